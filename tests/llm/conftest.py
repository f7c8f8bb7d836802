"""Texts that repeat in all the ways the operators care about."""

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))


@pytest.fixture(scope="session")
def corpus():
    """(id, text): copies, near copies, shared passages and lines, null and empty texts, one long text."""
    r = random.Random(5)
    vocabulary = ["".join(r.choices("abcdeéßXYZ.,", k=r.randint(1, 7))) for _ in range(400)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    docs, base, passage = [], text(80).split(), text(30)
    line = "This Line stands in very many documents, word by word, here"
    for i in range(40):
        docs.append(text(r.randint(0, 120)))
    for _ in range(30):  # near copies
        w = list(base)
        for _ in range(r.randint(0, 5)):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        docs.append(" ".join(w))
    for i in range(12):
        docs.append(text(r.randint(0, 40)) + " " + passage + "\n" + text(r.randint(0, 30)))
        docs.append(text(5) + "\n \t" + (line if i % 2 else line.upper()) + " \n" + text(9) + "\n" + line)
    docs += [docs[0], docs[0], docs[45], None, "", "  \n\t ", "one", "One", "two words", "two  WORDS", "é" * 45, text(6000), (passage + " ") * 7]
    r.shuffle(docs)
    return list(enumerate(docs))


@pytest.fixture(scope="session")
def frame(spark, corpus):
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or ""), i) for i, t in corpus], "doc_id long, text string, lang string, source string, n_chars long, n_words long").repartition(5)
