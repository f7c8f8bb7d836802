"""Hard negatives, fingerprints and spelling variants against plain versions."""

import collections
import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldscore.llm import fingerprints, negatives, spelling

VECTORS = "vec_id long, embedding array<float>, label int, score int, asked string"


# -- hard negatives --------------------------------------------------------------------------------------------------


def plain_negatives(rows, positives=5, negatives_=10):
    """Over rows (id, vector, label), each its own."""
    kept = []
    for i, v, label in rows:
        if i is None or label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((i, [math.floor(256 * float(np.float32(x))) for x in v], (label + 1) % 10 if i % 7 == 0 else label))
    out = []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    for k, (i, v, label) in enumerate(kept):
        if i % 100:
            continue
        others = [(-dot(v, w), j, m) for n, (j, w, m) in enumerate(kept) if n != k and len(w) == len(v)]
        for s, p, _ in sorted(x for x in others if x[2] == label)[:positives]:
            fits = sorted(x for x in others if x[2] != label and 30 * -s <= 100 * -x[0] <= 90 * -s)[:negatives_]
            out += [(i, p, r + 1, j, -s, -t) for r, (t, j, _) in enumerate(fits)]
    return sorted(out)


def mined(frame, **more):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    out = negatives.mine_negatives(frame, F.col("id") % 100 == 0, label, **more)
    return sorted(tuple(r)[:6] for r in out.collect()), out


def test_hard_negatives_as_by_hand(spark):
    r = random.Random(3)
    centres = [[r.gauss(0, 1) for _ in range(6)] for _ in range(8)]
    rows = []
    for i in range(900):
        c = centres[i % 8]
        rows.append((i, [x + r.gauss(0, 0.2) for x in c], r.randrange(4)))
    rows += [(1000 + i, rows[5][1], 2) for i in range(300)]  # a hot vector, with anchors among its rows
    rows += [(100, rows[100][1], 1), (100, rows[100][1], rows[100][2]), (200, rows[7][1], rows[200][2])]  # ids that repeat
    rows += [(None, [1.0] * 6, 1), (2000, None, 1), (2001, [], 1), (2002, [1.0] * 6, None), (2003, [1.0, None] * 3, 1), (2004, [float("nan")] + [1.0] * 5, 1), (2005, [float("inf")] + [1.0] * 5, 1)]
    rows += [(2100, [0.5, 0.5], 1), (2101, [0.5, 0.4], 1), (2102, [0.3, 0.3], 2), (2200, [0.0] * 6, 1)]
    frame = spark.createDataFrame([(i, v, x, 7, "clash") for i, v, x in rows], VECTORS).repartition(5)
    want = plain_negatives(rows)
    for more in ({}, {"pivots": 4, "block_rows": 100}, {"pivots": 1, "block_rows": 5000}):
        got, out = mined(frame, **more)
        assert got == want
    assert len(want) > 100


def test_nodes_outside_are_skipped(spark):
    """On vectors in clusters most rows are never compared with an anchor."""
    r = np.random.default_rng(1)
    centres = r.standard_normal((40, 12))
    rows = [(i, (centres[i % 40] + 0.02 * r.standard_normal(12)).tolist(), int(i % 40) % 10, 0, "") for i in range(4000)]
    got, out = mined(spark.createDataFrame(rows, VECTORS).repartition(3))
    seen = [x.verified for x in out.select("anchor_id", "verified").distinct().collect()]
    assert got == plain_negatives([x[:3] for x in rows]) and sum(seen) / len(seen) < 0.5 * len(rows)


def test_large_components_and_empty_tables(spark):
    rows = [(0, [1e30, -1e30], 1, 0, ""), (1, [1e30, 1.0], 1, 0, ""), (2, [2.0**17, 0.0], 2, 0, "")]
    assert mined(spark.createDataFrame(rows, VECTORS))[0] is not None
    assert mined(spark.createDataFrame([], VECTORS))[0] == []
    assert mined(spark.createDataFrame([(100, [1.0], 1, 0, "")], VECTORS))[0] == []


# -- fingerprints ----------------------------------------------------------------------------------------------------


def edited_by_hand(docs):
    ordered = sorted({(i, t or "") for i, t in docs if i is not None})
    assert len({i for i, _ in ordered}) == len(ordered)
    out = {}
    for k, (i, t) in enumerate(ordered):
        m = len(t) // 4
        out[i] = (len(t), hashlib.sha256((t[: len(t) - m] + ordered[(k + 1) % len(ordered)][1][:m]).encode()).hexdigest())
    return out


def test_fingerprints(spark, frame, corpus):
    rows = fingerprints.fingerprint_edits(frame).collect()
    assert len(rows) == len(corpus)
    want = edited_by_hand(corpus)
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in rows} == want
    texts = {i: t or "" for i, t in corpus}
    prints = collections.defaultdict(set)
    for r in rows:
        prints[texts[r.doc_id]].add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert r.near_edited == plain_likeness(r.fingerprint, r.edited_fingerprint)
    assert all(len(x) == 1 for x in prints.values())
    by_id = {r.doc_id: r for r in rows}
    ids = sorted(by_id)
    for a, b in zip(ids, ids[1:] + ids[:1], strict=True):
        assert by_id[a].near_next == plain_likeness(by_id[a].fingerprint, by_id[b].fingerprint)
    same = {r.doc_id: r.fingerprint for r in fingerprints.fingerprint(frame).collect()}
    assert same == {r.doc_id: r.fingerprint for r in rows}


def plain_likeness(a, b):
    if not a or not b:
        return float(a == b)
    cut = lambda s: [s[i : i + 8] for i in range(0, len(s), 8)]
    return sum(x == y for x, y in zip(cut(a), cut(b), strict=True)) / len(cut(a))


def test_edits_stay_near_and_others_do_not(spark):
    r = random.Random(9)
    words = ["".join(r.choices("abcdefghijklmnop", k=6)) for _ in range(4000)]
    docs = [(i, " ".join(r.choices(words, k=r.randint(40, 400)))) for i in range(300)]
    rows = fingerprints.fingerprint_edits(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()
    assert sum(x.near_edited for x in rows) / len(rows) > 0.35 and sum(x.near_next for x in rows) / len(rows) < 0.05
    assert sum(x.near_edited > x.near_next for x in rows) > 0.98 * len(rows)


def test_fingerprint_cases(spark):
    schema = "doc_id long, text string, no int, term string, head string"
    docs = [(3, "ab cd ef gh ij kl"), (3, "ab cd ef gh ij kl"), (3, "other words here"), (None, "no id at all"), (1, None), (2, ""), (9, "?!"), (7, "x" * 200_000 + " y")]
    rows = fingerprints.fingerprint_edits(spark.createDataFrame([(*d, 1, "t", "h") for d in docs], schema).repartition(3)).collect()
    assert sorted((r.doc_id or 0, r.n_chars) for r in rows) == sorted((i or 0, len(t or "")) for i, t in docs)
    assert len({r.fingerprint for r in rows if r.doc_id == 3}) == 2
    assert {r.fingerprint for r in rows if r.doc_id in (1, 2, 9)} == {""}
    one = fingerprints.fingerprint_edits(spark.createDataFrame([(5, "abcdefgh", 1, "", "")], schema)).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and one[0].near_next == 1
    assert fingerprints.fingerprint_edits(spark.createDataFrame([], schema)).count() == 0
    assert fingerprints.fingerprint(spark.createDataFrame([], schema)).count() == 0


def plain_fingerprints(spark, docs, texts):
    """Of ``texts``, by the lexicon of ``docs``: all terms of the band, or all terms."""
    terms = lambda t: {w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t)) if w}
    counts = collections.Counter(w for t in docs for w in terms(t))
    high = max(2, int(len(docs) * fingerprints.MOST))
    rows = [(i, sorted({w for w in terms(t) if 2 <= counts[w] <= high} or terms(t))) for i, t in enumerate(texts)]
    used = spark.createDataFrame(rows, "i int, w array<string>").select("i", fingerprints.hashes("w").alias("t"))
    return [r.s for r in sorted(used.select("i", fingerprints.signature("t").alias("h")).select("i", fingerprints.as_text("h").alias("s")).collect())]


def edited_texts(docs):
    texts = [t for _, t in sorted(docs)]
    return [t[: len(t) - len(t) // 4] + u[: len(t) // 4] for t, u in zip(texts, texts[1:] + texts[:1], strict=True)]


def test_fingerprints_use_all_terms(spark):
    """Long texts of words that all hold, with few of the band; the two of a pair share these and nothing else tells them apart."""
    r = random.Random(8)
    docs = []
    for i in range(200):
        words = [f"common{k}" for k in range(400)] + [f"pair{i // 2}x{k}" for k in range(3)] + [f"only{i}x{k}" for k in range(40)]
        r.shuffle(words)
        docs.append((i, " ".join(words)))
    rows = sorted(fingerprints.fingerprint_edits(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect())
    assert [x.fingerprint for x in rows] == plain_fingerprints(spark, [t for _, t in docs], [t for _, t in docs])
    assert [x.edited_fingerprint for x in rows] == plain_fingerprints(spark, [t for _, t in docs], edited_texts(docs))
    assert all((x.near_next == 1) == (x.doc_id % 2 == 0) for x in rows) and len({x.fingerprint for x in rows}) == 100


def test_fingerprints_as_by_hand(spark, corpus):
    """Short words, so that those which an edit cuts or joins are often the lexicon's; copies, empty and odd texts."""
    r = random.Random(6)
    docs = [(i, t or "") for i, t in corpus] + [(1000 + i, "".join(r.choices("aB,é ", k=r.randint(0, 60)))) for i in range(300)]
    rows = sorted(fingerprints.fingerprint_edits(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect())
    assert [x.fingerprint for x in rows] == plain_fingerprints(spark, [t for _, t in docs], [t for _, t in docs])
    assert [x.edited_fingerprint for x in rows] == plain_fingerprints(spark, [t for _, t in docs], edited_texts(docs))
    assert {r.doc_id: r.fingerprint for r in fingerprints.fingerprint(spark.createDataFrame([(str(i), t) for i, t in docs], "doc_id string, text string")).collect()} == {str(x.doc_id): x.fingerprint for x in rows}


# -- spelling variants -----------------------------------------------------------------------------------------------


def plain_variants(docs):
    counts = collections.Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'null' if i is None else i}:{low}".encode())
            k = h % len(low)
            counts[low[:k] + low[k + 1 :] if h % 97 == 0 else low] += 1
    kept = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    near = {a: [b for b in kept if a != b and abs(len(a) - len(b)) < 2 and distance_one(a, b)] for a in kept}
    form = {}
    for w, n in kept.items():
        best = min(near[w], key=lambda x: (-kept[x], x), default=None)
        form[w] = best if best is not None and kept[best] >= 2 * n else None
    out = []
    for w, n in kept.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), kept[form[w]] if form[w] else None))
    return sorted(out)


def distance_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def variants(df):
    return sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect())


@pytest.fixture(scope="module")
def misspelt():
    r = random.Random(4)
    base = ["".join(r.choices("abcdeßéöst", k=r.randint(5, 9))) for _ in range(60)] + ["aaaaa", "aaaaaa", "aaaaaaa", "abababab", "babababa", "ab" * 40]
    docs = []
    for i in range(400):
        words = []
        for _ in range(30):
            w = r.choice(base)
            if r.random() < 0.3:
                k = r.randrange(len(w))
                w = r.choice([w[:k] + w[k + 1 :], w[:k] + r.choice("abcÀ") + w[k:], w[:k] + r.choice("abé") + w[k + 1 :]])
            words.append(w.title() if r.random() < 0.2 else w)
        docs.append((i, r.choice([" ", ", ", "1", "\n"]).join(words)))
    return [*docs, (None, "hello hello hello World"), (5, docs[5][1]), (800, None), (801, ""), (802, "x1y2 ×÷ 12"), (803, "Straße " * 5000)]


def test_variants_as_by_hand(spark, misspelt, monkeypatch):
    frame = spark.createDataFrame([(i, t, 1, "g") for i, t in misspelt], "doc_id long, text string, n int, word string").repartition(7)
    want = plain_variants(misspelt)
    assert variants(spelling.group_variants(frame)) == want
    assert sum(x[1] is not None for x in want) > 50 and any(x[2] not in (x[0], x[1]) for x in want)
    # other dictionaries, tiles and counts held give the same
    monkeypatch.setattr(spelling, "FREQUENT", 2)
    monkeypatch.setattr(spelling, "LIST_ROWS", 3)
    monkeypatch.setattr(spelling, "FEW", 0)
    monkeypatch.setattr(spelling, "HELD_WORDS", 50)
    assert variants(spelling.group_variants(frame)) == want


def test_variants_are_not_broadcast(spark, misspelt):
    """A table of grams looks as small as the file of its words; here any broadcast ends the job."""
    docs = misspelt[:60]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    before = spark.conf.get("spark.sql.maxBroadcastTableSize")
    spark.conf.set("spark.sql.maxBroadcastTableSize", "1")
    try:
        assert variants(spelling.group_variants(frame)) == plain_variants(docs)
    finally:
        spark.conf.set("spark.sql.maxBroadcastTableSize", before)


def test_hashes_of_id_and_run():
    r = random.Random(1)
    parts = [(f"{r.randrange(10**9)}:".encode(), bytes(r.choices(range(256), k=r.randint(1, spelling.SHORT_RUN)))) for _ in range(500)]
    crcs = np.array([[zlib.crc32(a), zlib.crc32(b)] for a, b in parts], np.uint32)
    assert spelling.joined_crc(crcs[:, 0], crcs[:, 1], np.array([len(b) for _, b in parts])).tolist() == [zlib.crc32(a + b) for a, b in parts]


def test_long_lists_need_few_comparisons(spark, monkeypatch, tmp_path):
    """A list of words that are far from each other is not compared pair by pair."""
    calls, plain = str(tmp_path / "calls"), spelling.one_edit

    def counted(a, b):
        with open(calls, "ab") as f:
            f.write(b"x")
        return plain(a, b)

    monkeypatch.setattr(spelling, "one_edit", counted)
    monkeypatch.setattr(spelling, "FREQUENT", 1000)
    r = random.Random(7)
    words = sorted({"".join(r.choices("abcd", k=8)) for _ in range(250)})
    near = sorted(tuple(x) for x in spelling.near_words(spark.createDataFrame([(w,) for w in words], "word string")).collect())
    assert near == sorted((a, b) for a in words for b in words if a < b and distance_one(a, b))
    assert not os.path.exists(calls) or os.path.getsize(calls) < 3 * len(words)


def test_no_words(spark):
    assert spelling.group_variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert spelling.group_variants(spark.createDataFrame([(1, None), (2, "ab 12")], "doc_id long, text string")).count() == 0


def test_grams_cover_all_edits():
    """What an edit doesn't touch is found again in its place from the left or the right."""
    r = random.Random(2)
    words = ["".join(r.choices("abc", k=r.randint(5, 9))) for _ in range(200)]
    counts = collections.Counter(g for w in words for q in range(2, 5) for g in {spelling.marked(w)[p : p + q] for p in range(len(w) + 3 - q)})
    frequent = frozenset(g for g, n in counts.items() if n > 20)
    for w in words:
        k = r.randrange(len(w))
        for v in (w[:k] + w[k + 1 :], w[:k] + "d" + w[k:], w[:k] + "d" + w[k + 1 :]):
            a, b = spelling.decompose(w, frequent), spelling.decompose(v, frequent)
            kept = {(p, g) for p, g in enumerate(a)} & {(p, g) for p, g in enumerate(b)}
            behind = {(len(a) - p, g) for p, g in enumerate(a)} & {(len(b) - p, g) for p, g in enumerate(b)}
            shared = {p for p, _ in kept} | {len(a) - p for p, _ in behind}
            assert len(shared) >= len(a) - spelling.affected(a)
