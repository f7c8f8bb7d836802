"""Scalars: the rules written out on hand-made rows, and properties of the distances."""

import itertools
import json
import random
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fieldscore.functions import distance as D
from fieldscore.functions import jsontext as J
from fieldscore.functions import text as T


def column(spark, values, make, kind="string"):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}")
    return [r[0] for r in df.select("i", make(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


def test_strict_object(spark):
    good = ['{"a":1}', " {} ", '{"a":{"b":null}}', '{"a":1,"a":2}', '{"a":"]}"}', ' {"a":{"b":[1,{"c":"\\"]"}]}} ', '{"a":"[","b":"\\\\"}', '{"a":"' + 'x\\"' * 20000 + '"}']
    bad = ['{"a":1} more', "[1]", '"x"', "", None, '{"a":1},{"b":2}', "1", '{"a":NaN}', '{"a":1}] trailing', '{"a":1}],[{"b":2}', '{"a":1}]', '{"a":[1,2}]', '{"a":"x"}] and "then', '{"a":1}}', '[{"a":1}]']
    assert column(spark, good + bad, lambda c: J.strict_object(c).isNotNull()) == [True] * len(good) + [False] * len(bad)
    for t in good:
        assert isinstance(json.loads(t), dict)
    assert column(spark, ['{"a":1,"b":3,"a":2}'], lambda c: F.to_json(J.strict_object(c))) == ['{"a":2,"b":3}']
    # a repeated key stands where it came first, with its last value
    assert column(spark, ['{"a":1,"b":{"c":1,"c":"x"},"a":2}'], J.ordered_string) == ['{"a":2,"b":{"c":1,"c":"x"}}']


def test_numbers_as_python_shows_them(spark):
    texts = ["1.0", "1e5", "0.00001", "0.0001", "-0", "1e16", "123456789.5", "1.5e300", "12", "1e15", "-2.5e-7", "0.1", "-0.0", "1234567890123456789012", "9007199254740993.0", "1e22", "1E400", "-1E400"]
    assert column(spark, texts, J.number_text) == [str(json.loads(t)) for t in texts]


@pytest.mark.parametrize(("mode", "text", "found"), [
    ("fence_strip", '```json\n{"a":"1"}\n```\nmore', '{"a":"1"}'),
    ("outer_span", 'x {"a":"1"} y', '{"a":"1"}'),
    ("outer_span", '{"a":"1"} and {"b":"2"}', "{}"),
    ("first_balanced", 'x {"a":{"b":"1"}} {"c":"2"}', '{"a":{"b":"1"}}'),
    ("first_balanced", '{"a":"}"} tail', "{}"),
    ("first_balanced", "no braces", "{}"),
    ("longest_prefix", '{"a":"1"} } tail }', '{"a":"1"}'),
    ("nested_regex", '{"a":"1"} {"b":{"c":"2"}}', '{"b":{"c":"2"}}'),
    ("greedy", 'x {"a":"1"}', '{"a":"1"}'),
])
def test_extract(spark, mode, text, found):
    assert column(spark, [text, None], lambda c: J.extract_object(c, mode)) == [found, "{}"]


def test_extract_options(spark):
    assert column(spark, ["none"], lambda c: J.extract_object(c, "greedy", on_fail="raw")) == ["none"]
    assert column(spark, ["none"], lambda c: J.extract_object(c, "greedy", on_fail="template", template='{"a":""}')) == ['{"a":""}']
    assert column(spark, ['{"a":1,"b":2,"c":3}', '{"a":1,"b":2,"c":3,"d":4}'], lambda c: J.extract_object(c, "greedy", min_keys=4)) == ["{}", '{"a":1,"b":2,"c":3,"d":4}']


def test_ordered_string(spark):
    texts = ['{"b": 1, "a":{"d":"é","c":null}, "k\\"":[1, 2]}', "{}", "[1]", None]
    assert column(spark, texts, J.ordered_string) == ['{"b":1,"a":{"d":"é","c":null},"k\\"":[1,2]}', "{}", None, None]
    assert column(spark, texts[:1], lambda c: J.ordered_string(c, indent=True)) == ['{\n  "b": 1,\n  "a": {"d":"é","c":null},\n  "k\\"": [1,2]\n}']


def test_prefix_and_escape(spark):
    assert column(spark, ["User: OCR: Assistant: x", "assistant: a\nASSISTANT: OCR: b", "ocr: c", "d"], J.strip_chat_prefix) == ["x", "b", "c", "d"]
    assert column(spark, [r"{\"a\":\"b\"}", r"a \"b\" c", r"\"\"\"\" \x"], J.unescape_once) == ['{"a":"b"}', r"a \"b\" c", r"\"\"\"\" \x"]


def test_normal_forms(spark):
    assert column(spark, ["é  a\tb ", None], T.normalize_text) == ["é a b", None]
    assert column(spark, ["Straße-\n weg: 1", "ﬁx Ä"], T.schema_form) == ["strasseweg:1", "fixä"]
    assert column(spark, ["A-b: c!"], T.content_form) == ["a-bc"]
    assert column(spark, ["1.2.3 a.b 4."], T.decimal_comma) == ["1,2,3 a.b 4."]
    assert column(spark, ["Ä\\Bé.JPG"], T.file_key) == ["a/be.jpg"]
    assert column(spark, ["Inv. Nr.: 7  — Foto  Nr 3\r\nVers. Wert"], T.clean_labels) == ["Inv.Nr: 7 - Foto Nr 3\nVers.-Wert"]


def test_line_classes(spark):
    assert column(spark, ["%%", "a", "ab", "#*+!&/()=?", "éè"], T.is_noise) == [True, True, False, True, False]
    assert column(spark, ["x" * 75, "a " * 27 + "bb", "x" * 60 + ".", "short."], T.is_paragraph) == [True, True, True, False]
    assert column(spark, ["L 4", "B 2", "T3", "1 x 2 x 3", "3 cm", "1,2 3,4", "plain 4"], T.is_measurement) == [True] * 6 + [False]


texts = st.text("abä c", max_size=12)


@settings(max_examples=200, deadline=None)
@given(texts, texts)
def test_alignment(a, b):
    s, d, i = D.alignment(a, b)
    table = np.zeros((len(a) + 1, len(b) + 1), int)
    for x, y in itertools.product(range(len(a) + 1), range(len(b) + 1)):
        table[x, y] = x + y if not x or not y else min(table[x - 1, y] + 1, table[x, y - 1] + 1, table[x - 1, y - 1] + (a[x - 1] != b[y - 1]))
    assert s + d + i == table[-1, -1]
    assert len(a) - d + i == len(b)


def test_alignments_of_many_pairs():
    """Made together as one by one: substitutions preferred, then deletions, walked back through a plain table."""
    r = random.Random(5)
    word = lambda most: "".join(r.choices("abé", k=r.randint(0, most)))

    def plain(a, b):
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for x, y in itertools.product(range(len(a) + 1), range(len(b) + 1)):
            table[x, y] = x + y if not x or not y else min(table[x - 1, y] + 1, table[x, y - 1] + 1, table[x - 1, y - 1] + (a[x - 1] != b[y - 1]))
        x, y, out = len(a), len(b), [0, 0, 0]
        while x or y:
            if x and y and table[x, y] == table[x - 1, y - 1] + (a[x - 1] != b[y - 1]):
                out[0] += a[x - 1] != b[y - 1]
                x, y = x - 1, y - 1
            elif x and table[x, y] == table[x - 1, y] + 1:
                out[1], x = out[1] + 1, x - 1
            else:
                out[2], y = out[2] + 1, y - 1
        return tuple(out)

    pairs = [(word(12), word(12)) for _ in range(400)] + [(word(60), word(60)) for _ in range(30)] + [("x", "y"), ("", ""), ("ab", ""), ("", "ab"), ("x\0", "x")]
    pairs += pairs[:50]
    made = D.alignments([a for a, _ in pairs], [b for _, b in pairs])
    assert list(zip(*[m.tolist() for m in made], strict=True)) == [plain(a, b) for a, b in pairs]
    assert D.alignments(["e" * 2_000, "k"], ["e" * 1_990, "l" * 140_000])[1].tolist() == [10, 0]  # tables of any width
    assert [m.tolist() for m in D.alignments([], [])] == [[], [], []]


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 5), st.integers(1, 5), st.integers(0, 10**6))
def test_matching_by_parts(n, m, seed):
    r = np.random.default_rng(seed)
    score = r.choice([0.5, 0.7, 0.9, 1.0], (n, m)) * (r.random((n, m)) < 0.4)
    a = score if n <= m else score.T
    best = max(sum(a[i, p[i]] for i in range(len(a))) for p in itertools.permutations(range(a.shape[1]), len(a)))
    assert abs(D.matching_by_parts(score) - best) < 1e-9


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 5), st.integers(1, 5), st.integers(0, 10**6))
def test_matching(n, m, seed):
    score = np.random.default_rng(seed).random((n, m))
    a = score if n <= m else score.T
    best = max(sum(a[i, p[i]] for i in range(len(a))) for p in itertools.permutations(range(a.shape[1]), len(a)))
    assert abs(D.best_matching(score) - best) < 1e-9


def test_distances(spark):
    r = random.Random(4)
    pairs = [("".join(r.choices("abä", k=r.randint(0, 8))), "".join(r.choices("abä", k=r.randint(0, 8)))) for _ in range(60)]
    df = spark.createDataFrame(pairs, "h string, r string").select("*", D.edits(F.col("h"), F.col("r")).alias("e"), D.string_anls(F.col("h"), F.col("r")).alias("a"), D.edit_ops(F.col("r"), F.col("h")).alias("o"))
    for row in df.collect():
        assert row.e == sum(row.o) == sum(D.alignment(row.r, row.h))
        m = max(len(row.h), len(row.r))
        assert abs(len(row.h) - len(row.r)) <= row.e <= m
        assert row.a == pytest.approx(1.0 if not m else (s if (s := 1 - row.e / m) >= 0.5 and row.h and row.r else 0.0))


def test_list_anls(spark):
    df = spark.createDataFrame([(["ab", "cd"], ["cd", "ab"]), (["ab"], ["ab", "x"]), ([], []), ([], ["a"]), (None, ["a"])], "p array<string>, g array<string>")
    assert [r[0] for r in df.select(D.list_anls(F.col("p"), F.col("g"))).collect()] == [1.0, 0.5, 1.0, 0.0, 0.0]
    # two good pairs are worth more than an equal one
    df = spark.createDataFrame([(["ab", "aba"], ["aba", "ba"])], "p array<string>, g array<string>")
    assert [r[0] for r in df.select(D.list_anls(F.col("p"), F.col("g"))).collect()] == [pytest.approx(2 / 3)]
    words = [f"w{i}" * 3 for i in range(300)]  # a long list in another order, one word misspelt
    df = spark.createDataFrame([(words[::-1], [*words[:-1], words[-1] + "x"])], "p array<string>, g array<string>")
    assert [r[0] for r in df.select(D.list_anls(F.col("p"), F.col("g"))).collect()] == [pytest.approx((299 + 1 - 1 / 13) / 300)]


def test_distance_of_long_texts(spark):
    """Against a plain table, whatever the band; long near texts end."""
    r = random.Random(6)

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    for _ in range(150):
        a = "".join(r.choices("abé", k=r.randint(0, 60)))
        b = "".join(r.choices("abé", k=r.randint(0, 60))) if r.random() < 0.3 else "".join(c for c in a if r.random() > 0.1) + r.choice(["", "ab", "é" * 30])
        assert D.long_distance(a, b) == plain(a, b)
    long = "".join(r.choices("äöüabc ", k=120_000))
    assert D.long_distance(long, long[:500] + "x" + long[600:]) == 100
    rows = [(long, long[:-3]), (long, long), ("", long), ("kurz", "kürz"), (None, long)]
    df = spark.createDataFrame(rows, "a string, b string")
    assert [x[0] for x in df.select(D.edits_of_any_length(F.col("a"), F.col("b"))).collect()] == [3, 0, len(long), 1, None]


def plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def _near(rng, text, letters):
    out = list(text)
    for _ in range(rng.randint(0, 6)):
        at = rng.randint(0, len(out))
        out[at : at + rng.randint(0, 2)] = rng.choices(letters, k=rng.randint(0, 2))
    return "".join(out)


def test_distances_of_many_pairs():
    """Pairs of all lengths around whole words of bits, near and far ones, against the plain table; long texts in little time."""
    rng, letters = random.Random(3), "abcäß€𝄞"
    pairs = []
    for _ in range(300):
        a = "".join(rng.choices(letters, k=rng.choice([0, 1, 2, 20, 63, 64, 65, 128, 140])))
        pairs.append((a, _near(rng, a, letters) if rng.random() < 0.6 else "".join(rng.choices(letters, k=rng.randint(0, 140)))))
    want = [plain(a, b) for a, b in pairs]
    assert D.distances(*zip(*pairs)).tolist() == want
    assert [D._by_bits(a, b) for a, b in pairs if a and b] == [w for (a, b), w in zip(pairs, want) if a and b]
    assert [D._farthest(a, b, 300) for a, b in pairs if len(a) <= len(b)] == [w for (a, b), w in zip(pairs, want) if len(a) <= len(b)]
    text = "".join(rng.choices("abcdefghij ", k=40_000))
    started = time.time()
    assert D.long_distance(text, re.sub("(.{80}).", r"\1", text)) == 493
    assert time.time() - started < 20


@pytest.mark.parametrize("n, m", [(1, 1), (2, 4), (4, 2), (4, 4), (5, 6)])
def test_matchings_of_many_tables(n, m):
    score = np.random.default_rng(n).choice([0, 0.5, 0.6, 0.9, 1.0], (40, n, m))
    for s, got in zip(score, D.best_matchings(score), strict=True):
        wide = s if n <= m else s.T
        assert abs(got - max(sum(wide[i, c] for i, c in enumerate(o)) for o in itertools.permutations(range(wide.shape[1]), wide.shape[0]))) < 1e-9


def test_plain_substitutions_fill_no_table(monkeypatch):
    monkeypatch.setattr(D, "_tables", None)
    ref = "the letter e is read as another one, here and there" * 4
    swapped, deleted, added = D.alignments([ref, ref, ref], [ref.replace("e", "c"), ref + " and more", ref[:10] + ref[14:]])
    assert swapped.tolist() == [ref.count("e"), 0, 0] and deleted.tolist() == [0, 0, 4] and added.tolist() == [0, 9, 0]


def test_bounds_settle_distances(monkeypatch):
    """What bounds tell is the plain distance, and replaced or left-out letters fill no table."""
    rng = random.Random(6)
    pairs = [("", ""), ("", "a"), ("a\0", "a"), ("\0a", "a"), ("ab", "ba"), ("abcd", "bcda"), ("𝄞" * 9, "𝄞" * 8), ("\ud800a", "a\udc00")]
    for _ in range(600):
        a = "".join(rng.choices("abcdeäß€𝄞", k=rng.choice([1, 2, 5, 20, 65, 140])))
        b = a.replace(rng.choice("abc"), rng.choice("x.a")) if rng.random() < 0.4 else "".join(c for c in a if rng.random() < 0.8) if rng.random() < 0.5 else _near(rng, a, "abcä")
        pairs.append((a, b) if rng.random() < 0.5 else (b, a))
    want = [plain(a, b) for a, b in pairs]
    for cells in (D.BOUND_CELLS, 64 * 200, 64):
        monkeypatch.setattr(D, "BOUND_CELLS", cells)
        told = D.settled(*zip(*pairs)).tolist()
        assert all(t in (-1, w) for t, w in zip(told, want, strict=True)) and (cells < 64 * 200 or sum(t >= 0 for t in told) > 300)
        assert D.distances(*zip(*pairs)).tolist() == want
    monkeypatch.undo()
    monkeypatch.setattr(D, "_columns", None)
    ref = "the letter e is read as another one, here and there" * 3
    others = [ref.replace("e", "."), ref.replace("e", ""), ref + " and more", ref[:10] + ref[14:]]
    assert D.distances(others, [ref] * 4).tolist() == [ref.count("e"), ref.count("e"), 9, 4]
