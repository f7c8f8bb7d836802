"""Operators on hand-made rows: the quirks that have to be kept."""

import re

import pytest
from pyspark.sql import functions as F

from fieldscore.operators import align, datasets, history, layout, metrics, resolve, shape


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*(columns or df.columns)).collect()), key=repr)


def test_resolve(spark):
    lines = ['{"predicted_json":{},"predicted_text":"{}","target_json":{"a":"1"}}', '{"prediction":" x ","ground_truth":"y"}', '{"ground_truth":{"b":1},"raw_response":"{\\"c\\":2}"}', "broken"]
    out = resolve.resolve_rows(spark.createDataFrame([(x,) for x in lines], "raw string")).drop("raw")
    assert [tuple(r) for r in out.collect()] == [("{}", "{}", '{"a":"1"}', None), (None, "x", None, "y"), ('{"c":2}', '{"c":2}', '{"b":1}', None), (None, None, None, None)]
    taken = out.select(resolve.path_taken(F.col("pred_json"), F.col("gt_json"), F.col("pred_str"), F.col("gt_str")))
    assert [r[0] for r in taken.collect()] == ["json", "string", "json", "skipped"]


def test_flatten(spark):
    texts = ['{"a":"1","b":{"c":null,"d":{"e":["x","y"]}},"f":{},"g":true,"k.l":2}', "no", '{"a":{"b":{"c":{"d":"deep"}}}}']
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    assert rows(shape.flatten(df, ["i"], "t")) == [
        (0, "a", "1"), (0, "b.c", ""), (0, "b.d.e", '["x","y"]'), (0, "g", "true"), (0, "k.l", "2"), (2, "a.b.c.d", "deep"),
    ]
    assert rows(shape.flatten_typed(df, ["i"], "t", ["a", "b.c", "b.d.e", "g", "z"])) == [(0, "a", "1"), (0, "b.c", ""), (0, "b.d.e", '["x","y"]'), (0, "g", "true"), (2, "a", '{"b":{"c":{"d":"deep"}}}')]


def test_leaves(spark):
    texts = ['{ "z": {"y": 1.50, "b": [{"q":" r ","p":[1,null]}, "s"]}, "a":"\\u00e9|x", "g":{"b":{"c":{"d":{"e":{"f":"deep"}}}}}}', "[1]", None, "{}", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    assert rows(shape.leaves(df, ["i"], "t")) == [
        (0, 0, "z.y", "1.5", None), (0, 1, "z.b", '[{"p":[1,null],"q":" r "},"s"]', ['{"p":[1,null],"q":" r "}', "s"]), (0, 2, "a", "é|x", None), (0, 3, "g.b.c.d.e.f", "deep", None),
    ]
    opened = shape.leaves(df, ["i"], "t", open_lists=True)
    assert [r.path for r in opened.orderBy("position").collect()] == ["z.y", "z.b.0.q", "z.b.0.p.0", "z.b.0.p.1", "z.b.1", "a", "g.b.c.d.e.f"]
    assert rows(shape.leaf_text(opened, ["i"])) == [(0, "1.5 r 1 s é|x deep")]
    assert shape.leaves(df.limit(0), ["i"], "t").count() == 0


def test_flatten_reads_once(spark, tmp_path):
    spark.createDataFrame([(1, '{"a":{"b":1}}')], "i int, t string").write.parquet(str(tmp_path / "t"))
    plan = shape.flatten(spark.read.parquet(str(tmp_path / "t")), ["i"], "t")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 and "Exchange" not in plan


def test_nested_string(spark):
    made = spark.createDataFrame([(1, "M.L", "3"), (1, "Inv.Nr", 'q"')], "doc_id int, path string, value string")
    fields = ("Inv.Nr", "M.L", "M.B", "Z")
    assert rows(shape.nested_string(shape.conform(made, ["doc_id"], fields), ["doc_id"], fields, ("M",))) == [(1, '{"Inv.Nr":"q\\"","M":{"L":"3","B":""},"Z":""}')]


def test_nested_report(spark):
    texts = ['{"a|b":[1,"x"],"k":[{"x":1,"y":true},{"y":false,"x":"|"}],"m":[{"x":1},2],"s":null}', "no", "{}"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    assert rows(shape.nested_report(df, ["i"], "t")) == [
        (0, "| Field | Value |\n| --- | --- |\n| s |  |\n\n#### a|b\n\n| Value |\n| --- |\n| 1 |\n| x |\n\n#### k\n\n|  | x | y |\n| --- | --- | --- |\n| #1 | 1 | ✓ |\n| #2 | \\| |  |\n\n"
            '#### m\n\n```json\n[{"x":1},2]\n```\n\n'),
        (2, ""),
    ]


def test_anls_of_lists(spark):
    records = [(1, '{"r":{"up":["abcd","x","y"],"n":"z"}}', '{"r":{"up":["y","abcx"],"n":"z"}}'), (2, '{"r":["a"]}', '{"r":"a"}'), (3, '{"r":["a","b"]}', "{}"), (4, '{"r":[]}', '{"r":[]}')]
    df = spark.createDataFrame(records, "doc_id int, g string, p string")
    leaves = metrics.anls_leaves(shape.leaves(df, ["doc_id"], "g"), shape.leaves(df, ["doc_id"], "p"), "doc_id")
    assert rows(leaves) == [(1, "r.n", 1.0, 1), (1, "r.up", pytest.approx(1.75 / 3), 3), (2, "r", 0.0, 1), (3, "r", 0.0, 2), (4, "r", 1.0, 1)]
    assert {r.path: r.score for r in metrics.anls_paths(leaves, "doc_id").where("doc_id = 1").collect()}["r"] == pytest.approx(2.75 / 4)


def long(spark, *values):
    return spark.createDataFrame(list(values), "doc_id int, path string, value string")


def test_overlap(spark):
    gt = long(spark, (1, "a", "abcd"), (1, "b", "x"), (1, "empty", ""), (2, "a", "abcd"))
    pred = long(spark, (1, "a", "abcx"), (1, "c", "extra"), (1, "empty", ""))
    documents = spark.createDataFrame([(1, True), (2, False)], "doc_id int, valid boolean")
    counts = metrics.overlap_counts(gt, pred, documents, "doc_id", (0.8, 0.7))
    # a wrong field is a false positive and a false negative; an invalid document only misses; empty fields don't count
    assert rows(counts, "path", "threshold", "tp", "fp", "fn") == [
        ("a", 0.7, 1, 0, 1), ("a", 0.8, 0, 1, 2), ("b", 0.7, 0, 0, 1), ("b", 0.8, 0, 0, 1), ("c", 0.7, 0, 1, 0), ("c", 0.8, 0, 1, 0),
    ]
    score = {r.threshold: r for r in metrics.overlap_scores(counts).collect()}[0.7]
    assert (score.precision, score.recall) == (pytest.approx(1 / 3), pytest.approx(1 / 6))
    assert score.f1 == pytest.approx(2 * (1 / 3) * (1 / 6) / (1 / 3 + 1 / 6))  # of the means, not a mean


def test_recall_never_falls_with_the_threshold(spark):
    gt = long(spark, *[(i, "a", "abcdefghij") for i in range(10)])
    pred = long(spark, *[(i, "a", "abcdefghij"[:i] + "z" * (10 - i)) for i in range(10)])
    documents = spark.createDataFrame([(i, True) for i in range(10)], "doc_id int, valid boolean")
    score = sorted((r.threshold, r.recall) for r in metrics.overlap_scores(metrics.overlap_counts(gt, pred, documents, "doc_id")).collect())
    assert [r for _, r in score] == sorted((r for _, r in score), reverse=True)


def test_anls_nodes(spark):
    leaves = metrics.anls_leaves(long(spark, (1, "a.x", "abc"), (1, "a.y", "d"), (1, "b", "")), long(spark, (1, "a.x", "abc"), (1, "b", ""), (1, "c", "e")), "doc_id")
    assert rows(metrics.anls_paths(leaves, "doc_id")) == [(1, "", 0.5), (1, "a", 0.5), (1, "a.x", 1.0), (1, "a.y", 0.0), (1, "b", 1.0), (1, "c", 0.0)]


def test_rates(spark):
    s = metrics.pair_scores(spark.createDataFrame([("ab", "abc"), ("", ""), ("x", ""), ("abc", "abc")], "hyp string, ref string"))
    assert metrics.macro_cer(s).first()[0] == pytest.approx(1 / 6)
    assert metrics.macro_cer(s, empty="rate").first()[0] == pytest.approx((1 / 3 + 0 + 1 + 0) / 4)
    assert metrics.macro_cer(s.limit(0)).first()[0] == 1.0
    assert metrics.micro_cer(s).first()[0] == pytest.approx(2 / 6)
    assert [r[0] for r in spark.createDataFrame([(0.0,), (0.05,), (0.1,), (0.3,)], "c double").select(metrics.cer_band(F.col("c"))).collect()] == ["perfect", "good", "fair", "poor"]
    fields = metrics.field_cer(long(spark, (1, "a", "false")), long(spark, (1, "a", ""), (1, "z", "q")), "doc_id", falsy_as_empty=True)
    assert rows(fields) == [(1, "a", 0, 0, 0.0)]


def lines(spark, *texts):
    return spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "doc_id int, line_no int, line string")


def test_dehyphenate_takes_lines_in_pairs(spark):
    out = layout.dehyphenate(lines(spark, "a-", "b-", "c-", "d", "E-", "F", "g-"), "doc_id")
    assert [r.line for r in out.orderBy("line_no").collect()] == ["ab-", "cd", "E-", "F", "g-"]


def test_reading_order_chains(spark):
    boxes = spark.createDataFrame([(1, 0, 10.0, 0.0, 10.0, "b"), (1, 1, 0.0, 6.0, 10.0, "a"), (1, 2, 20.0, 12.0, 10.0, "c"), (1, 3, 0.0, 30.0, 10.0, "d")], "doc_id int, det_id int, x double, y double, h double, text string")
    out = layout.reading_order(boxes, "doc_id")
    assert rows(out, "line") == [("a b c",), ("d",)]  # each box is compared with the one before


def test_fields_by_header(spark):
    out = layout.fields_by_header(lines(spark, "x", "Material: Gold", "gold", "Silber", "Preis 5 DM", "Herkunft:", "Wald"), "doc_id")
    assert rows(out, "key", "value") == [("Herkunft", "Wald"), ("Material", "Gold Silber"), ("Preis", "5 dm")]


def test_fields_by_line(spark):
    out = layout.fields_by_line(lines(spark, "L 4,5", "nothing", "Preis: 5 Material: Gold", "und Silber", "Unbekannt: 7", "B 3"), "doc_id")
    # a value goes up to the next colon; a line with an unknown label ends the field before
    assert rows(out, "key", "value") == [("Maße", "L 4,5 B 3"), ("Preis", "5 Material und Silber")]


def test_inventory_number_falls_back_to_a_line(spark):
    out = layout.inventory_number(lines(spark, "heading", "more words", "nr 7"), "doc_id")
    assert rows(out) == [(1, "nr 7", 2)]


def test_files(spark):
    names = spark.createDataFrame([(1, "A.jpg"), (2, "ä.JPG"), (3, "x (7).jpg"), (4, "art"), (5, "gone.png"), (6, "")], "doc_id int, name string")
    files = spark.createDataFrame([("/f/A.jpg",), ("/f/a.jpg",), ("/f/IMG (7).jpg",), ("/f/start.tif",), ("/e/start.tif",)], "path string")
    assert rows(align.resolve_files(names, files, "doc_id", "name")) == [(1, "/f/A.jpg", 1), (2, "/f/A.jpg", 2), (3, "/f/IMG (7).jpg", 3), (4, "/e/start.tif", 4)]
    assert rows(align.resolve_by_stem(names, files, "doc_id", "name"), "doc_id", "reason")[-1] == (6, "no name")


def test_early_stop_and_best(spark):
    values = [0.5, 0.4, 0.395, 0.396, 0.394, 0.2]
    df = spark.createDataFrame([("r", i, v) for i, v in enumerate(values)], "run string, epoch int, value double")
    assert rows(history.early_stop(df, "run", "epoch", "value", 3, 0.01)) == [("r", 4)]
    tie = spark.createDataFrame([("r", 0, 0.1), ("r", 1, 0.1)], "run string, epoch int, value double")
    assert rows(history.best_epoch(tie, "run", "epoch", "value")) == [("r", 0, 0.1)]


def test_subset_does_not_depend_on_order(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    picks = [rows(datasets.seeded_subset(df.repartition(n).orderBy(F.rand(n)), "k", 20, 3)) for n in (1, 7, 64)]
    assert picks[0] == picks[1] == picks[2] and len(picks[0]) == 20
    assert rows(datasets.seeded_subset(df, "k", 20, 4)) != picks[0]


def test_overlap_at_every_threshold(spark):
    """Fields whose distance is the largest that a threshold allows, and one more, for all lengths to 120."""
    levels = (0.8, 0.7, 0.5, 0.3)
    cases = []
    for n in range(1, 121):
        for level in levels:
            cases += [(n, e) for e in range(max(0, int((1 - level) * n) - 1), min(n - 1, int((1 - level) * n) + 2) + 1)]
    cases = sorted(set(cases))
    gt = spark.createDataFrame([(i, f"f{i}", "x" * n) for i, (n, _) in enumerate(cases)], "doc_id long, path string, value string")
    pred = spark.createDataFrame([(i, f"f{i}", "x" * (n - e)) for i, (n, e) in enumerate(cases)], "doc_id long, path string, value string")
    documents = spark.createDataFrame([(i, True) for i in range(len(cases))], "doc_id long, valid boolean")
    got = {(r.path, r.threshold): (r.tp, r.fp, r.fn) for r in metrics.overlap_counts(gt, pred, documents, "doc_id", levels).collect()}
    for i, (n, e) in enumerate(cases):
        for level in levels:
            hit = 1 - e / n >= level
            assert got[f"f{i}", level] == ((1, 0, 0) if hit else (0, 1, 1)), (n, e, level)


def test_files_by_what_their_paths_contain(spark):
    paths = ["/a/holder cup.jpg", "/b/Krug-17.png", "/b/xy.tif", "/c/xyz.tif", "/c/zzzzzzzzz.tif"]
    names = [(1, "cup"), (2, "rug-1"), (3, "xy"), (4, "z"), (5, "older c"), (6, "zzzzzzzz"), (7, "lder cups"), (8, "q")]
    out = align.resolve_files(spark.createDataFrame(names, "doc_id long, name string"), spark.createDataFrame([(p,) for p in paths], "path string"), "doc_id", "name")
    expected = {i: min((p for p in paths if n in p.lower()), default=None) for i, n in names}
    assert {r.doc_id: r.path for r in out.collect()} == {i: p for i, p in expected.items() if p}


def test_detections_of_all_shapes(spark):
    """Four points and more, boxes that are missing, arrays of different lengths, null arrays."""
    box = lambda x: [[x, 0.0], [x + 1, 0.0], [x + 1, 1.0], [x, 1.0]]
    rows = [(1, ["a", "b"], [0.5], [box(0.0), None, [*box(2.0), [9.0, 9.0]]], None), (2, None, None, None, [box(5.0)]), (3, ["t"], [0.1], [[[1.0, 2.0]]], None), (4, None, None, None, None)]
    kind = "array<array<array<double>>>"
    frame = spark.createDataFrame(rows, f"id int, rec_texts array<string>, rec_scores array<double>, rec_polys {kind}, dt_polys {kind}")
    got = [tuple(r) for r in layout.detections(frame, "id").orderBy("id", "det_id").collect()]
    assert got == [(1, 0, box(0.0), "a", 0.5), (1, 2, box(2.0), "", None), (2, 0, box(5.0), "", None)]
    flat = spark.createDataFrame([(1, ["a", "b"], [0.5, None], [[0.0] * 8, [1.0] * 7])], "id int, rec_texts array<string>, rec_scores array<double>, rec_polys array<array<double>>")
    assert [tuple(r) for r in layout.detections(flat, "id").collect()] == [(1, 0, [[0.0, 0.0]] * 4, "a", 0.5)]


def test_paths_that_meet(spark):
    """Of two leaves with one path the later counts, where the first stands; numbers are shown as Python does."""
    text = '{"a.b":"x","a":{"b":"y","c":1.0},"k":1,"d":1e5,"k":2}'
    frame = spark.createDataFrame([(1, text)], "id int, j string")
    assert [(r.position, r.path, r.value) for r in shape.leaves(frame, ["id"], "j").orderBy("position").collect()] == [(0, "a.b", "y"), (1, "a.c", "1.0"), (2, "k", "2"), (3, "d", "100000.0")]
    typed = {r.path: r.value for r in shape.flatten_typed(frame, ["id"], "j", ["a.b", "a.c", "d", "k", "none"]).collect()}
    assert typed == {"a.b": "y", "a.c": "1.0", "d": "100000.0", "k": "2"}
    same = metrics.overlap_counts(shape.flatten(frame, ["id"], "j"), shape.flatten(frame, ["id"], "j"), frame.select("id", F.lit(True).alias("valid")), "id")
    assert {(r.tp, r.fp, r.fn) for r in same.collect()} == {(1, 0, 0)}


def test_natural_order_in_ranges(spark):
    names = [f"img{n % 17}_{n}" for n in range(300)] + ["none", "a", "x99999999999999999999"]
    number = lambda n: int(m[0]) if (m := re.findall(r"\d+", n)) and int(m[0]) < 2**63 else -1
    rows = layout.natural_order(spark.createDataFrame([(n,) for n in names], "n string").repartition(7), "n")
    assert [r.n for r in rows.orderBy("place").collect()] == sorted(names, key=lambda n: (number(n), n))
    assert sorted(r.place for r in rows.collect()) == list(range(1, len(names) + 1))
    assert "SinglePartition" not in rows._jdf.queryExecution().toString()
    assert layout.natural_order(spark.createDataFrame([], "n string"), "n").count() == 0


def test_log_lines_of_real_shapes(spark):
    lines = [
        "Inventory CER Callback: COMPUTING CER ON VALIDATION SUBSET (Epoch 1)", "   Validation CER (Epoch 1): 0.2566 (25.66%)", "   NEW BEST CER: 0.2566 (improved by inf)",
        "{'loss': 0.5, 'grad_norm': 1.0, 'epoch': 1.5}", "Epoch 2/20", "Validation CER (Epoch 20): 0.0690 (6.90%)", "{'train_runtime': 2.5, 'train_loss': 0.24, 'epoch': 20.0}", "Average CER: 0.0581 (5.81%)", "Perfect matches: 3/47 (6.38%)", "nothing",
    ]
    frame = spark.createDataFrame([("r", i, x) for i, x in enumerate(lines)] + [("s", 0, "Average CER: 0.5 (50%)")], "run string, n int, line string").repartition(3)
    got = [tuple(r)[1:] for r in history.log_metrics(frame, "run", "line", "n").where("run = 'r'").orderBy("line_no").collect()]
    assert got == [(1, 1, "val_cer", 0.2566), (2, 1, "best_cer", 0.2566), (3, 1, "loss", 0.5), (5, 20, "val_cer", 0.069), (6, 20, "train_loss", 0.24), (7, 20, "test_cer", 0.0581), (8, 20, "test_perfect", 3.0)]
    assert history.log_metrics(frame, "run", "line", "n").where("run = 's' AND epoch IS NULL").count() == 1


def test_leaderboard_ranks_within_data_sets(spark):
    r = __import__("random").Random(1)
    rows = [(f"d{i % 3}", f"r{i}", "m", r.randrange(40) / 10) for i in range(300)]
    board = history.leaderboard(spark.createDataFrame(rows, "d string, run string, name string, value double"), "d", "run", "m")
    want = {(d, n): 1 + sum(x[0] == d and x[3] < v for x in rows) for d, n, _, v in rows}
    assert {(x.d, x.run): x["rank"] for x in board.collect()} == want
    places = history.ranked(spark.createDataFrame([("a", v, 1) for v in range(50)], "d string, v int, n int"), "d", "v", "n", width=7)
    assert {x.v: x["rank"] for x in places.collect()} == {v: v + 1 for v in range(50)}


def test_error_split_leaves_out_empty_references(spark):
    pairs = [("a", "abc", "abd"), ("a", "abc", "ab"), ("a", "abc", None), ("a", "", "x"), ("a", None, "x"), ("b", "", ""), ("c", "ä", "xä")]
    out = metrics.error_split(spark.createDataFrame(pairs, "kind string, ref string, hyp string"), "kind")
    assert out.columns == ["kind", "substitutions", "deletions", "insertions", "ref_chars", "micro", "macro"]
    assert rows(out) == [("a", 1, 4, 0, 9, 5 / 9, pytest.approx((1 / 3 + 1 / 3 + 1) / 3)), ("c", 0, 0, 1, 1, 1.0, 1.0)]
    assert metrics.error_split(spark.createDataFrame([], "kind string, ref string, hyp string"), "kind").count() == 0


def test_missing_and_extra_sends_no_side(spark):
    """Exploded rows look few, so either side was broadcast; here any broadcast ends the job. Null keys are like no others."""
    left = spark.createDataFrame([(1, "a"), (1, "b"), (1, "a"), (2, None), (3, "c")], "i int, path string")
    right = spark.createDataFrame([(1, "a"), (2, None), (None, "c"), (4, "d"), (4, "d")], "i int, path string")
    before = spark.conf.get("spark.sql.maxBroadcastTableSize")
    spark.conf.set("spark.sql.maxBroadcastTableSize", "1")
    try:
        assert rows(align.missing_and_extra(left, right, ["i", "path"])) == [
            (1, "b", "missing"), (2, None, "extra"), (2, None, "missing"), (3, "c", "missing"), (4, "d", "extra"), (None, "c", "extra"),
        ]
    finally:
        spark.conf.set("spark.sql.maxBroadcastTableSize", before)
