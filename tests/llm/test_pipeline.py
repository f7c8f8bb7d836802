"""The pipeline, stage by stage, and the registered queries."""

import brute
import corpus_pipeline
from pyspark.sql import functions as F

import __spark_entry__
from fieldscore.llm import line_dedup, quality


def write_tables(spark, frame, folder, corpus):
    docs = frame.drop("n_words").withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast("long"))
    docs.write.parquet(f"{folder}/documents.parquet")
    item = next(t for _, t in corpus if t and len(t.split()) == 80)
    spark.createDataFrame([(1, " ".join(item.split()[:40]))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i, _ in corpus[:20]], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet")


def test_stages(spark, frame, corpus, tmp_path):
    folder = str(tmp_path / "sf")
    docs = write_tables(spark, frame, folder, corpus)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "best-fit packing"]
    now = docs
    kept = {}
    for name, function in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in now.select("doc_id", "text").collect()}
        out = function(spark, now, folder)
        path = f"{folder}/{name}"
        out.write.parquet(path)
        out = spark.read.parquet(path)
        if name != "best-fit packing":
            assert out.columns == docs.columns
            now = out
        kept[name] = before, out
    before, out = kept["quality classifier"]
    assert out.count() == len(before)  # one kind of label: all are accepted
    before, out = kept["line dedup"]
    assert {r.doc_id: r.text for r in out.collect()} == {i: t for i, t, *_ in brute.line_dedup(list(before.items()))}
    before, out = kept["n-gram Jaccard join"]
    linked = brute.link_components(list(before.items()), 5, 80, 100)
    assert sorted(r.doc_id for r in out.collect()) == sorted(i for i, _, c in linked if i == c)
    before, out = kept["benchmark decontamination"]
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    assert sorted(r.doc_id for r in out.collect()) == sorted(r[0] for r in brute.contamination(list(before.items()), items) if not r[5])
    assert out.count() < len(before)
    before, out = kept["best-fit packing"]
    sizes = {r[0]: r[1] for r in out.groupBy("doc_id").agg(F.sum("n_tokens")).collect()}
    assert sizes == {i: len(brute.WORD.findall(t or "")) + 1 for i, t in before.items()}


def test_run(spark, frame, corpus, tmp_path):
    folder = str(tmp_path / "sf")
    write_tables(spark, frame, folder, corpus)
    out = corpus_pipeline.run(spark, folder)
    assert 0 < out.select("doc_id").distinct().count() < len(corpus)


def test_repeated_rows_and_no_ids_stay_or_go(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (None, None), (3, None)], "doc_id long, text string")
    out = corpus_pipeline.near_duplicate_stage(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted((tuple(r) for r in out.collect()), key=repr) == sorted([(1, "a b c d e f"), (None, "a b c d e f"), (None, None), (3, None)], key=repr)


def test_an_id_with_several_texts_loses_only_the_copies(spark):
    a, a2, b = " ".join(f"w{i}" for i in range(80)), " ".join(f"w{i}" for i in range(78)), " ".join(f"v{i}" for i in range(80))
    docs = spark.createDataFrame([(5, a), (3, a2), (5, b), (5, b), (7, b)], "doc_id long, text string")
    out = corpus_pipeline.near_duplicate_stage(spark, docs, "")
    assert sorted(tuple(r) for r in out.collect()) == sorted([(3, a2), (5, b)])


def test_every_operator_has_a_query():
    names = list(__spark_entry__.queries())
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)
    assert line_dedup.MIN_DOCS == 5 and quality.THRESHOLD == 0.5


CLASHES = ("n_words", "n_hit", "n_dropped", "contaminated", "accepted", "content", "metadata", "good", "weight", "prediction", "features", "id", "key", "words", "component_id", "x")


def test_stages_keep_columns_with_their_names(spark, frame, corpus, tmp_path):
    folder = str(tmp_path / "sf")
    write_tables(spark, frame, folder, corpus)
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumns({c: F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")) for c in CLASHES})
    for _, function in corpus_pipeline.STAGES[:-1]:
        out = function(spark, docs, folder)
        assert out.columns == docs.columns
        for r in out.select("doc_id", *CLASHES).limit(30).collect():
            assert all(r[c] == f"{c}:{r.doc_id}" for c in CLASHES)
    assert corpus_pipeline.packing_stage(spark, docs, folder).count() >= docs.count()


def test_stages_on_nothing(spark, frame, corpus, tmp_path):
    folder = str(tmp_path / "sf")
    docs = write_tables(spark, frame, folder, corpus).limit(0)
    for _, function in corpus_pipeline.STAGES:
        assert function(spark, docs, folder).count() == 0


def test_stages_on_nulls(spark, frame, corpus, tmp_path):
    folder = str(tmp_path / "sf")
    docs = write_tables(spark, frame, folder, corpus)
    void = spark.createDataFrame([(None,) * len(docs.columns)] * 2 + [(7000, None, None, None, None)], docs.schema)
    now = void
    for _, function in corpus_pipeline.STAGES[:-1]:
        now = function(spark, now, folder)
        assert now.count() == 3
    assert corpus_pipeline.packing_stage(spark, now, folder).count() == 3
