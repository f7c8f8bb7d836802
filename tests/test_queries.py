"""Registered queries against DuckDB at the smallest scale, and independence of partitions."""

import os
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from fieldscore.plans import oracles, queries
from fieldscore.plans.fixtures import LETTERS_FROM, LETTERS_TO, fixture

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(x):
    return round(x, 9) if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(oracles()))
def test_same_as_sql(spark, db, name):
    df = queries()[name](spark, SF)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    out = db.sql(oracles()[name])
    assert sorted(out.columns) == names
    order = [out.columns.index(c) for c in names]
    assert got == sorted((tuple(plain(r[i]) for i in order) for r in out.fetchall()), key=repr)


def test_every_query_without_sql_runs(spark):
    for name in queries().keys() - oracles().keys():
        assert queries()[name](spark, SF).count() > 0


def test_partitions_do_not_matter(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    seen = []
    try:
        for n in ("1", "7", "64"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            seen.append([sorted(map(tuple, queries()[q](spark, SF).collect())) for q in ("q_map_f1", "q_reading_order", "q_segment_line")])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1] == seen[2]


def test_every_sheet_and_field(spark):
    n = spark.read.parquet(f"{SF}/part.parquet").count()
    numbers = {r.doc_id: r.number for r in queries()["q_inventory_number"](spark, SF).collect()}
    assert len(numbers) == n and numbers[2] == "x1002"
    assert {r.doc_id: r.number for r in queries()["q_sheet_records"](spark, SF).collect()} == numbers
    fields = queries()["q_segment_header"](spark, SF)
    assert {r.key: r["count"] for r in fields.where("key IN ('Gegenstand', 'Material', 'Preis')").groupBy("key").count().collect()} == {"Gegenstand": n, "Material": n, "Preis": n // 4}


def test_whole_documents(spark):
    """Every folded character and every word of the documents."""
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    ascii_letters = str.maketrans(LETTERS_FROM, LETTERS_TO)
    folded = {i: re.sub("[^a-z0-9 ]", "", t.lower().translate(ascii_letters)) for i, t in texts.items()}
    assert max(map(len, folded.values())) > 200
    assert {r.doc_id: r.ref_len for r in queries()["q_cer_all"](spark, SF).collect()} == {i: len(t) for i, t in folded.items()}
    words = fixture(spark, SF, "words").groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in words} == {i: len(re.sub("[^a-z0-9]+", " ", t.lower()).split(" ")) for i, t in texts.items()}


def test_lists_of_whole_documents(spark):
    """Every word of every piece stands in one list of six."""
    pairs = fixture(spark, SF, "pairs").select("doc_id", "hyp", "ref").collect()
    want = {}
    for r in pairs:
        n = max(len(r.hyp.split(" ")), len(r.ref.split(" ")))
        want[r.doc_id] = want.get(r.doc_id, 0) + -(-n // 6)
    rows = queries()["q_anls_lists"](spark, SF).collect()
    assert {r.doc_id: r.lists for r in rows} == want
    assert all(r.score == 1.0 for r in rows if r.doc_id % 5 == 0)  # the reader's text is the reference there


def test_streams_cross_batches(spark):
    """A run's rows and repeated requests come in several batches, so the state decides."""
    from fieldscore.plans import books

    seen = {}
    rows = books._epochs(spark, SF)
    stream = books._stream(spark, rows, 2, "run", parts=(F.col("epoch") <= 3, F.col("epoch") > 3))
    query = stream.writeStream.foreachBatch(lambda df, i: seen.update({i: {r.run for r in df.select("run").distinct().collect()}}))
    query.option("checkpointLocation", books.scratch_dir(spark)).trigger(availableNow=True).start().awaitTermination()
    assert len(seen) > 1 and seen[0] & seen[1]


@pytest.mark.parametrize("name", ["q_paths_deep", "q_leaf_text_ordered", "q_nested_report", "q_anls_nested", "q_sheet_records", "q_field_cer", "q_two_forms", "q_anls_string"])
def test_rows_of_one_file_are_spread(spark, name):
    """A small file is one task; what costs much for each row runs behind an exchange."""
    assert "REPARTITION_BY_NUM" in queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_detections_send_numbers_only(spark):
    plan = queries()["q_detections"](spark, SF)._jdf.queryExecution().optimizedPlan()
    packed = [line for line in plan.toString().split("\n") if "Aggregate" in line]
    assert packed and not any("array(" in line for line in packed)  # boxes are made behind the exchange


def test_documents_share_a_folder(spark, monkeypatch):
    """A folder for each document is listed, and its file moved, one by one."""
    from fieldscore.sources import jsonl

    seen, plain_read = [], jsonl.read_documents
    monkeypatch.setattr(jsonl, "read_documents", lambda spark, path: seen.append(path) or plain_read(spark, path))
    n = queries()["q_documents_combined"](spark, SF).first().documents
    folder = seen[0].removeprefix("file://")
    assert sum(x.endswith(".json") for x in os.listdir(folder)) == n > 0
    assert not any(x.is_dir() for x in os.scandir(folder))


def test_forms_are_made_once(spark):
    """Each of the three expressions once a side, and one that makes the texts."""
    plan = queries()["q_two_forms"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 7


def test_documents_are_spread_before_they_are_cut(spark):
    plan = queries()["q_two_forms"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("explode(sequence(") < plan.index("RepartitionByExpression")  # what comes first is made last
    assert plan.count("RepartitionByExpression") == 1
