"""Registered queries: histories, trials, data sets, sources and sinks, streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.distance import cer
from ..operators import datasets, history, metrics
from ..sources import files as file_sources
from ..sources import jsonl, reports
from ..sources.scratch import scratch_dir
from ..streaming import jobs
from .fixtures import duck, fixture
from .scoring import _spread, rounded

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_E = f"e AS (SELECT run, epoch, value FROM {duck('epochs')})"


def _epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "epochs").select("run", F.col("epoch").cast("long"), "value")


@query(f"WITH {_E} SELECT run, epoch, round(avg(value) OVER (PARTITION BY run ORDER BY epoch ROWS UNBOUNDED PRECEDING) + 1e-9, 6) AS running FROM e")
def q_running_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    # means of numbers with two places can lie exactly between two roundings
    rows = history.running_average(_epochs(spark, sf_dir), "run", "epoch", "value")
    return rounded(rows.select("run", "epoch", (F.col("running") + 1e-9).alias("running")))


@query(f"""WITH {_E}, b AS (SELECT *, min(value) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e)
    SELECT run, epoch, round(before - value, 6) AS gain FROM b WHERE before IS NULL OR value < before""")
def q_improvements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(history.improvements(_epochs(spark, sf_dir), "run", "epoch", "value").where("new_best").select("run", "epoch", "gain"))


@query(f"WITH {_E}, m AS (SELECT run, min(value) AS v FROM e GROUP BY run) SELECT e.run, min(epoch) AS best_epoch, v AS best_value FROM e JOIN m ON e.run = m.run AND value = v GROUP BY e.run, v")
def q_best_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.best_epoch(_epochs(spark, sf_dir), "run", "epoch", "value")


@query(f"""WITH {_E}, b AS (SELECT *, min(value) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e),
    g AS (SELECT *, max(CASE WHEN before IS NULL OR before - value > 0.01 THEN epoch END) OVER (PARTITION BY run ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS last FROM b)
    SELECT run, min(epoch) AS stop FROM g WHERE epoch - last >= 3 GROUP BY run""")
def q_early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.early_stop(_epochs(spark, sf_dir), "run", "epoch", "value", patience=3, threshold=0.01)


@query(f"""SELECT study, count(*) FILTER (WHERE state = 'COMPLETE') AS completed, greatest(400 - count(*) FILTER (WHERE state = 'COMPLETE'), 0) AS remaining,
    arg_min(trial, (value, trial)) FILTER (WHERE state = 'COMPLETE') AS best_trial, min(value) FILTER (WHERE state = 'COMPLETE') AS best_value FROM {duck('trials')} GROUP BY study""")
def q_best_trial(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark)
    fixture(spark, sf_dir, "trials").write.parquet(path)
    return history.best_trials(reports.read_trials(spark, path), "study", planned=400)


@query("SELECT o_custkey AS run, concat('runs/', o_custkey, '/checkpoint-', max(o_orderkey)) AS path, max(o_orderkey) AS step FROM orders WHERE o_orderkey % 7 > 0 GROUP BY o_custkey")
def q_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    ending = F.when(F.col("o_orderkey") % 7 == 0, F.lit("last")).otherwise(F.col("o_orderkey").cast("string"))
    paths = orders.select(F.col("o_custkey").alias("run"), F.concat(F.lit("runs/"), F.col("o_custkey").cast("string"), F.lit("/checkpoint-"), ending).alias("path"))
    return history.latest_checkpoint(paths, "run", "path")


@query(f"WITH {_E} SELECT run, CAST(floor((epoch - 1) / 16) AS INTEGER) AS chunk, count(*) AS n FROM e GROUP BY ALL")
def q_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.with_chunks(_epochs(spark, sf_dir), "run", "epoch", 16).groupBy("run", "chunk").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_E}, s AS (SELECT * FROM e WHERE epoch % 2 = 0), m AS (SELECT run, min(value) AS v FROM s GROUP BY run) SELECT s.run, min(epoch) AS best_epoch, v AS best_value FROM s JOIN m ON s.run = m.run AND value = v GROUP BY s.run, v")
def q_two_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _epochs(spark, sf_dir).withColumn("stage", F.when(F.col("epoch") % 2 == 0, 2).otherwise(1))
    return history.two_stage_best(rows, "run", "stage", "epoch", "value")


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) WHERE n <= 5")
def q_first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.first_rows(fixture(spark, sf_dir, "texts").select("doc_id", "source"), "source", "doc_id", 5)


_LOG = f"""e AS (SELECT DISTINCT run, dataset, CAST(line_no // 3 AS INTEGER) AS epoch, line_no % 3 AS k, line_no, line, regexp_extract(line, '0[.]([0-9]+)', 0) AS v FROM {duck('logs')}),
    m AS (SELECT run, dataset, line_no, epoch, CASE WHEN k = 2 THEN 'val_cer' WHEN epoch % 7 = 1 THEN 'best_cer' ELSE 'loss' END AS name, CAST(v AS DOUBLE) AS value FROM e WHERE k = 2 OR (k = 1 AND epoch % 7 > 0))"""


@query(f"WITH {_LOG} SELECT run, line_no, epoch, name, value FROM m")
def q_log_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.log_metrics(fixture(spark, sf_dir, "logs"), "run", "line", "line_no")


@query(f"WITH {_LOG}, b AS (SELECT dataset, run, min(value) AS best FROM m WHERE name = 'val_cer' GROUP BY ALL) SELECT dataset, run, best, CAST(rank() OVER (PARTITION BY dataset ORDER BY best) AS INTEGER) AS rank FROM b")
def q_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = fixture(spark, sf_dir, "logs")
    found = history.log_metrics(logs, "run", "line", "line_no")
    return history.leaderboard(found.join(logs.select("run", "dataset").distinct(), "run"), "dataset", "run", "val_cer")


# -- data sets -------------------------------------------------------------------------------------------------------


@query("SELECT dataset, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM (SELECT doc_id, coalesce(lang, 'none') AS dataset FROM documents UNION ALL SELECT item_id, 'benchmark' FROM benchmark) GROUP BY dataset")
def q_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fixture(spark, sf_dir, "texts")
    tagged = docs.select(F.coalesce("lang", F.lit("none")).alias("dataset"), F.col("doc_id").alias("image_name"), "text")
    out = datasets.union_datasets({"benchmark": (spark.table("benchmark"), "item_id")}, tagged=[(tagged, "image_name")])
    return out.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids"))


@query("SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256(concat('7:', doc_id)), doc_id) AS n FROM documents) WHERE n <= 20")
def q_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.seeded_subset(fixture(spark, sf_dir, "texts").select("doc_id", "lang"), "doc_id", 20, 7, by=["lang"])


_WANTED = ("17", "3", "none", "29")


@query("SELECT doc_id, CASE doc_id WHEN 17 THEN 0 WHEN 3 THEN 1 WHEN 29 THEN 3 END AS place FROM documents ORDER BY place NULLS LAST, doc_id LIMIT 5")
def q_fewshot_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.named_shots(fixture(spark, sf_dir, "texts").select("doc_id"), "doc_id", _WANTED, 5)


@query("SELECT doc_id, quality, toxic, CAST(turn AS INTEGER) AS turn FROM (SELECT *, row_number() OVER (PARTITION BY quality, toxic ORDER BY doc_id) AS turn FROM labels) ORDER BY turn, doc_id LIMIT 6")
def q_fewshot_diverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return datasets.diverse_shots(labels, ["quality", "toxic"], "doc_id", 6).select("doc_id", "quality", "toxic", "turn")


@query("""SELECT conv_id, turn, concat('[{"role":"user","content":[{"type":"image","text":"', conv_id, '"},{"type":"text","text":"Lies die Karte."}]},{"role":"assistant","content":[{"type":"text","text":', CAST(to_json(coalesce(text, '')) AS VARCHAR), '}]}]') AS messages FROM conversations""")
def q_chat_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").withColumn("label", F.coalesce("text", F.lit("")))
    return datasets.chat_rows(rows, "Lies die Karte.", "conv_id", "label").select("conv_id", "turn", F.to_json("messages").alias("messages"))


@query("""SELECT doc_id, md5(concat('user:item 0|assistant:', (SELECT text FROM benchmark WHERE item_id = 0), '|user:item 1|assistant:', (SELECT text FROM benchmark WHERE item_id = 1), '|user:', text)) AS prompt FROM documents""")
def q_fewshot_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fixture(spark, sf_dir, "texts").select("doc_id", F.coalesce("text", F.lit("")).alias("ask"))
    shots = spark.table("benchmark").where("item_id < 2").select("item_id", F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("q"), F.coalesce("text", F.lit("")).alias("a"))
    out = datasets.shot_prompt(docs, shots, "item_id", "q", "a", "ask")
    return out.select("doc_id", F.md5(F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["text"])), "|")).alias("prompt"))


@query("""SELECT doc_id, copy, CASE WHEN copy > 0 THEN concat(doc_id, '_aug', copy) ELSE CAST(doc_id AS VARCHAR) END AS new_id, CASE WHEN copy > 0 THEN 2 + (doc_id + copy) % 2 ELSE 0 END AS n,
    CASE WHEN copy > 0 THEN (SELECT arg_min(t, sha256(concat('0:', doc_id, ':', copy, ':', t))) FROM (VALUES ('rotate'), ('blur'), ('contrast'), ('noise')) v(t)) END AS first
    FROM documents, (VALUES (0), (1), (2)) c(copy)""")
def q_augmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = datasets.augmentation_plan(fixture(spark, sf_dir, "texts").select("doc_id"), "doc_id", 2, ("rotate", "blur", "contrast", "noise"))
    return plan.select("doc_id", "copy", "new_id", F.size("transforms").cast("long").alias("n"), F.get("transforms", 0).alias("first"))


@query(f"SELECT model, count(*) AS requests, count(*) FILTER (WHERE r > 1) AS hits FROM (SELECT *, row_number() OVER (PARTITION BY model, content ORDER BY event_id) AS r FROM {duck('requests')}) GROUP BY model")
def q_dedup_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = datasets.first_of_content(fixture(spark, sf_dir, "requests"), "content", ["model"], "event_id")
    return rows.groupBy("model").agg(F.count(F.lit(1)).alias("requests"), F.count_if("hit").alias("hits"))


@query(f"""SELECT model, count(*) AS requests, round(avg(latency), 6) AS mean, round(median(latency), 6) AS median, round(quantile_cont(latency, 0.95), 6) AS p95, round(avg(CASE WHEN r > 1 THEN 1.0 ELSE 0 END), 6) AS hit_rate
    FROM (SELECT *, row_number() OVER (PARTITION BY model, content ORDER BY event_id) AS r FROM {duck('requests')}) GROUP BY model""")
def q_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = datasets.first_of_content(fixture(spark, sf_dir, "requests"), "content", ["model"], "event_id")
    return rounded(metrics.latency_summary(rows, "model", "latency", "hit"))


@query("SELECT count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels)) AS valid, count(*) AS total FROM documents")
def q_valid_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fixture(spark, sf_dir, "texts")
    return datasets.valid_samples(docs.select("doc_id"), spark.table("labels"), "doc_id")[1]


@query("SELECT doc_id, lang, CASE lang WHEN 'en' THEN 'Read the card.' WHEN 'de' THEN 'Lies die Karte.' END AS instruction FROM documents")
def q_instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.align import attach

    told = spark.createDataFrame([("en", "Read the card."), ("de", "Lies die Karte.")], "lang string, instruction string")
    return attach(fixture(spark, sf_dir, "texts").select("doc_id", "lang"), told, "lang")


@query("SELECT doc_id, (SELECT string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) FROM benchmark WHERE item_id < 3) AS shots FROM documents")
def q_with_shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.align import with_shots

    docs = fixture(spark, sf_dir, "texts").select("doc_id")
    shots = spark.table("benchmark").where("item_id < 3").select("item_id", "text")
    return with_shots(docs, shots, "item_id").select("doc_id", F.array_join(F.transform("shots", lambda s: s["item_id"].cast("string")), ",").alias("shots"))


# -- sources and sinks -----------------------------------------------------------------------------------------------


def _part_lines(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """A folder of JSON lines made of the record pairs, a third of the lines blank or broken."""
    path = scratch_dir(spark)
    f1 = fixture(spark, sf_dir, "f1")
    return path, f1


@query(f"SELECT doc_id::VARCHAR AS doc_id, gt::JSON->>'Name' AS name FROM {duck('f1')}")
def q_jsonl_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, f1 = _part_lines(spark, sf_dir)
    jsonl.write_jsonl(f1.where("doc_id % 2 = 0").select("doc_id", "gt"), path)
    jsonl.write_jsonl(f1.where("doc_id % 2 = 1").select("doc_id", "gt"), path, mode="append")
    rows = jsonl.read_jsonl(spark, path)
    record = F.try_parse_json(F.try_variant_get("row", "$.gt", "string"))
    return rows.select(F.try_variant_get("row", "$.doc_id", "string").alias("doc_id"), F.try_variant_get(record, "$.Name", "string").alias("name"))


@query(f"""SELECT CASE WHEN json_type(TRY_CAST(pred AS JSON)) = 'OBJECT' THEN 'ok' ELSE 'not JSON' END AS reason, count(*) AS n FROM
    (SELECT replace(pred, chr(10), ' ') AS pred FROM {duck('f1')}) GROUP BY 1 UNION ALL SELECT 'not one object', count(*) FROM part WHERE p_partkey % 4 = 0""")
def q_jsonl_permissive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, f1 = _part_lines(spark, sf_dir)
    lines = f1.select(F.replace("pred", F.lit("\n"), F.lit(" ")).alias("value"))
    odd = f1.where("doc_id % 4 = 0").select(F.lit("[1, 2]").alias("value")).unionByName(f1.where("doc_id % 3 = 0").select(F.lit("   ").alias("value")))
    lines.unionByName(odd).write.text(path)
    good, bad = jsonl.good_and_bad(jsonl.read_jsonl(spark, path, mode="permissive"))
    return good.select(F.lit("ok").alias("reason")).unionByName(bad.select("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


_LINES = f"""SELECT doc_id % 5 AS part, doc_id, 0 AS k, replace(pred, chr(10), ' ') AS raw FROM {{f1}} AS f UNION ALL SELECT doc_id % 5, doc_id, 1, '[1, 2]' FROM {{f1}} AS g WHERE doc_id % 4 = 0
    UNION ALL SELECT doc_id % 5, doc_id, 2, '   ' FROM {{f1}} AS h WHERE doc_id % 3 = 0"""


@query(f"""WITH l AS (SELECT part, raw, row_number() OVER (PARTITION BY part ORDER BY doc_id, k) AS line_no FROM ({_LINES.format(f1=duck('f1'))}))
    SELECT part, line_no, raw, CASE WHEN raw = '[1, 2]' THEN 'not one object' ELSE 'not JSON' END AS reason FROM l WHERE trim(raw) <> '' AND json_type(TRY_CAST(raw AS JSON)) IS DISTINCT FROM 'OBJECT'""")
def q_jsonl_bad_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark)
    fixture(spark, sf_dir, "f1").createOrReplaceTempView("f1")
    lines = spark.sql(_LINES.format(f1="f1"))
    lines.repartition("part").sortWithinPartitions("part", "doc_id", "k").select("part", F.col("raw").alias("value")).write.partitionBy("part").text(path)  # a file a part
    return jsonl.bad_lines(spark, path).select(F.regexp_extract("file", r"part=(\d+)", 1).cast("long").alias("part"), "line_no", "raw", "reason")


@query("SELECT count(*) AS documents, CAST(sum(length(s_name)) AS BIGINT) AS characters FROM supplier")
def q_documents_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark)
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    jsonl.write_documents(supplier.select(F.col("s_suppkey").alias("name"), F.to_json(F.struct("s_name")).alias("record")), path)
    docs = jsonl.read_documents(spark, path)
    name = F.length(F.try_variant_get(F.try_parse_json("record"), "$.s_name", "string"))
    return docs.agg(F.count(F.lit(1)).alias("documents"), F.sum(name).alias("characters"))


@query("SELECT count(*) AS folders, CAST(sum(n) AS BIGINT) AS characters FROM (SELECT c_nationkey, sum(length(c_name) + 1) AS n FROM customer GROUP BY c_nationkey)")
def q_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark)
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    customer.select("c_nationkey", F.col("c_name").alias("value")).write.partitionBy("c_nationkey").text(path)
    found = file_sources.manifest(spark, path).where(F.col("path").endswith(".txt"))
    folder = F.regexp_extract("path", r"c_nationkey=(\d+)", 1)
    return found.agg(F.count_distinct(folder).alias("folders"), F.sum("length").alias("characters"))


@query(f"SELECT count(*) AS n, round(avg(CASE WHEN hyp = '' THEN length(ref) WHEN ref = '' THEN length(hyp) ELSE levenshtein(hyp, ref) END / greatest(1, length(ref))), 6) AS mean FROM {duck('pairs')}")
def q_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark)
    few = rounded(metrics.cer_statistics(metrics.pair_scores(_spread(fixture(spark, sf_dir, "pairs"), "doc_id", "pos"))).select("n", "mean"))
    reports.write_report(few, path)
    return spark.read.schema("n long, mean double").option("header", True).csv(f"{path}/csv")


# -- streams ---------------------------------------------------------------------------------------------------------


def _stream(spark: SparkSession, rows: DataFrame, files: int, *keys: str, parts: tuple[Column, ...] = ()) -> DataFrame:
    """Rows as a stream of files, two a batch; with ``parts`` the rows of each condition come after those of the one before."""
    path = scratch_dir(spark)
    if parts:  # made once for all of them
        made = scratch_dir(spark)
        rows.write.parquet(made)
        rows = spark.read.schema(rows.schema).parquet(made)
    for part in parts or (F.lit(True),):
        rows.where(part).repartition(files, *keys).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(path)


@query(f"SELECT concat(doc_id, ':', pos) AS pair, CASE WHEN hyp = '' THEN length(ref) WHEN ref = '' THEN length(hyp) ELSE levenshtein(hyp, ref) END AS edits, length(ref) AS ref_len FROM {duck('pairs')}")
def q_stream_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = fixture(spark, sf_dir, "pairs").withColumn("pair", F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("pos").cast("string")))
    target = scratch_dir(spark)
    # a third of the rows comes again in later batches
    doubled = pairs.withColumn("again", F.lit(False)).unionByName(pairs.where("doc_id % 3 = 0").withColumn("again", F.lit(True)))
    stream = _stream(spark, doubled, 4, "pair", parts=(~F.col("again"), F.col("again")))
    jobs.score_new(stream, "pair", target, scratch_dir(spark)).awaitTermination()
    return spark.read.parquet(target).select("pair", "edits", "ref_len")


def _into_memory(frame: DataFrame, mode: str) -> DataFrame:
    """The final state of a stream, as a table in the shared folder."""
    spark = frame.sparkSession
    target = scratch_dir(spark)

    def keep(rows: DataFrame, _: int) -> None:
        rows.write.mode("overwrite" if mode == "complete" else "append").parquet(target)

    frame.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", scratch_dir(spark)).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(frame.schema).parquet(target)


@query(f"""WITH s AS (SELECT lang, length(ref) AS n, CASE WHEN hyp = '' THEN length(ref) WHEN ref = '' THEN length(hyp) ELSE levenshtein(hyp, ref) END AS edits FROM {duck('pairs')})
    SELECT lang, count(*) AS n, round(avg(edits / greatest(1, s.n)), 6) AS macro_cer, round(sum(edits) / sum(s.n), 6) AS micro_cer FROM s GROUP BY lang""")
def q_stream_running_cer(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = fixture(spark, sf_dir, "pairs")
    return rounded(_into_memory(jobs.running_cer(_stream(spark, pairs, 4, "doc_id"), "lang"), "complete"))


@query(f"SELECT DISTINCT model, content FROM {duck('requests')}")
def q_stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = fixture(spark, sf_dir, "requests").select("model", "content", F.col("ts").cast("timestamp").alias("ts"))
    once = jobs.suppress_repeats(_stream(spark, requests, 4, "ts"), ["model", "content"], "ts", "1000 days")
    return _into_memory(once.select("model", "content"), "append")


@query(f"""WITH {_E}, b AS (SELECT *, min(value) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e)
    SELECT run, epoch, value FROM b WHERE before IS NULL OR value < before""")
def q_stream_new_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _epochs(spark, sf_dir)
    early_to_late = (F.col("epoch") <= 3, F.col("epoch").between(4, 9), F.col("epoch") > 9)  # a run's rows come in several batches
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return _into_memory(jobs.new_best_alerts(_stream(spark, rows, 2, "run", parts=early_to_late)), "append")
    finally:
        spark.conf.set(provider, before)


__all__ = ["ORACLE", "QUERIES", "cer"]
