"""The corpus pipeline: quality, line dedup, near duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir), where ``docs`` is what its predecessor kept, and returns a DataFrame; all but
the last return the columns of ``documents``. ``run`` writes each result to the shared folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldscore.llm import decontaminate, jaccard, line_dedup, packing, quality
from fieldscore.llm.common import stage

#: Near duplicates: word shingles of five words, similarity of 0.8 or more.
SHINGLE_WORDS = 5
SIMILARITY = (80, 100)

#: The stages classify, link and pack in ways that SQL can't express.
ORACLE_SQL = None


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _packed(docs: DataFrame, *columns: str) -> DataFrame:
    """The columns a stage works on and the others as one column, so that no name of theirs meets one of an operator's."""
    rest = [c for c in docs.columns if c not in columns]
    return docs.select(*columns, F.struct(*rest).alias("__row") if rest else F.lit(None).cast("string").alias("__row"))


def _unpacked(out: DataFrame, docs: DataFrame, *columns: str) -> DataFrame:
    """The columns of ``docs`` in their order."""
    return out.select(*[F.col(c) if c in columns else F.col("__row").getField(c).alias(c) for c in docs.columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go."""
    used = ("doc_id", "text", "lang", "source", "n_chars")
    judged = quality.classify(_packed(docs, *used), _table(spark, sf_dir, "labels"))
    return _unpacked(judged.where("accepted"), docs, *used)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents hold stay in one; ``n_chars`` follows the text."""
    used = ("doc_id", "text", "n_chars")
    out = line_dedup.dedup_lines(_packed(docs, *used))
    n = F.when(F.col("n_dropped") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return _unpacked(out.withColumn("n_chars", n), docs, *used)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays (of different texts under that id, the one
    with the smallest hash); of rows with one id and text, one. Rows without an id stay."""
    linked = stage(jaccard.link_documents(docs.select("doc_id", "text"), n=SHINGLE_WORDS, similarity=SIMILARITY, keys=True).where("doc_id IS NOT NULL"))
    key = F.struct("doc_id", "text_hash")
    firsts = linked.where("component_key IS NOT NULL").groupBy("component_key").agg(F.min(key).alias("s")).select("component_key", "s.doc_id", "s.text_hash")
    gone = linked.join(firsts, ["component_key", "doc_id", "text_hash"], "left_anti").where("component_key IS NOT NULL").select("doc_id", "text_hash").distinct()
    rows = _packed(docs, "doc_id", "text").withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit("")))).join(gone, ["doc_id", "text_hash"], "left_anti")
    again = stage(linked.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id", "text_hash"))
    if not again.isEmpty():  # repeated rows, each pair of id and text on its own
        once = rows.join(again, ["doc_id", "text_hash"], "left_semi").dropDuplicates(["doc_id", "text_hash"])
        rows = rows.join(again, ["doc_id", "text_hash"], "left_anti").unionByName(once)
    return _unpacked(rows, docs, "doc_id", "text")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by benchmark items go."""
    judged = decontaminate.decontaminate(_packed(docs, "doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    return _unpacked(judged.where("NOT contaminated"), docs, "doc_id", "text")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is packed; a document is as long as its words and an end mark."""
    n = F.regexp_count(F.coalesce("text", F.lit("")), F.lit("[^ \\t\\n\\x0B\\f\\r]+")) + 1
    return packing.pack_documents(docs.select("doc_id", n.alias("n_tokens")))


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("best-fit packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = _table(spark, sf_dir, "documents")
    for _, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir))
    return stage(STAGES[-1][1](spark, docs, sf_dir))
