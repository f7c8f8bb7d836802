"""JSON lines and JSON documents as sources and sinks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.jsontext import parsed, strict_object
from ..functions.text import strip
from .scratch import scratch_dir


def read_jsonl(spark: SparkSession, path: str, mode: str = "failfast") -> DataFrame:
    """(raw, row): lines that aren't blank, with the parsed object. ``failfast`` ends the job at a bad line, ``permissive``
    keeps it with a null row."""
    lines = spark.read.text(path).select(F.col("value").alias("raw")).where(strip(F.col("raw")) != "")
    rows = lines.withColumn("row", strict_object(F.col("raw")))
    if mode == "failfast":
        bad = F.raise_error(F.concat(F.lit("not a JSON object: "), F.substring("raw", 1, 200)))
        return rows.withColumn("row", F.when(F.col("row").isNull(), bad).otherwise(F.col("row")))
    return rows


def good_and_bad(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that parsed, (raw, reason) of the others) of a permissive read."""
    return rows.where("row IS NOT NULL"), rows.where("row IS NULL").select("raw", _reason().alias("reason"))


def _reason() -> Column:
    return F.when(parsed(F.col("raw")).isNull(), "not JSON").otherwise("not one object")


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, raw, reason) of the lines that aren't one JSON object; lines count from 1, blank ones too.

    Files may be split: a line has its place in its block, and a block starts behind the lines of the blocks before it in
    its file. Both are taken in one scan, which sends on a row for each block and the bad lines only.
    """
    lines = spark.read.text(path).select(
        F.col("value").alias("raw"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),  # rises by one from line to line of a block
    )
    bad = (strip(F.col("raw")) != "") & strict_object(F.col("raw")).isNull()
    lines = lines.groupBy("file", "block").agg(
        F.count(F.lit(1)).alias("n"), F.min("at").alias("first"), F.collect_list(F.when(bad, F.struct("at", "raw", _reason().alias("reason")))).alias("bad")
    )
    stored = scratch_dir(spark)
    lines.write.parquet(stored)
    blocks = spark.read.schema(lines.schema).parquet(stored)
    behind = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("file", "block", F.coalesce(F.sum("n").over(behind), F.lit(0)).alias("start"))
    found = blocks.select("file", "block", "first", F.explode("bad").alias("b")).join(starts, ["file", "block"])
    return found.select("file", (F.col("start") + F.col("b.at") - F.col("first") + 1).alias("line_no"), "b.raw", "b.reason")


def write_jsonl(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One object for each row, null fields kept, text as it is; ``mode='append'`` adds to a history."""
    rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode(mode).text(path)


def write_documents(rows: DataFrame, path: str) -> int:
    """A file ``name.json`` for each row of (name, record), which ``read_documents`` takes back; returns how many were written.

    Rows of one name are numbered (``name~1`` is the second), no name is ``null``. Tasks write through Arrow's file systems:
    Hadoop's starts a process for each file of a local folder, and folders made by a key are listed one by one. A repeated
    task makes the same files again, each put in its place when it is whole.
    """
    store, folder = fs.FileSystem.from_uri(path)
    store.create_dir(folder, recursive=True)
    name = F.coalesce(F.col("name").cast("string"), F.lit("null"))
    bad = F.raise_error(F.concat(F.lit("not a file name: "), name))
    rows = rows.select(F.when(name.rlike(r"^$|^[._]|[/~\x00]"), bad).otherwise(name).alias("name"), F.coalesce("record", F.lit("")).alias("record"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(path)
        last, again, n = None, 0, 0
        for batch in batches:
            for name, record in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                last, again = name, again + 1 if name == last else 0
                made = f"{folder}/_{uuid.uuid4().hex}"  # Spark passes over such names
                with store.open_output_stream(made, compression=None) as out:
                    out.write(record.encode())
                store.move(made, f"{folder}/{name}~{again}.json" if again else f"{folder}/{name}.json")
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    spread = rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, "name").sortWithinPartitions("name", "record")
    return spread.mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(name, record): one JSON file for each document; the name is the file's, without its ending."""
    files = spark.read.option("wholetext", True).text(path)
    name = F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)?$", 1)
    return files.select(name.alias("name"), strip(F.col("value")).alias("record"))
