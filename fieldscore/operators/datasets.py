"""Putting evaluation and training tables together."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .align import packed


def union_datasets(parts: dict[str, tuple[DataFrame, str]], tagged: Sequence[tuple[DataFrame, str]] = ()) -> DataFrame:
    """Tables of several datasets under one id column ``doc_id``, tagged with their name; ``tagged`` are tables that hold
    several datasets and have their names in a column ``dataset``."""
    named = [df.withColumnRenamed(id_col, "doc_id") for df, id_col in tagged]
    tagged = [*named, *[df.withColumnRenamed(id_col, "doc_id").withColumn("dataset", F.lit(name)) for name, (df, id_col) in parts.items()]]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def seeded_subset(rows: DataFrame, key: str, n: int, seed: int, by: Sequence[str] = ()) -> DataFrame:
    """The same n rows for the same seed, whatever the order and partitions: those with the smallest hash of seed and key."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    if not by:
        return rows.withColumn("__h", order).orderBy("__h", key).limit(n).drop("__h")
    w = Window.partitionBy(*by).orderBy(order, key)
    return rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def named_shots(rows: DataFrame, key: str, wanted: Sequence[str], k: int) -> DataFrame:
    """The wanted rows in the order given; if fewer than k exist, the first other rows fill up."""
    names = rows.sparkSession.createDataFrame(list(enumerate(wanted)), "place int, __key string")
    found = rows.join(F.broadcast(names), F.col(key).cast("string") == F.col("__key"), "left").drop("__key")
    return found.orderBy(F.col("place").asc_nulls_last(), key).limit(k)


def diverse_shots(rows: DataFrame, classes: Sequence[str], key: str, k: int) -> DataFrame:
    """One row of each class by stable key, filled up with others to k rows."""
    w = Window.partitionBy(*classes).orderBy(key)
    ranked = rows.withColumn("turn", F.row_number().over(w))
    return ranked.orderBy("turn", key).limit(k)


def chat_rows(rows: DataFrame, instruction: str, doc: str, label: str) -> DataFrame:
    """Rows with ``messages``: the instruction with the document, then the label as the answer."""
    part = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.cast("string").alias("text"))
    turn = lambda role, *content: F.struct(F.lit(role).alias("role"), F.array(*content).alias("content"))
    messages = F.array(turn("user", part("image", F.col(doc)), part("text", F.lit(instruction))), turn("assistant", part("text", F.col(label))))
    return rows.withColumn("messages", messages)


def shot_prompt(rows: DataFrame, shots: DataFrame, order: str, question: str, answer: str, ask: str) -> DataFrame:
    """Rows with ``messages``: user and assistant turns of the shots in order, then the row's own question."""
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("text"))
    one = packed(shots, F.array_sort(F.collect_list(F.struct(order, F.col(question).alias("q"), F.col(answer).alias("a")))), "s")
    before = F.flatten(F.transform("s", lambda x: F.array(turn("user", x["q"]), turn("assistant", x["a"]))))
    return rows.crossJoin(F.broadcast(one)).withColumn("messages", F.concat(before, F.array(turn("user", F.col(ask))))).drop("s")


def augmentation_plan(rows: DataFrame, key: str, copies: int, transforms: Sequence[str], seed: int = 0) -> DataFrame:
    """Each row and ``copies`` more under new ids, each copy with two or three transforms chosen by hash."""
    out = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies))))
    tag = F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"), F.lit(":"), F.col("copy").cast("string"), F.lit(":"))
    ranked = F.array_sort(F.array(*[F.struct(F.sha2(F.concat(tag, F.lit(t)), 256).alias("h"), F.lit(t).alias("t")) for t in transforms]))
    many = 2 + F.pmod(F.col(key).cast("long") + F.col("copy"), F.lit(2))
    chosen = F.when(F.col("copy") > 0, F.transform(F.slice(ranked, 1, many), lambda x: x["t"])).otherwise(F.array().cast("array<string>"))
    new_id = F.when(F.col("copy") > 0, F.concat(F.col(key).cast("string"), F.lit("_aug"), F.col("copy").cast("string"))).otherwise(F.col(key).cast("string"))
    return out.withColumn("new_id", new_id).withColumn("transforms", chosen)


def first_of_content(rows: DataFrame, content: str, by: Sequence[str], order: str) -> DataFrame:
    """Rows with ``content_hash`` and ``hit``: later rows with the same content are hits."""
    hashed = rows.withColumn("content_hash", F.sha2(content, 256))
    w = Window.partitionBy(*by, "content_hash").orderBy(order)
    return hashed.withColumn("hit", F.row_number().over(w) > 1)


def valid_samples(rows: DataFrame, manifest: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose file exists, one row with how many are valid of how many)."""
    valid = rows.join(manifest.select(key).distinct(), key, "left_semi")
    flagged = rows.join(manifest.select(key).distinct().withColumn("__there", F.lit(1)), key, "left")
    return valid, flagged.agg(F.count("__there").alias("valid"), F.count(F.lit(1)).alias("total"))
