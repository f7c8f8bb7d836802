"""Joins of ground truth, predictions, files and dimensions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import file_key
from ..sources.scratch import scratch_dir

#: Characters of the runs by which a name finds the paths that may contain it.
GRAM = 6
#: Places to which the paths of one such run are dealt.
PLACES = 256


def with_predictions(gt: DataFrame, pred: DataFrame, id_col: str, score: str) -> DataFrame:
    """Every ground-truth row with its score; a row without a prediction scores 1 and says why."""
    joined = gt.join(pred, id_col, "left")
    return joined.withColumn("error", F.when(F.col(score).isNull(), "no prediction")).withColumn(score, F.coalesce(score, F.lit(1.0)))


def align_paths(gt: DataFrame, pred: DataFrame, id_cols: Sequence[str], how: str = "full") -> DataFrame:
    """(ids, path, gt, pred) of both long tables; ``how='left'`` leaves out paths that only predictions have."""
    on = [*id_cols, "path"]
    return gt.withColumnRenamed("value", "gt").join(pred.withColumnRenamed("value", "pred"), on, how)


def without_done(work: DataFrame, done: DataFrame, id_col: str) -> DataFrame:
    """What is still to do."""
    return work.join(done.select(id_col), id_col, "left_anti")


def missing_and_extra(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of only one side, with ``side``; a row with a null key has no like on the other side.

    Both sides are counted together and not joined: exploded rows look as few as those they come from, and Spark would send them all.
    """
    on = list(on)
    both = left.select(*on, F.lit(True).alias("__left")).unionByName(right.select(*on, F.lit(False).alias("__left")))
    seen = both.groupBy(*on).agg(F.bool_or("__left").alias("__left"), F.bool_or(~F.col("__left")).alias("__right"))
    null = reduce(or_, [F.col(c).isNull() for c in on])
    only = lambda here, there, side: F.when(F.col(here) & (~F.col(there) | null), side)
    sides = F.array_compact(F.array(only("__left", "__right", "missing"), only("__right", "__left", "extra")))
    return seen.select(*on, F.explode(sides).alias("side"))


def resolve_files(names: DataFrame, files: DataFrame, id_col: str, name_col: str, path_col: str = "path") -> DataFrame:
    """(id, path, rule): the file of each name, by the first rule that finds one, the smallest path of several.

    1 the name itself, 2 without accents and case, 3 its ``(number).extension`` ending, 4 contained in the path.
    All rules are equi-joins: for the last one a name meets the paths that hold its rarest run of GRAM characters.
    """
    base = F.element_at(F.split(F.col(path_col), "/"), -1)
    numbered = lambda c: F.regexp_extract(c, r"(?i)(\(\s*\d+\s*\)\.(?:jpe?g|png|tiff?))$", 1)
    # the keys are made once
    files = _written(files.select(F.col(path_col).alias("path"), base.alias("base"), file_key(base).alias("key"), file_key(F.col(path_col)).alias("whole")))
    files = files.withColumn("ending", numbered(F.col("key")))
    names = names.select(F.col(id_col), F.col(name_col).alias("name")).where("name <> ''")
    names = _written(names.withColumn("key", file_key(F.col("name")))).withColumn("ending", numbered(F.col("key")))

    def by(rule: int, left: str, right: str) -> DataFrame:
        a = names.select(id_col, F.col(left).alias("k")).where("k <> ''")
        b = files.groupBy(F.col(right).alias("k")).agg(F.min("path").alias("path"))
        return a.join(b, "k").select(id_col, "path", F.lit(rule).alias("rule"))

    found = by(1, "name", "base").unionByName(by(2, "key", "key")).unionByName(by(3, "ending", "ending"))
    found = _written(found.groupBy(id_col).agg(F.min(F.struct("rule", "path")).alias("f")).select(id_col, "f.path", "f.rule"))
    left = _written(names.join(found, id_col, "left_anti").select(id_col, "key"))
    inside = left.join(_inside(left.select("key").distinct(), files.select("path", "whole")), "key").select(id_col, "path")
    return found.unionByName(inside.withColumn("rule", F.lit(4)))


def _written(table: DataFrame) -> DataFrame:
    path = scratch_dir(table.sparkSession)
    table.write.parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


def _inside(keys: DataFrame, paths: DataFrame) -> DataFrame:
    """(key, path): the smallest path whose ``whole`` contains the key."""

    def runs(text: str, size: int) -> Column:
        return F.when(F.length(text) >= size, F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substr(F.col(text), i, F.lit(size)))).otherwise(F.array().cast("array<string>"))

    size = F.least(F.length("key"), F.lit(GRAM))
    sizes = sorted(r[0] for r in keys.where("key <> ''").select(size).distinct().collect())  # GRAM values at most
    everywhere = keys.where("key = ''").crossJoin(paths.agg(F.min("path").alias("path")))  # one row at most
    if not sizes:
        return everywhere
    of_path = paths.select("path", "whole", F.explode(F.array_distinct(F.flatten(F.array(*[runs("whole", n) for n in sizes])))).alias("gram"))
    # paths of a run are dealt to places; a name goes to those that have some, at most as many as there are paths
    of_path = of_path.withColumn("place", F.pmod(F.xxhash64("path"), F.lit(PLACES)).cast("int"))
    counts = of_path.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.collect_set("place").alias("places"))
    of_key = keys.withColumn("own", F.expr("CAST(array() AS ARRAY<STRING>)"))
    for n in sizes:
        of_key = of_key.withColumn("own", F.when(size == n, runs("key", n)).otherwise(F.col("own")))
    of_key = of_key.withColumn("own", F.array_distinct("own")).select("key", F.size("own").alias("grams"), F.explode("own").alias("gram"))
    # a run that no path holds rules a name out
    rarest = of_key.join(counts, "gram").groupBy("key").agg(F.min_by(F.struct("gram", "places"), F.struct("n", "gram")).alias("r"), F.count(F.lit(1)).alias("there"), F.first("grams").alias("grams")).where("there = grams")
    rarest = rarest.select("key", "r.gram", F.explode("r.places").alias("place"))
    return rarest.join(of_path, ["gram", "place"]).where(F.col("whole").contains(F.col("key"))).groupBy("key").agg(F.min("path").alias("path")).unionByName(everywhere)


def resolve_by_stem(names: DataFrame, files: DataFrame, id_col: str, name_col: str, path_col: str = "path") -> DataFrame:
    """(id, path, reason): by name without case, else by name without extension; the reason of a miss."""
    base = F.lower(F.element_at(F.split(F.col(path_col), "/"), -1))
    stem = lambda c: F.regexp_replace(c, r"\.[^.]*$", "")
    files = files.select(F.col(path_col).alias("path"), base.alias("base"))
    full = files.groupBy("base").agg(F.min("path").alias("full_path"))
    short = files.groupBy(stem(F.col("base")).alias("stem")).agg(F.min("path").alias("stem_path"))
    names = names.select(F.col(id_col), F.lower(F.col(name_col)).alias("base")).withColumn("stem", stem(F.col("base")))
    out = names.join(full, "base", "left").join(short, "stem", "left")
    reason = F.when(F.col("base").isNull() | (F.col("base") == ""), "no name").when(F.col("path").isNull(), "not found")
    return out.withColumn("path", F.coalesce("full_path", "stem_path")).withColumn("reason", reason).select(id_col, "path", "reason")


def resolve_by_extension(names: DataFrame, files: DataFrame, id_col: str, stem_col: str, extensions: Sequence[str], path_col: str = "path") -> DataFrame:
    """(id, path): the stem with the first extension that exists."""
    ranked = F.posexplode(F.array(*[F.lit(x) for x in extensions]))
    tried = names.select(F.col(id_col), F.col(stem_col).alias("stem"), ranked.alias("rank", "ext")).withColumn("base", F.concat("stem", "ext"))
    files = files.select(F.col(path_col).alias("path"), F.element_at(F.split(F.col(path_col), "/"), -1).alias("base"))
    return tried.join(files, "base").groupBy(id_col).agg(F.min_by("path", F.struct("rank", "path")).alias("path"))


def attach(rows: DataFrame, dimension: DataFrame, on: str) -> DataFrame:
    """A dimension of a dataset (instruction, id key, excluded keys) on each row; one row for each dataset.
    Spark broadcasts it if it is small."""
    return rows.join(dimension, on, "left")


#: Rows of a table that may be packed into one value and sent to every task.
FEW = 10_000


def packed(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """One row with an aggregate of few rows; more than FEW end the job instead of filling every task's memory."""
    bad = F.raise_error(F.lit(f"more than {FEW} rows to be sent to every task"))
    return rows.limit(FEW + 1).agg(F.when(F.count(F.lit(1)) > FEW, bad).otherwise(value).alias(name))


def with_shots(rows: DataFrame, shots: DataFrame, order: str) -> DataFrame:
    """Every row with the same ordered array ``shots``, made once; ``shots`` are the few examples of a prompt."""
    one = packed(shots, F.array_sort(F.collect_list(F.struct(order, *[c for c in shots.columns if c != order]))), "shots")
    return rows.crossJoin(F.broadcast(one))  # one row


def first_by(rows: DataFrame, keys: Sequence[str], *order) -> DataFrame:
    """The first row of each group."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
