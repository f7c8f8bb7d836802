"""Bookkeeping of runs and trials: windows over (run, epoch)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .order import numbered


def running_average(rows: DataFrame, run: str, order: str, value: str) -> DataFrame:
    """Mean of all values of a run so far."""
    w = Window.partitionBy(run).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("running", F.avg(value).over(w))


def improvements(rows: DataFrame, run: str, order: str, value: str) -> DataFrame:
    """Best value before each row, whether the row is strictly better, and by how much."""
    before = Window.partitionBy(run).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("best_before", F.min(value).over(before))
    new = F.col("best_before").isNull() | (F.col(value) < F.col("best_before"))
    return rows.withColumn("new_best", new).withColumn("gain", F.when(new, F.col("best_before") - F.col(value)))


def best_epoch(rows: DataFrame, run: str, order: str, value: str) -> DataFrame:
    """(run, best order, best value): the smallest value, the first of equal ones."""
    return rows.groupBy(run).agg(F.min_by(order, F.struct(value, order)).alias("best_epoch"), F.min(value).alias("best_value"))


def early_stop(rows: DataFrame, run: str, order: str, value: str, patience: int, threshold: float) -> DataFrame:
    """(run, stop): the first row at which ``patience`` rows in a row brought no gain over ``threshold``.

    A gain counts against the best value before, as that is what a trainer keeps.
    """
    w = Window.partitionBy(run).orderBy(order)
    best = F.min(value).over(w.rowsBetween(Window.unboundedPreceding, -1))
    seq = rows.withColumn("seq", F.row_number().over(w)).withColumn("best_before", best)
    gained = F.col("best_before").isNull() | (F.col("best_before") - F.col(value) > threshold)
    seq = seq.withColumn("last", F.last(F.when(gained, F.col("seq")), ignorenulls=True).over(w))
    return seq.where(F.col("seq") - F.col("last") >= patience).groupBy(run).agg(F.min(order).alias("stop"))


def best_trials(trials: DataFrame, study: str, planned: int) -> DataFrame:
    """(study, completed, remaining, best trial, best value) of the trials that completed."""
    done = F.col("state") == "COMPLETE"
    return trials.groupBy(study).agg(
        F.count_if(done).alias("completed"), F.greatest(F.lit(planned) - F.count_if(done), F.lit(0)).alias("remaining"),
        F.min_by(F.when(done, F.col("trial")), F.when(done, F.struct("value", "trial"))).alias("best_trial"), F.min(F.when(done, F.col("value"))).alias("best_value"),
    )


def latest_checkpoint(paths: DataFrame, run: str, path: str) -> DataFrame:
    """(run, path, step) of the checkpoint with the largest number at its end."""
    step = F.regexp_extract(path, r"checkpoint-(\d+)$", 1).try_cast("long")
    found = paths.withColumn("step", step).where("step IS NOT NULL")
    return found.groupBy(run).agg(F.max_by(path, F.struct("step", path)).alias("path"), F.max("step").alias("step"))


def with_chunks(rows: DataFrame, part: str, order: str, size: int) -> DataFrame:
    """Number of the chunk of ``size`` rows that a row is in, within its part."""
    w = Window.partitionBy(part).orderBy(order)
    return rows.withColumn("chunk", F.floor((F.row_number().over(w) - 1) / size).cast("int"))


def first_rows(rows: DataFrame, part: str, order: str, n: int) -> DataFrame:
    """The first n rows of each part (a validation limit)."""
    w = Window.partitionBy(part).orderBy(order)
    return rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def two_stage_best(rows: DataFrame, run: str, stage: str, order: str, value: str) -> DataFrame:
    """The best row of the second stage; the first stage isn't evaluated."""
    return best_epoch(rows.where(F.col(stage) == 2), run, order, value)


#: What a metric line looks like: (pattern, name, group of the epoch or 0, group of the value). Fixed values of the log formats.
LOG_PATTERNS = (
    (r"Validation CER \(Epoch (\d+)\): ([0-9.]+)", "val_cer", 1, 2),
    (r"NEW BEST CER: ([0-9.]+)", "best_cer", 0, 1),
    (r"Average CER: ([0-9.]+)", "test_cer", 0, 1),
    (r"Median CER: ([0-9.]+)", "test_cer_median", 0, 1),
    (r"Perfect matches: (\d+)/", "test_perfect", 0, 1),
    (r"^\{'loss': ([0-9.eE+-]+)", "loss", 0, 1),
    (r"^\{.*'eval_loss': ([0-9.eE+-]+)", "eval_loss", 0, 1),
    (r"^\{.*'train_loss': ([0-9.eE+-]+)", "train_loss", 0, 1),
    (r"^epoch (\d+) val_cer: ([0-9.]+)$", "val_cer", 1, 2),
)
#: Where a line tells the epoch that the lines behind it belong to.
EPOCH_PATTERNS = (r"\(Epoch (\d+)\)", r"^Epoch (\d+)(?:/\d+)?\b", r"^\{.*'epoch': (\d+)(?:\.\d+)?", r"^epoch (\d+) ")


def log_metrics(lines: DataFrame, run: str, line: str, order: str) -> DataFrame:
    """(run, line_no, epoch, name, value) of the metrics in log lines, by ``LOG_PATTERNS``.

    A metric without an epoch of its own gets the last one that its run's lines told before, or null.
    """
    text = F.col(line)
    told = F.coalesce(*[F.regexp_extract(text, p, 1).try_cast("int") for p in EPOCH_PATTERNS])
    found = F.array_compact(F.array(*[
        F.when(text.rlike(p), F.struct(F.lit(name).alias("name"), (F.regexp_extract(text, p, e).try_cast("int") if e else F.lit(None).cast("int")).alias("own"), F.regexp_extract(text, p, v).try_cast("double").alias("value")))
        for p, name, e, v in LOG_PATTERNS
    ]))
    # only lines that tell something take part in the window
    rows = lines.select(run, F.col(order).alias("line_no"), told.alias("told"), found.alias("found")).where("told IS NOT NULL OR size(found) > 0")
    w = Window.partitionBy(run).orderBy("line_no")
    carried = rows.withColumn("open", F.last("told", ignorenulls=True).over(w))
    out = carried.select(run, "line_no", "open", F.explode("found").alias("m")).where("m.value IS NOT NULL")
    return out.select(run, "line_no", F.coalesce("m.own", "open").alias("epoch"), F.col("m.name").alias("name"), F.col("m.value").alias("value"))


def leaderboard(metrics: DataFrame, dataset: str, run: str, name: str) -> DataFrame:
    """(data set, run, best value, rank) of a metric over the runs of a data set, equal values ranked equal.

    Different values are ranked by how many runs have a smaller one: values are counted, numbered by ranges of data set
    and value, and summed within ranges, so no task sees all runs of a data set.
    """
    best = metrics.where(F.col("name") == name).groupBy(dataset, run).agg(F.min("value").alias("best"))
    counts = best.groupBy(dataset, "best").agg(F.count(F.lit(1)).alias("n"))
    places = ranked(counts, dataset, "best", "n")
    return best.join(places, [dataset, "best"]).select(dataset, run, "best", F.col("rank").cast("int"))


def ranked(counts: DataFrame, by: str, value: str, n: str, width: int = 1024) -> DataFrame:
    """(by, value, rank): one more than what ``n`` sums to over the smaller values of each ``by``.

    Values are numbered by ranges and cut into chunks of ``width``; a value's sum is that of the chunks before and of the
    values before it in its chunk.
    """
    rows = numbered(counts, F.col(by).asc_nulls_first(), F.col(value), name="__p").withColumn("__c", F.floor(F.col("__p") / width))
    inside = Window.partitionBy("__c", by).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy(by).orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each chunk: a ``width``-th of the values
    chunks = rows.groupBy(by, "__c").agg(F.sum(n).alias("s")).select(F.col(by).alias("__by"), "__c", F.coalesce(F.sum("s").over(ahead), F.lit(0)).alias("__s"))
    out = rows.withColumn("__i", F.coalesce(F.sum(n).over(inside), F.lit(0)))
    return out.join(chunks, out[by].eqNullSafe(chunks["__by"]) & (out["__c"] == chunks["__c"])).select(by, value, (F.col("__i") + F.col("__s") + 1).alias("rank"))
