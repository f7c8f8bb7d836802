"""Scoring as Structured Streaming jobs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.metrics import pair_scores
from ..sources.scratch import exists


def score_new(pairs: DataFrame, id_col: str, target: str, checkpoint: str) -> StreamingQuery:
    """Score pairs of a stream once and append them to ``target``; of rows with one id one counts, null is an id too.

    Scored ids are the stream's keyed state, so a batch reads nothing of what it has written before, also after a restart.
    Rows that the target held when the checkpoint was new count as scored: their ids enter the state with the first batch,
    the only one that is joined with them. The target is partitioned by ``batch``; a batch that is run again replaces its
    part. For more ids than fit into the executors' memory, set the RocksDB state store.
    """
    spark, kind = pairs.sparkSession, pairs.select(id_col).schema
    earlier = f"{checkpoint}-earlier"
    if not exists(spark, f"{checkpoint}/offsets/0"):  # later it must stay as it is
        ids = spark.read.schema(kind).parquet(target).select(id_col).distinct() if exists(spark, target) else spark.createDataFrame([], kind)
        ids.write.mode("overwrite").parquet(earlier)
    before = spark.readStream.schema(kind).parquet(earlier)
    both = pairs.withColumn("__new", F.lit(True)).unionByName(before.withColumn("__new", F.lit(False)), allowMissingColumns=True)
    folder = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def batch(rows: DataFrame, number: int) -> None:
        rows = rows.where("__new")
        if number == 0:  # the state may have met the new row of an id first
            rows = rows.join(spark.read.schema(kind).parquet(earlier).withColumnRenamed(id_col, "__id"), F.col(id_col).eqNullSafe(F.col("__id")), "left_anti")
        pair_scores(rows).select(id_col, "edits", "ref_len", "cer").write.mode("overwrite").parquet(f"{target}/batch={folder}-{number:08d}")

    once = both.dropDuplicates([id_col])
    return once.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_cer(pairs: DataFrame, dataset: str) -> DataFrame:
    """Rates by dataset over all that has come; for update or complete output."""
    scored = pair_scores(pairs)
    return scored.groupBy(dataset).agg(F.count(F.lit(1)).alias("n"), F.avg("cer").alias("macro_cer"), (F.sum("edits") / F.sum("ref_len")).alias("micro_cer"))


def suppress_repeats(requests: DataFrame, keys: list[str], time: str, bound: str) -> DataFrame:
    """The first request of each key within a time bound; a later one beyond the bound counts as new."""
    return requests.withWatermark(time, bound).dropDuplicatesWithinWatermark(keys)


BEST = "run long, epoch long, value double"


class BestSoFar(StatefulProcessor):
    """Holds the best value of a run; rows that are strictly better come out."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.best = handle.getValueState("best", "value double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:  # noqa: N802
        # plain arrays: a run has few rows, and a table for each would cost more than they do
        parts = [(f["epoch"].to_numpy(), f["value"].to_numpy(np.float64, na_value=np.nan)) for f in rows]
        epoch, value = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(epoch, kind="stable")
        epoch, value = epoch[order], value[order]
        best = self.best.get()
        before = np.fmin.accumulate(np.append(best[0] if best else np.inf, value))[:-1]
        better = value < before
        if better.any():
            self.best.update((float(value[better][-1]),))
            yield pd.DataFrame({"run": key[0], "epoch": epoch[better], "value": value[better]})

    def close(self) -> None:
        pass


def new_best_alerts(metrics: DataFrame) -> DataFrame:
    """Alerts (run, epoch, value) on a stream of (run, epoch, value); rows of a run come in epoch order. Needs the RocksDB store."""
    return metrics.groupBy("run").transformWithStateInPandas(BestSoFar(), outputStructType=BEST, outputMode="Append", timeMode="None")
