"""Places in a global order, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import scratch_dir

_WITHIN = (1 << 33) - 1


def numbered(df: DataFrame, *by: Column, name: str = "place") -> DataFrame:
    """The rows with their place from 0 in the order of ``by``, gapless.

    Rows are dealt by range and sorted within their partition; a partition starts behind the rows of those before it.
    Only one count for each partition reaches the driver. ``by`` should tell all rows apart, as rows that it leaves equal
    go to one partition and stand in any order.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_dir(spark)
    # an id of Spark is the partition and, in its 33 lower bits, the place there
    df.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id()).write.parquet(path)
    stored = spark.read.parquet(path)
    part = F.shiftright("__at", 33)
    starts, total = [], 0
    for r in stored.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect():  # a row a partition
        starts.append((r["part"], total))
        total += r["n"]
    offsets = spark.createDataFrame(starts, "__part long, __start long")
    out = stored.withColumn("__part", part).join(F.broadcast(offsets), "__part")
    return out.withColumn(name, F.col("__start") + F.col("__at").bitwiseAND(F.lit(_WITHIN))).drop("__part", "__start", "__at")
