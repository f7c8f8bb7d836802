"""Metric reports as JSON, CSV and text, and trial tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .trials import TrialStore


def write_report(metrics: DataFrame, path: str) -> None:
    """A report of few rows: ``json/``, ``csv/`` with a header, and ``text/`` with a line for each number."""
    few = metrics.coalesce(1)
    few.write.json(f"{path}/json")
    few.write.option("header", True).csv(f"{path}/csv")
    lines = F.concat_ws("\n", *[F.concat(F.lit(f"{c}: "), F.col(c).cast("string")) for c in metrics.columns])
    few.select(lines.alias("value")).write.text(f"{path}/text")


def read_trials(spark: SparkSession, source: str, table: str | None = None, **options: str) -> DataFrame:
    """(study, trial, state, value) from a JDBC store (with ``table``), an SQLite file (``*.db``, ``*.sqlite``) or a folder of Parquet files."""
    if table is not None:
        return spark.read.format("jdbc").options(url=source, dbtable=table, **options).load().select("study", "trial", "state", "value")
    if source.endswith((".db", ".sqlite")):
        spark.dataSource.register(TrialStore)
        return spark.read.format("trial_store").options(path=source, **options).load()
    return spark.read.parquet(source).select("study", "trial", "state", "value")
