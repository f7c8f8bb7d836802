"""File manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """(path, length) of every file below a folder; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
