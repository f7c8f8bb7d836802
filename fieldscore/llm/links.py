"""Connected components of a table of links, by hooking to the smallest neighbour and contracting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def _ordered(links: DataFrame) -> DataFrame:
    """Each link once, the smaller end first; links inside a node are gone."""
    return links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of the links (a, b); nodes have one label if and only if links join them.

    A round hooks each node to the smallest of itself and its neighbours and follows the hooks to their roots. Then
    links are taken between roots: those inside a root are gone, so each round has fewer. Rounds are staged, nothing
    is gathered.
    """
    edges = stage(_ordered(links))
    labels = None
    while True:
        ends = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        roots = stage(ends.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("x"), F.least("a", "m").alias("root")))
        while True:  # hooks point to smaller nodes, so there are no cycles
            ahead = roots.select(F.col("x").alias("root"), F.col("root").alias("next"))
            jumped = stage(roots.join(ahead, "root").select("x", F.col("next").alias("root"), (F.col("next") < F.col("root")).alias("moved")))
            roots = jumped.select("x", "root")
            if jumped.where("moved").isEmpty():
                break
        if labels is None:
            labels = roots.select(F.col("x").alias("node"), F.col("root").alias("label"))
        else:
            labels = stage(labels.join(roots, labels["label"] == roots["x"], "left").select("node", F.coalesce("root", "label").alias("label")))
        edges = stage(
            _ordered(
                edges.join(roots.select(F.col("x").alias("a"), F.col("root").alias("ra")), "a")
                .join(roots.select(F.col("x").alias("b"), F.col("root").alias("rb")), "b")
                .select(F.col("ra").alias("a"), F.col("rb").alias("b"))
            )
        )
        if edges.isEmpty():
            return labels
