"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's larger neighbours (large), or itself and its smaller ones, to its least neighbour."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the undirected links (u, v); component: its least node.

    Loops and repeated links are allowed; an empty link table gives no rows. Every round is
    checkpointed in the shared folder; rounds grow with the logarithm of the longest path.
    """
    now = checkpointed(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    digest = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long"))).first()
    before = digest(now)
    if not before[0]:
        return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for _ in range(max_rounds):
        now = checkpointed(_stars(_stars(now, True), False))
        after = digest(now)
        if after == before:
            roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
        before = after
    raise RuntimeError("components did not settle")
