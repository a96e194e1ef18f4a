"""Connected components of a distributed edge list, by alternating star contractions.

Every round hangs each node's larger neighbours, then its smaller ones, on the
smallest node it knows (minima with map-side combine and a join, which AQE splits
where a node has many neighbours). Rounds end when nothing changes; each is written
to the shared folder, so a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import materialise


def _hang(edges: DataFrame, node: str, other: str) -> DataFrame:
    """``edges`` with the least neighbour of ``node``."""
    return edges.join(edges.groupBy(node).agg(F.min(other).alias("_least")), node)


def _round(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("low").alias("high"), F.col("high").alias("low")))
    # Larger neighbours (low is the node here, high its neighbour).
    large = _hang(both.select(F.col("high").alias("node"), F.col("low").alias("near")), "node", "near").filter(
        F.col("near") > F.col("node")
    ).select(F.col("near").alias("high"), F.least("_least", "node").alias("low")).distinct()
    # Smaller neighbours, and the node itself.
    small = _hang(large.select(F.col("high").alias("node"), F.col("low").alias("near")), "node", "near")
    return small.select(
        F.explode(F.array(
            F.struct(F.col("near").alias("high"), F.col("_least").alias("low")),
            F.struct(F.col("node").alias("high"), F.col("_least").alias("low")),
        )).alias("e")
    ).select("e.*").filter(F.col("high") > F.col("low")).distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, root for every node of ``edges`` that is not the smallest of its component."""
    now = edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("high"), F.least(a, b).alias("low")).distinct()
    now, before = materialise(now, "stars"), None
    while True:
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).first()
        if seen == before or not seen[0]:
            return now.select(F.col("high").alias("node"), F.col("low").alias("root"))
        now, before = materialise(_round(now), "stars"), seen
