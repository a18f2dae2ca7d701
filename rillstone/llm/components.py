"""Connected components by alternating large and small stars, as joins and aggregations of DataFrames.

Minima are aggregated map-side first and written out before the join, so a hub with a great many neighbours is never gathered
in one task: the join's exchanges are plain ones whose skewed partitions Spark splits. Rounds grow with the logarithm of the
longest path; each round cuts lineage by writing its edges to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component) for every node of edges (a, b): component is the smallest id reachable. Loops and repeated edges don't
    matter; nodes without an edge to another node have no row."""
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "components")
    seen = None
    for _ in range(most_rounds):
        both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).union(edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = stored(both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m")), "components-least")
        large = stored(both.join(least, "x").where("y > x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct(), "components-large")
        low = stored(large.groupBy("u").agg(F.min("v").alias("m")), "components-low")
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        before, edges = edges, stored(small.distinct(), "components")
        discard(before, least, large, low)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit((1 << 40) - 1)))).first())
        if now == seen:
            roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)
        seen = now
    raise RuntimeError(f"no fixed point after {most_rounds} rounds")
