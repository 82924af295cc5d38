"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendcloud.llm.common import stored


def _fingerprint(edges: DataFrame) -> tuple:
    """Equal for equal sets of links."""
    mark = F.xxhash64("low", "high").cast("decimal(38,0)")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(mark)).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of the links (a, b); root is the smallest node it reaches.

    Each round points every node's larger neighbours, then its smaller ones, at
    the smallest neighbour it knows. The number of rounds grows with the
    logarithm of a component's size. A round is written out, which cuts the
    lineage; a node with many neighbours is only ever aggregated, never collected.
    """
    node = F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")
    edges = links.filter("a <> b").select(*node).distinct()
    edges = stored(edges, "links")
    state = _fingerprint(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("high").alias("low"), F.col("low").alias("high")))
        # (low = a node, high = one of its neighbours)
        least = both.groupBy("low").agg(F.least(F.min("high"), F.first("low")).alias("least"))
        large = both.filter("high > low").join(least, "low").select(F.col("least").alias("low"), "high")
        smaller = large.groupBy("high").agg(F.min("low").alias("least"))
        small = large.join(smaller, "high")
        small = (
            small.select(F.col("least").alias("low"), F.col("high"))
            .union(small.select(F.col("least").alias("low"), F.col("low").alias("high")))
            .filter("low <> high")
            .distinct()
        )
        edges = stored(small, "links")
        before, state = state, _fingerprint(edges)
        if state == before:
            break
    roots = edges.select(F.col("high").alias("node"), F.col("low").alias("root"))
    return roots.union(edges.select(F.col("low"), F.col("low"))).distinct()
