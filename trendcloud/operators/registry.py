"""The list of known tickers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendcloud.functions.columns import strip

def registry_list(lines: DataFrame, col: str = "value") -> DataFrame:
    """Trimmed, non-empty entries in ascending order; repeats stay."""
    names = lines.select(strip(F.col(col)).alias("ticker"))
    return names.filter(F.col("ticker") != "").orderBy("ticker")


def registry_count(registry: DataFrame) -> DataFrame:
    return registry.agg(F.count(F.lit(1)).alias("count"))


def registry_merge(
    existing: DataFrame, new: DataFrame, cap: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Add tickers that are not there yet; returns (registry, refused).

    Entries already there always stay. With a `cap`, new ones are let in in
    ascending order until the registry holds so many entries; the others are
    refused. Without one none is.
    """
    known = existing.select("ticker")
    fresh = new.select("ticker").distinct().join(known, "ticker", "left_anti")
    if cap is None:
        return known.unionByName(fresh).orderBy("ticker"), fresh.filter(F.lit(False))
    free = max(0, cap - known.count())
    # The first `free` by name: Spark cuts each task's rows to as many before they meet.
    admitted = fresh.orderBy("ticker").limit(free)
    refused = fresh.join(admitted, "ticker", "left_anti")
    return known.unionByName(admitted).orderBy("ticker"), refused
