"""The object listing: catalogue of series, snapshot status, store metrics.

`objects` has `key, size, last_modified`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendcloud.functions.columns import megabytes

DATA_PREFIX = "data/"
SNAPSHOT_PREFIX = "cache/"


def base_name(key: Column) -> Column:
    return F.substring_index(key, "/", -1)


def key_ticker(key: Column) -> Column:
    """The name in front of the first underscore of the file name."""
    return F.substring_index(base_name(key), "_", 1)


def catalog_listing(objects: DataFrame, suffix: str = ".csv") -> DataFrame:
    """The series files of a listing with their tickers; `suffix` picks those of a year."""
    key = F.col("key")
    is_series = key.startswith(DATA_PREFIX) & key.endswith(".csv") & key.contains(suffix)
    return objects.filter(is_series).select(
        key_ticker(key).alias("ticker"), "key", "size", "last_modified"
    )


def _snapshots(objects: DataFrame) -> DataFrame:
    return objects.filter(F.col("key").startswith(SNAPSHOT_PREFIX))


def cache_status(objects: DataFrame) -> DataFrame:
    """Number and bytes of all snapshot objects."""
    total = F.coalesce(F.sum("size"), F.lit(0).cast("bigint"))
    return (
        _snapshots(objects)
        .agg(F.count(F.lit(1)).alias("total_files"), total.alias("total_size"))
        .withColumn("size_mb", megabytes(F.col("total_size")))
    )


def cache_status_by_ticker(objects: DataFrame) -> DataFrame:
    return (
        _snapshots(objects)
        .groupBy(key_ticker(F.col("key")).alias("ticker"))
        .agg(F.count(F.lit(1)).alias("files"))
    )


def store_metrics(objects: DataFrame) -> DataFrame:
    """Objects under each prefix; the registry file counts as a data object."""
    key = F.col("key")
    return objects.agg(
        F.count_if(key.startswith(DATA_PREFIX)).alias("data_files"),
        F.count_if(key.startswith(SNAPSHOT_PREFIX)).alias("cache_files"),
    )
