"""Dated snapshots of series: reading today's, and expiry by the date in the key.

`as_of` is always an argument, so that a run can be repeated.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendcloud.functions.columns import parse_day
from trendcloud.operators.bars import normalize_bars
from trendcloud.operators.catalog import SNAPSHOT_PREFIX, base_name
from trendcloud.schema import BAR_NAMES

RETENTION_DAYS = 7


def key_date(key: Column) -> Column:
    """The date at the end of a snapshot's key; NULL if there is none."""
    tail = F.regexp_extract(base_name(key), r"(?:^|_)(\d{4}-\d{1,2}-\d{1,2})(?:\.json)?$", 1)
    return parse_day(tail)


def snapshot_read(envelopes: DataFrame, as_of: date) -> DataFrame:
    """Bars of the snapshots dated, and stamped, on the day `as_of`.

    `envelopes` has `ticker, cache_date, timestamp, data`, `data` being an array
    of bars; both dates are tested before anything is unpacked.
    """
    day = F.lit(as_of)
    today = envelopes.filter(
        (F.col("cache_date") == day) & (parse_day(F.col("timestamp")) == day)
    )
    bars = today.select("ticker", F.inline("data"))
    return normalize_bars(bars, BAR_NAMES)


def _dated(objects: DataFrame) -> DataFrame:
    return objects.filter(F.col("key").startswith(SNAPSHOT_PREFIX)).withColumn(
        "cache_date", key_date(F.col("key"))
    )


def _expired(as_of: datetime, days: int) -> Column:
    cutoff = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days))
    return F.col("cache_date").cast("timestamp_ntz") < cutoff


def snapshot_expired(
    objects: DataFrame, as_of: datetime, days: int = RETENTION_DAYS, ticker: str | None = None
) -> DataFrame:
    """Snapshots whose date, at midnight, is more than `days` before `as_of`.

    Keys without a date are passed over. With `ticker`, only its snapshots.
    """
    dated = _dated(objects).filter(_expired(as_of, days))
    if ticker is not None:
        dated = dated.filter(F.col("key").startswith(f"{SNAPSHOT_PREFIX}{ticker}_"))
    return dated


def snapshot_live(objects: DataFrame, as_of: datetime, days: int = RETENTION_DAYS) -> DataFrame:
    """Snapshots that stay, those without a date among them."""
    return _dated(objects).filter(F.coalesce(~_expired(as_of, days), F.lit(True)))


def snapshot_all(objects: DataFrame) -> DataFrame:
    """Every snapshot: what a forced clean-up removes."""
    return _dated(objects)
