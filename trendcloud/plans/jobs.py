"""Batch jobs: collecting series and computing indicators over a bar table."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trendcloud import schema
from trendcloud.operators.bars import csv_line_bytes, normalize_bars
from trendcloud.operators.indicators import ichimoku_cloud
from trendcloud.operators.registry import registry_list, registry_merge
from trendcloud.operators.snapshots import RETENTION_DAYS
from trendcloud.operators.tickers import validate_tickers
from trendcloud.params import CloudParams
from trendcloud.sources.files import (
    BUCKETS,
    ensure_checkpoint_dir,
    exists,
    read_series,
    registry_write,
    scan_registry,
    snapshot_expire,
    snapshot_write,
    write_bars,
)


#: Series that are named to the reader one by one; of more all buckets are read.
FEW = 10_000


@dataclass(frozen=True)
class Collected:
    """What a collection did."""

    report: DataFrame  # ticker, status, rows_processed, data_existed
    invalid: DataFrame  # ticker, reason
    registry: DataFrame  # the tickers from now on


def _in_range(start: str | None, end: str | None):
    """Half-open range of days; an end that is None is open, and rows without a day are in no closed range."""
    day, inside = F.col("time"), F.lit(True)
    if start is not None:
        inside = inside & (day >= F.lit(start).cast("date"))
    if end is not None:
        inside = inside & (day < F.lit(end).cast("date"))
    return F.coalesce(inside, F.lit(False))


def valid_landing(landing: DataFrame) -> DataFrame:
    """Bars of the landing rows whose ticker is valid."""
    named = validate_tickers(landing).filter("is_valid").withColumn("ticker", F.col("symbol"))
    return normalize_bars(named.select(landing.columns))


def landing_bars(landing: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Bars in the range, of the landing rows whose ticker is valid."""
    return valid_landing(landing).filter(_in_range(start, end))


def collect_ingest(
    landing: DataFrame,
    path: str,
    registry_path: str | None = None,
    start: str | None = None,
    end: str | None = None,
    max_tickers: int | None = None,
    max_bytes: int | None = None,
    fmt: str = "parquet",
    buckets: int = BUCKETS,
) -> Collected:
    """Validate, normalise and store landing rows; extend the registry at `registry_path`.

    `landing` has `ticker` and six columns in bar order. Series already stored
    are replaced, others stay. Range and limits are open unless given: with
    `max_bytes` a series that is larger as CSV, and with `max_tickers` one for
    which the registry has no room, is reported and not written. A valid ticker
    without rows in the range is reported as `no_data`. `data_existed` tells
    whether the store had the series before.

    Two passes over the landing rows: one for the size of each series (the small
    result is checkpointed and feeds guard, registry and report), one for the write.
    """
    spark = landing.sparkSession
    ensure_checkpoint_dir(spark)
    bars, inside = valid_landing(landing), _in_range(start, end)
    header = len(",".join(schema.BAR_NAMES)) + 1
    sizes = (
        bars.groupBy("ticker")
        .agg(
            F.count_if(inside).alias("rows_processed"),
            (F.coalesce(F.sum(F.when(inside, csv_line_bytes())), F.lit(0)) + F.lit(header)).alias("bytes"),
        )
        .checkpoint()
    )
    known = _stored_tickers(spark, path, fmt).checkpoint()
    registry = spark.createDataFrame([], "ticker string")
    if registry_path is not None and exists(spark, registry_path):
        registry = registry_list(scan_registry(spark, registry_path)).distinct()
    has_rows = F.col("rows_processed") > 0
    fits = has_rows if max_bytes is None else has_rows & (F.col("bytes") <= max_bytes)
    fitting = sizes.filter(fits)
    merged, full = registry_merge(registry, fitting, max_tickers)
    merged, full = merged.checkpoint(), full.checkpoint()
    stored = fitting.join(full, "ticker", "left_anti").select("ticker")
    write_bars(bars.filter(inside).join(stored, "ticker", "left_semi"), path, fmt, buckets)
    if registry_path is not None:
        registry_write(merged, registry_path)

    refused = full.withColumn("_full", F.lit(True))
    status = F.when(~has_rows, F.lit("no_data"))
    if max_bytes is not None:
        status = status.when(F.col("bytes") > max_bytes, F.lit("too_large"))
    status = status.when(F.col("_full"), F.lit("registry_full")).otherwise(F.lit("stored"))
    report = (
        sizes.join(known.withColumn("_known", F.lit(True)), "ticker", "left")
        .join(refused, "ticker", "left")
        .select(
            "ticker",
            status.alias("status"),
            "rows_processed",
            F.col("_known").isNotNull().alias("data_existed"),
        )
    )
    invalid = (
        validate_tickers(landing.select("ticker").distinct())
        .filter("not is_valid")
        .select("ticker", "reason")
    )
    return Collected(report, invalid, merged)


def _stored_tickers(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    """The tickers that a bar table holds; none if there is no table."""
    if not exists(spark, path):
        return spark.createDataFrame([], "ticker string")
    return read_series(spark, path, fmt).select(F.col("ticker").cast("string")).distinct()


def indicator_job(
    spark: SparkSession,
    bars_path: str,
    out_path: str,
    params: CloudParams = CloudParams(),
    fmt: str = "parquet",
    block_rows: int | None = None,
) -> None:
    """Compute the indicator for a stored bar table and store it by ticker.

    With `block_rows` series are worked on in blocks, for tables whose series are
    too long for one task.
    """
    bars = read_series(spark, bars_path, fmt)
    write_bars(ichimoku_cloud(bars, params, block_rows), out_path, fmt)


def indicator_update(
    spark: SparkSession,
    new: DataFrame,
    bars_path: str,
    out_path: str,
    params: CloudParams = CloudParams(),
) -> None:
    """Add `new` bars to a stored bar table and bring its stored indicator up to date.

    A new bar replaces the stored one of its ticker and day. Of each series with new
    bars only the rows that these can change are made anew: from `rows_after` rows
    before the first new day, whose lagging close may move, to the projected end;
    that takes the `rows_before` bars before them and no earlier ones. Other series
    are not read and, unless they share a bucket, not written. A run that breaks off
    is finished by running it again.
    """
    ensure_checkpoint_dir(spark)
    names = [f.name for f in schema.BARS.fields]
    new = new.select(*names).checkpoint()
    series = lambda: F.coalesce(F.col("ticker"), F.lit("\x00")).alias("_series")
    since = new.groupBy(series()).agg(
        # A bar without a day comes first in its series.
        F.when(F.count_if(F.col("time").isNull()) == 0, F.min("time")).alias("_since")
    )
    since = since.checkpoint()
    if not since.limit(1).count():
        return
    tickers = [None if r["_series"] == "\x00" else r["_series"] for r in since.select("_series").collect()] if since.count() <= FEW else None
    held = None
    if exists(spark, bars_path):
        own = read_series(spark, bars_path, tickers=tickers).select(*names, series())
        keys = new.select(series(), F.col("time").alias("_time")).distinct()
        same = (F.col("_series") == F.col("_key")) & F.col("time").eqNullSafe(F.col("_time"))
        held = own.join(since.select("_series"), "_series", "left_semi")
        held = held.join(keys.withColumnRenamed("_series", "_key"), same, "left_anti").drop("_series")
    merged = (new if held is None else held.unionByName(new)).checkpoint()
    write_bars(merged, bars_path)

    placed = merged.withColumn("_series", series()).join(since, "_series")
    changed = F.coalesce(F.col("time") >= F.col("_since"), F.col("_since").isNull())
    marked = placed.withColumn("_changed", changed)
    latest = Window.partitionBy("_series", "_changed").orderBy(F.desc_nulls_last("time"), F.desc("high"), F.desc("low"), F.desc("close"))
    reach = params.rows_after + params.rows_before
    numbered = marked.withColumn("_back", F.row_number().over(latest))
    tail = numbered.filter(F.col("_changed") | (F.col("_back") <= reach)).checkpoint()
    # The first row that is made anew; a series without so many rows is made anew from its start.
    before = F.when(~F.col("_changed") & (F.col("_back") == max(1, params.rows_after)), F.col("time"))
    start = tail.groupBy("_series").agg(
        F.max(before).alias("_start"),
        (F.count_if(~F.col("_changed")) < max(1, params.rows_after)).alias("_all"),
    )
    made = ichimoku_cloud(tail.select(*names), params)
    columns = made.columns
    made = made.withColumn("_series", series()).join(start, "_series")
    fresh = made.filter(F.col("_all") | F.col("_start").isNull() | (F.col("time") >= F.col("_start"))).select(*columns)
    if exists(spark, out_path):
        out = read_series(spark, out_path, tickers=tickers).withColumn("_series", series()).join(start, "_series")
        stays = out.filter(~F.col("is_projected") & ~F.col("_all") & (F.col("time") < F.col("_start")))
        fresh = fresh.unionByName(stays.select(*columns))
    write_bars(fresh.checkpoint(), out_path)


def refresh_snapshot(
    provider: DataFrame, path: str, as_of: datetime, days: int = RETENTION_DAYS
) -> list[str]:
    """Keep what a provider delivered as the day's snapshot, and drop expired ones of its tickers.

    Nothing is written or dropped if it had no rows. Returns the days from which
    something was dropped.
    """
    spark = provider.sparkSession
    if isinstance(as_of, date) and not isinstance(as_of, datetime):
        as_of = datetime.combine(as_of, time.min)
    ensure_checkpoint_dir(spark)
    tickers = provider.select("ticker").distinct().checkpoint()
    if not tickers.limit(1).count():
        return []
    snapshot_write(provider, path, as_of.date())
    return snapshot_expire(spark, path, as_of, days, tickers)
