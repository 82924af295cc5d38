"""The registered queries: each operator over the given tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendcloud import schema
from trendcloud.operators import access, admission, bars, cascade, catalog, indicators
from trendcloud.operators import registry, series, snapshots, tickers
from trendcloud.params import CloudParams
from trendcloud.plans.jobs import collect_ingest as run_collect
from trendcloud.plans.jobs import indicator_job, landing_bars
from trendcloud.plans.jobs import indicator_update as update_indicator
from trendcloud.plans.jobs import refresh_snapshot as run_refresh
from trendcloud.sources import files, tables
from trendcloud.streaming import admission as admission_streaming
from trendcloud.streaming.access import access_log_stream

FAST = CloudParams(5, 10, 10, 20, 10)
SNAPSHOT_DAY = date(1998, 6, 30)
YEAR_END = date(1998, 12, 31)
AS_OF = datetime(1998, 9, 1, 12, 0)
CSV_SUFFIX = "_1998_data.csv"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indicators.ichimoku_cloud(tables.brand_bars(spark, sf_dir))


# The indicator


@query
def ichimoku_cloud(spark, sf_dir):
    return _cloud(spark, sf_dir)


@query
def ichimoku_fast(spark, sf_dir):
    """Short lengths on many short series."""
    return indicators.ichimoku_cloud(tables.supplier_bars(spark, sf_dir), FAST)


@query
def ichimoku_blocks(spark, sf_dir):
    """The plan for series too long for one task, with small blocks."""
    return indicators.ichimoku_cloud(tables.brand_bars(spark, sf_dir), block_rows=256)


@query
def tenkan_sen(spark, sf_dir):
    out = indicators.tenkan_sen(tables.brand_bars(spark, sf_dir))
    return out.select("ticker", "time", "tenkan_sen")


@query
def kijun_sen(spark, sf_dir):
    out = indicators.kijun_sen(tables.brand_bars(spark, sf_dir))
    return out.select("ticker", "time", "kijun_sen")


@query
def chikou_span(spark, sf_dir):
    out = indicators.chikou_span(tables.brand_bars(spark, sf_dir))
    return out.select("ticker", "time", "chikou_span")


@query
def senkou_span_a(spark, sf_dir):
    out = indicators.senkou_span_a(tables.brand_bars(spark, sf_dir))
    return out.select("ticker", "time", "senkou_span_a", "is_projected")


@query
def senkou_span_b(spark, sf_dir):
    out = indicators.senkou_span_b(tables.brand_bars(spark, sf_dir))
    return out.select("ticker", "time", "senkou_span_b", "is_projected")


@query
def future_rows(spark, sf_dir):
    return indicators.extend_horizon(tables.brand_bars(spark, sf_dir))


@query
def cloud_color(spark, sf_dir):
    return _cloud(spark, sf_dir).groupBy("ticker", "cloud_color").agg(
        F.count(F.lit(1)).alias("rows")
    )


@query
def cloud_parameters(spark, sf_dir):
    cloud = indicators.ichimoku_cloud(tables.supplier_bars(spark, sf_dir), FAST)
    return indicators.cloud_parameters(cloud, FAST)


# Chart series


@query
def line_series(spark, sf_dir):
    return series.line_series(_cloud(spark, sf_dir))


@query
def candles(spark, sf_dir):
    return series.candles(_cloud(spark, sf_dir))


@query
def volume_bars(spark, sf_dir):
    return series.volume_bars(_cloud(spark, sf_dir))


@query
def cloud_bands(spark, sf_dir):
    return series.cloud_bands(_cloud(spark, sf_dir))


@query
def cloud_bands_long(spark, sf_dir):
    return series.cloud_bands_long(series.line_series(_cloud(spark, sf_dir)))


@query
def preview(spark, sf_dir):
    return bars.preview(tables.brand_bars(spark, sf_dir))


@query
def last_bars(spark, sf_dir):
    return bars.last_bars(tables.brand_bars(spark, sf_dir))


@query
def records_json(spark, sf_dir):
    return bars.records_json(_cloud(spark, sf_dir))


# Bars


@query
def normalize_bars(spark, sf_dir):
    return bars.normalize_bars(tables.raw_lines(spark, sf_dir))


@query
def bar_quality(spark, sf_dir):
    return bars.bar_quality(bars.normalize_bars(tables.raw_lines(spark, sf_dir)))


@query
def date_range(spark, sf_dir):
    return bars.date_range(tables.supplier_bars(spark, sf_dir), "1997-01-01", "1997-12-31")


@query
def landing(spark, sf_dir):
    return landing_bars(tables.landing(spark, sf_dir), "1997-01-01", "1997-12-31")


@query
def series_counts(spark, sf_dir):
    return bars.series_counts(tables.supplier_bars(spark, sf_dir))


@query
def size_guard(spark, sf_dir):
    return bars.size_guard(tables.supplier_bars(spark, sf_dir), 530)[0]


@query
def size_guard_refused(spark, sf_dir):
    return bars.size_guard(tables.supplier_bars(spark, sf_dir), 530)[1]


@query
def csv_guard(spark, sf_dir):
    """Bytes of each series as CSV, refused ones only."""
    return bars.csv_guard(tables.supplier_bars(spark, sf_dir), 26_000)[1]


@query
def csv_guard_kept(spark, sf_dir):
    """The series that `csv_guard` does not refuse."""
    return bars.csv_guard(tables.supplier_bars(spark, sf_dir), 26_000)[0]


@query
def bars_from_records(spark, sf_dir):
    """The indicator as JSON records, read back with the types of its further fields."""
    cloud = _cloud(spark, sf_dir)
    extra = T.StructType([f for f in cloud.schema if f.name not in schema.BARS.names])
    return bars.bars_from_json(bars.records_json(cloud), extra=extra)


@query
def scan_csv_named(spark, sf_dir):
    """Bars exported as one CSV file per ticker, named by it, and scanned again."""
    return files.scan_bars(spark, _exported(spark, sf_dir), glob=f"*{CSV_SUFFIX}")


def _exported(spark, sf_dir):
    """Series files, named by ticker, and the registry in a folder as outside programs lay them out."""
    path = files.scratch_dir(spark, "store")
    named = tables.brand_bars(spark, sf_dir).withColumn("_file", F.replace("ticker", F.lit("#"), F.lit("")))
    files.export_named(named.drop("ticker"), f"{path}/data", "_file", "csv", CSV_SUFFIX)
    return f"{path}/data"


@query
def scan_objects(spark, sf_dir):
    """The listing of those files: keys and sizes."""
    return files.scan_objects(spark, _exported(spark, sf_dir)).select("key", "size")


@query
def scan_snapshots(spark, sf_dir):
    """Snapshots exported as JSON files, named by ticker and day, and a day's bars read from them."""
    path = files.scratch_dir(spark, "cache")
    envelopes = tables.snapshot_envelopes(spark, sf_dir, yearly=True)
    symbol = F.replace("ticker", F.lit("#"), F.lit(""))
    named = envelopes.withColumn("_file", F.concat(symbol, F.lit("_"), F.col("cache_date").cast("string")))
    files.export_named(named.drop("cache_date"), path, "_file", "json", ".json")
    return snapshots.snapshot_read(files.scan_snapshots(spark, path), YEAR_END)


@query
def scan_registry(spark, sf_dir):
    """The registry as a text file, read and rewritten sorted with the arrivals, and read again."""
    path = files.scratch_dir(spark, "registry")
    tables.registry_lines(spark, sf_dir).write.text(path)
    listed = registry.registry_list(files.scan_registry(spark, path))
    merged, _ = registry.registry_merge(listed.distinct(), _arrivals(spark, sf_dir))
    files.registry_write(merged, path)
    return registry.registry_list(files.scan_registry(spark, path))


@query
def scan_csv(spark, sf_dir):
    """Bars written as CSV and scanned again."""
    path = files.scratch_dir(spark, "bars-csv")
    files.write_bars(tables.brand_bars(spark, sf_dir), path, "csv")
    return files.scan_bars(spark, path)


@query
def scan_parquet(spark, sf_dir):
    path = files.scratch_dir(spark, "bars-parquet")
    files.write_bars(tables.brand_bars(spark, sf_dir), path)
    return files.scan_bars(spark, path, "parquet").select("ticker", *schema.BAR_NAMES)


# Tickers


@query
def ticker_validate(spark, sf_dir):
    return tickers.validate_tickers(tables.ticker_names(spark, sf_dir))


@query
def ticker_exists(spark, sf_dir):
    part = tables.table(spark, sf_dir, "part")
    names = part.select(F.replace("p_brand", F.lit("#"), F.lit("")).alias("ticker")).union(
        part.select("p_type")
    )
    listing = catalog.catalog_listing(tables.object_listing(spark, sf_dir), CSV_SUFFIX)
    return tickers.ticker_exists(names.distinct(), listing)


@query
def registry_list(spark, sf_dir):
    return registry.registry_list(tables.registry_lines(spark, sf_dir))


@query
def registry_count(spark, sf_dir):
    return registry.registry_count(registry.registry_list(tables.registry_lines(spark, sf_dir)))


def _registry(spark, sf_dir):
    return registry.registry_list(tables.registry_lines(spark, sf_dir)).distinct()


def _arrivals(spark, sf_dir):
    names = tables.landing(spark, sf_dir).select("ticker").distinct()
    valid = tickers.validate_tickers(names).filter("is_valid")
    return valid.select(F.col("symbol").alias("ticker"))


@query
def registry_merge(spark, sf_dir):
    return registry.registry_merge(_registry(spark, sf_dir), _arrivals(spark, sf_dir), 24)[0]


@query
def registry_refused(spark, sf_dir):
    return registry.registry_merge(_registry(spark, sf_dir), _arrivals(spark, sf_dir), 24)[1]


# Sources, snapshots, catalogue


def _collected(spark, sf_dir):
    """The collection job over a store that holds the brands of large parts, and its registry."""
    path = files.scratch_dir(spark, "collected")
    _registry(spark, sf_dir).select(F.col("ticker").alias("value")).write.text(f"{path}/registry")
    held = landing_bars(tables.landing(spark, sf_dir)).filter(F.endswith("ticker", F.lit("3")))
    files.write_bars(held, f"{path}/bars")
    done = run_collect(
        tables.landing(spark, sf_dir),
        f"{path}/bars",
        f"{path}/registry",
        "1997-01-01",
        "1997-12-31",
        max_tickers=24,
    )
    return path, done


@query
def collect_ingest(spark, sf_dir):
    """The collection job end to end; its report."""
    return _collected(spark, sf_dir)[1].report


@query
def collect_invalid(spark, sf_dir):
    """The names that the collection refuses, with reasons."""
    return _collected(spark, sf_dir)[1].invalid


@query
def collect_registry(spark, sf_dir):
    """The registry file as the collection leaves it."""
    path, _ = _collected(spark, sf_dir)
    return registry.registry_list(files.scan_registry(spark, f"{path}/registry"))


def _sources(spark, sf_dir):
    """A folder with the four sources as stored tables."""
    path = files.scratch_dir(spark, "sources")
    every = tables.brand_bars(spark, sf_dir)
    files.write_bars(every, f"{path}/provider")
    provider = files.read_series(spark, f"{path}/provider")
    number = F.split_part("ticker", F.lit("#"), F.lit(2)).cast("int")
    files.write_bars(bars.date_range(provider.filter(number % 2 == 0), "1998-01-01", "1999-01-01"), f"{path}/stored")
    files.write_bars(bars.date_range(provider, "1999-01-01", "2000-01-01"), f"{path}/local")
    files.snapshot_write(snapshots.snapshot_read(tables.snapshot_envelopes(spark, sf_dir), SNAPSHOT_DAY), f"{path}/cache", SNAPSHOT_DAY)
    return path


@query
def source_cascade(spark, sf_dir):
    """Snapshots first, then stored series, then one local series, then the provider.

    Which source serves a ticker is read from the tables' presence indexes; of each
    source only the buckets that it serves from are opened.
    """
    path = _sources(spark, sf_dir)
    stored = [
        cascade.StoredSource.of_day("s3_cache", f"{path}/cache", SNAPSHOT_DAY),
        cascade.StoredSource("s3_csv", f"{path}/stored"),
        cascade.StoredSource("local_csv", f"{path}/local", "Brand#25"),
    ]
    return cascade.resolve_stored(spark, stored, files.read_series(spark, f"{path}/provider"))


@query
def source_cascade_rows(spark, sf_dir):
    """The same for sources that are any tables: names are read from their rows."""
    path = _sources(spark, sf_dir)
    return cascade.resolve_sources(
        cascade.gate_sources(
            files.scan_snapshot_table(spark, f"{path}/cache", SNAPSHOT_DAY),
            files.read_series(spark, f"{path}/stored"),
            files.read_series(spark, f"{path}/local"),
            files.read_series(spark, f"{path}/provider"),
            use_csv=True,
            use_s3=True,
            local_ticker="Brand#25",
        )
    )


@query
def series_read(spark, sf_dir):
    """Two of the stored series; only the buckets that hold them are opened."""
    path = files.scratch_dir(spark, "series")
    files.write_bars(tables.brand_bars(spark, sf_dir), path)
    return files.read_series(spark, path, tickers=["Brand#12", "Brand#35"]).select("ticker", *schema.BAR_NAMES)


@query
def present_tickers(spark, sf_dir):
    """The tickers that a stored table holds, from its index, after some were replaced and some added."""
    path = files.scratch_dir(spark, "present")
    number = F.split_part("ticker", F.lit("#"), F.lit(2)).cast("int")
    every = tables.brand_bars(spark, sf_dir)
    files.write_bars(every.filter(number < 40), path)
    files.write_bars(every.filter(number > 30), path)
    return files.present_tickers(spark, path).select("ticker")


@query
def indicator_update(spark, sf_dir):
    """The indicator of bars to the end of 1997, brought up to date with those of 1998, by half-years."""
    path = files.scratch_dir(spark, "indicator")
    every = tables.brand_bars(spark, sf_dir)
    files.write_bars(every.filter("time < date'1998-01-01'"), f"{path}/bars")
    indicator_job(spark, f"{path}/bars", f"{path}/out")
    for start, end in (("1998-01-01", "1998-07-01"), ("1998-07-01", "2100-01-01")):
        update_indicator(spark, bars.date_range(every, start, end), f"{path}/bars", f"{path}/out")
    return files.read_series(spark, f"{path}/out").select(*_cloud(spark, sf_dir).columns)


@query
def snapshot_read(spark, sf_dir):
    return snapshots.snapshot_read(tables.snapshot_envelopes(spark, sf_dir), SNAPSHOT_DAY)


@query
def snapshot_write(spark, sf_dir):
    """Bars written as a day's snapshot and read back by day."""
    path = files.scratch_dir(spark, "snapshots")
    files.snapshot_write(tables.brand_bars(spark, sf_dir), path, SNAPSHOT_DAY)
    return files.scan_snapshot_table(spark, path, SNAPSHOT_DAY)


SNAPSHOT_DAYS = (datetime(1998, 8, 20), datetime(1998, 8, 25), datetime(1998, 8, 26))


def _by_year(spark, sf_dir, day):
    """The bars that a snapshot of a day holds here: those of a year."""
    start = 1994 + SNAPSHOT_DAYS.index(day)
    return bars.date_range(tables.brand_bars(spark, sf_dir), f"{start}-01-01", f"{start + 1}-01-01")


@query
def snapshot_expire(spark, sf_dir):
    """Snapshots of three days, of which two have expired; what is left."""
    path = files.scratch_dir(spark, "snapshots")
    for day in SNAPSHOT_DAYS:
        files.snapshot_write(_by_year(spark, sf_dir, day), path, day.date())
    files.snapshot_expire(spark, path, AS_OF)
    return files.scan_snapshot_table(spark, path)


@query
def snapshot_refresh(spark, sf_dir):
    """A provider delivers the brands whose numbers end in 1; their expired snapshots go, others stay."""
    path = files.scratch_dir(spark, "snapshots")
    for day in SNAPSHOT_DAYS[1:]:
        files.snapshot_write(_by_year(spark, sf_dir, day), path, day.date())
    provider = tables.brand_bars(spark, sf_dir).filter(F.endswith("ticker", F.lit("1")))
    run_refresh(provider, path, AS_OF)
    return files.scan_snapshot_table(spark, path)


@query
def snapshot_compact(spark, sf_dir):
    """The refreshed snapshots after what has expired was taken out of the files."""
    path = files.scratch_dir(spark, "snapshots")
    for day in SNAPSHOT_DAYS[1:]:
        files.snapshot_write(_by_year(spark, sf_dir, day), path, day.date())
    provider = tables.brand_bars(spark, sf_dir).filter(F.endswith("ticker", F.lit("1")))
    run_refresh(provider, path, AS_OF)
    files.compact_snapshots(spark, path)
    return files.scan_snapshot_table(spark, path)


@query
def snapshot_expired(spark, sf_dir):
    return snapshots.snapshot_expired(tables.object_listing(spark, sf_dir), AS_OF)


@query
def snapshot_expired_ticker(spark, sf_dir):
    return snapshots.snapshot_expired(
        tables.object_listing(spark, sf_dir), AS_OF, ticker="Brand12"
    )


@query
def snapshot_live(spark, sf_dir):
    return snapshots.snapshot_live(tables.object_listing(spark, sf_dir), AS_OF)


@query
def snapshot_all(spark, sf_dir):
    return snapshots.snapshot_all(tables.object_listing(spark, sf_dir))


@query
def catalog_listing(spark, sf_dir):
    return catalog.catalog_listing(tables.object_listing(spark, sf_dir), CSV_SUFFIX)


@query
def cache_status(spark, sf_dir):
    return catalog.cache_status(tables.object_listing(spark, sf_dir))


@query
def cache_status_by_ticker(spark, sf_dir):
    return catalog.cache_status_by_ticker(tables.object_listing(spark, sf_dir))


@query
def store_metrics(spark, sf_dir):
    return catalog.store_metrics(tables.object_listing(spark, sf_dir))


# Access and admission


@query
def access_log_summary(spark, sf_dir):
    return access.access_log_summary(tables.access_log(spark, sf_dir))


@query
def access_log_append(spark, sf_dir):
    """The log appended to a table and summed up from there."""
    path = files.scratch_dir(spark, "access-log")
    files.access_log_append(tables.access_log(spark, sf_dir), path)
    return access.access_log_summary(files.scan_access_log(spark, path))


@query
def access_stream(spark, sf_dir):
    """The log appended as a stream that stops half-way and goes on from its checkpoint."""
    path = files.scratch_dir(spark, "access-stream")
    log = tables.access_log(spark, sf_dir)
    late = F.col("timestamp") >= F.lit(datetime(2024, 1, 16))
    for part in (log.filter(~late), log.filter(late)):
        part.write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(schema.ACCESS_LOG).parquet(f"{path}/in")
        access_log_stream(stream, f"{path}/log", f"{path}/checkpoint").awaitTermination()
    return access.access_log_summary(files.scan_access_log(spark, f"{path}/log"))


@query
def admission_audit(spark, sf_dir):
    """Five requests a day per user."""
    return admission.admission_audit(
        tables.table(spark, sf_dir, "events").select("event_id", "user_id", "ts"),
        ["user_id"],
        "ts",
        window_seconds=86_400,
    )


@query
def admission_summary(spark, sf_dir):
    """Five requests in four hours per kind of event: few keys, each with many rows."""
    return admission.admission_summary(
        tables.table(spark, sf_dir, "events"), ["event_type"], "ts", window_seconds=14_400
    )


@query
def admission_minute(spark, sf_dir):
    """The default rule, five a minute, per user and endpoint."""
    return admission.admission_summary(
        tables.table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts"
    )


@query
def admission_segments(spark, sf_dir):
    """`admission_summary` with small segments: tables of their effects are composed over many."""
    log = tables.table(spark, sf_dir, "events")
    return admission.admission_summary(log, ["event_type"], "ts", window_seconds=14_400, segment_rows=200)


@query
def admission_stream(spark, sf_dir):
    """`admission_audit` as a stream over files of a week's events each, an hour's lateness."""
    path = files.scratch_dir(spark, "admission-stream")
    log = tables.table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    week = F.expr("date_diff(ts, date'2024-01-01') div 7")
    weeks = sorted(r[0] for r in log.select(week).distinct().collect())
    for number in weeks:
        log.filter(week == number).coalesce(1).write.mode("append").parquet(f"{path}/log")
    return admission_streaming.audit_files(
        spark,
        f"{path}/log",
        f"{path}/out",
        keys=["user_id"],
        ts="ts",
        window_seconds=86_400,
        batch_files=1,
        lateness_seconds=3600,
    )
