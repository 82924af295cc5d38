"""Files: bars, snapshots, listings, registry, access log and the jobs on them."""

import json
import os
import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from trendcloud import CloudParams, ichimoku_cloud, schema
from trendcloud.operators import access, catalog, registry, snapshots
from trendcloud.operators.bars import normalize_bars
from trendcloud.plans import jobs
from trendcloud.sources import files
from trendcloud.streaming.access import access_log_stream

BAR = (1.5, 2.5, 0.5, 2.0, 10)


def rows(df):
    return sorted(tuple(r) for r in df.select(*schema.BARS.names).collect())


def put(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def test_csv_files_named_by_ticker(spark, tmp_path):
    head = "Date,Open,High,Low,Close,Volume\n"
    put(f"{tmp_path}/data/AAA_2024_data.csv", head + "2024-01-02,1.5,2.5,0.5,2.0,10\nbad,1,,0.5,NaN,\n")
    put(f"{tmp_path}/data/BB_2024_data.csv", head + "2024-01-03 00:00:00-05:00,1,2,0,1,5\n")
    put(f"{tmp_path}/data/available_tickers.txt", "AAA\nBB\n")
    got = files.scan_bars(spark, f"{tmp_path}/data", glob="*_2024_data.csv")
    assert {tuple(r) for r in got.select(*schema.BARS.names).collect()} == {
        ("AAA", date(2024, 1, 2), 1.5, 2.5, 0.5, 2.0, 10),
        ("AAA", None, 1.0, None, 0.5, None, None),
        ("BB", date(2024, 1, 3), 1.0, 2.0, 0.0, 1.0, 5),
    }


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_written_bars_replace_only_their_tickers(spark, bars_of, tmp_path, fmt):
    path = str(tmp_path / "bars")
    files.write_bars(bars_of({"A": [BAR] * 3, "B": [BAR] * 2}), path, fmt)
    newer = bars_of({"B": [(9.0, 9.0, 9.0, 9.0, 9)]})
    files.write_bars(newer, path, fmt)
    expect = rows(bars_of({"A": [BAR] * 3})) + rows(newer)
    assert rows(files.scan_bars(spark, path, fmt)) == sorted(expect)


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_tickers_that_look_like_numbers(spark, bars_of, tmp_path, fmt):
    bars = bars_of({"007": [BAR], "7": [BAR] * 2})
    files.write_bars(bars, str(tmp_path / "bars"), fmt)
    assert rows(files.scan_bars(spark, str(tmp_path / "bars"), fmt)) == rows(bars)
    if fmt == "parquet":
        jobs.indicator_job(spark, str(tmp_path / "bars"), str(tmp_path / "out"))
        out = files.read_series(spark, str(tmp_path / "out"))
        assert {r.ticker for r in out.collect()} == {"007", "7"}
    files.snapshot_write(bars, str(tmp_path / "s"), date(2024, 5, 1))
    got = files.scan_snapshot_table(spark, str(tmp_path / "s"), date(2024, 5, 1))
    assert rows(got) == rows(bars)


def envelope(stamp, ticker, *bars):
    data = [dict(zip(schema.BAR_NAMES, b)) for b in bars]
    return json.dumps({"timestamp": stamp, "ticker": ticker, "data": data, "count": len(data)})


def test_snapshot_files(spark, tmp_path):
    bar = ("2024-03-01", 1.0, 2.0, 0.5, 1.5, 7)
    put(f"{tmp_path}/cache/A_2024-03-05.json", envelope("2024-03-05T09:00:00", "A", bar, bar))
    put(f"{tmp_path}/cache/B_2024-03-05.json", envelope("2024-03-04T23:59:59", "B", bar))
    put(f"{tmp_path}/cache/C_2024-03-04.json", envelope("2024-03-04T09:00:00", "C", bar))
    put(f"{tmp_path}/cache/D_latest.json", envelope("2024-03-05T09:00:00", "D", bar))
    put(f"{tmp_path}/cache/E_2024-03-05.json", envelope("2024-03-05T09:00:00", "E"))
    read = files.scan_snapshots(spark, f"{tmp_path}/cache")
    got = snapshots.snapshot_read(read, date(2024, 3, 5))
    assert rows(got) == [("A", date(2024, 3, 1), 1.0, 2.0, 0.5, 1.5, 7)] * 2


def test_snapshot_table_and_expiry(spark, bars_of, tmp_path):
    path = str(tmp_path / "snapshots")
    for day in (date(2024, 3, 1), date(2024, 3, 2), date(2024, 3, 8)):
        files.snapshot_write(bars_of({"A": [BAR], "B": [BAR]}), path, day)
    again = bars_of({"A": [(9.0, 9.0, 9.0, 9.0, 9)]})
    files.snapshot_write(again, path, date(2024, 3, 8))
    got = files.scan_snapshot_table(spark, path, date(2024, 3, 8))
    assert rows(got) == sorted(rows(again) + rows(bars_of({"B": [BAR]})))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cache_date" in plan

    now = datetime(2024, 3, 8, 12)
    only_a = spark.createDataFrame([("A",), ("other",)], "ticker string")
    assert files.snapshot_expire(spark, path, now, tickers=only_a) == ["2024-03-01"]
    assert files.snapshot_expire(spark, path, now, tickers=only_a) == []
    left = files.scan_snapshot_table(spark, path, date(2024, 3, 1))
    assert rows(left) == rows(bars_of({"B": [BAR]}))
    assert files.snapshot_expire(spark, path, datetime(2024, 3, 8)) == []
    assert files.snapshot_expire(spark, path, now) == ["2024-03-01"]
    assert files.snapshot_expire(spark, path, now, everything=True) == ["2024-03-02", "2024-03-08"]


def objects(spark, *keys):
    return spark.createDataFrame(
        [(k, 10, datetime(2024, 1, 1)) for k in keys], schema.OBJECTS
    )


def test_expiry_by_key(spark):
    listing = objects(
        spark,
        "cache/A_2024-03-02.json",
        "cache/A_2024-03-01.json",
        "cache/AB_2024-02-29.json",
        "cache/A_2024-3-1.json",
        "cache/A_latest.json",
        "cache/A_2024-02-30.json",
        "data/A_2020-01-01.json",
    )
    noon = datetime(2024, 3, 8, 12)

    def keys(df):
        return {r.key.removeprefix("cache/") for r in df.collect()}

    gone = {"A_2024-03-01.json", "AB_2024-02-29.json", "A_2024-3-1.json"}
    assert keys(snapshots.snapshot_expired(listing, noon)) == gone
    assert keys(snapshots.snapshot_expired(listing, noon, ticker="A")) == gone - {"AB_2024-02-29.json"}
    assert keys(snapshots.snapshot_expired(listing, datetime(2024, 3, 8))) == {"AB_2024-02-29.json"}
    live = {"A_2024-03-02.json", "A_latest.json", "A_2024-02-30.json"}
    assert keys(snapshots.snapshot_live(listing, noon)) == live
    assert keys(snapshots.snapshot_all(listing)) == gone | live


def test_listing(spark, tmp_path):
    put(f"{tmp_path}/store/data/AAA_2024_data.csv", "x" * 12)
    put(f"{tmp_path}/store/data/BB_2023_data.csv", "x")
    put(f"{tmp_path}/store/data/available_tickers.txt", "AAA")
    put(f"{tmp_path}/store/cache/AAA_2024-01-01.json", "x" * 100)
    put(f"{tmp_path}/store/cache/AAA_2024-01-02.json", "x" * 50)
    put(f"{tmp_path}/store/cache/BB_2024-01-02.json", "x" * (2 * 1024 * 1024))
    listing = files.scan_objects(spark, f"{tmp_path}/store").cache()
    assert listing.count() == 6
    assert catalog.catalog_listing(listing).count() == 2
    found = catalog.catalog_listing(listing, "_2024_data.csv").collect()
    assert [(r.ticker, r.key, r["size"]) for r in found] == [("AAA", "data/AAA_2024_data.csv", 12)]
    assert tuple(catalog.cache_status(listing).first()) == (3, 2 * 1024 * 1024 + 150, 2.0)
    per_ticker = catalog.cache_status_by_ticker(listing).collect()
    assert {(r.ticker, r.files) for r in per_ticker} == {("AAA", 2), ("BB", 1)}
    assert tuple(catalog.store_metrics(listing).first()) == (3, 3)


def test_tasks_list_many_files_in_folders_of_any_depth(spark, tmp_path, monkeypatch):
    """A hundred thousand files, unevenly dealt over folders; the driver lists none of them."""
    monkeypatch.setattr(files, "_scan_objects_by_reader", None)
    expect = 0
    for folder, n in (("a", 60_000), ("b/c", 25_000), ("b/c/d/e/f", 15_000), (".", 7)):
        os.makedirs(f"{tmp_path}/store/{folder}", exist_ok=True)
        for i in range(n):
            os.close(os.open(f"{tmp_path}/store/{folder}/{i}", os.O_CREAT | os.O_WRONLY))
        expect += n
    for hidden in ("_x", ".y", "b/_z/1", "b/c/d/.w/2"):
        put(f"{tmp_path}/store/{hidden}", "x")
    listing = files.scan_objects(spark, f"file:{tmp_path}/store").cache()
    assert listing.count() == listing.distinct().count() == expect
    per = listing.groupBy(F.regexp_extract("key", "^(.*)/", 1)).count().collect()
    assert {tuple(r) for r in per} == {("a", 60_000), ("b/c", 25_000), ("b/c/d/e/f", 15_000), ("", 7)}
    os.makedirs(f"{tmp_path}/none")
    assert files.scan_objects(spark, f"{tmp_path}/none").count() == 0


def test_empty_store(spark):
    empty = objects(spark)
    assert tuple(catalog.cache_status(empty).first()) == (0, 0, 0.0)
    assert tuple(catalog.store_metrics(empty).first()) == (0, 0)


def test_registry_rewrites_itself(spark, tmp_path):
    path = str(tmp_path / "registry")
    first = spark.createDataFrame([("B",), ("A",)], "ticker string")
    files.registry_write(first, path)
    listed = registry.registry_list(files.scan_registry(spark, path))
    new = spark.createDataFrame([("C",), ("A",)], "ticker string")
    files.registry_write(registry.registry_merge(listed, new)[0], path)
    again = registry.registry_list(files.scan_registry(spark, path))
    assert [r.ticker for r in again.collect()] == ["A", "B", "C"]


def test_access_log(spark, tmp_path):
    path = str(tmp_path / "log")
    attempts = spark.createDataFrame(
        [(datetime(2024, 1, 1, h), "A", "10.0.0.1", ok) for h, ok in ((1, True), (2, False), (3, None))],
        "at timestamp, name string, ip string, ok boolean",
    )
    log = access.access_records(attempts, attempts.at, attempts.name, attempts.ip, attempts.ok)
    files.access_log_append(log, path)
    files.access_log_append(log, path)
    got = access.access_log_summary(files.scan_access_log(spark, path)).first()
    assert tuple(got) == ("A", "data_access", 6, 4, 2, datetime(2024, 1, 1, 1), datetime(2024, 1, 1, 3))


def test_access_log_stream(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "log")
    rows = [(datetime(2024, 1, 1, h), "A", "10.0.0.1", True, "data_access") for h in range(4)]
    log = spark.createDataFrame(rows, schema.ACCESS_LOG)
    log.write.parquet(source)
    for _ in range(2):
        stream = spark.readStream.schema(schema.ACCESS_LOG).parquet(source)
        access_log_stream(stream, path, str(tmp_path / "checkpoint")).awaitTermination()
    assert files.scan_access_log(spark, path).exceptAll(log).count() == 0
    assert files.scan_access_log(spark, path).count() == 4


LANDING = "ticker string, Date string, Open double, High double, Low double, Close double, Volume bigint"


def test_collect(spark, tmp_path):
    path = str(tmp_path / "bars")
    landing = spark.createDataFrame(
        [
            (" a\n", "2024-01-01", *BAR),
            (" a\n", "2024-12-30T00:00:00-05:00", *BAR),
            (" a\n", "2024-12-31", *BAR),
            (" a\n", "broken", *BAR),
            ("b", "2024-06-01", *BAR),
            ("c", "2024-06-01", *BAR),
            ("old", "2023-06-01", *BAR),
            ("test", "2024-06-01", *BAR),
            ("big", "2024-06-01", *BAR),
            ("big", "2024-06-02", *BAR),
            ("big", "2024-06-03", *BAR),
        ],
        LANDING,
    )
    put(f"{tmp_path}/registry/part", "B\nZ\n")
    files.write_bars(normalize_bars(landing.filter("ticker = 'b'")).withColumn("ticker", F.lit("C")), path)
    limits = {"start": "2024-01-01", "end": "2024-12-31", "max_tickers": 3, "max_bytes": 32 + 2 * 30}
    done = jobs.collect_ingest(landing, path, f"{tmp_path}/registry", **limits)
    assert {tuple(r) for r in done.report.collect()} == {
        ("A", "stored", 2, False),
        ("B", "stored", 1, False),
        ("C", "registry_full", 1, True),
        ("OLD", "no_data", 0, False),
        ("BIG", "too_large", 3, False),
    }
    assert [tuple(r) for r in done.invalid.collect()] == [("test", "Ticker 'TEST' is not allowed")]
    assert sorted(r.ticker for r in done.registry.collect()) == ["A", "B", "Z"]
    assert sorted(r.value for r in files.scan_registry(spark, f"{tmp_path}/registry").collect()) == ["A", "B", "Z"]
    stored = files.scan_bars(spark, path, "parquet")
    assert sorted((r.ticker, r.time) for r in stored.collect()) == [
        ("A", date(2024, 1, 1)),
        ("A", date(2024, 12, 30)),
        ("B", date(2024, 6, 1)),
        ("C", date(2024, 6, 1)),
    ]


def test_collect_has_no_limits_of_its_own(spark, tmp_path):
    """A series of more than 1 MiB, more than a hundred tickers, and years apart: all of it is stored."""
    day = F.date_add(F.lit(date(1900, 1, 1)), F.col("id").cast("int"))
    long = spark.range(40_000).select(F.lit("big").alias("ticker"), day.cast("string").alias("Date"))
    many = spark.range(300).select(F.concat(F.lit("t"), "id").alias("ticker"), F.lit("2031-05-05").alias("Date"))
    landing = long.unionByName(many).selectExpr(
        "ticker", "Date", "1.5D Open", "2.5D High", "0.5D Low", "2.0D Close", "10L Volume"
    )
    path = str(tmp_path / "bars")
    report = jobs.collect_ingest(landing, path, str(tmp_path / "registry")).report.collect()
    assert len(report) == 301 and {r.status for r in report} == {"stored"}
    assert files.scan_bars(spark, path, "parquet").count() == 40_300
    assert files.scan_registry(spark, str(tmp_path / "registry")).count() == 301
    again = jobs.collect_ingest(landing, path, str(tmp_path / "registry")).report.collect()
    assert all(r.data_existed for r in again)
    assert files.scan_bars(spark, path, "parquet").count() == 40_300


def test_indicator_job(spark, bars_of, tmp_path):
    bars = bars_of({"A": [BAR] * 30, "B": [BAR] * 4})
    files.write_bars(bars, str(tmp_path / "bars"))
    params = CloudParams(2, 3, 1, 4, 2)
    jobs.indicator_job(spark, str(tmp_path / "bars"), str(tmp_path / "out"), params)
    stored = spark.read.parquet(str(tmp_path / "out"))
    expect = ichimoku_cloud(bars, params)
    got = stored.select(*expect.columns)
    assert got.exceptAll(expect).count() == 0 and got.count() == expect.count()


def test_refreshed_snapshot(spark, bars_of, tmp_path):
    """Expired snapshots of the tickers that were delivered go, whatever signs their names hold."""
    path = str(tmp_path / "s")
    for day in (date(2024, 5, 1), date(2024, 5, 20), date(2024, 6, 25)):
        files.snapshot_write(bars_of({"Brand#12": [BAR], "B": [BAR]}), path, day)
    fresh = bars_of({"Brand#12": [BAR] * 2})
    assert jobs.refresh_snapshot(fresh, path, datetime(2024, 7, 1, 12)) == ["2024-05-01", "2024-05-20"]
    got = files.scan_snapshot_table(spark, path).groupBy("cache_date", "ticker").count().collect()
    assert {tuple(r) for r in got} == {
        (date(2024, 5, 1), "B", 1),
        (date(2024, 5, 20), "B", 1),
        (date(2024, 6, 25), "B", 1),
        (date(2024, 6, 25), "Brand#12", 1),
        (date(2024, 7, 1), "Brand#12", 2),
    }
    assert jobs.refresh_snapshot(bars_of({}), path, datetime(2025, 1, 1)) == []
    assert files.scan_snapshot_table(spark, path).count() == 6


def test_many_tickers_make_few_folders_and_files(spark, tmp_path):
    bars = spark.range(20_000).selectExpr(
        "concat('T', id) ticker", "date'2024-01-01' time", "1D open", "1D high", "1D low", "1D close", "1L volume"
    )
    path = str(tmp_path / "bars")
    files.write_bars(bars, path, buckets=8)
    assert len(os.listdir(path)) <= 8 + 2 and files.scan_bars(spark, path, "parquet").count() == 20_000
    with pytest.raises(ValueError, match="buckets"):
        files.write_bars(bars, path, buckets=16)


def test_corrupt_lines_are_told_from_blanks(spark, tmp_path):
    head = "time,open,high,low,close,volume\n"
    put(f"{tmp_path}/d/A_x.csv", head + "2024-01-02,1,2,0,1,5\n2024-01-03,,,,,\n2024-01-04,what,2,0,1,5\n")
    got = files.scan_bars(spark, f"{tmp_path}/d", glob="*.csv", corrupt="line").collect()
    assert {(r.time.day, r.open, r.line) for r in got} == {
        (2, 1.0, None), (3, None, None), (4, None, "2024-01-04,what,2,0,1,5"),
    }


def test_export_names_files_by_value(spark, bars_of, tmp_path):
    files.export_named(bars_of({"A#1": [BAR] * 2, "B": [BAR]}), str(tmp_path), "ticker", "csv", "_x.csv")
    assert sorted(f for f in os.listdir(tmp_path) if not f.startswith(".")) == ["A#1_x.csv", "B_x.csv"]


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda *_: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        files.scratch_dir(Session(), "x")
    Context.master = "local[4]"
    assert files.scratch_dir(Session(), "x")


def test_scratch_is_in_the_shared_folder(spark):
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is not None:
        assert files.scratch_dir(spark, "x").startswith(shared)
    assert files.scratch_dir(spark, "x") != files.scratch_dir(spark, "x")


def test_cascade_of_tables_reads_names_once_and_rows_once(spark):
    """Seven scans: the names of three sources, and the rows of four."""
    from trendcloud.plans.queries import QUERIES

    out = QUERIES["source_cascade_rows"](spark, "/root/testdata/sf0.001")
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Scan parquet") <= 7
    assert "BroadcastNestedLoop" not in plan and "Cartesian" not in plan


def opened(df):
    """Bucket folders of the files that a read opens."""
    return {part for f in df.inputFiles() for part in f.split("/") if part.startswith("bucket=")}


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_point_reads_open_the_buckets_of_their_tickers(spark, bars_of, tmp_path, fmt):
    path = str(tmp_path / "bars")
    files.write_bars(bars_of({f"T{i}": [BAR] * 2 for i in range(300)} | {None: [BAR]}), path, fmt)
    names = lambda df: {r["ticker"] for r in df.collect()}
    one = files.scan_bars(spark, path, fmt, tickers=["T7"])
    assert names(one) == {"T7"} and one.count() == 2 and len(opened(one)) == 1
    assert names(files.scan_bars(spark, path, fmt, tickers=["T7", None, "T9"])) == {"T7", None, "T9"}
    none = files.scan_bars(spark, path, fmt, tickers=["absent"])
    assert none.count() == 0 and len(opened(none)) <= 1
    assert files.scan_bars(spark, path, fmt, tickers=[]).count() == 0
    assert len(opened(files.scan_bars(spark, path, fmt))) > 50


def test_point_reads_of_a_day(spark, bars_of, tmp_path):
    path, day = str(tmp_path / "s"), date(2024, 3, 1)
    files.snapshot_write(bars_of({f"T{i}": [BAR] for i in range(100)} | {None: [BAR]}), path, day)
    one = files.scan_snapshot_table(spark, path, day, tickers=["T5", None])
    assert {r["ticker"] for r in one.collect()} == {"T5", None} and 1 <= len(opened(one)) <= 2
    assert one.columns == schema.BARS.names


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_presence_index_follows_the_table(spark, bars_of, tmp_path, fmt):
    path = str(tmp_path / "bars")
    files.write_bars(bars_of({"A": [BAR], "B": [BAR] * 3, None: [BAR]}), path, fmt)
    files.write_bars(bars_of({"B": [BAR], "C": [BAR]}), path, fmt)
    got = [r["ticker"] for r in files.present_tickers(spark, path).collect()]
    assert sorted(got, key=str) == ["A", "B", "C", None]
    assert files.scan_bars(spark, path, fmt).count() == 4  # the index is no part of the table
    assert files.present_tickers(spark, str(tmp_path / "no")).count() == 0


def test_later_sources_open_only_what_they_serve(spark, bars_of, tmp_path):
    from trendcloud.operators import cascade

    day = date(2024, 3, 1)
    first, second, third = (str(tmp_path / n) for n in ("first", "second", "third"))
    files.snapshot_write(bars_of({"A": [BAR], None: [BAR]}), first, day)
    files.write_bars(bars_of({"A": [BAR] * 2, "B": [BAR] * 2, "L": [BAR]}), second)
    files.write_bars(bars_of({"A": [BAR] * 3, "L": [BAR] * 3}), third)
    sources = [
        cascade.StoredSource.of_day("s3_cache", first, day),
        cascade.StoredSource("s3_csv", second),
        cascade.StoredSource("local_csv", third, "L"),
    ]
    got = cascade.resolve_stored(spark, sources, bars_of({"A": [BAR] * 4, "P": [BAR] * 4, None: [BAR] * 4}))
    counts = got.groupBy("ticker", "source", "label").count().collect()
    assert {tuple(r) for r in counts} == {
        ("A", "s3_cache", "AWS S3 cache", 1), (None, "s3_cache", "AWS S3 cache", 1), ("B", "s3_csv", "AWS S3 CSV", 2),
        ("L", "s3_csv", "AWS S3 CSV", 1), ("P", "yahoo_finance", "Yahoo Finance", 4),
    }
    read = got.inputFiles()
    assert not any(third in f for f in read), "all its tickers are served earlier"
    assert len({f for f in read if second in f}) <= 2, "only the buckets of B and L"
    assert cascade.resolve_stored(spark, sources[2:]).count() == 3
    with pytest.raises(ValueError):
        cascade.resolve_stored(spark, [cascade.StoredSource("s3_csv", str(tmp_path / "no"))])


def stamps(path):
    return {f: os.stat(f).st_mtime_ns for f in (str(p) for p in path.rglob("*.parquet")) if "_gone" not in f}


def test_a_refresh_writes_marks_and_compaction_writes_files(spark, bars_of, tmp_path):
    path = tmp_path / "s"
    old, kept, today = date(2024, 5, 1), date(2024, 6, 28), datetime(2024, 7, 1, 12)
    many = {f"T{i}": [BAR] for i in range(40)} | {None: [BAR]}
    for day in (old, kept):
        files.snapshot_write(bars_of(many), str(path), day)
    before = stamps(path)
    assert jobs.refresh_snapshot(bars_of({"T1": [BAR] * 2, None: [BAR]}), str(path), today) == ["2024-05-01"]
    assert {f: t for f, t in stamps(path).items() if f in before} == before, "no earlier file is touched"
    left = lambda day: {r["ticker"] for r in files.scan_snapshot_table(spark, str(path), day).collect()}
    assert left(old) == many.keys() - {"T1", None} and left(kept) == many.keys()
    whole = files.scan_snapshot_table(spark, str(path)).groupBy("cache_date").count().collect()
    assert {tuple(r) for r in whole} == {(old, 39), (kept, 41), (date(2024, 7, 1), 3)}
    assert files.scan_snapshot_table(spark, str(path), old, tickers=["T1", "T2"]).count() == 1
    # What is written again on an old day is there again, and other marks stay.
    files.snapshot_write(bars_of({"T1": [BAR]}), str(path), old)
    assert left(old) == many.keys() - {None}
    jobs.refresh_snapshot(bars_of({"T3": [BAR]}), str(path), today)
    before = stamps(path)
    assert files.compact_snapshots(spark, str(path)) == ["2024-05-01"]
    changed = {f.split("/")[-2] for f, t in stamps(path).items() if before.get(f) != t and "_presence" not in f}
    assert left(old) == many.keys() - {None, "T3"} and len(changed) <= 2
    assert files.gone_tickers(spark, str(path)) is None or files.gone_tickers(spark, str(path)).count() == 0
    assert files.compact_snapshots(spark, str(path)) == []
    # A day whose last ticker goes, goes.
    files.snapshot_write(bars_of({"Z": [BAR]}), str(path), date(2024, 5, 2))
    jobs.refresh_snapshot(bars_of({"Z": [BAR]}), str(path), today)
    assert files.compact_snapshots(spark, str(path)) == ["2024-05-02"]
    assert not (path / "cache_date=2024-05-02").exists()


@pytest.mark.parametrize("params", [CloudParams(2, 3, 1, 4, 2), CloudParams(3, 5, 7, 9, 6)])
def test_an_updated_indicator_equals_one_made_anew(spark, bars_of, tmp_path, params):
    """Bars behind the last ones, between them, in place of one, of new series and of short ones."""
    rng = random.Random(8)
    bar = lambda: (1.0, rng.random() + 1, rng.random(), rng.random(), 1)
    bars, out = str(tmp_path / "bars"), str(tmp_path / "out")
    first = bars_of({"A": [bar() for _ in range(60)], "B": [bar() for _ in range(4)], "C": [bar() for _ in range(50)]})
    files.write_bars(first, bars)
    jobs.indicator_job(spark, bars, out, params)
    untouched = {f: t for f, t in stamps(tmp_path / "out").items()}
    steps = [
        bars_of({"A": [bar()]}, start=date(2024, 3, 1)),
        bars_of({"A": [bar(), bar()], "B": [bar()], "D": [bar()]}, start=date(2024, 3, 2)),
        bars_of({"A": [bar()], "B": [bar()]}, start=date(2024, 1, 3)),
        bars_of({"A": [bar()]}, start=date(2023, 1, 1)),
    ]
    for step, new in enumerate(steps):
        jobs.indicator_update(spark, new, bars, out, params)
        expect = ichimoku_cloud(files.read_series(spark, bars), params)
        got = files.read_series(spark, out).select(*expect.columns)
        assert got.count() == expect.count(), step
        assert got.exceptAll(expect).count() == 0, step
    c = files.bucket_names(spark, out, ["C"])
    if not c & files.bucket_names(spark, out, ["A", "B", "D"]):
        same = {f for f, t in stamps(tmp_path / "out").items() if untouched.get(f) == t}
        assert any(f"bucket={next(iter(c))}" in f for f in same), "other buckets are not written"
    jobs.indicator_update(spark, bars_of({}), bars, out, params)
    assert files.read_series(spark, out).count() == expect.count()
