"""Readers and writers for bars, snapshots, object listings, registry and access log.

Paths may be any file system Spark reads.
"""

from __future__ import annotations

import re
import sys
import tempfile
import uuid
from collections.abc import Collection, Iterator
from datetime import date, datetime, time, timedelta

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendcloud import schema
from trendcloud.functions.columns import parse_day
from trendcloud.operators.bars import normalize_bars
from trendcloud.operators.catalog import base_name, key_ticker
from trendcloud.operators.snapshots import RETENTION_DAYS

#: Folders of a stored table (of each day, for snapshots).
BUCKETS = 64
#: Beside the folders of a stored table: which tickers each of them has.
PRESENCE = "_presence"
#: Beside the days of a snapshot table: which tickers are gone from which of them.
GONE = "_gone"

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the one the cluster names in `spark.checkpoint.dir`. Only in local mode,
    where there is one machine, may it be missing; a new local folder serves then.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared:
        return shared.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="trendcloud-")


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one."""
    return f"{shared_dir(spark)}/trendcloud/{name}-{uuid.uuid4().hex}"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's checkpoint folder; set one only where there is none (local mode)."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def _bucket(buckets: int) -> Column:
    """The folder of a ticker: tables have as many as there are buckets, whatever the tickers."""
    number = F.pmod(F.xxhash64(F.coalesce("ticker", F.lit("\x00"))), F.lit(buckets))
    return F.format_string(f"%05d-of-{buckets}", number)


def _folders(spark: SparkSession, path: str, name: str) -> dict[str, str]:
    """Values of the folders `name=value` below `path`, with the folders' paths."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return {}
    unescape = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    found = (status.getPath() for status in fs.listStatus(root) if status.isDirectory())
    pairs = ((f, f.getName().partition("=")) for f in found)
    return {unescape(value): f.toString() for f, (key, sep, value) in pairs if sep and key == name}


def exists(spark: SparkSession, path: str) -> bool:
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root)


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _load(spark: SparkSession, fmt: str, paths: list[str], base: str, kind: T.StructType | None = None) -> DataFrame:
    reader = spark.read.format(fmt).option("basePath", base).option("header", fmt == "csv")
    return (reader.schema(kind) if kind is not None else reader).load(paths)


# Readers


def bucket_names(spark: SparkSession, path: str, tickers: Collection[str | None]) -> set[str]:
    """The buckets of a stored table that hold these tickers, if it has them."""
    held = _folders(spark, path, "bucket")
    if not held:
        return set()
    buckets = int(next(iter(held)).rpartition("-")[2])
    asked = spark.createDataFrame([(t,) for t in set(tickers)], "ticker string")
    names = asked.select(_bucket(buckets).alias("bucket")).distinct().collect()
    return held.keys() & {r["bucket"] for r in names}


def read_series(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    tickers: Collection[str | None] | None = None,
    buckets: Collection[str] | None = None,
) -> DataFrame:
    """A table written by `write_bars`, all its columns; of one in CSV those of a bar.

    With `tickers` (a few names; None for rows without one) only their rows, and only
    the folders that can hold them are listed and opened; with `buckets` those folders.
    """
    if fmt == "csv":
        return scan_bars(spark, path, fmt, tickers=tickers, buckets=buckets)
    rows, found = _wanted(spark, path, fmt, tickers, buckets)
    return rows.filter(found).drop("bucket")


def _wanted(spark, path, fmt, tickers, buckets, kind=None) -> tuple[DataFrame, Column]:
    """The rows of the folders that can hold what is asked for, and which of them are."""
    if tickers is None and buckets is None:
        return _load(spark, fmt, [path], path, kind), F.lit(True)
    named = F.lit(True)
    if tickers is not None:
        names = [t for t in tickers if t is not None]
        named = F.coalesce(F.col("ticker").isin(names), F.lit(False)) if names else F.lit(False)
        named = named | F.col("ticker").isNull() if None in tickers else named
        inside = bucket_names(spark, path, tickers)
        buckets = inside if buckets is None else inside & set(buckets)
    held = _folders(spark, path, "bucket")
    paths = sorted(held[b] for b in buckets if b in held)
    if not paths:
        return _load(spark, fmt, [path], path, kind), F.lit(False)
    return _load(spark, fmt, paths, path, kind), named


def present_tickers(spark: SparkSession, path: str) -> DataFrame:
    """(ticker, bucket) of the series that a table of `write_bars`, or a day's snapshot, holds.

    One small file per bucket, kept up by the writers; the table itself is not opened.
    """
    kind = T.StructType([T.StructField("ticker", T.StringType()), T.StructField("bucket", T.StringType())])
    index = f"{path.rstrip('/')}/{PRESENCE}"
    if not exists(spark, index):
        return spark.createDataFrame([], kind)
    return spark.read.schema(kind).parquet(index)


def scan_bars(
    spark: SparkSession,
    path: str,
    fmt: str = "csv",
    glob: str | None = None,
    corrupt: str | None = None,
    tickers: Collection[str | None] | None = None,
    buckets: Collection[str] | None = None,
) -> DataFrame:
    """Bars of every file below `path`; of a table with `tickers` or `buckets` as in `read_series`.

    The files are those of `write_bars`, or with `glob` CSV files in any folders,
    named by ticker (`AAPL_2024_data.csv`). Lines that cannot be read as a bar keep
    what could be read; with `corrupt` a column of that name holds such lines.
    """
    if fmt != "csv":
        return normalize_bars(read_series(spark, path, fmt, tickers, buckets), schema.BAR_NAMES)
    lines = T.StructField(corrupt, T.StringType()) if corrupt else None
    fields = [*schema.RAW_BAR.fields, *([] if glob else [T.StructField("ticker", T.StringType())])]
    declared = T.StructType([*fields, *([lines] if lines else [])])
    reader = spark.read.schema(declared).option("header", True).option("mode", "PERMISSIVE")
    if corrupt:
        reader = reader.option("columnNameOfCorruptRecord", corrupt)
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob).option("recursiveFileLookup", True)
    raw = reader.csv(path) if tickers is None and buckets is None else None
    if raw is None:
        wanted, found = _wanted(spark, path, fmt, tickers, buckets, declared)
        raw = wanted.filter(found).drop("bucket")
    if glob is not None:
        raw = raw.withColumn("ticker", key_ticker(F.col("_metadata.file_name")))
    bars = normalize_bars(raw, schema.BAR_NAMES, further=[corrupt] if corrupt else [])
    return bars


def scan_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """JSON snapshot files (one object per file) with the date of their names."""
    name = base_name(F.col("_metadata.file_path"))
    read = (
        spark.read.schema(schema.SNAPSHOT)
        .option("multiLine", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.json")
        .json(path)
    )
    stamp = F.regexp_extract(name, r"_([^_]*)\.json$", 1)
    return read.withColumn("cache_date", parse_day(stamp))


def scan_snapshot_table(
    spark: SparkSession, path: str, as_of: date | None = None, tickers: Collection[str | None] | None = None
) -> DataFrame:
    """Bars of one day of a table of `snapshot_write`, or of all days with their `cache_date`.

    Of one day only its folder is listed and read, and of some `tickers` only the
    folders in it that can hold them. Tickers that have expired from a day are left out.
    """
    columns = schema.BARS.names if as_of is not None else [*schema.BARS.names, "cache_date"]
    if as_of is not None and tickers is not None:
        rows, found = _wanted(spark, _day_folder(path, as_of), "parquet", tickers, None, schema.BARS)
        rows = rows.filter(found).withColumn("cache_date", F.lit(as_of))
    else:
        days = T.StructField("cache_date", T.DateType())
        rows = spark.read.schema(T.StructType([*schema.BARS.fields, days])).parquet(path)
        if as_of is not None:
            rows = rows.filter(F.col("cache_date") == F.lit(as_of))
        if tickers is not None:
            names = [t for t in tickers if t is not None]
            rows = rows.filter(F.col("ticker").isin(names) | (F.col("ticker").isNull() & F.lit(None in tickers)))
    return _without_gone(rows, gone_tickers(spark, path, as_of)).select(*columns)


def _day_folder(path: str, day: date) -> str:
    return f"{path.rstrip('/')}/cache_date={day.isoformat()}"


def gone_tickers(spark: SparkSession, path: str, day: date | None = None) -> DataFrame | None:
    """(ticker, cache_date, bucket) of series that have expired but lie in the files yet; None if none has."""
    root = f"{path.rstrip('/')}/{GONE}"
    folder = root if day is None else f"{root}/cache_date={day.isoformat()}"
    if not exists(spark, folder):
        return None
    fields = [T.StructField(c, T.StringType()) for c in ("ticker", "bucket")]
    kind = T.StructType([*fields, T.StructField("cache_date", T.DateType())])
    return _load(spark, "parquet", [folder], root, kind)


def _without_gone(rows: DataFrame, gone: DataFrame | None) -> DataFrame:
    if gone is None:
        return rows
    # A text stands for a missing ticker, so that this is a plain join.
    name = lambda: F.coalesce(F.col("ticker"), F.lit("\x00")).alias("_name")
    marks = gone.select(name(), F.col("cache_date").alias("_day")).distinct()
    keyed = rows.withColumns({"_name": name(), "_day": F.col("cache_date")})
    return keyed.join(marks, ["_name", "_day"], "left_anti").drop("_name", "_day")


def _arrow_folder(path: str) -> tuple[arrow_fs.FileSystem, str] | None:
    try:
        return arrow_fs.FileSystem.from_uri(path) if ":/" in path else (arrow_fs.LocalFileSystem(), path)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return None


#: Folder levels that are listed one by one, each level spread over tasks, before the rest below.
LISTED_LEVELS = 2


def scan_objects(spark: SparkSession, path: str, levels: int = LISTED_LEVELS) -> DataFrame:
    """The files below `path` as `key, size, last_modified`; contents are not read.

    Tasks do the listing: one lists the folder itself, and the folders found are
    dealt to tasks that list them, `levels` times; what lies deeper is listed by the
    task that has the folder above. Names that begin with `_` or `.` are passed over,
    as by Spark's readers. File systems that only Spark can open are listed by its
    own reader on the driver.
    """
    if _arrow_folder(path) is None:
        return _scan_objects_by_reader(spark, path)
    kind = "key string, size bigint, last_modified timestamp, folder string"

    def lister(deep: bool):
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for folder in batch.column(0).to_pylist():
                    yield from _listed(path, folder, deep)

        return each

    folders = spark.range(1).select(F.lit("").alias("folder"))
    found = []
    for level in range(levels + 1):
        spread = folders if level == 0 else folders.repartition(F.col("folder"))
        listed = spread.mapInArrow(lister(level == levels), kind)
        if level < levels:
            ensure_checkpoint_dir(spark)
            listed = listed.checkpoint()
        found.append(listed.filter("folder is null").drop("folder"))
        folders = listed.filter("folder is not null").select("folder")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _listed(path: str, folder: str, deep: bool) -> Iterator[pa.RecordBatch]:
    """A folder's files with their keys and, unless all below is listed, its folders."""
    files, root = _arrow_folder(path)
    root = root.rstrip("/")
    place = f"{root}/{folder}" if folder else root
    infos = files.get_file_info(arrow_fs.FileSelector(place, recursive=deep))
    keys, sizes, times, folders = [], [], [], []
    for info in infos:
        key = info.path[len(root) + 1 :]
        if any(part[0] in "_." for part in key.split("/")):
            continue
        is_file = info.type == arrow_fs.FileType.File
        if not is_file and deep:
            continue
        keys.append(key if is_file else None)
        sizes.append(info.size if is_file else None)
        times.append(info.mtime if is_file else None)
        folders.append(None if is_file else key)
    kinds = (pa.string(), pa.int64(), pa.timestamp("us", tz="UTC"), pa.string())
    columns = [pa.array(x, k) for x, k in zip((keys, sizes, times, folders), kinds, strict=True)]
    whole = pa.RecordBatch.from_arrays(columns, names=["key", "size", "last_modified", "folder"])
    for at in range(0, whole.num_rows, 10_000):
        yield whole.slice(at, 10_000)


def _scan_objects_by_reader(spark: SparkSession, path: str) -> DataFrame:
    root = path.rstrip("/") + "/"
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(path)
        .select("path", "length", "modificationTime")
    )
    plain = F.regexp_replace("path", r"^[a-z0-9]+:/+", "/")
    prefix = F.regexp_replace(F.lit(root), r"^[a-z0-9]+:/+", "/")
    return files.select(
        F.substring(plain, F.length(prefix) + 1, F.length(plain)).alias("key"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("last_modified"),
    )


def scan_registry(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def scan_access_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.ACCESS_LOG).parquet(path)


# Writers


def _replace(df: DataFrame, path: str, fmt: str, buckets: int, day: date | None) -> None:
    """Write the rows by bucket; rows of other tickers in the same buckets stay.

    A bucket is written as a whole: what stays in it is read first, and only from
    the buckets that the new tickers lie in; what has expired from them goes for
    good. Rows of a bucket are brought together for few files, and adaptive execution
    still splits one that is too big.
    """
    spark = df.sparkSession
    folder = path if day is None else _day_folder(path, day)
    held = _folders(spark, folder, "bucket")
    if any(not name.endswith(f"-of-{buckets}") for name in held):
        raise ValueError(f"{folder} has another number of buckets")
    out = df.withColumn("bucket", _bucket(buckets))
    gone = gone_tickers(spark, path, day) if day is not None else None
    touched = None
    if held:
        ensure_checkpoint_dir(spark)
        names = out.select("ticker", "bucket").distinct().checkpoint()
        touched = [r["bucket"] for r in names.select("bucket").distinct().collect()]  # at most `buckets`
        kind = T.StructType([*df.schema.fields, T.StructField("bucket", T.StringType())])
        paths = [held[b] for b in touched if b in held]
        if paths:
            stays = _load(spark, fmt, paths, folder, kind)
            new = names.select(F.col("ticker").alias("_new"))
            stays = stays.join(new, F.col("ticker").eqNullSafe(F.col("_new")), "left_anti")
            if gone is not None:
                stays = _without_gone(stays.withColumn("cache_date", F.lit(day)), gone).drop("cache_date")
            out = out.unionByName(stays)
    _write_buckets(out, folder, fmt)
    _index_buckets(spark, folder, fmt, touched)
    if gone is not None and touched is not None:
        _keep_marks(spark, path, day, gone.filter(~F.col("bucket").isin(touched)))


def _write_buckets(out: DataFrame, folder: str, fmt: str) -> None:
    keys = ["bucket", "ticker"] + [c for c in ("time",) if c in out.columns]
    writer = out.hint("rebalance", "bucket").sortWithinPartitions(*keys).write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.option("partitionOverwriteMode", "dynamic").partitionBy("bucket").save(folder)


def _index_buckets(spark: SparkSession, folder: str, fmt: str, touched: Collection[str] | None) -> None:
    """Write the tickers of the `touched` buckets (of all, without) to the presence index, from their files."""
    held = _folders(spark, folder, "bucket")
    paths = [f for b, f in held.items() if touched is None or b in touched]
    if not paths:
        return
    if fmt == "csv":  # by place: a file has the columns that its table has
        names = _load(spark, fmt, paths, folder).select(F.col("ticker").cast("string"), "bucket")
    else:
        kind = T.StructType([T.StructField(c, T.StringType()) for c in ("ticker", "bucket")])
        names = _load(spark, fmt, paths, folder, kind)
    writer = names.distinct().repartition("bucket").sortWithinPartitions("bucket", "ticker").write.mode("overwrite")
    writer.option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{folder.rstrip('/')}/{PRESENCE}")


def _keep_marks(spark: SparkSession, path: str, day: date, marks: DataFrame) -> None:
    """Leave only these marks of a day's expired tickers."""
    ensure_checkpoint_dir(spark)
    marks = marks.select("ticker", "bucket").checkpoint()
    folder = f"{path.rstrip('/')}/{GONE}/cache_date={day.isoformat()}"
    if marks.limit(1).count():
        marks.write.mode("overwrite").parquet(folder)
    else:
        _delete(spark, folder)


def write_bars(df: DataFrame, path: str, fmt: str = "parquet", buckets: int = BUCKETS) -> None:
    """Write series, replacing those of the same tickers and leaving the others.

    Tickers share a fixed number of folders, and inside files rows are sorted by
    ticker, so millions of tickers make no more files than a few.
    """
    _replace(df.select(*[c for c in df.columns if c != "ticker"], "ticker"), path, fmt, buckets, None)


def snapshot_write(df: DataFrame, path: str, as_of: date, buckets: int = BUCKETS) -> None:
    """Write series as the snapshots of the day `as_of`, replacing that day's of the same tickers."""
    _replace(df, path, "parquet", buckets, as_of)


def snapshot_expire(
    spark: SparkSession,
    path: str,
    as_of: datetime,
    days: int = RETENTION_DAYS,
    tickers: DataFrame | None = None,
    everything: bool = False,
) -> list[str]:
    """Drop expired days of a snapshot table; returns the days something was dropped from.

    A day is expired if its midnight is more than `days` before `as_of`. Folder
    names decide, and a whole day goes without being read. With `tickers` (a column
    of that name) only they go: a mark per ticker and day is written, found by the
    index of each day's tickers, and no snapshot is opened; readers leave marked
    tickers out and `compact_snapshots` takes them out of the files. With
    `everything` days of any age go.
    """
    cutoff = as_of - timedelta(days=days)
    expired = {}
    for value, folder in sorted(_folders(spark, path, "cache_date").items()):
        try:
            day = date.fromisoformat(value)
        except ValueError:
            continue
        if everything or datetime.combine(day, time.min) < cutoff:
            expired[day] = folder
    if tickers is not None:
        return _mark_gone(spark, path, expired, tickers)
    for day, folder in expired.items():
        _delete(spark, folder)
        _delete(spark, f"{path.rstrip('/')}/{GONE}/cache_date={day.isoformat()}")
    return [day.isoformat() for day in expired]


def _mark_gone(spark: SparkSession, path: str, days: dict[date, str], tickers: DataFrame) -> list[str]:
    indexed = {day: f"{folder}/{PRESENCE}" for day, folder in days.items()}
    indexed = {day: index for day, index in indexed.items() if exists(spark, index)}
    if not indexed:
        return []
    # Folders of several tables: the day and the bucket are taken from the files' names.
    read = spark.read.schema("ticker string").option("recursiveFileLookup", True).parquet(*indexed.values())
    place = F.col("_metadata.file_path")
    day = F.regexp_extract(place, r"/cache_date=([0-9-]+)/", 1).cast("date")
    bucket = F.regexp_extract(place, r"/bucket=([^/]+)/", 1)
    held = _without_gone(read.withColumns({"bucket": bucket, "cache_date": day}), gone_tickers(spark, path))
    asked = tickers.select(F.col("ticker").alias("_asked")).distinct()
    ensure_checkpoint_dir(spark)
    marks = held.join(asked, F.col("ticker").eqNullSafe(F.col("_asked")), "left_semi").checkpoint()
    touched = sorted(r["cache_date"].isoformat() for r in marks.select("cache_date").distinct().collect())
    if touched:
        writer = marks.repartition("cache_date").write.mode("append").partitionBy("cache_date")
        writer.parquet(f"{path.rstrip('/')}/{GONE}")
    return touched


def compact_snapshots(spark: SparkSession, path: str) -> list[str]:
    """Take what is marked as expired out of the files; returns the days that were written anew.

    Of a day only the buckets with marked tickers are read and written. A run that
    breaks off is finished by running it again.
    """
    done = []
    for value in sorted(_folders(spark, f"{path.rstrip('/')}/{GONE}", "cache_date")):
        day = date.fromisoformat(value)
        folder, gone = _day_folder(path, day), gone_tickers(spark, path, day)
        held = _folders(spark, folder, "bucket")
        touched = [b for b in (r["bucket"] for r in gone.select("bucket").distinct().collect()) if b in held]
        if touched:
            ensure_checkpoint_dir(spark)
            kind = T.StructType([*schema.BARS.fields, T.StructField("bucket", T.StringType())])
            rows = _load(spark, "parquet", [held[b] for b in touched], folder, kind)
            rest = _without_gone(rows.withColumn("cache_date", F.lit(day)), gone).drop("cache_date").checkpoint()
            _write_buckets(rest, folder, "parquet")
            left = {r["bucket"] for r in rest.select("bucket").distinct().collect()}
            for name in set(touched) - left:
                _delete(spark, held.pop(name))
                _delete(spark, f"{folder}/{PRESENCE}/bucket={name}")
            _index_buckets(spark, folder, "parquet", left)
            done.append(value)
        if not held:
            _delete(spark, folder)
        _delete(spark, f"{path.rstrip('/')}/{GONE}/cache_date={value}")
    return done


def export_named(df: DataFrame, path: str, name: str, fmt: str, extension: str) -> None:
    """One file per value of the column `name`, called `<value><extension>`; for readers outside Spark.

    Each value's rows are one file, so this is for exchange, not for storage; the
    files are named by the driver, one rename each.
    """
    spark = df.sparkSession
    staged = f"{path.rstrip('/')}/_staged-{uuid.uuid4().hex}"
    rows = df.withColumn("_name", F.col(name)).drop(name).repartition("_name")
    rows = rows.sortWithinPartitions("_name", *[c for c in ("time",) if c in df.columns])
    rows.write.format(fmt).option("header", True).option("ignoreNullFields", False).partitionBy("_name").save(staged)
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for value, folder in _folders(spark, staged, "_name").items():
        parts = [x.getPath() for x in fs.listStatus(jvm.org.apache.hadoop.fs.Path(folder))]
        (part,) = [x for x in parts if x.getName().startswith("part-")]
        fs.rename(part, jvm.org.apache.hadoop.fs.Path(root, value + extension))
    _delete(spark, staged)


def registry_write(registry: DataFrame, path: str) -> None:
    """Replace the registry by its sorted tickers, one per line.

    `registry` may have been read from `path`, so it is checkpointed before the
    old list is overwritten.
    """
    ensure_checkpoint_dir(registry.sparkSession)
    held = registry.select(F.col("ticker").alias("value")).checkpoint()
    held.orderBy("value").write.mode("overwrite").text(path)


def access_log_append(log: DataFrame, path: str) -> None:
    log.select(*schema.ACCESS_LOG.names).write.mode("append").parquet(path)
