"""Bar tables: normalising, ranges, guards, counts and previews."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendcloud import schema
from trendcloud.functions.columns import nan_to_null, parse_day

def normalize_bars(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    key: str = "ticker",
    fmt: str | None = None,
    strict: bool = False,
    further: Sequence[str] = (),
) -> DataFrame:
    """Rename six columns by position to time, open, high, low, close, volume.

    `columns` names the six source columns in that order; by default they are
    every column of `df` but the key. Days that cannot be read become NULL, or
    fail the job when `strict` is set. Columns named in `further` are kept.
    """
    source = list(columns) if columns is not None else [c for c in df.columns if c != key]
    if len(source) != len(schema.BAR_NAMES):
        raise ValueError(f"expected {len(schema.BAR_NAMES)} columns, got {source}")
    kind = df.schema[source[0]].dataType
    raw = F.col(f"`{source[0]}`")
    if isinstance(kind, T.DateType):
        day = raw
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        day = raw.cast("date")
    else:
        day = parse_day(raw, fmt)
    if strict:
        broken = raw.isNotNull() & day.isNull()
        day = F.when(
            broken, F.raise_error(F.concat(F.lit("not a day: "), raw.cast("string"))).cast("date")
        ).otherwise(day)
    prices = [
        nan_to_null(F.col(f"`{c}`").cast("double")).alias(name)
        for c, name in zip(source[1:5], schema.PRICES)
    ]
    volume = F.col(f"`{source[5]}`")
    if isinstance(df.schema[source[5]].dataType, (T.DoubleType, T.FloatType)):
        volume = nan_to_null(volume)
    head = [F.col(key)] if key in df.columns else []
    bar = [day.alias("time"), *prices, volume.cast("bigint").alias("volume")]
    return df.select(*head, *bar, *[F.col(f"`{c}`") for c in further])


def _kind(values: Iterable) -> T.DataType:
    """The narrowest type for the values of a further column; mixed ones are text."""
    kinds = {type(v) for v in values if v is not None}
    if kinds and kinds <= {bool}:
        return T.BooleanType()
    if kinds and kinds <= {int}:
        return T.LongType()
    if kinds and kinds <= {int, float}:
        return T.DoubleType()
    return T.StringType()


def bars_from_records(spark: SparkSession, rows: Iterable[dict], ticker: str | None = None) -> DataFrame:
    """Inline records to a bar table; absent fields are NULL, further ones kept with their types."""
    rows = list(rows)
    extra = sorted({k for r in rows for k in r} - set(schema.BARS.names))
    fields = [
        T.StructField(f.name, T.StringType()) if f.name == "time" else f for f in schema.BARS
    ]
    declared = T.StructType(fields + [T.StructField(c, _kind(r.get(c) for r in rows)) for c in extra])

    def convert(row: dict) -> tuple:
        out = []
        for f in declared:
            value = row.get(f.name)
            if f.name == "ticker" and value is None:
                value = ticker
            if value is not None:
                if isinstance(f.dataType, T.DoubleType):
                    value = float(value)
                elif isinstance(f.dataType, T.LongType):
                    value = None if value != value else int(value)
                elif isinstance(f.dataType, T.StringType):
                    value = str(value)
            out.append(value)
        return tuple(out)

    df = spark.createDataFrame([convert(r) for r in rows], declared)
    return _from_raw(df, extra)


def _from_raw(df: DataFrame, extra: Sequence[str]) -> DataFrame:
    return df.select(
        "ticker",
        parse_day(F.col("time")).alias("time"),
        *[nan_to_null(F.col(c)).alias(c) for c in schema.PRICES],
        "volume",
        *extra,
    )


def bars_from_json(
    records: DataFrame, col: str = "record", extra: T.StructType = T.StructType(), ticker: str | None = None
) -> DataFrame:
    """Records as JSON text to a bar table; `extra` declares further fields, which are kept.

    Absent and unreadable fields are NULL; records without a ticker get `ticker`.
    """
    fields = [
        T.StructField(f.name, T.StringType()) if f.name == "time" else f for f in schema.BARS
    ]
    row = records.select(F.from_json(col, T.StructType(fields + extra.fields)).alias("r")).select("r.*")
    if ticker is not None:
        row = row.withColumn("ticker", F.coalesce("ticker", F.lit(ticker)))
    return _from_raw(row, extra.names)


def date_range(df: DataFrame, start: str, end: str) -> DataFrame:
    """Half-open range of days: start is in, end is not."""
    day = F.col("time")
    return df.filter((day >= F.lit(start).cast("date")) & (day < F.lit(end).cast("date")))


def series_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("ticker").agg(F.count(F.lit(1)).alias("count"))


def _guarded(df: DataFrame, measure: Column, name: str, most: int) -> tuple[DataFrame, DataFrame]:
    """Whole series whose `measure` is at most `most`, and the refused (ticker, measure).

    The measure is combined before it is shuffled and met again by a semi join,
    which adaptive execution may split, so a long series is never one task. Rows
    without a ticker are a series too: a text stands for NULL in both, so the join
    is a plain one and the rows need one exchange.
    """
    named = df.withColumn("_series", F.coalesce("ticker", F.lit("\x00")))
    measured = named.groupBy("_series").agg(measure.alias(name))
    fitting = measured.filter(F.col(name) <= most).select("_series")
    kept = named.join(fitting, "_series", "left_semi").drop("_series")
    ticker = F.nullif("_series", F.lit("\x00")).alias("ticker")
    return kept, measured.filter(F.col(name) > most).select(ticker, name)


def size_guard(df: DataFrame, max_rows: int) -> tuple[DataFrame, DataFrame]:
    """Split into whole series within the limit, and the refused `(ticker, count)`."""
    return _guarded(df, F.count(F.lit(1)), "count", max_rows)


def csv_line_bytes() -> Column:
    """Bytes of a bar as a line of CSV."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in schema.BAR_NAMES]
    return F.octet_length(F.concat_ws(",", *cells)) + F.lit(1)


def _csv_bytes() -> Column:
    header = len(",".join(schema.BAR_NAMES)) + 1
    return F.sum(csv_line_bytes()) + F.lit(header)


def csv_size(df: DataFrame) -> DataFrame:
    """Bytes each series takes as CSV text with a header line."""
    return df.groupBy("ticker").agg(_csv_bytes().alias("bytes"))


def csv_guard(df: DataFrame, max_bytes: int) -> tuple[DataFrame, DataFrame]:
    """As `size_guard`, by the bytes of the series as CSV."""
    return _guarded(df, _csv_bytes(), "bytes", max_bytes)


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    """The first n rows of each series.

    Spark cuts each group to n rows before the shuffle (WindowGroupLimit). Rows
    that repeat a day come in the order of their values, the same on every run.
    """
    rest = [c for c in df.columns if c not in ("ticker", "time")]
    first = Window.partitionBy("ticker").orderBy("time", *rest)
    return df.withColumn("row", F.row_number().over(first)).filter(F.col("row") <= n)


def last_bars(df: DataFrame) -> DataFrame:
    """The last row of each series; of rows that repeat its day the one with the largest values.

    Spark cuts each group to one row before the shuffle (WindowGroupLimit).
    """
    rest = [F.desc(c) for c in df.columns if c not in ("ticker", "time")]
    last = Window.partitionBy("ticker").orderBy(F.desc("time"), *rest)
    return df.withColumn("_n", F.row_number().over(last)).filter(F.col("_n") == 1).drop("_n")


def bar_quality(df: DataFrame) -> DataFrame:
    """Per series: rows, unreadable days, repeated days, missing or inverted prices.

    Two levels of counting: repeated days are folded per (ticker, day) first.
    """
    missing = (
        F.col("open").isNull()
        | F.col("high").isNull()
        | F.col("low").isNull()
        | F.col("close").isNull()
    )
    per_day = df.groupBy("ticker", "time").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(missing).alias("missing"),
        F.count_if(F.col("high") < F.col("low")).alias("inverted"),
    )
    known = F.col("time").isNotNull()
    return per_day.groupBy("ticker").agg(
        F.sum("n").alias("rows"),
        F.sum(F.when(~known, F.col("n")).otherwise(0)).alias("unreadable_days"),
        F.sum(F.when(known, F.col("n") - 1).otherwise(0)).alias("repeated_days"),
        F.sum("missing").alias("missing_prices"),
        F.sum("inverted").alias("inverted_prices"),
    )


def records_json(df: DataFrame) -> DataFrame:
    """One JSON record per row; absent values are written as null."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("record"))
