"""Small column expressions; all of them stay inside Spark's own functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Colours of the cloud and of the bars.
LIGHT_GREEN = "rgba(144,238,144,0.3)"
LIGHT_RED = "rgba(255,182,193,0.3)"
COLOR_BULL = "rgba(38,166,154,0.9)"
COLOR_BEAR = "rgba(239,83,80,0.9)"

# Every character that counts as white space.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def parse_day(value: Column, fmt: str | None = None) -> Column:
    """Text to DATE, NULL where it is not a day.

    Without a format an ISO day is read, with or without a time of day behind
    it; the day is the one written, whatever zone offset follows.
    """
    text = value.cast("string")
    return text.try_cast("date") if fmt is None else F.try_to_date(text, fmt)


def strip(text: Column) -> Column:
    """Without white space of any kind at either end (`trim` alone knows only blanks)."""
    return F.trim(text, F.lit(WHITE_SPACE))


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def without_nan(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Replace NaN by NULL in the floating columns (all, or the named ones)."""
    floating = {
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, (T.DoubleType, T.FloatType))
        and (names is None or f.name in names)
    }
    if not floating:
        return df
    return df.select(
        *[nan_to_null(F.col(c)).alias(c) if c in floating else F.col(c) for c in df.columns]
    )


def cloud_color(span_a: Column, span_b: Column) -> Column:
    """Green only where A is above B; ties and undefined rows are red."""
    return F.when(span_a > span_b, F.lit(LIGHT_GREEN)).otherwise(F.lit(LIGHT_RED))


def candle_color(open_: Column, close: Column) -> Column:
    """A tie is bullish."""
    return F.when(open_ > close, F.lit(COLOR_BEAR)).otherwise(F.lit(COLOR_BULL))


def volume_color(open_: Column, close: Column) -> Column:
    """A tie is bearish."""
    return F.when(close > open_, F.lit(COLOR_BULL)).otherwise(F.lit(COLOR_BEAR))


def megabytes(size: Column) -> Column:
    return F.round(size / F.lit(1024 * 1024), 2)


def join_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Equi-join in which NULL keys match each other, so that no row is lost.

    The right side's keys are renamed, so both sides may stem from one table.
    """
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    matches = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    joined = left.join(renamed, reduce(lambda a, b: a & b, matches), how)
    return joined.drop(*[f"_right_{k}" for k in keys])
