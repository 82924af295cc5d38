"""Declared schemas. `(ticker, time)` is the key of a bar table."""

from __future__ import annotations

from pyspark.sql import types as T

BAR_NAMES = ("time", "open", "high", "low", "close", "volume")
PRICES = ("open", "high", "low", "close")
LINES = ("tenkan_sen", "kijun_sen", "chikou_span", "senkou_span_a", "senkou_span_b")

BARS = T.StructType(
    [
        T.StructField("ticker", T.StringType()),
        T.StructField("time", T.DateType()),
        T.StructField("open", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("close", T.DoubleType()),
        T.StructField("volume", T.LongType()),
    ]
)

# A bar as it stands in a file: the day is text until it has been parsed.
RAW_BAR = T.StructType(
    [
        T.StructField("time", T.StringType()),
        T.StructField("open", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("close", T.DoubleType()),
        T.StructField("volume", T.LongType()),
    ]
)

SNAPSHOT = T.StructType(
    [
        T.StructField("timestamp", T.StringType()),
        T.StructField("ticker", T.StringType()),
        T.StructField("data", T.ArrayType(RAW_BAR)),
        T.StructField("count", T.LongType()),
    ]
)

OBJECTS = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("last_modified", T.TimestampType()),
    ]
)

ACCESS_LOG = T.StructType(
    [
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("ticker", T.StringType()),
        T.StructField("source_ip", T.StringType()),
        T.StructField("success", T.BooleanType()),
        T.StructField("action", T.StringType()),
    ]
)
