"""Chart-ready series from bars and indicator rows. All are narrow: no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendcloud.functions.columns import candle_color, nan_to_null, volume_color, without_nan
from trendcloud.schema import LINES


def candles(df: DataFrame) -> DataFrame:
    """Rows with a day and all four prices, coloured (projected rows fall out)."""
    bars = without_nan(df, ["open", "high", "low", "close"])
    whole = bars.dropna(subset=["time", "open", "high", "low", "close"])
    return whole.select(
        "ticker",
        "time",
        "open",
        "high",
        "low",
        "close",
        candle_color(F.col("open"), F.col("close")).alias("color"),
    )


def volume_bars(df: DataFrame) -> DataFrame:
    """Rows with a day and a volume, coloured by the bar's direction."""
    bars = without_nan(df, ["volume", "open", "close"]).dropna(subset=["time", "volume"])
    return bars.select(
        "ticker",
        "time",
        F.col("volume").alias("value"),
        volume_color(F.col("open"), F.col("close")).alias("color"),
    )


def line_series(df: DataFrame, lines: tuple[str, ...] = LINES) -> DataFrame:
    """The lines in long form `(ticker, line, time, value)`, only where defined."""
    long = df.unpivot(["ticker", "time"], list(lines), "line", "value")
    value = nan_to_null(F.col("value"))
    return long.filter(F.col("time").isNotNull() & value.isNotNull()).select(
        "ticker", "line", "time", "value"
    )


def cloud_bands(df: DataFrame) -> DataFrame:
    """Upper and lower edge of the cloud where both spans are defined.

    The edges stand in the bullish pair where A >= B, else in the bearish pair;
    the other pair is NULL. Drawn as two plain lines, the upper and lower edges
    of both pairs together are just span A and span B.
    """
    spans = without_nan(df, ["senkou_span_a", "senkou_span_b"])
    both = spans.dropna(subset=["senkou_span_a", "senkou_span_b"])
    a, b = F.col("senkou_span_a"), F.col("senkou_span_b")
    bullish = a >= b
    top, bottom = F.greatest(a, b), F.least(a, b)
    return both.select(
        "ticker",
        "time",
        F.when(bullish, top).alias("bull_top"),
        F.when(bullish, bottom).alias("bull_bottom"),
        F.when(~bullish, top).alias("bear_top"),
        F.when(~bullish, bottom).alias("bear_bottom"),
    )


def cloud_bands_long(lines: DataFrame) -> DataFrame:
    """`cloud_bands` from two spans in long form, paired by `(ticker, time)`."""
    spans = lines.filter(F.col("line").isin("senkou_span_a", "senkou_span_b"))
    wide = spans.groupBy("ticker", "time").agg(
        F.max(F.when(F.col("line") == "senkou_span_a", F.col("value"))).alias("senkou_span_a"),
        F.max(F.when(F.col("line") == "senkou_span_b", F.col("value"))).alias("senkou_span_b"),
    )
    return cloud_bands(wide)
