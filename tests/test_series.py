"""Chart series: tie rules, missing values, both shapes of the cloud."""

from datetime import date

from pyspark.sql import functions as F

from trendcloud.functions.columns import COLOR_BEAR, COLOR_BULL, LIGHT_GREEN, LIGHT_RED, cloud_color
from trendcloud.operators import series

DAY = date(2024, 1, 1)


def test_candle_colors_and_filter(bars_of):
    df = bars_of(
        {
            "A": [(2.0, 3.0, 1.0, 1.0, 1)],
            "B": [(1.0, 3.0, 1.0, 2.0, 1)],
            "TIE": [(2.0, 3.0, 1.0, 2.0, 1)],
            "NAN": [(2.0, float("nan"), 1.0, 2.0, 1)],
            "NULL": [(2.0, 3.0, 1.0, None, 1)],
        }
    )
    got = {r.ticker: r.color for r in series.candles(df).collect()}
    assert got == {"A": COLOR_BEAR, "B": COLOR_BULL, "TIE": COLOR_BULL}


def test_volume_colors_and_filter(bars_of):
    df = bars_of(
        {
            "UP": [(1.0, 3.0, 1.0, 2.0, 7)],
            "DOWN": [(2.0, 3.0, 1.0, 1.0, 8)],
            "TIE": [(2.0, 3.0, 1.0, 2.0, 9)],
            "NONE": [(1.0, 3.0, 1.0, 2.0, None)],
            "BARE": [(None, None, None, None, 5)],
        }
    )
    got = {r.ticker: (r.value, r.color) for r in series.volume_bars(df).collect()}
    assert got == {
        "UP": (7, COLOR_BULL),
        "DOWN": (8, COLOR_BEAR),
        "TIE": (9, COLOR_BEAR),
        "BARE": (5, COLOR_BEAR),
    }


def spans(spark, rows):
    return spark.createDataFrame(
        [(t, DAY, a, b) for t, a, b in rows],
        "ticker string, time date, senkou_span_a double, senkou_span_b double",
    )


ROWS = [
    ("BULL", 3.0, 2.0),
    ("BEAR", 2.0, 3.0),
    ("TIE", 2.0, 2.0),
    ("HALF", 2.0, None),
    ("NAN", float("nan"), 1.0),
]


def test_cloud_color(spark):
    df = spans(spark, ROWS[:4]).select(
        "ticker", cloud_color(F.col("senkou_span_a"), F.col("senkou_span_b")).alias("c")
    )
    assert {r.ticker: r.c for r in df.collect()} == {
        "BULL": LIGHT_GREEN,
        "BEAR": LIGHT_RED,
        "TIE": LIGHT_RED,
        "HALF": LIGHT_RED,
    }


def test_cloud_bands(spark):
    df = series.cloud_bands(spans(spark, ROWS))
    got = {r.ticker: tuple(r[2:]) for r in df.collect()}
    assert got == {
        "BULL": (3.0, 2.0, None, None),
        "BEAR": (None, None, 3.0, 2.0),
        "TIE": (2.0, 2.0, None, None),
    }


def test_edges_of_both_pairs_are_the_spans(spark):
    df = series.cloud_bands(spans(spark, ROWS)).select(
        "ticker",
        F.coalesce("bull_top", "bear_bottom").alias("a"),
        F.coalesce("bull_bottom", "bear_top").alias("b"),
    )
    assert {tuple(r) for r in df.collect()} == {r for r in ROWS if r[0] in ("BULL", "BEAR", "TIE")}


def test_long_form(spark):
    wide = spans(spark, ROWS)
    lines = series.line_series(wide, ("senkou_span_a", "senkou_span_b"))
    assert lines.count() == 8
    long, short = series.cloud_bands_long(lines), series.cloud_bands(wide)
    assert long.exceptAll(short).count() == 0 and short.exceptAll(long).count() == 0
