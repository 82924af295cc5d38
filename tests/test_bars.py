"""Normalising, guards, counts, previews and inline records."""

import json
from datetime import date

import pytest
from pyspark.errors import PySparkException

from trendcloud.operators import bars

RAW = "ticker string, Date string, Open double, High double, Low double, Close double, Volume int"


def test_normalize_renames_by_position(spark):
    raw = spark.createDataFrame(
        [
            ("A", "2024-01-02T00:00:00-05:00", 1.0, float("nan"), 0.5, 1.5, 10),
            ("A", "not a day", 1.0, 2.0, 0.5, 1.5, None),
        ],
        RAW,
    )
    got = bars.normalize_bars(raw)
    assert got.columns == ["ticker", "time", "open", "high", "low", "close", "volume"]
    first, second = got.orderBy("volume", ascending=False).collect()
    assert tuple(first) == ("A", date(2024, 1, 2), 1.0, None, 0.5, 1.5, 10)
    assert second.time is None and second.high == 2.0


def test_normalize_with_format_and_arity(spark):
    raw = spark.createDataFrame([("A", "02/01/2024", 1.0, 2.0, 0.5, 1.5, 10)], RAW)
    assert bars.normalize_bars(raw, fmt="dd/MM/yyyy").first().time == date(2024, 1, 2)
    with pytest.raises(ValueError):
        bars.normalize_bars(raw.drop("Volume"))


def test_strict_normalizing_fails(spark):
    raw = spark.createDataFrame([("A", "nonsense", 1.0, 2.0, 0.5, 1.5, 10)], RAW)
    with pytest.raises(PySparkException):
        bars.normalize_bars(raw, strict=True).collect()


def test_date_range_is_half_open(bars_of):
    df = bars_of({"A": [(1.0, 1.0, 1.0, 1.0, 1)] * 5})
    days = [r.time.day for r in bars.date_range(df, "2024-01-02", "2024-01-04").collect()]
    assert sorted(days) == [2, 3]


def test_size_guard_keeps_whole_series(bars_of):
    bar = (1.0, 1.0, 1.0, 1.0, 1)
    df = bars_of({"LONG": [bar] * 6, "FITS": [bar] * 5, "ONE": [bar]})
    kept, refused = bars.size_guard(df, 5)
    assert {r.ticker: r["count"] for r in bars.series_counts(kept).collect()} == {"FITS": 5, "ONE": 1}
    assert [tuple(r) for r in refused.collect()] == [("LONG", 6)]


def test_csv_guard_counts_bytes(bars_of):
    df = bars_of({"A": [(1.5, 2.0, 1.0, 1.25, 10)] * 2, "B": [(None, 2.0, 1.0, 1.25, 10)]})
    header = "time,open,high,low,close,volume\n"
    expect = {
        "A": len(header) + 2 * len("2024-01-01,1.5,2.0,1.0,1.25,10\n"),
        "B": len(header) + len("2024-01-01,,2.0,1.0,1.25,10\n"),
    }
    assert {r.ticker: r.bytes for r in bars.csv_size(df).collect()} == expect
    kept, refused = bars.csv_guard(df, expect["B"])
    assert [r.ticker for r in kept.collect()] == ["B"]
    assert [r.ticker for r in refused.collect()] == ["A"]


def test_preview_and_last(bars_of):
    df = bars_of({t: [(float(i), 1.0, 1.0, 1.0, i) for i in range(8)] for t in "AB"})
    rows = bars.preview(df).collect()
    assert sorted((r.ticker, r.volume) for r in rows) == [(t, i) for t in "AB" for i in range(5)]
    assert sorted((r.ticker, r.volume) for r in bars.last_bars(df).collect()) == [("A", 7), ("B", 7)]
    plan = bars.preview(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_records(spark):
    df = bars.bars_from_records(
        spark,
        [
            {"time": "2024-01-02", "high": 2, "low": 1, "close": float("nan"), "note": "x"},
            {"time": "2024-01-03", "open": 1, "high": 2, "low": 1, "close": 2, "volume": 5.0},
        ],
        ticker="A",
    )
    rows = [r.asDict() for r in df.orderBy("time").collect()]
    assert rows[0] == {
        "ticker": "A",
        "time": date(2024, 1, 2),
        "open": None,
        "high": 2.0,
        "low": 1.0,
        "close": None,
        "volume": None,
        "note": "x",
    }
    typed = bars.bars_from_records(spark, [{"n": 1, "x": 1.5, "ok": True}, {"n": 2**53 + 1, "x": 2, "ok": None}])
    assert dict(typed.dtypes) | {"n": "bigint", "x": "double", "ok": "boolean"} == dict(typed.dtypes)
    assert {r.n for r in typed.collect()} == {1, 2**53 + 1}
    assert rows[1]["volume"] == 5 and rows[1]["note"] is None
    back = [json.loads(r.record) for r in bars.records_json(df.orderBy("time")).collect()]
    assert back[0]["time"] == "2024-01-02" and back[0]["volume"] is None


def test_quality(spark):
    from trendcloud import schema

    d = date(2024, 1, 1)
    df = spark.createDataFrame(
        [
            ("A", d, 1.0, 2.0, 1.0, 1.0, 1),
            ("A", d, 1.0, 2.0, 3.0, 1.0, 1),
            ("A", None, 1.0, None, 1.0, 1.0, 1),
            ("A", None, 1.0, 2.0, 1.0, 1.0, 1),
        ],
        schema.BARS,
    )
    assert tuple(bars.bar_quality(df).first()) == ("A", 4, 2, 1, 1, 1)


def test_repeated_days_come_in_the_order_of_their_values(spark):
    from trendcloud import schema

    d = date(2024, 1, 1)
    rows = [("A", d, float(i), 2.0, 1.0, 1.0, 1) for i in range(9)]
    one, other = (spark.createDataFrame(x, schema.BARS).repartition(3) for x in (rows, rows[::-1]))
    for df in (one, other):
        assert sorted(r.open for r in bars.preview(df).collect()) == [0.0, 1.0, 2.0, 3.0, 4.0]
        assert [r.open for r in bars.last_bars(df).collect()] == [8.0]


def test_guards_take_rows_without_a_ticker_as_a_series(spark):
    from trendcloud import schema

    rows = [(t, date(2024, 1, 1 + i), 1.0, 1.0, 1.0, 1.0, 1) for t in (None, "A") for i in range(3)]
    df = spark.createDataFrame(rows[:5], schema.BARS)
    kept, refused = bars.size_guard(df, 2)
    assert {r.ticker for r in kept.collect()} == {"A"} and [tuple(r) for r in refused.collect()] == [(None, 3)]


def test_days_of_large_keys_and_prices(spark, tmp_path):
    from trendcloud.sources import tables

    lines = spark.createDataFrame(
        [(6 * 10**11, 200_000.0), (6 * 10**11 + 1, 1.005), (6 * 10**11 + 1, 1.004), (2**62, 167_772.17)],
        "l_orderkey long, l_extendedprice double",
    ).selectExpr("*", "'A' ticker", "timestamp_ntz'2024-01-01' l_shipdate")
    (bar,) = tables._daily(lines, "ticker").collect()
    assert (bar.open, bar.high, bar.low, bar.close, bar.volume) == (200_000.0, 200_000.0, 1.004, 167_772.17, 4)
    plan = tables._daily(lines, "ticker")._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan
