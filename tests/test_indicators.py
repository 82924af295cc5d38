"""The indicator against a plain loop, its edge rules and its plan."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from trendcloud import CloudParams, ichimoku_cloud
from trendcloud.functions.columns import LIGHT_GREEN, LIGHT_RED
from trendcloud.operators import indicators
from trendcloud.schema import LINES


def loop_midpoint(bars, i, n):
    window = bars[i - n + 1 : i + 1] if i >= n - 1 else []
    if len(window) < n or any(b[1] is None or b[2] is None for b in window):
        return None
    return (max(b[1] for b in window) + min(b[2] for b in window)) / 2


def loop_cloud(bars, params, start=date(2024, 1, 1)):
    """(time, five lines, colour, is_projected) of one series of (o, h, l, c, v)."""
    n, shift = len(bars), params.cloud_shift
    tenkan = [loop_midpoint(bars, i, params.conversion_len) for i in range(n)]
    kijun = [loop_midpoint(bars, i, params.base_len) for i in range(n)]
    leading = [loop_midpoint(bars, i, params.leading_span_b_len) for i in range(n)]
    out = []
    for i in range(n + shift):
        real, src = i < n, i - shift
        chikou = bars[i + params.lagging_len][3] if i + params.lagging_len < n else None
        a = b = None
        if 0 <= src < n:
            if tenkan[src] is not None and kijun[src] is not None:
                a = (tenkan[src] + kijun[src]) / 2
            b = leading[src]
        green = a is not None and b is not None and a > b
        out.append(
            (
                start + timedelta(days=i),
                tenkan[i] if real else None,
                kijun[i] if real else None,
                chikou if real else None,
                a,
                b,
                LIGHT_GREEN if green else LIGHT_RED,
                not real,
            )
        )
    return out


def random_bars(rng, n, gaps=0.0):
    out = []
    for _ in range(n):
        low = round(rng.uniform(10, 90), 2)
        high = round(low + rng.choice([0, rng.uniform(0, 9)]), 2)
        bar = [rng.choice([low, high]), high, low, rng.choice([low, high]), rng.randrange(1000)]
        for k in range(5):
            if rng.random() < gaps:
                bar[k] = None
        out.append(tuple(bar))
    return out


def result(df, ticker):
    rows = df.filter(F.col("ticker") == ticker).orderBy("time").collect()
    return [(r.time, *[r[c] for c in LINES], r.cloud_color, r.is_projected) for r in rows]


PARAMS = [
    CloudParams(),
    CloudParams(5, 10, 10, 20, 10),
    CloudParams(1, 2, 3, 4, 5),
    CloudParams(12, 7, 0, 3, 0),
    CloudParams(2, 130, 5, 41, 7),
    CloudParams(11, 11, 1, 50, 1),
]


@pytest.mark.parametrize("params", PARAMS)
@pytest.mark.parametrize("block_rows", [None, 40])
def test_equals_plain_loop(bars_of, params, block_rows):
    rng = random.Random(7)
    series = {
        "FULL": random_bars(rng, 180),
        "GAPS": random_bars(rng, 150, gaps=0.02),
        "SHORT": random_bars(rng, 5),
        "ONE": random_bars(rng, 1),
        "NINE": random_bars(rng, 9),
        "HALF": random_bars(rng, 30),
    }
    df = ichimoku_cloud(bars_of(series), params, block_rows=block_rows).cache()
    for ticker, bars in series.items():
        assert result(df, ticker) == loop_cloud(bars, params), ticker
    assert df.count() == sum(len(b) + params.cloud_shift for b in series.values())


def test_short_series_is_extended_without_lines(bars_of):
    df = ichimoku_cloud(bars_of({"A": random_bars(random.Random(1), 5)}))
    rows = df.orderBy("time").collect()
    assert len(rows) == 31
    assert all(r[c] is None for r in rows for c in LINES)
    assert {r.cloud_color for r in rows} == {LIGHT_RED}
    assert all(r.open is None and r.volume is None for r in rows if r.is_projected)


def test_line_starts_with_its_nth_row(bars_of):
    df = indicators.tenkan_sen(bars_of({"A": random_bars(random.Random(2), 9)}))
    values = [r.tenkan_sen for r in df.orderBy("time").collect()]
    assert values[:8] == [None] * 8 and values[8] is not None


def test_nan_is_missing(bars_of):
    bars = random_bars(random.Random(3), 60)
    nan = list(bars)
    nan[20] = (nan[20][0], float("nan"), *nan[20][2:])
    null = list(bars)
    null[20] = (null[20][0], None, *null[20][2:])
    a = ichimoku_cloud(bars_of({"A": nan}))
    b = ichimoku_cloud(bars_of({"A": null}))
    assert result(a, "A") == result(b, "A")
    gone = [i for i, r in enumerate(result(a, "A")[:60]) if i >= 8 and r[1] is None]
    assert gone == list(range(20, 29))


def test_series_and_row_order_do_not_matter(bars_of):
    rng = random.Random(4)
    series = {t: random_bars(rng, 90) for t in ("A", "B")}
    both = bars_of(series)
    shuffled = both.orderBy(F.rand(5)).repartition(7)
    for ticker, bars in series.items():
        alone = result(ichimoku_cloud(bars_of({ticker: bars})), ticker)
        assert result(ichimoku_cloud(both), ticker) == alone
        assert result(ichimoku_cloud(shuffled), ticker) == alone


def test_projected_days_are_calendar_days(bars_of):
    friday = date(2024, 5, 31)
    df = ichimoku_cloud(bars_of({"A": random_bars(random.Random(6), 1)}, start=friday))
    times = [r.time for r in df.filter("is_projected").orderBy("time").collect()]
    assert times == [friday + timedelta(days=i) for i in range(1, 27)]


def test_shift_moves_rows_not_days(spark):
    from trendcloud import schema

    days = [date(2024, 1, 1) + timedelta(days=3 * i) for i in range(6)]
    rows = [("A", d, 1.0, 10.0 + i, 1.0 + i, 5.0, 1) for i, d in enumerate(days)]
    bars = spark.createDataFrame(rows, schema.BARS)
    df = ichimoku_cloud(bars, CloudParams(1, 1, 1, 1, 2)).orderBy("time").collect()
    assert [r.senkou_span_b for r in df] == [None, None, 5.5, 6.5, 7.5, 8.5, 9.5, 10.5]
    assert [r.time for r in df[6:]] == [days[-1] + timedelta(days=1), days[-1] + timedelta(days=2)]


def test_no_shift_adds_nothing(bars_of):
    df = ichimoku_cloud(
        bars_of({"A": random_bars(random.Random(8), 60)}), CloudParams(cloud_shift=0)
    )
    rows = df.collect()
    assert len(rows) == 60 and not any(r.is_projected for r in rows)
    for r in rows:
        if r.tenkan_sen is not None and r.kijun_sen is not None:
            assert r.senkou_span_a == (r.tenkan_sen + r.kijun_sen) / 2


def test_empty_input_gives_no_rows(bars_of):
    assert ichimoku_cloud(bars_of({})).count() == 0
    assert ichimoku_cloud(bars_of({}), block_rows=10).count() == 0


def test_further_columns_pass_through(bars_of):
    bars = bars_of({"A": random_bars(random.Random(9), 3)}).withColumn("venue", F.lit("X"))
    rows = ichimoku_cloud(bars).select("venue", "is_projected").distinct().collect()
    assert {(r.venue, r.is_projected) for r in rows} == {("X", False), (None, True)}


@pytest.mark.parametrize(
    "bad",
    [
        {"conversion_len": 0},
        {"base_len": -1},
        {"leading_span_b_len": 0},
        {"lagging_len": -1},
        {"cloud_shift": -1},
    ],
)
def test_bad_parameters(bad):
    with pytest.raises(ValueError):
        CloudParams(**bad)


def test_bad_parts(bars_of):
    bars = bars_of({})
    for call in (
        lambda: indicators.tenkan_sen(bars, 0),
        lambda: indicators.chikou_span(bars, -1),
        lambda: indicators.extend_horizon(bars, -1),
        lambda: indicators.senkou_span_a(bars, shift=-1),
        lambda: indicators.senkou_span_b(bars, n=0),
    ):
        with pytest.raises(ValueError):
            call()


@pytest.mark.parametrize("block_rows", [None, 30])
def test_parts_equal_whole(bars_of, block_rows):
    series = {
        "A": random_bars(random.Random(10), 120, gaps=0.01),
        "B": random_bars(random.Random(11), 20),
    }
    bars = bars_of(series)
    whole = ichimoku_cloud(bars).cache()
    base = whole.filter("not is_projected")
    for name in ("tenkan_sen", "kijun_sen", "chikou_span"):
        part = getattr(indicators, name)(bars, block_rows=block_rows)
        part = part.select("ticker", "time", name)
        assert part.exceptAll(base.select(*part.columns)).count() == 0, name
        assert part.count() == base.count()
    for name in ("senkou_span_a", "senkou_span_b"):
        part = getattr(indicators, name)(bars, block_rows=block_rows)
        part = part.select("ticker", "time", name, "is_projected")
        assert part.exceptAll(whole.select(*part.columns)).count() == 0, name
        assert part.count() == whole.count()
    longer = indicators.extend_horizon(bars, block_rows=block_rows)
    assert longer.exceptAll(whole.select(*longer.columns)).count() == 0
    assert longer.count() == whole.count()


def test_long_series_take_blocks(bars_of):
    bars = bars_of({"A": random_bars(random.Random(12), 300), "B": random_bars(random.Random(13), 10)})
    plain = ichimoku_cloud(bars)
    cut = ichimoku_cloud(bars, block_rows=100)
    assert "_block" in cut._jdf.queryExecution().toString()
    assert "_block" not in plain._jdf.queryExecution().toString()
    assert plain.exceptAll(cut).count() == 0 and cut.exceptAll(plain).count() == 0


def test_blocks_of_sparse_series_and_unknown_days(spark):
    """Rows far apart in time, some without a day: positions still follow the rows."""
    from trendcloud import schema

    rng = random.Random(14)
    rows = [
        ("A", date(1700, 1, 1) + timedelta(days=400 * i), 1.0, rng.random() + 1, rng.random(), 1.0 * i, 1)
        for i in range(200)
    ]
    rows += [("A", None, 1.0, 2.0 + i, 1.0, 1.0, 1) for i in range(3)]
    rows += [(None, *row[1:]) for row in rows[:50]]
    bars = spark.createDataFrame(rows, schema.BARS)
    params = CloudParams(3, 5, 4, 9, 6)
    plain, cut = ichimoku_cloud(bars, params), ichimoku_cloud(bars, params, block_rows=16)
    assert plain.count() == 209 + 56
    assert plain.exceptAll(cut).count() == 0 and cut.exceptAll(plain).count() == 0


def test_a_day_with_many_rows_is_spread_over_tasks(spark, tmp_path):
    """Positions follow the rows' order though one day of one series has nearly all rows."""
    from trendcloud.operators import blocks

    day = "date_add(date'2024-01-01', cast(if(id % 50 = 0, id % 400, 0) as int))"
    columns = ("'A' ticker", f"{day} time", "1D open", "cast(xxhash64(id) % 100000 as double) high", "0D low", "1D close", "1L volume")
    spark.range(100_000).selectExpr(*columns).write.parquet(str(tmp_path / "bars"))
    bars = spark.read.parquet(str(tmp_path / "bars"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the data are few
    try:
        numbered = blocks.numbered_rows(bars)
        shares = [r["count"] for r in numbered.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(shares) > 1 and max(shares) < 60_000
    rows = numbered.select("time", "high", blocks.POSITION, blocks.TOTAL).orderBy(blocks.POSITION).collect()
    assert [r[2] for r in rows] == list(range(100_000)) and {r[3] for r in rows} == {100_000}
    assert [r[:2] for r in rows] == sorted(r[:2] for r in rows)
    plan = blocks.split_series(bars, 1000, 100, 100)._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" not in plan, "the sorted rows are kept: the bars are read once"


def test_one_exchange_and_one_sort(bars_of, spark, tmp_path):
    bars_of({"A": random_bars(random.Random(15), 50)}).write.parquet(str(tmp_path / "bars"))
    bars = spark.read.parquet(str(tmp_path / "bars"))
    plan = ichimoku_cloud(bars)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "hashpartitioning(ticker" in plan
    assert plan.count("Sort [") == 1


def test_unused_columns_are_not_read(bars_of, spark, tmp_path):
    bars_of({"A": random_bars(random.Random(16), 50)}).write.parquet(str(tmp_path / "bars"))
    bars = spark.read.parquet(str(tmp_path / "bars"))
    df = ichimoku_cloud(bars).select("ticker", "time", "senkou_span_a")
    plan = df._jdf.queryExecution().executedPlan().toString()
    schema = plan[plan.index("ReadSchema") :]
    assert "volume" not in schema and "open" not in schema
