"""The five-line indicator and its projected cloud.

A bar table holds every series; a series is the rows of one ticker in the order
of `time`. All lines come out of one exchange by ticker and one sort, which every
pass of the window operator shares. Bars are daily and `(ticker, time)` is a key, so a
series has at most one row per calendar day and fits a task; series that break
this (or are simply too long) take `block_rows`, see `blocks.py`.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from trendcloud.functions.columns import cloud_color, without_nan
from trendcloud.operators import blocks
from trendcloud.params import CloudParams, require_shift, require_window
from trendcloud.schema import LINES


@dataclass(frozen=True)
class Layout:
    """How rows are grouped for a window pass, and where a row stands in its series."""

    order: WindowSpec
    place: dict[str, Column]  # number of the row (from 1), rows in the series, its last day

    @staticmethod
    def by_series(columns: list[str]) -> Layout:
        order = Window.partitionBy("ticker").orderBy(*blocks.row_order(columns))
        whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        place = {
            "_row": F.row_number().over(order).cast("bigint"),
            "_rows": F.count(F.lit(1)).over(whole),
            "_last": F.max("time").over(whole),
        }
        return Layout(order, place)

    @staticmethod
    def by_block() -> Layout:
        order = Window.partitionBy("ticker", blocks.BLOCK).orderBy(blocks.POSITION)
        place = {
            "_row": F.col(blocks.POSITION) + 1,
            "_rows": F.col(blocks.TOTAL),
            "_last": F.col(blocks.LAST),
        }
        return Layout(order, place)


# Frames are walked row by row, so only short ones are used as they are; a longer
# window is put together from shorter ones that end on earlier rows.
FRAME_ROWS = 10
PIECES = 4


def _frame(bars: DataFrame, order: WindowSpec, n: int, also: dict[str, Column]) -> DataFrame:
    """Add `_high{n}` and `_low{n}` over the last n rows, NULL unless n whole rows are there."""
    frame = order.rowsBetween(-(n - 1), 0)
    whole = F.count(F.col("high") + F.col("low")).over(frame) == n
    return bars.withColumns(
        {
            f"_high{n}": F.when(whole, F.max("high").over(frame)),
            f"_low{n}": F.when(whole, F.min("low").over(frame)),
        }
        | also
    )


def _widen(df: DataFrame, order: WindowSpec, m: int, n: int) -> DataFrame:
    """Add `_high{n}` and `_low{n}` from windows of m rows, m < n.

    The last n rows are covered by windows of m rows ending on this row, m rows
    earlier and so on; highest and lowest do not mind that the last two overlap.
    """
    ends = [*range(0, n - m, m), n - m]

    def piece(side: str, end: int) -> str:
        return f"_{side}{m}_{end}" if end else f"_{side}{m}"

    added = {
        piece(side, end): F.lag(f"_{side}{m}", end).over(order)
        for side in ("high", "low")
        for end in ends
        if end
    }
    # High and low of a piece are NULL together.
    whole = reduce(lambda a, b: a & b, [F.col(piece("high", end)).isNotNull() for end in ends])
    wider = {
        f"_high{n}": F.when(whole, F.greatest(*[piece("high", end) for end in ends])),
        f"_low{n}": F.when(whole, F.least(*[piece("low", end) for end in ends])),
    }
    return df.withColumns(added).withColumns(wider).drop(*added)


def with_midpoints(
    bars: DataFrame,
    order: WindowSpec,
    lines: dict[str, int],
    also: dict[str, Column] | None = None,
) -> DataFrame:
    """Add each line of `lines`: (highest high + lowest low) / 2 of its last n rows.

    The current row is one of them. A line is NULL unless all n rows are there
    and none lacks its high or low. `also` are window expressions over the same
    order that share the first pass. All passes use one sort.
    """
    for name, n in lines.items():
        require_window(n, name)
    lengths = sorted(set(lines.values()))
    at = min(lengths[0], FRAME_ROWS)
    df = _frame(bars, order, at, also or {})
    for n in lengths:
        while n > at:
            longer = n if n <= PIECES * at else (PIECES - 1) * at
            df = _widen(df, order, at, longer)
            at = longer
    return df.withColumns(
        {
            name: (F.col(f"_high{n}") + F.col(f"_low{n}")) / F.lit(2.0)
            for name, n in lines.items()
        }
    )


def _lay_out(
    bars: DataFrame, block_rows: int | None, before: int, after: int
) -> tuple[DataFrame, Layout]:
    """Rows ready for window passes that reach `before` and `after` rows far."""
    bars = without_nan(bars)
    if block_rows is None:
        return bars, Layout.by_series(bars.columns)
    return blocks.split_series(bars, block_rows, before, after), Layout.by_block()


def _own(df: DataFrame) -> DataFrame:
    """Without the copies that blocks hold of their neighbours' rows."""
    return df.filter(F.col(blocks.OWN)) if blocks.OWN in df.columns else df


def _line(bars: DataFrame, name: str, n: int, block_rows: int | None) -> DataFrame:
    require_window(n, name)
    laid, layout = _lay_out(bars, block_rows, n - 1, 0)
    lined = with_midpoints(laid, layout.order, {name: n})
    return _own(lined).select(*bars.columns, name)


def tenkan_sen(bars: DataFrame, n: int = 9, block_rows: int | None = None) -> DataFrame:
    """The short midpoint."""
    return _line(bars, "tenkan_sen", n, block_rows)


def kijun_sen(bars: DataFrame, n: int = 26, block_rows: int | None = None) -> DataFrame:
    """The middle midpoint."""
    return _line(bars, "kijun_sen", n, block_rows)


def chikou_span(bars: DataFrame, n: int = 26, block_rows: int | None = None) -> DataFrame:
    """The close n rows ahead."""
    require_shift(n)
    laid, layout = _lay_out(bars, block_rows, 0, n)
    led = laid.withColumn("chikou_span", F.lead("close", n).over(layout.order))
    return _own(led).select(*bars.columns, "chikou_span")


def _project(df: DataFrame, shift: int, moved: dict[str, Column]) -> DataFrame:
    """Append `shift` rows per series, dated by calendar days after its last day.

    Each of the last `shift` rows of a series brings forth the projected row that
    lies `shift` rows after it, so a value moved that far is at hand where it is
    needed and the rows need no second sort. In a series shorter than `shift` the
    first row brings forth the days that no row reaches. Projected rows hold the
    `moved` values of the row they come from and are NULL otherwise.
    """
    row, rows, step = F.col("_row"), F.col("_rows"), F.col("_step")
    own_step = row + F.lit(shift) - rows
    reaches, starts_short = own_step >= 1, (row == 1) & (rows < shift)
    nothing = F.array().cast("array<bigint>")
    emitted = F.concat(
        F.array(F.lit(0).cast("bigint")),
        F.when(reaches, F.array(own_step)).otherwise(nothing),
        F.when(starts_short, F.sequence(F.lit(1).cast("bigint"), F.lit(shift) - rows)).otherwise(
            nothing
        ),
    )
    # Rows far from the end bring forth nothing; the outer explode keeps them as they are.
    stepped = df.select(
        "*", F.explode_outer(F.when(reaches | starts_short, emitted)).alias("_step")
    )
    projected = F.coalesce(step > 0, F.lit(False))
    kept = ("ticker", blocks.BLOCK, blocks.OWN)
    out = []
    for c in df.columns:
        value = F.col(c)
        if c == "time":
            value = F.when(projected, F.date_add("_last", step.cast("int"))).otherwise(value)
        elif c in moved:
            value = F.when(~projected, value).when(step == own_step, moved[c])
        elif c not in kept:
            value = F.when(~projected, value)
        out.append(value.alias(c))
    return stepped.select(*out, projected.alias("is_projected"))


def extend_horizon(
    bars: DataFrame, shift: int = 26, block_rows: int | None = None
) -> DataFrame:
    """The bars and, after each series, `shift` days of which only the date is known."""
    require_shift(shift)
    laid, layout = _lay_out(bars, block_rows, 0, 0)
    out = _project(laid.withColumns(layout.place), shift, {})
    return _own(out).select(*bars.columns, "is_projected")


def _moved(df: DataFrame, layout: Layout, shift: int, moved: dict[str, Column]) -> DataFrame:
    """The longer series with the `moved` values `shift` rows later."""
    valued = df.withColumns({f"_{name}": value for name, value in moved.items()})
    lagged = valued.withColumns(
        {name: F.lag(f"_{name}", shift).over(layout.order) for name in moved}
    )
    return _project(lagged, shift, {name: F.col(f"_{name}") for name in moved})


def senkou_span_a(
    bars: DataFrame,
    conversion_len: int = 9,
    base_len: int = 26,
    shift: int = 26,
    block_rows: int | None = None,
) -> DataFrame:
    """Mean of the two shorter midpoints, `shift` rows later."""
    require_shift(shift)
    before = max(conversion_len, base_len) - 1 + shift
    laid, layout = _lay_out(bars, block_rows, before, 0)
    lines = {"_conversion": conversion_len, "_base": base_len}
    lined = with_midpoints(laid, layout.order, lines, layout.place)
    out = _moved(lined, layout, shift, {"senkou_span_a": _mean("_conversion", "_base")})
    return _own(out).select(*bars.columns, "senkou_span_a", "is_projected")


def senkou_span_b(
    bars: DataFrame, n: int = 52, shift: int = 26, block_rows: int | None = None
) -> DataFrame:
    """The longest midpoint, `shift` rows later."""
    require_shift(shift)
    laid, layout = _lay_out(bars, block_rows, n - 1 + shift, 0)
    lined = with_midpoints(laid, layout.order, {"_leading": n}, layout.place)
    out = _moved(lined, layout, shift, {"senkou_span_b": F.col("_leading")})
    return _own(out).select(*bars.columns, "senkou_span_b", "is_projected")


def _mean(a: str, b: str) -> Column:
    return (F.col(a) + F.col(b)) / F.lit(2.0)


def ichimoku_cloud(
    bars: DataFrame, params: CloudParams = CloudParams(), block_rows: int | None = None
) -> DataFrame:
    """All five lines and the cloud colour; further columns pass through.

    Per series there are `cloud_shift` projected rows more than bars. With
    `block_rows` (here and in the single lines) a series is worked on in blocks
    of that many rows, each with copies of the few neighbours its windows reach,
    so that no task holds a whole series; the result is the same.
    """
    laid, layout = _lay_out(bars, block_rows, params.rows_before, params.rows_after)
    lines = {
        "tenkan_sen": params.conversion_len,
        "kijun_sen": params.base_len,
        "_leading": params.leading_span_b_len,
    }
    lead = F.lead("close", params.lagging_len).over(layout.order)
    lined = with_midpoints(laid, layout.order, lines, {"chikou_span": lead} | layout.place)
    moved = {
        "senkou_span_a": _mean("tenkan_sen", "kijun_sen"),
        "senkou_span_b": F.col("_leading"),
    }
    out = _own(_moved(lined, layout, params.cloud_shift, moved))
    color = cloud_color(F.col("senkou_span_a"), F.col("senkou_span_b"))
    return out.withColumn("cloud_color", color).select(
        *bars.columns, *LINES, "cloud_color", "is_projected"
    )


def cloud_parameters(cloud: DataFrame, params: CloudParams = CloudParams()) -> DataFrame:
    """One row: the number of rows of a result and the lengths it was made with."""
    echoed = [F.lit(value).cast("bigint").alias(name) for name, value in asdict(params).items()]
    return cloud.agg(F.count(F.lit(1)).alias("count")).select("count", *echoed)
