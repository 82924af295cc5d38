"""Cutting long series into blocks of rows that can be worked on apart.

Frames of the indicator are counted in rows, so a block needs the rows just
before and just after it, however far away in time they lie. Rows are sorted once,
by series, day and prices, with a range exchange: however many rows a series or
even one of its days has, they spread over tasks. A row's place in its task and the
counts of each series per task, summed up in the order of tasks, give its position
in the series, so nothing is numbered in one task. Only the rows near a block's
ends are copied to its neighbours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendcloud.sources.files import ensure_checkpoint_dir

POSITION = "_position"
BLOCK = "_block"
OWN = "_own"
TOTAL = "_total"
LAST = "_series_end"

#: Bits of a row's number in its task, in the ids that Spark gives.
ROW_BITS = 33


def row_order(columns: list[str]) -> list[Column]:
    """`time` first; prices only settle the order of rows that repeat a day."""
    return [F.col(c) for c in ("time", "high", "low", "close") if c in columns]


def _series() -> Column:
    # Rows without a ticker are a series too; as text they meet in a plain equi-join,
    # which shares its exchange with the numbering.
    return F.coalesce(F.col("ticker"), F.lit("\x00"))


def numbered_rows(bars: DataFrame) -> DataFrame:
    """Bars with `_series` and their position, `TOTAL` and `LAST` of the series.

    The sorted rows are checkpointed with their numbers, so the bars are read once
    and a task that runs again finds the same rows. Only rows that are equal in every
    column stay together whatever their number.
    """
    ensure_checkpoint_dir(bars.sparkSession)
    keyed = bars.withColumns({"_series": _series(), "_tie": F.xxhash64(*bars.columns)})
    order = ["_series", *row_order(bars.columns), "_tie"]
    ranged = keyed.repartitionByRange(*order).sortWithinPartitions(*order).drop("_tie")
    placed = ranged.withColumn("_id", F.monotonically_increasing_id()).checkpoint()
    placed = placed.withColumns({"_task": F.shiftright("_id", ROW_BITS), "_at": F.expr(f"_id & {(1 << ROW_BITS) - 1}L")})
    pieces = series_pieces(placed)
    position = F.col("_start") + F.col("_at") - F.col("_first")
    numbered = placed.join(pieces, ["_series", "_task"]).withColumn(POSITION, position)
    return numbered.drop("_id", "_task", "_at", "_first", "_start")


def series_pieces(placed: DataFrame) -> DataFrame:
    """Per series and task: its first row's number there and in the series, rows and last day of the series.

    There are no more of these than series and tasks together.
    """
    sizes = placed.groupBy("_series", "_task").agg(
        F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_size"), F.max("time").alias("_end")
    )
    order = Window.partitionBy("_series").orderBy("_task")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return sizes.select(
        "_series",
        "_task",
        "_first",
        (F.sum("_size").over(upto) - F.col("_size")).alias("_start"),
        F.sum("_size").over(whole).alias(TOTAL),
        F.max("_end").over(whole).alias(LAST),
    )


def split_series(bars: DataFrame, block_rows: int, before: int, after: int) -> DataFrame:
    """Give each row its block, and copies to the blocks whose windows reach it.

    Blocks are at least as long as the reach, so only the next and the previous
    block can need a row. Copies carry `_own = false`. Runs jobs when called.
    """
    size = max(block_rows, before, after, 1)
    numbered = numbered_rows(bars).drop("_series")
    block = F.expr(f"{POSITION} div {size}")
    offset = F.col(POSITION) % F.lit(size)
    targets = F.array_compact(
        F.array(
            block,
            F.when(
                (offset >= size - before) & (F.col(TOTAL) > (block + 1) * size), block + 1
            ),
            F.when((offset < after) & (block > 0), block - 1),
        )
    )
    home = numbered.withColumn("_home", block)
    copied = home.select("*", F.explode(targets).alias(BLOCK))
    return copied.withColumn(OWN, F.col(BLOCK) == F.col("_home")).drop("_home")
