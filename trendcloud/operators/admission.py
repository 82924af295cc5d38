"""Sliding-window admission: who would have been let in.

A request is let in unless `limit` requests of its key were let in during the
last `window` seconds; refused requests do not count. Each verdict hangs on the
ones before it, which no window frame expresses, so a short Python state (the
last `limit` admitted instants) walks over sorted rows. What is walked is kept
small and cut up first:

* requests of one key at one instant are counted before the shuffle, and the
  walk decides how many of them pass, so the log itself never goes to Python;
* a key with few instants is one walk. A longer one is cut: a quiet spell of at
  least the window clears the state, so stretches between quiet spells are walked
  apart from each other, and a stretch without one is cut into segments of bounded
  size, each walked once from the state it is entered with;
* these states come from composing what segments do to any state (`segments.py`),
  in rounds that grow with the logarithm of a stretch's segments;
* a walk streams over Arrow batches and leaps over refused instants; it never
  holds a key, a stretch or a segment in memory.

The counted instants are checkpointed, so the log is read once for them; the
operators here therefore run jobs when they are called.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendcloud.operators.segments import entering_states, run_ends
from trendcloud.sources.files import ensure_checkpoint_dir

LIMIT = 5
WINDOW_SECONDS = 60
#: Instants of a segment, about: a slice of one window's length is never cut.
SEGMENT_ROWS = 1 << 18

# The walk travels to the workers with its helpers, so they need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Admission:
    """The state of one key: its last `limit` admitted instants."""

    def __init__(self, limit: int, window: int, admitted: Sequence[int] = ()):
        self.limit = limit
        self.window = window
        self.admitted = list(admitted)

    def admit(self, at: np.ndarray, requests: np.ndarray) -> np.ndarray:
        """How many of the requests at each of the ascending instants are let in."""
        if not self.admitted and requests.sum() <= self.limit:
            # Too few to reach the limit, however close together.
            self.admitted = np.repeat(at, requests).tolist()
            return requests.astype(np.int64)
        out = np.zeros(len(at), dtype=np.int64)
        i = 0
        while i < len(at):
            now = int(at[i])
            live = [t for t in self.admitted if now - t < self.window]
            free = self.limit - len(live)
            if free > 0:
                out[i] = min(free, int(requests[i]))
                live += [now] * int(out[i])
                i += 1
            else:
                # Full: nothing passes before the oldest one leaves the window.
                i = max(i + 1, int(np.searchsorted(at, live[0] + self.window, side="left")))
            self.admitted = live
        return out


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def check_rule(limit: int, window_seconds: int) -> None:
    if limit < 1 or window_seconds < 1:
        raise ValueError("limit and window must be at least 1")


def _segments(instants: DataFrame, keys: list[str], window: int, rows: int) -> DataFrame:
    """(keys, _slice, _stretch, _segment, _last) of every slice of one window's length that has instants.

    Instants of different stretches do not affect each other: instants at least a
    window apart never share a slice, so quiet spells are found from the first and
    last instant of each. A stretch is cut where its counts pass `rows`; segments
    are numbered from 0 and `_last` is the stretch's last number. These are small
    rows, one per key and slice.
    """
    spans = instants.groupBy(*keys, "_slice").agg(
        F.min("_at").alias("_begin"), F.max("_at").alias("_end"), F.count(F.lit(1)).alias("_rows")
    )
    order = Window.partitionBy(*keys).orderBy("_slice")
    quiet = F.col("_begin") - F.lag("_end").over(order) >= window
    marked = spans.withColumn("_opens", F.when(F.coalesce(quiet, F.lit(True)), F.col("_slice")))
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stretched = marked.withColumn("_stretch", F.max("_opens").over(upto))
    stretch = Window.partitionBy(*keys, "_stretch")
    inside = stretch.orderBy("_slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = stretched.withColumn("_before", F.sum("_rows").over(inside) - F.col("_rows"))
    cut = cut.withColumn("_part", F.expr(f"_before div {rows}"))
    numbered = cut.withColumn("_segment", F.dense_rank().over(stretch.orderBy("_part")).cast("long") - 1)
    return numbered.select(*keys, "_slice", "_stretch", "_segment", F.max("_segment").over(stretch).alias("_last"))


def _walk(rows: DataFrame, names: list[str], limit: int, window: int) -> DataFrame:
    """Instants with `_admitted`; rows of the same `names` are one walk, in order of `_at`.

    `rows` has `_state`, the admitted instants that a walk starts from.
    """
    ordered = rows.repartition(*names).sortWithinPartitions(*names, "_at")
    given = ordered.select(*names, "_at", "_requests", "_state")
    kind = T.StructType(
        [
            *[T.StructField(c, given.schema[c].dataType) for c in (*names, "_at", "_requests")],
            T.StructField("_admitted", T.LongType()),
        ]
    )

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: tuple | None = None
        state = Admission(limit, window)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            at = batch.column("_at").to_numpy()
            requests = batch.column("_requests").to_numpy()
            columns = [batch.column(c) for c in names]
            admitted = np.zeros(batch.num_rows, dtype=np.int64)
            start = 0
            for end in run_ends(columns, batch.num_rows):
                name = tuple(c[start].as_py() for c in columns)
                if name != current:
                    current = name
                    state = Admission(limit, window, batch.column("_state")[start].as_py() or ())
                admitted[start:end] = state.admit(at[start:end], requests[start:end])
                start = end
            yield pa.RecordBatch.from_arrays(
                [*columns, batch.column("_at"), batch.column("_requests"), pa.array(admitted)],
                names=[*names, "_at", "_requests", "_admitted"],
            )

    return given.mapInArrow(walk, kind)


def admitted_instants(
    log: DataFrame,
    keys: Sequence[str],
    ts: str,
    limit: int = LIMIT,
    window_seconds: int = WINDOW_SECONDS,
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Per key and instant: `_requests` there were and `_admitted` that were let in.

    Keys of at most `segment_rows` instants are walked whole; only longer ones are
    cut into stretches and segments.
    """
    check_rule(limit, window_seconds)
    keys = list(keys)
    spark = log.sparkSession
    ensure_checkpoint_dir(spark)
    window = window_seconds * 1_000_000
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*keys, ts)])
    timed = log.filter(known).select(*keys, _micros(ts).alias("_at"))
    instants = timed.groupBy(*keys, "_at").agg(F.count(F.lit(1)).alias("_requests")).checkpoint()
    result = [*keys, "_at", "_requests", "_admitted"]
    none = F.array().cast("array<bigint>")
    long = instants.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > segment_rows)
    long = long.select(*keys).checkpoint()
    if not long.limit(1).count():
        return _walk(instants.withColumn("_state", none), keys, limit, window).select(*result)
    short = instants.join(long, keys, "left_anti").withColumn("_state", none)
    walked = _walk(short, keys, limit, window).select(*result)

    slice_ = F.expr(f"(_at - pmod(_at, {window}L)) div {window}L")
    instants = instants.join(long, keys, "left_semi").withColumn("_slice", slice_)
    segments = _segments(instants, keys, window, segment_rows).checkpoint()
    names = [*keys, "_stretch", "_segment"]
    placed = instants.join(segments, [*keys, "_slice"]).drop("_slice")
    states = entering_states(placed, keys, limit, window)
    started = placed.drop("_last").join(states, names, "left").withColumn("_state", F.coalesce("_state", none))
    return walked.unionByName(_walk(started, names, limit, window).select(*result))


def admission_audit(
    log: DataFrame,
    keys: Sequence[str],
    ts: str,
    limit: int = LIMIT,
    window_seconds: int = WINDOW_SECONDS,
    order_by: Sequence[str] = (),
) -> DataFrame:
    """The log with `admitted`; NULL for requests without a time or a key.

    `order_by` orders requests of one key at one instant. Numbering them and
    meeting the verdicts use one exchange of the log, by key and instant; requests
    that are not judged are spread over all tasks.
    """
    keys = list(keys)
    verdicts = admitted_instants(log, keys, ts, limit, window_seconds)
    order = [F.col(c) for c in order_by] or [F.xxhash64(*log.columns)]
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*keys, ts)])
    # A constant for judged requests, so their place is settled by key and instant alone.
    spread = F.when(known, F.lit(0).cast("bigint")).otherwise(F.pmod(F.xxhash64(*log.columns), F.lit(1 << 20)))
    at_once = Window.partitionBy(*keys, "_at", "_spread").orderBy(*order)
    numbered = log.withColumns({"_at": _micros(ts), "_spread": spread})
    numbered = numbered.withColumn("_n", F.row_number().over(at_once))
    joined = numbered.join(verdicts.withColumn("_spread", F.lit(0).cast("bigint")), [*keys, "_at", "_spread"], "left")
    return joined.select(*log.columns, (F.col("_n") <= F.col("_admitted")).alias("admitted"))


def admission_summary(
    log: DataFrame,
    keys: Sequence[str],
    ts: str,
    limit: int = LIMIT,
    window_seconds: int = WINDOW_SECONDS,
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Requests let in and refused per key, from the counted instants alone.

    Requests without a time or a key are not judged and not counted.
    """
    verdicts = admitted_instants(log, keys, ts, limit, window_seconds, segment_rows)
    return verdicts.groupBy(*keys).agg(
        F.sum("_requests").alias("requests"),
        F.sum("_admitted").alias("admitted"),
        (F.sum("_requests") - F.sum("_admitted")).alias("refused"),
    )
