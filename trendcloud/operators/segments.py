"""What a segment of a request log does to any state, composed over many segments.

The state of a key is its last `limit` admitted instants a1 <= ... <= aL. The next
one admitted is the first request behind the last one and not before a1 + window;
so, counting requests at one instant as following each other, the u-th request that
a segment admits is

    max over the walks w of w(u)

where a walk lets requests in from an empty state on: one starts with the segment's
first request at u = 1, and for each am one with the first request not before
am + window, at u = m. That holds because "first request not before x + window"
keeps order and so commutes with the maximum.

A segment is therefore known completely by its walks from each instant of its first
window and from the one behind it: how many requests each lets in, and the last few of them. Two such tables
compose into that of both segments: every walk's last instants in the first are a
state in the second. At most `limit` requests lie between where two walks of the
same state end, so an answer of k instants needs k + limit of each walk.

`FAN` neighbouring segments become one, and these again, until a stretch has no more
than `FAN`: rounds grow with the logarithm of the segments. From the top, states are
then handed down, each a few look-ups in the tables. Tables are rows, one per walk,
and stream through the tasks; a task holds two tables at a time.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Segments that are composed into one in a round.
FAN = 16
#: Stands for an instant that is not there: before all others.
NONE = np.iinfo(np.int64).min

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def run_ends(columns: list[pa.Array], rows: int) -> list[int]:
    """Ends of the runs of equal rows."""
    change = np.zeros(rows, dtype=bool)
    for column in columns:
        codes = column.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        change[1:] |= codes[1:] != codes[:-1]
    return [*np.flatnonzero(change).tolist(), rows]


class Table:
    """Walks by their first instant: `entries`, ascending, the `counts` they let in, and the last `exits`."""

    def __init__(self, entries: np.ndarray, counts: np.ndarray, exits: np.ndarray):
        self.entries, self.counts, self.exits = entries, counts, exits


def segment_table(at: np.ndarray, requests: np.ndarray, limit: int, window: int, keep: int) -> Table:
    """The walks from every instant of the first window, and from the one behind it."""
    several = np.minimum(requests, limit)
    time = np.repeat(at, several)
    first = np.append(np.cumsum(several) - several, len(time))
    free = np.repeat(first[np.searchsorted(at, at + window)], several)
    entries = at[: np.searchsorted(at, at[0] + window) + 1]
    counts = np.zeros(len(entries), np.int64)
    last = np.full((len(entries), keep), NONE)
    admitted = np.zeros((len(entries), limit), np.int64)
    active, now, step = np.arange(len(entries)), first[: len(entries)].copy(), 0
    while len(active):
        last[active, step % keep] = time[now]
        admitted[active, step % limit] = now
        step += 1
        counts[active] = step
        now = now + 1
        if step >= limit:
            now = np.maximum(now, free[admitted[active, step % limit]])
        on = now < len(time)
        active, now = active[on], now[on]
    place = counts[:, None] - keep + np.arange(keep)
    exits = np.where(place >= 0, np.take_along_axis(last, place % keep, axis=1), NONE)
    return Table(entries, counts, exits)


def follow(table: Table, states: np.ndarray, limit: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Requests that a segment lets in after each of the `states`, and the last instants then.

    A state is a row: its last `limit` columns are what it is entered with, ascending,
    `NONE` first; as many columns come back.
    """
    n, width = states.shape
    keep = table.exits.shape[1]
    held = states[:, -limit:]
    there = held != NONE
    walk = np.searchsorted(table.entries, np.where(there, held + window, table.entries[0]))
    blocked = there & (walk == len(table.entries))
    walk = np.where(there & ~blocked, walk, 0)
    start = np.arange(1, limit + 1)
    ends = start + table.counts[walk] - 1
    ends = np.where(blocked, start - 1, np.where(there, ends, np.iinfo(np.int64).max))
    passed = np.minimum(ends.min(axis=1), table.counts[0])
    walk = np.concatenate([np.zeros((n, 1), np.int64), walk], axis=1)
    runs = np.concatenate([np.ones((n, 1), bool), there & ~blocked], axis=1)
    start = np.append(1, start)
    out = np.full((n, width), NONE)
    rows = np.arange(n)
    for back in range(width):
        u = passed - back
        old = width - 1 + u
        out[:, width - 1 - back] = np.where((u <= 0) & (old >= 0), states[rows, np.clip(old, 0, width - 1)], NONE)
        place = u[:, None] - start
        column = keep - table.counts[walk] + place
        known = runs & (place >= 0) & (u[:, None] > 0) & (column >= 0)
        value = np.where(known, table.exits[walk, np.clip(column, 0, keep - 1)], NONE).max(axis=1)
        out[:, width - 1 - back] = np.where(u > 0, value, out[:, width - 1 - back])
    return passed, out


_WALK = ["_entry", "_count", "_exits"]


def joined(whole: Table, table: Table, limit: int, window: int) -> Table:
    """The table of two neighbouring segments, with as many exits as the first one's.

    If the first is shorter than the window, walks start in the second as well.
    """
    keep = whole.exits.shape[1]
    passed, exits = follow(table, whole.exits, limit, window)
    counts = whole.counts + passed
    ends = whole.entries[0] + window
    if whole.entries[-1] >= ends:
        return Table(whole.entries, counts, exits)
    more = slice(0, int(np.searchsorted(table.entries, ends)) + 1)
    return Table(
        np.concatenate([whole.entries, table.entries[more]]),
        np.concatenate([counts, table.counts[more]]),
        np.concatenate([exits, table.exits[more, -keep:]]),
    )


def _rows(place: list[pa.Array], names: list[str], table: Table) -> pa.RecordBatch:
    """A table as rows, each with the place it has."""
    n, keep = table.exits.shape
    exits = pa.ListArray.from_arrays(pa.array(np.arange(0, n * keep + 1, keep, dtype=np.int32)), pa.array(table.exits.ravel()))
    where = [p.take(pa.array(np.zeros(n, np.int64))) for p in place]
    return pa.RecordBatch.from_arrays([*where, pa.array(table.entries), pa.array(table.counts), exits], names=[*names, *_WALK])


def _tables(batches: Iterator[pa.RecordBatch], names: list[str], width: int) -> Iterator[tuple[list[pa.Array], Table, pa.RecordBatch]]:
    """The tables of sorted rows, one after the other: their places, themselves, a row of theirs."""
    current, parts, place, row = None, [], [], None

    def table() -> Table:
        return Table(*(np.concatenate(x) for x in zip(*parts, strict=True)))

    for batch in batches:
        columns = [batch.column(c) for c in names]
        start = 0
        for end in run_ends(columns, batch.num_rows) if batch.num_rows else []:
            name = tuple(c[start].as_py() for c in columns)
            if name != current:
                if parts:
                    yield place, table(), row
                current, parts, place, row = name, [], [c.slice(start, 1) for c in columns], batch.slice(start, 1)
            exits = batch.column("_exits").slice(start, end - start).flatten().to_numpy().reshape(end - start, -1)
            parts.append((batch.column("_entry").to_numpy()[start:end], batch.column("_count").to_numpy()[start:end], exits[:, -width:]))
            start = end
    if parts:
        yield place, table(), row


def _sorted(rows: DataFrame, by: list[str], *order: str) -> DataFrame:
    return rows.repartition(*by).sortWithinPartitions(*by, *order)


def _kind(rows: DataFrame, names: list[str], *more: T.StructField) -> T.StructType:
    return T.StructType([*[rows.schema[c] for c in names], *more])


_WALK_FIELDS = (
    T.StructField("_entry", T.LongType()),
    T.StructField("_count", T.LongType()),
    T.StructField("_exits", T.ArrayType(T.LongType())),
)


def first_tables(placed: DataFrame, names: list[str], limit: int, window: int, keep: int) -> DataFrame:
    """The tables of segments; `placed` has their instants, `_at` and `_requests`."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, parts, place = None, [], []

        def close() -> pa.RecordBatch:
            at, requests = (np.concatenate(x) for x in zip(*parts, strict=True))
            return _rows(place, names, segment_table(at, requests, limit, window, keep))

        for batch in batches:
            columns = [batch.column(c) for c in names]
            start = 0
            for end in run_ends(columns, batch.num_rows) if batch.num_rows else []:
                name = tuple(c[start].as_py() for c in columns)
                if name != current:
                    if parts:
                        yield close()
                    current, parts, place = name, [], [c.slice(start, 1) for c in columns]
                parts.append((batch.column("_at").to_numpy()[start:end], batch.column("_requests").to_numpy()[start:end]))
                start = end
        if parts:
            yield close()

    ordered = _sorted(placed, names, "_at").select(*names, "_at", "_requests")
    return ordered.mapInArrow(build, _kind(placed, names, *_WALK_FIELDS))


def composed(tables: DataFrame, keys: list[str], limit: int, window: int, keep: int) -> DataFrame:
    """Tables of `FAN` neighbouring segments each, numbered anew, with `keep` exits."""
    names = [*keys, "_stretch", "_block"]

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, at = None, None
        for place, table, _ in _tables(batches, [*names, "_segment"], keep + limit):
            block = [p[0].as_py() for p in place[:-1]]
            if whole is not None and block == [p[0].as_py() for p in at]:
                whole = joined(whole, table, limit, window)
                continue
            if whole is not None:
                yield _rows(at, [*keys, "_stretch", "_segment"], whole)
            whole, at = Table(table.entries, table.counts, table.exits[:, -keep:]), place[:-1]
        if whole is not None:
            yield _rows(at, [*keys, "_stretch", "_segment"], whole)

    numbered = tables.withColumn("_block", F.expr(f"_segment div {FAN}"))
    kind = _kind(tables, [*keys, "_stretch", "_segment"], *_WALK_FIELDS)
    ordered = _sorted(numbered, names, "_segment", "_entry")
    return ordered.select(*names, "_segment", *_WALK).mapInArrow(compose, kind)


def handed_down(tables: DataFrame, states: DataFrame | None, keys: list[str], limit: int, window: int) -> DataFrame:
    """The states that segments are entered with (keys, _stretch, _segment, _state), but the first.

    `states` are those of blocks of `FAN` segments; without them a stretch is one block.
    """
    numbered = tables.withColumn("_block", F.expr(f"_segment div {FAN}") if states is not None else F.lit(0).cast("long"))
    if states is not None:
        known = states.select(*keys, "_stretch", F.col("_segment").alias("_block"), "_state")
        numbered = numbered.join(known, [*keys, "_stretch", "_block"], "left")
    else:
        numbered = numbered.withColumn("_state", F.array().cast("array<bigint>"))
    names = [*keys, "_stretch", "_block"]
    out = [*keys, "_stretch", "_segment", "_state"]

    def hand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, state = None, None
        for place, table, row in _tables(batches, [*names, "_segment"], 2 * limit):
            if block != (now := [p[0].as_py() for p in place[:-1]]):
                given = row.column("_state")[0].as_py() or []
                block, state = now, np.array([[NONE] * (limit - len(given)) + given], np.int64)
            _, state = follow(table, state, limit, window)
            kept = pa.array([[x for x in state[0].tolist() if x != NONE]], pa.list_(pa.int64()))
            number = pa.array([place[-1][0].as_py() + 1], pa.int64())
            yield pa.RecordBatch.from_arrays([*place[:-2], number, kept], names=out)

    ordered = _sorted(numbered, names, "_segment", "_entry")
    kind = _kind(tables, [*keys, "_stretch", "_segment"], T.StructField("_state", T.ArrayType(T.LongType())))
    return ordered.select(*names, "_segment", *_WALK, "_state").mapInArrow(hand, kind)


def rounds(segments: int) -> int:
    """Times that tables are composed for so many segments of a stretch."""
    count = 0
    while segments > FAN:
        segments, count = -(-segments // FAN), count + 1
    return count


def entering_states(placed: DataFrame, keys: list[str], limit: int, window: int) -> DataFrame:
    """(keys, _stretch, _segment, _state): what segments are entered with, but a stretch's first.

    `placed` has instants with `_requests`, `_stretch`, `_segment` (from 0) and
    `_last`, the number of the stretch's last segment, whose table nobody needs.
    Tables are checkpointed; runs jobs when called.
    """
    names = [*keys, "_stretch", "_segment"]
    most = placed.agg(F.max("_last")).first()[0] or 0
    height = rounds(most)
    levels = [first_tables(placed.filter("_segment < _last"), names, limit, window, (height + 2) * limit).checkpoint()]
    for level in range(height, 0, -1):
        levels.append(composed(levels[-1], keys, limit, window, (level + 1) * limit).checkpoint())
    states = None
    for tables in reversed(levels):
        states = handed_down(tables, states, keys, limit, window)
    return states.checkpoint()
