"""Cut passages that an earlier document already has, at the grain of word windows.

A window is `length` consecutive words. Three passes over the texts:

1. *Sketch.* Every window holds one anchor, the smallest hash among the shorter
   runs of words inside it, so equal windows have equal anchors and neighbouring
   windows mostly share one. Each task counts, in a count-min sketch of two rows,
   in how many of its documents an anchor occurs; the partial sketches are merged
   by ranges of cells. An anchor's estimate is never below the number of
   documents with any of its windows.
2. *Exact groups.* Only windows whose anchor is estimated in two or more documents
   are looked at, by a hash of 96 bits. What a task itself knows to be in a smaller
   document needs no more; of each window only the smallest document that the task
   has met goes on, so a passage in a third of all documents does not bring them
   together. The windows that go on are dealt out and their smallest document is
   found exactly. None that repeats is lost: the sketch only ever overestimates. A
   window estimated by mistake stands alone in its group and does nothing.
3. *Cut.* Covered words of each document meet its text again.

The merged sketch is the one thing sent to all tasks; its width follows the bytes
of the texts, which are summed up first, up to `MOST_CELLS` (two rows of 32 MB). Beyond
that more windows are estimated as repeated and pass 2 has more to do; its result
stays the same.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendcloud.llm.common import (
    WordCodes,
    bounded_batches,
    mix,
    offsets,
    pieces,
    ranges,
    shuffle_partitions,
    utf8,
    working_names,
)

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LENGTH = 50
#: Cells a row of the sketch has at least and at most (powers of two), and the bytes of text for each.
CELLS, MOST_CELLS, CELL_BYTES = 1 << 20, 1 << 28, 16
#: Cells whose counts one task merges at a time.
CHUNK = 1 << 20
#: Windows whose smallest document a task remembers.
MET = 1 << 17
#: Cells a task notes before it hands a partial sketch on.
NOTED = 1 << 22

_R = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_R_INVERSE = tuple(pow(r, -1, 1 << 64) for r in _R)


class Rolling:
    """Hashes of every run of words, from prefix sums modulo 2^64."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.sums, self.back = [], []
        for row, (r, inverse) in enumerate(zip(_R, _R_INVERSE, strict=True)):
            powers = np.cumprod(np.full(n + 1, r, np.uint64))
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(words[:, row] * powers[:n], out=sums[1:])
            self.sums.append(sums)
            self.back.append(np.cumprod(np.full(n + 1, inverse, np.uint64)))

    def of(self, length: int, row: int) -> np.ndarray:
        sums = self.sums[row]
        n = max(0, len(sums) - length)
        return mix((sums[length:] - sums[:n]) * self.back[row][:n])


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[: len(values) - size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def _windows(counts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each document's windows start among all words, whose they are, and their position."""
    per = np.maximum(counts - length + 1, 0)
    begins = offsets(counts)[:-1]
    where = ranges(begins, per)
    owner = np.repeat(np.arange(len(counts)), per)
    return where, owner, where - begins[owner]


def _anchors(rolling: Rolling, where: np.ndarray, length: int) -> np.ndarray:
    """The anchor of each window."""
    run = max(1, length // 2)
    lows = _sliding_min(rolling.of(run, 0), length - run + 1)
    return lows[where]


def _cells(anchors: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    shift = np.uint64(64 - (cells.bit_length() - 1))
    return anchors >> shift, mix(anchors ^ np.uint64(0xA5A5A5A5A5A5A5A5)) >> shift


def _sketch(length: int, cells: int):
    """Partial sketches: noted cells with their counts, in rows by chunk."""

    def handed_on(noted: list[np.ndarray]) -> pa.RecordBatch:
        cell, count = np.unique(np.concatenate(noted), return_counts=True)
        chunk, first = np.unique(cell // CHUNK, return_index=True)
        at = [*first.tolist(), len(cell)]
        offset = (cell % CHUNK).astype("<u4")
        twice = np.minimum(count, 2).astype(np.uint8)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(chunk.astype(np.int32)),
                pa.array([offset[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)], pa.binary()),
                pa.array([twice[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)], pa.binary()),
            ],
            names=["chunk", "cells", "counts"],
        )

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, noted, size = WordCodes(), [], 0
        for batch in pieces(batches, 256):
            words, counts = codes.hashes(utf8(batch.column(0)))
            where, owner, _ = _windows(counts, length)
            if not len(where):
                continue
            anchors = _anchors(Rolling(words), where, length)
            new = np.ones(len(anchors), bool)
            new[1:] = (anchors[1:] != anchors[:-1]) | (owner[1:] != owner[:-1])
            anchors, owner = anchors[new], owner[new]
            order = np.lexsort((anchors, owner))
            anchors, owner = anchors[order], owner[order]
            once = np.ones(len(anchors), bool)
            once[1:] = (anchors[1:] != anchors[:-1]) | (owner[1:] != owner[:-1])
            first, second = _cells(anchors[once], cells)
            noted += [first, second + np.uint64(cells)]
            size += 2 * len(first)
            if size > NOTED:
                yield handed_on(noted)
                noted, size = [], 0
        if noted:
            yield handed_on(noted)

    return sketch


def _merge_chunk(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bit per cell of a chunk: counted twice or more by all partial sketches together."""
    total = np.zeros(CHUNK, np.int32)
    for batch in batches:
        for cells, counts in zip(batch.column("cells").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            total[np.frombuffer(cells, "<u4")] += np.frombuffer(counts, np.uint8)
    bits = np.packbits(total >= 2, bitorder="little")
    yield pa.RecordBatch.from_arrays(
        [pa.array([key[0].as_py()], pa.int32()), pa.array([bits.tobytes()], pa.binary())],
        names=["chunk", "bits"],
    )


def repeated_cells(texts: DataFrame, length: int, cells: int) -> bytes:
    """The merged sketch, as a bit per cell of both rows: estimated in two documents or more."""
    partial = texts.mapInArrow(_sketch(length, cells), "chunk int, cells binary, counts binary")
    merged = partial.groupBy("chunk").applyInArrow(_merge_chunk, "chunk int, bits binary")
    bits = bytearray(2 * cells // 8)
    for row in merged.toLocalIterator():  # as many rows as there are chunks, of 128 KB each
        at = row["chunk"] * CHUNK // 8
        bits[at : at + CHUNK // 8] = row["bits"]
    return bytes(bits)


class _Smallest:
    """The smallest document a task has met of each window that came in several; forgets all beyond `MET`."""

    def __init__(self) -> None:
        self.high = np.zeros(0, np.uint64)
        self.low = np.zeros(0, np.uint32)
        self.ids = np.zeros(0, np.int64)

    def late(self, high: np.ndarray, low: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Which windows are known to be in a smaller document, of this batch or an earlier one."""
        order = np.lexsort((ids, low, high))
        h, l, i = high[order], low[order], ids[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (l[1:] != l[:-1])
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(h)))
        least = i[starts].copy()
        if len(self.high):
            at = np.minimum(np.searchsorted(self.high, h[starts]), len(self.high) - 1)
            met = (self.high[at] == h[starts]) & (self.low[at] == l[starts])
            least[met] = np.minimum(least[met], self.ids[at[met]])
        out = np.zeros(len(h), bool)
        out[order] = i > np.repeat(least, sizes)
        several = i[starts + sizes - 1] > least
        high = np.concatenate([h[starts][several], self.high])
        low = np.concatenate([l[starts][several], self.low])
        ids = np.concatenate([least[several], self.ids])
        # One entry per high half: another window with the same half is only met less often.
        self.high, first = np.unique(high, return_index=True)
        self.low, self.ids = low[first], ids[first]
        if len(self.high) > MET:
            self.__init__()
        return out


def _deal(length: int, cells: int, parts: int, sketch):
    """Windows estimated as repeated, in rows by part: owners, then hashes and positions.

    Rows without hashes hold windows that are known to be in a smaller document.
    """

    def rows_of(part, ids, marks, owner, position, high=None, low=None) -> pa.RecordBatch:
        order = np.argsort(part, kind="stable")  # owners stay together inside a part
        part, owner, position = part[order], owner[order], position[order]
        used, first = np.unique(part, return_index=True)
        at = [*first.tolist(), len(part)]
        rows: list[list] = [[], [], [], [], [], []]
        for a, b in zip(at, at[1:], strict=False):
            own, n = np.unique(owner[a:b], return_counts=True)
            packed = [ids[own].astype("<i8"), marks[own].astype("<i8"), n.astype("<u4")]
            packed += [x[order[a:b]] for x in (high, low)] if high is not None else [None, None]
            packed += [position[a:b].astype("<u4")]
            for column, values in zip(rows, packed, strict=True):
                column.append(None if values is None else values.tobytes())
        return pa.RecordBatch.from_arrays(
            [pa.array(used.astype(np.int32)), *(pa.array(r, pa.binary()) for r in rows)],
            names=["part", "ids", "marks", "counts", "high", "low", "position"],
        )

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, bits, smallest = WordCodes(), np.frombuffer(sketch.value, np.uint8), _Smallest()

        def repeated(cell: np.ndarray) -> np.ndarray:
            return (bits[cell >> np.uint64(3)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1 == 1

        for batch in pieces(batches, 1024):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            marks = batch.column(2).to_numpy(zero_copy_only=False)
            words, counts = codes.hashes(utf8(batch.column(1)))
            where, owner, position = _windows(counts, length)
            if not len(where):
                continue
            rolling = Rolling(words)
            anchors = _anchors(rolling, where, length)
            first, second = _cells(anchors, cells)
            keep = repeated(first)
            keep[keep] = repeated(second[keep] + np.uint64(cells))
            where, owner, position = where[keep], owner[keep], position[keep]
            if not len(where):
                continue
            high, low = rolling.of(length, 0)[where], rolling.of(length, 1)[where].astype(np.uint32)
            late = smallest.late(high, low, ids[owner])
            if late.any():
                # Nothing is to be found out about these: they go by document.
                part = mix(ids[owner[late]].view(np.uint64)) % np.uint64(parts)
                yield rows_of(part, ids, marks, owner[late], position[late])
            if not late.all():
                part = ((high[~late] >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
                yield rows_of(part, ids, marks, owner[~late], position[~late], high[~late], low[~late])

    return deal


def _read(batches: Iterator[pa.RecordBatch], columns: dict[str, str]) -> dict[str, np.ndarray]:
    """All rows of a partition: packed columns as arrays."""
    got: dict[str, list] = {c: [] for c in columns}
    for batch in batches:
        for c, kind in columns.items():
            got[c] += [np.frombuffer(x, kind) for x in batch.column(c).to_pylist()]
    return {c: np.concatenate([np.zeros(0, kind), *got[c]]) for c, kind in columns.items()}


def _by_bucket(buckets: int, ids: np.ndarray, marks: np.ndarray, owner: np.ndarray, position: np.ndarray) -> pa.RecordBatch:
    """Late windows in rows by document bucket."""
    bucket = mix(ids.view(np.uint64)) % np.uint64(buckets)
    order = np.lexsort((position, owner, bucket[owner]))
    owner, position = owner[order], position[order]
    used, first = np.unique(bucket[owner], return_index=True)
    at = [*first.tolist(), len(owner)]
    rows: list[list] = [[], [], [], []]
    for a, b in zip(at, at[1:], strict=False):
        own, _, n = np.unique(owner[a:b], return_index=True, return_counts=True)
        for column, values in zip(rows, (ids[own], marks[own], n.astype("<u4"), position[a:b]), strict=True):
            column.append(values.tobytes())
    return pa.RecordBatch.from_arrays(
        [pa.array(used.astype(np.int32)), *(pa.array(r, pa.binary()) for r in rows)],
        names=["bucket", "ids", "marks", "counts", "position"],
    )


def _judge(buckets: int):
    """Whole parts: windows that start in a smaller document too, in rows by document bucket."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"ids": "<i8", "marks": "<i8", "counts": "<u4", "high": "<u8", "low": "<u4", "position": "<u4"}
        asked = []
        for batch in batches:
            open_ = batch.column("high").is_valid()
            asked.append(batch.filter(open_))
            known = batch.filter(pa.compute.invert(open_))
            if known.num_rows:  # handed on as they are
                x = _read([known], {c: kinds[c] for c in ("ids", "marks", "counts", "position")})
                owner = np.repeat(np.arange(len(x["ids"])), x["counts"].astype(np.int64))
                yield _by_bucket(buckets, x["ids"], x["marks"], owner, x["position"])
        x = _read(asked, kinds)
        if not len(x["high"]):
            return
        counts = x["counts"].astype(np.int64)
        owner = np.repeat(np.arange(len(counts)), counts)
        order = np.lexsort((x["low"], x["high"]))
        high, low, owner, position = x["high"][order], x["low"][order], owner[order], x["position"][order]
        new = np.ones(len(high), bool)
        new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
        starts = np.flatnonzero(new)
        ids = x["ids"][owner]
        least = np.repeat(np.minimum.reduceat(ids, starts), np.diff([*starts, len(ids)]))
        late = ids > least
        if late.any():
            yield _by_bucket(buckets, x["ids"], x["marks"], owner[late], position[late])

    return judge


def _cover(length: int):
    """Whole buckets: the covered words of each document as (begin, end) pairs."""

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = _read(batches, {"ids": "<i8", "marks": "<i8", "counts": "<u4", "position": "<u4"})
        if not len(x["ids"]):
            return
        owner = np.repeat(np.arange(len(x["ids"])), x["counts"].astype(np.int64))
        ids, marks, position = x["ids"][owner], x["marks"][owner], x["position"].astype(np.int64)
        order = np.lexsort((position, marks, ids))
        ids, marks, position = ids[order], marks[order], position[order]
        other = np.ones(len(ids), bool)
        other[1:] = (ids[1:] != ids[:-1]) | (marks[1:] != marks[:-1])
        opens = other.copy()
        opens[1:] |= position[1:] > position[:-1] + length
        begin = np.flatnonzero(opens)
        end = np.append(begin[1:], len(ids)) - 1
        spans = np.stack([position[begin], position[end] + length], 1).astype("<u4")
        document = np.flatnonzero(other)
        first = np.searchsorted(begin, document)
        at = [*first.tolist(), len(begin)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(ids[document]),
                pa.array(marks[document]),
                pa.array([spans[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)], pa.binary()),
            ],
            names=["id", "mark", "spans"],
        )

    return cover


def sketch_cells(text_bytes: int) -> int:
    """Cells of a row of the sketch: as many are full however the texts are dealt out.

    About one anchor comes from 80 bytes of text. Every worker holds the sketch, so
    it must not be wide just because there are many partitions.
    """
    return min(MOST_CELLS, max(CELLS, 1 << (text_bytes // CELL_BYTES).bit_length()))


def covered_spans(docs: DataFrame, id_col: str, text_col: str, length: int = LENGTH) -> DataFrame:
    """(id, mark, spans): covered words of every document that has any; `mark` is xxhash64 of its text."""
    spark = docs.sparkSession
    bounded_batches(spark)
    n = shuffle_partitions(spark)
    chosen = docs.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")
    )
    cells = sketch_cells(chosen.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    sketch = spark.sparkContext.broadcast(repeated_cells(chosen.select("text"), length, cells))
    dealt = chosen.withColumn("mark", F.xxhash64("text")).mapInArrow(
        _deal(length, cells, 2 * n, sketch),
        "part int, ids binary, marks binary, counts binary, high binary, low binary, position binary",
    )
    judged = dealt.repartition(n, "part").mapInArrow(
        _judge(2 * n), "bucket int, ids binary, marks binary, counts binary, position binary"
    )
    return judged.repartition(n, "bucket").mapInArrow(_cover(length), "id long, mark long, spans binary")


_CUT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_removed", T.LongType()),
        T.StructField("kept_text", T.StringType()),
    ]
)


@F.arrow_udf(_CUT)
def _cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
    n_words, n_removed, kept = [], [], []
    for text, covered in zip(utf8(texts), spans.to_pylist(), strict=True):
        words = text.split()
        n = len(words)
        if covered:
            left, at = [], 0
            for begin, end in np.frombuffer(covered, "<u4").reshape(-1, 2).tolist():
                left += words[at:begin]
                at = end
            words = left + words[at:]
        n_words.append(n)
        n_removed.append(n - len(words))
        kept.append(b" ".join(words))
    arrays = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())]
    return pa.StructArray.from_arrays(
        [*arrays, pa.array(kept, pa.binary()).cast(pa.string())], ["n_words", "n_removed", "kept_text"]
    )


def cut_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH
) -> DataFrame:
    """The documents with n_words, n_removed and kept_text (the words left, joined by one space).

    A word goes if some window over it also starts in a document with a smaller
    id. Rows that share an id are one document and do not remove each other's
    words. Null texts read as empty; rows without an id lose nothing and remove
    nothing. Texts of any length are read whole; an empty table gives an empty
    one. Columns of the input named as the three added are replaced; all others,
    whatever their names, come back as they are.
    """
    spans = covered_spans(docs, id_col, text_col, length)
    added = ["n_words", "n_removed", "kept_text"]
    docs = docs.drop(*added)
    who, mark, covered, cut = working_names(docs, "id", "mark", "spans", "cut")
    left = docs.withColumns({who: F.col(id_col).cast("long"), mark: F.when(F.col(text_col).isNotNull(), F.xxhash64(text_col))})
    spans = spans.select(F.col("id").alias(who), F.col("mark").alias(mark), F.col("spans").alias(covered))
    met = left.join(spans, [who, mark], "left").withColumn(cut, _cut(F.col(text_col), F.col(covered)))
    return met.select(*docs.columns, *(F.col(f"{cut}.{c}").alias(c) for c in added))
