"""Ranked lexical search over K2-treaps of the term-document grid.

Documents are indexed in blocks. A block's grid has a row per term (frequent ones
first) and a column per document (in ascending id), and a cell per pair that occurs,
with its impact: what one unit of the term's weight adds to the document's score. A
quadtree cuts the grid into quarters down to single cells, K2-fashion: a byte tells
which quarters of a square hold anything, a quarter's place follows from counting
the bits before it, and a quarter with one cell is that cell, so no path is longer
than it has to be. Every quarter keeps the greatest impact in it.

A search walks the rows of an item's terms down together: a node is a range of
documents with the squares that its terms' rows have there, and its bound is the sum
of the squares' weighted maxima. Each item's queue gives up its best nodes first;
they are halved until single documents are left, whose bound is their score. A range
that cannot beat the item's last place so far is dropped. All items of a chunk go
down a block side by side, a bundle of nodes each, as array operations.

Blocks are rows of a Parquet table in the index folder. They are built where the
documents lie, without a shuffle, and searched one by one; only each task's best rows
meet in a shuffle.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from trendcloud.llm.common import bounded_batches, offsets, pieces, ranges, stored, utf8

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Places an item's result has.
PLACES = 20
#: A block is closed with the document that brings it to so many terms, or to so many documents.
BLOCK_TERMS = 1 << 21
BLOCK_DOCS = 1 << 16
#: Nodes that an item's queue gives up at a time.
BUNDLE = 24
#: Bytes of items that are searched for at a time, about.
CHUNK_BYTES = 8 << 20

#: Fixed: bytes of terms, A-Z in lower case; anything else in ASCII separates terms.
TERM_BYTES = bytes(
    ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else b if b >= 128 else 32 for b in range(256)
)
#: How many bits a byte's low four have.
BITS = np.array([bin(i).count("1") for i in range(16)], np.uint8)


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(TERM_BYTES).split()


def term_hash(term: bytes) -> int:
    return xxhash.xxh3_64_intdigest(term)


class _Codes(dict):
    """Numbers of terms in the order they are first seen."""

    def __missing__(self, term: bytes) -> int:
        code = self[term] = len(self)
        return code


def impacts(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """What a unit of weight adds for a term that occurs `tf` times in a document of this norm."""
    return (1_000_000_000 * tf) // (1000 * tf + 12 * norm)


def norms(lengths: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """The lengths' norms; whole numbers of any size in between."""
    return np.array([75 + 25 * int(n) * docs // terms for n in lengths], np.int64)


# The index


@dataclass(frozen=True)
class Treap:
    """A block's quadtree; squares and quarters by depth, then place.

    `masks` has a square's quarters as bits (2 x row half + column half), `first`
    the number of its first quarter, `peaks` every quarter's greatest impact,
    `single` whether a quarter is one cell, `square` and `cell` its number as a
    square or as a cell, `rows` and `columns` the cells' places.
    """

    depth: int
    masks: np.ndarray
    peaks: np.ndarray
    single: np.ndarray
    rows: np.ndarray
    columns: np.ndarray
    first: np.ndarray
    square: np.ndarray
    cell: np.ndarray


def treap(depth: int, masks: np.ndarray, peaks: np.ndarray, single: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> Treap:
    """The tree with the places that counting gives."""
    first = offsets(BITS[masks])[:-1]
    cells = np.cumsum(single)
    return Treap(depth, masks, peaks, single, rows, columns, first, np.arange(1, len(single) + 1) - cells, cells - 1)


def _spread(x: np.ndarray) -> np.ndarray:
    """The bits of 32-bit numbers, with a gap after each."""
    x = x.astype(np.uint64)
    for shift, mask in (
        (16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F),
        (2, 0x3333333333333333), (1, 0x5555555555555555),
    ):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


def build_treap(rows: np.ndarray, columns: np.ndarray, values: np.ndarray) -> Treap:
    """The tree of distinct cells (row, column) with their values."""
    if not len(rows):
        none = np.zeros(0, np.int64)
        return treap(1, np.zeros(1, np.uint8), none, none.astype(bool), none, none)
    depth = max(1, int(max(rows.max(), columns.max())).bit_length())
    key = (_spread(rows) << np.uint64(1)) | _spread(columns)
    order = np.argsort(key)
    key, values = key[order], values[order]
    place = order
    masks, peaks, single, cells = [], [], [], []
    squares = np.zeros(len(key), np.int64)  # the square of this depth that each point lies in
    count = 1
    for level in range(depth):
        shift = np.uint64(2 * (depth - 1 - level))
        prefix = key >> shift
        starts = np.flatnonzero(np.concatenate([[True], prefix[1:] != prefix[:-1]]))
        sizes = np.diff(np.append(starts, len(key)))
        mask = np.zeros(count, np.uint8)
        np.bitwise_or.at(mask, squares[starts], np.uint8(1) << (prefix[starts] & np.uint64(3)).astype(np.uint8))
        alone = sizes == 1
        masks.append(mask)
        peaks.append(np.maximum.reduceat(values, starts))
        single.append(alone)
        cells.append(place[starts[alone]])
        stay = np.repeat(~alone, sizes)
        count = int((~alone).sum())
        if not count:
            break
        squares = np.repeat(np.arange(count), sizes[~alone])
        key, values, place = key[stay], values[stay], place[stay]
    cell = np.concatenate(cells)
    return treap(depth, np.concatenate(masks), np.concatenate(peaks), np.concatenate(single), rows[cell], columns[cell])


def _packed(values: np.ndarray, kind: type) -> bytes:
    return zstandard.compress(np.ascontiguousarray(values, kind).tobytes(), 3)


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), kind)


BLOCKS = T.StructType(
    [
        T.StructField("depth", T.IntegerType()),
        *[T.StructField(c, T.BinaryType()) for c in ("terms", "frequencies", "masks", "peaks", "single", "rows", "columns")],
        T.StructField("ids", T.ArrayType(T.LongType())),
    ]
)


def _block(ids: list, texts: list[list[int]], codes: _Codes, docs: int, total: int) -> dict:
    """One row of the index: the documents' ids in order, the terms' hashes, and the tree."""
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i]))
    lengths = np.array([len(texts[i]) for i in order], np.int64)
    flat = np.concatenate([np.array(texts[i], np.int64) for i in order])
    column = np.repeat(np.arange(len(order)), lengths)
    pair, tf = np.unique(flat * len(order) + column, return_counts=True)
    code, column = np.divmod(pair, len(order))
    frequency = np.bincount(code, minlength=len(codes))
    by_frequency = np.argsort(-frequency, kind="stable")
    row_of = np.empty(len(codes), np.int64)
    row_of[by_frequency] = np.arange(len(codes))
    tree = build_treap(row_of[code], column, impacts(tf, norms(lengths, docs, total)[column]))
    hashes = np.fromiter(map(term_hash, codes), np.uint64, len(codes))
    return {
        "depth": tree.depth,
        "terms": _packed(hashes[by_frequency], np.uint64),
        "frequencies": _packed(frequency[by_frequency], np.uint32),
        "masks": _packed(tree.masks, np.uint8),
        "peaks": _packed(tree.peaks, np.uint32),
        "single": _packed(np.packbits(tree.single), np.uint8),
        "rows": _packed(tree.rows, np.uint32),
        "columns": _packed(tree.columns, np.uint16),
        "ids": [ids[i] for i in order],
    }


def write_index(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Index the whole texts of all documents that have a term, into the folder `path`.

    Null and empty texts have no terms. Repeated rows and ids are documents of their
    own, null ids too (they rank behind others of the same score). Other columns are
    not read. A document lies in one block, whatever its length.
    """
    bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    given = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = terms = 0
        for batch in pieces(batches, 128):
            for text in utf8(batch.column(1)):
                found = len(terms_of(text))
                n += found > 0
                terms += found
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([terms])], names=["docs", "terms"])

    sums = given.mapInArrow(count, "docs long, terms long").agg(F.sum("docs").alias("docs"), F.sum("terms").alias("terms"))
    row = sums.first()
    n, total = row["docs"] or 0, row["terms"] or 0
    kind = pa.schema([(f.name, pa.int32() if f.name == "depth" else pa.list_(pa.int64()) if f.name == "ids" else pa.binary()) for f in BLOCKS])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, codes, size = [], [], _Codes(), 0
        for batch in pieces(batches, 128):
            for id_, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                words = terms_of(text)
                if not words:
                    continue
                ids.append(id_)
                texts.append(np.fromiter(map(codes.__getitem__, words), np.int32, len(words)))
                size += len(words)
                if size >= BLOCK_TERMS or len(ids) >= BLOCK_DOCS:
                    yield pa.RecordBatch.from_pylist([_block(ids, texts, codes, n, total)], kind)
                    ids, texts, codes, size = [], [], _Codes(), 0
        if ids:
            yield pa.RecordBatch.from_pylist([_block(ids, texts, codes, n, total)], kind)

    given.mapInArrow(build, BLOCKS).write.mode("overwrite").parquet(f"{path}/blocks")
    note = json.dumps({"docs": n, "terms": total})
    spark.range(1).select(F.lit(note).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/totals")


# The search


@dataclass(frozen=True)
class Queries:
    """Items' terms: hashes and weights, those of item i from starts[i] to starts[i + 1]."""

    starts: np.ndarray
    hashes: np.ndarray
    weights: np.ndarray


class Best:
    """Each item's best documents so far."""

    def __init__(self, items: int, places: int):
        self.places = places
        self.item = self.score = self.id = np.zeros(0, np.int64)
        self.known = np.zeros(0, bool)
        self.least = np.zeros(items, np.int64)
        self.last = np.full(items, np.iinfo(np.int64).max)
        self.last_known = np.zeros(items, bool)

    def add(self, item: np.ndarray, score: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        """Documents with their scores; ids that are not `known` rank behind all others."""
        self.item = np.concatenate([self.item, item])
        self.score = np.concatenate([self.score, score])
        self.id = np.concatenate([self.id, ids])
        self.known = np.concatenate([self.known, known])
        order = np.lexsort((self.id, ~self.known, -self.score, self.item))
        sizes = np.bincount(self.item, minlength=len(self.least))
        ends = offsets(sizes)
        rank = np.arange(len(order)) - ends[self.item[order]]
        kept = order[rank < self.places]
        full = np.flatnonzero(sizes >= self.places)
        last = order[ends[full] + self.places - 1]
        self.least[full], self.last[full], self.last_known[full] = self.score[last], self.id[last], self.known[last]
        self.item, self.score, self.id, self.known = (x[kept] for x in (self.item, self.score, self.id, self.known))

    def may_enter(self, item: np.ndarray, bound: np.ndarray, ids: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Whether a document from `ids` on, of a score of at most `bound`, can take a place."""
        full = self.least[item] > 0
        before = (known & ~self.last_known[item]) | ((known == self.last_known[item]) & (ids < self.last[item]))
        return (bound > 0) & (~full | (bound > self.least[item]) | ((bound == self.least[item]) & before))


def _chosen(item: np.ndarray, bound: np.ndarray, column: np.ndarray) -> np.ndarray:
    """The best `BUNDLE` nodes of each item's queue: greatest bounds, then first documents."""
    order = np.lexsort((column, -bound, item))
    sorted_item = item[order]
    first = np.flatnonzero(np.concatenate([[True], sorted_item[1:] != sorted_item[:-1]]))
    rank = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    chosen = np.zeros(len(item), bool)
    chosen[order[rank < BUNDLE]] = True
    return chosen


def search_block(tree: Treap, terms: np.ndarray, ids: np.ndarray, known: np.ndarray, queries: Queries, best: Best) -> None:
    """Let a block's documents take their places among each item's best.

    A node's paths are rows of its terms: the number of the square (or of the cell,
    as -1 - number) that the row has in the node's columns, and what it may add.
    """
    by_hash = np.argsort(terms)
    at = np.searchsorted(terms, queries.hashes, sorter=by_hash)
    found = at < len(terms)
    row = by_hash[np.minimum(at, len(terms) - 1)]
    found &= terms[row] == queries.hashes
    item_of = np.repeat(np.arange(len(queries.starts) - 1), np.diff(queries.starts))
    item_of, row, weight = item_of[found], row[found], queries.weights[found]
    items, counts = np.unique(item_of, return_counts=True)
    if not len(items):
        return
    # The root: all columns, and the one square there is.
    node = {"item": items, "column": np.zeros(len(items), np.int64), "level": np.zeros(len(items), np.int64)}
    node["bound"] = np.full(len(items), np.iinfo(np.int64).max)
    start, size = offsets(counts)[:-1], counts
    path_row, path_weight, path_at = row, weight, np.zeros(len(row), np.int64)
    path_peak = np.zeros(len(row), np.int64)
    while len(node["item"]):
        chosen = _chosen(node["item"], node["bound"], node["column"])
        took = ranges(start[chosen], size[chosen])
        p_node = np.repeat(np.arange(int(chosen.sum())), size[chosen])
        p_row, p_weight, p_at, p_peak = path_row[took], path_weight[took], path_at[took], path_peak[took]
        level, column, item = node["level"][chosen], node["column"][chosen], node["item"][chosen]
        shift = tree.depth - 1 - level
        # Halve the chosen nodes: where each path goes in the left and in the right half.
        sides = []
        inner = p_at >= 0
        square = np.where(inner, p_at, 0)
        cell = np.where(inner, 0, -1 - p_at)
        half = (p_row >> shift[p_node]) & 1
        own = (tree.columns[cell].astype(np.int64) >> shift[p_node]) & 1 if len(tree.columns) else half
        for side in (0, 1):
            quarter = (2 * half + side).astype(np.uint8)
            mask = tree.masks[square]
            there = (mask >> quarter) & 1 == 1
            child = np.where(inner & there, tree.first[square] + BITS[mask & ((np.uint8(1) << quarter) - np.uint8(1))], 0)
            single = tree.single[child]
            same = ~single | (tree.rows[np.where(single, tree.cell[child], 0)] == p_row)
            goes = np.where(inner, there & same, own == side)
            now = np.where(inner, np.where(single, -1 - tree.cell[child], tree.square[child]), p_at)
            peak = np.where(inner, tree.peaks[child], p_peak)
            bound = np.bincount(p_node[goes], (peak * p_weight)[goes].astype(float), len(item)).astype(np.int64)
            sides.append((goes, now, peak, bound, column + (side << shift)))
        # What was not chosen stays in the queue, if it can still take a place.
        stay = ~chosen
        left = ranges(start[stay], size[stay])
        parts = [(node["item"][stay], node["column"][stay], node["level"][stay], node["bound"][stay], size[stay],
                  path_row[left], path_weight[left], path_at[left], path_peak[left])]
        for goes, now, peak, bound, new_column in sides:
            real = bound > 0
            leaf = real & (level == tree.depth - 1)
            if leaf.any():
                at = new_column[leaf]
                best.add(item[leaf], bound[leaf], ids[at], known[at])
            real &= ~leaf
            kept = goes & real[p_node]
            number = np.bincount(p_node[kept], minlength=len(item))[real]
            parts.append((item[real], new_column[real], level[real] + 1, bound[real], number,
                          p_row[kept], p_weight[kept], now[kept], peak[kept]))
        joined = [np.concatenate([p[i] for p in parts]) for i in range(9)]
        first = np.minimum(joined[1], len(ids) - 1)
        may = best.may_enter(joined[0], joined[3], ids[first], known[first])
        begin = offsets(joined[4])[:-1]
        rest = ranges(begin[may], joined[4][may])
        node = {"item": joined[0][may], "column": joined[1][may], "level": joined[2][may], "bound": joined[3][may]}
        size = joined[4][may]
        start = offsets(size)[:-1]
        path_row, path_weight, path_at, path_peak = (joined[i][rest] for i in (5, 6, 7, 8))


def _tree_of(batch: pa.RecordBatch, at: int) -> Treap:
    read = lambda name, kind: _unpacked(batch.column(name)[at].as_py(), kind)
    peaks = read("peaks", np.uint32).astype(np.int64)
    single = np.unpackbits(read("single", np.uint8), count=len(peaks)).astype(bool)
    return treap(
        batch.column("depth")[at].as_py(), read("masks", np.uint8), peaks, single,
        read("rows", np.uint32).astype(np.int64), read("columns", np.uint16),
    )


def search_index(
    spark: SparkSession,
    path: str,
    items: DataFrame,
    places: int = PLACES,
    id_col: str = "item_id",
    text_col: str = "text",
    result_col: str = "doc_id",
) -> DataFrame:
    """Each item's best documents: (id_col, rank, result_col, score), equal scores by ascending id.

    Only documents with a score above 0 are found; an item without terms, as with a
    null or empty text, has none. Rows with the same id and text are one item; other
    rows that share an id are ranked apart. Items are searched for in chunks of
    bounded size, each over the whole index; other columns are not read. Runs jobs
    when called.
    """
    totals = json.loads(spark.read.text(f"{path}/totals").first()["value"])
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    given = items.select(F.col(id_col).alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).distinct()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 512):
            keys, terms, times, row = [], [], [], []
            for i, text in enumerate(utf8(batch.column(1))):
                found: dict[bytes, int] = {}
                for term in terms_of(text):
                    found[term] = found.get(term, 0) + 1
                key = xxhash.xxh3_64_intdigest(repr(batch.column(0)[i].as_py()).encode() + b"\x00" + text)
                row += [i] * len(found)
                keys += [key - (1 << 63)] * len(found)
                terms += [term_hash(t) - (1 << 63) for t in found]
                times += found.values()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(keys, pa.int64()), pa.array(terms, pa.int64()), pa.array(times, pa.int64())],
                names=["item", "key", "term", "times"],
            )

    kind = T.StructType([given.schema["item"], *[T.StructField(c, T.LongType()) for c in ("key", "term", "times")]])
    asked = stored(given.mapInArrow(split, kind), "asked")
    rows = asked.count()
    chunks = max(1, -(-rows * 24 // CHUNK_BYTES))
    out = T.StructType([given.schema["item"], T.StructField("key", T.LongType()), T.StructField("id", T.LongType()), T.StructField("score", T.LongType())])
    results = spark.createDataFrame([], out)
    for chunk in range(chunks):
        part = asked.filter(F.pmod("key", F.lit(chunks)) == chunk)
        results = results.unionByName(_search(blocks, _weighted(blocks, part, totals["docs"]), places, out))
    order = Window.partitionBy("item", "key").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    ranked = results.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= places)
    return ranked.select(F.col("item").alias(id_col), "rank", F.col("id").alias(result_col), "score")


def _weighted(blocks: DataFrame, asked: DataFrame, docs: int) -> DataFrame:
    """(item, key, term, weight) of a chunk's terms that documents have; reads the blocks' term lists only."""
    wanted = np.array(sorted(r["term"] for r in asked.select("term").distinct().collect()), np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                terms = _unpacked(batch.column(0)[i].as_py(), np.uint64)
                terms = (terms ^ np.uint64(1 << 63)).view(np.int64)
                at = np.minimum(np.searchsorted(wanted, terms), max(len(wanted) - 1, 0))
                hit = wanted[at] == terms if len(wanted) else np.zeros(len(terms), bool)
                np.add.at(total, at[hit], _unpacked(batch.column(1)[i].as_py(), np.uint32)[hit].astype(np.int64))
        some = total > 0
        yield pa.RecordBatch.from_arrays([pa.array(wanted[some]), pa.array(total[some])], names=["term", "df"])

    counted = blocks.select("terms", "frequencies").mapInArrow(count, "term long, df long")
    frequency = counted.groupBy("term").agg(F.sum("df").alias("df"))
    ratio = F.lit(2.0 * docs + 2) / (2 * F.col("df") + 1)
    weight = F.floor(1000 * F.log(ratio)).cast("long") * F.col("times")
    return asked.join(frequency, "term").select("item", "key", "term", weight.alias("weight"))


def _search(blocks: DataFrame, weighted: DataFrame, places: int, kind: T.StructType) -> DataFrame:
    rows = weighted.filter("weight > 0").collect()  # a chunk's terms, bounded by its size
    names = {r["key"]: r["item"] for r in rows}
    number = {key: i for i, key in enumerate(sorted(names))}
    rows.sort(key=lambda r: number[r["key"]])
    counts = np.bincount([number[r["key"]] for r in rows], minlength=len(number)) if rows else np.zeros(0, np.int64)
    hashes = (np.array([r["term"] for r in rows], np.int64).view(np.uint64)) ^ np.uint64(1 << 63)
    queries = Queries(offsets(counts), hashes, np.array([r["weight"] for r in rows], np.int64))
    keys = sorted(names)
    items = [names[k] for k in keys]
    schema = to_arrow_schema(kind)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(keys), places)
        for batch in batches:
            for i in range(batch.num_rows if keys else 0):
                column = batch.column("ids")[i].values
                ids = column.fill_null(0).to_numpy()
                known = column.is_valid().to_numpy(zero_copy_only=False)
                terms = _unpacked(batch.column("terms")[i].as_py(), np.uint64)
                search_block(_tree_of(batch, i), terms, ids, known, queries, best)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([items[i] for i in best.item], schema.field("item").type),
                pa.array([keys[i] for i in best.item], pa.int64()),
                pa.array(best.id, pa.int64(), mask=~best.known),
                pa.array(best.score, pa.int64()),
            ],
            names=kind.names,
        )

    return blocks.mapInArrow(search, kind)
