"""Documents whose sets of word n-grams overlap by a given Jaccard similarity, and their groups.

The incidence matrix (document by n-gram) is multiplied with itself in blocks,
and what cannot reach the similarity is discarded as early as its size tells:

1. *Column blocks.* Incidences are dealt out by ranges of n-gram hashes, packed,
   one row per batch of documents and block. Documents of one task with the same
   set send it once, so not even a set held by a third of all documents makes a
   block large. A column met by one set alone cannot overlap with anything and is
   dropped there; the others go back to their sets with the column's frequency.
2. *Size bound.* A linked pair shares at least 80 % of either set, so a set of
   which fewer of its columns are shared by any other is done. What is left are
   the near copies.
3. *Candidates.* Ordered from rare to frequent, two linked sets share one of
   their first n - ceil(0.8 n) + 1 columns, and their sizes lie within 80 % of each
   other, so in one size band or two that meet. Sets that share a column within
   such bands, directly or by way of others, form a cluster.
4. *Blocked product.* A cluster is one tile, or, if it is too large, one for each
   pair of its blocks whose bands meet. A tile accumulates overlaps a row at a time,
   against those sets of a size that can be linked which are not linked yet. It hands
   on one link per set, never all pairs.
5. Links between tiles meet as connected components, and every document gets the
   smallest id of its group.

N-grams and sets are told apart by 64-bit hashes (n-grams by 48 bits and the
number of their block).
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendcloud.llm.common import (
    WordCodes,
    bounded_batches,
    mix,
    offsets,
    pieces,
    ranges,
    shuffle_partitions,
    stored,
    utf8,
    working_names,
)
from trendcloud.llm.components import components

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WORDS, PERCENT = 5, 80
#: Sets and incidences of one tile; larger clusters are cut into more tiles.
TILE_SETS, TILE_INCIDENCES = 4096, 4 << 20

_PACKED = "kind int, keys binary, sizes binary, counts binary, cols binary, freq binary, ids binary, nulls binary"
_KINDS = {"keys": "<i8", "sizes": "<i4", "counts": "<u2", "freq": "<u2", "ids": "<i8", "nulls": "u1"}


def shingle_sets(words: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of every document's word n-grams, and how many each has.

    A document of fewer words has one, its whole sequence; without words it has none.
    """
    factors = np.cumprod(np.full(size, 0x9E3779B97F4A7C15, np.uint64))
    begins = offsets(counts)[:-1]
    per = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    where, owner = ranges(begins, per), np.repeat(np.arange(len(counts)), per)
    short = counts[owner] < size
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    hashes = np.zeros(len(where), np.uint64)
    for j in range(size):
        inside = ~short | (j < counts[owner])
        hashes += np.where(inside, padded[where + j] * factors[j], np.uint64(0))
    hashes = mix(hashes + np.where(short, counts[owner], 0).astype(np.uint64))
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], np.bincount(owner[new], minlength=len(counts))


def _rows(kind: int, name: str, into: np.ndarray, columns: dict[str, list[bytes]]) -> pa.RecordBatch:
    n = len(into)
    given = {c: pa.array(columns[c], pa.binary()) if c in columns else pa.nulls(n, pa.binary()) for c in (*_KINDS, "cols")}
    order = ["keys", "sizes", "counts", "cols", "freq", "ids", "nulls"]
    return pa.RecordBatch.from_arrays(
        [pa.array(into.astype(np.int32)), pa.array([kind] * n, pa.int32()), *(given[c] for c in order)],
        names=[name, "kind", *order],
    )


def _split(into: np.ndarray, **columns: np.ndarray) -> tuple[np.ndarray, dict[str, list[bytes]]]:
    """Columns packed by the (ascending) row they go to."""
    used, first = np.unique(into, return_index=True)
    at = [*first.tolist(), len(into)]
    return used, {
        c: [v[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)] for c, v in columns.items()
    }


def _runs(owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal neighbours as (owner, count) with counts of two bytes; longer runs are cut."""
    begin = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    n = np.diff(np.append(begin, len(owner)))
    cuts = -(-n // 65535)
    own = np.repeat(owner[begin], cuts)
    out = np.full(len(own), 65535, np.int64)
    last = np.cumsum(cuts) - 1
    out[last] = n - 65535 * (cuts - 1)
    return own, out.astype("<u2")


def _incidences(size: int, parts: int):
    """Texts to packed incidences by column block (kind 0), documents (1) and the sizes of sets (2).

    Documents are dealt by id, as a set may have any number of them; incidences and
    size of a set are sent once by a task.
    """

    def incidences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, sent = WordCodes(), set()
        for batch in pieces(batches, 256):
            ids = batch.column(0)
            words, counts = codes.hashes([t.lower() for t in utf8(batch.column(1))])
            hashes, sizes = shingle_sets(words[:, 0], counts, size)
            at = offsets(sizes)
            keys = np.array(
                [xxhash.xxh3_64_intdigest(hashes[a:b].tobytes()) for a, b in zip(at, at[1:], strict=False)],
                np.uint64,
            ).view(np.int64)
            whose = ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8")
            missing = ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8)
            # Rows without an id, or with the same one, spread by their place in the batch.
            spread = mix(whose.view(np.uint64) + np.arange(len(whose), dtype=np.uint64))
            part = spread % np.uint64(parts)
            order = np.argsort(part, kind="stable")
            used, packed = _split(
                part[order],
                ids=whose[order],
                nulls=missing[order],
                sizes=sizes[order].astype("<i4"),
                keys=keys[order],
            )
            yield _rows(1, "part", used, packed)
            fresh = np.zeros(len(keys), bool)
            for i in np.flatnonzero(sizes):
                if keys[i] not in sent:
                    sent.add(keys[i])
                    fresh[i] = True
            new = np.flatnonzero(fresh)
            if len(new):
                part = (keys[new].view(np.uint64) >> np.uint64(32)) % np.uint64(parts)
                new = new[np.argsort(part, kind="stable")]
                used, packed = _split(np.sort(part), sizes=sizes[new].astype("<i4"), keys=keys[new])
                yield _rows(2, "part", used, packed)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            hashes, owner = hashes[fresh[owner]], owner[fresh[owner]]
            if not len(hashes):
                continue
            part = ((hashes >> np.uint64(48)) * np.uint64(parts)) >> np.uint64(16)
            order = np.argsort(part, kind="stable")
            part, hashes, owner = part[order], hashes[order], owner[order]
            used, first = np.unique(part, return_index=True)
            at = [*first.tolist(), len(part)]
            low = np.ascontiguousarray(hashes.view(np.uint8).reshape(-1, 8)[:, :6])
            rows: dict[str, list[bytes]] = {"keys": [], "counts": [], "cols": []}
            for a, b in zip(at, at[1:], strict=False):
                own, n = _runs(owner[a:b])
                rows["keys"].append(keys[own].tobytes())
                rows["counts"].append(n.tobytes())
                rows["cols"].append(low[a:b].tobytes())
            yield _rows(0, "part", used, rows)

    return incidences


class _Gathered:
    """Packed rows of a partition as arrays."""

    def __init__(self) -> None:
        self.got: dict[str, list[np.ndarray]] = {}

    def add(self, batch: pa.RecordBatch, row: int, columns: dict[str, str]) -> None:
        for c, kind in columns.items():
            self.got.setdefault(c, []).append(np.frombuffer(batch.column(c)[row].as_buffer(), kind))

    def __getitem__(self, c: str) -> np.ndarray:
        return np.concatenate(self.got[c]) if c in self.got else np.zeros(0, np.int64)


def _shared_columns(buckets: int):
    """Whole column blocks: columns that two or more sets meet, in rows by bucket of sets."""

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, blocks = _Gathered(), []
        for batch in batches:
            part, kinds = batch.column("part").to_pylist(), batch.column("kind").to_pylist()
            docs, sets = _Gathered(), _Gathered()
            for row, kind in enumerate(kinds):
                if kind == 1:
                    docs.add(batch, row, {c: _KINDS[c] for c in ("ids", "nulls", "sizes", "keys")})
                    continue
                if kind == 2:
                    sets.add(batch, row, {c: _KINDS[c] for c in ("sizes", "keys")})
                    continue
                cells.add(batch, row, {c: _KINDS[c] for c in ("keys", "counts")})
                low = np.frombuffer(batch.column("cols")[row].as_buffer(), np.uint8).reshape(-1, 6)
                col = np.zeros((len(low), 8), np.uint8)
                col[:, :6] = low
                blocks.append(col.view("<u8").ravel() | np.uint64(part[row] << 48))
            for kind, of in ((1, docs), (2, sets)):
                keys = of["keys"]
                if len(keys):
                    by = of["ids"].view(np.uint64) + np.arange(len(keys), dtype=np.uint64) if kind == 1 else keys.view(np.uint64)
                    bucket = mix(by) % np.uint64(buckets)
                    order = np.argsort(bucket, kind="stable")
                    used, packed = _split(bucket[order], **{c: of[c][order] for c in of.got})
                    yield _rows(kind, "bucket", used, packed)
        if not blocks:
            return
        col, keys = np.concatenate(blocks), cells["keys"]
        owner = np.repeat(np.arange(len(keys), dtype=np.int32), cells["counts"])
        order = np.argsort(col, kind="stable")
        col, owner = col[order], owner[order]
        same = np.zeros(len(col) + 1, bool)
        same[1:-1] = col[1:] == col[:-1]
        several = same[1:] | same[:-1]
        col, owner = col[several], owner[several]
        order = np.lexsort((keys[owner], col))
        col, owner = col[order], owner[order]
        new = np.ones(len(col), bool)  # one set may have been sent by several tasks
        new[1:] = (col[1:] != col[:-1]) | (keys[owner[1:]] != keys[owner[:-1]])
        col, owner = col[new], owner[new]
        _, back, met = np.unique(col, return_inverse=True, return_counts=True)
        freq = np.minimum(met[back], 65535)
        keep = freq > 1
        col, owner, freq = col[keep], owner[keep], freq[keep]
        if not len(col):
            return
        bucket = mix(keys.view(np.uint64)) % np.uint64(buckets)
        order = np.lexsort((keys[owner], bucket[owner]))
        col, owner, freq = col[order], owner[order], freq[order]
        used, first = np.unique(bucket[owner], return_index=True)
        at = [*first.tolist(), len(owner)]
        rows: dict[str, list[bytes]] = {"keys": [], "counts": [], "cols": [], "freq": []}
        for a, b in zip(at, at[1:], strict=False):
            own, n = _runs(keys[owner[a:b]])
            rows["keys"].append(own.tobytes())
            rows["counts"].append(n.tobytes())
            rows["cols"].append(col[a:b].tobytes())
            rows["freq"].append(freq[a:b].astype("<u2").tobytes())
        yield _rows(0, "bucket", used, rows)

    return shared


def _sets_of(percent: int):
    """Whole buckets: every document with its set, and the sets that enough columns share.

    A row per document (id, size, key), and one per such set (size, key, cols
    from rare to frequent, how many of them a linked set must share one of).
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, known = _Gathered(), _Gathered()
        for batch in batches:
            for row, kind in enumerate(batch.column("kind").to_pylist()):
                if kind == 0:
                    names = ("keys", "counts", "freq")
                    cells.add(batch, row, {c: _KINDS[c] for c in names} | {"cols": "<u8"})
                    continue
                if kind == 2:
                    known.add(batch, row, {"keys": "<i8", "sizes": "<i4"})
                    continue
                ids, missing, sizes, keys = (
                    np.frombuffer(batch.column(c)[row].as_buffer(), _KINDS[c])
                    for c in ("ids", "nulls", "sizes", "keys")
                )
                none = pa.nulls(len(ids), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.ones(len(ids), np.int32)),
                        pa.array(ids, mask=missing == 1),
                        pa.array(sizes.astype(np.int64)),
                        pa.array(keys),
                        none,
                        pa.nulls(len(ids), pa.int32()),
                    ],
                    names=["kind", "id", "size", "key", "cols", "prefix"],
                )
        if not len(cells["keys"]):
            return
        owner = np.repeat(np.arange(len(cells["keys"])), cells["counts"])
        key, col = cells["keys"][owner], cells["cols"]
        order = np.lexsort((col, cells["freq"], key))
        key, col = key[order], col[order]
        own, first, met = np.unique(key, return_index=True, return_counts=True)
        named, at = np.unique(known["keys"], return_index=True)
        size = known["sizes"][at][np.searchsorted(named, own)].astype(np.int64)
        left = 100 * met >= percent * size
        prefix = size - -(-percent * size // 100) + 1 - (size - met)
        cols = [col[a : a + n].tobytes() for a, n in zip(first[left], met[left], strict=True)]
        n = len(cols)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.zeros(n, np.int32)),
                pa.nulls(n, pa.int64()),
                pa.array(size[left]),
                pa.array(own[left]),
                pa.array(cols, pa.binary()),
                pa.array(prefix[left].astype(np.int32)),
            ],
            names=["kind", "id", "size", "key", "cols", "prefix"],
        )

    return sets


def _band(percent: int) -> Column:
    """Numbers a set's size so that sizes within `percent` of each other differ by at most 1."""
    # A little wider than the ratio, so that rounding cannot part a pair at its very edge.
    return F.floor(F.ln("size") / max(math.log(100 / percent) * (1 + 1e-6), 1e-3)).cast("int")


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, 1024):
        prefix = batch.column("prefix").to_numpy(zero_copy_only=False)
        cols = [
            np.frombuffer(c, "<i8")[:p]
            for c, p in zip(batch.column("cols").to_pylist(), prefix.tolist(), strict=True)
        ]
        n = [len(c) for c in cols]
        keys, bands = (np.repeat(batch.column(c).to_numpy(zero_copy_only=False), n) for c in ("key", "band"))
        flat = np.concatenate([np.zeros(0, np.int64), *cols])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (flat, keys, bands)], names=["col", "key", "band"])


def _link(percent: int):
    """A tile's links: each set of a group with the first of them, itself included."""

    def link(tile: pa.Table) -> pa.Table:
        tile = tile.sort_by([("size", "ascending"), ("key", "ascending")])
        keys = tile["key"].to_numpy()
        size = tile["size"].to_numpy()
        cols = [np.frombuffer(c, "<i8") for c in tile["cols"].to_pylist()]
        met = np.array([len(c) for c in cols])
        names, flat = np.unique(np.concatenate(cols), return_inverse=True)
        at = offsets(met)
        mark = np.zeros(len(names), bool)
        open_ = np.arange(len(keys))  # sets not linked to an earlier one, with their incidences
        inside, begins = flat, at[:-1]
        alive = np.ones(len(keys), bool)
        a, b = [], []
        for first in range(len(keys)):
            if not alive[first]:
                continue
            alive[first] = False
            queue, before = [first], len(a)
            while queue:
                row = queue.pop()
                if alive.sum() * 2 < len(open_):
                    open_ = np.flatnonzero(alive)
                    inside, begins = flat[ranges(at[open_], met[open_])], offsets(met[open_])[:-1]
                least, most = -(-percent * size[row] // 100), 100 * size[row] // percent
                low, high = np.searchsorted(size[open_], [least, most + 1])
                if low == high:  # no set left is of a size that can be linked with this one
                    continue
                some, begin = open_[low:high], begins[low]
                end = begins[high] if high < len(begins) else len(inside)
                own = flat[at[row] : at[row + 1]]
                mark[own] = True
                overlap = np.add.reduceat(mark[inside[begin:end]], begins[low:high] - begin, dtype=np.int64)
                mark[own] = False
                union = size[row] + size[some] - overlap
                linked = some[(100 * overlap >= percent * union) & alive[some]]
                alive[linked] = False
                queue += linked.tolist()
                a += keys[linked].tolist()
                b += [int(keys[first])] * len(linked)
            if len(a) > before:
                a.append(int(keys[first]))
                b.append(int(keys[first]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return link


def _clusters(sets: DataFrame) -> DataFrame:
    """(key, cluster) of the sets that share a prefix column with another of a size to be linked with."""
    rows = sets.mapInArrow(_prefixes, "col long, key long, band int")
    # A band meets the next one under its own number and the one before under that one's.
    rows = rows.withColumn("band", F.explode(F.array(F.col("band"), F.col("band") - 1)))
    least = rows.groupBy("col", "band").agg(F.min("key").alias("least"), F.max("key").alias("most"))
    least = least.filter("least < most").select("col", "band", "least")
    pairs = rows.join(least, ["col", "band"]).select(F.col("key").alias("a"), F.col("least").alias("b"))
    found = components(pairs.distinct())
    return found.select(F.col("node").alias("key"), F.col("root").alias("cluster"))


def _tiles(placed: DataFrame) -> DataFrame:
    """A row for each tile (cluster, tile) that a set belongs to.

    `placed` has a set's cluster, band, number of blocks of its band, of the band before and
    of the next one, both 0 if there is none. A block meets all blocks of its band and of
    those two, and no others.
    """
    own, band = F.pmod(F.xxhash64("key"), F.col("blocks")), F.col("band")

    def tiles(blocks: str, tile) -> Column:
        return F.transform(F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1), lambda o: F.struct(*tile(o)))

    def meeting(blocks: str, tile) -> Column:
        none = F.array().cast("array<struct<low:int,row:bigint,high:int,column:bigint>>")
        return F.when(F.col(blocks) > 0, tiles(blocks, tile)).otherwise(none)

    def named(low, row, high, column):
        return low.alias("low"), row.alias("row"), high.alias("high"), column.alias("column")

    where = F.concat(
        tiles("blocks", lambda o: named(band, F.least(own, o), band, F.greatest(own, o))),
        meeting("after", lambda o: named(band, own, band + 1, o)),
        meeting("before", lambda o: named(band - 1, o, band, own)),
    )
    return placed.select("cluster", F.explode(where).alias("tile"), "key", "size", "cols")


def _links(sets: DataFrame, percent: int) -> DataFrame:
    """(key, root) of the sets linked to another."""
    sets = sets.withColumn("band", _band(percent))
    clustered = stored(sets.join(_clusters(sets), "key"), "clusters")
    blocks = F.greatest(F.ceil(F.col("n") / TILE_SETS), F.ceil(F.col("size") / (8 * TILE_INCIDENCES)))
    loads = clustered.groupBy("cluster", "band").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("cols")).alias("size")
    )
    whole = loads.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("size").alias("size"))
    whole = stored(whole.select("cluster", (blocks > 1).alias("cut")), "clusters-to-cut")
    # A cluster has a band for each power of 1.25 at most, so its bands are few rows of a window.
    near = Window.partitionBy("cluster").orderBy("band")
    beside = {"before": (F.lag, -1), "after": (F.lead, 1)}
    cut = loads.join(whole.filter("cut"), "cluster").select("cluster", "band", blocks.cast("long").alias("blocks"))
    cut = cut.withColumns(
        {
            name: F.when(shift("band").over(near) == F.col("band") + by, shift("blocks").over(near)).otherwise(F.lit(0))
            for name, (shift, by) in beside.items()
        }
    )
    cut = stored(cut, "bands")
    alone = {"band": F.lit(0), "blocks": F.lit(1).cast("long")} | {c: F.lit(0).cast("long") for c in beside}
    small = clustered.join(whole.filter("not cut"), "cluster", "left_semi").withColumns(alone)
    tiles = _tiles(small.unionByName(clustered.join(cut, ["cluster", "band"])))
    links = tiles.groupBy("cluster", "tile").applyInArrow(_link(percent), "a long, b long")
    if not whole.filter("cut").limit(1).count():  # then each group lies in one tile, as a star
        return links.select(F.col("a").alias("key"), F.col("b").alias("root"))
    found = components(links)
    return found.select(F.col("node").alias("key"), "root")


def ngram_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    percent: int = PERCENT,
) -> DataFrame:
    """(id_col, n_shingles, component_id) of every row; component_id is the smallest id reachable by links.

    Words are runs of anything but ASCII white space, with A-Z in lower case. A
    text of fewer words than an n-gram has one, its whole sequence. Null, empty
    and blank texts have none and link with nothing. Rows without an id are kept
    and take the smallest id of their group, null if it has none. Repeated rows
    are linked with each other. Other columns are left out; an empty table gives
    an empty one. Ids are integers.
    """
    if not 50 < percent <= 100:
        raise ValueError("percent must be over 50 and at most 100")
    bounded_batches(docs.sparkSession)
    n = shuffle_partitions(docs.sparkSession)
    parts = min(n, 1 << 15)
    chosen = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sent = chosen.mapInArrow(_incidences(words, parts), f"part int, {_PACKED}")
    shared = sent.repartition(n, "part").mapInArrow(_shared_columns(2 * n), f"bucket int, {_PACKED}")
    found = shared.repartition(n, "bucket").mapInArrow(
        _sets_of(percent), "kind int, id long, size long, key long, cols binary, prefix int"
    )
    found = stored(found, "sets")
    rows = found.filter("kind = 1").select("id", "size", "key")
    roots = stored(_links(found.filter("kind = 0").select("size", "key", "cols", "prefix"), percent), "roots")
    # Smallest ids by set, then by group, each a partial sum. Both sides of the last joins
    # are stored, so that Spark can broadcast the small one or split a set of many copies.
    sets = rows.filter("size > 0").groupBy("key").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"))
    sets = stored(sets.join(roots, "key", "left").withColumn("group", F.coalesce("root", "key")), "sets-in-groups")
    groups = sets.groupBy("group").agg(F.min("least").alias("component"), F.sum("n").alias("n")).filter("n > 1")
    groups = stored(groups.select("group", "component"), "groups")
    known = stored(sets.join(groups, "group").select("key", "component"), "components")
    component = F.when(F.col("size") > 0, F.coalesce("component", "id")).otherwise(F.col("id"))
    return rows.join(known, "key", "left").select(
        F.col("id").alias(id_col), F.col("size").alias("n_shingles"), component.alias("component_id")
    )


def one_of_each(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    percent: int = PERCENT,
) -> DataFrame:
    """The documents that have the smallest id of their group; the columns are those of `docs`.

    Rows that share an id are one document and stay or go together; rows without
    an id stay, and so do those with a null or empty text, which are in no group. An
    empty table gives an empty one; columns of any name come back as they are.
    """
    groups = ngram_groups(docs.select(id_col, text_col), id_col, text_col, words, percent)
    (mark,) = working_names(docs, "first")
    first = groups.filter(F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias(mark)).distinct()
    named = docs.filter(F.col(id_col).isNotNull())
    kept = named.join(first, F.col(id_col).cast("long") == F.col(mark), "left_semi")
    return kept.unionByName(docs.filter(F.col(id_col).isNull()))
