"""Approximate nearest neighbours by inner product: a forest of random-projection trees.

The forest is fitted on a bounded sample, every row is put into one leaf of each
tree, and a query walks all trees through one priority queue, nearest leaf first,
until its leaves hold enough rows. Its leaves are then searched exactly and the
best of all are ranked in double precision.

* Equal vectors are one point. Of a point's rows only the k + 1 smallest ids can
  be among anyone's k nearest, so a vector held by a third of the rows is no
  heavier than another.
* Leaves are packed into buckets of bounded size; a larger leaf is cut into
  several. A query's vector travels once to each bucket that holds leaves of its.
* The sample gives each query a lower bound of what its k + 1 nearest score. Only
  better points leave a bucket.
* Inner products are not distances, so for the trees each vector gets one more
  component that brings it to the largest length; queries get zero there.
"""

from __future__ import annotations

import heapq
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendcloud.llm.common import pieces, shuffle_partitions, stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

NEIGHBOURS = 20
TREES = 6
#: Points that the forest is fitted on at most, and points of the sample in a leaf.
SAMPLE, LEAF = 16_384, 32
#: Rows in the leaves that a query searches, as a share of all points, each tree counted
#: by itself; measured recall is in the README.
SHARE = 1.3
#: Rows of a bucket; leaves above it are cut up.
BUCKET_ROWS = 8192


@dataclass(frozen=True)
class Forest:
    """Trees as arrays: a child below zero is the leaf -1 - child."""

    normals: np.ndarray
    thresholds: np.ndarray
    children: np.ndarray
    roots: np.ndarray
    leaves: int

    def leaves_of(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point in each tree."""
        out = np.empty((len(points), len(self.roots)), np.int64)
        for t, root in enumerate(self.roots):
            node = np.full(len(points), root)
            while (inner := np.flatnonzero(node >= 0)).size:
                at = node[inner]
                side = np.einsum("ij,ij->i", points[inner], self.normals[at]) >= self.thresholds[at]
                node[inner] = self.children[at, side.astype(int)]
            out[:, t] = -1 - node
        return out

    def search(self, margins: np.ndarray, rows: np.ndarray, enough: float) -> list[int]:
        """Leaves in order of how far a query is from them, until they hold `enough` rows.

        `margins` are its distances from all hyperplanes, `rows` the leaves' sizes.
        One queue holds the open branches of all trees.
        """
        queue = [(0.0, int(root)) for root in self.roots]
        found, held = [], 0.0
        while queue and held < enough:
            cost, node = heapq.heappop(queue)
            if node < 0:
                found.append(-1 - node)
                held += rows[-1 - node]
                continue
            margin = margins[node]
            low, high = self.children[node]
            near, far = (high, low) if margin >= 0 else (low, high)
            heapq.heappush(queue, (cost, int(near)))
            heapq.heappush(queue, (cost + margin * margin, int(far)))
        return found


def fit_forest(sample: np.ndarray, trees: int, leaf: int, seed: int = 11) -> Forest:
    """Split at the median along the line between two random points, until `leaf` points are left."""
    rng = np.random.default_rng(seed)
    normals, thresholds, children, roots, leaves = [], [], [], [], 0

    def grow(rows: np.ndarray) -> int:
        nonlocal leaves
        if len(rows) > leaf:
            a, b = rng.choice(len(rows), 2, replace=False)
            normal = sample[rows[a]] - sample[rows[b]]
            normal = normal / max(np.linalg.norm(normal), 1e-300)
            along = sample[rows] @ normal
            threshold = np.median(along)
            high = along >= threshold
            if high.any() and not high.all():
                node = len(normals)
                normals.append(normal)
                thresholds.append(threshold)
                children.append([0, 0])
                children[node] = [grow(rows[~high]), grow(rows[high])]
                return node
        leaves += 1
        return -leaves

    for _ in range(trees):
        roots.append(grow(np.arange(len(sample))))
    d = sample.shape[1]
    return Forest(
        np.array(normals).reshape(-1, d),
        np.array(thresholds, float),
        np.array(children, np.int64).reshape(-1, 2),
        np.array(roots, np.int64),
        leaves,
    )


def _usable(vector: Column) -> Column:
    """Neither null nor zero, and without null or non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _lifted(points: np.ndarray, longest: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(longest - (points * points).sum(1), 0.0))
    return np.column_stack([points, rest])


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed from the first component to the last."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


@dataclass(frozen=True)
class _Plan:
    """Where leaves lie: the rows of each, its first bucket, and into how many it is cut."""

    rows: np.ndarray
    bucket: np.ndarray
    cuts: np.ndarray


def _packed(rows: np.ndarray, size: int) -> _Plan:
    cuts = np.maximum(1, -(-rows // size))
    bucket, at, held = np.zeros(len(rows), np.int64), 0, 0
    for i, n in enumerate(rows.tolist()):
        if held and (held + n > size or cuts[i] > 1):
            at, held = at + 1, 0
        bucket[i] = at
        held += n
        if cuts[i] > 1:
            at, held = at + int(cuts[i]), 0
    return _Plan(rows, bucket, cuts)


def _leaf_rows(forest, longest: float):
    def leaf_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted = np.zeros(forest.value.leaves, np.int64)
        for batch in batches:
            if batch.num_rows:
                points = _lifted(_matrix(batch.column("vec")), longest)
                counted += np.bincount(forest.value.leaves_of(points).ravel(), minlength=len(counted))
        leaf = np.flatnonzero(counted)
        yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(counted[leaf])], names=["leaf", "n"])

    return leaf_rows


_SENT = ["bucket", "kind", "id", "leaves", "bound", "vec"]


def _place(forest, plan, longest: float):
    """Every point, once for each tree, with the bucket of its leaf."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = plan.value
        for batch in pieces(batches, 4096):
            ids = batch.column("id").to_numpy()
            vectors = batch.column("vec")
            leaves = forest.value.leaves_of(_lifted(_matrix(vectors), longest))
            turn = ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
            for leaf in leaves.T:
                bucket = where.bucket[leaf] + (turn % where.cuts[leaf].astype(np.uint64)).astype(np.int64)
                own = pa.ListArray.from_arrays(pa.array(np.arange(len(leaf) + 1), pa.int32()), pa.array(leaf))
                columns = [pa.array(bucket), pa.array(np.zeros(len(leaf), np.int32)), batch.column("id"), own]
                columns += [pa.nulls(len(leaf), pa.float64()), vectors]
                yield pa.RecordBatch.from_arrays(columns, names=_SENT)

    return place


def _ask(forest, plan, sample, share: float, points: int, k: int):
    """Every query, once for each bucket that holds leaves of its, with its lower bound."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, where, known = forest.value, plan.value, sample.value
        enough = max(share * points, 100.0 * k)
        rows = where.rows.tolist()
        for batch in pieces(batches, 256):
            vectors = batch.column("vec")
            queries = _matrix(vectors)
            scores = queries @ known.T
            bound = np.full(len(queries), -np.inf)
            if known.shape[0] > k:
                bound = np.partition(scores, -(k + 1), axis=1)[:, -(k + 1)]
                bound -= 1e-9 * (1 + np.abs(bound))
            lifted = np.column_stack([queries, np.zeros(len(queries))])
            margins = lifted @ trees.normals.T - trees.thresholds
            into: list[tuple[int, int, list[int]]] = []
            for q in range(len(queries)):
                own: dict[int, list[int]] = {}
                held = 0
                for leaf in trees.search(margins[q], rows, enough):
                    # The first leaves answer without a bound: together they hold k + 1 points.
                    name = -1 - leaf if held < len(trees.roots) * (k + 1) else leaf
                    held += rows[leaf]
                    for cut in range(int(where.cuts[leaf])):
                        own.setdefault(int(where.bucket[leaf]) + cut, []).append(name)
                into += [(bucket, q, leaves) for bucket, leaves in own.items()]
            which = np.array([q for _, q, _ in into], np.int64)
            columns = [
                pa.array([b for b, _, _ in into], pa.int64()),
                pa.array(np.ones(len(into), np.int32)),
                batch.column("id").take(pa.array(which)),
                pa.array([leaves for _, _, leaves in into], pa.list_(pa.int64())),
                pa.array(bound[which]),
                vectors.take(pa.array(which)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=_SENT)

    return ask


def _search(k: int):
    """Buckets one after the other, their points first: what beats a query's bound, k + 1 of a leaf at most."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, leaves = None, [], {}
        for batch in pieces(batches, 1024):
            buckets = batch.column("bucket").to_numpy()
            kinds = batch.column("kind").to_numpy()
            ends = np.flatnonzero(np.append((buckets[1:] != buckets[:-1]) | (kinds[1:] != kinds[:-1]), True)) + 1
            for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False):
                part = batch.slice(a, b - a)
                if buckets[a] != current:
                    current, held, leaves = buckets[a], [], {}
                first = part.column("leaves")
                ids = part.column("id").to_numpy()
                vectors = _matrix(part.column("vec"))
                if kinds[a] == 0:
                    held.append((first.flatten().to_numpy(), ids, vectors))
                    continue
                if not held:
                    continue
                if not leaves:
                    leaf, points, matrix = (np.concatenate(x) for x in zip(*held, strict=True))
                    order = np.argsort(leaf, kind="stable")
                    names, begin = np.unique(leaf[order], return_index=True)
                    for name, rows in zip(names.tolist(), np.split(order, begin[1:]), strict=True):
                        leaves[name] = points[rows], matrix[rows]
                bound = part.column("bound").to_numpy()
                asked = first.flatten().to_numpy()
                asker = np.repeat(np.arange(len(first)), first.value_lengths().to_numpy())
                least_of = np.where(asked < 0, -np.inf, bound[asker])
                asked = np.where(asked < 0, -1 - asked, asked)
                order = np.argsort(asked, kind="stable")
                names, begin = np.unique(asked[order], return_index=True)
                out: list[list[np.ndarray]] = [[], [], []]
                for name, which in zip(names.tolist(), np.split(order, begin[1:]), strict=True):
                    if name not in leaves:
                        continue
                    points, matrix = leaves[name]
                    rows = asker[which]
                    scores = vectors[rows] @ matrix.T
                    if scores.shape[1] > k + 1:
                        least = np.partition(scores, -(k + 1), axis=1)[:, -(k + 1)]
                        least -= 1e-9 * (1 + np.abs(least))
                    else:
                        least = np.full(len(rows), -np.inf)
                    q, p = np.nonzero(scores >= np.maximum(least, least_of[which])[:, None])
                    out[0].append(ids[rows[q]])
                    out[1].append(points[p])
                    out[2].append(exact_products(vectors[rows[q]], matrix[p]))
                if out[0]:
                    arrays = [pa.array(np.concatenate(x)) for x in out]
                    yield pa.RecordBatch.from_arrays(arrays, names=["query", "id", "score"])

    return search


def _best(k: int):
    """Whole queries: the k + 1 best points of each."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [[b.column(c).to_numpy() for c in ("query", "id", "score")] for b in batches]
        if not got:
            return
        query, point, score = (np.concatenate(x) for x in zip(*got, strict=True))
        order = np.lexsort((point, -score, query))
        query, point, score = query[order], point[order], score[order]
        new = np.ones(len(query), bool)  # a point is found in several trees, with the same score
        new[1:] = (query[1:] != query[:-1]) | (point[1:] != point[:-1])
        query, point, score = query[new], point[new], score[new]
        _, begin, n = np.unique(query, return_index=True, return_counts=True)
        keep = np.arange(len(query)) - np.repeat(begin, n) <= k
        arrays = [pa.array(x[keep]) for x in (query, point, score)]
        yield pa.RecordBatch.from_arrays(arrays, names=["query", "id", "score"])

    return best


def nearest(
    vectors: DataFrame,
    is_query: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = NEIGHBOURS,
    trees: int = TREES,
    share: float = SHARE,
    sample_size: int = SAMPLE,
) -> DataFrame:
    """(query_id, rank, id_col, score): the k nearest found of every row that `is_query` holds for.

    Nearest is the largest inner product in double precision, ties to the smaller
    id; a row is not its own neighbour. Rows whose id is null or whose vector is
    null, zero, holds null or non-finite components, or is not as long as most,
    take no part. Rows that repeat an id with the same vector count once. With
    fewer rows than k all are returned; an empty table gives an empty result.
    Other columns are left out.
    """
    spark = vectors.sparkSession
    n = shuffle_partitions(spark)
    chosen = vectors.filter(F.col(id_col).isNotNull() & _usable(F.col(vector_col))).select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vec"), F.coalesce(is_query, F.lit(False)).alias("asks")
    )
    result = f"query_id long, rank int, {id_col} long, score double"
    lengths = chosen.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], result)
    chosen = chosen.filter(F.size("vec") == lengths[0]["d"])
    # Points: distinct vectors, each with its k + 1 smallest ids; the smallest names it.
    by_vector = Window.partitionBy("vec").orderBy("id")
    few = chosen.select("id", "vec").withColumn("n", F.dense_rank().over(by_vector)).filter(F.col("n") <= k + 1)
    points = few.groupBy("vec").agg(F.min("id").alias("id"), F.array_sort(F.collect_set("id")).alias("ids"))
    points = stored(points, "points")
    asking = chosen.filter("asks").select(F.col("id").alias("query_id"), "vec").distinct()
    members = stored(asking.join(points.select("id", "vec"), "vec").select("query_id", F.col("id").alias("query")), "queries")

    square = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    known = points.agg(F.count(F.lit(1)).alias("n"), F.max(square).alias("longest")).first()
    total, longest = known["n"], known["longest"]
    turn = F.pmod(F.xxhash64("id"), F.lit(1_000_003))
    some = points if total <= sample_size else points.filter(turn < int(1_000_003 * sample_size / total))
    rows = some.select("id", "vec").orderBy("id").collect()
    sample = np.array([r["vec"] for r in rows], np.float64)
    fitted = fit_forest(_lifted(sample, longest), trees, LEAF)
    forest, seen = spark.sparkContext.broadcast(fitted), spark.sparkContext.broadcast(sample)
    counted = points.select("vec").mapInArrow(_leaf_rows(forest, longest), "leaf long, n long")
    held = np.zeros(fitted.leaves, np.int64)
    for row in counted.groupBy("leaf").agg(F.sum("n").alias("n")).collect():  # as many as the forest has
        held[row["leaf"]] = row["n"]
    plan = spark.sparkContext.broadcast(_packed(held, BUCKET_ROWS))

    element = points.schema["vec"].dataType.simpleString()
    sent = f"bucket long, kind int, id long, leaves array<bigint>, bound double, vec {element}"
    index = points.select("id", "vec").mapInArrow(_place(forest, plan, longest), sent)
    queries = members.select(F.col("query").alias("id")).distinct().join(points.select("id", "vec"), "id")
    queries = queries.repartition(n, "id").select("id", "vec")
    asked = queries.mapInArrow(_ask(forest, plan, seen, share, total, k), sent)
    met = index.union(asked).repartition(n, "bucket").sortWithinPartitions("bucket", "kind")
    found = met.mapInArrow(_search(k), "query long, id long, score double")
    best = found.repartition(n, "query").mapInArrow(_best(k), "query long, id long, score double")

    # From points back to rows: k + 1 of them per point that asks, then without the row itself.
    order = Window.partitionBy("query").orderBy(F.desc("score"), "near")
    spread = best.join(points.select("id", "ids"), "id").select("query", "score", F.explode("ids").alias("near"))
    spread = spread.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1)
    lists = spread.groupBy("query").agg(
        F.array_sort(F.collect_list(F.struct("n", "near", "score"))).alias("list")
    )
    others = F.filter("list", lambda x: x["near"] != F.col("query_id"))
    ranked = members.join(lists, "query").select("query_id", F.posexplode(F.slice(others, 1, k)).alias("at", "x"))
    return ranked.select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("x.near").alias(id_col), F.col("x.score").alias("score")
    )
