"""Whitening of embeddings onto the leading principal components.

Entries become whole numbers (256 steps to one), and every vector counts once: the
fit list holds each distinct vector. Spark finds it, sums it (exactly) and sums the
products of centred entries, task by task and then by a shuffle, so what reaches the
driver is one sum per dimension and one matrix of dimension x dimension.

The spectrum of that matrix is sliced there. The LDLᵀ factors of V - sI have as many
positive pivots as V has eigenvalues above s (inertia), so bisection on that count
isolates each leading eigenvalue; Rayleigh quotient iteration, solving with the same
factors, then converges cubically; and counts just below and above the value found
certify which number it bears. Eigenvalues that no count can tell apart share an
interval, and their vectors are kept orthogonal.

Projections run where the rows lie, with the few components in the tasks' closure.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendcloud.llm.common import pieces, stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Steps to one when entries become whole numbers.
STEPS = 256
COMPONENTS = 4
#: Entries beyond this many steps are taken as this many, so that all sums stay exact.
MOST = (1 << 62) - 1


def ldlt(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """P A Pᵀ = L D Lᵀ of a symmetric matrix: order P, the factors packed, and D's blocks.

    Pivots are the largest of what is left, single or in pairs, so that the factors
    stay small whatever the signs. L's columns lie below D's blocks.
    """
    a = a.copy()
    n = len(a)
    order = np.arange(n)
    small = np.finfo(float).eps * max(float(np.abs(a).max(initial=0.0)), 1e-150)
    blocks = []
    k = 0
    while k < n:
        rest = np.abs(a[k:, k:])
        d = int(np.argmax(np.diagonal(rest)))
        i, j = divmod(int(np.argmax(rest)), n - k)
        # The bound that keeps growth least: (1 + sqrt 17) / 8.
        single = k == n - 1 or rest[d, d] >= 0.6403882032022076 * rest[i, j]
        wanted = [k + d] if single else sorted((k + i, k + j))
        for at, p in enumerate(wanted, start=k):
            if p != at:
                a[[at, p]], order[[at, p]] = a[[p, at]], order[[p, at]]
                a[:, [at, p]] = a[:, [p, at]]
        end = k + len(wanted)
        pivot = a[k:end, k:end].copy()
        if single and pivot[0, 0] == 0.0:
            pivot[0, 0] = a[k, k] = small  # the rest is zero: a shift exactly on an eigenvalue
        column = np.linalg.solve(pivot, a[k:end, end:]).T
        a[end:, end:] -= column @ a[k:end, end:]
        a[end:, k:end] = column
        blocks.append((k, end))
        k = end
    return order, a, blocks


def eigenvalues_above(v: np.ndarray, shift: float) -> int:
    """How many eigenvalues of the symmetric `v` lie above `shift`: positive pivots of LDLᵀ."""
    _, a, blocks = ldlt(v - shift * np.eye(len(v)))
    # A pair has one pivot of each sign: its determinant is below zero by choice of pivots.
    return sum(1 if end - k == 2 else int(a[k, k] > 0) for k, end in blocks)


def solve_shifted(v: np.ndarray, shift: float, b: np.ndarray) -> np.ndarray:
    """(V - shift I)⁻¹ b by the LDLᵀ factors."""
    order, a, blocks = ldlt(v - shift * np.eye(len(v)))
    x = b[order].copy()
    for k, end in blocks:
        x[end:] -= a[end:, k:end] @ x[k:end]
    for k, end in reversed(blocks):
        x[k:end] = np.linalg.solve(a[k:end, k:end], x[k:end]) - a[end:, k:end].T @ x[end:]
    out = np.empty_like(x)
    out[order] = x
    return out


@dataclass(frozen=True)
class Spectrum:
    """Leading eigenvalues, falling; unit eigenvectors as rows; per value, whether counts certify its number."""

    values: np.ndarray
    vectors: np.ndarray
    certified: list[bool]


def leading_spectrum(v: np.ndarray, most: int = COMPONENTS) -> Spectrum:
    """The `most` largest eigenvalues of a positive semidefinite matrix, those above rounding.

    A value is isolated by bisection until its interval holds no other or is as
    narrow as rounding; iteration that leaves the interval starts again from a
    narrower one.
    """
    n = len(v)
    norm = float(np.abs(v).sum(axis=1).max()) if n else 0.0
    blur = 8 * n * np.finfo(float).eps * norm
    values, vectors, certified = [], [], []
    for number in range(1, min(most, n) + 1):
        low, high = -blur, norm + blur
        if norm == 0.0 or eigenvalues_above(v, blur) < number:
            break
        above_low, above_high = n, 0
        value = vector = None
        while value is None:
            while high - low > blur and (above_low != number or above_high != number - 1 or high - low > 1e-2 * high):
                middle = (low + high) / 2
                above = eigenvalues_above(v, middle)
                if above >= number:
                    low, above_low = middle, above
                else:
                    high, above_high = middle, above
            value, vector = _iterate(v, low, high, blur, vectors, number)
            if value is None:
                middle = (low + high) / 2
                above = eigenvalues_above(v, middle)
                if above >= number:
                    low, above_low = middle, above
                else:
                    high, above_high = middle, above
        values.append(value)
        vectors.append(vector)
        certified.append(eigenvalues_above(v, value + blur) < number <= eigenvalues_above(v, value - blur))
    return Spectrum(np.array(values), np.array(vectors).reshape(len(values), n), certified)


def _iterate(v, low, high, blur, found, number):
    """Rayleigh quotient iteration from the middle of an interval; None if it leaves the interval."""

    def clear(x):
        for _ in range(2):
            for f in found:
                x = x - (f @ x) * f
        return x / np.linalg.norm(x)

    x = clear(np.random.default_rng(number).standard_normal(len(v)))
    shift = (low + high) / 2
    for _ in range(3):
        x = clear(solve_shifted(v, shift, x))
    best = None
    for _ in range(12):
        rho = float(x @ v @ x)
        residual = float(np.linalg.norm(v @ x - rho * x))
        if best is not None and residual >= best[0] / 2:
            break
        best = (residual, rho, x)
        if residual == 0.0:
            break
        x = clear(solve_shifted(v, rho, x))
    residual, rho, x = best
    # The bound is no tighter than the interval, so bisection always comes to an end.
    settled = high - low <= blur or (residual <= blur and low - blur <= rho <= high + blur)
    return (rho, x) if settled else (None, None)


def whole_steps(vec_col: str):
    """The entries as whole steps; NULL if the vector is, or holds anything but finite numbers."""
    finite = F.forall(
        F.col(vec_col),
        lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")),
    )
    bound = float(MOST)
    step = lambda c: F.floor(F.least(F.greatest(c.cast("double") * STEPS, F.lit(-bound)), F.lit(bound)))
    return F.when(finite, F.transform(F.col(vec_col), lambda c: step(c).cast("long")))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: rows and the exact sum of every dimension, in halves that cannot overflow."""
    rows, low, high = 0, None, None
    for batch in pieces(batches, 4096):
        x = _matrix(batch.column(0))
        rows += len(x)
        parts = (x & 0xFFFFFFFF).sum(axis=0), (x >> 32).sum(axis=0)
        low, high = parts if low is None else (low + parts[0], high + parts[1])
    if rows:
        n = len(low)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(n, dtype=np.int32)), pa.array(np.full(n, rows)), pa.array(low), pa.array(high)],
            names=["i", "n", "low", "high"],
        )


def _products(centre: np.ndarray, onto: Whitening | None = None):
    """Per task: sums of products of centred entries, one row per pair of dimensions.

    With `onto` the vectors are whitened first; `centre` is then the mean of that.
    """

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for batch in pieces(batches, 4096):
            x = _matrix(batch.column(0))
            y = x - centre if onto is None else onto.whiten(x) - centre
            total = total + y.T @ y
        if np.ndim(total):
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays(
                [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])],
                names=["i", "j", "product"],
            )

    return products


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def _covariance(fit: DataFrame, n: int, size: int, centre: np.ndarray, onto=None) -> np.ndarray:
    sums = fit.mapInArrow(_products(centre, onto), "i int, j int, product double")
    out = np.zeros((size, size))
    for row in sums.groupBy("i", "j").agg(F.sum("product").alias("product")).collect():
        out[row["i"], row["j"]] = out[row["j"], row["i"]] = row["product"] / n
    return out


@dataclass(frozen=True)
class Whitening:
    """What a fit has learned; `sums` are exact whole numbers."""

    n: int
    sums: list[int]
    spectrum: Spectrum
    trace: float
    identity_error: float = 0.0

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """Whitened components of whole-step vectors, one row each."""
        y = x - np.array([s / self.n for s in self.sums])
        return (y @ self.spectrum.vectors.T) / np.sqrt(self.spectrum.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sums of (n x - S)²; None where a long cannot hold it."""
        most = self.n * max(1, int(np.abs(x).max(initial=0))) + max(map(abs, self.sums), default=0)
        if x.shape[1] * most * most < 1 << 63:
            y = self.n * x - np.array(self.sums, np.int64)
            return (y * y).sum(axis=1).tolist()
        exact = [sum((self.n * int(c) - s) ** 2 for c, s in zip(row, self.sums, strict=True)) for row in x]
        return [e if e < 1 << 63 else None for e in exact]


def fit_list(vectors: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """Each distinct whole-step vector once, as `x`.

    Rows without a usable vector are left out; so are, if lengths differ, those
    whose vector has not the commonest length (the greater one of equally common).
    """
    return _of_one_length(vectors.select(whole_steps(vec_col).alias("x"))).distinct()


def _of_one_length(x: DataFrame) -> DataFrame:
    lengths = x.filter("x is not null and size(x) > 0").groupBy(F.size("x").alias("d")).count()
    first = lengths.orderBy(F.desc("count"), F.desc("d")).first()
    return x.filter(F.col("x").isNotNull() & (F.size("x") == (first["d"] if first else -1)))


def fit_whitening(fit: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Components of the vectors `x` of a fit list; None if it is empty."""
    sums = fit.mapInArrow(_sums, "i int, n long, low long, high long")
    wide = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("low", "high")]
    dims = sums.groupBy("i").agg(F.sum("n").alias("n"), *wide).orderBy("i").collect()
    if not dims:
        return None
    n = dims[0]["n"]
    total = [int(r["low"]) + (int(r["high"]) << 32) for r in dims]
    v = _covariance(fit, n, len(total), np.array([s / n for s in total]))
    spectrum = leading_spectrum(v, components)
    model = Whitening(n, total, spectrum, float(np.trace(v)))
    k = len(spectrum.values)
    if not k:
        return model
    # What rounding leaves of the mean is far below what the error may be; it is centred away as well.
    mean = _projected_mean(fit, model, n)
    error = float(np.abs(_covariance(fit, n, k, mean, model) - np.eye(k)).max())
    return Whitening(n, total, spectrum, model.trace, error)


def _projected_mean(fit: DataFrame, model: Whitening, n: int) -> np.ndarray:
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(model.spectrum.values))
        for batch in pieces(batches, 4096):
            total += model.whiten(_matrix(batch.column(0))).sum(axis=0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["i", "total"]
        )

    rows = fit.mapInArrow(sums, "i int, total double").groupBy("i").agg(F.sum("total").alias("total")).collect()
    return np.array([r["total"] for r in sorted(rows, key=lambda r: r["i"])]) / n


def whitened(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS
) -> DataFrame:
    """Per row with a usable vector and component: (id_col, component, n, deviation, whitened, explained, identity_error).

    Vectors that are null, empty or hold null or non-finite entries are dropped, and
    of vectors of several lengths only the commonest length stays. Repeated rows and
    null ids are kept and each given out; vectors that are equal after rounding count
    once in the fit. Components are only those whose eigenvalue is above rounding,
    so a table with one distinct vector, like an empty one, gives no rows. Equal
    eigenvalues get some orthogonal vectors of their space. `deviation` is NULL where
    a long cannot hold it. Other columns are left out. Runs jobs when called.
    """
    rows = vectors.select(F.col(id_col).alias("id"), whole_steps(vec_col).alias("x"))
    fit = stored(fit_list(vectors, vec_col), "fit")
    model = fit_whitening(fit, components)
    kind = T.StructType(
        [
            T.StructField("id", rows.schema["id"].dataType),
            T.StructField("component", T.IntegerType()),
            T.StructField("n", T.LongType()),
            T.StructField("deviation", T.LongType()),
            T.StructField("whitened", T.DoubleType()),
            T.StructField("explained", T.DoubleType()),
            T.StructField("identity_error", T.DoubleType()),
        ]
    )
    if model is None or not len(model.spectrum.values):
        return vectors.sparkSession.createDataFrame([], kind).withColumnRenamed("id", id_col)
    k = len(model.spectrum.values)
    share = model.spectrum.values / model.trace

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 4096):
            x = _matrix(batch.column(1))
            m = len(x)
            if not m:
                continue
            each = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, model.n)),
                    pa.array(model.deviations(x), pa.int64()).take(pa.array(each)),
                    pa.array(model.whiten(x).ravel()),
                    pa.array(np.tile(share, m)),
                    pa.array(np.full(m * k, model.identity_error)),
                ],
                names=kind.names,
            )

    usable = rows.filter(F.col("x").isNotNull() & (F.size("x") == len(model.sums)))
    return usable.mapInArrow(project, kind).withColumnRenamed("id", id_col)
