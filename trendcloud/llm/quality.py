"""Quality scores learned from labelled documents.

Document statistics go through random Fourier features, whose inner products
approximate a Gaussian kernel. Ridge scores follow from normal equations that
every partition sums for itself, so what comes together is one square matrix,
however many rows there are. An isotonic fit on rows kept aside turns raw scores
into probabilities.

Statistics are the only inputs of a score; texts are read whole.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendcloud.llm.common import WordCodes, bounded_batches, offsets, stored, utf8

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FEATURES = 384
RIDGE = 1e-4
#: Labelled rows that a model is fitted to at most: an even sample by a hash of their ids.
MOST_FITTED = 200_000
#: One in so many fitted rows is kept aside for the calibration.
CALIBRATION = 5
#: Raw scores are gathered in steps of this width for the calibration.
STEP = 1e-3
THRESHOLD = 0.7

_GROUPS = {
    "symbols": b"#*$%&|<>",
    "bars": b"|",
    "shouts": b"!",
    "ends": b".?",
    "commas": b",;:",
    "upper": bytes(range(65, 91)),
    "letters": bytes([*range(65, 91), *range(97, 123)]),
    "digits": bytes(range(48, 58)),
    "blanks": b" \t\r\x0b\x0c",
    "brackets": b"()[]{}=/\\_@^~`+",
    "high": bytes(range(128, 256)),
}
STATISTICS = (
    "log_words", "log_bytes", "word_length", "longest_word", "short_words", "distinct_words",
    "distinct_triples", "repeated_neighbours", "commonest_word", "lines", "repeated_lines",
    "words_a_line", "packed", *_GROUPS,
)


def statistics(texts: list[bytes], codes: WordCodes) -> np.ndarray:
    """One row of `STATISTICS` per text; an empty text has zeros."""
    out = np.zeros((len(texts), len(STATISTICS)))
    hashes, counts = codes.hashes(texts)
    words = hashes[:, 0]
    at = offsets(counts)
    factor = np.uint64(0x9E3779B97F4A7C15)
    triples = words[:-2] * factor * factor + words[1:-1] * factor + words[2:] if len(words) > 2 else words[:0]
    for i, text in enumerate(texts):
        n, size = int(counts[i]), len(text)
        if not size:
            continue
        own = words[at[i] : at[i + 1]]
        row = [np.log1p(n), np.log1p(size)]
        if n:
            lengths = np.fromiter(map(len, text.split()), np.int64, n)
            _, met = np.unique(own, return_counts=True)
            three = triples[at[i] : at[i + 1] - 2] if n > 2 else own
            row += [
                lengths.mean(),
                np.log1p(lengths.max()),
                (lengths < 4).mean(),
                len(met) / n,
                len(np.unique(three)) / len(three),
                (own[1:] == own[:-1]).mean() if n > 1 else 0.0,
                met.max() / n,
            ]
        else:
            row += [0.0] * 7
        lines = [x for x in text.split(b"\n") if x.strip()]
        row += [
            np.log1p(len(lines)),
            1 - len(set(lines)) / max(1, len(lines)),
            n / max(1, len(lines)),
            len(zlib.compress(text, 1)) / (size + 20),
        ]
        row += [(size - len(text.translate(None, group))) / size for group in _GROUPS.values()]
        out[i] = row
    return out


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def text_statistics(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    codes = WordCodes()
    for column in texts:
        parts = [statistics(utf8(column.slice(a, 512)), codes) for a in range(0, len(column), 512)]
        rows = np.concatenate(parts) if parts else np.zeros((0, len(STATISTICS)))
        at = pa.array(np.arange(len(rows) + 1) * len(STATISTICS), pa.int32())
        yield pa.ListArray.from_arrays(at, pa.array(rows.ravel()))


@dataclass(frozen=True)
class QualityModel:
    """Scores statistics; without anything to learn from, every score is 0.5."""

    mean: np.ndarray = field(default_factory=lambda: np.zeros(len(STATISTICS)))
    scale: np.ndarray = field(default_factory=lambda: np.ones(len(STATISTICS)))
    weights: np.ndarray | None = None
    knots: np.ndarray = field(default_factory=lambda: np.zeros(1))
    values: np.ndarray = field(default_factory=lambda: np.full(1, 0.5))

    def features(self, rows: np.ndarray) -> np.ndarray:
        """Cosines along random directions, and a constant."""
        rng = np.random.default_rng(7)
        d = len(self.mean)
        directions = rng.standard_normal((d, FEATURES)) / np.sqrt(d)
        phases = rng.uniform(0, 2 * np.pi, FEATURES)
        z = np.clip((rows - self.mean) / self.scale, -5, 5)
        cosines = np.sqrt(2 / FEATURES) * np.cos(z @ directions + phases)
        return np.concatenate([cosines, np.ones((len(rows), 1))], 1)

    def raw(self, rows: np.ndarray) -> np.ndarray:
        if self.weights is None or not len(rows):
            return np.zeros(len(rows))
        return self.features(rows) @ self.weights

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Probabilities; a trace of the raw score orders rows inside a flat step."""
        raw = self.raw(rows)
        level = np.interp(raw, self.knots, self.values)
        return 0.998 * level + 0.002 * np.clip((raw + 1) / 3, 0, 1)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _normal_sums(model: QualityModel):
    """A partition's sum of feature products, a row of the matrix at a time, targets last."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            x = model.features(_matrix(batch.column("stats")))
            y = batch.column("label").to_numpy(zero_copy_only=False)
            total += x.T @ np.column_stack([x, y])
            rows += batch.num_rows
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(total), dtype=np.int32)), pa.array([r.tobytes() for r in total])],
                names=["i", "sums"],
            )

    return sums


def _added(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(FEATURES + 2)
    for batch in batches:
        for row in batch.column("sums").to_pylist():
            total += np.frombuffer(row)
    yield pa.RecordBatch.from_arrays(
        [pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()])], names=["i", "sums"]
    )


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres and values of the best non-decreasing steps (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for a, b, w in sorted(zip(x.tolist(), y.tolist(), weight.tolist(), strict=True)):
        blocks.append([a * w, b * w, w])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    sums = np.array(blocks)
    return sums[:, 0] / sums[:, 2], sums[:, 1] / sums[:, 2]


_TURNS = 1_000_003


def _turn() -> Column:
    """An even number from 0 below `_TURNS`, by the id."""
    return F.pmod(F.xxhash64("id"), F.lit(_TURNS))


def fit_quality(rows: DataFrame) -> QualityModel:
    """A model of `label` (0 to 1) from `stats`, both columns of `rows` beside an `id`.

    At most `MOST_FITTED` rows are used; beyond that an even share by a hash of
    the id. Rows without a label or statistics are left out.
    """
    rows = rows.filter("label is not null and stats is not null")
    known = rows.count()
    if not known:
        return QualityModel()
    turn = _turn()
    if known > MOST_FITTED:
        rows = rows.filter(turn < int(_TURNS * MOST_FITTED / known))
    rows = stored(rows.select("stats", "label", (F.pmod(turn, F.lit(CALIBRATION)) == 0).alias("aside")), "labelled")
    fit, aside = rows.filter("not aside"), rows.filter("aside")
    if not fit.limit(1).count() or not aside.limit(1).count():
        fit = aside = rows
    each = range(len(STATISTICS))
    spread = fit.agg(
        *(F.avg(F.col("stats")[i]).alias(f"m{i}") for i in each),
        *(F.stddev_pop(F.col("stats")[i]).alias(f"s{i}") for i in each),
    ).first()
    mean = np.array([spread[f"m{i}"] for i in each])
    scale = np.array([spread[f"s{i}"] for i in each])
    scale[scale < 1e-9] = 1.0
    model = QualityModel(mean, scale)
    partial = fit.select("stats", "label").mapInArrow(_normal_sums(model), "i int, sums binary")
    total = np.zeros((FEATURES + 1, FEATURES + 2))
    for row in partial.groupBy("i").applyInArrow(_added, "i int, sums binary").collect():
        total[row["i"]] = np.frombuffer(row["sums"])
    n = total[-1, -2]
    weights = np.linalg.solve(total[:, :-1] + RIDGE * n * np.eye(FEATURES + 1), total[:, -1])
    model = QualityModel(mean, scale, weights)
    step = F.round(_raw_scores(model)(F.col("stats")) / STEP).cast("long")
    seen = aside.groupBy(step.alias("step")).agg(F.avg("label").alias("y"), F.count(F.lit(1)).alias("n"))
    steps = seen.collect()  # raw scores are bounded, and so are their steps
    x, y, w = (np.array([r[c] for r in steps], float) for c in ("step", "y", "n"))
    knots, values = isotonic(x * STEP, y, w)
    return QualityModel(mean, scale, weights, knots, values)


def _raw_scores(model: QualityModel):
    @F.arrow_udf("double")
    def raw(stats: pa.Array) -> pa.Array:
        return pa.array(np.clip(model.raw(_matrix(stats)), -3, 4) if len(stats) else np.zeros(0))

    return raw


def quality_score(model: QualityModel, stats: Column) -> Column:
    """The score of statistics."""

    @F.arrow_udf("double")
    def score(rows: pa.Array) -> pa.Array:
        return pa.array(model.score(_matrix(rows)) if len(rows) else np.zeros(0))

    return score(stats)


def held_out(id_col: str) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _known_labels(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """(id, label) of the rows that may be learned from."""
    known = labels.filter(F.col(label_col).isin(0, 1) & ~held_out(id_col))
    return known.groupBy(F.col(id_col).alias("id")).agg(F.avg(label_col).alias("label"))


def learn_quality(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> QualityModel:
    """A model from (id_col, stats) and the labels of rows that are not held out.

    Labels other than 0 and 1 are left out; a document with several has their mean.
    """
    given = _known_labels(labels, id_col, label_col)
    return fit_quality(stats.select(F.col(id_col).alias("id"), "stats").join(given, "id"))


def quality_scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id_col, held_out, score, predicted) of every row, learned from the labels.

    Null texts score as empty ones do; null ids and repeated rows are kept; an
    empty table gives an empty one; without labels every score is 0.5. Columns
    other than id and text are left out.
    """
    bounded_batches(docs.sparkSession)
    stats = docs.select(F.col(id_col), text_statistics(F.col(text_col)).alias("stats"))
    stats = stored(stats, "statistics")
    model = learn_quality(stats, labels, id_col)
    scored = stats.select(id_col, held_out(id_col).alias("held_out"), quality_score(model, F.col("stats")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with a score of at least `THRESHOLD`; the columns are those of `docs`.

    Null and empty texts are scored as empty ones; null ids and repeated rows are kept
    or go by their text; an empty table gives an empty one; columns of any name come
    back as they are. Without labels to learn from nothing is known about quality,
    and all documents stay. To learn, only the texts with labels (`MOST_FITTED` of
    them at most, about) have their statistics taken; all are then judged in one pass.
    """
    bounded_batches(docs.sparkSession)
    given = _known_labels(labels, id_col, "quality")
    known = given.count()
    if known > MOST_FITTED:
        given = given.filter(_turn() < int(_TURNS * MOST_FITTED / known))
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # No more labels than are learned from go to all tasks.
    fitted = named.join(F.broadcast(given), "id").select("id", "label", text_statistics(F.col("text")).alias("stats"))
    model = fit_quality(stored(fitted, "fitted"))
    if model.weights is None:
        return docs
    return docs.filter(quality_score(model, text_statistics(F.col(text_col))) >= THRESHOLD)
