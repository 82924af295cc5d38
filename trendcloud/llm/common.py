"""Small helpers that several operators share.

Functions here travel to the workers with the operators that use them, so no
worker needs the package installed.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

from trendcloud.sources.files import scratch_dir

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions: the caller sizes it to the input."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def bounded_batches(spark: SparkSession) -> None:
    """Send documents to Python a few hundred at a time, unless the session says otherwise.

    Spark's default of 10,000 rows is meant for short rows: as many long texts fill
    an executor's memory, in the JVM and again in the worker.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, "512")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the cluster's shared folder as Parquet and read again."""
    path = f"{scratch_dir(df.sparkSession, 'llm')}/{name}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def working_names(df: DataFrame, *names: str) -> list[str]:
    """Names for working columns that no column of `df` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    mark = "_"
    while any(f"{mark}{n}".lower() in taken for n in names):
        mark += "_"
    return [f"{mark}{n}" for n in names]


def utf8(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8; null reads as empty."""
    return column.cast(pa.binary()).fill_null(b"").to_pylist()


def pieces(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `rows`."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (lengths[0] of them), starts[1], ... as one array."""
    lengths = lengths.astype(np.int64)
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return np.zeros(0, np.int64)
    return np.arange(ends[-1]) + np.repeat(starts.astype(np.int64) - (ends - lengths), lengths)


def offsets(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths, dtype=np.int64)])


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (in place of a slow hash per number)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class WordCodes(dict):
    """Words to small numbers and their 128-bit hashes; forgets all when it has grown to `most`."""

    def __init__(self, most: int = 1 << 16):
        super().__init__()
        self.most = most
        self.digests: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        code = self[word] = len(self.digests)
        self.digests.append(xxhash.xxh3_128_digest(word))
        return code

    def hashes(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Two independent 64-bit hashes of every word of the texts (n, 2), and words per text.

        Words are the runs of anything but ASCII white space.
        """
        if len(self) > self.most:
            self.clear()
            self.digests = []
        counts = np.zeros(len(texts), np.int64)
        codes: list[np.ndarray] = []
        look = self.__getitem__
        for i, text in enumerate(texts):
            words = text.split()
            counts[i] = len(words)
            codes.append(np.fromiter(map(look, words), np.int64, len(words)))
        digests = np.frombuffer(b"".join(self.digests), np.uint64).reshape(-1, 2)
        where = np.concatenate(codes) if codes else np.zeros(0, np.int64)
        return digests[where], counts
