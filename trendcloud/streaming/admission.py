"""Admission as a stream: verdicts as requests come in.

Verdicts hang on the order of the requests, and a stream's files come in any. So a
request waits in state until the watermark has passed it; a timer then judges what
is ready, in order, from the few instants that its key had admitted last. Spark keeps
state by groups of keys, as each group and each of its timers costs a call and some
messages, which for keys of few requests is far more than the verdicts themselves. The same requests get the same verdicts however they fall into files and
micro-batches. One that comes when the watermark has already passed it gets NULL, as
do those without a time or a key, which never enter the state.

State is Spark's: per key the last admitted instants, and per group what waits, packed
by slices of the lateness, a few slices together where requests are few. A micro-batch
touches what its requests fall into and what becomes ready, nothing else, and nothing
waits longer than the lateness.
What still waits when a log has ended is read from the state and judged by the
batch operator, which cuts long keys up.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from trendcloud.operators.admission import LIMIT, WINDOW_SECONDS, Admission, admission_audit, check_rule
from trendcloud.sources.files import exists

#: How late a request may come and still be judged.
LATENESS_SECONDS = 600
#: Slices of the lateness in which waiting requests are kept.
SLICES = 16
#: Groups of keys that state is kept by; a stream that goes on must have as many as it began with.
KEY_GROUPS = 512
#: Requests that are packed together whatever their slices, and those of a micro-batch's group held meanwhile.
BUNDLE_ROWS, PENDING_ROWS = 1 << 12, 1 << 18
#: The one state store that keeps states of several kinds and timers; it writes changes only.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_WAITING = pa.schema([("name", pa.string()), ("at", pa.int64()), ("tie", pa.int64()), ("packed", pa.list_(pa.string()))])


def _packed(requests: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _WAITING) as writer:
        writer.write_table(requests)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pa.Table:
    """Requests from streams that were written one behind the other."""
    source, batches = pa.BufferReader(data), []
    while source.tell() < source.size():
        batches += list(pa.ipc.open_stream(source))
    return pa.Table.from_batches(batches, _WAITING)


def _requests(frame: pd.DataFrame) -> pa.Table:
    columns = [pa.array(list(frame[f.name]), f.type) for f in _WAITING]
    return pa.Table.from_arrays(columns, schema=_WAITING)


class Judge(StatefulProcessor):
    """Requests of a group of keys in, verdicts out, as the watermark passes them."""

    def __init__(self, limit: int, window: int, slice_ms: int):
        self.limit, self.window, self.slice_ms = limit, window, slice_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # What waits below a slice's number is of that slice or later ones.
        self.waiting = handle.getMapState("waiting", "slice long", "requests binary")
        self.admitted = handle.getMapState("admitted", "name string", "instants array<long>")
        self.done: set = set()  # groups judged in this micro-batch, whose other timers find nothing

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        pending, n = [], 0
        for frame in rows:
            late = frame["at"].to_numpy() < mark * 1000
            if late.any():
                yield pd.DataFrame({"packed": frame["packed"][late], "admitted": pd.array([None] * int(late.sum()), "boolean")})
                frame = frame[~late]
            pending.append(_requests(frame))
            n += len(frame)
            if n >= PENDING_ROWS:
                self._wait(pa.concat_tables(pending))
                pending, n = [], 0
        if n:
            self._wait(pa.concat_tables(pending))

    def _slices(self, requests: pa.Table) -> np.ndarray:
        return requests["at"].to_numpy() // (self.slice_ms * 1000)

    def _wait(self, requests: pa.Table) -> None:
        requests = requests.sort_by("at")
        slices, first = np.unique(self._slices(requests), return_index=True)
        ends = np.append(first[1:], requests.num_rows)
        begin = 0
        for i in range(len(slices)):
            if i + 1 < len(slices) and ends[i + 1] - first[begin] <= BUNDLE_ROWS:
                continue
            place = (int(slices[begin]),)
            data = _packed(requests.slice(first[begin], ends[i] - first[begin]))
            if self.waiting.containsKey(place):
                data = self.waiting.getValue(place)[0] + data
            else:
                self.handle.registerTimer((place[0] + 1) * self.slice_ms)
            self.waiting.updateValue(place, (data,))
            begin = i + 1

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if key in self.done:
            return
        self.done.add(key)
        ends = timerValues.getCurrentWatermarkInMs() // self.slice_ms
        ready = sorted(k[0] for k in self.waiting.keys() if k[0] < ends)
        walks: dict[str, Admission] = {}
        held = _WAITING.empty_table()
        for number, upto in zip(ready, [*ready[1:], ends], strict=True):
            held = pa.concat_tables([held, _unpacked(self.waiting.getValue((number,))[0])])
            self.waiting.removeKey((number,))
            # Whatever else waits is of the slice `upto` or later.
            now = self._slices(held) < upto
            if now.any():
                yield self._judged(held.filter(now), walks)
                held = held.filter(~now)
        for name, walk in walks.items():
            self.admitted.updateValue((name,), ([int(t) for t in walk.admitted[-self.limit :]],))
        if held.num_rows:
            self._wait(held)

    def _judged(self, requests: pa.Table, walks: dict[str, Admission]) -> pd.DataFrame:
        requests = requests.sort_by([("name", "ascending"), ("at", "ascending"), ("tie", "ascending")])
        at, names = requests["at"].to_numpy(), requests["name"].combine_chunks()
        own = np.append(True, pc.not_equal(names[1:], names[:-1]).to_numpy(zero_copy_only=False))
        first = np.flatnonzero(own | np.append(True, at[1:] != at[:-1]))
        counts = np.diff(np.append(first, len(at)))
        passed = np.zeros(len(first), np.int64)
        begins = np.flatnonzero(own[first])
        for a, b in zip(begins, np.append(begins[1:], len(first)), strict=True):
            name = names[int(first[a])].as_py()
            if name not in walks:
                before = self.admitted.getValue((name,))[0] if self.admitted.containsKey((name,)) else []
                walks[name] = Admission(self.limit, self.window, [int(t) for t in before])
            passed[a:b] = walks[name].admit(at[first[a:b]], counts[a:b])
        rank = np.arange(len(at)) - np.repeat(first, counts)
        return pd.DataFrame({"packed": requests["packed"].to_pylist(), "admitted": rank < np.repeat(passed, counts)})

    def close(self) -> None:
        pass


# Requests travel through the state as texts, from which every type comes back as it was.


def _text(field: T.StructField) -> Column:
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(F.struct(column.alias("x")), {"ignoreNullFields": "false"})
    return F.base64(column) if isinstance(field.dataType, T.BinaryType) else column.cast("string")


def _value(field: T.StructField, text: Column) -> Column:
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        value = F.from_json(text, T.StructType([T.StructField("x", field.dataType)]))["x"]
    else:
        value = F.unbase64(text) if isinstance(field.dataType, T.BinaryType) else text.cast(field.dataType)
    return value.alias(field.name)


def _unpack(packed: DataFrame, schema: T.StructType, *more: str) -> DataFrame:
    return packed.select(*[_value(f, F.col("packed")[i]) for i, f in enumerate(schema.fields)], *more)


def _fields(schema: T.StructType, keys: Sequence[str]) -> list[T.StructField]:
    named = {f.name.lower(): f for f in schema.fields} | {f.name: f for f in schema.fields}
    return [named.get(c) or named[c.lower()] for c in keys]


def _name(schema: T.StructType, keys: Sequence[str]) -> Column:
    """A key's columns as one text; equal numbers have equal ones."""

    def same(field: T.StructField) -> Column:
        zero = F.col(f"`{field.name}`") == 0
        return F.when(zero, "0.0").otherwise(_text(field)) if isinstance(field.dataType, (T.FloatType, T.DoubleType)) else _text(field)

    return F.to_json(F.array(*[same(f) for f in _fields(schema, keys)]))


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def verdict_stream(
    log: DataFrame,
    keys: Sequence[str],
    ts: str,
    limit: int = LIMIT,
    window_seconds: int = WINDOW_SECONDS,
    lateness_seconds: int = LATENESS_SECONDS,
) -> DataFrame:
    """A streaming log's requests with `admitted`, each once the watermark has passed it.

    The query needs a state store that keeps timers; `admission_stream` sets it.
    """
    check_rule(limit, window_seconds)
    if lateness_seconds < 0:
        raise ValueError("lateness must be at least 0")
    schema, window = log.schema, window_seconds * 1_000_000
    slice_ms = max(1000, lateness_seconds * 1000 // SLICES)
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*keys, ts)])
    marked = log.filter(known).withColumn("_mark", F.col(ts).cast("timestamp")).withWatermark("_mark", f"{lateness_seconds} seconds")
    # Names without a leading underscore: Spark's own frames of requests rename such ones.
    packed = marked.select(
        F.pmod(F.xxhash64(*keys), F.lit(KEY_GROUPS)).alias("keys"),
        _name(schema, keys).alias("name"),
        # Made anew, so that Spark does not drop what is late before it is seen here.
        F.unix_micros("_mark").alias("at"),
        F.xxhash64(*schema.names).alias("tie"),
        F.array(*[_text(f) for f in schema.fields]).alias("packed"),
    )
    judged = packed.groupBy("keys").transformWithStateInPandas(
        Judge(limit, window, slice_ms), "packed array<string>, admitted boolean", "append", "EventTime"
    )
    never = log.filter(~known).withColumn("admitted", F.lit(None).cast("boolean"))
    return _unpack(judged, schema, "admitted").unionByName(never)


def admission_stream(
    log: DataFrame,
    target: str,
    keys: Sequence[str],
    ts: str,
    limit: int = LIMIT,
    window_seconds: int = WINDOW_SECONDS,
    lateness_seconds: int = LATENESS_SECONDS,
    available_now: bool = False,
) -> StreamingQuery:
    """Judge a streaming log; verdicts are appended below `target`, see `read_verdicts`.

    The checkpoint lies beside the verdicts, so a run that is broken off goes on
    where it stopped.
    """
    spark = log.sparkSession
    verdicts = verdict_stream(log, keys, ts, limit, window_seconds, lateness_seconds)
    writer = verdicts.writeStream.format("parquet").option("checkpointLocation", f"{target}/checkpoint")
    writer = writer.trigger(availableNow=True) if available_now else writer
    # A query keeps the settings it was started with; the session gets its own back.
    before = {name: spark.conf.get(name, None) for name in STORE}
    for name, value in STORE.items():
        spark.conf.set(name, value)
    try:
        return writer.start(f"{target}/verdicts")
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def _state(spark: SparkSession, target: str, name: str) -> DataFrame:
    return spark.read.format("statestore").option("path", f"{target}/checkpoint").option("stateVarName", name).load()


def finish_stream(
    spark: SparkSession,
    target: str,
    keys: Sequence[str],
    ts: str,
    schema: T.StructType,
    limit: int = LIMIT,
    window_seconds: int = WINDOW_SECONDS,
) -> None:
    """Judge what a stopped stream still holds: its log has ended.

    A key's last admitted instants go through the batch operator once more in front
    of its waiting requests: nothing was admitted between them, so they are again.
    May be called again; it writes the same.
    """
    if not exists(spark, f"{target}/checkpoint/state"):
        return

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                yield from _unpacked(data.as_py()).select(["packed"]).to_batches()

    waiting = _state(spark, target, "waiting").select("user_map_value.requests").mapInArrow(unpack, "packed array<string>")
    new = _unpack(waiting, schema).withColumns({"_old": F.lit(False), "_time": F.col(ts).cast("timestamp")})
    name = F.from_json("user_map_key.name", "array<string>")
    names = [_value(f, name[i]) for i, f in enumerate(_fields(schema, keys))]
    instants = _state(spark, target, "admitted").select(*names, F.explode("user_map_value.instants").alias("_at"))
    old = instants.select(*keys, F.timestamp_micros("_at").alias("_time"), F.lit(True).alias("_old"))
    pool = new.withColumn("_tie", F.xxhash64(*schema.names)).unionByName(old, allowMissingColumns=True)
    audited = admission_audit(pool, keys, "_time", limit, window_seconds, order_by=["_tie"])
    rest = audited.filter(~F.col("_old")).drop("_old", "_time", "_tie")
    rest.write.mode("overwrite").parquet(f"{target}/rest")


def read_verdicts(spark: SparkSession, target: str, schema: T.StructType) -> DataFrame:
    """The columns of the log and `admitted`, of all requests judged so far."""
    out = T.StructType([*schema.fields, T.StructField("admitted", T.BooleanType())])
    parts = [f"{target}/{name}" for name in ("verdicts", "rest") if exists(spark, f"{target}/{name}")]
    none = spark.createDataFrame([], out)
    return reduce(DataFrame.unionByName, [spark.read.schema(out).parquet(p) for p in parts], none)


def audit_files(
    spark: SparkSession,
    source: str,
    target: str,
    keys: Sequence[str],
    ts: str,
    glob: str | None = None,
    columns: Sequence[str] | None = None,
    limit: int = LIMIT,
    window_seconds: int = WINDOW_SECONDS,
    batch_files: int | None = None,
    lateness_seconds: int = LATENESS_SECONDS,
) -> DataFrame:
    """Judge all Parquet files of a folder, oldest first, as a stream, then read the verdicts back.

    `batch_files` bounds a micro-batch; it changes nothing in the verdicts of
    requests that are not late. A request older than the newest by more than the
    lateness when its micro-batch begins is.
    """
    pattern = f"{source.rstrip('/')}/{glob}" if glob else source
    reader = spark.readStream.schema(spark.read.parquet(pattern).schema)
    if batch_files is not None:
        reader = reader.option("maxFilesPerTrigger", batch_files)
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    log = reader.parquet(source)
    if columns is not None:
        log = log.select(*columns)
    rule = {"limit": limit, "window_seconds": window_seconds}
    run = admission_stream(log, target, keys, ts, lateness_seconds=lateness_seconds, available_now=True, **rule)
    run.awaitTermination()
    finish_stream(spark, target, keys, ts, log.schema, **rule)
    return read_verdicts(spark, target, log.schema)
