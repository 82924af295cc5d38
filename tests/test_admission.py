"""Admission against a plain loop, in batch and as a stream."""

import random
from collections import Counter
from datetime import datetime, timedelta
from decimal import Decimal
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trendcloud.operators import admission, segments
from trendcloud.streaming import admission as streaming
from trendcloud.streaming.admission import admission_stream, audit_files, finish_stream, read_verdicts, verdict_stream

START = datetime(2024, 1, 1)
LOG = "id bigint, ip string, endpoint string, ts timestamp"


def loop(hits, limit, window):
    """Verdicts for ascending times in seconds."""
    kept, out = [], []
    for t in hits:
        kept = [k for k in kept if t - k < window]
        out.append(len(kept) < limit)
        if out[-1]:
            kept.append(t)
    return out


def log_of(spark, hits):
    rows = [
        (i, ip, endpoint, START + timedelta(seconds=t)) for i, (ip, endpoint, t) in enumerate(hits)
    ]
    return spark.createDataFrame(rows, LOG)


def verdicts(df):
    return {r.id: r.admitted for r in df.collect()}


def audit(spark, times, **kwargs):
    df = log_of(spark, [("a", "x", t) for t in times])
    got = verdicts(admission.admission_audit(df, ["ip", "endpoint"], "ts", order_by=["id"], **kwargs))
    return [got[i] for i in range(len(times))]


def test_five_in_a_minute(spark):
    times = [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 60]
    assert audit(spark, times) == [True] * 5 + [False] * 2 + [True]


def test_refused_requests_do_not_count(spark):
    assert audit(spark, [0, 0, 0, 0, 0, 30, 61]) == [True] * 5 + [False, True]


def random_hits(rng, n):
    hits = []
    for ip in "ab":
        for endpoint in ("collect", "data"):
            t = 0
            for _ in range(n):
                # Bursts, instants with many requests, quiet spells around the window's length.
                t += rng.choice([0, 0, 0, 1, 2, 5, 11, 19, 20, 21, 40, rng.randrange(60)])
                hits.append((ip, endpoint, t))
    return hits


@pytest.mark.parametrize("limit,window", [(5, 60), (1, 20), (2, 20), (3, 7)])
def test_equals_plain_loop(spark, limit, window):
    hits = random_hits(random.Random(limit), 400)
    df = log_of(spark, hits).repartition(5)
    got = verdicts(
        admission.admission_audit(df, ["ip", "endpoint"], "ts", limit, window, order_by=["id"])
    )
    expect, totals = {}, {}
    for key in {(h[0], h[1]) for h in hits}:
        ids = [i for i, h in enumerate(hits) if (h[0], h[1]) == key]
        passed = loop([hits[i][2] for i in ids], limit, window)
        expect.update(zip(ids, passed))
        totals[key] = (len(ids), sum(passed), len(ids) - sum(passed))
    assert got == expect
    summary = admission.admission_summary(df, ["ip", "endpoint"], "ts", limit, window)
    assert {(r[0], r[1]): tuple(r)[2:] for r in summary.collect()} == totals


def test_walk_over_small_batches(spark):
    """State goes on from one Arrow batch to the next."""
    hits = random_hits(random.Random(9), 200)
    df = log_of(spark, hits)
    whole = verdicts(admission.admission_audit(df, ["ip", "endpoint"], "ts", order_by=["id"]))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert verdicts(admission.admission_audit(df, ["ip", "endpoint"], "ts", order_by=["id"])) == whole
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_quiet_spells_cut_a_key(spark):
    df = log_of(spark, [("a", "x", t) for t in (0, 59, 118, 178, 237, 1000)])
    instants = df.groupBy("ip", admission._micros("ts").alias("_at")).count()
    sliced = instants.withColumn("_slice", F.expr("_at div 60000000"))
    cut = admission._segments(sliced, ["ip"], 60_000_000, 1000).collect()
    assert len({r["_stretch"] for r in cut}) == 3 and {r["_segment"] for r in cut} == {0} == {r["_last"] for r in cut}


@pytest.mark.parametrize("rows,fan", [(1, 16), (7, 2)])
def test_segments_of_a_key_that_never_pauses(spark, monkeypatch, rows, fan):
    """Walked apart, each from the state that the composed tables give."""
    monkeypatch.setattr(segments, "FAN", fan)
    rng = random.Random(rows)
    hits, t = [], -3000  # instants before 1970 have slices below zero
    for _ in range(500):
        t += rng.choice([0, 1, 3, 7, 11, 19])
        hits.append(("a", "x", t))
    df = log_of(spark, hits)
    found = admission.admitted_instants(df, ["ip"], "ts", 3, 20, segment_rows=rows)
    passed = Counter()
    for (_, _, at), ok in zip(hits, loop([h[2] for h in hits], 3, 20), strict=True):
        passed[int((START + timedelta(seconds=at) - datetime(1970, 1, 1)).total_seconds()) * 1_000_000] += ok
    assert {r["_at"]: r["_admitted"] for r in found.collect()} == dict(passed)


def state_after(at, requests, state, limit, window):
    """Admitted instants and the state left, by letting requests in one by one."""
    walk = admission.Admission(limit, window, state)
    passed = walk.admit(at, requests)
    return passed, walk.admitted[-limit:]


@pytest.mark.parametrize("limit,window", [(1, 10), (2, 10), (5, 60), (3, 1)])
def test_composed_tables_do_what_walks_do(limit, window):
    """Tables of four segments as one, against walking through them."""
    rng = np.random.default_rng(limit)
    for _ in range(200):
        at = np.unique(np.cumsum(rng.choice([1, 1, 2, 3, window // 2 + 1, window - 1 or 1], 60)))
        requests = rng.integers(1, limit + 3, len(at))
        cuts = np.append(np.sort(rng.choice(np.arange(1, len(at)), 4, replace=False)), len(at))
        parts = [slice(a, b) for a, b in zip(cuts, cuts[1:])]
        first = [segments.segment_table(at[p], requests[p], limit, window, 3 * limit) for p in parts]
        whole = segments.Table(first[0].entries, first[0].counts, first[0].exits[:, -2 * limit :])
        for table in first[1:]:
            whole = segments.joined(whole, table, limit, window)
        _, state = state_after(at[: cuts[0]], requests[: cuts[0]], [], limit, window)
        row = np.array([[segments.NONE] * (limit - len(state)) + state], np.int64)
        expect, left = state_after(at[cuts[0] :], requests[cuts[0] :], state, limit, window)
        count, got = segments.follow(whole, row, limit, window)
        live = [t for t in got[0].tolist() if t > at[-1] - window]
        assert count[0] == expect.sum() and live == [t for t in left if t > at[-1] - window]


@pytest.mark.parametrize("offset", [0, 7])
def test_a_key_that_never_pauses_is_walked_once_whatever_its_phase(spark, monkeypatch, offset):
    """A saturated log keeps its phase for ever; rounds grow with the logarithm of its segments."""
    made = []
    for name in ("composed", "first_tables"):
        old = getattr(segments, name)
        monkeypatch.setattr(segments, name, lambda *a, old=old, name=name: (made.append(name), old(*a))[1])
    walks = []
    monkeypatch.setattr(admission, "_walk", lambda *a, old=admission._walk: (walks.append(1), old(*a))[1])
    monkeypatch.setattr(segments, "FAN", 3)
    df = spark.range(100_000).selectExpr("'a' ip", f"timestamp_micros(id * 50000 + {offset * 1_000_000}) ts")
    found = admission.admitted_instants(df, ["ip"], "ts", 5, 60, segment_rows=4_000)
    assert found.groupBy("_admitted").count().count() == 2
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the data are few
    try:
        tasks = found.select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert tasks > 1 and found.agg(F.sum("_admitted")).first()[0] == 5 * -(-100_000 * 50 // 60_000)
    # 21 segments or so: two rounds of threes; one walk of the short keys, one of the long.
    assert made == ["first_tables", "composed", "composed"] and len(walks) == 2


def test_rounds_grow_with_the_logarithm():
    assert [segments.rounds(n) for n in (1, 16, 17, 256, 257, 4096, 1_000_000)] == [0, 0, 1, 1, 2, 2, 4]


def test_leaps_over_refused_instants():
    state = admission.Admission(2, 1_000_000)
    at = np.arange(0, 5_000_000, 10)
    out = state.admit(at, np.ones(len(at), dtype=np.int64))
    assert out.sum() == 10
    assert np.flatnonzero(out).tolist() == [s * 100_000 + i for s in range(5) for i in (0, 1)]


def test_requests_without_time_or_key(spark):
    df = spark.createDataFrame(
        [(0, "a", "x", None), (1, None, "x", START), (2, "a", "x", START)], LOG
    )
    got = verdicts(admission.admission_audit(df, ["ip", "endpoint"], "ts"))
    assert got == {0: None, 1: None, 2: True}


def test_empty_log(spark):
    df = spark.createDataFrame([], LOG)
    assert admission.admission_audit(df, ["ip"], "ts").count() == 0
    assert admission.admission_summary(df, ["ip"], "ts").count() == 0


def test_bad_rule(spark):
    with pytest.raises(ValueError):
        admission.admission_summary(spark.createDataFrame([], LOG), ["ip"], "ts", limit=0)


def in_files(df, path, cuts):
    """One file per range of ids."""
    for low, high in zip(cuts, cuts[1:]):
        part = df.filter(f"id >= {low} and id < {high}")
        part.coalesce(1).write.mode("append").parquet(path)


@pytest.mark.parametrize("batch_files", [1, None])
def test_stream_equals_batch_whatever_the_files(spark, tmp_path, batch_files):
    """Eight files of shuffled requests, one at a time or all at once, row by row."""
    hits = random_hits(random.Random(3), 60)
    df = log_of(spark, hits)
    batch = verdicts(admission.admission_audit(df, ["ip", "endpoint"], "ts"))
    path = str(tmp_path / "log")
    df.repartition(8).write.parquet(path)
    rule = {"batch_files": batch_files, "lateness_seconds": 1_000_000}
    got = audit_files(spark, path, str(tmp_path / "out"), ["ip", "endpoint"], "ts", **rule)
    assert got.count() == len(hits) and verdicts(got) == batch


def test_stream_judges_as_the_watermark_passes(spark, tmp_path):
    """Files in the order of time, state carried over steps, and requests that come too late."""
    hits = sorted(random_hits(random.Random(4), 40), key=lambda h: h[2])
    late = [("a", "data", 1), ("b", "data", 2)]
    df = log_of(spark, hits + late)
    batch = verdicts(admission.admission_audit(df.filter(f"id < {len(hits)}"), ["ip", "endpoint"], "ts"))
    path, n = str(tmp_path / "log"), len(hits)
    in_files(df, path, [0, n // 3, 2 * n // 3, n, n + 2])
    out = str(tmp_path / "out")
    got = audit_files(spark, path, out, ["ip", "endpoint"], "ts", batch_files=1, lateness_seconds=30)
    found = verdicts(got)
    assert got.count() == n + 2 and found[n] is None and found[n + 1] is None
    assert {i: v for i, v in found.items() if i < n} == batch
    judged = spark.read.parquet(f"{out}/verdicts").count()
    assert n > judged > 2 * n // 3, "most verdicts come before the log has ended"


def test_a_stream_that_was_stopped_goes_on(spark, tmp_path):
    hits = sorted(random_hits(random.Random(6), 30), key=lambda h: h[2])
    df, n = log_of(spark, hits), len(hits)
    batch = verdicts(admission.admission_audit(df, ["ip", "endpoint"], "ts"))
    path, out = str(tmp_path / "log"), str(tmp_path / "out")
    for low, high in ((0, n // 2), (n // 2, n)):
        in_files(df, path, [low, high])
        log = spark.readStream.schema(LOG).parquet(path)
        admission_stream(log, out, ["ip", "endpoint"], "ts", lateness_seconds=5, available_now=True).awaitTermination()
    for _ in range(2):
        finish_stream(spark, out, ["ip", "endpoint"], "ts", log.schema)
    got = read_verdicts(spark, out, log.schema)
    assert got.count() == n and verdicts(got) == batch


def test_each_step_writes_in_proportion_to_its_batch(spark, tmp_path):
    """Twenty files of as many requests each: later steps write no more state than earlier ones."""
    path, out = str(tmp_path / "log"), tmp_path / "out"
    for k in range(20):
        rows = spark.range(400).selectExpr("id", "concat('k', id % 7) ip", "'x' endpoint", f"timestamp_seconds({k} * 400 + id) ts")
        rows.coalesce(1).write.mode("append").parquet(path)
    audit_files(spark, path, str(out), ["ip"], "ts", batch_files=1, lateness_seconds=100)
    sizes = {}
    for file in (out / "checkpoint" / "state").rglob("*.changelog"):
        step = int(file.name.split(".")[0].split("_")[0])
        sizes[step] = sizes.get(step, 0) + file.stat().st_size
    steps = [sizes[k] for k in sorted(sizes)]
    assert len(steps) >= 20 and max(steps[10:20]) < 1.5 * max(steps[2:8])


class Messages:
    """The state of one group, as a handle, a map and the time; counts what is asked of it."""

    def __init__(self):
        self.maps, self.timers, self.sent = {}, set(), 0

    def getMapState(self, name, *_):
        held, state = self.maps.setdefault(name, {}), SimpleNamespace()
        calls = {"getValue": held.get, "containsKey": held.__contains__, "updateValue": held.__setitem__,
                 "removeKey": held.pop, "keys": lambda: list(held)}
        for call, does in calls.items():
            setattr(state, call, lambda *a, does=does: (self.count(), does(*a))[1])
        return state

    def getValueState(self, name, *_):
        held = self.getMapState(name)
        return SimpleNamespace(exists=lambda: held.containsKey(0), get=lambda: held.getValue(0), update=lambda v: held.updateValue(0, v))

    def count(self):
        self.sent += 1

    def registerTimer(self, at):
        self.count()
        assert at not in self.timers
        self.timers.add(at)

    def batch(self, judge, frames, mark):
        judge.init(self)
        time = SimpleNamespace(getCurrentWatermarkInMs=lambda: mark)
        out = list(judge.handleInputRows((0,), iter(frames), time))
        for at in sorted(t for t in self.timers if t <= mark):
            out += judge.handleExpiredTimer((0,), time, SimpleNamespace(getExpiryTimeInMs=lambda at=at: at))
            self.timers.remove(at)
        return {r[0][0]: r[1] for f in out for r in zip(f["packed"], f["admitted"])}


def frame_of(hits):
    return pd.DataFrame([(f"k{k}", at, i, [str(i)]) for i, k, at in hits], columns=["name", "at", "tie", "packed"])


def test_state_is_asked_for_few_things_whatever_the_requests():
    """A week of 20 keys in one file: each request has a slice of the lateness to itself."""
    state, hour = Messages(), 3_600_000
    judge = streaming.Judge(5, 86_400 * 10**6, hour // 16)
    hits = [(i, i % 20, i * 600 * 10**6) for i in range(1000)]
    assert state.batch(judge, [frame_of(hits)], 0) == {}
    assert len(state.batch(judge, [], 1000 * 600_000)) == 1000
    assert state.sent < 100


@pytest.mark.parametrize("bundle, pending", [(1, 1), (3, 40), (1 << 12, 1 << 18)])
def test_verdicts_hold_however_requests_are_bundled(monkeypatch, bundle, pending):
    monkeypatch.setattr(streaming, "BUNDLE_ROWS", bundle)
    monkeypatch.setattr(streaming, "PENDING_ROWS", pending)
    rng, lateness = random.Random(9), 160_000
    hits = [(i, rng.randrange(7), i * 10**6 + rng.randrange(90 * 10**6)) for i in range(1500)]
    want = {}
    for k in range(7):
        own = sorted((at, i) for i, key, at in hits if key == k)
        walk = admission.Admission(5, 60 * 10**6)
        want |= {str(i): bool(walk.admit(np.array([at]), np.array([1]))[0]) for at, i in own}
    state, judge, got, newest = Messages(), streaming.Judge(5, 60 * 10**6, 10_000), {}, 0
    while hits:
        n = rng.choice([5, 30, 400])
        part, hits = hits[:n], hits[n:]
        a, b = sorted(rng.randrange(n) for _ in range(2))
        got |= state.batch(judge, [frame_of(p) for p in (part[:a], part[a:b], part[b:]) if p], max(0, newest // 1000 - lateness))
        newest = max(newest, *(h[2] for h in part))
    got |= state.batch(judge, [], 10**7)
    assert got == want and not state.maps["waiting"]


def test_stream_keeps_what_it_cannot_judge_and_all_types(spark, tmp_path):
    kind = LOG + ", price decimal(20,4), bytes binary, tags array<struct<a:bigint,b:string>>, near double, day date"
    more = (Decimal("12345678901234.5678"), b"\x00\xff", [(2**60, None), (1, "\u00e9")], 0.1, START.date())
    none = (None,) * 5
    rows = [(0, "a", None, START, *more), (2**53 + 1, "a", None, None, *none), (None, None, "x", START, *more),
            (3, "a", "y", START + timedelta(microseconds=1), *none)]
    path = str(tmp_path / "log")
    df = spark.createDataFrame(rows, kind)
    df.write.parquet(path)
    got = audit_files(spark, path, str(tmp_path / "out"), ["ip"], "ts")
    passed = F.when(F.col("ip").isNotNull() & F.col("ts").isNotNull(), True)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, df.withColumn("admitted", passed).collect()))


def test_settings_of_the_session_stay(spark, tmp_path):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    path = str(tmp_path / "log")
    log_of(spark, []).write.parquet(path)
    assert audit_files(spark, path, str(tmp_path / "out"), ["ip"], "ts").count() == 0
    assert spark.conf.get(name) == before
    with pytest.raises(ValueError):
        verdict_stream(spark.readStream.schema(LOG).parquet(path), ["ip"], "ts", lateness_seconds=-1)
