"""Chat formatting and source mixing: exact round trips, masks and draws."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trendcloud.llm.chat import chat_report, escape, format_conversations, read_loss, read_turns, unescape
from trendcloud.llm.mixing import mix_sources, poisson_steps, tempered_rates, unit

SCHEMA = "conv_id long, turn long, role string, text string"
NASTY = [
    "", None, "<|end|>", "<|turn|>user<|text|>hi<|end|>", r"<\|end|>", r"<\\|text|>", "</s>[INST] ok [/INST]", r"<\s> <\\/s>",
    "<<SYS>>", r"[\INST]", "<", "<|", "|>", "\\", "$1 \\1", "<<|next|>>", "é😀<|next|>\n", "<" * 5 + "|", "[" + "\\" * 7 + "/INST]",
]


def conversations(seed=1):
    rng = random.Random(seed)
    rows = []
    for c in range(60):
        for t in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant", "assistant", "system", "<|text|>", None, ""])
            rows.append((c, t, role, " ".join(filter(None, rng.choices(NASTY + ["plain words"], k=3))) or rng.choice(NASTY)))
    return rows


def test_escaping_is_reversible_and_leaves_no_control_string(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choices(["<", "[", "\\", "|", "/", "s>", "INST]", "SYS>>", "end|>", "x", "é"], k=12)) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts + [n for n in NASTY if n]], "t string")
    got = df.select("t", escape(F.col("t")).alias("e"), unescape(escape(F.col("t"))).alias("u")).collect()
    assert all(r["t"] == r["u"] for r in got)
    for mark in ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>"):
        assert not any(mark in r["e"] for r in got)


def test_turns_and_loss_are_read_back(spark):
    rows = conversations()
    shuffled = rows.copy()
    random.Random(2).shuffle(shuffled)
    df = spark.createDataFrame(shuffled, SCHEMA).withColumns({c: F.lit("x") for c in ("turns", "blocks", "mask", "formatted")})
    done = format_conversations(df)
    got = done.select(
        "conv_id", "formatted", "mask",
        read_turns(F.col("formatted")).alias("turns"),
        read_loss(F.col("formatted"), F.col("mask")).alias("loss"),
    ).collect()
    want = {}
    for c, _, role, text in rows:
        want.setdefault(c, []).append((role or "", text or ""))
    assert {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in got} == want
    for r in got:
        assert r["loss"] == [t for role, t in want[r["conv_id"]] if role == "assistant"]
        assert sum(m["n_chars"] for m in r["mask"]) == len(r["formatted"])
        merged = [x for i, x in enumerate(want[r["conv_id"]]) if i == 0 or x[0] != want[r["conv_id"]][i - 1][0]]
        assert r["formatted"].count("<|turn|>") == len(merged)


def test_report_of_a_conversation(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 2, "assistant", "<|end|>")]
    (r,) = chat_report(spark.createDataFrame(rows, SCHEMA)).collect()
    turns = "user\na\nassistant\nb\nassistant\n<|end|>\n"
    assert (r["n_turns"], r["turns_sha256"]) == (3, hashlib.sha256(turns.encode()).hexdigest())
    assert (r["loss_chars"], r["loss_sha256"]) == (8, hashlib.sha256(b"b<|end|>").hexdigest())
    assert r["formatted_chars"] == len(r"<|turn|>user<|text|>a<|end|><|turn|>assistant<|text|>b<|next|><\|end|><|end|>")


def test_odd_conversations(spark):
    rows = [(None, 0, "user", "x"), (None, None, "assistant", None), (2, 0, None, None), (3, 0, "assistant", ""), (4, 1, "user", "r"), (4, 1, "user", "r")]
    got = {r["conv_id"]: r for r in chat_report(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {c: r["n_turns"] for c, r in got.items()} == {None: 2, 2: 1, 3: 1, 4: 2}
    assert got[None]["turns_sha256"] == hashlib.sha256(b"assistant\n\nuser\nx\n").hexdigest()
    assert got[3]["loss_chars"] == 0
    assert chat_report(spark.createDataFrame([], SCHEMA)).collect() == []


def test_a_long_conversation_is_linear(spark):
    rows = spark.range(30_000).select(
        F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("text "), F.col("id")).alias("text"),
    )
    (r,) = chat_report(rows).collect()
    assert r["n_turns"] == 30_000


def test_only_expressions_run(spark):
    plan = chat_report(spark.createDataFrame(conversations(), SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def documents(docs_of, n=3000):
    return docs_of([(i, "x" * (5 + i % 7)) for i in range(n)])


def test_copies_follow_the_distribution(docs_of, spark):
    rates = spark.createDataFrame([("hot", 0.4), ("s1", 2.5), ("s2", 0.0)], "source string, rate double")
    got = mix_sources(documents(docs_of), rates).groupBy("source", "doc_id").agg(F.count("*").alias("n"), F.max("n_copies").alias("m")).collect()
    assert {r["source"] for r in got} == {"hot", "s1"} and all(r["n"] == r["m"] for r in got)
    ids = {s: [r["doc_id"] for r in documents(docs_of).collect() if r["source"] == s] for s in ("hot", "s1")}
    counts = {r["doc_id"]: r["n"] for r in got}
    for source, rate in (("hot", 0.4), ("s1", 2.5)):
        n = np.array([counts.get(i, 0) for i in ids[source]])
        assert abs(n.mean() - rate) < 4 * np.sqrt(rate / len(n)) and abs(n.var() / rate - 1) < 0.3


def test_draws_are_the_inverse_of_the_distribution(spark):
    steps = poisson_steps(spark.createDataFrame([("a", 0.7), ("b", 800.0)], "source string, rate double")).collect()
    for r in steps:
        rate = {"a": 0.7, "b": 800.0}[r["source"]]
        pmf, total = np.exp(-rate) if rate < 700 else 0.0, 0.0
        if rate < 1:
            for k, s in enumerate(r["steps"][:12]):
                total += pmf
                assert abs(s - total) < 1e-12
                pmf *= rate / (k + 1)
        assert all(a <= b for a, b in zip(r["steps"], r["steps"][1:])) and abs(r["steps"][-1] - 1) < 1e-9
    (u,) = spark.range(1).select(unit(F.lit(17), F.lit("5")).alias("u")).first()
    assert u == int(hashlib.md5(b"17/5").hexdigest()[:13], 16) / 2**52


def test_tempered_rates_keep_the_corpus_size(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 10_000), ("c", 0)], "source string, size long")
    got = {r["source"]: r["rate"] for r in tempered_rates(sizes).collect()}
    assert got.keys() == {"a", "b"}
    assert got["a"] * 100 + got["b"] * 10_000 == pytest.approx(10_100)
    assert got["b"] * 10_000 / (got["a"] * 100) == pytest.approx(10)


def test_mixing_odd_rows(docs_of, odd_rows, spark):
    docs = docs_of(odd_rows, clashing=True).withColumn("source", F.when(F.col("doc_id") % 2 == 0, F.col("source")))
    rates = spark.createDataFrame([(None, 3.0), ("hot", 1.0), ("s1", 1.0), ("s2", 1.0), ("s3", 1.0)], "source string, rate double")
    got = mix_sources(docs, rates)
    assert got.columns == [c for c in docs.columns if c != "copy"] + ["copy", "n_copies"]
    rows = got.collect()
    assert rows and all(1 <= r["copy"] <= r["n_copies"] for r in rows)
    again = mix_sources(docs.repartition(5), rates).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert mix_sources(docs_of([])).collect() == []
    assert mix_sources(docs_of([(1, None), (2, "")])).collect() == []


def test_the_shuffle_is_global(docs_of):
    got = [r["doc_id"] for r in mix_sources(documents(docs_of)).collect()]
    assert abs(np.corrcoef(np.arange(len(got)), got)[0, 1]) < 0.1
