"""The quality classifier and the learned rules: exact statistics, held-out accuracy, odd rows."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import words
from trendcloud.llm import quality
from trendcloud.llm.quality import (
    STATISTICS,
    QualityModel,
    isotonic,
    keep_quality,
    learn_quality,
    quality_scores,
    statistics,
    text_statistics,
)
from trendcloud.llm.common import WordCodes
from trendcloud.llm.quality_rules import Rule, apply_rules, fit_rules, learn_rules, text_counts, verdict

LABELS = "doc_id long, quality int, toxic int"


def corpus(n=400):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        text = words(i, rng.randint(60, 200), "abcdefghijklmnopqrst")
        bad = i % 4 == 0
        if bad:
            kind = rng.randrange(3)
            text = (
                [w.upper() + "!!" for w in text] if kind == 0
                else [w + rng.choice(("***", "$$$", "###")) for w in text] if kind == 1
                else text[:2] * 60
            )
        rows.append((i, " ".join(text)))
        labels.append((i, int(not bad), 0))
    return rows, labels


@pytest.fixture(scope="module")
def labelled(spark, docs_of):
    rows, labels = corpus()
    return docs_of(rows, clashing=True), spark.createDataFrame(labels, LABELS), dict((a, b) for a, b, _ in labels)


def test_held_out_documents_are_scored_right(labelled):
    docs, labels, truth = labelled
    got = quality_scores(docs, labels).collect()
    assert len(got) == len(truth) and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"]]
    assert len(held) > 50
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.95


def test_labels_of_held_out_documents_do_not_matter(spark, labelled):
    docs, labels, _ = labelled
    turned = labels.withColumn(
        "quality", F.when(quality.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality"))
    )
    a, b = (sorted(quality_scores(docs, x).select("doc_id", "predicted").collect()) for x in (labels, turned))
    assert a == b


def test_partition_sums_do_not_depend_on_partitions(labelled):
    docs, labels, _ = labelled
    stats = docs.select("doc_id", text_statistics("text").alias("stats"))
    one = learn_quality(stats.coalesce(1), labels)
    many = learn_quality(stats.repartition(9), labels)
    x = np.random.default_rng(1).random((50, len(STATISTICS)))
    assert np.allclose(one.raw(x), many.raw(x), atol=1e-6)


def test_normal_equations_equal_a_direct_solution(spark, labelled):
    docs, labels, truth = labelled
    rows = docs.select(F.col("doc_id").alias("id"), text_statistics("text").alias("stats")).join(
        labels.select(F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("label")), "id"
    )
    model = quality.fit_quality(rows)
    aside = F.pmod(F.pmod(F.xxhash64("id"), F.lit(1_000_003)), F.lit(quality.CALIBRATION)) == 0
    got = rows.filter(~aside).collect()
    x = model.features(np.array([r["stats"] for r in got]))
    y = np.array([r["label"] for r in got])
    direct = np.linalg.solve(x.T @ x + quality.RIDGE * len(y) * np.eye(x.shape[1]), x.T @ y)
    assert np.allclose(x @ model.weights, x @ direct, atol=1e-4)


def test_random_features_approximate_a_gaussian_kernel():
    model = QualityModel()
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(40, len(STATISTICS))), rng.normal(size=(40, len(STATISTICS)))
    got = (model.features(a)[:, :-1] * model.features(b)[:, :-1]).sum(1)
    want = np.exp(-((a - b) ** 2).sum(1) / len(STATISTICS) / 2)
    assert np.abs(got - want).max() < 0.2


def test_isotonic_steps():
    knots, values = isotonic(np.array([0.0, 1, 2, 3]), np.array([0.2, 0.1, 0.6, 0.5]), np.array([1.0, 1, 1, 3]))
    assert (np.diff(values) >= 0).all() and np.allclose(values, [0.15, 0.525])
    assert np.allclose(knots, [0.5, 2.75])


def test_scores_of_odd_rows_and_without_labels(spark, docs_of, odd_rows):
    none = spark.createDataFrame([], LABELS)
    got = quality_scores(docs_of(odd_rows, clashing=True), none).collect()
    assert len(got) == len(odd_rows) and {round(r["score"], 2) for r in got} == {0.5}
    assert quality_scores(docs_of([]), none).collect() == []
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 1, None), (4, None, 0), (None, 1, 1), (7, 5, 0)], LABELS)
    assert len(quality_scores(docs_of(odd_rows), labels).collect()) == len(odd_rows)


def test_keeping_agrees_with_scores(labelled):
    docs, labels, _ = labelled
    kept = keep_quality(docs, labels)
    assert kept.columns == docs.columns
    want = {r["doc_id"] for r in quality_scores(docs, labels).collect() if r["predicted"]}
    assert {r["doc_id"] for r in kept.collect()} == want


def test_statistics_of_an_empty_text_are_zero():
    assert not statistics([b"", b"a b"], WordCodes())[0].any()


def brute_counts(text):
    text = text or ""
    w = re.findall("[^\x20\x09-\x0d]+", text)
    triples = Counter(zip(w, w[1:], w[2:]))
    covered = {j for i in range(len(w) - 2) if triples[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            repeated += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(covered)


def test_counts_of_odd_rows_are_exact(docs_of, odd_rows):
    rows = [*odd_rows, (20, "a b\na b\n a b\n\n\nc # | <x>\na b \x1c d"), (21, "a b c a b c a b"), (22, "q")]
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = docs_of(rows).select(text_counts("text").alias("c")).select(*(f"c.{n}" for n in names)).collect()
    assert sorted(map(tuple, got)) == sorted(brute_counts(t) for _, t in rows)


def test_rules_keep_good_documents_that_were_held_out(labelled):
    docs, labels, truth = labelled
    got = [r for r in apply_rules(docs, labels).collect() if not r["base_failed"]]
    held = [r for r in got if r["doc_id"] is not None]
    assert np.mean([r["kept"] == bool(truth[r["doc_id"]]) for r in held]) > 0.97


def test_rules_are_conditional_expressions(labelled):
    docs, labels, _ = labelled
    counts = docs.select("doc_id", text_counts("text").alias("c")).select("doc_id", "c.*")
    rules = fit_rules(counts, labels)
    assert rules and all(str(r).startswith("reject if ") for r in rules)
    expression = str(verdict(rules))
    assert "CASE WHEN" in expression.upper() and "udf" not in expression.lower()


def test_without_labels_the_base_test_decides(spark, docs_of, odd_rows):
    none = spark.createDataFrame([], LABELS)
    got = apply_rules(docs_of(odd_rows, clashing=True), none).collect()
    assert len(got) == len(odd_rows) and all(r["kept"] != r["base_failed"] for r in got)
    assert {r["doc_id"] for r in got if r["base_failed"]} >= {4, 5, 6, 7, 8, 13, 14}
    assert apply_rules(docs_of([]), none).collect() == []


def test_a_rule_is_cut_back_to_what_holds_on_other_rows():
    rng = np.random.default_rng(5)
    a, b = rng.random(3000), rng.random(3000)
    bad = (a > 0.8) & (b < 0.5)
    rules = learn_rules({"a": a, "b": b}, bad, np.arange(3000) % 3 == 0)
    covered = np.zeros(3000, bool)
    for rule in rules:
        covered |= rule.covers({"a": a, "b": b})
    assert (covered == bad).mean() > 0.99
    assert not learn_rules({"a": a}, np.zeros(3000, bool), np.arange(3000) % 3 == 0)
    assert Rule((("a", True, 0.5),)).covers({"a": np.array([0.4, 0.5])}).tolist() == [False, True]


def test_scores_are_those_of_a_direct_computation(labelled):
    """Every score from the statistics by the formula, with weights from the whole normal equations."""
    docs, labels, _ = labelled
    stats = docs.select("doc_id", text_statistics(F.col("text")).alias("stats"))
    model = learn_quality(stats, labels)
    rows = {r["doc_id"]: np.array(r["stats"], float) for r in stats.collect()}
    got = {r["doc_id"]: r["score"] for r in quality_scores(docs, labels).collect()}
    x = np.array([rows[i] for i in sorted(rows)])
    raw = model.features(x) @ model.weights
    level = np.interp(np.clip(raw, -3, 4), model.knots, model.values)
    expect = 0.998 * level + 0.002 * np.clip((np.clip(raw, -3, 4) + 1) / 3, 0, 1)
    assert np.allclose([got[i] for i in sorted(rows)], expect, atol=1e-3)


def test_only_labelled_texts_are_learned_from_and_all_stay_without_labels(spark, labelled, docs_of):
    docs, labels, truth = labelled
    kept = keep_quality(docs, labels)
    assert kept.columns == docs.columns
    scores = {r["doc_id"]: r["predicted"] for r in quality_scores(docs, labels).collect()}
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == {i for i, p in scores.items() if p}
    none = spark.createDataFrame([], LABELS)
    assert keep_quality(docs, none).count() == len(truth)
    assert keep_quality(docs_of([]), labels).count() == 0
