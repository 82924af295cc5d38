"""The language field against sums over all labellings, code-switched and odd texts."""

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trendcloud.llm import language_crf as crf
from trendcloud.llm.language_crf import (
    LanguageModel,
    _gradient,
    forward_backward,
    languages,
    learn_languages,
    ngrams,
    text_languages,
    word_hashes,
    word_languages,
    words_of,
)
from trendcloud.llm.queries import op11_language

SYLLABLES = {"aa": "ka lo mi tu ra".split(), "bb": "schn üb grö eit ung".split(), "cc": "дом рек лес зим вод".split()}


def prose(lang, n, seed):
    rng = random.Random(f"{lang}{seed}")
    return ["".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(n)]


def labelled(n=240):
    rows = []
    for i in range(n):
        lang = sorted(SYLLABLES)[i % 3]
        rows.append((i, " ".join(prose(lang, 20 + i % 50, i)), lang, "s", 0))
    return rows


@pytest.fixture(scope="module")
def corpus(spark, docs_of):
    return spark.createDataFrame(labelled(), docs_of([]).schema)


@pytest.fixture(scope="module")
def model(corpus):
    return learn_languages(corpus)


def test_words_and_ngrams():
    texts = ["Ab c", None, "", "É1xy-é  ", "  ", "数字 a" * 2]
    words = words_of(pa.array(["zz", *texts]).slice(1))
    got = [(int(t), words.marked[s + 1 : s + n - 1].tobytes().decode()) for t, s, n in zip(words.text, words.starts, words.sizes)]
    expect = [(i, w) for i, t in enumerate(texts) for w in re.findall(r"[a-z\x80-\U0010ffff]+", (t or "").lower())]
    assert got == expect
    hashes = word_hashes(words)
    assert (hashes[:, None] == hashes).tolist() == [[a[1] == b[1] for b in expect] for a in expect]
    grams = ngrams(words)
    for n, codes in zip((2, 3, 4), grams):
        assert (codes < crf.BUCKETS).sum() == sum(max(0, len(w.encode()) + 3 - n) for _, w in expect)


@pytest.mark.parametrize("chunk", [1, 3, 32])
def test_forward_backward_sums_over_all_labellings(monkeypatch, chunk):
    monkeypatch.setattr(crf, "CHUNK", chunk)
    rng = np.random.default_rng(chunk)
    lengths = np.array([5, 0, 1, 7, 2])
    scores, moves = rng.standard_normal((15, 3)) * 3, rng.standard_normal((3, 3))
    found, expected = forward_backward(scores, lengths, moves)
    truth, counted = np.zeros((15, 3)), np.zeros((3, 3))
    start = 0
    for n in lengths:
        total, here, pairs = 0.0, np.zeros((n, 3)), np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            if not n:
                continue
            weight = np.log(np.exp(moves[:, path[0]]).sum()) + sum(scores[start + t, y] for t, y in enumerate(path))
            weight = np.exp(weight + sum(moves[a, b] for a, b in zip(path, path[1:])))
            total += weight
            here[range(n), path] += weight
            for a, b in zip(path, path[1:]):
                pairs[a, b] += weight
        if n:
            truth[start : start + n] = here / total
            counted += pairs / total
        start += n
    assert np.allclose(found, truth, atol=1e-12) and np.allclose(expected, counted, atol=1e-12)


def test_gradient_is_the_slope_of_the_likelihood():
    texts, truth = [" ".join(prose(lang, 4, 1)) for lang in ("aa", "bb", "cc")], [0, 1, 2]
    rng = np.random.default_rng(0)
    words = words_of(pa.array(texts))
    lexicon = np.sort(word_hashes(words))[:3]
    weights, moves = rng.standard_normal((crf.BUCKETS + 4, 3)), rng.standard_normal((3, 3))
    weights[crf.BUCKETS] = 0

    def likelihood(weights, moves):
        model = LanguageModel(["aa", "bb", "cc"], lexicon, weights, moves)
        scores = model.scores(words, ngrams(words), model.entries(words))
        labels = np.array(truth)[words.text]
        path = scores[np.arange(len(labels)), labels].sum() + moves[labels[:-1], labels[1:]].sum()
        path += np.log(np.exp(moves[:, labels[0]]).sum())
        forward = np.log(np.exp(moves).sum(axis=0)) + scores[0]
        for row in scores[1:]:
            forward = np.log(np.exp(forward[:, None] + moves).sum(axis=0)) + row
        return path - np.log(np.exp(forward).sum())

    batch = pa.RecordBatch.from_arrays([pa.array(truth, pa.int32()), pa.array(texts)], names=["lang", "span"])
    model = LanguageModel(["aa", "bb", "cc"], lexicon, weights, moves)
    (got,) = list(_gradient(model)(iter([batch])))
    slope = np.frombuffer(got.column(0)[0].as_py(), np.float32).reshape(weights.shape)
    places = [(ngrams(words)[2][2], 1), (crf.BUCKETS + 2, 0), (ngrams(words)[0][0], 2)]
    for place in places:
        up, down = weights.copy(), weights.copy()
        up[place] += 1e-5
        down[place] -= 1e-5
        assert np.isclose((likelihood(up, moves) - likelihood(down, moves)) / 2e-5, slope[place], atol=1e-4)


def test_held_out_texts_are_told_right(corpus):
    got = languages(corpus.withColumns({c: F.lit("x") for c in ("id", "turn", "span", "runs", "lang_pred", "score")}))
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    truth = {r[0]: r[2] for r in labelled()}
    rows = got.collect()
    assert len(rows) == len(truth) and sum(r["held_out"] for r in rows) > 30
    assert all(r["lang_pred"] == truth[r["doc_id"]] and 0.9 < r["score"] <= 1 for r in rows)


def test_labels_and_ids_are_no_input(corpus):
    """Held-out labels change nothing; neither do other columns."""
    from trendcloud.llm.quality import held_out

    changed = corpus.withColumn("lang", F.when(held_out("doc_id"), "zz").otherwise(F.col("lang"))).withColumn("source", F.lit("t"))
    assert sorted(languages(changed).collect()) == sorted(languages(corpus).collect())


def test_words_of_a_text_that_switches(spark, model, docs_of):
    parts = [("aa", 9), ("bb", 12), ("aa", 6), ("cc", 8)]
    text = " ".join(w for i, (lang, n) in enumerate(parts) for w in prose(lang, n, 1000 + i))
    runs = word_languages(docs_of([(1, text), (2, None), (3, "")]), model).orderBy("doc_id").collect()
    assert [(r["lang"], r["length"]) for r in runs[0]["runs"]] == parts
    assert [r["start"] for r in runs[0]["runs"]] == [0, 9, 21, 27] and runs[1]["runs"] == runs[2]["runs"] == []
    row = text_languages(docs_of([(1, text)]), model).first()
    assert row["lang_pred"] == "aa" and abs(row["score"] - 15 / 35) < 0.05
    assert np.diagonal(model.transitions).min() > np.max(model.transitions - 100 * np.eye(3))


def test_odd_rows(spark, model, docs_of, odd_rows):
    rows = odd_rows + [(50, "12 !? 34"), (51, "😀 1"), (52, "a"), (53, " ".join(prose("bb", 50_000, 3)))]
    got = text_languages(docs_of(rows, clashing=True), model).collect()
    assert len(got) == len(rows)
    has_letter = {i: any(c.isalpha() for c in t or "") for i, t in rows}
    for r in got:
        assert r["doc_id"] is None or (r["lang_pred"] == "und") == (not has_letter[r["doc_id"]])
        assert 0 <= r["score"] <= 1 and (r["lang_pred"] != "und" or r["score"] == 0)
    assert {r["lang_pred"] for r in got if r["doc_id"] == 53} == {"bb"}


def test_tables_with_one_language_none_or_no_rows(spark, docs_of):
    schema = docs_of([]).schema
    texts = [(1, "ab", "s"), (3, "cd", "s"), (4, None, "s")]
    one = languages(spark.createDataFrame([(i, t, "aa", s, 0) for i, t, s in texts], schema)).collect()
    assert {(r["doc_id"], r["lang_pred"], r["score"]) for r in one} == {(1, "aa", 1.0), (3, "aa", 1.0), (4, "und", 0.0)}
    none = languages(spark.createDataFrame([(i, t, None, s, 0) for i, t, s in texts], schema)).collect()
    assert {(r["lang_pred"], r["score"]) for r in none} == {("und", 0.0)} and len(none) == 3
    assert languages(docs_of([])).collect() == []


def test_registered_query_tells_the_held_out_texts(spark):
    path = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{path}/documents.parquet")
    got = op11_language(spark, path).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)
