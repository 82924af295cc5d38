"""The registered queries against their SQL and the pipeline against its operators."""

import hashlib
import os
import re
import sys
from collections import Counter

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import corpus_pipeline  # noqa: E402
from compare import compare, duck  # noqa: E402
from trendcloud.llm.queries import QUERIES, SQL  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_there_is_one_query_for_each_operator():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))
    assert SQL.keys() <= QUERIES.keys()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    con = duck(SF_DIR)
    assert compare(spark, con, QUERIES[name], SQL[name], SF_DIR) == ""
    con.close()


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys() - {"op12_whitening"}))
def test_query_returns_a_row_for_every_document(spark, name):
    n = spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
    rows = QUERIES[name](spark, SF_DIR).count()
    assert rows == n if name != "op5_nearest" else rows > 0


def test_stages_keep_the_columns_and_take_what_the_last_one_kept(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, SF_DIR), name)
        assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] >= sizes[2] >= sizes[3] > 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR)
    assert last.count() == sizes[-1]


def test_stages_take_odd_rows_and_none(spark, docs_of, odd_rows, tmp_path):
    """Without labels quality is unknown and all stay; near copies go, rows without an id do not."""
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for rows in (odd_rows, []):
        docs, seen = docs_of(rows), {}
        for name, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.stored(stage(spark, docs, str(tmp_path)), name)
            seen[name] = [r["doc_id"] for r in docs.collect()]
        ids = {i for i, _ in rows}
        assert len(seen["quality_classifier"]) == len(rows)
        assert set(seen["ngram_join"]) == ids - {2, 3, 8}
        assert set(seen["substring_dedup"]) <= ids - {2, 3, 8} and ({1, 9, None} & ids) <= set(seen["substring_dedup"])
        assert set(seen["mixing"]) <= set(seen["substring_dedup"]) and len(seen["byte_bpe"]) == len(seen["mixing"])
        assert bool(rows) == bool(seen["byte_bpe"])


def test_pipeline_equals_its_stages_by_brute_force(spark):
    """Rows of every stage against plain Python over the stage's own input."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    rows = {name: None for name in steps}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, SF_DIR), name)
        rows[name] = docs.collect()
    kept = {r["doc_id"]: r["text"] for r in rows["quality_classifier"]}

    def grams(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets = {i: grams(t) for i, t in kept.items()}
    group = {i: i for i in kept}
    for _ in kept:  # the smallest id spreads along links until nothing changes
        before = dict(group)
        for a in kept:
            for b in kept:
                if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    group[a] = group[b] = min(group[a], group[b])
        if group == before:
            break
    ones = {i for i in kept if group[i] == i}
    assert {r["doc_id"] for r in rows["ngram_join"]} == ones
    seen, expect = {}, {}
    for i in sorted(ones):
        words = re.findall(r"[^\x20\x09-\x0D]+", kept[i] or "")
        windows = [tuple(words[k : k + 50]) for k in range(len(words) - 49)]
        gone = {k + j for k, w in enumerate(windows) if seen.get(w, i) < i for j in range(50)}
        for w in windows:
            seen.setdefault(w, i)
        if not gone or len(gone) < len(words):
            expect[i] = " ".join(w for k, w in enumerate(words) if k not in gone) if gone else kept[i]
    assert {r["doc_id"]: r["text"] for r in rows["substring_dedup"]} == expect
    sources = Counter(r["source"] for r in rows["mixing"])
    assert set(sources) <= {r["source"] for r in rows["substring_dedup"]}
    assert {(r["doc_id"], r["text"]) for r in rows["mixing"]} <= set(expect.items())
    digests = Counter((r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in rows["mixing"])
    assert Counter((r["doc_id"], r["decoded_sha256"]) for r in rows["byte_bpe"]) == digests
