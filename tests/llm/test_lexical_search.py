"""Lexical search against scores worked out term by term."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import words
from trendcloud.llm import lexical_search
from trendcloud.llm.lexical_search import Best, Queries, build_treap, search_block, search_index, terms_of, write_index

ITEMS = "item_id long, text string"


def terms(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def brute(docs, items, places=20):
    held = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    n = sum(size > 0 for _, _, size in held)
    total = sum(size for _, _, size in held)
    df = Counter(t for _, found, _ in held for t in found)
    out = []
    for item, text in dict.fromkeys(items):
        scores = []
        for i, found, size in held:
            if not size:
                continue
            m = 75 + 25 * size * n // total
            score = 0
            for t in terms(text):
                if found[t]:
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                    score += w * (1_000_000_000 * found[t] // (1000 * found[t] + 12 * m))
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        for rank, (score, _, _, i) in enumerate(sorted(scores)[:places], start=1):
            out.append((item, rank, i, -score))
    return sorted(out, key=repr)


def search(spark, tmp_path, docs, items, **kwargs):
    path = str(tmp_path / f"index{random.random()}")
    write_index(docs, path)
    got = search_index(spark, path, spark.createDataFrame(items, ITEMS), **kwargs)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in got.collect()), key=repr)


def test_terms_are_those_of_the_pattern():
    for text in ("", "A-b_C 9Z\x7f\x80é ÀÉΑ x\x00y", "".join(map(chr, range(0x300))), "数字😀 a"):
        assert [t.decode() for t in terms_of(text.encode())] == terms(text)


@pytest.mark.parametrize("size", [(1, 1), (3, 40), (40, 3), (64, 64), (200, 90)])
def test_a_tree_holds_its_cells_and_their_maxima(size):
    rng = np.random.default_rng(size[0])
    for share in (0.02, 0.3, 1.0):
        place = np.flatnonzero(rng.random(size[0] * size[1]) < share)
        rows, columns = np.divmod(place, size[1])
        values = rng.integers(1, 1000, len(place))
        tree = build_treap(rows, columns, values)
        # Walk down to every cell.
        found, todo = {}, [(0, 0)] if len(place) else []
        while todo:
            square, level = todo.pop()
            child = tree.first[square]
            for quarter in range(4):
                if tree.masks[square] >> quarter & 1:
                    if tree.single[child]:
                        c = tree.cell[child]
                        found[tree.rows[c], tree.columns[c]] = tree.peaks[child]
                    else:
                        s = tree.square[child]
                        inside = tree.peaks[tree.first[s] : tree.first[s] + bin(tree.masks[s]).count("1")]
                        assert tree.peaks[child] == inside.max()
                        todo.append((s, level + 1))
                    child += 1
        assert found == {(r, c): v for r, c, v in zip(rows.tolist(), columns.tolist(), values.tolist())}


def test_most_of_the_grid_is_never_looked_at(monkeypatch):
    """Ranges without rivals of the best documents are dropped unopened."""
    rng = np.random.default_rng(3)
    rows, columns = np.divmod(np.flatnonzero(rng.random(50 * 4096) < 0.5), 4096)
    values = rng.integers(1, 100, len(rows))
    values[np.isin(columns, (7, 2000))] = 10_000
    tree = build_treap(rows, columns, values)
    seen = []
    monkeypatch.setattr(Best, "add", lambda self, *a, old=Best.add: (seen.append(len(a[0])), old(self, *a))[1])
    best = Best(1, 2)
    terms = np.arange(50, dtype=np.uint64)
    ids = np.arange(4096)
    search_block(tree, terms, ids, np.ones(4096, bool), Queries(np.array([0, 50]), terms, np.ones(50, np.int64)), best)
    assert best.id.tolist() == ([7, 2000] if best.score[0] >= best.score[1] and best.id[0] == 7 else [2000, 7])
    assert sum(seen) < 200


def test_equals_brute_force_on_odd_rows(spark, docs_of, odd_rows, tmp_path, monkeypatch):
    hot = "".join("the same few words again ")
    rows = odd_rows + [(100 + i, hot + (" more" if i % 7 == 0 else "")) for i in range(90)]
    items = [(1, rows[0][1][:200]), (2, "ONE two"), (3, None), (4, "?! -"), (5, "the SAME same words"), (6, "größe 数字"),
             (6, "größe 数字"), (6, "few few again"), (None, "again"), (7, "absent")]
    expect = brute(rows, items)
    for terms_a_block, bundle in ((1 << 21, 24), (300, 1)):
        monkeypatch.setattr(lexical_search, "BLOCK_TERMS", terms_a_block)
        monkeypatch.setattr(lexical_search, "BUNDLE", bundle)
        assert search(spark, tmp_path, docs_of(rows, clashing=True).repartition(3), items) == expect


def test_random_corpora_and_chunks(spark, docs_of, tmp_path, monkeypatch):
    monkeypatch.setattr(lexical_search, "CHUNK_BYTES", 2000)
    rng = random.Random(5)
    vocabulary = words(5, 120)
    rows = [(i, " ".join(rng.choices(vocabulary, [1 / (k + 1) for k in range(120)], k=rng.randint(1, 60)))) for i in range(700)]
    items = [(i, " ".join(rng.choices(vocabulary, k=12)) if i % 2 else rows[i][1]) for i in range(30)]
    assert search(spark, tmp_path, docs_of(rows), items, places=7) == brute(rows, items, 7)


def test_empty_tables(spark, docs_of, tmp_path):
    assert search(spark, tmp_path, docs_of([]), [(1, "a")]) == []
    assert search(spark, tmp_path, docs_of([(1, None), (2, " ")]), [(1, "a")]) == []
    assert search(spark, tmp_path, docs_of([(1, "a")]), []) == []
    assert search(spark, tmp_path, docs_of([(1, "a")]).withColumns({"rank": F.lit(1), "block": F.lit(2)}), [(1, "a")]) == brute([(1, "a")], [(1, "a")])
