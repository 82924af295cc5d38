"""N-gram groups and window dedup against brute force on small documents."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import words
from trendcloud.llm import ngram_join, substring_dedup
from trendcloud.llm.components import components
from trendcloud.llm.ngram_join import ngram_groups, one_of_each, shingle_sets
from trendcloud.llm.substring_dedup import CHUNK, Rolling, cut_repeats


def shingles(text, n=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute_groups(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [
        (i, len(s), i if not s and i is not None else least.get(find(k))) for k, (i, s) in enumerate(sets)
    ]


def as_rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def near_copies(seed, base, copies, share):
    """Copies of a text with some words replaced, at many distances from each other."""
    rng = random.Random(seed)
    out = []
    for _ in range(copies):
        new = base.copy()
        for i in rng.sample(range(len(new)), int(len(new) * rng.random() * share)):
            new[i] = f"w{rng.random()}"
        out.append(" ".join(new))
    return out


def test_groups_of_odd_rows(docs_of, odd_rows):
    got = ngram_groups(docs_of(odd_rows, clashing=True))
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert as_rows(got) == sorted(brute_groups(odd_rows), key=str)


def test_groups_of_no_documents_and_of_unlike_ones(docs_of):
    assert ngram_groups(docs_of([])).collect() == []
    rows = [(i, " ".join(words(i, 40))) for i in range(5)]
    assert [r["component_id"] for r in sorted(ngram_groups(docs_of(rows)).collect())] == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("tile", [4096, 7])
def test_near_copies_at_all_distances(docs_of, monkeypatch, tile):
    """Groups that hang together by chains, with shared passages, also in many tiles."""
    monkeypatch.setattr(ngram_join, "TILE_SETS", tile)
    passage = words(99, 120)
    texts = near_copies(5, words(7, 200), 40, 0.06) + near_copies(6, words(8, 60), 25, 0.1)
    texts += [" ".join(words(50 + k, 80) + passage) for k in range(20)] + ["the same short one"] * 30
    random.Random(1).shuffle(texts)
    rows = list(enumerate(texts))
    want = brute_groups(rows)
    assert 2 < len({c for _, _, c in want}) < len(rows)
    assert as_rows(ngram_groups(docs_of(rows))) == sorted(want, key=str)


@pytest.mark.parametrize("tile", [4096, 3])
def test_sets_of_all_sizes_that_hold_one_another(docs_of, monkeypatch, tile):
    """Every text begins like the next longer one; only those of near sizes can be linked."""
    monkeypatch.setattr(ngram_join, "TILE_SETS", tile)
    text = words(21, 900)
    lengths = [5, 9, 10, 14, 24, 29, 30, 44, 64, 84, 104, 129, 160, 210, 260, 330, 500, 624, 700, 899]
    rows = [(i, " ".join(text[:n])) for i, n in enumerate(lengths)] + [(90, " ".join(text[5:705]))]
    got = ngram_groups(docs_of(rows))
    assert as_rows(got) == sorted(brute_groups(rows), key=str)


@pytest.mark.parametrize("percent", [51, 80, 99, 100])
def test_no_pair_that_can_be_linked_is_further_apart_than_one_band(spark, percent):
    sizes = spark.range(1, 40_000).select(F.col("id").alias("size"))
    band = dict(sizes.select("size", ngram_join._band(percent)).collect())
    assert all(band[100 * s // percent] - band[s] in (0, 1) for s in band if 100 * s // percent in band)


def test_blocks_of_bands_apart_share_no_tile(spark):
    rows = [(7, i, 3 * i, 10, b"", i // 20, 4, 4 * (i >= 20), 4 * (i < 80)) for i in range(100)]
    placed = spark.createDataFrame(
        rows, "cluster long, n long, key long, size long, cols binary, band int, blocks long, before long, after long"
    )
    tiles = ngram_join._tiles(placed).select("tile.*", "key").collect()
    assert {t["high"] - t["low"] for t in tiles} == {0, 1}
    met = {}
    for t in tiles:
        met.setdefault(t[:4], set()).add(t["key"] // 3)
    # Five bands of four blocks: ten tiles in each, sixteen between two that meet.
    assert len(met) == 5 * 10 + 4 * 16
    pairs = {(a, b) for keys in met.values() for a in keys for b in keys if a < b}
    assert pairs == {(a, b) for a in range(100) for b in range(a + 1, 100) if b // 20 - a // 20 <= 1}


def test_one_of_each_keeps_columns_and_rows_without_id(docs_of, odd_rows):
    docs = docs_of(odd_rows, clashing=True)
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=str)
    assert ids == sorted([1, 4, 5, 6, 7, 9, 10, 11, 12, 13, 14, None, None], key=str)


def test_shingle_sets_of_short_texts():
    hashes, sizes = shingle_sets(np.arange(1, 12, dtype=np.uint64), np.array([0, 3, 5, 3]), 5)
    assert sizes.tolist() == [0, 1, 1, 1] and len(set(hashes.tolist())) == 3


def test_percent_must_leave_shared_columns(docs_of):
    with pytest.raises(ValueError):
        ngram_groups(docs_of([]), percent=50)


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(7, k) for k in range(200, 260)] + [(5, 5)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    want = dict.fromkeys(range(100, 141), 100) | dict.fromkeys([7, *range(200, 260)], 7)
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def brute_cut(rows, length):
    first = {}
    texts = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in texts:
        if i is not None:
            for k in range(len(w) - length + 1):
                s = tuple(w[k : k + length])
                first[s] = min(i, first.get(s, i))
    out = []
    for i, w in texts:
        covered = set()
        if i is not None:
            for k in range(len(w) - length + 1):
                if first[tuple(w[k : k + length])] < i:
                    covered.update(range(k, k + length))
        kept = b" ".join(x for k, x in enumerate(w) if k not in covered).decode()
        out.append((i, len(w), len(covered), kept))
    return sorted(out, key=str)


@pytest.mark.parametrize("length", [50, 4, 1])
def test_windows_of_odd_rows(docs_of, odd_rows, length):
    docs = docs_of(odd_rows, clashing=True)
    got = cut_repeats(docs, length=length)
    assert got.columns == [c for c in docs.columns if c != "n_words"] + ["n_words", "n_removed", "kept_text"]
    assert as_rows(got.select("doc_id", "n_words", "n_removed", "kept_text")) == brute_cut(odd_rows, length)


def test_windows_of_overlapping_passages(docs_of, monkeypatch):
    """Passages that overlap, repeat inside a document, and run over its ends; a crowded sketch."""
    monkeypatch.setattr(substring_dedup, "CELLS", CHUNK)
    passage, rng = words(3, 90), random.Random(2)
    rows = []
    for i in range(60):
        a, b = sorted(rng.sample(range(91), 2))
        rows.append((rng.randrange(1000), " ".join(words(i, rng.randrange(40)) + passage[a:b] * rng.randint(1, 2))))
    got = cut_repeats(docs_of(rows), length=10)
    assert as_rows(got.select("doc_id", "n_words", "n_removed", "kept_text")) == brute_cut(rows, 10)


def test_the_sketch_follows_the_texts_not_the_partitions(spark, docs_of, monkeypatch):
    """Every worker holds the sketch: a small table dealt over many partitions has a small one."""
    widths, old = [], substring_dedup.repeated_cells
    monkeypatch.setattr(substring_dedup, "repeated_cells", lambda t, length, cells: (widths.append(cells), old(t, length, cells))[1])
    shared = " ".join(words(5, 60))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        got = {r["doc_id"]: r["n_removed"] for r in cut_repeats(docs_of([(1, shared), (2, "x " + shared), (3, None)])).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert widths == [CHUNK] and got == {1: 0, 2: 60, 3: 0}
    assert substring_dedup.sketch_cells(864_000_000) == 1 << 26
    assert substring_dedup.sketch_cells(1 << 40) == substring_dedup.MOST_CELLS


def test_no_window_is_lost_when_every_cell_is_shared(docs_of, odd_rows, monkeypatch):
    """With a sketch of one bit in all, everything is estimated as repeated; the result is the same."""
    monkeypatch.setattr(substring_dedup, "_cells", lambda a, cells: (a * np.uint64(0), a * np.uint64(0)))
    got = cut_repeats(docs_of(odd_rows))
    assert as_rows(got.select("doc_id", "n_words", "n_removed", "kept_text")) == brute_cut(odd_rows, 50)


def test_cut_of_no_documents(docs_of):
    assert cut_repeats(docs_of([])).collect() == []


def test_rolling_hashes_tell_runs_apart():
    values = np.random.default_rng(1).integers(0, 2**63, (30, 2)).astype(np.uint64)
    twice = np.concatenate([values, values])
    rolled = Rolling(twice).of(10, 0)
    assert (rolled[:21] == rolled[30:51]).all() and len(set(rolled.tolist())) == 30


def test_a_passage_in_very_many_documents_is_dealt_out_once_a_batch(spark, docs_of):
    """What a task knows to be in a smaller document goes by document, not by window."""
    from trendcloud.llm import substring_dedup as sub

    passage = " ".join(words(77, 60))
    rows = [(i, f"a{i} b{i} c{i} {passage}") for i in range(600)]
    batch = [pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([t for _, t in rows]), pa.array(range(600))], names=["id", "text", "mark"])]

    class Sketch:
        value = b"\xff" * (2 * (1 << 20) // 8)

    dealt = list(sub._deal(50, 1 << 20, 8, Sketch)(iter(batch)))
    asked = [b.filter(b.column("high").is_valid()) for b in dealt]
    positions = sum(len(x) // 4 for b in asked for x in b.column("position").to_pylist())
    every = sum(len(x) // 4 for b in dealt for x in b.column("position").to_pylist())
    assert every == 600 * 14 and positions <= 600 * 3 + 14 * 2, "only the first document's shared windows are dealt out"
    got = {r["doc_id"]: r["n_removed"] for r in sub.cut_repeats(docs_of(rows).repartition(7)).collect()}
    assert got == {i: 60 if i else 0 for i in range(600)}


def test_an_exact_copy_in_very_many_documents_sends_its_set_once_a_task(spark, docs_of):
    from trendcloud.llm import ngram_join as join

    text = " ".join(words(5, 40))
    batch = pa.RecordBatch.from_arrays([pa.array(range(500)), pa.array([text] * 500)], names=["id", "text"])
    sent = list(join._incidences(5, 16)(iter([batch])))
    kinds = [(k, p, len(x) // 8) for b in sent for k, p, x in zip(b.column("kind").to_pylist(), b.column("part").to_pylist(), b.column("keys").to_pylist())]
    documents = [n for k, _, n in kinds if k == 1]
    assert sum(documents) == 500 and {p for k, p, _ in kinds if k == 1} == set(range(16)) and max(documents) < 50
    assert [n for k, _, n in kinds if k == 2] == [1]
    got = ngram_groups(docs_of([(i, text) for i in range(500)]).repartition(6)).collect()
    assert {(r["n_shingles"], r["component_id"]) for r in got} == {(36, 0)} and len(got) == 500
