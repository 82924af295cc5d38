"""Language of every word by a linear-chain conditional random field, and of every text from its words.

A word is a run of ASCII letters and of bytes beyond ASCII, in lower case. Its
features are the n-grams of 2 to 4 bytes of the word between two border marks, those
at a border being its affixes, hashed into a fixed number of weights, and the word
itself if the lexicon has it. A language's weights of a word's features are summed
up to that word's score; learned transitions between the languages of neighbouring
words tie the scores together, and forward-backward gives every word's probabilities
given the whole text. A text's language is the one with the largest expected share
of its words, and its score is that share.

Texts in training have one language each, so spans of many texts are drawn and put
in an order by hash: long sequences that switch language every few words, from which
the transitions are learned together with the weights. Gradients are summed per task
of the stored spans; the driver takes the steps.

Forward and backward passes cut a text into chunks of words. A chunk is first one
matrix of languages x languages; only these are walked in order, and then all chunks
of a batch at once from the right state, so a very long text takes array operations
like many short ones.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendcloud.llm.common import bounded_batches, mix, offsets, pieces, ranges, stored
from trendcloud.llm.quality import held_out

cloudpickle.register_pickle_by_value(sys.modules[__name__])

UNKNOWN = "und"
#: Weights that n-grams share per language.
BUCKETS = 1 << 15
#: Labelled texts of a language that are learned from, about; spans of each, and words of a span.
TEXTS, SPANS, SPAN_WORDS = 1500, 6, 16
#: Spans that follow each other in a sequence.
CHAIN = 32
#: Words of the lexicon, the most frequent of those the spans have at least `SEEN` times.
LEXICON, SEEN = 20_000, 3
ROUNDS, RATE, DECAY = 14, 1.0, 1e-3
#: Words of a chunk in forward-backward.
CHUNK = 32

_LETTER = np.array([b >= 128 or chr(b).isalpha() for b in range(256)])
_BORDER = 0x1F


@dataclass(frozen=True)
class Words:
    """The words of some texts: which text each is of, and their bytes between border marks."""

    text: np.ndarray
    marked: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray


def words_of(texts: pa.Array) -> Words:
    """The words of a column of texts; null has none."""
    lower = pc.utf8_lower(pc.fill_null(texts, "").cast(pa.large_string()))
    at = np.frombuffer(lower.buffers()[1], np.int64)[lower.offset : lower.offset + len(lower) + 1]
    buffer = lower.buffers()[2]
    data = np.frombuffer(buffer, np.uint8)[: at[-1]] if buffer is not None and len(lower) else np.zeros(0, np.uint8)
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _LETTER[data]
    inside[1 : at[0] + 1] = False
    first = np.zeros(len(data) + 1, bool)
    first[at] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | first[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | first[1:])) + 1
    sizes = ends - starts
    place = offsets(sizes + 2)
    marked = np.full(int(place[-1]), _BORDER, np.uint8)
    marked[ranges(place[:-1] + 1, sizes)] = data[ranges(starts, sizes)]
    return Words(np.searchsorted(at, starts, "right") - 1, marked, place[:-1], sizes + 2)


def word_hashes(words: Words) -> np.ndarray:
    """A 64-bit hash of every word."""
    if not len(words.starts):
        return np.zeros(0, np.uint64)
    powers = np.cumprod(np.full(int(words.sizes.max()), 0x9E3779B97F4A7C15, np.uint64))
    inside = ranges(np.zeros(len(words.sizes), np.int64), words.sizes)
    return mix(np.add.reduceat((words.marked.astype(np.uint64) + np.uint64(1)) * powers[inside], words.starts))


def ngrams(words: Words) -> list[np.ndarray]:
    """For n = 2, 3, 4 the weight of the n-gram at every byte; `BUCKETS` where none fits in the word."""
    left = np.repeat(words.sizes, words.sizes) - ranges(np.zeros(len(words.sizes), np.int64), words.sizes)
    total = len(words.marked)
    value = words.marked.astype(np.uint64)
    out, code = [], value
    for n in (2, 3, 4):
        following = np.zeros(total, np.uint64)
        following[: total - n + 1] = value[n - 1 :]
        code = code | (following << np.uint64(8 * (n - 1)))
        bucket = ((code + np.uint64(n)) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - 15)
        out.append(np.where(left >= n, bucket.astype(np.int64), BUCKETS))
    return out


def forward_backward(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of every word's languages given its sequence, and the expected number of each transition.

    `scores` has the words of all sequences one after the other, `lengths` the
    words of each. The words before the first are taken to be of any language.
    """
    n, k = scores.shape
    step = np.exp(transitions - transitions.max())
    chance = np.exp(scores - scores.max(axis=1, keepdims=True))
    parts = -(-lengths // CHUNK)
    first_part = offsets(parts)[:-1]
    inside = ranges(np.zeros(len(parts), np.int64), parts)
    begin = np.repeat(offsets(lengths)[:-1], parts) + inside * CHUNK
    size = np.minimum(CHUNK, np.repeat(lengths, parts) - inside * CHUNK)
    order = np.argsort(-size, kind="stable")
    begin, active = begin[order], np.searchsorted(-size[order], -np.arange(CHUNK), "left")

    def unit(x: np.ndarray, axis) -> np.ndarray:
        return x / x.sum(axis=axis, keepdims=True)

    # Every chunk as one matrix.
    whole = np.broadcast_to(np.eye(k), (len(order), k, k)).copy()
    for t in range(CHUNK):
        a = active[t]
        if a:
            whole[:a] = unit((whole[:a] @ step) * chance[begin[:a] + t][:, None, :], (1, 2))
    # The states between chunks, in order.
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    long = np.argsort(-parts, kind="stable")
    most = int(parts.max(initial=0))
    running = np.searchsorted(-parts[long], -np.arange(most), "left")
    before, after = np.ones((len(order), k)), np.ones((len(order), k))
    state = np.ones((len(long), k))
    for j in range(most):
        r = running[j]
        at = place[first_part[long[:r]] + j]
        before[at] = state[:r]
        state[:r] = unit((state[:r, None, :] @ whole[at])[:, 0], 1)
    state = np.ones((len(long), k))
    for j in range(most - 1, -1, -1):
        r = running[j]
        at = place[first_part[long[:r]] + j]
        after[at] = state[:r]
        state[:r] = unit((whole[at] @ state[:r, :, None])[:, :, 0], 1)
    # Inside all chunks at once.
    alpha, beta = np.empty((n, k)), np.empty((n, k))
    for t in range(CHUNK):
        a, at = active[t], begin[: active[t]] + t
        before[:a] = unit((before[:a] @ step) * chance[at], 1)
        alpha[at] = before[:a]
    for t in range(CHUNK - 1, -1, -1):
        a, at = active[t], begin[: active[t]] + t
        beta[at] = after[:a]
        after[:a] = unit((chance[at] * after[:a]) @ step.T, 1)
    found = unit(alpha * beta, 1) if n else alpha
    follows = np.ones(n, bool)
    follows[offsets(lengths)[:-1][lengths > 0]] = False
    here = np.flatnonzero(follows)
    behind, ahead = alpha[here - 1], chance[here] * beta[here]
    z = ((behind @ step) * ahead).sum(axis=1, keepdims=True)
    return found, step * ((behind / z).T @ ahead)


@dataclass(frozen=True)
class LanguageModel:
    """Languages in order; weights of n-grams, then of the lexicon's words (ascending hashes); transitions."""

    langs: list[str] = field(default_factory=list)
    lexicon: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS + 1, 0)))
    transitions: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    def entries(self, words: Words) -> np.ndarray:
        """The lexicon's weight of every word; that of no n-gram if it is not there."""
        if not len(self.lexicon):
            return np.full(len(words.starts), BUCKETS)
        hashes = word_hashes(words)
        at = np.minimum(np.searchsorted(self.lexicon, hashes), len(self.lexicon) - 1)
        return np.where(self.lexicon[at] == hashes, BUCKETS + 1 + at, BUCKETS)

    def scores(self, words: Words, grams: list[np.ndarray], entries: np.ndarray) -> np.ndarray:
        """Every word's score for every language."""
        if not len(words.starts):
            return np.zeros((0, len(self.langs)))
        total = sum(np.take(self.weights, g, axis=0) for g in grams)
        summed = np.add.reduceat(total, words.starts, axis=0)
        return summed / np.sqrt(words.sizes)[:, None] + np.take(self.weights, entries, axis=0)

    def probabilities(self, texts: pa.Array) -> tuple[Words, np.ndarray]:
        words = words_of(texts)
        if not self.langs:
            return words, np.zeros((len(words.starts), 0))
        scores = self.scores(words, ngrams(words), self.entries(words)).astype(float)
        lengths = np.bincount(words.text, minlength=len(texts))
        return words, forward_backward(scores, lengths, self.transitions)[0]


def _spans(langs: list[str]):
    """Spans of labelled texts, evenly spread over each: (lang number, span, turn)."""
    number = {lang: i for i, lang in enumerate(langs)}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 64):
            words = words_of(batch.column(1))
            counts = np.bincount(words.text, minlength=batch.num_rows)
            at = offsets(counts)
            rows = []
            for i, lang in enumerate(batch.column(0).to_pylist()):
                n = counts[i]
                for j in range(min(SPANS, -(-n // SPAN_WORDS))):
                    start = at[i] + (n - min(n, SPAN_WORDS)) * j // max(1, min(SPANS, -(-n // SPAN_WORDS)) - 1)
                    first, last = int(start), int(min(start + SPAN_WORDS, at[i + 1])) - 1
                    low, high = words.starts[first], words.starts[last] + words.sizes[last]
                    text = words.marked[low:high].tobytes().replace(b"\x1f\x1f", b" ").strip(b"\x1f").decode()
                    rows.append({"lang": number[lang], "span": text})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("lang", pa.int32()), ("span", pa.string())]))

    return cut


def _gradient(model: LanguageModel):
    """Per task: the gradient of the log-likelihood, of weights and transitions together, and its words."""

    def gradient(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.langs)
        weights, moves, total = np.zeros(model.weights.shape), np.zeros((k, k)), 0
        for batch in pieces(batches, 1024):
            words = words_of(batch.column(1))
            if not len(words.starts):
                continue
            truth = batch.column(0).to_numpy()[words.text]
            grams, entries = ngrams(words), model.entries(words)
            scores = model.scores(words, grams, entries)
            lengths = np.bincount(words.text // CHAIN)
            lengths = lengths[lengths > 0]
            found, expected = forward_backward(scores, lengths, model.transitions)
            wrong = np.eye(k)[truth] - found
            follows = np.ones(len(truth), bool)
            follows[offsets(lengths)[:-1]] = False
            here = np.flatnonzero(follows)
            seen = np.zeros((k, k))
            np.add.at(seen, (truth[here - 1], truth[here]), 1)
            moves += seen - expected
            scaled = np.repeat(wrong / np.sqrt(words.sizes)[:, None], words.sizes, axis=0)
            for lang in range(k):
                for g in grams:
                    weights[:, lang] += np.bincount(g, scaled[:, lang], len(weights))
                weights[:, lang] += np.bincount(entries, wrong[:, lang], len(weights))
            total += len(truth)
        if total:
            packed = [weights.astype(np.float32).tobytes()], [moves.tobytes()], [total]
            yield pa.RecordBatch.from_arrays([pa.array(p) for p in packed], names=["weights", "moves", "words"])

    return gradient


def learn_languages(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> LanguageModel:
    """A model from the texts of `docs` and their languages; rows without either are left out.

    About `TEXTS` texts of each language are learned from, an even share of them by
    a hash of the id, with `SPANS` spans of `SPAN_WORDS` words of each.
    """
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    known = known.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.xxhash64(id_col).alias("turn"))
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    k = len(langs)
    if k < 2:
        return LanguageModel(langs, transitions=np.zeros((k, k)), weights=np.zeros((BUCKETS + 1, k)))
    share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, int(1e6 * min(1.0, TEXTS / sizes[lang])) or 1)])
    drawn = known.filter(F.pmod("turn", F.lit(1_000_000)) < share[F.col("lang")]).select("lang", "text")
    spans = drawn.mapInArrow(_spans(langs), "lang int, span string")
    mixed = spans.repartition(8, F.xxhash64("span")).sortWithinPartitions(F.xxhash64("span", "lang"))
    spans = stored(mixed, "spans")
    lexicon = _lexicon(spans)
    model = LanguageModel(langs, lexicon, np.zeros((BUCKETS + 1 + len(lexicon), k), np.float32), np.zeros((k, k)))
    squares, steep = np.zeros(model.weights.shape), np.zeros((k, k))
    weights, moves = np.zeros(model.weights.shape), np.zeros((k, k))
    for _ in range(ROUNDS):
        model = LanguageModel(langs, lexicon, weights.astype(np.float32), moves.copy())
        parts = spans.mapInArrow(_gradient(model), "weights binary, moves binary, words long").collect()
        total = sum(p["words"] for p in parts)
        if not total:
            break
        slope = sum(np.frombuffer(p["weights"], np.float32).astype(float) for p in parts).reshape(weights.shape) / total
        slope -= DECAY * weights / len(weights)
        turn = sum(np.frombuffer(p["moves"]) for p in parts).reshape(k, k) / total
        squares += slope * slope
        steep += turn * turn
        weights += RATE * slope / np.sqrt(squares + 1e-12)
        moves += RATE * turn / np.sqrt(steep + 1e-12)
        weights[BUCKETS] = 0.0  # that of no n-gram
    return LanguageModel(langs, lexicon, weights.astype(np.float32), moves)


def _lexicon(spans: DataFrame) -> np.ndarray:
    """Hashes of the most frequent words of the spans, ascending."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 4096):
            hashes, times = np.unique(word_hashes(words_of(batch.column(0))), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(times)], names=["word", "times"])

    counted = spans.select("span").mapInArrow(count, "word long, times long").groupBy("word").agg(F.sum("times").alias("times"))
    top = counted.filter(F.col("times") >= SEEN).orderBy(F.desc("times"), "word").limit(LEXICON).collect()
    return np.sort(np.array([r["word"] for r in top], np.int64).view(np.uint64))


def _labelled(docs: DataFrame, model: LanguageModel, id_col: str, text_col: str, out: T.StructType, rows):
    """Per text what `rows(words, probabilities, has a letter)` makes of a batch, behind its id."""

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 128):
            texts = batch.column(1)
            words, found = model.probabilities(texts)
            letters = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column(0), *rows(words, found, letters)], names=["id", *out.names])

    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = T.StructType([given.schema["id"], *out.fields])
    return given.mapInArrow(label, kind)


def text_languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score) of every row: the language of the largest share of words, and that share.

    `und` with score 0 for a text that is null, empty or without letters, and for all
    if nothing was learned. Ties go to the first language in order. Null ids and
    repeated rows are kept, texts of any length read whole; other columns are left out.
    """
    out = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    langs = model.langs

    def rows(words: Words, found: np.ndarray, letters: np.ndarray):
        n, k = len(letters), len(langs)
        counts = np.bincount(words.text, minlength=n)
        share = np.stack([np.bincount(words.text, found[:, i], n) for i in range(k)], axis=1) if k else np.zeros((n, 0))
        judged = letters & (counts > 0) & (k > 0)
        best = share.argmax(axis=1) if k else np.zeros(n, np.int64)
        score = share[np.arange(n), best] / np.maximum(counts, 1) if k else np.zeros(n)
        names = [langs[b] if j else UNKNOWN for b, j in zip(best.tolist(), judged.tolist(), strict=True)]
        return pa.array(names, pa.string()), pa.array(np.clip(np.where(judged, score, 0.0), 0.0, 1.0))

    return _labelled(docs, model, id_col, text_col, out, rows).withColumnRenamed("id", id_col)


def word_languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, runs) of every row: `runs` has (start, length, lang, score) of words with the same likeliest language.

    Words are counted from 0; `score` is the mean probability. Texts without words,
    null ones too, have no runs; nor has any if nothing was learned.
    """
    run = T.StructType(
        [
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("lang", T.StringType()),
            T.StructField("score", T.DoubleType()),
        ]
    )
    out = T.StructType([T.StructField("runs", T.ArrayType(run))])
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("lang", pa.string()), ("score", pa.float64())])
    langs = model.langs

    def rows(words: Words, found: np.ndarray, letters: np.ndarray):
        best = found.argmax(axis=1) if found.size else np.zeros(0, np.int64)
        text = words.text[: len(best)]
        change = np.flatnonzero(np.concatenate([[True], (best[1:] != best[:-1]) | (text[1:] != text[:-1])])[: len(best)])
        sizes = np.diff(np.append(change, len(best)))
        first = offsets(np.bincount(words.text, minlength=len(letters)))
        runs = [[] for _ in letters]
        for at, size in zip(change.tolist(), sizes.tolist(), strict=True):
            of, lang = int(text[at]), int(best[at])
            score = float(found[at : at + size, lang].mean())
            runs[of].append({"start": at - int(first[of]), "length": size, "lang": langs[lang], "score": score})
        return (pa.array(runs, pa.list_(kind)),)

    return _labelled(docs, model, id_col, text_col, out, rows).withColumnRenamed("id", id_col)


def languages(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, held_out, lang_pred, score) of every row, learned from rows that are not held out.

    See `learn_languages` and `text_languages`; runs jobs when called.
    """
    bounded_batches(docs.sparkSession)
    model = learn_languages(docs.filter(~held_out(id_col)), lang_col, id_col, text_col)
    found = text_languages(docs, model, id_col, text_col)
    return found.select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score")
