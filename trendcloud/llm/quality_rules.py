"""Quality rules learned as a decision list.

Sequential covering grows one rule at a time, a conjunction of thresholds on
document statistics, on part of the labelled rows; cuts it back on the rest; and
goes on with the rows the rule does not cover. The list that results is a plain
conditional expression over statistics columns: it can be read, stored and run
by Spark alone.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendcloud.llm.common import WordCodes, bounded_batches, offsets, ranges, stored, utf8
from trendcloud.llm.quality import held_out

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Labelled rows that rules are learned from at most: an even sample by a hash of their ids.
MOST_LEARNED = 20_000
MOST_RULES, MOST_CONDITIONS = 12, 4
#: Thresholds tried per statistic and step; share of right rows that a rule must have.
CANDIDATES, PRECISION = 64, 0.8
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, REPEAT_PERCENT = 50, 50

COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters",
    "n_capitals", "n_shouts", "n_bars", "n_digits", "n_ends", "n_distinct",
)
_BLANK = b" \t\n\x0b\x0c\r"
_CONTINUED = bytes(range(0x80, 0xC0))


def _repeated_words(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per text: words inside 3-word windows that the text has twice or more."""
    begins, per = offsets(counts)[:-1], np.maximum(counts - 2, 0)
    where, owner = ranges(begins, per), np.repeat(np.arange(len(counts)), per)
    factor = np.uint64(0x9E3779B97F4A7C15)
    windows = (words[where] * factor + words[where + 1]) * factor + words[where + 2]
    order = np.lexsort((windows, owner))
    same = np.zeros(len(order) + 1, bool)
    same[1:-1] = (windows[order][1:] == windows[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    covered = np.zeros(len(words), bool)
    found = where[order][same[1:] | same[:-1]]
    covered[found] = covered[found + 1] = covered[found + 2] = True
    return np.diff(offsets(covered)[offsets(counts)])


@F.arrow_udf(T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]))
def text_counts(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Exact counts of each text; a null text has none."""
    codes = WordCodes()
    for column in texts:
        rows = []
        for a in range(0, len(column), 512):
            part = utf8(column.slice(a, 512))
            hashes, counts = codes.hashes(part)
            repeated = _repeated_words(hashes[:, 0], counts)
            at = offsets(counts)
            for i, text in enumerate(part):
                size = len(text)
                lines = [x for x in text.split(b"\n") if x.strip()]

                def of(group: bytes, text: bytes = text, size: int = size) -> int:
                    return size - len(text.translate(None, group))

                capitals = of(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")
                rows.append(
                    (
                        counts[i],
                        len(text.translate(None, _CONTINUED + _BLANK)),
                        of(SYMBOLS),
                        len(lines) - len(set(lines)),
                        repeated[i],
                        len(lines),
                        capitals + of(b"abcdefghijklmnopqrstuvwxyz"),
                        capitals,
                        of(b"!"),
                        of(b"|"),
                        of(b"0123456789"),
                        of(b".?"),
                        len(np.unique(hashes[at[i] : at[i + 1], 0])),
                    )
                )
        table = np.array(rows, np.int64).reshape(-1, len(COUNTS))
        yield pa.StructArray.from_arrays([pa.array(c) for c in table.T], list(COUNTS))


#: Statistics that rules speak of: counts that do not depend on a text's length.
STATISTICS = {
    "word_length": ("word_chars", "n_words"),
    "symbol_share": ("n_symbols", "word_chars"),
    "bar_share": ("n_bars", "n_words"),
    "shout_share": ("n_shouts", "n_words"),
    "capital_share": ("n_capitals", "n_letters"),
    "digit_share": ("n_digits", "word_chars"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "words_a_line": ("n_words", "n_lines"),
    "ends_a_word": ("n_ends", "n_words"),
    "distinct_share": ("n_distinct", "n_words"),
}


def statistic(name: str) -> Column:
    above, below = STATISTICS[name]
    return F.coalesce(F.try_divide(F.col(above).cast("double"), F.col(below)), F.lit(0.0))


@dataclass(frozen=True)
class Rule:
    """All (statistic, is it at least, threshold) must hold for a row to be rejected."""

    conditions: tuple[tuple[str, bool, float], ...]

    def covers(self, table: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(table.values()))), bool)
        for name, least, threshold in self.conditions:
            out &= table[name] >= threshold if least else table[name] < threshold
        return out

    def column(self) -> Column:
        out = F.lit(True)
        for name, least, threshold in self.conditions:
            value = statistic(name)
            out = out & (value >= threshold if least else value < threshold)
        return out

    def __str__(self) -> str:
        parts = (f"{n} {'>=' if least else '<'} {t:.6g}" for n, least, t in self.conditions)
        return "reject if " + " and ".join(parts)


def _taken(table: dict[str, np.ndarray], rows: np.ndarray) -> dict[str, np.ndarray]:
    return {c: v[rows] for c, v in table.items()}


def _grow(table: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Add the condition that gains most information until the rule covers no good row."""
    conditions: list[tuple[str, bool, float]] = []
    inside = np.ones(len(bad), bool)
    while len(conditions) < MOST_CONDITIONS and (inside & ~bad).any():
        p, n = (inside & bad).sum(), (inside & ~bad).sum()
        best = (1e-9, None)
        for name, values in table.items():
            levels = np.unique(values[inside])
            if len(levels) < 2:
                continue
            steps = (levels[1:] + levels[:-1]) / 2
            steps = steps[np.unique(np.linspace(0, len(steps) - 1, CANDIDATES).astype(int))]
            for threshold in steps:
                above = inside & (values >= threshold)
                for least, new in ((True, above), (False, inside & ~above)):
                    p1, n1 = (new & bad).sum(), (new & ~bad).sum()
                    if p1 and (gain := p1 * (np.log2(p1 / (p1 + n1)) - np.log2(p / (p + n)))) > best[0]:
                        best = (gain, (name, least, float(threshold)))
        if best[1] is None:
            break
        conditions.append(best[1])
        inside = Rule(tuple(conditions)).covers(table)
    return Rule(tuple(conditions))


def _worth(rule: Rule, table: dict[str, np.ndarray], bad: np.ndarray) -> float:
    covered = rule.covers(table)
    p, n = (covered & bad).sum(), (covered & ~bad).sum()
    return (p - n) / (p + n) if p + n else -1.0


def learn_rules(table: dict[str, np.ndarray], bad: np.ndarray, prune: np.ndarray) -> list[Rule]:
    """Rules in order; `prune` marks the rows that cut rules back and judge them."""
    rules: list[Rule] = []
    rest = np.ones(len(bad), bool)
    while len(rules) < MOST_RULES and (rest & bad & ~prune).any():
        grow, cut = np.flatnonzero(rest & ~prune), np.flatnonzero(rest & prune)
        rule = _grow(_taken(table, grow), bad[grow])
        if not rule.conditions:
            break
        held = cut if bad[cut].any() else np.flatnonzero(rest)
        shorter = [Rule(rule.conditions[:k]) for k in range(1, len(rule.conditions) + 1)]
        judged = _taken(table, held)
        rule = max(shorter, key=lambda r: (_worth(r, judged, bad[held]), -len(r.conditions)))
        covered = rest & rule.covers(table)
        if _worth(rule, judged, bad[held]) < 2 * PRECISION - 1 or bad[covered].mean() < PRECISION:
            break
        rules.append(rule)
        rest &= ~covered
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The decision list as one conditional expression: false for the first rule that holds, else true."""
    if not rules:
        return F.lit(True)
    out = F.when(rules[0].column(), False)
    for rule in rules[1:]:
        out = out.when(rule.column(), False)
    return out.otherwise(True)


def base_failed() -> Column:
    few = F.col("n_words") < MIN_WORDS
    return few | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def fit_rules(counts: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> list[Rule]:
    """Rules from rows with `COUNTS` that pass the base test and have one label of 0 or 1.

    Held-out rows are not learned from. At most `MOST_LEARNED` rows come to the
    driver, as statistics; beyond that an even share by a hash of the id.
    """
    given = (
        labels.filter(F.col(label_col).isin(0, 1) & ~held_out(id_col))
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.min(label_col).alias("least"), F.max(label_col).alias("label"))
        .filter("least = label")
        .select("id", "label")
    )
    turn = F.pmod(F.xxhash64("id"), F.lit(1_000_003))
    rows = (
        counts.filter(~base_failed())
        .select(F.col(id_col).alias("id"), *(statistic(s).alias(s) for s in STATISTICS))
        .join(given, "id")
        .withColumn("turn", turn)
    )
    rows = stored(rows, "labelled")
    known = rows.count()
    if known > MOST_LEARNED:
        rows = rows.filter(F.col("turn") < int(1_000_003 * MOST_LEARNED / known))
    got = rows.orderBy("turn", "id").collect()
    if not got:
        return []
    table = {s: np.array([r[s] for r in got]) for s in STATISTICS}
    bad = np.array([r["label"] == 0 for r in got])
    return learn_rules(table, bad, np.array([r["turn"] % 3 == 0 for r in got]))


def apply_rules(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id_col, COUNTS..., base_failed, kept) of every row.

    Words are runs of anything but ASCII white space. Null and empty texts have no
    words and fail the base test; null ids and repeated rows are kept; an empty
    table gives an empty one; without labels the base test alone decides. Other
    columns are left out. Texts of any length are read whole.
    """
    bounded_batches(docs.sparkSession)
    counts = docs.select(F.col(id_col), text_counts(F.col(text_col)).alias("counts"))
    counts = stored(counts.select(id_col, "counts.*"), "counts")
    rules = fit_rules(counts, labels, id_col)
    return counts.withColumn("base_failed", base_failed()).withColumn(
        "kept", ~F.col("base_failed") & verdict(rules)
    )
