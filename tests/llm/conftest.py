import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
#: Columns whose names clash with ones the operators use or add.
CLASHING = (
    *("id", "key", "block", "ids", "part", "mark", "spans", "copy", "n_words", "stats", "score", "group"),
    *("__source", "__steps", "__at", "__place", "__id", "__mark", "__spans", "__cut", "__first", "label"),
    *("_source", "_steps", "_at", "_place", "_ID", "_mark", "_spans", "_cut", "_First", "turn", "at"),
)


def words(seed, n, letters="abcdefgh"):
    rng = random.Random(seed)
    return ["".join(rng.choices(letters, k=rng.randint(1, 7))) for _ in range(n)]


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (id, text) pairs, with a third of them in one source."""

    def build(rows, clashing=False):
        full = [
            (i, t, "en", "hot" if k % 3 == 0 else f"s{k % 4}", None if t is None else len(t))
            for k, (i, t) in enumerate(rows)
        ]
        df = spark.createDataFrame(full, DOCS)
        if clashing:
            from pyspark.sql import functions as F

            df = df.withColumns({c: F.lit("x") for c in CLASHING})
        return df

    return build


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty, blank and very long texts, repeated rows, repeated ids, near copies."""
    base = words(1, 300)
    near = base.copy()
    near[150] = "changed"
    long = " ".join(words(2, 40_000))
    return [
        (1, " ".join(base)),
        (2, " ".join(base)),
        (3, " ".join(near)),
        (3, " ".join(near)),
        (4, None),
        (5, ""),
        (6, " \n\t "),
        (7, "one two"),
        (8, "ONE two"),
        (9, long),
        (None, " ".join(base)),
        (None, None),
        (10, "Größe ñandú 数字 😀 it's  we'll\r\n\n tab\tend\x00\x1c "),
        (11, "<|endoftext|> a<|startoftext|>b </s>[INST]"),
        (12, " ".join(words(3, 60) + base[100:180] + words(4, 60))),
        (13, "x" * 5000),
        (14, " ".join(["same"] * 500)),
    ]
