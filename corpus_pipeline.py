"""A training corpus from raw documents, stage by stage.

Each stage takes (spark, docs, sf_dir), works on all that the one before it kept
and returns the columns of documents, the last one its report. `run` writes every
stage's result as Parquet to the cluster's shared folder and reads it again, so a
lost executor costs no more than a part of one stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendcloud.llm.bpe import bpe_report, read_ranks
from trendcloud.llm.common import stored, table
from trendcloud.llm.mixing import mix_sources
from trendcloud.llm.ngram_join import one_of_each
from trendcloud.llm.quality import keep_quality
from trendcloud.llm.substring_dedup import cut_repeats


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on labels that are not held out, does not reject."""
    return keep_quality(docs, table(spark, sf_dir, "labels"))


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near copies."""
    return one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages an earlier document has; a text that loses every word goes.

    Texts that lose nothing stay as they are; the others are their words joined by a space.
    """
    cut = cut_repeats(docs).filter("n_removed = 0 or n_removed < n_words")
    changed = F.col("n_removed") > 0
    text = F.when(changed, F.col("kept_text")).otherwise(F.col("text"))
    n_chars = F.when(changed, F.char_length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return cut.withColumns({"text": text, "n_chars": n_chars}).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that sources meet their tempered weights, in a shuffled order."""
    return mix_sources(docs).select(*docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The number of tokens of every text, with digests of its ids and of what they decode to."""
    ranks = read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe_report(docs, ranks, public_tokenizers.PATTERN)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_join", ngram_join),
    ("substring_dedup", substring_dedup),
    ("mixing", mixing),
    ("byte_bpe", byte_bpe),
]

#: The classifier is learned, so no SQL gives the rows; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
