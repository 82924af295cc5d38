"""The operators' queries over the given tables, and their SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendcloud.llm.bpe import bpe_report, read_ranks
from trendcloud.llm.chat import chat_report
from trendcloud.llm.common import table
from trendcloud.llm.language_crf import languages
from trendcloud.llm.lexical_search import search_index, write_index
from trendcloud.llm.mixing import mix_sources
from trendcloud.llm.neighbours import nearest
from trendcloud.llm.ngram_join import ngram_groups
from trendcloud.llm.quality import quality_scores
from trendcloud.llm.quality_rules import apply_rules
from trendcloud.llm.substring_dedup import cut_repeats
from trendcloud.llm.token_counts import token_counts
from trendcloud.llm.token_files import read_token_files, write_token_files
from trendcloud.llm.whitening import whitened
from trendcloud.sources.files import scratch_dir

#: Tokens above which op2 marks a document.
TOKEN_LIMIT = 512
#: The id that ends a document in op9's files.
END_ID = 1


def _vocabulary(name: str) -> str:
    with open(public_tokenizers.path(name), encoding="utf-8") as file:
        return file.read()


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every text, decode the ids, and give digests of both."""
    ranks = read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe_report(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every text, and whether it has more than the limit."""
    counts = token_counts(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format all conversations and one made of control strings, and read them back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    return chat_report(rows.unionByName(hard))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every text, learned from the labels that are not held out."""
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows found of every 20th, by inner product."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact counts of every text, the base test, and the learned decision list's verdict."""
    judged = apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select("doc_id", *counts, "base_failed", "kept")


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of every document's set of 5-word shingles, and its group at 80 % Jaccard."""
    return ngram_groups(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, repeated to bring sources to the square roots of their sizes, and shuffled."""
    return mix_sources(table(spark, sf_dir, "documents"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every text's ids to seekable files and read all documents back."""
    folder = scratch_dir(spark, "tokens")
    docs = table(spark, sf_dir, "documents")
    write_token_files(docs, folder, _vocabulary("word_bpe_49k.json"), END_ID)
    read = read_token_files(spark, folder)
    return read.select("doc_id", "start", "n_tokens", F.crc32("tokens").alias("ids_crc32"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every text that an earlier document's 50-word windows cover, and what is left."""
    cut = cut_repeats(table(spark, sf_dir, "documents"))
    digest = F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256")
    return cut.select("doc_id", "n_words", "n_removed", digest)


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text, learned from those that are not held out."""
    return languages(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors on the four leading components, each with unit variance."""
    return whitened(table(spark, sf_dir, "embeddings"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index all documents and find the 20 best of every benchmark item."""
    folder = scratch_dir(spark, "index")
    write_index(table(spark, sf_dir, "documents"), folder)
    return search_index(spark, folder, table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_token_counts": op2_token_counts,
    "op3_chat_format": op3_chat_format,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_nearest": op5_nearest,
    "op6_quality_rules": op6_quality_rules,
    "op7_ngram_join": op7_ngram_join,
    "op8_mixing": op8_mixing,
    "op9_token_files": op9_token_files,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_language": op11_language,
    "op12_whitening": op12_whitening,
    "op13_lexical_search": op13_lexical_search,
}

SQL: dict[str, str] = {
    "op3_chat_format": r"""
        WITH given AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
        ), escaped AS (
            SELECT *,
                length(regexp_replace(text, '([<\[])(\\*)(\||/?s>|/?INST\]|/?SYS>>)', '\1\\\2\3', 'g')) AS n_text,
                length(regexp_replace(role, '([<\[])(\\*)(\||/?s>|/?INST\]|/?SYS>>)', '\1\\\2\3', 'g')) AS n_role,
                lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) IS DISTINCT FROM role AS opens
            FROM given
        )
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
            sum(n_text + CASE WHEN opens THEN n_role + 8 + 8 + 7 ELSE 8 END)::BIGINT AS formatted_chars
        FROM escaped GROUP BY conv_id
    """,
    "op7_ngram_join": """
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x20\x09-\x0D]+') AS w
            FROM documents
        ), shingles AS (
            SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
            FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS i FROM words)
        ), sizes AS (
            SELECT doc_id, count(s) AS n FROM documents LEFT JOIN shingles USING (doc_id) GROUP BY doc_id
        ), met AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared
            FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
        ), links AS (
            SELECT a, b FROM met JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
            WHERE 100 * shared >= 80 * (x.n + y.n - shared)
        ), reach(doc_id, other) AS (
            SELECT doc_id, doc_id FROM sizes
            UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other
        )
        SELECT doc_id, n AS n_shingles, min(other) AS component_id
        FROM sizes JOIN reach USING (doc_id) GROUP BY doc_id, n
    """,
    "op8_mixing": """
        WITH sizes AS (
            SELECT coalesce('=' || source, 'null') AS s, sum(coalesce(length(text), 0)) AS size
            FROM documents GROUP BY 1
        ), total AS (
            SELECT sum(size) AS size, sum(pow(size, 0.5)) AS weight FROM sizes
        ), rates AS (
            SELECT s, pow(sizes.size, 0.5) / weight * total.size / sizes.size AS rate
            FROM sizes, total WHERE sizes.size > 0
        ), terms AS (
            SELECT s, k, CASE WHEN k = 0 THEN -rate ELSE ln(rate) - ln(greatest(k, 1)) END AS term
            FROM (SELECT *, unnest(range(0, ceil(rate + 40 * sqrt(rate) + 40)::BIGINT + 1)) AS k FROM rates)
        ), logs AS (
            SELECT s, k, sum(term) OVER (PARTITION BY s ORDER BY k) AS lg FROM terms
        ), sums AS (
            SELECT s, k, sum(exp(lg)) OVER (PARTITION BY s ORDER BY k) AS below FROM logs
        ), steps AS (
            SELECT s, list(below ORDER BY k) AS steps FROM sums GROUP BY s
        ), drawn AS (
            SELECT documents.*, ('0x' || substr(md5('17/' || coalesce(doc_id::VARCHAR, 'text ' || md5(coalesce(text, '')))), 1, 13))::BIGINT
                / 4503599627370496.0 AS place, steps
            FROM documents JOIN steps ON steps.s = coalesce('=' || source, 'null')
        ), counted AS (
            SELECT * EXCLUDE (steps), len(list_filter(steps, lambda x: x <= place))::INT AS n_copies FROM drawn
        )
        SELECT doc_id, text, lang, source, n_chars, unnest(range(1, n_copies + 1))::INT AS copy, n_copies
        FROM counted
    """,
    "op10_substring_dedup": """
        WITH words AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), windows AS (
            SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS s
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM words WHERE len(w) >= 50)
        ), late AS (
            SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY s) AS least FROM windows) WHERE least < doc_id
        ), covered AS (
            SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM late
        ), placed AS (
            SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM words
        ), kept AS (
            SELECT doc_id, count(*) AS n, string_agg(w[i], ' ' ORDER BY i) AS text
            FROM placed ANTI JOIN covered USING (doc_id, i) GROUP BY doc_id
        )
        SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
        FROM words LEFT JOIN kept USING (doc_id)
    """,
    "op13_lexical_search": r"""
        WITH found AS (
            SELECT doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
            FROM documents
        ), totals AS (
            SELECT count(*) AS docs, sum(len(t))::BIGINT AS terms FROM found WHERE len(t) > 0
        ), held AS (
            SELECT doc_id, len(t) AS n, unnest(t) AS term FROM found
        ), counts AS (
            SELECT doc_id, n, term, count(*) AS tf FROM held GROUP BY ALL
        ), weights AS (
            SELECT term, floor(1000 * ln((2.0 * docs + 2) / (2 * df + 1)))::BIGINT AS w
            FROM (SELECT term, count(*) AS df FROM counts GROUP BY term), totals
        ), asked AS (
            SELECT item_id, unnest(regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM benchmark
        ), scored AS (
            SELECT item_id, doc_id,
                sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms))))::BIGINT AS score
            FROM asked JOIN weights USING (term) JOIN counts USING (term), totals GROUP BY item_id, doc_id
        )
        SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
        FROM scored WHERE score > 0 QUALIFY rank <= 20
    """,
}
