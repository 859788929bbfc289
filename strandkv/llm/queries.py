"""One query per operator over the standard tables, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import encode_documents
from .common import documents
from .exact_dedup import exact_groups
from .html_text import extract
from .jaccard import components
from .packing import pack
from .pii import personal_data
from .quality import quality
from .suffix_dedup import remove_repeats
from .token_binary import round_trip
from .toxicity import toxicity

#: Read in place on every machine; never copied.
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    def held_out():
        return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = toxicity(documents(spark, sf_dir), labels, ~held_out())
    return got.withColumn("held_out", held_out())


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), WORD_TOKENIZER, 4096, 1)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir))


def op4_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir), WORD_TOKENIZER, 2)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(documents(spark, sf_dir), BYTE_RANKS, public_tokenizers.PATTERN)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir), 50)


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(documents(spark, sf_dir), 3, 90)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(documents(spark, sf_dir))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = quality(documents(spark, sf_dir, "doc_id", "text", "source"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_lines", "n_left_words")


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_token_binary": op4_token_binary,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_html_extraction": op7_html_extraction,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_pii": op9_pii,
    "op10_quality_rules": op10_quality_rules,
}

_OP3 = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC) = 1 AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) WINDOW w AS (PARTITION BY t)
"""

_OP10 = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, coalesce(source, chr(0) || 'none') AS host FROM documents
), w AS (
  SELECT *, list_filter(string_split(translate(t, chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     '), ' '), lambda x: x <> '') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: translate(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13), '') <> '') AS ls FROM d
), g AS (
  SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT rid, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM w WHERE len(ws) >= 3)
), r AS (
  SELECT rid, count(DISTINCT p) AS n FROM (
    SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM g) WHERE c > 1) GROUP BY rid
), l AS (
  SELECT rid, host, t, list_filter(string_split(translate(x, chr(9) || chr(11) || chr(12) || chr(13) || 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '    abcdefghijklmnopqrstuvwxyz'), ' '), lambda y: y <> '') AS lw
  FROM (SELECT rid, host, t, unnest(ls) AS x FROM w)
), n AS (
  SELECT host, array_to_string(lw, ' ') AS line, count(DISTINCT t) AS n FROM l GROUP BY 1, 2
), h AS (SELECT host, count(DISTINCT t) AS docs FROM d GROUP BY host),
f AS (SELECT n.host, n.line FROM n JOIN h USING (host) WHERE n.n > 20 AND 100 * n.n > 10 * h.docs),
gone AS (
  SELECT rid, count(*) AS lines, sum(len(lw)) AS words FROM l JOIN f ON l.host = f.host AND array_to_string(l.lw, ' ') = f.line GROUP BY rid
), a AS (
  SELECT w.doc_id, len(ws) AS n_words, length(translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS word_chars,
         length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
         coalesce(r.n, 0) AS n_repeat_words, coalesce(gone.lines, 0) AS n_removed_lines, len(ws) - coalesce(gone.words, 0) AS n_left_words
  FROM w LEFT JOIN r USING (rid) LEFT JOIN gone USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * n_left_words >= 20 * n_words AS kept,
       n_removed_lines::BIGINT AS n_removed_lines, n_left_words::BIGINT AS n_left_words FROM a
"""

ORACLE_SQL = {"op3_exact_dedup": _OP3, "op10_quality_rules": _OP10}
