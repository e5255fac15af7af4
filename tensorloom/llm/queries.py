"""Registered queries of the operators: thin wrappers that derive the result columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.llm import (
    attention, bpe_tree, forest, licences, mixing, packing, quality, repair, sketches, substrings, token_files, whitening,
    wordpiece,
)
from tensorloom.llm.texts import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

END_ID = 1
SEQUENCE_TOKENS = 2048


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query
def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "token-files")
    path = public_tokenizers.path("word_bpe_49k.json")
    token_files.write(documents(spark, sf_dir), folder, path, END_ID)
    return token_files.read(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op10_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    cut = packing.cut_documents(documents(spark, sf_dir), path, end_id=0, capacity=SEQUENCE_TOKENS)
    slim = cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(slim, "length", SEQUENCE_TOKENS)


@query
def op3_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.ledger(documents(spark, sf_dir)).select("doc_id", "ledger.*")
    failed = F.col("failed")
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        quality.rejects(failed, quality.BASE).alias("base_failed"),
        (~quality.rejects(failed, quality.CURRENT)).alias("kept"),
        "failed",
    )


ORACLE_SQL["op3_rule_ledger"] = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT doc_id, text,
    regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM t
), g AS (
  SELECT doc_id, text, words, lines,
    list_transform(generate_series(1, len(words) - 2), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) AS grams
  FROM w
), times AS (
  SELECT doc_id, gram, list(i) AS places FROM (
    SELECT doc_id, unnest(grams) AS gram, generate_subscripts(grams, 1) AS i FROM g
  ) GROUP BY doc_id, gram HAVING count(*) > 1
), repeated AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, unnest([place, place + 1, place + 2]) AS p FROM (SELECT doc_id, unnest(places) AS place FROM times)
  ) GROUP BY doc_id
), top AS (
  SELECT doc_id, max(n) AS n FROM (
    SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(words) AS word FROM w) GROUP BY ALL
  ) GROUP BY doc_id
), m AS (
  SELECT g.doc_id, len(words) AS n_words,
    coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(r.n, 0) AS n_repeat_words,
    len(lines) AS n_lines,
    len(regexp_extract_all(text, '[A-Za-zÀ-ÖØ-öø-ÿ]')) AS n_letters,
    len(regexp_extract_all(text, '[A-ZÀ-ÖØ-Þ]')) AS n_upper,
    coalesce(top.n, 0) AS n_top_word
  FROM g LEFT JOIN repeated r USING (doc_id) LEFT JOIN top USING (doc_id)
), f AS (
  SELECT *, (
    (n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT
    + 4 * (10 * n_symbols > n_words)::BIGINT + 8 * (n_dup_lines > 5 AND 2 * n_dup_lines > n_lines)::BIGINT
    + 16 * (2 * n_upper > n_letters)::BIGINT + 32 * (word_chars < 2 * n_words)::BIGINT
    + 64 * (word_chars > 20 * n_words)::BIGINT + 128 * (2 * n_letters < word_chars)::BIGINT
    + 256 * (5 * n_top_word > 2 * n_words)::BIGINT)::BIGINT AS failed
  FROM m
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, (failed & 3) <> 0 AS base_failed, failed = 0 AS kept, failed
FROM f
"""


@query
def op8_longest_match_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"))


@query
def op9_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = bpe_tree.encode(documents(spark, sf_dir), ranks, pattern)
    return bpe_tree.decode(encoded, ranks, pattern).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("data", 256).alias("decoded_sha256")
    )


@query
def op4_near_duplicate_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.near_duplicates(documents(spark, sf_dir))


@query
def op6_earlier_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substrings.remove_repeats(documents(spark, sf_dir))
    lengths = F.transform("spans", lambda s: s["end"] - s["start"])
    return cut.select(
        "doc_id", "n_bytes", F.aggregate(lengths, F.lit(0).cast("bigint"), lambda a, b: a + b).alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


@query
def op2_licence_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(documents(spark, sf_dir))


@query
def op5_paragraph_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sketches.fingerprints(documents(spark, sf_dir))
    return found.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        "near_edited", "near_next",
    )


@query
def op7_attention_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return attention.score_texts(documents(spark, sf_dir), path, begin_id=49406, end_id=49407).drop("losses")


@query
def op11_refined_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query
def op12_shared_ending_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


@query
def op13_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies")
