"""Registered queries of this subpackage: one per operator, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import attribution, centroids, chat, covertree, decontaminate, divergence, extract, jaccard, mixture, quality, rules, tokens, warc
from ..session import fresh_path
from .common import stored, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql:
            ORACLE[name] = sql.strip()
        return function

    return register


@query("op8_quality_attention")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op7_jaccard_classes")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked_sets(table(spark, sf_dir, "documents"), share=90, width=3)


@query("op10_benchmark_leaks")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op5_source_mix", mixture.SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mixed(table(spark, sf_dir, "documents"))


@query("op3_token_orc")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_table(table(spark, sf_dir, "documents"), fresh_path(spark, "tokens"), tokens.default_path())


@query("op1_main_text")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.main_texts(table(spark, sf_dir, "pages"))


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS hex, max(page_id) OVER (PARTITION BY html) AS keeper FROM p),
b AS (SELECT *, [CAST('0x' || substr(hex, 1 + 5 * i, 5) AS BIGINT) FOR i IN range(8)] AS parts FROM d)
SELECT page_id, payload_bytes,
  list_aggregate([list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((x >> s) & 31 AS INT) + 1, 1) FOR s IN [15, 10, 5, 0]], 'string_agg', '') FOR x IN parts],
    'string_agg', '') AS payload_digest,
  CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> keeper THEN keeper END AS refers_to
FROM b
"""


@query("op2_warc_members", OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc.archive_pages(table(spark, sf_dir, "pages"), fresh_path(spark, "warc"))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op9_section_tokens")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.token_counts(table(spark, sf_dir, "documents"), tokens.default_path())


@query("op4_cover_tree")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.near_vectors(table(spark, sf_dir, "embeddings"), 0.93)


@query("op6_chat_round_trip", chat.SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = r"\### Assistant: </turn> ok"
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(planted).alias("text"))
    return chat.digests(stored(chat.format_chats(given.union(probe)), "chats"))


@query("op11_source_divergence", divergence.SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


@query("op12_quality_rules", rules.SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.apply_rules(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op13_centroid_clusters", centroids.sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clusters(table(spark, sf_dir, "embeddings"))
