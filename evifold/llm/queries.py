"""Queries over the test tables, one or more per problem, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evifold.llm import boilerplate, contamination, formatdups, mojibake, packing, qapairs, splitting
from evifold.sources.tables import table


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(table(spark, d, "documents")).withColumnRenamed("item_id", "doc_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    crawled = boilerplate.furniture(table(spark, d, "crawl_results"), "page_id", "markdown")
    pages = boilerplate.furniture(table(spark, d, "documents"), "doc_id", "text", F.col("doc_kind") == "web_page")
    named = [x.select(F.lit(name).alias("page_table"), "item_id", "line_no") for name, x in (("crawl_results", crawled), ("documents", pages))]
    return named[0].unionByName(named[1])


def p2_main_body(spark: SparkSession, d: str) -> DataFrame:
    crawled = boilerplate.main_body(table(spark, d, "crawl_results"), "page_id", "markdown")
    pages = boilerplate.main_body(table(spark, d, "documents"), "doc_id", "text", F.col("doc_kind") == "web_page")
    named = [x.select(F.lit(name).alias("page_table"), "item_id", "body") for name, x in (("crawl_results", crawled), ("documents", pages))]
    return named[0].unionByName(named[1])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return formatdups.duplicate_pairs(formatdups.canonical_searches(table(spark, d, "case_steps")))


def p3_distinct(spark: SparkSession, d: str) -> DataFrame:
    return formatdups.distinct_records(formatdups.canonical_searches(table(spark, d, "case_steps")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return qapairs.defective_pairs(table(spark, d, "eval_outputs")).withColumnRenamed("item_id", "output_id")


def p5_sequences(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(packing.sized(table(spark, d, "documents"))).withColumnRenamed("item_id", "doc_id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    leaks = contamination.find_leaks(table(spark, d, "documents"), table(spark, d, "exclusion_pool"), paraphrases=False)
    return leaks.where("kind = 'verbatim'").select(F.col("item_id").alias("doc_id"), "question_id").distinct()


def p6_leaks(spark: SparkSession, d: str) -> DataFrame:
    return contamination.find_leaks(table(spark, d, "documents"), table(spark, d, "exclusion_pool")).withColumnRenamed("item_id", "doc_id")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.find_wrong_decoding(table(spark, d, "documents")).select(F.col("item_id").alias("doc_id"))


def p7_restored(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.find_wrong_decoding(table(spark, d, "documents"), with_text=True).withColumnRenamed("item_id", "doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    listed = (p1_pieces, p2_found, p2_main_body, p3_found, p3_distinct, p4_found, p5_sequences, p6_found, p6_leaks, p7_found, p7_restored)
    return {f.__name__: f for f in listed}


_P3_ACTIONS = r"""
WITH parsed AS (
  SELECT log_id, CAST(executed_action AS JSON) AS j FROM case_steps WHERE json_valid(executed_action)
), w AS (
  SELECT log_id,
    trim(regexp_replace(replace(lower(j->>'action'), 'ß', 'ss'), '[^\p{L}\p{N}]+', ' ', 'g')) AS action,
    coalesce(trim(regexp_replace(replace(lower(j->>'channel'), 'ß', 'ss'), '[^\p{L}\p{N}]+', ' ', 'g')), '') AS channel,
    coalesce(list_transform(CAST(j->'requirement_ids' AS VARCHAR[]), lambda x: trim(regexp_replace(replace(lower(x), 'ß', 'ss'), '[^\p{L}\p{N}]+', ' ', 'g'))), []) AS ids,
    trim(regexp_replace(replace(lower(j->>'query'), 'ß', 'ss'), '[^\p{L}\p{N}]+', ' ', 'g')) AS query
  FROM parsed
), sets AS (
  SELECT log_id, min(log_id) OVER g AS keep_id, count(*) OVER g AS n_copies
  FROM w WHERE action = 'search' AND query <> '' WINDOW g AS (PARTITION BY channel, ids, query)
)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": _P3_ACTIONS + " SELECT keep_id, log_id AS dup_id FROM sets WHERE log_id > keep_id",
        "p3_distinct": _P3_ACTIONS + " SELECT DISTINCT keep_id, CAST(n_copies AS BIGINT) AS n_copies FROM sets",
    }
