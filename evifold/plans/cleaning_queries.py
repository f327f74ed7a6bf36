"""Queries of cleaning, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evifold.operators import cleaning as C
from evifold.plans.event_queries import _STEPS, steps
from evifold.sources.tables import table


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "crawl_results").select("page_id", "markdown")


def link_density_blocks(spark: SparkSession, d: str) -> DataFrame:
    blocks = C.text_blocks(_pages(spark, d), "page_id", F.col("markdown"))
    hinted = F.col("block").rlike(r"^\s*([*+-]|\[)")
    return blocks.select("page_id", "block_no", F.round(C.link_density(F.col("block")), 4).alias("density"), C.dropped_block(F.col("block"), hinted).alias("dropped"))


def body_blocks(spark: SparkSession, d: str) -> DataFrame:
    blocks = C.text_blocks(_pages(spark, d), "page_id", F.col("markdown"))
    return C.body_blocks(blocks, "page_id").groupBy("page_id").agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.length("block")).alias("chars"))


def retained_spans(spark: SparkSession, d: str) -> DataFrame:
    spans = C.retained_spans(_pages(spark, d), "page_id", F.col("markdown"))
    return spans.groupBy("page_id").agg(F.count(F.lit(1)).alias("spans"), F.sum(F.length("span")).alias("chars"))


def section_audit(spark: SparkSession, d: str) -> DataFrame:
    audit = C.section_audit(table(spark, d, "documents"), "doc_id", F.col("text"))
    return audit.withColumn("section_no", F.col("section_no").cast("bigint")).withColumn("chars", F.col("chars").cast("bigint"))


def readable_body(spark: SparkSession, d: str) -> DataFrame:
    return C.readable_body(C.section_audit(table(spark, d, "documents"), "doc_id", F.col("text")), "doc_id")


def clean_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = C.clean_lines(_pages(spark, d), "page_id", F.col("markdown"))
    return lines.select("page_id", F.col("line_no").cast("bigint").alias("line_no"), F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"))


def observation_status(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "case_steps").where("run_id is not null")
    return C.observation_status(rows, ["run_id"], F.size("new_evidence_ids") > 0, F.col("feedback_status") == "blocked", "feedback_status")


def incomplete_tables(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null")
    window = F.substring("text", 1, 1_800)
    flag = C.incomplete_table(window, F.lit(0), F.lit(1_800), F.lit(0), F.length("text"))
    return docs.select("doc_id", flag.alias("incomplete"))


def source_requirements(spark: SparkSession, d: str) -> DataFrame:
    papers = table(spark, d, "paper_rows")
    want = F.when(F.col("rank_no") % 3 == 0, "Meta-Analysis").when(F.col("rank_no") % 3 == 1, "any").otherwise("")
    return papers.select("paper_row_id", C.source_requirement(want, F.col("publication_types")).alias("met"))


def language_matches(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_outputs").select("output_id", C.language_matches(F.col("problem"), F.col("final_response")).alias("same_script"))


def query_anchors(spark: SparkSession, d: str) -> DataFrame:
    rows = steps(spark, d).where("a.query is not null").select("log_id", F.col("a.query").alias("q"))
    parts = F.filter(F.split("q", " "), lambda x: F.length(x) >= 4)
    places = C.anchors_in_order(F.col("q"), F.slice(parts, 1, 2))
    return rows.select("log_id", F.array_join(F.transform(places, lambda x: x.cast("string")), ",").alias("places"))


QUERIES = {f.__name__: f for f in (link_density_blocks, body_blocks, retained_spans, section_audit, readable_body, clean_lines, observation_status, incomplete_tables, source_requirements, language_matches, query_anchors)}

_L = C.LINK
_BLOCKS = r"""blocks AS (SELECT page_id, block_no, block FROM (SELECT page_id, unnest(p) AS block, generate_subscripts(p, 1) AS block_no FROM (SELECT page_id, regexp_split_to_array(replace(markdown, chr(13), ''), '\n[ \t]*\n') AS p FROM crawl_results WHERE markdown IS NOT NULL)) WHERE trim(regexp_replace(block, '\s+', ' ', 'g')) <> '')"""
_DENSITY = rf"coalesce(list_sum(list_transform(regexp_extract_all(block, '{_L}', 1), lambda x: length(x))), 0) / CAST(nullif(length(regexp_replace(block, '{_L}', '\1', 'g')), 0) AS DOUBLE)"
_SECTIONS = rf"""parts AS (SELECT doc_id, unnest(p) AS s, generate_subscripts(p, 1) - 1 AS i FROM (SELECT doc_id, regexp_split_to_array(chr(10) || replace(text, chr(13), ''), '\n#{{1,6}} ') AS p FROM documents WHERE text IS NOT NULL)),
named AS (SELECT doc_id, i, CASE WHEN i > 0 THEN trim(split_part(s, chr(10), 1)) END AS heading, trim(regexp_replace(CASE WHEN i > 0 THEN regexp_replace(s, '^[^\n]*', '') ELSE s END, '\s+', ' ', 'g')) AS b FROM parts),
shaped AS (SELECT *, regexp_matches(b, '{C.ASSERTION}') OR contains(b, '|') AS kept, lower(trim(coalesce(heading, ''))) AS head FROM named WHERE i > 0 OR b <> ''),
audit AS (SELECT doc_id, i + 1 AS section_no, heading, CASE WHEN b = '' THEN 'empty'
  WHEN NOT kept AND len(regexp_extract_all(b, '\bD[0-9]{{6,9}}\b')) >= 3 AND length(b) <= 1200 THEN 'descriptor_list'
  WHEN NOT kept AND len(regexp_extract_all(b, '(?i)\b(?:quick reference guide|slide set|checklist|podcast|download|fact sheet|video|toolkit)\b')) >= 3 AND length(b) <= 4000 THEN 'resource_catalogue'
  WHEN NOT kept AND regexp_matches(b, '(?i)^\s*(correspondence|contact|e-?mail)\s*:') AND length(b) <= 400 THEN 'contact'
  WHEN NOT kept AND head IN ('clinical guidelines', 'guidelines', 'site directory', 'guidelines in development') AND length(b) <= 800 THEN 'index'
  WHEN (length(b) <= 320 AND regexp_matches(b, '{C.ASSERTION}')) OR length(b) >= 60 THEN 'content' ELSE 'short' END AS kind, length(b) AS chars FROM shaped)"""
_SCRIPT = "CASE WHEN len(regexp_extract_all({0}, '[一-鿿]')) + len(regexp_extract_all({0}, '[A-Za-zÀ-ÿ]')) >= 12 THEN len(regexp_extract_all({0}, '[一-鿿]')) >= 0.3 * (len(regexp_extract_all({0}, '[一-鿿]')) + len(regexp_extract_all({0}, '[A-Za-zÀ-ÿ]'))) END"
SQL = {
    "link_density_blocks": rf"""WITH {_BLOCKS}, x AS (SELECT *, coalesce({_DENSITY}, 0) AS d FROM blocks) SELECT page_id, block_no, round(d, 4) AS density, regexp_matches(block, '^\s*([*+-]|\[)') AND d >= 0.65 AND length(block) <= 1400
  AND NOT (length(block) >= 180 AND len(regexp_extract_all(block, '{C.SENTENCE_END}')) >= 2) AS dropped FROM x""",
    "body_blocks": f"""WITH {_BLOCKS}, x AS (SELECT *, coalesce({_DENSITY}, 0) AS d FROM blocks), s AS (SELECT page_id, min(block_no) AS lo, max(block_no) AS hi FROM x WHERE length(block) >= 80 AND d < 0.35 GROUP BY 1)
SELECT page_id, count(*) AS blocks, sum(length(block)) AS chars FROM x LEFT JOIN s USING (page_id) WHERE coalesce(block_no BETWEEN lo AND hi, false) OR (length(block) <= 320 AND regexp_matches(block, '{C.ASSERTION}')) GROUP BY 1""",
    "retained_spans": rf"""WITH p AS (SELECT page_id, unnest(regexp_split_to_array(markdown, '{C.EXCLUDED}')) AS s FROM crawl_results WHERE markdown IS NOT NULL), t AS (SELECT page_id, regexp_replace(regexp_replace(s, '^\s+', ''), '\s+$', '') AS s FROM p)
SELECT page_id, count(*) AS spans, sum(length(s)) AS chars FROM t WHERE s <> '' GROUP BY 1""",
    "section_audit": f"WITH {_SECTIONS} SELECT *, kind = 'content' AS eligible FROM audit",
    "readable_body": f"WITH {_SECTIONS} SELECT doc_id, count(*) AS sections, count(*) FILTER (kind = 'content') AS eligible, bool_or(kind = 'content') AS readable FROM audit GROUP BY 1",
    "clean_lines": rf"""WITH l AS (SELECT page_id, unnest(p) AS line, generate_subscripts(p, 1) AS line_no FROM (SELECT page_id, string_split(markdown, chr(10)) AS p FROM crawl_results WHERE markdown IS NOT NULL)),
q AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY page_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM l)
SELECT page_id, line_no, CAST(start AS BIGINT) AS start, CAST(start + length(line) AS BIGINT) AS "end" FROM q WHERE trim(line) <> '' AND (regexp_matches(line, '^\s*\|.*\|\s*$') OR NOT regexp_full_match(line, '{C.TEMPLATE_LINE}'))""",
    "observation_status": "SELECT run_id, CASE WHEN bool_or(coalesce(len(new_evidence_ids) > 0, false)) THEN max(feedback_status) WHEN bool_or(coalesce(feedback_status = 'blocked', false)) THEN 'access_blocked' ELSE 'source_unreadable' END AS status FROM case_steps WHERE run_id IS NOT NULL GROUP BY 1",
    "incomplete_tables": r"""WITH w AS (SELECT doc_id, substring(text, 1, 1800) AS t, length(text) AS n FROM documents WHERE text IS NOT NULL)
SELECT doc_id, len(regexp_extract_all(t, '(?m)^\s*\|.*\|\s*$')) >= 2 AND (n > 1800 OR regexp_matches(split_part(t, chr(10), -1), '^\s*\|.*[^|\s]\s*$')) AS incomplete FROM w""",
    "source_requirements": "SELECT paper_row_id, CASE WHEN rank_no % 3 = 1 THEN true WHEN rank_no % 3 = 0 THEN coalesce(list_contains(publication_types, 'Meta-Analysis'), false) END AS met FROM paper_rows",
    "language_matches": f"SELECT output_id, ({_SCRIPT.format('problem')}) = ({_SCRIPT.format('final_response')}) AS same_script FROM eval_outputs",
    "query_anchors": f"""WITH {_STEPS}, p AS (SELECT log_id, query AS q, list_filter(string_split(query, ' '), lambda x: length(x) >= 4)[1:2] AS a FROM s WHERE query IS NOT NULL),
f AS (SELECT *, strpos(q, a[1]) AS p1 FROM p), g AS (SELECT *, CASE WHEN p1 > 0 AND len(a) = 2 THEN strpos(substring(q, p1 + length(a[1])), a[2]) END AS p2 FROM f)
SELECT log_id, CASE WHEN len(a) = 0 THEN '' WHEN len(a) = 1 THEN CAST(p1 AS VARCHAR) WHEN p2 > 0 THEN p1 || ',' || (p2 + p1 + length(a[1]) - 1) END AS places FROM g""",
}
