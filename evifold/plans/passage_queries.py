"""Queries of parsing, chunking and budgets, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evifold.operators import passages as P
from evifold.plans.event_queries import _STEPS, steps
from evifold.sources.tables import table


def markdown_sections(spark: SparkSession, d: str) -> DataFrame:
    parsed = P.parse_sections(table(spark, d, "crawl_results"), "page_id", "markdown")
    return parsed.select(F.col("item_id").alias("page_id"), "title", F.size("sections").cast("bigint").alias("n_sections"), F.aggregate("sections", F.lit(0).cast("bigint"), lambda s, x: s + F.length(x["text"])).alias("n_chars"))


def html_sections(spark: SparkSession, d: str) -> DataFrame:
    parsed = P.parse_sections(table(spark, d, "crawl_results").where("html is not null"), "page_id", "html")
    return parsed.select(F.col("item_id").alias("page_id"), "title", F.posexplode("sections").alias("section_no", "s")).select("page_id", "title", "section_no", "s.heading", F.length("s.text").alias("n_chars"))


def fixed_chunks(spark: SparkSession, d: str) -> DataFrame:
    return P.stride_chunks(table(spark, d, "documents"), "doc_id", F.col("text")).select("doc_id", "chunk_no", "digest")


def interval_merge(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events").select("user_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("s"), F.col("value"))
    spans = ev.select("user_id", "s", (F.col("s") + F.floor(F.col("value") * 600)).alias("e"))
    return P.merge_intervals(spans, ["user_id"], "s", "e")


def char_budget(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", F.length("text").alias("n"))
    return P.char_budget(docs, ["source"], ["doc_id"], F.col("n"), 12_000).where("kept > 0").select("doc_id", "source", "kept")


def fair_share_cap(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "case_steps").where("run_id is not null").groupBy("run_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "log_id", F.length("executed_action").alias("n")))), lambda x: F.coalesce(x["n"], F.lit(0))).alias("sizes"))
    return rows.select("run_id", F.posexplode(P.fair_shares(F.col("sizes"), 700)).alias("pos", "share"))


def preview_share(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "paper_rows").where("pub_year is not null and channel is not null")
    return rows.select("paper_row_id", P.preview_caps(["pub_year", "channel"]).alias("cap"), P.token_estimate(F.col("abstract")).alias("tokens"))


def dict_factor(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "paper_rows").select("paper_row_id", "abstract")
    codes = P.dictionary(rows, "abstract", 120)
    packed = rows.join(codes, "abstract", "left").select("paper_row_id", F.coalesce("code", "abstract").alias("packed"), F.coalesce("n", F.lit(0)).alias("n"))
    return packed.select("paper_row_id", F.md5("packed").alias("packed"), "n")


def dict_round_trip(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "paper_rows").select("paper_row_id", F.concat(F.when(F.col("paper_row_id") % 7 == 0, "@").otherwise(""), "abstract").alias("abstract"))
    codes = P.dictionary(rows, "abstract", 120)
    back = P.unpacked_column(P.packed_column(rows, "abstract", codes).drop("abstract"), "packed", codes, "abstract")
    return back.select("paper_row_id", F.md5("abstract").alias("abstract"), (F.length("packed") <= F.length("abstract") + 1).alias("no_longer"))


def evidence_pack(spark: SparkSession, d: str) -> DataFrame:
    s = steps(spark, d).where("run_id is not null and feedback_status = 'ok' and a.source_id is not null").select("run_id", "turn", "log_id", F.col("a.source_id").alias("source"), F.repeat(F.col("a.reading_focus"), 9).alias("t"))
    return P.evidence_pack(s, ["run_id"], ["turn", "log_id"], "source", F.col("t"))


def sentence_overlap_excerpt(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("title is not null and text is not null")
    return P.best_sentences(docs, "doc_id", F.col("title"), F.col("text"))


def passage_dependencies(spark: SparkSession, d: str) -> DataFrame:
    """Lines that end with a colon open a scope for the later lines of their text: how many of them each line has before it."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where("trim(line) != ''")
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    marked = lines.withColumn("scopes", F.coalesce(F.sum(F.trim("line").rlike(":$").cast("int")).over(w), F.lit(0)))
    return marked.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.col("scopes") > 0).alias("scoped"), F.max("scopes").alias("scopes"))


QUERIES = {f.__name__: f for f in (markdown_sections, html_sections, fixed_chunks, interval_merge, char_budget, fair_share_cap, preview_share, dict_factor, dict_round_trip, evidence_pack, sentence_overlap_excerpt, passage_dependencies)}

SQL = {
    "dict_round_trip": "SELECT paper_row_id, md5(CASE WHEN paper_row_id % 7 = 0 THEN '@' ELSE '' END || abstract) AS abstract, CASE WHEN abstract IS NOT NULL THEN true END AS no_longer FROM paper_rows",
    "fair_share_cap": """WITH RECURSIVE r AS (SELECT run_id, list(coalesce(length(executed_action), 0) ORDER BY turn, log_id) AS z FROM case_steps WHERE run_id IS NOT NULL GROUP BY 1),
f AS (SELECT run_id, z, 0 AS pos, 700 AS rest, least(z[1], greatest(1, 700 // len(z))) AS share FROM r
  UNION ALL SELECT run_id, z, pos + 1, rest - share, least(z[pos + 2], CASE WHEN rest - share <= 0 THEN 0 ELSE greatest(1, (rest - share) // (len(z) - pos - 1)) END) FROM f WHERE pos + 1 < len(z))
SELECT run_id, pos, share FROM f""",
    "evidence_pack": rf"""WITH RECURSIVE {_STEPS}, x AS (SELECT run_id, turn, log_id, source, repeat(focus, 9) AS t FROM s WHERE run_id IS NOT NULL AND feedback_status = 'ok' AND source IS NOT NULL),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, source, md5(trim(regexp_replace(t, '\s+', ' ', 'g'))) ORDER BY turn, log_id) AS k FROM x WHERE length(t) > 0) WHERE k = 1),
g AS (SELECT run_id, source, list(length(t) ORDER BY turn, log_id) AS z, min((turn, log_id)) AS f FROM o GROUP BY 1, 2), p AS (SELECT *, dense_rank() OVER (PARTITION BY run_id ORDER BY f, source) AS q FROM g),
w AS (SELECT run_id, source, z, 0 AS i, 0 AS taken, 0 AS used FROM p WHERE q <= 6
  UNION ALL SELECT run_id, source, z, i + 1, CASE WHEN taken < 3 AND used + z[i + 1] <= 2400 THEN taken + 1 ELSE taken END, CASE WHEN taken < 3 AND used + z[i + 1] <= 2400 THEN used + z[i + 1] ELSE used END FROM w WHERE i < len(z))
SELECT run_id, source, taken, used FROM w WHERE i = len(z)""",
    "fixed_chunks": "WITH n AS (SELECT doc_id, text, unnest(range(0, greatest(1, CAST(ceil((length(text) - 1800) / 1600) AS BIGINT) + 1))) AS chunk_no FROM documents WHERE length(text) > 0) SELECT doc_id, chunk_no, sha256(substr(text, chunk_no * 1600 + 1, 1800)) AS digest FROM n",
    "interval_merge": "WITH e AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS s, CAST(floor(epoch(ts)) AS BIGINT) + CAST(floor(value * 600) AS BIGINT) AS e FROM events), m AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM e WHERE s <= e), i AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM m) SELECT user_id, min(s) AS island_start, max(e) AS island_end, count(*) AS n FROM i GROUP BY user_id, island",
    "char_budget": "WITH b AS (SELECT doc_id, source, coalesce(length(text), 0) AS n, coalesce(sum(coalesce(length(text), 0)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM documents) SELECT doc_id, source, CAST(greatest(0, least(n, 12000 - used)) AS BIGINT) AS kept FROM b WHERE greatest(0, least(n, 12000 - used)) > 0",
    "preview_share": "SELECT paper_row_id, CAST(least(128, floor(1024 / count(*) OVER (PARTITION BY pub_year, channel))) AS BIGINT) AS cap, CAST(coalesce(greatest(ceil(strlen(abstract) / 3.15), ceil(1.1 * len(regexp_extract_all(abstract, '[A-Za-z0-9]+|[㐀-鿿]')))), 0) AS BIGINT) AS tokens FROM paper_rows WHERE pub_year IS NOT NULL AND channel IS NOT NULL",
    "dict_factor": "WITH c AS (SELECT abstract, '@' || substr(sha256(abstract), 1, 16) AS code, count(*) AS n FROM paper_rows WHERE length(abstract) >= 120 GROUP BY abstract HAVING count(*) >= 2) SELECT paper_row_id, md5(coalesce(code, p.abstract)) AS packed, coalesce(n, 0) AS n FROM paper_rows p LEFT JOIN c ON p.abstract = c.abstract",
    "sentence_overlap_excerpt": r"""WITH d AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(title), '[a-z0-9]+')) AS q, string_split_regex(text, '[.!?。！？]+[ \n]*') AS l FROM documents WHERE title IS NOT NULL AND text IS NOT NULL),
s AS (SELECT doc_id, q, generate_subscripts(l, 1) - 1 AS sentence_no, list_distinct(regexp_extract_all(lower(unnest(l)), '[a-z0-9]+')) AS w FROM d),
f AS (SELECT doc_id, sentence_no, round(2.0 * len(list_intersect(q, w)) / (len(q) + len(w)), 6) AS f1 FROM s WHERE len(list_intersect(q, w)) > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY f1 DESC, sentence_no) AS k FROM f) SELECT doc_id, sentence_no, f1 FROM r WHERE k = 1""",
    "passage_dependencies": r"WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), x AS (SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS line FROM l), m AS (SELECT doc_id, coalesce(sum(CAST(regexp_matches(trim(line), ':$') AS INT)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS scopes FROM x WHERE trim(line) <> '') SELECT doc_id, count(*) AS lines, count(*) FILTER (scopes > 0) AS scoped, CAST(max(scopes) AS BIGINT) AS scopes FROM m GROUP BY doc_id",
}
