"""Queries of section classes, candidate scores and visibility windows, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evifold.operators import ranking as R
from evifold.operators import selection as S
from evifold.operators import textrules as T
from evifold.sources.tables import table

_AUTHORITY = {"corxilvita.example": 110, "udancare.example": 90, "sazirmed.example": 75}


def section_classifier(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", S.heading_kind(F.col("title")).alias("heading"), S.section_class(F.col("title"), F.col("text")).alias("class"), S.quality_penalty(F.col("title"), F.col("text")).alias("penalty"))


def web_candidates(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("doc_kind = 'web_page' and title is not null")
    host = T.host(F.col("url"))
    words = docs.select("doc_id", "lang", "title", "url", host.alias("host"), R.distinct_tokens(F.col("title")).alias("q"), R.distinct_tokens(F.col("snippet")).alias("o"), R.distinct_tokens(F.col("text")).alias("t"), F.when(F.col("error").isNotNull(), 40.0).alias("penalty"))
    scored = words.withColumn("score", F.round(S.web_score(F.col("q"), F.col("o"), F.col("t"), F.col("url"), S.authority(F.col("host"), _AUTHORITY), F.col("penalty")), 6))
    ranked = R.domain_diverse(scored.withColumn("lang", F.coalesce("lang", F.lit("none"))), ["lang"], "host", "score", "title", "doc_id")
    return ranked.select("lang", "doc_id", "score", "rank")


def paper_utility(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "paper_rows").where("source_id is not null")
    text = F.lower(F.concat_ws(" ", F.array_join(F.coalesce("publication_types", F.array()), " "), "title", "abstract"))
    score = S.paper_score(R.tokens(F.col("title")), R.tokens(F.col("abstract")), F.col("abstract"), F.col("pub_year"), T.study_design(text), T.human_evidence(text))
    return rows.select("paper_row_id", F.round(score, 6).alias("score"))


def pubmed_rerank(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "paper_rows").where("channel is not null and pub_year is not null and rank_no is not null")
    scored = rows.select("paper_row_id", "channel", "pub_year", "rank_no", F.length("abstract").alias("a"), F.size("publication_types").alias("b"))
    placed = scored.withColumn("position", F.row_number().over(Window.partitionBy("channel", "pub_year").orderBy("rank_no", "paper_row_id")))
    return S.rerank_head(placed, ["channel", "pub_year"], "position", ["a", "b"]).select("paper_row_id", "position", "final")


def passage_slots(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("score is not null")
    ranked = docs.select("doc_id", "source", "doc_kind", "lang", F.coalesce("lang", F.lit("none")).alias("l"), F.round("score", 6).alias("score"), (F.length("text") > 1500).alias("good"))
    placed = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("doc_kind", "l").orderBy(F.desc("score"), "doc_id")))
    return S.three_slots(placed, ["doc_kind", "l"], "rank", "source", F.col("good")).where("slot is not null").select("doc_id", "slot")


def visible_candidates(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "paper_rows").where("pub_year is not null and channel is not null")
    shown = S.visible(rows, ["pub_year", "channel"], F.col("rank_no") <= 5, F.length("abstract"), F.col("rank_no"), "paper_row_id")
    return shown.select("paper_row_id", "slot")


def pool_merge(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "paper_rows").where("source_id is not null and pub_year is not null and rank_no is not null").select("pub_year", "source_id", "rank_no", "channel")
    return S.merge_pools(rows.where("channel = 'pubmed'"), rows.where("channel != 'pubmed'"), ["pub_year"], "source_id", "rank_no", 20)


def citation_support(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "paper_rows").where("title is not null and abstract is not null")
    return rows.select("paper_row_id", F.round(S.citation_fit(F.col("title"), F.col("abstract")), 6).alias("fit"))


def eligible_fusion(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "paper_rows").where("pub_year is not null and channel is not null").select("paper_row_id", "pub_year", "channel", F.length("abstract").alias("a"), F.length("title").alias("t"), (F.col("pmid").isNotNull()).alias("ok"))
    out = S.fused(rows, ["pub_year", "channel"], "a", "t", ["paper_row_id"], 10, 16, F.col("ok"))
    return out.select("paper_row_id", "r1", "r2", F.round("rrf", 9).alias("rrf"), "rank")


QUERIES = {f.__name__: f for f in (section_classifier, web_candidates, paper_utility, pubmed_rerank, passage_slots, visible_candidates, pool_merge, citation_support, eligible_fusion)}


def _in(names: list[str]) -> str:
    return "(" + ", ".join("'" + n.replace("'", "''") + "'" for n in names) + ")"


def _n(pattern: str, text: str = "t") -> str:
    return f"len(regexp_extract_all({text}, '{pattern}'))"


def _phrase(text: str, phrases: list[str]) -> str:
    return f"regexp_matches(' ' || {text} || ' ', '[^a-z0-9](" + "|".join(p.replace("-", "[-]") for p in phrases) + ")[^a-z0-9]')"


_TOK = r"regexp_extract_all(lower(coalesce({}, '')), '[a-z0-9]+|[\x{{4e00}}-\x{{9fff}}]')"
_KIND = f"CASE WHEN h IN {_in(S.BIBLIOGRAPHY)} THEN 'bibliography' WHEN h IN {_in(S.PUBLICATION)} THEN 'publication_metadata' WHEN h IN {_in(S.NAVIGATION)} THEN 'web_boilerplate' ELSE 'content' END"
_HOST = r"nullif(regexp_replace(regexp_replace(regexp_extract(lower(url), '^https?://([^/?#@]*@)?([^/?#:]+)', 2), '^www\.', ''), '\.$', ''), '')"
_AUTH = "greatest(" + ", ".join(f"CASE WHEN host = '{h}' OR ends_with(host, '.{h}') THEN {s} ELSE -1 END" for h, s in _AUTHORITY.items()) + ")"
_DESIGN = "CASE " + " ".join(f"WHEN {_phrase('x', cues)} THEN '{name}'" for name, cues in T.DESIGNS) + " ELSE 'unknown' END"
_SHARE = "len(list_intersect({0}, {1})) / greatest(1, len({0}))"
_BI = "list_distinct(list_transform({0}[1:len({0})-1], lambda x, i: x || ' ' || {0}[i+1]))"
SQL = {
    "section_classifier": rf"""WITH b AS (SELECT doc_id, regexp_replace(lower(trim(coalesce(title, ''))), '^[#0-9.\s]+|[\s:.*#]+$', '', 'g') AS h, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS t FROM documents),
f AS (SELECT doc_id, h, t, lower(t) AS l, {_KIND} AS k, length(t) AS n, {_n('[。！？!?]|[.]( |$)')} AS ends FROM b),
g AS (SELECT *, n >= 180 AND ends >= 2 AS prose, {_n('all rights reserved|copyright|terms of use|privacy policy|cookie', 'l')} AS legal, {_n('doi|PMID|[0-9]{4};[0-9]+|et al[.]')} AS rec, {_n('subscribe|sign up|share this|print this|download|log in|sign in|newsletter', 'l')} AS ctl,
  regexp_matches(l, '[0-9]+([.][0-9]+)? ?%|95% ci|confidence interval|randomi[sz]ed|p ?[<=]|reduced|increased|compared with|recommend') AS ev, regexp_matches(l, 'all rights reserved|cookie settings|javascript is disabled|accept all cookies') AS boil FROM f)
SELECT doc_id, k AS heading, CASE WHEN k = 'publication_metadata' THEN k WHEN k = 'bibliography' AND rec >= 1 THEN k WHEN legal >= 2 AND n <= 1200 AND NOT prose THEN 'web_boilerplate' WHEN prose THEN 'content' WHEN ctl >= 2 AND n <= 600 THEN 'web_boilerplate' WHEN k = 'web_boilerplate' AND n <= 400 AND ends = 0 THEN 'web_boilerplate' ELSE 'content' END AS class,
  CASE WHEN boil AND NOT ev THEN CAST(100 AS DOUBLE) WHEN k <> 'content' AND ev THEN 0 WHEN k <> 'content' OR (n < 320 AND NOT ev) THEN 2 ELSE 0 END AS penalty FROM g""",
    "web_candidates": rf"""WITH w AS (SELECT doc_id, coalesce(lang, 'none') AS lang, title, url, {_HOST} AS host, list_filter(list_distinct({_TOK.format('title')}), lambda x: x NOT IN {_in(S.FRAMING)}) AS q, list_filter(list_distinct({_TOK.format('snippet')}), lambda x: x NOT IN {_in(S.FRAMING)}) AS o, list_distinct({_TOK.format('text')}) AS t, {_TOK.format('text')} AS raw, CASE WHEN error IS NOT NULL THEN 40.0 ELSE 0.0 END AS pen FROM documents WHERE doc_kind = 'web_page' AND title IS NOT NULL),
u AS (SELECT *, list_sort(list_transform(t, lambda x: list_position(raw, x))) AS pos FROM w),
v AS (SELECT *, array_to_string(list_transform(pos, lambda p: raw[p]), ' ') || ' ' || lower(url) AS x FROM u),
r AS (SELECT *, 0.3 * ({_SHARE.format('q', 't')}) + 0.7 * CASE WHEN len(o) > 0 THEN {_SHARE.format('o', 't')} ELSE {_SHARE.format('q', 't')} END AS rel, CASE WHEN {_AUTH} < 0 OR host IS NULL THEN 60 ELSE {_AUTH} END AS auth FROM v),
s AS (SELECT doc_id, lang, title, host, round(200 * rel + least(1.0, rel / 0.15) * (0.1 * auth + CASE WHEN {_phrase('x', S.EVIDENCE_CUES)} THEN 12 ELSE 0 END) - CASE WHEN regexp_matches(lower(url), '{'|'.join(S.LOW_VALUE_PATHS)}') THEN 10 ELSE 0 END - pen, 6) AS score FROM r),
a AS (SELECT *, score - 30.0 * (row_number() OVER (PARTITION BY lang, host ORDER BY score DESC, title DESC, doc_id) - 1) AS adj FROM s)
SELECT lang, doc_id, score, row_number() OVER (PARTITION BY lang ORDER BY adj DESC, title DESC, doc_id) AS rank FROM a""",
    "paper_utility": f"""WITH b AS (SELECT paper_row_id, {_TOK.format('title')} AS q, {_TOK.format('abstract')} AS t, abstract, try_cast(nullif(regexp_extract(coalesce(pub_year, ''), '^([0-9]{{4}})', 1), '') AS INT) AS y, lower(concat_ws(' ', array_to_string(coalesce(publication_types, []), ' '), title, abstract)) AS x FROM paper_rows WHERE source_id IS NOT NULL),
f AS (SELECT *, {_DESIGN} AS d, {_phrase('x', T.HUMAN)} AND NOT {_phrase('x', T.ANIMAL)} AS h, len(list_intersect({_BI.format('q')}, {_BI.format('t')})) AS s, length(trim(coalesce(abstract, ''))) AS n FROM b)
SELECT paper_row_id, round(80 * (len(list_intersect(list_distinct(q), list_distinct(t))) / greatest(1, len(list_distinct(q)))) + 20 * least(2, s) + CASE d WHEN 'meta_analysis' THEN 30 WHEN 'systematic_review' THEN 24 WHEN 'randomized_trial' THEN 26 WHEN 'observational' THEN 10 WHEN 'protocol' THEN -55 ELSE 0 END + CASE WHEN h THEN 12 ELSE 0 END + 0.25 * greatest(0, least(30, coalesce(y - 2000, 0))) + CASE WHEN n > 0 THEN least(12.0, n / 120.0) ELSE -12.0 END, 6) AS score FROM f""",
    "pubmed_rerank": "WITH p AS (SELECT paper_row_id, channel, pub_year, length(abstract) AS a, len(publication_types) AS b, row_number() OVER (PARTITION BY channel, pub_year ORDER BY rank_no, paper_row_id) AS position FROM paper_rows WHERE channel IS NOT NULL AND pub_year IS NOT NULL AND rank_no IS NOT NULL), r AS (SELECT *, position <= 10 AS i, row_number() OVER (PARTITION BY channel, pub_year, position <= 10 ORDER BY a DESC NULLS LAST, position) AS ra, row_number() OVER (PARTITION BY channel, pub_year, position <= 10 ORDER BY b DESC NULLS LAST, position) AS rb FROM p) SELECT paper_row_id, position, row_number() OVER (PARTITION BY channel, pub_year ORDER BY CASE WHEN i THEN 0 ELSE 1 END, CASE WHEN i THEN CAST(1.0 AS DOUBLE) / (20 + ra) + CAST(1.1 AS DOUBLE) / (20 + rb) END DESC NULLS LAST, position) AS final FROM r",
    "pool_merge": "WITH r AS (SELECT pub_year, source_id, rank_no, CASE WHEN channel = 'pubmed' THEN 0 ELSE 1 END AS l FROM paper_rows WHERE source_id IS NOT NULL AND pub_year IS NOT NULL AND rank_no IS NOT NULL AND channel IS NOT NULL), f AS (SELECT pub_year, source_id, min(rank_no * 10 + l) AS k FROM r GROUP BY 1, 2), s AS (SELECT pub_year, source_id, row_number() OVER (PARTITION BY pub_year ORDER BY k, source_id) AS slot FROM f) SELECT * FROM s WHERE slot <= 20",
    "visible_candidates": "WITH f AS (SELECT *, coalesce(rank_no <= 5, false) AS nw FROM paper_rows WHERE pub_year IS NOT NULL AND channel IS NOT NULL), p AS (SELECT *, row_number() OVER (PARTITION BY pub_year, channel, nw ORDER BY rank_no NULLS FIRST, paper_row_id) AS p FROM f), t AS (SELECT *, CASE WHEN nw AND p <= 4 THEN 0 WHEN NOT nw THEN 1 ELSE 2 END AS t FROM p), s AS (SELECT paper_row_id, row_number() OVER (PARTITION BY pub_year, channel ORDER BY t, CASE WHEN t = 1 THEN -coalesce(length(abstract), 0) ELSE p END, p, paper_row_id) AS slot FROM t) SELECT * FROM s WHERE slot <= 8",
    "citation_support": r"WITH w AS (SELECT paper_row_id, list_distinct(regexp_extract_all(lower(title), '[a-z]{3,}')) AS a, list_distinct(regexp_extract_all(lower(abstract), '[a-z]{3,}')) AS b, regexp_extract_all(title, '[0-9]+(?:\.[0-9]+)?') AS x, regexp_extract_all(abstract, '[0-9]+(?:\.[0-9]+)?') AS y FROM paper_rows WHERE title IS NOT NULL AND abstract IS NOT NULL) SELECT paper_row_id, CASE WHEN len(list_filter(x, lambda n: NOT list_contains(y, n))) > 0 THEN CAST(-1 AS DOUBLE) ELSE round(len(list_intersect(a, b)) / greatest(1, len(a)), 6) END AS fit FROM w",
    "eligible_fusion": "WITH r AS (SELECT paper_row_id, pub_year, channel, pmid IS NOT NULL AS ok, row_number() OVER (PARTITION BY pub_year, channel ORDER BY coalesce(length(abstract), 0) DESC, paper_row_id) AS r1, row_number() OVER (PARTITION BY pub_year, channel ORDER BY coalesce(length(title), 0) DESC, paper_row_id) AS r2 FROM paper_rows WHERE pub_year IS NOT NULL AND channel IS NOT NULL), p AS (SELECT *, least(row_number() OVER (PARTITION BY pub_year, channel ORDER BY r1), row_number() OVER (PARTITION BY pub_year, channel ORDER BY r2)) AS p FROM r WHERE ok), s AS (SELECT *, CAST(1.0 AS DOUBLE) / (60 + r1) + CAST(1.0 AS DOUBLE) / (60 + r2) AS rrf FROM p WHERE p <= 10), k AS (SELECT *, row_number() OVER (PARTITION BY pub_year, channel ORDER BY rrf DESC, paper_row_id) AS rank FROM s) SELECT paper_row_id, r1, r2, round(rrf, 9) AS rrf, rank FROM k WHERE rank <= 16",
}
