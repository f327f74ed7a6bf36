"""Queries of cleaning, classification, curation and integrity, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evifold.functions.text import computed_once
from evifold.operators import curation as U
from evifold.operators import textrules as T
from evifold.operators.traces import normalised
from evifold.plans.checkpoints import cut_lineage
from evifold.sources.tables import spread, table


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def clean_text_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = _docs(spark, d).select("doc_id", "text", T.clean_text(F.col("text")).alias("c"))
    return rows.select("doc_id", F.length("c").cast("bigint").alias("clean_chars"), (F.length("text") - F.length("c")).cast("bigint").alias("dropped"), F.md5("c").alias("digest"))


def script_hint(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", T.script_hint(F.col("text")).alias("script"))


def english_eligible(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", T.english_eligible(F.col("text")).alias("eligible"))


def pii_redact(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("mail "), F.lower(F.translate("c_name", "#", "")), F.lit("@x.example or 555-010-"), F.lpad(F.col("c_nationkey").cast("string"), 4, "0"), F.lit(" with key_abcdef123456")).alias("note"))
    return rows.select("c_custkey", T.redact(F.col("note")).alias("note"))


def table_signature(spark: SparkSession, d: str) -> DataFrame:
    rows = computed_once(spread(_docs(spark, d).select("doc_id", "text")), "low", T.folded(F.col("text")))
    return rows.select("doc_id", *(c.alias(n) for n, c in T.table_signature(F.col("low")).items()))


def source_metadata(spark: SparkSession, d: str) -> DataFrame:
    identity = F.concat_ws(" ", "title", F.array_join(F.coalesce("publication_types", F.array()), " "))
    content = F.concat_ws(" ", identity, F.col("abstract"))
    return table(spark, d, "paper_rows").select("paper_row_id", T.study_design(identity).alias("design"), T.human_evidence(content).alias("human"), T.evidence_types(content).alias("types"))


def url_canonical_host(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "crawl_results").select(T.host(F.col("url")).alias("host"), T.canonical_url(F.col("url")).alias("page"), "success")
    return rows.groupBy("host").agg(F.count(F.lit(1)).alias("fetches"), F.countDistinct("page").alias("pages"), F.count_if(~F.col("success")).alias("failed"))


def web_source_id(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "crawl_results").select("page_id", U.short_id("WEB:", F.col("url")).alias("source_id"))


def failure_taxonomy(spark: SparkSession, d: str) -> DataFrame:
    both = table(spark, d, "crawl_results").select("error").unionAll(_docs(spark, d).select("error"))
    return both.groupBy(T.failure_class(F.col("error")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def heading_outline(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "crawl_results").select("page_id", T.heading_lines(F.col("markdown")).alias("headings"), T.count_of(F.col("markdown"), r"\]\(").cast("bigint").alias("links"))


def exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    return U.exact_groups(_docs(spark, d), "doc_id", U.content_key(F.col("text")))


def hash_ranked_sample(spark: SparkSession, d: str) -> DataFrame:
    return U.hash_sample(_docs(spark, d), "doc_id", "seed-1", 50).select("doc_id", "source")


def stratified_cap(spark: SparkSession, d: str) -> DataFrame:
    return U.stratified_sample(_docs(spark, d), "source", "doc_id", "seed-2", 10).select("doc_id", "source")


def atomic_group_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "case_steps").where("run_id is not null")
    return U.atomic_filter(rows, ["run_id"], F.col("feedback_status").isin("ok", "empty")).select("log_id", "run_id")


def shard_ntile(spark: SparkSession, d: str) -> DataFrame:
    return U.shard_of(_docs(spark, d).select("doc_id"), "doc_id", 7)


def resume_anti_join(spark: SparkSession, d: str) -> DataFrame:
    papers = table(spark, d, "paper_rows").select("paper_row_id", "pmid").where("pmid is not null")
    done = table(spark, d, "paper_rows").where("channel = 'pubmed'").select("pmid")
    return U.missing(papers, done, "pmid").select("paper_row_id", "pmid")


def split_disjointness(spark: SparkSession, d: str) -> DataFrame:
    rows = _docs(spark, d).where("text is not null").select((F.col("doc_id") % 5 == 0).alias("held"), U.content_key(F.col("text")).alias("k"))
    return U.disjoint(rows.where("held"), rows.where("not held"), "k")


def conflict_detect(spark: SparkSession, d: str) -> DataFrame:
    return U.conflicts(table(spark, d, "eval_cells"), ["round_no", "question_id", "arm"], F.concat_ws("/", "status", F.col("benchmark_score").isNull().cast("string")))


def manifest_diff(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "crawl_results").select("page_id", T.canonical_url(F.col("url")).alias("page"), F.sha2(F.coalesce("markdown", F.lit("")), 256).alias("digest"), "fetched_at")
    w = Window.partitionBy("page").orderBy("fetched_at", "page_id")
    first = pages.withColumn("r", F.row_number().over(w)).where("r = 1")
    last = pages.withColumn("r", F.row_number().over(Window.partitionBy("page").orderBy(F.desc("fetched_at"), F.desc("page_id")))).where("r = 1 and page_id % 7 != 0")
    return U.manifest_diff(first, last, "page", "digest")


def _titles(spark: SparkSession, d: str) -> DataFrame:
    """(title, id, asked): the smallest row of each title, and whether any of its rows is a query."""
    rows = table(spark, d, "paper_rows").where("title is not null")
    return rows.groupBy("title").agg(F.min("paper_row_id").alias("id"), F.bool_or(F.col("paper_row_id") % 20 == 0).alias("asked"))


def jaccard_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Near titles of each title that any row with an id divisible by 20 has, by the smallest row of each; ``jaccard_members`` has the other rows."""
    docs = _titles(spark, d)
    asked = docs.where("asked").select(F.col("id").alias("query_id"), "title")
    return U.near_pairs(asked, docs, "query_id", "id", "title", 0.8).select("query_id", "id", F.round("jaccard", 6).alias("jaccard"))


def jaccard_members(spark: SparkSession, d: str) -> DataFrame:
    """The row by which ``jaccard_pairs`` names the title of each row."""
    return table(spark, d, "paper_rows").select("paper_row_id", "title").join(_titles(spark, d), "title").select("paper_row_id", "id")


def decontaminate(spark: SparkSession, d: str) -> DataFrame:
    """All rows of eval_outputs with a held-out question: (output_id, question_id, kind, jaccard, share), each pair once.

    ``kind`` is the first that holds: 'id', 'normalised_exact', 'near_duplicate' (from 80 characters on, by lengths,
    words and longest matching blocks) or 'contained' (at least 13 words of the held-out problem in a row). ``jaccard`` is
    that of the words, ``share`` the share of the held-out problem's runs of 13 words. Texts are compared normalised.
    """
    # a text of the pool that is missing may still stand there in its normalised form
    pool = cut_lineage(table(spark, d, "exclusion_pool").where("question_id is not null").select("question_id", F.coalesce(F.nullif(normalised("problem"), F.lit("")), F.nullif(normalised("normalized_text"), F.lit(""))).alias("q")).distinct())
    outputs = cut_lineage(table(spark, d, "eval_outputs").select("output_id", "example_id", normalised("problem").alias("p")))
    left = outputs.where("p != ''").select(F.col("p").alias("text")).distinct().withColumn("l", F.md5("text"))
    right = pool.where("q is not null").select(F.col("q").alias("text")).distinct().withColumn("r", F.md5("text"))

    near = U.near_pairs(left.where(F.length("text") >= 80), right, "l", "r", "text", 0.65, U.blank_sets)
    texts = near.join(left.select("l", F.col("text").alias("p")), "l").join(right.select("r", F.col("text").alias("q")), "r")
    alike = texts.where(F.least(F.length("p"), F.length("q")) >= 0.8 * F.greatest(F.length("p"), F.length("q"))).where(U.sequence_ratio("p", "q") >= 0.85).select("p", "q", F.lit(2).alias("k"))
    runs = U.contained(left, right, "l", "r", "text", 13)
    held = runs.join(left.select("l", F.col("text").alias("p")), "l").join(right.select("r", F.col("text").alias("q")), "r").select("p", "q", F.lit(3).alias("k"))
    equal = left.join(right, "text").select(F.col("text").alias("p"), F.col("text").alias("q"), F.lit(1).alias("k"))
    by_text = outputs.join(equal.unionByName(alike).unionByName(held), "p").join(pool, "q").select("output_id", "question_id", "k", "p", "q")
    by_id = outputs.join(pool, F.col("example_id") == F.col("question_id")).select("output_id", "question_id", F.lit(0).alias("k"), "p", "q")

    pairs = by_id.unionByName(by_text).groupBy("output_id", "question_id").agg(F.min_by(F.struct("p", "q"), F.struct("k", "q")).alias("t"), F.min("k").alias("k"))
    a, b = U.blank_sets(F.col("t.p")), U.blank_sets(F.col("t.q"))
    x, y = U.shingles(F.coalesce("t.p", F.lit("")), 13), U.shingles(F.coalesce("t.q", F.lit("")), 13)
    kind = F.element_at(F.array(*map(F.lit, ("id", "normalised_exact", "near_duplicate", "contained"))), F.col("k") + 1)
    jaccard = F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0))
    share = F.size(F.array_intersect(x, y)) / F.nullif(F.size(y), F.lit(0))
    return pairs.select("output_id", "question_id", kind.alias("kind"), F.round(jaccard, 6).alias("jaccard"), F.round(share, 6).alias("share"))


def canonical_digest(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "case_steps").select("log_id", U.canonical_digest(run=F.col("run_id"), turn=F.col("turn"), status=F.col("feedback_status"), error=F.col("error_code")).alias("digest"))
    return rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("log_id").alias("first"))


def benchmark_examples(spark: SparkSession, d: str) -> DataFrame:
    """The pool as benchmark examples: md5 id, trimmed problem, answers split into sentences."""
    pool = table(spark, d, "exclusion_pool").where("problem is not null")
    answers = F.filter(F.transform(F.split(F.coalesce("accepted_answer", F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")
    return pool.select(F.md5("problem").alias("id"), F.trim("problem").alias("problem"), "bench", F.size(answers).cast("bigint").alias("n_answers"), F.array_join(answers, " || ").alias("answers"))


QUERIES = {f.__name__: f for f in (clean_text_stats, script_hint, english_eligible, pii_redact, table_signature, source_metadata, url_canonical_host, web_source_id, failure_taxonomy, heading_outline, exact_dedup, hash_ranked_sample, stratified_cap, atomic_group_filter, shard_ntile, resume_anti_join, split_disjointness, conflict_detect, manifest_diff, jaccard_pairs, jaccard_members, decontaminate, canonical_digest, benchmark_examples)}


def _count(pattern: str, text: str = "text") -> str:
    return f"len(regexp_extract_all(coalesce({text}, ''), '{pattern}'))"


def _phrase(text: str, phrases: list[str]) -> str:
    listed = "|".join(p.replace("-", r"\-") for p in phrases)
    return f"regexp_matches(' ' || {text} || ' ', '[^a-z0-9]({listed})[^a-z0-9]')"


def _cues() -> list[str]:
    return [f"CAST(regexp_matches(low, '{p.replace(chr(39), chr(39) * 2)}') AS INT)" for p in T.TABLE_CUES]


_KEY = r"md5(trim(regexp_replace(lower(text), '\s+', ' ', 'g')))"
_HOST = r"nullif(regexp_replace(regexp_replace(regexp_extract(lower(url), '^https?://([^/?#@]*@)?([^/?#:]+)', 2), '^www\.', ''), '\.$', ''), '')"
_PAGE = _HOST + r" || regexp_replace(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '(/amp)?/*$', '')"
_DESIGN = "CASE " + " ".join(f"WHEN {_phrase('identity', cues)} THEN '{name}'" for name, cues in T.DESIGNS) + " ELSE 'unknown' END"
_TYPES = "concat_ws(',', " + ", ".join(f"CASE WHEN {_phrase('content', cues)} THEN '{name}' END" for name, cues in sorted(T.EVIDENCE_TYPES)) + ")"
_REDACTED = "note"
for _p, _r in T.SECRETS:
    _REDACTED = f"regexp_replace({_REDACTED}, '{_p}', '{_r.replace('$1', chr(92) + '1')}', 'g')"
SQL = {
    "clean_text_stats": r"WITH c AS (SELECT doc_id, text, trim(regexp_replace(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g'), '\s+', ' ', 'g')) AS c FROM documents) SELECT doc_id, length(c) AS clean_chars, length(text) - length(c) AS dropped, md5(c) AS digest FROM c",
    "script_hint": f"WITH c AS (SELECT doc_id, {_count('[A-Za-z]')} AS l, {_count('[㐀-鿿]')} AS h FROM documents) SELECT doc_id, CASE WHEN l + h < 80 THEN 'unknown' WHEN l >= 0.9 * (l + h) THEN 'latin' WHEN h >= 0.7 * (l + h) THEN 'cjk' ELSE 'mixed' END AS script FROM c",
    "english_eligible": "WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(lower(coalesce(text, '')), '[a-z]+') AS w FROM documents) SELECT doc_id, len(w) >= 12 AND len(regexp_extract_all(t, '[\\x00-\\x7F]')) / greatest(1, length(t)) >= 0.97 AND len(list_filter(w, lambda x: x IN (" + ", ".join(f"'{w}'" for w in T.COMMON_ENGLISH) + "))) >= 0.12 * len(w) AS eligible FROM w",
    "pii_redact": f"WITH n AS (SELECT c_custkey, 'mail ' || lower(replace(c_name, '#', '')) || '@x.example or 555-010-' || lpad(CAST(c_nationkey AS VARCHAR), 4, '0') || ' with key_abcdef123456' AS note FROM customer) SELECT c_custkey, {_REDACTED} AS note FROM n",
    "table_signature": f"""WITH l AS (SELECT doc_id, lower(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))) AS low FROM documents),
s AS (SELECT doc_id, length(low) AS n, {' + '.join(_cues())} AS header, {_cues()[1]} + {_cues()[2]} AS weak, {_count('[0-9]+([.][0-9]+)?%?', 'low')} AS cells, {_count('[|]', 'low')} AS pipes, {_count('[.!?]( |$)|[。！？]', 'low')} AS ends FROM l)
SELECT doc_id, CAST(header AS BIGINT) AS header_cues, cells, pipes, ends AS sentence_ends, CASE WHEN pipes >= 2 OR (header - weak >= 2 AND header >= 3 AND cells >= 3 AND n <= 1600 AND ends < 1) THEN 'table_like' ELSE 'prose' END AS structure FROM s""",
    "source_metadata": f"WITH i AS (SELECT paper_row_id, lower(concat_ws(' ', title, array_to_string(coalesce(publication_types, []), ' '))) AS identity, lower(concat_ws(' ', title, array_to_string(coalesce(publication_types, []), ' '), abstract)) AS content FROM paper_rows) SELECT paper_row_id, {_DESIGN} AS design, {_phrase('content', T.HUMAN)} AND NOT {_phrase('content', T.ANIMAL)} AS human, {_TYPES} AS types FROM i",
    "url_canonical_host": f"WITH p AS (SELECT {_HOST} AS host, {_PAGE} AS page, success FROM crawl_results) SELECT host, count(*) AS fetches, count(DISTINCT page) AS pages, count(*) FILTER (NOT success) AS failed FROM p GROUP BY host",
    "web_source_id": "SELECT page_id, 'WEB:' || substr(sha256(url), 1, 16) AS source_id FROM crawl_results",
    "failure_taxonomy": "WITH e AS (SELECT error FROM crawl_results UNION ALL SELECT error FROM documents), k AS (SELECT CASE WHEN error IS NULL OR trim(error) = '' THEN NULL WHEN regexp_matches(lower(error), 'timeout|timed out') THEN 'timeout' WHEN regexp_matches(lower(error), '403|401|forbidden|captcha') THEN 'blocked' WHEN regexp_matches(lower(error), '404|410|not found') THEN 'missing' WHEN regexp_matches(lower(error), 'robots') THEN 'robots' WHEN regexp_matches(lower(error), 'navigation|connection|dns|reset') THEN 'network' ELSE 'other' END AS kind FROM e) SELECT kind, count(*) AS n FROM k GROUP BY kind",
    "heading_outline": "SELECT page_id, " + _count(r"(^|\n)#{1,6} ", "markdown") + " AS headings, " + _count(r"\]\(", "markdown") + " AS links FROM crawl_results",
    "exact_dedup": f"SELECT min(doc_id) AS keep_id, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY {_KEY}",
    "hash_ranked_sample": "SELECT doc_id, source FROM documents ORDER BY sha256('seed-1' || chr(31) || doc_id), doc_id LIMIT 50",
    "stratified_cap": "SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY sha256('seed-2' || chr(31) || doc_id), doc_id) AS r FROM documents) WHERE r <= 10",
    "atomic_group_filter": "SELECT log_id, run_id FROM case_steps WHERE run_id IS NOT NULL AND run_id NOT IN (SELECT run_id FROM case_steps WHERE run_id IS NOT NULL AND NOT coalesce(feedback_status IN ('ok', 'empty'), false))",
    "shard_ntile": "SELECT doc_id, ntile(7) OVER (ORDER BY doc_id) - 1 AS shard FROM documents",
    "resume_anti_join": "SELECT paper_row_id, pmid FROM paper_rows WHERE pmid IS NOT NULL AND pmid NOT IN (SELECT pmid FROM paper_rows WHERE channel = 'pubmed' AND pmid IS NOT NULL)",
    "split_disjointness": f"SELECT DISTINCT {_KEY} AS k FROM documents WHERE text IS NOT NULL AND doc_id % 5 = 0 INTERSECT SELECT {_KEY} FROM documents WHERE text IS NOT NULL AND doc_id % 5 <> 0",
    "conflict_detect": "SELECT round_no, question_id, arm, count(DISTINCT concat_ws('/', status, CAST(benchmark_score IS NULL AS VARCHAR))) AS versions, count(*) AS n FROM eval_cells GROUP BY ALL HAVING count(DISTINCT concat_ws('/', status, CAST(benchmark_score IS NULL AS VARCHAR))) > 1",
    "manifest_diff": f"WITH p AS (SELECT page_id, {_PAGE} AS page, sha256(coalesce(markdown, '')) AS digest, fetched_at FROM crawl_results), f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY fetched_at NULLS FIRST, page_id) AS r FROM p) WHERE r = 1), l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY fetched_at DESC NULLS LAST, page_id DESC) AS r FROM p) WHERE r = 1 AND page_id % 7 <> 0) SELECT coalesce(f.page, l.page) AS page, CASE WHEN f.page IS NULL THEN 'added' WHEN l.page IS NULL THEN 'removed' ELSE 'changed' END AS change FROM f FULL JOIN l ON f.page = l.page WHERE f.digest IS DISTINCT FROM l.digest",
    "jaccard_members": "SELECT paper_row_id, min(paper_row_id) OVER (PARTITION BY title) AS id FROM paper_rows WHERE title IS NOT NULL",
    "jaccard_pairs": "WITH t AS (SELECT title, min(paper_row_id) AS id, bool_or(paper_row_id % 20 = 0) AS asked FROM paper_rows WHERE title IS NOT NULL GROUP BY title), w AS (SELECT id, asked, list_distinct(regexp_extract_all(lower(title), '[a-z0-9]+')) AS w FROM t), j AS (SELECT a.id AS query_id, b.id, len(list_intersect(a.w, b.w)) AS i, len(a.w) + len(b.w) AS n FROM w a JOIN w b ON len(a.w) > 0 AND len(b.w) >= 0.8 * len(a.w) AND len(a.w) >= 0.8 * len(b.w) WHERE a.asked) SELECT query_id, id, round(i / (n - i), 6) AS jaccard FROM j WHERE i / (n - i) >= 0.8",
    "canonical_digest": r"WITH d AS (SELECT log_id, sha256('error' || chr(30) || coalesce('=' || error_code, '~') || chr(30) || 'run' || chr(30) || coalesce('=' || run_id, '~') || chr(30) || 'status' || chr(30) || coalesce('=' || feedback_status, '~') || chr(30) || 'turn' || chr(30) || coalesce('=' || turn, '~')) AS digest FROM case_steps) SELECT digest, count(*) AS n, min(log_id) AS first FROM d GROUP BY digest",
    "benchmark_examples": "WITH a AS (SELECT md5(problem) AS id, trim(problem) AS problem, bench, list_filter(list_transform(string_split(coalesce(accepted_answer, ''), ';'), lambda x: trim(x)), lambda x: x <> '') AS l FROM exclusion_pool WHERE problem IS NOT NULL) SELECT id, problem, bench, len(l) AS n_answers, coalesce(array_to_string(l, ' || '), '') AS answers FROM a",
}
