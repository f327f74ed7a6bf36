"""Queries over traces, chunks and evidence windows, with their SQL."""

from __future__ import annotations

import base64
import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evifold.operators import passages as P
from evifold.operators import ranking as R
from evifold.operators import traces as X
from evifold.operators import windows as V
from evifold.operators.textrules import citations
from evifold.plans.event_queries import _STEPS, steps
from evifold.sources import readers as S
from evifold.sources.tables import table


def query_rewrites(spark: SparkSession, d: str) -> DataFrame:
    s = steps(spark, d).where("a.query is not null").select(F.col("a.query").alias("query")).distinct()
    return s.select("query", F.posexplode(X.query_rewrites(F.col("query"))).alias("pos", "form"))


def repeated_query_words(spark: SparkSession, d: str) -> DataFrame:
    s = steps(spark, d).where("a.action = 'search' and run_id is not null and a.query is not null").select("log_id", "run_id", F.struct("turn", "log_id").alias("o"), F.col("a.query").alias("query"))
    return X.repeated_queries(s, "run_id", "o", F.col("query")).select("log_id", F.round("best", 6).alias("best"))


def similar_query_advisory(spark: SparkSession, d: str) -> DataFrame:
    s = steps(spark, d).where("a.action = 'search' and run_id is not null and a.query is not null").select("log_id", "run_id", F.lower("a.channel").alias("channel"), F.struct("turn", "log_id").alias("o"), F.col("a.query").alias("query"))
    return X.similar_queries(s, ["run_id", "channel"], "o", F.col("query")).select("log_id", "similarity")


def evidence_transitions(spark: SparkSession, d: str) -> DataFrame:
    """Growth of the set of evidence of each run, step by step."""
    rows = table(spark, d, "case_steps").where("run_id is not null and turn is not null")
    return X.evidence_growth(rows, ["run_id"], ["turn", "log_id"], "new_evidence_ids").select("log_id", "added", "change")


def coverage_merge(spark: SparkSession, d: str) -> DataFrame:
    s = steps(spark, d).where("question_id is not null").select("question_id", "turn", "feedback_status", "new_evidence_ids", F.explode("a.requirement_ids").alias("requirement"))
    ids = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("new_evidence_ids", F.array().cast("array<string>"))))))
    level = F.when(F.bool_or(F.col("feedback_status") == "ok"), "partial").otherwise("missing")
    old = s.where("turn <= 3").groupBy("question_id", "requirement").agg(level.alias("status"), ids.alias("evidence_ids"))
    delta = s.where("turn > 3").groupBy("question_id", "requirement").agg(F.coalesce(F.bool_or(F.col("feedback_status") == "ok"), F.lit(False)).alias("support"), (F.count_if(F.col("feedback_status") == "ok") >= 3).alias("complete"), ids.alias("new_evidence_ids"))
    merged = X.merge_coverage(old, delta, ["question_id", "requirement"])
    return merged.select("question_id", "requirement", "status", F.array_join("evidence_ids", ",").alias("evidence"))


def answer_validation(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "eval_outputs").where("final_response is not null")
    held = rows.withColumn("cited", citations(F.col("final_response"))).withColumn("opened", F.array(F.lit("E1"), F.lit("E2")))
    return X.answer_issues(held, "cited", "opened", F.col("final_response"), F.col("problem")).select("output_id", F.array_join("issues", ",").alias("issues"))


def prefix_chain_merge(spark: SparkSession, d: str) -> DataFrame:
    rows = steps(spark, d).where("run_id is not null and a.query is not null").withColumn("q", F.lower("a.query"))
    chained = X.prefix_chains(rows, ["run_id"], ["turn", "log_id"], "q")
    return chained.groupBy("run_id").agg(F.max("chain").alias("chains"), F.count(F.lit(1)).alias("n"))


def normalised_problems(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "exclusion_pool").select("question_id", X.normalised("problem").alias("text")).groupBy("text").agg(F.count(F.lit(1)).alias("n"))


def greedy_selection(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "exclusion_pool").select("question_id", "bench", F.md5("accepted_answer").alias("cluster"), F.sha2(F.concat_ws("/", "question_id", "problem"), 256).alias("h"))
    return X.greedy_two_way(rows, "bench", "cluster", "h", 10).select("question_id", "bench")


def hash_batches(spark: SparkSession, d: str) -> DataFrame:
    return X.batches(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", "batch-1", 4)


def rate_schedule(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 1000).alias("step"))
    return rows.select("o_orderkey", F.round(X.cosine_rate(F.col("step"), 100, 1000, 0.01), 9).alias("rate"))


def section_chunks(spark: SparkSession, d: str) -> DataFrame:
    parsed = P.parse_sections(table(spark, d, "crawl_results"), "page_id", "markdown")
    return V.chunk_sections(parsed).select(F.col("item_id").alias("page_id"), "chunk_id", "start_char", "end_char", "text_sha256")


def hybrid_passages(spark: SparkSession, d: str) -> DataFrame:
    """Pages cut to chunks, ranked per page for its first heading by words and by overlap, fused, packed under both budgets."""
    parsed = P.parse_sections(table(spark, d, "crawl_results"), "page_id", "markdown").where("title != ''")
    chunks = V.chunk_sections(parsed, with_title=True)
    asked = F.array_distinct(R.tokens(F.col("title")))
    body = R.tokens(F.concat_ws(" ", "heading", "text"))
    scored = chunks.withColumn("lexical", F.size(F.filter(body, lambda t: F.array_contains(asked, t)))).withColumn("overlap", R.overlap_share(asked, F.array_distinct(body)))
    by = lambda c: Window.partitionBy("item_id").orderBy(F.desc(c), "section_index", "chunk_index")
    pools = scored.withColumn("r1", F.row_number().over(by("lexical"))).withColumn("r2", F.row_number().over(by("overlap"))).where("least(r1, r2) <= 8")
    fused = pools.withColumn("rrf", R.reciprocal_rank("r1", "r2")).withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("rrf"), "section_index", "chunk_index")))
    packed = V.pack_ranked(fused.select("item_id", "rank", "text", (F.regexp_count("text", F.lit(r"\|")) >= 2).alias("is_table")), "item_id")
    return packed.select(F.col("item_id").alias("page_id"), "rank", F.length("kept").alias("n_chars"))


def source_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Body of each paper: its longest abstract of the paper channel, else of any channel, else its title."""
    rows = table(spark, d, "paper_rows").where("source_id is not null")
    longest = lambda c: F.max_by(c, F.struct(F.length(c), F.col(c)))
    base = rows.select("source_id").distinct()
    first = rows.where("channel = 'pubmed' and abstract is not null").groupBy("source_id").agg(longest("abstract").alias("body"))
    second = rows.where("abstract is not null").groupBy("source_id").agg(longest("abstract").alias("body"))
    third = rows.where("title is not null").groupBy("source_id").agg(longest("title").alias("body"))
    found = S.cascade(base, "source_id", ("pubmed", first), ("any", second), ("title", third))
    return found.select("source_id", "route", F.md5("body").alias("body"))


def receipt_replay(spark: SparkSession, d: str) -> DataFrame:
    rows = steps(spark, d).where("a.query is not null")
    receipts = rows.groupBy(F.sha2("a.query", 256).alias("digest")).agg(F.min("feedback_status").alias("response")).where("response is not null")
    frozen = receipts.withColumn("response_digest", F.sha2(F.when(F.col("response") == "empty", F.lit("torn")).otherwise(F.col("response")), 256))
    found = S.replay(rows.select("log_id", F.col("a.query").alias("request")), frozen)
    return found.select("log_id", "verdict", "response")


def cached_results(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "crawl_results").where("fetched_at is not null")
    cache = pages.where("success").select(F.col("url").alias("key"), F.md5(F.coalesce("markdown", F.lit(""))).alias("value"), (F.col("fetched_at") + F.expr("interval 10 days")).alias("expires_at"), "page_id")
    now = pages.agg(F.max("fetched_at").alias("now"))
    live = cache.crossJoin(F.broadcast(now)).where("expires_at > now").groupBy("key").agg(F.max_by("value", F.struct("expires_at", "page_id")).alias("value"))
    return pages.select(F.col("url").alias("key")).distinct().join(live, "key", "left")


def deciphered_pool(spark: SparkSession, d: str) -> DataFrame:
    """The pool's problems after a round through the enciphered form of benchmark files."""

    @F.pandas_udf("string")
    def encipher(text, password):
        out = []
        for t, p in zip(text, password):
            raw = t.encode()
            key = hashlib.sha256(p.encode()).digest()
            out.append(base64.b64encode(bytes(b ^ key[i % 32] for i, b in enumerate(raw))).decode())
        return type(text)(out)

    rows = table(spark, d, "exclusion_pool").where("problem is not null and question_id is not null")
    secret = rows.select("question_id", encipher("problem", "question_id").alias("c"))
    return secret.select("question_id", S.decipher("c", "question_id").alias("problem"))


QUERIES = {f.__name__: f for f in (query_rewrites, repeated_query_words, similar_query_advisory, evidence_transitions, coverage_merge, answer_validation, prefix_chain_merge, normalised_problems, greedy_selection, hash_batches, rate_schedule, section_chunks, hybrid_passages, source_cascade, receipt_replay, cached_results, deciphered_pool)}

_TOK = r"regexp_extract_all(lower(coalesce({}, '')), '[a-z0-9]+|[\x{{4e00}}-\x{{9fff}}]')"
_NUM = r"regexp_extract_all(coalesce({}, ''), '[0-9]+(?:\.[0-9]+)?')"
_IDS = "array_to_string(list_sort(list_distinct(flatten(list(coalesce(new_evidence_ids, []))))), ',')"
SQL = {
    "normalised_problems": r"SELECT array_to_string(regexp_extract_all(lower(problem), '[\p{L}\p{N}_]+'), ' ') AS text, count(*) AS n FROM exclusion_pool GROUP BY 1",
    "greedy_selection": """WITH RECURSIVE c AS (SELECT question_id, bench, md5(accepted_answer) AS cl, row_number() OVER (ORDER BY sha256(concat_ws('/', question_id, problem)), md5(accepted_answer), bench) AS i FROM exclusion_pool),
g AS (SELECT 0 AS i, CAST([] AS VARCHAR[]) AS strata, CAST([] AS VARCHAR[]) AS clusters, false AS ok, CAST(NULL AS VARCHAR) AS question_id, CAST(NULL AS VARCHAR) AS bench
  UNION ALL SELECT c.i, CASE WHEN t.ok THEN list_append(strata, coalesce(c.bench, '')) ELSE strata END, CASE WHEN t.ok THEN list_append(clusters, coalesce(c.cl, '')) ELSE clusters END, t.ok, c.question_id, c.bench
  FROM g JOIN c ON c.i = g.i + 1, LATERAL (SELECT NOT list_contains(clusters, coalesce(c.cl, '')) AND len(list_filter(strata, lambda x: x = coalesce(c.bench, ''))) < 10 AS ok) t)
SELECT question_id, bench FROM g WHERE ok""",
    "repeated_query_words": f"WITH {_STEPS}, q AS (SELECT log_id, run_id, row_number() OVER (PARTITION BY run_id ORDER BY turn, log_id) AS o, list_distinct({_TOK.format('query')}) AS w FROM s WHERE action = 'search' AND run_id IS NOT NULL AND query IS NOT NULL), j AS (SELECT a.log_id, CASE WHEN len(a.w) + len(b.w) = 0 THEN 1.0 ELSE len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) END AS j FROM q a JOIN q b ON a.run_id = b.run_id AND b.o < a.o) SELECT log_id, round(max(j), 6) AS best FROM j GROUP BY log_id HAVING max(j) >= 0.85",
    "evidence_transitions": "WITH e AS (SELECT run_id, turn, log_id, coalesce(new_evidence_ids, []) AS l FROM case_steps WHERE run_id IS NOT NULL AND turn IS NOT NULL), c AS (SELECT run_id, turn, log_id, list_distinct(flatten(list(l) OVER (PARTITION BY run_id ORDER BY turn, log_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))) AS ids FROM e), p AS (SELECT *, len(ids) - coalesce(lag(len(ids)) OVER w, 0) AS added, lag(len(ids)) OVER w IS NULL AS f FROM c WINDOW w AS (PARTITION BY run_id ORDER BY turn, log_id)) SELECT log_id, added, CASE WHEN f THEN 'first' WHEN added > 0 THEN 'append' ELSE 'no_change' END AS change FROM p",
    "coverage_merge": f"WITH {_STEPS}, r AS (SELECT question_id, turn, feedback_status, new_evidence_ids, unnest(CAST(j->'requirement_ids' AS VARCHAR[])) AS requirement FROM s WHERE question_id IS NOT NULL) SELECT question_id, requirement, CASE WHEN count(*) FILTER (turn > 3 AND feedback_status = 'ok') >= 3 THEN 'direct' WHEN count(*) FILTER (turn <= 3 AND feedback_status = 'ok') > 0 OR count(*) FILTER (turn > 3 AND feedback_status = 'ok') > 0 THEN 'partial' ELSE 'missing' END AS status, coalesce({_IDS}, '') AS evidence FROM r WHERE turn IS NOT NULL GROUP BY 1, 2",
    "answer_validation": f"WITH c AS (SELECT output_id, final_response AS f, problem AS p, list_filter(flatten(list_transform(regexp_extract_all(final_response, '<cite id=\"([^\"<>]+)\">', 1), lambda g: list_transform(string_split(g, ','), lambda x: trim(x)))), lambda x: x <> '') AS cited FROM eval_outputs WHERE final_response IS NOT NULL) SELECT output_id, concat_ws(',', CASE WHEN len(list_filter(cited, lambda x: x NOT IN ('E1', 'E2'))) > 0 THEN 'unknown_citation' END, CASE WHEN len(cited) = 0 THEN 'no_citation' END, CASE WHEN len(list_filter({_NUM.format('f')}, lambda x: NOT list_contains({_NUM.format('p')}, x))) > 0 THEN 'unsupported_number' END, CASE WHEN len(list_intersect({_TOK.format('f')}, {_TOK.format('p')})) = 0 THEN 'no_shared_term' END) AS issues FROM c",
    "prefix_chain_merge": f"WITH {_STEPS}, q AS (SELECT run_id, turn, log_id, lower(query) AS q FROM s WHERE run_id IS NOT NULL AND query IS NOT NULL), b AS (SELECT *, CASE WHEN starts_with(q, lag(q) OVER (PARTITION BY run_id ORDER BY turn, log_id)) THEN 0 ELSE 1 END AS b FROM q) SELECT run_id, CAST(sum(b) AS BIGINT) AS chains, count(*) AS n FROM b GROUP BY run_id",
    "hash_batches": "SELECT o_orderkey, (row_number() OVER (ORDER BY sha256('batch-1' || chr(31) || o_orderkey), o_orderkey) - 1) // 4 AS batch FROM orders",
    "rate_schedule": "WITH s AS (SELECT o_orderkey, o_orderkey % 1000 AS s FROM orders) SELECT o_orderkey, round(CASE WHEN s < 100 THEN 0.01 * s / 100 ELSE 0.01 * 0.5 * (1 + cos(pi() * least(1.0, (s - 100) / 900))) END, 9) AS rate FROM s",
    "source_cascade": "WITH r AS (SELECT * FROM paper_rows WHERE source_id IS NOT NULL), l AS (SELECT source_id, max({'n': length(abstract), 'x': abstract}) FILTER (channel = 'pubmed' AND abstract IS NOT NULL) AS a, max({'n': length(abstract), 'x': abstract}) FILTER (abstract IS NOT NULL) AS b, max({'n': length(title), 'x': title}) FILTER (title IS NOT NULL) AS c FROM r GROUP BY source_id) SELECT source_id, CASE WHEN trim(a.x) <> '' THEN 'pubmed' WHEN trim(b.x) <> '' THEN 'any' WHEN trim(c.x) <> '' THEN 'title' END AS route, md5(coalesce(nullif(trim(a.x), ''), nullif(trim(b.x), ''), nullif(trim(c.x), ''))) AS body FROM l",
    "receipt_replay": f"WITH {_STEPS}, r AS (SELECT query AS request, min(feedback_status) AS response FROM s WHERE query IS NOT NULL GROUP BY query HAVING min(feedback_status) IS NOT NULL) SELECT log_id, CASE WHEN response IS NULL THEN 'missing' WHEN response = 'empty' THEN 'corrupt' ELSE 'ok' END AS verdict, CASE WHEN response <> 'empty' THEN response END AS response FROM s LEFT JOIN r ON s.query = r.request WHERE query IS NOT NULL",
    "cached_results": "WITH p AS (SELECT * FROM crawl_results WHERE fetched_at IS NOT NULL), c AS (SELECT url AS key, md5(coalesce(markdown, '')) AS value, fetched_at + INTERVAL 10 DAY AS e, page_id FROM p WHERE success), l AS (SELECT key, arg_max(value, {'e': e, 'p': page_id}) AS value FROM c WHERE e > (SELECT max(fetched_at) FROM p) GROUP BY key) SELECT DISTINCT p.url AS key, l.value FROM p LEFT JOIN l ON l.key = p.url",
    "deciphered_pool": "SELECT question_id, problem FROM exclusion_pool WHERE problem IS NOT NULL AND question_id IS NOT NULL",
}
