"""Queries that prepare records for training, evaluation and search, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evifold.operators import evaluation as V
from evifold.operators import preparation as P
from evifold.operators import ranking as R
from evifold.operators import traces as X
from evifold.plans.evaluation_queries import _CELLS, cells
from evifold.sources.tables import table


def token_budget(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "eval_outputs")
    p, c = F.ceil(F.octet_length("problem") / 3.15).cast("int"), F.ceil(F.octet_length("final_response") / 3.15).cast("int")
    return rows.select("output_id", P.within_budget(p, c, 400, 250).alias("fits"), F.aggregate(P.label_mask(F.coalesce(p, F.lit(0)), F.coalesce(c, F.lit(0))), F.lit(0), lambda s, x: s + x).cast("bigint").alias("targets"))


def training_samples(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "case_steps")
    out = P.training_samples(rows, F.col("feedback_status") == "ok", F.col("arm"), ["sft", "raw"], F.col("error_code") == "E_DUP", ["run_id", "executed_action"], ["turn", "log_id"])
    return out.select("log_id")


def finalised_batches(spark: SparkSession, d: str) -> DataFrame:
    rows = cells(spark, d)
    decisions = rows.where("benchmark_score is not null").withColumn("ok", F.col("benchmark_score") > 0)
    return P.finalised(rows.where("process_score is not null"), decisions, ["round_no", "question_id", "arm"], "ok")


def complete_merge(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "eval_outputs").select("output_id", "example_id", F.pmod("output_id", F.lit(4)).alias("worker"))
    return P.complete_merge(rows, "worker", 4, ["example_id", "output_id"]).select("output_id", "worker")


def visibility_faults(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "case_steps").where("run_id is not null and turn is not null")
    runs = rows.groupBy("run_id").agg(F.array_distinct(F.flatten(F.collect_list(F.coalesce("new_evidence_ids", F.array().cast("array<string>"))))).alias("opened"))
    out = P.visibility_faults(rows.join(runs, "run_id"), F.lit("E1"), F.col("new_evidence_ids"), F.array(F.lit("E1"), F.lit("E2"), F.lit("E9")), F.col("opened"))
    return out.select("log_id", "target_visible", F.array_join(F.array_sort("unopened"), ",").alias("unopened"))


def candidate_extraction(spark: SparkSession, d: str) -> DataFrame:
    papers = table(spark, d, "paper_rows").where("channel is not null")
    out = P.candidates(papers, ["channel", "pub_year"], F.lower("doi"), ["rank_no", "paper_row_id"], 8, {"title": 20})
    return out.select("paper_row_id", "title", "position")


def public_projection(spark: SparkSession, d: str) -> DataFrame:
    papers = table(spark, d, "paper_rows")
    return papers.select("paper_row_id", P.first_filled(F.col("source_id"), F.col("doi"), F.col("paper_id"), default="none").alias("id"), P.first_filled(F.col("abstract"), F.col("title")).alias("preview"))


def question_registry(spark: SparkSession, d: str) -> DataFrame:
    return P.registered_values(table(spark, d, "eval_outputs"), "output_id", "original_data", ["id", "arm"])


def length_adjusted(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "eval_outputs").withColumn("s", F.length("problem") / 100.0)
    return rows.select("output_id", F.round(V.length_adjusted(F.col("s"), F.length("final_response"), 0.0147, 2_000), 6).alias("adjusted"))


def fully_covered(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(V.fully_covered(F.pmod("l_partkey", F.lit(3))).alias("complete"))


def grade_parsing(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "eval_outputs")
    raw = F.concat(F.when(F.col("output_id") % 2 == 0, "```json\n").otherwise(""), F.lit('{"criteria_met": '), F.when(F.col("output_id") % 3 == 0, "true").when(F.col("output_id") % 3 == 1, "false").otherwise("maybe"), F.lit(', "explanation": "x"}'), F.when(F.col("output_id") % 2 == 0, "\n```").otherwise(""))
    return rows.select("output_id", V.graded(raw).alias("met"))


def recomputed_figures(spark: SparkSession, d: str) -> DataFrame:
    rows = cells(spark, d)
    stated = rows.groupBy("arm").agg(F.round(F.avg("benchmark_score"), 3).alias("score"), F.count("process_score").cast("double").alias("n"))
    computed = rows.groupBy("arm").agg(F.avg("benchmark_score").alias("score"), F.count("process_score").cast("double").alias("n"))
    return V.recomputed(stated, computed, ["arm"], ["score", "n"]).select("arm", "metric", F.round("stated", 6).alias("stated"), F.round("computed", 6).alias("computed"))


def process_scores(spark: SparkSession, d: str) -> DataFrame:
    return cells(spark, d).groupBy("arm").agg(F.round(F.avg(V.retained_process(F.col("status"), F.col("process_score"))), 6).alias("mean"), F.count(V.retained_process(F.col("status"), F.col("process_score"))).alias("n"))


def expanded_examples(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "paper_rows").where("size(publication_types) = 2")
    out = V.expanded_examples(rows, "paper_row_id", "publication_types", 100, 2, "17", 2)
    return out.select("paper_row_id", F.col("copy").cast("bigint").alias("copy"), F.col("completion_no").cast("bigint").alias("completion_no"), V.completion_id(F.col("paper_row_id").cast("string"), F.col("completion")).alias("completion_id"))


def scored_candidates(spark: SparkSession, d: str) -> DataFrame:
    papers = table(spark, d, "paper_rows")
    scores = papers.where("paper_row_id % 4 = 0 and doi is not null").select(F.lower("doi").alias("key"), (F.length("title") / 100.0).alias("s"))
    out = P.scored_rows(papers.withColumn("key", F.lower("doi")), scores, ["key"], "s", R.overlap_share(R.distinct_tokens(F.lit("chronic pain in adults")), R.distinct_tokens(F.col("title"))))
    return out.select("paper_row_id", "scored", F.round("model_score", 6).alias("model_score"))


def merged_routes(spark: SparkSession, d: str) -> DataFrame:
    papers = table(spark, d, "paper_rows").where("doi is not null").withColumn("doi", F.lower("doi")).withColumn("s", 1.0 / F.col("rank_no"))
    return P.merged_routes([("paper", papers.where("channel = 'paper'")), ("other", papers.where("channel != 'paper'")), ("none", papers.limit(0))], ["pub_year"], "doi", "s", 5).select("pub_year", "doi", F.round("score", 6).alias("score"), "routes", "rank")


def rotated_order(spark: SparkSession, d: str) -> DataFrame:
    return V.rotated_order(cells(spark, d).select("cell_id", "question_id", "arm"), "question_id", "arm").select("cell_id", "block_no", "slot")


def target_mass(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct((F.col("l_linenumber") * 10).alias("start"), (F.col("l_linenumber") * 10 + F.col("l_quantity").cast("int")).alias("end"), F.col("l_discount").alias("weight")))).alias("spans"))
    return rows.select("l_orderkey", F.round(X.weighted_mass(F.col("spans")), 6).alias("mass"), X.record_faults(F.col("spans"), F.lit(100)).alias("fault"))


QUERIES = {
    f.__name__: f
    for f in (
        token_budget, training_samples, finalised_batches, complete_merge, visibility_faults, candidate_extraction, public_projection, question_registry, length_adjusted, fully_covered, grade_parsing, recomputed_figures,
        process_scores, expanded_examples, scored_candidates, merged_routes, rotated_order, target_mass,
    )
}

_WORD = r"list_distinct(regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]+|[一-鿿]'))"
SQL = {
    "token_budget": "WITH t AS (SELECT output_id, CAST(ceil(strlen(problem) / 3.15) AS INT) AS p, CAST(ceil(strlen(final_response) / 3.15) AS INT) AS c FROM eval_outputs) SELECT output_id, coalesce(p + 250 <= 400 AND c <= 250, false) AS fits, coalesce(c, 0) AS targets FROM t",
    "training_samples": "SELECT log_id FROM (SELECT log_id, row_number() OVER (PARTITION BY run_id, executed_action ORDER BY turn, log_id) AS r FROM case_steps WHERE coalesce(feedback_status = 'ok', false) AND arm IN ('sft', 'raw') AND NOT coalesce(error_code = 'E_DUP', false)) WHERE r = 1",
    "finalised_batches": f"""WITH {_CELLS}, a AS (SELECT round_no, question_id, arm, true AS a FROM cells WHERE process_score IS NOT NULL), b AS (SELECT round_no, question_id, arm, benchmark_score > 0 AS ok FROM cells WHERE benchmark_score IS NOT NULL)
SELECT round_no, question_id, arm, CASE WHEN ok IS NULL THEN 'no_decision' WHEN a IS NULL THEN 'no_session' WHEN ok THEN 'accepted' ELSE 'rejected' END AS state FROM a FULL JOIN b USING (round_no, question_id, arm)""",
    "complete_merge": "SELECT output_id, output_id % 4 AS worker FROM eval_outputs WHERE (SELECT count(DISTINCT output_id % 4) FROM eval_outputs) = 4",
    "visibility_faults": """WITH s AS (SELECT * FROM case_steps WHERE run_id IS NOT NULL AND turn IS NOT NULL), o AS (SELECT run_id, list(DISTINCT e) AS opened FROM (SELECT run_id, unnest(new_evidence_ids) AS e FROM s) GROUP BY 1)
SELECT log_id, coalesce(list_contains(new_evidence_ids, 'E1'), false) AS target_visible, array_to_string(list_filter(['E1', 'E2', 'E9'], lambda x: NOT list_contains(coalesce(opened, []), x)), ',') AS unopened FROM s LEFT JOIN o USING (run_id)""",
    "candidate_extraction": """WITH f AS (SELECT *, row_number() OVER (PARTITION BY channel, pub_year, lower(doi) ORDER BY rank_no, paper_row_id) AS r FROM paper_rows WHERE channel IS NOT NULL AND doi IS NOT NULL), p AS (SELECT paper_row_id, substring(title, 1, 20) AS title, row_number() OVER (PARTITION BY channel, pub_year ORDER BY rank_no, paper_row_id) AS position FROM f WHERE r = 1)
SELECT * FROM p WHERE position <= 8""",
    "public_projection": "SELECT paper_row_id, coalesce(nullif(trim(source_id), ''), nullif(trim(doi), ''), nullif(trim(paper_id), ''), 'none') AS id, coalesce(nullif(trim(abstract), ''), nullif(trim(title), ''), '') AS preview FROM paper_rows",
    "question_registry": "WITH j AS (SELECT output_id, CAST(original_data AS JSON) AS j FROM eval_outputs WHERE json_valid(original_data)), w AS (SELECT output_id, unnest([{'name': 'id', 'value': j->>'id'}, {'name': 'arm', 'value': j->>'arm'}]) AS z FROM j) SELECT output_id, '$.' || z.name AS path, z.name AS name, z.value AS value FROM w WHERE z.value IS NOT NULL",
    "length_adjusted": "SELECT output_id, round(length(problem) / 100.0 - 0.0147 * (length(final_response) - 2000) / 500, 6) AS adjusted FROM eval_outputs",
    "fully_covered": "SELECT l_orderkey, bool_and(l_partkey % 3 = 2) AS complete FROM lineitem GROUP BY 1",
    "grade_parsing": "SELECT output_id, CASE output_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS met FROM eval_outputs",
    "recomputed_figures": f"WITH {_CELLS}, s AS (SELECT arm, avg(benchmark_score) AS x FROM cells GROUP BY 1) SELECT arm, 'score' AS metric, round(x, 3) AS stated, round(x, 6) AS computed FROM s WHERE abs(round(x, 3) - x) > 1e-8",
    "process_scores": f"WITH {_CELLS}, s AS (SELECT arm, CASE WHEN status = 'held' THEN NULL WHEN status = 'failed' THEN 0 ELSE process_score END AS x FROM cells) SELECT arm, round(avg(x), 6) AS mean, count(x) AS n FROM s GROUP BY 1",
    "expanded_examples": """WITH r AS (SELECT paper_row_id, publication_types AS p FROM paper_rows WHERE len(publication_types) = 2 ORDER BY sha256('17|' || paper_row_id), paper_row_id LIMIT 100), c AS (SELECT *, unnest([1, 2]) AS copy FROM r), n AS (SELECT paper_row_id, copy, unnest(p) AS t, generate_subscripts(p, 1) - 1 AS completion_no FROM c)
SELECT paper_row_id, copy, completion_no, sha256(CAST(paper_row_id AS VARCHAR) || t) AS completion_id FROM n""",
    "scored_candidates": f"""WITH s AS (SELECT lower(doi) AS key, max(length(title) / 100.0) AS s FROM paper_rows WHERE paper_row_id % 4 = 0 AND doi IS NOT NULL AND title IS NOT NULL GROUP BY 1)
SELECT paper_row_id, s IS NOT NULL AS scored, round(coalesce(s, len(list_intersect(['chronic', 'pain', 'in', 'adults'], {_WORD.format('title')})) / 4.0), 6) AS model_score FROM paper_rows LEFT JOIN s ON lower(doi) = key""",
    "merged_routes": """WITH p AS (SELECT pub_year, lower(doi) AS doi, max(1.0 / rank_no) AS score, CASE WHEN bool_and(channel = 'paper') THEN 'paper' WHEN bool_or(channel = 'paper') THEN 'other+paper' ELSE 'other' END AS routes FROM paper_rows WHERE doi IS NOT NULL AND channel IS NOT NULL GROUP BY 1, 2),
r AS (SELECT pub_year, doi, round(score, 6) AS score, routes, row_number() OVER (PARTITION BY pub_year ORDER BY score DESC NULLS LAST, doi) AS rank FROM p) SELECT * FROM r WHERE rank <= 5""",
    "rotated_order": f"WITH {_CELLS}, x AS (SELECT cell_id, dense_rank() OVER (ORDER BY question_id) - 1 AS q, dense_rank() OVER (ORDER BY arm) - 1 AS a, (SELECT count(DISTINCT arm) FROM cells) AS n FROM cells) SELECT cell_id, q // 5 AS block_no, ((a - q // 5) % n + n) % n AS slot FROM x",
    "target_mass": """WITH s AS (SELECT l_orderkey, l_linenumber * 10 AS s, l_linenumber * 10 + CAST(l_quantity AS INT) AS e, l_discount AS w FROM lineitem), o AS (SELECT *, lag(e) OVER (PARTITION BY l_orderkey ORDER BY s, e, w) AS p FROM s)
SELECT l_orderkey, round(sum((e - s) * w), 6) AS mass, CASE WHEN bool_or(s < 0 OR e > 100 OR e <= s) THEN 'out_of_range' WHEN bool_or(w <= 0) THEN 'not_positive' WHEN bool_or(p IS NOT NULL AND s < p) THEN 'overlap' END AS fault FROM o GROUP BY 1""",
}
