"""Queries of verdict aggregation, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evifold.operators import judging as J
from evifold.plans.evaluation_queries import _CELLS, cells
from evifold.sources.tables import table


def _slots(spark: SparkSession, d: str) -> DataFrame:
    """Line items as slots of an order: available and final state of each, its citation score, and flags of the order."""
    return table(spark, d, "lineitem").select(
        "l_orderkey", F.when(F.col("l_returnflag") == "A", "direct").when(F.col("l_returnflag") == "N", "partial").otherwise("unknown").alias("state"),
        F.when(F.col("l_tax") < 0.01, "unobservable").when(F.col("l_linestatus") == "O", "partial").otherwise("direct").alias("expected"),
        F.when(F.col("l_quantity") < 5, "abstained").when(F.col("l_quantity") < 10, "omitted").otherwise("answered").alias("disposition"),
        (F.col("l_discount") * 10).alias("citation"), (F.col("l_orderkey") % 2 == 0).alias("natural"), (F.col("l_orderkey") % 3 != 0).alias("safe"),
    )


_SLOTS = """slots AS (SELECT l_orderkey, CASE l_returnflag WHEN 'A' THEN 'direct' WHEN 'N' THEN 'partial' ELSE 'unknown' END AS state,
  CASE WHEN l_tax < 0.01 THEN 'unobservable' WHEN l_linestatus = 'O' THEN 'partial' ELSE 'direct' END AS expected,
  CASE WHEN l_quantity < 5 THEN 'abstained' WHEN l_quantity < 10 THEN 'omitted' ELSE 'answered' END AS disposition,
  l_discount * 10 AS citation, l_orderkey % 2 = 0 AS by_itself, l_orderkey % 3 <> 0 AS safe FROM lineitem)"""


def state_grading(spark: SparkSession, d: str) -> DataFrame:
    graded = J.state_grades(_slots(spark, d), ["l_orderkey"], "state", "expected", "citation")
    return graded.select("l_orderkey", *(F.round(c, 6).alias(c) for c in ("status_accuracy", "grounded_accuracy", "score")), "n")


def stage_scalar(spark: SparkSession, d: str) -> DataFrame:
    rows = cells(spark, d)
    core = {"content": (F.col("process_score") / 100, 0.7), "citation": (F.abs("process_reward"), 0.3)}
    label = F.when(F.col("status") == "complete", 1).when(F.col("status") == "failed", -1)
    return rows.select("cell_id", F.round(J.stage_scalar(core, label, F.col("benchmark_score") == 0), 6).alias("score"))


def rubric_gaps(spark: SparkSession, d: str) -> DataFrame:
    rows = cells(spark, d)
    pool = table(spark, d, "exclusion_pool").select("question_id", "bench")
    return J.rubric_gaps(pool.where("question_id is not null and bench is not null"), rows.where("bench is not null").select("question_id", "bench"), ["question_id", "bench"])


def citation_binding(spark: SparkSession, d: str) -> DataFrame:
    steps = table(spark, d, "case_steps").where("run_id is not null")
    evidence = steps.select("run_id", "log_id", F.explode("new_evidence_ids").alias("e"))
    bound = J.bind_citations(steps.select("run_id", "log_id", "new_evidence_ids"), evidence, ["run_id"], "new_evidence_ids", "e", F.col("log_id"))
    return bound.select("log_id", F.col("place").cast("bigint").alias("place"), "cited_id", "bound_to")


def terminal_penalty(spark: SparkSession, d: str) -> DataFrame:
    return _slots(spark, d).groupBy("l_orderkey").agg(
        F.round(J.terminal_penalty(F.col("state"), F.col("disposition"), 0.4, 0.2), 6).alias("penalty"),
        F.round(J.terminal_bonus(F.col("state"), (F.col("disposition") == "answered") & (F.col("citation") > 0.3), F.col("natural"), F.col("safe"), 0.3, 0.1), 6).alias("bonus"),
    )


def failure_overlay(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "case_steps")
    reasons = F.array_compact(F.array(F.nullif(F.col("error_code"), F.lit(""))))
    score = J.failure_overlay(F.col("turn") / 10.0 - 0.5, F.col("feedback_status") == "timeout", reasons, ["E_DUP", "E_PARSE"], -0.2)
    return rows.select("log_id", F.round(score, 6).alias("score"))


def trajectory_reward(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "case_steps").where("run_id is not null").groupBy("run_id").agg(
        F.count(F.lit(1)).alias("calls"), F.avg((F.col("feedback_status") == "ok").cast("double")).alias("coverage"), F.max("turn").alias("last"),
        F.coalesce(F.bool_or(F.size("new_evidence_ids") > 0), F.lit(False)).alias("opened"), F.bool_or(F.col("question_id").isNotNull()).alias("judged"),
    )
    reward = J.trajectory_reward(F.col("calls") == 1, F.col("calls") - 1, F.col("coverage"), F.col("last") >= 8, F.col("opened"), F.col("judged"))
    return runs.select("run_id", F.round(reward, 6).alias("reward"))


def quality_r(spark: SparkSession, d: str) -> DataFrame:
    value = J.quality_r(F.col("process_score"), F.col("status") == "held", F.col("benchmark_score") < 0, F.col("status") == "failed", F.col("process_reward") < 0.5)
    return cells(spark, d).select("cell_id", F.round(value, 6).alias("quality"))


def process_points(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        J.content_part(F.pmod(F.col("l_partkey"), F.lit(3))).alias("p1"), F.sum(F.col("l_discount") * 100).alias("p2"), F.sum(F.col("l_tax") * 100).alias("p3"), F.max("l_linenumber").cast("double").alias("p4")
    )
    return rows.select("l_orderkey", F.round("p1", 6).alias("p1"), F.round(F.col("p1") * 2.5, 6).alias("coverage_percent"), F.round(J.process_total([F.col(p) for p in ("p1", "p2", "p3", "p4")]), 6).alias("total"))


def answer_dimensions(spark: SparkSession, d: str) -> DataFrame:
    dims = [F.when(F.pmod(F.col("o_custkey"), F.lit(k)) != 0, F.pmod(F.col("o_orderkey"), F.lit(k + 1)).cast("double")) for k in (2, 3, 4, 5)]
    dims = [F.when(x <= 4, x) for x in dims]
    candidate, accepted = J.answer_score(dims, F.col("o_orderstatus") == "F")
    return table(spark, d, "orders").select("o_orderkey", F.round(candidate, 4).alias("candidate"), F.round(accepted, 4).alias("accepted"))


def stop_gate(spark: SparkSession, d: str) -> DataFrame:
    seen = F.when(F.col("feedback_status") == "ok", "consistent").when(F.col("feedback_status") == "blocked", "minor").when(F.col("feedback_status") == "error", "conflict")
    return table(spark, d, "case_steps").groupBy("arm").agg(F.round(F.avg(J.stop_gate(seen)), 6).alias("weight"), F.count(J.stop_gate(seen)).alias("observed"))


def quote_repair(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null")
    return J.repaired_quotes(docs, "doc_id", F.upper(F.regexp_extract("text", r"([A-Z][^.\n]{30,}\.)", 1)), F.col("text"))


QUERIES = {f.__name__: f for f in (state_grading, stage_scalar, rubric_gaps, citation_binding, terminal_penalty, failure_overlay, trajectory_reward, quality_r, process_points, answer_dimensions, stop_gate, quote_repair)}

_DIMS = ", ".join(f"CASE WHEN o_custkey % {k} <> 0 AND o_orderkey % {k + 1} <= 4 THEN CAST(o_orderkey % {k + 1} AS DOUBLE) END AS d{k}" for k in (2, 3, 4, 5))
_GOT = " + ".join(f"coalesce({w} * d{k} / 4, 0)" for k, w in zip((2, 3, 4, 5), (40, 30, 20, 10)))
_HELD = " + ".join(f"CASE WHEN d{k} IS NOT NULL THEN {w} ELSE 0 END" for k, w in zip((2, 3, 4, 5), (40, 30, 20, 10)))
SQL = {
    "state_grading": f"""WITH {_SLOTS}, r AS (SELECT *, CASE WHEN expected <> 'unobservable' THEN CAST(state = expected AS INT) END AS ok FROM slots),
g AS (SELECT *, CASE WHEN ok = 0 THEN 0 WHEN ok = 1 AND state = 'unknown' THEN 1 WHEN ok = 1 THEN citation END AS gr FROM r),
m AS (SELECT l_orderkey, CASE WHEN count(*) = count(ok) THEN avg(ok) END AS a, CASE WHEN count(*) = count(gr) THEN avg(gr) END AS b, count(*) AS n FROM g GROUP BY 1)
SELECT l_orderkey, round(a, 6) AS status_accuracy, round(b, 6) AS grounded_accuracy, round(0.75 * a + 0.25 * b, 6) AS score, n FROM m""",
    "stage_scalar": f"""WITH {_CELLS}, c AS (SELECT *, (process_score / 100 * 0.7 + abs(process_reward) * 0.3) AS core, CASE status WHEN 'complete' THEN 0.05 WHEN 'failed' THEN -0.05 ELSE 0 END AS move FROM cells)
SELECT cell_id, CASE WHEN core IS NOT NULL THEN round(greatest(0, least(1, core + CASE WHEN benchmark_score = 0 AND move > 0 THEN 0 ELSE move END)), 6) END AS score FROM c""",
    "rubric_gaps": f"""WITH {_CELLS}, a AS (SELECT DISTINCT question_id, bench FROM exclusion_pool WHERE question_id IS NOT NULL AND bench IS NOT NULL), b AS (SELECT DISTINCT question_id, bench FROM cells WHERE bench IS NOT NULL)
SELECT *, 'missing' AS gap FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'extra' AS gap FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""",
    "citation_binding": """WITH e AS (SELECT run_id, log_id, unnest(new_evidence_ids) AS cited_id, generate_subscripts(new_evidence_ids, 1) - 1 AS place FROM case_steps WHERE run_id IS NOT NULL)
SELECT log_id, place, cited_id, min(log_id) OVER (PARTITION BY run_id, cited_id) AS bound_to FROM e""",
    "terminal_penalty": f"""WITH {_SLOTS}, g AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (state = 'direct') AS have, count(*) FILTER (state = 'direct' AND disposition IN ('abstained', 'omitted')) AS missed,
  bool_or(state = 'direct' AND disposition = 'abstained') AS bad, count(*) FILTER (state = 'direct' AND disposition = 'answered' AND citation > 0.3) AS used, bool_and(by_itself AND safe) AS fine FROM slots GROUP BY 1)
SELECT l_orderkey, round(0.4 * missed / n + CASE WHEN bad THEN 0.2 ELSE 0 END, 6) AS penalty, CASE WHEN have = 0 THEN 0.0 ELSE round(0.3 * used / have + CASE WHEN fine AND used >= 0.75 * have THEN 0.1 ELSE 0 END, 6) END AS bonus FROM g""",
    "failure_overlay": """SELECT log_id, round(CASE WHEN feedback_status = 'timeout' THEN 0 WHEN error_code IN ('E_DUP', 'E_PARSE') THEN least(turn / 10.0 - 0.5, -0.2) WHEN error_code <> '' THEN 0 ELSE greatest(turn / 10.0 - 0.5, 0) END, 6) AS score FROM case_steps""",
    "trajectory_reward": """WITH r AS (SELECT run_id, count(*) AS calls, avg(CASE WHEN feedback_status = 'ok' THEN 1.0 WHEN feedback_status IS NOT NULL THEN 0 END) AS c, max(turn) AS last, coalesce(bool_or(len(new_evidence_ids) > 0), false) AS opened, bool_or(question_id IS NOT NULL) AS judged FROM case_steps WHERE run_id IS NOT NULL GROUP BY 1)
SELECT run_id, round(CASE WHEN calls = 1 THEN 1.0 WHEN opened AND NOT judged THEN NULL ELSE c - CASE WHEN last >= 8 AND c < 1 THEN 0.25 ELSE 0 END END, 6) AS reward FROM r""",
    "quality_r": f"""WITH {_CELLS} SELECT cell_id, round(CASE WHEN status = 'held' THEN NULL WHEN benchmark_score < 0 OR status = 'failed' THEN 0 ELSE process_score / 100 * CASE WHEN process_reward < 0.5 THEN 0.49 ELSE 1 END END, 6) AS quality FROM cells""",
    "process_points": """WITH g AS (SELECT l_orderkey, 40.0 * sum(l_partkey % 3) / (2 * count(*)) AS p1, sum(l_discount * 100) AS p2, sum(l_tax * 100) AS p3, max(l_linenumber) AS p4 FROM lineitem GROUP BY 1)
SELECT l_orderkey, round(p1, 6) AS p1, round(p1 * 2.5, 6) AS coverage_percent, round(least(40.0, p1) + least(30.0, p2) + least(20.0, p3) + least(10.0, p4), 6) AS total FROM g""",
    "answer_dimensions": f"""WITH d AS (SELECT o_orderkey, o_orderstatus, {_DIMS} FROM orders), s AS (SELECT *, round(100 * ({_GOT}) / nullif({_HELD}, 0), 4) AS candidate FROM d)
SELECT o_orderkey, candidate, CASE WHEN o_orderstatus = 'F' THEN candidate END AS accepted FROM s""",
    "stop_gate": """SELECT arm, round(avg(w), 6) AS weight, count(w) AS observed FROM (SELECT arm, CASE feedback_status WHEN 'ok' THEN 1.0 WHEN 'blocked' THEN 0.5 WHEN 'error' THEN 0.0 END AS w FROM case_steps) GROUP BY 1""",
}
