"""Queries over the step log and the event stream, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evifold.operators import events as E
from evifold.sources.tables import table

ACTION = "action string, channel string, requirement_ids array<string>, query string, source_id string, reading_focus string, reason string, _broken string"
_J = {"columnNameOfCorruptRecord": "_broken", "allowSingleQuotes": "false"}
RUN = ["run_id"]
ORDER = ["turn", "log_id"]


def steps(spark: SparkSession, d: str) -> DataFrame:
    """The step log with its parsed action beside it; broken JSON gives a NULL action."""
    rows = table(spark, d, "case_steps")
    parsed = rows.withColumn("a", F.from_json("executed_action", ACTION, _J))
    return parsed.withColumn("a", F.when(F.col("a._broken").isNull(), F.col("a")))


_STEPS = """steps AS (SELECT *, CASE WHEN json_valid(executed_action) THEN CAST(executed_action AS JSON) END AS j FROM case_steps),
s AS (SELECT *, j->>'action' AS action, j->>'channel' AS channel, j->>'query' AS query, j->>'source_id' AS source, j->>'reading_focus' AS focus FROM steps)"""


def latest_state_fold(spark: SparkSession, d: str) -> DataFrame:
    return E.latest_by(table(spark, d, "case_steps").where("run_id is not null"), RUN, "feedback_status", ORDER)


def repeat_actions(spark: SparkSession, d: str) -> DataFrame:
    s = steps(spark, d).where("a.action = 'search' and run_id is not null and a.query is not null")
    marked = E.repeats(s.withColumn("signature", E.search_signature(F.col("a.channel"), F.col("a.query"))), ["run_id", "signature"], ORDER)
    return marked.groupBy("arm").agg(F.count(F.lit(1)).alias("searches"), F.count_if(F.col("occurrence") > 1).alias("repeated"))


def attempts_and_success(spark: SparkSession, d: str) -> DataFrame:
    s = steps(spark, d).where("a.action = 'browse' and a.source_id is not null")
    keyed = s.withColumn("source", E.source_id(F.col("a.source_id")))
    return keyed.groupBy("run_id", "source").agg(F.count(F.lit(1)).alias("attempts"), F.count_if(F.col("feedback_status") == "ok").alias("successes"), (F.count(F.lit(1)) >= 2).alias("used_up"))


def call_output_pairing(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events")
    paired = E.previous_of(ev, ["user_id"], ["ts", "event_id"], F.col("event_id"), F.col("event_type") == "click", F.col("event_type").isin("view", "purchase"))
    return paired.where("paired is not null").select("user_id", "event_id", "paired")


def budget_charge(spark: SparkSession, d: str) -> DataFrame:
    charged = E.charge_budget(table(spark, d, "case_steps"), RUN, ORDER, F.coalesce(F.col("feedback_status") == "timeout", F.lit(False)), turn=F.col("turn"))
    return charged.select("log_id", "actual", "exempt", "charged", "stopped")


def failures_since_ok(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events")
    marked = E.failures_since_success(ev, ["user_id"], ["ts", "event_id"], F.col("event_type") == "purchase", F.col("event_type") == "error")
    return marked.select("event_id", "user_id", "failures")


def no_progress_browse(spark: SparkSession, d: str) -> DataFrame:
    s = steps(spark, d).where("a.action = 'browse'").withColumn("focus", F.trim(F.regexp_replace(F.lower("a.reading_focus"), r"\s+", " ")))
    rows = s.select("log_id", "run_id", "turn", F.col("a.source_id").alias("source"), "focus", (F.coalesce(F.size("new_evidence_ids"), F.lit(0)) > 0).alias("gained"))
    return E.no_progress(rows, ["run_id", "source", "focus"], ORDER, F.col("gained")).select("log_id", "run_id", "earlier")


def exposure_stats(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "case_steps").where("run_id is not null").groupBy("arm", "run_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("feedback_status") != "ok").alias("bad"))
    return runs.groupBy("arm").agg(F.count(F.lit(1)).alias("runs"), F.round(F.avg("n"), 6).alias("mean_steps"), F.median("n").alias("median_steps"), F.count_if(F.col("bad") > 0).alias("runs_with_bad"))


def status_board(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "case_steps").groupBy("arm", "feedback_status", "error_code").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("run_id").alias("runs"))


def repeated_paragraph(spark: SparkSession, d: str) -> DataFrame:
    return E.repeated_paragraphs(table(spark, d, "documents"), "doc_id", F.col("text")).select("doc_id", "first_repeat", "n_repeats")


def unopened_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Papers found per channel that no run ever browsed."""
    found = table(spark, d, "paper_rows").where("source_id is not null").groupBy("source_id").agg(F.count(F.lit(1)).alias("n_found"), F.min("rank_no").alias("best_rank"))
    opened = steps(spark, d).where("a.action = 'browse' and a.source_id is not null").select(E.source_id(F.col("a.source_id")).alias("source_id")).distinct()
    return found.join(opened, "source_id", "left_anti").select("source_id", "n_found", "best_rank")


def evidence_registration(spark: SparkSession, d: str) -> DataFrame:
    """New evidence per run: each id once, numbered in the order of its first delivery."""
    rows = table(spark, d, "case_steps").where("run_id is not null").select("run_id", "turn", "log_id", F.posexplode("new_evidence_ids").alias("pos", "evidence_id"))
    first = rows.where("evidence_id is not null").groupBy("run_id", "evidence_id").agg(F.min(F.struct("turn", "log_id", "pos")).alias("at"))
    return first.withColumn("number", F.row_number().over(Window.partitionBy("run_id").orderBy("at"))).select("run_id", "evidence_id", "number")


def coverage_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Per question and arm: distinct sources opened, distinct channels searched, and whether evidence came of it."""
    s = steps(spark, d).where("question_id is not null")
    return s.groupBy("question_id", "arm").agg(
        F.countDistinct(F.when(F.col("a.action") == "browse", E.source_id(F.col("a.source_id")))).alias("sources"),
        F.countDistinct(F.when(F.col("a.action") == "search", F.col("a.channel"))).alias("channels"),
        F.coalesce(F.bool_or(F.size("new_evidence_ids") > 0), F.lit(False)).alias("any_evidence"),
    )


def linked_credit(spark: SparkSession, d: str) -> DataFrame:
    """Each successful browse with the searches of its run before it: a single one shares 30/70, else all is the browse's."""
    s = steps(spark, d).where("run_id is not null").select("run_id", "turn", "log_id", F.col("a.action").alias("action"), "feedback_status", F.concat_ws(",", F.col("a.requirement_ids")).alias("req"))
    w = Window.partitionBy("run_id", "req").orderBy("turn", "log_id").rowsBetween(*E.BEFORE)
    counted = s.withColumn("n", F.count_if(F.col("action") == "search").over(w)).withColumn("search_id", F.max(F.when(F.col("action") == "search", F.col("log_id"))).over(w))
    browses = counted.where("action = 'browse' and feedback_status = 'ok'")
    return browses.select("log_id", F.when(F.col("n") == 1, F.col("search_id")).alias("search_id"), F.when(F.col("n") == 1, 0.3).otherwise(0.0).alias("search_share"), F.when(F.col("n") == 1, 0.7).otherwise(1.0).alias("browse_share"))


QUERIES = {f.__name__: f for f in (latest_state_fold, repeat_actions, attempts_and_success, call_output_pairing, budget_charge, failures_since_ok, no_progress_browse, exposure_stats, status_board, repeated_paragraph, unopened_candidates, evidence_registration, coverage_gaps, linked_credit)}

_SOFAR = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
_BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
SQL = {
    "latest_state_fold": "SELECT run_id, feedback_status FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY turn DESC, log_id DESC) AS r FROM case_steps WHERE run_id IS NOT NULL) WHERE r = 1",
    "repeat_actions": f"WITH {_STEPS}, r AS (SELECT arm, row_number() OVER (PARTITION BY run_id, coalesce(channel, ''), trim(regexp_replace(lower(query), '\\s+', ' ', 'g')) ORDER BY turn, log_id) AS o FROM s WHERE action = 'search' AND run_id IS NOT NULL AND query IS NOT NULL) SELECT arm, count(*) AS searches, count(*) FILTER (o > 1) AS repeated FROM r GROUP BY arm",
    "attempts_and_success": f"WITH {_STEPS} SELECT run_id, trim(string_split(source, '#')[1]) AS source, count(*) AS attempts, count(*) FILTER (feedback_status = 'ok') AS successes, count(*) >= 2 AS used_up FROM s WHERE action = 'browse' AND source IS NOT NULL GROUP BY ALL",
    "call_output_pairing": "WITH l AS (SELECT *, last_value(CASE WHEN event_type IN ('click', 'view', 'purchase') THEN {'c': event_type = 'click', 'v': event_id} END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l FROM events) SELECT user_id, event_id, l.v AS paired FROM l WHERE event_type IN ('view', 'purchase') AND l.c",
    "budget_charge": f"WITH c AS (SELECT log_id, row_number() OVER (PARTITION BY run_id ORDER BY turn, log_id) AS actual, CAST(least(sum(CASE WHEN feedback_status = 'timeout' THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY turn, log_id {_SOFAR}), 5) AS BIGINT) AS exempt, turn FROM case_steps) SELECT log_id, actual, exempt, actual - exempt AS charged, (actual - exempt >= 6 OR actual >= 11 OR coalesce(turn >= 16, false)) AS stopped FROM c",
    "failures_since_ok": f"WITH i AS (SELECT *, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id {_SOFAR}) AS isl FROM events) SELECT event_id, user_id, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, isl ORDER BY ts, event_id {_SOFAR}) AS BIGINT) AS failures FROM i",
    "no_progress_browse": f"WITH {_STEPS}, f AS (SELECT log_id, run_id, turn, source, trim(regexp_replace(lower(focus), '\\s+', ' ', 'g')) AS focus, coalesce(len(new_evidence_ids), 0) > 0 AS g FROM s WHERE action = 'browse'), w AS (SELECT log_id, run_id, count(*) OVER x AS earlier, max(CAST(g AS INT)) OVER x AS gain FROM f WINDOW x AS (PARTITION BY run_id, source, focus ORDER BY turn, log_id {_BEFORE})) SELECT log_id, run_id, earlier FROM w WHERE earlier > 0 AND gain = 0",
    "exposure_stats": "WITH r AS (SELECT arm, run_id, count(*) AS n, count(*) FILTER (feedback_status <> 'ok') AS bad FROM case_steps WHERE run_id IS NOT NULL GROUP BY arm, run_id) SELECT arm, count(*) AS runs, round(avg(n), 6) AS mean_steps, median(n) AS median_steps, count(*) FILTER (bad > 0) AS runs_with_bad FROM r GROUP BY arm",
    "status_board": "SELECT arm, feedback_status, error_code, count(*) AS n, count(DISTINCT run_id) AS runs FROM case_steps GROUP BY ALL",
    "repeated_paragraph": r"WITH p AS (SELECT doc_id, string_split_regex(coalesce(text, ''), '\n[ \t\r]*\n') AS l FROM documents), q AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS x FROM p), c AS (SELECT doc_id, pos, trim(regexp_replace(regexp_replace(x, '</?(think|answer|cite)[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS x FROM q), r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id, x ORDER BY pos) AS o FROM c WHERE length(x) >= 80) SELECT doc_id, CAST(min(pos) AS INT) AS first_repeat, count(*) AS n_repeats FROM r WHERE o > 1 GROUP BY doc_id",
    "unopened_candidates": f"WITH {_STEPS}, f AS (SELECT source_id, count(*) AS n_found, min(rank_no) AS best_rank FROM paper_rows WHERE source_id IS NOT NULL GROUP BY source_id) SELECT * FROM f WHERE source_id NOT IN (SELECT trim(string_split(source, '#')[1]) FROM s WHERE action = 'browse' AND source IS NOT NULL)",
    "evidence_registration": "WITH e AS (SELECT run_id, turn, log_id, generate_subscripts(new_evidence_ids, 1) AS pos, unnest(new_evidence_ids) AS evidence_id FROM case_steps WHERE run_id IS NOT NULL), f AS (SELECT run_id, evidence_id, min({'t': turn, 'l': log_id, 'p': pos}) AS place FROM e WHERE evidence_id IS NOT NULL GROUP BY run_id, evidence_id) SELECT run_id, evidence_id, row_number() OVER (PARTITION BY run_id ORDER BY place) AS number FROM f",
    "coverage_gaps": f"WITH {_STEPS} SELECT question_id, arm, count(DISTINCT CASE WHEN action = 'browse' THEN trim(string_split(source, '#')[1]) END) AS sources, count(DISTINCT CASE WHEN action = 'search' THEN channel END) AS channels, coalesce(bool_or(len(new_evidence_ids) > 0), false) AS any_evidence FROM s WHERE question_id IS NOT NULL GROUP BY question_id, arm",
    "linked_credit": f"WITH {_STEPS}, q AS (SELECT *, coalesce(array_to_string(CAST(j->'requirement_ids' AS VARCHAR[]), ','), '') AS req FROM s WHERE run_id IS NOT NULL), c AS (SELECT *, count(*) FILTER (action = 'search') OVER w AS n, max(CASE WHEN action = 'search' THEN log_id END) OVER w AS sid FROM q WINDOW w AS (PARTITION BY run_id, req ORDER BY turn, log_id {_BEFORE})) SELECT log_id, CASE WHEN n = 1 THEN sid END AS search_id, CASE WHEN n = 1 THEN CAST(0.3 AS DOUBLE) ELSE 0 END AS search_share, CASE WHEN n = 1 THEN CAST(0.7 AS DOUBLE) ELSE 1 END AS browse_share FROM c WHERE action = 'browse' AND feedback_status = 'ok'",
}
