"""Queries over the ledgers of agent runs, their integrity and training records, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evifold.operators import events as E
from evifold.operators import ledger as L
from evifold.plans.evaluation_queries import _CELLS, cells
from evifold.plans.event_queries import _STEPS, steps
from evifold.sources.tables import table


def _runs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "case_steps").where("run_id is not null")


def public_ledger(spark: SparkSession, d: str) -> DataFrame:
    rows = steps(spark, d).where("run_id is not null")
    out = L.public_ledger(rows, ["run_id"], F.coalesce(F.col("feedback_status") != "ok", F.lit(True)), E.source_id(F.col("a.source_id")), F.col("new_evidence_ids"), 8)
    return out.withColumn("found", F.col("found").cast("bigint")).withColumn("remaining", F.col("remaining").cast("bigint"))


def invalid_transitions(spark: SparkSession, d: str) -> DataFrame:
    rows = steps(spark, d).where("run_id is not null").withColumn("action", F.col("a.action"))
    allowed = {"search": ("search", "browse", "stop"), "browse": ("search", "browse", "stop")}
    return L.invalid_transitions(rows, ["run_id"], [F.col("turn"), F.col("log_id")], "action", allowed).select("log_id", "before", "action")


def search_alignment(spark: SparkSession, d: str) -> DataFrame:
    rows = steps(spark, d).where("run_id is not null and a.action = 'search'").withColumn("channel", F.col("a.channel"))
    return L.align_kth(rows, rows.where("feedback_status = 'ok'"), ["run_id"], [F.col("turn"), F.col("log_id")], [F.col("turn"), F.col("log_id")], "channel", "channel")


def history_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = steps(spark, d).where("run_id is not null and turn is not null")
    facts = F.concat_ws(":", F.col("turn").cast("string"), F.col("a.action"), F.col("feedback_status"))
    return L.history(rows, ["run_id"], ["turn", "log_id"], facts)


def final_attempts(spark: SparkSession, d: str) -> DataFrame:
    ok = F.col("feedback_status") == "ok"
    return L.final_attempt(_runs(spark, d), ["run_id"], "log_id", ok & (F.size("new_evidence_ids") == 0), F.col("error_code") == "E_RATE", 3)


def longest_context(spark: SparkSession, d: str) -> DataFrame:
    rows = steps(spark, d).where("run_id is not null and question_id is not null and turn is not null")
    acts = rows.groupBy("question_id", "run_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "log_id", F.coalesce("a.action", F.lit("?")).alias("x")))), lambda s: s["x"]).alias("actions"))
    known = acts.where(F.size("actions") <= 4).select("question_id", "actions", F.col("run_id").alias("prefix"))
    return L.longest_context(acts, known, ["question_id"], "actions", "prefix").select("run_id", "question_id", F.col("matched").cast("bigint").alias("matched"), "context")


def merged_sources(spark: SparkSession, d: str) -> DataFrame:
    rows = steps(spark, d).where("run_id is not null and a.action = 'browse'")
    out = L.merged_sources(rows, ["question_id"], E.source_id(F.col("a.source_id")), F.col("arm"), ["turn", "log_id"])
    return out.select("question_id", "source", F.array_join("tools", ",").alias("tools"), "first")


def batch_violations(spark: SparkSession, d: str) -> DataFrame:
    return L.violations(table(spark, d, "case_steps"), ["run_id", "turn", "executed_action"], ["run_id", "question_id", "executed_action", "error_code"], ["run_id"], "turn")


def registry_lookup(spark: SparkSession, d: str) -> DataFrame:
    papers = table(spark, d, "paper_rows")
    registry = papers.where("paper_row_id % 3 = 0 and title is not null").select(F.sha2(F.concat_ws("\x1f", F.col("title"), F.coalesce("pub_year", F.lit(""))), 256).alias("digest"))
    out = L.by_digest(papers, registry, [F.col("title"), F.col("pub_year")], "digest", [])
    return out.groupBy("channel").agg(F.count_if("trusted").alias("trusted"), F.count(F.lit(1)).alias("n"))


def judge_cache(spark: SparkSession, d: str) -> DataFrame:
    now = cells(spark, d).select("cell_id", "question_id", "arm")
    cache = table(spark, d, "eval_cells").where("question_id is not null and arm is not null and pmod(cell_id, 3) = 0")
    valid = (F.col("status") == "complete") & F.col("process_score").isNotNull()
    out = L.valid_cached(now, cache, ["question_id", "arm"], "process_score", valid)
    return out.select("cell_id", F.round("cached", 6).alias("cached"), "status")


def retry_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return L.retry_outcomes(_runs(spark, d), ["run_id"], [F.col("turn"), F.col("log_id")], F.col("feedback_status") == "ok", F.col("retryable"), 3)


def execution_binding(spark: SparkSession, d: str) -> DataFrame:
    rows = steps(spark, d).where("run_id is not null")
    calls = rows.where("a.action = 'search'").withColumn("h", F.sha2(F.coalesce("a.query", F.lit("")), 256))
    bindings = rows.where("a.action = 'search' and coalesce(error_code, '') != 'E_DUP'").withColumn("h", F.sha2(F.coalesce("a.query", F.lit("")), 256))
    out = L.align_kth(calls, bindings, ["run_id"], [F.col("turn"), F.col("log_id")], [F.col("turn"), F.col("log_id")], "h", "h")
    return out.groupBy("run_id").agg(F.count_if("matches").alias("bound"), F.count_if(~F.col("matches")).alias("unbound"))


def decision_records(spark: SparkSession, d: str) -> DataFrame:
    rows = steps(spark, d).where("run_id is not null")
    out = L.decision_index(rows, ["run_id"], ["turn", "log_id"], F.col("a.action").isin("search", "stop"))
    key = L.baseline_key(F.col("question_id"), F.coalesce("a.channel", "a.action"), F.col("decision_idx"), ["web", "paper"], "stop")
    return out.select("log_id", "decision_idx", key.alias("baseline"))


def combined_advantage(spark: SparkSession, d: str) -> DataFrame:
    rows = cells(spark, d).withColumn("local", F.col("process_reward") - 0.5).withColumn("final", F.col("benchmark_score") / 10).withColumn("channel", F.coalesce("bench", F.lit("none")))
    per = rows.groupBy("question_id", "arm").agg(F.avg("final").alias("final"))
    out = L.combined_advantage(rows.drop("final").join(per, ["question_id", "arm"]), "local", "final", "question_id", "arm", "channel", 0.3, 0.7)
    return out.select("cell_id", F.round("final_advantage", 6).alias("final_advantage"), F.round("advantage", 6).alias("advantage"), "observed", F.round("loss_weight", 6).alias("loss_weight"))


def reward_events(spark: SparkSession, d: str) -> DataFrame:
    rows = steps(spark, d).withColumn("act", F.col("a.action"))
    score = F.size("new_evidence_ids") / 4.0
    return rows.select(
        "log_id", F.round(L.combined_reward(F.col("turn") / 10.0, score, F.col("turn").cast("double")), 6).alias("reward"), F.round(L.stop_event(score, F.coalesce(F.col("act") == "stop", F.lit(False)), 0.5), 6).alias("stop"),
        F.round(L.cost_events(F.col("feedback_status") != "ok", F.coalesce(F.col("act").isin("search", "browse"), F.lit(False))), 6).alias("cost"), L.rollout_normaliser(F.lit(8), F.col("turn")).alias("denominator"),
    )


def masked_log_probs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    allowed = F.transform("embedding", lambda x: x > 0.05)
    probs = L.masked_log_softmax(F.col("embedding"), allowed)
    return rows.select("vec_id", F.round(F.array_max(probs), 5).alias("top"), F.size(F.filter(probs, lambda x: x.isNotNull())).cast("bigint").alias("n"))


def acceptance_subset(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "case_steps").where("question_id is not null").withColumn("len", F.length("executed_action"))
    return L.acceptance_subset(rows, ["question_id"], "log_id", "len", F.col("feedback_status") == "error", "arm", 8).select("question_id", "log_id", "pick")


QUERIES = {
    f.__name__: f
    for f in (
        public_ledger, invalid_transitions, search_alignment, history_summary, final_attempts, longest_context, merged_sources, batch_violations, registry_lookup, judge_cache, retry_outcomes, execution_binding,
        decision_records, combined_advantage, reward_events, masked_log_probs, acceptance_subset,
    )
}

_S = f"WITH {_STEPS}"
_TRIM = "trim(split_part(source, '#', 1))"
SQL = {
    "public_ledger": f"{_S}, e AS (SELECT run_id, count(DISTINCT x) AS found FROM (SELECT run_id, unnest(new_evidence_ids) AS x FROM s) GROUP BY 1) SELECT s.run_id, count(*) AS calls, count(*) FILTER (coalesce(feedback_status <> 'ok', true)) AS failures, greatest(0, 8 - count(*)) AS remaining, count(DISTINCT {_TRIM}) AS sources, coalesce(any_value(found), 0) AS found FROM s LEFT JOIN e USING (run_id) WHERE s.run_id IS NOT NULL GROUP BY 1",
    "invalid_transitions": f"{_S}, l AS (SELECT log_id, action, lag(action) OVER w AS before, row_number() OVER w AS n FROM s WHERE run_id IS NOT NULL WINDOW w AS (PARTITION BY run_id ORDER BY turn, log_id)) SELECT log_id, before, action FROM l WHERE n > 1 AND NOT coalesce(before IN ('search', 'browse') AND action IN ('search', 'browse', 'stop'), false)",
    "search_alignment": f"{_S}, c AS (SELECT run_id, channel, feedback_status, turn, log_id FROM s WHERE run_id IS NOT NULL AND action = 'search'), a AS (SELECT run_id, channel, row_number() OVER (PARTITION BY run_id ORDER BY turn, log_id) AS k FROM c), b AS (SELECT run_id, channel, row_number() OVER (PARTITION BY run_id ORDER BY turn, log_id) AS k FROM c WHERE feedback_status = 'ok') SELECT run_id, k, a.channel AS left_value, b.channel AS right_value, b.k IS NOT NULL AND a.channel IS NOT DISTINCT FROM b.channel AS matches FROM a LEFT JOIN b USING (run_id, k)",
    "history_summary": f"{_S} SELECT run_id, string_agg(concat_ws(':', turn, action, feedback_status), '; ' ORDER BY turn, log_id) AS history FROM s WHERE run_id IS NOT NULL AND turn IS NOT NULL GROUP BY 1",
    "final_attempts": """WITH r AS (SELECT *, coalesce(feedback_status = 'ok' AND len(new_evidence_ids) = 0, false) AS ok, coalesce(error_code = 'E_RATE', false) AS odd FROM case_steps WHERE run_id IS NOT NULL),
g AS (SELECT run_id, count(*) AS attempts, max(log_id) AS last, min(log_id) FILTER (ok) AS v, arg_max(ok AND NOT odd, log_id) AS fine FROM r GROUP BY 1),
x AS (SELECT *, CASE WHEN attempts > 3 THEN 'too_many' WHEN v < last THEN 'after_valid' WHEN NOT fine THEN 'needs_attention' ELSE 'selected' END AS verdict FROM g)
SELECT run_id, attempts, CASE WHEN verdict = 'selected' THEN last END AS selected, verdict FROM x""",
    "longest_context": f"""{_S}, t AS (SELECT question_id, run_id, list(coalesce(action, '?') ORDER BY turn, log_id) AS acts FROM s WHERE run_id IS NOT NULL AND question_id IS NOT NULL AND turn IS NOT NULL GROUP BY 1, 2),
m AS (SELECT t.run_id, t.question_id, len(p.acts) AS n, p.run_id AS c FROM t JOIN t p ON t.question_id = p.question_id AND len(p.acts) <= 4 AND t.acts[1:len(p.acts)] = p.acts),
b AS (SELECT *, row_number() OVER (PARTITION BY run_id, question_id ORDER BY n DESC, c) AS r FROM m)
SELECT t.run_id, t.question_id, coalesce(n, 0) AS matched, c AS context FROM t LEFT JOIN b ON b.run_id = t.run_id AND b.question_id = t.question_id AND r = 1""",
    "merged_sources": f"{_S}, x AS (SELECT question_id, {_TRIM} AS source, arm, turn, log_id FROM s WHERE run_id IS NOT NULL AND action = 'browse' AND source IS NOT NULL) SELECT question_id, source, string_agg(DISTINCT arm, ',' ORDER BY arm) AS tools, arg_min(log_id, (turn, log_id)) AS first FROM x GROUP BY 1, 2",
    "batch_violations": """SELECT 'null_run_id' AS rule, count(*) FILTER (run_id IS NULL) AS n FROM case_steps UNION ALL SELECT 'null_question_id', count(*) FILTER (question_id IS NULL) FROM case_steps UNION ALL SELECT 'null_executed_action', count(*) FILTER (executed_action IS NULL) FROM case_steps UNION ALL SELECT 'null_error_code', count(*) FILTER (error_code IS NULL) FROM case_steps
UNION ALL SELECT 'repeated_identity', CAST(sum(c - 1) AS BIGINT) FROM (SELECT count(*) AS c FROM case_steps GROUP BY run_id, turn, executed_action) UNION ALL SELECT 'gap', CAST(sum(g) AS BIGINT) FROM (SELECT max(turn) - min(turn) + 1 - count(DISTINCT turn) AS g FROM case_steps WHERE run_id IS NOT NULL AND turn IS NOT NULL GROUP BY run_id)""",
    "registry_lookup": "WITH g AS (SELECT DISTINCT title, coalesce(pub_year, '') AS y FROM paper_rows WHERE paper_row_id % 3 = 0 AND title IS NOT NULL) SELECT channel, count(*) FILTER (g.title IS NOT NULL) AS trusted, count(*) AS n FROM paper_rows p LEFT JOIN g ON coalesce(p.title, '') = g.title AND coalesce(p.pub_year, '') = g.y GROUP BY 1",
    "judge_cache": f"WITH {_CELLS}, c AS (SELECT question_id, arm, max(process_score) FILTER (status = 'complete') AS v, bool_or(coalesce(status = 'complete' AND process_score IS NOT NULL, false)) AS ok FROM eval_cells WHERE question_id IS NOT NULL AND arm IS NOT NULL AND cell_id % 3 = 0 GROUP BY 1, 2) SELECT cell_id, round(v, 6) AS cached, CASE WHEN ok THEN 'hit' WHEN ok IS NOT NULL THEN 'stale' ELSE 'miss' END AS status FROM cells LEFT JOIN c USING (question_id, arm)",
    "retry_outcomes": """WITH r AS (SELECT run_id, coalesce(feedback_status = 'ok', false) AS ok, coalesce(retryable, false) AS again, row_number() OVER (PARTITION BY run_id ORDER BY turn, log_id) AS n FROM case_steps WHERE run_id IS NOT NULL),
g AS (SELECT run_id, count(*) AS attempts, min(n) FILTER (ok) AS f, min(n) FILTER (NOT ok AND NOT again) AS e FROM r GROUP BY 1), x AS (SELECT *, coalesce(f, 1e9) AS f1, coalesce(e, 1e9) AS e1 FROM g),
y AS (SELECT *, CASE WHEN f1 <= 3 AND f1 < e1 THEN 'ok' WHEN e1 <= 3 AND e1 < f1 THEN 'not_retryable' WHEN attempts >= 3 THEN 'exhausted' ELSE 'open' END AS outcome FROM x)
SELECT run_id, attempts, CASE WHEN outcome = 'ok' THEN f END AS first_ok, outcome FROM y""",
    "execution_binding": f"{_S}, c AS (SELECT run_id, coalesce(query, '') AS q, error_code, turn, log_id FROM s WHERE run_id IS NOT NULL AND action = 'search'), a AS (SELECT run_id, q, row_number() OVER (PARTITION BY run_id ORDER BY turn, log_id) AS k FROM c), b AS (SELECT run_id, q, row_number() OVER (PARTITION BY run_id ORDER BY turn, log_id) AS k FROM c WHERE coalesce(error_code, '') <> 'E_DUP') SELECT run_id, count(*) FILTER (b.k IS NOT NULL AND a.q = b.q) AS bound, count(*) FILTER (NOT (b.k IS NOT NULL AND a.q = b.q)) AS unbound FROM a LEFT JOIN b USING (run_id, k) GROUP BY 1",
    "decision_records": f"{_S}, x AS (SELECT log_id, question_id, coalesce(channel, action) AS ch, count(*) FILTER (action IN ('search', 'stop')) OVER (PARTITION BY run_id ORDER BY turn, log_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS i FROM s WHERE run_id IS NOT NULL) SELECT log_id, i AS decision_idx, CASE WHEN ch = 'stop' THEN NULL WHEN ch IN ('web', 'paper') THEN concat_ws('|', question_id, 'task', i) ELSE concat_ws('|', question_id, ch) END AS baseline FROM x",
    "combined_advantage": f"""WITH {_CELLS}, p AS (SELECT question_id, arm, avg(benchmark_score / 10) AS f FROM cells GROUP BY 1, 2), t AS (SELECT question_id, sum(f) AS s, count(f) AS n FROM p GROUP BY 1),
x AS (SELECT c.cell_id, process_reward - 0.5 AS l, f - (s - f) / nullif(n - 1, 0) AS fa, count(*) OVER (PARTITION BY c.question_id, c.arm, coalesce(bench, 'none')) AS z FROM cells c JOIN p USING (question_id, arm) JOIN t USING (question_id))
SELECT cell_id, round(fa, 6) AS final_advantage, round(0.3 * coalesce(l, 0) + 0.7 * coalesce(fa, 0), 6) AS advantage, l IS NOT NULL OR fa IS NOT NULL AS observed, round(1.0 / z, 6) AS loss_weight FROM x""",
    "reward_events": f"{_S} SELECT log_id, round(turn / 10.0 + 0.2 * (len(new_evidence_ids) / 4.0) - 0.01 * turn, 6) AS reward, CASE WHEN action = 'stop' THEN round(0.5 * (2 * (len(new_evidence_ids) / 4.0) - 1), 6) END AS stop, round(CASE WHEN action IN ('search', 'browse') THEN -0.01 ELSE 0 END + CASE WHEN feedback_status <> 'ok' THEN -0.1 ELSE 0 END, 6) AS cost, 8 * 4 * turn AS denominator FROM s",
    "masked_log_probs": "WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v FROM embeddings), k AS (SELECT * FROM x WHERE v > CAST(0.05 AS DOUBLE)), g AS (SELECT vec_id, max(v) AS m, count(*) AS n, ln(sum(exp(v))) AS z FROM k GROUP BY 1) SELECT e.vec_id, round(m - z, 5) AS top, coalesce(n, 0) AS n FROM embeddings e LEFT JOIN g USING (vec_id)",
    "acceptance_subset": """WITH r AS (SELECT question_id, log_id, arm, coalesce(feedback_status = 'error', false) AS bad, row_number() OVER (PARTITION BY question_id ORDER BY length(executed_action) DESC NULLS LAST, log_id) AS l FROM case_steps WHERE question_id IS NOT NULL),
p AS (SELECT *, row_number() OVER (PARTITION BY question_id, bad ORDER BY log_id) AS f, row_number() OVER (PARTITION BY question_id, arm ORDER BY log_id) AS s FROM r),
q AS (SELECT question_id, log_id, row_number() OVER (PARTITION BY question_id ORDER BY CASE WHEN l = 1 THEN 0 WHEN bad AND f = 1 THEN 1 WHEN s = 1 THEN 2 ELSE 3 END, log_id) AS pick FROM p) SELECT * FROM q WHERE pick <= 8""",
}
