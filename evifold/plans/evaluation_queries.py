"""Queries of coverage, credit and evaluation, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evifold.operators import credit as C
from evifold.operators import evaluation as V
from evifold.plans.event_queries import _STEPS, steps
from evifold.sources.tables import table

_KEY = ["round_no", "question_id", "arm"]


def cells(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "eval_cells").where("question_id is not null and arm is not null")
    return V.latest_cells(rows, _KEY, [F.desc("ingested_at"), F.desc("cell_id")])


_CELLS = "cells AS (SELECT * EXCLUDE r FROM (SELECT *, row_number() OVER (PARTITION BY round_no, question_id, arm ORDER BY ingested_at DESC, cell_id DESC) AS r FROM eval_cells WHERE question_id IS NOT NULL AND arm IS NOT NULL) WHERE r = 1)"


def grid_summary(spark: SparkSession, d: str) -> DataFrame:
    grid = V.full_grid(cells(spark, d), ["round_no", "question_id"], "arm", ["status", "benchmark_score", "process_score"])
    return grid.groupBy("arm").agg(
        F.count(F.lit(1)).alias("planned"), F.count("status").alias("present"), F.count("benchmark_score").alias("scored"), F.count_if(F.col("status") == "complete").alias("complete"),
        F.round(F.count_if(F.col("status") == "complete") / F.count(F.lit(1)), 6).alias("completion_rate"), F.round(F.avg("benchmark_score"), 6).alias("raw_mean"),
        F.round(F.greatest(F.lit(0.0), F.avg("benchmark_score")), 6).alias("clipped_mean"), F.round(F.coalesce(F.sum("benchmark_score"), F.lit(0.0)) / F.count(F.lit(1)), 6).alias("yield"),
        F.round(F.avg("process_score"), 6).alias("process_mean"),
    )


def paired_wins(spark: SparkSession, d: str) -> DataFrame:
    pairs = V.paired(cells(spark, d), ["round_no", "question_id"], "arm", "benchmark_score")
    return pairs.select("arm_a", "arm_b", "common", *(F.round(c, 6).alias(c) for c in ("mean_a", "mean_b", "delta")), "a_wins", "b_wins", "ties")


def common_valid(spark: SparkSession, d: str) -> DataFrame:
    return V.complete_questions(cells(spark, d), ["round_no", "question_id"], "arm", "benchmark_score", 4)


def clipped_mean_rollup(spark: SparkSession, d: str) -> DataFrame:
    rows = cells(spark, d).withColumn("bench", F.coalesce("bench", F.lit("unknown")))
    rolled = rows.rollup("arm", "bench").agg(F.round(V.clipped_mean(F.col("benchmark_score")), 6).alias("score"), F.count("benchmark_score").alias("n"), F.grouping_id().alias("level"))
    return rolled.select("arm", "bench", "score", "n", F.col("level").cast("bigint").alias("level"))


def status_pivot(spark: SparkSession, d: str) -> DataFrame:
    names = ["complete", "process_failure", "final_failure"]
    wide = cells(spark, d).groupBy("bench").pivot("status", names).count()
    return wide.select("bench", *(F.coalesce(n, F.lit(0)).alias(n) for n in names))


def rubric_score_by_tag(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("tag"), (F.col("l_quantity") - 10).alias("points"), (F.col("l_linestatus") == "O").alias("met"))
    return rows.groupBy("tag").agg(F.round(V.rubric_score(F.col("points"), F.col("met")), 6).alias("score"), F.count(F.lit(1)).alias("n"))


def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    rows = cells(spark, d)
    base = rows.groupBy("round_no", "question_id").agg(F.min_by("benchmark_score", F.when(F.col("benchmark_score").isNotNull(), F.col("arm"))).alias("base"))
    deltas = rows.join(base, ["round_no", "question_id"]).select("arm", F.concat_ws("/", "round_no", "question_id").alias("q"), (F.col("benchmark_score") - F.col("base")).alias("delta"))
    out = V.bootstrap_interval(deltas, ["arm"], "q", "delta")
    return out.select("arm", "n", *(F.round(c, 6).alias(c) for c in ("mean", "low", "high")))


def bootstrap_deviation(spark: SparkSession, d: str) -> DataFrame:
    rows = cells(spark, d).select("arm", F.concat_ws("/", "round_no", "question_id").alias("q"), (F.col("benchmark_score") / 10).alias("x"))
    out = V.bootstrap_deviation(rows, ["arm"], "q", "x", 500)
    return out.select("arm", "n", F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation"))


def leave_one_question(spark: SparkSession, d: str) -> DataFrame:
    """Mean of each arm without the questions of each benchmark in turn."""
    rows = cells(spark, d).where("benchmark_score is not null").withColumn("bench", F.coalesce("bench", F.lit("unknown")))
    by = rows.groupBy("arm", "bench").agg(F.sum("benchmark_score").alias("s"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("arm")
    return by.select("arm", F.col("bench").alias("without"), F.round((F.sum("s").over(w) - F.col("s")) / F.nullif(F.sum("n").over(w) - F.col("n"), F.lit(0)), 6).alias("score"))


def weighted_coverage(spark: SparkSession, d: str) -> DataFrame:
    s = steps(spark, d).where("question_id is not null")
    value = C.status_value(F.col("feedback_status"), ["ok"], ["empty"], ["environment_failure", "source_unreadable"])
    return s.groupBy("question_id", "arm").agg(F.round(C.weighted_coverage(value, F.coalesce(F.col("turn"), F.lit(0)).cast("double"), F.col("feedback_status").isNull()), 6).alias("coverage"), F.count(F.lit(1)).alias("n"))


def strict_process_mean(spark: SparkSession, d: str) -> DataFrame:
    return cells(spark, d).groupBy("question_id", "arm").agg(F.round(C.strict_mean(F.col("process_score")), 6).alias("mean"), F.count(F.lit(1)).alias("n"))


def coverage_gain(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("question_id", "arm").orderBy("round_no")
    rows = cells(spark, d).withColumn("before", F.lag("process_score").over(w))
    return rows.where("before is not null and process_score is not null").groupBy("arm", "round_no").agg(F.round(F.avg(F.col("process_score") - F.col("before")), 6).alias("gain"), F.count(F.lit(1)).alias("n"))


def slot_first_support(spark: SparkSession, d: str) -> DataFrame:
    s = steps(spark, d).where("run_id is not null and feedback_status = 'ok'").select("run_id", "turn", "log_id", F.explode("a.requirement_ids").alias("slot"))
    return s.groupBy("run_id", "slot").agg(F.min(F.struct("turn", "log_id")).alias("at")).select("run_id", "slot", F.col("at.turn").alias("turn"), F.col("at.log_id").alias("log_id"))


def return_to_go(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events").withColumn("reward", F.when(F.col("event_type") != "error", F.col("value")))
    return C.return_to_go(ev, ["user_id"], ["ts", "event_id"], "reward").select("event_id", "user_id", F.round("rtg", 4).alias("rtg"))


def discounted_return(spark: SparkSession, d: str) -> DataFrame:
    rows = cells(spark, d).groupBy("question_id", "arm").agg(F.array_sort(F.collect_list(F.struct("round_no", "process_reward"))).alias("l"))
    return rows.select("question_id", "arm", F.round(C.discounted_return(F.transform("l", lambda x: x["process_reward"]), 0.9, F.lit(2.0)), 6).alias("ret"))


def loo_advantage(spark: SparkSession, d: str) -> DataFrame:
    rows = C.leave_one_out(cells(spark, d), ["question_id"], "arm", "process_reward")
    return rows.select("cell_id", F.round("local_advantage", 6).alias("local_advantage"))


def group_advantage(spark: SparkSession, d: str) -> DataFrame:
    rows = C.group_advantage(cells(spark, d), ["round_no", "question_id"], "process_reward", 4)
    return rows.select("cell_id", F.round("advantage", 6).alias("advantage"))


def std_advantage(spark: SparkSession, d: str) -> DataFrame:
    rows = C.standard_advantage(table(spark, d, "orders"), ["o_custkey"], "o_totalprice")
    return rows.select("o_orderkey", F.round("advantage", 6).alias("advantage"))


def clipped_surrogate(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_discount") - F.col("l_tax")).alias("delta"), (F.col("l_quantity") / 50 - 0.5).alias("a"))
    return rows.groupBy("l_orderkey").agg(F.round(C.surrogate_loss(F.col("delta") * 300, F.col("a")), 6).alias("loss"), F.round(F.avg(C.k3_divergence(F.col("delta"))), 6).alias("kl"))


def is_weights_ess(spark: SparkSession, d: str) -> DataFrame:
    raw = F.exp(5 * (F.col("l_discount") - F.col("l_tax")))
    rows = table(spark, d, "lineitem").select("l_returnflag", raw.alias("raw"), F.least(raw, F.lit(1.2)).alias("w"))
    return rows.groupBy("l_returnflag").agg(F.round(C.effective_sample_share(F.col("w")), 6).alias("ess"), F.round(F.avg((F.col("raw") > 1.2).cast("double")), 6).alias("capped"), F.count(F.lit(1)).alias("n"), C.weights_held(F.col("raw"), 1.2).alias("held"))


def learning_signal(spark: SparkSession, d: str) -> DataFrame:
    rows = C.group_advantage(cells(spark, d), ["round_no", "question_id"], "process_reward", 4)
    return rows.groupBy("question_id").agg(F.coalesce(F.bool_or(F.col("advantage") != 0), F.lit(False)).alias("has_signal"))


def citation_min_group_mean(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null")
    groups = docs.groupBy("source", F.sha2(F.trim(F.regexp_replace(F.lower("text"), r"\s+", " ")), 256).alias("h")).agg(F.min("score").alias("low"), F.count(F.lit(1)).alias("n"), F.count("score").alias("k"))
    return groups.withColumn("low", F.when(F.col("n") == F.col("k"), F.col("low"))).groupBy("source").agg(F.round(C.strict_mean(F.col("low")), 6).alias("strict"), F.count(F.lit(1)).alias("claims"), F.round(F.avg("low"), 6).alias("loose"))


def pairwise_winner(spark: SparkSession, d: str) -> DataFrame:
    rows = cells(spark, d).where("benchmark_score is not null").groupBy("round_no", "question_id").agg(F.max("benchmark_score").alias("top"), F.max_by("arm", F.struct("benchmark_score", "arm")).alias("winner"), F.sort_array(F.collect_list("benchmark_score")).alias("l"))
    tied = (F.size("l") > 1) & (F.element_at("l", -1) == F.try_element_at("l", F.lit(-2)))
    return rows.select("round_no", "question_id", F.when(~F.coalesce(tied, F.lit(False)), F.col("winner")).alias("winner"))


QUERIES = {f.__name__: f for f in (grid_summary, paired_wins, common_valid, clipped_mean_rollup, status_pivot, rubric_score_by_tag, bootstrap_ci, bootstrap_deviation, leave_one_question, weighted_coverage, strict_process_mean, coverage_gain, slot_first_support, return_to_go, discounted_return, loo_advantage, group_advantage, std_advantage, clipped_surrogate, is_weights_ess, learning_signal, citation_min_group_mean, pairwise_winner)}

_VALUE = "CASE WHEN feedback_status = 'ok' THEN 1.0 WHEN feedback_status = 'empty' THEN 0.5 WHEN feedback_status IN ('environment_failure', 'source_unreadable') THEN 0.0 END"
_GRP = f"WITH {_CELLS}, a AS (SELECT *, CASE WHEN count(process_reward) OVER w = 4 AND count(*) OVER w = 4 THEN process_reward - avg(process_reward) OVER w END AS adv FROM cells WINDOW w AS (PARTITION BY round_no, question_id))"
_DRAWS = ", ".join(f"{{'i': {i}, 'x': CAST('0x' || substring(h, {8 * i + 1}, 8) AS BIGINT)}}" for i in range(4))
SQL = {
    "bootstrap_deviation": f"""WITH {_CELLS}, d AS (SELECT arm, round_no || '/' || question_id AS q, benchmark_score / 10 AS x FROM cells), p AS (SELECT arm, x, row_number() OVER (PARTITION BY arm ORDER BY q, x) AS pos FROM d WHERE x IS NOT NULL),
n AS (SELECT arm, count(*) AS n, avg(x) AS mean FROM p GROUP BY 1), j AS (SELECT arm, n, r, unnest(range((n - 1) // 4 + 1)) AS j FROM (SELECT arm, n, unnest(range(500)) AS r FROM n)),
h AS (SELECT *, md5('20261026|' || r || '|' || j) AS h FROM j), z AS (SELECT arm, n, r, j, unnest([{_DRAWS}]) AS z FROM h), k AS (SELECT arm, r, z.x % n + 1 AS pos FROM z WHERE 4 * j + z.i < n),
m AS (SELECT arm, r, greatest(0.0, least(1.0, avg(x))) AS m FROM k JOIN p USING (arm, pos) GROUP BY 1, 2)
SELECT arm, n.n, round(greatest(0.0, least(1.0, n.mean)), 6) AS mean, round(stddev_pop(m), 6) AS deviation FROM m JOIN n USING (arm) GROUP BY 1, 2, n.mean""",
    "bootstrap_ci": f"""WITH {_CELLS}, b AS (SELECT round_no, question_id, arg_min(benchmark_score, arm) FILTER (benchmark_score IS NOT NULL) AS base FROM cells GROUP BY 1, 2),
d AS (SELECT arm, round_no || '/' || question_id AS q, benchmark_score - base AS x FROM cells JOIN b USING (round_no, question_id)), p AS (SELECT arm, x, row_number() OVER (PARTITION BY arm ORDER BY q, x) AS pos FROM d WHERE x IS NOT NULL),
n AS (SELECT arm, count(*) AS n, avg(x) AS mean FROM p GROUP BY 1), j AS (SELECT arm, n, r, unnest(range((n - 1) // 4 + 1)) AS j FROM (SELECT arm, n, unnest(range(2000)) AS r FROM n)),
h AS (SELECT *, md5('20261026|' || r || '|' || j) AS h FROM j), z AS (SELECT arm, n, r, j, unnest([{_DRAWS}]) AS z FROM h), k AS (SELECT arm, r, z.x % n + 1 AS pos FROM z WHERE 4 * j + z.i < n),
m AS (SELECT arm, r, avg(x) AS m FROM k JOIN p USING (arm, pos) GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY arm ORDER BY m, r) AS i FROM m)
SELECT arm, n.n, round(n.mean, 6) AS mean, round(max(m) FILTER (i = 50), 6) AS low, round(max(m) FILTER (i = 1950), 6) AS high FROM o JOIN n USING (arm) GROUP BY 1, 2, n.mean""",
    "grid_summary": f"WITH {_CELLS}, g AS (SELECT * FROM (SELECT DISTINCT round_no, question_id FROM cells), (SELECT DISTINCT arm FROM cells)), x AS (SELECT g.arm, status, benchmark_score, process_score FROM g LEFT JOIN cells c ON c.round_no IS NOT DISTINCT FROM g.round_no AND c.question_id = g.question_id AND c.arm = g.arm) SELECT arm, count(*) AS planned, count(status) AS present, count(benchmark_score) AS scored, count(*) FILTER (status = 'complete') AS complete, round(count(*) FILTER (status = 'complete') / count(*), 6) AS completion_rate, round(avg(benchmark_score), 6) AS raw_mean, round(greatest(0.0, avg(benchmark_score)), 6) AS clipped_mean, round(coalesce(sum(benchmark_score), 0.0) / count(*), 6) AS yield, round(avg(process_score), 6) AS process_mean FROM x GROUP BY arm",
    "paired_wins": f"WITH {_CELLS} SELECT a.arm AS arm_a, b.arm AS arm_b, count(*) AS common, round(avg(a.benchmark_score), 6) AS mean_a, round(avg(b.benchmark_score), 6) AS mean_b, round(avg(b.benchmark_score - a.benchmark_score), 6) AS delta, count(*) FILTER (b.benchmark_score < a.benchmark_score) AS a_wins, count(*) FILTER (b.benchmark_score > a.benchmark_score) AS b_wins, count(*) FILTER (b.benchmark_score = a.benchmark_score) AS ties FROM cells a JOIN cells b ON a.round_no = b.round_no AND a.question_id = b.question_id AND a.arm < b.arm WHERE a.benchmark_score IS NOT NULL AND b.benchmark_score IS NOT NULL GROUP BY ALL",
    "common_valid": f"WITH {_CELLS} SELECT round_no, question_id FROM cells WHERE benchmark_score IS NOT NULL GROUP BY round_no, question_id HAVING count(DISTINCT arm) >= 4",
    "clipped_mean_rollup": f"WITH {_CELLS}, x AS (SELECT arm, coalesce(bench, 'unknown') AS bench, benchmark_score FROM cells) SELECT arm, bench, round(greatest(0.0, least(1.0, avg(benchmark_score))), 6) AS score, count(benchmark_score) AS n, CAST(grouping(arm, bench) AS BIGINT) AS level FROM x GROUP BY ROLLUP (arm, bench)",
    "status_pivot": f"WITH {_CELLS} SELECT bench, count(*) FILTER (status = 'complete') AS complete, count(*) FILTER (status = 'process_failure') AS process_failure, count(*) FILTER (status = 'final_failure') AS final_failure FROM cells GROUP BY bench",
    "rubric_score_by_tag": "SELECT l_returnflag AS tag, round(sum(CASE WHEN l_linestatus = 'O' THEN l_quantity - 10 ELSE 0 END) / nullif(sum(CASE WHEN l_quantity > 10 THEN l_quantity - 10 ELSE 0 END), 0), 6) AS score, count(*) AS n FROM lineitem GROUP BY 1",
    "leave_one_question": f"WITH {_CELLS}, b AS (SELECT arm, coalesce(bench, 'unknown') AS without, sum(benchmark_score) AS s, count(*) AS n FROM cells WHERE benchmark_score IS NOT NULL GROUP BY 1, 2) SELECT arm, without, round((sum(s) OVER w - s) / nullif(sum(n) OVER w - n, 0), 6) AS score FROM b WINDOW w AS (PARTITION BY arm)",
    "weighted_coverage": f"WITH x AS (SELECT question_id, arm, feedback_status, CAST(coalesce(turn, 0) AS DOUBLE) AS w, {_VALUE} AS v FROM case_steps WHERE question_id IS NOT NULL) SELECT question_id, arm, CASE WHEN bool_or(feedback_status IS NULL) THEN NULL ELSE round(sum(v * w) / nullif(sum(w), 0), 6) END AS coverage, count(*) AS n FROM x GROUP BY 1, 2",
    "strict_process_mean": f"WITH {_CELLS} SELECT question_id, arm, CASE WHEN count(*) = count(process_score) THEN round(avg(process_score), 6) END AS mean, count(*) AS n FROM cells GROUP BY 1, 2",
    "coverage_gain": f"WITH {_CELLS}, l AS (SELECT *, lag(process_score) OVER (PARTITION BY question_id, arm ORDER BY round_no) AS before FROM cells) SELECT arm, round_no, round(avg(process_score - before), 6) AS gain, count(*) AS n FROM l WHERE before IS NOT NULL AND process_score IS NOT NULL GROUP BY 1, 2",
    "slot_first_support": f"WITH {_STEPS}, x AS (SELECT run_id, turn, log_id, unnest(CAST(j->'requirement_ids' AS VARCHAR[])) AS slot FROM s WHERE run_id IS NOT NULL AND feedback_status = 'ok'), r AS (SELECT *, row_number() OVER (PARTITION BY run_id, slot ORDER BY turn, log_id) AS o FROM x) SELECT run_id, slot, turn, log_id FROM r WHERE o = 1",
    "return_to_go": "WITH r AS (SELECT *, CASE WHEN event_type <> 'error' THEN value END AS reward FROM events) SELECT event_id, user_id, CASE WHEN count(*) FILTER (reward IS NULL) OVER w = 0 THEN round(sum(reward) OVER w, 4) END AS rtg FROM r WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)",
    "discounted_return": f"WITH {_CELLS}, l AS (SELECT *, row_number() OVER (PARTITION BY question_id, arm ORDER BY round_no) - 1 AS i FROM cells) SELECT question_id, arm, round(greatest(-1.0, least(1.0, sum(coalesce(process_reward, 0) * pow(0.9, i)) / 2.0)), 6) AS ret FROM l GROUP BY 1, 2",
    "loo_advantage": f"WITH {_CELLS}, m AS (SELECT question_id, arm, avg(process_reward) AS x FROM cells WHERE process_reward IS NOT NULL GROUP BY 1, 2), t AS (SELECT question_id, sum(x) AS s, count(*) AS n FROM m GROUP BY 1) SELECT cell_id, round(process_reward - (s - coalesce(x, 0)) / nullif(n - CASE WHEN x IS NULL THEN 0 ELSE 1 END, 0), 6) AS local_advantage FROM cells LEFT JOIN m USING (question_id, arm) LEFT JOIN t USING (question_id)",
    "group_advantage": _GRP + " SELECT cell_id, round(adv, 6) AS advantage FROM a",
    "std_advantage": "SELECT o_orderkey, CASE WHEN count(*) OVER w >= 2 THEN round((o_totalprice - avg(o_totalprice) OVER w) / (stddev_pop(o_totalprice) OVER w + 1e-8), 6) END AS advantage FROM orders WINDOW w AS (PARTITION BY o_custkey)",
    "clipped_surrogate": "WITH r AS (SELECT l_orderkey, l_discount - l_tax AS d, l_quantity / 50 - 0.5 AS a FROM lineitem) SELECT l_orderkey, CASE WHEN max(abs(d * 300)) <= 20 THEN round(-avg(least(exp(d * 300) * a, greatest(0.8, least(1.2, exp(d * 300))) * a)), 6) END AS loss, round(avg(exp(d) - 1 - d), 6) AS kl FROM r GROUP BY 1",
    "is_weights_ess": "WITH r AS (SELECT l_returnflag, exp(5 * (l_discount - l_tax)) AS raw FROM lineitem), w AS (SELECT *, least(raw, 1.2) AS w FROM r) SELECT l_returnflag, round(sum(w) * sum(w) / (count(w) * sum(w * w)), 6) AS ess, round(avg(CAST(raw > 1.2 AS DOUBLE)), 6) AS capped, count(*) AS n, avg(CAST(raw > 1.2 AS DOUBLE)) > 0.05 OR sum(w) * sum(w) / (count(w) * sum(w * w)) < 0.8 AS held FROM w GROUP BY 1",
    "learning_signal": _GRP + " SELECT question_id, coalesce(bool_or(adv <> 0), false) AS has_signal FROM a GROUP BY 1",
    "citation_min_group_mean": r"WITH g AS (SELECT source, CASE WHEN count(*) = count(score) THEN min(score) END AS low FROM documents WHERE text IS NOT NULL GROUP BY source, trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) SELECT source, CASE WHEN count(*) = count(low) THEN round(avg(low), 6) END AS strict, count(*) AS claims, round(avg(low), 6) AS loose FROM g GROUP BY 1",
    "pairwise_winner": f"WITH {_CELLS}, r AS (SELECT round_no, question_id, arm, benchmark_score, max(benchmark_score) OVER w AS top, rank() OVER (PARTITION BY round_no, question_id ORDER BY benchmark_score DESC) AS k FROM cells WHERE benchmark_score IS NOT NULL WINDOW w AS (PARTITION BY round_no, question_id)) SELECT round_no, question_id, CASE WHEN count(*) = 1 THEN min(arm) END AS winner FROM r WHERE k = 1 GROUP BY 1, 2",
}
