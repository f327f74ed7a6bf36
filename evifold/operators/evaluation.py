"""Evaluation statistics with fixed denominators and paired comparisons (EVL)."""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evifold.functions.ordered import numbered, running

#: Most arms that go to all tasks to build a grid; more are joined by the engine as it sees fit.
MAX_ARMS = 1_000
#: Most values, counted first, that go to all tasks to be resampled (16 bytes each); draws from more are joined to them.
RESAMPLED_AT_ONCE = 2_000_000


def latest_cells(cells: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per cell: the first in ``order`` of those written more than once."""
    return cells.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def full_grid(cells: DataFrame, question: list[str], arm: str, keep: list[str]) -> DataFrame:
    """Every question with every arm, missing cells with NULLs; the arms go to all tasks where a count shows them to be few."""
    arms = cells.select(arm).where(F.col(arm).isNotNull()).distinct()
    few = arms.limit(MAX_ARMS + 1).count() <= MAX_ARMS
    questions = cells.select(*question).distinct()
    grid = questions.crossJoin(F.broadcast(arms) if few else arms)
    return grid.join(cells.select(*question, arm, *keep), [*question, arm], "left")


def clipped_mean(x: Column) -> Column:
    """Mean over the observed values, clipped to 0..1; NULL if there are none."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.avg(x)))


def paired(cells: DataFrame, question: list[str], arm: str, score: str, tolerance: float = 0.0) -> DataFrame:
    """(arm_a, arm_b, common, mean_a, mean_b, delta, a_wins, b_wins, ties) over the questions that both arms have scored.

    Per question the arms stand in one array, whose pairs are taken; cells must be unique per question and arm.
    """
    rows = cells.where(F.col(score).isNotNull() & F.col(arm).isNotNull()).groupBy(*question).agg(F.array_sort(F.collect_list(F.struct(F.col(arm).alias("arm"), F.col(score).cast("double").alias("x")))).alias("l"))
    pairs = rows.select(F.explode(F.flatten(F.transform("l", lambda a: F.transform(F.filter("l", lambda b: b["arm"] > a["arm"]), lambda b: F.struct(a["arm"].alias("a"), b["arm"].alias("b"), a["x"].alias("x"), b["x"].alias("y")))))).alias("p"))
    d = F.col("p.y") - F.col("p.x")
    return pairs.groupBy(F.col("p.a").alias("arm_a"), F.col("p.b").alias("arm_b")).agg(
        F.count(F.lit(1)).alias("common"), F.avg("p.x").alias("mean_a"), F.avg("p.y").alias("mean_b"), F.avg(d).alias("delta"),
        F.count_if(d < -tolerance).alias("a_wins"), F.count_if(d > tolerance).alias("b_wins"), F.count_if(F.abs(d) <= tolerance).alias("ties"),
    )


def rubric_score(points: Column, met: Column) -> Column:
    """Points of the criteria that are met over all positive points; NULL without positive points; may be negative."""
    return F.sum(F.when(met, points).otherwise(0.0)) / F.nullif(F.sum(F.when(points > 0, points).otherwise(0.0)), F.lit(0.0))


def _means_by_task(rows: DataFrame, group: list[str], resamples: int, seed: int) -> DataFrame:
    """(group, r, m): means of the resamples, each task drawing some of them from all values, which are few."""
    held = rows.orderBy(*group, "_q", "_d").toPandas()
    keys = rows.select(*group)
    listed = [(key if isinstance(key, tuple) else (key,), part["_d"].to_numpy()) for key, part in (held.groupby(group, dropna=False, sort=False) if group else [((), held)])]
    shared = rows.sparkSession.sparkContext.broadcast(listed)
    most = max((len(x) for _, x in listed), default=0)
    schema = T.StructType([*keys.schema.fields, T.StructField("r", T.LongType()), T.StructField("m", T.DoubleType())])

    def draw(batches):
        for pdf in batches:
            out = []
            for r in pdf["r"]:
                digests = b"".join(hashlib.md5(f"{seed}|{r}|{j}".encode()).digest() for j in range(-(-most // 4)))
                x = np.frombuffer(digests, ">u4").astype(np.int64)
                out += [(*key, r, values[x[: len(values)] % len(values)].mean()) for key, values in shared.value if len(values)]
            yield pd.DataFrame(out, columns=schema.names)

    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.sparkSession.range(0, resamples, 1, min(resamples, 4 * cores)).withColumnRenamed("id", "r").mapInPandas(draw, schema)


def _means_by_join(rows: DataFrame, sizes: DataFrame, group: list[str], resamples: int, seed: int) -> DataFrame:
    """(group, r, m): means of the resamples, each draw joined to the value at its place."""
    placed = running(rows, group, [F.col("_q"), F.col("_d")], "_at")
    repeats = sizes.select(*group, "n", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("r"))
    quads = repeats.select(*group, "n", "r", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / 4))).alias("j"))
    digest = quads.withColumn("_h", F.md5(F.concat_ws("|", F.lit(str(seed)), "r", "j")))
    draw = [F.conv(F.substring("_h", 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]
    kept = F.filter(F.array(*(F.struct(F.lit(i).alias("i"), x.alias("x")) for i, x in enumerate(draw))), lambda z: 4 * F.col("j") + z["i"] < F.col("n"))
    drawn = digest.select(*group, "n", "r", F.explode(kept).alias("z")).select(*group, "r", (F.pmod(F.col("z.x"), F.col("n")) + 1).alias("_at"))
    return drawn.join(placed, [*group, "_at"]).groupBy(*group, "r").agg(F.avg("_d").alias("m"))


def _resampled(deltas: DataFrame, group: list[str], question: str, delta: str, resamples: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(group, n, mean) of the values, and (group, r, m) of their resamples."""
    rows = deltas.where(F.col(delta).isNotNull()).select(*group, F.col(question).alias("_q"), F.col(delta).cast("double").alias("_d"))
    sizes = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.avg("_d").alias("mean"))
    few = rows.limit(RESAMPLED_AT_ONCE + 1).count() <= RESAMPLED_AT_ONCE
    means = _means_by_task(rows, group, resamples, seed) if few else _means_by_join(rows, sizes, group, resamples, seed)
    return sizes, means


def bootstrap_deviation(scores: DataFrame, group: list[str], question: str, score: str, resamples: int = 1_000, seed: int = 20_261_026) -> DataFrame:
    """(group, n, mean, deviation): mean clipped to 0..1, and the population deviation of the clipped means of the resamples.

    Resamples are drawn as in :func:`bootstrap_interval`; NULL scores are left out.
    """
    sizes, means = _resampled(scores, group, question, score, resamples, seed)
    clipped = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    spread = means.groupBy(*group).agg(F.stddev_pop(clipped(F.col("m"))).alias("deviation"))
    return sizes.withColumn("mean", clipped(F.col("mean"))).join(spread, group)


def bootstrap_interval(deltas: DataFrame, group: list[str], question: str, delta: str, resamples: int = 2_000, seed: int = 20_261_026) -> DataFrame:
    """(group, n, mean, low, high): percentile interval of the mean delta over ``resamples`` resamples of the questions.

    Each resample draws as many questions as the group has, with replacement. Draw k of resample r is the question at the
    place that the MD5 digest of 'seed|r|k/4' gives, 8 hex digits for each of four draws, so a run repeats on any cluster
    and in any engine; places follow the question. Up to RESAMPLED_AT_ONCE values go to all tasks, of which each draws whole
    resamples; beyond that the draws are joined to the values. The bounds are the sorted
    means at 2.5 and 97.5 per cent, the 50th and the 1,950th of 2,000. NULL deltas are left out.
    """
    sizes, means = _resampled(deltas, group, question, delta, resamples, seed)
    at = lambda q: max(1, min(resamples, int(np.ceil(resamples * q))))
    ranked = means.withColumn("_k", F.row_number().over(Window.partitionBy(*group).orderBy("m", "r")))
    bounds = ranked.groupBy(*group).agg(F.max(F.when(F.col("_k") == at(0.025), F.col("m"))).alias("low"), F.max(F.when(F.col("_k") == at(0.975), F.col("m"))).alias("high"))
    return sizes.join(bounds, group) if group else sizes.crossJoin(bounds)


def complete_questions(cells: DataFrame, question: list[str], arm: str, score: str, arms: int) -> DataFrame:
    """Questions scored in at least ``arms`` arms."""
    return cells.where(F.col(score).isNotNull()).groupBy(*question).agg(F.countDistinct(arm).alias("n")).where(F.col("n") >= arms).drop("n")


def rotated_order(cells: DataFrame, question: str, arm: str, block: int = 5) -> DataFrame:
    """``cells`` with (block_no, slot): work order in blocks of questions, the arms rotated left by the number of the block."""
    asked = numbered(cells.select(question).where(F.col(question).isNotNull()).distinct(), [F.col(question)], "_q")
    indexed = cells.join(asked, question).withColumn("block_no", F.floor(F.col("_q") / block))
    arms = numbered(cells.select(arm).where(F.col(arm).isNotNull()).distinct(), [F.col(arm)], "_a")
    n = arms.agg(F.count(F.lit(1)).alias("_n"))
    return indexed.join(arms, arm).crossJoin(F.broadcast(n)).withColumn("slot", F.pmod(F.col("_a") - F.col("block_no"), F.col("_n"))).drop("_q", "_a", "_n")


def length_adjusted(score: Column, length: Column, penalty: float, centre: float) -> Column:
    """Score less ``penalty`` for each 500 characters beyond ``centre``, more for fewer; NULL where one is unobserved."""
    return score - penalty * (length - centre) / 500


def fully_covered(points: Column, most: int = 2) -> Column:
    """Whether all points of a group have the highest score; NULL scores don't."""
    return F.bool_and(F.coalesce(points == most, F.lit(False)))


def graded(answer: Column) -> Column:
    """Verdict of a grader's JSON answer {"criteria_met": true, "explanation": "..."}, fenced or not; NULL for anything else."""
    bare = F.regexp_replace(F.trim(answer), r"^```(?:json)?\s*|\s*```$", "")
    parsed = F.from_json(bare, "criteria_met boolean, explanation string, _broken string", {"columnNameOfCorruptRecord": "_broken", "mode": "PERMISSIVE"})
    return F.when(parsed["_broken"].isNull(), parsed["criteria_met"])


def retained_process(status: Column, score: Column) -> Column:
    """Process score that keeps a failure of the process as 0 and is NULL on an engineering hold."""
    return F.when(status == "held", F.lit(None).cast("double")).when(status == "failed", 0.0).otherwise(score)


def recomputed(stated: DataFrame, computed: DataFrame, keys: list[str], metrics: list[str], tolerance: float = 1e-8) -> DataFrame:
    """(keys, metric, stated, computed): every published figure that recomputing doesn't give, to ``tolerance``; a missing side is NULL.

    Two NULLs agree. Figures that agree give no row.
    """
    def long(df: DataFrame, name: str) -> DataFrame:
        return df.select(*keys, F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias(name)) for m in metrics))).alias("z")).select(*keys, "z.*")

    both = long(stated, "stated").join(long(computed, "computed"), [*keys, "metric"], "full")
    return both.where(~((F.abs(F.col("stated") - F.col("computed")) <= tolerance) | F.col("stated").isNull() & F.col("computed").isNull()).eqNullSafe(True))


def expanded_examples(df: DataFrame, id_col: str, completions: str, size: int, repeats: int, seed: str, exactly: int | None = None) -> DataFrame:
    """(id, copy, completion_no, completion): a sample of ``size`` examples, one row for each reference completion and copy.

    With ``exactly`` only examples with that many completions take part. The sample takes the smallest SHA-256 digests
    of 'seed|id', which any number of tasks can find together.
    """
    fit = df if exactly is None else df.where(F.size(completions) == exactly)
    ranked = fit.select(id_col, completions, F.sha2(F.concat_ws("|", F.lit(seed), F.col(id_col).cast("string")), 256).alias("_h")).orderBy("_h", id_col).limit(size)
    copies = ranked.select(id_col, completions, F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("copy"))
    return copies.select(id_col, "copy", F.posexplode(completions).alias("completion_no", "completion"))


def completion_id(prompt: Column, text: Column) -> Column:
    """SHA-256 of prompt and completion; NULLs count as empty."""
    return F.sha2(F.concat(F.coalesce(prompt, F.lit("")), F.coalesce(text, F.lit(""))), 256)


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)
