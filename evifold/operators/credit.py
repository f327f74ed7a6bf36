"""Coverage scores, returns, advantages and losses; NULL means unobserved and is never zero (COV, ADV)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evifold.functions.ordered import running


def strict_mean(x: Column) -> Column:
    """Mean of a group that is NULL as soon as one value is unobserved; NULL for an empty group."""
    return F.when(F.count(F.lit(1)) == F.count(x), F.avg(x))


def weighted_coverage(value: Column, weight: Column, unobservable: Column) -> Column:
    """Weighted mean of coverage values, NULL if any item is unobservable or the weights sum to nothing."""
    return F.when(F.bool_or(unobservable), F.lit(None).cast("double")).otherwise(F.sum(value * weight) / F.nullif(F.sum(weight), F.lit(0.0)))


def status_value(status: Column, direct: list[str], partial: list[str], none: list[str]) -> Column:
    """1 for direct, 0.5 for partial, 0 for none; NULL for all other and NULL states."""
    return F.when(status.isin(direct), 1.0).when(status.isin(partial), 0.5).when(status.isin(none), 0.0)


def return_to_go(df: DataFrame, run: list[str], order: list[str], reward: str) -> DataFrame:
    """``df`` with ``rtg``: sum of this and all later rewards of the run, NULL where one of them is unobserved.

    A run may hold most of the rows; ``order`` must tell its rows apart.
    """
    own = F.col(reward)
    later = running(df, run, [F.desc(o) for o in order], before={"_later": own, "_unknown": own.isNull().cast("int")})
    return later.withColumn("rtg", F.when(F.col("_unknown") == 0, F.col("_later") + own)).drop("_later", "_unknown")


def discounted_return(rewards: Column, gamma: float, scale: Column, clip: float = 1.0) -> Column:
    """Discounted sum of an ordered array of rewards over ``scale``, clipped; NULL rewards count as 0, an empty array gives 0."""
    total = F.aggregate(F.reverse(rewards), F.lit(0.0), lambda s, x: F.coalesce(x, F.lit(0.0)) + gamma * s)
    return F.greatest(F.lit(-clip), F.least(F.lit(clip), total / scale))


def leave_one_out(df: DataFrame, key: list[str], member: str, score: str) -> DataFrame:
    """``df`` with ``local_advantage``: score minus the mean over the other members of their own means.

    NULL where the score is, or where no other member of the key has a score.
    """
    means = df.where(F.col(score).isNotNull()).groupBy(*key, member).agg(F.avg(score).alias("_mean"))
    totals = means.groupBy(*key).agg(F.sum("_mean").alias("_sum"), F.count(F.lit(1)).alias("_n"))
    joined = df.join(means, [*key, member], "left").join(totals, key, "left")
    others = F.col("_n") - F.when(F.col("_mean").isNotNull(), 1).otherwise(0)
    rest = (F.col("_sum") - F.coalesce(F.col("_mean"), F.lit(0.0))) / F.nullif(others, F.lit(0))
    return joined.withColumn("local_advantage", F.col(score) - rest).drop("_mean", "_sum", "_n")


def group_advantage(df: DataFrame, group: list[str], reward: str, size: int) -> DataFrame:
    """``df`` with ``advantage`` = reward - mean of the group; the whole group is held (NULL) unless it has ``size`` observed rewards."""
    w = Window.partitionBy(*group)
    whole = (F.count(reward).over(w) == size) & (F.count(F.lit(1)).over(w) == size)
    return df.withColumn("advantage", F.when(whole, F.col(reward) - F.avg(reward).over(w)))


def standard_advantage(df: DataFrame, group: list[str], reward: str, epsilon: float = 1e-8) -> DataFrame:
    """``df`` with ``advantage`` = (reward - mean) / (population deviation + epsilon) for groups of two or more, else NULL."""
    w = Window.partitionBy(*group)
    return df.withColumn("advantage", F.when(F.count(reward).over(w) >= 2, (F.col(reward) - F.avg(reward).over(w)) / (F.stddev_pop(reward).over(w) + epsilon)))


def clipped_surrogate(ratio: Column, advantage: Column, clip: float = 0.2) -> Column:
    """min(ratio * A, clip(ratio, 1 - c, 1 + c) * A)."""
    return F.least(ratio * advantage, F.greatest(F.lit(1 - clip), F.least(F.lit(1 + clip), ratio)) * advantage)


def k3_divergence(delta: Column) -> Column:
    """exp(d) - 1 - d, the non-negative estimate of a divergence from a difference of log-probabilities."""
    return F.exp(delta) - 1 - delta


def token_surrogate(current: Column, old: Column, behaviour: Column, advantage: Column, cap: float = 2.0, clip: float = 0.2) -> Column:
    """Per-token truncated importance weight times clipped surrogate over three arrays of log-probabilities of equal length."""
    rows = F.arrays_zip(current.alias("c"), old.alias("o"), behaviour.alias("b"))
    return F.transform(rows, lambda t: F.least(F.exp(t["o"] - t["b"]), F.lit(cap)) * clipped_surrogate(F.exp(t["c"] - t["o"]), advantage, clip))


def effective_sample_share(weight: Column) -> Column:
    """(sum w)^2 / (n * sum w^2) of a group."""
    return F.sum(weight) * F.sum(weight) / (F.count(weight) * F.sum(weight * weight))


def surrogate_loss(delta: Column, advantage: Column, clip: float = 0.2, most: float = 20.0) -> Column:
    """Negative mean of the clipped surrogate over a group of differences of log-probabilities; NULL where one is beyond ``most``, as exp() of it says nothing."""
    return F.when(F.max(F.abs(delta)) <= most, -F.avg(clipped_surrogate(F.exp(delta), advantage, clip)))


def weights_held(raw: Column, cap: float, most_capped: float = 0.05, least_share: float = 0.8) -> Column:
    """Whether a group is held back: more than ``most_capped`` of its raw weights beyond the cap, or an effective share under ``least_share``."""
    return (F.avg((raw > cap).cast("double")) > most_capped) | (effective_sample_share(F.least(raw, F.lit(cap))) < least_share)
