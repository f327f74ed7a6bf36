"""Joins and checks over the ledgers of agent runs: histories, attempts, receipts, bindings, batches (EVT, INT, ADV)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def public_ledger(df: DataFrame, run: list[str], failed: Column, source: Column, found: Column, budget: int) -> DataFrame:
    """One row per run: calls, failures, remaining budget (never under 0), distinct sources and found ids. NULL sources and arrays count for nothing."""
    ids = F.array_distinct(F.flatten(F.collect_list(F.coalesce(found, F.array().cast("array<string>")))))
    return df.groupBy(*run).agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(failed).alias("failures"), F.greatest(F.lit(0), budget - F.count(F.lit(1))).alias("remaining"), F.count_distinct(source).alias("sources"), F.size(ids).alias("found")
    )


def invalid_transitions(df: DataFrame, run: list[str], order: list[Column], state: str, allowed: dict[str, tuple[str, ...]]) -> DataFrame:
    """``df`` of the rows whose state may not follow the one before in the run, with ``before``. NULL states follow nothing and nothing follows them."""
    rules = F.create_map(*(x for k, v in allowed.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    moved = df.withColumn("before", F.lag(state).over(Window.partitionBy(*run).orderBy(*order))).withColumn("_n", F.row_number().over(Window.partitionBy(*run).orderBy(*order)))
    fine = F.coalesce(F.array_contains(F.element_at(rules, F.col("before")), F.col(state)), F.lit(False))
    return moved.where((F.col("_n") > 1) & ~fine).drop("_n")


def align_kth(left: DataFrame, right: DataFrame, run: list[str], left_order: list[Column], right_order: list[Column], left_value: str, right_value: str) -> DataFrame:
    """(run, k, left_value, right_value, matches): the k-th row of either side beside each other; a missing side is NULL and doesn't match."""
    sides = []
    for df, order, value, name in ((left, left_order, left_value, "left_value"), (right, right_order, right_value, "right_value")):
        sides.append(df.select(*run, F.row_number().over(Window.partitionBy(*run).orderBy(*order)).alias("k"), F.col(value).alias(name), F.lit(True).alias(f"_{name}")))
    both = sides[0].join(sides[1], [*run, "k"], "full")
    same = F.col("_left_value").isNotNull() & F.col("_right_value").isNotNull() & F.col("left_value").eqNullSafe(F.col("right_value"))
    return both.select(*run, "k", "left_value", "right_value", same.alias("matches"))


def history(df: DataFrame, run: list[str], order: list[str], facts: Column, name: str = "history") -> DataFrame:
    """One row per run with its facts in order, joined by '; '. A NULL fact is left out. A run is bounded by its budget of steps."""
    listed = F.array_sort(F.collect_list(F.struct(*(F.col(o) for o in order), facts.alias("_f"))))
    return df.groupBy(*run).agg(F.array_join(F.transform(listed, lambda x: x["_f"]), "; ").alias(name))


def final_attempt(df: DataFrame, key: list[str], attempt: str, valid: Column, abnormal: Column, most: int = 3) -> DataFrame:
    """(key, attempts, selected, verdict): the last attempt, if it is valid and not abnormal.

    ``verdict`` is 'too_many' beyond ``most`` attempts, 'after_valid' where an attempt follows a valid one,
    'needs_attention' where the last one is not valid or is abnormal, else 'selected'; ``selected`` is NULL unless so.
    NULL flags count as false.
    """
    ok, odd = F.coalesce(valid, F.lit(False)), F.coalesce(abnormal, F.lit(False))
    g = df.groupBy(*key).agg(
        F.count(F.lit(1)).alias("attempts"), F.max(attempt).alias("_last"), F.min(F.when(ok, F.col(attempt))).alias("_first_valid"), F.max_by(ok & ~odd, F.col(attempt)).alias("_fine")
    )
    verdict = F.when(F.col("attempts") > most, "too_many").when(F.col("_first_valid") < F.col("_last"), "after_valid").when(~F.col("_fine"), "needs_attention").otherwise("selected")
    return g.withColumn("verdict", verdict).select(*key, "attempts", F.when(F.col("verdict") == "selected", F.col("_last")).alias("selected"), "verdict")


def common_prefix(a: Column, b: Column) -> Column:
    """Number of leading elements that two arrays share; 0 where either is NULL or empty."""
    pairs = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    length = F.coalesce(F.array_position(pairs, False) - 1, F.lit(0))
    return F.when(length >= 0, length).otherwise(F.coalesce(F.size(pairs), F.lit(0))).cast("int")


def longest_context(targets: DataFrame, prefixes: DataFrame, key: list[str], actions: str, prefix_id: str) -> DataFrame:
    """``targets`` with (matched, context): length and id of the longest sequence of ``prefixes`` of the same key that their actions begin with.

    Each target is met by hash of each of its own beginnings, so nothing but equal beginnings is joined. No match gives
    0 and NULL; of equal prefixes the smallest id is taken; empty prefixes match nothing.
    """
    known = prefixes.where(F.size(actions) > 0).groupBy(*key, F.xxhash64(actions).alias("_h"), F.col(actions).alias("_p")).agg(F.min(prefix_id).alias("_id"))
    n = F.size(actions)
    cut = targets.withColumn("_row", F.monotonically_increasing_id()).withColumn("_n", F.explode_outer(F.when(n > 0, F.sequence(F.lit(1), n)))).withColumn("_b", F.slice(actions, 1, F.greatest(F.lit(1), F.coalesce("_n", F.lit(1)))))
    met = cut.withColumn("_h", F.xxhash64("_b")).join(known, [*key, "_h"], "left").withColumn("_hit", F.coalesce(F.col("_b") == F.col("_p"), F.lit(False)))
    columns = [c for c in targets.columns]
    best = met.groupBy("_row").agg(*(F.first(c).alias(c) for c in columns), F.max(F.when(F.col("_hit"), F.struct("_n", "_id"))).alias("_best"))
    return best.select(*columns, F.coalesce(F.col("_best._n"), F.lit(0)).alias("matched"), F.col("_best._id").alias("context"))


def merged_sources(df: DataFrame, scope: list[str], source: Column, tool: Column, order: list[str]) -> DataFrame:
    """(scope, source, tools, first): each source once with the tools that gave it, sorted, and the order of its first mention; NULL sources are left out."""
    rows = df.withColumn("source", source).where("source is not null")
    return rows.groupBy(*scope, "source").agg(F.array_sort(F.collect_set(tool)).alias("tools"), F.min(F.struct(*order)).alias("_f")).select(*scope, "source", "tools", F.col("_f")[order[-1]].alias("first"))


# ------------------------------------------------------------------------------------------------ integrity
def violations(df: DataFrame, unique: list[str], required: list[str], run: list[str], seq: str) -> DataFrame:
    """(rule, n): how often a batch breaks a rule: NULL in a required column, an identity that stands twice, a gap in the sequence of a run.

    Rules that hold come out with 0. Rows with a NULL run or sequence are not checked for gaps.
    """
    nulls = df.agg(*(F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in required))
    twice = df.groupBy(*unique).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n"))
    dense = df.where(" and ".join(f"{c} is not null" for c in [*run, seq])).groupBy(*run).agg((F.max(seq) - F.min(seq) + 1 - F.count_distinct(F.col(seq))).alias("_gaps"))
    gaps = dense.agg(F.coalesce(F.sum("_gaps"), F.lit(0)).alias("n"))
    listed = nulls.select(F.explode(F.array(*(F.struct(F.lit(f"null_{c}").alias("rule"), F.col(f"null_{c}").cast("bigint").alias("n")) for c in required))).alias("r")).select("r.*")
    return listed.unionByName(twice.select(F.lit("repeated_identity").alias("rule"), F.col("n").cast("bigint").alias("n"))).unionByName(gaps.select(F.lit("gap").alias("rule"), F.col("n").cast("bigint").alias("n")))


def by_digest(df: DataFrame, registry: DataFrame, content: list[Column], digest: str, values: list[str]) -> DataFrame:
    """``df`` with the registered values of its content's digest and ``trusted``: whether the registry holds it. NULLs and empty texts digest alike."""
    h = F.sha2(F.concat_ws("\x1f", *(F.coalesce(c.cast("string"), F.lit("")) for c in content)), 256)
    known = registry.select(F.col(digest).alias("_d"), *values).dropDuplicates(["_d"])
    return df.withColumn("_d", h).join(known.withColumn("_known", F.lit(True)), "_d", "left").withColumn("trusted", F.col("_known").isNotNull()).drop("_d", "_known")


def valid_cached(df: DataFrame, cache: DataFrame, keys: list[str], value: str, valid: Column) -> DataFrame:
    """``df`` with the cached value of its keys where it is still valid, else NULL, and ``status``: hit, stale or miss. Of several entries the largest value counts."""
    entries = cache.withColumn("_valid", F.coalesce(valid, F.lit(False))).groupBy(*keys).agg(F.max(F.when(F.col("_valid"), F.col(value))).alias("_value"), F.bool_or("_valid").alias("_valid"))
    joined = df.join(entries, keys, "left")
    status = F.when(F.col("_valid"), "hit").when(F.col("_valid").isNotNull(), "stale").otherwise("miss")
    return joined.withColumn("cached", F.col("_value")).withColumn("status", status).drop("_value", "_valid")


def retry_outcomes(df: DataFrame, key: list[str], order: list[Column], ok: Column, retryable: Column, most: int) -> DataFrame:
    """(key, attempts, first_ok, outcome): bounded retry of each request.

    ``outcome`` is 'ok' when an attempt within ``most`` succeeded, 'not_retryable' when the first failure that may not be
    repeated came before, 'exhausted' after ``most`` failures, else 'open'. NULL flags: not ok, not retryable.
    """
    n = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    good, again = F.coalesce(ok, F.lit(False)), F.coalesce(retryable, F.lit(False))
    rows = df.withColumn("_n", n).withColumn("_good", good).withColumn("_end", ~good & ~again)
    g = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("attempts"), F.min(F.when(F.col("_good"), F.col("_n"))).alias("_ok"), F.min(F.when(F.col("_end"), F.col("_n"))).alias("_stop"))
    far = F.lit(1 << 30)
    first, stop = F.coalesce("_ok", far), F.coalesce("_stop", far)
    outcome = F.when((first <= most) & (first < stop), "ok").when((stop <= most) & (stop < first), "not_retryable").when(F.col("attempts") >= most, "exhausted").otherwise("open")
    return g.withColumn("outcome", outcome).select(*key, "attempts", F.when(F.col("outcome") == "ok", F.col("_ok")).alias("first_ok"), "outcome")


# ------------------------------------------------------------------------------------------------ training records
def decision_index(df: DataFrame, run: list[str], order: list[str], counted: Column) -> DataFrame:
    """``df`` with ``decision_idx``: number of counted rows of the run up to and with this one. Runs are bounded by their budget."""
    w = Window.partitionBy(*run).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("decision_idx", F.count_if(F.coalesce(counted, F.lit(False))).over(w))


def baseline_key(question: Column, channel: Column, idx: Column, task_channels: list[str], final: str = "final") -> Column:
    """Key of the group that a record is compared in: question and decision number for task channels, question and channel for others, NULL for the final one."""
    return F.when(channel == final, F.lit(None).cast("string")).when(channel.isin(task_channels), F.concat_ws("|", question, F.lit("task"), idx.cast("string"))).otherwise(F.concat_ws("|", question, channel))


def combined_advantage(df: DataFrame, local: str, final: str, question: str, rollout: str, channel: str, local_weight: float, final_weight: float) -> DataFrame:
    """``df`` with (final_advantage, advantage, observed, loss_weight).

    The final advantage is the final reward less the mean of the other rollouts of the question, NULL without another one.
    Unobserved parts add 0 to the sum, ``observed`` tells whether there was any; the loss weight is 1 over the rows of a
    rollout and channel. ``final`` is the same in all rows of a rollout; NULL rewards are unobserved.
    """
    per = df.where(F.col(final).isNotNull()).groupBy(question, rollout).agg(F.max(final).alias("_f"))
    total = per.groupBy(question).agg(F.sum("_f").alias("_s"), F.count(F.lit(1)).alias("_n"))
    sizes = df.groupBy(question, rollout, channel).agg(F.count(F.lit(1)).alias("_size"))
    joined = df.join(total, question, "left").join(sizes, [question, rollout, channel], "left")
    rest = F.when(F.col(final).isNotNull(), (F.col("_s") - F.col(final)) / F.nullif(F.col("_n") - 1, F.lit(0)))
    out = joined.withColumn("final_advantage", F.col(final) - rest)
    value = local_weight * F.coalesce(F.col(local), F.lit(0.0)) + final_weight * F.coalesce(F.col("final_advantage"), F.lit(0.0))
    seen = F.col(local).isNotNull() | F.col("final_advantage").isNotNull()
    return out.withColumn("advantage", value).withColumn("observed", seen).withColumn("loss_weight", 1.0 / F.col("_size")).drop("_s", "_n", "_size")


def rollout_normaliser(batch: Column, policy_tokens: Column, rollouts: int = 4) -> Column:
    """Denominator that gives each rollout of a batch the same weight: batch x rollouts x tokens of the policy."""
    return batch * rollouts * policy_tokens


def combined_reward(answer: Column, process: Column, cost: Column) -> Column:
    """answer + 0.2 process - 0.01 cost; NULL where one is unobserved."""
    return answer + 0.2 * process - 0.01 * cost


def stop_event(score: Column, active: Column, scale: float) -> Column:
    """scale x (2 score - 1) for an active stop, NULL for any other row."""
    return F.when(active, scale * (2 * score - 1))


def cost_events(failed: Column, tool: Column, penalty: float = -0.1, cost: float = -0.01) -> Column:
    """Reward events of a call: its cost for a tool call, and the penalty on top when it failed."""
    return F.when(tool, F.lit(cost)).otherwise(0.0) + F.when(F.coalesce(failed, F.lit(False)), F.lit(penalty)).otherwise(0.0)


def masked_log_softmax(logits: Column, allowed: Column) -> Column:
    """Log-probabilities over the allowed entries of an array, NULL for the others and where none is allowed."""
    rows = F.arrays_zip(logits.alias("x"), allowed.alias("ok"))
    kept = F.transform(F.filter(rows, lambda r: r["ok"]), lambda r: r["x"].cast("double"))
    top = F.array_max(kept)
    log_sum = top + F.log(F.aggregate(F.transform(kept, lambda x: F.exp(x - top)), F.lit(0.0), lambda s, x: s + x))
    return F.transform(rows, lambda r: F.when(r["ok"], r["x"].cast("double") - log_sum))


def acceptance_subset(df: DataFrame, group: list[str], id_col: str, length: str, failed: Column, stratum: str, size: int) -> DataFrame:
    """At most ``size`` rows per group, with their ``pick``: the longest, the first failure, the first of each stratum, then the rest, by id.

    Ties of length go to the smaller id; a NULL stratum is a stratum; NULL lengths come last. Groups are bounded by a
    question's rollouts.
    """
    by_length = F.row_number().over(Window.partitionBy(*group).orderBy(F.col(length).desc_nulls_last(), id_col))
    bad = F.coalesce(failed, F.lit(False))
    of_failure = F.row_number().over(Window.partitionBy(*group, bad).orderBy(id_col))
    of_stratum = F.row_number().over(Window.partitionBy(*group, stratum).orderBy(id_col))
    ranked = df.withColumn("_p", F.when(by_length == 1, 0).when(bad & (of_failure == 1), 1).when(of_stratum == 1, 2).otherwise(3))
    return ranked.withColumn("pick", F.row_number().over(Window.partitionBy(*group).orderBy("_p", id_col))).where(F.col("pick") <= size).drop("_p")
