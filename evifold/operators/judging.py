"""Aggregation of verdicts into scores (COV); NULL means unobserved and is never zero."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evifold.operators.credit import strict_mean

#: Caps of the four parts of a process score and weights of the four dimensions of an answer; fixed values.
PART_CAPS = (40.0, 30.0, 20.0, 10.0)
ANSWER_WEIGHTS = (40.0, 30.0, 20.0, 10.0)


def state_grades(df: DataFrame, keys: list[str], status: str, expected: str, citation: str) -> DataFrame:
    """(keys, status_accuracy, grounded_accuracy, score, n): how well stated states agree with the expected ones.

    An item whose expected state is 'unobservable' is unobserved, and so is its group then. A wrong state is worth 0
    however well it is cited, a right 'unknown' 1 without a citation, any other right state its citation score. The score
    is 0.75 of the first and 0.25 of the second mean. NULL states are wrong; a NULL expected state is unobserved.
    """
    right = F.when(F.coalesce(F.col(expected), F.lit("unobservable")) != "unobservable", F.coalesce(F.col(status) == F.col(expected), F.lit(False)).cast("double"))
    grounded = F.when(right == 0, 0.0).when(right.isNotNull() & (F.col(status) == "unknown"), 1.0).when(right.isNotNull(), F.col(citation).cast("double"))
    graded = df.groupBy(*keys).agg(strict_mean(right).alias("status_accuracy"), strict_mean(grounded).alias("grounded_accuracy"), F.count(F.lit(1)).alias("n"))
    return graded.withColumn("score", 0.75 * F.col("status_accuracy") + 0.25 * F.col("grounded_accuracy"))


def stage_scalar(core: dict[str, tuple[Column, float]], auxiliary: Column, core_error: Column, cap: float = 0.05, excluded: frozenset[str] = frozenset()) -> Column:
    """Weighted mean of the core scores that are not excluded, moved by up to ``cap`` and clipped to 0..1.

    One missing core score makes it NULL. ``auxiliary`` is -1, 0, 1 or NULL, which moves nothing; a core error blocks
    a move upward. Raises ValueError for a cap beyond 0.05 or weights that are not positive.
    """
    if not 0 <= cap <= 0.05 or any(w <= 0 for _, w in core.values()) or set(core) <= excluded:
        raise ValueError("the cap must be in [0, 0.05], weights positive, and a core score left")
    active = [(c, w) for name, (c, w) in core.items() if name not in excluded]
    total = sum((c * w for c, w in active[1:]), active[0][0] * active[0][1]) / sum(w for _, w in active)
    move = F.coalesce(auxiliary, F.lit(0)) * cap
    allowed = F.when(F.coalesce(core_error, F.lit(False)) & (move > 0), 0.0).otherwise(move)
    return F.when(total.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), total + allowed)))


def rubric_gaps(expected: DataFrame, given: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, gap): 'missing' for expected items without a grade, 'extra' for grades of no expected item; repeats count once."""
    a, b = expected.select(*keys).distinct(), given.select(*keys).distinct()
    missing = a.join(b, keys, "left_anti").withColumn("gap", F.lit("missing"))
    return missing.unionByName(b.join(a, keys, "left_anti").withColumn("gap", F.lit("extra")))


def bind_citations(claims: DataFrame, evidence: DataFrame, scope: list[str], ids: str, evidence_id: str, order: Column) -> DataFrame:
    """``claims`` with one row for each id in ``ids``: its place, the id, and ``bound_to``, the smallest ``order`` under that id in the scope.

    An id that no evidence of the scope bears is bound to NULL; claims with NULL or empty ids give no row.
    """
    listed = claims.select("*", F.posexplode(ids).alias("place", "_id"))
    known = evidence.groupBy(*scope, F.col(evidence_id).alias("_id")).agg(F.min(order).alias("bound_to"))
    return listed.join(known, [*scope, "_id"], "left").withColumnRenamed("_id", "cited_id")


def missed_slot(available: Column, disposition: Column) -> Column:
    """Whether evidence was at hand directly and the answer abstained from the slot or left it out."""
    return (available == "direct") & disposition.isin("abstained", "omitted")


def terminal_penalty(available: Column, disposition: Column, missed_weight: float, abstention_weight: float) -> Column:
    """Share of missed slots times its weight, and the other weight once if any abstention had direct evidence; 0 for an empty group."""
    unjustified = F.max(((available == "direct") & (disposition == "abstained")).cast("int"))
    missed = F.count_if(F.coalesce(missed_slot(available, disposition), F.lit(False)))
    return missed_weight * missed / F.greatest(F.lit(1), F.count(F.lit(1))) + abstention_weight * F.coalesce(unjustified, F.lit(0))


def terminal_bonus(available: Column, used: Column, natural: Column, safe: Column, used_weight: float, natural_weight: float, least: float = 0.75) -> Column:
    """Share of directly supported slots that the answer used, times its weight, and a bonus for a natural, safe end from ``least`` on.

    Without a supported slot it is 0. ``natural`` and ``safe`` are the same in all rows of a group.
    """
    at_hand = F.count_if(F.coalesce(available == "direct", F.lit(False)))
    share = F.count_if(F.coalesce((available == "direct") & used, F.lit(False))) / F.nullif(at_hand, F.lit(0))
    ended = F.coalesce(F.bool_and(natural) & F.bool_and(safe), F.lit(False))
    return F.coalesce(used_weight * share + F.when(ended & (share >= least), natural_weight).otherwise(0.0), F.lit(0.0))


def failure_overlay(score: Column, environment: Column, policy_reasons: Column, proven: list[str], penalty: float) -> Column:
    """0 where the environment failed, the penalty (at most the score) where a reason is proven, 0 where reasons stay unproven, else the score if positive."""
    reasons = F.coalesce(policy_reasons, F.array().cast("array<string>"))
    return (
        F.when(F.coalesce(environment, F.lit(False)), 0.0).when(F.arrays_overlap(reasons, F.array(*map(F.lit, proven))), F.least(score, F.lit(penalty)))
        .when(F.size(reasons) > 0, 0.0).otherwise(F.greatest(score, F.lit(0.0)))
    )


def trajectory_reward(no_tool: Column, calls: Column, coverage: Column, at_limit: Column, opened: Column, judged: Column) -> Column:
    """Reward of a whole run: without need of tools 1 if none was called; else its coverage, less 0.25 if it ran into the limit incomplete; NULL if evidence was opened and no verdict stands."""
    tooled = coverage - F.when(at_limit & (coverage < 1), 0.25).otherwise(0.0)
    return F.when(no_tool, F.when(calls == 0, 1.0).otherwise(0.0)).when(opened & ~judged, F.lit(None).cast("double")).otherwise(tooled)


def quality_r(process: Column, hold: Column, fatal: Column, task_failure: Column, major: Column) -> Column:
    """Reported reward: NULL on hold, 0 after a fatal error or a failed task, else a hundredth of the score, 0.49 of it with a major fault."""
    value = process / 100 * F.when(F.coalesce(major, F.lit(False)), 0.49).otherwise(1.0)
    failed = F.coalesce(fatal, F.lit(False)) | F.coalesce(task_failure, F.lit(False))
    return F.when(F.coalesce(hold, F.lit(False)), F.lit(None).cast("double")).when(failed, 0.0).otherwise(value)


def content_part(points: Column) -> Column:
    """First part of a process score from content points of 0, 1 or 2: 40 times their share of the possible; NULL for none."""
    return PART_CAPS[0] * F.sum(points) / F.nullif(2 * F.count(points), F.lit(0))


def process_total(parts: list[Column]) -> Column:
    """Sum of the four parts, each cut to 0 and its cap; NULL if one is unobserved."""
    capped = [F.when(p.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(cap), p))) for p, cap in zip(parts, PART_CAPS, strict=True)]
    return capped[0] + capped[1] + capped[2] + capped[3]


def answer_score(dimensions: list[Column], complete: Column) -> tuple[Column, Column]:
    """(candidate, accepted): 100 x weighted mean of the observed dimensions of 0..4, weights renormalised; accepted only where complete."""
    got = [F.coalesce(w * d / 4, F.lit(0.0)) for d, w in zip(dimensions, ANSWER_WEIGHTS, strict=True)]
    weights = [F.when(d.isNotNull(), w).otherwise(0.0) for d, w in zip(dimensions, ANSWER_WEIGHTS)]
    candidate = 100 * sum(got[1:], got[0]) / F.nullif(sum(weights[1:], weights[0]), F.lit(0.0))
    return candidate, F.when(complete, candidate)


def stop_gate(consistency: Column) -> Column:
    """Weight of a stop: 0 in conflict with the state, one half with minor differences, 1 when consistent, NULL otherwise."""
    return F.when(consistency == "conflict", 0.0).when(consistency == "minor", 0.5).when(consistency == "consistent", 1.0)


# ------------------------------------------------------------------------------------------------ quotes
_PLAIN = str.maketrans({"“": '"', "”": '"', "„": '"', "«": '"', "»": '"', "‘": "'", "’": "'", "–": "-", "—": "-", " ": " "})
_SPACE = re.compile(r"\s+")


def normal_with_places(text: str) -> tuple[str, list[int]]:
    """Text with quotes and dashes plain, case folded and white space collapsed, and the place in ``text`` of each of its characters."""
    out, at = [], []
    blank = True
    for i, c in enumerate(text):
        if c.isspace():
            if not blank:
                out.append(" ")
                at.append(i)
            blank = True
            continue
        blank = False
        for x in c.translate(_PLAIN).casefold():
            out.append(x)
            at.append(i)
    if out and out[-1] == " ":
        out.pop()
        at.pop()
    return "".join(out), at


def repair_quote(quote: str | None, source: str | None) -> str | None:
    """The exact stretch of ``source`` that equals ``quote`` but for case, white space, quotation marks and dashes; NULL unless there is exactly one."""
    if not quote or not source:
        return None
    wanted = normal_with_places(quote)[0]
    text, at = normal_with_places(source)
    first = text.find(wanted) if wanted else -1
    if first < 0 or text.find(wanted, first + 1) >= 0:
        return None
    return source[at[first] : at[first + len(wanted) - 1] + 1]


def repaired_quotes(df: DataFrame, id_col: str, quote: Column, source: Column) -> DataFrame:
    """(id, exact): for each row the stretch of the source that the quote stands for, NULL if there is none or more than one. Whole texts are read."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            exact = list(map(repair_quote, b.column(1).to_pylist(), b.column(2).to_pylist()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(exact, pa.string())], names=[id_col, "exact"])

    rows = df.select(F.col(id_col).cast("bigint").alias(id_col), quote.cast("string").alias("_q"), source.cast("string").alias("_s"))
    return rows.mapInArrow(scan, f"`{id_col}` bigint, exact string")
