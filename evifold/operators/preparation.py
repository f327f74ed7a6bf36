"""Preparing records for training and search: budgets, extraction, matching, candidates, registries, merged routes (CUR, RNK, SRC)."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def within_budget(prompt_tokens: Column, completion_tokens: Column, context: int, reserve: int) -> Column:
    """Whether a record fits without being cut: prompt and reserve in the context, completion in the reserve; NULL sizes don't fit."""
    return F.coalesce((prompt_tokens + reserve <= context) & (completion_tokens <= reserve), F.lit(False))


def label_mask(prompt_tokens: Column, completion_tokens: Column) -> Column:
    """Array of 0 for each token of the prompt and 1 for each of the completion."""
    return F.concat(F.array_repeat(F.lit(0), prompt_tokens), F.array_repeat(F.lit(1), completion_tokens))


def training_samples(df: DataFrame, accepted: Column, role: Column, roles: list[str], repaired: Column, receipt: list[str], order: list[str]) -> DataFrame:
    """Accepted, unrepaired rows of the roles, one per receipt: the first in order. NULL flags: not accepted, not repaired."""
    rows = df.where(F.coalesce(accepted, F.lit(False)) & role.isin(roles) & ~F.coalesce(repaired, F.lit(False)))
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*receipt).orderBy(*order))).where("_r = 1").drop("_r")


def finalised(sessions: DataFrame, decisions: DataFrame, keys: list[str], accepted: str) -> DataFrame:
    """(keys, state): 'accepted' or 'rejected' where session and decision match one to one, else 'no_decision', 'no_session' or 'repeated'."""
    a = sessions.groupBy(*keys).agg(F.count(F.lit(1)).alias("_a"))
    b = decisions.groupBy(*keys).agg(F.count(F.lit(1)).alias("_b"), F.bool_and(F.coalesce(F.col(accepted), F.lit(False))).alias("_ok"))
    state = F.when(F.col("_b").isNull(), "no_decision").when(F.col("_a").isNull(), "no_session").when((F.col("_a") > 1) | (F.col("_b") > 1), "repeated").when(F.col("_ok"), "accepted").otherwise("rejected")
    return a.join(b, keys, "full").select(*keys, state.alias("state"))


def complete_merge(parts: DataFrame, worker: str, workers: int, order: list[str]) -> DataFrame:
    """All rows of the workers' outputs in order, once every worker from 0 to ``workers`` - 1 has written; no rows before. Raises nothing."""
    present = parts.where(F.col(worker).between(0, workers - 1)).agg(F.count_distinct(F.col(worker)).alias("_n")).where(F.col("_n") == workers)
    return parts.join(F.broadcast(present), how="left_semi", on=F.col("_n") == workers).orderBy(*order)


def visibility_faults(df: DataFrame, target: Column, candidates: Column, references: Column, opened: Column) -> DataFrame:
    """``df`` with (target_visible, unopened): whether the target stands among the candidates, and the references that were never opened. NULL arrays are empty."""
    none = F.array().cast("array<string>")
    missing = F.array_except(F.coalesce(references, none), F.coalesce(opened, none))
    return df.withColumn("target_visible", F.coalesce(F.array_contains(F.coalesce(candidates, none), target), F.lit(False))).withColumn("unopened", missing)


def candidates(df: DataFrame, group: list[str], canonical: Column, order: list[str], limit: int, cut: dict[str, int]) -> DataFrame:
    """First row of each canonical id in order, at most ``limit`` per group, with ``position``; columns in ``cut`` are cut to so many characters. NULL ids are left out."""
    rows = df.withColumn("_id", canonical).where("_id is not null")
    first = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*group, "_id").orderBy(*order))).where("_r = 1")
    placed = first.withColumn("position", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("position") <= limit)
    for name, n in cut.items():
        placed = placed.withColumn(name, F.substring(name, 1, n))
    return placed.drop("_r", "_id")


def first_filled(*columns: Column, default: str = "") -> Column:
    """First of the columns that is neither NULL nor blank, trimmed; else the default."""
    return F.coalesce(*(F.nullif(F.trim(c.cast("string")), F.lit("")) for c in columns), F.lit(default))


def registered_values(df: DataFrame, id_col: str, json_col: str, names: list[str]) -> DataFrame:
    """(id, path, name, value): every string or number under one of the names anywhere in a JSON text, with the path to it.

    Broken and NULL JSON gives no row; of a repeated key the last value counts, as JSON readers have it.
    """
    wanted = frozenset(names)

    def walk(node: object, path: str) -> Iterator[tuple[str, str, str]]:
        stack = [(node, path)]
        while stack:
            x, at = stack.pop()
            if isinstance(x, dict):
                for k, v in x.items():
                    if k in wanted and isinstance(v, (str, int, float)) and not isinstance(v, bool):
                        yield f"{at}.{k}", k, str(v)
                    stack.append((v, f"{at}.{k}"))
            elif isinstance(x, list):
                stack += [(v, f"{at}[{i}]") for i, v in enumerate(x)]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    out += [(i, *found) for found in walk(json.loads(t), "$")]
                except (ValueError, RecursionError):
                    continue
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), *(pa.array([r[k] for r in out], pa.string()) for k in (1, 2, 3))], names=[id_col, "path", "name", "value"])

    rows = df.select(F.col(id_col).cast("bigint").alias(id_col), F.col(json_col).cast("string").alias("_j")).where("_j is not null")
    return rows.mapInArrow(scan, f"`{id_col}` bigint, path string, name string, value string")


# ------------------------------------------------------------------------------------------------ ranking inputs
def scored_rows(df: DataFrame, scores: DataFrame, keys: list[str], score: str, fallback: Column) -> DataFrame:
    """``df`` with ``model_score`` from a table of model scores, and ``scored``: whether it stood there. Of several scores the largest counts; the fallback stands for missing and NaN ones."""
    known = scores.where(F.col(score).isNotNull() & ~F.isnan(score)).groupBy(*keys).agg(F.max(score).alias("_s"))
    joined = df.join(known, keys, "left")
    return joined.withColumn("scored", F.col("_s").isNotNull()).withColumn("model_score", F.coalesce("_s", fallback)).drop("_s")


def merged_routes(routes: list[tuple[str, DataFrame]], group: list[str], id_col: str, score: str, limit: int) -> DataFrame:
    """(group, id, score, routes, rank): the rows of several routes pooled, each id once with its best score and the routes that gave it.

    A route without rows, as one that failed, takes nothing from the others. Ranked by score, then id; NULL scores come last.
    """
    pool = None
    for name, df in routes:
        part = df.select(*group, id_col, F.col(score).cast("double").alias("score"), F.lit(name).alias("_route"))
        pool = part if pool is None else pool.unionByName(part)
    once = pool.groupBy(*group, id_col).agg(F.max("score").alias("score"), F.array_join(F.array_sort(F.collect_set("_route")), "+").alias("routes"))
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(F.col("score").desc_nulls_last(), id_col)))
    return ranked.where(F.col("rank") <= limit)
