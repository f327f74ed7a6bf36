"""Positions and running sums within keys, also where one key holds a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evifold.plans.checkpoints import cut_lineage


def running(df: DataFrame, keys: list[str], order: list[Column], number: str | None = None, before: dict[str, Column] | None = None) -> DataFrame:
    """``df`` with ``number`` (1.. within the keys in order) and, per name in ``before``, the sum of a column over the rows before.

    Rows are split by range of (keys, order), so a hot key lies in several partitions; each partition counts and sums
    by itself, and only for keys that go on from an earlier partition, at most one per partition, an offset is added.
    The split is written once, as its bounds are sampled. ``order`` must tell all rows of a key apart; NULL keys are a
    key of their own, NULL values add nothing, an empty table gives no rows.
    """
    before = before or {}
    values = {f"_v{i}": v for i, v in enumerate(before.values())}
    prepared = df.select("*", *(F.coalesce(v, F.lit(0)).alias(n) for n, v in values.items()))
    parted = cut_lineage(prepared.repartitionByRange(*map(F.col, keys), *order).withColumn("_p", F.spark_partition_id()))
    w = Window.partitionBy("_p", *keys).orderBy(*order)
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    local = parted.withColumn("_n", F.row_number().over(w))
    for n in values:
        local = local.withColumn(f"{n}_b", F.coalesce(F.sum(n).over(earlier), F.lit(0)))
    totals = parted.groupBy("_p", *keys).agg(F.count(F.lit(1)).alias("_c"), *(F.sum(n).alias(n) for n in values))
    past = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        F.col("_p").alias("_op"), *(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.sum("_c").over(past).alias("_co"), *(F.sum(n).over(past).alias(f"{n}_o") for n in values)
    ).where("_co is not null")
    same = F.col("_p") == F.col("_op")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    joined = local.join(F.broadcast(offsets), same, "left")
    added = [(F.col("_n") + F.coalesce("_co", F.lit(0))).cast("bigint").alias(number)] if number else []
    added += [(F.col(f"{n}_b") + F.coalesce(f"{n}_o", F.lit(0))).alias(name) for n, name in zip(values, before)]
    return joined.select(*df.columns, *added)


def numbered(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """``df`` with its place 0.. in a total order over all rows, without one window over all of them."""
    keyed = running(df.withColumn("_all", F.lit(0)), ["_all"], order, name)
    return keyed.withColumn(name, F.col(name) - 1).drop("_all")
