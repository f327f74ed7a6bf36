"""Analytics over append-only logs of agent steps (EVT)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from evifold.functions.ordered import running

BEFORE = (Window.unboundedPreceding, -1)
SO_FAR = (Window.unboundedPreceding, Window.currentRow)


def source_id(c: Column) -> Column:
    """Identity of a source: what stands before ``#``, trimmed. NULL gives NULL."""
    return F.trim(F.substring_index(c, "#", 1))


def run_order(*order: str, by: str = "run_id") -> WindowSpec:
    return Window.partitionBy(by).orderBy(*order)


def search_signature(channel: Column, query: Column) -> Column:
    """Channel and query with case and white space removed; NULL where the query is."""
    return F.concat_ws("\x1f", F.coalesce(channel, F.lit("")), F.trim(F.regexp_replace(F.lower(query), r"\s+", " ")))


def repeats(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``df`` with ``occurrence``: 1 for the first row of its keys in order, 2 for the next, ..."""
    return df.withColumn("occurrence", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def latest_by(df: DataFrame, keys: list[str], value: str, seq: list[str]) -> DataFrame:
    """Last value in order per key; a NULL value counts as any other."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(value), F.struct(*seq))[value].alias(value))


def failures_since_success(df: DataFrame, run: list[str], order: list[str], ok: Column, failed: Column) -> DataFrame:
    """``df`` with ``failures``: failures since the last success of the run up to this row, which is included.

    A run may hold most of the rows; ``order`` must tell its rows apart. NULL verdicts are neither success nor failure.
    """
    sort = [F.col(o) for o in order]
    flagged = df.withColumn("_ok", F.when(ok, 1).otherwise(0)).withColumn("_bad", F.when(failed, 1).otherwise(0))
    islands = running(flagged, run, sort, before={"_island": F.col("_ok")}).withColumn("_island", F.col("_island") + F.col("_ok"))
    inside = running(islands, [*run, "_island"], sort, before={"failures": F.col("_bad")})
    return inside.withColumn("failures", F.col("failures") + F.col("_bad")).drop("_ok", "_bad", "_island")


def charge_budget(df: DataFrame, run: list[str], order: list[str], failed: Column, exempt_limit: int = 5, charged_limit: int = 6, actual_limit: int = 11, turn: Column | None = None, turn_limit: int = 16) -> DataFrame:
    """``df`` with (actual, exempt, charged, stopped): failures of the environment are free up to a limit, and a turn past its own limit stops too."""
    w = Window.partitionBy(*run).orderBy(*order).rowsBetween(*SO_FAR)
    actual = F.row_number().over(Window.partitionBy(*run).orderBy(*order)).cast("bigint")
    exempt = F.least(F.sum(F.when(failed, 1).otherwise(0)).over(w), F.lit(exempt_limit)).cast("bigint")
    counted = df.withColumn("actual", actual).withColumn("exempt", exempt).withColumn("charged", F.col("actual") - F.col("exempt"))
    late = F.lit(False) if turn is None else F.coalesce(turn >= turn_limit, F.lit(False))
    return counted.withColumn("stopped", (F.col("charged") >= charged_limit) | (F.col("actual") >= actual_limit) | late)


def previous_of(df: DataFrame, run: list[str], order: list[str], value: Column, is_call: Column, is_output: Column) -> DataFrame:
    """``df`` with ``paired``: for outputs, the value of the last call or output before them if that is a call.

    Rows that are neither call nor output lie between the two without effect; an output uses its call up. NULL flags count
    as neither.
    """
    either = F.coalesce(is_call, F.lit(False)) | F.coalesce(is_output, F.lit(False))
    last = F.last(F.when(either, F.struct(is_call.alias("call"), value.alias("value"))), ignorenulls=True).over(Window.partitionBy(*run).orderBy(*order).rowsBetween(*BEFORE))
    return df.withColumn("_l", last).withColumn("paired", F.when(is_output & F.col("_l.call"), F.col("_l.value"))).drop("_l")


def no_progress(df: DataFrame, signature: list[str], order: list[str], gained: Column) -> DataFrame:
    """Rows whose signature was seen before in the run without gain ever since the first time."""
    w = Window.partitionBy(*signature).orderBy(*order).rowsBetween(*BEFORE)
    return df.withColumn("_seen", F.count(F.lit(1)).over(w)).withColumn("_gain", F.max(gained.cast("int")).over(w)).where("_seen > 0 and _gain = 0").drop("_gain").withColumnRenamed("_seen", "earlier")


def paragraphs(df: DataFrame, id_col: str, text: Column, least: int = 80) -> DataFrame:
    """(id, pos, paragraph): paragraphs between blank lines with at least ``least`` characters after collapsing white space."""
    listed = df.select(id_col, F.posexplode(F.split(F.coalesce(text, F.lit("")), r"\n[ \t\r]*\n")).alias("pos", "paragraph"))
    clean = listed.withColumn("paragraph", F.trim(F.regexp_replace(F.regexp_replace("paragraph", r"</?(think|answer|cite)[^>]*>", " "), r"\s+", " ")))
    return clean.where(F.length("paragraph") >= least)


def repeated_paragraphs(df: DataFrame, id_col: str, text: Column, least: int = 80) -> DataFrame:
    """(id, first_repeat, n_repeats): texts in which a long paragraph stands twice, and where the first one does again."""
    again = repeats(paragraphs(df, id_col, text, least).withColumn("h", F.sha2("paragraph", 256)), [id_col, "h"], ["pos"]).where("occurrence > 1")
    return again.groupBy(id_col).agg(F.min("pos").alias("first_repeat"), F.count(F.lit(1)).alias("n_repeats"))
