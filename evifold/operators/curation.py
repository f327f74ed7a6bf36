"""Deduplication, decontamination, sampling, splitting and integrity of tables (CUR, INT)."""

from __future__ import annotations

from collections.abc import Callable
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evifold.functions.ordered import numbered


def content_key(text: Column) -> Column:
    """128-bit key of a text without case and white space; NULL for NULL."""
    return F.md5(F.trim(F.regexp_replace(F.lower(text), r"\s+", " ")))


def exact_groups(df: DataFrame, id_col: str, key: Column) -> DataFrame:
    """(keep_id, n): the smallest id and the size of each group of equal keys; NULL keys are left out. Counts combine before the shuffle."""
    return df.select(F.col(id_col), key.alias("_k")).where("_k is not null").groupBy("_k").agg(F.min(id_col).alias("keep_id"), F.count(F.lit(1)).alias("n")).drop("_k")


def hash_order(key: Column, seed: str) -> Column:
    """Order that depends on the seed and the key only."""
    return F.sha2(F.concat(F.lit(seed + "\x1f"), key.cast("string")), 256)


def hash_sample(df: DataFrame, key: str, seed: str, n: int) -> DataFrame:
    """The first ``n`` rows in hash order; stable under repartitioning. NULL keys are left out."""
    return df.where(F.col(key).isNotNull()).withColumn("_h", hash_order(F.col(key), seed)).orderBy("_h", key).limit(n).drop("_h")


def stratified_sample(df: DataFrame, stratum: str, key: str, seed: str, n: int) -> DataFrame:
    """At most ``n`` rows per stratum in hash order; Spark prunes each stratum before the shuffle."""
    w = Window.partitionBy(stratum).orderBy(hash_order(F.col(key), seed), F.col(key))
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def atomic_filter(df: DataFrame, scenario: list[str], good: Column) -> DataFrame:
    """Rows of the scenarios in which every row is good; a NULL verdict counts as bad."""
    bad = df.where(~F.coalesce(good, F.lit(False))).select(*scenario).distinct()
    return df.join(bad, scenario, "left_anti")


def shard_of(df: DataFrame, order: str, shards: int) -> DataFrame:
    """``df`` with ``shard`` 0..n-1: contiguous in order, sizes that differ by one at most, larger ones first. ``order`` must be unique."""
    n = df.count()
    base, extra = n // shards, n % shards
    large = extra * (base + 1)
    place = F.col("_i")
    shard = F.when(place < large, F.floor(place / (base + 1))).otherwise(extra + F.floor((place - large) / max(base, 1)))
    return numbered(df, [F.col(order)], "_i").withColumn("shard", shard.cast("bigint")).drop("_i")


def disjoint(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that stand in both; no rows if the two are disjoint."""
    return a.select(key).where(F.col(key).isNotNull()).intersect(b.select(key))


def missing(requests: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Requests without a finished row; NULL keys always count as missing."""
    return requests.join(done.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def conflicts(df: DataFrame, identity: list[str], value: Column) -> DataFrame:
    """Identities that stand with more than one value, NULL as a value of its own."""
    shown = F.coalesce(value.cast("string"), F.lit("\x00null"))
    return df.groupBy(*identity).agg(F.countDistinct(shown).alias("versions"), F.count(F.lit(1)).alias("n")).where("versions > 1")


def manifest_diff(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, change): added, removed or changed entries of two manifests with unique keys."""
    both = old.select(F.col(key), F.col(digest).alias("_a"), F.lit(True).alias("_old")).join(new.select(F.col(key), F.col(digest).alias("_b"), F.lit(True).alias("_new")), key, "full")
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return both.select(key, change.alias("change")).where("change is not null")


def word_sets(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)))


def near_pairs(left: DataFrame, right: DataFrame, left_id: str, right_id: str, text: str, least: float, sets: Callable[[Column], Column] = word_sets) -> DataFrame:
    """(left_id, right_id, jaccard): pairs of texts whose word sets have a Jaccard similarity of at least ``least``.

    Prefix filtering: words are ranked from rare to frequent over both sides; two similar sets share one of their first
    ``n - ceil(least * n) + 1`` words. Only those prefixes are joined, so no pair that reaches ``least`` is lost and no
    cross join is made. Texts without words give no pair. ``sets`` gives the word set of a text.
    """
    a = left.select(F.col(left_id).alias("_a"), sets(F.col(text)).alias("_x"))
    b = right.select(F.col(right_id).alias("_b"), sets(F.col(text)).alias("_y"))
    frequency = a.select(F.explode("_x").alias("w")).unionAll(b.select(F.explode("_y").alias("w"))).groupBy("w").agg(F.count(F.lit(1)).alias("f"))

    def prefix(df: DataFrame, key: str, words: str) -> DataFrame:
        ranked = df.select(key, F.size(words).alias("n"), F.explode(words).alias("w")).join(frequency, "w")
        r = F.row_number().over(Window.partitionBy(key).orderBy("f", "w"))
        return ranked.withColumn("r", r).where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * least) + 1).select(key, "w", F.col("n").alias("n" + key))

    shared = prefix(a, "_a", "_x").join(prefix(b, "_b", "_y"), "w").where((F.col("n_a") >= least * F.col("n_b")) & (F.col("n_b") >= least * F.col("n_a")))
    candidates = shared.select("_a", "_b").distinct()
    scored = candidates.join(a, "_a").join(b, "_b")
    both = F.size(F.array_intersect("_x", "_y"))
    jaccard = both / (F.size("_x") + F.size("_y") - both)
    return scored.select(F.col("_a").alias(left_id), F.col("_b").alias(right_id), jaccard.alias("jaccard")).where(F.col("jaccard") >= least)


def blank_sets(text: Column) -> Column:
    """Word set of a text whose words are joined by one blank, in any script."""
    return F.array_remove(F.array_distinct(F.split(F.coalesce(text, F.lit("")), " ")), "")


def shingles(text: Column, width: int) -> Column:
    """Distinct runs of ``width`` words of a text whose words are joined by one blank; none if it has fewer."""
    w = F.split(text, " ")
    last = F.size(w) - width + 1
    return F.when(last >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice(w, i, width), " ")))).otherwise(F.array().cast("array<string>"))


def contained(left: DataFrame, right: DataFrame, left_id: str, right_id: str, text: str, width: int) -> DataFrame:
    """(left_id, right_id, share): pairs that share a run of ``width`` words; share of the right text's distinct runs that stand in the left one.

    Hashes of the runs find the pairs, the runs themselves confirm them.
    """
    a = left.select(F.col(left_id).alias("_a"), shingles(F.col(text), width).alias("_x"))
    b = right.select(F.col(right_id).alias("_b"), shingles(F.col(text), width).alias("_y"))
    hashed = lambda df, key, runs: df.select(key, F.explode(F.transform(runs, lambda s: F.xxhash64(s))).alias("h"))
    candidates = hashed(a, "_a", F.col("_x")).join(hashed(b, "_b", F.col("_y")), "h").select("_a", "_b").distinct()
    both = F.size(F.array_intersect("_x", "_y"))
    scored = candidates.join(a, "_a").join(b, "_b").where(both > 0)
    return scored.select(F.col("_a").alias(left_id), F.col("_b").alias(right_id), (both / F.size("_y")).alias("share"))


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity of two texts by longest matching blocks; NULL counts as empty, two empty texts give 1."""
    return pd.Series([SequenceMatcher(None, x or "", y or "", autojunk=False).ratio() for x, y in zip(a, b)])


def canonical_digest(**fields: Column) -> Column:
    """SHA-256 over named fields in alphabetical order, NULL apart from every value; for strings, integers and booleans."""
    parts = [x for name in sorted(fields) for x in (F.lit(name), F.coalesce(F.concat(F.lit("="), fields[name].cast("string")), F.lit("~")))]
    return F.sha2(F.concat_ws("\x1e", *parts), 256)


def short_id(prefix: str, text: Column) -> Column:
    """``prefix`` and the first 16 hexadecimal digits of the SHA-256 of the text."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(text, 256), 1, 16))
