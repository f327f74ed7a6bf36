"""Checks and folds over agent traces: tool calls, citations, repeated queries, coverage merges, evidence transitions (CLN, EVT, COV, CUR, INT)."""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evifold.functions.ordered import numbered
from evifold.operators.curation import hash_order, sequence_ratio
from evifold.operators.ranking import jaccard, tokens
from evifold.plans.checkpoints import cut_lineage

# fixed values: words that frame a search question and words that name study designs
FRAMING = "what which how when where who does do is are can should the a an of in for to and with on about".split()
DESIGN_TERMS = "randomized randomised controlled trial trials systematic review meta analysis meta-analysis cohort study studies evidence literature".split()
_CALL = r'<tool\s+name="([^"]+)"([^>]*)>([\s\S]*?)</tool>'
_ATTRIBUTE = r'([A-Za-z_]+)="([^"]*)"'


def tool_call(text: Column) -> Column:
    """First ``<tool name="x" k="v">body</tool>`` of a text as (tool, attributes, body); NULL if there is none."""
    name, rest = F.regexp_extract(text, _CALL, 1), F.regexp_extract(text, _CALL, 2)
    pairs = F.map_from_entries(F.array_distinct(F.arrays_zip(F.regexp_extract_all(rest, F.lit(_ATTRIBUTE), F.lit(1)).alias("k"), F.regexp_extract_all(rest, F.lit(_ATTRIBUTE), F.lit(2)).alias("v"))))
    return F.when(name != "", F.struct(name.alias("tool"), pairs.alias("attributes"), F.regexp_replace(F.regexp_extract(text, _CALL, 3), r"^\s+|\s+$", "").alias("body")))


@F.pandas_udf(T.StringType())
def repair_json(text: pd.Series) -> pd.Series:
    """Canonical JSON of the first object in a text: fences, control characters and trailing commas are mended; repeated keys and all else give NULL."""

    def unique(pairs: list[tuple]) -> dict:
        if len({k for k, _ in pairs}) != len(pairs):
            raise ValueError("repeated key")
        return dict(pairs)

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        body = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", re.sub(r"^\s*```\w*|```\s*$", "", t.strip()))
        lo, hi = body.find("{"), body.rfind("}")
        if lo < 0 or hi < lo:
            return None
        body = re.sub(r",(\s*[}\]])", r"\1", body[lo : hi + 1])
        try:
            value = json.loads(body, object_pairs_hook=unique, parse_constant=lambda c: (_ for _ in ()).throw(ValueError(c)))
        except ValueError:
            return None
        return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))

    return pd.Series([one(t) for t in text], dtype=object)


@F.pandas_udf(T.StringType())
def normalised(text: pd.Series) -> pd.Series:
    """NFKC, full case folding, words joined by one blank. NULL gives NULL."""
    return text.map(lambda t: " ".join(re.findall(r"\w+", unicodedata.normalize("NFKC", t).casefold())), na_action="ignore")


@F.pandas_udf(T.StringType())
def preview_text(text: pd.Series) -> pd.Series:
    """Search preview without known HTML tags, entities, control, format and surrogate characters; white space collapsed."""
    import html

    tag = re.compile(r"</?(?:p|b|i|em|strong|span|div|br|a|sup|sub|jats:\w+)(?:\s[^<>]*)?/?>", re.I)

    def one(t: str) -> str:
        t = tag.sub(" ", html.unescape(t))
        return " ".join("".join(c for c in t if c.isspace() or unicodedata.category(c) not in ("Cc", "Cf", "Cs")).split())

    return text.map(one, na_action="ignore")


def citation_marks_sound(text: Column) -> Column:
    """No nested, unclosed or empty ``<cite id="...">`` marks."""
    opened = F.regexp_count(text, F.lit("<cite "))
    whole = F.regexp_count(text, F.lit(r'<cite id="[^"<>]+">[^<]*</cite>'))
    return (opened == whole) & (F.regexp_count(text, F.lit("</cite>")) == whole)


def query_rewrites(query: Column) -> Column:
    """At most three distinct forms of a search query: as it is, without framing words, without design terms, its first six words."""
    clean = F.trim(F.regexp_replace(query, r"\s+", " "))
    parts = F.regexp_extract_all(clean, F.lit(r"[A-Za-z0-9]+(?:[-'][A-Za-z0-9]+)*"), F.lit(0))
    compact = F.filter(parts, lambda w: ~F.lower(w).isin(FRAMING))
    broad = F.filter(parts, lambda w: ~F.lower(w).isin(DESIGN_TERMS))
    text = lambda a, n: F.array_join(F.slice(a, 1, n), " ")
    listed = F.array(
        clean, F.when((F.size(parts) >= 8) & (F.size(compact) >= 3), text(compact, 32)),
        F.when((F.size(broad) >= 3) & (F.size(broad) < F.size(parts)), text(broad, 32)), F.when(F.size(compact) > 6, text(compact, 6)),
    )
    kept = F.filter(F.array_compact(listed), lambda x: x != "")
    first = F.filter(kept, lambda x, i: ~F.array_contains(F.transform(F.slice(kept, 1, i), lambda y: F.lower(y)), F.lower(x)))
    return F.slice(first, 1, 3)


def repeated_queries(df: DataFrame, run: str, order: str, query: Column, least: float = 0.85) -> DataFrame:
    """Rows whose query has a word Jaccard of at least ``least`` with any query before it in the run: (row, best).

    Each row holds the distinct word sets before it in its run, so the work grows with the square of a run's length.
    """
    rows = df.withColumn("_w", F.array_distinct(tokens(query)))
    earlier = F.collect_set("_w").over(Window.partitionBy(run).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    best = F.array_max(F.transform(earlier, lambda e: jaccard(F.col("_w"), e)))
    return rows.withColumn("best", best).where(F.col("best") >= least).drop("_w")


def similar_queries(df: DataFrame, run: list[str], order: str, query: Column, least: float = 0.9, least_chars: int = 24) -> DataFrame:
    """Rows with an earlier, different query in the run whose similarity by matching blocks is at least ``least``: (row, similarity).

    Lengths bound the similarity from above, 2 * min / (a + b); pairs under the bound never reach Python.
    """
    rows = df.withColumn("_q", F.trim(F.regexp_replace(F.lower(query), r"\s+", " "))).where(F.length("_q") >= least_chars)
    w = Window.partitionBy(*run).orderBy(order)
    earlier = rows.withColumn("_e", F.collect_set("_q").over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("_p", F.explode("_e")).drop("_e")
    a, b = F.length("_q"), F.length("_p")
    near = earlier.where((F.col("_q") != F.col("_p")) & (2 * F.least(a, b) >= least * (a + b)))
    scored = near.withColumn("similarity", F.round(sequence_ratio("_q", "_p"), 3)).where(F.col("similarity") >= least)
    keys = [c for c in df.columns]
    return scored.groupBy(*keys).agg(F.max("similarity").alias("similarity"))


def merge_coverage(old: DataFrame, delta: DataFrame, key: list[str]) -> DataFrame:
    """Coverage after a delta: direct stays, complete support makes direct, any support at least partial; evidence is united and sorted."""
    none = F.array().cast("array<string>")
    both = old.join(delta, key, "full")
    status = (
        F.when((F.col("status") == "direct") | F.coalesce("complete", F.lit(False)), "direct")
        .when((F.col("status") == "partial") | F.coalesce("support", F.lit(False)), "partial").otherwise(F.coalesce("status", F.lit("missing")))
    )
    return both.select(*key, status.alias("status"), F.array_sort(F.array_union(F.coalesce("evidence_ids", none), F.coalesce("new_evidence_ids", none))).alias("evidence_ids"))


def transitions(states: DataFrame, run: list[str], order: list[str], ids: str) -> DataFrame:
    """``states`` with (added, lost, change): evidence may only grow; change is first, append, no_change or violation."""
    before = F.lag(ids).over(Window.partitionBy(*run).orderBy(*order))
    added, lost = F.size(F.array_except(ids, F.coalesce(before, F.array().cast("array<string>")))), F.size(F.array_except(F.coalesce(before, F.array().cast("array<string>")), ids))
    change = F.when(before.isNull(), "first").when(lost > 0, "violation").when(added > 0, "append").otherwise("no_change")
    return states.withColumn("added", added).withColumn("lost", lost).withColumn("change", change)


def evidence_growth(df: DataFrame, run: list[str], order: list[str], ids: str) -> DataFrame:
    """``df`` with (added, change): how many ids each step brings that no earlier step of its run has; first, append or no_change.

    Only the first step of each id is looked up, so a run costs its ids and not its steps times its ids. ``order`` must
    tell the steps of a run apart; NULL and empty arrays bring nothing, an id that stands twice in a step counts once.
    """
    step = F.struct(*order)
    listed = df.select(*run, step.alias("_o"), F.explode(F.array_distinct(ids)).alias("_id")).where("_id is not null")
    first = listed.groupBy(*run, "_id").agg(F.min("_o").alias("_o")).groupBy(*run, "_o").agg(F.count(F.lit(1)).alias("_n"))
    starts = df.groupBy(*run).agg(F.min(step).alias("_start"))
    placed = df.withColumn("_o", step).join(first, [*run, "_o"], "left").join(starts, run)
    added = F.coalesce("_n", F.lit(0))
    change = F.when(F.col("_o") == F.col("_start"), "first").when(added > 0, "append").otherwise("no_change")
    return placed.withColumn("added", added).withColumn("change", change).drop("_o", "_n", "_start")


def answer_issues(df: DataFrame, cited: str, opened: str, claim: Column, evidence: Column) -> DataFrame:
    """``df`` with ``issues``: unknown citations, numbers that the evidence lacks, no shared word; distinct, in this order."""
    numbers = lambda c: F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0))
    shared = F.size(F.array_intersect(tokens(claim), tokens(evidence)))
    listed = F.array(
        F.when(F.size(F.array_except(cited, opened)) > 0, "unknown_citation"), F.when(F.size(cited) == 0, "no_citation"),
        F.when(F.size(F.array_except(numbers(claim), numbers(evidence))) > 0, "unsupported_number"), F.when(shared == 0, "no_shared_term"),
    )
    return df.withColumn("issues", F.array_compact(listed))


def prefix_chains(df: DataFrame, run: list[str], order: list[str], text: str) -> DataFrame:
    """``df`` with ``chain``: number of the chain in which each text continues the one before it in the run."""
    w = Window.partitionBy(*run).orderBy(*order)
    broken = F.when(F.col(text).startswith(F.lag(text).over(w)), 0).otherwise(1)
    return df.withColumn("_b", broken).withColumn("chain", F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_b")


def greedy_two_way(df: DataFrame, stratum: str, cluster: str, order: str, cap: int) -> DataFrame:
    """Rows taken in order, at most ``cap`` per stratum and one per cluster; a row that is skipped uses nothing up.

    Done in rounds over all open rows at once. A row is taken when it is the first open one of its cluster and its stratum
    would have room even if all open rows before it were taken; rows of a taken cluster or a full stratum are dropped. The
    first open row is always decided, and the result is that of the loop. Ties of ``order`` go by cluster and stratum;
    NULLs are a stratum and a cluster.
    """
    ordered = [F.col(order), F.col(cluster), F.col(stratum)]
    still = cut_lineage(df.withColumn("_id", F.monotonically_increasing_id()))
    taken = still.limit(0)
    while still.limit(1).count():
        used = taken.groupBy(F.col(stratum).alias("_us")).agg(F.count(F.lit(1)).alias("_used"))
        left = still.join(used, F.col(stratum).eqNullSafe(F.col("_us")), "left").withColumn("_used", F.coalesce("_used", F.lit(0)))
        ranked = left.withColumn("_c", F.row_number().over(Window.partitionBy(cluster).orderBy(*ordered, "_id"))).withColumn("_s", F.row_number().over(Window.partitionBy(stratum).orderBy(*ordered, "_id")))
        marked = cut_lineage(ranked.withColumn("_take", (F.col("_c") == 1) & (F.col("_used") + F.col("_s") <= cap)))
        new = marked.where("_take").select(*still.columns)
        taken = cut_lineage(taken.unionByName(new))
        clusters = new.select(F.col(cluster).alias("_cl"), F.lit(True).alias("_hit")).distinct()
        full = taken.groupBy(F.col(stratum).alias("_st")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= cap)
        rest = marked.where("not _take").select(*still.columns)
        rest = rest.join(clusters, F.col(cluster).eqNullSafe(F.col("_cl")), "left_anti").join(full, F.col(stratum).eqNullSafe(F.col("_st")), "left_anti")
        still = cut_lineage(rest)
    return taken.drop("_id")


def record_faults(spans: Column, size: Column) -> Column:
    """Name of the first fault of an array of (start, end, weight): out_of_range, not_positive, overlap; NULL if sound."""
    ordered = F.forall(F.sequence(F.lit(1), F.greatest(F.size(spans) - 1, F.lit(1))), lambda i: (F.size(spans) < 2) | (F.get(spans, i)["start"] >= F.get(spans, i - 1)["end"]))
    return (
        F.when(F.exists(spans, lambda s: (s["start"] < 0) | (s["end"] > size) | (s["start"] >= s["end"])), "out_of_range")
        .when(F.exists(spans, lambda s: s["weight"] <= 0), "not_positive").when(~ordered, "overlap")
    )


def weighted_mass(spans: Column) -> Column:
    """Sum of length times weight over an array of (start, end, weight)."""
    return F.aggregate(spans, F.lit(0.0), lambda s, x: s + (x["end"] - x["start"]) * x["weight"])


def cosine_rate(step: Column, warmup: int, total: int, peak: float) -> Column:
    """Learning rate: linear to ``peak`` over the warm-up, then half a cosine to 0."""
    done = (step - warmup) / max(1, total - warmup)
    return F.when(step < warmup, peak * step / max(1, warmup)).otherwise(peak * 0.5 * (1 + F.cos(F.pi() * F.least(F.lit(1.0), done))))


def batches(df: DataFrame, key: str, seed: str, size: int) -> DataFrame:
    """``df`` with ``batch``: rows in hash order of their unique key in batches of ``size``, the last one smaller."""
    placed = numbered(df.withColumn("_h", hash_order(F.col(key), seed)), [F.col("_h"), F.col(key)], "_i")
    return placed.withColumn("batch", F.floor(F.col("_i") / size).cast("bigint")).drop("_h", "_i")
