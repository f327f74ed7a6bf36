"""Candidate scores, section classes and visibility windows of a search agent (CLN, RNK, BUD)."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evifold.functions.text import collapse_space
from evifold.operators.ranking import bigrams, overlap_share, reciprocal_rank
from evifold.operators.textrules import any_phrase, count_of

# fixed values: framing words, cues of evidence, low-value paths, kinds of headings
FRAMING = ["what", "which", "how", "when", "where", "who", "is", "are", "the", "a", "an", "of", "in", "for", "to", "and", "does", "do", "current", "latest", "guideline", "guidelines", "evaluation", "approach"]
EVIDENCE_CUES = ["guideline", "systematic review", "meta-analysis", "randomized", "randomised", "clinical trial", "cohort"]
LOW_VALUE_PATHS = ["/login", "/tag/", "/search", "/category/", "/author/"]
BIBLIOGRAPHY = ["references", "bibliography", "works cited", "literature cited", "further reading", "mesh terms", "keywords", "literatur", "références", "referencias"]
PUBLICATION = ["acknowledgements", "acknowledgments", "funding", "conflicts of interest", "competing interests", "author contributions", "data availability", "ethics approval", "abbreviations", "supplementary material", "copyright", "license"]
NAVIGATION = ["related articles", "most read", "share", "menu", "navigation", "contact", "subscribe", "newsletter", "advertisement", "in this collection", "you may also like"]


def heading_kind(heading: Column) -> Column:
    """bibliography, publication_metadata, web_boilerplate or content by a heading without its numbering, case and punctuation."""
    name = F.regexp_replace(F.lower(F.trim(F.coalesce(heading, F.lit("")))), r"^[#0-9.\s]+|[\s:.*#]+$", "")
    return F.when(name.isin(BIBLIOGRAPHY), "bibliography").when(name.isin(PUBLICATION), "publication_metadata").when(name.isin(NAVIGATION), "web_boilerplate").otherwise("content")


def section_class(heading: Column, text: Column) -> Column:
    """Class of a section, the first that holds: metadata by heading, reference lists, legal notices and controls in short text, else content.

    Prose of 180 characters and two sentences is content whatever its cues. NULL texts are empty.
    """
    t = collapse_space(F.coalesce(text, F.lit("")))
    ends = count_of(t, r"[。！？!?]|[.]( |$)")
    prose = (F.length(t) >= 180) & (ends >= 2)
    legal = count_of(F.lower(t), "all rights reserved|copyright|terms of use|privacy policy|cookie")
    records = count_of(t, r"doi|PMID|[0-9]{4};[0-9]+|et al[.]")
    controls = count_of(F.lower(t), "subscribe|sign up|share this|print this|download|log in|sign in|newsletter")
    kind = heading_kind(heading)
    return (
        F.when(kind == "publication_metadata", "publication_metadata").when((kind == "bibliography") & (records >= 1), "bibliography")
        .when((legal >= 2) & (F.length(t) <= 1200) & ~prose, "web_boilerplate").when(prose, "content")
        .when((controls >= 2) & (F.length(t) <= 600), "web_boilerplate").when((kind == "web_boilerplate") & (F.length(t) <= 400) & (ends == 0), "web_boilerplate").otherwise("content")
    )


def quality_penalty(heading: Column, text: Column) -> Column:
    """100 for boilerplate without evidence, 2 for weak headings and short texts without evidence, 0 otherwise."""
    t = collapse_space(F.coalesce(text, F.lit("")))
    evidence = F.lower(t).rlike("[0-9]+(\\.[0-9]+)? ?%|95% ci|confidence interval|randomi[sz]ed|p ?[<=]|reduced|increased|compared with|recommend")
    weak = heading_kind(heading) != "content"
    boilerplate = F.lower(t).rlike("all rights reserved|cookie settings|javascript is disabled|accept all cookies")
    return F.when(boilerplate & ~evidence, 100.0).when(weak & evidence, 0.0).when(weak | ((F.length(t) < 320) & ~evidence), 2.0).otherwise(0.0)


def authority(host: Column, scores: dict[str, int], default: int = 60) -> Column:
    """Best score of the domains that the host is or lies under; ``default`` if none is."""
    found = [F.when((host == d) | host.endswith("." + d), F.lit(s)) for d, s in scores.items()]
    return F.coalesce(F.array_max(F.array(*found)), F.lit(default)) if found else F.lit(default)


def web_score(focus: Column, question: Column, item: Column, url: Column, authority_score: Column, penalty: Column) -> Column:
    """200 times relevance, plus what authority and cues of evidence add once it is relevant, less low paths and inaccessibility (0..180).

    ``focus``, ``question`` and ``item`` are arrays of distinct words; framing words are not counted.
    """
    words = lambda c: F.filter(c, lambda w: ~w.isin(FRAMING))
    near = overlap_share(words(focus), item)
    relevance = 0.3 * near + 0.7 * F.when(F.size(words(question)) > 0, overlap_share(words(question), item)).otherwise(near)
    gate = F.least(F.lit(1.0), relevance / 0.15)
    text = F.concat_ws(" ", F.array_join(item, " "), F.lower(url))
    cues = F.when(any_phrase(text, EVIDENCE_CUES), 12.0).otherwise(0.0)
    low = F.when(F.lower(url).rlike("|".join(LOW_VALUE_PATHS)), 10.0).otherwise(0.0)
    return 200 * relevance + gate * (0.1 * authority_score + cues) - low - F.greatest(F.lit(0.0), F.least(F.lit(180.0), F.coalesce(penalty, F.lit(0.0))))


def paper_score(query: Column, text: Column, abstract: Column, year: Column, design: Column, human: Column) -> Column:
    """Evidence utility of a paper: overlap, shared word pairs, design, people, recency and readability of the abstract.

    ``query`` and ``text`` are arrays of words in order; years that are not numbers count as 2000.
    """
    shared = F.size(F.array_intersect(bigrams(query), bigrams(text)))
    weight = F.when(design == "meta_analysis", 30).when(design == "systematic_review", 24).when(design == "randomized_trial", 26).when(design == "observational", 10).when(design == "protocol", -55).otherwise(0)
    recency = F.coalesce(F.try_to_number(F.regexp_extract(F.coalesce(year, F.lit("")), "^([0-9]{4})", 1), F.lit("9999")).cast("int") - 2000, F.lit(0))
    length = F.length(F.trim(F.coalesce(abstract, F.lit(""))))
    readable = F.when(length > 0, F.least(F.lit(12.0), length / 120.0)).otherwise(-12.0)
    return 80 * overlap_share(F.array_distinct(query), F.array_distinct(text)) + 20 * F.least(F.lit(2), shared) + weight + F.when(human, 12).otherwise(0) + 0.25 * F.greatest(F.lit(0), F.least(F.lit(30), recency)) + readable


def rerank_head(ranked: DataFrame, group: list[str], position: str, scores: list[str], head: int = 10, weights: tuple[float, ...] = (1.0, 1.1), k: int = 20) -> DataFrame:
    """``ranked`` with ``final``: the first ``head`` rows reordered by weighted reciprocal ranks of several scores, the tail untouched."""
    inside = F.col(position) <= head
    out = ranked
    for i, s in enumerate(scores):
        out = out.withColumn(f"_r{i}", F.row_number().over(Window.partitionBy(*group, inside).orderBy(F.desc_nulls_last(s), position)))
    fused = reduce(lambda a, b: a + b, (w / (k + F.col(f"_r{i}")) for i, w in zip(range(len(scores)), weights)))
    out = out.withColumn("_f", F.when(inside, fused))
    order = F.row_number().over(Window.partitionBy(*group).orderBy(F.when(inside, 0).otherwise(1), F.desc_nulls_last("_f"), position))
    return out.withColumn("final", order).drop("_f", *(f"_r{i}" for i in range(len(scores))))


def three_slots(ranked: DataFrame, group: list[str], rank: str, section: str, quality: Column, complement: str | None = None) -> DataFrame:
    """``ranked`` with ``slot`` 1..3: the best row; the complement (else the next row); of the next three the first of good quality in a new section.

    If none of the three is of good quality all three count; if no section is new, the first of them is taken.
    """
    w = Window.partitionBy(*group).orderBy(rank)
    whole = Window.partitionBy(*group)
    base = ranked.withColumn("_n", F.row_number().over(w)).withColumn("_good", F.coalesce(quality, F.lit(False)))
    wanted = F.min(F.when((F.col("_n") > 1) & (F.col(complement) if complement else F.lit(False)), F.col("_n"))).over(whole)
    second = base.withColumn("_second", F.coalesce(wanted, F.lit(2)))
    marked = second.withColumn("_rest", F.col("_n") - 1 - (F.col("_n") > F.col("_second")).cast("int")).withColumn("_pool", (F.col("_n") > 1) & (F.col("_n") != F.col("_second")) & (F.col("_rest") <= 3))
    used = F.array_distinct(F.collect_list(F.when((F.col("_n") == 1) | (F.col("_n") == F.col("_second")), F.col(section))).over(whole))
    flagged = marked.withColumn("_used", used).withColumn("_any", F.max(F.when(F.col("_pool"), F.col("_good"))).over(whole))
    fit = F.col("_pool") & (F.col("_good") | ~F.coalesce(F.col("_any"), F.lit(False)))
    key = F.when(fit, F.struct(F.array_contains("_used", F.col(section)).cast("int").alias("a"), F.col("_n").alias("b")))
    third = flagged.withColumn("_third", F.min(key).over(whole)["b"])
    slot = F.when(F.col("_n") == 1, 1).when(F.col("_n") == F.col("_second"), 2).when(F.col("_n") == F.col("_third"), 3)
    return third.withColumn("slot", slot).drop("_n", "_good", "_second", "_rest", "_pool", "_used", "_any", "_third")


def visible(candidates: DataFrame, run: list[str], newest: Column, score: Column, age: Column, id_col: str, limit: int = 8, latest: int = 4) -> DataFrame:
    """``candidates`` with ``slot``: at most ``latest`` of the newest batch by age, then the history by score, then what is left by age."""
    w = Window.partitionBy(*run)
    first = candidates.withColumn("_new", F.coalesce(newest, F.lit(False)))
    placed = first.withColumn("_p", F.row_number().over(Window.partitionBy(*run, "_new").orderBy(F.asc(age) if isinstance(age, str) else age.asc(), id_col)))
    tier = F.when(F.col("_new") & (F.col("_p") <= latest), 0).when(~F.col("_new"), 1).otherwise(2)
    ordered = placed.withColumn("_t", tier).withColumn("slot", F.row_number().over(w.orderBy("_t", F.when(F.col("_t") == 1, -F.coalesce(score, F.lit(0.0))).otherwise(F.col("_p").cast("double")), "_p", id_col)))
    return ordered.where(F.col("slot") <= limit).drop("_new", "_p", "_t")


def unread_first(candidates: DataFrame, run: list[str], position: str, state: str) -> DataFrame:
    """Visible candidates, unread before read, each in its old order; blocked and exhausted ones are left out."""
    open_ = candidates.where(~F.coalesce(F.col(state), F.lit("unread")).isin("blocked", "exhausted"))
    read = (F.coalesce(F.col(state), F.lit("unread")) != "unread").cast("int")
    return open_.withColumn("slot", F.row_number().over(Window.partitionBy(*run).orderBy(read, position)))


def merge_pools(new: DataFrame, kept: DataFrame, run: list[str], id_col: str, position: str, limit: int) -> DataFrame:
    """(run, id, slot): two pools interleaved by position, the new one first, each id once."""
    both = new.select(*run, id_col, position, F.lit(0).alias("_l")).unionByName(kept.select(*run, id_col, position, F.lit(1).alias("_l")))
    first = both.groupBy(*run, id_col).agg(F.min(F.struct(position, "_l")).alias("_at"))
    return first.withColumn("slot", F.row_number().over(Window.partitionBy(*run).orderBy("_at", id_col))).where(F.col("slot") <= limit).drop("_at")


def above_threshold(scored: DataFrame, group: list[str], score: str, id_col: str, least: float, top: int) -> DataFrame:
    """The best ``top`` rows per group with a score of at least ``least``; NULL scores never count."""
    ranked = scored.where(F.col(score) >= least).withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(score), id_col)))
    return ranked.where(F.col("rank") <= top)


def citation_fit(claim: Column, source: Column) -> Column:
    """-1 if a number of the claim is missing in the source, else the share of the claim's words that stand in it."""
    numbers = lambda c: F.regexp_extract_all(c, F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0))
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z]{3,}"), F.lit(0)))
    return F.when(F.size(F.array_except(numbers(claim), numbers(source))) > 0, -1.0).otherwise(overlap_share(words(claim), words(source)))


@F.pandas_udf(T.StringType())
def byte_prefix(text: pd.Series, limit: pd.Series) -> pd.Series:
    """Longest prefix of at most ``limit`` UTF-8 bytes that cuts no character. NULL gives NULL."""
    return pd.Series([None if t is None else t.encode()[: max(0, int(n))].decode("utf-8", "ignore") for t, n in zip(text, limit)], dtype=object)


def anchored_query(question: Column, focus: Column, question_bytes: int = 640, focus_bytes: int = 320) -> Column:
    """The question once and the focus twice, each cut to its bytes; blank parts are left out."""
    q, f = byte_prefix(question, F.lit(question_bytes)), byte_prefix(focus, F.lit(focus_bytes))
    return F.array_join(F.filter(F.array(q, f, f), lambda x: F.trim(x) != ""), "\n")


def fused(df: DataFrame, group: list[str], first: str, second: str, tie: list[str], pool: int = 8, keep: int = 12, eligible: Column | None = None) -> DataFrame:
    """``df`` with (r1, r2, rrf, rank): union of the best ``pool`` of two scores, at most ``keep`` by reciprocal ranks.

    Ranks are taken over all rows; rows that are not eligible can't enter the pools.
    """
    by = lambda c, part: Window.partitionBy(*part).orderBy(F.desc(F.coalesce(F.col(c), F.lit(0.0))), *tie)
    ranked = df.withColumn("r1", F.row_number().over(by(first, group))).withColumn("r2", F.row_number().over(by(second, group)))
    if eligible is not None:
        ranked = ranked.where(F.coalesce(eligible, F.lit(False)))
        p1 = F.row_number().over(Window.partitionBy(*group).orderBy("r1"))
        p2 = F.row_number().over(Window.partitionBy(*group).orderBy("r2"))
        ranked = ranked.withColumn("_p", F.least(p1, p2)).where(F.col("_p") <= pool).drop("_p")
    else:
        ranked = ranked.where(F.least("r1", "r2") <= pool)
    scored = ranked.withColumn("rrf", reciprocal_rank("r1", "r2"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("rrf"), *tie))).where(F.col("rank") <= keep)
