"""Cleaning of fetched pages and documents: blocks, sections, lines, spans, languages (CLN)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LINK = r"\[([^\]\[]*)\]\([^()\s]*\)"
#: Ends of sentences, and words of assertions that keep a short text; one pattern each for both engines.
SENTENCE_END = r"[.!?。！？](\s|$)"
ASSERTION = r"(?i)\b(should|must|avoid|recommended|contraindicated|reduced|increased|improved|enrolled|randomi[sz]ed|excluded|associated with|confidence interval)\b|[0-9] ?%"
#: Spans of a page that are no text: pictures, placeholders of templates, publication dates, trackers.
EXCLUDED = r"!\[[^\]]*\]\([^()\s]*\)|\{\{[^{}]*\}\}|(?i:(published online|last reviewed|page last updated)\s*:?\s*[0-9]{4}-[0-9]{2}-[0-9]{2})|https?://[^\s()]*[?&]utm_[^\s()]*"
#: Lines of a page that never belong to a passage, matched as a whole.
TEMPLATE_LINE = r"(?i)\s*(advertisement|share|print|back to top|read more|show more|menu|skip to (main )?content|table of contents|continue reading|article continues below|follow us|subscribe)\s*[:.]?\s*"


def count_matches(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0))


def is_prose(text: Column) -> Column:
    """At least 180 characters and two sentence ends."""
    return (F.length(text) >= 180) & (count_matches(text, SENTENCE_END) >= 2)


def text_blocks(df: DataFrame, id_col: str, text: Column) -> DataFrame:
    """(id, block_no, block): the non-blank blocks between blank lines, numbered from 1. NULL and blank texts give no row."""
    pieces = F.split(F.regexp_replace(text, r"\r", ""), r"\n[ \t]*\n")
    return df.select(F.col(id_col), F.posexplode(pieces).alias("_p", "block")).where(F.trim(F.regexp_replace("block", r"\s+", " ")) != "").select(id_col, (F.col("_p") + 1).alias("block_no"), "block")


def link_density(block: Column) -> Column:
    """Characters of link texts over characters of the text with links opened; 0 for a block without text."""
    linked = F.aggregate(F.regexp_extract_all(block, F.lit(LINK), F.lit(1)), F.lit(0), lambda s, x: s + F.length(x))
    return F.coalesce(linked / F.nullif(F.length(F.regexp_replace(block, LINK, "$1")), F.lit(0)), F.lit(0.0))


def dropped_block(block: Column, hinted: Column) -> Column:
    """Whether a block is a list of links: hinted by its form, density of 0.65 or more, at most 1,400 characters, and no prose."""
    return hinted & (link_density(block) >= 0.65) & (F.length(block) <= 1_400) & ~is_prose(block)


def publication_shape(heading: Column, text: Column) -> Column:
    """Kind of a section that is apparatus of a publication, by its form: descriptor list, resource catalogue, contact line, index; NULL for all else.

    Text with an assertion or a table row is never apparatus. NULL texts and headings match nothing.
    """
    kept = F.coalesce(text.rlike(ASSERTION), F.lit(False)) | F.coalesce(F.contains(text, F.lit("|")), F.lit(False))
    head = F.lower(F.trim(F.coalesce(heading, F.lit(""))))
    return (
        F.when(kept, F.lit(None).cast("string"))
        .when((count_matches(text, r"\bD[0-9]{6,9}\b") >= 3) & (F.length(text) <= 1_200), "descriptor_list")
        .when((count_matches(text, r"(?i)\b(quick reference guide|slide set|checklist|podcast|download|fact sheet|video|toolkit)\b") >= 3) & (F.length(text) <= 4_000), "resource_catalogue")
        .when(text.rlike(r"(?i)^\s*(correspondence|contact|e-?mail)\s*:") & (F.length(text) <= 400), "contact")
        .when(head.isin("clinical guidelines", "guidelines", "site directory", "guidelines in development") & (F.length(text) <= 800), "index")
    )


def protected_short(text: Column, most: int = 320) -> Column:
    """Whether a short text asserts something and so is never dropped."""
    return F.coalesce((F.length(text) <= most) & text.rlike(ASSERTION), F.lit(False))


def retained_spans(df: DataFrame, id_col: str, text: Column) -> DataFrame:
    """(id, span_no, start, end, span): what is left of a text between its excluded spans, character exact, blanks trimmed at both ends.

    Spans are numbered from 1 by place, offsets count from 0, and ``span`` equals the text from ``start`` to ``end``.
    NULL texts and texts that are excluded as a whole give no row.
    """
    cut = df.select(F.col(id_col), text.alias("_t")).where("_t is not null")
    cut = cut.withColumn("_k", F.split("_t", EXCLUDED)).withColumn("_x", F.regexp_extract_all("_t", F.lit(EXCLUDED), F.lit(0)))
    w = Window.partitionBy("_row").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    numbered = cut.select(id_col, F.monotonically_increasing_id().alias("_row"), "_k", "_x").select("*", F.posexplode("_k").alias("_p", "_s")).withColumn("_after", F.coalesce(F.length(F.try_element_at("_x", F.col("_p") + 1)), F.lit(0)))
    placed = numbered.withColumn("_at", F.coalesce(F.sum(F.length("_s") + F.col("_after")).over(w), F.lit(0)))
    lead = F.length("_s") - F.length(F.regexp_replace("_s", r"^\s+", ""))
    body = F.regexp_replace(F.regexp_replace("_s", r"^\s+", ""), r"\s+$", "")
    kept = placed.withColumn("start", (F.col("_at") + lead).cast("int")).withColumn("span", body).where("span != ''").withColumn("end", F.col("start") + F.length("span"))
    order = Window.partitionBy("_row").orderBy("start")
    return kept.withColumn("span_no", F.row_number().over(order)).select(id_col, "span_no", "start", "end", "span")


def section_audit(df: DataFrame, id_col: str, text: Column) -> DataFrame:
    """(id, section_no, heading, kind, chars, eligible): each section of a Markdown text with its fate.

    Sections begin at lines of 1 to 6 hash signs; what stands before the first is section 1 without a heading. ``kind``
    is the apparatus it is, 'empty', 'short' or 'content'; content and protected short texts are eligible.
    """
    pieces = F.split(F.concat(F.lit("\n"), F.regexp_replace(text, r"\r", "")), r"\n#{1,6} ")
    listed = df.select(F.col(id_col), F.posexplode(pieces).alias("_p", "_s"))
    heading = F.when(F.col("_p") > 0, F.trim(F.substring_index("_s", "\n", 1)))
    body = F.when(F.col("_p") > 0, F.regexp_replace("_s", r"^[^\n]*", "")).otherwise(F.col("_s"))
    rows = listed.withColumn("heading", heading).withColumn("_b", F.trim(F.regexp_replace(body, r"\s+", " ")))
    shape = publication_shape(F.col("heading"), F.col("_b"))
    kind = F.when(F.col("_b") == "", "empty").when(shape.isNotNull(), shape).when(protected_short(F.col("_b")) | (F.length("_b") >= 60), "content").otherwise("short")
    return rows.where("_p > 0 or _b != ''").withColumn("kind", kind).select(id_col, (F.col("_p") + 1).alias("section_no"), "heading", "kind", F.length("_b").alias("chars"), (F.col("kind") == "content").alias("eligible"))


def readable_body(audit: DataFrame, id_col: str) -> DataFrame:
    """(id, sections, eligible, readable): whether any section of a document is eligible."""
    return audit.groupBy(id_col).agg(F.count(F.lit(1)).alias("sections"), F.count_if("eligible").alias("eligible"), F.bool_or("eligible").alias("readable"))


def clean_lines(df: DataFrame, id_col: str, text: Column) -> DataFrame:
    """(id, line_no, start, end, line): the lines of a text that are no template lines, with their exact place; rows of tables always stay.

    Lines are numbered from 1, blank ones counted but not returned; offsets count from 0.
    """
    rows = df.select(F.col(id_col), F.monotonically_increasing_id().alias("_row"), F.split(text, "\n").alias("_l"))
    lines = rows.select(id_col, "_row", F.posexplode("_l").alias("_p", "line"))
    w = Window.partitionBy("_row").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    placed = lines.withColumn("start", F.coalesce(F.sum(F.length("line") + 1).over(w), F.lit(0)).cast("int")).withColumn("end", F.col("start") + F.length("line"))
    table = F.col("line").rlike(r"^\s*\|.*\|\s*$")
    kept = placed.where((F.trim("line") != "") & (table | ~F.col("line").rlike(f"^(?:{TEMPLATE_LINE})$")))
    return kept.select(id_col, (F.col("_p") + 1).alias("line_no"), "start", "end", "line")


def observation_status(chunks: DataFrame, keys: list[str], usable: Column, barrier: Column, status: str) -> DataFrame:
    """(keys, status): the status as it was where a chunk is usable, else 'access_blocked' with a barrier and 'source_unreadable' without."""
    g = chunks.groupBy(*keys).agg(F.bool_or(F.coalesce(usable, F.lit(False))).alias("_u"), F.bool_or(F.coalesce(barrier, F.lit(False))).alias("_b"), F.max(status).alias("_s"))
    return g.select(*keys, F.when(F.col("_u"), F.col("_s")).when(F.col("_b"), "access_blocked").otherwise("source_unreadable").alias("status"))


def body_blocks(blocks: DataFrame, id_col: str, least: int = 80) -> DataFrame:
    """``blocks`` (id, block_no, block) that lie between the first and the last dense block of a page, and protected short ones anywhere.

    A block is dense with at least ``least`` characters and a link density under 0.35. Pages without a dense block keep
    their protected blocks only.
    """
    dense = (F.length("block") >= least) & (link_density(F.col("block")) < 0.35)
    span = blocks.where(dense).groupBy(id_col).agg(F.min("block_no").alias("_lo"), F.max("block_no").alias("_hi"))
    joined = blocks.join(span, id_col, "left")
    inside = F.coalesce(F.col("block_no").between(F.col("_lo"), F.col("_hi")), F.lit(False))
    return joined.where(inside | protected_short(F.col("block"))).select(id_col, "block_no", "block")


def incomplete_table(text: Column, start: Column, end: Column, span_start: Column, span_end: Column) -> Column:
    """Whether a window shows part of a table: it holds two rows or more and begins after, ends before the table or in the middle of a row."""
    rows = count_matches(text, r"(?m)^\s*\|.*\|\s*$") >= 2
    dangling = F.coalesce(F.regexp_extract(text, r"([^\n]*)$", 1).rlike(r"^\s*\|.*[^|\s]\s*$"), F.lit(False))
    return rows & (F.coalesce(start > span_start, F.lit(False)) | F.coalesce(end < span_end, F.lit(False)) | dangling)


def source_requirement(required: Column, evidence_types: Column) -> Column:
    """Whether a source meets a requirement: 'any' always, one of the source's types otherwise; NULL for an empty or unknown requirement."""
    return F.when(required == "any", True).when(required.isNull() | (F.trim(required) == ""), F.lit(None).cast("boolean")).otherwise(F.coalesce(F.array_contains(evidence_types, required), F.lit(False)))


def language_matches(question: Column, answer: Column) -> Column:
    """Whether both are written in the same script, Latin or Han; NULL where either has too few letters to tell (under 12)."""

    def han_share(c: Column) -> Column:
        han, latin = count_matches(c, "[一-鿿]"), count_matches(c, "[A-Za-zÀ-ÿ]")
        return F.when(han + latin >= 12, han / (han + latin))

    q, a = han_share(question), han_share(answer)
    return (q >= 0.3) == (a >= 0.3)


def anchors_in_order(text: Column, anchors: Column) -> Column:
    """Places (from 1) of verbatim anchors that follow each other in a text without overlap, each found after the one before; NULL unless all are there."""
    found = F.aggregate(
        anchors, F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("places")),
        lambda s, a: F.struct(
            F.when((s["at"] > 0) & (F.call_function("locate", a, text, s["at"]) > 0), F.call_function("locate", a, text, s["at"]) + F.length(a)).otherwise(0).alias("at"),
            F.concat(s["places"], F.array(F.when(s["at"] > 0, F.call_function("locate", a, text, s["at"])).otherwise(0))).alias("places"),
        ),
    )
    return F.when(found["at"] > 0, found["places"])
