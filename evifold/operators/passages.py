"""Sections, chunks, spans and selection under budgets (CLN, CHK, BUD)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evifold.functions.ordered import running

SECTION = "title string, sections array<struct<heading:string,text:string>>"
_ARROW = pa.struct([("title", pa.string()), ("sections", pa.list_(pa.struct([("heading", pa.string()), ("text", pa.string())])))])
_DROPPED = frozenset("script style noscript svg nav header footer form template".split())
_BLOCKS = frozenset("p li div section article ul ol blockquote pre br td th tr table h1 h2 h3 h4 h5 h6 dd dt figcaption".split())


class _Sections(HTMLParser):
    """Streaming reader of a page: headings open sections, table rows become lines of cells, dropped elements give nothing."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.page_title = self.meta_title = ""
        self.first_heading: str | None = None
        self.sections: list[list] = [["", []]]
        self.buffer: list[str] = []
        self.dropped = 0
        self.inside: str | None = None
        self.row: list[str] | None = None

    def _flush(self) -> None:
        text = " ".join("".join(self.buffer).split())
        self.buffer = []
        if text:
            (self.row.append(text) if self.row is not None else self.sections[-1][1].append(text))

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _DROPPED:
            self._flush()
            self.dropped += 1
        if self.dropped:
            return
        if tag == "meta":
            held = dict(attrs)
            if held.get("name") == "citation_title":
                self.meta_title = held.get("content") or ""
        elif tag in _BLOCKS or tag == "title":
            self._flush()
            if tag == "tr":
                self.row = []
            elif tag == "title" or re.fullmatch("h[1-6]", tag):
                self.inside = tag

    def handle_endtag(self, tag: str) -> None:
        if tag in _DROPPED:
            self.dropped = max(0, self.dropped - 1)
            return
        if self.dropped or not (tag in _BLOCKS or tag == "title"):
            return
        if tag == self.inside:
            text = " ".join("".join(self.buffer).split())
            self.buffer, self.inside = [], None
            if tag == "title":
                self.page_title = text
            elif text:
                if tag == "h1" and self.first_heading is None:
                    self.first_heading = text
                self.sections.append([text, []])
            return
        self._flush()
        if tag == "tr" and self.row is not None:
            cells, self.row = self.row, None
            if cells:
                self.sections[-1][1].append(" | ".join(cells))

    def handle_data(self, data: str) -> None:
        if not self.dropped:
            self.buffer.append(data)


def html_sections(page: str) -> dict:
    """Title (first h1, citation title or title) and sections of an HTML page; sections without text are left out."""
    p = _Sections()
    p.feed(page)
    p.close()
    p._flush()
    return _result(p.first_heading or p.meta_title or p.page_title, p.sections)


def markdown_sections(page: str) -> dict:
    """Sections below ATX headings; the first heading of level one is the title; a text without headings is one section."""
    title, sections = "", [["", []]]
    for line in page.splitlines():
        m = re.match(r"(#{1,6})\s+(.*?)\s*#*$", line.strip())
        if m:
            if len(m.group(1)) == 1 and not title:
                title = m.group(2)
            sections.append([m.group(2), []])
        elif line.strip():
            sections[-1][1].append(" ".join(line.split()))
    return _result(title, sections)


def xml_sections(page: str) -> dict:
    """Title, abstract and body sections of an article in XML, whatever its namespaces; broken XML gives no section."""
    try:
        root = ElementTree.fromstring(page)
    except ElementTree.ParseError:
        return {"title": "", "sections": []}
    name = lambda e: e.tag.rsplit("}", 1)[-1].lower() if isinstance(e.tag, str) else ""
    text = lambda e: " ".join("".join(e.itertext()).split())
    title, sections = "", []
    for e in root.iter():
        if name(e) in ("article-title", "articletitle") and not title:
            title = text(e)
        elif name(e) in ("abstracttext",):
            sections.append([e.get("Label") or "Abstract", [text(e)]])
        elif name(e) in ("sec", "abstract"):
            heads = [c for c in e if name(c) == "title"]
            body = [text(c) for c in e if name(c) not in ("title", "sec", "abstracttext")]
            sections.append([text(heads[0]) if heads else name(e).title(), body])
    return _result(title, sections)


def _result(title: str, sections: list[list]) -> dict:
    kept = [{"heading": h or "Document", "text": "\n".join(b)} for h, b in sections if any(b)]
    return {"title": title, "sections": kept}


def parse_sections(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, title, sections): a document in HTML, XML or Markdown, told by its first characters.

    NULL texts give a NULL title and no sections. Nothing is shuffled, other columns are never read.
    """

    def one(text: str | None) -> dict:
        if text is None:
            return {"title": None, "sections": []}
        head = text[:200].lstrip().lower()
        if head.startswith("<?xml") and "<html" not in head:
            return xml_sections(text)
        return html_sections(text) if re.search(r"<!doctype html|<html|<body|<p>|<div", head) else markdown_sections(text)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parsed = pa.array([one(t) for t in batch.column(1).to_pylist()], _ARROW)
            yield pa.RecordBatch.from_arrays([batch.column(0), *parsed.flatten()], names=["item_id", "title", "sections"])

    rows = df.select(F.col(id_col).cast("bigint").alias("item_id"), F.col(text_col).cast("string").alias("body"))
    return rows.mapInArrow(scan, f"item_id bigint, {SECTION}")


def stride_chunks(df: DataFrame, id_col: str, text: Column, size: int = 1_800, stride: int = 1_600) -> DataFrame:
    """(id, chunk_no, chunk, digest): slices of fixed length at a fixed stride, the last one shorter. NULL and empty texts give none."""
    rows = df.select(F.col(id_col), text.alias("_t"), F.length(text).alias("_n")).where("_n > 0")
    count = F.greatest(F.lit(1), F.ceil((F.col("_n") - size) / stride).cast("int") + 1)
    listed = rows.select(id_col, "_t", F.explode(F.sequence(F.lit(0), count - 1)).alias("chunk_no"))
    chunk = F.substring(F.col("_t"), F.col("chunk_no") * stride + 1, F.lit(size))
    return listed.select(id_col, F.col("chunk_no").cast("bigint").alias("chunk_no"), chunk.alias("chunk")).withColumn("digest", F.sha2("chunk", 256))


def merge_intervals(df: DataFrame, key: list[str], start: str, end: str) -> DataFrame:
    """(key, island_start, island_end, n): unions of overlapping or touching intervals; NULL and reversed ones are left out."""
    sound = df.where(F.col(start) <= F.col(end))
    order = [F.col(start), F.col(end)]
    reach = F.max(end).over(Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    marked = sound.withColumn("_new", F.when(F.col(start) <= reach, 0).otherwise(1))
    island = marked.withColumn("_island", F.sum("_new").over(Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*key, "_island").agg(F.min(start).alias("island_start"), F.max(end).alias("island_end"), F.count(F.lit(1)).alias("n")).drop("_island")


def char_budget(df: DataFrame, group: list[str], rank: list[str], length: Column, budget: int) -> DataFrame:
    """``df`` with ``kept``: characters that each row gets when texts are taken in rank order until the budget is used up.

    A group may hold most of the rows; ``rank`` must tell its rows apart.
    """
    size = F.coalesce(length, F.lit(0)).cast("bigint")
    summed = running(df.withColumn("_size", size), group, [F.col(r) for r in rank], before={"_used": F.col("_size")})
    return summed.withColumn("kept", F.greatest(F.lit(0), F.least(F.col("_size"), F.lit(budget) - F.col("_used"))).cast("bigint")).drop("_size", "_used")


def fair_shares(sizes: Column, budget: int) -> Column:
    """Array of shares for an ordered array of sizes: each takes at most what is left over the items left, at least 1."""
    n = F.size(sizes)
    zero = F.struct(F.lit(budget).cast("bigint").alias("left"), F.array().cast("array<bigint>").alias("out"))

    def step(state: Column, size: Column) -> Column:
        items = n - F.size(state["out"])
        cap = F.when(state["left"] <= 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(state["left"] / items)))
        share = F.least(size.cast("bigint"), cap.cast("bigint"))
        return F.struct((state["left"] - share).alias("left"), F.concat(state["out"], F.array(share)).alias("out"))

    return F.aggregate(sizes, zero, step, lambda s: s["out"])


def preview_caps(group: list[str], total: int = 1_024, most: int = 128) -> Column:
    """Equal share of a total over the rows of a group, at most ``most``."""
    return F.least(F.lit(most), F.floor(F.lit(total) / F.count(F.lit(1)).over(Window.partitionBy(*group)))).cast("bigint")


def token_estimate(text: Column) -> Column:
    """Tokens without a tokenizer: the larger of bytes / 3.15 and 1.1 times words and Han characters, rounded up; 0 for NULL."""
    units = F.regexp_count(text, F.lit("[A-Za-z0-9]+|[㐀-鿿]"))
    return F.coalesce(F.greatest(F.ceil(F.octet_length(text) / 3.15), F.ceil(1.1 * units)), F.lit(0)).cast("bigint")


def dictionary(df: DataFrame, value: str, least_length: int, least_count: int = 2) -> DataFrame:
    """(value, code, n): long values that stand often, numbered by their digest; the lossless factoring of a column."""
    frequent = df.where(F.length(value) >= least_length).groupBy(value).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)
    return frequent.select(value, F.concat(F.lit("@"), F.substring(F.sha2(value, 256), 1, 16)).alias("code"), "n")


def packed_column(df: DataFrame, value: str, codes: DataFrame) -> DataFrame:
    """``df`` with ``packed``: the code of each value of a :func:`dictionary`, its own text otherwise, marked by a leading blank where it begins with the sign of a code.

    A code is shorter than any value of the dictionary, and each stands at least twice, so packing never adds.
    """
    joined = df.join(codes.select(F.col(value).alias("_v"), "code"), F.col(value) == F.col("_v"), "left").drop("_v")
    own = F.when(F.col(value).rlike("^ *@"), F.concat(F.lit(" "), F.col(value))).otherwise(F.col(value))
    return joined.withColumn("packed", F.coalesce("code", own)).drop("code")


def unpacked_column(df: DataFrame, packed: str, codes: DataFrame, value: str) -> DataFrame:
    """``df`` with ``value``: the text that :func:`packed_column` had; NULL stays NULL, a code that the dictionary lacks raises nothing and stays as it is."""
    joined = df.join(codes.select(F.col(value).alias("_v"), F.col("code").alias("_c")), F.col(packed) == F.col("_c"), "left")
    own = F.when(F.col(packed).rlike("^ +@"), F.substring(F.col(packed), 2, 1 << 30)).otherwise(F.col(packed))
    return joined.withColumn(value, F.coalesce("_v", own)).drop("_v", "_c")


def evidence_pack(df: DataFrame, run: list[str], order: list[str], source: str, text: Column, max_sources: int = 6, per_source: int = 3, budget: int = 2_400) -> DataFrame:
    """First-seen evidence: equal texts of a source once, at most six sources and three texts each, texts only whole if they fit.

    A smaller text after one that doesn't fit may still be taken; NULL and empty texts are left out.
    """
    rows = df.withColumn("_t", text).where("length(_t) > 0").withColumn("_k", F.md5(F.trim(F.regexp_replace("_t", r"\s+", " "))))
    once = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*run, source, "_k").orderBy(*order))).where("_r = 1")
    first = once.withColumn("_f", F.min(F.struct(*order)).over(Window.partitionBy(*run, source)))
    placed = first.withColumn("_s", F.dense_rank().over(Window.partitionBy(*run).orderBy("_f", source))).where(F.col("_s") <= max_sources)
    lists = placed.groupBy(*run, source).agg(F.array_sort(F.collect_list(F.struct(*order, F.length("_t").alias("n")))).alias("l"))
    zero = F.struct(F.lit(0).alias("used"), F.lit(0).alias("taken"))

    def step(state: Column, item: Column) -> Column:
        fits = (state["taken"] < per_source) & (state["used"] + item["n"] <= budget)
        return F.struct(F.when(fits, state["used"] + item["n"]).otherwise(state["used"]).alias("used"), (state["taken"] + fits.cast("int")).alias("taken"))

    packed = lists.select(*run, source, F.aggregate("l", zero, step).alias("p"))
    return packed.select(*run, source, F.col("p.taken").cast("bigint").alias("taken"), F.col("p.used").cast("bigint").alias("used"))


def best_sentences(df: DataFrame, id_col: str, query: Column, text: Column) -> DataFrame:
    """(id, sentence_no, f1): the sentence of each text with the best F1 of distinct words with the query, the first of equals."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)))
    rows = df.select(F.col(id_col), words(query).alias("_q"), F.posexplode(F.split(text, r"[.!?。！？]+[ \n]*")).alias("sentence_no", "_s"))
    scored = rows.withColumn("_w", words(F.col("_s"))).withColumn("_n", F.size(F.array_intersect("_q", "_w")))
    f1 = F.round(2.0 * F.col("_n") / (F.size("_q") + F.size("_w")), 6)
    found = scored.where("_n > 0").withColumn("f1", f1)
    best = found.groupBy(id_col).agg(F.max_by(F.struct("sentence_no", "f1"), F.struct(F.col("f1"), -F.col("sentence_no"))).alias("b"))
    return best.select(id_col, F.col("b.sentence_no").cast("bigint").alias("sentence_no"), "b.f1")
