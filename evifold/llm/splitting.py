"""Cutting oversized texts into overlapping pieces at natural boundaries.

Each position of a text has a boundary strength. A sparse table over ``strength * 2**32 + position`` answers
"the strongest cut in this window, the rightmost of equals" in constant time; the next piece starts up to
``overlap`` characters before the cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 1_800, 200
PARAGRAPH, LINE, SENTENCE, CLAUSE, BLANK, IDEOGRAPH, ANY, NEVER = 7, 6, 5, 4, 3, 2, 1, 0
#: Positions for which one sparse table is built at a time; bounds memory, not results.
SEGMENT = 1 << 17

# fixed values: code points by class
_ENDS, _WIDE_ENDS = ".!?…", "。！？｡"
_CLAUSES, _WIDE_CLAUSES = ",;:", "，、；："
_CLOSERS = "\"'”’»)]}*_」』】）"
_BLANKS = [9, 11, 12, 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]
_BREAKS = [10, 13, 0x85, 0x2028, 0x2029]

_O, _SPACE, _BREAK, _END, _WIDE_END, _CLAUSE, _WIDE_CLAUSE, _CLOSER, _IDEO, _MARK = range(10)


def _classes() -> np.ndarray:
    t = np.zeros(0x10000, np.uint8)
    for lo, hi in ((0x2E80, 0x3000), (0x3040, 0xA000), (0xAC00, 0xD7B0), (0xF900, 0xFB00)):
        t[lo:hi] = _IDEO
    for lo, hi in ((0x300, 0x370), (0x483, 0x48A), (0x591, 0x5BE), (0x64B, 0x660), (0x93C, 0x93D), (0x93E, 0x950), (0xE31, 0xE32), (0xE34, 0xE3B), (0xE47, 0xE4F), (0x1AB0, 0x1B00), (0x1DC0, 0x1E00), (0x200C, 0x200E), (0x20D0, 0x2100), (0x3099, 0x309B), (0xFE00, 0xFE10), (0xFE20, 0xFE30)):
        t[lo:hi] = _MARK
    t[_BLANKS] = _SPACE
    t[_BREAKS] = _BREAK
    t[[ord(c) for c in _CLOSERS]] = _CLOSER
    t[[ord(c) for c in _CLAUSES]] = _CLAUSE
    t[[ord(c) for c in _ENDS]] = _END
    t[[ord(c) for c in _WIDE_ENDS]] = _WIDE_END
    t[[ord(c) for c in _WIDE_CLAUSES]] = _WIDE_CLAUSE
    return t


_TABLE = _classes()


def boundary_strengths(text: str) -> np.ndarray:
    """Strength of a cut before each position 0..n: blank line, line, sentence, clause, blank, ideograph, any, never."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(cp)
    out = np.full(n + 1, ANY, np.uint8)
    out[0] = out[n] = PARAGRAPH
    if n < 2:
        return out
    wide = np.minimum(cp, 0xFFFF).astype(np.uint16)
    k = _TABLE[wide]
    k[cp > 0xFFFF] = np.where((cp[cp > 0xFFFF] >= 0x20000) & (cp[cp > 0xFFFF] < 0x32000), _IDEO, _O)
    k[((cp >= 0x1F3FB) & (cp <= 0x1F3FF)) | ((cp >= 0xE0100) & (cp < 0xE01F0))] = _MARK
    prev, here = k[:-1], k[1:]
    s = out[1:n]
    s[(prev == _IDEO) | (here == _IDEO)] = IDEOGRAPH
    s[prev == _WIDE_CLAUSE] = CLAUSE
    s[prev == _WIDE_END] = SENTENCE
    space = (prev == _SPACE) | (prev == _BREAK)
    s[space] = BLANK
    # what stands before the run of blanks, closing marks skipped
    at = np.arange(n)
    solid = np.maximum.accumulate(np.where((k != _SPACE) & (k != _BREAK), at, -1))
    inner = np.maximum.accumulate(np.where((k != _SPACE) & (k != _BREAK) & (k != _CLOSER), at, -1))
    last, ending = solid[:-1], inner[:-1]
    near = space & (ending >= 0) & (last - ending <= 3)
    before = k[np.maximum(ending, 0)]
    s[near & (before == _CLAUSE)] = CLAUSE
    s[near & ((before == _END) | (before == _WIDE_END))] = SENTENCE
    # a wide full stop followed by closing marks: cut after them
    closed = (prev == _CLOSER) & (here != _CLOSER) & (before == _WIDE_END) & (np.arange(n - 1) - ending <= 3)
    s[closed] = SENTENCE
    s[(prev == _WIDE_END) & (here == _CLOSER)] = ANY
    newline = prev == _BREAK
    s[newline] = LINE
    breaks = np.concatenate(([0], np.cumsum((k == _BREAK) & ~((cp == 10) & np.concatenate(([False], cp[:-1] == 13))))))
    s[newline & (breaks[1:n] - breaks[np.maximum(last, 0)] >= 2)] = PARAGRAPH
    s[(prev == _BREAK) & (here == _BREAK) & (cp[:-1] == 13) & (cp[1:] == 10)] = NEVER
    inside = space & ((here == _BREAK) | ((here == _SPACE) & (prev == _SPACE)))
    s[inside] = np.minimum(s[inside], ANY)
    s[(here == _MARK) | (cp[:-1] == 0x200D)] = NEVER
    return out


class RangeMax:
    """Sparse table for the maximum of a range and the rightmost place of it, over windows of bounded length."""

    def __init__(self, strengths: np.ndarray, longest: int) -> None:
        level = (strengths.astype(np.int64) << 32) | np.arange(len(strengths), dtype=np.int64)
        self.levels = [level]
        width = 1
        while 2 * width <= min(longest, len(strengths)):
            level = np.maximum(level[:-width], level[width:])
            self.levels.append(level)
            width *= 2

    def best(self, lo: int, hi: int) -> tuple[int, int]:
        """(strength, position) of the strongest cut in lo..hi, both included."""
        k = (hi - lo + 1).bit_length() - 1
        level = self.levels[k]
        x = max(int(level[lo]), int(level[hi - (1 << k) + 1]))
        return x >> 32, x & 0xFFFFFFFF


def piece_spans(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Half-open spans of the pieces of ``text`` in order. An empty text has none, a short one has one."""
    if limit < 4 or not 0 <= overlap <= limit // 3:
        raise ValueError("limit must be at least 4 and overlap between 0 and a third of it")
    n = len(text)
    if n <= limit:
        return [(0, n)] if n else []
    strengths = boundary_strengths(text)
    spans, start, base, table = [], 0, 0, None
    while n - start > limit:
        if table is None or start + limit - base >= table_end - base:
            base = start
            table_end = min(n + 1, base + SEGMENT + limit + 1)
            table = RangeMax(strengths[base:table_end], limit)
        half, far = start + limit // 2, start + limit
        strength, cut = table.best(half - base, far - base)
        if strength <= IDEOGRAPH:  # no natural boundary there: look in the nearer part too
            other, place = table.best(start + overlap + 1 - base, half - base)
            if other > max(strength, IDEOGRAPH):
                strength, cut = other, place
        if strength == NEVER:
            cut = far - base
        cut += base
        spans.append((start, cut))
        if overlap:
            lo, hi = max(start + 1, cut - overlap), cut
            around = strengths[lo:hi]
            places = np.flatnonzero(around >= BLANK)
            if not len(places):
                places = np.flatnonzero(around >= IDEOGRAPH)
            if not len(places):
                places = np.flatnonzero(around >= ANY)
            start = lo + int(places[0]) if len(places) else lo
        else:
            start = cut
    spans.append((start, n))
    return spans


def split_oversized(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(item_id, piece_no, start_char, end_char, piece): every text as ordered pieces of at most ``limit`` characters.

    Pieces are exact slices: ``piece = text[start_char:end_char]``, the first starts at 0, the last ends with the
    text, and each next one starts at most ``overlap`` characters before the end of the one before, never after it.
    NULL and empty texts give no piece; blank ones give pieces as any other. Equal rows give equal pieces, an empty
    table none. Nothing is shuffled. Extra columns are never read.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, nos, lo, hi, out, held = [], [], [], [], [], 0
            for i, t in zip(batch.column(0), batch.column(1).to_pylist()):
                if not t:
                    continue
                i = i.as_py()
                for k, (a, b) in enumerate(piece_spans(t, limit, overlap)):
                    ids.append(i); nos.append(k); lo.append(a); hi.append(b); out.append(t[a:b])  # noqa: E702
                held += len(t)
                if held > 4_000_000:
                    yield _batch(ids, nos, lo, hi, out)
                    ids, nos, lo, hi, out, held = [], [], [], [], [], 0
            yield _batch(ids, nos, lo, hi, out)

    rows = df.select(F.col(id_col).cast("bigint").alias("item_id"), F.col(text_col).cast("string").alias("body"))
    return rows.where("length(body) > 0").mapInArrow(cut, "item_id bigint, piece_no int, start_char int, end_char int, piece string")


def _batch(ids: list, nos: list, lo: list, hi: list, out: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(nos, pa.int32()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32()), pa.array(out, pa.string())],
        names=["item_id", "piece_no", "start_char", "end_char", "piece"],
    )
