"""Text that was decoded with the wrong character encoding: find it, and restore what can be restored.

Characters are mapped back to the bytes of a legacy encoding. Over those bytes runs an automaton of the
structure of UTF-8 (lead byte, right number of continuation bytes) that yields the maximal well-formed
multibyte spans; only those spans are decoded anew, as often as the damage was done. For single-byte legacy
encodings the automaton is compiled to a regular expression over the characters themselves. Damage between two single-byte or East Asian
encodings has no such structure; it is recognised by characters in places where no language puts them, and the
pair of encodings whose decoding removes all such places is taken.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 8

# fixed values: encodings that text was taken for, and encodings that it may have been in
TAKEN_FOR = ["cp1252", "cp1250", "cp1251", "iso8859_2", "iso8859_15", "cp437", "cp850", "mac_roman", "koi8_r", "cp866", "cp1254"]
TAKEN_FOR_WIDE = ["gbk", "cp932", "cp949", "big5", "euc_jp"]
SINGLE_PAIRS = [
    ("mac_roman", "cp1252"), ("cp850", "cp1252"), ("cp437", "cp1252"), ("cp1251", "cp1252"), ("koi8_r", "cp1252"), ("cp1250", "cp1252"),
    ("cp1252", "mac_roman"), ("cp1252", "cp850"), ("cp1252", "cp437"), ("cp1252", "cp1250"), ("iso8859_2", "cp1250"), ("cp1250", "iso8859_2"),
    ("cp1252", "iso8859_2"), ("cp1251", "cp1250"), ("cp1252", "cp1251"), ("cp1252", "koi8_r"), ("cp1252", "cp866"), ("cp1251", "koi8_r"), ("koi8_r", "cp1251"),
    ("cp1251", "cp866"), ("cp866", "cp1251"), ("mac_roman", "cp1251"), ("cp1252", "gbk"), ("cp1252", "euc_jp"), ("cp1252", "cp932"), ("cp1252", "big5"),
    ("cp1252", "cp949"), ("cp1251", "gbk"), ("gbk", "cp1252"), ("gbk", "euc_jp"), ("gbk", "cp932"), ("cp932", "gbk"), ("cp932", "euc_jp"), ("gbk", "big5"), ("big5", "gbk"),
]


@lru_cache(maxsize=None)
def _chars(codec: str) -> dict[int, str]:
    """Character of each high byte; undefined ones stand for the control character of the same number."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            out[b] = bytes([b]).decode(codec)
        except UnicodeDecodeError:
            out[b] = chr(b)
    return out


@lru_cache(maxsize=None)
def _bytes(codec: str) -> dict[int, int]:
    """Byte of each character beyond ASCII; control characters stand for themselves where the codec has none."""
    out = {b: b for b in range(0x80, 0xA0)}
    out.update({ord(c): b for b, c in _chars(codec).items()})
    return out


def _class(codec: str, lo: int, hi: int) -> str:
    chars = {_chars(codec)[b] for b in range(lo, hi + 1)} | {chr(b) for b in range(lo, min(hi, 0x9F) + 1)}
    return "[" + "".join(map(re.escape, sorted(chars))) + "]"


@lru_cache(maxsize=None)
def utf8_automaton(codec: str) -> re.Pattern[str]:
    """Maximal spans of characters whose bytes in ``codec`` are well-formed multibyte UTF-8."""
    c = lambda lo, hi: _class(codec, lo, hi)
    tail = c(0x80, 0xBF)
    three = f"{c(0xE0, 0xE0)}{c(0xA0, 0xBF)}{tail}|{c(0xED, 0xED)}{c(0x80, 0x9F)}{tail}|(?!{c(0xED, 0xED)}){c(0xE1, 0xEF)}{tail}{{2}}"
    four = f"{c(0xF0, 0xF0)}{c(0x90, 0xBF)}{tail}{{2}}|{c(0xF1, 0xF3)}{tail}{{3}}|{c(0xF4, 0xF4)}{c(0x80, 0x8F)}{tail}{{2}}"
    return re.compile(f"(?:{c(0xC2, 0xDF)}{tail}|{three}|{four})+")


UTF8_BYTES = re.compile(rb"(?:[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|\xed[\x80-\x9f][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2})+")
#: What text of the nine languages consists of beyond ASCII; what decoding must yield to be believed.
_USUAL = re.compile("[\\xa0-ÿœŒŸąćęłńśźżĄĆĘŁŃŚŹŻ\\u2010-\\u2040\\u2080-\\u2089≤≥€™αβΔА-яёЁ\\u3000-\\u30ff一-鿿\\uff01-\\uff5e]+")

# ---------------------------------------------------------------------------------------------- evidence
_LOW = "a-zß-öø-ÿœąćęłńśźż"
_UP = "À-ÖØ-ÞŒŸĄĆĘŁŃŚŹŻ"
_BOX = "─-▟⌐⌠⌡"
_ODD = "¡¢£¤¥¦¨©ª¬®¯°±²³´¶¸¹º»¼½¾¿×÷‚„†‡‰ˆ˜¯˘˙˚¸˝˛ˇƒ√∑∏∂∫≈≠≤≥∞◊ΓΘΣΦΩτδφεπⁿ₧"
_BOXES = re.compile("[А-яёЁ][─-▟]|[─-▟][А-яёЁ]|[─-▟]{2}")
_HAN = "㐀-䶿一-鿿豈-﫿㈠-㉿"
#: Places where no language of a text puts such characters, each alone enough.
PLACES = {
    "lost": re.compile("�"),
    "control": re.compile("[\x80-\x9f]"),
    "capital inside": re.compile(f"[{_LOW}][{_UP}](?=[{_LOW}'’.,;:]|$|\\s)"),
    "symbol inside": re.compile(f"[a-z][þð][a-z]|[A-Za-z{_UP}{_LOW}][{_ODD}·§][a-z]|(?<![^\\s(\\[*_#>-])[³²¹¬┐√∂ⁿ±÷][{_LOW}]{{2}}|[a-z]{{2}}[¾¼½¹³]+[a-z]|[A-Z]«?[√∂∑∏∫ƒ≈∆◊][A-Z]|(?<![^\\s])∑(?!\\S)|(?<![A-Za-z])ð[a-z]"),
    "small before capital": re.compile("(?<!\\w)[ß-öø-ÿ](?:[A-Z][a-z]|[A-Z]{2})|(?m:^)[òïëûõþðñçøù](?:$|\\s)"),
    "box": re.compile(f"[A-Za-zА-яёЁ{_LOW}][{_BOX}]|[{_BOX}][A-Za-zА-яёЁ{_LOW}]|[▒░▓]\\d|[├┬─ΓÔ][⌐çéÇôöª║®{_BOX}]"),
    "mixed scripts": re.compile("[A-Za-z][Ѐ-џ]|[Ѐ-џ][A-Za-z]"),
    "mac": re.compile("√[†-⁰©®ß∂-≥ºª±¥µÄÅÇÉÑÖÜáàâäãåçéèêëíìîïñóòôöõúùûü¢£§•¶™´¨ÆØ∏∫Ωæø¿¡¬«…]|¬[µ©∞±∑∑∏ªº∫ßÆø¿¡]|‚[ÄÇÅ][ôìî¶úù¢†°]|[≈ƒ][ÇÑÖÜáàâäãåçéèêëíìîïñóòôöõúùûü†°ôö]|∞C\\b|Œ[±≤îîº]"),
    "wide in cyrillic": re.compile("[Ѐ-ӿ][¤¦§©¬®±¶µ·†‡‰][Ѐ-ӿ]|[Ѐ-ӿ]\xad[Ѐ-ӿ]"),
    "high run": re.compile("[¡-ÿ]*[À-ÿ][¡-¿×÷]+[À-ÿ][¡-ÿ]*|[¡-ÿ]{5,}|(?:[‚ƒŠŽ][!-~¡-ÿŒœŠšŽžŸˆ˜–—‘’“”•…‰™]){3,}"),
    "half kana": re.compile("[縺繧繝邨郢隴][｡-ﾟ]|[｡-ﾟ][縺繧繝]|[A-Za-z][｡-ﾟ]{2}|[ﾃﾂ][｡-ﾟ]"),
}
#: The micro sign of a unit, read as another letter.
_UNIT = re.compile("\\d ?[^\\W\\d_\x00-\x7fµμкмнКМ]g(?![^\\W_])")
#: Places that count from the second on.
WEAK = re.compile("[ЂЃѓЉЊЌЋЏђљњќћџЎЈҐЅѕ]|[а-яё][А-Я]{2,}[а-я]?|[А-Я][а-я]?[°±µ‚ѓ„…†‡€‰‹‘’“”•–—™›¤¦§©«¬®·№»](?=[РСГВ])|(?:[ÐÑ][^\\s]){3}")
_RARE_SERBIAN = 3
#: Small Russian letters from the most to the least frequent; fixed values.
_FREQUENT = {c: k for k, c in enumerate("оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё")}
_CAPITAL_WORD = re.compile("[А-Я]{4,}")
_INVERTED, _CAPITALS, _SMALLS = re.compile("(?<![А-Яа-яё])[а-яё][А-Я]{3,}"), re.compile("[А-Я]"), re.compile("[а-яё]")
_WIDE = re.compile("[⺀-\U0010ffff]")
_HAN_RUN = re.compile(f"[{_HAN}]+[a-z]?")
_SYMBOL_RUN = re.compile("[À-ÿ]{4,}")
_BEYOND = re.compile("[^\x00-\x7f]+(?=([!-~]{0,2}))")
_UNICODE_LETTERS = re.compile("[A-Za-z]")
#: The automata that are run on every text with characters beyond ASCII.
_ALWAYS = ["cp1252", "cp437", "cp850", "cp1250", "iso8859_2", "iso8859_15", "cp1251", "koi8_r", "cp866", "mac_roman", "cp1254"]
_QUOTES = "»”’“‘›–—…°«‚„\xa0·"
_UPPER_WORD = re.compile(f"[A-Z{_UP}]$")


def _sample(text: str) -> str:
    """Runs of characters beyond ASCII with the character before and up to two after them, joined by blanks."""
    return " ".join(text[max(0, m.start() - 1) : m.end()] + m[1] for m in _BEYOND.finditer(text))


def _distinct(text: str) -> str:
    """The sample of a text with each run once."""
    return " ".join(dict.fromkeys(text[max(0, m.start() - 1) : m.end()] + m[1] for m in _BEYOND.finditer(text)))


def _sound_span(text: str, m: re.Match[str], codec: str) -> bool:
    """Whether a well-formed span is damage, not a capital that happens to stand before a closing mark."""
    span = m.group()
    if codec in ("koi8_r", "cp866"):  # letters alone are well-formed there too
        return bool(_BOXES.search(span)) and not span.isspace()
    if len(span) > 3:
        return not (codec == "cp1251" and all(c in _QUOTES for c in span[1::2]))
    if len(span) == 3:
        return True
    tail = span[1]
    if codec == "cp1251":
        return span[0] in "ГВЕДЖЗ" and tail not in "»”" and not re.match("[А-Яа-я]", text[m.end() : m.end() + 1])
    if codec == "mac_roman":
        return span[0] in "√¬≈ƒŒ" and not tail.isspace()
    if span[0] not in "ÂÃÄÅÐÑĂĹ├┬":
        return False
    if tail in _QUOTES:
        before, after = text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]
        if span[0] == "Â":
            return tail in "»«·°\xa0–—" and not _UPPER_WORD.match(before or " ")
        return not _UPPER_WORD.match(before or " ") and (after.isalpha() or before.isalpha() and before.islower() or tail == "\xa0")
    return True


def evidence(text: str) -> str | None:
    """Name of the first evidence of wrong decoding in ``text``; None for sound, empty and ASCII texts."""
    if text.isascii():
        return None
    t = _sample(text)
    for name, place in PLACES.items():
        if place.search(t):
            return name
    if _UNIT.search(text):
        return "unit"
    for codec in _ALWAYS:
        for m in utf8_automaton(codec).finditer(t):
            if _sound_span(t, m, codec):
                return codec
    if len(WEAK.findall(t)) >= _RARE_SERBIAN or _inverted_case(t) or _koi8_capitals(text):
        return "weak"
    for m in _HAN_RUN.finditer(t):
        if _wide_damage(m.group(), t, m, text):
            return "wide"
    if any("가" <= c <= "힣" for c in t) and _decoded_wide(t, "cp949"):
        return "cp949"
    runs = _SYMBOL_RUN.findall(t)
    if sum(len(r) for r in runs) >= 8 and sum(map(len, runs)) > 0.5 * sum(c.isalpha() and ord(c) > 127 for c in t):
        return "letters only beyond ascii"
    return None


def _inverted_case(t: str) -> bool:
    """Whether Cyrillic words begin small and go on in capitals, as KOI8-R does when it is read as cp1251."""
    return bool(_INVERTED.search(t)) and len(_CAPITALS.findall(t)) > 2 * len(_SMALLS.findall(t))


def _koi8_capitals(text: str) -> bool:
    """Whether the words in Cyrillic capitals are small Russian in cp1251 or KOI8-R that was read as the other: they are likelier words then."""
    words = _CAPITAL_WORD.findall(text)
    if sum(map(len, words)) < 6:
        return False
    rank = lambda x: sum(_FREQUENT.get(c, 2 * len(_FREQUENT)) for c in x)
    capitals = "".join(words)
    gain = max(rank(capitals.lower()) - rank(capitals.encode(taken).decode(true)) for taken, true in (("koi8_r", "cp1251"), ("cp1251", "koi8_r")))
    return gain > 2 * len(capitals)


def _wide_damage(run: str, t: str, m: re.Match[str], text: str) -> bool:
    """Whether a run of Han characters is UTF-8 that was read as a double-byte encoding."""
    return any(_wide_by(codec, run, t, m, text) for codec in ("gbk", "big5", "euc_jp", "cp949"))


def _wide_by(codec: str, run: str, t: str, m: re.Match[str], text: str) -> bool:
    han = run.rstrip("abcdefghijklmnopqrstuvwxyz")
    try:
        raw = run.encode(codec)
    except UnicodeEncodeError:
        return False
    spans = [s for s in UTF8_BYTES.finditer(raw) if _USUAL.fullmatch(s.group().decode())]
    covered = sum(s.end() - s.start() for s in spans)
    if len(han) >= 3:
        return covered >= 6 and covered >= 0.8 * len(raw) and max(s.end() - s.start() for s in spans) >= 6
    if not spans or covered < len(raw) - 1:
        return False
    before, after = t[m.start() - 1 : m.start()], t[m.end() : m.end() + 1]
    if "a" <= before <= "z" and run != han and len(han) <= 2 and all("\xc0" <= c <= "\xff" for c in raw[: -1].decode("utf-8", "replace")):
        return True  # a letter with an accent inside a Latin word, in a text of any language
    latin = ("a" <= before <= "z" or "A" <= before <= "Z") and (run != han or after.isalpha() and after.isascii()) or run != han and before in ("", " ") or ("a" <= before <= "z" and not after.isalpha())
    few = len(_WIDE.findall(text)) < 0.25 * len(text)
    return bool(latin and few)


def _decoded_wide(t: str, codec: str) -> bool:
    raw = t.encode(codec, "ignore")
    return sum(len(s) for s in UTF8_BYTES.findall(raw)) >= 2 and bool(re.search("[A-Za-z][가-힣]|[가-힣][a-z]", t))


# ---------------------------------------------------------------------------------------------- restoring
def _decode_spans(text: str, codec: str, sure: bool) -> str:
    table = _bytes(codec)

    def back(m: re.Match[str]) -> str:
        if not sure and not _sound_span(text, m, codec):
            return m.group()
        return bytes(table[ord(c)] for c in m.group()).decode("utf-8")

    return utf8_automaton(codec).sub(back, text)


def _decode_wide(text: str, codec: str) -> str:
    def back(m: re.Match[str]) -> str:
        try:
            raw = m.group().encode(codec)
        except UnicodeEncodeError:
            return m.group()
        try:
            return raw.decode("utf-8")
        except UnicodeDecodeError:
            return _span_by_span(m.group(), raw, codec)

    return re.sub("[^\x00-\x7f]+[a-z]?", back, text)


def _span_by_span(run: str, raw: bytes, codec: str) -> str:
    """The well-formed spans of ``raw`` decoded, all between them as it was, where spans end between characters."""
    ends, at = {0: 0}, 0
    for k, c in enumerate(run):
        at += len(c.encode(codec))
        ends[at] = k + 1
    out, last = [], 0
    for m in UTF8_BYTES.finditer(raw):
        if m.start() in ends and m.end() in ends:
            out += [run[last : ends[m.start()]], m.group().decode("utf-8")]
            last = ends[m.end()]
    return "".join(out) + run[last:]


def _recode(text: str, taken: str, true: str, only_damaged: bool = False) -> str:
    """Runs of characters beyond ASCII, brought back to bytes of ``taken`` and decoded as ``true`` where that works.

    With ``only_damaged``, words without evidence of their own stay as they are.
    """

    def back(m: re.Match[str]) -> str:
        try:
            raw = m.group().encode(taken) if taken in ("gbk", "cp932", "big5") else bytes(_bytes(taken)[ord(c)] if ord(c) > 127 else ord(c) for c in m.group())
            return raw.decode(true)
        except (UnicodeError, KeyError):
            return m.group()

    wide_in, wide_out = taken in ("gbk", "cp932", "big5"), true in ("gbk", "cp932", "euc_jp", "big5", "cp949")
    runs = re.compile("[^\x00-\x7f][^\x00-\x20]*" if true in ("cp932", "big5") else "[^\x00-\x7f]+[a-z]?" if wide_in and not wide_out else "[^\x00-\x7f]+")
    if only_damaged:
        return re.sub("[^\\s\x00-\x1f]+", lambda m: runs.sub(back, m.group()) if _word_damage(m.group()) else m.group(), text)
    return runs.sub(back, text)



#: Characters that decoding should not leave behind: beyond the usual ones, arrows, bullets and frames of sound texts.
_UNUSUAL = re.compile("[^\x00-\x7f\xa0-ÿœŒŸąćęłńśźżĄĆĘŁŃÓŚŹŻ\u2010-\u2040\u2080-\u2089≤≥€™αβΔА-яёЁ\u3000-\u30ff一-鿿\uff01-\uff5e│▾→]")
_PLAUSIBLE = re.compile("[àáâäãçèéêëíîïñóôöõúùûüßœąćęłńśźżµ°’“”–—…≥±]|[а-яё]{3}|[぀-ヿ]|[一-鿿]{2}|。|、")


def damage(text: str) -> int:
    """Number of places of any evidence; lower is better, 0 for sound texts."""
    if text.isascii():
        return 0
    t = _sample(text)
    n = sum(len(p.findall(t)) for p in PLACES.values())
    for codec in _ALWAYS:
        n += sum(_sound_span(t, m, codec) for m in utf8_automaton(codec).finditer(t))
    n += len(_UNUSUAL.findall(t)) + len(_UNIT.findall(text))
    weak = len(WEAK.findall(t))
    n += weak if weak >= _RARE_SERBIAN else 0
    n += sum(_wide_damage(m.group(), t, m, text) for m in _HAN_RUN.finditer(t))
    n += sum(map(len, _CAPITAL_WORD.findall(text))) if _koi8_capitals(text) else 0
    n += len(_CAPITALS.findall(t)) if _inverted_case(t) else 0
    return n + sum(len(r) for r in _SYMBOL_RUN.findall(t))


@lru_cache(maxsize=50_000)
def _word_damage(word: str) -> int:
    return damage(word)


def _rank(text: str) -> tuple[int, int]:
    """Order of attempts: least damage, then most usual characters."""
    return damage(text), -len(_PLAUSIBLE.findall(text))


@lru_cache(maxsize=1)
def _steps() -> list[Callable[[str], str]]:
    """All ways to decode anew, by encoding: only spans that are damage by themselves, or all well-formed ones."""
    spans = [lambda t, c=c, sure=sure: _decode_spans(t, c, sure) for sure in (False, True) for c in TAKEN_FOR]
    return spans + [lambda t, c=c: _decode_wide(t, c) for c in TAKEN_FOR_WIDE]


def _again(step: Callable[[str], str], sample: str) -> tuple[tuple[int, int], int]:
    """Best rank of a sample after a step made once or, where it goes on changing it, up to ROUNDS times; and how often."""
    best, t = (_rank(sample), 0), sample
    for n in range(1, ROUNDS + 1):
        new = step(t)
        if new == t:
            break
        t = new
        best = min(best, (_rank(t), n))
        if not best[0][0]:
            break
    return best


def restore(text: str) -> str:
    """``text`` with its damaged spans decoded anew; equal to ``text`` where nothing could be restored.

    Attempts are compared on the characters beyond ASCII and their neighbours only; the best is then made on the text.
    """
    if text.isascii() or not damage(text):
        return text
    best = text
    for _ in range(ROUNDS):
        sample = _distinct(best)
        now = _rank(sample)
        if not now[0]:
            break
        (rank, times), k = min((_again(step, sample), k) for k, step in enumerate(_steps()))
        if rank[0] >= now[0] or not times:
            break
        for _ in range(times):
            best = _steps()[k](best)
    left = damage(best)
    if left and (c1 := re.sub("[\x80-\x9f]", lambda m: _chars("cp1252")[ord(m.group())], best)) != best and damage(c1) < left:
        best, left = c1, damage(c1)
    if left:
        ways = [(x, w, t, k) for x in dict.fromkeys((best, text)) for w, t in SINGLE_PAIRS for k in (False, True)]
        samples = {x: _distinct(x) for x in (best, text)}
        ranked = [(_rank(_recode(samples[x], w, t, k)), i) for i, (x, w, t, k) in enumerate(ways)]
        if min(ranked)[0][0] < left:
            tried = _recode(*ways[min(ranked)[1]])
            best = tried if damage(tried) < left else best
    return best


# ---------------------------------------------------------------------------------------------- operators
def find_wrong_decoding(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """(item_id, evidence) of each row whose text shows wrong decoding; with ``with_text`` also (restored, complete).

    ``restored`` is the text with its damaged spans decoded anew, ``complete`` tells whether no evidence is left in
    it (lost characters can't come back). NULL, empty and ASCII texts are sound and give no row; rows that stand twice
    come out twice; an empty table gives no rows. Nothing is shuffled, and extra columns are never read.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, t in enumerate(batch.column(1).to_pylist()):
                if (why := evidence(t)) is not None:
                    if with_text:
                        mended = restore(t)
                        rows.append((i, why, mended, evidence(mended) is None))
                    else:
                        rows.append((i, why, None, None))
            ids = batch.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
            columns = [ids, pa.array([r[1] for r in rows], pa.string())]
            if with_text:
                columns += [pa.array([r[2] for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["item_id", "evidence", "restored", "complete"][: 4 if with_text else 2]
    schema = "item_id bigint, evidence string" + (", restored string, complete boolean" if with_text else "")
    rows = df.select(F.col(id_col).cast("bigint").alias("item_id"), F.col(text_col).cast("string").alias("body"))
    return rows.where("length(body) > 0 and octet_length(body) > length(body)").mapInArrow(scan, schema)
