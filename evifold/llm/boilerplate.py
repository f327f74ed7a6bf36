"""Main body of web pages: which lines belong to the article and which to the furniture of the site.

A page goes line by line through the standard library's streaming HTML parser, its Markdown marks counted as the tags
they stand for. The lines of a wrapped paragraph or of a table form a block. The text-to-tag ratio of each block is
taken, smoothed along the page with a Gaussian kernel, and a threshold between the two clusters of the smoothed ratios
marks the dense blocks. Neighbouring dense blocks form the regions of content; a region that holds little beside the
largest one is none. Heads, titles and bylines go with the region below them, all other lines are furniture.

The wording of furniture in four languages is a feature of the ratio: listed wording counts as one tag per character,
so that a notice of full sentences, which has no tags of its own, shows. ``wording=False`` leaves that out.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Width of the kernel in blocks, and the range of ratios in which the threshold of a page lies.
SIGMA, LEAST_RATIO, MOST_RATIO = 0.6, 18, 24
#: Characters of a sentence that may be content by itself, and that is content whatever stands around it; and both for
#: a sentence that was looked up in the wording and isn't listed.
SENTENCE_CHARS, SURE_CHARS = 50, 90
UNLISTED_CHARS, UNLISTED_SURE_CHARS = 10, 45
#: A table counts as text of this ratio, as its bars are no tags of furniture.
TABLE_RATIO = 120
#: Blocks without density that a region may span, and short lines above it that go with it as title, byline and head.
GAP, HEADS = 2, 5
#: Share of the largest region's characters that a region needs, without and with the wording, and what is always enough.
SHARE, SHARE_WORDED, ENOUGH_CHARS = 0.2, 0.05, 400
#: Share of the threshold that a sentence at the edge of a region needs.
ABOVE, BELOW = 0.8, 0.9
#: Longest line whose wording is kept for other pages that have it too; longer ones are looked at each time.
KEPT_CHARS = 300

# fixed values: wording of site furniture by language (en, de, fr, es), matched against a whole line or sentence
LABELS = (
    "home|news|topics|treatments|conditions|events|archive|help|donate|careers|podcasts|journals|guidelines|authors|about us|about|contact|contact us|for professionals|clinical tools|drugs a-z|"
    "menu|search|login|log in|sign in|register|subscribe|support us|our team|videos|blog|shop|store|faq|faqs|resources|"
    "startseite|aktuelles|leitlinien|erkrankungen|behandlung|kontakt|suche|über uns|für fachkreise|impressum|datenschutz|barrierefreiheit|anmelden|registrieren|presse|"
    "accueil|actualités|maladies|traitements|professionnels|recommandations|à propos|mentions légales|confidentialité|accessibilité|se connecter|s'inscrire|recherche|"
    "inicio|noticias|guías|enfermedades|tratamientos|profesionales|quiénes somos|contacto|aviso legal|privacidad|accesibilidad|iniciar sesión|registrarse|buscar|"
    "privacy policy|privacy|terms of use|terms|accessibility|site map|sitemap|advertise with us|press office|cookies|imprint|english|español|français|deutsch|português|italiano|print|copy link|email|e-mail|correo|imprimir|imprimer|drucken"
)
BOX_HEADS = (
    "in this collection|related articles|related content|related|you may also like|most read|most popular|editors' picks|editor's picks|popular topics|latest from the newsroom|latest news|more on this topic|read next|recommended for you|further reading on this site|"
    "das könnte sie auch interessieren|ähnliche beiträge|meistgelesen|mehr zum thema|verwandte artikel|"
    "à lire aussi|articles liés|les plus lus|sur le même sujet|"
    "también le puede interesar|artículos relacionados|lo más leído|más sobre este tema"
)
BUTTONS = (
    "accept all|accept|decline|reject all|reject optional|ok, got it|got it|manage preferences|cookie settings|save my choices|back to top|skip to main content|skip to content|toggle navigation|search this site|print this page|print|share|share this page|follow this topic|follow us|"
    "article continues below|advertisement|sponsored content from a partner|sponsored|sponsored content|continue reading|load more|show more|close|subscribe now|sign up|text size: a a a|menu|search|"
    "alle akzeptieren|nur notwendige|einstellungen ändern|ablehnen|zum inhalt springen|nach oben|anzeige|jetzt newsletter abonnieren|schriftgrösse ändern|werbung|"
    "tout accepter|continuer sans accepter|gérer mes choix|tout refuser|aller au contenu|haut de page|publicité|recevez notre lettre d'information|"
    "aceptar todo|rechazar|configurar|saltar al contenido|volver arriba|publicidad|suscríbase a nuestro boletín"
)
NOTICES = [
    r"[âa]?© ?\d{4}\b.*", r".*\ball rights reserved", r".*\balle rechte vorbehalten", r".*\btous droits réservés", r".*\btodos los derechos reservados",
    r"powered by the .+ content platform.*", r"powered by \S+", r"version \d+\.\d+", r"page generated in [\d.]+ ?s", r"stay connected with .*", r".* newsletters, alerts and more",
    r".* is an independent publisher", r"the material on this site is for .*", r".*does not replace (?:the )?advice from a qualified professional", r"no part of this website may be .*", r"registered office: .*", r"company no\. ?\d+",
    r"your privacy matters", r"choose which optional technologies we may use", r"some features need small files placed on your computer", r"to give you the best service we measure how pages are used",
    r"we and our \d+ partners store and access information .*", r"we use cookies to .*", r"this website (?:stores data such as|uses) cookies .*", r"by continuing to browse you agree to our use of cookies",
    r"sign up for free to read \d+ more articles.*", r"get our (?:weekly|daily|monthly)? ?digest in your inbox", r"was this page helpful\?.*", r"share this (?:page|article):.*", r"download pdf \(.*\)", r"listen to this article.*", r"my account(?: \(.*\))?", r"text size:.*",
    r"sign in \| register", r"(?:subscribe|sign up|register) (?:to|for) our .*", r"(?:log in|sign in|sign up) to .*", r"accept +decline", r"subscribe to our newsletter.*", r"follow us on .*",
    r"wir verwenden cookies.*", r"mit ihrer zustimmung erheben wir nutzungsdaten.*", r"die inhalte dieser website ersetzen keine .*", r"war diese seite hilfreich\?.*", r"artikel teilen:.*", r"seite teilen:.*", r"anmelden \| registrieren",
    r"ce site utilise des cookies.*", r"avec votre accord, nos \d+ partenaires .*", r"les informations de ce site ne remplacent pas .*", r"cette page vous a-t-elle aidée? ?\?.*", r"partager cet article ?:.*", r"partager cette page ?:.*", r"se connecter \| s'inscrire",
    r"utilizamos cookies .*", r"con su permiso, nosotros y \d+ socios .*", r"este sitio no sustituye .*", r"¿le ha resultado útil esta página\?.*", r"compartir:.*", r"iniciar sesión \| registrarse",
]
#: How a notice begins that may go on over the following lines of a wrapped page.
OPENINGS = [
    r"powered by the \S+ content\b.*", r".* is an independent publisher\. .*", r"the material on this site is for .*", r"no part of this website may .*", r"registered office:.*", r"we and our \d+ partners .*", r"to give you the best service .*", r"some features need small files .*",
    r"this website stores data .*", r"your privacy matters\. .*", r"by continuing to browse .*", r"stay connected with .*", r"sign up for free to read .*", r"we use cookies .*",
    r"mit ihrer zustimmung erheben wir .*", r"wir verwenden cookies.*", r"die inhalte dieser website .*", r"avec votre accord, nos .*", r"ce site utilise .*", r"les informations de ce site .*", r"con su permiso, nosotros .*", r"utilizamos cookies .*", r"este sitio no sustituye .*",
]

_LABEL_SET = frozenset(LABELS.split("|"))
_HEAD = re.compile(f"(?:{BOX_HEADS})")
_BUTTON = re.compile(f"(?:{'|'.join(map(re.escape, BUTTONS.split('|')))})")
_NOTICE = re.compile("|".join(f"(?:{x})" for x in NOTICES))
_OPENING = re.compile("|".join(f"(?:{x})" for x in OPENINGS))
#: The same wording without its characters beyond ASCII: pages that were wrongly decoded keep the rest of it.
_LABEL_BONES = frozenset(b for x in _LABEL_SET if not x.isascii() and len(b := re.sub("[^\x00-\x7f]", "", x).strip()) > 3)
_OTHER_BONES = frozenset(b for x in (*BUTTONS.split("|"), *BOX_HEADS.split("|")) if not x.isascii() and len(b := " ".join(re.sub("[^\x00-\x7f]", "", x).split())) > 6)
_HEAD_BONES = frozenset(" ".join(re.sub("[^\x00-\x7f]", "", x).split()) for x in BOX_HEADS.split("|") if not x.isascii())
_NOTICE_BONES = re.compile("|".join(f"(?:{re.sub('[^' + chr(0) + '-' + chr(127) + ']', '', x)})" for x in NOTICES if not x.isascii() and x[0] != "["))
_BUTTONS_ROW = re.compile(rf"(?:(?:{'|'.join(map(re.escape, sorted(BUTTONS.split('|'), key=len, reverse=True)))})\s*){{2,}}")
_LINK = re.compile(r"!?\[([^\]]*)\]\(([^)\s]*)[^)]*\)")
_MARKS = re.compile(r"^(?:[\s>*+•◦▪·–_-]|#{1,6}(?=\s)|\d{1,3}[.)](?=\s)|(?<![A-Za-z])[|](?=\s*\[))+")
_TAIL = re.compile(r"(?:[\s»›→▾▸*_·|-]|\(\d{1,4}\))+$")
_SEPARATORS = re.compile(r"\s*[|·•]\s*|\s{3,}")
_CRUMB = re.compile(r"\s+(?:[›»→▸/]|>)\s+")
_FIRST_END = re.compile(r"[.!?](?=\s|$)")
_TABLE = re.compile(r"^\s*[|│].*[|│]\s*$")
_SENTENCES = re.compile(r"(?<=[.!?])\s+")
_WORDS = re.compile(r"[^\W_]+")
_STOP = re.compile(r"[.!?…。！？:;][\"'”’»)\]*_]*$")
_ENDED = re.compile(r"[.!?…。！？][\"'”’»)\]*_ ]*$")
_ITEM = re.compile(r"^[\s>]*(?:[*+•◦▪·–-]|\d{1,3}[.)])(?=\s)\s*")
_HEADING = re.compile(r"^[\s>*_]*#{1,6}\s")
_PARTS = re.compile(r"\s*[|·•»›→/>]\s+|\s{3,}")
_BARS = re.compile(r"[|│\s:-]+")
#: Elements whose text is never part of an article.
_ASIDE = frozenset(("nav", "aside", "footer", "form", "button", "menu", "select", "script", "style", "noscript"))

PARAGRAPH, ITEM, HEADING, TABLE = "paragraph", "item", "heading", "table"


class _Events(HTMLParser):
    """Counts the characters of text and the tags of the line that is fed; entities count as what they stand for."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.chars = self.tags = 0
        self.open: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        if tag in _ASIDE:
            self.open.append(tag)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.tags += 1

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in self.open:
            del self.open[self.open.index(tag) :]

    def handle_data(self, data: str) -> None:
        n = len(data.strip())
        self.tags += n if self.open else 0
        self.chars += n

    def line(self, text: str) -> tuple[int, int]:
        """(characters of text, tags) of the next line of the page; a tag that isn't closed on its line is text."""
        self.chars = self.tags = 0
        if "<" not in text and "&" not in text and not self.open:
            return len(text), 0
        self.feed(text + "\n")
        if self.rawdata.strip():
            self.handle_data(self.rawdata)
        self.rawdata = ""
        return self.chars, self.tags


class Block(NamedTuple):
    """Lines (from 0) that stand together, and what was counted in them."""

    lines: list[int]
    kind: str
    chars: int
    tags: int
    ended: bool


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing along the blocks, the kernel cut at three sigma and renormalised at the ends."""
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(ratios)), kernel, "full")[reach : reach + len(ratios)]
    return np.convolve(ratios, kernel, "full")[reach : reach + len(ratios)] / weight


def threshold(values: np.ndarray) -> float:
    """Midpoint between the two clusters of ``values`` (two means, started at the extremes); their value if all are equal."""
    lo, hi = float(values.min()), float(values.max())
    for _ in range(12):
        cut = (lo + hi) / 2
        low, high = values[values <= cut], values[values > cut]
        if not len(low) or not len(high):
            break
        new = float(low.mean()), float(high.mean())
        if new == (lo, hi):
            break
        lo, hi = new
    return (lo + hi) / 2


# ------------------------------------------------------------------------------------------------ wording
def _plain_case(line: str) -> str:
    return _TAIL.sub("", _MARKS.sub("", line.replace("**", "").replace("__", ""))).strip("*_[] \t")


def _plain(line: str) -> str:
    """Wording of a line: links opened, marks and counters at both ends removed, case folded, blanks collapsed."""
    t = _LINK.sub(r"\1", line) if "](" in line else line
    t = _TAIL.sub("", _MARKS.sub("", t.replace("**", "").replace("__", "").strip()))
    t = t.strip("*_[] \t ")
    return " ".join(unicodedata.normalize("NFKC", t).replace("’", "'").casefold().replace("ß", "ss").split())


def _bones(text: str) -> str:
    """Lower-case text without the characters beyond ASCII."""
    return " ".join(re.sub("[^\x00-\x7f]", "", text).lower().split())


def _is_label(part: str) -> bool:
    part = part.strip(" *_[]▾›»→")
    return part in _LABEL_SET or not part.isascii() and _bones(part) in _LABEL_BONES


def _listed(t: str) -> bool:
    """Whether plain wording, all of it, is a notice or a button."""
    bare = t.rstrip(".! ")
    return bool(bare) and bool(_NOTICE.fullmatch(bare) or _BUTTON.fullmatch(bare) or _BUTTONS_ROW.fullmatch(bare + " "))


def _look_up(text: str) -> bool:
    raw = text.strip()
    if len(raw) > 60 and raw[0] not in "|[#" and "](" not in raw and (end := _FIRST_END.search(raw)) and not _listed(_plain(raw[: end.start()])):
        return False  # a notice made of several sentences begins with a listed one
    t = _plain(raw)
    if not t:
        return False
    if _HEAD.fullmatch(t.rstrip(":")) or _listed(t) or _is_label(t):
        return True
    opened = _LINK.sub(r"\1", raw) if "](" in raw else raw
    crumbs = [" ".join(c.casefold().replace("’", "'").split()) for c in _CRUMB.split(_plain_case(opened))]
    if len(crumbs) >= 2 and _is_label(crumbs[0]) and (_is_label(crumbs[1]) or not _STOP.search(raw)) and len(_WORDS.findall(crumbs[-1])) <= 16:
        return True
    wide = "  " in opened.strip() and re.search(r"\w  \w", opened) and not re.search(r"\w \w", opened.strip())
    gap = r"\s*(?:Â·|¬∑|[|·•])\s*|\s{6,}" if wide else r"\s*(?:Â·|¬∑|[|·•])\s*|\s{3,}"
    parts = [" ".join(p.casefold().replace("’", "'").split()) for p in re.split(gap, _plain_case(opened)) if p.strip()]
    if len(parts) >= 2:
        known = sum(map(_is_label, parts))
        if known >= 0.6 * len(parts) or (len(parts) >= 3 and known and all(len(p.split()) <= 3 for p in parts)):
            return True
    if not raw.isascii():
        bones = _bones(_plain_case(opened).replace("’", "'")).rstrip(".!: ")
        if bones in _HEAD_BONES or bones in _OTHER_BONES or _NOTICE_BONES.fullmatch(bones):
            return True
    sentences = _SENTENCES.split(t)
    known = sum(len(s) for s in sentences if _listed(s)) if len(sentences) > 1 else 0
    return known > 0.5 * len(t) or known >= 0.3 * len(t) and bool(known and _OPENING.fullmatch(t))


_look_up_kept = lru_cache(maxsize=100_000)(_look_up)


def _worded(text: str) -> bool:
    """Whether a line is furniture by its wording alone."""
    return _look_up_kept(text) if len(text) <= KEPT_CHARS else _look_up(text)


def _worded_block(block: Block, lines: list[str]) -> bool:
    """Whether a block is listed wording: each of its lines, or the wrapped notice that they make up."""
    if block.kind == TABLE:
        return False
    if all(_worded(lines[i]) for i in block.lines):
        return True
    whole = _plain(" ".join(lines[i].strip() for i in block.lines)) if len(block.lines) > 1 else ""
    return bool(whole) and bool(_OPENING.fullmatch(whole) or _listed(whole))


# ------------------------------------------------------------------------------------------------ regions
def _goes_on(above: str, line: str, width: int) -> bool:
    """Whether ``line`` continues the paragraph of the line above it, which was wrapped at ``width``."""
    if _ENDED.search(above):
        return False
    return line[:1].islower() and len(above) >= 40 or 60 <= width <= 100 and len(above) + 1 + len(line.split(None, 1)[0]) > width


def blocks(lines: list[str]) -> list[Block]:
    """The non-blank lines of a page, wrapped paragraphs and tables joined, with their characters and tags.

    HTML tags, links, marks of items and separators are tags, and so is the missing end of a line that is no sentence.
    """
    width = max(map(len, lines), default=0)
    groups: list[tuple[list[int], str]] = []
    above = ""
    for i, line in enumerate(lines):
        s = line.strip()
        if not s:
            above = ""
            continue
        kind = TABLE if _TABLE.match(s) else HEADING if _HEADING.match(line) else ITEM if _ITEM.match(line) else PARAGRAPH
        if kind == TABLE and above == TABLE or kind == PARAGRAPH and above and above != TABLE and _goes_on(above, s, width):
            groups[-1][0].append(i)
        else:
            groups.append(([i], kind))
        above = TABLE if kind == TABLE else "" if kind == HEADING or len(_PARTS.findall(s)) > 2 else s
    events = _Events()
    out = []
    for at, kind in groups:
        text = " ".join(lines[i].strip() for i in at)
        links = 0
        if "](" in text:
            links = len(_LINK.findall(text))
            text = _LINK.sub(r"\1", text)
        counted = [events.line(lines[i]) for i in at] if events.open or "<" in text or "&" in text else []
        tags = sum(t for _, t in counted)
        if kind == TABLE:
            out.append(Block(at, kind, len(_BARS.sub("", text)), tags, True))
            continue
        core = _ITEM.sub("", text).strip(" #*_>»›→▾")
        chars = sum(c for c, _ in counted) if tags else len(core)
        ended = bool(_ENDED.search(core))
        out.append(Block(at, kind, chars, tags + links + len(_PARTS.findall(core)) + (kind == ITEM) + (not ended), ended))
    return out


def _density(b: Block, least: int = SENTENCE_CHARS) -> float:
    """Logarithm of a block's text-to-tag ratio; the mark of an item that is a full sentence weighs nothing, links half."""
    if b.kind == TABLE and not b.tags:
        return math.log1p(TABLE_RATIO)
    if b.ended and b.chars >= least:
        return math.log1p(b.chars / (1 + max(0, b.tags - (b.kind == ITEM)) / 2))
    return math.log1p(b.chars / (1 + b.tags))


def text_to_tag_ratio(line: str) -> float:
    """Characters of text for each tag of a line, 1 added to the tags; 0 for a blank line."""
    return next((math.expm1(_density(b)) for b in blocks([line])), 0.0)


def _dense_regions(found: list[Block], dense: list[bool], known: list[bool]) -> list[tuple[int, int, int]]:
    """(first, last, characters) of the runs of dense blocks with fewer than GAP other blocks in a row between them."""
    regions: list[list[int]] = []
    gap = 0
    for j, b in enumerate(found):
        if dense[j]:
            if regions and gap < GAP:
                regions[-1][1] = j
                regions[-1][2] += b.chars
            else:
                regions.append([j, j, b.chars])
            gap = 0
        elif not known[j] and b.kind != HEADING:
            gap += 1
    return [tuple(r) for r in regions]


def _in_box(above: Block, block: Block, known: bool, lines: list[str]) -> bool:
    """Whether a block stands without a blank line below the head of a link box or below an unlisted item of one."""
    if block.lines[0] != above.lines[-1] + 1:
        return False
    return bool(_HEAD.fullmatch(_plain(lines[above.lines[0]]).rstrip(":"))) if known else above.kind == ITEM and not above.ended


def _content(found: list[Block], lines: list[str], wording: bool) -> list[bool]:
    """Which blocks are part of the main body."""
    n = len(found)
    known = [wording and _worded_block(b, lines) for b in found]
    least, sure = (UNLISTED_CHARS, UNLISTED_SURE_CHARS) if wording else (SENTENCE_CHARS, SURE_CHARS)
    own = np.array([_density(b, least) for b in found])
    for j in range(n - 2, -1, -1):  # a head is as dense as what follows it
        if found[j].kind == HEADING and not known[j]:
            own[j] = own[j + 1]
    ratio = smoothed(own)
    cut = min(max(threshold(ratio), math.log1p(LEAST_RATIO)), math.log1p(MOST_RATIO))
    sentence = [b.ended and b.chars >= least for b in found]
    dense = [
        not known[j] and (b.kind == TABLE and not b.tags or sentence[j] and own[j] >= cut and (ratio[j] >= cut or b.chars >= sure and b.tags <= 2))
        for j, b in enumerate(found)
    ]
    if not any(dense):  # a page without a dense block: its sentences
        dense = [b.ended and b.tags <= 2 and not known[j] for j, b in enumerate(found)]
    keep = [False] * n
    regions = _dense_regions(found, dense, known)
    if not regions and n == 1:
        return [found[0].tags <= 1 and not known[0]]
    share = SHARE_WORDED if wording else SHARE
    most = max((r[2] for r in regions), default=0)
    inside = [False] * n
    for first, last, chars in regions:
        inside[first : last + 1] = [True] * (last + 1 - first)
        if chars >= min(share * most, ENOUGH_CHARS):
            keep[first : last + 1] = [not k for k in known[first : last + 1]]
    boxed = [wording and j > 0 and _in_box(found[j - 1], b, known[j - 1], lines) for j, b in enumerate(found)]
    for first, last, _ in regions:
        if not keep[first]:
            continue
        j, short = first - 1, 0
        while j >= 0 and not inside[j] and not keep[j]:
            b = found[j]
            if not known[j]:
                if b.kind == HEADING:
                    short = 0
                elif b.kind == PARAGRAPH and not b.ended and b.tags <= 1 and short < HEADS and not boxed[j]:
                    short += 1
                elif not (sentence[j] and b.tags <= 2 and ratio[j] >= ABOVE * cut):
                    break
                keep[j] = True
            j -= 1
        j = last + 1
        while j < n and not inside[j] and not known[j] and sentence[j] and found[j].tags <= 2 and (found[j].kind == ITEM or ratio[j] >= BELOW * cut):
            keep[j] = True
            j += 1
    for j in range(n - 1, -1, -1):
        if found[j].kind == TABLE and not found[j].tags:
            keep[j] = True
        elif found[j].kind == HEADING and not keep[j] and not known[j]:
            below = next((x for x in range(j + 1, n) if not known[x]), None)
            title = lines[found[j].lines[0]].lstrip("> *_").startswith("# ")
            keep[j] = title or wording and bool(regions) or below is not None and keep[below] and (found[below].kind != ITEM or found[below].ended)
    return keep


def furniture_lines(page: str, wording: bool = True) -> list[int]:
    """Numbers (from 1) of the non-blank lines of a page that are not part of its main body."""
    lines = [x.rstrip("\r") for x in page.split("\n")]
    found = blocks(lines)
    if not found:
        return []
    keep = _content(found, lines, wording)
    return sorted(i + 1 for b, kept in zip(found, keep) if not kept for i in b.lines)


def furniture(df: DataFrame, id_col: str, text_col: str, where: Column | None = None, wording: bool = True) -> DataFrame:
    """(item_id, line_no): the non-blank lines of each page that are not part of its main body, numbered from 1.

    NULL, empty and blank pages give no row, as do pages without furniture; rows that stand twice come out twice; an
    empty table gives no rows. Whole pages are read, whatever their length. Nothing is shuffled, and other columns are
    never read. ``where`` restricts the rows to web pages, ``wording=False`` leaves the lists of wording out.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [furniture_lines(t, wording) for t in batch.column(1).to_pylist()]
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]), pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array([n for x in found for n in x], pa.int32())], names=["item_id", "line_no"])

    rows = df if where is None else df.where(where)
    rows = rows.select(F.col(id_col).cast("bigint").alias("item_id"), F.col(text_col).cast("string").alias("body"))
    return rows.where("length(body) > 0").mapInArrow(scan, "item_id bigint, line_no int")


def main_body(df: DataFrame, id_col: str, text_col: str, where: Column | None = None, wording: bool = True) -> DataFrame:
    """(item_id, body): each page without the lines of its furniture; other lines and their order stay as they are.

    NULL pages give NULL, pages of nothing but furniture an empty text. All else as in :func:`furniture`.
    """

    def clean(page: str | None) -> str | None:
        if page is None:
            return None
        drop = set(furniture_lines(page, wording))
        return "\n".join(x for i, x in enumerate(page.split("\n"), 1) if i not in drop)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(clean, batch.column(1).to_pylist())), pa.string())], names=["item_id", "body"])

    rows = df if where is None else df.where(where)
    return rows.select(F.col(id_col).cast("bigint").alias("item_id"), F.col(text_col).cast("string").alias("body")).mapInArrow(scan, "item_id bigint, body string")
