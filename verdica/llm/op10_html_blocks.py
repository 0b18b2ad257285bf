"""HTML extraction by two-pass block rules.

A page is cut into blocks at block-level tags and double line breaks; scripts, styles and
comments go, entities are resolved, white space is collapsed.  The first pass classifies
each block by itself, by its length in characters, its link density (share of characters
inside links) and its stop-word density (share of words that are common words of the
page's language; see below):

* link density above ``MAX_LINKS``, or a copyright sign, or inside a form control: bad;
* under ``SHORT`` characters: bad with any link, else short;
* stop-word density from ``HIGH``: good from ``LONG`` characters, else near-good;
* stop-word density from ``LOW``: near-good; otherwise bad.

The density needs the common words of the page's language.  A page that names a language with a
list is judged by it, unless most of its words (those of all blocks that the density decides)
aren't in Latin letters; a page that names none by the words of all lists, if ``HIGH`` of its words
are among them.  For all others, those that name a language without a list too, the density is
left out: length and links decide, as if every block had ``HIGH``.  So a page of another
language in Latin letters that wrongly names a listed one is still lost.

The second pass decides the ambiguous: short blocks take the label that their nearest
decided (good or bad) neighbours agree on; where these differ a short block is good only if
a near-good one lies on the side of the bad one before it; near-good blocks then are good
unless both neighbours are bad.  The page's edge counts as bad.  Headings are judged good
as short blocks are, and also where a good block follows within ``HEADING`` characters.

Defined cases: null and empty html give null and empty text; a page of no tags is one
block; unclosed comments and scripts end with the page, and so does a tag whose bracket only
quoted values hold; a quote that is never closed is a sign like any other; ``<`` before a page
without further ``>`` is text; a head without an end tag ends with the first text or tag that can't
stand in it, and so does its title's block with the title; a page without good blocks
has empty text; repeated rows are extracted each.  Time is linear in a page's length.
"""

from __future__ import annotations

import html as _html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import require

MAX_LINKS, SHORT, LONG, LOW, HIGH, HEADING = 0.2, 70, 200, 0.10, 0.20, 200

STOP_WORDS = {
    "en": "the of and to in a is that it for on was with as are be at by this from or an have not but had his they which you were her all their she there would what so if we can who has been will one more no said do when its than",
    "de": "der die das und ist in von zu den mit sich des auf für nicht ein eine dem im als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch",
    "fr": "le la les de des et est un une en du que qui dans pour pas sur au plus par ce il ne se sont avec son ou être sa aux à mais comme nous on cette ont été elle je vous leur y deux ces si tout fait bien même sans où",
    "es": "el la los las de que y en un una por con no es se del al lo como más para su o este sí ya todo esta son muy hay sin sobre ser tiene le me está entre cuando fue han si porque esto hasta desde donde",
}
_STOPS = {k: frozenset(v.split()) for k, v in STOP_WORDS.items()}
_ANY = frozenset().union(*_STOPS.values())

_BLOCK = frozenset(
    "address article aside blockquote body caption center dd dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav noframes noscript ol optgroup option p pre section select table tbody td textarea tfoot th thead title tr ul".split()
)
_HIDDEN = ("script", "style", "noscript", "template", "svg")
#: What may stand in a head; the start of anything else, or text, ends it.
_IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
#: A tag without angle brackets in it; possessive, so that it fails by the next bracket at the latest.
_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*+)((?:[^<>\"']|\"[^<>\"]*+\"|'[^<>']*+')*+)>")
_START, _COMMENT = re.compile("<(?=[A-Za-z/!?])"), re.compile("<(?=[!?])")
_NAME = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*+)")
_VALUE = re.compile(r"=\s*+([\"'])")
_CLOSE = {t: re.compile(rf"</{t}\s*+>", re.I) for t in _HIDDEN}
_LANG = re.compile(r"\blang\s*+=\s*+[\"']?([A-Za-z]{2})", re.I)
_SPACES = re.compile(r"\s+")
_WORD = re.compile(r"[^\W\d_]+")


class _Tags:
    """The tags of a page, from left to right, in time linear in its length."""

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self._without: dict[str, bool] = {}

    def next(self, at: int) -> tuple[int, int, str | None, bool, str]:
        """(start, end, name, closing, attributes) of the next mark-up; name None for a comment, start at the page's end for none."""
        page = self.page
        while True:
            found = (_START if at < self.last else _COMMENT).search(page, at)
            if not found:
                return len(page), len(page), None, False, ""
            start = found.start()
            if m := _TAG.match(page, start):
                return start, m.end(), m[2].lower(), bool(m[1]), m[3]
            if page[start + 1] in "!?":
                return start, self._end_of_comment(start), None, False, ""
            if m := _NAME.match(page, start):
                end = self._end_of_tag(m.end())
                return start, end, m[2].lower(), bool(m[1]), page[m.end() : end - 1]
            at = start + 1

    def _end_of_comment(self, start: int) -> int:
        for opening, closing in (("<!--", "-->"), ("<![CDATA[", "]]>"), ("<", ">")):
            if self.page.startswith(opening, start):
                end = self.page.find(closing, start + len(opening))
                return len(self.page) if end < 0 else end + len(closing)
        return len(self.page)

    def _end_of_tag(self, at: int) -> int:
        """After the bracket that no quoted value holds; the page's end where there is none."""
        page, end = self.page, -1
        while True:
            if end < at:
                end = page.find(">", at)
            if end < 0:
                return len(page)
            m = _VALUE.search(page, at, end)
            if not m or self._without.get(m[1]):
                return end + 1
            close = page.find(m[1], m.end())
            if close < 0:  # a quote that is never closed is a sign like any other, here and further on
                self._without[m[1]] = True
                continue
            at = close + 1


def blocks(page: str) -> tuple[list[tuple[str, int, bool, bool]], str | None]:
    """((text, characters in links, heading, inside head or select), ...) and the page's language."""
    out: list[tuple[str, int, bool, bool]] = []
    parts: list[str] = []
    linked: list[str] = []
    links, breaks, heading, dead, head, title, language = 0, 0, False, 0, False, False, None

    def flush() -> None:
        nonlocal parts, linked, breaks
        text = _SPACES.sub(" ", _html.unescape("".join(parts))).strip()
        if text:
            in_links = len(_SPACES.sub(" ", _html.unescape("".join(linked))).strip()) if linked else 0
            out.append((text, in_links, heading, head or dead > 0))
        parts, linked, breaks = [], [], 0

    tags = _Tags(page)
    at, end = 0, len(page)
    while at < end:
        stop, after, name, closing, attributes = tags.next(at)
        if stop > at:
            piece = page[at:stop]
            if (breaks or (head and not title)) and not piece.isspace():
                if head and not title:
                    head = False
                if breaks > 1:
                    flush()
                elif breaks:
                    parts.append(" ")
                breaks = 0
            parts.append(piece)
            if links:
                linked.append(piece)
        at = after
        if name is None:
            continue
        if head and not closing and name not in _IN_HEAD:
            flush()
            head = False
        if name in _CLOSE and not closing:
            if not attributes.endswith("/"):
                close = _CLOSE[name].search(page, at)
                at = close.end() if close else end
        elif name == "br":
            breaks += 1
        elif name == "a":
            links = max(0, links - 1) if closing else links + 1
        elif name in _BLOCK:
            flush()
            heading = not closing and len(name) == 2 and name[0] == "h" and name[1].isdigit()
            if name == "head":
                head, title = not closing, False
            elif name == "title":
                title = not closing
            elif name in ("select", "textarea"):
                dead = max(0, dead - 1) if closing else dead + 1
            if name == "body" and not closing:
                dead = 0
            links = 0 if name in ("body", "nav", "article", "footer") else links
            if name == "html" and not closing and (found := _LANG.search(attributes)):
                language = found[1].lower()
    flush()
    return out, language


def _by_form(block: tuple[str, int, bool, bool]) -> str | None:
    """bad or short, or None where the words decide."""
    text, in_links, _, dead = block
    density = in_links / len(text)
    if dead or density > MAX_LINKS or "©" in text:
        return "bad"
    if len(text) < SHORT:
        return "bad" if in_links else "short"
    return None


def _latin(word: str) -> bool:
    return word[0] < "\u02b0" or "\u1e00" <= word[0] < "\u1f00"


def stops_of(found: list[tuple[str, int, bool, bool]], language: str | None) -> frozenset | None:
    """The common words by which a page is judged, None where no list holds for it."""
    if language and language not in _STOPS:
        return None
    words = [w for b in found if _by_form(b) is None for w in _WORD.findall(b[0].lower())]
    if language:
        return _STOPS[language] if 2 * sum(map(_latin, words)) >= len(words) else None
    return _ANY if sum(w in _ANY for w in words) >= HIGH * len(words) else None


def first_pass(block: tuple[str, int, bool, bool], stops: frozenset | None) -> str:
    """good, bad, short or near; without stops by length and links alone."""
    text = block[0]
    if (form := _by_form(block)) is not None:
        return form
    words = _WORD.findall(text.lower())
    if stops is None:
        share = HIGH if words else 0.0
    else:
        share = sum(w in stops for w in words) / len(words) if words else 0.0
    if share >= HIGH:
        return "good" if len(text) >= LONG else "near"
    return "near" if share >= LOW else "bad"


def second_pass(found: list[tuple[str, int, bool, bool]], labels: list[str]) -> list[bool]:
    """Which blocks are good, by two sweeps for each pass over the neighbours."""
    n = len(labels)

    def sweep(decided: list[str], order, passing: tuple[str, ...]) -> tuple[list[str], list[bool]]:
        near, crossed, last, met = [""] * n, [False] * n, "bad", False
        for i in order:
            near[i], crossed[i] = last, met
            if decided[i] in passing:
                met = met or decided[i] == "near"
            else:
                last, met = decided[i], False
        return near, crossed

    before, near_before = sweep(labels, range(n), ("short", "near"))
    after, near_after = sweep(labels, range(n - 1, -1, -1), ("short", "near"))
    settled = list(labels)
    for i, label in enumerate(labels):
        if label == "short":
            if before[i] == after[i]:
                settled[i] = before[i]
            else:
                settled[i] = "good" if (near_before[i] if before[i] == "bad" else near_after[i]) else "bad"
    before, _ = sweep(settled, range(n), ("near",))
    after, _ = sweep(settled, range(n - 1, -1, -1), ("near",))
    for i, label in enumerate(settled):
        if label == "near":
            settled[i] = "bad" if before[i] == after[i] == "bad" else "good"
    for i in range(n - 1, -1, -1):
        if found[i][2] and labels[i] in ("short", "near") and settled[i] == "bad":
            length = 0
            for j in range(i + 1, n):
                if settled[j] == "good":
                    settled[i] = "good"
                    break
                length += len(found[j][0])
                if length > HEADING:
                    break
    return [x == "good" for x in settled]


def extract(page: str | None) -> tuple[str | None, int, int]:
    """(text, blocks, good blocks)."""
    if page is None:
        return None, 0, 0
    found, language = blocks(page)
    stops = stops_of(found, language)
    good = second_pass(found, [first_pass(b, stops) for b in found])
    kept = [b[0] for b, ok in zip(found, good) if ok]
    return "\n".join(kept), len(found), len(kept)


def _run(pages: pa.Array) -> pa.Array:
    rows = [extract(p) for p in pages.to_pylist()]
    text, n, kept = zip(*rows) if rows else ((), (), ())
    return pa.StructArray.from_arrays([pa.array(text, pa.string()), pa.array(n, pa.int32()), pa.array(kept, pa.int32())], names=["text", "blocks", "kept"])


def texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, blocks, kept) for every page; no shuffle."""
    udf = F.arrow_udf(_run, "text string, blocks int, kept int")
    made = require(pages, "page_id", "url", "html").select("page_id", "url", udf("html").alias("x"))
    return made.select("page_id", "url", "x.text", "x.blocks", "x.kept")
