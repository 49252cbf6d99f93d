"""Main text of web pages by line-block distribution.

Markup is stripped and every block element gives one line. A line weighs its length, the text of links much
less; furniture (navigation, headers, footers, adverts, forms, comments and the like, told by tag, role, class
or id) weighs nothing, unless such an element wraps the article itself. Weights are summed over a sliding window of lines.

Lines belong to the outermost article they are in, or to the outermost element named as content, or to the rest of
the page. Markup only multiplies the sums: the part whose windows surge highest gives the text, and so does every
part that comes near it. Inside a part the sum surges where text begins and dives to nothing where it ends;
what lies between is kept.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import strings

WINDOW = 3  # lines
SURGE = 40  # weight of a window where text begins
FACTOR = {"article": 3, "text": 2, "rest": 1}  # by which window sums count when parts of a page are compared
NEAR = 0.25  # of the highest surge, from which another part is text too
MARKED = 40  # added to each line of a marked article, so that a short one surges as well
LINKED = 8  # characters of link text that weigh as one

# What the elements and the usual names of page furniture are.
UNSEEN = "script|style|noscript|template|iframe|object|svg|math|textarea|select|button|canvas|audio|video|title"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul".split()
)
SPACED = frozenset("br td th option".split())
FURNITURE_TAGS = frozenset("nav header footer aside form menu dialog head fieldset search".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
FURNITURE = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead topbar footer sidebar aside widget widgets cookie cookies "
    "consent gdpr notice notices alert banner popup modal overlay newsletter subscribe subscription signup promo promotion advert "
    "adverts advertisement advertising ad ads adsense sponsor sponsored comment comments commentlist disqus reply replies respond "
    "share sharing social related recommended recommendations pagination pager login search toolbar skip copyright".split()
)
TEXT_NAMES = frozenset("article articlebody post entry story content maincontent main".split())
OWN_HEADER = frozenset("article post entry story title".split())

COMMENTS = frozenset("comment comments commentlist disqus reply replies respond".split())
MODIFIERS = frozenset("has no not with without hide show is".split())
GENERIC = frozenset("list box wrapper wrap container area section block item items inner link links bar panel".split())

ATTRIBUTES = r"""(?:=\s*+(?:"[^"]*+"(?=[\s/>])|'[^']*+'(?=[\s/>])|[^\s<>]*+)|[^=<>])*+"""
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<({UNSEEN})\b{ATTRIBUTES}>?.*?(?:</\1\b[^<>]*+>?|\Z)"
    rf"|<(/?)([a-z][^\s/<>]*+)({ATTRIBUTES})>?|<[!?/][^<>]*+>?",
    re.IGNORECASE | re.DOTALL,
)
NAMED = re.compile(r"""(?:^|\s)(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
WORD = re.compile(r"[a-z]+")


class Line(NamedTuple):
    """A block's text; ``own`` characters are outside links; ``part`` is (kind, number) of what it belongs to."""

    text: str
    own: int
    out: bool
    part: tuple[str, int]
    heading: bool
    paragraph: bool


class Place(NamedTuple):
    """What encloses a point of the page. ``soft`` is the innermost furniture element that may turn out to be a wrapper."""

    hard: bool = False
    soft: int = 0
    article: int = 0
    text: int = 0
    tag: str = ""


def _named(value: str) -> tuple[set[str], set[str]]:
    """Furniture words of a class or id attribute, and all its words. What follows a modifier (has-, no-, with-) says nothing
    about the element itself, nor does a word between the article's name and another noun."""
    found, every = set(), set()
    for token in value.split():
        words = WORD.findall(token)
        words = words[: next((i for i, w in enumerate(words) if w in MODIFIERS), len(words))]
        while len(words) > 1 and words[-1] in GENERIC:
            words.pop()
        every.update(words)
        for i, w in enumerate(words):
            if w in FURNITURE and (i == len(words) - 1 or not TEXT_NAMES.intersection(words[:i])):
                found.add(w)
    return found, every


def _kind(tag: str, attributes: str, inside: bool) -> str:
    """"hard" or "soft" for furniture (soft: void if it wraps the article), "article", "text" for an element named so, else ""."""
    found, names, role = set(), set(), ""
    if attributes.strip():
        for m in NAMED.finditer(attributes):
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
                return "" if tag in ("html", "body") else "hard"
            if name == "role":
                role = value
            elif name in ("class", "id"):
                more, words = _named(value)
                found |= more
                names |= words
    if tag in ("html", "body"):
        return ""
    if tag == "main" or role == "main":
        return "article"
    if "header" in found and names & OWN_HEADER:
        found = found - {"header"}
    if tag == "article":
        return "hard" if found & {"comment", "comments", "ad", "ads", "advert", "sponsored", "reply"} else "article"
    if found & COMMENTS or role in FURNITURE_ROLES:
        return "hard"
    if tag in FURNITURE_TAGS and tag != "form" and not (tag == "header" and (inside or names & OWN_HEADER)):
        return "hard"
    if found or tag == "form":
        return "soft"
    return "text" if role == "article" or names & TEXT_NAMES else ""


def page_lines(page: str) -> list[Line]:
    """The lines with text, in page order. Time grows with the page's length, whatever is left open in it."""
    lines: list[tuple[str, int, Place, bool]] = []
    at, stack, opened = Place(), [], Counter()
    pieces: list[str] = []
    linked: list[str] = []
    link = heading = False
    above, holds = [0], [False]  # of soft furniture elements, by number: the one around it, and if an article or h1 is inside
    parts = 0

    def flush() -> None:
        text = " ".join("".join(pieces).split())
        if text:
            own = len(text) - len(" ".join("".join(linked).split()))
            lines.append((text, max(own, 0), at, heading))
        pieces.clear()
        linked.clear()

    def add(raw: str) -> None:
        if raw:
            text = html.unescape(raw)
            pieces.append(text)
            if link:
                linked.append(text)

    last = 0
    for m in TOKEN.finditer(page):
        add(page[last : m.start()])
        last = m.end()
        if m[0].startswith("<![CDATA["):
            pieces.append(m[0][9:].removesuffix("]]>"))
        if not m[3]:
            continue
        tag, closing = m[3].lower(), bool(m[2])
        if tag in SPACED:
            pieces.append(" ")
        if tag == "a":
            link = not closing
        if tag not in BLOCKS or (closing and not opened[tag] and tag != "p"):
            continue  # an end tag of what is not open is nothing
        flush()
        link = False
        if tag in VOID:
            continue
        if closing:
            while opened[tag]:
                left = at.tag
                opened[left] -= 1
                at = stack.pop()
                if left == tag:
                    break
        else:
            if tag == "body":
                stack.clear()
                opened.clear()
                at = Place()
            if tag in ("p", "li", "dd", "dt", "tr"):
                while at.tag == tag:
                    opened[tag] -= 1
                    at = stack.pop()
            stack.append(at)
            opened[tag] += 1
            kind = _kind(tag, m[4] or "", bool(at.article or at.text))
            if kind in ("article", "text"):
                parts += 1
            if kind == "soft":
                above.append(at.soft)
                holds.append(False)
            elif (kind == "article" or tag == "h1") and not at.hard:
                holds[at.soft] = True
            at = Place(
                at.hard or kind == "hard",
                len(above) - 1 if kind == "soft" else at.soft,
                at.article or (parts if kind == "article" else 0),
                at.text or (parts if kind == "text" else 0),
                tag,
            )
        heading = not closing and len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()
    add(page[last:])
    flush()
    out = _furniture(above, holds, [(0 if p.hard else len(t), p.soft) for t, _, p, _ in lines])
    return [
        Line(
            t, own, p.hard or out[p.soft],
            ("article", p.article) if p.article else ("text", p.text) if p.text else ("rest", 0), h, p.tag == "p",
        )
        for t, own, p, h in lines
    ]


def _furniture(above: list[int], holds: list[bool], sizes: list[tuple[int, int]]) -> list[bool]:
    """If what lies in each soft element is furniture: not where it wraps an article or h1 and most of the page's other text."""
    within, holds = [0] * len(above), list(holds)
    for size, soft in sizes:
        within[soft] += size
    for i in range(len(above) - 1, 0, -1):
        if holds[i]:
            within[above[i]] += within[i]
            holds[above[i]] = True
    out = [False] * len(above)
    for i in range(1, len(above)):
        out[i] = out[above[i]] or not (holds[i] and within[i] * 2 > within[0])
    return out


def kept_lines(weights: list[int], headings: list[bool], surge: int, window: int = WINDOW) -> list[bool]:
    """Lines between a surge of the window sums and the next dive to zero; headings right before a surge too."""
    n = len(weights)
    sums = [sum(weights[i : i + window]) for i in range(n)]
    keep = [False] * n
    on = False
    for i in range(n):
        if not on and weights[i] and sums[i] >= surge:
            on, at = True, i
            while at and headings[at - 1] and weights[at - 1]:
                at -= 1
                keep[at] = True
        elif on and not sums[i]:
            on = False
        keep[i] = keep[i] or (on and weights[i] > 0)
    return keep


def _weight(line: Line) -> int:
    """Own characters and a little for links; a block of nothing but links is a menu unless it is a paragraph."""
    if line.out or (not line.own and not line.paragraph):
        return 0
    return max(1, line.own + (len(line.text) - line.own) // LINKED)


def _surges(lines: list[Line], weights: list[int]) -> dict[tuple[str, int], float]:
    """The highest window sum of each part."""
    best: dict[tuple[str, int], float] = {}
    for i in range(len(lines)):
        sums: dict[tuple[str, int], int] = {}
        for line, w in zip(lines[i : i + WINDOW], weights[i : i + WINDOW]):
            sums[line.part] = sums.get(line.part, 0) + w
        for part, total in sums.items():
            best[part] = max(best.get(part, 0), total * FACTOR[part[0]])
    return best


def main_text(page: str) -> str:
    """The page's article: its lines joined by one line feed; empty if there is none."""
    lines = page_lines(page)
    weights = [_weight(line) for line in lines]
    best = _surges(lines, weights)
    top = max(best.values(), default=0)
    keep = [False] * len(lines)
    for part in [p for p, surge in best.items() if surge and surge >= NEAR * top]:
        places = [i for i, line in enumerate(lines) if line.part == part]
        places = range(places[0], places[-1] + 1)
        mine = [not lines[i].out and lines[i].part == part for i in places]
        extra = MARKED if part[0] == "article" else 0
        kept = kept_lines([(weights[i] + extra) * ok for i, ok in zip(places, mine)], [lines[i].heading for i in places], SURGE)
        if not any(kept):
            kept = [weights[i] > 0 and ok for i, ok in zip(places, mine)]
        ends = [j for j, k in enumerate(kept) if k]
        for j, i in enumerate(places):  # blocks of links between lines of text are text too
            keep[i] = keep[i] or kept[j] or (mine[j] and ends[0] < j < ends[-1] and not weights[i] and any(kept[j - 1 : j + 2]))
    return "\n".join(line.text for line, k in zip(lines, keep) if k)


def extract(pages: DataFrame, keep: list[str], markup: str = "html") -> DataFrame:
    """The kept columns, ``text`` and ``n_chars`` (code points), row for row. Null or empty markup has empty text,
    repeated rows give a row each, an empty table gives none, pages of any length are read whole in linear time.
    Kept columns named as one of the results are left out for it."""
    keep = [k for k in keep if k not in ("text", "n_chars")]
    source = pages.select(*keep, F.col(markup).cast("string").alias("_markup"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(p) for p in strings(batch.column("_markup"))]
            columns = [batch.column(k) for k in keep]
            columns += [pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*keep, "text", "n_chars"])

    return source.mapInArrow(run, pages.select(*keep).schema.add("text", "string").add("n_chars", "long"))
