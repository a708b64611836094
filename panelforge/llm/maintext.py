"""Main text of web pages by two passes of block rules.

A page is cut at block elements. The first pass classifies each block by what surrounds it, its link density, its
length and its density of stop words as content, boilerplate or undecided; headings and short blocks are undecided. In
the second pass an undecided block takes the label of the nearest decided block of its region (the enclosing article
or main element, else the page); between two as near, content wins; without any decided block it is content.

Blocks inside menus, page headers and footers, sidebars, notices, adverts, forms and reader comments are boilerplate
whatever they say: these are known by their elements, roles, and the names in their class or id. What is known by a
name or is a form is not set apart if it holds the article or main element. Scripts, styles and other unseen elements are
no text at all. Where few of a page's long blocks are dense in the known stop words, the page's language is not among
them, and density decides nothing.

Defined cases: a null or empty page has an empty text; a page without markup is one block; unclosed or misnested
elements end with the element around them; white space is any Unicode white space, no-break spaces included; one <br>
is white space, two are a boundary; clashing columns of the input are replaced; repeated rows are extracted alike.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import without

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:"[^"]*"|'[^']*'|[^'">])*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>|<[!?][^>]*>""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|style)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
HIDDEN = re.compile(r"""(?<![\w-])hidden(?![\w-])|aria-hidden\s*=\s*["']?true""", re.I)
TOKEN = re.compile(r"[a-z0-9]+")
WORD = re.compile(r"[^\W\d_]+")

# Element names.
UNSEEN = frozenset("script style noscript template svg math iframe object select button textarea title canvas audio video datalist".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
NESTED = BLOCK - frozenset("p hr li dt dd option h1 h2 h3 h4 h5 h6 html".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
REGION = frozenset("article main".split())
ASIDE = frozenset("nav footer aside form dialog fieldset menu".split())
# Words of classes, ids and roles.
MARKS = frozenset(
    "ad ads adv advert adverts advertising advertisement advertorial sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs "
    "masthead topbar footer sidebar aside complementary contentinfo cookie cookies consent gdpr notice notices notification alert popup modal overlay dialog newsletter "
    "subscribe signup login comment comments disqus respond reply replies share sharing social related recommended widget toolbar pagination pager copyright form search skip".split()
)
#: What may follow a mark in a compound name; and words of compounds that tell what a page has or lacks.
HOLDERS = frozenset("area bar block box buttons container content inner items links list outer panel primary secondary section widget widgets wrap wrapper".split())
TELLING = frozenset("has have with without no not".split())
PAGE_ONLY = frozenset("header".split())
REPLIES = frozenset("comment comments reply replies".split())
#: Frequent function words.
STOP = frozenset(
    "a an and are as at be been but by for from had has have he her his i in is it its not of on or she that the their there they this to was were which who will with you "
    "der die das den dem des und in zu den mit sich auf für ist im nicht ein eine einer als auch es an werden aus er hat dass sie nach wird bei "
    "le la les de du des et à en un une que qui dans pour sur pas ne par plus ce il elle est au aux avec se son sa ses "
    "el los las y del que en un una por con para es se no lo al su sus como más pero ya o".split()
)
LONG, SHORT, DENSE, THIN, LINKED = 200, 70, 0.20, 0.10, 0.5


class Block:
    __slots__ = ("parts", "linked", "region", "inside", "shut", "heading")

    def __init__(self, region: int, inside: bool, shut: bool, heading: bool):
        self.parts, self.linked, self.region, self.inside, self.shut, self.heading = [], [], region, inside, shut, heading


def marks_of(attributes: str) -> set[str]:
    """Names of class, id and role: whole tokens, and of compounds their last part, or their first before a holder or a number."""
    words: set[str] = set()
    for name, value in ATTRIBUTE.findall(attributes):
        if name.lower() == "style":
            if "display:none" in value.replace(" ", "").lower():
                words.add("hidden")
        else:
            for token in value.strip("\"'").lower().split():
                parts = TOKEN.findall(token)
                if parts and TELLING.isdisjoint(parts[:-1]):
                    words.add(parts[-1])
                    if all(x in HOLDERS or x.isdigit() for x in parts[1:]):
                        words.add(parts[0])
    return words


def is_aside(name: str, attributes: str, inside: bool) -> bool:
    """Whether an element sets its contents apart from the main text."""
    if name in ASIDE or (name == "header" and not inside):
        return True
    if not attributes:
        return False
    if name in ("html", "body"):
        return False
    words = marks_of(attributes) if "=" in attributes else set()
    if "hidden" in words or HIDDEN.search(attributes):
        return True
    if name in REGION:
        return bool(words & REPLIES)
    return bool(words & MARKS) or (not inside and bool(words & PAGE_ONLY))


def is_soft(name: str, attributes: str) -> bool:
    """Whether an element that is set apart is so by a name or as a form, not by what it is or as unseen."""
    return name == "form" or not (name in ASIDE or name == "header" or HIDDEN.search(attributes) or "hidden" in marks_of(attributes))


def blocks_of(page: str, free: frozenset[int] = frozenset()) -> list[tuple[str, int, Block]]:
    """Text, characters in links, and block for every block with text, in order. ``free``: where elements begin that are not set apart."""
    out: list[Block] = []
    stack: list[tuple[str, bool, int, bool, int]] = []  # element, set apart, region, inside a region, place if set apart softly
    holding: set[int] = set()
    regions, links, breaks, at = 0, 0, 0, 0
    current = Block(0, False, False, False)
    unseen = ""

    def turn(heading: bool = False, apart: bool = False) -> None:
        nonlocal current, breaks
        if current.parts:
            out.append(current)
        top = stack[-1] if stack else ("", False, 0, False, -1)
        current, breaks = Block(top[2], top[3], top[1] or apart, heading), 0

    def put(text: str) -> None:
        nonlocal breaks
        if text:
            current.parts.append(text)
            if links:
                current.linked.append(text)
            if not text.isspace():
                breaks = 0

    for m in TAG.finditer(page):
        start, end = m.span()
        if start < at:
            continue
        if not unseen:
            put(page[at:start])
        at = end
        name = m[2] or m[5]
        if name is None:
            continue
        name, closing, attributes = name.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if unseen:
            if closing and name == unseen:
                unseen = ""
            continue
        if name in UNSEEN:
            if not closing and not attributes.endswith("/"):
                stop = re.compile(rf"</{name}\s*>", re.I).search(page, end)
                if stop:
                    at = stop.end()
                else:
                    unseen = name
            put(" ")
        elif name == "a":
            links = 0 if closing else 1
        elif name == "br":
            breaks += 1
            if breaks == 2:
                turn(apart=current.shut)
            else:
                current.parts.append(" ")
        elif name in BLOCK:
            links = 0
            if closing:
                if name in NESTED and any(x[0] == name for x in stack):
                    while stack.pop()[0] != name:
                        pass
                turn()
            else:
                inside = bool(stack) and stack[-1][3]
                apart = start not in free and is_aside(name, attributes, inside)
                if name in NESTED and not attributes.endswith("/"):
                    over = stack[-1] if stack else ("", False, 0, False, -1)
                    region = over[2]
                    if name in REGION and not apart:
                        if not inside:
                            holding.update(x[4] for x in stack if x[4] >= 0)
                        regions += 1
                        region, inside = regions, True
                    stack.append((name, over[1] or apart, region, inside, start if apart and is_soft(name, attributes) else -1))
                    turn()
                else:
                    turn(heading=name in HEADING, apart=apart)
    if not unseen:
        put(page[at:])
    turn()
    if holding:
        return blocks_of(page, free | holding)
    found = []
    for b in out:
        text = " ".join(html.unescape("".join(b.parts)).split())
        if text:
            found.append((text, len(" ".join(html.unescape(" ".join(b.linked)).split())) if b.linked else 0, b))
    return found


def density_of(text: str) -> float:
    words = WORD.findall(text.lower())
    return sum(w in STOP for w in words) / max(1, len(words))


def readable(blocks: list[tuple[str, int, Block]]) -> bool:
    """Whether a fifth of the text of long blocks is dense in stop words, so that their absence says something."""
    long = [t for t, linked, b in blocks if not b.shut and not b.heading and len(t) >= SHORT and linked <= LINKED * len(t)]
    return sum(len(t) for t in long if density_of(t) >= DENSE) * 5 >= sum(map(len, long))


def first_pass(text: str, linked: int, block: Block, known: bool = True) -> bool | None:
    """True for content, False for boilerplate, None for undecided; ``known``: the page's language has stop words here."""
    if block.shut or linked > LINKED * len(text):
        return False
    if block.heading or len(text) < SHORT:
        return None
    density = density_of(text)
    if density >= DENSE or (density >= THIN and len(text) >= LONG):
        return True
    return None if block.inside or density >= THIN or not known else False


def extract(page: str | None) -> str:
    """The blocks of content, one a line."""
    if not page:
        return ""
    blocks = blocks_of(page)
    known = readable(blocks)
    labels = [first_pass(*b, known) for b in blocks]
    places: dict[int, list[int]] = {}
    for i, (label, (_, _, b)) in enumerate(zip(labels, blocks, strict=True)):
        if label is not None and not b.shut:
            places.setdefault(b.region, []).append(i)
    final, cursor = list(labels), dict.fromkeys(places, 0)
    for i, (_, _, b) in enumerate(blocks):
        if labels[i] is not None:
            continue
        near = places.get(b.region)
        if not near:
            final[i] = True
            continue
        c = cursor[b.region]
        while c < len(near) and near[c] < i:
            c += 1
        cursor[b.region] = c
        before = (i - near[c - 1], labels[near[c - 1]]) if c else (len(blocks) + 1, False)
        after = (near[c] - i, labels[near[c]]) if c < len(near) else (len(blocks) + 1, False)
        final[i] = before[1] or after[1] if before[0] == after[0] else min(before, after)[1]
    return "\n".join(t for (t, _, _), keep in zip(blocks, final, strict=True) if keep)


def main_text(pages: DataFrame, *, html_column: str = "html", keep: list[str] | None = None, output: str = "text") -> DataFrame:
    """``pages`` (or its columns ``keep``) with the main text."""
    kept = [c for c in (pages.columns if keep is None else keep) if c.lower() != output.lower()]
    source = pages.select(*[f"`{c}`" for c in dict.fromkeys([*kept, html_column])])
    place = source.columns.index(html_column)
    shape = T.StructType([*without(pages, output).select(*[f"`{c}`" for c in kept]).schema.fields, T.StructField(output, T.StringType())])

    def run(batches):
        for b in batches:
            found = [extract(x.as_py()) for x in b.column(place)]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in kept), pa.array(found, pa.string())], names=[*kept, output])

    return source.mapInArrow(run, shape)


def digest(found: DataFrame) -> DataFrame:
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
