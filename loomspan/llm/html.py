"""HTML extraction by tag-path ratios.

A page becomes a list of text blocks, each under a root-to-leaf path of block tags. For
each path the text length outside links, the punctuation and the number of blocks are
summed. A block has its path's mean length and punctuation, smoothed over the blocks next
to it in page order and fused to sqrt(length * (1 + punctuation)); a path's score is the
mean of that over its blocks, times the share of its text that is no link, times the
weight of where it stands. List items and cells that
are links for the most part count as a path of their own. Paths whose score reaches a
share of the page's mean select their blocks.

Structure only weighs: text inside an article or main element counts ARTICLE times, text
outside of one counts OUTSIDE times where a page has one, a container that its class, id
or role calls something beside the text counts BESIDE times, and APART_BY_NAME times
where it is called an advert, menu, notice, comments and so on. A container that holds
most of the text (nine tenths of it, for the latter names; of the articles' text, where
there is one) is not weighed by its name, and neither are html, body, main and article. Names are whole words of the attribute (hyphens and underscores left out). Only what
HTML itself marks as no text of the page (nav, header, footer, aside, form, hidden
elements, scripts) never competes.

Defined results: a null or empty page, or one without content blocks, has the empty
text. Repeated rows stay. Further columns are ignored. Nothing is cut or dropped
inside a selected block; broken markup is read as browsers do (a new paragraph or
list item ends the open one, unknown end tags are skipped, open tags end with the page,
quotes count only where an attribute's value begins, a tag that never ends takes the
rest of the page). Time and memory grow in proportion to the page, whatever its markup.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textbatch as tb
from .common import table

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
APART = frozenset("nav header footer aside form script style noscript template textarea title iframe head button select option svg canvas object embed dialog menu fieldset input label".split())
CLOSES = {
    "p": "p", "li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option",
}
ITEMS = frozenset("li dt dd td th".split())
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
# Words of class, id and role that tell what a container is.
NAMED_APART = frozenset(
    "ad ads advert advertisement adverts adbox banner banners sponsor sponsored promo promotion nav navigation navbar menu breadcrumb breadcrumbs footer sidebar cookie cookies consent notice notices "
    "popup modal newsletter subscribe subscription signup login comment comments commentlist disqus replies responses copyright pagination pager".split()
)
NAMED_BESIDE = frozenset("header masthead foot side aside widget related recommended share sharing social alert overlay reply discussion tags toc skip".split())
# Words that make a name of several parts tell of a state.
NAMED_STATES = frozenset("has no is not with without show hide open closed on off free".split())
NEVER_NAMED = frozenset("html body main article".split())
ARTICLE, OUTSIDE, BESIDE, APART_BY_NAME = 4.0, 0.1, 0.1, 0.02

_VALUE = r"\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"'][^\s>]*+))?+"
_TAG = re.compile(rf"([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:{_VALUE})?+)*+)>")
_END = re.compile(r"([a-zA-Z][^\s/>]*+)[^>]*+>")
_ATTRIBUTE = re.compile(rf"([^\s/>][^\s/>=]*+)(?:{_VALUE})?+")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*+>", re.I) for tag in RAW}
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_SPACE = re.compile(r"\s+")
_PUNCTUATION = re.compile(r"[.,;:!?…、。،؟]")


@dataclass(slots=True)
class Block:
    """Text between two block boundaries; path: number of the tag path that it stands under; item: in a list item or cell."""

    path: int
    apart: bool
    article: bool
    named: int = -1
    item: bool = False
    parts: list[str] = field(default_factory=list)
    linked: int = 0


@dataclass(slots=True)
class _Open:
    """An open element; block: place on the stack of the innermost block element, itself included."""

    tag: str
    path: int
    apart: bool
    article: bool
    named: int
    block: int


def _attributes(text: str) -> dict[str, str]:
    """Values by lower-case name; of repeated names the first counts."""
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text):
        out.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return out


def _weight(attributes: dict[str, str]) -> float:
    """What the names of a container say: whole names, and for what stands apart the parts between hyphens, unless one tells of a state."""
    names = " ".join(attributes.get(x, "") for x in ("class", "id", "role")).lower().split()
    words = [re.sub("[-_]", "", x) for x in names]
    parts = [p for p in (re.split("[-_]+", x) for x in names) if len(p) > 1 and NAMED_STATES.isdisjoint(p)]
    if not (NAMED_APART.isdisjoint(words) and all(NAMED_APART.isdisjoint(p) for p in parts)):
        return APART_BY_NAME
    return 1.0 if NAMED_BESIDE.isdisjoint(words) else BESIDE


def _hidden(attributes: dict[str, str]) -> bool:
    return "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or bool(_UNSEEN.search(attributes.get("style", "")))


def blocks(page: str) -> tuple[list[Block], list[tuple[float, int]]]:
    """The page's text blocks in order, and (weight, place of the one around it, -1 for none) of each container with a name that tells something; Block.named is the place of the innermost."""
    out: list[Block] = []
    weights: list[tuple[float, int]] = []
    stack: list[_Open] = []
    open_tags: Counter[str] = Counter()
    paths: dict[tuple[int, str], int] = {}
    now: Block | None = None
    root = _Open("", 0, False, False, -1, -1)

    def add(text: str, cooked: bool = True) -> None:
        nonlocal now
        if not text:
            return
        if now is None:
            top = stack[-1] if stack else root
            now = Block(top.path, top.apart, top.article, top.named, top.block >= 0 and stack[top.block].tag in ITEMS)
            out.append(now)
        plain = entities.unescape(text) if cooked and "&" in text else text
        now.parts.append(plain)
        if open_tags["a"]:
            now.linked += len(plain)

    def close(down_to: int) -> None:
        for one in stack[down_to:]:
            open_tags[one.tag] -= 1
        del stack[down_to:]

    at, text_from, size = 0, 0, len(page)
    while (at := page.find("<", at)) >= 0:
        head = page[at + 1 : at + 2]
        if head in ("!", "?"):
            mark = next((m for m in (("<!--", "-->"), ("<![CDATA[", "]]>")) if page.startswith(m[0], at)), ("<!", ">"))
            end = page.find(mark[1], at + len(mark[0]))
            add(page[text_from:at])
            if mark[0] == "<![CDATA[":
                add(page[at + 9 : end if end >= 0 else size], False)
            at = text_from = end + len(mark[1]) if end >= 0 else size
            continue
        closing = head == "/"
        if not (page[at + 2 : at + 3] if closing else head).isascii() or not (page[at + 2 : at + 3] if closing else head).isalpha():
            at += 1  # a mere sign
            continue
        add(page[text_from:at])
        m = _END.match(page, at + 2) if closing else _TAG.match(page, at + 1)
        if not m:  # the tag never ends
            text_from = size
            break
        at = text_from = m.end()
        tag = m[1].lower()
        if closing:
            if tag not in INLINE:
                now = None
            if open_tags[tag]:
                place = len(stack) - 1
                while stack[place].tag != tag:
                    place -= 1
                close(place)
            continue
        if tag == "br":  # white space inside its block
            if now is not None:
                now.parts.append(" ")
            continue
        inline = tag in INLINE
        if not inline:
            now = None
        if tag in VOID:
            continue
        ends = CLOSES.get(tag, "").split() + (["p"] if tag in ENDS_P else [])
        # a block that begins ends the open paragraph or item, with the inline tags in it
        while ends and stack and stack[-1].block >= 0 and stack[stack[-1].block].tag in ends:
            close(stack[-1].block)
        if tag in RAW:
            end = _RAW_END[tag].search(page, at)
            at = text_from = end.end() if end else size
            continue
        if m[2].endswith("/") and tag in ("svg", "path"):
            continue
        top = stack[-1] if stack else root
        attributes = _attributes(m[2]) if m[2] else {}
        apart, named = top.apart or tag in APART or _hidden(attributes), top.named
        if tag not in NEVER_NAMED and (weight := _weight(attributes)) != 1:
            weights.append((weight, named))
            named = len(weights) - 1
        path = top.path if inline else paths.setdefault((top.path, tag), len(paths) + 1)
        stack.append(_Open(tag, path, apart, top.article or tag in ("article", "main"), named, top.block if inline else len(stack)))
        open_tags[tag] += 1
    add(page[text_from:])
    return out, weights


def extract(page: str | None, share: float = 0.25, reach: int = 1) -> str:
    """The main text. share: of the mean fused ratio that a path needs; reach: blocks on either side that smooth a ratio."""
    if not page:
        return ""
    every, weights = blocks(page)
    nodes = [(b, s) for b in every if not b.apart and (s := _SPACE.sub(" ", "".join(b.parts)).strip())]
    if not nodes:
        return ""
    size = [len(s) for _, s in nodes]
    article = any(b.article for b, _ in nodes)
    held, total = [0] * len(weights), 0
    for (b, _), n in zip(nodes, size, strict=True):
        if b.article or not article:
            total += n
            if b.named >= 0:
                held[b.named] += n
    # what a container holds is known when all inside it are summed; its weight is the least around it
    for k in reversed(range(len(weights))):
        if weights[k][1] >= 0:
            held[weights[k][1]] += held[k]
    least: list[float] = []
    for k, (own, around) in enumerate(weights):
        counts = held[k] <= total * (0.5 if own == BESIDE else 0.9)
        least.append(min(own if counts else 1.0, least[around] if around >= 0 else 1.0))
    sums: dict[tuple[int, float, bool], list[float]] = {}
    keys = []
    for (b, s), n in zip(nodes, size, strict=True):
        weight = least[b.named] if b.named >= 0 else 1.0
        weight *= ARTICLE if b.article else OUTSIDE if article else 1.0
        keys.append((b.path, weight, b.item and 2 * b.linked > n))
        one = sums.setdefault(keys[-1], [0, 0, 0, 0, 0.0])
        one[0] += max(0, n - b.linked)
        one[1] += len(_PUNCTUATION.findall(s))
        one[2] += 1
        one[3] += n
    text, dots = ([sums[k][x] / sums[k][2] for k in keys] for x in (0, 1))

    def smooth(values: list[float]) -> list[float]:
        return [sum(w := values[max(0, i - reach) : i + reach + 1]) / len(w) for i in range(len(values))]

    fused = [(n * (1 + d)) ** 0.5 for n, d in zip(smooth(text), smooth(dots), strict=True)]
    for k, f in zip(keys, fused, strict=True):
        sums[k][4] += f
    level = share * sum(fused) / len(fused)
    keep = {k for k, (own, _, n, whole, f) in sums.items() if own > 0 and k[1] * f / n * own / whole >= level}
    return "\n".join(s for (_, s), k in zip(nodes, keys, strict=True) if k in keep)


def extract_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    narrow = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    return narrow.mapInArrow(tb.tidy(rows), "page_id long, url string, text string, n_chars long")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract_pages(table(spark, sf_dir, "pages"))
