"""HTML extraction by the distribution of line blocks.

Markup is stripped into lines, one for each block element. A line weighs as much as its text outside links, and nothing
inside elements that never hold an article (menus, forms, scripts, and elements named so by class, id or role, unless
most of the page's text is in such an element). Sums
over sliding windows of lines show where text surges and where it dives to nothing; what stands between a surge and the
next dive is a region. Every region that is text rather than links is part of the article, however short it is. Set-apart
lines are taken out before, so that they part nothing.
Article and main elements are a weight: text in them counts twice, and once it is clear whether the story is in them or
beside them, only long lines of the other side weigh.

Defined cases: null or empty html gives an empty text; a null url or id is passed through; repeated rows give equal
rows; an element of that kind that is never closed ends with its parent, or with the page; an empty table gives no rows;
other columns are neither read nor kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Lines that a window of the distribution holds.
WINDOW = 3
#: Share of a region's characters that must have weight (text outside links) for it to be part of the article.
DENSE = 0.5
#: Weight of a character inside the article or main element of the story.
TAG = 2
#: Characters that a line on the other side of that element must exceed to have weight; a line as long is no teaser.
SHORT = 200

# Element names of HTML, and words that name parts which are no article.
RAW = "script style noscript template textarea svg iframe canvas select title".split()
NEVER = "nav footer aside form button dialog menu label fieldset".split()
WRAPPING = "form fieldset".split()  # some pages stand in one as a whole
BLOCKS = set(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
NAMED = set(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs "
    "masthead topbar footer sidebar side widget widgets cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe "
    "subscription signup comment comments commentlist disqus respond replies share sharing social related recommended recommendations login search "
    "toolbar pagination pager copyright disclaimer paywall hidden skip".split()
)
ROLES = set("navigation banner contentinfo complementary search alert dialog menu menubar form toolbar".split())

#: Parts that may stand beside those words in the name of such an element (related-posts, menu-item); with any other part
#: the name says something else (related-work, share-prices, has-sidebar, comments-open, overflow-hidden).
NEUTRAL = set(
    "archive archives area article articles bar block body bottom box btn button buttons card cards categories category column container content credit "
    "credits desktop element email entries entry facebook fixed footer form global google group header heading icon icons image info inline inner item "
    "items js latest law left linkedin link links list main media message meta mobile module more native news next outer page panel pinterest policy "
    "popular post posts prev previous primary print recent reply right row secondary section site slot sticky stories story tag tags text title top "
    "trending twitter unit whatsapp wrap wrapper".split()
)
#: Names that a part of the story may have as well: inside it they set apart what is short or mostly links.
WEAK = set("copyright login related search share sharing side skip social".split())
#: Characters outside links from which on a part with such a name is prose.
PROSE = 100
#: Words of a linked line that ends a sentence, from which on it is part of the story around it rather than a title.
SENTENCE = 8
#: Names of what readers and advertisers add, and of overlays; that may well be longer than the story.
ADDED = set(
    "comment comments commentlist disqus respond replies ad ads advert adverts advertisement advertising sponsor sponsored promo promotion "
    "cookie cookies consent gdpr popup modal overlay".split()
)

_RAW_ELEMENT = re.compile(
    r"<svg(?=[\s/>])[^<>]*/>|<(?:" + "|".join(RAW) + r")(?:\s+[^\s=>\"'/]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>]++))?)*+\s*/>"
    r"|<(" + "|".join(RAW) + r")(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)",
    re.S | re.I,
)
_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>", re.S)
#: Quotes count only where a value begins, as in HTML.
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9-]*)((?:[^>=]|=\s*(?:\"[^\"]*\"|'[^']*'|[\"'][^>]*|[^\s>]*))*+)>")
_NAME = re.compile(r"(?:^|\s)(?:class|id)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_ROLE = re.compile(r"\brole\s*=\s*[\"']?([a-z]+)", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_PART = re.compile(r"[^a-z]+")


def _named(value: str) -> set[str]:
    """Words of NAMED in the names of a class or id that have no other parts but neutral ones."""
    found = set()
    for name in value.strip("\"'").lower().split():
        parts = {p for p in _PART.split(name) if len(p) > 2 or p in NAMED}
        if parts <= NAMED | NEUTRAL:
            found |= parts & NAMED
    return found


def _apart(name: str, attributes: str, inside_article: bool) -> str:
    """Whether an element can't hold part of an article: "never"; "added" if it is named so; "likely" if only a
    page whose text is mostly in it speaks against that; "weak" if prose in it does, too; else empty."""
    if name in NEVER or (name == "header" and not inside_article):
        return "likely" if name in WRAPPING else "never"
    if not attributes or name in ("html", "body", "main"):
        return ""
    found = set().union(*(_named(m[1]) for m in _NAME.finditer(attributes)))
    if found & ADDED:
        return "added"
    if found and found <= WEAK and inside_article and not _HIDDEN.search(attributes):
        return "weak"
    if found or ((role := _ROLE.search(attributes)) and role[1].lower() in ROLES) or _HIDDEN.search(attributes):
        return "likely"
    return ""


class Line(NamedTuple):
    text: str
    linked: int  # characters of it in links
    apart: bool
    article: int  # number of the innermost article element around it, 0 outside all
    main: bool
    heading: bool


def page_lines(html: str) -> list[Line]:
    """Each block of a page that has text."""
    html = _RAW_ELEMENT.sub("\x00", _COMMENT.sub("", html)).replace("\x00", " ")
    lines: list[Line] = []
    around: list[tuple[int, ...]] = []  # numbers of the elements around each line that are set apart
    kinds: list[str] = []  # of each such element
    stack: list[tuple[str, int, int]] = []  # name, 1 + number of an element set apart, number of the innermost article
    text: list[str] = []
    linked = link = articles = 0

    def flush():
        nonlocal linked
        line = " ".join(unescape("".join(text)).split())
        if line:
            names = {s[0] for s in stack}
            around.append(tuple(s[1] - 1 for s in stack if s[1]))
            lines.append(Line(line, linked, bool(around[-1]), stack[-1][2] if stack else 0, "main" in names, not HEADINGS.isdisjoint(names)))
        text.clear()
        linked = 0

    at = 0
    for tag in _TAG.finditer(html):
        part = html[at : tag.start()]
        at = tag.end()
        text.append(part)
        if link:
            linked += len(unescape(part).strip())
        closing, name, attributes = tag[1], tag[2].lower(), tag[3]
        if name in BLOCKS:
            flush()
        if name == "a":
            link = 0 if closing else 1
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    if name not in BLOCKS and stack[k][1]:
                        flush()
                    del stack[k:]
                    break
        elif name not in VOID and not attributes.rstrip().endswith("/"):
            if name == "p" and stack and stack[-1][0] == "p":
                stack.pop()  # a paragraph ends where the next begins
            articles += name == "article"
            apart = _apart(name, attributes, any(s[0] in ("article", "main") for s in stack))
            if apart and name not in BLOCKS:
                flush()
            if apart:
                kinds.append(apart)
            if name in BLOCKS or apart:
                stack.append((name, len(kinds) if apart else 0, articles if name == "article" else stack[-1][2] if stack else 0))
    text.append(html[at:])
    flush()
    kept = _holding_most(lines, around, kinds) | _prose(lines, around, kinds)
    return [line._replace(apart=not kept.issuperset(inside)) for line, inside in zip(lines, around)] if kept else lines


def _holding_most(lines: list[Line], around: list[tuple[int, ...]], kinds: list[str]) -> set[int]:
    """Numbers of the elements that aren't set apart after all, as most of the page's text outside links is in them.
    Added parts stay apart if there is text in an article or main element, or long text, beside them; the others if they
    are short and there is text in an article or main element beside them."""
    rows = [(line, inside, max(len(line.text) - line.linked, 0)) for line, inside in zip(lines, around) if not any(kinds[k] == "never" for k in inside)]
    beside = [(line, inside, size) for line, inside, size in rows if not any(kinds[k] == "added" for k in inside)]
    if any(size and (line.article or line.main) for line, _, size in beside) or sum(size for *_, size in beside) > SHORT:
        rows = beside
    least = SHORT if any(size and (line.article or line.main) and not inside for line, inside, size in rows) else 0
    held = [0] * len(kinds)
    for _, inside, size in rows:
        for k in inside:
            held[k] += size
    total = sum(size for *_, size in rows)
    return {k for k, size in enumerate(held) if size > least and 2 * size > total}


def _prose(lines: list[Line], around: list[tuple[int, ...]], kinds: list[str]) -> set[int]:
    """Numbers of the weakly named elements that hold prose: enough text, less than half of it in links."""
    free, linked = [0] * len(kinds), [0] * len(kinds)
    for line, inside in zip(lines, around):
        for k in inside:
            free[k] += max(len(line.text) - line.linked, 0)
            linked[k] += line.linked
    return {k for k, kind in enumerate(kinds) if kind == "weak" and free[k] > PROSE and free[k] > linked[k]}


def runs(weights: np.ndarray, window: int = WINDOW) -> list[tuple[int, int]]:
    """(first, after the last) line with weight of each region: it surges at its first line with weight, and dives where
    a whole window of lines after it has none."""
    padded = np.concatenate([np.zeros(window - 1), weights, np.zeros(window - 1)])
    sums = np.convolve(padded, np.ones(window), "valid")  # the window that begins window - 1 lines before each line
    edges = np.diff(np.concatenate([[0], (sums > 0).astype(int), [0]]))
    # the first window with weight ends at the first line with weight, the last one begins at the last
    return [(int(s), int(d) - window + 1) for s, d in zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1))]


def article_regions(weights: np.ndarray, lengths: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Flags of the lines of regions whose weight is at least half of their characters, however short they are."""
    keep = np.zeros(len(weights), bool)
    for s, d in runs(weights, window):
        keep[s:d] = weights[s:d].sum() >= DENSE * lengths[s:d].sum()
    return keep


def own_lines(lines: list[Line], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flags of the lines on the story's side of the article and main tags (all, without tags), and in its tags. The side
    is the one with more text, that in a tag counted TAG times: an article element is a composition of its own, so a story
    outside is not continued in it, and a card beside or inside a story (a linked heading over short lines) is another's."""
    article, main = np.array([line.article for line in lines]), np.array([line.main for line in lines])
    totals = np.bincount(article, sizes)
    totals[0] = 0
    best = int(totals.argmax())
    beside = max((sizes[article == 0][s:d].sum() for s, d in runs(sizes[article == 0])), default=0)
    if best and TAG * totals[best] >= beside:
        own = main | (article > 0)
        titled = {line.article for line, size in zip(lines, sizes) if line.heading and size == 0}
        long = set(article[sizes > SHORT].tolist())
        if best in long and best not in titled:
            own &= ~np.isin(article, list(titled - long - {0}))
        return own, own
    free = sizes * ~main * (article == 0)
    own = main & (article == 0)
    if sizes[own].any() and TAG * sizes[own].sum() >= max((free[s:d].sum() for s, d in runs(free)), default=0):
        return own, own
    return article == 0, np.zeros(len(lines), bool)


def stretched(keep: np.ndarray, lines: list[Line], tagged: np.ndarray) -> np.ndarray:
    """The regions with the links up to the edge of their tag, if those don't fill a window, or with a heading beside."""
    out = keep.copy()
    for way in (1, -1):
        flags, inside, order = keep[::way], tagged[::way], lines[::way]
        for end in np.flatnonzero(flags[:-1] & ~flags[1:]) + 1:
            stop = end
            while stop < len(flags) and inside[stop] and not flags[stop]:
                stop += 1
            if stop - end < WINDOW or order[end].heading:
                out[::way][end : stop if stop - end < WINDOW else end + 1] = True
    return out


def _sentence(line: Line) -> bool:
    """Whether a line in an article or main element is a sentence, so that links in it say nothing."""
    return (line.article > 0 or line.main) and line.text.endswith(".") and line.text.count(" ") + 1 >= SENTENCE


def main_text(html: str | None) -> str:
    """The article of a page: its blocks with white space as single spaces, joined by single spaces."""
    lines = [line for line in page_lines(html or "") if not line.apart]
    sizes = np.array([0 if 2 * line.linked > len(line.text) and not _sentence(line) else len(line.text) for line in lines], float)
    if not sizes.any():
        return ""
    own, tagged = own_lines(lines, sizes)
    weights = np.where(own, np.where(tagged, TAG, 1) * sizes, np.where(sizes > SHORT, sizes, 0))
    keep = article_regions(weights, np.array([len(line.text) for line in lines]))
    return " ".join(line.text for line, on in zip(lines, stretched(keep, lines, tagged)) if on)


def extract_pages(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, url, text, n_chars of every page."""
    source = pages.select(F.col(key), F.col(url), F.col(html).alias("html"))
    schema = T.StructType([source.schema[key], source.schema[url]]).add("text", "string").add("n_chars", "long")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = [main_text(h) for h in part["html"].to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part[key], part[url], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[key, url, "text", "n_chars"]
                )

    return source.mapInArrow(read, schema)
