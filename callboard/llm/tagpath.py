"""Main text of web pages by tag-path ratios.

A page is read into leaves: pieces of text with their root-to-leaf tag path (tags with their
class and id), its block and whether it is inside a link. Only what is never text is left
out at once: scripts, styles, hidden elements. Every distinct path gets ratios: characters
and sentence ends per leaf make its density, up to what a full paragraph has, and linked
characters lower it. Scores are smoothed with those of the paths that come before and after in
the page, then fused with the siblings under one container, weighted by their text, so that
a short heading or one-word paragraph stands or falls with the text around it; a list inside a
container of dense text takes part in that container's score. Paths below ``THRESHOLD`` of
the best score are dropped. So a list of links, a one-line notice or a line of copyright beside a
body of paragraphs falls by its ratio, whatever its tag or class.

Marks weigh in. Furniture by tag, role, or a container's class or id (menus, headers, footers,
sidebars, notices, adverts, forms, comments of readers) multiplies a path's score by ``MARKED``;
a class word on a text element (a paragraph, heading, list item) by ``TINGED`` only, so a paragraph of sentences
called ``notice`` stays. A page on which nothing but furniture has text has no main text.

``article`` and ``main`` elements enter the score too. Their paths are fused once more over
the whole element, so lists and linked headings of an article stand with its paragraphs, and
gain by the square of the odds between the largest such element and the text outside all of
them. An article that holds most of a page thus outdoes the rest, a teaser beside a body in
plain ``div`` elements gains nothing.

One page is one row and its work is linear in its length; nothing is shuffled.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Hashable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callboard.llm.blocks import free_names

#: Share of the best path's score that a path needs.
THRESHOLD = 0.3
#: Characters and sentence ends per leaf beyond which a path isn't any denser.
FULL_CHARS, FULL_ENDS = 400, 4
#: What is left of a path's score below furniture, and in a text element with a furniture word.
MARKED, TINGED = 0.01, 0.5
#: Share of the score of the container around that a path can take on.
INHERITED = 0.5
#: Weights of the path before, the path itself and the path after it when scores are smoothed.
SMOOTH = (0.05, 0.9, 0.05)
#: Characters that an ``article`` or ``main`` element counts beside its own: on tiny pages the tag decides.
TAG_CHARS = 80

# Element kinds of HTML and words of furniture.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe noframes xmp svg math".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rt rp s samp small span strike strong sub sup time tt u var wbr br img".split()
)
_CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPES = frozenset("table ul ol dl select body html article main section div td th".split())
_FURNITURE_TAGS = frozenset("nav footer aside form button menu dialog".split())
_FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alert alertdialog form toolbar".split())
_FURNITURE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion "
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc sidebar aside widget "
    "footer masthead topbar toolbar cookie cookies consent gdpr notice notices notification alert popup modal overlay "
    "newsletter subscribe signup login share sharing social related recommended recommendations "
    "comment comments disqus respond replies reply".split()
)
_CONTENT = frozenset(("article", "main"))
#: Elements that hold one piece of text; a class word on one of these is a hint and no more.
_TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr blockquote pre figcaption caption address".split())
#: Elements whose text is never shown as text of the page.
_UNSEEN = frozenset("head script style noscript template textarea title svg math iframe object embed select option input".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""(?<![^\s"'])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?(?=[\s/>]|$)""", re.IGNORECASE)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_ENDS = re.compile(r"[.,;:!?…](?=[\s\"'”»)]|$)|[、。，！？]")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


@dataclass
class _Open:
    tag: str
    path: int
    container: int
    unseen: bool
    mark: float  # what furniture around and hints leave of the score
    content: int  # the outermost article or main element around, -1 outside
    link: bool


@dataclass
class _Block:
    path: int
    container: int
    around: int
    mark: float
    content: int
    parts: list[str] = field(default_factory=list)
    linked: int = 0

    def text(self) -> str:
        whole = "".join(self.parts)
        return " ".join((html.unescape(whole) if "&" in whole else whole).split())


def _marks(attributes: str) -> tuple[str, bool, bool, bool, bool, bool]:
    """A suffix for the path from class and id; whether these have a furniture word; whether the role is furniture's;
    whether the element is hidden, a header, the main part."""
    suffix, words_of, role, hidden, header, main = "", False, False, False, False, False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            suffix += ("." if name == "class" else "#") + " ".join(sorted(value.split()))
            words = {w.lower() for w in _WORDS.findall(value)}
            words_of |= not words.isdisjoint(_FURNITURE_WORDS)
            header |= "header" in words
        elif name == "role":
            role |= value.lower() in _FURNITURE_ROLES
            main |= value.lower() == "main"
        elif name == "style":
            hidden |= bool(_HIDDEN.search(value))
        elif name == "hidden":
            hidden = True
        else:
            hidden |= value.lower() == "true"
    return suffix, words_of, role, hidden, header, main


def blocks(page: str) -> list[_Block]:
    """The page's blocks of text, in page order."""
    found: list[_Block] = []
    paths: dict[tuple[int, str], int] = {}
    parents: dict[int, int] = {-1: -1}
    stack = [_Open("", -1, -1, False, 1.0, -1, False)]
    opened: Counter = Counter()
    current: _Block | None = None
    at, size, elements = 0, len(page), 0

    def text(piece: str) -> None:
        nonlocal current
        top = stack[-1]
        if top.unseen or not piece:
            return
        if current is None:
            if piece.isspace():
                return
            current = _Block(top.path, top.container, parents[top.container], top.mark, top.content)
            found.append(current)
        current.parts.append(piece)
        if top.link:
            current.linked += len(piece)

    def close(depth: int) -> None:
        nonlocal current
        if any(o.tag not in _INLINE for o in stack[depth:]):
            current = None
        opened.subtract(o.tag for o in stack[depth:])
        del stack[depth:]

    while at < size:
        token = _TOKEN.search(page, at)
        if token is None:
            text(page[at:])
            break
        text(page[at : token.start()])
        at = token.end()
        ending, name, attributes = token[1], token[2], token[3]
        if name is None:
            ending, name, attributes = token[4], token[5], token[6]
        if name is None:
            if token[0].startswith("<![CDATA["):
                text(html.escape(token[0][9:].removesuffix("]]>"), quote=False))
            continue
        tag = name.lower()
        if ending:
            if tag == "br":
                text(" ")
            for depth in range(len(stack) - 1, 0, -1) if opened[tag] > 0 else ():
                if stack[depth].tag == tag:
                    close(depth)
                    break
                if tag in _INLINE and stack[depth].tag not in _INLINE:
                    break  # a stray end tag doesn't close blocks
            continue
        if tag in ("br", "wbr", "img"):
            if tag == "br":
                text(" ")
            continue
        if tag in _CLOSES_P and opened["p"] > 0:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == "p":
                    close(depth)
                    break
                if stack[depth].tag in _SCOPES:
                    break
        for depth in range(len(stack) - 1, 0, -1) if any(opened[t] > 0 for t in _SIBLINGS.get(tag, ())) else ():
            if stack[depth].tag in _SIBLINGS[tag]:
                close(depth)
                break
            if stack[depth].tag in _SCOPES - {"td", "th"}:
                break
        if tag not in _INLINE:
            current = None
        if tag in _VOID:
            continue
        if tag in _RAW:
            end = re.compile(f"</{re.escape(tag)}(?=[\\s/>]|$)", re.IGNORECASE).search(page, at)
            at = end.start() if end else size
            stop = page.find(">", at)
            at = size if end is None or stop < 0 else stop + 1
            continue
        parent = stack[-1]
        suffix, word, role, hidden, header, main = _marks(attributes) if attributes.strip() else ("", *[False] * 5)
        content = parent.content
        if content < 0 and (main or tag in _CONTENT):
            content, elements = elements, elements + 1
        mark = parent.mark
        furniture = tag in _FURNITURE_TAGS or (header or tag == "header") and content < 0  # an article's own head stays
        if tag not in ("html", "body", *_CONTENT):
            if furniture or role or word and tag not in _TEXT_TAGS and tag not in _INLINE:
                mark = min(mark, MARKED)
            elif word:
                mark = min(mark, TINGED)
        path, container = parent.path, parent.container
        if tag not in _INLINE:
            # A path below furniture is another path than the same tags elsewhere.
            path, container = paths.setdefault((path, f"{tag}{suffix}{mark}"), len(paths)), path
            parents[path] = container
        unseen = parent.unseen or tag in _UNSEEN or hidden and tag not in ("html", "body")
        stack.append(_Open(tag, path, container, unseen, mark, content, parent.link or tag == "a"))
        opened[tag] += 1
    return found


def _fused(group: dict[int, Hashable], sums: dict[int, list[float]], score: dict[int, float]) -> dict[Hashable, float]:
    """The mean score of each group's paths, weighted by their characters."""
    weight: dict[Hashable, float] = {}
    total: dict[Hashable, float] = {}
    for path, g in group.items():
        weight[g] = weight.get(g, 0) + sums[path][1]
        total[g] = total.get(g, 0) + sums[path][1] * score[path]
    return {g: total[g] / weight[g] for g in total}


def select(found: list[_Block], threshold: float | None = None) -> list[str]:
    """The texts of the blocks whose paths carry content, in page order."""
    texts = [b.text() for b in found]
    sums: dict[int, list[float]] = {}
    first: dict[int, _Block] = {}
    for block, text in zip(found, texts):
        if text:
            total = sums.setdefault(block.path, [0, 0, 0, 0])
            for k, v in enumerate((1, len(text), len(_ENDS.findall(text)), min(block.linked, len(text)))):
                total[k] += v
            first.setdefault(block.path, block)
    if not sums or max(b.mark for b in first.values()) <= MARKED:
        return []
    unlinked = {p: 1 - 0.99 * linked / chars for p, (_, chars, _, linked) in sums.items()}
    score = {p: min(chars / n, FULL_CHARS) * (1 + min(ends / n, FULL_ENDS)) * unlinked[p] for p, (n, chars, ends, _) in sums.items()}
    order = list(score)
    smooth = {}
    for i, path in enumerate(order):
        near = [order[i + d] if 0 <= i + d < len(order) else path for d in (-1, 0, 1)]
        smooth[path] = sum(w * score[q] * (1 if q == path else first[q].mark) for w, q in zip(SMOOTH, near))
    # Furniture is fused with furniture: its text says nothing about what stands beside it.
    group = {p: (first[p].container, first[p].mark <= MARKED) for p in order}
    fused = _fused(group, sums, smooth)
    final = {}
    for p in order:
        inherited = INHERITED * fused.get((first[p].around, group[p][1]), 0)
        final[p] = max(fused[group[p]], inherited) * first[p].mark * unlinked[p]
    within = [p for p in order if first[p].content >= 0]
    if within:
        whole = _fused({p: first[p].content for p in within}, sums, smooth)
        held: Counter = Counter()
        for path in order:
            held[first[path].content] += sums[path][1] * first[path].mark
        outside = held.pop(-1, 0)
        odds = (max(held.values()) + TAG_CHARS) / max(1, outside)
        for path in within:
            final[path] = (final[path] + whole[first[path].content] * first[path].mark) / 2 * (1 + odds * odds)
    least = (THRESHOLD if threshold is None else threshold) * max(final.values())
    return [t for b, t in zip(found, texts) if t and final[b.path] >= least]


def main_text(page: str | None) -> str:
    """The page's main text, one line per block; "" for null, empty and text-less pages."""
    return "\n".join(select(blocks(page or "")))


def extract(pages: DataFrame, page: str = "html", text: str = "text") -> DataFrame:
    """All columns but the page's, and ``text``: its main text, never null.

    Repeated rows give equal rows and an empty table gives none; whole pages are read,
    whatever their length.
    """
    kept = [c for c in pages.columns if c not in (page, text)]
    (whole,) = free_names(kept, "page_")
    picked = pages.select(*kept, F.col(page).cast("string").alias(whole))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([main_text(p.as_py()) for p in batch.column(batch.num_columns - 1)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], found], schema=pa.schema([*list(batch.schema)[:-1], pa.field(text, pa.string())]))

    return picked.mapInArrow(run, T.StructType([*picked.schema.fields[:-1], T.StructField(text, T.StringType())]))
