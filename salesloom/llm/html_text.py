"""Main text of web pages from flat text blocks and a decision tree.

A page falls into flat blocks of text at block elements.  A block is described by its words and
the share of them inside links, by the same of its neighbours, and by where it stands: inside an
article, inside something named as a menu, footer, advert, notice, form or comment, a heading.  A
name counts unless it only modifies (has-sidebar, ad-free) or what bears it holds the page's main heading or an
article with most of its words; remarks and further reading always stay out.  A decision tree, trained on the small labelled table that ``EXAMPLES`` spells out, tells main text from
the rest.  Blocks of main text are joined in page order.

Defined results: null and empty pages have no text; text outside any element is a block; unclosed
elements end with what they stand in, unclosed comments, scripts and styles at the page's end; icons,
buttons and the like hold no text, and without an end tag they hold nothing at all; repeated
pages are handled each on its own; an empty table gives no rows; further columns pass through.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<more>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<more2>[^>]*+)>"
    r"|<[!?/][^>]*+>", re.S | re.I)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span "
                    "strike strong sub sup time tt u var br wbr img".split())
_CLOSES_ITSELF = frozenset("p li dt dd tr td th option".split())
_SECTIONS = frozenset("article aside blockquote body div dl fieldset figure footer form header html main nav ol section "
                      "table td th tr ul li dd".split())
_LISTS = frozenset("ul ol dl table".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Skipped to their end tags; what stands in them is no markup.
_RAW = frozenset("script style title textarea iframe".split())
_TO_THE_END = frozenset("script style".split())
#: Elements whose text is none of the page's.
_EMBEDDED = frozenset("noscript template svg object select button".split())
_NOT_IN_BUTTONS = _HEADINGS | frozenset("article main section p table ul ol".split())
_OTHER_TAGS = frozenset("nav aside footer form menu dialog".split())
_OTHER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
_OTHER_NAMES = re.compile(
    r"\b(?:ads?|advert\w*|adslot|adbox|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|notification|alert|popup|modal|overlay|"
    r"newsletter|subscri\w+|sidebar|menu|nav|navbar|navigation|breadcrumbs?|footer|masthead|topbar|toolbar|comments?|"
    r"respond|replies|disqus|related|recommend\w*|share|sharing|social|widgets?|login|signin|signup|search|pagination|pager)\b")
_HEADER_NAMES = re.compile(r"\bheader\b")
#: Names that say what a wrapper has, lacks or is a page of.
_MODIFIED = re.compile(r"\A(?:has|no|not|with|without|is|show|hide)\b|\b(?:free|open|opened|closed|page|layout|template|enabled|disabled)\Z")
_REMARKS = re.compile(r"\b(?:comments?|respond|replies|disqus|related|recommend\w*)\b")
#: Words outside links that a wrapper with the main heading has to hold.
_ENOUGH = 25
_MAIN_NAMES = re.compile(r"\b(?:article|content|post|entry|story|main|articlebody)\b")


@dataclass
class Flat:
    text: str
    words: int
    linked: int
    other: bool
    main: bool
    heading: bool
    named: int = -1
    title: bool = False


@dataclass
class Named:
    """An element that is something other by its name alone, in which of these it stands, and what it holds."""
    around: int
    remarks: bool
    words: int = 0
    linked: int = 0
    article: bool = False
    title: bool = False


class Open(NamedTuple):
    """An open element, and whether it stands in something other, in an article, in a link, in something embedded,
    and the number of the innermost ``Named``."""
    tag: str
    other: bool
    main: bool
    linked: bool
    empty: bool
    named: int


_OUTSIDE = Open("", False, False, False, False, -1)


def flat_blocks(page: str) -> list[Flat]:
    """The text blocks of a page in order; scripts, styles and the like hold none."""
    blocks: list[Flat] = []
    named: list[Named] = []
    pieces: list[str] = []
    links: list[str] = []
    stack: list[Open] = []
    is_open: Counter[str] = Counter()
    last_end: dict[str, int] = {}

    def flush() -> None:
        words = html.unescape("".join(pieces)).split()
        if words:
            here = stack[-1] if stack else _OUTSIDE
            blocks.append(Flat(" ".join(words), len(words), len(html.unescape(" ".join(links)).split()), here.other, here.main,
                               any(s.tag in _HEADINGS for s in stack[-3:]), here.named, is_open["h1"] > 0))
        pieces.clear()
        links.clear()

    def close(tag: str) -> None:
        if not is_open[tag]:
            return
        for k in range(len(stack) - 1, -1, -1):
            if stack[k].tag == tag:
                is_open.subtract(s.tag for s in stack[k:])
                del stack[k:]
                return
            if tag in _EMBEDDED:
                if not stack[k].empty:
                    return
            elif stack[k].tag in _SECTIONS and tag not in _SECTIONS or stack[k].tag in _LISTS and tag in _CLOSES_ITSELF:
                return

    at, size, last = 0, len(page), page.rfind(">") + 1
    while at < size:
        found = _TOKEN.search(page, at, last)  # no markup ends after the last bracket
        text = page[at:found.start()] if found else page[at:].partition("<!--")[0]
        if text and not (stack and stack[-1].empty):
            pieces.append(text)
            if stack and stack[-1].linked:
                links.append(text)
        if not found or found[0].startswith("<!--") and not found[0].endswith("-->"):
            break
        at = found.end()
        tag = (found["tag"] or found["tag2"] or "").lower()
        if not tag:
            continue
        ending, more = bool(found["end"] or found["end2"]), found["more"] or found["more2"] or ""
        if tag in _RAW or tag in _EMBEDDED:
            if not (stack and stack[-1].empty):
                flush() if tag == "title" else pieces.append(" ")
            if ending:
                close(tag)
                continue
            if more.endswith("/"):
                continue
            ends = re.compile(rf"</{tag}(?=[\s/>])[^>]*+>", re.I)
            if tag not in last_end:
                last_end[tag] = max((e.start() for e in ends.finditer(page, at)), default=-1)
            if at > last_end[tag]:
                at = size if tag in _TO_THE_END else at
            elif tag in _RAW:
                at = ends.search(page, at).end()
            else:
                close(tag) if tag in ("button", "select") else None
                is_open[tag] += 1
                stack.append((stack[-1] if stack else _OUTSIDE)._replace(tag=tag, empty=True))
            continue
        if stack and stack[-1].empty and not ending and tag in _NOT_IN_BUTTONS:
            close("button")
            close("select")
        if tag in _INLINE:
            if tag == "br":
                pieces.append(" ")
        elif not (stack and stack[-1].empty and (not ending or stack[-1].tag == tag)):
            flush()
        if ending:
            close(tag)
        elif tag not in _VOID:
            if tag in _CLOSES_ITSELF or tag not in _INLINE:
                close(tag if tag in _CLOSES_ITSELF else "p")
            is_open[tag] += 1
            stack.append(_entered(tag, more, stack[-1] if stack else _OUTSIDE, named))
    flush()
    _settle(blocks, named)
    return blocks


def _settle(blocks: list[Flat], named: list[Named]) -> None:
    """Mark blocks in elements that are something other by name, but not by names around the page's main text."""
    if not named:
        return
    title = next((b for b in blocks if b.title and not b.other), None)
    for b in blocks:
        if b.named >= 0:
            n = named[b.named]
            n.words, n.linked, n.title = n.words + b.words, n.linked + b.linked, n.title or b is title
    for n in reversed(named):
        if n.around >= 0:
            up = named[n.around]
            up.words, up.linked = up.words + n.words, up.linked + n.linked
            up.article, up.title = up.article or n.article, up.title or n.title
    total, other = sum(b.words for b in blocks), []
    for n in named:
        holds = n.title and n.words - n.linked >= _ENOUGH and 4 * n.words > total or n.article and 2 * n.words > total
        other.append(n.remarks or not holds or n.around >= 0 and other[n.around])
    for b in blocks:
        b.other = b.other or b.named >= 0 and other[b.named]


def _entered(tag: str, more: str, around: Open, named: list[Named]) -> Open:
    other, main = around.other, around.main
    names, plain, role, inner = "", "", "", around.named
    if "=" in more:
        for name, a, b, c in _ATTRIBUTE.findall(more):
            if name.lower() == "role":
                role = (a or b or c).lower()
            else:
                for token in (a or b or c).split():
                    words = re.sub(r"[-_]+", " ", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", token)).lower()
                    names += " " + words
                    plain += "" if _MODIFIED.search(words) else " " + words
    if tag not in ("html", "body"):
        named_main = bool(_MAIN_NAMES.search(names))
        other = other or tag in _OTHER_TAGS or role in _OTHER_ROLES or tag == "header" and not main
        header = bool(_HEADER_NAMES.search(plain)) and not named_main and not main
        if header or _OTHER_NAMES.search(plain):
            named.append(Named(inner, bool(_REMARKS.search(plain))))
            inner = len(named) - 1
        if tag in ("article", "main") and inner >= 0 and not other:
            named[inner].article = True
        main = main or tag in ("article", "main") or role in ("main", "article") or named_main
    return Open(tag, other, main, around.linked or tag == "a", around.empty, inner)


FEATURES = ("words", "link_share", "words_before", "link_share_before", "words_after", "link_share_after",
            "inside_other", "inside_main", "heading")


def described(blocks: list[Flat]) -> np.ndarray:
    """One row of ``FEATURES`` per block; beyond the page's ends there are no words."""
    own = np.array([(b.words, b.linked / b.words) for b in blocks], float).reshape(-1, 2)
    edge = np.zeros((1, 2))
    before, after = np.concatenate([edge, own])[:-1], np.concatenate([own, edge])[1:]
    place = np.array([(b.other, b.main, b.heading) for b in blocks], float).reshape(-1, 3)
    return np.hstack([own, before, after, place])


@dataclass
class Node:
    value: bool
    feature: int = -1
    limit: float = 0.0
    low: Node | None = None
    high: Node | None = None


def grow(rows: np.ndarray, labels: np.ndarray, depth: int = 5) -> Node:
    """Decision tree by the largest fall of Gini impurity; ties go to the earlier feature."""
    node = Node(bool(labels.mean() >= 0.5))
    if depth == 0 or labels.min() == labels.max():
        return node
    best = 1e-9
    impurity = lambda part: 2 * part.mean() * (1 - part.mean()) * len(part) if len(part) else 0.0
    for feature in range(rows.shape[1]):
        values = np.unique(rows[:, feature])
        for limit in (values[1:] + values[:-1]) / 2:
            low = rows[:, feature] < limit
            gain = impurity(labels) - impurity(labels[low]) - impurity(labels[~low])
            if gain > best + 1e-9:
                best, node.feature, node.limit = gain, feature, limit
    if node.feature >= 0:
        low = rows[:, node.feature] < node.limit
        node.low, node.high = grow(rows[low], labels[low], depth - 1), grow(rows[~low], labels[~low], depth - 1)
    return node


def decide(node: Node, rows: np.ndarray) -> np.ndarray:
    if node.feature < 0:
        return np.full(len(rows), node.value)
    low = rows[:, node.feature] < node.limit
    out = np.empty(len(rows), bool)
    out[low], out[~low] = decide(node.low, rows[low]), decide(node.high, rows[~low])
    return out


_LONG = "This sentence of the story goes on for a while, so that the block has some twenty words of running text in it."
#: Small pages; blocks of main text begin with a plus sign, others with a minus sign.
EXAMPLES = [
    f"<nav><ul><li><a>-Home</a><li><a>-News and more</a></ul></nav><div class=ad>-{_LONG}</div><article><h1>+Title of it</h1>"
    f"<p>+{_LONG}<p>+Short one.<p>+{_LONG}</article><footer>-Copyright of the example, all rights reserved</footer>",
    f"<header><a>-Site name</a> <p>-The best site</header><main><h1>+A heading</h1><p>+{_LONG} {_LONG}</p><ul><li>+First point<li>"
    f"+<a>Linked point</a></ul><p>+End.</main><aside><h3>-Related</h3><p>-{_LONG}</aside>",
    f"<div id=menu><a>-One</a></div><div><h2>+Heading of text</h2><p>+{_LONG}</p><p>+{_LONG} {_LONG}</p><p>+Few words here.</p><p>+{_LONG}</p></div>"
    f"<div class=comments><p>-{_LONG}</p><p>-I agree.</p></div><div id=cookie-notice>-{_LONG}</div>",
    "<p><a>-Home</a></p><p><a>-Archive of posts</a> <a>About us</a></p><p>-Search</p><p>-Menu</p>"
    f"<p>+{_LONG}</p><p>+{_LONG}</p><p><a>-Next page of this archive</a></p><p>-Imprint</p>",
    f"<form><p>-{_LONG}</p><label>-Name</label></form><article><p>+One.</p><p>+<a>All of it is a link</a></p><h2>+Two</h2>"
    f"<div class=share><a>-Share this</a></div><div class=related><p>-{_LONG}</p></div><p>+{_LONG}</p></article>",
    f"<div role=banner>-Welcome to the site</div><div class=post-content><p>+{_LONG}</p><p>+Yes.</p></div><section class=sidebar><p>-{_LONG}</p></section>",
    f"<p>+{_LONG}</p>", "<p>+A page of a few plain words, about ten of them here.</p>", f"<div class=newsletter>-{_LONG}</div>",
    "<p><a>-Only a link</a></p>", "<footer><p>-Words</p></footer>", "<article>+Word</article>",
    f"<div class='page has-sidebar'><article><h1>+Title</h1><p>+{_LONG}</p><p>+Short.</p></article><div class=sidebar><p>-{_LONG}</p></div></div>",
    f"<div class=widget><article><h2>+Title</h2><p>+{_LONG} {_LONG}</p><p>+Yes.</p></article></div><div class=promo>-{_LONG}</div>",
    f"<div id=search><ul class=menu><li><a>-One</a></ul><div><h1>+Title</h1><p>+{_LONG}</p><p>+{_LONG}</p></div><div class=comments><article>-{_LONG}</article></div></div>",
]


def labelled_table() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of ``EXAMPLES``."""
    rows, labels = [], []
    for page in EXAMPLES:
        blocks = flat_blocks(page)
        rows.append(described(blocks))
        labels += [b.text[0] == "+" for b in blocks]
    return np.concatenate(rows), np.array(labels, float)


def main_text(page: str, tree: Node) -> str:
    blocks = flat_blocks(page)
    if not blocks:
        return ""
    return "\n".join(b.text for b, keep in zip(blocks, decide(tree, described(blocks))) if keep)


def extract(pages: DataFrame, into: str = "text", html_col: str = "html") -> DataFrame:
    """``pages`` with the main text of the whole page in the column ``into``."""
    tree = grow(*labelled_table())

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([main_text(p.as_py(), tree) for p in batch], pa.string())

    return pages.withColumn(into, run(F.coalesce(F.col(html_col).cast("string"), F.lit(""))))
