"""Main text of web pages: flat text blocks classified by a decision tree.

A page becomes a flat list of text blocks; only what a browser does not show (head, scripts, styles, hidden elements and
such) yields none. Each block has its word count, its link density, those of the blocks before and after it, its place
(in the page's main element, outside it though there is one, or on a page without one) and its layout: how surely the
elements around it, from the main element on, are parts of the page's layout. A small decision tree, grown here from
the labelled pages PAGES, keeps or drops each block; nothing else does.

Layout is 3 in elements that are never an article (menus, footers, asides, dialogs, by tag or role), 2 in forms, headers
and elements whose class or id is a layout part's name, 1 where such a name is a part of a class or id (`has-ads`), else 0.
A main element (main, article, or by role) starts anew at 0, whatever names its wrappers or itself have, but not inside
another one, nor as an article whose class is such a name (a reader's comment). One in a layout part counts as main only
on pages that have none elsewhere.

Character references are decoded once; white space inside a block becomes one space; blocks are joined by one
newline in page order. Edge cases: null or empty html and pages without kept blocks give the empty text; cut-off
markup ends its text at the end of the page; a ``<`` that opens no tag is text; repeated rows are extracted alike;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>""", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

# fixed values: elements of the HTML standard by what they mean here
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noframes xmp".split())
_INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr".split())
_CLOSES_P = frozenset("address article aside blockquote center details dialog dd dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section table ul".split())
_NOT_SHOWN = frozenset("head script style noscript template title textarea select option datalist iframe object svg canvas audio video map noframes".split())
_PARTS, _PART_ROLES = frozenset("nav footer aside dialog menu".split()), frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar status".split())
_OWN_PARTS = frozenset("form header button".split())
#: Names that layout parts have.
_NAMES = frozenset("nav navbar navigation menu ad ads adv advert advertisement advertising sponsor sponsored cookie cookies consent gdpr comment comments respond disqus breadcrumb breadcrumbs newsletter subscribe subscription signup login popup modal toolbar pagination pager header masthead footer copyright disclaimer notice notification alert sidebar banner promo share sharing social related recommended widget teaser meta".split())


class Block(NamedTuple):
    text: str
    n_words: int
    link_density: float
    #: 1 in the main element, 0 where the page has none, -1 outside it
    place: int
    #: 0 to 3: how surely it is in a part of the page's layout
    layout: int


class _Open(NamedTuple):
    """An open element with what it inherits from those around it."""

    tag: str
    hidden: bool = False
    layout: int = 0
    #: 0: not in a main element, 1: in one, 2: in one that a layout part holds
    main: int = 0
    linked: bool = False


def _opened(tag: str, attributes: str, around: _Open) -> _Open:
    hidden, whole, some, role = around.hidden or tag in _NOT_SHOWN, False, False, ""
    if attributes:
        for name, *values in _ATTRIBUTE.findall(attributes):
            value, name = "".join(values), name.lower()
            if name in ("class", "id"):
                whole = whole or not _NAMES.isdisjoint(value.lower().split())
                some = some or not _NAMES.isdisjoint(x.lower() for x in _NAME.findall(value))
            elif name == "role":
                role = value.strip().lower()
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
                hidden = True
    is_main = tag == "main" or role in ("main", "article") or tag == "article" and not whole
    if is_main and not around.main:
        return _Open(tag, hidden, 0, 2 if around.layout > 1 else 1, around.linked)
    page = tag in ("html", "body") or is_main
    own = 0 if page else 3 if tag in _PARTS or role in _PART_ROLES else 2 if tag in _OWN_PARTS or role == "form" or whole else 1 if some else 0
    if tag in ("h1", "h2", "h3") and around.tag == "header" and around.main:
        return around._replace(tag=tag, hidden=hidden, layout=0)  # the article's own heading
    return around._replace(tag=tag, hidden=hidden, layout=max(own, around.layout), linked=around.linked or tag == "a")


def blocks(page: str) -> list[Block]:
    """The flat text blocks of a page."""
    found: list[tuple[str, int, int, _Open]] = []  # text, words, words in links, the element around
    text: list[str] = []
    linked: list[str] = []
    stack = [_Open("")]

    def flush() -> None:
        if text:
            flat = " ".join("".join(text).split())
            if flat:
                found.append((flat, flat.count(" ") + 1, len("".join(linked).split()), stack[-1]))
            text.clear()
            linked.clear()

    def add(raw: str) -> None:
        if raw and not stack[-1].hidden:
            text.append(unescape(raw) if "&" in raw else raw)
            if stack[-1].linked:
                linked.append(text[-1])

    def last(tag: str, stop: tuple[str, ...] = ()) -> int:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag == tag:
                return i
            if stack[i].tag in stop:
                break
        return 0

    def close(tag: str, stop: tuple[str, ...] = ()) -> None:
        if i := last(tag, stop):
            del stack[i:]

    at = 0
    while m := _TAG.search(page, at):
        add(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        ends = m[1] or m[4]
        attributes = m[3] or m[6] or ""
        if tag not in _INLINE:
            flush()
        elif tag == "br":
            text.append(" ")
            continue
        if ends:
            close(tag)
            continue
        if tag in _VOID:
            continue
        if tag in _CLOSES_P:
            close("p", ("div", "section", "article", "main", "td", "li", "blockquote", "body"))
        if tag in ("li", "dt", "dd", "option", "tr", "td", "th"):
            close(tag, ("ul", "ol", "dl", "table", "select", "menu"))
        if tag == "a":
            close("a")
        if not attributes.rstrip().endswith("/") or tag not in ("svg", "path"):
            stack.append(_opened(tag, attributes, stack[-1]))
        if tag in _RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            stack.pop()
    add(page[at:])
    flush()
    wanted = 1 if any(e.main == 1 for *_, e in found) else 2 if any(e.main for *_, e in found) else 0
    place = lambda e: 0 if not wanted else 1 if e.main == wanted else -1
    return [Block(t, n, min(1.0, k / n), place(e), e.layout) for t, n, k, e in found]


FEATURES = ("words", "links", "words before", "links before", "words after", "links after", "place", "layout")


def features(found: list[Block]) -> np.ndarray:
    """A row a block, its columns in the order of FEATURES."""
    if not found:
        return np.zeros((0, len(FEATURES)))
    own = np.array([(b.n_words, b.link_density) for b in found])
    where = np.array([(b.place, b.layout) for b in found])
    edge = np.zeros((1, 2))
    return np.hstack([own, np.vstack([edge, own[:-1]]), np.vstack([own[1:], edge]), where])


def _words(n: int) -> str:
    return " ".join(f"w{i}" for i in range(n))


def _p(*sizes: int) -> str:
    """Paragraphs of the article."""
    return "".join(f"<p>{KEEP}{_words(n)}</p>" for n in sizes)


def _list(*sizes: int) -> str:
    """A list of links of so many words."""
    return "<ul>" + "".join(f"<li><a href=x>{_words(n)}</a></li>" for n in sizes) + "</ul>"


#: Marks the blocks of the labelled pages that are article text.
KEEP = "\u00a7"
#: Labelled pages of varied layout.
PAGES = (
    # a main element: everything in it but lists of links, nothing around it
    f"<p>{_words(12)}</p><article><h1>{KEEP}{_words(6)}</h1>{_p(55, 40, 3, 1, 80, 12)}</article><p>{_words(14)}</p>",
    f"<div>{_words(45)}</div><main><h1>{KEEP}{_words(2)}</h1>{_p(30, 2, 5, 60)}<p>{KEEP}{_words(8)} <a href=x>{_words(8)}</a></p>{_p(25)}</main><div>{_words(80)}</div>",
    f"<main>{_p(70, 44)}{_list(3, 4, 2, 5)}</main>{_list(4, 3)}<p>{_words(30)}</p>",
    f"<article><h1>{KEEP}{_words(9)}</h1>{_list(1, 2, 1, 1)}{_p(90, 35, 20)}</article><p>{_words(5)}</p>",
    f"<article>{_p(1, 2, 1, 260)}<p>{KEEP}<a href=x>{_words(6)}</a></p>{_p(48)}</article>",
    f"<article><p>{KEEP}{_words(40)}</p><p>{KEEP}<a href=x>{_words(4)}</a> {_words(2)}</p>{_p(9, 7, 22)}</article><p>{_words(11)}</p>",
    # no main element: long blocks with few links, and short ones between them
    f"{_list(1, 1, 2)}<h1>{KEEP}{_words(7)}</h1>{_p(50, 66, 38)}<p>{_words(9)} <a href=x>{_words(5)}</a></p>{_list(2, 3, 2)}<p>{_words(6)}</p>",
    f"<p>{_words(4)} <a href=x>{_words(3)}</a></p>{_list(2, 1)}{_p(120)}<h2>{KEEP}{_words(3)}</h2>{_p(45, 60)}{_list(3, 3, 4)}<p>{_words(10)} <a href=x>{_words(3)}</a></p>",
    f"{_list(1, 1, 1, 2)}<p>{_words(3)}</p>{_list(2, 2)}{_p(35, 28, 41, 33)}<p>{KEEP}{_words(20)} <a href=x>{_words(2)}</a></p>{_p(30)}{_list(6, 7, 5)}",
    f"<h2>{KEEP}{_words(5)}</h2>{_p(75, 18, 52)}<div>{_words(12)} <a href=x>{_words(20)}</a></div>{_list(8, 9)}",
    f"{_list(1, 2)}{_p(40, 30, 60)}",
    f"{_list(2, 1)}{_p(50)}",
    f"{_p(33, 45)}",
    f"{_p(4)}",
    f"<h1>{KEEP}{_words(4)}</h1>{_p(26, 14, 90)}",
    f"{_p(31, 27)}{_list(4, 2)}<p>{_words(5)}</p>",
    # wrappers with the name of a layout part
    f"<div class='layout has-sidebar'>{_p(64, 48, 71)}<h2>{KEEP}{_words(4)}</h2>{_p(55)}</div><div class=sidebar><p>{_words(8)} <a href=x>{_words(6)}</a></p>{_list(3, 2, 4)}</div>",
    f"<div class='has-sidebar'>{_p(40, 70)}</div>",
    f"<div class='page menu-left'>{_p(80, 60, 24)}</div>",
    f"{_p(46, 52)}<div class=promo><p>{_words(8)}</p><p>{_words(6)}</p></div>",
    f"<article>{_p(60, 44)}<div class=share>{_list(1, 1, 1)}</div></article><div class=related><p>{_words(3)}</p>{_list(5, 6, 7)}</div>",
    f"<div class=header><p>{_words(2)}</p>{_list(1, 2, 1)}</div>{_p(42, 58, 37)}<div class=widget><p>{_words(9)}</p>{_list(2, 2)}<p>{_words(7)}</p></div>",
    # parts by tag and role, around a main element, inside one and on pages without one
    f"<nav>{_list(1, 1, 2)}</nav><header><p>{_words(3)}</p></header><article><h1>{KEEP}{_words(6)}</h1>{_p(70, 4, 33)}<footer><p>{_words(5)}</p></footer><aside><p>{_words(30)}</p></aside></article><aside><p>{_words(60)}</p></aside><footer><p>{_words(9)}</p></footer>",
    f"<header>{_list(1, 1)}</header><main><header><h1>{KEEP}{_words(5)}</h1><p>{_words(4)}</p></header>{_p(2, 90, 1, 40)}<form><p>{_words(6)}</p></form><section class=comments><p>{_words(45)}</p><p>{_words(4)}</p><p>{_words(70)}</p></section></main><footer>{_list(2, 2)}</footer>",
    f"<nav>{_list(1, 2, 1)}</nav><div class=ad><p>{_words(6)}</p></div>{_p(66, 51, 48)}<div class=comments><p>{_words(25)}</p><p>{_words(31)}</p></div><aside><p>{_words(55)}</p></aside><footer><p>{_words(60)}</p></footer>",
    f"<div class=cookie><p>{_words(22)}</p></div><main>{_p(38, 3)}<div class='content has-ads'>{_p(50, 64, 7)}</div><div class=share-links>{_list(1, 1)}</div></main>",
    f"<form><nav>{_list(1, 1)}</nav>{_p(72, 58, 90)}<p>{_words(4)}</p></form><footer><p>{_words(14)}</p></footer>",
    f"<div class=notice>{_p(81, 66, 93, 57)}</div>",
    f"<div class=notice><p>{_words(14)}</p></div>{_p(50, 70)}<div class=newsletter><p>{_words(18)}</p><p>{_words(3)}</p></div>",
    f"<div class=page-header>{_list(1, 1)}</div><div class='post with-related'><p>{KEEP}{_words(62)}</p>{_p(57, 49)}</div><div class=social><p>{_words(4)}</p>{_list(1, 1)}</div>",
)


def labelled(pages: tuple[str, ...] = PAGES) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the labelled pages' blocks."""
    found = [blocks(p) for p in pages]
    return np.vstack([features(b) for b in found]), np.array([x.text.startswith(KEEP) for b in found for x in b], float)


class Node(NamedTuple):
    feature: int
    cut: float
    low: Node | bool
    high: Node | bool


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8) -> Node | bool:
    """A binary decision tree by Gini impurity; ties go to the first feature and the lowest cut."""
    if depth == 0 or len(set(y.tolist())) == 1:
        return bool(2 * y.sum() > len(y))
    impurity = lambda part: len(part) * (p := part.mean()) * (1 - p) if len(part) else 0.0
    best = (impurity(y) - 1e-12, -1, 0.0)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[:-1] + values[1:]) / 2:
            low = x[:, f] <= cut
            best = min(best, (impurity(y[low]) + impurity(y[~low]), f, float(cut)))
    _, f, cut = best
    if f < 0:
        return bool(2 * y.sum() > len(y))
    low = x[:, f] <= cut
    return Node(f, cut, grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1))


def decide(tree: Node | bool, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, bool):
        return np.full(len(x), tree)
    low = x[:, tree.feature] <= tree.cut
    return np.where(low, decide(tree.low, x), decide(tree.high, x))


def main_text(page: str | None, tree: Node | bool) -> str:
    found = blocks(page or "")
    return "\n".join(b.text for b, keep in zip(found, decide(tree, features(found)), strict=True) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of pages(page_id, url, html)."""
    tree = grow(*labelled())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h.as_py(), tree) for h in b.column("html")]
            yield pa.RecordBatch.from_arrays([b.column("page_id").cast(pa.int64()), b.column("url").cast(pa.string()), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
