"""Operator 2: main text of web pages by tag-path ratios.

Every text block of a page belongs to a root-to-leaf path of block tags. Per path, text length (without the text of links) and punctuation are
added up over its blocks; their ratios to the number of blocks are smoothed over the page's sequence of blocks, fused by product and held
against a threshold drawn from their spread. Blocks of paths above it are content, however short a single one is. The lowest element that holds
all content is the article; its headings, lists and short blocks belong to it as well, but not groups of blocks that are mostly links.

What an element is called decides little. Some elements are nothing but furniture (menus, page footers, sidebars, adverts, reader comments, hidden
ones): they are left out unless they hold the article itself, that is the page's only article, main element or first heading and no less text
than is left outside. Others may be furniture (forms, page headers, and names that hold such a word beside others, as ``has-sidebar``): they are
left out only where they are small and hold no such mark.

Character references are decoded once; white space inside a block becomes one space; blocks are trimmed and joined by
two line breaks in page order.

A page is handled on its own, whole, in one pass whose time is linear in its length, however deep or broken its markup: paths are numbered, what
holds for the elements around one is kept with it, open elements are found by their tag, and a tag that is not closed ends at the next ``<``.
Nothing is shuffled. Defined results: null and empty pages give an empty text; unclosed and stray tags are accepted; null ids and repeated rows
stay; an empty table gives an empty result; other columns are ignored whatever their names.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

# How HTML elements behave.
_RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object", "xmp"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var"}
_P_CLOSERS = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
_SAME_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_FURNITURE = {"nav", "footer", "aside", "button", "select", "dialog", "head", "canvas", "audio", "video"}
_MAYBE = {"form", "fieldset", "menu", "header"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar", "toolbar"}
_NAMES = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "sponsor", "sponsored", "promo", "promotion", "cookie", "cookies", "consent", "notice", "notices", "alert", "popup", "modal", "overlay", "gdpr", "disclaimer", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "pagination", "pager", "sidebar", "widget", "widgets", "aside", "related", "recommended", "recommendations", "trending", "footer", "footnav", "copyright", "masthead", "topbar", "toolbar", "comment", "comments", "reply", "replies", "disqus", "respond", "share", "sharing", "social", "follow", "subscribe", "subscription", "newsletter", "signup", "login", "search", "form", "skip"}
_STATES = {"has", "no", "with", "without", "not", "is", "hide", "show", "shows", "hides"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_MARKS = ("article", "main", "h1")

_TAG = re.compile(r"</?([a-zA-Z][^\s/><]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)")
_ATTR = re.compile(r"(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_PUNCT = re.compile(r"[.,;:!?…。，、；：！？¡¿]")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
#: Shares of the text: an element that may be furniture is small below the first; a group of blocks is a list of links from the second on.
SMALL, LINKS = 1 / 3, 0.5

SURE, MAYBE = 2, 1


class _Node:
    __slots__ = ("tag", "parent", "path", "why", "in_article", "size", "marks", "out")

    def __init__(self, tag: str, parent: "_Node | None", path: int, why: int) -> None:
        self.tag, self.parent, self.path, self.why = tag, parent, path, why
        self.in_article = tag in ("article", "main") or bool(parent and parent.in_article)
        self.size, self.marks, self.out = 0, 0, False


def _suspicion(tag: str, attrs: str, in_article: bool) -> int:
    """Whether an element is furniture for certain, maybe, or not, by its tag and attributes."""
    why = SURE if tag in _FURNITURE else MAYBE if tag in _MAYBE and not (tag == "header" and in_article) else 0
    for m in _ATTR.finditer(attrs) if attrs else ():
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name == "hidden" and m[2] is None or name == "aria-hidden" and value == "true":
            return SURE
        if name == "style" and "display:none" in value.replace(" ", "").lower():
            return SURE
        if name == "role" and value.lower() in _ROLES:
            why = max(why, MAYBE if value.lower() == "form" else SURE)
        if name in ("class", "id") and tag not in ("html", "body", "main"):
            for one in value.split():
                words = [w.lower() for w in _NAME.findall(one)]
                odd = [w in _NAMES or (w == "header" and not in_article) for w in words]
                if any(odd):  # a name says what an element is by its last word; other words only that there is something of the kind
                    why = max(why, SURE if odd[-1] and words[0] not in _STATES and words[-1] != "header" else MAYBE)
    return why


def blocks(page: str) -> tuple[list[tuple[_Node, str, int]], set[str], list[_Node]]:
    """Text blocks of a page in order, each with the block element it stands in and its characters in links; tags seen; suspect elements, outer ones first."""
    paths: dict[tuple[int, str], int] = {}
    stack, where = [_Node("", None, 0, 0)], defaultdict(list)
    out: list[tuple[_Node, str, int]] = []
    text: list[str] = []
    linked, link_at = 0, 0  # characters of the block inside links; depth at which a link was opened, 0 if none
    seen: set[str] = set()
    suspects: list[_Node] = []
    pos, n = 0, len(page)
    last = {q: page.rfind(q) for q in "\"'"}

    def flush() -> None:
        nonlocal linked
        if text:
            t = " ".join(html.unescape("".join(text)).split())
            if t:
                out.append((stack[-1], t, min(linked, len(t))))
            text.clear()
        linked = 0

    def pop_to(depth: int) -> None:
        nonlocal link_at
        while len(stack) > depth:
            where[stack.pop().tag].pop()
        if link_at > depth:
            link_at = 0

    def close(tags: set[str], until: set[str] = frozenset()) -> None:
        at = max((where[t][-1] for t in tags if where[t]), default=0)
        if at > max((where[t][-1] for t in until if where[t]), default=0):
            flush()
            pop_to(at)

    def say(t: str) -> None:
        nonlocal linked
        text.append(t)
        if link_at:
            linked += len(t)

    while pos < n:
        start = page.find("<", pos)
        if start < 0:
            say(page[pos:])
            break
        if start > pos:
            say(page[pos:start])
        if page.startswith("<!--", start):
            pos = page.find("-->", start + 4) + 3
            pos = n if pos == 2 else pos
            continue
        if page.startswith("<![CDATA[", start):
            pos = page.find("]]>", start) + 3
            pos = n if pos == 2 else pos
            continue
        if page[start + 1 : start + 2] in ("!", "?"):
            pos = page.find(">", start) + 1 or n
            continue
        m = _TAG.match(page, start)
        if m is None:
            if page[start + 1 : start + 2] == "/" or start + 1 == n:
                pos = page.find(">", start) + 1 or n
            else:
                say("<")
                pos = start + 1
            continue
        pos = m.end()
        while pos < n and page[pos] in last and pos >= last[page[pos]]:  # a quotation mark without its fellow is a sign like others
            stop = re.compile("[<>\"']").search(page, pos + 1)
            pos = stop.start() if stop else n
        if pos < n and page[pos] == ">":
            pos += 1
        elif pos >= n:
            break  # cut off by the end of the page
        tag, attrs = m[1].lower(), m[2]
        if page[start + 1] == "/":
            if tag == "a":
                link_at = 0
            if tag not in _INLINE and tag not in _VOID:
                close({tag})
            continue
        if tag in _RAW:
            if not attrs.rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, pos)
                pos = end.end() if end else n
            text.append("" if tag in ("script", "style", "template", "noscript", "object", "svg", "math") else " ")
            continue
        if tag in ("br", "img", "input", "wbr", "embed"):
            text.append(" " if tag == "br" else "")
            continue
        if tag in _VOID:
            if tag == "hr":
                close({"p"})
                flush()
            continue
        why = 0
        if tag in _INLINE:
            if tag == "a":
                link_at = len(stack)
            why = _suspicion(tag, attrs, True) if tag in ("a", "span", "label") else 0
            if why < SURE:
                continue
        if tag in _P_CLOSERS:
            close({"p"}, {"td", "th", "li", "button", "caption"})
        if tag in _SAME_CLOSES:
            close(*_SAME_CLOSES[tag])
        flush()
        parent = stack[-1]
        node = _Node(tag, parent, paths.setdefault((parent.path, tag), len(paths) + 1), why or _suspicion(tag, attrs, parent.in_article))
        if node.why:
            suspects.append(node)
        seen.add(tag)
        where[tag].append(len(stack))
        stack.append(node)
    flush()
    return out, seen, suspects


def _smooth(x: np.ndarray) -> np.ndarray:
    """Gaussian smoothing over neighbouring blocks (radius 1)."""
    if len(x) < 3:
        return x
    w = np.array([0.25, 0.5, 0.25])
    return np.convolve(np.pad(x, 1, mode="edge"), w, mode="valid")


def _sums(every: list[tuple[_Node, str, int]]) -> list[_Node]:
    """Text and marks (bits of _MARKS) in each element, from the blocks up; the elements with text, inner ones first."""
    order: list[_Node] = []
    known: set[int] = set()
    for node, t, _ in every:
        chain = []
        x = node
        while x is not None and id(x) not in known:
            known.add(id(x))
            x.size = x.marks = 0
            chain.append(x)
            x = x.parent
        order += reversed(chain)  # parents before their sons
        node.size += len(t)
    for x in reversed(order):
        if x.tag in _MARKS:
            x.marks |= 1 << _MARKS.index(x.tag)
        if x.parent is not None:
            x.parent.size += x.size
            x.parent.marks |= x.marks
    return order


def _mark_out(order: list[_Node], least: int) -> None:
    for x in order:  # parents come before their sons
        x.out = x.why >= least or bool(x.parent and x.parent.out)


def _leave_out(every: list[tuple[_Node, str, int]], seen: set[str], suspects: list[_Node]) -> list[tuple[_Node, str, int]]:
    """The blocks outside of furniture."""
    order = _sums(every)
    if not order:
        return []
    _mark_out(order, SURE)
    held = {id(x): (x.size, x.marks) for x in suspects if x.size and x.why == SURE}
    left = [b for b in every if not b[0].out]
    around = _sums(left)
    size, marks = (around[0].size, around[0].marks) if around else (0, 0)
    if not marks:
        for x in suspects:  # outer ones first; what stands between two suspects was out for the outer one alone
            own, theirs = held.get(id(x), (0, 0))
            above = x.parent
            while above is not None and above.out and above.why < SURE:
                above = above.parent
            if theirs and own >= size and not (above and above.out):
                x.why, x.out = 0, False  # it holds the article
    if not left and not seen & {"article", "main"} and not any(not b[0].out for b in every):
        prose = [b for b in every if len(b[1]) >= 80 and b[2] < LINKS * len(b[1]) and len(_PUNCT.findall(b[1])) > 1]
        tops = [x for x in suspects if id(x) in held and not (x.parent and x.parent.out)]
        if prose and tops:
            max(tops, key=lambda x: held[id(x)][0]).why = 0
    _mark_out(order, SURE)
    left = [b for b in every if not b[0].out]
    around = _sums(left)
    total = around[0].size if around else 0
    inner = {id(x) for x in around}
    for x in suspects:
        if x.why == MAYBE and id(x) in inner and (x.marks & 3 or x.size > SMALL * total):
            x.why = 0
    _mark_out(order, MAYBE)
    return [b for b in left if not b[0].out]


def main_text(page: str | None) -> str:
    """The article of a page; empty if there is none."""
    every, seen, suspects = blocks(page or "")
    found = _leave_out(every, seen, suspects) if suspects else every
    if not found:
        return ""
    length, punct, number = defaultdict(int), defaultdict(int), defaultdict(int)
    group = defaultdict(lambda: [0, 0, 0])  # of the blocks of a path under one parent: characters, those in links, blocks
    for node, t, links in found:
        length[node.path] += len(t) - links
        punct[node.path] += len(_PUNCT.findall(t))
        number[node.path] += 1
        for g in (group[id(node.parent), node.path],):
            g[0] += len(t)
            g[1] += links
            g[2] += 1

    def is_links(node: _Node) -> bool:
        chars, links, many = group[id(node.parent), node.path]
        return many > 2 and links >= LINKS * chars

    ratio = np.array([length[x.path] / number[x.path] for x, _, _ in found])
    marks = np.array([(punct[x.path] + 0.1) / number[x.path] for x, _, _ in found])
    fused = np.sqrt(_smooth(ratio) * _smooth(marks)) + np.sqrt(ratio * marks)
    limit = min(fused.std(), fused.max() * 0.5)
    score: dict[int, list[float]] = defaultdict(list)
    for (node, _, _), f in zip(found, fused):
        score[node.path].append(f)
    chosen = {path for path, f in score.items() if np.mean(f) >= limit}
    content = [b for b in found if b[0].path in chosen and not is_links(b[0])] or [b for b in found if b[0].path in chosen] or found
    order = _sums(content)
    total = sum(len(t) for _, t, _ in content)
    article = [x for x in order if x.size == total][-1]
    while article.tag not in ("article", "main", "body", "") and article.parent is not None and _leaf_like(article.tag):
        article = article.parent
    whole = article.tag not in ("body", "html", "")
    inside = {id(article)}
    first, last = (next(i for i, b in enumerate(found) if b is content[j]) if j == 0 else len(found) - 1 - next(i for i, b in enumerate(reversed(found)) if b is content[j]) for j in (0, -1))
    out, known = [], {}
    for i, (node, t, _) in enumerate(found):
        chain, x = [], node
        while x is not None and id(x) not in inside and id(x) not in known:
            chain.append(x)
            x = x.parent
        here = x is not None and (id(x) in inside or known[id(x)])
        known.update({id(y): here for y in chain})
        if not here or is_links(node):
            continue
        if whole or node.path in chosen or node.tag in _HEADINGS or (first < i < last) or node.tag in ("li", "blockquote", "pre", "p"):
            out.append(t)
    return "\n\n".join(out)


def _leaf_like(tag: str) -> bool:
    return tag in ("p", "li", "td", "th", "tr", "tbody", "blockquote", "pre", "dd", "dt", "figcaption") or tag in _HEADINGS


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of each page."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    picked = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return picked.mapInArrow(run, "page_id long, url string, text string, n_chars long")
