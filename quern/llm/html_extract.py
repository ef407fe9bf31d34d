"""HTML extraction by tag-path ratios.

A page is read into blocks of text, each with its root-to-leaf path of block tags and classes. For each path
the length of its text and its punctuation are added up and divided by its blocks; both ratios are
smoothed over the blocks in page order and fused by their product, so that the paths of running text stand
out. A path is content if its fused ratio passes a share of that of the path with most running text, whatever length it adds
up to and unless it is mostly links. Kept is all of each part that directly holds such a path and, in the smallest
element around all of them (the body, say), every block between the first and the last one, with the heading before
and lists, tables and quotations right after. What HTML itself calls menu,
header, footer, aside or the like is never content. What only a class names so, and forms, are read in a second go,
which counts if it gives `MUCH` times the running text; names of remarks, adverts and cookie notes hold unless nothing
is left without them. A `main` is free of the names around it. Of a page with `article` or `main` that part is kept, without the links before and
after the running text that the ratios find in it, unless the content outside of it has `MUCH` times its running text.

Nulls and odd cases: a null or empty page, or one without text, gives the empty text; unclosed and misplaced
tags are closed where HTML closes them; time and memory grow with the page's length, however deep it nests; equal pages give equal texts; repeated rows stay; an empty table gives an
empty result; extra columns are left out.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import by_bytes, keyed, named, utf8

#: Share of the best path's fused ratio that makes a path content by itself; weight of the neighbours when smoothing.
SHARE, NEIGHBOUR = 0.2, 0.5
#: How many times the running text outweighs a name or an `article`.
MUCH = 4
# Fixed values of the format: void elements, raw-text elements, elements that break a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noframes xmp".split())
BLOCK = frozenset(
    "html body address article aside blockquote center details dialog dd div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol optgroup option p pre search section select summary table "
    "tbody td tfoot th thead tr ul caption button object canvas audio video svg math head".split()
)
#: Elements that are no running text of the page.
DROPPED = frozenset("nav header footer aside form menu head select option optgroup button dialog svg math object canvas audio video fieldset search".split())
#: Words of a class, id or role that name such parts.
NAMED = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs "
    "header masthead footer sidebar aside widget widgets comment comments respond disqus replies reply notice notices cookie cookies consent gdpr alert popup modal overlay "
    "newsletter subscribe subscription signup login share sharing social related recommended toolbar pagination pager search form complementary contentinfo".split()
)
#: What a reader's comment is called where it is an article of its own, and words that turn a name into its absence or mere presence.
REMARKS = frozenset("comment comments reply replies respond".split())
#: Names that hold however much text the part has: such parts may be longer than the article.
FIRM = REMARKS | frozenset("disqus ad ads advert adverts advertisement advertising sponsor sponsored sponsors cookie cookies consent gdpr related recommended".split())
#: Why a part is left out: a form or name that may mislead, a firm name, or HTML itself.
LOOSE, STRICT, NEVER = 1, 2, 3
TURNED = frozenset("no not has with without is".split())
#: Tags that an opening tag closes, as far up as the nearest of their containers.
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
KEPT_BY = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
_NO_P = frozenset(BLOCK - {"html", "body", "head", "td", "th", "caption", "legend", "option", "optgroup", "button", "object", "canvas", "audio", "video", "svg", "math", "tbody", "thead", "tfoot", "tr", "select"})
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>?"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>"
    r"|[^<]+|<",
    re.S,
)
_ATTRIBUTE = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:[\s=/]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
#: Elements that may hold a page's content as a whole, and those that belong to the running text before them.
WRAPPERS = frozenset("article main body div section td".split())
HEADINGS, APPENDED = frozenset("h1 h2 h3 h4 h5 h6".split()), frozenset("ul ol dl table blockquote pre figure details".split())
_WORD = re.compile(r"[a-z]+")
_PUNCTUATION = re.compile(r"[.,;:!?…。、，；：！？]")
_SPACE = re.compile(r"\s+")


class _Page:
    """A page's elements as they open: parent, tag, path, and the last element inside each; its blocks of text.

    Elements are numbered in page order, so an element holds just those from its own number to `last`. A path is known by a
    number: of its parent's path and its own label. So whatever the nesting, each element and block takes the same room.
    """

    def __init__(self):
        self.parent, self.tag, self.path, self.last = [-1], [""], [0], [0]
        self.wrapper, self.inside = [0], [False]  # the innermost element that may hold content; whether in article or main
        self.paths: dict[tuple[int, str], int] = {}
        self.blocks: list[_Block] = []

    def open(self, parent: int, tag: str, label: str) -> int:
        n = len(self.parent)
        self.parent.append(parent)
        self.tag.append(tag)
        self.path.append(self.paths.setdefault((self.path[parent], label), len(self.paths) + 1))
        self.last.append(n)
        self.wrapper.append(n if tag in WRAPPERS else self.wrapper[parent])
        self.inside.append(self.inside[parent] or tag in ("article", "main"))
        return n

    def holds(self, element: int, other: int) -> bool:
        return element <= other <= self.last[element]

    def child(self, element: int, other: int) -> int:
        """The child of an element that an element inside of it is in."""
        while self.parent[other] != element:
            other = self.parent[other]
        return other


class _Block:
    """A block's element, path and tag, its text and whether that is mostly links, and why it may be left out."""

    __slots__ = ("element", "path", "tag", "text", "inside", "linked", "mark")

    def __init__(self, element: int, path: int, tag: str, text: str, inside: bool, linked: bool, mark: int):
        self.element, self.path, self.tag, self.text, self.inside, self.linked, self.mark = element, path, tag, text, inside, linked, mark


def _named(marks: str, names: frozenset[str]) -> bool:
    """Whether a class, id or role names such a part: `site-footer` does, `no-sidebar` doesn't."""
    parts = (_WORD.findall(m) for m in marks.split())
    return any(p and p[0] not in TURNED and not names.isdisjoint(p) for p in parts)


def read(page: str) -> _Page:
    """The elements and the blocks of text in page order with their marks, without the parts that are never content."""
    out = _Page()
    stack: list[tuple[str, int, int, str]] = []  # tag, mark of it or what is around it, its number, why it is marked
    opened: Counter[str] = Counter()  # how many of each tag are open
    words: list[str] = []
    link, in_links = False, 0

    def flush() -> None:
        nonlocal in_links
        if words:
            linked = 2 * in_links > sum(len(w.strip()) for w in words)
            text = _SPACE.sub(" ", html.unescape("".join(words))).strip()
            words.clear()
            in_links = 0
            mark, element = (stack[-1][1], stack[-1][2]) if stack else (0, 0)
            if text and mark < NEVER:
                out.blocks.append(_Block(element, out.path[element], out.tag[element], text, out.inside[element], linked, mark))

    def close(depth: int) -> None:
        flush()
        for tag, _, element, _ in stack[depth:]:
            opened[tag] -= 1
            out.last[element] = len(out.parent) - 1
        del stack[depth:]

    def innermost(tags: tuple[str, ...], kept_by: tuple[str, ...] = ()) -> int:
        """The place of the innermost open element of these tags, up to one that keeps it open; -1 if none."""
        if any(opened[t] for t in tags):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in tags:
                    return i
                if stack[i][0] in kept_by:
                    break
        return -1

    at, end, closed = 0, len(page), page.rfind(">")
    while at < end:
        if at > closed and page[at] == "<" and page[at + 1 : at + 2] not in ("!", "?"):
            words.append("<")  # no tag can end any more
            at += 1
            continue
        m = _TOKEN.match(page, at)
        at = m.end()
        token = m.group()
        if token[0] != "<":
            words.append(token)
            in_links += len(token.strip()) if link else 0
            continue
        name = m.group(2) or m.group(5)
        if name is None:
            if token == "<":
                words.append("<")
            elif token.startswith("<![CDATA["):
                words.append(html.escape(token[9:-3]))
            continue
        closing, name, attributes = m.group(1) or m.group(4), name.lower(), m.group(3) or m.group(6) or ""
        if name == "a":
            link = not closing
        if closing:
            if name == "br":
                words.append(" ")
            elif name in BLOCK:
                depth = innermost((name,))
                close(depth if depth >= 0 else len(stack))
            continue
        if name in RAW:
            stop = re.compile(rf"</{name}\s*/?>", re.I).search(page, at)
            if name not in ("noscript", "template"):
                at = stop.end() if stop else end
                if name in ("iframe", "textarea"):
                    words.append(" ")
            elif stop:
                at = stop.end()
            continue
        if name == "br":
            words.append(" ")
            continue
        if name == "hr":
            flush()
            continue
        if name in VOID or name not in BLOCK:
            if name in ("img", "input", "embed"):
                words.append(" ")
            continue
        if name in CLOSED_BY:
            while (depth := innermost(CLOSED_BY[name], KEPT_BY[name])) >= 0:
                close(depth)
                if name != "tr":
                    break
        elif name in _NO_P and (depth := innermost(("p",), ("td", "th", "button", "caption", "object", "table"))) >= 0:
            close(depth)
        if name not in ("html", "head") and (depth := innermost(("head",))) >= 0:
            close(depth)
        flush()
        marks = " ".join("".join(x) for x in _ATTRIBUTE.findall(attributes)).lower() if attributes.strip() else ""
        plain = name in ("html", "body", "main")
        around, why = (stack[-1][1], stack[-1][3]) if stack else (0, "")
        if around < NEVER and (name == "main" or why == "form" and name == "article"):
            around, why = 0, ""  # a named part or a form around a whole page
        if name == "form" and around < LOOSE:
            around, why = LOOSE, "form"
        elif name != "form" and name in DROPPED or _HIDDEN.search(attributes):
            around = NEVER
        if around < STRICT and not plain and marks and _named(marks, REMARKS if name == "article" else NAMED):
            around, why = STRICT if _named(marks, FIRM) else LOOSE, "named"
        if not attributes.rstrip().endswith("/") or name not in ("svg", "math"):
            label = f"{name}.{marks}" if marks and not plain and name != "article" else name
            stack.append((name, around, out.open(stack[-1][2] if stack else 0, name, label), why))
            opened[name] += 1
    close(0)
    out.last[0] = len(out.parent) - 1
    return out


def tag_path_ratios(blocks: list[_Block]) -> dict[int, float]:
    """The fused, smoothed ratio of each path."""
    totals: dict[int, list[int]] = {}
    for b in blocks:
        t = totals.setdefault(b.path, [0, 0, 0])
        t[0] += 1
        t[1] += len(b.text)
        t[2] += len(_PUNCTUATION.findall(b.text))
    ratios = np.array([(totals[b.path][1] / totals[b.path][0], (totals[b.path][2] + 0.5) / totals[b.path][0]) for b in blocks])
    padded = np.pad(ratios, ((1, 1), (0, 0)), mode="edge")
    smooth = (padded[1:-1] + NEIGHBOUR * (padded[:-2] + padded[2:])) / (1 + 2 * NEIGHBOUR)
    fused: dict[int, list[float]] = {}
    for b, (length, marks) in zip(blocks, smooth.tolist()):
        fused.setdefault(b.path, []).append(length * marks)
    return {p: sum(v) / len(v) for p, v in fused.items()}


def running(blocks: list[_Block]) -> list[_Block]:
    """The blocks whose paths stand out by their ratios."""
    fused, totals = tag_path_ratios(blocks), Counter()
    for b in blocks:
        totals[b.path] += 0 if b.linked else len(b.text)
    # The path to compare with counts by its text as well: one long line doesn't outweigh an article of many.
    best = max(fused, key=lambda p: fused[p] * totals[p])
    return [b for b in blocks if fused[b.path] >= SHARE * fused[best] and not b.linked] or [b for b in blocks if b.path == best]


def content(page: _Page, blocks: list[_Block]) -> list[_Block]:
    """The blocks of running text and what stands among them."""
    if not blocks:
        return []
    seeds = running(blocks)
    # The smallest element that may hold content around all of them; the page itself if there is none.
    around, first, last = page.wrapper[seeds[0].element], min(b.element for b in seeds), max(b.element for b in seeds)
    while around and not (page.holds(around, first) and page.holds(around, last)):
        around = page.wrapper[page.parent[around]]
    parts = sorted({w for b in seeds if (w := page.wrapper[b.element]) and page.tag[w] != "body"})
    reach = np.maximum.accumulate(np.array([page.last[w] for w in parts] or [-1]))
    before = np.searchsorted(parts, [b.element for b in blocks], "right") - 1
    sure = {id(b) for b in seeds}
    held = [i for i, b in enumerate(blocks) if id(b) in sure or before[i] >= 0 and reach[before[i]] >= b.element]
    start, stop = held[0], held[-1] + 1
    heading = start - 1
    while heading >= 0 and page.holds(around, blocks[heading].element) and not blocks[heading].linked and not _heading(blocks[heading]):
        heading -= 1
    while heading >= 0 and page.holds(around, blocks[heading].element) and _heading(blocks[heading]):
        start, heading = heading, heading - 1
    child = 0
    for i in range(stop, len(blocks)):
        b, tag = blocks[i], ""
        if not b.linked and page.holds(around, b.element) and b.element != around:
            child = child if child and page.holds(child, b.element) else page.child(around, b.element)
            tag = page.tag[child]
        if tag in APPENDED:
            stop = i + 1
        elif tag not in HEADINGS:
            break
    return [b for b in blocks[start:stop] if page.holds(around, b.element)]


def _heading(block: _Block) -> bool:
    return not block.linked and block.tag in HEADINGS


def _running(blocks: list[_Block]) -> int:
    """How much running text there is: with a mark, and not mostly links."""
    return sum(len(b.text) for b in blocks if not b.linked and _PUNCTUATION.search(b.text))


def _preferred(page: _Page, blocks: list[_Block]) -> list[_Block]:
    """What is inside `article` or `main`, unless the real article stands outside of it."""
    inside = [b for b in blocks if b.inside]
    if not inside:
        return content(page, blocks)
    outside = [b for b in blocks if not b.inside]
    if _running(outside) <= MUCH * _running(inside) or _running(found := content(page, outside)) <= MUCH * _running(inside):
        return _whole(inside)
    sure = {id(b) for b in found}
    first, last = blocks.index(found[0]), blocks.index(found[-1])
    return [b for b in blocks[first : last + 1] if b.inside or id(b) in sure]


def _whole(inside: list[_Block]) -> list[_Block]:
    """What is inside `article` or `main`, but for links before and after the content that the ratios find.

    The author marked all of it as the article, so short lines at its edges stay.
    """
    seeds = running(inside)
    first, last = inside.index(seeds[0]), inside.index(seeds[-1])
    return [b for i, b in enumerate(inside) if first <= i <= last or not b.linked]


def main_text(html_text: str) -> str:
    """The content blocks, joined by an empty line."""
    page = read(html_text)
    kept: list[_Block] = []
    for mark in (0, LOOSE, STRICT):
        if any(b.mark == mark for b in page.blocks):
            now, before = [b for b in page.blocks if b.mark <= mark], _running(kept)
            # Firm names hold as long as there is running text, or an article of a few words, without them.
            if not kept or (mark == LOOSE or not before and not any(b.inside for b in kept)) and _running(now) > MUCH * before:
                found = _preferred(page, now)
                kept = found if not kept or _running(found) > MUCH * before else kept
    return "\n\n".join(b.text for b in kept)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches, "__html"):
        texts = [main_text(x.decode("utf-8", "replace")) if x else "" for x in utf8(batch.column("__html"))]
        names = [n for n in batch.schema.names if n != "__html"]
        made = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
        yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], *made], [*names, "text", "n_chars"])


def extract(pages: DataFrame, keys: list[str], page: str = "html") -> DataFrame:
    """`keys`, text and n_chars for each row of `pages`."""
    kept = keyed(pages, keys, __html=F.col(f"`{page}`").cast("string"))
    schema = T.StructType(list(kept.drop("__html").schema.fields)).add("text", "string").add("n_chars", "long")
    return named(kept.mapInArrow(_extracted, schema), keys)
