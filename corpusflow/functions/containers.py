"""Containers of saved pages found with a stack of open elements: nested ones, unclosed ones, and what is inside them.

A page is read once, from tag to tag.  An end tag closes the nearest open element of its name and all that is open inside it, and is
passed over if there is none; an element without an end tag lasts as long as the one around it, or until a tag comes that can't be in
it.  Work is linear in the page's length, and pages are independent rows.

Selectors are ``tag``, ``tag.class`` or ``.class``, in any case of tag.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions.text import ColumnLike, col
from corpusflow.session import unused

# fixed values of HTML: elements without an end, elements whose content is no markup, elements that aren't shown, and what ends an open element
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title".split())
HIDDEN = frozenset("script style".split())
BLOCKS = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
ITEMS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tr", "td", "th", "thead"}}
HOLDS_ITEMS = frozenset("ul ol dl select table".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/<>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
_CLASS = re.compile(r"(?:^|\s)class\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


@dataclass(slots=True)
class Element:
    """Where an element's content begins and ends."""

    name: str
    classes: frozenset[str]
    start: int
    end: int


class Page:
    """The elements of a page in order, and the runs of text between its tags."""

    def __init__(self, html: str):
        self.elements: list[Element] = []
        self.runs: list[tuple[int, int]] = []
        self._open: list[Element] = []
        self._count: dict[str, int] = {}
        self._blocks: list[Element] = []  # open elements that aren't inline
        self._items: list[list[Element]] = [[]]  # open items by the list or table that holds them
        at = 0
        while m := _TOKEN.search(html, at):
            if m.start() > at:
                self.runs.append((at, m.start()))
            at = m.end()
            if not m[2]:
                continue
            name = m[2].lower()
            if m[1]:
                if self._count.get(name):
                    self._close(name, m.start())
            else:
                at = self._begin(name, m[3], m.start(), at, html)
        if at < len(html):
            self.runs.append((at, len(html)))
        while self._open:
            self._pop(len(html))

    def _begin(self, name: str, attributes: str, tag: int, at: int, html: str) -> int:
        """Where reading goes on after a start tag."""
        self._end_implied(name, tag)
        found = _CLASS.search(attributes)
        one = Element(name, frozenset((found[1] or found[2] or found[3] or "").split()) if found else frozenset(), at, at)
        self.elements.append(one)
        if name in VOID:
            return at
        if name in RAW:
            close = re.compile(rf"</{name}\s*>", re.I).search(html, at)
            one.end = close.start() if close else len(html)
            if name not in HIDDEN and one.end > at:
                self.runs.append((at, one.end))
            return close.end() if close else len(html)
        self._push(one)
        return at

    def _end_implied(self, name: str, tag: int) -> None:
        if name in BLOCKS and self._blocks and self._blocks[-1].name == "p":
            self._close("p", tag)  # with the inline elements still open in it
        ends = ITEMS.get(name, ())
        for one in self._items[-1]:
            if one.name in ends:
                while self._pop(tag) is not one:
                    pass
                break

    def _push(self, one: Element) -> None:
        self._open.append(one)
        self._count[one.name] = self._count.get(one.name, 0) + 1
        if one.name in ITEMS:
            self._items[-1].append(one)
        if one.name in HOLDS_ITEMS:
            self._items.append([])
        if one.name in BLOCKS or one.name in ITEMS or one.name in HOLDS_ITEMS:
            self._blocks.append(one)

    def _pop(self, at: int) -> Element:
        one = self._open.pop()
        one.end = at
        self._count[one.name] -= 1
        if one.name in HOLDS_ITEMS:
            self._items.pop()
        if one.name in ITEMS:
            self._items[-1].pop()
        if self._blocks and self._blocks[-1] is one:
            self._blocks.pop()
        return one

    def _close(self, name: str, at: int) -> None:
        while self._pop(at).name != name:
            pass


def _wanted(selector: str):
    tag, _, cls = selector.partition(".")
    tag = tag.lower()
    return lambda e: (not tag or e.name == tag) and (not cls or cls in e.classes)


def _decoded(text: str, references) -> str:
    """``text`` with all character references decoded as browsers do, or just the pairs of name and character in ``references``, one after the other."""
    if references is None:
        return entities.unescape(text)
    if "&" in text:
        for name, char in references:
            text = text.replace(name, char)
    return text


def _text(html: str, page: Page, starts: list[int], a: int, b: int, drop: list[tuple[int, int]], glue: str, references=None) -> str:
    """The text from a to b without the spans in ``drop``, which are in order and apart."""
    out, d = [], bisect_left(drop, (a, a))
    for s, e in page.runs[bisect_left(starts, a) :]:
        if s >= b:
            break
        while d < len(drop) and drop[d][1] <= s:
            d += 1
        if d == len(drop) or s < drop[d][0]:
            out.append(_decoded(html[s:e], references))
    return glue.join(out)


def _outermost(elements, wanted) -> list[tuple[int, int]]:
    spans, until = [], -1
    for e in elements:
        if e.start >= until and any(w(e) for w in wanted):
            spans.append((e.start, e.end))
            until = max(e.end, e.start)
    return spans


def body_of(html: str, containers, drop, references=None) -> str | None:
    """The text of the first container there is, a line per run of text, without ``drop``; see ``container_body``."""
    page = Page(html)
    wanted = [_wanted(d) for d in drop]
    for choice in map(_wanted, containers):
        for e in page.elements:
            if choice(e):
                text = _text(html, page, [r[0] for r in page.runs], e.start, e.end, _outermost(page.elements, wanted), "\n", references)
                return "\n".join(t for line in text.split("\n") if (t := line.strip()))
    return None


def qa_of(html: str, block: str, question: str, short_question: str, answer: str, doctor: str, references=None) -> list[tuple]:
    """(pos, question, answer, doctor) of every block; see ``extract_qa``."""
    page = Page(html)
    starts = [r[0] for r in page.runs]
    fields = [[e for e in page.elements if w(e)] for w in map(_wanted, (question, short_question, answer, doctor))]
    begins = [[e.start for e in f] for f in fields]
    own = _wanted(block)
    blocks = [e for e in page.elements if own(e)]
    inner = [(e.start, e.end) for e in blocks]
    out = []
    for pos, one in enumerate(blocks):
        # what blocks inside this one hold is theirs
        nested = _outermost((blocks[i] for i in range(pos + 1, bisect_left(inner, (one.end, -1)))), [own])

        def first(i: int) -> str:
            at, d = bisect_left(begins[i], one.start), 0
            while at < len(fields[i]) and fields[i][at].start < one.end:
                e = fields[i][at]
                while d < len(nested) and nested[d][1] <= e.start:
                    d += 1
                if d < len(nested) and nested[d][0] <= e.start:
                    at = bisect_left(begins[i], nested[d][1], at + 1)
                    continue
                return " ".join(_text(html, page, starts, e.start, e.end, nested, " ", references).split())
            return ""

        asked, name = first(0) or first(1), first(3)
        said = first(2)
        said = " ".join(said.replace(name, "").split()) if name else said
        if asked and said:
            out.append((pos, asked, said, name))
    return out


def container_body(html: ColumnLike, containers=("article", "main", "body"), drop=("script", "style", "nav", "aside", "noscript", "footer", "form", "div.ad", "div.ads"), references=None) -> Column:
    """The text of the first container that a page has, in the order of ``containers``, a line per run of text between tags.

    Elements that ``drop`` selects go with all that is inside them.  Null for a null page and one without a container.  Character references
    are decoded as browsers do, those without a semicolon too, or, with ``references``, just these pairs of name and character in their order.
    """

    @F.pandas_udf("string")
    def body(pages: pd.Series) -> pd.Series:
        return pages.map(lambda h: None if h is None else body_of(h, containers, drop, references))

    return body(col(html))


def extract_qa(pages: DataFrame, html: str, block: str, question: str, short_question: str, answer: str, doctor: str, references=None) -> DataFrame:
    """``pages`` with a row per question and answer block: question (full before short), answer (without the doctor's name), doctor, pos.

    Blocks inside blocks are rows of their own, and their text isn't that of the outer one.  Blocks without a question or an answer are left out, but counted in ``pos``.
    White space is single.  Null pages have no blocks.  ``references`` as in ``container_body``.
    """
    (found,) = unused(pages, "qa")
    row = "array<struct<pos:int,question:string,answer:string,doctor:string>>"

    @F.pandas_udf(row)
    def blocks(texts: pd.Series) -> pd.Series:
        return texts.map(lambda h: [] if h is None else [dict(zip(("pos", "question", "answer", "doctor"), r)) for r in qa_of(h, block, question, short_question, answer, doctor, references)])

    made = {"pos", "question", "answer", "doctor"}
    kept = [c for c in pages.columns if c not in made]
    return pages.select(*kept, F.explode(blocks(html)).alias(found)).select(*kept, f"{found}.*")
