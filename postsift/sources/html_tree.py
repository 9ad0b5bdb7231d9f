"""Nested elements of scraped pages (S5): one pass over a page with a stack of open tags.

A list item may hold lists, quoted posts, comments and scripts, so the first ``</li>`` behind
its start need not be its own end.  ``nested_elements`` finds the elements with a given tag and
class and gives, in the order of their starts,

* ``html``: the element's source without comments, without the contents of scripts and styles and
  without other such elements inside it (they are rows of their own), and
* ``parent``: the place of the nearest such element around it (null when there is none).

Rules: void elements have no end; an ``<li>`` ends an open one of the same list; an end tag
ends everything opened inside its element, and is left out when nothing of its name is open (for
``</li>``: in the same list); what is open at the end of the page ends there.  A tag, comment or
script that never ends hides the rest of the page.  Time is linear in the page.  A null or
empty page has no elements.
"""

from __future__ import annotations

import re
from typing import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of HTML.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
RAW_TEXT = {"script", "style"}
LISTS = {"ol", "ul", "menu"}

_NEXT = re.compile(r"<(?:!--|[!?]|/|(?=[A-Za-z]))")
_START = re.compile(r"""<([A-Za-z][^\s/>]*+)((?:[^>"']|"[^"]*+"|'[^']*+')*+)>""")
_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in RAW_TEXT}


def _classes(attributes: str) -> list[str]:
    for m in _ATTRIBUTE.finditer(attributes):
        if m.group(1).lower() == "class":
            return (m.group(2) or m.group(3) or m.group(4) or "").split()
    return []


class _Page:
    def __init__(self, source: str, tag: str, css_class: str):
        self.source, self.tag, self.css_class = source, tag, css_class
        self.found: list = []      # [pieces, parent]
        self.open: list = []       # (name, place in found or None)
        self.count: dict = {}      # open elements by name
        self.lists: list = []      # depths of the open lists and list items
        self.inside: list = []     # places of the open elements that are looked for
        self.mark = 0              # where the text begins that no element has got yet

    def flush(self, upto: int, skip_to: int) -> None:
        if self.inside:
            self.found[self.inside[-1]][0].append(self.source[self.mark:upto])
        self.mark = skip_to

    def close_one(self, at: int) -> None:
        name, place = self.open.pop()
        self.count[name] -= 1
        if self.lists and self.lists[-1] == len(self.open):
            self.lists.pop()
        if place is not None:
            self.flush(at, at)
            self.inside.pop()

    def close_to(self, depth: int, start: int, end: int) -> None:
        """End the element at ``depth``, whose end tag goes from start to end, and all inside it."""
        while len(self.open) > depth + 1:
            self.close_one(start)
        self.close_one(end)

    def item_open(self) -> bool:
        return bool(self.lists) and self.open[self.lists[-1]][0] == "li"

    def start_tag(self, name: str, attributes: str, start: int) -> None:
        if name == "li" and self.item_open():
            self.close_to(self.lists[-1], start, start)
        place = None
        if name == self.tag and self.css_class in _classes(attributes):
            self.flush(start, start)
            place = len(self.found)
            self.found.append(([], self.inside[-1] if self.inside else None))
            self.inside.append(place)
        if name == "li" or name in LISTS:
            self.lists.append(len(self.open))
        self.open.append((name, place))
        self.count[name] = self.count.get(name, 0) + 1

    def end_tag(self, name: str, start: int, end: int) -> None:
        if name == "li":
            if self.item_open():
                self.close_to(self.lists[-1], start, end)
        elif self.count.get(name):
            depth = len(self.open) - 1
            while self.open[depth][0] != name:
                depth -= 1
            self.close_to(depth, start, end)

    def read(self) -> list[dict]:
        source, at = self.source, 0
        while (m := _NEXT.search(source, at)) is not None:
            start, kind = m.start(), m.group()
            if kind == "<!--":
                end = source.find("-->", start + 2)
                stop = end + 3 if end >= 0 else -1
            elif kind == "<":
                tag = _START.match(source, start)
                stop = tag.end() if tag else -1
            else:
                stop = source.find(">", start) + 1 or -1
            if stop < 0:                           # never ends: the rest of the page is hidden
                self.flush(start, len(source))
                break
            if kind == "<!--":
                self.flush(start, stop)
            elif kind == "</":
                name = _NAME.match(source, start + 2)
                if name:
                    self.end_tag(name.group().lower(), start, stop)
            elif kind == "<":
                name = tag.group(1).lower()
                if name in RAW_TEXT:
                    end = _RAW_END[name].search(source, stop)
                    self.flush(stop, end.start() if end else len(source))
                    stop = end.start() if end else len(source)
                if name in VOID:
                    pass
                else:
                    self.start_tag(name, tag.group(2), start)
            at = stop
        while self.open:
            self.close_one(len(source))
        return [{"html": "".join(pieces), "parent": parent} for pieces, parent in self.found]


def read_elements(source: str | None, tag: str, css_class: str) -> list[dict]:
    """The elements of one page."""
    return _Page(source, tag, css_class).read() if source else []


def nested_elements(page: Column, tag: str, css_class: str) -> Column:
    """Array of (html, parent) of a page's elements ``tag`` with ``css_class``."""
    @F.pandas_udf("array<struct<html:string,parent:bigint>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pd.Series([read_elements(p, tag, css_class) for p in pages])

    return run(page)
