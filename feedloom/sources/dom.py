"""Flat element table of an HTML page.

Spark has no HTML functions (its XML functions need well-formed input), so one small Python
helper turns a page into two rendered texts plus one row per element with its place in
those texts. Everything that is *looked for* in a page is a Spark expression over that table
(``feedloom.functions.page``); nothing is selected here.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from feedloom.functions.fixed import CARD_ROW_CLASSES, DATE_STRING_V1
from feedloom.schema import DOM

# Workers get this module's code with the task, so it need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_HIDDEN = frozenset("head script style template noscript".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu "
    "nav ol option p pre section summary table tbody tfoot thead tr ul".split()
)
_IN_HEAD = frozenset("base link meta noscript script style template title".split())
_CELLS = frozenset(("td", "th"))
_ROWS = frozenset(("thead", "tbody", "tfoot"))
_NEWLINE_AFTER = frozenset("p div h1 h2 h3 li".split())
_NO_CONTENT_TAGS = frozenset("nav aside header".split())

# Start tag -> (open elements it ends, elements beyond which it does not look).
_TABLE_EDGE = frozenset(("table", "td", "th", "caption", "button", "object"))
_ENDS = {
    "a": (frozenset(("a",)), _TABLE_EDGE),
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu"))),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "option": (frozenset(("option",)), frozenset(("select", "datalist"))),
    "td": (_CELLS, frozenset(("tr", "table"))),
    "th": (_CELLS, frozenset(("tr", "table"))),
    "tr": (frozenset(("tr",)), _ROWS | {"table"}),
    "thead": (_ROWS, frozenset(("table",))),
    "tbody": (_ROWS, frozenset(("table",))),
    "tfoot": (_ROWS, frozenset(("table",))),
}
_ENDS_P = (frozenset(("p",)), _TABLE_EDGE)

_SPACES = re.compile(r"[ \t\n\r\f]+")
_HIDING_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_PAGES_PER_BATCH = 256
_CHARS_PER_BATCH = 4 << 20  # a batch ends once its pages reach so many bytes of html


def _size(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode("utf-8"))


class _Page(HTMLParser):
    """Builds the element rows and texts of one page."""

    def __init__(self, url: str, mentions: re.Pattern | None, skip: frozenset = frozenset()) -> None:
        super().__init__(convert_charrefs=True)
        self.base, self.mentions, self.skip = url, mentions, skip
        self.rows: list[list] = []
        self.open: list[tuple[int, str, bool]] = []  # row, tag, hidden
        self.inner: list[str] = []
        self.walk: list[str] = []
        self.strings: list[tuple[int, str]] = []
        self.title: str | None = None
        self.inner_len = self.walk_len = 0
        self.breaks, self.gap = 0, ""
        self.inside = {"pre": 0, "svg": 0}

    def updatepos(self, i: int, j: int) -> int:  # line numbers are not needed
        return j

    # --- text ---------------------------------------------------------------------------
    def _emit(self, text: str) -> None:
        self.inner.append(text)
        self.inner_len += _size(text)

    def _emit_pending(self) -> None:
        if self.breaks:
            if self.inner_len:
                self._emit("\n" * self.breaks)
        elif self.gap and self.inner_len and not self.inner[-1].endswith("\n"):
            self._emit(self.gap)
        self.breaks, self.gap = 0, ""

    def _walk(self, text: str) -> None:
        self.walk.append(text)
        self.walk_len += _size(text)

    def handle_data(self, data: str) -> None:
        row, tag, hidden = self.open[-1] if self.open else (-1, "", False)
        if tag == "title" and not self.inside["svg"]:
            self.title = (self.title or "") + data
        self._mention(row, data)
        if hidden:
            return
        self._walk(data)
        if self.inside["pre"]:
            self._emit_pending()
            self._emit(data)
            return
        words = _SPACES.sub(" ", data)
        core = words.strip(" ")
        if words.startswith(" "):
            self.gap = self.gap or " "
        if core:
            self._emit_pending()
            self._emit(core)
            self.gap = " " if words.endswith(" ") else ""

    def handle_comment(self, data: str) -> None:
        self._mention(self.open[-1][0] if self.open else -1, data)

    def _mention(self, row: int, data: str) -> None:
        if self.mentions and self.mentions.search(data):
            self.strings.append((row, data))

    # --- tree ---------------------------------------------------------------------------
    def _break(self, tag: str) -> None:
        if tag in _BLOCK:
            self.breaks = max(self.breaks, 2 if tag == "p" else 1)

    def _close(self, depth: int) -> None:
        """End every open element from the innermost down to stack position ``depth``."""
        while len(self.open) > depth:
            at, tag, hidden = self.open.pop()
            if tag in self.inside:
                self.inside[tag] -= 1
            row = self.rows[at]
            row[1], row[9] = len(self.rows) - 1, self.inner_len
            if not hidden:
                if tag in _NEWLINE_AFTER:
                    self._walk("\n")
                self._break(tag)
            row[11] = self.walk_len

    def _end_implied(self, ends: frozenset, edge: frozenset) -> None:
        for depth in range(len(self.open) - 1, -1, -1):
            tag = self.open[depth][1]
            if tag in ends:
                self._close(depth)
            if tag in ends or tag in edge:
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.open and self.open[-1][1] == "head" and tag not in _IN_HEAD:
            self._close(len(self.open) - 1)
        if tag in _ENDS:
            self._end_implied(*_ENDS[tag])
        if tag in _BLOCK and tag not in ("option", "caption", "html", "body"):
            self._end_implied(*_ENDS_P)
        at = dict(reversed(attrs))
        parent = self.open[-1] if self.open else (-1, "", False)
        hidden = (
            parent[2] or tag in _HIDDEN or tag in self.skip or "hidden" in at
            or bool(_HIDING_STYLE.search(at.get("style") or ""))
        )
        if not hidden:
            if tag == "br":
                self._emit_pending()
                self._emit("\n")
            elif tag == "img":
                alt = at.get("alt") or at.get("aria-label")
                if alt:
                    self._walk(f" {alt} ")
            elif tag in _CELLS and self.rows[-1][2] != "tr":
                self.gap = "\t"
            self._break(tag)
        href = at.get("href")
        self.rows.append([
            len(self.rows), len(self.rows), tag, at.get("class"), href,
            self._resolved(href) if tag == "a" else None,
            at.get("data-testid"), at.get("dir"),
            self.inner_len, self.inner_len, self.walk_len, self.walk_len,
            parent[0], at.get("scrollable") == "true", self._in_row(parent[0]),
        ])
        if tag not in _VOID:
            if tag in self.inside:
                self.inside[tag] += 1
            self.open.append((len(self.rows) - 1, tag, hidden))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def _in_row(self, parent: int) -> bool:
        if parent < 0:
            return False
        row = self.rows[parent]
        return row[14] or (row[2] == "div" and set(CARD_ROW_CLASSES) <= set((row[3] or "").split()))

    def _resolved(self, href: str | None) -> str | None:
        if href is None:
            return None
        try:
            return urljoin(self.base, href.strip())
        except ValueError:
            return href

    def handle_endtag(self, tag: str) -> None:
        for depth in range(len(self.open) - 1, -1, -1):
            here = self.open[depth][1]
            if here == tag:
                return self._close(depth)
            if here in _BLOCK and tag not in _BLOCK and tag not in _CELLS:
                return None

    def finish(self, html: str) -> "_Page":
        self.feed(html)
        self.close()
        self._close(0)
        return self


def _is_main(row: list) -> bool:
    return row[2] in ("article", "main") or row[7] == "auto" or "prose" in (row[3] or "").split()


class _Batch:
    """Collects pages column-wise and builds one Arrow batch."""

    def __init__(self) -> None:
        self.cells: list[list] = [[], [], [], [], []]

    def add(self, url: str, html: str, mentions: re.Pattern | None) -> None:
        page = _Page(url or "", mentions).finish(html or "")
        bare = None
        if mentions and not any(map(_is_main, page.rows)):
            bare = "".join(_Page(url or "", None, _NO_CONTENT_TAGS).finish(html or "").inner)
        for cell, value in zip(
            self.cells, (page.title, "".join(page.inner), bare, "".join(page.walk), page), strict=True
        ):
            cell.append(value)

    def columns(self, schema: pa.Schema) -> list[pa.Array]:
        titles, inner, bare, walk, pages = self.cells
        texts = [pa.array(c, pa.string()) for c in (titles, inner, bare, walk)]
        rows = [_with_parent_range(row, page.rows) for page in pages for row in page.rows]
        strings = [s for page in pages for s in page.strings]
        return [
            *texts,
            _lists(schema.field("strings").type, [len(p.strings) for p in pages], strings),
            _lists(schema.field("elements").type, [len(p.rows) for p in pages], rows),
        ]


def _with_parent_range(row: list, rows: list[list]) -> list:
    parent = row[12]
    span = [rows[parent][8], rows[parent][9]] if parent >= 0 else [None, None]
    return row[:12] + span + row[13:]


def _lists(kind: pa.ListType, sizes: list[int], items: list) -> pa.Array:
    """List-of-struct array from flat items, without a Python object per struct."""
    struct = kind.value_type
    columns = zip(*items, strict=True) if items else [[] for _ in range(struct.num_fields)]
    values = pa.StructArray.from_arrays(
        [pa.array(c, struct.field(i).type) for i, c in enumerate(columns)],
        fields=[struct.field(i) for i in range(struct.num_fields)],
    )
    offsets = [0]
    for size in sizes:
        offsets.append(offsets[-1] + size)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, type=kind)


def _pieces(htmls: pa.Array) -> Iterator[slice]:
    """Ranges of pages whose element tables are built together."""
    start = size = 0
    lengths = htmls if pa.types.is_null(htmls.type) else pc.binary_length(htmls)
    for k, length in enumerate(lengths.to_pylist(), 1):
        size += length or 0
        if k - start >= _PAGES_PER_BATCH or size >= _CHARS_PER_BATCH or k == len(htmls):
            yield slice(start, k)
            start, size = k, 0


def parse_pages(pages: DataFrame, first_generation: bool = False) -> DataFrame:
    """Pages with ``html`` replaced by its title, texts and element table.

    Other columns pass through. Work is per page, so nothing is shuffled; put filters on the
    pages *before* this call, they are not pushed below it. ``strings`` and ``bare_text`` are
    filled only for the ``first_generation`` rules, which alone read them.
    """
    kept = [f for f in pages.schema.fields if f.name != "html"]
    schema = type(DOM)(kept + DOM.fields)
    arrow = to_arrow_schema(schema)
    pattern = DATE_STRING_V1 if first_generation else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mentions = re.compile(pattern, re.I) if pattern else None
        for whole in batches:
            for span in _pieces(whole.column("html")):
                part = whole.slice(span.start, span.stop - span.start)
                built = _Batch()
                for url, html in zip(
                    part.column("url").to_pylist(), part.column("html").to_pylist(), strict=True
                ):
                    built.add(url, html, mentions)
                passed = [part.column(f.name) for f in kept]
                yield pa.RecordBatch.from_arrays(passed + built.columns(arrow), schema=arrow)

    return pages.mapInArrow(run, schema)


def page_function():
    """The element table of a page as a function of (url, html), to be called from SQL.

    It gives what ``parse_pages`` gives, as one struct. The tables of a few pages are handed back
    before the next ones are built, so that a worker never holds those of a whole input batch.
    """
    arrow = to_arrow_schema(DOM)

    @F.arrow_udf(returnType=DOM)
    def parse(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for urls, htmls in batches:
            for span in _pieces(htmls):
                built = _Batch()
                for url, html in zip(urls[span].to_pylist(), htmls[span].to_pylist(), strict=True):
                    built.add(url, html, None)
                yield pa.StructArray.from_arrays(built.columns(arrow), fields=list(arrow))

    return parse
