"""HTML to blocks: headings, paragraphs, list items, quotes, code, tables, images.

One pass of the standard library's parser over each page, in Arrow batches; a
page is one row, so nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, StructField, StructType

BLOCKS = "seq int, kind string, text string, level int, ordered boolean, src string, rows array<array<string>>, header_rows int"
SKIPPED = {"script", "style", "nav", "template", "head"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
OPENS = {"p": "para", "li": "list_item", "blockquote": "quote", "figcaption": "caption", "caption": "caption", "dt": "para", "dd": "para"}
PARTS = {"div", "section", "article", "main", "header", "footer", "aside", "body", "ul", "ol", "dl", "figure", "form"}
MARKS = {"b": "**", "strong": "**", "em": "*", "i": "*", "code": "`"}
_SPACE = re.compile(r"[ \t\n\x0b\f\r]+")
#: What marks a note, and a reference to one.
NOTE_TYPES = ("footnote", "endnote", "rearnote", "doc-footnote", "doc-endnote")
REF_TYPES = ("noteref", "doc-noteref")


@dataclass
class _Block:
    kind: str
    level: int = 0
    ordered: bool = False
    parts: list[str] = field(default_factory=list)
    src: str | None = None
    rows: list[list[str]] | None = None
    header_rows: int = 0


class _Reader(HTMLParser):
    """A stack of open elements.

    A block element ends the text block before it, so a tag that is never
    closed costs its own mark and nothing after it.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[_Block] = []
        self.open: list[str] = []
        self.now: _Block | None = None
        self.title: list[str] = []
        self.links: list[tuple[str, str]] = []
        self.table: _Block | None = None
        self.cell: list[str] | None = None
        self.outer: list[tuple[_Block, list[str] | None]] = []
        self.notes: list[tuple[int, str]] = []  # depth of the open element, and the note's id
        self.ref: tuple[int, str] | None = None
        self.link: tuple[str, list[str]] | None = None
        self.marks: list[str] = []

    def _end(self) -> None:
        if self.now:
            if self.marks:
                self.now.parts = ["".join(self.now.parts).rstrip(), *reversed(self.marks)]
                self.marks.clear()
            text = "".join(self.now.parts)
            text = text.strip("\n") if self.now.kind == "code" else _SPACE.sub(" ", text).strip()
            for mark in set(MARKS.values()):
                text = text.replace(f"{mark} {mark}", " ") if mark != "*" else text
            if text.replace("*", "").replace("`", "").strip():
                if self.notes and self.now.kind in ("para", "list_item"):
                    self.now.kind, self.now.src = "footnote", self.notes[-1][1]
                self.now.parts = [text]
                self.blocks.append(self.now)
        self.now = None

    def _begin(self, kind: str, **more) -> None:
        self._end()
        self.now = _Block(kind, **more)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = dict(attrs)
        if tag == "br":
            self.handle_data(" ")
        elif tag == "hr":
            self._end()
            self.blocks.append(_Block("hr"))
        elif tag == "img" and not self._skipping():
            self._end()
            self.blocks.append(_Block("image", src=a.get("src") or "", parts=[a.get("alt") or ""]))
        if tag in VOID:
            return
        self.open.append(tag)
        kinds = f"{a.get('epub:type') or ''} {a.get('role') or ''} {a.get('class') or ''}".split()
        if tag == "a":
            self.link = (a.get("href") or "", [])
            if not self._skipping() and any(k in REF_TYPES for k in kinds) and self.ref is None:
                self.handle_data(f"[^{a.get('href') or ''}]")
                self.ref = (len(self.open), a.get("href") or "")
        if self._skipping():
            return
        in_notes = any(k in ("endnotes", "footnotes", "rearnotes", "doc-endnotes") for k in kinds) or (self.notes and not self.notes[-1][1])
        if any(k in NOTE_TYPES for k in kinds) or (tag == "li" and in_notes and a.get("id")):
            self._end()
            self.notes.append((len(self.open), a.get("id") or "n"))
        elif in_notes and any(k.endswith("notes") for k in kinds):
            self.notes.append((len(self.open), ""))
        if len(tag) == 2 and tag[0] == "h" and tag[1].isdigit():
            self._begin("heading", level=int(tag[1]))
        elif tag == "pre":
            self._begin("code")
        elif tag == "table":
            self._end()
            if self.table:
                self.outer.append((self.table, self.cell))
            self.table, self.cell = _Block("table", rows=[]), None
        elif tag == "tr" and self.table:
            self.table.rows.append([])
        elif tag in ("td", "th") and self.table:
            if not self.table.rows:
                self.table.rows.append([])
            self.cell = []
            if tag == "th" and len(self.table.rows) == self.table.header_rows + 1:
                self.table.header_rows += not self.table.rows[-1]
        elif tag == "li":
            lists = [t for t in self.open if t in ("ul", "ol")]
            self._begin("list_item", level=len(lists), ordered=lists[-1:] == ["ol"])
        elif tag in OPENS:
            self._begin(OPENS[tag], level=0)
        elif tag in PARTS:
            self._end()
        elif tag in MARKS and self.cell is None and not self.ref and "pre" not in self.open:
            self.now = self.now or _Block("para")
            self.now.parts.append(MARKS[tag])
            self.marks.append(MARKS[tag])

    def handle_endtag(self, tag: str) -> None:
        if tag not in self.open:
            return
        while self.open.pop() != tag:
            pass
        if self.ref and len(self.open) < self.ref[0]:
            self.ref = None
        if self.notes and len(self.open) < self.notes[-1][0]:
            self._end()
            while self.notes and len(self.open) < self.notes[-1][0]:
                self.notes.pop()
        if tag == "a" and self.link:
            self.links.append((self.link[0], _SPACE.sub(" ", "".join(self.link[1])).strip()))
            self.link = None
        if tag in MARKS and self.now and MARKS[tag] in self.marks:
            while self.marks:
                mark = self.marks.pop()
                self.now.parts.append(mark)
                if mark == MARKS[tag]:
                    break
        elif tag in ("td", "th") and self.cell is not None:
            self.table.rows[-1].append(_SPACE.sub(" ", "".join(self.cell)).strip())
            self.cell = None
        elif tag == "table" and self.table:
            self._end_table()
        elif tag in OPENS or tag in PARTS or tag == "pre" or re.fullmatch(r"h\d", tag):
            self._end()

    def _end_table(self) -> None:
        """A table within a cell is that cell's text; any other is a block."""
        rows = [r for r in self.table.rows if r]
        self.table.rows = rows
        done, self.table, self.cell = self.table, None, None
        if self.outer:
            self.table, self.cell = self.outer.pop()
            if self.cell is not None:
                self.cell.append(" " + " ".join(" ".join(r) for r in rows) + " ")
                return
        if rows:
            self.blocks.append(done)

    def handle_data(self, data: str) -> None:
        if self.ref:
            return
        if self.open[-1:] == ["title"] and "head" in self.open:
            self.title.append(data)
        if self._skipping():
            if self.link and "nav" in self.open:
                self.link[1].append(data)
            return
        if self.link:
            self.link[1].append(data)
        if self.cell is not None:
            self.cell.append(data)
        elif self.now:
            self.now.parts.append(data)
        elif data.strip():
            self.now = _Block("para", parts=[data])

    def _skipping(self) -> bool:
        return not SKIPPED.isdisjoint(self.open)

    def close(self) -> None:
        super().close()
        self._end()
        while self.table:
            if self.cell is not None and self.table.rows:
                self.table.rows[-1].append(_SPACE.sub(" ", "".join(self.cell)).strip())
            self._end_table()


class _Contents(HTMLParser):
    """The entries of a navigation document's table of contents."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.entries: list[tuple[int, str, str]] = []
        self.inside, self.depth = False, 0
        self.link: tuple[str, list[str]] | None = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = dict(attrs)
        if tag == "nav":
            self.inside = "toc" in (a.get("epub:type") or "")
        elif tag == "ol" and self.inside:
            self.depth += 1
        elif tag == "a" and self.inside:
            self.link = (a.get("href") or "", [])

    def handle_endtag(self, tag: str) -> None:
        if tag == "nav":
            self.inside = False
        elif tag == "ol" and self.inside:
            self.depth -= 1
        elif tag == "a" and self.link:
            self.entries.append((max(1, self.depth), "".join(self.link[1]).strip(), self.link[0]))
            self.link = None

    def handle_data(self, data: str) -> None:
        if self.link:
            self.link[1].append(data)


def contents(markup: str) -> list[tuple[int, str, str]]:
    """``depth, title, href`` of each entry of an EPUB's navigation document."""
    out = _Contents()
    out.feed(markup)
    out.close()
    return out.entries


def style_map(css: str) -> dict[str, tuple[float | None, bool | None]]:
    """Size in points and boldness that a style sheet gives each class; a broken rule gives none."""
    scale = {"": 1.0, "pt": 1.0, "px": 0.75, "em": 12.0, "rem": 12.0, "%": 0.12}
    out: dict[str, tuple[float | None, bool | None]] = {}
    for selectors, body in re.findall(r"([^{}]+)\{([^}]*)\}", css):
        size = re.search(r"font-size\s*:\s*(\d*\.?\d+)\s*(pt|px|rem|em|%)?(?![\d.])", body)
        weight = re.search(r"font-weight\s*:\s*(bold|[4-9]00|normal)", body)
        for name in re.findall(r"\.([A-Za-z0-9_\-]+)", selectors):
            was = out.get(name, (None, None))
            out[name] = (float(size[1]) * scale[size[2] or ""] if size else was[0], weight[1] not in ("normal", "400", "500") if weight else was[1])
    return out


def read(html: str | None) -> _Reader:
    out = _Reader()
    out.feed(html or "")
    out.close()
    return out


def rows_of(blocks: list[_Block]) -> list[tuple]:
    return [(i, b.kind, b.parts[0] if b.parts else "", b.level, b.ordered, b.src, b.rows, b.header_rows) for i, b in enumerate(blocks)]


#: Bytes of text that a batch of results holds, about.
SLICE_BYTES = 1 << 20


def schema_of(key: str, kind: DataType, ddl: str) -> StructType:
    return StructType([StructField(key, kind), *StructType.fromDDL(ddl)])


def stepper(made: Callable[[str | None], Iterable[tuple]], schema: StructType, most: int = SLICE_BYTES) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of (key, page) to batches of the rows that ``made`` gives for a page.

    A few pages at a time are taken out of a batch, and rows go back as soon as
    they come to ``most`` bytes, so a worker's memory does not grow with the
    batch it reads.
    """
    types = [to_arrow_type(f.dataType) for f in schema]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], schema.names)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for read_ in batches:
            for i in range(0, read_.num_rows, 16):
                few = read_.slice(i, 16)
                for k, page in zip(few.column(0).to_pylist(), few.column(1).to_pylist(), strict=True):
                    own = [(k, *r) for r in made(page)]
                    rows += own
                    size += len(page or "") + 100 * len(own)
                    if rows and size > most:
                        yield batch(rows)
                        rows, size = [], 0
        if rows:
            yield batch(rows)

    return step


def blocks(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """One row for each block of each page, in order.  A null page has none."""
    schema = schema_of(key, pages.schema[key].dataType, BLOCKS)
    return pages.select(key, html).mapInArrow(stepper(lambda page: rows_of(read(page).blocks), schema), schema)


def links(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """``key, seq, href, text`` of every link, navigation included."""
    schema = schema_of(key, pages.schema[key].dataType, "seq int, href string, text string")
    return pages.select(key, html).mapInArrow(stepper(lambda page: [(i, *x) for i, x in enumerate(read(page).links)], schema), schema)


def titles(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """``key, title``: by pattern alone, inside Catalyst."""
    found = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    return pages.select(key, F.trim(F.regexp_replace(found, r"\s+", " ")).alias("title"))
