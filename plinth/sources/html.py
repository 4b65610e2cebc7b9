"""HTML pages as rows: a tolerant parser for links and listing rows, run inside Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html import parser, unescape
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Classes of listing rows, the first that a page has being its listing; then the rows of the first such table: fixed values.
ROW_CLASSES, TABLE_CLASS = ("catAgendaRow", "MeetingRow"), "listtable"
FALLBACK = "fallback"


class _Page(HTMLParser):
    """Collects links (href, text, label, the rows around) and elements that may be rows (tag, classes, text, date cell)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.links: list[dict] = []
        self.rows: list[dict] = []
        self.open: list[tuple[str, dict | None, dict | None]] = []  # tag, the row that it opens, the date cell's row
        self.link: dict | None = None
        self.table: int | None = None  # how deep the first listing table stands; -1 once it has ended

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs} if attrs else {}
        classes = a["class"].split() if "class" in a else []
        row = None
        if tag in ("tr", "div") or (classes and any(c in classes for c in ROW_CLASSES)):
            row = {"idx": len(self.rows), "tag": tag, "classes": classes, "listed": tag == "tr" and self.table not in (None, -1), "linked": False, "text": [], "date_cell": ""}
            self.rows.append(row)
        if tag == "table" and self.table is None and TABLE_CLASS in classes:
            self.table = len(self.open)
        cell = next((r for _, r, _ in reversed(self.open) if r), None) if tag == "td" and a.get("headers") == "Date" else None
        if tag == "a" and "href" in a:
            around = [r for _, r, _ in self.open if r]
            for r in around:
                r["linked"] = True
            self.link = {"idx": len(self.links), "href": a["href"], "label": a.get("aria-label", ""), "text": [], "rows": [r["idx"] for r in around]}
            self.links.append(self.link)
        if tag not in _VOID:
            self.open.append((tag, row, cell))

    def handle_endtag(self, tag):
        if tag == "a":
            self.link = None
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                break
        if self.table not in (None, -1) and len(self.open) <= self.table:
            self.table = -1

    def handle_data(self, data):
        data = data.strip()
        if not data:
            return
        if self.link is not None:
            self.link["text"].append(data)
        for _, row, cell in self.open:
            if row:
                row["text"].append(data)
            if cell:
                cell["date_cell"] += data

    def listing(self) -> tuple[str, list[dict]]:
        """The kind of the page's listing rows and the rows; fallback rows are all that hold a link."""
        for kind in ROW_CLASSES:
            if found := [r for r in self.rows if kind in r["classes"]]:
                return kind, found
        if found := [r for r in self.rows if r["listed"]]:
            return TABLE_CLASS, found
        return FALLBACK, [r for r in self.rows if r["tag"] in ("tr", "div") and r["linked"]]


#: Plain tags and text; a page with anything else goes to the tolerant parser, as do texts that only it reads raw.
_PLAIN = re.compile(r'<([a-zA-Z][a-zA-Z0-9]*)((?:[ \t\n]+[a-zA-Z][a-zA-Z0-9-]*="[^"<>]*")*)[ \t\n]*>|</([a-zA-Z][a-zA-Z0-9]*)[ \t\n]*>|([^<]+)')
_ATTRIBUTE = re.compile(r'([a-zA-Z][a-zA-Z0-9-]*)="([^"]*)"')
_RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "noscript", "plaintext", "xmp"}
_unescaped = getattr(parser, "_unescape_attribute", unescape)  # what the tolerant parser does with an attribute


def _scan(html: str) -> _Page | None:
    """A page of plain tags and text in one pass, by the same handlers; else null."""
    page, at = _Page(), 0
    for m in _PLAIN.finditer(html):
        if m.start() != at:
            return None
        at = m.end()
        start, attributes, end, text = m.groups()
        if text is not None:
            if "&" in text:
                if at == len(html):
                    return None
                text = unescape(text)
            page.handle_data(text)
        elif end is not None:
            page.handle_endtag(end.lower())
        else:
            tag = start.lower()
            if tag in _RAW:
                return None
            page.handle_starttag(tag, [(k.lower(), _unescaped(v) if "&" in v else v) for k, v in _ATTRIBUTE.findall(attributes)] if attributes else ())
    return page if at == len(html) else None


def _parse(html: str | None) -> _Page:
    page = _scan(html or "")
    if page is None:
        page = _Page()
        page.feed(html)
        page.close()
    return page


def _each_page(pages: DataFrame, found: Callable[[_Page], list[tuple]], columns: dict[str, str]) -> DataFrame:
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            yield pd.DataFrame([(k, *row) for k, h in zip(p["page_id"], p["html"], strict=True) for row in found(_parse(h))], columns=["page_id", *columns])

    return pages.where("page_id IS NOT NULL").select("page_id", "html").mapInPandas(work, "page_id long, " + ", ".join(f"{n} {t}" for n, t in columns.items()))


def anchors(pages: DataFrame) -> DataFrame:
    """(page_id, idx, href, text, label, rows) of all links in pages (page_id, html); ``rows`` are those around a link."""
    return _each_page(pages, lambda p: [(a["idx"], a["href"], "".join(a["text"]), a["label"], a["rows"]) for a in p.links], {"idx": "int", "href": "string", "text": "string", "label": "string", "rows": "array<int>"})


_ROW = {"row": "int", "kind": "string", "text": "string", "date_cell": "string"}


def listing_rows(pages: DataFrame) -> DataFrame:
    """(page_id, row, kind, text, date_cell) of the rows of each page's listing."""

    def found(p: _Page) -> list[tuple]:
        kind, rows = p.listing()
        return [(r["idx"], kind, " ".join(r["text"]), r["date_cell"]) for r in rows]

    return _each_page(pages, found, _ROW)


_COLUMNS = "row int, tag string, kind string, text string, date_cell string, links array<struct<idx:int,href:string,text:string,label:string>>"
_LINKS = T.ArrayType(T.StructType().add("idx", "integer").add("href", "string").add("text", "string").add("label", "string"))
_TYPE = T.ArrayType(T.StructType().add("row", "integer").add("tag", "string").add("kind", "string").add("text", "string").add("date_cell", "string").add("links", _LINKS))
_LINK = pa.struct([("idx", pa.int32()), ("href", pa.string()), ("text", pa.string()), ("label", pa.string())])
_ROWS = pa.list_(pa.struct([("row", pa.int32()), ("tag", pa.string()), ("kind", pa.string()), ("text", pa.string()), ("date_cell", pa.string()), ("links", pa.list_(_LINK))]))


def _rows(page: _Page) -> list[tuple]:
    kind, listed = page.listing()
    own = {r["idx"] for r in listed}
    links: dict[int, list[tuple]] = {}
    for a in page.links:
        link = (a["idx"], a["href"], "".join(a["text"]), a["label"])
        for row in a["rows"]:
            links.setdefault(row, []).append(link)
    return [(r["idx"], r["tag"], kind if r["idx"] in own else None, " ".join(r["text"]), r["date_cell"], links.get(r["idx"], [])) for r in page.rows]


@F.arrow_udf(_TYPE)
def rows_of(html: pa.Array) -> pa.Array:
    """Each page's rows, parsed once, each with the links in it.

    ``kind`` is that of the page's listing for the rows that belong to it, else null.
    """
    return pa.array([_rows(_parse(h)) for h in html.to_pylist()], _ROWS)


def page_rows(pages: DataFrame) -> DataFrame:
    """(page_id, url, row, tag, kind, text, date_cell, links) of pages (page_id, url, html)."""
    return pages.where("page_id IS NOT NULL").select("page_id", "url", F.inline(rows_of("html")))


def register(spark: SparkSession) -> None:
    """``page_rows(html)`` as a table function of the session's SQL: whole batches of pages go to Python, not one page a call."""
    spark.udf.register("page_rows_of", rows_of)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION page_rows(html STRING) RETURNS TABLE ({_COLUMNS}) RETURN SELECT * FROM inline(page_rows_of(html))")
