"""HTML pages -> text, titles, links and tables; one small parser inside Arrow batches."""

from __future__ import annotations

import re
from html import unescape
from html.parser import HTMLParser
from urllib.parse import urljoin

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import app_url, id_from_url, strip, url_part

PARSED = "title string, text string, focus string, links array<string>, tables array<array<array<string>>>"
OUT = pa.schema([("title", pa.string()), ("text", pa.string()), ("focus", pa.string()), ("links", pa.list_(pa.string())), ("tables", pa.list_(pa.list_(pa.list_(pa.string()))))])
PIECE = 1 << 20  #: bytes of pages that are parsed to objects at a time
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Page(HTMLParser):
    """Text nodes of the body and of chosen ids, title, h1, hrefs, and tables of cells."""

    def __init__(self, ids: tuple[str, ...]):
        super().__init__(convert_charrefs=True)
        self.ids = ids
        self.open: list[tuple[str, str]] = []
        self.title, self.h1, self.links, self.tables = "", "", [], []
        self.body: list[str] = []
        self.focus: dict[str, list[str]] = {}
        self.stack: list[list[list[str]]] = []
        self.cell: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if tag not in VOID:
            self.open.append((tag, attrs.get("id") or ""))
        if tag == "a" and attrs.get("href"):
            self.links.append(attrs["href"])
        elif tag == "table":
            self.stack.append([])
        elif tag == "tr" and self.stack:
            self._end_cell()
            self.stack[-1].append([])
        elif tag in ("td", "th") and self.stack:
            self._end_cell()
            self.cell = []

    def _end_cell(self):
        if self.cell is not None and self.stack:
            if not self.stack[-1]:
                self.stack[-1].append([])
            self.stack[-1][-1].append(re.sub(r"\s+", " ", "".join(self.cell).replace("\xa0", " ")).strip())
        self.cell = None

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr"):
            self._end_cell()
        elif tag == "table" and self.stack:
            self._end_cell()
            rows = [r for r in self.stack.pop() if any(r)]
            if rows:
                self.tables.append(rows)
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                break

    def handle_data(self, data):
        tags = {t for t, _ in self.open}
        text = data.strip()
        if "title" in tags:
            self.title = self.title or text
        elif text and not tags & {"script", "style"}:
            if "h1" in tags:
                self.h1 = self.h1 or text
            if "head" not in tags:
                self.body.append(text)
            for _, ident in self.open:
                if ident in self.ids:
                    self.focus.setdefault(ident, []).append(text)
        if self.cell is not None and not tags & {"script", "style"}:
            self.cell.append(data)


def parse_pages(pages: DataFrame, focus: tuple[str, ...] = ("detail_info", "content-body"), least: int = 80) -> DataFrame:
    """``pages(url, html, ...)`` with title, text, focused text (of the first id with ``least``
    characters, else the whole text), distinct absolute links in order, and tables."""

    kept = [c for c in pages.columns if c != "html"]
    kinds = dict(pages.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), PARSED])

    def parsed(html, url):
        p = _Page(focus)
        p.feed(html or "")
        p.close()
        text = "\n".join(p.body)
        found = ("\n".join(p.focus.get(i, [])) for i in focus)
        part = next((t for t in found if len(t) >= least), text)
        absolute = [a for a in (absolute_url(x, url or "") for x in p.links) if a]
        return {"title": p.title or p.h1, "text": text, "focus": part, "links": list(dict.fromkeys(absolute)), "tables": p.tables}

    def parse(batches):
        for batch in batches:
            sizes = pc.binary_length(batch.column("html")).fill_null(0)
            # Cut where the characters of the pages add up, so that only a small part of a batch is ever held as objects.
            piece = np.cumsum(sizes.to_numpy(zero_copy_only=False), dtype=np.int64) // PIECE
            cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1), len(batch)] if len(batch) else [0]
            for start, end in zip(cuts, cuts[1:]):
                some = batch.slice(start, end - start)
                rows = [parsed(h, u) for h, u in zip(some.column("html").to_pylist(), some.column("url").to_pylist(), strict=True)]
                found = pa.RecordBatch.from_pylist(rows, OUT)
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in kept), *found.columns], [*kept, *OUT.names])

    return pages.mapInArrow(parse, schema)


def absolute_url(href: str | None, base: str) -> str | None:
    href = (href or "").strip()
    if not href:
        return None
    if href.startswith(("http://", "https://")):
        return href
    return "https:" + href if href.startswith("//") else urljoin(base, href)


def page_links(parsed: DataFrame, site: str | None = None) -> DataFrame:
    """One row per link with its class: pdf, download, news, section (of ``site``) or other."""
    links = parsed.select("url", F.explode("links").alias("link"))
    path = F.lower(url_part(F.col("link"), 3))
    host = F.lower(url_part(F.col("link"), 2))
    inside = host.contains(site) if site else host == F.lower(url_part(F.col("url"), 2))
    kind = (
        F.when(path.endswith(".pdf"), "pdf")
        .when(path.contains("/download") | F.lower("link").contains("download="), "download")
        .when(path.contains("/news") & inside, "news")
        .when(inside & (path != "") & (path != "/"), "section")
        .otherwise("other")
    )
    return links.withColumn("kind", kind)


def is_error_page(title: Column, text: Column) -> Column:
    missing = r"(?i)\b404\b|not found"
    return F.coalesce(title, F.lit("")).rlike(missing) | F.coalesce(F.substring(text, 1, 800), F.lit("")).rlike(missing)


def page_records(parsed: DataFrame, source: str = "pages", least: int = 80, host: str | None = None) -> DataFrame:
    """Corpus records of pages with enough text, ids from the URL. Listing pages of ``host`` count as the
    application they wrap (``app_url``); ``original_url`` is the page's own URL where it differs."""
    text = strip(F.regexp_replace("focus", "\n{3,}", "\n\n"))
    rows = parsed.withColumn("text", text).filter(F.length("text") >= least)
    url = app_url(F.col("url"), host) if host else F.col("url")
    rows = rows.withColumns({"url": url, "original_url": F.when(url != F.col("url"), F.col("url"))})
    return rows.select(F.lit(source).alias("source"), id_from_url(F.col("url")).alias("doc_id"), "text", "url", "title", "original_url")


def table_rows(parsed: DataFrame, width: int) -> DataFrame:
    """One row per table row, cells as col_0 ... col_{width-1}: short rows padded, long ones cut."""
    t = parsed.select("url", "title", F.posexplode("tables").alias("table_index", "t"))
    r = t.select("url", "title", "table_index", F.posexplode("t").alias("row_index", "cells"))
    return r.select("url", "title", "table_index", "row_index", *(F.coalesce(F.get("cells", F.lit(i)), F.lit("")).alias(f"col_{i}") for i in range(width)))


def _plain(c: Column) -> Column:
    @F.pandas_udf("string")
    def entities(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else re.sub(r"\s+", " ", unescape(x)).strip())

    return entities(c)


def yield_rows(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Municipality and value of each ``<th scope="row">name</th><td>number``."""
    # The row pattern of the yield pages.
    pattern = r'(?is)<th\s+scope="row"[^>]*>([^<]+)</th>\s*<td[^>]*>\s*([\d.]+)'
    names, values = (F.regexp_extract_all(html_col, F.lit(pattern), F.lit(i)) for i in (1, 2))
    rows = pages.select(*(c for c in pages.columns if c != html_col), F.explode(F.arrays_zip(names.alias("n"), values.alias("v"))).alias("x"))
    keep = [c for c in pages.columns if c != html_col]
    return rows.select(*keep, _plain(F.col("x.n")).alias("municipality"), F.coalesce(F.col("x.v").try_cast("double"), F.lit(0.0)).alias("value"))


def provinces(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Number and name of each ``id="prov-N" value="..."`` before the first script."""
    head = F.split_part(html_col, F.lit("<script>"), F.lit(1))
    # The attributes of the province list.
    ids, names = (F.regexp_extract_all(head, F.lit(r'id="prov-(\d+)"[^>]*value="([^"]*)"'), F.lit(i)) for i in (1, 2))
    rows = pages.select(F.explode(F.arrays_zip(ids.alias("i"), names.alias("n"))).alias("x"))
    return rows.select(F.col("x.i").cast("int").alias("province_id"), F.trim("x.n").alias("province"))
