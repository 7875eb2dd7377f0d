"""Price pages as rows of cells, and the links to their sections."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspark.operators.extract import price_rows
from tallyspark.sources.references import decoded

# fixed values: elements that can be a row, that name a section, or that hold no text
ROWS = "tr li div p section article td th dd dl".split()
HEADINGS = "h1 h2 h3 h4 h5 h6".split()
HIDDEN = "script style noscript svg head".split()
MOST_CELLS = 8

_TAG = re.compile(r"</?([a-zA-Z][a-zA-Z0-9]*)")
_SPACE = re.compile(r"\s+")


def pieces_of(html: str) -> Iterator[tuple[str, str, str, str]]:
    """(slash, name, attributes, text): the tags and the texts between them, in one pass.

    A comment without end is text, and so is a ``<`` that begins no tag or is the start of one
    without end; what is not found once is not looked for again.
    """
    at, n, comments, tags = 0, len(html), True, True
    while at < n:
        if html[at] != "<":
            end = html.find("<", at)
            end = n if end < 0 else end
            yield "", "", "", html[at:end]
        else:
            end = 0
            if comments and html.startswith("<!--", at):
                end = html.find("-->", at + 4) + 3
                comments = end > 2
                end = end if comments else 0
            elif tags and (m := _TAG.match(html, at)):
                end = html.find(">", m.end()) + 1
                tags = end > 0
                if tags:
                    yield html[at + 1 : m.start(1)], m[1], html[m.end() : end - 1], ""
            if not end:
                end = at + 1
                yield "", "", "", "<"
        at = end


def cells_of(html: str) -> list[tuple[list[str], str]]:
    """(cells, category) of each block that holds one to eight pieces of text.

    A closing tag ends a piece; a block inside another is one piece of the outer; the last
    heading is the category. A block that is never closed is no row.
    """
    rows, opened, piece, heading = [], [], [], None
    category, hidden = "", 0

    def end_piece():
        text = _SPACE.sub(" ", decoded(" ".join(piece))).strip()
        piece.clear()
        if text and opened:
            opened[-1].append(text)

    for slash, name, attrs, text in pieces_of(unicodedata.normalize("NFC", html or "")):
        if text:
            if not hidden:
                (piece if heading is None else heading).append(text)
            continue
        name = name.lower()
        if name in HIDDEN:
            hidden = max(0, hidden - 1) if slash else hidden + 1
        elif hidden or not name:
            continue
        elif name in HEADINGS:
            if slash:
                title = _SPACE.sub(" ", decoded(" ".join(heading or ()))).strip()
                category, heading = title or category, None
                piece.clear()
            else:
                end_piece()
                heading = []
        elif name == "br":
            piece.append(" ")
            if slash or attrs.endswith("/"):
                end_piece()
        elif not slash:
            if name in ROWS:
                end_piece()
                opened.append([])
            if attrs.endswith("/"):
                end_piece()
        else:
            end_piece()
            if name in ROWS and opened:
                cells = opened.pop()
                if 1 <= len(cells) <= MOST_CELLS:
                    rows.append((cells, category))
                if cells and opened:
                    opened[-1].append(_SPACE.sub(" ", " ".join(cells)).strip())
    return rows


def page_rows(pages: DataFrame) -> DataFrame:
    """page_id, row_no, cells, category. The one step in Python: Spark has no HTML reader."""

    def run(batches):
        for pdf in batches:
            out = [(i, n, cells, c) for i, html in zip(pdf["page_id"], pdf["html"], strict=True) for n, (cells, c) in enumerate(cells_of(html))]
            yield pd.DataFrame(out, columns=["page_id", "row_no", "cells", "category"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, row_no int, cells array<string>, category string")


def site_prices(pages: DataFrame) -> DataFrame:
    """Rows of prices of all pages of a site, in order. pages: page_id, site, page_ord, url, html.

    Pages other than a site's first one count only if they have a row.
    """
    rows = price_rows(page_rows(pages))
    return rows.select("page_id", "row_no", "name", "unit", "price", "category").join(pages.select("page_id", "site", "page_ord", "url"), "page_id")


def site_page_counts(pages: DataFrame, rows: DataFrame) -> DataFrame:
    """site, pages, rows: the pages that a site's list is made of: its first one, and others that
    have a row. rows: those of site_prices."""
    firsts = pages.groupBy("site").agg(F.min("page_ord").alias("page_ord"))
    counted = rows.groupBy("site", "page_ord").agg(F.count("*").alias("rows"))
    return firsts.join(counted, ["site", "page_ord"], "full").groupBy("site").agg(F.count("*").alias("pages"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"))


def section_links(pages: DataFrame, most: int = 19) -> DataFrame:
    """page_id, ord, link: pages of the same host below the page's own path, first ones first."""
    href = r"""(?i)<a\s[^>]*?href\s*=\s*["']?([^"'\s>]+)"""
    links = pages.select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit(href), F.lit(1))).alias("ord", "href"))
    href = F.regexp_replace("href", "#.*$", "")
    root = F.regexp_extract("url", r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_extract("url", r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^?#]*/)", 1)
    absolute = (
        F.when(href == "", F.regexp_replace("url", "#.*$", "")).when(href.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract("url", "^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1), href)).when(href.startswith("/"), F.concat(root, href))
        .otherwise(F.concat(F.when(F.length(folder) > F.length(root) + 1, folder).otherwise(F.concat(root, F.lit("/"))), href))
    )
    links = links.withColumn("link", absolute)
    host = lambda c: F.regexp_extract(c, r"^[^:]+://([^/?#]*)", 1)
    path = lambda c: F.regexp_extract(c, r"^[^:]+://[^/?#]*([^?#]*)", 1)
    base = F.rtrim(path(F.col("url")), F.lit("/"))
    below = (base != "") & F.contains(path(F.col("link")), base) & (F.rtrim(path(F.col("link")), F.lit("/")) != base)
    kept = links.where((host(F.col("link")) == host(F.col("url"))) & (F.col("link") != F.col("url")) & below)
    first = kept.groupBy("page_id", "link").agg(F.min("ord").alias("ord"))
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy("ord"))
    return first.withColumn("ord", rank).where(F.col("ord") <= most).select("page_id", "ord", "link")
