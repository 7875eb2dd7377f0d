"""The page reader: against the pattern that says what a piece is, and on hostile pages."""

from __future__ import annotations

import html as stdlib
import random
import re
import time

import pytest

from tallyspark.sources import pages as P
from tallyspark.sources.references import decoded

PIECE = re.compile(r"<!--.*?-->|<(/?)([a-zA-Z][a-zA-Z0-9]*)([^>]*)>|([^<]+|<)", re.S)


def test_pieces_of_random_markup():
    rng = random.Random(7)
    parts = ["<", ">", "<!--", "-->", "<a", "</a>", "<div class='x'>", "</div>", "text", " ", "<td>", "</td>", "<!", "--", "&amp;", "<1", "</", "<br/>", "\n"]
    for _ in range(20_000):
        html = "".join(rng.choices(parts, k=rng.randint(0, 14)))
        assert [p for p in P.pieces_of(html)] == [p for p in PIECE.findall(html) if any(p)], html


@pytest.mark.parametrize("html", ["<a" * 100_000, "<!--" * 100_000, "<" * 200_000, "</a" * 100_000, "<p>&#" + "9" * 100_000 + ";</p>", "<p>&#x" + "f" * 100_000 + ";</p>", "<p>" + "&#" * 100_000, "<p>" + "<!-" * 100_000])
def test_hostile_pages_take_linear_time(html):
    began = time.process_time()
    P.cells_of(html)
    assert time.process_time() - began < 5  # quadratic readers take minutes


def test_references():
    for text in ("&amp;&lt;&#65;&#x42;&nbsp;&bogus;&#1114112;&#0;&#128;&#12345678;", "&#00000000065;b", "&#0000000000;", "&#65", "&#000000065 x", "a & b &# &#; &#x;"):
        assert decoded(text) == stdlib.unescape(text)
    assert decoded("x&#" + "9" * 5000 + ";y&#" + "0" * 5000 + "65z") == "x�yAz"


def test_rows_of_a_page_with_a_long_reference(spark):
    pages = [(1, "<table><tr><td>Фарбування стін</td><td>м2</td><td>120</td></tr></table>"), (2, "<p>&#" + "9" * 4400 + "; грн</p>"), (3, None), (4, "")]
    got = P.page_rows(spark.createDataFrame(pages, "page_id long, html string")).collect()
    assert {r.page_id for r in got} == {1, 2} and [r.cells for r in got if r.page_id == 2] == [["� грн"]]
