from __future__ import annotations

import html
import random
import re
import time
from html.parser import HTMLParser

from tallyspark.llm import html_text as H
from tallyspark.llm.markup import ARTICLE, FURNITURE, MAIN, OTHER, blocks_of


class Plain(HTMLParser):
    """The text of <article>, white space made single; a second reading of the same pages."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.text = 0, []

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        self.text += [" "] * (self.inside and tag in ("p", "br", "h1"))

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        self.text += [" "] * (self.inside and tag in ("p", "h1"))

    def handle_data(self, data):
        if self.inside:
            self.text.append(data)


def test_table(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: r for r in H.main_text(pages).collect()}
    for r in pages.collect():
        p = Plain()
        p.feed(r.html)
        want = " ".join("".join(p.text).split())
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (want, len(want), r.url)
    assert len(got) == pages.count()


def test_parts():
    page = """<html><head><title>t</title><style>x</style></head><body class="has-sidebar"><header><h1>Site</h1></header>
    <nav role=navigation><ul><li>Menu</ul></nav><div id="cookie-notice">We use cookies</div><form>Search <input></form>
    <article class="post menu-open"><header><h1>Ti&amp;tle</h1></header><p>One <b>bo</b>ld&nbsp;word<br>next<p>Two &lt;x&gt; </p><div class="ad"><p>Buy</p></div>
    <script>var t="</p>";</script><!-- hidden --><aside>Side</aside><ul><li>a<li>b</ul><span class="share">Share</span>after
    <section id="comments"><article><p>Nice!</p></article></section><footer>by me</footer></article><p>Free text</p><footer>foot</footer>"""
    blocks = blocks_of(page)
    text = lambda k: " | ".join(t for p, t in blocks if p == k)
    assert text(ARTICLE) == "Ti&tle | One bold word | next | Two <x> | a | b | after"
    assert text(OTHER) == "Free text" and text(MAIN) == ""
    assert text(FURNITURE) == "Site | Menu | We use cookies | Search | Buy | Side | Share | Nice! | by me | foot"
    assert blocks_of("<main><p>x</main>y") == [(MAIN, "x"), (OTHER, "y")]
    for odd in (None, "", "<", "<p", "a < b", "<!-- open", "<script>open", "</p></div>x", "<p class='a>x", "plain"):
        blocks_of(odd)
    assert blocks_of("a < b &amp c") == [(OTHER, "a < b & c")]


def test_attributes_and_wrappers():
    parts = lambda page: {k: " | ".join(t for p, t in blocks_of(page) if p == k) for k in (ARTICLE, MAIN, OTHER, FURNITURE)}
    story = "<article><p>The story</p></article>"
    # Words in values of other attributes and words of longer names are no labels.
    for inside in ('<p><a href="/hidden/path">x</a>', '<p title="A hidden gem">x', '<p data-story-id="social-12">x', '<p data-class="ad">x', '<p class="story-with-share">x', "<p id=tag-social>x"):
        assert parts(f"<article>{inside}</article>")[ARTICLE] == "x", inside
    for inside in ("<p hidden>x", "<p class='big ad'>x", "<p id=cookie-notice>x", '<div class="ad-wrapper"><p>x</div>', '<div CLASS="site-footer">x</div>', '<p aria-hidden="true">x', "<span class=share>x</span>"):
        assert parts(f"<article>y{inside}</article>") == {ARTICLE: "y", MAIN: "", OTHER: "", FURNITURE: "x"}, inside
    for wrapper in ('div class="layout has-sidebar"', 'div id="page-with-menu"', 'div class="sidebar-wrapper"', 'form id="aspnetForm"', 'div class="overlay"', "header"):
        assert parts(f"<{wrapper}><nav>Home</nav>{story}</{wrapper.split()[0]}>")[ARTICLE] == "The story", wrapper
        assert parts(f"<{wrapper}><main>The story</main></{wrapper.split()[0]}>")[MAIN] == "The story", wrapper
    for under in ("aside", "nav", "footer", 'section id="comments"', 'div class="related-posts"', "div hidden", 'form class="comment-form"', "form><aside"):
        assert parts(f"<{under}>{story}") == {ARTICLE: "", MAIN: "", OTHER: "", FURNITURE: "The story"}, under
    # What ends with the article, and a form that holds most of a page or little of it.
    assert parts(f"<form>Find {story} <i class=ad>Buy</i> it</form> free text") == {ARTICLE: "The story", MAIN: "", OTHER: "free text", FURNITURE: "Find | Buy | it"}
    assert parts("<form><nav>Home</nav><p>all of the page</p><div class=ad>Buy</div></form>rest") == {ARTICLE: "", MAIN: "", OTHER: "all of the page | rest", FURNITURE: "Home | Buy"}
    assert parts("<article><form><p>all of the story</form></article>")[ARTICLE] == "all of the story"
    assert parts("<form>Find</form><p>the page itself") == {ARTICLE: "", MAIN: "", OTHER: "the page itself", FURNITURE: "Find"}


def brute(rows):
    """(host, blocks of unmarked text) per page -> text without runs seen on another page of the host."""
    windows = {}
    pad = lambda t: t.split() + [""] * (H.RUN - len(t.split()))
    for k, (host, blocks) in enumerate(rows):
        for t in blocks:
            w = pad(t)
            for i in range(len(w) - H.RUN + 1):
                windows.setdefault((host, tuple(w[i : i + H.RUN])), set()).add(k)
    out = []
    for host, blocks in rows:
        left = []
        for t in blocks:
            w, own = pad(t), t.split()
            gone = {j for i in range(len(w) - H.RUN + 1) if len(windows[host, tuple(w[i : i + H.RUN])]) > 1 for j in range(i, i + H.RUN)}
            left += [x for i, x in enumerate(own) if i not in gone]
        out.append(" ".join(left))
    return out


def test_runs_against_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    shared = ["read our weekly letter for all the news of the town every friday", "Home", "short line", " ".join(f"w{i}" for i in range(40))]
    rows = []
    for k in range(90):
        own = [f"v{rng.randrange(400)}" for _ in range(rng.randrange(30))]
        cut = rng.randrange(len(own) + 1)
        blocks = [" ".join(own[:cut] + (rng.choice(shared).split() if rng.random() < 0.6 else []) + own[cut:]), rng.choice(shared), f"only here {k}"]
        rows.append(("hot.example" if k % 3 else f"h{k % 9}.example", [b for b in blocks if b]))
    pages = spark.createDataFrame([(k, f"http://{h}/p{k}", "".join(f"<p>{b}</p>" for b in blocks), "x", 1) for k, (h, blocks) in enumerate(rows)], "page_id long, url string, html string, text string, _row int")
    for size in (512, 7):
        monkeypatch.setattr(H, "BLOCK_PAGES", size)
        got = {r.page_id: r.text for r in H.main_text(pages).collect()}
        assert [got[k] for k in range(len(rows))] == brute(rows)


def test_odd_rows(spark):
    pages = spark.createDataFrame([(1, None, None), (2, "x", ""), (None, None, "<p>alone</p>"), (3, "http://a/", "<article></article><p>x</p>"), (4, "http://a/", "<p>twice</p>"), (4, "http://a/", "<p>twice</p>"), (5, "http://b/", "<p>two</p>"), (6, "http://b/", "<p>two</p>")], "page_id long, url string, html string")
    got = sorted(((r.page_id, r.text, r.n_chars) for r in H.main_text(pages).collect()), key=repr)
    assert got == sorted([(1, "", 0), (2, "", 0), (None, "alone", 5), (3, "x", 1), (4, "twice", 5), (4, "twice", 5), (5, "", 0), (6, "", 0)], key=repr)
    assert H.main_text(pages.limit(0)).collect() == []
    long = spark.createDataFrame([(1, "http://a/", f"<article>a &#{'9' * 4400}; &#{'0' * 4400}66; b</article>"), (2, "http://a/", "<article>sound</article>")], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in H.main_text(long).collect()} == {1: "a \ufffd B b", 2: "sound"}


def test_open_text_beside_articles(spark):
    teaser, menu = "<article>A teaser card</article>", "<p>all the news of our town and of the sea every day</p>"
    rows = [
        (1, "http://a/1", f"<main><h1>Body of one</h1><p>that is longer than the card</p></main>{teaser}{menu}"),
        (2, "http://a/2", f"{menu}{teaser}<div>only plain text of the second page</div>"),
        (3, "http://a/3", f"<main>{menu}<article>the third page is an article with many words in it</article>By me</main>"),
        (4, "http://a/4", "<div>left open</div><main>of main alone</main>"),
        (5, "http://a/5", "<main>of main alone</main>"),
    ]
    got = {r.page_id: r.text for r in H.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {
        1: "Body of one that is longer than the card A teaser card",
        2: "A teaser card only plain text of the second page",
        3: "the third page is an article with many words in it By me",
        4: "left open of main alone",
        5: "of main alone",
    }


def test_hostile_pages():
    """Pages that make a backtracking reader slow are read in time that grows with their length."""
    pages = [
        "<a" * 100_000, '<p "' * 100_000, '<p ="' * 100_001 + ">", "<div>" * 200_000, "<div><b>" * 60_000 + "</i></p>" * 60_000, "</x>" * 200_000, "<!--" * 200_000, "<script>" * 100_000,
        "<a href=" * 100_000, '<p a="x" ' * 60_000, "<p a='" * 99_999 + ">", "<" * 300_000, "<p " + "a " * 300_000 + ">", '<p class="' + "ad-x " * 100_000 + '">x',
        "&#" + "9" * 200_000 + ";", "&#" * 200_000, "&#x" + "f" * 200_000,
    ]
    for page in pages:
        began = time.process_time()
        blocks_of(page)
        assert time.process_time() - began < 20, page[:20]  # quadratic readers take minutes
    assert blocks_of('<p title="a > b">one</p><p title="open>two</p>three') == [(OTHER, "one"), (OTHER, "two"), (OTHER, "three")]
    assert blocks_of("x<svg><p>no</p></svg>y<textarea>no</textarea><SCRIPT>a</scripty></script >z") == [(OTHER, "xyz")]


def test_array_and_markup_share_the_work(spark):
    """Furniture on several pages of a host goes by the array, what else is furniture by markup."""
    menu, story = "<nav><a>Home</a> <a>News</a></nav>", "<article>a story that is told on both pages of the host in these words</article>"
    rows = [(1, "http://a/1", f"{menu}{story}<aside>only here</aside>"), (2, "http://a/2", f"{menu}{story}open once <footer>seen on b too</footer>"), (3, "http://b/1", "<footer>seen on b too</footer>")]
    got = {r.page_id: (r.text, r.n_repeated, r.n_marked) for r in H.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    text = "a story that is told on both pages of the host in these words"
    assert got == {1: (text, 2, 2), 2: (f"{text} open once", 2, 4), 3: ("", 0, 4)}
