from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st

from tallyspark.llm import url_filter as U

RULES = [*U.RULES, ("block", "org", "/a"), ("allow", "org", "/a"), ("block", "x.org", ""), ("allow", "Deep.X.org", "/a/b"), ("block", None, "/"), ("block", "", "/")]


def brute(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        ends = [rest.find(c) for c in "/?#" if c in rest]
        host = rest[: min(ends, default=len(rest))]
        rest = rest[len(host) :]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h) + len(p), h.count("."), a, h.lower() + p) for a, h, p in rules if h and (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else "allow"


URLS = ["http://a.com/", "http://com", "HTTPS://WWW.Example.com/en/x?y", "example.com/en/", "http://example.com/en/", "x://net/es/", "x://b.net/fr/q#f", "x://bnet/fr/", "a://b://c.com/", "x://org/ab", "x://deep.x.org/a/bc", "x://x.org", "http://com?x/", "://", "", None, "http://É.com/ü/\n/x", "http:///com/", "http://a.com:80/"]


def test_against_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "r", "v") for i, u in enumerate([*URLS, *URLS])] + [(None, URLS[0], "r", "v")], "page_id long, url string, rule string, host string")
    for rules in (RULES, U.RULES):
        got = U.judge(pages, rules).collect()
        assert sorted(map(tuple, got), key=repr) == sorted(((r.page_id, *brute(r.url, rules)) for r in pages.collect()), key=repr)


def test_generated_urls(spark):
    parts = st.sampled_from(["com", "net", "example", "www", "org", "x", "deep", "en", "es", "fr", "a", "b", "/", "/", ".", ".", "?", "#", "://"])
    found = []

    @settings(max_examples=300, deadline=None)
    @given(st.lists(parts, max_size=12))
    def collect(xs):
        found.append("http://" + "".join(xs))

    collect()
    pages = spark.createDataFrame(list(enumerate(found)), "page_id long, url string")
    got = {r.page_id: tuple(r)[1:] for r in U.judge(pages, RULES).collect()}
    assert got == {i: brute(u, RULES) for i, u in enumerate(found)}


def test_many_rules(spark):
    """Thousands of lengths and labels of rules: the plan and a url's expressions stay small."""
    rules = [("block", f"h{k % 50}.example.org", "/" + "x" * k) for k in range(3000)] + [("allow", "example.org", "/x" * k) for k in range(400)] + [("block", ".".join("a" * 60), "/")]
    frame = spark.createDataFrame(rules, "action string, host string, path string")
    urls = [f"http://{h}/{'x' * n}{t}" for h in ("h7.example.org", "www.h7.example.org", "h49.example.org", "example.org", "a." * 80 + "a") for n in (0, 1, 57, 107, 2999) for t in ("", "/x/x?q")]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    judged = U.judge(pages, frame)
    assert {r.page_id: tuple(r)[1:] for r in judged.collect()} == {i: brute(u, rules) for i, u in enumerate(urls)}
    assert len(judged._jdf.queryExecution().toString()) < 100_000


def test_empty(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert U.judge(pages.limit(0)).collect() == []
    none = spark.createDataFrame([], "action string, host string, path string")
    assert U.judge(pages, none, default="block").collect()[0].verdict == "block"
