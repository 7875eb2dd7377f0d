from __future__ import annotations

import random
import tracemalloc

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyspark.llm import decontaminate as D


def brute_tiles(a, b, least):
    free_a, free_b, out = [True] * len(a), [True] * len(b), []
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and free_a[i + n] and free_b[j + n] and a[i + n] == b[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return out
        out.append((i, j, n))
        free_a[i : i + n] = [False] * n
        free_b[j : j + n] = [False] * n


def brute(docs, items, least=5, coverage=0.5):
    out = []
    for d, t in docs:
        for k, u in items:
            a, b = D.words_of(t), D.words_of(u)
            if b:
                found = brute_tiles(a, b, min(least, len(b)))
                if sum(n for *_, n in found) >= coverage * len(b):
                    out.append((d, k, round(sum(n for *_, n in found) / len(b), 9), sorted((i, j, n) for i, j, n in found)))
    return sorted(out, key=repr)


def rows(df):
    return sorted(((r.doc_id, r.item_id, round(r.coverage, 9), sorted(map(tuple, r.tiles))) for r in df.collect()), key=repr)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=40), st.lists(st.sampled_from("abcd"), max_size=40), st.integers(1, 5))
def test_tiles(a, b, least):
    assert D.tiles(a, b, least) == brute_tiles(a, b, least)


def test_tiles_of_repeated_words_and_phrases(monkeypatch):
    """Words, phrases and periods that repeat do not multiply, and the tiles are the same."""
    listed, pairs = D._matches, []

    def counted(*args):
        found = listed(*args)
        pairs.append(len(found or ()))
        return found

    monkeypatch.setattr(D, "_matches", counted)
    assert D.tiles(["w"] * 20_000, ["w"] * 400) == [(0, 0, 400)]
    assert [n for *_, n in D.tiles(["a", "b", "c"] * 20_000, (["a", "b", "c"] * 60 + ["x"]) * 3)] == [180] * 3
    assert sum(pairs) < 100_000
    for a, b in ((["w"] * 60, ["w"] * 23), (["a", "b"] * 30, ["b", "a", "b"] * 9), (["w"] * 30 + [None] + ["w"] * 8, ["w"] * 45), (["w"] * 9, ["w"] * 50 + ["v"])):
        assert D.tiles(a, b) == brute_tiles([object() if w is None else w for w in a], b, 5)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=50), st.lists(st.sampled_from("abcd"), max_size=50), st.integers(1, 5))
def test_tiles_by_turns(a, b, least):
    """The way for matches too many to list gives the same tiles."""
    listed = D._matches
    D._matches = lambda x, y, size, most: None
    try:
        assert D.tiles(a, b, least) == brute_tiles(a, b, least)
    finally:
        D._matches = listed


def test_phrases_that_repeat_on_both_sides(monkeypatch):
    """Work follows places, not pairs of places: 2,000,000 pairs here."""
    looked, longest = [], D._Level.longest
    monkeypatch.setattr(D._Level, "longest", lambda self, i, most: looked.append(i) or longest(self, i, most))
    phrase = "one two three four five".split()
    a = [x for k in range(10_000) for x in (f"a{k}", *phrase)]
    b = [x for k in range(200) for x in (f"b{k}", *phrase)]
    tracemalloc.start()
    found = D.tiles(a, b)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == [(1 + 6 * k, 1 + 6 * k, 5) for k in range(200)]
    assert len(looked) < 3 * 10_000 and most < 100e6


def test_items_of_many_words_take_linear_time():
    """A hundred thousand seeds of an item: each looks at its own words only."""
    n = 100_000
    makers = D.common_seeds(n, list(range(n - 4)), [1] * (n - 4), 0.5)
    assert n // 2 - 10 < len(makers) < n // 2 + 10


@given(st.lists(st.text(alphabet="abé", min_size=1, max_size=4), max_size=30))
def test_equal_windows_have_equal_hashes(words):
    h = D.seed_hashes(words)
    by = {}
    for i in range(len(h)):
        by.setdefault(tuple(words[i : i + 5]), set()).add(int(h[i]))
    assert all(len(x) == 1 for x in by.values()) and len(set(h.tolist())) == len(by)


def test_against_brute_force(spark):
    rng = random.Random(11)
    common = "please answer the following question in one short sentence now".split()
    items, docs = [], []
    for k in range(24):
        own = [f"w{rng.randrange(60)}" for _ in range(rng.randrange(3, 30))]
        items.append((k, " ".join(common * (k % 2) + own)))
    items += [(50, None), (51, ""), (52, "one two three four"), (54, "Two three?"), (55, "uno"), (53, items[1][1]), (53, items[1][1]), (None, items[3][1])]
    for d in range(60):
        text = [f"w{rng.randrange(60)}" for _ in range(rng.randrange(40))]
        for _ in range(rng.randrange(3)):
            w = items[rng.randrange(24)][1].split()
            cut = rng.randrange(len(w) + 1)
            text += rng.choice([w, w[cut:] + ["then"] + w[:cut], common, w[: len(w) // 2]]) + ["x"] * rng.randrange(2)
        docs.append((d, ", ".join(text).upper()))
    docs += [(90, None), (91, ""), (92, items[5][1]), (92, items[5][1]), (None, items[5][1]), (93, "one two three four"), (94, "one two. Three: w1 w2 w3 w4 four, uno"), (95, "one two four three")]
    got = D.contaminated(spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, item_id string"), spark.createDataFrame([(*r, "y") for r in items], "item_id long, text string, words string"))
    want = brute(docs, items)
    # Of equally long matches, tiles may lie elsewhere in a document; coverage must agree.
    assert [r[:3] for r in rows(got)] == [r[:3] for r in want] and len(want) > 30
    assert rows(got) == want
    stay = D.drop_contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    bad = {repr(r[0]) for r in want}
    assert sorted(repr(r.doc_id) for r in stay.collect()) == sorted(repr(d) for d, _ in docs if repr(d) not in bad)


def test_common_seeds_lose_nothing():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n = int(rng.integers(5, 40))
        frequency = rng.integers(1, 9, n - 4).tolist()
        makers = set(D.common_seeds(n, list(range(n - 4)), frequency, 0.5))
        covered = np.zeros(n, bool)
        for i in range(n - 4):
            if i not in makers:
                covered[i : i + 5] = True
        assert covered.sum() < 0.5 * n


def test_table_and_empty_inputs(spark, sf_dir):
    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    want, texts = set(), {r.item_id: D.words_of(r.text) for r in items.collect()}
    for r in docs.collect():
        w = " " + " ".join(D.words_of(r.text)) + " "
        want |= {(r.doc_id, k) for k, x in texts.items() if f" {' '.join(x)} " in w}
    got = {(r.doc_id, r.item_id) for r in D.contaminated(docs, items).collect()}
    assert want and got >= want
    assert D.contaminated(docs.limit(0), items).collect() == [] and D.contaminated(docs, items.limit(0)).collect() == []
