"""Ranked search: against a plain scorer, and that blocks stay packed."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np

from tallyspark.llm import ranked_search as R

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def by_hand(docs, items):
    """item number -> [(doc_id, score)] of the 20 best."""
    bags = [(d, Counter(terms(t))) for d, t in docs]
    big_n, big_l = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = {}
    for i, (_, text) in enumerate(items):
        found = []
        for d, b in bags:
            n, score = sum(b.values()), 0
            for t, k in Counter(terms(text)).items():
                if t in b:
                    w = math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1)))
                    score += k * w * (10**9 * b[t] // (1000 * b[t] + 12 * (75 + 25 * n * big_n // big_l)))
            if score > 0:
                found.append((d, score))
        out[i] = sorted(found, key=lambda x: (-x[1], x[0] is None, x[0] or 0))[:20]
    return out


def inverted(docs, shard):
    names = R._Numbers()
    made = R.invert([(d, R.numbered_terms(R.terms_of(t), names)) for d, t in docs], names, shard)
    return [r for b in made for r in b.to_pandas().itertuples(index=False)]


def corpus(rng, n):
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(4000)] + ["Été", "ABC", "naïve", "日本", "a_b"]
    return [(i, " ".join(rng.choices(words, k=rng.choice([1, 5, 30, 200])))) for i in range(n)]


def test_against_plain_scores(spark, monkeypatch):
    rng = random.Random(1)
    docs = corpus(rng, 700) + [(700, None), (701, ""), (702, "..."), (None, "w1 w2"), (5, "w1 w3 w3"), (5, "w1 w3 w3"), (703, "w7 " * 400), (704, "x1 " * 70_000)]
    docs += [(800 + i, "tie w2 tie") for i in range(40)]
    items = [(i, rng.choice(docs)[1]) for i in range(25)] + [(30, "tie"), (30, "TIE w2"), (31, None), (32, "nowhere"), (None, "w3 abc Été"), (33, "x1 w7")]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, rank string").repartition(3)
    asked = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, score string").coalesce(1)
    monkeypatch.setattr(R, "ITEM_BLOCK", 8)
    index = R.build_index(df)
    got = R.search(index, asked).collect()
    want = sorted((items[i][0] if items[i][0] is not None else -1, k, d if d is not None else -1, s) for i, found in by_hand(docs, items).items() for k, (d, s) in enumerate(found, 1))
    assert sorted((r.item_id if r.item_id is not None else -1, r.rank, r.doc_id if r.doc_id is not None else -1, r.score) for r in got) == want
    assert R.search(index, asked.limit(0)).count() == 0 and R.ranked(df.limit(0), asked).count() == 0


def test_shards_and_spans(monkeypatch):
    """Any cut into shards and spans gives the same best; with a high threshold most blocks stay packed."""
    rng = random.Random(2)
    docs = corpus(rng, 6000)
    items = [(0, "w1 w2 w3 w9 w40 w41 日本 日本 日本 日本 Été Été"), (1, docs[17][1]), (2, "w1 w1 w1")]
    want = by_hand(docs, items)
    n_terms, big_n = sum(len(terms(t)) for _, t in docs), sum(bool(terms(t)) for _, t in docs)
    df = Counter(t for _, x in docs for t in set(terms(x)))
    for cut, span in ((6000, 512), (6000, 6000), (1000, 300)):
        best, packed, blocks = {i: [] for i in range(3)}, 0, 0
        for a in range(0, 6000, cut):
            rows = inverted(docs[a : a + cut], a)
            head, by_term = rows[0], {r.term: r for r in rows[1:]}
            norms = R.norm(np.frombuffer(head.lasts, "<i8"), big_n, n_terms)
            for i, (_, text) in enumerate(items):
                lists = [(k * math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))), R.PostingList(by_term[t], norms, big_n, n_terms)) for t, k in Counter(terms(text)).items() if t in by_term]
                d, s = R.best_of_shard(lists, len(norms), 20, span)
                best[i] += zip((d + a).tolist(), s.tolist(), strict=True)
                packed += sum(len(p.lasts) - len(p.unpacked) for _, p in lists)
                blocks += sum(len(p.lasts) for _, p in lists)
        assert {i: sorted(b, key=lambda x: (-x[1], x[0]))[:20] for i, b in best.items()} == want
        assert packed > 0 if span == 512 else True


def test_block_maxima_are_exact():
    rng = random.Random(4)
    docs = [(i, " ".join(rng.choices(["a", "b", "c"], [9, 1, 3], k=rng.randint(1, 900)))) for i in range(900)]
    rows = inverted(docs, 0)
    sizes = np.frombuffer(rows[0].lasts, "<i8")
    norms = R.norm(sizes, 900, int(sizes.sum()))
    for r in rows[1:]:
        p = R.PostingList(r, norms, 900, int(sizes.sum()))
        assert [int(p.block(k)[1].max()) for k in range(len(p.lasts))] == p.maxima.tolist()
        assert [int(p.block(k)[0][-1]) for k in range(len(p.lasts))] == p.lasts.tolist()
