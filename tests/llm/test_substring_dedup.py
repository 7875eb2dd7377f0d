"""Substring dedup: against windows by hand, also with groups dealt by windows."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from tallyspark.llm import substring_dedup as S

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_hand(rows):
    texts = [(d, WORD.findall(t or "")) for d, t in rows]
    least = {}
    size = lambda d: (d is None, d or 0)
    for d, words in texts:
        for i in range(len(words) - 49):
            w = tuple(words[i : i + 50])
            least[w] = min(least.get(w, size(d)), size(d))
    out = []
    for d, words in texts:
        gone = set()
        for i in range(len(words) - 49):
            if least[tuple(words[i : i + 50])] < size(d):
                gone.update(range(i, i + 50))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((d if d is not None else -1, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def result(spark, rows):
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, key int").repartition(3)
    return sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_removed, r.kept_sha256) for r in S.digest(S.remove_repeats(df)).collect())


def corpus(rng, n=120):
    new = lambda k: [rng.choice("abcdefghij") + str(rng.randint(0, 400)) for _ in range(k)]
    passages = [new(rng.choice([49, 50, 51, 60, 90, 200])) for _ in range(12)]
    frame = new(12)  # a frequent phrase too short to matter, around which texts differ
    rows = []
    for i in range(n):
        words = new(rng.choice([0, 3, 30, 120]))
        for _ in range(rng.randint(0, 3)):
            words += rng.choice(passages) + new(rng.choice([0, 1, 40])) + frame
        if rng.random() < 0.3 and words:
            words[rng.randrange(len(words))] = "changed"
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(words)))
    rows += [(200 + i, rows[rng.randrange(n)][1]) for i in range(30)]  # copies
    same = new(150)
    for i in range(40):  # near copies, each with words of its own
        copy = same[:]
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(150)] = f"x{i}" if i % 2 else "y"
        rows.append((300 + i, " ".join(copy)))
    rows += [(None, rows[5][1]), (None, " ".join(same)), (1, rows[1][1]), (1, rows[1][1]), (2, rows[7][1]), (900, None), (901, ""), (902, "w " * 300), (903, "w " * 80), (904, "p q r " * 60), (905, "q r p " * 40)]
    ring = new(60)  # contexts that a document holds twice, and windows of them in smaller documents
    rows += [(990, " ".join(ring * 4)), (980, " ".join(["o"] + ring[5:58] + ["p"])), (985, " ".join(ring[40:] + ring[:31] + ["q"])), (990, " ".join(["r"] + ring * 4))]
    rows += [(-5, " ".join(same[20:120])), (950, "é ü " * 30 + " ".join(passages[0] + passages[0]))]
    return rows


@pytest.mark.parametrize("small", [200, 3])
def test_against_windows_by_hand(spark, monkeypatch, small):
    monkeypatch.setattr(S, "SMALL_GROUP", small)
    rows = corpus(random.Random(small))
    rng = random.Random(9)
    rng.shuffle(rows)
    got = result(spark, rows)
    assert got == by_hand(rows) and sum(r[2] for r in got) > 5000


def test_empty_table(spark):
    assert S.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_very_long_text(spark):
    rng = random.Random(4)
    long = [f"w{rng.randint(0, 10**6)}" for _ in range(120_000)]
    rows = [(1, " ".join(long)), (2, " ".join(["own"] + long[50_000:50_090])), (3, " ".join(long[:100_000] + ["z"] + long[100_000:]))]
    got = {r[0]: r for r in result(spark, rows)}
    assert got[1][2] == 0 and got[2][2] == 90 and got[3][2] == 120_000


def test_every_window_holds_an_anchor_at_its_own_place():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    h[100:200] = h[100]  # one word again and again
    at, _ = S.anchors(h)
    for i in range(351):
        inside = at[(at >= i) & (at <= i + S.REACH)]
        own, _ = S.anchors(h[i : i + 50])
        assert len(inside) and len(own) == 1 and own[0] + i in inside


def test_many_parts_of_one_group_are_looked_at_once():
    """Members that part from each other one after the other, on both sides, do not multiply."""
    n = 40
    side = np.zeros((n, S.REACH + 1), np.int64)
    for i in range(n):
        side[i, : S.REACH] = 1
        side[i, i : S.REACH] = 2 + i
    calls = list(S.repeats_in_group(np.arange(n), side, side, [np.arange(n)]))
    assert len(calls) < n * n
