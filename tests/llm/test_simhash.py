from __future__ import annotations

import random

import numpy as np
import pandas as pd
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyspark.llm import simhash as S


def brute_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(items):
    """items: (doc_id, fingerprint)."""
    label = list(range(len(items)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(items)):
        for j in range(i):
            if (items[i][1] ^ items[j][1]).bit_count() <= 4:
                label[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(items):
        groups.setdefault(find(i), []).append(d)
    return sorted(((d, min((x for x in groups[find(i)] if x is not None), default=None)) for i, (d, _) in enumerate(items)), key=repr)


@given(st.text(alphabet="aZé \t\n\x0b  ß", max_size=80))
def test_fingerprint(text):
    assert S.fingerprint(text) == brute_fingerprint(text)


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = S.near_duplicates(docs).collect()
    items = [(r.doc_id, brute_fingerprint(r.text)) for r in docs.collect()]
    assert sorted((r.doc_id, int(r.fingerprint, 16)) for r in got) == sorted(items)
    assert sorted(((r.doc_id, r.component_id) for r in got), key=repr) == brute_components(items)


def test_odd_rows(spark):
    rows = [(4, None, 1), (3, "", 1), (9, " \n", 2), (5, "one two", 3), (5, "one two", 3), (None, "ONE TWO", 4), (None, "alone here now", 5)]
    got = S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp int")).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=repr) == sorted([(4, 3), (3, 3), (9, 3), (5, 5), (5, 5), (None, 5), (None, None)], key=repr)
    stay = S.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string, fp int"))
    assert stay.columns == ["doc_id", "text", "fp"] and sorted((r.doc_id for r in stay.collect()), key=repr) == [3, 5, None]
    assert S.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def planted(n, seed):
    rng = random.Random(seed)
    out = {0, (1 << 64) - 1}
    while len(out) < n:
        base = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 9)):
            x = base
            for b in rng.sample(range(64), rng.randrange(0, 6)):
                x ^= 1 << b
            out.add(x)
    return sorted(out)


def test_links_keep_every_component(spark):
    fps = planted(700, 3)
    nodes = spark.createDataFrame([(S._signed(x),) for x in fps], "fp long")
    edges = S.links(nodes)
    roots = {r.node: r.root for r in S.components(edges).collect()}
    ids = {x: i for i, x in enumerate(fps)}
    got = {}
    for x in fps:
        got.setdefault(roots.get(S._signed(x), S._signed(x)), []).append(ids[x])
    want = brute_components([(i, x) for x, i in ids.items()])
    assert sorted((i, min(g)) for g in got.values() for i in g) == sorted(want)


@settings(max_examples=20, deadline=None)
@given(st.integers(0, 2**32))
def test_collisions_do_not_depend_on_slicing(seed):
    fps = np.array([x & (1 << 52) - 1 for x in planted(60, seed)], np.uint64)
    pdf = pd.DataFrame({"fp": fps.view(np.int64), "left": 2})
    whole = S._links(pdf, 52)
    was, S.TASK_VARIANTS = S.TASK_VARIANTS, 5000
    try:
        sliced = S._links(pdf, 52)
    finally:
        S.TASK_VARIANTS = was
    assert whole.equals(sliced)


def test_long_chain_of_edges(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(200, 100), (300, 100)], "a long, b long")
    roots = {r.node: r.root for r in S.components(edges).collect()}
    assert {roots[i] for i in range(41)} == {0} and {roots[i] for i in (100, 200, 300)} == {100}


def test_hot_prefixes_are_dealt_again(spark, monkeypatch):
    monkeypatch.setattr(S, "HOT_PREFIX", 9)
    fps = planted(120, 9)
    edges = S.links(spark.createDataFrame([(S._signed(x),) for x in fps], "fp long"))
    roots = {r.node: r.root for r in S.components(edges).collect()}
    got = {}
    for i, x in enumerate(fps):
        got.setdefault(roots.get(S._signed(x), S._signed(x)), []).append(i)
    assert sorted((i, min(g)) for g in got.values() for i in g) == sorted(brute_components(list(enumerate(fps))))


def test_very_long_texts(spark):
    """A text of several megabytes and one that differs in a few words are near copies; another is not."""
    rng = random.Random(6)
    words = [f"w{rng.randrange(10**6)}" for _ in range(400_000)]
    near = words[:]
    near[200_000] = "changed"
    other = [f"w{rng.randrange(10**6)}" for _ in range(400_000)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(other)), (4, "short text")], "doc_id long, text string").repartition(2)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.near_duplicates(df).collect()}
    assert [got[k][1] for k in (1, 2, 3, 4)] == [1, 1, 3, 4]
    assert got[1][0] == format(brute_fingerprint(" ".join(words)), "016x")
