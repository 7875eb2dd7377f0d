from __future__ import annotations

import hashlib
import random
import re

from hypothesis import given
from hypothesis import strategies as st

from tallyspark.llm import exact_dedup as X

SCHEMA = "doc_id long, text string, hash string, recipe string"


def brute(rows):
    groups = {}
    for i, (d, t, *_) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append((d is None, d or 0, i))
    out = []
    for i, (d, t, *_) in enumerate(rows):
        n = re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
        least = min(groups[n])
        out.append((d, None if least[0] else least[1], len(groups[n]), hashlib.sha256(n.encode()).hexdigest()))
    return out


def order(rows):
    return sorted(rows, key=repr)


def test_against_brute_force(spark):
    rng = random.Random(5)
    long = " ".join(rng.choice("abc de fgh ij".split()) + str(rng.random()) for _ in range(4000))
    rows = [
        (7, long, "x", "y"), (3, long.replace(" ", "\n "), "x", "y"), (4, long + "!", "x", "y"), (5, "!" + long, None, "y"),
        (1, None, None, None), (2, "", None, None), (6, " \t\n", None, None), (8, " ", None, None), (9, " ", None, None),
        (10, "same", None, None), (10, "same", None, None), (None, "same", None, None), (None, "alone", None, None),
    ]
    got = X.exact_dedup(spark.createDataFrame(rows, SCHEMA)).collect()
    assert order((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == order(brute(rows))
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in got}) and all(r.doc_id == r.keep_id for r in kept)
    stay = X.drop_copies(spark.createDataFrame(rows, SCHEMA))
    assert stay.columns == ["doc_id", "text", "hash", "recipe"]
    assert order(r.doc_id for r in stay.collect()) == order(r.doc_id for r in kept)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert X.exact_dedup(empty).collect() == [] and X.drop_copies(empty).collect() == []


def test_very_long_texts(spark):
    """Texts of several megabytes: an edit in the middle tells them apart, white space does not."""
    rng = random.Random(2)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(500_000))
    half = long.index(" ", len(long) // 2)
    rows = [(1, long), (2, long[:half] + "\n\t" + long[half + 1 :]), (3, long[:half] + "x" + long[half:]), (4, long), (5, "short")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in X.exact_dedup(df).collect()) == [(1, 1, 3, True), (2, 1, 3, False), (3, 3, 1, True), (4, 1, 3, False), (5, 5, 1, True)]
    assert sorted(r.doc_id for r in X.drop_copies(df).collect()) == [1, 3, 5]


def test_rows_of_files_are_numbered_without_a_copy(spark, tmp_path):
    from tallyspark.llm.common import identified

    frame = spark.range(1000).selectExpr("id AS doc_id", "concat('t', id % 700) AS text", "id AS _file").repartition(5)
    frame.write.parquet(str(tmp_path / "docs"))
    read = spark.read.parquet(str(tmp_path / "docs"))
    for df in (read, frame):
        given = identified(df, "_given")
        assert given.columns == ["doc_id", "text", "_file", "_given"]
        twice = [{r._given: r.doc_id for r in given.select("_given", "doc_id").collect()} for _ in range(2)]
        assert twice[0] == twice[1] and len(twice[0]) == 1000
    assert sorted(r.doc_id for r in X.drop_copies(read).collect()) == list(range(700))
    assert X.drop_copies(read).columns == read.columns


def test_clashing_hashes_are_told_apart(spark):
    rows = [(0, [1, 2], [b"a", b"b"]), (1, [1, 2], [b"a", b"b"]), (2, [1, 2], [b"c", b"b"])]
    got = X.verified(spark.createDataFrame(rows, "_row long, hashes array<long>, digests array<binary>")).collect()
    recipes = {r._row: r.recipe for r in got}
    assert recipes[0] == recipes[1] != recipes[2]


@given(st.binary(max_size=3000), st.integers(1, 40))
def test_cuts_cover_the_text(data, times):
    data = data * times
    ends = X.cut_points(data)
    sizes = [b - a for a, b in zip([0, *ends], ends)]
    assert ends[-1] == len(data) and all(0 < s <= X.MAX_CHUNK for s in sizes if data)


def test_an_edit_changes_few_chunks():
    rng = random.Random(1)
    data = bytes(rng.randrange(256) for _ in range(200_000))
    chunks = lambda d: {d[a:b] for a, b in zip([0, *X.cut_points(d)], X.cut_points(d))}
    edited = data[:90_000] + b"inserted" + data[90_000:]
    assert len(chunks(edited) - chunks(data)) <= 4 < len(chunks(data))
