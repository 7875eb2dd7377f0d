from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyspark.llm import token_files as T

tokenizers = pytest.importorskip("public_tokenizers")
PATH = tokenizers.path("byte_bpe_50k.json")
HF = Tokenizer.from_file(PATH)


def want_ids(text):
    return [*HF.encode(text or "", add_special_tokens=False).ids, 0]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab it's Éé²½ªßŉ×; \t\n\u00a0\u2009\x1cé漢🙂.,'09\x85") | st.characters(codec="utf-8"), max_size=50))
def test_parts_give_the_tokenizers_ids(text):
    table = T.token_table(PATH)
    texts = [text, text + "<|endoftext|> x", "", text[::-1], "it's a word, (and) another. " + text]
    ids, n = table.encode(pa.array(["left", *texts]).slice(1), np.array([0], table.dtype).tobytes())
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == list(map(want_ids, texts))


def test_round_trip(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(-5, None, "a"), (10**9, "", "b"), (10**9, "x", "b"), (None, "none", "c"), (-7, "word " * 90_000, "d")], "doc_id long, text string, lang string")
    both = docs.union(odd)
    manifest = T.write_token_files(both, PATH, shards=5)
    got = sorted(map(tuple, T.read_documents(manifest).collect()), key=lambda r: r[1])
    rows = sorted(both.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    assert [r[0] for r in got] == [r.doc_id for r in rows]
    start, sizes = 0, {}
    for g, r in zip(got, rows):
        ids = want_ids(r.text)
        if r.doc_id != 10**9:
            assert g[1:] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert g[1] == start
        start += g[2]
        sizes.setdefault(r.doc_id, []).append(g[2])
    assert sorted(sizes[10**9]) == [1, 2]
    shards = sorted(manifest.collect(), key=lambda r: r.shard)
    assert len(shards) == 5 and shards[-1].base + shards[-1].n_tokens == start
    assert all(T.FlatFile(s.folder, f"{s.name}.bin", s.dtype).size == s.n_tokens and s.dtype == "<u2" for s in shards)
    places = T.FlatFile(shards[1].folder, f"{shards[1].name}.idx", "<u8")
    assert places.read(0, 1)[0] == shards[0].n_tokens and places.size == shards[1].n_docs + 1


def test_blocks_of_readers_and_writers(spark, sf_dir, monkeypatch):
    """Blocks much smaller than a shard, and files read by ranges, give the same documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    manifest = T.write_token_files(docs, PATH, shards=2).collect()
    want = [r for s in manifest for b in T._documents_of(s.asDict()) for r in b.to_pylist()]
    for name, value in (("READ_IDS", 700), ("READ_DOCS", 3)):
        monkeypatch.setattr(T, name, value)
    assert [r for s in manifest for b in T._documents_of(s.asDict()) for r in b.to_pylist()] == want

    class Remote:  # a store whose files are not local
        get_file_info, open_input_file = T.pafs.LocalFileSystem().get_file_info, T.pafs.LocalFileSystem().open_input_file

    monkeypatch.setattr(T, "_store", lambda path: (Remote, path.removeprefix("file://")))
    assert [r for s in manifest for b in T._documents_of(s.asDict()) for r in b.to_pylist()] == want and len(want) == docs.count()
    texts = pa.array(["ab", "", "c" * 50, "d", "e"])
    assert list(T.text_groups(texts, 4)) == [(0, 2), (2, 1), (3, 2)] and list(T.text_groups(texts.slice(0, 0))) == []


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(2, "two", "a", 9, b"x"), (1, "one", "b", 8, b"y")], "doc_id long, text string, start string, n_tokens int, shard binary")
    got = T.read_documents(T.write_token_files(docs, PATH)).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens) for r in got] == [(1, 0, 2), (2, 2, 2)]


def test_empty_table(spark):
    manifest = T.write_token_files(spark.createDataFrame([], "doc_id long, text string"), PATH)
    assert T.read_documents(manifest).collect() == []
