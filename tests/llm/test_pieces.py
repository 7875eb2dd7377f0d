from __future__ import annotations

import hashlib

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyspark.llm import pieces as P

tokenizers = pytest.importorskip("public_tokenizers")
PATH = tokenizers.path("piece_bpe_32k.model")
SP = sentencepiece.SentencePieceProcessor(model_file=PATH)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab etinhors\t\n▁éßñ漢字🙂́\x00<0x41>/."), max_size=60) | st.text(max_size=30))
def test_encoding_and_decoding(text):
    ids = P.pieces(PATH).encode(text)
    assert ids == SP.encode(text, add_eos=True)
    assert P.pieces(PATH).decode(ids) == SP.decode(ids)


def test_long_texts_without_spaces():
    for text in ("a" * 5000, "the" * 3000, " " * 3000, "ab " * 10 + "\n" * 999, "é" * 2000 + "x"):
        assert P.pieces(PATH).encode(text) == SP.encode(text, add_eos=True)


def test_full_tables_are_emptied(monkeypatch):
    monkeypatch.setattr(P, "TABLE_SIZE", 3)
    monkeypatch.setattr(P, "PAIRS_SIZE", 3)
    p = P.Pieces(PATH)
    text = "some words that come once and some words that come again and again"
    assert p.encode(text) == SP.encode(text, add_eos=True) and len(p.parts) <= 3 and len(p.parts.older) <= 3


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(10**6, None, 1), (10**6 + 1, "", 2), (None, "x y", 3), (None, "x y", 3)], "doc_id long, text string, ids int")
    both = docs.select("doc_id", "text", "source").unionByName(odd, allowMissingColumns=True)
    got = sorted(map(tuple, P.digests(P.encode_decode(both, PATH)).collect()), key=repr)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in both.collect():
        ids = SP.encode(r.text or "", add_eos=True)
        want.append((r.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(SP.decode(ids))))
    assert got == sorted(want, key=repr)
    assert P.encode_decode(both.limit(0), PATH).collect() == []
