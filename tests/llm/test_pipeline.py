from __future__ import annotations

import re
from pathlib import Path

import corpus_pipeline
import pytest
import sentencepiece

from tallyspark.llm import common
from tallyspark.llm.common import written
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_simhash import brute_components, brute_fingerprint

tokenizers = pytest.importorskip("public_tokenizers")


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(-3, None, "en", "s", 0), (-2, "", None, None, None), (-1, "?!", "en", "s", 2)], docs.schema)
    docs, items = docs.union(odd), [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    columns = docs.columns
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        rows = [(r.doc_id, r.text or "") for r in docs.collect()]
        out = written(stage(spark, docs, sf_dir), name)
        if name != "encode":
            assert out.columns == columns
        if name == "language_id":
            assert {d for d, t in rows if not re.search(r"[^\W\d_]", t)}.isdisjoint(ids(out))
            assert out.count() >= 0.98 * len(rows)
        elif name == "exact_dedup":
            first = {}
            for d, t in sorted(rows):
                first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), d)
            assert ids(out) == set(first.values())
        elif name == "near_dedup":
            assert ids(out) == {c for _, c in brute_components([(d, brute_fingerprint(t)) for d, t in rows])}
        elif name == "decontaminate":
            assert ids(out) == {d for d, _ in rows} - {d for d, *_ in contaminated(rows, items)}
        else:
            sp = sentencepiece.SentencePieceProcessor(model_file=tokenizers.path("piece_bpe_32k.model"))
            assert {r.doc_id: (list(r.ids), r.decoded) for r in out.collect()} == {d: (sp.encode(t, add_eos=True), t) for d, t in rows}
        docs = out


def test_it_is_registered(spark):
    import __spark_entry__

    assert "pipeline" in __spark_entry__.queries() and "pipeline" not in __spark_entry__.oracle_sql()


def _tables(spark, folder, docs, items):
    docs.write.parquet(f"{folder}/documents.parquet")
    items.write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_odd_tables(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows, clashing columns, empty tables; nothing is left behind but the result."""
    long, story = "eine lange zeile mit immer anderen worten " * 20_000, "the quick brown fox is not here today but it was there all of last week"
    schema = "doc_id long, text string, lang string, source string, n_chars long, _given string, _row int, fp string, recipe int"
    rows = [(5, story), (5, story), (3, story + " "), (None, story), (7, None), (8, ""), (9, "12 ?"), (10, long), (11, long + "ende"), (12, "der hund und die katze sind nicht mehr im haus oder auf der strasse"), (None, "und noch ein kleiner satz der keine nummer hat und doch bleiben soll")]
    rows = [(d, t, "en" if t and t[:3] == "the" else "de", "s", 1, "g", 2, "f", 3) for d, t in rows]
    docs, items = spark.createDataFrame(rows, schema), spark.createDataFrame([(1, "the benchmark asks for one thing only and nothing more"), (2, None)], "item_id long, text string")
    for name, d, i in (("full", docs, items), ("empty", docs.limit(0), items), ("no-items", docs, items.limit(0))):
        folder = _tables(spark, tmp_path / name, d, i)
        kept = {"full": [3, 10, 12, None], "empty": [], "no-items": [3, 10, 12, None]}[name]
        now = spark.read.parquet(f"{folder}/documents.parquet")
        for stage, f in corpus_pipeline.STAGES[:-1]:
            now = written(f(spark, now, folder), stage)
            assert now.columns == docs.columns
        assert {r["_given"] for r in now.collect()} <= {"g"}
        out = corpus_pipeline.run(spark, folder)
        assert sorted((r.doc_id for r in out.collect()), key=repr) == sorted((r.doc_id for r in now.collect()), key=repr)
        assert sorted((r.doc_id for r in now.collect()), key=repr) == sorted(kept, key=repr), name


def test_scratch_removes_its_tables(spark, sf_dir, monkeypatch):
    """Of the tables that a run writes to the shared folder, which others may use too, the result alone stays."""
    made = []

    def noted(session, name, given=common.shared_dir):
        made.append(given(session, name))
        return made[-1]

    monkeypatch.setattr(common, "shared_dir", noted)
    monkeypatch.setattr(corpus_pipeline, "shared_dir", noted)
    out = corpus_pipeline.run(spark, sf_dir)
    left = [p for p in map(Path, (re.sub("^file:/*", "/", p) for p in made)) if p.exists()]
    assert [p.name.rsplit("-", 1)[0] for p in left] == ["encode"] and len(made) > 20 and out.count() > 0
