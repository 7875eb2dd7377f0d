from __future__ import annotations

import zlib

from tallyspark.llm import language as L


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in L.identify(docs).collect()}
    rows = docs.select("doc_id", "lang").collect()
    assert len(got) == len(rows)
    assert all(got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if got[r.doc_id].held_out]
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) / len(held) >= 0.98
    assert sum(got[r.doc_id].rejected for r in rows) / len(rows) < 0.01
    assert all(0 <= r.score <= 1 for r in got.values())


def test_labels_of_held_out_rows_do_not_matter(spark, sf_dir):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    other = docs.withColumn("lang", F.when(L.held_out(F.col("doc_id")), F.lit("zz")).otherwise(F.col("lang"))).withColumn("source", F.lit(None).cast("string"))
    assert sorted(map(tuple, L.identify(docs).collect())) == sorted(map(tuple, L.identify(other).collect()))


ROWS = [
    (1, "the cat sat on the mat and the dog was there with them all day", "en", "a"), (3, "der hund und die katze sind nicht im haus oder auf der strasse", "de", "b"),
    (4, None, "en", None), (5, "", "de", None), (6, "12 34 !!", None, None), (7, "the dog and the cat", None, None), (None, "der hund und die katze", None, None), (7, "the dog and the cat", None, None),
    (8, "the cat " * 50_000, None, None),
]


def test_odd_rows(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, score string")
    got = sorted(((r.doc_id, r.lang_pred) for r in L.identify(docs).collect()), key=repr)
    assert got == sorted([(1, "en"), (3, "de"), (4, "und"), (5, "und"), (6, "und"), (7, "en"), (7, "en"), (None, "de"), (8, "en")], key=repr)
    stay = L.keep_identified(docs)
    assert stay.columns == docs.columns and sorted((r.doc_id for r in stay.collect()), key=repr) == sorted([1, 3, 7, 7, 8, None], key=repr)
    assert L.identify(docs.limit(0)).collect() == []


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert L.identify(docs).collect()[0].lang_pred == "und"
    one = spark.createDataFrame([(1, "some text", "en"), (2, "other", None)], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score) for r in L.identify(one).collect()} == {("en", 1.0)}


def test_a_tie_is_rejected():
    c = L.Classifier({"a": b"same words here", "b": b"same words here"})
    assert c.predict("same words") == ("a", 0.5, True)


def test_many_languages(spark, monkeypatch):
    """More labels than one group of compressors holds, and the same result in other groups."""
    word = lambda k, i: "".join(chr(97 + (k * 7 + i * 5 + j * (k % 11 + 1)) % 26) for j in range(6)) + chr(97 + k % 26)
    text = lambda k, at: " ".join(word(k, (at * 3 + i) % 9) for i in range(40))
    rows = [(n, text(n % 70, n // 70), f"l{n % 70:02d}") for n in range(560)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in L.identify(docs).collect()}
    assert len({lang for _, _, lang in rows}) > 64 and len(got) == len(rows)
    assert sum(got[n].lang_pred == lang for n, _, lang in rows) / len(rows) >= 0.95
    assert 0 < L.keep_identified(docs).count() <= len(rows)
    dictionaries = L.learn(docs.where(~L.held_out(docs.doc_id)))
    texts = [t for _, t, _ in rows[:80]] + ["ab", None, "1"]
    one = L.Classifier(dictionaries).predict_all(texts)
    monkeypatch.setattr(L, "GROUP", 7)
    assert L.Classifier(dictionaries).predict_all(texts) == one == [L.Classifier(dictionaries).predict(t) for t in texts]


def test_every_sampled_row_gives_a_piece():
    name = lambda n: "".join(chr(97 + int(c)) for c in f"{n:03d}")
    texts = [f"{name(n)} " + "word " * (5 if n % 4 == 0 else 2000) for n in range(L.SAMPLE_ROWS)] + ["12", ""]
    got = L.share_out(texts).decode()
    assert all(name(n) + " word" in got for n in range(L.SAMPLE_ROWS))
    assert L.DICT_BYTES - L.SAMPLE_ROWS < len(got) <= L.DICT_BYTES
    assert L.share_out(["one two", "", "three"]) == b"one two three" and L.share_out(["12"]) == b""


def test_rows_beyond_the_first_hundred_count(spark):
    """All sampled rows of a language enter its dictionary, however long they are."""
    name = lambda n: "".join(chr(97 + int(c)) for c in f"{n:03d}")
    docs = spark.createDataFrame([(n, f"x{name(n)}x " + "word " * 400, "en") for n in range(L.SAMPLE_ROWS)], "doc_id long, text string, lang string")
    got = L.learn(docs)["en"].decode()
    assert all(f"x{name(n)}x" in got for n in range(L.SAMPLE_ROWS))


def test_sizes_against_brute_force(spark, sf_dir):
    """Each text compressed by itself, language by language: the least total is the prediction."""
    import zstandard

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    dictionaries = L.learn(docs.where(~L.held_out(docs.doc_id)))
    got = {r.doc_id: r for r in L.predict(docs, dictionaries).collect()}
    ties = 0
    for r in docs.collect():
        plain = " ".join("".join(c if c.isalpha() else " " for c in (r.text or "").lower()).split())
        if not plain:
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score, got[r.doc_id].rejected) == ("und", 0.0, True)
            continue
        data, sizes = plain.encode(), {}
        for lang, d in dictionaries.items():
            total = 0
            for at in range(0, len(data), L.BLOCK):
                how = zstandard.ZstdCompressionParameters.from_level(L.LEVEL, source_size=L.BLOCK, dict_size=len(d), write_content_size=False, write_checksum=False, write_dict_id=False)
                total += len(zstandard.ZstdCompressor(compression_params=how, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)).compress(data[at : at + L.BLOCK]))
            sizes[lang] = total
        least = sorted(k for k, n in sizes.items() if n == min(sizes.values()))
        ties += len(least) > 1
        assert got[r.doc_id].lang_pred in least
        if len(least) == 1:
            second = sorted(sizes.values())[1]
            assert got[r.doc_id].rejected == ((second - min(sizes.values())) / second < L.MIN_MARGIN)
    assert ties < 0.05 * len(got)
