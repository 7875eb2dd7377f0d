"""Language ID by compression with one zstandard raw-content dictionary per language.

A text is lower-cased, runs of anything but letters become one space, and blocks of it
are compressed with each language's dictionary; the smallest total wins. Sizes that are
equal (very short texts do not compress) are told apart by the letter trigrams of the
dictionaries. A narrow margin rejects a text: ``rejected`` is set, the best guess stays.

The dictionaries are learned from a bounded sample of labelled rows: SAMPLE_ROWS rows a
language, chosen by a hash of doc_id. DICT_BYTES are shared out among them, so that each
row with letters gives a piece; what short rows leave goes to longer ones. Any number of
languages is scored; compressors are built for GROUP languages at a time, while the
dictionaries are held whole, DICT_BYTES a language at most. Predictions cover whole texts.

Defined results: a null text, or one without letters, is ``und`` with score 0 and
rejected, and so is everything where there is nothing to learn from; equal scores go to the
first language in alphabetical order; rows that repeat a doc_id are predicted each; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspark.llm.common import by_batch, record

SAMPLE_ROWS, DICT_BYTES, GROUP = 160, 110 << 10, 64
LEVEL, BLOCK = 5, 4096
#: Texts whose best and second size differ by less than this share are rejected.
MIN_MARGIN = 0.005
UNKNOWN = "und"

_OTHER = re.compile(r"[\W\d_]+")


def letters(text: str | None) -> str:
    return _OTHER.sub(" ", (text or "").lower()).strip()


def held_out(doc_id):
    """The fold that is never learned from: crc32 of the id's digits, mod 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def share_out(texts: list[str]) -> bytes:
    """A dictionary of DICT_BYTES at most with a piece of each text that has letters."""
    whole = [t for t in (letters(text).encode("utf-8", "surrogatepass") for text in texts) if t]
    left, sizes = DICT_BYTES - max(0, len(whole) - 1), {}
    for n, k in enumerate(sorted(range(len(whole)), key=lambda k: len(whole[k]))):
        sizes[k] = min(len(whole[k]), left // (len(whole) - n))
        left -= sizes[k]
    return b" ".join(t[: sizes[k]] for k, t in enumerate(whole))


def _dictionary(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "dictionary": [share_out(pdf.sort_values("n")["text"].tolist())]})


def learn(docs: DataFrame) -> dict[str, bytes]:
    """lang -> dictionary content. docs: doc_id, text, lang; only rows that may be learned from."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    # A hash threshold for about four samples a language, then the first of those by hash.
    counts = rows.groupBy("lang").count().select("lang", F.least(F.lit(1.0), 4.0 * SAMPLE_ROWS / F.col("count")).alias("share"))
    lot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"))
    chosen = rows.join(F.broadcast(counts), "lang").where(lot < F.col("share") * (1 << 20))
    sample = chosen.withColumn("n", F.row_number().over(order)).where(F.col("n") <= SAMPLE_ROWS)
    # No row gives more than DICT_BYTES of letters, so a long one need not come whole.
    sample = sample.select("lang", "n", F.substring("text", 1, 4 * DICT_BYTES).alias("text"))
    found = sample.groupBy("lang").applyInPandas(_dictionary, "lang string, dictionary binary").collect()  # DICT_BYTES a language at most
    return {r["lang"]: bytes(r["dictionary"]) for r in sorted(found, key=lambda r: r["lang"]) if r["dictionary"]}


class _Group:
    """Compressors and trigram counts of some languages."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.dictionaries, self.by, self.trigrams = dictionaries, {}, {}
        for k, d in dictionaries.items():
            content = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            how = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=BLOCK, dict_size=len(d), write_content_size=False, write_checksum=False, write_dict_id=False)
            self.by[k] = zstandard.ZstdCompressor(compression_params=how, dict_data=content)

    def sizes(self, blocks: list[bytes]) -> list[float]:
        return [float(sum(len(c.compress(b)) for b in blocks)) for c in self.by.values()]

    def unlike(self, text: str, names: list[str]) -> dict[str, float]:
        """Bits of the text's trigrams in the trigram counts of the named dictionaries, in bytes."""
        padded = f" {text} "
        grams = Counter(padded[i : i + 3] for i in range(len(padded) - 2))
        out = {}
        for k in names:
            if k not in self.trigrams:
                s = self.dictionaries[k].decode("utf-8", "ignore")
                c = Counter(s[i : i + 3] for i in range(len(s) - 2))
                self.trigrams[k] = c, sum(c.values()) + 1e4
            c, total = self.trigrams[k]
            out[k] = -sum(n * math.log2((c[g] + 0.5) / total) for g, n in grams.items()) / 8
        return out


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes]):
        self.dictionaries, self.names = dictionaries, sorted(dictionaries)
        self.kept: _Group | None = None

    def _groups(self) -> Iterator[_Group]:
        """Groups of GROUP languages in order, one in memory at a time; a single one is kept."""
        for at in range(0, len(self.names), GROUP):
            group = self.kept or _Group({k: self.dictionaries[k] for k in self.names[at : at + GROUP]})
            if len(self.names) <= GROUP:
                self.kept = group
            yield group

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score from 0 to 1, rejected."""
        return self.predict_all([text])[0]

    def predict_all(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        out: list[tuple[str, float, bool]] = [(UNKNOWN, 0.0, True)] * len(texts)
        plain = {i: p for i, p in enumerate(map(letters, texts)) if self.names and any(map(str.isalpha, p))}
        sizes: dict[int, list[float]] = {i: [] for i in plain}
        for group in self._groups() if plain else ():
            for i, p in plain.items():
                data = p.encode("utf-8", "surrogatepass")
                sizes[i] += group.sizes([data[at : at + BLOCK] for at in range(0, len(data), BLOCK)])
        ranked, tied = {}, {}
        for i, found in sizes.items():
            least = min(found)
            names = [k for s, k in zip(found, self.names, strict=True) if s == least]
            if len(names) > 1:
                tied[i] = set(names)
            ranked[i] = sorted(zip(found, self.names, strict=True))
        unlike: dict[int, dict[str, float]] = {i: {} for i in tied}
        for group in self._groups() if tied else ():
            for i, names in tied.items():
                unlike[i] |= group.unlike(plain[i], [k for k in group.by if k in names])
        for i in plain:
            order = sorted((s, k) for k, s in unlike[i].items()) if i in tied else ranked[i]
            if len(order) == 1:
                out[i] = order[0][1], 1.0, False
                continue
            (best, name), (second, _) = order[:2]
            total = sum(math.exp(max(-700.0, (best - s) / 2)) for s, _ in order)
            out[i] = name, 1 / total, (second - best) / max(second, 1.0) < MIN_MARGIN
        return out


def predict(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """doc_id, lang_pred, score, rejected: one row per row of docs; reads doc_id and text only."""
    schema = {"doc_id": pa.int64(), "lang_pred": pa.string(), "score": pa.float64(), "rejected": pa.bool_()}
    kept: list[Classifier] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not kept:
            kept.append(Classifier(dictionaries))
        found = kept[0].predict_all(batch.column("text").to_pylist())
        a, b, c = zip(*found, strict=True) if found else ((), (), ())
        return record(schema, doc_id=batch.column("doc_id"), lang_pred=list(a), score=list(b), rejected=list(c))

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return by_batch(texts, run, "doc_id long, lang_pred string, score double, rejected boolean")


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the rows that are not held out, predict all: doc_id, held_out, lang_pred, score, rejected."""
    found = predict(docs, learn(docs.where(~held_out(F.col("doc_id")))))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of docs whose language is identified, with all their columns.

    The rejection is decided from the text of the row itself, so no join is needed.
    """
    dictionaries = learn(docs.where(~held_out(F.col("doc_id"))))
    kept: list[Classifier] = []

    def run(batches):
        if not kept:
            kept.append(Classifier(dictionaries))
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                yield part.filter(pa.array([not rejected for _, _, rejected in kept[0].predict_all(part.column("text").to_pylist())], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
