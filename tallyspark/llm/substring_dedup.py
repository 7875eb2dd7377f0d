"""Substring dedup: seed and extend on winnowed anchors.

A word is removed if a window of WINDOW words that covers it also starts in a document with a
smaller doc_id. Seeds are runs of SEED words; winnowing picks the seed of the least hash
among those of each window, so equal windows hold the same anchor at the same place, and it is enough
to look at the words around anchors: at most REACH before and after one, its context.

Anchors that one document alone holds are done. Equal contexts (by digest) are a class: its
members after the first document are repeats as a whole, and only the first one goes on. First
members fetch the words of their contexts and meet in groups by anchor. In a group
all are compared with the member of the smallest doc_id and matches are extended both ways,
word by word; a match of WINDOW words or more is a repeat. What a member has beyond the match
can only match members that part from the first one at the same place with the same
word: they form groups of their own, by the word before or after the match, until a member is alone.
So a passage that many documents share costs a comparison for each, not for each pair.
Groups of up to SMALL_GROUP members are extended within a task. Members of larger ones, so that
none meet in one task, are dealt by the windows of their contexts: a window repeats if its
least document is smaller.

Overlapping repeats are merged to maximal ones before words are removed.

Defined results: a null text has no words; a null doc_id is larger than all others, so among
such rows nothing is removed for each other; rows that repeat a doc_id do not repeat each
other; equal rows get equal results; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import by_batch, record, written

WINDOW, SEED = 50, 8
#: Words of a context before its anchor, at most, and after it.
REACH = WINDOW - SEED
#: Members of a group that one task extends.
SMALL_GROUP = 200
#: Words whose hashes a task remembers.
KNOWN_WORDS = 1 << 20

_BASE, _STEP, _LOW = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xFFFFFFFF)


class _Hashes(dict):
    """Hashes of words, kept while they are few."""

    def __missing__(self, word):
        if len(self) >= KNOWN_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()  # bytes split at ASCII white space only


def anchors(hashes: np.ndarray, seed: int = SEED, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Places of the winnowed anchors of a text of hashed words, and the hashes of their seeds."""
    n = len(hashes)
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    seeds = np.zeros(n - seed + 1, np.uint64)
    for k in range(seed):
        seeds = seeds * _BASE + hashes[k : n - seed + 1 + k]
    seeds ^= seeds >> np.uint64(32)
    seeds *= _STEP
    seeds ^= seeds >> np.uint64(29)
    # Least upper half; of equal ones the last. Minima over doubling widths, then over `width`.
    least = (seeds & ~_LOW) | (_LOW - np.arange(len(seeds), dtype=np.uint64))
    width, done = window - seed + 1, 1
    while done * 2 <= width:
        least = np.minimum(least[:-done], least[done:])
        done *= 2
    rest = width - done
    least = np.minimum(least[: len(least) - rest], least[rest:])
    at = np.unique(_LOW - (least & _LOW)).astype(np.int64)
    return at, seeds[at]


def _signed(x) -> np.ndarray:
    return np.asarray(x, np.uint64).view(np.int64)


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, key, text. Rows of equal doc_id and text share a key and all results."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))


def _order(doc: str = "doc_id") -> list[Column]:
    return [F.col(doc).isNull(), F.coalesce(doc, F.lit(0))]


def found_anchors(docs: DataFrame) -> DataFrame:
    """anchor, digest (of the context), doc_id, key, at, low, high: a row for each anchor; written.

    low and high: where the context begins and ends, in words.
    """
    names = {"anchor": pa.int64(), "digest": pa.int64(), "doc_id": pa.int64(), "key": pa.int64(), "at": pa.int32(), "low": pa.int32(), "high": pa.int32()}
    known = _Hashes()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = {k: [] for k in names}
        which = []
        for i, text in enumerate(batch.column("text").to_pylist()):
            words = words_of(text)
            hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
            at, seeds = anchors(hashes)
            if not len(at):
                continue
            low, high = np.maximum(0, at - REACH), np.minimum(len(words), at + SEED + REACH)
            data = hashes.tobytes()
            digest = [xxhash.xxh3_64_intdigest(data[8 * a : 8 * b], p - a) for p, a, b in zip(at.tolist(), low.tolist(), high.tolist(), strict=True)]
            which.append(np.full(len(at), i))
            for k, v in (("anchor", _signed(seeds)), ("digest", _signed(digest)), ("at", at), ("low", low), ("high", high)):
                out[k].append(v)
        which = np.concatenate(which) if which else np.zeros(0, np.int64)
        columns = {k: pa.array(np.concatenate(v)) if v else pa.array([], t) for (k, t), v in zip(names.items(), out.values(), strict=True) if k not in ("doc_id", "key")}
        return record(names, **columns, **{k: batch.column(k).take(pa.array(which, pa.int64())) for k in ("doc_id", "key")})

    schema = "anchor long, digest long, doc_id long, key long, at int, low int, high int"
    return written(by_batch(_keyed(docs), run, schema), "anchors")


def repeated_anchors(found: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(whole: doc_id, key, low, high, contexts that a smaller document holds as they are;
    again: doc_id, key, at, first_key, first_at, further places of a context in the document that holds it first;
    firsts: anchor, doc_id, key, at, low, high, the first member of each class of an anchor with
    several classes and documents); all written."""
    rank = F.struct(*(c.alias(f"o{i}") for i, c in enumerate(_order())))
    first = F.min(F.struct(rank.alias("rank"), "doc_id", "key", "at", "low", "high"))
    classes = written(found.groupBy("anchor", "digest").agg(first.alias("first"), F.max(rank).alias("last"), F.count("*").alias("n")), "classes")
    live = classes.groupBy("anchor").agg(F.count("*").alias("classes"), F.min("first.rank").alias("least"), F.max("last").alias("most")).where("least < most")
    firsts = classes.join(live.where("classes > 1").select("anchor"), "anchor").select("anchor", "first.doc_id", "first.key", "first.at", "first.low", "first.high")
    several = classes.where("n > 1").select("anchor", "digest", F.col("first.rank").alias("f_rank"), F.col("first.key").alias("first_key"), F.col("first.at").alias("first_at"))
    members = found.join(several, ["anchor", "digest"]).withColumn("later", rank > F.col("f_rank"))
    members = written(members.where("later OR key <> first_key OR at <> first_at").select("doc_id", "key", "at", "low", "high", "first_key", "first_at", "later"), "members")
    return members.where("later").select("doc_id", "key", "low", "high"), members.where("NOT later").select("doc_id", "key", "at", "first_key", "first_at"), written(firsts, "firsts")


def contexts(docs: DataFrame, firsts: DataFrame) -> DataFrame:
    """group, doc_id, key, at, low, high, words (of the context, joined by spaces); written."""
    wanted = firsts.groupBy("doc_id", "key").agg(F.collect_list(F.struct("anchor", "at", "low", "high")).alias("places"))
    texts = _keyed(docs)
    same = F.col("t.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("t.key") == F.col("w.key"))
    joined = texts.alias("t").join(wanted.alias("w"), same).select("t.doc_id", "t.key", "t.text", "w.places")
    names = {"group": pa.int64(), "doc_id": pa.int64(), "key": pa.int64(), "at": pa.int32(), "low": pa.int32(), "high": pa.int32(), "words": pa.string()}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = {k: [] for k in names}
        for doc, key, text, places in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            words = words_of(text)
            for p in places:
                a, b = p["low"], p["high"]
                row = (p["anchor"], doc, key, p["at"], a, b, b" ".join(words[a:b]).decode("utf-8", "surrogatepass"))
                for k, v in zip(names, row, strict=True):
                    out[k].append(v)
        return record(names, **out)

    return written(by_batch(joined, run, "group long, doc_id long, key long, at int, low int, high int, words string"), "contexts")


def _coded(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Words of contexts as numbers, before the anchor (nearest first) and after it; 0: none.
    Then the rows of each anchor: its words are compared too."""
    numbers: dict[str, int] = {}
    before, after = (np.zeros((len(rows), REACH + 1), np.int64) for _ in range(2))
    own: dict[tuple, list[int]] = {}
    for i, r in enumerate(rows):
        words, k = r["words"].split(" "), r["at"] - r["low"]
        codes = [numbers.setdefault(w, len(numbers) + 1) for w in words]
        before[i, :k] = codes[:k][::-1]
        after[i, : len(codes) - k - SEED] = codes[k + SEED :]
        own.setdefault(tuple(codes[k : k + SEED]), []).append(i)
    return before, after, [np.array(g) for g in own.values()]


def _common(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many words from the anchor on each row shares with the first."""
    differ = (x != first) | (x == 0)
    return np.where(differ.any(axis=1), differ.argmax(axis=1), x.shape[1])


def repeats_in_group(doc: np.ndarray, before: np.ndarray, after: np.ndarray, groups: list[np.ndarray]) -> Iterator[tuple[int, int, int]]:
    """(row, words before the anchor, words after it) of each repeat that is found.

    Rows are in order of their documents, doc their ranks. A row is compared with the first one
    of its group; what it has beyond the match goes to the groups of those that part there with
    the same word. A group is a set of words before and after, so it is looked at once.
    """
    groups, seen = [g for g in groups if len(g) > 1], set()
    while groups:
        rows = groups.pop()
        if len(rows) > 2:
            if (name := rows.tobytes()) in seen:
                continue
            seen.add(name)
        first, rows = rows[0], rows[1:]
        left, right = _common(before[rows], before[first]), _common(after[rows], after[first])
        hit = (doc[rows] > doc[first]) & (left + SEED + right >= WINDOW)
        yield from zip(rows[hit].tolist(), left[hit].tolist(), right[hit].tolist(), strict=True)
        if len(rows) < 2:
            continue
        for side, own in ((before, left), (after, right)):
            # The word at which it parts; without one, or none within reach, nothing is left to match.
            word = side[rows, own]
            open_ = np.flatnonzero(word)
            if len(open_) < 2:
                continue
            key = own[open_] * (int(word.max()) + 1) + word[open_]
            order = np.argsort(key, kind="stable")
            cut = np.flatnonzero(np.diff(key[order])) + 1
            groups += [g for g in np.split(rows[open_][order], cut) if len(g) > 1]


_MEMBER = {"group": pa.int64(), "doc_id": pa.int64(), "key": pa.int64(), "at": pa.int32(), "low": pa.int32(), "high": pa.int32(), "words": pa.string()}
_REPEAT = {"doc_id": pa.int64(), "key": pa.int64(), "at": pa.int32(), "low": pa.int32(), "high": pa.int32()}


def _small_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeats in groups that follow each other: rows sorted by group, document, key and place."""
    held: list[dict] = []

    def done(out: dict) -> None:
        doc, rank = [], 0
        for a, b in zip([None, *held], held, strict=False):
            rank += a is not None and a["doc_id"] != b["doc_id"]
            doc.append(rank)
        if rank:
            for row, left, right in repeats_in_group(np.array(doc), *_coded(held)):
                r = held[row]
                for k, v in zip(out, (r["doc_id"], r["key"], r["at"], r["at"] - left, r["at"] + SEED + right), strict=True):
                    out[k].append(v)

    for batch in batches:
        out = {k: [] for k in _REPEAT}
        for r in (r for at in range(0, batch.num_rows, 1000) for r in batch.slice(at, 1000).to_pylist()):
            if held and held[0]["group"] != r["group"]:
                done(out)
                held.clear()
            if not held or any(held[-1][k] != r[k] for k in ("doc_id", "key", "at")):  # equal rows once
                held.append(r)
        yield record(_REPEAT, **out)
    out = {k: [] for k in _REPEAT}
    if held:
        done(out)
    yield record(_REPEAT, **out)


def _windows(batch: pa.RecordBatch) -> pa.RecordBatch:
    """A row for each window of a context: window (its hash, 128 bits), doc_id, key, at, low."""
    names = {"window": pa.binary(), "doc_id": pa.int64(), "key": pa.int64(), "at": pa.int32(), "low": pa.int32()}
    out = {k: [] for k in names}
    for r in batch.to_pylist():
        words = r["words"].encode("utf-8", "surrogatepass").split(b" ")
        for k in range(len(words) - WINDOW + 1):
            row = (xxhash.xxh3_128_digest(b" ".join(words[k : k + WINDOW])), r["doc_id"], r["key"], r["at"], r["low"] + k)
            for c, v in zip(names, row, strict=True):
                out[c].append(v)
    return record(names, **out)


def repeats(members: DataFrame) -> DataFrame:
    """doc_id, key, at, low, high of all repeats among the contexts of each group; written."""
    sizes = written(members.groupBy("group").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
    hot = sizes.where(F.col("size") > SMALL_GROUP).select("group")
    small = members.join(sizes.where(F.col("size") <= SMALL_GROUP), "group", "left_semi").select(*_MEMBER)
    order = ["group", F.col("doc_id").asc_nulls_last(), "key", "at"]
    found = small.repartition("group").sortWithinPartitions(*order).mapInArrow(_small_groups, "doc_id long, key long, at int, low int, high int")
    # Large groups are dealt by windows. Those of a context that repeat all hold its anchor, so they are one stretch.
    windows = by_batch(members.join(hot, "group", "left_semi"), _windows, "window binary, doc_id long, key long, at int, low int")
    windows = written(windows, "windows")
    rank = F.struct(*(c.alias(f"o{i}") for i, c in enumerate(_order())))
    least = windows.groupBy("window").agg(F.min(rank).alias("least"), F.max(rank).alias("most")).where("least < most")
    later = windows.join(least, "window").where(rank > F.col("least"))
    large = later.groupBy("doc_id", "key", "at").agg(F.min("low").alias("low"), (F.max("low") + WINDOW).alias("high"))
    return written(found.unionByName(large), "repeats")


def maximal(spans: DataFrame) -> DataFrame:
    """doc_id, key, spans (array of low, high, in order)."""
    # Of repeats that begin at the same word the longest counts: combined before the shuffle.
    longest = spans.groupBy("doc_id", "key", "low").agg(F.max("high").alias("high"))
    return longest.groupBy("doc_id", "key").agg(F.array_sort(F.collect_list(F.struct("low", "high"))).alias("spans"))


def _merged(spans: list[dict] | None) -> Iterator[tuple[int, int]]:
    """Overlapping and touching repeats as one."""
    low = high = None
    for s in spans or ():
        if high is not None and s["low"] <= high:
            high = max(high, s["high"])
            continue
        if high is not None:
            yield low, high
        low, high = s["low"], s["high"]
    if high is not None:
        yield low, high


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, kept (words that stay, joined by spaces), n_words, n_removed, spans (removed: first word, last word + 1)."""
    whole, again, firsts = repeated_anchors(found_anchors(docs))
    found = repeats(contexts(docs, firsts))
    # What holds for the first place of a context holds for its other places in that document.
    same = F.col("a.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("a.first_key") == F.col("f.key")) & (F.col("a.first_at") == F.col("f.at"))
    shift = F.col("a.at") - F.col("a.first_at")
    moved = found.alias("f").join(again.alias("a"), same).select("a.doc_id", "a.key", (F.col("f.low") + shift).alias("low"), (F.col("f.high") + shift).alias("high"))
    spans = written(maximal(whole.unionByName(found.drop("at")).unionByName(moved)), "spans")
    same = F.col("t.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("t.key") == F.col("s.key"))
    joined = _keyed(docs).alias("t").join(spans.alias("s"), same, "left").select("t.doc_id", "t.text", "s.spans")
    span = pa.struct([("low", pa.int32()), ("high", pa.int32())])
    names = {"doc_id": pa.int64(), "kept": pa.string(), "n_words": pa.int64(), "n_removed": pa.int64(), "spans": pa.list_(span)}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = {k: [] for k in names}
        for doc, text, spans in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            words = words_of(text)
            cuts, kept, end = list(_merged(spans)), [], 0
            for a, b in cuts:
                kept += words[end:a]
                end = b
            kept += words[end:]
            row = (doc, b" ".join(kept).decode("utf-8", "surrogatepass"), len(words), len(words) - len(kept), [{"low": a, "high": b} for a, b in cuts])
            for k, v in zip(names, row, strict=True):
                out[k].append(v)
        return record(names, **out)

    return by_batch(joined, run, "doc_id long, kept string, n_words long, n_removed long, spans array<struct<low:int,high:int>>")


def digest(kept: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
