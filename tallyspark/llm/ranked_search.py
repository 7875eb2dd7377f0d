"""Ranked lexical search by Block-Max MaxScore over an inverted index in shards.

build_index: each task cuts its documents into shards and inverts them. The index is a table
with a row for each shard and term: postings in ascending doc_id order, in blocks of BLOCK,
packed; beside them, for each block, its last document and the pairs of (occurrences, document
length) that no other pair of the block beats. Since a term's share of a score grows with the
occurrences and falls with the length, those pairs give the exact maximum of a block
for any corpus statistics, so the index is built in one pass and can be added to.

search: items are dealt in blocks. Asked terms meet the index in an equi-join; a task gets the
lists of one shard that one block of items asks for. There, for an item, lists are ordered
by the most that they can add. Lists whose bounds together cannot beat the worst of the best
so far are not essential: candidates come from the others alone, and for a list that is not
essential the maxima of its blocks reject candidates before a block is unpacked. The best of
each shard (a heap of `limit` rows) meet in one window per item. No list is cut.

Defined results: a null or empty text, of a document or an item, has no terms; rows that
repeat a doc_id are documents of their own, with equal scores in any order; a null doc_id
comes last among equal scores; each row of items is a query of its own, also if it repeats an
item_id; other columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspark.llm.common import TEXT_BATCH_ROWS, shared_dir, with_row_id, written

BLOCK, LIMIT = 128, 20
#: Documents and terms (with repeats) of a shard, at most (one document at least).
SHARD_DOCS, SHARD_TERMS = 1 << 15, 1 << 21
#: Documents that are scored at once; items of a block.
SPAN, ITEM_BLOCK = 2048, 64

#: ASCII letters become lower case, what belongs to no term becomes a space.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TERMS).split()


class _Numbers(dict):
    """Gives each new key the next number."""

    def __missing__(self, key):
        n = self[key] = len(self)
        return n


def numbered_terms(terms: list[bytes], names: dict[bytes, int]) -> np.ndarray:
    return np.fromiter(map(names.__getitem__, terms), np.uint32, len(terms))


INDEX = pa.schema(
    [("shard", pa.int64()), ("term", pa.string()), ("df", pa.int64()), ("lasts", pa.binary()), ("widths", pa.binary()), ("best", pa.binary()), ("best_sizes", pa.binary()), ("blob", pa.binary())]
)
INDEX_DDL = "shard long, term string, df long, lasts binary, widths binary, best binary, best_sizes binary, blob binary"


def invert(docs: list[tuple], names: dict[bytes, int], shard: int) -> Iterator[pa.RecordBatch]:
    """Rows of the index for documents (doc_id, numbers of their terms).

    The row with a null term holds the documents: doc_ids (best: 1 if null) and lengths.
    """
    docs.sort(key=lambda d: (d[0] is None, d[0] or 0))
    sizes = np.array([len(t) for _, t in docs], np.int64)
    ids = np.concatenate([t for _, t in docs] or [np.zeros(0, np.int64)]).astype(np.int64)
    keys, tf = np.unique(ids * len(docs) + np.repeat(np.arange(len(docs)), sizes), return_counts=True)
    term, doc = np.divmod(keys, max(1, len(docs)))
    first = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.zeros(0, np.int64)
    counts = np.diff(np.r_[first, len(term)])
    # Blocks of BLOCK postings within each list.
    place = np.arange(len(term)) - np.repeat(first, counts)
    starts = np.flatnonzero(place % BLOCK == 0)
    ends = np.r_[starts[1:], len(term)]
    block = np.repeat(np.arange(len(starts)), ends - starts)
    gaps = np.where(place % BLOCK == 0, doc, np.diff(np.r_[0, doc]))
    lasts = doc[ends - 1].astype("<u2") if len(ends) else np.zeros(0, "<u2")
    wide_doc = np.maximum.reduceat(gaps, starts) > 255 if len(starts) else np.zeros(0, bool)
    top_tf = np.maximum.reduceat(tf, starts) if len(starts) else np.zeros(0, np.int64)
    widths = (wide_doc + 2 * (top_tf > 255)).astype(np.uint8)
    narrow, wide, tf1, tf4 = gaps.astype(np.uint8).tobytes(), gaps.astype("<u2").tobytes(), tf.astype(np.uint8).tobytes(), tf.astype("<u4").tobytes()
    packed = [
        (wide[2 * a : 2 * b] if w & 1 else narrow[a:b]) + (tf4[4 * a : 4 * b] if w & 2 else tf1[a:b])
        for a, b, w in zip(starts.tolist(), ends.tolist(), widths.tolist(), strict=True)
    ]
    # Pairs that no other pair of the block beats: by rising length, those with more occurrences than all before.
    length = sizes[doc]
    order = np.lexsort((-tf, length, block))
    height = tf[order] + block[order] * (int(tf.max(initial=0)) + 1)
    rises = np.r_[True, height[1:] > np.maximum.accumulate(height)[:-1]] if len(height) else np.zeros(0, bool)
    keep = order[rises]
    best = np.stack([tf[keep], length[keep]], axis=1).astype("<u4").tobytes()
    best_sizes = np.bincount(block[keep], minlength=len(starts))
    best_ends = np.cumsum(best_sizes)
    last_bytes, width_bytes, size_bytes = lasts.tobytes(), widths.tobytes(), (best_sizes - 1).astype(np.uint8).tobytes()
    # Blocks of each term, as slices.
    from_block = np.searchsorted(starts, first)
    to_block = np.r_[from_block[1:], len(starts)].tolist()
    from_block, best_from = from_block.tolist(), np.r_[0, best_ends].tolist()
    listed = list(names)
    ids_bytes = np.array([d if d is not None else 0 for d, _ in docs], "<i8").tobytes()
    nulls = bytes(d is None for d, _ in docs)
    rows = {k: [] for k in INDEX.names}

    def add(*row):
        for k, v in zip(INDEX.names, row, strict=True):
            rows[k].append(v)

    add(shard, None, int((sizes > 0).sum()), sizes.astype("<i8").tobytes(), None, nulls, None, ids_bytes)
    for t, n, a, b in zip(term[first].tolist(), counts.tolist(), from_block, to_block, strict=True):
        add(shard, listed[t].decode("utf-8", "replace"), n, last_bytes[2 * a : 2 * b], width_bytes[a:b], best[8 * best_from[a] : 8 * best_from[b]], size_bytes[a:b], b"".join(packed[a:b]))
        if len(rows["df"]) >= 10_000:
            yield pa.RecordBatch.from_pydict(rows, schema=INDEX)
            rows = {k: [] for k in INDEX.names}
    yield pa.RecordBatch.from_pydict(rows, schema=INDEX)


def build_index(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The index of all rows of docs (doc_id, text); written, to `path` if given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, names, held, size = None, _Numbers(), [], 0
        for batch in (whole.slice(at, TEXT_BATCH_ROWS) for whole in batches for at in range(0, whole.num_rows, TEXT_BATCH_ROWS)):
            for row, doc, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                terms = terms_of(text)
                if held and (len(held) >= SHARD_DOCS or size + len(terms) > SHARD_TERMS):
                    yield from invert(held, names, shard)
                    shard, names, held, size = None, _Numbers(), [], 0
                shard = row if shard is None else shard  # named by its first row: no other shard has it
                held.append((doc, numbered_terms(terms, names)))
                size += len(terms)
        if held:
            yield from invert(held, names, shard)

    rows = with_row_id(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    made = rows.select("_row", "doc_id", "text").mapInArrow(run, INDEX_DDL)
    path = path or shared_dir(docs.sparkSession, "index")
    made.write.parquet(path)
    return docs.sparkSession.read.schema(INDEX_DDL).parquet(path)


def statistics(index: DataFrame) -> tuple[int, int]:
    """(documents with a term, terms with repeats) over all shards."""
    lengths = index.where(F.col("term").isNull()).select("lasts").mapInArrow(_lengths, "n long, terms long")
    r = lengths.agg(F.sum("n").alias("n"), F.sum("terms").alias("terms")).first()
    return r["n"] or 0, r["terms"] or 0


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = [np.frombuffer(x, "<i8") for x in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([int((s > 0).sum()) for s in sizes], pa.int64()), pa.array([int(s.sum()) for s in sizes], pa.int64())], names=["n", "terms"])


def norm(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """How a document's length n weighs, in hundredths."""
    return 75 + 25 * n * n_docs // n_terms


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


class PostingList:
    """A term's postings in a shard, unpacked a block at a time."""

    def __init__(self, row, norms: np.ndarray, n_docs: int, n_terms: int):
        self.norms, self.blob = norms, row.blob
        self.lasts = np.frombuffer(row.lasts, "<u2").astype(np.int64)
        self.widths = np.frombuffer(row.widths, np.uint8)
        best = np.frombuffer(row.best, "<u4").astype(np.int64).reshape(-1, 2)
        sizes = np.frombuffer(row.best_sizes, np.uint8).astype(np.int64) + 1
        self.maxima = np.maximum.reduceat(impact(best[:, 0], norm(best[:, 1], n_docs, n_terms)), np.r_[0, np.cumsum(sizes)[:-1]])
        self.most = int(self.maxima.max())
        self.counts = np.full(len(self.lasts), BLOCK, np.int64)
        self.counts[-1] = int(row.df) - BLOCK * (len(self.lasts) - 1)
        self.at = np.r_[0, np.cumsum(self.counts * (1 + (self.widths & 1) + np.where(self.widths & 2, 4, 1)))]
        self.unpacked: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, impacts) of a block."""
        if k not in self.unpacked:
            n, w, data = int(self.counts[k]), self.widths[k], self.blob[self.at[k] : self.at[k + 1]]
            size = 2 * n if w & 1 else n
            doc = np.cumsum(np.frombuffer(data[:size], "<u2" if w & 1 else np.uint8).astype(np.int64))
            tf = np.frombuffer(data[size:], "<u4" if w & 2 else np.uint8).astype(np.int64)
            self.unpacked[k] = doc, impact(tf, self.norms[doc])
        return self.unpacked[k]

    def between(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, impacts) from low to below high; only blocks that reach in are unpacked."""
        a, b = np.searchsorted(self.lasts, (low, high))
        parts = [self.block(k) for k in range(a, min(b + 1, len(self.lasts)))]
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        doc, gain = (np.concatenate(x) for x in zip(*parts, strict=True)) if len(parts) > 1 else parts[0]
        a, b = np.searchsorted(doc, (low, high))
        return doc[a:b], gain[a:b]


def best_of_shard(lists: list[tuple[int, PostingList]], n_docs: int, limit: int = LIMIT, span: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of the best of a shard, best first. lists: (weight, postings).

    Documents come in ascending order, so of equal scores the first to come stays, and a
    candidate must beat the worst of the best so far.
    """
    lists = sorted(((w * p.most, w, p) for w, p in lists if w > 0), key=lambda x: x[0])
    bounds = np.cumsum([0] + [b for b, *_ in lists])  # bounds[k]: the most that the k least lists add together
    docs, scores, worst = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    for low in range(0, n_docs, span):
        high = min(n_docs, low + span)
        essential = int(np.searchsorted(bounds[1:], worst, side="right"))  # the lists below add at most `worst`
        if essential == len(lists):
            break  # nothing can beat the best any more
        total = np.zeros(high - low, np.int64)
        for _, w, p in lists[essential:]:
            doc, gain = p.between(low, high)
            total[doc - low] += w * gain
        found = np.flatnonzero(total)
        for k in range(essential - 1, -1, -1):
            found = found[total[found] + bounds[k + 1] > worst]
            if not len(found):
                break
            _, w, p = lists[k]
            at = np.searchsorted(p.lasts, found + low)
            inside = at < len(p.lasts)
            most = np.zeros(len(found), np.int64)
            most[inside] = w * p.maxima[at[inside]]
            may = total[found] + most + bounds[k] > worst  # a block's maximum rejects before it is unpacked
            found, at = found[may], at[may]
            for b in np.unique(at[at < len(p.lasts)]).tolist():
                doc, gain = p.block(b)
                mine = found[at == b] + low
                where = np.minimum(np.searchsorted(doc, mine), len(doc) - 1)
                hit = doc[where] == mine
                total[mine[hit] - low] += w * gain[where[hit]]
        found = found[total[found] > worst]
        if len(found):
            docs, scores = np.r_[docs, found + low], np.r_[scores, total[found]]
            order = np.lexsort((docs, -scores))[:limit]
            docs, scores = docs[order], scores[order]
            worst = int(scores[-1]) if len(scores) == limit else 0
    return docs, scores


def asked_terms(items: DataFrame) -> DataFrame:
    """_item, item_id, part (its block of items), term, n: the terms of items with their repeats; written."""
    schema = pa.schema([("_item", pa.int64()), ("item_id", pa.int64()), ("term", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, name, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                terms = [t.decode("utf-8", "replace") for t in terms_of(text)]
                if terms:
                    yield pa.RecordBatch.from_arrays([pa.array([v] * len(terms), t) for v, t in ((item, pa.int64()), (name, pa.int64()))] + [pa.array(terms)], schema=schema)

    rows = with_row_id(items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")), "_item")
    found = rows.select("_item", "item_id", "text").mapInArrow(run, "_item long, item_id long, term string")
    found = found.groupBy("_item", "item_id", "term").agg(F.count("*").alias("n"))
    # Row numbers within a part of the input are dense, so blocks of them hold ITEM_BLOCK items at most.
    return written(found.withColumn("part", F.floor(F.col("_item") / ITEM_BLOCK).cast("long")), "asked")


def search(index: DataFrame, items: DataFrame, limit: int = LIMIT) -> DataFrame:
    """item_id, rank, doc_id, score: the best documents of each item."""
    schema = "_item long, item_id long, doc_id long, nameless boolean, score long"
    n_docs, n_terms = statistics(index)
    asked = asked_terms(items)
    wanted = written(asked.groupBy("term").agg(F.collect_set("part").alias("parts")), "terms")
    # Of the index only the lists that are asked for; df over all shards.
    lists = written(index.where(F.col("term").isNotNull()).join(wanted, "term").select(*INDEX.names, "parts"), "lists")
    frequent = lists.groupBy("term").agg(F.sum("df").alias("all_df"))
    weight = F.floor(1000 * F.log((2.0 * n_docs + 2) / (2 * F.col("all_df") + 1))).cast("long")
    weights = asked.join(frequent, "term").select("part", "_item", "item_id", "term", (F.col("n") * weight).alias("w"))
    # The documents of a shard go where its lists go, and so do the items of a block.
    pairs = written(lists.select("shard", F.explode("parts").alias("part")).distinct(), "pairs")
    dealt = lists.select(*INDEX.names, F.explode("parts").alias("part"))
    heads = index.where(F.col("term").isNull()).join(pairs, "shard").select(*INDEX.names, "part")
    queries = written(weights.where("w > 0"), "weights").join(pairs, "part")

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = {r.term: r for r in left.itertuples(index=False)}
        head = rows.pop(None, None)
        if head is None or right.empty:
            return pd.DataFrame(columns=["_item", "item_id", "doc_id", "nameless", "score"])
        sizes, ids = np.frombuffer(head.lasts, "<i8"), np.frombuffer(head.blob, "<i8")
        nulls, norms = np.frombuffer(head.best, np.uint8) > 0, norm(sizes, n_docs, n_terms)
        made: dict[str, PostingList] = {}
        parts = []
        for item, own in right.groupby("_item"):
            lists = []
            for term, w in zip(own["term"], own["w"].tolist(), strict=True):
                if term in rows:
                    if term not in made:
                        made[term] = PostingList(rows[term], norms, n_docs, n_terms)
                    lists.append((w, made[term]))
            docs, scores = best_of_shard(lists, len(ids), limit)
            name = own["item_id"].iloc[0]
            parts.append(pd.DataFrame({"_item": item, "item_id": pd.array([None if pd.isna(name) else int(name)] * len(docs), "Int64"), "doc_id": pd.array(np.where(nulls[docs], 0, ids[docs]), "Int64"), "nameless": nulls[docs], "score": scores}))
        return pd.concat(parts)

    found = dealt.unionByName(heads).groupBy("shard", "part").cogroup(queries.groupBy("shard", "part")).applyInPandas(run, schema)
    doc = F.when(~F.col("nameless"), F.col("doc_id"))
    best = written(found.select("_item", "item_id", doc.alias("doc_id"), "score"), "best")
    rank = F.row_number().over(Window.partitionBy("_item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return best.withColumn("rank", rank).where(F.col("rank") <= limit).select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The best documents of each item, over all documents."""
    return search(build_index(docs), items, limit)
