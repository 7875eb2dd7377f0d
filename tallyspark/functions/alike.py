"""Words that are alike, met in sorted runs of keys without listing all pairs.

Words of 4 to SHORTENED letters meet on what is left of them without the letters that may differ
(of just the length that the pair's ratio asks for). Rows of both sides are dealt and sorted by key; a run is
worked on in arrays, and only what is asked of its pairs leaves the task: sums, or the pairs that pass a filter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache, lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

SHORT_RATIO, LONG_RATIO, SHORT_WORD, SHORTENED = 90, 82, 6, 12
#: Pairs compared at once; alike words of a run that are listed; words whose absence is counted in a filter; rows of a
#: word from which on it is told apart whether any word is near it.
PIECE, LISTED, CLASSES, COMMON = 100_000, 8, 64, 100


@cache
def needed(n: int, m: int) -> int:
    """Common letters that two words of n and m letters need."""
    return -(-(SHORT_RATIO if min(n, m) < SHORT_WORD else LONG_RATIO) * (n + m) // 200)


def feasible(n: int, m: int) -> bool:
    return min(n, m) >= 4 and needed(n, m) <= min(n, m)


def common(a: str, b: str) -> int:
    masks: dict[str, int] = {}
    for place, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << place
    inside = state = (1 << len(a)) - 1
    for c in b:
        m = masks.get(c, 0)
        state = ((state + (state & m)) | (state & ~m)) & inside
    return len(a) - state.bit_count()


@lru_cache(200_000)
def hit(q: str, w: str) -> bool:
    """match.token_hit of two words."""
    if (len(q) >= 4 and w.startswith(q)) or (len(w) >= 5 and q.startswith(w)):
        return True
    return feasible(len(q), len(w)) and common(q, w) >= needed(len(q), len(w))


@F.pandas_udf(ArrayType(StringType()))
def found_of(asked, stems):
    """Those of the asked words that one of the stems is a hit for."""
    import pandas as pd

    return pd.Series([[q for q in a if any(hit(q, w) for w in s)] if len(a) else [] for a, s in zip(asked, stems, strict=True)], dtype=object)


@cache
def _least_common(n: int, m: int, n_over: int, m_over: int) -> int:
    """The fewest common letters of two words of n and m letters that one word may hit, at least one of them not by
    its beginning. n_over, m_over: length of the longest word that begins with them."""
    out = min(n, m) + 1
    for q in range(4, int(1.45 * max(n, m)) + 2):
        near_n, near_m = feasible(q, n), feasible(q, m)
        if near_n and near_m:
            out = min(out, needed(q, n) + needed(q, m) - q)
        if near_n:
            out = min(out, needed(q, n)) if q <= m else min(out, m + needed(q, n) - q) if q <= m_over else out
        if near_m:
            out = min(out, needed(q, m)) if q <= n else min(out, n + needed(q, m) - q) if q <= n_over else out
    return out


def may_share(w: str, p: str, w_over: int, p_over: int) -> bool:
    """Whether some word may hit both (false only if none can)."""
    return w[:4] == p[:4] or common(w, p) >= _least_common(len(w), len(p), w_over, p_over)


_APART = ArrayType(StructType([StructField("w", StringType()), StructField("before", ArrayType(StringType()))]))


@F.pandas_udf(_APART)
def apart(words):
    """For each word of a name (struct w, n, over), the commoner words of the name that may be hit along with it."""
    import pandas as pd

    def one(row):
        order = sorted(((r["w"], int(r["n"]), int(r["over"])) for r in row), key=lambda r: (-r[1], r[0]))
        return [{"w": w, "before": [p for p, _, p_over in order[:k] if may_share(w, p, w_over, p_over)]} for k, (w, _, w_over) in enumerate(order)]

    return pd.Series([one(r) for r in words], dtype=object)


@F.pandas_udf(LongType())
def counted_before(q, sets):
    """How many rows of the sets (struct before, n) are counted at a commoner word that q hits too."""
    import pandas as pd

    return pd.Series([sum(int(s["n"]) for s in (row if row is not None else ()) if any(hit(x, p) for p in s["before"])) for x, row in zip(q, sets, strict=True)], dtype="int64")


@cache
def _left(n: int, c: int) -> np.ndarray:
    return np.array(list(combinations(range(n), c)), np.int16)


_FACTORS = np.random.default_rng(11).integers(1, 2**63, SHORTENED + 1, np.uint64) * np.uint64(2) + np.uint64(1)


def _codes(words: list[str]) -> np.ndarray:
    return np.array(words, f"U{SHORTENED}").view(np.uint32).reshape(len(words), SHORTENED)


def _hashes(codes: np.ndarray, n: int, c: int) -> np.ndarray:
    """Of words of n letters (rows of codes): a hash of each choice of c letters."""
    out = np.full((len(codes), len(_left(n, c))), np.uint64(c), np.uint64)
    for j in range(c):
        out += codes[:, _left(n, c)[:, j]].astype(np.uint64) * _FACTORS[j]
    return out ^ (out >> np.uint64(32))


def keyed(df: DataFrame, word: str, others: list[int]) -> DataFrame:
    """df with a row for each key (key, c, at) on which its word may meet words of the other lengths."""
    schema = StructType([StructField("key", LongType()), StructField("c", LongType()), StructField("at", LongType()), *df.schema.fields])
    lengths = {n: sorted({needed(n, m) for m in others if m <= SHORTENED and feasible(n, m)}) for n in range(4, SHORTENED + 1)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(batch.schema.get_field_index(word)).to_pylist()
            size = np.array([len(w) for w in words])
            for n, cs in lengths.items():
                rows = np.flatnonzero(size == n)
                for start in range(0, len(rows), 2000):
                    some = rows[start : start + 2000]
                    codes = _codes([words[r] for r in some])
                    for c in cs:
                        h = _hashes(codes, n, c)
                        at = np.argsort(h, axis=1, kind="stable")
                        h = np.take_along_axis(h, at, 1)
                        new = np.ones(h.shape, bool)
                        new[:, 1:] = h[:, 1:] != h[:, :-1]
                        r, k = np.nonzero(new)
                        taken = batch.take(pa.array(some[r]))
                        yield pa.RecordBatch.from_arrays([pa.array(h[r, k].view(np.int64)), pa.array(np.full(len(r), c, np.int64)), pa.array(at[r, k].astype(np.int64)), *taken.columns], names=schema.names)

    return df.mapInArrow(run, schema)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole runs of a key, many at once."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        keys = batch.column(0).to_numpy()
        if not len(keys):
            continue
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut == 0 and held and held[-1].column(0)[-1].as_py() == keys[0]:
            held.append(batch)
            continue
        if cut:
            held.append(batch.slice(0, cut))
        if held:
            yield pa.Table.from_batches(held).combine_chunks()
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _numbered(column: pa.ChunkedArray) -> tuple[np.ndarray, list]:
    """The distinct values of a column, and which of them each row has (-1: null)."""
    column = column.combine_chunks()
    codes = (column.chunk(0) if isinstance(column, pa.ChunkedArray) else column).dictionary_encode()
    return codes.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), codes.dictionary.to_pylist()


def _meetings(table: pa.Table, asked: np.ndarray, useful: Callable | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of asked words and of items' words that are alike but do not begin with each other; each pair of words once.

    useful: which pairs of rows are worth a look at their words."""
    key, c, at = (table.column(i).to_numpy() for i in ("key", "c", "at"))
    of, words = _numbered(table.column("word"))
    codes, size = _codes(words)[of], np.array([len(w) for w in words])[of]
    for n in np.unique(size[asked]).tolist():
        for m in np.unique(size[~asked]).tolist():
            if not feasible(n, m):
                continue
            need = needed(n, m)
            qs, ws = np.flatnonzero(asked & (size == n) & (c == need)), np.flatnonzero(~asked & (size == m) & (c == need))
            low, high = np.searchsorted(key[ws], key[qs]), np.searchsorted(key[ws], key[qs], "right")
            qs, low, high = (x[high > low] for x in (qs, low, high))
            if not len(qs):
                continue
            hq, hw = _hashes(codes[qs], n, need), _hashes(codes[ws], m, need)
            ends = np.cumsum(high - low)
            start = 0
            while start < len(qs):
                stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PIECE, "right")))
                many = (high - low)[start:stop]
                q = np.repeat(np.arange(start, stop), many)
                w = np.arange(len(q)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low[start:stop], many)
                start = stop
                if useful is not None:
                    some = useful(qs[q], ws[w])
                    q, w = q[some], w[some]
                a, b = codes[qs[q]], codes[ws[w]]
                short = min(n, m)
                keep = (a[:, :short] != b[:, :short]).any(1) if n <= m or m >= 5 else np.ones(len(q), bool)
                q, w, a, b = q[keep], w[keep], a[keep], b[keep]
                same = np.take_along_axis(a, _left(n, need)[at[qs[q]]].astype(np.int64), 1) == np.take_along_axis(b, _left(m, need)[at[ws[w]]].astype(np.int64), 1)
                keep = same.all(1)
                q, w = q[keep], w[keep]
                here = key[qs[q]].view(np.uint64)
                first = np.ones(len(q), bool)  # the least of the keys that a pair shares
                mine = hq[q]
                for j in range(hw.shape[1]):
                    other = hw[w, j]
                    less = np.flatnonzero(other < here)
                    first[less[(mine[less] == other[less, None]).any(1)]] = False
                yield qs[q[first]], ws[w[first]]


def _dealt(queries: DataFrame, items: DataFrame) -> DataFrame:
    both = queries.unionByName(items, allowMissingColumns=True)
    return both.repartition(int(both.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key").sortWithinPartitions("key")


def lengths_of(df: DataFrame, word: str) -> list[int]:
    return [r[0] for r in df.where(F.length(word).between(4, SHORTENED)).select(F.length(word)).distinct().collect()]  # at most nine rows


def near_counts(queries: DataFrame, items: DataFrame) -> DataFrame:
    """q, found, words, more: rows of the catalogue by words near q, in parts; the words unless they are many (more).
    Rows without q list words of more than COMMON rows that are near some q.

    queries: word; items: word, n, sets (before, n), both distinct by word."""
    q_long, w_long = lengths_of(queries, "word"), lengths_of(items, "word")
    both = _dealt(keyed(queries.withColumn("asked", F.lit(True)), "word", w_long), keyed(items.withColumn("asked", F.lit(False)), "word", q_long))
    schema = StructType([StructField("q", StringType()), StructField("found", LongType()), StructField("words", ArrayType(StringType())), StructField("more", BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches):
            asked = table.column("asked").to_numpy()
            if asked.all() or not asked.any():
                continue
            n = table.column("n").fill_null(0).to_numpy()
            words, sets = table.column("word"), table.column("sets")
            plain = pa.array(words.to_pylist(), pa.string())
            marked = sets.is_valid().to_numpy()
            for q, w in _meetings(table, asked):
                if not len(q):
                    continue
                rows = n[w]
                for k in np.flatnonzero(marked[w]).tolist():
                    x = words[int(q[k])].as_py()
                    rows[k] -= sum(s["n"] for s in sets[int(w[k])].as_py() if any(hit(x, p) for p in s["before"]))
                starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
                many = np.diff(np.r_[starts, len(q)])
                few = many <= LISTED
                shown = plain.take(pa.array(w[np.repeat(few, many)]))
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.where(few, many, 0))].astype(np.int32)), shown)
                yield pa.RecordBatch.from_arrays([plain.take(pa.array(q[starts])), pa.array(np.add.reduceat(rows, starts)), lists, pa.array(~few)], names=schema.names)
                often = np.unique(w[n[w] > COMMON])
                if len(often):
                    yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.array([0]), pa.array([list({words[int(k)].as_py() for k in often})], pa.list_(pa.string())), pa.array([False])], names=schema.names)

    return both.mapInArrow(run, schema)


def _named(column: pa.ChunkedArray) -> np.ndarray:
    """A number for each distinct text, -1 for empty ones and nulls."""
    at, texts = _numbered(column)
    return np.where(np.isin(at, [k for k, x in enumerate(texts) if x == ""]), -1, at)


def _places(column: pa.ChunkedArray, missing: int) -> tuple[np.ndarray, np.ndarray]:
    """length and ord of structs."""
    parts = column.combine_chunks()
    parts = parts.chunk(0) if isinstance(parts, pa.ChunkedArray) else parts
    return tuple(x.fill_null(missing).to_numpy(zero_copy_only=False).astype(np.int64) for x in parts.flatten())


def near_pairs(queries: DataFrame, items: DataFrame) -> DataFrame:
    """qid, iid, need: pairs that meet on alike words, unless the other words that an item lacks weigh more than the query can spare.

    queries: word, qid, need, spare, spare_apart (of an item of another unit), unit, action, most (struct length, ord: an item that
    comes after it is of no use; null: all are), others, weights; items: word, iid, unit, action, place (struct length, ord), others.
    others are joined by spaces; a word has the same weight in all queries. Items of another action are left out. Empty units and actions are like any other."""
    q_long, w_long = lengths_of(queries, "word"), lengths_of(items, "word")
    both = _dealt(keyed(queries.withColumn("asked", F.lit(True)), "word", w_long), keyed(items.withColumn("asked", F.lit(False)), "word", q_long))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches):
            asked = table.column("asked").to_numpy()
            if asked.all() or not asked.any():
                continue
            qid, iid, need, spare = (table.column(i).fill_null(0).to_numpy() for i in ("qid", "iid", "need", "spare"))
            apart = table.column("spare_apart").fill_null(0).to_numpy()
            unit, action = (_named(table.column(c)) for c in ("unit", "action"))
            length, ord_ = _places(table.column("place"), np.iinfo(np.int64).min)
            most_length, most_ord = _places(table.column("most"), np.iinfo(np.int64).max)
            of, lists = _numbered(table.column("others"))  # many rows have the same ones
            others, asks = [x.split(" ") if x else [] for x in lists], np.flatnonzero(asked)
            kinds, first, many = np.unique(of[asks], return_index=True, return_counts=True)
            count: dict[str, int] = {}
            for k, n in zip(kinds.tolist(), many.tolist(), strict=True):
                for t in others[k]:
                    count[t] = count.get(t, 0) + n
            classes = {t: k for k, t in enumerate(sorted(count, key=lambda t: -count[t])[:CLASSES])}  # the absence of others is not looked at
            lost, held = np.zeros((len(lists), len(classes)), np.float32), np.zeros((len(lists), len(classes)), bool)
            for k, weights in zip(kinds.tolist(), table.column("weights").take(pa.array(asks[first])).to_pylist(), strict=True):
                for t, x in zip(others[k], weights, strict=True):  # a word has one weight
                    if t in classes:
                        lost[k, classes[t]] += x
            has: dict[str, np.ndarray] = {}
            for k in np.unique(of[~asked]).tolist():
                for w in others[k]:
                    if w not in has:
                        has[w] = np.array([hit(t, w) for t in classes], bool)
                    held[k] |= has[w]

            differ = lambda x, q, w: (x[q] >= 0) & (x[w] >= 0) & (x[q] != x[w])

            def useful(q, w):
                in_time = (length[w] < most_length[q]) | ((length[w] == most_length[q]) & (ord_[w] <= most_ord[q]))  # noqa: B023
                return in_time & ~differ(action, q, w) & (~differ(unit, q, w) | (apart[q] >= -1e-4))  # noqa: B023

            for q, w in _meetings(table, asked, useful):
                keep = (lost[of[q]] * ~held[of[w]]).sum(1) <= np.where(differ(unit, q, w), apart[q], spare[q]) + 1e-4
                if keep.any():
                    yield pa.RecordBatch.from_arrays([pa.array(qid[q[keep]].astype(np.int64)), pa.array(iid[w[keep]].astype(np.int64)), pa.array(need[q[keep]])], names=["qid", "iid", "need"])

    return both.mapInArrow(run, "qid long, iid long, need double")
