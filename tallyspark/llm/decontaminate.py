"""Benchmark decontamination by greedy string tiling.

Texts become words (lower case, runs of word characters). Documents and benchmark items
that share a seed, a window of MIN_MATCH words, are candidates; a running Karp-Rabin hash
finds the seeds. For each candidate pair the longest common word sequence that is not
marked yet is marked as a tile again and again, down to MIN_MATCH words, so passages are
found in any order. A document is contaminated by an item if its tiles cover COVERAGE of
the item's words.

How it is dealt: the seeds of the benchmark set bits in a field of fixed size (16 MiB),
which goes to all tasks; windows of documents that miss it cannot be seeds. Only the
stretches of a document made of possible seeds travel further, and they meet the items in
joins on seeds. Of an item, the most frequent seeds that together cover less than COVERAGE
of its words make no candidates: a document that shares no other seed cannot reach the
threshold. So a phrase that all items share does not pair everything with everything, and
nothing is lost. Words are compared themselves; hashes only propose. Items of equal words
are tiled once and get their ids back at the end.

Defined results: null texts count as empty and so do items without words, which are not looked
for; an item of fewer than MIN_MATCH words is looked for as a whole, in one tile; rows that repeat an id count as rows of their own (a pair is then reported
again); null ids stay null; other columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import heapq
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import by_batch, free_name, identified, record, with_row_id, written

MIN_MATCH, COVERAGE = 5, 0.5
#: Matches of two texts that are listed, for each of their words; beyond, places take turns (see _Level).
PAIRS_A_WORD = 4
#: The field has 2**FIELD_BITS bits and is put together from blocks of 2**BLOCK_BITS.
FIELD_BITS, BLOCK_BITS = 27, 19

_GAP = re.compile(r"\W+")
_BASE, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def words_of(text: str | None) -> list[str]:
    return _GAP.sub(" ", (text or "").lower()).split()


def seed_hashes(words: list[str], width: int = MIN_MATCH) -> np.ndarray:
    """A hash for each window of so many words, all by running sums."""
    n = len(words)
    if n < width:
        return np.zeros(0, np.uint64)
    data = " ".join(words).encode("utf-8", "surrogatepass")
    raw = np.frombuffer(data, np.uint8)
    ends = np.r_[np.flatnonzero(raw == 32), len(raw)]
    starts = np.r_[0, ends[:-1] + 1]
    # Karp-Rabin within words: the place in the word is the exponent, taken by a table.
    sizes = ends - starts
    place = np.arange(len(raw)) - np.repeat(starts, np.r_[sizes[:-1] + 1, sizes[-1]])
    powers = np.cumprod(np.full(max(1, int(sizes.max()) + 1), _BASE, np.uint64))
    sums = np.r_[np.uint64(0), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers[np.minimum(place, len(powers) - 1)])]
    word = sums[ends] - sums[starts]
    word ^= word >> np.uint64(29)
    word *= _STEP
    out = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        out = out * _BASE + word[k : n - width + 1 + k]
    out ^= out >> np.uint64(32)
    out *= _STEP
    return out ^ (out >> np.uint64(29))


def tiles(a: list, b: list, least: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in a, start in b, length), longest first.

    Of equally long matches, the first in a, then the first in b, is marked first. None in a
    or b matches nothing.
    """
    ids: dict = {}
    x, y = (np.array([0 if w is None else ids.setdefault(w, len(ids) + 1) for w in words], np.int64) for words in (a, b))
    marked_x, marked_y, out = bytearray(len(a)), bytearray(len(b)), []
    size = least
    while size * 2 <= min(len(a), len(b)):
        size *= 2
    while True:
        found, at = _matches(x, y, size, PAIRS_A_WORD * (len(a) + len(b)) + 4096), 0
        if found is None:
            _Level(x, y, size).mark(marked_x, marked_y, out)
            found = []
        rest: list[tuple[int, int, int]] = []  # a heap of what is left of matches between marks
        while at < len(found) or rest:
            if rest and (at == len(found) or rest[0] < found[at]):
                n, i, j = heapq.heappop(rest)
            else:
                n, i, j = found[at]
                at += 1
            n = -n
            if marked_x.find(1, i, i + n) < 0 and marked_y.find(1, j, j + n) < 0:
                out.append((i, j, n))
                marked_x[i : i + n] = marked_y[j : j + n] = b"\1" * n
                x[i : i + n] = y[j : j + n] = 0
                if marked_y.find(0) < 0:
                    return out
                continue
            busy = np.frombuffer(marked_x[i : i + n], np.uint8) | np.frombuffer(marked_y[j : j + n], np.uint8)
            edges = np.flatnonzero(np.diff(np.r_[1, busy, 1])).tolist()  # where free stretches begin and end
            for start, end in zip(edges[::2], edges[1::2], strict=True):
                if end - start >= size:
                    heapq.heappush(rest, (start - end, i + start, j + start))
        if size <= least or marked_y.find(0) < 0:
            return out
        size = max(least, size // 2)


class _Level:
    """Matches of size to 2 size - 1 words where phrases repeat so often that their pairs cannot
    be listed: each place in x keeps a bound of its longest match, and only the place whose turn
    it is looks for partners, by running hashes of any length. No longer matches may be left."""

    def __init__(self, x: np.ndarray, y: np.ndarray, size: int):
        self.x, self.y, self.size = x, y, size
        (i, hi), (j, hj) = _windows(x, size), _windows(y, size)
        _, code = np.unique(np.r_[hi, hj], return_inverse=True)
        ci, cj = code[: len(i)], code[len(i) :]
        order = np.argsort(cj, kind="stable")
        j, cj = j[order], cj[order]
        cut = np.flatnonzero(np.diff(cj)) + 1
        self.places = dict(zip(cj[np.r_[0, cut]].tolist(), np.split(j, cut), strict=True)) if len(j) else {}
        shared = np.isin(ci, cj)
        self.code = dict(zip(i[shared].tolist(), ci[shared].tolist(), strict=True))
        powers = np.cumprod(np.r_[np.uint64(1), np.full(max(len(x), len(y)), _BASE)])
        self.inverse = np.cumprod(np.r_[np.uint64(1), np.full(max(len(x), len(y)), np.uint64(pow(int(_BASE), -1, 1 << 64)))])
        self.sums = [np.r_[np.uint64(0), np.cumsum((w.astype(np.uint64) * _STEP ^ (w.astype(np.uint64) * _STEP) >> np.uint64(32)) * powers[: len(w)])] for w in (x, y)]
        self.runs = [self._runs(w) for w in (x, y)]

    @staticmethod
    def _runs(w: np.ndarray) -> np.ndarray:
        """How many free words follow from each place on."""
        ends = np.flatnonzero(np.r_[w == 0, True])
        return ends[np.searchsorted(ends, np.arange(len(w)))] - np.arange(len(w))

    def _hash(self, side: int, at, n: int):
        return (self.sums[side][at + n] - self.sums[side][at]) * self.inverse[at]

    def partner(self, i: int, n: int) -> int | None:
        """The first free place in y of the n words at i."""
        js = self.places[self.code[i]]
        js = js[(self.runs[1][js] >= n)]
        for j in js[self._hash(1, js, n) == self._hash(0, np.array([i]), n)].tolist():
            if (self.x[i : i + n] == self.y[j : j + n]).all():  # words themselves are compared
                return j
        return None

    def longest(self, i: int, most: int) -> int:
        """Words of the longest free match at i, at most so many; 0 if under size."""
        js = self.places[self.code[i]]
        js = self.places[self.code[i]] = js[self.runs[1][js] >= self.size]  # runs only shrink
        low, high = self.size - 1, most
        while low < high and len(js):
            mid = (low + high + 1) // 2
            js_mid = js[self.runs[1][js] >= mid]
            hit = self._hash(1, js_mid, mid) == self._hash(0, np.array([i]), mid)
            if hit.any():
                low, js = mid, js_mid[hit]
            else:
                high = mid - 1
        return low if low >= self.size and len(js) else 0

    def mark(self, marked_x: bytearray, marked_y: bytearray, out: list[tuple[int, int, int]]) -> None:
        runs_x, runs_y = self.runs
        heap = [(-min(2 * self.size - 1, int(runs_x[i])), i) for i in self.code]
        heapq.heapify(heap)
        while heap:
            bound, i = heapq.heappop(heap)
            most = min(-bound, int(runs_x[i]))
            n = self.longest(i, most) if most >= self.size else 0
            if n < -bound:
                if n:
                    heapq.heappush(heap, (-n, i))
                continue
            j = self.partner(i, n)
            if j is None:  # hashes were equal, words were not
                if n > self.size:
                    heapq.heappush(heap, (1 - n, i))
                continue
            out.append((i, j, n))
            for words, runs, marked, at in ((self.x, runs_x, marked_x, i), (self.y, runs_y, marked_y, j)):
                marked[at : at + n] = b"\1" * n
                words[at : at + n] = 0
                runs[at : at + n] = 0
                start = marked.rfind(1, 0, at) + 1
                runs[start:at] = np.minimum(runs[start:at], np.arange(at - start, 0, -1))
            if marked_y.find(0) < 0:
                return


def _windows(x: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows of so many words (ids above 0) and their Karp-Rabin hashes."""
    n = len(x) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = x.astype(np.uint64) * _STEP
    h ^= h >> np.uint64(32)
    out, done, width, power = np.zeros(n, np.uint64), 0, 1, int(_BASE)
    while True:  # windows of doubling width, put together to one of `size`
        if size & width:
            out = out * np.uint64(power) + h[done : done + n]
            done += width
        if done == size:
            break
        h = h[:-width] * np.uint64(power) + h[width:]
        width, power = 2 * width, power * power & (1 << 64) - 1
    gaps = np.cumsum(np.r_[0, x == 0])
    at = np.flatnonzero(gaps[size:] == gaps[:-size])
    return at, out[at]


def _matches(x: np.ndarray, y: np.ndarray, size: int, most: int) -> list[tuple[int, int, int]] | None:
    """(-length, i, j), in order, of the maximal matches of size or more words; 0 matches nothing.
    None if there are more than `most`.

    Equal windows are paired only where the words before them differ or are marked, so words
    and phrases that repeat give one pair for each maximal match, not for each pair of places.
    """
    (i, hi), (j, hj) = _windows(x, size), _windows(y, size)
    _, code = np.unique(np.r_[hi, hj], return_inverse=True)
    ci, cj = code[: len(i)], code[len(i) :]
    i, ci = i[np.isin(ci, cj)], ci[np.isin(ci, cj)]
    j, cj = j[np.isin(cj, ci)], cj[np.isin(cj, ci)]
    if not len(i):
        return []
    words = int(max(x.max(), y.max())) + 1
    before = np.r_[0, y][j]
    key = ci * words + np.r_[0, x][i]
    order = np.lexsort((i, key))
    i, key = i[order], key[order]
    low, high = np.searchsorted(key, cj * words), np.searchsorted(key, (cj + 1) * words)
    same, other = (np.where(before > 0, np.searchsorted(key, cj * words + before, side), high) for side in ("left", "right"))
    start, n, j = np.r_[low, other], np.r_[same - low, high - other], np.r_[j, j]
    if n.sum() > most:
        return None
    found, x, y = [], np.r_[x, 0], np.r_[y, 0]
    for part in np.split(np.arange(len(n)), np.flatnonzero(np.diff(np.cumsum(n) >> 20)) + 1):
        k = np.repeat(start[part] - np.cumsum(n[part]) + n[part], n[part]) + np.arange(n[part].sum())
        a, b = i[k], np.repeat(j[part], n[part])
        length, on = np.zeros(len(a), np.int64), np.arange(len(a))
        while len(on):  # words themselves are compared
            p, q = x[a[on] + length[on]], y[b[on] + length[on]]
            on = on[(p == q) & (p > 0)]
            length[on] += 1
        long = length >= size
        found.append(np.stack([-length[long], a[long], b[long]]))
    found = np.concatenate(found, axis=1)
    return [tuple(r) for r in found[:, np.lexsort(found[::-1])].T.tolist()]


def common_seeds(n_words: int, hashes: list[int], items: list[int], coverage: float, width: int = MIN_MATCH) -> list[int]:
    """The seeds of an item that make candidates: all but the most frequent ones that
    together cover too few words to reach the coverage."""
    need, n = int(np.ceil(coverage * n_words - 1e-9)), 0
    covered, left = bytearray(n_words), set()
    for i in sorted(range(len(hashes)), key=lambda i: (-items[i], i)):
        more = covered.count(0, i, i + width)
        if n + more >= need:
            left.add(hashes[i])
        else:
            covered[i : i + width] = b"\1" * width
            n += more
    return sorted(left)


def seed_width(words: list[str]) -> int:
    """Words of an item's seeds and tiles, at least: an item of fewer than MIN_MATCH words counts as a whole."""
    return min(MIN_MATCH, max(1, len(words)))


def _signed(x: np.ndarray) -> list[int]:
    return x.view(np.int64).tolist()


def _items(benchmark: DataFrame, coverage: float) -> tuple[DataFrame, DataFrame]:
    """(members: _item, item_id, a row per row of benchmark; items: _item, words, seeds (all),
    makers (those that make candidates), a row per distinct list of words); written.

    _item is a hash of the words, 128 bits wide.
    """
    schema = {"item_id": pa.int64(), "_item": pa.binary(), "words": pa.list_(pa.string()), "seeds": pa.list_(pa.int64())}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = [words_of(t) for t in batch.column("text").to_pylist()]
        names = [xxhash.xxh3_128_digest(" ".join(w).encode("utf-8", "surrogatepass")) for w in words]
        return record(schema, item_id=batch.column("item_id"), _item=names, words=words, seeds=[_signed(seed_hashes(w, seed_width(w))) for w in words])

    texts = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    rows = written(by_batch(texts, run, "item_id long, _item binary, words array<string>, seeds array<long>").where(F.size("seeds") > 0), "items")
    items = written(rows.groupBy("_item").agg(F.first("words").alias("words"), F.first("seeds").alias("seeds")), "items")
    frequent = items.select(F.explode(F.array_distinct("seeds")).alias("seed")).groupBy("seed").count()
    ranked = (
        items.select("_item", F.posexplode("seeds").alias("at", "seed")).join(frequent, "seed")
        .groupBy("_item").agg(F.array_sort(F.collect_list(F.struct("at", F.col("count").alias("n")))).alias("f"))
    )

    def pick(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = batch.to_pylist()
        makers = [common_seeds(len(r["words"]), r["seeds"], [x["n"] for x in r["f"]], coverage, seed_width(r["words"])) for r in rows]
        return pa.RecordBatch.from_arrays([batch.column(k) for k in ("_item", "words", "seeds")] + [pa.array(makers, pa.list_(pa.int64()))], names=["_item", "words", "seeds", "makers"])

    joined = items.join(ranked, "_item").select("_item", "words", "seeds", "f")
    return rows.select("_item", "item_id"), written(by_batch(joined, pick, "_item binary, words array<string>, seeds array<long>, makers array<long>"), "items")


def bit_field(seeds: DataFrame) -> np.ndarray:
    """The seeds' bits, put together from at most 2**(FIELD_BITS - BLOCK_BITS) blocks: 16 MiB."""
    place = F.pmod(F.col("seed"), F.lit(1 << FIELD_BITS))

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(1 << BLOCK_BITS, bool)
        bits[pdf["place"].to_numpy() & ((1 << BLOCK_BITS) - 1)] = True
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "bits": [np.packbits(bits).tobytes()]})

    places = seeds.select(place.alias("place")).distinct().withColumn("block", F.shiftright("place", BLOCK_BITS))
    field = np.zeros(1 << (FIELD_BITS - 3), np.uint8)
    size = 1 << (BLOCK_BITS - 3)
    for r in places.groupBy("block").applyInPandas(block, "block long, bits binary").toLocalIterator():
        field[r["block"] * size : (r["block"] + 1) * size] = np.frombuffer(r["bits"], np.uint8)
    return field


def _stretches(docs: DataFrame, field: np.ndarray, widths: list[int]) -> DataFrame:
    """_row, doc_id, start, words, seeds: stretches of documents made of possible seeds of these widths; written."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    names = {"_row": pa.int64(), "doc_id": pa.int64(), "start": pa.int32(), "words": pa.list_(pa.string()), "seeds": pa.list_(pa.int64())}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bits, out = shared.value, {k: [] for k in names}
        for row, doc, text in zip(*(batch.column(k).to_pylist() for k in ("_row", "doc_id", "text")), strict=True):
            words = words_of(text)
            starts, ends, found = [], [], []
            for width in widths:
                h = seed_hashes(words, width)
                at = (h & np.uint64((1 << FIELD_BITS) - 1)).astype(np.int64)
                hits = np.flatnonzero((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1)
                starts, ends, found = [*starts, hits], [*ends, hits + width], [*found, h[hits]]
            starts, ends, found = np.concatenate(starts), np.concatenate(ends), np.concatenate(found)
            if not len(starts):
                continue
            if len(widths) > 1:
                order = np.argsort(starts, kind="stable")
                starts, ends, found = starts[order], np.maximum.accumulate(ends[order]), found[order]
            # Windows whose words touch or overlap are one stretch.
            cut = np.flatnonzero(starts[1:] > ends[:-1]) + 1
            for part in np.split(np.arange(len(starts)), cut):
                a, b = int(starts[part[0]]), int(ends[part[-1]])
                out["_row"].append(row)
                out["doc_id"].append(doc)
                out["start"].append(a)
                out["words"].append(words[a:b])
                out["seeds"].append(sorted(set(_signed(found[part]))))
        return record(names, **out)

    rows = with_row_id(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    return written(by_batch(rows, run, "_row long, doc_id long, start int, words array<string>, seeds array<long>"), "stretches")


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, item_id, coverage, n_tiles, tiles (start in the document, start in the item, words).

    A row for each document and item whose tiles cover so much of the item.
    """
    members, items = _items(benchmark, coverage)
    size = F.least(F.lit(MIN_MATCH), F.size("words"))
    widths = sorted(r["n"] for r in items.select(size.alias("n")).distinct().collect())  # five numbers at most
    stretches = _stretches(docs, bit_field(items.select(F.explode("seeds").alias("seed"))), widths or [MIN_MATCH])
    makers = items.select("_item", F.explode("makers").alias("seed"))
    # Seeds that very many documents hold are split by adaptive execution: both sides are dealt anew.
    pairs = written(
        stretches.select("_row", F.explode("seeds").alias("seed")).join(makers, "seed").select("_row", "_item").distinct(), "pairs"
    )
    sides = (
        pairs.join(stretches.select("_row", "doc_id", "start", "words"), "_row")
        .groupBy("_row", "_item").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("start", "words"))).alias("parts"))
    )
    sides = written(sides, "sides").join(items.select("_item", F.col("words").alias("item")), "_item")
    tile = pa.struct([("doc_start", pa.int32()), ("item_start", pa.int32()), ("words", pa.int32())])
    names = {"doc_id": pa.int64(), "_item": pa.binary(), "coverage": pa.float64(), "n_tiles": pa.int32(), "tiles": pa.list_(tile)}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = {k: [] for k in names}
        for r in batch.to_pylist():
            words, place = [], []
            for part in r["parts"]:
                words += [*part["words"], None]  # no tile goes over a gap
                place += [part["start"] + k for k in range(len(part["words"]) + 1)]
            found = tiles(words, r["item"], seed_width(r["item"]))
            share = sum(n for *_, n in found) / len(r["item"])
            if share >= coverage:
                out["doc_id"].append(r["doc_id"])
                out["_item"].append(r["_item"])
                out["coverage"].append(share)
                out["n_tiles"].append(len(found))
                out["tiles"].append([{"doc_start": place[i], "item_start": j, "words": n} for i, j, n in found])
        return record(names, **out)

    schema = "doc_id long, _item binary, coverage double, n_tiles int, tiles array<struct<doc_start:int,item_start:int,words:int>>"
    found = written(by_batch(sides, run, schema), "found")
    return found.join(members, "_item").select("doc_id", "item_id", "coverage", "n_tiles", "tiles")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The rows of docs that no benchmark item contaminates, with all their columns."""
    row = free_name(docs, "_given")
    given = identified(docs, row)
    found = contaminated(given.select(F.col(row).alias("doc_id"), "text"), benchmark, coverage)
    return given.join(written(found.select(F.col("doc_id").alias(row)).distinct(), "found"), row, "left_anti").drop(row)
