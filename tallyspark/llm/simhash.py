"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints at Hamming distance 4 or less share a variant that is at
distance 2 or less from both. Every distinct fingerprint therefore emits its ball of
variants and equal variants meet. The ball (2,081 variants) is dealt by a variant's
leading bits: Spark explodes a fingerprint into the prefixes that its ball reaches
(79 for 12 bits) and shuffles by prefix; the task of a prefix emits the variants below
it, sorts them and finds collisions. All fingerprints that share a variant lie within
4 bits of each other, so a collision is a class: it is reported as a star around its
smallest member, never as all pairs, and each task reduces its stars to a spanning
forest. Each link that is reported is verified. Components of the links are found by
repeated contraction.

Defined results: a null text counts as empty; a text without words has fingerprint 0,
which links like any other; rows that repeat a doc_id share a component if their
fingerprints link; a null doc_id is ignored when the smallest id is taken (null if the
component has no other); other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import by_batch, free_name, identified, record, with_row_id, written

SEED, SHINGLE, RADIUS, HALF = 42, 4, 4, 2
#: Leading bits by which variants are dealt, at least; variants that one task holds at once.
PREFIX_BITS, TASK_VARIANTS = 12, 1 << 22
#: A prefix with more fingerprints than this is dealt again by its next bits.
HOT_PREFIX = 200_000


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """The text's SimHash over word shingles, as an unsigned integer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # ASCII case and white space only
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return digest(joined, SEED)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - width + 1].tolist()
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        part = hashes[at : at + 8192].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * ones > len(hashes)).tolist())


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _fingerprints(batch: pa.RecordBatch) -> pa.RecordBatch:
    schema = {"doc_id": pa.int64(), "fp": pa.int64()}
    return record(schema, doc_id=batch.column("doc_id"), fp=[_signed(fingerprint(t)) for t in batch.column("text").to_pylist()])


def fingerprints(docs: DataFrame) -> DataFrame:
    """A written row per document: doc_id, fp (signed long), _row."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(with_row_id(by_batch(texts, _fingerprints, "doc_id long, fp long")), "fingerprints")


def _masks(bits: int, radius: int) -> np.ndarray:
    """All words of so many bits with at most radius ones."""
    one = np.uint64(1) << np.arange(bits, dtype=np.uint64)
    parts = [np.zeros(1, np.uint64)]
    if radius >= 1:
        parts.append(one)
    if radius >= 2:
        a, b = np.triu_indices(bits, 1)
        parts.append(one[a] | one[b])
    return np.concatenate(parts)


def _deal(df: DataFrame, done: int, bits: int) -> DataFrame:
    """Deal rows (prefix, left, fp), whose first bits are dealt already, by the next ones.

    left: how many more flips a variant may have.
    """
    flips = [F.struct(F.lit(int(m)).cast("long").alias("flip"), F.lit(int(m).bit_count()).alias("used")) for m in _masks(bits, HALF)]
    own = F.shiftrightunsigned("fp", 64 - done - bits).bitwiseAND((1 << bits) - 1)
    return (
        df.withColumn("f", F.explode(F.array(*flips)))
        .where(F.col("f.used") <= F.col("left"))
        .select(
            (F.shiftleft("prefix", bits) + own.bitwiseXOR(F.col("f.flip"))).alias("prefix"),
            (F.col("left") - F.col("f.used")).cast("int").alias("left"),
            "fp",
        )
    )


def _collisions(rest: np.ndarray, left: np.ndarray, which: np.ndarray, bits: int):
    """Yield (fingerprint, smallest fingerprint of its class) for classes of equal variants."""
    sizes = {r: len(_masks(bits, r)) for r in range(HALF + 1)}
    if sum(int((left == r).sum()) * s for r, s in sizes.items()) > TASK_VARIANTS and bits > 1:
        top = (rest >> np.uint64(bits - 1)) & np.uint64(1)
        low = rest & np.uint64((1 << (bits - 1)) - 1)
        for bit in (0, 1):
            now = left - (top != bit)
            ok = now >= 0
            if ok.sum() > 1:
                yield from _collisions(low[ok], now[ok], which[ok], bits - 1)
        return
    variants, owners = [], []
    for r in range(HALF + 1):
        has = left == r
        if has.any():
            masks = _masks(bits, r)
            variants.append((rest[has][:, None] ^ masks[None, :]).ravel())
            owners.append(np.repeat(which[has], len(masks)))
    if not variants:
        return
    variants, owners = np.concatenate(variants), np.concatenate(owners)
    ordered = np.sort(variants)
    again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(again):
        return
    seen = np.zeros(1 << 16, bool)  # a quick sieve before the exact look-up
    seen[(again ^ (again >> np.uint64(17))).astype(np.uint16)] = True
    may = seen[(variants ^ (variants >> np.uint64(17))).astype(np.uint16)]
    variants, owners = variants[may], owners[may]
    at = np.minimum(np.searchsorted(again, variants), len(again) - 1)
    hit = again[at] == variants
    at, owners = at[hit], owners[hit]
    order = np.lexsort((owners, at))
    at, owners = at[order], owners[order]
    first = np.r_[True, at[1:] != at[:-1]]
    least = owners[first][np.cumsum(first) - 1]
    yield np.unique(np.stack([owners, least])[:, owners != least], axis=1)


def _links(pdf: pd.DataFrame, bits: int) -> pd.DataFrame:
    """A spanning forest of the links below one prefix: columns a > b (by rank)."""
    fps = pdf["fp"].to_numpy()
    names, which = np.unique(fps, return_inverse=True)
    low = fps.view(np.uint64) & np.uint64((1 << bits) - 1)
    root = np.arange(len(names))
    edges = list(_collisions(low, pdf["left"].to_numpy(), which, bits))
    if edges:
        a, b = np.concatenate(edges, axis=1)
        near = np.bitwise_count(names.view(np.uint64)[a] ^ names.view(np.uint64)[b]) <= RADIUS
        a, b = a[near], b[near]
        while True:  # smallest rank along the links, with short cuts
            was = root.copy()
            least = np.minimum(root[a], root[b])
            np.minimum.at(root, root[a], least)
            np.minimum.at(root, root[b], least)
            root = root[root]
            if (was == root).all():
                break
    linked = root != np.arange(len(names))
    return pd.DataFrame({"a": names[linked], "b": names[root[linked]]})


def links(fps: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that keep every component."""
    fps = written(fps.select("fp").distinct(), "distinct")
    n = fps.count()
    bits = min(24, max(PREFIX_BITS, math.ceil(math.log2(max(1, n) * 2081 / (1 << 24)))))
    dealt = _deal(fps.select(F.lit(0).cast("long").alias("prefix"), F.lit(HALF).alias("left"), "fp"), 0, bits)
    forest = lambda df, rest: df.groupBy("prefix").applyInPandas(lambda pdf: _links(pdf, rest), "a long, b long")
    out = None
    while True:
        done, hot = bits, None
        if n > HOT_PREFIX and done < 56:
            hot = written(dealt.groupBy("prefix").count().where(F.col("count") > HOT_PREFIX).select("prefix"), "hot")
            hot = None if hot.isEmpty() else hot
        found = forest(dealt if hot is None else dealt.join(hot, "prefix", "left_anti"), 64 - done)
        out = found if out is None else out.union(found)
        if hot is None:
            return out.distinct()
        # Hot prefixes are dealt by their next bits, again and again until none is hot.
        dealt, bits = written(_deal(dealt.join(hot, "prefix", "left_semi"), done, 8), "dealt"), done + 8


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the edges (a, b); root is the same within a component.

    Each round maps every node to the smallest of itself and its neighbours and contracts
    the edges. Fingerprints are hashes, so their order is random and the number of nodes
    falls by a constant factor a round. Rounds are written, which cuts lineage and lets
    adaptive execution split the join of a node with very many edges.
    """
    edges = written(edges.select("a", "b"), "edges")
    nodes = None
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m")), "step")
        if nodes is None:
            nodes = step.select(F.col("u").alias("node"), F.col("m").alias("root"))
        else:
            nodes = nodes.join(step, nodes["root"] == step["u"], "left").select("node", F.coalesce("m", "root").alias("root"))
        nodes = written(nodes, "nodes")
        left = step.select(F.col("u").alias("a"), F.col("m").alias("x"))
        right = step.select(F.col("u").alias("b"), F.col("m").alias("y"))
        edges = written(
            edges.join(left, "a").join(right, "b").where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(),
            "edges",
        )
    return nodes if nodes is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id, _row, _first: one row per row of docs.

    _first is the row that stays of a component: the one with the smallest doc_id.
    """
    rows = fingerprints(docs)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")).alias("first")
    by_fp = written(rows.groupBy("fp").agg(first), "by_fp")
    roots = components(links(by_fp))
    named = by_fp.join(roots, by_fp["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    named = written(named, "named")
    least = written(named.groupBy("root").agg(F.min("first").alias("least")), "least")
    of_fp = written(named.join(least, "root").select("fp", "least"), "of_fp")
    return rows.join(of_fp, "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("least.doc_id").alias("component_id"),
        "_row",
        F.col("least._row").alias("_first"),
    )


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One document of each component, with all its columns."""
    row = free_name(docs, "_given")
    given = identified(docs, row)
    found = near_duplicates(given.select(F.col(row).alias("doc_id"), "text"))
    # Rows go by their number here; the one that stays is chosen by doc_id.
    pairs = found.select(F.col("doc_id").alias("row"), F.col("component_id").alias("c"))
    named = pairs.join(given.select(F.col(row).alias("row"), F.col("doc_id").alias("doc")), "row").groupBy("c")
    first = named.agg(F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "row")).alias("first"))
    return given.join(first.select(F.col("first.row").alias(row)), row, "left_semi").drop(row)
