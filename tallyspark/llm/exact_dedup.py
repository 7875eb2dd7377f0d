"""Exact dedup by content-defined chunk recipes.

Each text is normalised, cut at content-defined places and turned into a recipe:
the ordered list of its chunks' identifiers. A chunk's identifier is a 64-bit hash
that is verified against the chunk's SHA-256: where one hash stands for several
digests, the digests are numbered and the number becomes part of the identifier.
Equal recipes are equal texts, so only identifiers move between executors, never
the texts.

Defined results: a null text counts as empty; empty texts are equal to each other;
rows that repeat a doc_id are rows of their own, of which one stays; a null doc_id
comes after all others when the row that stays is chosen; columns other than doc_id
and text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import by_batch, free_name, identified, record, with_row_id, written

_SPACE = re.compile(rb"[\x20\x09-\x0D]+")
#: Chunk sizes in bytes. The mask has 11 bits: a cut about every 2 KiB.
MIN_CHUNK, MAX_CHUNK, MASK = 256, 8192, np.uint32(0x7FF00000)
_GEAR = np.random.default_rng(20240229).integers(0, 2**32, 256, dtype=np.uint32)


def normalise(text: str | None) -> bytes:
    return _SPACE.sub(b" ", (text or "").encode("utf-8", "surrogatepass"))


def cut_points(data: bytes, least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> list[int]:
    """Ends of the chunks of data; a cut depends only on the 32 bytes before it."""
    n = len(data)
    if n <= least:
        return [n]
    h = _GEAR[np.frombuffer(data, np.uint8)]
    for step in (1, 2, 4, 8, 16):  # after the last step h[i] covers bytes i-31 .. i
        shifted = h[:-step] << np.uint32(step)
        h[step:] += shifted
    ends, start = [], 0
    for at in (np.flatnonzero((h & MASK) == 0) + 1).tolist():
        if at - start < least:
            continue
        while at - start > most:
            start += most
            ends.append(start)
        if at - start >= least and at < n:
            ends.append(at)
            start = at
    while n - start > most:
        start += most
        ends.append(start)
    return [*ends, n]


_RECIPE = {
    "doc_id": pa.int64(), "text_sha256": pa.string(), "n_bytes": pa.int64(),
    "hashes": pa.list_(pa.int64()), "digests": pa.list_(pa.binary()),
}


def _recipes(batch: pa.RecordBatch) -> pa.RecordBatch:
    shas, sizes, hashes, digests = [], [], [], []
    for text in batch.column("text").to_pylist():
        data = normalise(text)
        shas.append(hashlib.sha256(data).hexdigest())
        sizes.append(len(data))
        start, ids, full = 0, [], []
        for end in cut_points(data):
            chunk = data[start:end]
            h = xxhash.xxh3_64_intdigest(chunk)
            ids.append(h - (1 << 64) if h >> 63 else h)
            full.append(hashlib.sha256(chunk).digest())
            start = end
        hashes.append(ids)
        digests.append(full)
    return record(_RECIPE, doc_id=batch.column("doc_id"), text_sha256=shas, n_bytes=sizes, hashes=hashes, digests=digests)


def chunk_recipes(docs: DataFrame) -> DataFrame:
    """A written row per document: doc_id, text_sha256, n_bytes, hashes, digests, _row."""
    out = by_batch(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")),
        _recipes,
        "doc_id long, text_sha256 string, n_bytes long, hashes array<long>, digests array<binary>",
    )
    return written(with_row_id(out), "recipes")


def verified(recipes: DataFrame) -> DataFrame:
    """Adds ``recipe``: the ordered list of verified chunk identifiers.

    Chunks are reduced to distinct (hash, digest) pairs before the shuffle. Only rows
    of hashes with more than one digest, hardly ever any, are numbered and joined.
    """
    chunk = F.explode(F.arrays_zip("hashes", "digests")).alias("c")
    pairs = recipes.select(chunk).select(F.col("c.hashes").alias("hash"), F.col("c.digests").alias("digest")).distinct()
    clashing = pairs.groupBy("hash").agg(F.array_sort(F.collect_set("digest")).alias("all")).where(F.size("all") > 1)
    clashing = written(clashing, "clashing")
    fixes = (
        recipes.select("_row", F.posexplode(F.arrays_zip("hashes", "digests")).alias("at", "c"))
        .join(clashing, F.col("c.hashes") == F.col("hash"))
        .select("_row", "at", F.array_position("all", F.col("c.digests")).alias("number"))
        .groupBy("_row")
        .agg(F.map_from_entries(F.collect_list(F.struct("at", "number"))).alias("fix"))
    )
    identifier = lambda h, i: F.struct(h.alias("hash"), F.coalesce(F.try_element_at("fix", i), F.lit(1)).alias("number"))
    return recipes.join(fixes, "_row", "left").withColumn("recipe", F.transform("hashes", identifier)).drop("fix")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of docs."""
    rows = written(
        verified(chunk_recipes(docs)).select(
            "_row", "doc_id", "text_sha256", "recipe", F.size("recipe").alias("n_chunks"), F.xxhash64("recipe").alias("key")
        ),
        "verified",
    )
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")).alias("first")
    # Counts are combined before the shuffle. Written first, so that the join below
    # deals both sides anew and adaptive execution can split a hot group.
    groups = written(
        rows.groupBy("key", "recipe").agg(first, F.count("*").alias("n")).where("n > 1")
        .select("key", "recipe", F.col("first.doc_id").alias("first_id"), F.col("first._row").alias("first_row"), "n"),
        "groups",
    )
    own = F.col("n").isNull()
    return rows.join(groups, ["key", "recipe"], "left").select(
        "doc_id",
        F.when(own, F.col("doc_id")).otherwise(F.col("first_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (own | (F.col("first_row") == F.col("_row"))).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns.

    doc_ids that are unique are assumed nowhere: of repeated rows one stays.
    """
    row = free_name(docs, "_given")
    given = identified(docs, row)
    own = chunk_recipes(given.select(F.col(row).alias("doc_id"), "text"))
    ids = given.select(F.col(row).alias("row"), F.col("doc_id").alias("doc"))
    rows = written(
        verified(own).select("recipe", F.xxhash64("recipe").alias("key"), F.col("doc_id").alias("row")).join(ids, "row"),
        "verified",
    )
    first = F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "row")).alias("first")
    keep = rows.groupBy("key", "recipe").agg(first).select(F.col("first.row").alias(row))
    return given.join(keep, row, "left_semi").drop(row)
