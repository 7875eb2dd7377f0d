"""Token-id output: flat files of unsigned integers with 64-bit document offsets.

Documents are dealt by ranges of doc_id. A task encodes its documents in ascending
order and writes one shard: the ids (16 bit where the vocabulary allows, else 32 bit),
the documents' lengths and the documents' ids, all flat and little-endian. A second
small pass turns lengths into global 64-bit offsets (ids before each document, and a
last entry for the end); the base of a shard comes from prefix sums over the manifest.
Readers memory-map local files and read ranges of other stores; writers and readers hold
one block at a time, however large a shard is.

Files go to the shared folder under names that no other attempt uses. The manifest, a
Parquet table that Spark commits, lists the files of the attempts that succeeded, so a
lost executor leaves unlisted files at worst.

A task cuts the bytes of many texts at once, at places where the tokenizer's own pattern
always cuts (before white space after anything else, and before plain marks after a
letter). Arrow reduces the parts to distinct ones, only those are looked up in a bounded
table or encoded, and the ids are gathered back by their places.

Defined results: a null text counts as empty (the end id alone); null doc_ids come
first and read back as null; rows that repeat a doc_id stand side by side, ordered by
a hash of the text and the text (the hash is part of the ranges too, so that a doc_id of
very many rows is split); other columns are ignored; an empty table gives an empty
manifest and result.
"""

from __future__ import annotations

import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspark.llm.common import record, shared_dir, written

#: Entries of each of the two tables of parts, and the longest part (bytes) kept in them.
TABLE_SIZE, LONGEST_PART = 300_000, 48
#: Bytes of text that are cut at once, and ids or documents that a reader holds at once.
TEXT_BYTES, READ_IDS, READ_DOCS = 4 << 20, 4 << 20, 1 << 16
#: doc_id of a document without one, in the files.
NO_ID = -(1 << 63)

#: A run of Latin letters (up to U+024F) after a space or none: one word of the tokenizer's pattern.
_WORD = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|[\xc4-\xc8][\x80-\xbf]|\xc9[\x80-\x8f])+\Z")
#: Classes of bytes: ASCII white space (with the controls that some libraries count), what may be cut before, letters, plain marks.
_BLANK, _CUT, _LETTER, _MARK = (np.zeros(256, bool) for _ in range(4))
_BLANK[[*range(9, 14), *range(28, 33)]] = True
_CUT[[*range(9, 14), 32]] = True
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK[list(b".,;:!?")] = True
#: White space beyond ASCII, its bytes as one integer.
_WIDE = [int.from_bytes(chr(c).encode(), "big") for c in range(0x80, 0x3001) if chr(c).isspace()]


def _byte_letters() -> dict[str, str]:
    """The letter that byte-level vocabularies write for each byte (given as latin-1)."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return str.maketrans({chr(b): chr(b) for b in plain} | {chr(b): chr(256 + i) for i, b in enumerate(rest)})


def cut_places(raw: np.ndarray) -> np.ndarray:
    """Places in UTF-8 bytes where a byte-level tokenizer's pattern always cuts."""
    blank = _BLANK[raw]
    at = np.flatnonzero(_CUT[raw[1:]] & ~blank[:-1]) + 1
    before = raw[at - 1]
    wide = np.flatnonzero(before >= 0x80)
    p = at[wide]
    code = raw[p - 1].astype(np.int64) + (raw[np.maximum(p - 2, 0)].astype(np.int64) << 8)
    space = np.isin(code, _WIDE) | np.isin(code + (raw[np.maximum(p - 3, 0)].astype(np.int64) << 16), _WIDE)
    at = np.delete(at, wide[space])
    marks = np.flatnonzero(_MARK[raw[1:]] & _LETTER[raw[:-1]]) + 1
    return np.sort(np.concatenate([at, marks]))


class TokenTable(dict):
    """encode() of one tokenizer file; itself a bounded table from parts to their ids.

    When it is full it becomes the older table and starts anew; parts that come again move up.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = {2: "H", 4: "I"}[self.dtype.itemsize]
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        pre = self.tokenizer.pre_tokenizer
        self.by_part = type(pre).__name__ == "ByteLevel" and not pre.add_prefix_space and pre.use_regex and self.tokenizer.normalizer is None
        self.letters = _byte_letters()
        self.older: dict[bytes, bytes] = {}

    def _encoded(self, part: bytes) -> bytes:
        if self.by_part and _WORD.match(part):  # one word of the tokenizer's: straight to its merges
            ids = [t.id for t in self.model.tokenize(part.decode("latin-1").translate(self.letters))]
        else:
            ids = self.tokenizer.encode(part.decode("utf-8", "replace"), add_special_tokens=False).ids
        return array(self.code, ids).tobytes()

    def __missing__(self, part: bytes) -> bytes:
        out = self.older.get(part)
        if out is None:
            out = self._encoded(part)
        if len(part) <= LONGEST_PART:
            if len(self) >= TABLE_SIZE:
                self.older = dict(self)
                self.clear()
            self[part] = out
        return out

    def encode(self, texts: pa.Array, end: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, each with the end's ids; number of ids of each text)."""
        offsets, raw = bytes_of(texts)
        ends, filled = offsets[1:], offsets[:-1] < offsets[1:]
        cuts = cut_places(raw) if self.by_part and len(raw) else np.zeros(0, np.int64)
        cuts = cuts[offsets[np.searchsorted(offsets, cuts)] != cuts]
        for added in self.added:  # texts with one of these are given to the tokenizer whole
            whole = pc.match_substring(texts, added).to_numpy(zero_copy_only=False)
            if whole.any():
                cuts = cuts[~whole[np.searchsorted(ends, cuts)]]
        # A part begins with each text and at each cut, and an empty one, which stands for the end, closes each text.
        starts = np.sort(np.concatenate([cuts, offsets[:-1][filled], ends]))
        n_parts = np.diff(np.searchsorted(cuts, offsets)) + filled + 1
        parts = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(np.r_[starts, ends[-1:]].astype(np.int32)), pa.py_buffer(raw)])
        coded = parts.dictionary_encode()
        known = [self[p] if p else end for p in coded.dictionary.to_pylist()]
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // self.dtype.itemsize
        flat, first = np.frombuffer(b"".join(known), self.dtype), np.cumsum(sizes) - sizes
        which = coded.indices.to_numpy()
        n = sizes[which]
        ids = flat[np.repeat(first[which] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        return ids, np.add.reduceat(n, np.cumsum(n_parts) - n_parts)


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets from 0, bytes) of an array of strings without nulls; nothing is copied but a slice's offsets."""
    wide = texts.cast(pa.large_string())
    _, places, data = wide.buffers()
    offsets = np.frombuffer(places, np.int64)[wide.offset : wide.offset + len(wide) + 1]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], raw


def text_groups(texts: pa.Array, most: int = TEXT_BYTES) -> Iterator[tuple[int, int]]:
    """(start, length) of slices of so many bytes at most, or of one longer text."""
    sizes, start, held = pc.binary_length(texts).to_numpy(zero_copy_only=False), 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and held + n > most:
            yield start, i - start
            start, held = i, 0
        held += n
    if len(sizes):
        yield start, len(sizes) - start


@lru_cache(maxsize=2)
def token_table(path: str) -> TokenTable:
    return TokenTable(path)


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


_MANIFEST = {
    "shard": pa.int32(), "name": pa.string(), "dtype": pa.string(), "n_docs": pa.int64(), "n_tokens": pa.int64(),
}


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 0, folder: str | None = None, shards: int | None = None) -> DataFrame:
    """Write the files; returns the manifest: shard, name, dtype, n_docs, n_tokens, base, folder.

    shards: how many ranges of doc_id; by default the session's shuffle partitions, of which
    adaptive execution joins small ones.
    """
    from pyspark import TaskContext

    spark = docs.sparkSession
    folder = folder or shared_dir(spark, "tokens")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    tie = F.xxhash64("text")
    ranges = ([shards] if shards else []) + [F.col("doc_id"), tie]
    ordered = texts.repartitionByRange(*ranges).sortWithinPartitions(F.col("doc_id"), tie, "text")

    def run(batches):
        fs, top = _store(folder)
        fs.create_dir(top, recursive=True)
        table, shard, name = None, TaskContext.get().partitionId(), uuid.uuid4().hex
        out, n_docs, n_tokens = {}, 0, 0
        for batch in batches:
            if table is None:
                table = token_table(tokenizer_path)
                end = np.array([end_id], table.dtype).tobytes()
                out = {kind: fs.open_output_stream(f"{top}/{name}.{kind}") for kind in ("bin", "len", "doc")}
            for at, size in text_groups(batch.column("text")):
                ids, lengths = table.encode(batch.column("text").slice(at, size), end)
                out["bin"].write(ids)
                out["len"].write(lengths.astype("<i8"))
                out["doc"].write(pc.fill_null(batch.column("doc_id").slice(at, size), NO_ID).to_numpy(zero_copy_only=False).astype("<i8"))
                n_docs, n_tokens = n_docs + size, n_tokens + len(ids)
        for f in out.values():
            f.close()
        if out:
            yield record(_MANIFEST, shard=[shard], name=[name], dtype=[table.dtype.str], n_docs=[n_docs], n_tokens=[n_tokens])

    manifest = written(ordered.mapInArrow(run, "shard int, name string, dtype string, n_docs long, n_tokens long"), "manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row per shard
    manifest = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).withColumn("folder", F.lit(folder))

    def offsets(batches):
        for batch in batches:
            for row in batch.to_pylist():
                fs, top = _store(row["folder"])
                lengths, base = FlatFile(row["folder"], f"{row['name']}.len", "<i8"), row["base"]
                with fs.open_output_stream(f"{top}/{row['name']}.idx") as f:
                    f.write(np.array([base], "<u8"))
                    for at in range(0, row["n_docs"], READ_DOCS):
                        part = base + np.cumsum(lengths.read(at, min(READ_DOCS, row["n_docs"] - at)))
                        f.write(part.astype("<u8"))
                        base = int(part[-1])
            yield batch

    return written(_dealt(manifest).mapInArrow(offsets, manifest.schema), "manifest")


def _dealt(manifest: DataFrame) -> DataFrame:
    """A manifest's rows over the session's partitions: each row is the work of a shard."""
    return manifest.repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "shard")


class FlatFile:
    """A flat file of integers: memory-mapped if it is a local one, else read by ranges."""

    def __init__(self, folder: str, name: str, dtype: str):
        fs, top = _store(folder)
        self.dtype, self.whole, self.file = np.dtype(dtype), None, None
        size = fs.get_file_info(f"{top}/{name}").size
        self.size = size // self.dtype.itemsize
        if not size:
            self.whole = np.zeros(0, dtype)
        elif isinstance(fs, pafs.LocalFileSystem):
            self.whole = np.memmap(f"{top}/{name}", dtype=dtype, mode="r")
        else:
            self.file = fs.open_input_file(f"{top}/{name}")

    def read(self, start: int, n: int) -> np.ndarray:
        if self.whole is not None:
            return self.whole[start : start + n]
        width = self.dtype.itemsize
        return np.frombuffer(self.file.read_at(n * width, start * width), self.dtype)


_DOCS = {"doc_id": pa.int64(), "start": pa.int64(), "n_tokens": pa.int64(), "ids_crc32": pa.int64()}


def _documents_of(row: dict) -> Iterator[pa.RecordBatch]:
    """Documents of one shard, block by block."""
    ids, places, docs = (FlatFile(row["folder"], f"{row['name']}.{kind}", dtype) for kind, dtype in (("bin", row["dtype"]), ("idx", "<u8"), ("doc", "<i8")))
    at = 0
    while at < row["n_docs"]:
        start = places.read(at, min(READ_DOCS, row["n_docs"] - at) + 1).astype(np.int64)
        n = max(1, int(np.searchsorted(start, start[0] + READ_IDS, "right")) - 1)  # a longer document is a block of its own
        start = start[: n + 1]
        block = memoryview(ids.read(int(start[0]) - row["base"], int(start[-1] - start[0])).astype("<u4")).cast("B")
        cut = ((start - start[0]) * 4).tolist()
        crc = [zlib.crc32(block[a:b]) for a, b in zip(cut, cut[1:], strict=False)]
        names = docs.read(at, n)
        yield record(_DOCS, doc_id=pa.array(names, pa.int64(), mask=np.asarray(names == NO_ID)), start=start[:-1], n_tokens=np.diff(start), ids_crc32=crc)
        at += n


def read_documents(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from the files."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield from _documents_of(row)

    return _dealt(manifest).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
