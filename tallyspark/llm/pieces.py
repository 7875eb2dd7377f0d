"""SentencePiece encoding (merge type) by backtracking, and decoding.

A token sequence is the merge encoding of a text exactly if every two neighbours are
compatible: merging their joined characters again gives those two tokens. So the text
is read from left to right: an Aho-Corasick automaton gives the longest piece at each
place; a piece is taken if it is compatible with the one before; else its next shorter
prefix is tried; where none is left, the last piece is given up and the place is marked
as failed in a bit field, so that no place is left twice.

If no piece has a non-space before a space, texts are cut before their runs of spaces;
parts that come again are looked up (a bounded table). Characters without a piece become
the pieces of their bytes. Decoding is the library's decode(ids).

Defined results: a null text counts as empty; an empty text gives the end id alone;
other columns are kept out; repeated rows give repeated results; an empty table gives
an empty result.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import by_batch, record

SPACE = "▁"
#: Entries of each of the two tables of parts and of the table of pairs, and the longest part kept.
TABLE_SIZE, PAIRS_SIZE, LONGEST_PART = 300_000, 1_000_000, 40


class _Parts(dict):
    """A bounded table from parts to ids. When it is full it becomes the older table and
    starts anew; parts that come again move up."""

    def __init__(self, pieces: Pieces):
        self.pieces, self.older = pieces, {}

    def __missing__(self, part: str) -> bytes:
        out = self.older.get(part) or self.pieces.encoded(part)
        if len(part) <= LONGEST_PART:
            if len(self) >= TABLE_SIZE:
                self.older = dict(self)
                self.clear()
            self[part] = out
        return out


class Pieces:
    """The vocabulary of one model file and its merge encoding."""

    def __init__(self, path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self._require_identity()
        sp = self.library
        self.rank: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.byte = [0] * 256
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.id[piece] = i
                self.rank[piece] = -sp.get_score(i)
        self.end = sp.eos_id()
        self.end_bytes = array("i", [self.end]).tobytes()
        self.automaton = ahocorasick.Automaton()
        for piece in self.id:
            if len(piece) > 1 and self.merged(piece) == [piece]:  # one character is a token anyway
                self.automaton.add_word(piece, (piece, len(piece) - 1))
        self.automaton.make_automaton()
        self.cut = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.id):
            self.cut = re.compile("(?s).+")
        self.pairs: dict[tuple[str, str], bool] = {}
        self.parts = _Parts(self)
        self.less: dict[str, str | None] = {}

    def _require_identity(self) -> None:
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        model.ParseFromString(self.library.serialized_model_proto())
        norm, trainer = model.normalizer_spec, model.trainer_spec
        user = any(p.type == pb.ModelProto.SentencePiece.USER_DEFINED for p in model.pieces)
        if trainer.model_type != pb.TrainerSpec.BPE or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or user or not trainer.byte_fallback:
            raise ValueError("only merge-type models with identity normalisation and byte fallback are supported")
        self.prefix = SPACE if norm.add_dummy_prefix else ""

    def merged(self, text: str) -> list[str]:
        """The merge encoding of a short text: the best score first, leftmost of equal ones."""
        parts, rank = list(text), self.rank
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, a: str, b: str) -> bool:
        ok = self.pairs.get((a, b))
        if ok is None:
            if len(self.pairs) >= PAIRS_SIZE:
                self.pairs.clear()
            ok = self.pairs[a, b] = self.merged(a + b) == [a, b]
        return ok

    def shorter(self, piece: str) -> str | None:
        """The longest proper prefix that is a piece; one character always is a token."""
        if piece not in self.less:
            found = (piece[:n] for n in range(len(piece) - 1, 1, -1) if piece[:n] in self.automaton)
            self.less[piece] = next(found, piece[0] if len(piece) > 1 else None)
        return self.less[piece]

    def tokens(self, text: str) -> list[str]:
        longest = list(text)
        for end, (piece, back) in self.automaton.iter(text):
            longest[end - back] = piece  # of one start, longer pieces come later
        failed, out, at, n = bytearray(len(text) // 8 + 1), [], 0, len(text)
        pairs, last = self.pairs, None
        token = longest[0] if text else None
        while at < n:
            end = at + len(token)
            if not failed[end >> 3] >> (end & 7) & 1:
                ok = last is None or pairs.get((last, token))
                if ok is None:
                    ok = self.compatible(last, token)
                if ok:
                    out.append(token)
                    at, last = end, token
                    token = longest[at] if at < n else None
                    continue
            token = self.shorter(token)
            if token is None:
                failed[at >> 3] |= 1 << (at & 7)
                token = out.pop()
                last = out[-1] if out else None
                at -= len(token)
        return out

    def encoded(self, text: str) -> bytes:
        """The ids of a part, as 32-bit integers."""
        ids = array("i")
        for t in self.tokens(text):
            i = self.id.get(t)
            if i is None:
                ids.extend(self.byte[b] for b in t.encode())
            else:
                ids.append(i)
        return ids.tobytes()

    def packed(self, text: str) -> bytes:
        """encode() as 32-bit integers."""
        if not text:
            return self.end_bytes
        parts = self.cut.findall(self.prefix + text.replace(" ", SPACE))
        return b"".join(map(self.parts.__getitem__, parts)) + self.end_bytes

    def encode(self, text: str) -> list[int]:
        return array("i", self.packed(text)).tolist()

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def encode_decode(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids (array of int, with the end id), decoded (the text that they give)."""
    schema = {"doc_id": pa.int64(), "ids": pa.list_(pa.int32()), "decoded": pa.string()}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        p = pieces(model_path)
        packed = [p.packed(t or "") for t in batch.column("text").to_pylist()]
        ends = np.cumsum([0] + [len(x) // 4 for x in packed], dtype=np.int32)
        ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), np.int32)))
        return record(schema, doc_id=batch.column("doc_id"), ids=ids, decoded=[p.decode(array("i", x).tolist()) for x in packed])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return by_batch(texts, run, "doc_id long, ids array<int>, decoded string", rows=100)


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
