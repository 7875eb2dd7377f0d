"""String similarity: shares of common subsequences.

The length of a longest common subsequence is the one step that Spark has no expression for that is cheap
(a table of nested arrays copies itself for each letter): it runs in Arrow batches, a word of
bits a text, all pairs of a batch at once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

#: Letters that a word of bits takes; pairs whose tables are made at once.
BITS, CHUNK = 64, 2048


def common_lengths(a: list[str], b: list[str]) -> np.ndarray:
    """Lengths of the longest common subsequences of pairs of texts.

    Bit k of a state is 0 if the k-th letter of the first text adds to the length so far;
    each letter of the second text takes one addition.
    """
    out = np.zeros(len(a), np.int32)
    for at in range(0, len(a), CHUNK):
        out[at : at + CHUNK] = _chunk(a[at : at + CHUNK], b[at : at + CHUNK])
    return out


def _chunk(a: list[str], b: list[str]) -> np.ndarray:
    out = np.zeros(len(a), np.int32)
    short = []
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        if min(len(x), len(y)) > BITS:
            out[i] = _long(x, y)
        else:
            short.append((i, x, y) if len(x) <= BITS else (i, y, x))
    if not short:
        return out
    letters: dict[str, int] = {}
    firsts, seconds = {x: k for k, x in enumerate(dict.fromkeys(x for _, x, _ in short))}, {y: k for k, y in enumerate(dict.fromkeys(y for _, _, y in short))}
    coded = [[letters.setdefault(c, len(letters) + 1) for c in x] for x in firsts]
    masks = np.zeros((len(firsts), len(letters) + 1), np.uint64)
    for k, codes in enumerate(coded):
        for place, c in enumerate(codes):
            masks[k, c] |= np.uint64(1 << place)
    longest = max(map(len, seconds))
    texts = np.zeros((len(seconds), longest), np.int32)  # a letter that no first text has changes nothing
    for k, y in enumerate(seconds):
        texts[k, : len(y)] = [letters.get(c, 0) for c in y]
    one = np.array([firsts[x] for _, x, _ in short])
    two = np.array([seconds[y] for _, _, y in short])
    state = np.full(len(short), ~np.uint64(0))
    for place in range(longest):
        m = masks[one, texts[two, place]]
        state = (state + (state & m)) | (state & ~m)
    size = np.array([len(x) for _, x, _ in short], np.uint64)
    inside = np.where(size == BITS, ~np.uint64(0), (np.uint64(1) << (size % np.uint64(BITS))) - np.uint64(1))
    out[[i for i, *_ in short]] = np.bitwise_count(~state & inside)
    return out


def _long(x: str, y: str) -> int:
    """The same for texts of any length, by integers of any length."""
    masks: dict[str, int] = {}
    for place, c in enumerate(x):
        masks[c] = masks.get(c, 0) | 1 << place
    inside = (1 << len(x)) - 1
    state = inside
    for c in y:
        m = masks.get(c, 0)
        state = ((state + (state & m)) | (state & ~m)) & inside
    return len(x) - state.bit_count()


@F.pandas_udf(IntegerType())
def common_length(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the longest common subsequence of two texts; null if one is."""
    known = a.notna() & b.notna()
    out = pd.Series(pd.array([None] * len(a), "Int32"), index=a.index)
    if known.any():
        out[known] = common_lengths(a[known].tolist(), b[known].tolist())
    return out


def ratio(a: Column, b: Column) -> Column:
    """100 times twice the common length over both lengths; 100 for two empty texts."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(100.0)).when(a == b, F.lit(100.0)).otherwise(200.0 * common_length(a, b) / total)


def token_sets(a: Column, b: Column) -> Column:
    """What the similarity of two phrases as sets of words is made of: whether either has none,
    how many words they share and of what length, and the words that only one has."""
    x, y = (F.array_distinct(F.filter(F.split(F.trim(c), r"(?U)\s+"), lambda t: t != "")) for c in (a, b))
    both = F.array_intersect(x, y)
    rest = lambda z: F.array_join(F.array_sort(F.array_except(z, both)), " ")
    return F.struct(
        ((F.size(x) == 0) | (F.size(y) == 0)).alias("none"), F.size(both).alias("n"), F.length(F.array_join(both, " ")).alias("s"), rest(x).alias("jx"), rest(y).alias("jy")
    )


def of_token_sets(p: Column, common: Column) -> Column:
    """The similarity, given the common length of what only one phrase has. It grows with it: 0
    and the shorter length are bounds."""
    jx, jy, s = F.length(p["jx"]), F.length(p["jy"]), p["s"]
    gap = F.when(s > 0, 1).otherwise(0)  # the space between the common part and a rest
    long_x, long_y = s + gap + jx, s + gap + jy
    rests = 100.0 * (1 - (jx + jy - 2 * common) / (long_x + long_y))
    part = lambda rest, n: 100.0 * (1 - (gap + rest) / (s + n))
    return (
        F.when(p["none"], F.lit(0.0)).when((p["n"] > 0) & ((p["jx"] == "") | (p["jy"] == "")), F.lit(100.0))
        .when(p["n"] == 0, rests).otherwise(F.greatest(rests, part(jx, long_x), part(jy, long_y)))
    )


def token_set_ratio(a: Column, b: Column) -> Column:
    """Similarity of two phrases as sets of words."""
    p = token_sets(a, b)
    return of_token_sets(p, common_length(p["jx"], p["jy"]))
