"""The most similar items among those that share no word with a query, in blocks.

Items are dealt by the length of their phrase and cut into blocks of BLOCK. The length of two
phrases bounds their similarity, so lengths near to a query's are visited first, and other
lengths only if their bound reaches the query's k-th score. A task gets one block and a part of the
queries that visit it, compares all phrases of the block with a query at once and keeps the
best few; no pair leaves it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspark.functions import fixed
from tallyspark.functions import similarity as S
from tallyspark.sources.shared import written

#: Items of a block, at most; queries that visit it in one task.
BLOCK, QUERIES = 2000, 4000
#: Lengths of which one is at least this share of what the similarity can be are visited first.
NEAR = 80.0
#: Words with fewer letters are no hits of each other, so phrases that share no hit may share them.
HIT_LETTERS = 4


def length_bound(a: Column, b: Column) -> Column:
    """The most that the similarity of two phrases without a common word can be, by their lengths."""
    return 200.0 * F.least(a, b) / (a + b)


class Block:
    """Items (iid, phrase, action, unit_n, stems, size, ord) that are compared with one query at a time."""

    def __init__(self, items: pd.DataFrame):
        self.items = items
        self.sets = [frozenset(p.split()) for p in items["phrase"]]
        texts = [" ".join(sorted(x)) for x in self.sets]
        self.size = np.array([len(t) for t in texts])
        letters: dict[str, int] = {}
        codes = np.zeros((int(self.size.max(initial=0)), len(texts)), np.int32)
        for k, t in enumerate(texts):
            codes[: len(t), k] = [letters.setdefault(c, len(letters) + 1) for c in t]
        self.letters, self.codes, self.texts = letters, codes, texts
        # Phrases of a block are about as long. Up to BITS letters, each has a word of bits for every letter.
        self.masks = np.zeros((len(letters) + 1, len(texts)), np.uint64) if len(codes) <= S.BITS else None
        if self.masks is not None:
            for place, row in enumerate(codes):
                self.masks[row, np.arange(len(texts))] |= np.uint64(1 << place)
            self.inside = np.where(self.size == S.BITS, ~np.uint64(0), (np.uint64(1) << (self.size % S.BITS).astype(np.uint64)) - np.uint64(1))
        self.rows: dict[str, list[int]] = {}
        for k, (stems, words) in enumerate(zip(items["stems"], self.sets, strict=True)):
            for w in {*stems, *words}:
                self.rows.setdefault(w, []).append(k)
        # Actions and units as numbers; 0: none.
        self.kinds = [{"": 0}, {"": 0}]
        self.action, self.unit = (np.array([kinds.setdefault(v or "", len(kinds)) for v in items[c]]) for c, kinds in zip(("action", "unit_n"), self.kinds, strict=True))
        self.order = items["size"].to_numpy(), items["ord"].to_numpy()

    def similarity(self, phrase: str) -> np.ndarray:
        words = frozenset(phrase.split())
        text = " ".join(sorted(words))
        if self.masks is not None:
            state = np.full(len(self.texts), ~np.uint64(0))
            for c in text:
                if k := self.letters.get(c):
                    m = self.masks[k]
                    state = (state + (state & m)) | (state & ~m)
            common = np.bitwise_count(~state & self.inside).astype(np.int64)
        elif len(text) > S.BITS:
            common = np.array([S._long(text, t) for t in self.texts])
        else:
            masks = np.zeros(len(self.letters) + 1, np.uint64)
            for k, c in enumerate(text):
                masks[self.letters.get(c, 0)] |= np.uint64(1 << k)
            masks[0] = 0
            state = np.full(len(self.texts), ~np.uint64(0))
            for row in self.codes:
                m = masks[row]
                state = (state + (state & m)) | (state & ~m)
            inside = ~np.uint64(0) if len(text) == S.BITS else np.uint64((1 << len(text)) - 1)
            common = np.bitwise_count(~state & inside).astype(np.int64)
        out = np.where(self.size > 0, 200.0 * common / np.maximum(1, self.size + len(text)), 0.0) if words else np.zeros(len(self.texts))
        for k in {k for w in words for k in self.rows.get(w, ())}:
            if both := words & self.sets[k]:
                out[k] = token_set(words, self.sets[k], both)
        return out

    def best(self, phrase: str, action: str, unit: str, found: list[str], limit: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of the best items that hold none of the words found."""
        score = fixed.SIMILARITY_SHARE / 100 * self.similarity(phrase)
        if action:
            score -= fixed.ACTION_PENALTY * ((self.action != 0) & (self.action != self.kinds[0].get(action, -1)))
        if unit:
            score += np.where(self.unit == self.kinds[1].get(unit, -1), fixed.UNIT_BONUS, np.where(self.unit != 0, -fixed.UNIT_PENALTY, 0.0))
        for w in found:
            score[self.rows.get(w, [])] = -np.inf
        shown = np.sign(score) * np.floor(np.abs(score) * 10 + 0.5 + 1e-9)  # tenths, halves away from zero, as they are ranked
        last = len(shown) - min(limit, len(shown))
        rows = np.flatnonzero(shown >= np.partition(shown, last)[last])
        rows = rows[np.lexsort((self.order[1][rows], self.order[0][rows], -shown[rows]))[:limit]]
        rows = rows[score[rows] > -np.inf]
        return rows, score[rows]


def token_set(x: frozenset, y: frozenset, both: frozenset) -> float:
    """The similarity of two sets of words that share some."""
    if x <= y or y <= x:
        return 100.0
    s, jx, jy = len(" ".join(both)), " ".join(sorted(x - both)), " ".join(sorted(y - both))
    long_x, long_y = s + 1 + len(jx), s + 1 + len(jy)
    common = S._long(jx, jy)
    return max(100.0 * (1 - (len(jx) + len(jy) - 2 * common) / (long_x + long_y)), *(100.0 * (1 - (1 + n) / (s + long)) for n, long in ((len(jx), long_x), (len(jy), long_y))))


def fill(queries: DataFrame, items: DataFrame, limit: int) -> DataFrame:
    """qid, iid, raw: at least the best `limit` items of each query, of those without any of its words.

    queries: qid, found, q_phrase, q_action, q_unit, bar (its k-th score so far, or null).
    items: iid, phrase, action, unit_n, stems, name, ord.
    """
    size = F.length(F.array_join(F.array_sort(F.array_distinct(F.split("phrase", " "))), " "))
    cut = F.floor(F.row_number().over(Window.partitionBy("length", "_salt").orderBy("iid")) / BLOCK)
    # Items of one length are dealt to many windows before they are cut into blocks.
    dealt = items.select("iid", "phrase", "action", "unit_n", "stems", F.length("name").alias("size"), "ord", size.alias("length")).withColumn("_salt", F.pmod(F.xxhash64("iid"), F.lit(64)))
    counts = dealt.groupBy("length").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    dealt = dealt.join(counts, "length").withColumn("_salt", F.pmod("_salt", F.col("parts"))).withColumn("block", F.concat_ws("-", "length", "_salt", cut))
    dealt = written(dealt.drop("_salt", "parts"), "blocks")
    lengths = written(dealt.select("length", "block").distinct(), "lengths")
    text = F.array_distinct(F.filter(F.split("q_phrase", " "), lambda w: w != ""))
    asked = queries.withColumns({"q_length": F.length(F.array_join(text, " ")), "short": F.exists(text, lambda w: F.length(w) < HIT_LETTERS)})
    part = F.pmod(F.xxhash64("qid"), F.greatest(F.lit(1), F.ceil(F.lit(float(queries.count())) / QUERIES)).cast("long"))
    asked = written(asked.withColumn("part", part), "fill")
    top = lengths.agg(F.max("length")).first()[0] or 0  # one number

    def visited(which: Column) -> DataFrame:
        bound = F.when(F.col("short"), 100.0).otherwise(length_bound(F.col("q_length"), F.col("length")))
        seen = asked.withColumn("length", F.explode(F.sequence(F.lit(0), F.lit(top)))).where(which & (bound * (fixed.SIMILARITY_SHARE / 100) + fixed.UNIT_BONUS >= F.coalesce("bar", F.lit(-1e9)) - 0.1))
        left = seen.join(lengths, "length").select("block", "part", "qid", "found", "q_phrase", "q_action", "q_unit")
        pairs = written(left.select("block", "part").distinct(), "visits")
        right = dealt.join(pairs, "block").drop("length")

        def run(key, q: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(q) and len(rows):
                block, ids = Block(rows), rows["iid"].to_numpy()
                for r in q.itertuples(index=False):
                    found, score = block.best(r.q_phrase, r.q_action or "", r.q_unit or "", list(r.found), limit)
                    out.append(pd.DataFrame({"qid": r.qid, "iid": ids[found], "raw": score}))
            return pd.concat(out) if out else pd.DataFrame({"qid": [], "iid": [], "raw": []})

        found = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInPandas(run, "qid long, iid long, raw double")
        return written(found, "filled")

    near = length_bound(F.col("q_length"), F.col("length")) >= NEAR
    first = visited(near)
    order = Window.partitionBy("qid").orderBy(F.desc("raw"))
    best = first.withColumn("_n", F.row_number().over(order)).where(F.col("_n") == limit).select("qid", F.col("raw").alias("first_bar"))
    asked = written(asked.join(best, "qid", "left").withColumn("bar", F.greatest("bar", "first_bar")).drop("first_bar"), "fill")
    return first.unionByName(visited(~near))
