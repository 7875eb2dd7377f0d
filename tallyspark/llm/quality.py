"""Quality classifier by co-training of two views.

The text view sees the text alone (hashed byte trigrams and shape), the metadata view the
row's metadata alone (source, lang, n_chars). Each is a logistic model. Both learn from a
bounded sample of labelled rows; then, for some rounds, each view labels those rows of a
bounded unlabelled pool that it is confident about, and the other learns from them. On a
fold that was kept out, each view is calibrated (Platt scaling) and a last logistic model
combines the calibrated views. All documents are scored over their whole texts.

Bounds: LABELLED rows with a label and POOL rows without are used at most, the first by a
hash of doc_id; models are fitted on the driver from these alone. Both are parameters of
learn(); README has the accuracy at other sizes of the pool.

Defined results: a null text counts as empty, null metadata as a value of its own; labels
that contradict each other count by majority, ties as good; without any label, or with
labels of one kind only, every score is that kind's share (0.5 without labels); rows that
repeat a doc_id are scored each; other columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import by_batch, record

LABELLED, POOL, ROUNDS, CONFIDENT = 6000, 4000, 3, 0.97
TEXT_DIMS, META_DIMS, SHAPE = 1024, 128, 12
KEEP_FROM = 0.5


def text_features(text: str | None) -> np.ndarray:
    """Shape of the text and its hashed byte trigrams, as one vector."""
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n, words = max(1, len(raw)), text.split()
    counts = np.bincount(raw, minlength=256)
    upper, lower, digit = counts[65:91].sum(), counts[97:123].sum(), counts[48:58].sum()
    space, line, high = counts[32], counts[10], counts[128:].sum()
    other = len(raw) - upper - lower - digit - space - line - high
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    shape = [
        upper / n, lower / n, digit / n, space / n, min(1.0, 20 * line / n), high / n, other / n, min(1.0, 5 * other / n),
        len(set(words)) / max(1, len(words)), again / max(1, len(words)), np.log1p(len(words)) / 10, min(1.0, n / max(1, len(words)) / 20),
    ]
    out = np.zeros(SHAPE + TEXT_DIMS, np.float32)
    out[:SHAPE] = shape
    if len(raw) > 2:
        for at in range(0, len(raw) - 2, 1 << 20):
            x = raw[at : at + (1 << 20) + 2].astype(np.uint32)
            mixed = (x[:-2] * np.uint32(0x9E3779B1)) ^ (x[1:-1] * np.uint32(0x85EBCA77)) ^ (x[2:] * np.uint32(0xC2B2AE3D))
            out[SHAPE:] += np.bincount((mixed * np.uint32(0x27D4EB2F)) >> np.uint32(22), minlength=TEXT_DIMS)
        out[SHAPE:] = np.sqrt(out[SHAPE:] / (len(raw) - 2))
    return out


def meta_features(source, lang, n_chars) -> np.ndarray:
    out = np.zeros(META_DIMS, np.float32)
    out[zlib.crc32(f"source={source}".encode()) % 80] = 1
    out[80 + zlib.crc32(f"lang={lang}".encode()) % 32] = 1
    out[112 + (15 if n_chars is None else min(14, int(np.log2(max(0, n_chars) + 1))))] = 1
    return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-4, steps: int = 250, rate: float = 0.1) -> np.ndarray:
    """Weights of a logistic model, the last for the constant; Adam over all rows."""
    x = np.c_[x, np.ones(len(x), np.float32)].astype(np.float32)
    w, m, v = (np.zeros(x.shape[1], np.float32) for _ in range(3))
    for t in range(1, steps + 1):
        g = x.T @ (_sigmoid(x @ w) - y).astype(np.float32) / len(y) + l2 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _margin(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.asarray(x) @ w[:-1] + w[-1]


class Views:
    """The fitted views, their calibrations and the combination."""

    def __init__(self, share: float, models=None):
        self.share, self.models = share, models

    def score(self, text_x: np.ndarray, meta_x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Combined score, text score, metadata score."""
        if self.models is None:
            flat = np.full(len(text_x), self.share)
            return flat, flat, flat
        wt, wm, ct, cm, both = self.models
        a, b = ct[0] * _margin(wt, text_x) + ct[1], cm[0] * _margin(wm, meta_x) + cm[1]
        return _sigmoid(both[0] * a + both[1] * b + both[2]), _sigmoid(a), _sigmoid(b)


def co_train(text_x, meta_x, y, pool_text, pool_meta, rounds: int = ROUNDS) -> Views:
    """y: 1 good, 0 not, for the labelled rows. Every fourth of them is kept out to calibrate."""
    share = float(y.mean()) if len(y) else 0.5
    if len(y) < 8 or share in (0.0, 1.0):
        return Views(share)
    out = np.arange(len(y)) % 4 == 3
    if len(set(y[out])) < 2 or len(set(y[~out])) < 2:
        out = np.zeros(len(y), bool)
    fold = out if out.any() else ~out
    x = [text_x[~out], meta_x[~out]]
    pools, given = [pool_text, pool_meta], [{}, {}]  # row of the pool -> label that the other view gave
    weights = calibration = None
    for k in range(rounds + 1):
        weights, calibration = [], []
        for v in (0, 1):
            rows = sorted(given[v])
            xs = np.concatenate([x[v], pools[v][rows]]) if rows else x[v]
            ys = np.r_[y[~out], [given[v][r] for r in rows]] if rows else y[~out]
            weights.append(fit_logistic(xs, ys))
            labelled = text_x if v == 0 else meta_x
            calibration.append(fit_logistic(_margin(weights[v], labelled[fold])[:, None], y[fold], l2=1e-3))
        if k == rounds or not len(pool_text):
            break
        for v in (0, 1):  # this view's confident labels are for the other one
            p = _sigmoid(calibration[v][0] * _margin(weights[v], pools[v]) + calibration[v][1])
            given[1 - v] |= {int(r): float(p[r] > 0.5) for r in np.flatnonzero((p >= CONFIDENT) | (p <= 1 - CONFIDENT))}
    a, b = (c[0] * _margin(w, z[fold]) + c[1] for c, w, z in zip(calibration, weights, (text_x, meta_x), strict=True))
    both = fit_logistic(np.c_[a, b], y[fold], l2=1e-3)
    return Views(share, (*weights, *calibration, both))


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source"),
        F.col("lang").cast("string").alias("lang"), F.col("n_chars").cast("long").alias("n_chars"),
    )


def _meta(batch: pa.RecordBatch) -> np.ndarray:
    rows = zip(*(batch.column(k).to_pylist() for k in ("source", "lang", "n_chars")), strict=True)
    return np.array([meta_features(*r) for r in rows], np.float32).reshape(-1, META_DIMS)


def _text(batch: pa.RecordBatch) -> np.ndarray:
    return np.array([text_features(t) for t in batch.column("text").to_pylist()], np.float32).reshape(-1, SHAPE + TEXT_DIMS)


def learn(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, pool: int = POOL) -> Views:
    """Fit on at most so many rows with and without a label."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))
    lot = F.xxhash64("doc_id")
    there = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where(F.col("doc_id").isNotNull())
    # Labels of absent documents do not use up the bound.
    taken = known.join(there, "doc_id", "left_semi").orderBy(lot, "doc_id").limit(labelled)
    free = there.distinct().orderBy(lot.desc(), "doc_id").limit(pool)
    # Rows are few by construction, so they may be broadcast.
    ids = taken.unionByName(free.withColumn("quality", F.lit(None).cast("int"))).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = _columns(docs).join(F.broadcast(ids), "doc_id")

    def features(batch: pa.RecordBatch) -> pa.RecordBatch:
        names = {"doc_id": pa.int64(), "quality": pa.int32(), "t": pa.binary(), "m": pa.binary()}
        return record(names, doc_id=batch.column("doc_id"), quality=batch.column("quality"), t=[x.tobytes() for x in _text(batch)], m=[x.tobytes() for x in _meta(batch)])

    got = by_batch(rows, features, "doc_id long, quality int, t binary, m binary").dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id")
    got = got.limit(labelled + pool).collect()
    of = lambda kind, want, n: np.array([np.frombuffer(r[kind], np.float32) for r in got if (r["quality"] is not None) == want], np.float32).reshape(-1, n)
    y = np.array([r["quality"] for r in got if r["quality"] is not None], np.float32)
    return co_train(of("t", True, SHAPE + TEXT_DIMS), of("m", True, META_DIMS), y, of("t", False, SHAPE + TEXT_DIMS), of("m", False, META_DIMS))


def score(docs: DataFrame, views: Views) -> DataFrame:
    """doc_id, score, text_score, meta_score, kept: one row per row of docs."""
    names = {"doc_id": pa.int64(), "score": pa.float64(), "text_score": pa.float64(), "meta_score": pa.float64(), "kept": pa.bool_()}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        s, t, m = views.score(_text(batch), _meta(batch))
        return record(names, doc_id=batch.column("doc_id"), score=s.tolist(), text_score=t.tolist(), meta_score=m.tolist(), kept=(s >= KEEP_FROM).tolist())

    return by_batch(_columns(docs), run, "doc_id long, score double, text_score double, meta_score double, kept boolean", rows=200)


def classify(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, pool: int = POOL) -> DataFrame:
    return score(docs, learn(docs, labels, labelled, pool))
