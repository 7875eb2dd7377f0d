from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tallyspark.llm import quality as Q


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    known = labels.where(F.col("doc_id") % 3 != 0)
    got = {r.doc_id: r for r in Q.classify(docs, known).collect()}
    assert len(got) == docs.count()
    rest = [(got[r.doc_id], r.quality) for r in labels.where(F.col("doc_id") % 3 == 0).collect()]
    right = np.mean([g.kept == bool(q) for g, q in rest])
    good = np.mean([g.kept for g, q in rest if q == 1])
    poor = np.mean([not g.kept for g, q in rest if q == 0])
    print(right, good, poor)
    assert right > 0.97 and good > 0.98 and poor > 0.9
    brier = np.mean([(g.score - q) ** 2 for g, q in rest])
    assert brier < 0.03


def test_a_view_can_teach_the_other():
    rng = np.random.default_rng(1)
    y = (rng.random(4000) < 0.5).astype(np.float32)
    view = lambda noise: (y[:, None] * 2 - 1 + noise * rng.normal(size=(4000, 6))).astype(np.float32)
    a, b = view(0.7), view(1.5)
    few = slice(0, 40)
    taught, alone = Q.co_train(a[few], b[few], y[few], a[40:2000], b[40:2000]), Q.co_train(a[few], b[few], y[few], a[:0], b[:0])
    of = lambda v: ((v.score(a[2000:], b[2000:])[2] > 0.5) == y[2000:]).mean()
    assert of(taught) > of(alone)
    assert ((taught.score(a[2000:], b[2000:])[0] > 0.5) == y[2000:]).mean() > 0.97


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, None, None, None, 1.0), (None, "", "s", "en", 0, 2.0), (2, "x " * 600_000, "s", None, 1200000, None), (2, "x", None, None, -5, None)], "doc_id long, text string, source string, lang string, n_chars long, score double")
    for labels, want in (([], 0.5), ([(1, 1, 0), (2, 1, 1), (2, 1, 1)], 1.0), ([(1, None, 0), (2, 1, 1), (2, 0, 1), (None, 0, 0)], 1.0)):
        got = Q.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
        assert len(got) == 4 and {r.score for r in got} == {want}
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    many = spark.createDataFrame([(i, "good words here" if i % 2 else "%%% $$$ ###", "s", "en", 9) for i in range(40)], "doc_id long, text string, source string, lang string, n_chars long")
    assert all(r.kept == bool(r.doc_id % 2) for r in Q.classify(many, labels).collect())
    assert Q.classify(docs.limit(0), labels).collect() == []


def test_against_brute_force(spark, sf_dir):
    """The same rounds over rows that are collected and read one by one give the same scores."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    absent = spark.createDataFrame([(10**7 + i, i % 2) for i in range(50)], "doc_id long, quality int")
    got = {r.doc_id: r for r in Q.classify(docs, labels.select("doc_id", "quality").union(absent)).collect()}
    rows = docs.withColumn("lot", F.xxhash64("doc_id")).orderBy("lot", "doc_id").collect()
    votes = {}
    for r in labels.collect():
        votes.setdefault(r.doc_id, []).append(r.quality)
    known = [r for r in rows if r.doc_id in votes]
    free = [r for r in rows if r.doc_id not in votes]
    assert 8 <= len(known) <= Q.LABELLED and 8 <= len(rows) <= Q.POOL
    text = lambda rs: np.stack([Q.text_features(r.text) for r in rs])
    meta = lambda rs: np.stack([Q.meta_features(r.source, r.lang, r.n_chars) for r in rs])
    y = np.array([float(np.mean(votes[r.doc_id]) >= 0.5) for r in known], np.float32)
    out = np.arange(len(y)) % 4 == 3
    views = [(text(known), text(free)), (meta(known), meta(free))]
    extra = [({}), ({})]  # labels that a view was given, by row of free
    for k in range(Q.ROUNDS + 1):
        models, cal = [], []
        for v, (x, pool) in enumerate(views):
            r = sorted(extra[v])
            models.append(Q.fit_logistic(np.concatenate([x[~out], pool[r]]), np.array([*y[~out], *(extra[v][i] for i in r)], np.float32)))
            cal.append(Q.fit_logistic((x[out] @ models[v][:-1] + models[v][-1])[:, None], y[out], l2=1e-3))
        if k < Q.ROUNDS:
            for v, (_, pool) in enumerate(views):
                p = 1 / (1 + np.exp(-(cal[v][0] * (pool @ models[v][:-1] + models[v][-1]) + cal[v][1])))
                for i in range(len(p)):
                    if p[i] >= Q.CONFIDENT or p[i] <= 1 - Q.CONFIDENT:
                        extra[1 - v][i] = float(p[i] > 0.5)
    margin = lambda v, x: cal[v][0] * (x @ models[v][:-1] + models[v][-1]) + cal[v][1]
    both = Q.fit_logistic(np.c_[margin(0, views[0][0][out]), margin(1, views[1][0][out])], y[out], l2=1e-3)
    for r in rows:
        want = 1 / (1 + np.exp(-(both[0] * margin(0, text([r]))[0] + both[1] * margin(1, meta([r]))[0] + both[2])))
        assert abs(got[r.doc_id].score - want) < 1e-3
    assert max(len(e) for e in extra) > 0 and len(got) == len(rows)
