import os
import zlib

import numpy as np
import pytest

from tidelane.llm import quality

SCHEMA = "doc_id long, text string, lang string, source string, score string"
LABELS = "doc_id long, quality int, toxic int"
SMALL = "/root/testdata/sf0.01"


def test_logistic_matches_newton():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 4)).astype(np.float32)
    y = (x @ [1.0, -2.0, 0.5, 0] + rng.normal(size=400) > 0.3).astype(int)
    got = quality.logistic(x, y, np.ones(400), ridge=1e-2, rounds=3000)
    z, w = np.hstack([x, np.ones((400, 1))]), np.zeros(5)
    keep = np.diag([1e-2] * 4 + [0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z / 400 + keep, z.T @ (p - y) / 400 + keep @ w)
    assert np.allclose(got, w, atol=5e-3)


def test_views_teach_each_other():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 1000)
    text = np.stack([y * 2 - 1 + rng.normal(size=1000) * 0.4, rng.normal(size=1000)], axis=1).astype(np.float32)
    meta = np.stack([y * 2 - 1 + rng.normal(size=1000) * 0.4, rng.normal(size=1000)], axis=1).astype(np.float32)
    labels = np.where(np.arange(1000) < 60, y, -1)
    model = quality.Model(text, meta, labels, np.arange(1000) % 3 == 0)
    assert min(model.taught) > 0
    assert ((model.score(text, meta) > 0.5) == y).mean() > 0.97


def test_pools_agree_and_edges_count(spark):
    rng = np.random.default_rng(5)
    views = [rng.normal(size=(500, n)).astype(np.float16).astype(np.float32) for n in quality._SIZES]
    weights = [rng.normal(size=n + 1).astype(np.float32) / 6 for n in quality._SIZES]
    rows = spark.createDataFrame([(x.astype(np.float16).tobytes(), y.astype(np.float16).tobytes()) for x, y in zip(*views, strict=True)], "t binary, m binary").repartition(3)
    steps = [[(w, (quality.BINS // 40, 0.5), (-1, 0.0)) for w in weights]]
    for near, far in ((quality.Pool(views), quality.SparkPool(rows)),):
        assert np.allclose(near.certain(steps, weights), far.certain(steps, weights))
        assert np.allclose(near.moments(steps, weights), far.moments(steps, weights), rtol=1e-3, atol=1e-2)
    assert quality._edge(np.array([5, 4, 2]), 4) == (1, 0.5)
    assert quality._edge(np.array([5, 4, 2]), 11) == (-1, 0.0)


def test_all_unlabelled_documents_take_part(spark, monkeypatch):
    monkeypatch.setattr(quality, "MOST_UNLABELLED", 50, raising=False)
    docs, labels = corpus()
    docs += [(d + 1000, f"{t} {d}", "en", "rare", None) for d, t, *_ in docs[:300]]
    seen = []
    model = quality.Model
    monkeypatch.setattr(quality, "Model", lambda *a, pool=None, **k: seen.append(pool.rows.count() if pool else int((a[2] < 0).sum())) or model(*a, pool=pool, **k))
    quality.fit(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, LABELS))
    assert seen == [100 + 1 + 300]  # a null and an empty text have like features; a null id teaches nothing


def corpus():
    rng = np.random.default_rng(3)
    docs, labels = [], []
    for i in range(300):
        words = [f"w{x}" for x in rng.integers(0, 60, 60)]
        good = i % 3 > 0
        docs.append((i, " ".join(words) if good else " ".join(w.upper() + "###" for w in words), "en" if i % 2 else None, "s", None))
        if i < 200:
            labels.append((i, int(good), 0))
    docs += [(900, None, None, None, None), (901, "", None, None, None), (None, "w1 w2 w3", None, "s", None), (4, docs[4][1], "en", "s", None)]
    return docs, labels + [(None, 0, 1), (7000, None, None), (7001, 1, 1)]


def test_classify(spark):
    docs, labels = corpus()
    got = quality.classify(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == len(docs)
    for r in got:
        assert 0 <= r.score <= 1 and r.kept == (r.score >= 0.5)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        if r.doc_id is not None and r.doc_id < 300:
            assert r.kept == (r.doc_id % 3 > 0)


def test_without_labels(spark):
    docs = spark.createDataFrame(corpus()[0][:3], SCHEMA)
    assert [r.score for r in quality.classify(docs, spark.createDataFrame([], LABELS)).collect()] == [0.5] * 3
    assert quality.classify(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], LABELS)).collect() == []


@pytest.mark.skipif(not os.path.exists(SMALL), reason="no test tables")
def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.classify(docs, labels).where("held_out").join(labels, "doc_id").select("kept", "quality").collect()
    assert np.mean([r.kept == (r.quality == 1) for r in got]) >= 0.95
