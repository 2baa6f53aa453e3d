import numpy as np
import pytest

from tidelane.llm import embeddings

SCHEMA = "vec_id long, embedding array<float>, label int, node string, list string"


def brute(rows, threshold=0.95):
    ok = [(i, v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)) for i, v in rows]
    n = len(rows)
    unit = [np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float)) if good and i is not None else None for (i, good), (_, v) in zip(ok, rows, strict=True)]
    link = np.zeros((n, n), bool)
    for a in range(n):
        for b in range(n):
            if a != b and unit[a] is not None and unit[b] is not None and len(unit[a]) == len(unit[b]):
                link[a, b] = unit[a] @ unit[b] >= threshold
    out = []
    for a in range(n):
        seen, todo = {a}, [a]
        while todo:
            for b in np.flatnonzero(link[todo.pop()]).tolist():
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        least = min((rows[b][0] for b in seen if rows[b][0] is not None), default=None)
        out.append((rows[a][0], int(link[a].sum()), least, True if rows[a][0] is None else rows[a][0] == least))
    return sorted(out, key=repr)


def corpus(seed, copies):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(12):
        base = rng.normal(size=16)
        rows += [(100 * k + c, (base + rng.normal(size=16) * rng.choice([0.02, 0.2, 0.35])).tolist()) for c in range(12)]
        rows += [(100 * k + 50 + c, (base * (1 + c)).tolist()) for c in range(3)]
    rows += [(5000 + c, rows[0][1]) for c in range(copies)]
    rows += [(7000, None), (7001, []), (7002, [0.0] * 16), (7003, [float("nan")] + [1.0] * 15), (7004, [None] + [1.0] * 15), (7005, [float("inf")] * 16), (None, rows[0][1]), (7, rows[0][1]), (7, rows[20][1]), (8000, [1.0, 2.0]), (8001, [2.0, 4.0]), (8002, [-0.0, 1.0]), (8003, [0.0, 1.0]), (8004, [1e-30] * 16), (8005, [1e30] * 16)]
    return rows


@pytest.mark.parametrize(("block", "queries"), [(2048, 16_384), (5, 7)])
def test_equals_brute_force(spark, block, queries):
    rows = corpus(block, 30)
    vectors = spark.createDataFrame([(i, v, 1, "x", "y") for i, v in rows], SCHEMA)
    got = embeddings.near_duplicates(vectors, list_vectors=20, block_vectors=block, block_queries=queries, probe_sigmas=None)
    assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in got.collect()), key=repr) == brute(rows)


def test_probes_and_codes_lose_no_pair():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 24))
    x = np.concatenate([x, x[:200] + 0.3 * rng.normal(size=(200, 24))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = embeddings.Index(x, 30, 0.8, None)
    near = index.nearest(x)
    codes, error = index.encode(x, near)
    probed = set(zip(*(k.tolist() for k in index.probes(x)), strict=True))
    pairs = np.argwhere(x @ x.T >= 0.8)
    assert len(pairs) > 900
    for a, b in pairs.tolist():
        assert (a, near[b]) in probed
        assert index.near_codes(x[a : a + 1], near[b], codes[b : b + 1], error[b : b + 1]).all()
    assert len(probed) < 800 * 30


def test_default_probes_reach_nearly_all_neighbours():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(2000, 64))
    x = np.concatenate([x, x[:1000] + 0.3 * rng.normal(size=(1000, 64))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = embeddings.Index(x, 30, 0.95)
    near = index.nearest(x)
    probed = set(zip(*(k.tolist() for k in index.probes(x)), strict=True))
    pairs = [(a, b) for a, b in np.argwhere(x @ x.T >= 0.95).tolist() if a != b]
    assert len(pairs) > 1000 and len(probed) < 0.6 * 3000 * 30
    assert sum((a, near[b]) in probed for a, b in pairs) >= 0.999 * len(pairs)


@pytest.mark.parametrize("intrinsic", [4, 8, 16, 32])
def test_default_probing_in_few_intrinsic_dimensions(spark, intrinsic):
    """Clustered vectors on random subspaces: links at both ends, nearly all of them."""
    rng = np.random.default_rng(intrinsic)
    base = rng.normal(size=(400, intrinsic)) @ rng.normal(size=(intrinsic, 48))
    x = np.concatenate([base, base[:300] + (0.25 * rng.normal(size=(300, intrinsic))) @ rng.normal(size=(intrinsic, 48))])
    vectors = spark.createDataFrame([(i, v.tolist(), 1, "x", "y") for i, v in enumerate(x)], SCHEMA)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(vectors, list_vectors=20).collect()}
    want = {i: (n, c) for i, n, c, _ in brute([(i, v.tolist()) for i, v in enumerate(x)])}
    assert sum(n for n, _ in want.values()) > 300
    assert sum(n for n, _ in got.values()) >= 0.99 * sum(n for n, _ in want.values())
    assert sum(n for n, _ in got.values()) % 2 == 0 and all(got[i][0] <= n for i, (n, _) in want.items())


def test_many_lists_in_two_levels():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = embeddings.Index(x, 1500, 0.95)
    assert 1300 < len(index.centroids) < 1700
    assert [embeddings.list_count(n) for n in (100, 100_000, 10_000_000, 10**12)] == [1, 390, 6324, 16_384]


def test_empty_tables(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    only = spark.createDataFrame([(1, None, 1, "", "")], SCHEMA)
    assert [tuple(r) for r in embeddings.near_duplicates(only).collect()] == [(1, 0, 1, True)]
