import itertools

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidelane.llm import simhash

SCHEMA = "doc_id long, text string, fp string, mark string"


def plain(text, n=4):
    words = [w for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    grams = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def components(ids, fps, distance=4):
    root = list(range(len(ids)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(ids)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= distance:
            root[top(i)] = top(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return [least.get(top(i)) for i in range(len(ids))]


def corpus():
    rng = np.random.default_rng(7)
    rows = [(0, None), (1, ""), (2, "  \n"), (3, "One two"), (4, "one TWO"), (5, "É é x"), (5, "É é x"), (None, "one two"), (None, "alone here in this text"), (9, "É é X")]
    for k in range(6):
        base = [f"w{x}" for x in rng.integers(0, 1000, 400)]
        for c in range(8):
            words = list(base)
            for p in rng.integers(0, 400, c):
                words[p] = "edit"
            rows.append((100 + 10 * k + c, " ".join(words)))
    rows.append((900, " ".join(f"w{x}" for x in range(2600))))
    return rows


def test_fingerprints_and_components(spark):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, "clash", None) for d, t in rows], SCHEMA)
    got = simhash.near_duplicates(docs).collect()
    fps = [plain(t) for _, t in rows]
    want = sorted(((d, f"{f:016x}", c) for (d, _), f, c in zip(rows, fps, components([d for d, _ in rows], fps), strict=True)), key=repr)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=repr) == want
    assert any(len(list(g)) > 2 for _, g in itertools.groupby(sorted(c for _, _, c in want if c is not None)))


@pytest.mark.parametrize("blocks", [2, 3, 4, 5])
def test_neighbouring_cells_lose_no_link(blocks):
    """Of two fingerprints within four bits one lies in or visits a cell of the other in some grid."""
    rng = np.random.default_rng(blocks)
    base = rng.integers(0, 2**63, 120, dtype=np.uint64)
    flips = np.zeros(120, np.uint64)
    for _ in range(4):
        flips |= np.uint64(1) << rng.integers(0, 64, 120).astype(np.uint64)
    x, y = simhash.embed(base), simhash.embed(base ^ flips)
    assert (np.bitwise_count(x ^ y) <= np.bitwise_count(flips)).all()
    met = np.zeros(120, int)
    for segments in simhash.grids(blocks):
        here = simhash.mask(segments)
        met += (x ^ y) & here == 0
        for a, b in ((x, y), (y, x)):
            for at, moved in simhash.visits(a, segments, 4 // blocks):
                assert (np.bitwise_count((moved ^ a[at]) & here) <= 4 // blocks).all() and ((moved ^ a[at]) & ~here == 0).all()
                met[at] += (moved ^ b[at]) & here == 0
    assert (met > 0).all()


@pytest.mark.parametrize(("blocks", "distance"), [(1, 1), (2, 2), (2, 4), (3, 4), (4, 4), (5, 4), (4, 7)])
def test_radii_that_sum_to_less_lose_no_link(blocks, distance):
    """Links of every spread of flipped bits meet in some grid within its own radius."""
    radii = simhash.radii(blocks, distance)
    assert sum(radii) == distance + 1 - blocks and min(radii) >= 0
    rng = np.random.default_rng(10 * blocks + distance)
    base = rng.integers(0, 2**63, 600, dtype=np.uint64)
    flips = np.zeros(600, np.uint64)
    for k in range(distance):  # a third of the pairs differ within few segments, a third in one bit of each
        at = np.concatenate([rng.integers(0, 64, 200), rng.integers(20, 24, 200), (2 * (rng.integers(0, 32, 200) + 9 * k) + 1) % 64])
        flips |= np.uint64(1) << at.astype(np.uint64)
    x, y = simhash.embed(base), simhash.embed(base ^ flips)
    met = np.zeros(600, bool)
    for segments, radius in zip(simhash.grids(blocks), radii, strict=True):
        here = simhash.mask(segments)
        met |= (x ^ y) & here == 0
        for a, b in ((x, y), (y, x)):
            for at, moved in simhash.visits(a, segments, radius):
                met[at] |= (moved ^ b[at]) & here == 0
    assert met.all()


def test_keyed_rows_grow_in_step_with_the_fingerprints(spark):
    made = []
    for n in (40_000, 200_000):
        fps = spark.range(n).select(F.xxhash64("id").alias("fp"))
        blocks = simhash.blocks_for(n, 4)
        made.append(simhash._keyed(fps, blocks, 4).count())
        assert made[-1] < 20 * n and abs(made[-1] / n - simhash.rows_each(blocks, 4)) < 0.5
    assert made[1] < 5.5 * made[0]


def test_a_fullest_cell_fits_a_task():
    for distance in range(9):
        for n in (0, 1, 10**6, 10**8, 10**10, 10**12):
            blocks = simhash.blocks_for(n, distance)
            assert blocks == 1 or n * 0.5 ** (32 // blocks) * (1 + 32 // blocks / 2) <= simhash.ROWS_PER_CELL


def test_every_neighbour_is_visited_once_and_one_way():
    e = simhash.embed(np.array([0b00_01_11_00, 0b01_11_00_01], np.uint64))
    segments = range(4)
    cells = [int(m) for at, moved in simhash.visits(e[:1], segments, 2) for m in moved]
    counts = lambda c: [(c >> 2 * s & 3).bit_count() for s in segments]
    own = counts(int(e[0]))
    near = [c for c in np.ndindex(3, 3, 3, 3) if 0 < sum(abs(a - b) for a, b in zip(c, own, strict=True)) <= 2]
    up = [c for c in near if next(a - b for a, b in zip(c, own, strict=True) if a != b) > 0]
    assert sorted(tuple(counts(c)) for c in cells) == sorted(up)


def test_more_fingerprints_get_finer_cells():
    assert [simhash.blocks_for(n, 4) for n in (100, 300_000, 10**9)] == sorted([simhash.blocks_for(n, 4) for n in (100, 300_000, 10**9)], reverse=True)
    assert simhash.blocks_for(300_000, 4) == 3 and simhash.blocks_for(10**9, 4) == 2


@pytest.mark.parametrize(("size", "large"), [(20, 2048), (200, 2048), (200, 50)])
def test_cells_join_what_is_linked(size, large, monkeypatch):
    monkeypatch.setattr(simhash, "_LARGE", large)
    rng = np.random.default_rng(size)
    fp = np.unique(np.concatenate([rng.integers(0, 2**62, 5)[:, None] ^ (1 << rng.integers(0, 30, size))[None, :]]).ravel())
    u, v = simhash.linked_in_cells(np.zeros(len(fp), np.int64), fp, np.ones(len(fp), bool), 4)
    root = {int(a): int(a) for a in fp}

    def top(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in zip(u.tolist(), v.tolist(), strict=True):
        assert (a ^ b).bit_count() <= 4
        root[top(a)] = top(b)
    got = [top(int(a)) for a in fp]
    want = components(list(range(len(fp))), [int(a) for a in fp])
    pairs = lambda x: {(i, j) for i, j in itertools.combinations(range(len(x)), 2) if x[i] == x[j]}
    assert pairs(got) == pairs(want)


def test_keep_one(spark):
    rows = [(1, "a b c d e"), (2, "a b c d e"), (2, "other words are in here"), (2, "other words are in here"), (None, "a b c d e")]
    docs = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], SCHEMA)
    got = simhash.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted([(1, "a b c d e"), (2, "other words are in here"), (None, "a b c d e")], key=repr)


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(empty).collect() == [] and simhash.keep_one(empty).collect() == []
