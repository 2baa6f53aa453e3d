"""Embedding near-duplicates by product quantisation (operator 1).

Vectors are compared as unit vectors, where a cosine of at least ``threshold``
is a distance of at most ``delta``.  An inverted file deals every vector to the
list of its nearest coarse centroid and stores its residual's subspace codes
with the exact quantisation error.  A query probes the lists that can hold a vector
within ``delta`` of it, compares codes by asymmetric table lookups, passes all
that the error allows, and reranks by the exact cosine in double precision.

Probing is exact if ``probe_sigmas`` is None (see ``Index.probes``), but then a
query in many dimensions visits most lists.  By default the bound is taken
``probe_sigmas`` standard deviations out for a neighbour whose direction is like
those of the residuals around it; their spread is measured list by list on the
training sample, so that in few intrinsic dimensions the bound becomes the exact
one.  A link counts at both ends, whichever side's probes found it.  The later steps
lose nothing.

Equal vectors are one class with a count, so copies are never paired out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelane.llm.common import col, components, save, spanning_stars

THRESHOLD = 0.95
#: Distinct vectors that train the index, those with the least hashes; for many lists
#: so many a list.
TRAINING_VECTORS, TRAINING_A_LIST = 20_000, 16
#: Vectors in a list, by expectation, while there are no more lists than ``FLAT_LISTS``.
#: Beyond, lists grow as twice the square root of the vectors, in two levels, up to a
#: model of ``MOST_LISTS`` centroids; longer lists are split into blocks.
LIST_VECTORS, FLAT_LISTS, MOST_LISTS = 256, 1024, 16_384
PROBE_SIGMAS = 3.0
SUBSPACES, CODEWORDS = 8, 256
#: Longer lists are split into blocks of about this many vectors, their queries likewise.
BLOCK_VECTORS, BLOCK_QUERIES = 2048, 16_384
_QUERIES = 512
_SLACK = 1e-9


def _unit(raw: list[bytes], kind: str) -> np.ndarray:
    x = np.stack([np.frombuffer(b, kind) for b in raw]).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Lloyd's algorithm."""
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = np.argmax(x @ c.T - (c * c).sum(axis=1) / 2, axis=1)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def _two_level_means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """``k`` centroids; many are found within coarser cells, a share of each by its vectors."""
    if k <= FLAT_LISTS:
        return _means(x, k, rounds, rng)
    coarse = _means(x, int(np.sqrt(k)), rounds, rng)
    cell = np.argmax(x @ coarse.T - (coarse * coarse).sum(axis=1) / 2, axis=1)
    return np.concatenate([_means(part, max(1, round(k * len(part) / len(x))), rounds, rng) for part in (x[cell == c] for c in range(len(coarse))) if len(part)])


def list_count(n: int, list_vectors: int = LIST_VECTORS) -> int:
    return max(1, min(n // list_vectors, max(FLAT_LISTS, int(2 * n**0.5)), MOST_LISTS))


def _spread(residuals: np.ndarray, near: np.ndarray, lists: int) -> np.ndarray:
    """For each list the root mean square of the cosine between two residuals: 1 / sqrt(d) in d dimensions.

    Lists with few sampled vectors take the greater of their own and all lists' value.
    """
    size = np.sqrt((residuals * residuals).sum(axis=1))
    unit = residuals[size > 1e-12] / size[size > 1e-12][:, None]
    near = near[size > 1e-12]
    order = np.argsort(near, kind="stable")
    cuts = np.searchsorted(near[order], np.arange(lists + 1))
    total, pairs = np.zeros(lists), np.zeros(lists)
    for c, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        u = unit[order[a : min(b, a + 256)]]
        if len(u) > 1:
            total[c], pairs[c] = ((u @ u.T) ** 2).sum() - len(u), len(u) * (len(u) - 1)
    every = total.sum() / pairs.sum() if pairs.sum() else 1.0
    own = np.divide(total, pairs, out=np.full(lists, every), where=pairs > 0)
    return np.sqrt(np.where(pairs >= 30 * 29, own, np.maximum(own, every)))


class Index:
    """Coarse centroids and residual codebooks; of bounded size, so it is shipped in closures."""

    def __init__(self, sample: np.ndarray, lists: int, threshold: float, probe_sigmas: float | None = PROBE_SIGMAS, subspaces: int = SUBSPACES, codewords: int = CODEWORDS) -> None:
        rng = np.random.default_rng(17)
        self.delta = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + _SLACK
        self.centroids = _two_level_means(sample, min(lists, len(sample)), 10, rng)
        near = self.nearest(sample)
        residuals = sample - self.centroids[near]
        spread = np.ones(len(self.centroids)) if probe_sigmas is None else np.minimum(1.0, probe_sigmas * _spread(residuals, near, len(self.centroids)))
        self.reach = self.delta * spread
        edges = np.linspace(0, sample.shape[1], min(subspaces, sample.shape[1]) + 1).astype(int)
        self.parts = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
        self.books = [_means(residuals[:, a:b], min(codewords, len(sample)), 6, rng) for a, b in self.parts]

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Greater for nearer centroids: x.c - |c|^2 / 2."""
        return x @ self.centroids.T - (self.centroids**2).sum(axis=1) / 2

    def nearest(self, x: np.ndarray) -> np.ndarray:
        return np.argmax(self.scores(x), axis=1)

    def encode(self, x: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Residual codes, and each vector's distance from what they stand for."""
        r = x - self.centroids[near]
        codes = np.stack([np.argmax(r[:, a:b] @ book.T - (book * book).sum(axis=1) / 2, axis=1) for (a, b), book in zip(self.parts, self.books, strict=True)], axis=1)
        left = r - np.concatenate([book[codes[:, k]] for k, book in enumerate(self.books)], axis=1)
        return codes.astype(np.uint8), np.sqrt((left * left).sum(axis=1))

    def probes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row, list): the lists that may hold a vector within delta.

        If y lies in list c, then score_c(y) >= score_b(y) for the query's own
        list b; the difference changes by (q - y).(b - c) between q and y, which is
        at most delta |b - c|, and for a random direction in d dimensions has a
        standard deviation of delta |b - c| / sqrt(d).
        """
        return np.nonzero(self.probed(x))

    def probed(self, x: np.ndarray) -> np.ndarray:
        """Whether each row probes each list."""
        s = self.scores(x)
        best = np.argmax(s, axis=1)
        gap = s[np.arange(len(x)), best][:, None] - s
        own, square = self.centroids[best], (self.centroids**2).sum(axis=1)
        apart = np.sqrt(np.maximum(square[best][:, None] + square - 2 * own @ self.centroids.T, 0))
        return gap <= self.reach[best][:, None] * apart + _SLACK

    def near_codes(self, q: np.ndarray, c: int, codes: np.ndarray, error: np.ndarray) -> np.ndarray:
        """Which (query, vector) pairs of list c the looked-up distances allow."""
        r = q - self.centroids[c]
        total = np.zeros((len(q), len(codes)), np.float64)
        for k, ((a, b), book) in enumerate(zip(self.parts, self.books, strict=True)):
            d = r[:, a:b]
            table = (d * d).sum(axis=1)[:, None] - 2 * d @ book.T + (book * book).sum(axis=1)
            total += table[:, codes[:, k]]
        return total <= (self.delta + error + 1e-6) ** 2


def _raw_rows(vectors: DataFrame, vec_id: str, embedding: str, kind: str) -> DataFrame:
    """Rows (vec_id, raw): the vector's bytes, or null if it links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = []
            for key, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = x.values
                if key is None or x is None or x.null_count or not len(x):
                    raw.append(None)
                    continue
                v = x.to_numpy(zero_copy_only=False) + 0  # -0.0 becomes 0.0
                raw.append(v.astype(kind).tobytes() if np.isfinite(v).all() and v.any() else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=["vec_id", "raw"])

    return vectors.select(col(vec_id).cast("long").alias("vec_id"), col(embedding).alias("embedding")).mapInArrow(run, "vec_id long, raw binary")


_BASE = "list int, block int, part int, query boolean, node long, n long, raw binary, codes binary, error double"


def _deal(classes: DataFrame, index: Index, kind: str, blocks: np.ndarray | None, parts: np.ndarray | None = None) -> DataFrame:
    """Every class in its list, and as a query in the lists it probes.

    A list has ``blocks`` of vectors and ``parts`` of queries, and a row for every
    block meets every part; without them only (list, query) are returned, to count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.float64())
        names = ["list", "block", "part", "query", "node", "n", "raw", "codes", "error"]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                node, n, raw = (part.column(k).to_pylist() for k in range(3))
                x = _unit(raw, kind)
                near = index.nearest(x)
                row, probe = index.probes(x)
                if blocks is None:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([near, probe]), pa.int32()), pa.array(np.arange(len(near) + len(probe)) >= len(near))], names=["list", "query"])
                    continue
                codes, error = index.encode(x, near)
                own = [(int(c), node[i] % int(blocks[c]), p, False, node[i], n[i], raw[i], codes[i].tobytes(), float(error[i])) for i, c in enumerate(near) for p in range(int(parts[c]))]
                asks = [(int(c), b, node[i] % int(parts[c]), True, node[i], n[i], raw[i], None, None) for i, c in zip(row.tolist(), probe.tolist(), strict=True) for b in range(int(blocks[c]))]
                yield pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(zip(*(own + asks), strict=True), types, strict=True)], names=names)

    return classes.select("node", "n", "raw").mapInArrow(run, "list int, query boolean" if blocks is None else _BASE)


def _compare(index: Index, kind: str, threshold: float):
    def run(table: pa.Table) -> pa.Table:
        asks = table.column("query").to_numpy(zero_copy_only=False)
        node, n = table.column("node").to_numpy(), table.column("n").to_numpy()
        own, ask = np.flatnonzero(~asks), np.flatnonzero(asks)
        kinds, a, b = [], [], []
        if len(own) and len(ask):
            raw = table.column("raw").to_pylist()
            c = int(table.column("list")[0].as_py())
            base = _unit([raw[i] for i in own.tolist()], kind)
            codes = np.stack([np.frombuffer(x, np.uint8) for x in table.column("codes").take(pa.array(own)).to_pylist()])
            error = table.column("error").take(pa.array(own)).to_numpy()
            order = np.argsort(node[ask], kind="stable")
            ask = ask[order]
            for at in range(0, len(ask), _QUERIES):
                part = ask[at : at + _QUERIES]
                q = _unit([raw[i] for i in part.tolist()], kind)
                i, j = np.nonzero(index.near_codes(q, c, codes, error))
                linked = np.zeros(len(i), bool)
                for k in range(0, len(i), 65_536):
                    s = slice(k, k + 65_536)
                    linked[s] = np.einsum("ij,ij->i", q[i[s]], base[j[s]]) >= threshold
                linked &= node[part[i]] != node[own[j]]
                i, j = i[linked], j[linked]
                count = np.zeros(len(table), np.int64)
                np.add.at(count, part[i], n[own[j]])
                # the other end counts the link here if it does not probe the query's list itself
                some, place = np.unique(j, return_inverse=True)
                deaf = ~index.probed(base[some])[place, index.nearest(q)[i]] if len(some) else np.zeros(0, bool)
                np.add.at(count, own[j[deaf]], n[part[i[deaf]]])
                hit = np.flatnonzero(count)
                u, v = spanning_stars(node[part[i]], node[own[j]])
                kinds.append(np.repeat([0, 1], [len(hit), len(u)]))
                a.append(np.concatenate([node[hit], u]))
                b.append(np.concatenate([count[hit], v]))
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return pa.Table.from_arrays([pa.array(join(x).astype(t), k) for x, t, k in ((kinds, np.int32, pa.int32()), (a, np.int64, pa.int64()), (b, np.int64, pa.int64()))], names=["kind", "a", "b"])

    return run


def near_duplicates(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD, list_vectors: int = LIST_VECTORS, block_vectors: int = BLOCK_VECTORS, block_queries: int = BLOCK_QUERIES, probe_sigmas: float | None = PROBE_SIGMAS) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one per vector.

    Vectors that are null, empty, zero or hold null or non-finite components link
    with nothing; so do rows whose vec_id is null (their component_id is null and
    they are kept), and vectors of differing length never link.  Rows that share
    a vec_id count as vectors of their own under one id; a component's id is the
    least vec_id in it.  An empty table gives no rows.
    """
    kind = "<f4" if "float" in dict(vectors.dtypes)[embedding] else "<f8"
    rows = save(_raw_rows(vectors, vec_id, embedding, kind), "vectors")
    valid = rows.where("raw IS NOT NULL")
    classes = valid.groupBy("raw").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"))
    classes = save(classes.withColumn("node", F.monotonically_increasing_id()), "vector-classes")
    found = [_linked(classes.where(F.length("raw") == r["size"]), kind, r["n"], threshold, list_vectors, block_vectors, block_queries, probe_sigmas) for r in classes.groupBy(F.length("raw").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy("size").collect()]
    if not found:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    links = save(links, "vector-links")
    counts = links.where("kind = 0").groupBy("a").agg(F.sum("b").alias("links")).withColumnRenamed("a", "node")
    roots = components(links.where("kind = 1").select("a", "b"))
    rooted = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    known = rooted.join(least, "root").join(counts, "node", "left").select("raw", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    got = rows.where("raw IS NOT NULL").join(known, "raw").select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    rest = rows.where("raw IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    return got.unionByName(rest)


def _linked(classes: DataFrame, kind: str, n: int, threshold: float, list_vectors: int, block_vectors: int, block_queries: int, probe_sigmas: float | None) -> DataFrame:
    """Rows (kind, a, b): 0 with a node and its links in a block, 1 with an edge."""
    lists = list_count(n, list_vectors)
    sample = classes.select("raw").orderBy(F.xxhash64("raw"), "raw").limit(max(TRAINING_VECTORS, TRAINING_A_LIST * lists)).collect()
    index = Index(_unit([bytes(r["raw"]) for r in sample], kind), lists, threshold, probe_sigmas)
    sizes = np.zeros((2, len(index.centroids)), np.int64)
    for r in _deal(classes, index, kind, None).groupBy("list", "query").count().collect():
        sizes[int(r["query"]), r["list"]] = r["count"]
    blocks, parts = np.maximum(1, -(-sizes[0] // block_vectors)), np.maximum(1, -(-sizes[1] // block_queries))
    return _deal(classes, index, kind, blocks, parts).groupBy("list", "block", "part").applyInArrow(_compare(index, kind, threshold), "kind int, a long, b long")
