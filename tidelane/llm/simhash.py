"""SimHash near-duplicates with a segment-popcount embedding (operator 3).

A fingerprint's 64 bits are 32 segments of two; the embedding holds each
segment's bit count.  Manhattan distance between embeddings never exceeds
Hamming distance, so pairs within ``distance`` bits are found by a range join
under Manhattan distance and then verified on the bits.

The range join runs on grids: the segments are dealt to B blocks, one grid each, whose
cells are keyed by the counts in the block.  Every block has a radius, and these sum to
r + 1 - B: two embeddings beyond the radius in every block are at a Manhattan distance
over r.  So every fingerprint lies in its own cell of each grid and visits the
neighbouring cells within the block's radius; of two neighbours one visits the other.
B does not follow the number of fingerprints until a cell would outgrow a task, so the
keyed rows grow in step with the fingerprints, about 19 each at four bits.  No cell is
capped; a large one is joined on equal stretches of bits, of which any pair within
``distance`` bits has one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelane.llm.common import as_bytes, col, components, mix, save, slices, spanning_stars, thrifty

SHINGLE = 4
DISTANCE = 4
SEED = 42
#: Keyed rows that one task compares, by expectation.
ROWS_PER_TASK = 1_000_000
#: Keyed rows that the fullest cell may hold, by expectation; a cell is one task's.
ROWS_PER_CELL = 2_000_000
_CHUNK = 1_000_000
#: Cells up to this many members are compared in step, all cells at once; larger ones
#: than the second number are split by stretches of bits.
_SMALL, _LARGE = 32, 2048
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def _bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the unsigned 64-bit values have each bit set."""
    octets = h.astype("<u8").view(np.uint8).reshape(-1, 8)
    if len(h) < 2000:
        return np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BITS for k in range(8)])


def fingerprint(raw: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint of one text, unsigned; no words give zero."""
    from xxhash import xxh64_intdigest as digest

    words = raw.lower().split() if raw else []
    if not words:
        return 0
    size = min(shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    lo, hi = starts[: len(words) - size + 1], ends[size - 1 :] - 1
    counts = np.zeros(64, np.int64)
    for at in range(0, len(lo), _CHUNK):
        h = [digest(joined[a:b], seed) for a, b in zip(lo[at : at + _CHUNK].tolist(), hi[at : at + _CHUNK].tolist(), strict=True)]
        counts += _bit_counts(np.array(h, np.uint64))
    return int(sum(1 << k for k in np.flatnonzero(2 * counts > len(lo)).tolist()))


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Rows (doc_id, mark, fp): mark is the text's xxhash64, fp the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fp = np.array([fingerprint(x, shingle) for x in as_bytes(batch.column(2))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp)], names=["doc_id", "mark", "fp"])

    rows = docs.select(col(doc_id).cast("long").alias("doc_id"), F.xxhash64(col(text)).alias("mark"), col(text).cast("string").alias("text"))
    return rows.mapInArrow(thrifty(run), "doc_id long, mark long, fp long")


_ODD = np.uint64(0x5555555555555555)


def embed(x: np.ndarray) -> np.ndarray:
    """The 32 two-bit segments' counts, each in unary: 0 as 00, 1 as 01, 2 as 11.

    The Manhattan distance of two embeddings is the popcount of their XOR.
    """
    low, high = x & _ODD, (x >> np.uint64(1)) & _ODD
    return (low | high) | ((low & high) << np.uint64(1))


def grids(blocks: int) -> list[range]:
    """The segments of each block."""
    edges = [round(k * 32 / blocks) for k in range(blocks + 1)]
    return [range(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def mask(segments: range) -> np.uint64:
    """The bits of the embedding that make a grid's cells."""
    return np.uint64(sum(3 << 2 * s for s in segments))


def visits(e: np.ndarray, segments: range, radius: int, first: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Cells within the Manhattan radius of embeddings, as (places in ``e``, changed embeddings).

    Of two opposite ways the one that first goes up is taken, so that of two cells one
    visits the other.
    """
    for s in segments if radius else ():
        low, high = np.uint64(1 << 2 * s), np.uint64(2 << 2 * s)
        count = ((e & low) > 0).astype(np.int64) + ((e & high) > 0)
        for step in (1, 2, -1, -2)[: 2 if first else 4]:
            if abs(step) > radius:
                continue
            at = np.flatnonzero((count + step >= 0) & (count + step <= 2))
            if not len(at):
                continue
            to = (count[at] + step)[:, None] == np.arange(3)
            moved = (e[at] & ~(low | high)) | (to @ np.array([0, 1, 3], np.uint64).astype(np.int64)).astype(np.uint64) << np.uint64(2 * s)
            yield at, moved
            for deeper, more in visits(moved, range(s + 1, segments.stop), radius - abs(step), False):
                yield at[deeper], more


@lru_cache
def _visited(segments: int, radius: int) -> float:
    """Cells that a fingerprint visits, about: half of those within the radius."""
    ways, inside = [1.0] + [0.0] * radius, 1.0
    for _ in range(segments):  # a count of 0, 1 or 2 has 1.5 neighbours at one step
        ways = [sum(ways[r - k] * (1, 1.5, 0.5)[k] for k in range(min(r, 2) + 1)) for r in range(radius + 1)]
        inside = sum(ways)
    return (inside - 1) / 2


def radii(blocks: int, distance: int) -> list[int]:
    """How far a fingerprint visits in each grid; beyond all of them is beyond the distance."""
    least, more = divmod(distance + 1 - blocks, blocks)
    return [least + (k < more) for k in range(blocks)]


def rows_each(blocks: int, distance: int) -> float:
    """Keyed rows that a fingerprint makes, about."""
    return sum(1 + _visited(len(segments), radius) for segments, radius in zip(grids(blocks), radii(blocks, distance), strict=True))


def blocks_for(n: int, distance: int) -> int:
    """Blocks for n fingerprints: the fewest with radii of at most one, whatever n.

    Fewer blocks, whose finer cells take many times the visits, serve only where the
    fullest cell would hold over ROWS_PER_CELL: that of one bit in every segment, as a
    half of the fingerprints have, with half its own number from each neighbour.
    """
    blocks = distance // 2 + 1
    while blocks > 1 and n * 0.5 ** (32 // blocks) * (1 + 32 // blocks / 2) > ROWS_PER_CELL:
        blocks -= 1
    return blocks


def _keyed(fps: DataFrame, blocks: int, distance: int) -> DataFrame:
    """Rows (cell, fp, own): every fingerprint in its own cells and in those it visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            e = embed(fp.view(np.uint64))
            for k, (segments, radius) in enumerate(zip(grids(blocks), radii(blocks, distance), strict=True)):
                seed, here = mix(np.array([k + 1], np.uint64)), mask(segments)
                for own, (at, moved) in [(True, (np.arange(len(e)), e)), *[(False, x) for x in visits(e, segments, radius)]]:
                    cell = mix((moved & here) ^ seed)
                    yield pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), pa.array(fp[at]), pa.array(np.full(len(at), own))], names=["cell", "fp", "own"])

    return fps.mapInArrow(thrifty(run), "cell long, fp long, own boolean")


def _near(x: np.ndarray, e: np.ndarray, i: np.ndarray, j: np.ndarray, distance: int) -> np.ndarray:
    """Which pairs are within the distance: the lower bound first, then the bits."""
    out = np.bitwise_count(e[i] ^ e[j]) <= distance
    at = np.flatnonzero(out)
    out[at] = np.bitwise_count(x[i[at]] ^ x[j[at]]) <= distance
    return out


def linked_in_cells(cell: np.ndarray, fp: np.ndarray, own: np.ndarray, distance: int, split: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join all fingerprints linked within a cell, visitors with what is its own; rows need not be sorted."""
    order = np.lexsort((fp, ~own, cell))
    cell, fp, own = cell[order], fp[order], own[order]
    x = fp.view(np.uint64)
    e = embed(x)
    heads = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(heads, len(cell)))
    size = np.repeat(sizes, sizes)
    u, v = [], []
    small = size <= _SMALL
    for step in range(1, _SMALL):
        i = np.flatnonzero(small[:-step] & own[:-step] & (size[:-step] > step) & (cell[:-step] == cell[step:])) if len(cell) > step else np.zeros(0, np.int64)
        if not len(i):
            break
        i = i[_near(x, e, i, i + step, distance)]
        u.append(fp[i])
        v.append(fp[i + step])
    if split and (large := size > _LARGE).any():
        edges = [round(k * 64 / (distance + 1)) for k in range(distance + 2)]
        for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            part = x[large] & np.uint64((1 << b) - (1 << a))
            inner = mix(mix(part) ^ cell[large].view(np.uint64) ^ mix(np.array([k + 1], np.uint64)))
            a, b = linked_in_cells(inner.view(np.int64), fp[large], own[large], distance, False)
            u.append(a)
            v.append(b)
    for a, n in zip(heads.tolist(), sizes.tolist(), strict=True):
        if n <= _SMALL or (split and n > _LARGE):
            continue
        left = np.arange(a, a + n)  # not yet reached; each is compared with every member that is reached
        while len(left) and own[left[0]]:
            front, left = [left[0]], left[1:]
            while front and len(left):
                here = front.pop()
                hit = _near(x, e, left, np.full(len(left), here), distance)
                if not own[here]:
                    hit &= own[left]
                got = left[hit]
                if len(got):
                    u.append(fp[got])
                    v.append(np.full(len(got), fp[here]))
                    front.extend(got.tolist())
                    left = left[~hit]
    none = np.zeros(0, np.int64)
    return (np.concatenate(u), np.concatenate(v)) if u else (none, none)


def _links(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[b.column(k).to_numpy(zero_copy_only=False) for k in range(3)] for b in batches if b.num_rows]
        if not held:
            return
        a, b = spanning_stars(*linked_in_cells(*[np.concatenate(x) for x in zip(*held, strict=True)], distance))
        for at in range(0, len(a), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(a[at : at + 100_000]), pa.array(b[at : at + 100_000])], names=["a", "b"])

    return run


def groups(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Rows (fp, component_id) for each fingerprint of the saved rows (doc_id, fp).

    component_id is the least doc_id that links reach from the fingerprint.
    """
    own = save(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    n = own.count()
    blocks = blocks_for(n, distance)
    rows = n * rows_each(blocks, distance)
    edges = _keyed(own.select("fp"), blocks, distance).repartition(max(1, -(-int(rows) // ROWS_PER_TASK)), "cell").mapInArrow(thrifty(_links(distance)), "a long, b long")
    roots = components(edges)
    rooted = own.join(roots, own["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(least, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """Rows (doc_id, fingerprint, component_id, mark), one per document.

    Fingerprints link at ``distance`` or fewer differing bits; component_id is
    the smallest doc_id reachable.  Texts that are null or hold no word have
    fingerprint zero and link like any other.  Rows whose doc_id is null take
    part but name no component; a component of such rows alone has a null id.
    Repeated rows each give a row.  An empty table gives no rows.
    """
    fps = save(fingerprints(docs, doc_id=doc_id, text=text, shingle=shingle), "document-fingerprints")
    found = groups(fps.select("doc_id", "fp"), distance)
    return fps.join(found, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "mark")


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose doc_id is their component's, all columns kept.

    Of repeated rows with one doc_id and one text a single one stays.  Rows whose
    doc_id is null stay.
    """
    found = near_duplicates(docs, doc_id=doc_id, text=text)
    kept = found.where("doc_id = component_id").select(F.col("doc_id").alias("_doc"), F.col("mark").alias("_mark")).distinct()
    here = docs.select(F.struct(*[col(x) for x in docs.columns]).alias("_row"), col(doc_id).cast("long").alias("_id"), F.xxhash64(col(text)).alias("_own"))
    joined = here.join(kept, (F.col("_id") == F.col("_doc")) & (F.col("_own") == F.col("_mark"))).dropDuplicates(["_id", "_own"])
    rest = here.where("_id IS NULL").select("_row")
    return joined.select("_row").unionByName(rest).select("_row.*")
