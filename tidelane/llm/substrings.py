"""Removal of repeated word passages with prefix-partitioned suffix trees (operator 6).

A word is removed if some window of ``window`` consecutive words that covers it
also starts in a document with a smaller doc_id.

Suffixes (word positions) are split into memory-sized groups by a prefix of
variable length, and every group builds its own subtree.  Partitioning by the
first words of each suffix would ship every word ``window`` times, so the prefix
is read at the suffix's *anchor*: the place, within the suffix's first
``window`` words, of the word pair with the least hash.  Equal windows have equal
anchors, so they still meet in one group, while neighbouring suffixes share one
anchor and travel as one run of text.  A prefix that alone would fill a group is
lengthened: to five words, then to the whole window, which is at last salted by
document (the salted groups' first holders then meet in a second round).

A group's subtree is held as suffixes sorted to the ends of their runs, with the
common prefixes of neighbours; a stack over these gives its internal nodes, each an
interval of suffixes and a depth in words.  Below a node of ``window`` words or more
every suffix of a document other than the least is a repeat.  Words are compared as
words throughout; hashes only deal suffixes out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelane.llm.common import as_bytes, col, give_back, mix, save, slices, thrifty

WINDOW = 13
#: Words in a prefix, from the shortest; the last is the whole window.
PREFIXES = (2, 5)
#: Suffixes in a group, by expectation.
GROUP_SUFFIXES = 700_000
_B = np.uint64(0x9E3779B97F4A7C15)
_BUCKETS = 1 << 20
#: Places take the low 24 bits of a packed hash; they tell neighbours apart, so they may wrap.
_SEGMENT = 4_000_000
_LOW = np.uint64((1 << 24) - 1)
#: Into how many groups a hot window is salted, at least and at most.
_SALTS, _MOST_SALTS = 64, 1 << 16

_R = np.uint64(0xD6E8FEB86659FD93)
_R_INVERSE = np.uint64(pow(int(_R), -1, 1 << 64))
_STRETCH = 1 << 17


class Text:
    """Words in one buffer, cut by single spaces and line feeds: places and 64-bit hashes."""

    _powers = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def __init__(self, joined: bytes) -> None:
        self.joined = joined
        buffer = np.frombuffer(joined, np.uint8)
        cuts = np.flatnonzero((buffer == 32) | (buffer == 10))
        self.is_end = np.append(buffer[cuts] == 10, True)  # the word ends a line
        self.starts = np.concatenate([[0], cuts + 1])
        self.ends = np.append(cuts, len(buffer))
        self.h = np.empty(len(self.starts), np.uint64)
        at = 0
        while at < len(self.starts):  # by stretches of whole words that fit the cache
            base = self.starts[at]
            end = max(at + 1, int(np.searchsorted(self.starts, base + _STRETCH)))
            part = buffer[base : self.ends[end - 1]]
            up, down = self._power(len(part) + 1)
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=sums[1:])
            lo, hi = self.starts[at:end] - base, self.ends[at:end] - base
            self.h[at:end] = mix((sums[hi] - sums[lo]) * down[lo])
            at = end

    @classmethod
    def _power(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls._powers[0]) < n:
            grown = []
            for r in (_R, _R_INVERSE):
                x = np.full(1 << (n - 1).bit_length(), r, np.uint64)
                x[0] = 1
                grown.append(np.cumprod(x))
            cls._powers = tuple(grown)
        return cls._powers

    def word(self, k: int) -> bytes:
        return self.joined[self.starts[k] : self.ends[k]]


def _grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams that start at each word; the last n - 1 are cut off."""
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out = out * _B + h[k : len(h) - n + 1 + k]
    return mix(out)


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    step = 1
    while 2 * step <= width:
        x = np.minimum(x[: len(x) - step], x[step:])
        step *= 2
    return np.minimum(x[: len(x) - (width - step)], x[width - step :]) if width > step else x


class _Words:
    """The words of a slice of documents, end to end, and the windows within them."""

    def __init__(self, keys: list, hashes: list, raws: list[bytes | None], window: int) -> None:
        self.docs: list[tuple[int, int]] = []
        lines: list[bytes] = []
        first, starts, owner, base = 0, [], [], []
        for key, mark, raw in zip(keys, hashes, raws, strict=True):
            if key is None or raw is None:
                continue
            words = raw.split()
            if len(words) < window:
                continue
            doc = len(self.docs)
            self.docs.append((key, mark))
            for at in range(0, len(words) - window + 1, _SEGMENT):
                part = words[at : at + _SEGMENT + window - 1]
                n = len(part) - window + 1
                starts.append(np.arange(first, first + n))
                owner.append(np.full(n, doc, np.uint32))
                base.append(np.full(n, at - first, np.int64))
                lines.append(b" ".join(part))
                first += len(part)
        none = np.zeros(0, np.int64)
        self.start = np.concatenate(starts) if starts else none
        self.owner = np.concatenate(owner) if owner else none.astype(np.uint32)
        self.base = np.concatenate(base) if base else none
        self.text = Text(b"\n".join(lines))
        self.window = window

    def anchors(self, n: int) -> np.ndarray:
        """For each window, the least n-gram hash (high 40 bits) and its place modulo 2**24."""
        grams = _grams(self.text.h, n)
        packed = (grams & ~_LOW) | (np.arange(len(grams), dtype=np.uint64) & _LOW)
        return _least(packed, self.window - n + 1)[self.start]


def _parts(batches, window):
    """Slices of (doc_id, row mark, text) batches as _Words; one text makes one, however long."""
    for batch in slices(batches, 4 << 20):
        keys, marks, raws = batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2))
        got = _Words(keys, marks, raws, window)
        if len(got.start):
            yield got


def _counts(docs: DataFrame, window: int, group_suffixes: int) -> tuple[int, list[np.ndarray], int]:
    """All windows, for each prefix length the buckets that hold too many of them, and salts for the largest.

    A task reports a bucket if it has more than its part of an eighth of what is too
    many, going by the task's share of all windows (of which there is less than one
    for two bytes of text).  So no bucket of 9/8 is missed, and the driver gets
    ``_BUCKETS`` sums a level at most.  They steer the split, not the result.
    """
    many = max(group_suffixes // 4, 1)
    most = max(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0, 2) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sums = 0, [np.zeros(_BUCKETS, np.int64) for _ in (*PREFIXES, window)]
        for part in _parts(batches, window):
            total += len(part.start)
            for n, held in zip((*PREFIXES, window), sums, strict=True):
                held += np.bincount((part.anchors(n) >> np.uint64(44)).astype(np.int64), minlength=_BUCKETS)
        rows = [(-1, 0, total)]
        for k, held in enumerate(sums):
            rows += [(k, int(b), int(held[b])) for b in np.flatnonzero(held > max(1, min(total >> 12, many * total // (8 * most))))]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=["level", "bucket", "n"])

    got = docs.mapInArrow(thrifty(run), "level long, bucket long, n long").groupBy("level", "bucket").agg(F.sum("n").alias("n"))
    got = got.where((F.col("level") < 0) | (F.col("n") > many)).collect()
    total = sum(r["n"] for r in got if r["level"] < 0)
    largest = max((r["n"] for r in got if r["level"] == len(PREFIXES)), default=0)
    salts = min(max(_SALTS, -(-largest // many)), _MOST_SALTS)
    return total, [np.array(sorted(r["bucket"] for r in got if r["level"] == k), np.int64) for k in range(len(PREFIXES) + 1)], salts


#: ``many`` holds how many places of its document each run of text stands at; null for one each.
_RUNS = "g long, round int, docs binary, owner binary, start binary, text binary, many binary"


def _emit(pack, g, salted, docs, owner, start, parts, many=None) -> tuple:
    """One row: the runs of a slice that belong to a group, ``start`` with ``many`` places of each."""
    used, owner = np.unique(owner, return_inverse=True)
    ids = np.array([docs[k] for k in used.tolist()], "<i8").tobytes()
    return g, salted, pack(ids), pack(owner.astype("<u4").tobytes()), pack(start.astype("<i8").tobytes()), pack(b"\n".join(parts)), None if many is None else pack(many.astype("<i8").tobytes())


def _deal(docs: DataFrame, groups: int, hot: list[np.ndarray], window: int, salts: int = _SALTS) -> DataFrame:
    """Runs of suffixes, dealt to groups by the prefixes at their anchors."""
    tables = []
    for buckets in hot:
        table = np.zeros(_BUCKETS, bool)
        table[buckets] = True
        tables.append(table if len(buckets) else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for part in _parts(batches, window):
            key = part.anchors(PREFIXES[0])
            level = np.zeros(len(key), np.uint64)
            for k, n in enumerate((*PREFIXES[1:], window)):
                if tables[k] is None:
                    break
                long = (level == k) & tables[k][(key >> np.uint64(44)).astype(np.int64)]
                if not long.any():
                    break
                key[long] = part.anchors(n)[long]
                level[long] = k + 1
            salt = np.zeros(len(key), bool)
            if tables[-1] is not None:
                salt = (level == len(PREFIXES)) & tables[-1][(key >> np.uint64(44)).astype(np.int64)]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (level[1:] != level[:-1]) | (np.diff(part.start) != 1)
            at = np.flatnonzero(new)
            first = part.start[at]
            end = part.start[np.append(at[1:], len(key)) - 1] + window
            deal = mix((key[at] & ~_LOW) + level[at])
            if salt.any():
                own = mix(np.array([k for k, _ in part.docs], np.int64).view(np.uint64))[part.owner[at]] % np.uint64(salts)
                deal = np.where(salt[at], mix(deal + own + np.uint64(1)), deal)
            group = (deal % np.uint64(groups)).astype(np.int64) * 2 + salt[at]
            order = np.argsort(group, kind="stable")
            joined, group = part.text.joined, group[order]
            lo, hi = part.text.starts[first[order]].tolist(), part.text.ends[end[order] - 1].tolist()
            texts = [joined[a:b] for a, b in zip(lo, hi, strict=True)]
            owner, start = part.owner[at][order], (first + part.base[at])[order]
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(group)]]).tolist()
            rows = [_emit(pack, int(group[a]) >> 1, int(group[a]) & 1, part.docs, owner[a:b], start[a:b], texts[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            for a in range(0, len(rows), 256):
                yield _batch(rows[a : a + 256])

    return docs.mapInArrow(thrifty(run), _RUNS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), *[pa.binary()] * 5)
    return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["g", "round", "docs", "owner", "start", "text", "many"])


class Subtree:
    """Suffixes below the prefixes of one group: sorted, with common-prefix lengths.

    Each line of the text is a run of words; every position with ``window`` words
    or more to the end of its run is a suffix.
    """

    def __init__(self, text: Text, window: int) -> None:
        self.text = text
        last = np.flatnonzero(text.is_end) + 1
        first = np.concatenate([[0], last[:-1]])
        counts = np.maximum(last - first - window + 1, 0)
        self.run = np.repeat(np.arange(len(last)), counts)
        self.within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        self.place = first[self.run] + self.within
        # a suffix whose window hash stands alone is a leaf above the deep nodes
        key = _grams(text.h, window)[self.place] if len(self.place) else np.zeros(0, np.uint64)
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        shared = np.zeros(len(key), bool)
        shared[order[1:]] |= same
        shared[order[:-1]] |= same
        self.suffix = np.flatnonzero(shared)
        # the rest are sorted by their words themselves, numbered as they come, to the ends of their runs
        end = last[self.run[self.suffix]]
        used = np.zeros(len(text.h) + 1, np.int64)
        np.add.at(used, self.place[self.suffix], 1)
        np.add.at(used, end, -1)
        used = np.flatnonzero(np.cumsum(used[:-1]))
        numbers: dict[bytes, int] = {}
        ids = np.zeros(len(text.h), np.int32)
        joined = text.joined
        ids[used] = [numbers.setdefault(joined[a:b], len(numbers)) for a, b in zip(text.starts[used].tolist(), text.ends[used].tolist(), strict=True)]
        left = end - self.place[self.suffix]
        columns = [np.where(k < left, ids[np.minimum(self.place[self.suffix] + k, end - 1)], -1) for k in range(int(left.max(initial=0)))]
        rank = np.lexsort(columns[::-1]) if columns else np.zeros(0, np.int64)
        self.suffix = self.suffix[rank]
        self.lcp = np.zeros(max(len(rank) - 1, 0), np.int64)
        alive = np.ones(len(self.lcp), bool)
        for c in columns:
            c = c[rank]
            alive &= (c[1:] == c[:-1]) & (c[1:] >= 0)
            self.lcp += alive

    def internal_nodes(self, depth: int) -> list[tuple[int, int, int, bool]]:
        """The internal nodes of ``depth`` words or more, children before parents, from a stack over the common prefixes.

        Each is its depth, its first and last sorted suffix, and whether no such node
        is above it.
        """
        out: list[tuple[int, int, int, bool]] = []
        stack: list[tuple[int, int]] = []
        for i, common in enumerate([*self.lcp.tolist(), 0]):
            first = i
            while stack and stack[-1][0] > common:
                deep, first = stack.pop()
                out.append((deep, first, i, common < depth and not stack))
            if common >= depth and (not stack or stack[-1][0] < common):
                stack.append((common, first))
        return out

    def deep_nodes(self, depth: int) -> np.ndarray:
        """For each sorted suffix, the number of the highest node of that depth above it, or of itself."""
        new = np.ones(len(self.suffix), bool)
        for _, first, last, top in self.internal_nodes(depth):
            if top:
                new[first + 1 : last + 1] = False
        return np.cumsum(new) - 1


_FOUND = "kind int, doc_id long, mark long, spans binary, g long, docs binary, owner binary, start binary, text binary, many binary"


def _repeats(window: int):
    def run(table: pa.Table) -> pa.Table:
        unpack, pack = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=3).compress
        docs, owner, start, many, lines, salted = [], [], [], [], [], False
        n = 0
        for row in table.to_pylist():
            held = np.frombuffer(unpack(row["docs"]), "<i8").reshape(-1, 2)
            docs.append(held)
            owner.append(np.frombuffer(unpack(row["owner"]), "<u4").astype(np.int64) + n)
            start.append(np.frombuffer(unpack(row["start"]), "<i8"))
            many.append(np.ones(len(owner[-1]), np.int64) if row["many"] is None else np.frombuffer(unpack(row["many"]), "<i8"))
            lines.append(unpack(row["text"]))
            salted |= bool(row["round"])
            n += len(held)
        docs, owner, start, many = np.concatenate(docs), np.concatenate(owner), np.concatenate(start), np.concatenate(many)
        tree = Subtree(Text(b"\n".join(lines)), window)
        suffix, node = tree.suffix, tree.deep_nodes(window)
        rows: list[tuple] = []
        if salted:  # the first holder of every window, repeated here or not, goes on to the next round
            suffix, node = _all_windows(tree, node)
        who = owner[tree.run[suffix]]
        if len(node):
            heads = np.flatnonzero(np.diff(node, prepend=-1))
            least = np.minimum.reduceat(docs[who, 0], heads)[node]
            if salted:
                ahead = np.flatnonzero(docs[who, 0] == least)
                at = start[tree.run[suffix[ahead]]] + tree.within[suffix[ahead]]
                # a holder's text goes once, with every place where it stands
                order = np.lexsort((at, docs[who[ahead], 1], node[ahead]))
                ahead, at = ahead[order], at[order]
                new = np.append(True, (np.diff(node[ahead]) != 0) | (np.diff(docs[who[ahead], 1]) != 0))
                fresh = new | np.append(True, np.diff(at) != 0)  # equal rows of one id count once
                ahead, at, heads, text = ahead[new], at[fresh], np.flatnonzero(new[fresh]), tree.text
                texts = [text.joined[text.starts[p] : text.ends[p + window - 1]] for p in tree.place[suffix[ahead]].tolist()]
                _, _, *packed = _emit(pack, 0, 0, [tuple(x) for x in docs.tolist()], who[ahead], at, texts, np.diff(np.append(heads, len(at))))
                rows.append((1, None, None, None, int(table.column("g")[0].as_py()), *packed))
            late = np.flatnonzero(docs[who, 0] > least)
            run = tree.run[suffix[late]]
            late, places = np.repeat(late, many[run]), _ranges((np.cumsum(many) - many)[run], many[run])
            rows += _spans(docs, who[late], start[places] + tree.within[suffix[late]])
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), *[pa.binary()] * 5)
        names = ["kind", "doc_id", "mark", "spans", "g", "docs", "owner", "start", "text", "many"]
        return pa.Table.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

    def out(table: pa.Table) -> pa.Table:
        try:
            return run(table)
        finally:
            give_back()

    return out


def _ranges(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers first, first + 1, ... of each range, one range after another."""
    return np.arange(counts.sum()) + np.repeat(first - (np.cumsum(counts) - counts), counts)


def _all_windows(tree: Subtree, node):
    """Every suffix of a salted group and its node: leaves become nodes of their own."""
    lone = np.ones(len(tree.place), bool)
    lone[tree.suffix] = False
    lone = np.flatnonzero(lone)
    extra = np.arange(len(lone)) + (node[-1] + 1 if len(node) else 0)
    return np.concatenate([tree.suffix, lone]), np.concatenate([node, extra])


def _spans(docs, who, at) -> list[tuple]:
    """Rows of merged ranges of window starts for each document."""
    if not len(who):
        return []
    order = np.lexsort((at, who))
    who, at = who[order], at[order]
    new = np.ones(len(who), bool)
    new[1:] = (np.diff(who) != 0) | (np.diff(at) > 1)
    heads = np.flatnonzero(new)
    last = at[np.append(heads[1:], len(at)) - 1]
    ranges = np.stack([at[heads], last], axis=1).astype("<i8")
    owner = who[heads]
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(owner)) + 1, [len(owner)]]).tolist()
    return [(0, int(docs[owner[a], 0]), int(docs[owner[a], 1]), ranges[a:b].tobytes(), *[None] * 6) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def repeated_spans(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, group_suffixes: int = GROUP_SUFFIXES) -> DataFrame:
    """Rows (doc_id, mark, spans): ranges of starts of windows that an earlier document has.

    ``mark`` is the xxhash64 of the text and tells apart rows that share a
    doc_id.  ``spans`` are binary pairs of little-endian 64-bit word positions,
    first and last start; a document may have several rows.
    """
    rows = docs.select(col(doc_id).cast("long").alias("doc_id"), F.xxhash64(col(text)).alias("mark"), col(text).cast("string").alias("text"))
    total, hot, salts = _counts(rows, window, group_suffixes)
    groups = max(1, -(-total // group_suffixes))
    runs = _deal(rows, groups, hot, window, salts)
    found = runs.groupBy("g", "round").applyInArrow(_repeats(window), _FOUND)
    if not len(hot[-1]):
        return found.select("doc_id", "mark", "spans")
    found = save(found, "salted-runs")
    again = found.where("kind = 1").select("g", F.lit(0).alias("round"), "docs", "owner", "start", "text", "many")
    again = save(again.mapInArrow(thrifty(_regroup(groups, window)), _RUNS), "second-round").groupBy("g", "round").applyInArrow(_repeats(window), _FOUND)
    return found.where("kind = 0").unionByName(again).select("doc_id", "mark", "spans")


def _regroup(groups: int, window: int):
    """First holders from salted groups, dealt by their whole windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        unpack, pack = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                docs = [tuple(x) for x in np.frombuffer(unpack(row["docs"]), "<i8").reshape(-1, 2).tolist()]
                owner, start = np.frombuffer(unpack(row["owner"]), "<u4"), np.frombuffer(unpack(row["start"]), "<i8")
                many = np.frombuffer(unpack(row["many"]), "<i8")
                begin = np.cumsum(many) - many
                texts = unpack(row["text"]).split(b"\n")
                group = np.array([xxhash.xxh3_64_intdigest(x) % groups for x in texts])
                for g in np.unique(group).tolist():
                    mine = np.flatnonzero(group == g)
                    rows.append(_emit(pack, g, 0, docs, owner[mine], start[_ranges(begin[mine], many[mine])], [texts[k] for k in mine.tolist()], many[mine]))
            if rows:
                yield _batch(rows)

    return run


def keep_words(words: list[bytes], spans: list[bytes] | None, window: int) -> list[bytes]:
    """The words that no range of windows covers."""
    if not spans:
        return words
    cover = np.zeros(len(words) + 1, np.int64)
    ranges = np.frombuffer(b"".join(spans), "<i8").reshape(-1, 2)
    np.add.at(cover, ranges[:, 0], 1)
    np.add.at(cover, ranges[:, 1] + window, -1)
    return [words[k] for k in np.flatnonzero(np.cumsum(cover[:-1]) == 0).tolist()]


def remove_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, group_suffixes: int = GROUP_SUFFIXES, keep_text: bool = True, others: tuple[str, ...] = ()) -> DataFrame:
    """Every document without the words that repeat an earlier document.

    Returns doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by
    one space), with ``keep_text`` the kept words as ``kept_text``, and the
    columns named in ``others``.  A null text has no words.  A row whose doc_id
    is null is returned whole and counts for nothing else.  Rows that share a
    doc_id are judged apart and do not repeat each other.  An empty table gives
    no rows.
    """
    schema = docs.select(*[col(x) for x in others]).schema
    spans = repeated_spans(docs, doc_id=doc_id, text=text, window=window, group_suffixes=group_suffixes)
    spans = spans.groupBy("doc_id", "mark").agg(F.collect_list("spans").alias("_spans")).select(F.col("doc_id").alias("_doc"), F.col("mark").alias("_mark"), "_spans")
    rows = docs.select(col(doc_id).cast("long").alias("_id"), F.xxhash64(col(text)).alias("_own"), col(text).cast("string").alias("_text"), F.struct(F.lit(0).alias("_"), *[col(x) for x in others]).alias("_others"))
    joined = rows.join(spans, (F.col("_id") == F.col("_doc")) & (F.col("_own") == F.col("_mark")), "left").select("_id", "_text", "_spans", *[F.col("_others")[x].alias(x) for x in others])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts, removed, digests, texts = [], [], [], []
            for raw, found in zip(as_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                words = raw.split() if raw else []
                kept = keep_words(words, found, window)
                whole = b" ".join(kept)
                counts.append(len(words))
                removed.append(len(words) - len(kept))
                digests.append(hashlib.sha256(whole).hexdigest())
                texts.append(whole.decode() if keep_text and raw is not None else None)
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if keep_text:
                columns.append(pa.array(texts, pa.string()))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays([*columns, *[batch.column(3 + k) for k in range(len(others))]], names=[*names, *others])

    ddl = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * keep_text
    return joined.mapInArrow(thrifty(run), ", ".join([ddl, *[f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields]]))
