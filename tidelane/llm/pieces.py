"""SentencePiece encoding and decoding, with a max-plus parallel scan for giant texts (operator 8).

A text's ids are those of the ``sentencepiece`` library.  Texts up to
``giant`` characters are encoded whole.  Longer ones are split into chunks that
any executor can take.  The segmentation is a best path in a lattice of piece
occurrences; what a chunk's inside owes to its surroundings is only which
occurrence covers the character before each of its two boundaries.  So a chunk
yields a transfer matrix: for every occurrence over its left boundary and every
one over its right, the best weight of a path between them (minus infinity if
there is none).  Matrices multiply in the max-plus semiring, which is
associative; prefix products by doubling give the best occurrence over every
boundary, and with these each chunk is traced back by itself.

In a BPE model a segmentation is right exactly if each pair of neighbours is what
the two pieces' characters alone would give, so paths weigh 0 and forbidden
neighbours minus infinity.  In a unigram model pieces weigh their scores and any
may be neighbours.  A piece never holds a space after another character, so a cut
before a space is a boundary of every path; from the first such cut in a chunk to
its last the library encodes the text, and the lattice spans what is left; in a text
without spaces that is all of it.  A chunk carries as many characters before and after
it as the longest piece has, whatever the text.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelane.llm.common import col, slices

GIANT, CHUNK = 65_536, 16_384
SPACE = "▁"
_NONE = -np.inf


class Pieces:
    """A model's pieces, the lattice over a text, and decoding."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=path)
        p = self.library
        self.bytes: list[bytes] = []
        self.ids: dict[str, int] = {}
        self.byte_ids: dict[int, int] = {}
        for i in range(p.piece_size()):
            piece = p.id_to_piece(i)
            if p.is_byte(i):
                self.byte_ids[int(piece[1:-1], 16)] = i
                self.bytes.append(bytes([int(piece[1:-1], 16)]))
            elif p.is_control(i) or p.is_unknown(i):
                self.bytes.append(b"")
            else:
                self.ids[piece] = i
                self.bytes.append(piece.replace(SPACE, " ").encode())
        self.score = {piece: p.get_score(i) for piece, i in self.ids.items()}
        self.longest = max(map(len, self.ids))
        self.bpe = _is_bpe(path)
        self._pairs: dict[tuple[str, str], bool] = {}

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.library.encode(texts, num_threads=1)

    def decode(self, ids: list[int] | np.ndarray) -> bytes:
        """Bytes of a run of ids; the space put before a text is still there."""
        return b"".join(map(self.bytes.__getitem__, ids))

    def occurrences(self, text: str, at: int) -> list[str]:
        """Pieces that begin at a place; the character itself if there is none of one letter."""
        end = min(len(text), at + self.longest)
        found = [text[at:e] for e in range(at + 1, end + 1) if text[at:e] in self.ids]
        return found if found and len(found[0]) == 1 else [text[at], *found]

    def merged(self, chars: list[str]) -> list[str]:
        """Byte-pair merges: the best scored neighbours first, the leftmost of equals; n log n steps."""
        parts: list[str | None] = list(chars)
        before, after = list(range(-1, len(parts) - 1)), list(range(1, len(parts) + 1))
        queue: list[tuple[float, int, str]] = []

        def offer(k: int) -> None:
            if 0 <= k and after[k] < len(parts):
                joined = parts[k] + parts[after[k]]
                score = self.score.get(joined)
                if score is not None:
                    heapq.heappush(queue, (-score, k, joined))

        for k in range(len(parts) - 1):
            offer(k)
        while queue:
            _, k, joined = heapq.heappop(queue)
            # an offer is void once either side has changed
            if parts[k] is None or after[k] >= len(parts) or parts[k] + parts[after[k]] != joined:
                continue
            gone = after[k]
            parts[k], parts[gone], after[k] = joined, None, after[gone]
            if after[k] < len(parts):
                before[after[k]] = k
            offer(before[k])
            offer(k)
        return [x for x in parts if x is not None]

    def neighbours(self, a: str, b: str) -> bool:
        """Whether piece b may follow piece a."""
        if not self.bpe:
            return True
        got = self._pairs.get((a, b))
        if got is None:
            got = self.merged([*a, *b]) == [a, b]
            if len(self._pairs) < 500_000:
                self._pairs[a, b] = got
        return got

    def weight(self, piece: str) -> float:
        if self.bpe:
            return 0.0
        return self.score.get(piece, min(self.score.values()) - 10)

    def spelt(self, piece: str) -> list[int]:
        i = self.ids.get(piece)
        if i is not None:
            return [i]
        return [self.byte_ids[b] for b in piece.encode()] if self.byte_ids else [self.library.unk_id()]


def _is_bpe(path: str) -> bool:
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    return model.trainer_spec.model_type == 2


def seen_text(text: str) -> str:
    """A text as the model sees it: a space before it, spaces shown."""
    return SPACE + text.replace(" ", SPACE)


#: An occurrence over a boundary: start and end in the whole text.  None stands for the text's begin.
State = tuple[int, int]


class Chunk:
    """A stretch of a seen text with enough characters around it.

    ``text`` is the seen text from ``base`` on; the chunk is [lo, hi) in the whole
    text.  The states over a boundary are the occurrences that hold the character
    before it.
    """

    def __init__(self, pieces: Pieces, text: str, base: int, lo: int, hi: int) -> None:
        self.p, self.text, self.base, self.lo, self.hi = pieces, text, base, lo, hi
        local, end = text, hi - base
        cuts = [k for k in range(max(lo - base, 1), end + 1) if k < len(local) and local[k] == SPACE and local[k - 1] != SPACE]
        # with one cut or more, paths are free between the first and the last
        self.cuts = (cuts[0] + base, cuts[-1] + base) if cuts else None

    def piece(self, s: State) -> str:
        return self.text[s[0] - self.base : s[1] - self.base]

    def over(self, boundary: int) -> list[State]:
        """All occurrences that hold the character before a boundary."""
        if boundary == 0:
            return [(0, 0)]
        out = []
        for start in range(max(self.base, boundary - self.p.longest), boundary):
            out += [(start, start + len(x)) for x in self.p.occurrences(self.text, start - self.base) if start + len(x) >= boundary]
        return out

    def paths(self, sources: list[State], end: int) -> tuple[dict[State, np.ndarray], dict[State, list[State]]]:
        """Best weights from every source to the occurrences reached, until they hold the character before ``end``."""
        best: dict[State, np.ndarray] = {}
        before: dict[State, list[State]] = {}
        ends: dict[int, list[State]] = {}
        for k, s in enumerate(sources):
            best[s] = np.where(np.arange(len(sources)) == k, 0.0, _NONE)
            ends.setdefault(s[1], []).append(s)
        place = min(ends)
        while place < end:
            for piece in self.p.occurrences(self.text, place - self.base) if place in ends else ():
                here = (place, place + len(piece))
                for s in ends[place]:
                    if s[0] < s[1] and not self.p.neighbours(self.piece(s), piece):
                        continue
                    value = best[s] + self.p.weight(piece)
                    if here not in best:
                        best[here] = value
                        ends.setdefault(here[1], []).append(here)
                    else:
                        best[here] = np.maximum(best[here], value)
                    before.setdefault(here, []).append(s)
            place += 1
        return best, before

    def transfer(self) -> tuple[list[State], list[State], np.ndarray]:
        """States over the left and the right boundary, and the matrix between them."""
        left, right = self.over(self.lo), self.over(self.hi)
        matrix = np.full((len(left), len(right)), _NONE)
        if self.cuts is None or self.cuts[0] == self.hi:  # nothing is free between two cuts
            best, _ = self.paths(left, self.hi)
            for j, s in enumerate(right):
                if s in best:
                    matrix[:, j] = best[s]
            return left, right, matrix
        first, last = self.cuts
        best, _ = self.paths(left, first)
        into = np.full(len(left), _NONE)
        for s, value in best.items():
            if s[1] == first:
                into = np.maximum(into, value)
        best, _ = self.paths([(last, last)], self.hi)
        for j, s in enumerate(right):
            if s[1] == last and last == self.hi:  # the path ends with the cut
                matrix[:, j] = into if self._ends_at_cut(s) else _NONE
            elif s in best:
                matrix[:, j] = into + best[s][0]
        return left, right, matrix

    def _ends_at_cut(self, s: State) -> bool:
        """Whether the right segmentation up to the cut ends with this occurrence."""
        return self._before_cut() == s

    def _before_cut(self) -> State:
        """The last occurrence before the last cut; its word lies between two cuts of the chunk."""
        last = self.cuts[1] - self.base
        start = last - 1
        while start > 0 and not (self.text[start] == SPACE and self.text[start - 1] != SPACE):
            start -= 1
        parts = self.p.merged(list(self.text[start:last])) if self.p.bpe else self._best(start, last)
        return (self.cuts[1] - len(parts[-1]), self.cuts[1])

    def _best(self, start: int, end: int) -> list[str]:
        return [self.piece(s) for s in self._trace([(start + self.base,) * 2], end + self.base, lambda s: s[1] == end + self.base)]

    def _trace(self, sources: list[State], end: int, wanted) -> list[State]:
        """The best path to a wanted occurrence, without its source."""
        best, before = self.paths(sources, end)
        reached = [s for s in best if wanted(s) and best[s][0] > _NONE]
        here = max(reached, key=lambda s: best[s][0])
        out = []
        while here != sources[0]:
            out.append(here)
            here = max(before[here], key=lambda s: best[s][0])
        return out[::-1]

    def trace(self, left: State, right: State) -> list[int]:
        """Ids of the path after the left state up to and with the right one."""
        if left == right:
            return []
        if self.cuts is None or self.cuts[0] == self.hi or left[1] >= self.cuts[1]:
            out = self._trace([left], self.hi, lambda s: s == right)
            return [i for s in out for i in self.p.spelt(self.piece(s))]
        first, last = self.cuts
        ids: list[int] = []
        if left[1] < first:
            ids += [i for s in self._trace([left], first, lambda s: s[1] == first) for i in self.p.spelt(self.piece(s))]
        middle = self.text[first - self.base : last - self.base]
        if middle:
            ids += self._library(middle)
        if right[1] > last:
            ids += [i for s in self._trace([(last, last)], self.hi, lambda s: s == right) for i in self.p.spelt(self.piece(s))]
        return ids

    def _library(self, seen: str) -> list[int]:
        """Encode a stretch that begins with a space: the library puts that one before the rest."""
        rest = seen[1:].replace(SPACE, " ")
        return self.p.encode([rest])[0] if rest else self.p.spelt(SPACE)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of two matrices in the max-plus semiring."""
    return (a[:, :, None] + b[None]).max(axis=1)


def boundary_states(lefts: list[list[State]], rights: list[list[State]], matrices: list[np.ndarray], length: int) -> list[tuple[State, State]]:
    """The best state over both boundaries of every chunk, from prefix products by doubling."""
    prefix, step = list(matrices), 1
    while step < len(prefix):
        prefix = [times(prefix[k - step], prefix[k]) if k >= step else prefix[k] for k in range(len(prefix))]
        step *= 2
    ends = [j for j, s in enumerate(rights[-1]) if s[1] == length]
    chosen = max(ends, key=lambda j: prefix[-1][0, j])
    out = []
    for k in range(len(matrices) - 1, -1, -1):
        if k == 0:
            before = 0
        else:
            before = int(np.argmax(prefix[k - 1][0] + matrices[k][:, chosen]))
        out.append((lefts[k][before], rights[k][chosen]))
        chosen = before
    return out[::-1]


_MODELS: dict[str, Pieces] = {}


def model(path: str) -> Pieces:
    """The model of this Python worker."""
    if path not in _MODELS:
        _MODELS[path] = Pieces(path)
    return _MODELS[path]


_CHUNKS = "doc_id long, mark long, chunk int, base long, lo long, hi long, length long, text string"


def _chunks(texts: DataFrame, path: str, chunk: int) -> DataFrame:
    """Giant texts' chunks, each with the characters around it that its states need."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        around = model(path).longest
        for batch in slices(batches):
            for key, mark, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                seen = seen_text(text)
                rows = []
                for k, lo in enumerate(range(0, len(seen), chunk)):
                    hi = min(lo + chunk, len(seen))
                    base = max(0, lo - around)
                    rows.append((key, mark, k, base, lo, hi, len(seen), seen[base : hi + around]))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["doc_id", "mark", "chunk", "base", "lo", "hi", "length", "text"])

    return texts.mapInArrow(run, _CHUNKS)


_ENCODED = "doc_id long, mark long, chunk int, ids binary, n_chars long, round_trip boolean"


def _encoded(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "mark", "chunk", "ids", "n_chars", "round_trip"])


def encode(docs: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text", giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """Rows (doc_id, mark, chunk, ids, n_chars, round_trip): ids as little-endian 32-bit numbers.

    A text up to ``giant`` characters has one row, chunk 0; a longer one a row per
    chunk, whose ids follow one another.  ``round_trip`` says that the ids decode to
    the text they came from.  Null and empty texts have one row without ids.
    ``mark`` is the text's xxhash64: rows that share an id are told apart by it, and
    rows that share both come once per row.  An empty table gives no rows.
    """
    rows = docs.select(col(doc_id).cast("long").alias("doc_id"), F.xxhash64(col(text)).alias("mark"), col(text).cast("string").alias("text"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch in slices(batches, 8 << 20):
            texts = [t or "" for t in batch.column(2).to_pylist()]
            out = []
            for key, mark, t, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, own.encode(texts), strict=True):
                back = own.decode(ids)
                out.append((key, mark, 0, np.array(ids, "<i4").tobytes(), len(t), back == (b" " + t.encode() if t else b"")))
            yield _encoded(out)

    small = rows.where(F.coalesce(F.length("text") <= giant, F.lit(True))).mapInArrow(whole, _ENCODED)
    large = rows.where(F.length("text") > giant)
    # spread the chunks of few giant texts over all tasks
    parts = _chunks(large, path, chunk).repartition("mark", "chunk")

    def transfers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                left, right, matrix = Chunk(own, r["text"], r["base"], r["lo"], r["hi"]).transfer()
                out.append((r["doc_id"], r["mark"], r["chunk"], r["length"], np.array(left, "<i8").tobytes(), np.array(right, "<i8").tobytes(), matrix.astype("<f8").tobytes()))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "mark", "chunk", "length", "left", "right", "matrix"])

    def combine(table: pa.Table) -> pa.Table:
        found = {r["chunk"]: r for r in table.to_pylist()}  # repeated rows bring the same chunks again
        chunks = sorted(found)
        states = lambda b: [tuple(x) for x in np.frombuffer(b, "<i8").reshape(-1, 2).tolist()]
        lefts, rights = ([states(found[k][side]) for k in chunks] for side in ("left", "right"))
        matrices = [np.frombuffer(found[k]["matrix"], "<f8").reshape(len(a), len(b)) for k, a, b in zip(chunks, lefts, rights, strict=True)]
        best = boundary_states(lefts, rights, matrices, found[0]["length"])
        one = found[0]
        out = [(one["doc_id"], one["mark"], k, *a, *b) for k, (a, b) in zip(chunks, best, strict=True)]
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        return pa.Table.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["_doc", "_mark", "_chunk", "a0", "a1", "b0", "b1"])

    matrices = parts.mapInArrow(transfers, "doc_id long, mark long, chunk int, length long, left binary, right binary, matrix binary")
    chosen = matrices.groupBy("doc_id", "mark").applyInArrow(combine, "_doc long, _mark long, _chunk int, a0 long, a1 long, b0 long, b1 long")
    joined = parts.join(chosen, parts["doc_id"].eqNullSafe(F.col("_doc")) & (F.col("mark") == F.col("_mark")) & (F.col("chunk") == F.col("_chunk"))).drop("_doc", "_mark", "_chunk")

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                ids = Chunk(own, r["text"], r["base"], r["lo"], r["hi"]).trace((r["a0"], r["a1"]), (r["b0"], r["b1"]))
                held = r["text"][r["a1"] - r["base"] : r["b1"] - r["base"]]
                out.append((r["doc_id"], r["mark"], r["chunk"], np.array(ids, "<i4").tobytes(), len(held) - (r["chunk"] == 0), own.decode(ids) == held.replace(SPACE, " ").encode()))
            if out:
                yield _encoded(out)

    return small.unionByName(joined.mapInArrow(trace, _ENCODED))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Rows (doc_id, mark, text) from rows (doc_id, mark, chunk, ids); a text's chunks once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch in batches:
            texts = []
            for chunk, ids in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                back = own.decode(np.frombuffer(ids, "<i4").tolist()).decode()
                texts.append(back[1:] if chunk == 0 else back)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(texts, pa.string())], names=["doc_id", "mark", "chunk", "part"])

    parts = encoded.select("doc_id", "mark", "chunk", "ids").mapInArrow(run, "doc_id long, mark long, chunk int, part string")
    grouped = parts.groupBy("doc_id", "mark").agg(F.array_sort(F.collect_set(F.struct("chunk", "part"))).alias("p"))
    return grouped.select("doc_id", "mark", F.array_join(F.col("p.part"), "").alias("text"))


def digests(encoded: DataFrame) -> DataFrame:
    """Rows (doc_id, chunk, n_tokens, ids_crc32, n_chars, round_trip)."""
    return encoded.select("doc_id", "chunk", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"), "n_chars", "round_trip")
