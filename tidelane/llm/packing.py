"""Best-fit packing of tokenised documents into fixed-length sequences (operator 2).

Method: bounded-space online best-fit.  Each task keeps a fixed number of open
bins.  A bitset with one bit per free-space value says which values have an open
bin; the lowest set bit at or above a piece's length is the best fit.  If none
fits and all bins are in use, the fullest bin (the lowest set bit of all) closes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelane.llm.common import as_bytes, col, remembered, save, slices, thrifty

CAPACITY = 4096
END_ID = 1
OPEN_BINS = 256
#: Pieces that one packing task takes in, by expectation.
PIECES_PER_TASK = 2_000_000
#: Words whose ids a worker remembers; other words are encoded each time.
CACHED_WORDS = 450_000

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"
#: Strings that the tokenizer handles across or inside white space in its own way.
_SPECIAL = (b"<|", b"\x1c", b"\x1d", b"\x1e", b"\x1f")


class WordEncoder:
    """Token ids of whole texts, word by word.

    The tokenizer cuts texts at white space before any merge, so the ids of a
    text are those of its words in order.  Texts that hold a special token or a
    control character on which white-space rules differ go to the tokenizer whole.
    """

    def __init__(self, path: str, most: int = CACHED_WORDS) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cache: dict[str, bytes] = {}
        self.most = most

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of distinct words, encoded together and cut at the words' places."""
        out: dict[str, bytes] = {}
        for at in range(0, len(words), 4096):
            part = words[at : at + 4096]
            got = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            ids = np.array(got.ids, "<u4")
            lengths = np.fromiter(map(len, part), np.int64, len(part)) + 1
            ends = np.cumsum(lengths)
            first = np.fromiter((x for x, _ in got.offsets), np.int64, len(ids))
            cuts = np.searchsorted(first, np.concatenate([[0], ends]))
            blob = ids.tobytes()
            for k, word in enumerate(part):
                out[word] = blob[4 * cuts[k] : 4 * cuts[k + 1]]
        return out

    def encode(self, raws: list[bytes | None]) -> Iterator[np.ndarray]:
        held, lacking, fresh = [], [], {}
        get = self.cache.get
        for k, raw in enumerate(raws):
            words = [] if raw is None else raw.decode().split()
            blobs = list(map(get, words))
            try:
                blobs = b"".join(blobs)
            except TypeError:  # some word is not remembered
                at = [i for i, x in enumerate(blobs) if x is None]
                missing = [words[i] for i in at]
                fresh.update(dict.fromkeys(missing))
                lacking.append((k, at, missing))
            held.append(blobs)
        found = self._learn(list(fresh))
        for k, at, missing in lacking:
            blobs = held[k]
            for i, word in zip(at, missing, strict=True):
                blobs[i] = found[word]
            held[k] = b"".join(blobs)
        if len(self.cache) < self.most:
            self.cache.update(found)
        for raw, blob in zip(raws, held, strict=True):
            if raw is not None and any(x in raw for x in _SPECIAL):
                blob = self._whole(raw.decode())
            yield np.frombuffer(blob, "<u4")


def encoder_of(path: str) -> WordEncoder:
    """The encoder of this Python worker; what it remembers serves all its tasks."""
    held = remembered("packing")
    if path not in held:
        held[path] = WordEncoder(path)
    return held[path]


def pieces(docs: DataFrame, tokenizer_path: str, *, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = True) -> DataFrame:
    """Token pieces of every document: ids, then ``end_id``; cut only if longer than ``capacity``.

    Null and empty texts give one piece that holds only ``end_id``.  A null
    doc_id stays null.  Repeated rows give their pieces each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer_path)
        for batch in slices(batches, 4 << 20):
            rows: list[list] = [[], [], [], [], [], []]
            for key, ids in zip(batch.column(0).to_pylist(), encoder.encode(as_bytes(batch.column(1))), strict=True):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for k, start in enumerate(range(0, len(ids), capacity)):
                    blob = ids[start : start + capacity].tobytes()
                    for column, value in zip(rows, (key, k, start, len(blob) // 4, zlib.crc32(blob), blob if keep_ids else None), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    return docs.select(col(doc_id).cast("long").alias("doc_id"), col(text).cast("string").alias("text")).mapInArrow(thrifty(run, "packing"), PIECE_SCHEMA)


class OpenBins:
    """A fixed number of open bins in a bitset keyed by free space."""

    def __init__(self, capacity: int, most: int, first: int) -> None:
        self.capacity, self.most, self.next = capacity, most, first
        self.bits, self.count = 0, 0
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, free: int) -> int:
        bins = self.at[free]
        out = bins.pop()
        if not bins:
            self.bits &= ~(1 << free)
        self.count -= 1
        return out

    def put(self, length: int) -> tuple[int, int]:
        """Bin and offset for a piece."""
        above = self.bits >> length
        if above:
            free = length + (above & -above).bit_length() - 1
            chosen = self._take(free)
        else:
            if self.count >= self.most:  # the fullest closes
                self._take((self.bits & -self.bits).bit_length() - 1)
            free, chosen, self.next = self.capacity, self.next, self.next + 1
        left = free - length
        if left:
            self.at[left].append(chosen)
            self.bits |= 1 << left
            self.count += 1
        return chosen, self.capacity - free


def pack(parts: DataFrame, *, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, per_task: int = PIECES_PER_TASK, n_pieces: int | None = None) -> DataFrame:
    """Add sequence_id and offset to rows of (doc_id, piece, length, ...).

    Rows are dealt out by a hash of their whole content, so equal keys spread
    and a lost task gives the same bins again.  Within a task pieces arrive in
    hash order: long and short ones mixed, which is what best-fit needs.  A task
    numbers its sequences from its partition number times 2**33.
    """
    n = parts.count() if n_pieces is None else n_pieces
    tasks = max(1, -(-n // per_task))
    names, schema = parts.columns, parts.schema
    place = names.index("length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bins = OpenBins(capacity, open_bins, TaskContext.get().partitionId() << 33)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            placed = [bins.put(x) for x in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array([x for x, _ in placed], pa.int64()), pa.array([y for _, y in placed], pa.int64())], names=[*names, "sequence_id", "offset"])

    order = F.xxhash64(*[col(x) for x in ("doc_id", "piece", "start", "length", "ids_crc32")])
    dealt = parts.withColumn("_h", order).repartition(tasks, "_h").sortWithinPartitions("_h", "doc_id", "piece").drop("_h")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return dealt.mapInArrow(thrifty(run, "packing"), f"{ddl}, sequence_id long, offset long")


def best_fit_pack(docs: DataFrame, tokenizer_path: str, *, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, open_bins: int = OPEN_BINS, per_task: int = PIECES_PER_TASK) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row
    per piece.  The tokenised pieces are written once (their places and lengths
    only), then dealt to the packing tasks.  An empty table gives no rows.
    """
    parts = save(pieces(docs, tokenizer_path, doc_id=doc_id, text=text, capacity=capacity, end_id=end_id, keep_ids=False).drop("ids"), "pieces")
    return pack(parts, capacity=capacity, open_bins=open_bins, per_task=per_task)
