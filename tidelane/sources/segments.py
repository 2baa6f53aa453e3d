"""Log segments as bytes: files ``wal-<8 digits>.log`` of framed, checksummed entries.

Frame: payload length (unsigned 64 bits), CRC-32 of the payload (unsigned 32),
version (one byte), all little-endian, then the payload: variant (unsigned 32),
tx id and seconds (unsigned 64 each) and length-prefixed key and values.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelane.model import LOG_SCHEMA

HEADER = struct.Struct("<QIB")
VERSION = 1
#: Variants in the order of their numbers.
OPS = ("Insert", "Update", "Delete", "Commit", "Abort")
#: Blobs that follow the key: names of the columns.
_BLOBS = {"Insert": ("value",), "Update": ("old_value", "value"), "Delete": ("old_value",), "Commit": (), "Abort": ()}


def frame(payload: bytes, version: int = VERSION) -> bytes:
    return HEADER.pack(len(payload), zlib.crc32(payload), version) + payload


def encode_entry(op: str, tx_id: int, ts_sec: int, key: str | None = None, value: bytes | None = None, old_value: bytes | None = None) -> bytes:
    """One framed entry."""
    out = struct.pack("<IQQ", OPS.index(op), tx_id, ts_sec)
    if op not in ("Commit", "Abort"):
        blobs = {"value": value, "old_value": old_value}
        for part in ((key or "").encode(), *[blobs[b] or b"" for b in _BLOBS[op]]):
            out += struct.pack("<Q", len(part)) + part
    return frame(out)


def decode_payload(payload: bytes) -> tuple:
    """(op, tx_id, ts_sec, key, value, old_value); raises ValueError if the bytes are no entry."""
    try:
        variant, tx, ts = struct.unpack_from("<IQQ", payload)
        op = OPS[variant]
        at, parts = 20, []
        for _ in range(1 + len(_BLOBS[op]) if op not in ("Commit", "Abort") else 0):
            (n,) = struct.unpack_from("<Q", payload, at)
            if at + 8 + n > len(payload):
                raise ValueError("short entry")
            parts.append(payload[at + 8 : at + 8 + n])
            at += 8 + n
    except (struct.error, IndexError) as e:
        raise ValueError(str(e)) from e
    held = dict(zip(_BLOBS[op], parts[1:], strict=True)) if parts else {}
    return op, tx, ts, parts[0].decode() if parts else None, held.get("value"), held.get("old_value")


def scan(content: bytes) -> tuple[list[tuple], str]:
    """The valid prefix of a segment, and why reading ended: end, partial or checksum."""
    rows, at = [], 0
    while True:
        if at + HEADER.size > len(content):
            return rows, "partial" if at < len(content) else "end"
        length, crc, version = HEADER.unpack_from(content, at)
        at += HEADER.size
        if at + length > len(content):
            return rows, "partial"
        payload = content[at : at + length]
        at += length
        if zlib.crc32(payload) != crc:
            return rows, "checksum"
        try:
            rows.append((*decode_payload(payload), crc, version))
        except ValueError:
            return rows, "checksum"


def files(spark: SparkSession, folder: str) -> DataFrame:
    """(segment_id, content) of every segment file; other files are ignored."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", "wal-*.log").load(folder)
    number = F.regexp_extract(F.col("path"), r"wal-(\d{8,})\.log$", 1)
    return f.where(number != "").select(number.cast("long").alias("segment_id"), "content")


def entries(segments: DataFrame) -> DataFrame:
    """LOG_SCHEMA rows of each segment's valid prefix; a damaged segment does not stop the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.int32())
        names = [f.split()[0] for f in LOG_SCHEMA.split(", ")]
        for batch in batches:
            for segment, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [(segment, i, *r) for i, r in enumerate(scan(content)[0])]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return segments.select("segment_id", "content").mapInArrow(run, LOG_SCHEMA)


def ends(segments: DataFrame) -> DataFrame:
    """Per segment the entries of its valid prefix, their largest tx id, and why reading ended, in one scan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan(c) for c in batch.column(1).to_pylist()]
            top = [max((r[1] for r in rows), default=0) for rows, _ in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(r) for r, _ in found], pa.int64()), pa.array(top, pa.int64()), pa.array([why for _, why in found], pa.string())], names=["segment_id", "entries", "max_tx_id", "ended"])

    return segments.select("segment_id", "content").mapInArrow(run, "segment_id long, entries long, max_tx_id long, ended string")


def damage(segments: DataFrame) -> DataFrame:
    """One row: segments that end in a partial write, and with a failed checksum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([scan(c)[1] for c in batch.column(0).to_pylist()], pa.string())], names=["ended"])

    ended = segments.select("content").mapInArrow(run, "ended string")
    return ended.agg(F.count_if(F.col("ended") == "partial").alias("partial_writes"), F.count_if(F.col("ended") == "checksum").alias("checksum_failures"))


def encode(log: DataFrame) -> DataFrame:
    """(segment_id, content) from rows of segment_id, idx, op, tx_id, ts_sec, key, value, old_value.

    A segment is bounded by its size, so one task takes one segment.
    """

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["idx"])
        content = b"".join(encode_entry(r["op"], r["tx_id"], r["ts_sec"], r["key"], r["value"], r["old_value"]) for r in rows)
        return pa.table({"segment_id": pa.array([rows[0]["segment_id"]], pa.int64()), "content": pa.array([content], pa.binary())})

    return log.groupBy("segment_id").applyInArrow(run, "segment_id long, content binary")


def write(segments: DataFrame, folder: str) -> None:
    """Write segment files through Hadoop's file systems, one at a time from the driver's JVM.

    For logs of moderate size (tests, hand-over to other readers); content comes
    to the driver one partition at a time.
    """
    spark = segments.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for r in segments.toLocalIterator():
        target = jvm.org.apache.hadoop.fs.Path(os.path.join(folder, f"wal-{r['segment_id']:08d}.log"))
        out = target.getFileSystem(conf).create(target, True)
        out.write(bytearray(r["content"]))
        out.close()


def read_checkpoint(spark: SparkSession, path: str) -> int:
    """The checkpoint's tx id: eight little-endian bytes; 0 if the file is missing or of another size."""
    folder, name = os.path.split(path)
    found = spark.read.format("binaryFile").option("pathGlobFilter", name).load(folder).select("content").collect()
    return struct.unpack("<Q", found[0]["content"])[0] if found and len(found[0]["content"]) == 8 else 0


def write_checkpoint(spark: SparkSession, path: str, tx_id: int) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(struct.pack("<Q", tx_id)))
    out.close()
