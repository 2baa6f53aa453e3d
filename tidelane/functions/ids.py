"""Span ids: the producer in the top 16 bits, a sequence number below."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEQUENCE_BITS = 48


def pack_id(producer: Column, seq: Column) -> Column:
    return F.shiftleft(producer.cast("long"), SEQUENCE_BITS).bitwiseOR(seq.cast("long"))


def id_producer(span_id: Column) -> Column:
    return F.shiftrightunsigned(span_id, SEQUENCE_BITS)


def id_sequence(span_id: Column) -> Column:
    return span_id.bitwiseAND(F.lit((1 << SEQUENCE_BITS) - 1))


def trace_hex(number: Column) -> Column:
    """32 lower-case hex digits."""
    return F.lpad(F.lower(F.hex(number)), 32, "0")
