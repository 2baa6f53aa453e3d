"""Configurations and schemas."""

from __future__ import annotations

from dataclasses import dataclass

SPAN_SCHEMA = "trace_id string, span_id long, parent_span_id long, start_ns long, end_ns long, name string, attributes map<string,string>, status string, kind string"
LOG_SCHEMA = "segment_id long, idx long, op string, tx_id long, ts_sec long, key string, value binary, old_value binary, crc long, version int"

DATA_OPS = ("Insert", "Update", "Delete")
MARKERS = {"Commit": "Commit", "Abort": "Rollback"}


@dataclass(frozen=True)
class LaneConfig:
    """Lanes of 2**ring_bits slots."""

    ring_bits: int = 16
    max_producers: int = 16

    def __post_init__(self) -> None:
        if not 1 <= self.ring_bits <= 20:
            raise ValueError("ring_bits must be 1 to 20")
        if not 1 <= self.max_producers <= 128:
            raise ValueError("max_producers must be 1 to 128")

    @property
    def capacity(self) -> int:
        return 1 << self.ring_bits


DEFAULT, LOW_LATENCY, HIGH_THROUGHPUT = LaneConfig(), LaneConfig(12, 16), LaneConfig(18, 32)


@dataclass(frozen=True)
class StreamConfig:
    """Longest wait between polls and most items handed over at once."""

    poll_ms: int = 10
    batch_hint: int = 64


STREAM_DEFAULT, STREAM_LOW_LATENCY, STREAM_HIGH_THROUGHPUT = StreamConfig(), StreamConfig(1, 16), StreamConfig(50, 256)


@dataclass(frozen=True)
class BatchConfig:
    size_limit: int = 100
    timeout_us: int = 5_000_000


@dataclass(frozen=True)
class RetryConfig:
    max_retries: int = 3
    initial_ms: int = 100
    max_ms: int = 10_000
    multiplier: int = 2

    def delay_ms(self, attempt: int) -> int:
        """Wait before an attempt; none before the first (attempt 0)."""
        return 0 if attempt == 0 else min(self.initial_ms * self.multiplier ** (attempt - 1), self.max_ms)


@dataclass(frozen=True)
class BreakerConfig:
    failure_threshold: int = 5
    reset_us: int = 30_000_000
    success_threshold: int = 2
