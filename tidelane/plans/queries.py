"""Named queries: each takes a session and a folder of tables."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelane.model import BatchConfig, BreakerConfig, LaneConfig, RetryConfig, STREAM_DEFAULT
from tidelane.operators import lanes, log, replay, resilience, spans, verify
from tidelane.sources import segments, tables

HOUR_US = 3_600_000_000

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


# lanes


@query
def channel_merge_order(spark, sf_dir):
    return lanes.merge_order(tables.messages(spark, sf_dir)).select("producer_id", "seq", "event_id", "pos")


@query
def channel_bounded_drain(spark, sf_dir):
    got = lanes.drain(tables.messages(spark, sf_dir), 1000)
    return got.groupBy("producer_id").agg(F.count(F.lit(1)).alias("drained"), F.max("seq").alias("last_seq"))


@query
def lane_bounded_drain(spark, sf_dir):
    got = lanes.drain_lanes(tables.messages(spark, sf_dir, most=100), 100)
    return got.groupBy("producer_id").agg(F.count(F.lit(1)).alias("drained"), F.sum("value_c").alias("value_c"))


@query
def lane_peek(spark, sf_dir):
    return lanes.peek(tables.messages(spark, sf_dir), 3, 64).select("producer_id", "seq", "event_id", "value_c")


@query
def lane_depths(spark, sf_dir):
    m = tables.messages(spark, sf_dir)
    consumed = lanes.drain(m, 1000).groupBy("producer_id").agg((F.max("seq") + 1).alias("head"))
    return lanes.depths(m, consumed, LaneConfig(ring_bits=9))


@query
def lane_metrics(spark, sf_dir):
    return lanes.metrics(tables.messages(spark, sf_dir), 64)


@query
def register_producers(spark, sf_dir):
    return lanes.register(tables.messages(spark, sf_dir), "user_id", ["ts_us", "event_id"], LaneConfig(max_producers=128))


@query
def producer_count(spark, sf_dir):
    return lanes.producer_count(register_producers(spark, sf_dir), LaneConfig(max_producers=128))


@query
def channel_metrics(spark, sf_dir):
    m = tables.messages(spark, sf_dir)
    consumed = lanes.drain(m, 1000).groupBy("producer_id").agg((F.max("seq") + 1).alias("head"))
    return lanes.channel_metrics(m, consumed, 64)


@query
def collector_metrics(spark, sf_dir):
    return lanes.collector_metrics(lanes.try_send(tables.messages(spark, sf_dir), 8, HOUR_US, 1))


@query
def fifo_violations(spark, sf_dir):
    return lanes.fifo_violations(tables.messages(spark, sf_dir))


@query
def commit_prefix(spark, sf_dir):
    return lanes.commit_prefix(tables.messages(spark, sf_dir), 64, 48)


@query
def occupancy_try_send(spark, sf_dir):
    return lanes.try_send(tables.messages(spark, sf_dir), 8, HOUR_US, 1)


@query
def occupancy_reserve(spark, sf_dir):
    return lanes.reserve(tables.messages(spark, sf_dir), 16, 3, HOUR_US, 2)


@query
def send_status(spark, sf_dir):
    return lanes.send_status(tables.messages(spark, sf_dir), 8, HOUR_US, 1, 500)


@query
def stream_chunks(spark, sf_dir):
    return lanes.chunks(tables.messages(spark, sf_dir), STREAM_DEFAULT.batch_hint)


@query
def stream_map_filter(spark, sf_dir):
    return lanes.map_filter_take(tables.messages(spark, sf_dir), "purchase", 100)


# log


@query
def wal_assign_lsn(spark, sf_dir):
    return tables.log_data(spark, sf_dir).select("lsn", "tx_id", "op", "key", "value")


@query
def wal_group_commit(spark, sf_dir):
    data = tables.log_data(spark, sf_dir)
    n = tables.table(spark, sf_dir, "lineitem").count()
    return log.group_commit(log.records(data, tables.log_markers(spark, sf_dir), n), 256)


@query
def wal_group_commit_gap(spark, sf_dir):
    """Lanes as logs: a batch of at most 16, closed by four hours of silence."""
    rows = tables.messages(spark, sf_dir).withColumnRenamed("seq", "pos")
    return log.group_commit_by_gap(rows, 16, 4 * HOUR_US, ["producer_id"])


def _damaged_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log bytes in segments of 1000 entries: some are torn at their end, some have a flipped byte."""
    data = log.fixed_segments(tables.log_data(spark, sf_dir), 1000)
    text = lambda c: F.col(c).cast("string")
    rows = data.select("segment_id", ((F.col("lsn") - 1) % 1000).alias("idx"), "op", "tx_id", F.lit(7).cast("long").alias("ts_sec"), text("key").alias("key"), text("value").cast("binary").alias("value"), text("value").cast("binary").alias("old_value"))
    whole = segments.encode(rows)
    torn = F.expr("substring(content, 1, octet_length(content) - 5)")
    # the last byte of the last entry, which its checksum covers
    flipped = F.expr("concat(substring(content, 1, octet_length(content) - 1), X'00')")
    return whole.select("segment_id", F.when(F.col("segment_id") % 5 == 3, torn).when(F.col("segment_id") % 7 == 4, flipped).otherwise(F.col("content")).alias("content"))


@query
def wal_segment_scan(spark, sf_dir):
    """Entries encoded, framed, damaged and read back: each segment's valid prefix."""
    return segments.ends(_damaged_segments(spark, sf_dir))


@query
def wal_damage_stats(spark, sf_dir):
    return segments.damage(_damaged_segments(spark, sf_dir))


@query
def wal_scan_recover(spark, sf_dir):
    """Recovery classes of what the damaged segments still hold."""
    found = segments.entries(_damaged_segments(spark, sf_dir)).select("tx_id", "op")
    return log.recovery_stats(log.recover(found, tables.markers_by_date(spark, sf_dir), "at"))


@query
def wal_segment_rotation(spark, sf_dir):
    return log.rotate(tables.log_data(spark, sf_dir), 65_536)


@query
def wal_recover_tx(spark, sf_dir):
    return log.recover(tables.log_data(spark, sf_dir, numbered=False), tables.markers_by_date(spark, sf_dir), "at")


@query
def wal_recovery_stats(spark, sf_dir):
    return log.recovery_stats(wal_recover_tx(spark, sf_dir))


@query
def wal_marker_last_wins(spark, sf_dir):
    """Every seventh transaction has a second, opposite marker after all others."""
    once = tables.log_markers(spark, sf_dir)
    n = tables.table(spark, sf_dir, "orders").count()
    again = once.where("tx_id % 7 = 0").select((F.col("mlsn") + n).alias("mlsn"), "tx_id", F.when(F.col("op") == "Commit", "Abort").otherwise("Commit").alias("op"))
    return log.last_markers(once.unionByName(again)).select("tx_id", log.recovery_class(F.col("marker")).alias("class"))


@query
def wal_checkpoint(spark, sf_dir):
    return log.checkpoint(tables.markers_by_date(spark, sf_dir), 100, "at")


@query
def wal_truncate(spark, sf_dir):
    markers = tables.markers_by_date(spark, sf_dir)
    ckpt = tables.table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").agg(F.max("o_orderkey")).first()[0]
    return log.truncate(log.fixed_segments(tables.log_data(spark, sf_dir), 1000), markers, (ckpt or 0) + 1)


@query
def wal_truncate_before(spark, sf_dir):
    summary = log.segment_summary(log.fixed_segments(tables.log_data(spark, sf_dir), 1000))
    return log.truncate_before(summary, 25_500).select("segment_id", "entries", "first_lsn", "last_lsn")


@query
def wal_next_tx_id(spark, sf_dir):
    return log.next_tx_id(tables.log_data(spark, sf_dir, numbered=False), tables.markers_by_date(spark, sf_dir))


# replay


def _state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries in log order by their own columns, so that no numbering is needed."""
    items = tables.table(spark, sf_dir, "lineitem").select(*tables.LOG_ORDER, "l_returnflag")
    op = F.when(F.col("l_returnflag") == "N", "Insert").when(F.col("l_returnflag") == "R", "Update").otherwise("Delete")
    data = items.select((F.col("l_orderkey") + 1).alias("tx_id"), op.alias("op"), F.col("l_partkey").alias("key"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("value"), *tables.LOG_ORDER)
    return replay.replay(data, tables.markers_by_date(spark, sf_dir), "at", tables.LOG_ORDER)


@query
def wal_replay_state(spark, sf_dir):
    return _state(spark, sf_dir)


@query
def store_point_get(spark, sf_dir):
    return replay.point_get(_state(spark, sf_dir), [1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144])


@query
def store_snapshot_size(spark, sf_dir):
    return replay.snapshot_size(_state(spark, sf_dir))


@query
def store_apply_each(spark, sf_dir):
    """A user's rule: how often a key was written, and the sum of what was written to it."""

    def apply(rows):
        kept = rows[rows["op"] != "Delete"]
        return pd.DataFrame({"key": [int(rows["key"].iloc[0])], "writes": [len(kept)], "total": [int(kept["value"].sum())], "last_op": [rows["op"].iloc[-1]]})

    return replay.apply_each(tables.log_data(spark, sf_dir), tables.log_markers(spark, sf_dir), apply, "key long, writes long, total long, last_op string")


# verification


def _crashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.crash(tables.log_data(spark, sf_dir), 256, F.col("batch_no") % 5 == 4, verify.lost_write(F.col("lsn"), 97))


@query
def wal_crash_durable(spark, sf_dir):
    return _crashed(spark, sf_dir).groupBy("op", "tier").agg(F.count(F.lit(1)).alias("entries"))


@query
def wal_seeded_faults(spark, sf_dir):
    """Entries by the fault that strikes them under one seed."""
    struck = verify.strike(tables.log_data(spark, sf_dir), 42, {"write": 10_000, "partial": 5_000, "read": 20_000})
    return struck.groupBy("op", F.coalesce("fault", F.lit("none")).alias("fault")).agg(F.count(F.lit(1)).alias("entries"))


@query
def verify_recovery(spark, sf_dir):
    committed = tables.markers_by_date(spark, sf_dir).where("op = 'Commit'")
    return verify.verify_recovery(committed.where("tx_id % 11 <> 0"), committed.where("tx_id % 13 <> 0"))


@query
def wal_tx_atomicity(spark, sf_dir):
    committed = replay.committed_entries(_crashed(spark, sf_dir), tables.markers_by_date(spark, sf_dir), "at")
    return verify.atomicity(committed, committed.where("tier = 'durable'"))


# spans


@query
def span_duration_stats(spark, sf_dir):
    return spans.duration_stats(tables.spans(spark, sf_dir))


@query
def span_trace_groups(spark, sf_dir):
    return spans.trace_groups(tables.spans(spark, sf_dir))


@query
def span_trace_paths(spark, sf_dir):
    return spans.trace_paths(tables.spans(spark, sf_dir))


@query
def span_parent_join(spark, sf_dir):
    return spans.children(tables.spans(spark, sf_dir))


@query
def span_orphans(spark, sf_dir):
    return spans.orphans(tables.spans(spark, sf_dir).where("seq % 17 <> 0")).select("trace_id", "span_id", "parent_span_id")


@query
def span_validation(spark, sf_dir):
    return spans.validation(tables.spans(spark, sf_dir).where("seq % 17 <> 0"))


@query
def span_attributes(spark, sf_dir):
    return spans.attribute_counts(tables.spans(spark, sf_dir), "k")


@query
def span_error_rate(spark, sf_dir):
    return spans.error_rate(tables.spans(spark, sf_dir))


@query
def span_batch_by_size(spark, sf_dir):
    return spans.batch_by_size(tables.span_arrivals(spark, sf_dir), 512)


@query
def span_batch_size_or_timeout(spark, sf_dir):
    return spans.batch_by_size_or_time(tables.span_arrivals(spark, sf_dir), BatchConfig(size_limit=100, timeout_us=6 * HOUR_US))


@query
def span_id_decode(spark, sf_dir):
    return spans.decode_ids(tables.spans(spark, sf_dir))


# export


@query
def export_metrics(spark, sf_dir):
    return resilience.export_metrics(tables.batches(spark, sf_dir))


@query
def retry_schedule(spark, sf_dir):
    return resilience.retry(tables.batches(spark, sf_dir), RetryConfig())


@query
def circuit_breaker(spark, sf_dir):
    return resilience.circuit_breaker(tables.batches(spark, sf_dir), BreakerConfig(failure_threshold=3, reset_us=8 * HOUR_US, success_threshold=2))


@query
def rate_limited_export(spark, sf_dir):
    return resilience.rate_limit(tables.batches(spark, sf_dir), 8 * HOUR_US)
