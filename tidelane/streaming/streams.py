"""Structured Streaming forms: pacing, drain on shutdown, and stateful rules."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidelane.model import STREAM_DEFAULT, StreamConfig
from tidelane.streaming.sinks import Exporter


def source(spark: SparkSession, folder: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A stream of Parquet files; producers are paced by what a trigger takes."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def drain(stream: DataFrame, export: Exporter, checkpoint: str, mode: str = "append") -> None:
    """Deliver everything committed, then end: drain on shutdown."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(export).start()
    query.awaitTermination()


def poll(stream: DataFrame, export: Exporter, checkpoint: str, config: StreamConfig = STREAM_DEFAULT, mode: str = "append"):
    """Hand over micro-batches every ``poll_ms``; the returned query is stopped by its ``stop``."""
    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(processingTime=f"{config.poll_ms} milliseconds").foreachBatch(export).start()


def lane_metrics(messages: DataFrame) -> DataFrame:
    """Running counts of every lane (output mode complete or update)."""
    return messages.groupBy("producer_id").agg(F.count(F.lit(1)).alias("messages"), F.max("seq").alias("last_seq"))


def try_send(messages: DataFrame, capacity: int, tick_us: int, per_tick: int) -> DataFrame:
    """Accept or reject arrivals at bounded lanes; occupancy and clock are kept per lane.

    Within a micro-batch a lane's rows are taken by sequence; batches must bring a
    lane's rows in order, as a lane's files do.
    """

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        occupied, last = state.get if state.exists else (0, -1)
        rows = pd.concat(list(frames)).sort_values("seq")
        out = []
        for seq, ts in zip(rows["seq"].tolist(), rows["ts_us"].tolist(), strict=True):
            tick = ts // tick_us
            if last >= 0:
                occupied = max(0, occupied - per_tick * (tick - last))
            accepted = occupied < capacity
            occupied, last = occupied + accepted, tick
            out.append((key[0], seq, accepted, occupied))
        state.update((occupied, last))
        yield pd.DataFrame(out, columns=["producer_id", "seq", "accepted", "occupied"])

    return messages.select("producer_id", "seq", "ts_us").groupBy("producer_id").applyInPandasWithState(step, "producer_id long, seq long, accepted boolean, occupied long", "occupied long, last long", "append", GroupStateTimeout.NoTimeout)


def batches(spans: DataFrame, time: str, late: str, size: int, timeout_ms: int) -> DataFrame:
    """Batches (trace_id, batch, spans, reason) that a trace gives at ``size`` spans or ``timeout_ms`` after its first.

    The timer is event time, so it fires when the watermark passes it, data or
    not.  The state is two numbers per trace that has spans pending or has given a
    batch before; spans without a trace are a trace of their own.
    """

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, pending = state.get if state.exists else (0, 0)
        out = []
        if state.hasTimedOut:
            if pending:
                out.append((key[0], number, pending, "timeout"))
            state.update((number + (pending > 0), 0))
        else:
            rows = pd.concat(list(frames))
            fresh, pending = pending == 0, pending + len(rows)
            while pending >= size:
                out.append((key[0], number, size, "size"))
                number, pending, fresh = number + 1, pending - size, True
            state.update((number, pending))
            if pending:
                # a new first span starts the timer; an old one's goes on
                first = rows["at_ms"].sort_values().iloc[-min(pending, len(rows))] if fresh else None
                due = int(first) + timeout_ms if fresh else state.oldTimeoutTimestamp
                state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["trace_id", "batch", "spans", "reason"])

    t = spans.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    rows = t.select("trace_id", time, F.unix_millis(time).alias("at_ms"))
    return rows.groupBy("trace_id").applyInPandasWithState(step, "trace_id long, batch long, spans long, reason string", "batch long, pending long", "append", GroupStateTimeout.EventTimeTimeout)


def span_windows(spans: DataFrame, time: str, late: str, width: str) -> DataFrame:
    """Spans and errors per closed time window; rows later than ``late`` are dropped."""
    t = spans.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return t.groupBy(F.window(time, width)).agg(F.count(F.lit(1)).alias("spans"), F.count_if(F.col("status") == "Error").alias("errors"))


def first_delivery(entries: DataFrame, late: str, time: str) -> DataFrame:
    """Each (tx_id, lsn) once, for replay under at-least-once delivery."""
    return entries.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark(["tx_id", "lsn"])
