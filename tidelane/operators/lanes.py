"""Lanes: bounded per-producer FIFO queues, merged by one consumer in (lane, seq) order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelane.functions.folds import ordered_fold
from tidelane.functions.ordering import lane_positions
from tidelane.model import STREAM_DEFAULT, LaneConfig


def merge_order(messages: DataFrame) -> DataFrame:
    """Every message with its position ``pos`` in the merged order: lane 0 whole, then lane 1, ..."""
    return lane_positions(messages, "producer_id", "seq", "pos")


def drain(messages: DataFrame, most: int) -> DataFrame:
    """The first ``most`` messages in merged order; low lanes go first and may starve high ones."""
    return messages.orderBy("producer_id", "seq").limit(most)


def drain_lanes(messages: DataFrame, most: int) -> DataFrame:
    """The first ``most`` messages of each lane (a dedicated consumer per lane)."""
    return messages.where(F.col("seq") < most)


def peek(messages: DataFrame, lane: int, most: int) -> DataFrame:
    """What a consumer of one lane would read next, without advancing."""
    return messages.where(F.col("producer_id") == lane).orderBy("seq").limit(most)


def depths(messages: DataFrame, consumed: DataFrame, config: LaneConfig) -> DataFrame:
    """Lane gauges: head, tail, length, and whether empty or full; ``consumed`` has (producer_id, head)."""
    tails = messages.groupBy("producer_id").agg((F.max("seq") + 1).alias("tail"))
    both = tails.join(consumed, "producer_id", "left").withColumn("head", F.least("tail", F.coalesce("head", F.lit(0))))
    length = F.col("tail") - F.col("head")
    return both.select("producer_id", "head", "tail", length.alias("length"), (length == 0).alias("is_empty"), (length >= config.capacity).alias("is_full"))


def metrics(messages: DataFrame, batch: int) -> DataFrame:
    """Messages and batches of every lane, and the channel's sums in the row of lane -1."""
    lanes = messages.groupBy("producer_id").agg(F.count(F.lit(1)).alias("messages")).withColumn("batches", F.ceil(F.col("messages") / batch))
    total = lanes.agg(F.lit(-1).cast("long").alias("producer_id"), F.coalesce(F.sum("messages"), F.lit(0)).alias("messages"), F.coalesce(F.sum("batches"), F.lit(0)).alias("batches"))
    return lanes.unionByName(total)


def register(arrivals: DataFrame, key: str, order: list[str], config: LaneConfig) -> DataFrame:
    """Dense producer ids by first arrival; -1 for those refused because all lanes are taken."""
    first = arrivals.groupBy(key).agg(F.min(F.struct(*order)).alias("_first"))
    taken = first.orderBy("_first").limit(config.max_producers)
    ids = taken.select(F.col(key), (F.row_number().over(Window.orderBy("_first")) - 1).cast("long").alias("producer_id"))
    return first.join(ids, key, "left").select(key, F.coalesce("producer_id", F.lit(-1)).alias("producer_id"), F.col("producer_id").isNotNull().alias("accepted"))


def producer_count(registered: DataFrame, config: LaneConfig) -> DataFrame:
    """One row: lanes taken, arrivals refused, and lanes that are left."""
    n = registered.agg(F.count_if("accepted").alias("producers"), F.count_if(~F.col("accepted")).alias("refused"))
    return n.withColumn("free", F.lit(config.max_producers).cast("long") - F.col("producers"))


def channel_metrics(messages: DataFrame, consumed: DataFrame, batch: int) -> DataFrame:
    """Sent and received messages and batches of every lane; ``consumed`` has (producer_id, head)."""
    sent = messages.groupBy("producer_id").agg(F.count(F.lit(1)).alias("sent"))
    both = sent.join(consumed, "producer_id", "left").withColumn("received", F.least("sent", F.coalesce("head", F.lit(0))))
    return both.select("producer_id", "sent", "received", F.ceil(F.col("sent") / batch).alias("batches_sent"), F.ceil(F.col("received") / batch).alias("batches_received"))


def collector_metrics(tried: DataFrame) -> DataFrame:
    """From tried sends: per collector lane what was submitted, found full, consumed, and is in flight at the end."""
    last = F.max_by("occupied", "seq")
    t = tried.groupBy("producer_id").agg(F.count_if("accepted").alias("submitted"), F.count_if(~F.col("accepted")).alias("full"), last.alias("in_flight"))
    return t.withColumn("consumed", F.col("submitted") - F.col("in_flight"))


def fifo_violations(messages: DataFrame) -> DataFrame:
    """Per lane, how many messages do not follow their predecessor by one."""
    before = F.lag("seq").over(Window.partitionBy("producer_id").orderBy("ts_us", "event_id"))
    return messages.select("producer_id", (F.coalesce(F.col("seq") - before, F.col("seq") + 1) != 1).alias("bad")).groupBy("producer_id").agg(F.count(F.lit(1)).alias("messages"), F.sum(F.col("bad").cast("long")).alias("violations"))


def commit_prefix(messages: DataFrame, reserved: int, wanted: int) -> DataFrame:
    """Per lane and reservation: its length, what commit_up_to publishes, and whether try_commit_n succeeds."""
    b = messages.groupBy("producer_id", F.floor(F.col("seq") / reserved).alias("batch_no")).agg(F.count(F.lit(1)).alias("reserved"))
    return b.select("producer_id", "batch_no", "reserved", F.least(F.lit(wanted).cast("long"), "reserved").alias("committed"), (F.lit(wanted) <= F.col("reserved")).alias("exact_ok"))


def try_send(messages: DataFrame, capacity: int, tick_us: int, per_tick: int) -> DataFrame:
    """Accept or reject each arrival at a lane of ``capacity`` that drains ``per_tick`` items a tick."""

    def step(state, row):
        occupied, last = state
        seq, ts = row
        tick = ts // tick_us
        if last is not None:
            occupied = max(0, occupied - per_tick * (tick - last))
        accepted = occupied < capacity
        occupied += accepted
        return (occupied, tick), [(seq, accepted, occupied)]

    return ordered_fold(messages, ["producer_id"], ["seq"], ["seq", "ts_us"], lambda: (0, None), step, lambda s: [], "seq long, accepted boolean, occupied long")


def reserve(messages: DataFrame, capacity: int, n: int, tick_us: int, per_tick: int) -> DataFrame:
    """All-or-nothing reservations of ``n`` slots at each arrival: refused if n exceeds what is free."""

    def step(state, row):
        occupied, last = state
        seq, ts = row
        tick = ts // tick_us
        if last is not None:
            occupied = max(0, occupied - per_tick * (tick - last))
        granted = 0 < n <= capacity - occupied
        occupied += n * granted
        return (occupied, tick), [(seq, granted, occupied)]

    return ordered_fold(messages, ["producer_id"], ["seq"], ["seq", "ts_us"], lambda: (0, None), step, lambda s: [], "seq long, granted boolean, occupied long")


def chunks(messages: DataFrame, size: int = STREAM_DEFAULT.batch_hint) -> DataFrame:
    """The merged stream cut into hand-overs of at most ``size``: number, size, first and last position."""
    pos = merge_order(messages)
    return pos.groupBy(F.floor(F.col("pos") / size).alias("batch_no")).agg(F.count(F.lit(1)).alias("items"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.sum("value_c").alias("value_c"))


def map_filter_take(messages: DataFrame, event_type: str, most: int) -> DataFrame:
    """A stream's map, filter and take: values of one type doubled, the first ones in merged order."""
    picked = messages.where(F.col("event_type") == event_type).select("producer_id", "seq", (F.col("value_c") * 2).alias("doubled_c"))
    return picked.orderBy("producer_id", "seq").limit(most)


def send_status(messages: DataFrame, capacity: int, tick_us: int, per_tick: int, closed_after: int) -> DataFrame:
    """Outcome counts per lane: ok, full (recoverable), or closed once ``closed_after`` arrivals have passed."""
    tried = try_send(messages.where(F.col("seq") < closed_after), capacity, tick_us, per_tick)
    status = tried.select("producer_id", F.when(F.col("accepted"), "ok").otherwise("full").alias("status"))
    closed = messages.where(F.col("seq") >= closed_after).select("producer_id", F.lit("closed").alias("status"))
    return status.unionByName(closed).groupBy("producer_id", "status").agg(F.count(F.lit(1)).alias("n"))
