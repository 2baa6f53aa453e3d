"""Write-ahead log: numbering, group commit, segments, recovery, checkpoint, truncation.

``data`` has tx_id, op (Insert, Update, Delete), key, value and, where order
matters, lsn; ``markers`` has tx_id, op (Commit, Abort) and mlsn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelane.functions.folds import ordered_fold

HEADER_BYTES = 13


def recovery_class(marker: Column) -> Column:
    return F.when(marker == "Commit", "Commit").when(marker == "Abort", "Rollback").otherwise("Incomplete")


def last_markers(markers: DataFrame, order: str = "mlsn") -> DataFrame:
    """Each transaction's last marker: (tx_id, marker, marker_at)."""
    return markers.groupBy("tx_id").agg(F.max_by("op", order).alias("marker"), F.max(order).alias("marker_at"))


def recover(data: DataFrame, markers: DataFrame, order: str = "mlsn") -> DataFrame:
    """Every transaction that left a trace: (tx_id, class, entries).

    A marker alone counts as a transaction of no entries; entries without a
    marker are incomplete.
    """
    entries = data.groupBy("tx_id").agg(F.count(F.lit(1)).alias("entries"))
    both = entries.join(last_markers(markers, order), "tx_id", "full_outer")
    return both.select("tx_id", recovery_class(F.col("marker")).alias("class"), F.coalesce("entries", F.lit(0)).alias("entries"))


def recovery_stats(recovered: DataFrame) -> DataFrame:
    return recovered.groupBy("class").agg(F.count(F.lit(1)).alias("transactions"), F.sum("entries").alias("entries"))


def records(data: DataFrame, markers: DataFrame, n_data: int | None = None) -> DataFrame:
    """Entries and markers in one order: (pos, tx_id, op, key, value); markers follow all entries."""
    n = data.count() if n_data is None else n_data
    entries = data.select(F.col("lsn").alias("pos"), "tx_id", "op", "key", "value")
    tail = markers.select((F.col("mlsn") + n).alias("pos"), "tx_id", "op", F.lit(None).cast("long").alias("key"), F.lit(None).cast("long").alias("value"))
    return entries.unionByName(tail)


def group_commit(records: DataFrame, batch: int) -> DataFrame:
    """One sync per ``batch`` records; it releases every commit that waits in the batch."""
    b = records.groupBy(F.floor((F.col("pos") - 1) / batch).alias("batch_no"))
    return b.agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("op") == "Commit").alias("waiters"), F.max("pos").alias("durable_lsn"))


def group_commit_by_gap(records: DataFrame, batch: int, gap_us: int, keys: list[str]) -> DataFrame:
    """Batches of every log (``keys``) that close when full, or when ``gap_us`` pass without a record.

    The count starts anew after a gap, so a batch is a stretch of one run of
    records: (keys, run_no, batch_no, records, first_us, last_us, by_gap).
    """
    order = Window.partitionBy(*keys).orderBy("pos")
    late = F.coalesce(F.col("ts_us") - F.lag("ts_us").over(order) >= gap_us, F.lit(False)).cast("long")
    runs = records.withColumn("_late", late).withColumn("run_no", F.sum("_late").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.row_number().over(Window.partitionBy(*keys, "run_no").orderBy("pos")) - 1
    b = runs.withColumn("batch_no", F.floor(place / batch)).groupBy(*keys, "run_no", "batch_no")
    out = b.agg(F.count(F.lit(1)).alias("records"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"))
    return out.withColumn("by_gap", F.col("records") < batch)


def entry_bytes() -> Column:
    """Header, variant, tx id, time, and length-prefixed key and value; updates and deletes hold the old value."""
    text = lambda c: F.lit(8) + F.octet_length(F.col(c).cast("string"))
    values = F.when(F.col("op") == "Update", 2 * text("value")).otherwise(text("value"))
    return (F.lit(HEADER_BYTES + 4 + 8 + 8) + text("key") + values).cast("long")


def rotate(data: DataFrame, max_bytes: int, keys: list[str] | None = None) -> DataFrame:
    """Segments by size: a new one begins before an entry once the current has ``max_bytes`` or more.

    ``keys`` name the logs if there are several; each is folded on its own, in a
    stream with constant memory.  Returns segment_id, first_lsn, last_lsn,
    entries, bytes.
    """
    sized = data.select(*(keys or []), "lsn", entry_bytes().alias("_bytes"), F.lit(0).alias("_log"))

    def step(state, row):
        segment, first, last, n, size = state
        lsn, grown = row
        made = []
        if size >= max_bytes:
            made, segment, first, n, size = [(segment, first, last, n, size)], segment + 1, None, 0, 0
        return (segment, lsn if first is None else first, lsn, n + 1, size + grown), made

    out = ordered_fold(sized, keys or ["_log"], ["lsn"], ["lsn", "_bytes"], lambda: (0, None, None, 0, 0), step, lambda s: [s] if s[3] else [], "segment_id long, first_lsn long, last_lsn long, entries long, bytes long")
    return out.drop("_log")


def fixed_segments(data: DataFrame, entries: int) -> DataFrame:
    """Entries with the segment they fall in, if segments hold a fixed number."""
    return data.withColumn("segment_id", F.floor((F.col("lsn") - 1) / entries))


def segment_summary(segmented: DataFrame) -> DataFrame:
    """Per segment: entries, first and last lsn, largest tx id; the last one is still open."""
    s = segmented.groupBy("segment_id").agg(F.count(F.lit(1)).alias("entries"), F.min("lsn").alias("first_lsn"), F.max("lsn").alias("last_lsn"), F.max("tx_id").alias("max_tx_id"))
    return s.withColumn("sealed", F.col("segment_id") < segmented.agg(F.max("segment_id")).scalar())


def truncate_before(summary: DataFrame, lsn: int) -> DataFrame:
    """Sealed segments that end before ``lsn``."""
    return summary.where(F.col("sealed") & (F.col("last_lsn") < lsn))


def truncate(segmented: DataFrame, markers: DataFrame, checkpoint_tx_id: int) -> DataFrame:
    """Per segment whether the rule drops it, and whether that would be safe.

    The rule looks at the largest tx id only; a segment is safe to drop if every
    transaction in it has a marker.
    """
    done = markers.select("tx_id", F.lit(True).alias("_done")).distinct()
    open_ones = segmented.select("segment_id", "tx_id").distinct().join(done, "tx_id", "left").groupBy("segment_id").agg(F.count_if(F.col("_done").isNull()).alias("open_transactions"))
    s = segment_summary(segmented).join(open_ones, "segment_id")
    dropped = F.col("sealed") & (F.col("max_tx_id") > 0) & (F.col("max_tx_id") < checkpoint_tx_id)
    return s.select("segment_id", "max_tx_id", "open_transactions", dropped.alias("dropped"), (dropped & (F.col("open_transactions") == 0)).alias("safe_to_drop"))


def checkpoint(markers: DataFrame, current: int, order: str = "mlsn") -> DataFrame:
    """The largest committed tx id, and whether it passes the current checkpoint."""
    best = last_markers(markers, order).where("marker = 'Commit'").agg(F.coalesce(F.max("tx_id"), F.lit(0)).alias("committed_tx_id"))
    advanced = F.col("committed_tx_id") > current
    return best.select(F.when(advanced, F.col("committed_tx_id")).otherwise(F.lit(current)).cast("long").alias("checkpoint_tx_id"), advanced.alias("advanced"))


def next_tx_id(data: DataFrame, markers: DataFrame) -> DataFrame:
    """One more than any id in the log."""
    return data.select("tx_id").unionByName(markers.select("tx_id")).agg((F.coalesce(F.max("tx_id"), F.lit(0)) + 1).alias("next_tx_id"))
