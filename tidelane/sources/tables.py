"""Messages, log, spans and export batches, viewed on the tables of a folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelane.functions.ids import pack_id, trace_hex
from tidelane.functions.ordering import with_position

LOG_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
#: Spans in an export batch.
BATCH_SPANS = 100


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _micros(c: str) -> Column:
    """Microseconds of a time without zone, read as UTC whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST({c} AS TIMESTAMP_NTZ))")


def messages(spark: SparkSession, sf_dir: str, lanes: int = 16, most: int | None = None) -> DataFrame:
    """producer_id, seq, event_id, event_type, user_id, ts_us, value_c: events in lanes by user.

    With ``most`` only the first ones of every lane, which are cut off before the sort.
    """
    e = table(spark, sf_dir, "events")
    lane = F.pmod("user_id", F.lit(lanes)).cast("long")
    place = F.row_number().over(Window.partitionBy("producer_id").orderBy("ts", "event_id"))
    e = e.withColumn("producer_id", lane).withColumn("_place", place)
    e = e if most is None else e.where(F.col("_place") <= most)
    return e.select("producer_id", (F.col("_place") - 1).cast("long").alias("seq"), "event_id", "event_type", "user_id", _micros("ts").alias("ts_us"), F.round(F.col("value") * 100).cast("long").alias("value_c"))


def log_data(spark: SparkSession, sf_dir: str, numbered: bool = True) -> DataFrame:
    """tx_id, op, key, value and, if asked for, lsn: data entries in log order."""
    items = table(spark, sf_dir, "lineitem").select(*LOG_ORDER, "l_returnflag")
    if numbered:
        items = with_position(items, LOG_ORDER, "lsn", start=1)
    op = F.when(F.col("l_returnflag") == "N", "Insert").when(F.col("l_returnflag") == "R", "Update").otherwise("Delete")
    return items.select(*["lsn"] * numbered, (F.col("l_orderkey") + 1).alias("tx_id"), op.alias("op"), F.col("l_partkey").alias("key"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("value"))


def log_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mlsn, tx_id, op: commit and abort markers, which follow all data entries."""
    orders = table(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("F", "P")).select("o_orderdate", "o_orderkey", "o_orderstatus")
    placed = with_position(orders, ["o_orderdate", "o_orderkey"], "mlsn", start=1)
    return placed.select("mlsn", (F.col("o_orderkey") + 1).alias("tx_id"), F.when(F.col("o_orderstatus") == "F", "Commit").otherwise("Abort").alias("op"))


def markers_by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tx_id, op and the markers' order as a struct: for rules that need no numbers."""
    orders = table(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("F", "P"))
    return orders.select((F.col("o_orderkey") + 1).alias("tx_id"), F.when(F.col("o_orderstatus") == "F", "Commit").otherwise("Abort").alias("op"), F.struct("o_orderdate", "o_orderkey").alias("at"))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans with SPAN_SCHEMA's columns but attributes (kept as JSON in ``props``), and producer_id, seq, event_id, ts_us."""
    m = messages(spark, sf_dir, 8)
    props = table(spark, sf_dir, "events").select("event_id", "props", F.round(F.col("value") * 1_000_000).cast("long").alias("_ns"))
    span_id = pack_id(F.col("producer_id"), F.col("seq"))
    kind = F.when(F.col("event_type") == "click", "Client").when(F.col("event_type") == "view", "Server").when(F.col("event_type") == "purchase", "Producer").when(F.col("event_type") == "signup", "Consumer").otherwise("Internal")
    start = F.col("ts_us") * 1000
    return m.join(props, "event_id").select(
        trace_hex(pack_id(F.col("producer_id"), F.floor(F.col("seq") / 5))).alias("trace_id"),
        span_id.alias("span_id"),
        F.when(F.col("seq") % 5 == 0, F.lit(0)).otherwise(span_id - 1).cast("long").alias("parent_span_id"),
        start.alias("start_ns"),
        (start + F.col("_ns")).alias("end_ns"),
        F.col("event_type").alias("name"),
        kind.alias("kind"),
        F.when(F.col("event_type") == "error", "Error").otherwise("Ok").alias("status"),
        "props",
        "producer_id",
        "seq",
        "event_id",
        "ts_us",
    )


def span_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pos, ts_us, event_id, is_error: spans in the order in which they arrive."""
    e = table(spark, sf_dir, "events").select(_micros("ts").alias("ts_us"), "event_id", (F.col("event_type") == "error").alias("is_error"))
    return with_position(e, ["ts_us", "event_id"], "pos")


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """batch_id, n_spans, n_errors, at_us, fails, failed: export batches in order."""
    b = span_arrivals(spark, sf_dir).groupBy(F.floor(F.col("pos") / BATCH_SPANS).alias("batch_id"))
    b = b.agg(F.count(F.lit(1)).alias("n_spans"), F.sum(F.col("is_error").cast("long")).alias("n_errors"), F.max("ts_us").alias("at_us"))
    return b.select("batch_id", "n_spans", "n_errors", "at_us", (F.col("batch_id") % 5).alias("fails"), (F.col("batch_id") % 8 < 4).alias("failed"))
