"""Trace spans: statistics, grouping, parents, validation and batching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelane.functions.folds import ordered_fold
from tidelane.functions.ids import id_producer, id_sequence
from tidelane.model import BatchConfig


def duration_ns() -> Column:
    """Never negative."""
    return F.greatest(F.col("end_ns") - F.col("start_ns"), F.lit(0))


def duration_stats(spans: DataFrame) -> DataFrame:
    d = duration_ns()
    return spans.groupBy("name", "kind").agg(F.count(F.lit(1)).alias("n"), F.min(d).alias("min_ns"), F.max(d).alias("max_ns"), F.sum(d).alias("sum_ns"))


def trace_groups(spans: DataFrame) -> DataFrame:
    """Pending spans by trace: how many, the first and last by sequence, and roots."""
    return spans.groupBy("trace_id").agg(F.count(F.lit(1)).alias("spans"), F.min("span_id").alias("first_span"), F.max("span_id").alias("last_span"), F.count_if(F.col("parent_span_id") == 0).alias("roots"))


def traces(spans: DataFrame) -> DataFrame:
    """Traces with their spans in arrival order, as arrays."""
    return spans.groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("span_id", "parent_span_id", "name", "status"))).alias("spans"))


def trace_paths(spans: DataFrame) -> DataFrame:
    """Traces as text: their spans' sequence numbers and names in arrival order."""
    steps = F.transform("spans", lambda s: F.concat(id_sequence(s["span_id"]).cast("string"), F.lit(":"), s["name"]))
    return traces(spans).select("trace_id", F.size("spans").cast("long").alias("n"), F.array_join(steps, ",").alias("path"))


def children(spans: DataFrame) -> DataFrame:
    """Every span with the number of its direct children."""
    n = spans.where("parent_span_id <> 0").groupBy("trace_id", F.col("parent_span_id").alias("span_id")).agg(F.count(F.lit(1)).alias("children"))
    return spans.join(n, ["trace_id", "span_id"], "left").select("trace_id", "span_id", "name", F.coalesce("children", F.lit(0)).alias("children"))


def orphans(spans: DataFrame) -> DataFrame:
    """Spans whose parent is not there."""
    parents = spans.select(F.col("trace_id"), F.col("span_id").alias("parent_span_id"))
    return spans.where("parent_span_id <> 0").join(parents, ["trace_id", "parent_span_id"], "left_anti")


def validation(spans: DataFrame) -> DataFrame:
    """Breaches of each rule: (rule, breaches)."""
    again = spans.groupBy("trace_id", "span_id").count().where("count > 1").agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("breaches")).select(F.lit("unique_id").alias("rule"), "breaches")
    alone = orphans(spans).agg(F.count(F.lit(1)).alias("breaches")).select(F.lit("parent_exists").alias("rule"), "breaches")
    flat = spans.agg(F.count_if(F.col("end_ns") < F.col("start_ns")).alias("time_order"), F.count_if(F.col("status") == "Unset").alias("final_status"), F.count_if(F.col("span_id") == 0).alias("identity"))
    rest = flat.selectExpr("stack(3, 'time_order', time_order, 'final_status', final_status, 'identity', identity) AS (rule, breaches)")
    return again.unionByName(alone).unionByName(rest)


def attribute_counts(spans: DataFrame, name: str) -> DataFrame:
    """Spans by the value of an attribute."""
    value = F.get_json_object("props", f"$.{name}").cast("long")
    return spans.groupBy(value.alias("attribute")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "Error").alias("errors"))


def error_rate(spans: DataFrame) -> DataFrame:
    """Errors of every service, in millionths of its spans."""
    s = spans.groupBy("producer_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "Error").alias("errors"))
    return s.withColumn("error_ppm", F.expr("errors * 1000000 div total"))


def batch_by_size(arrivals: DataFrame, size: int) -> DataFrame:
    return arrivals.groupBy(F.floor(F.col("pos") / size).alias("batch_no")).agg(F.count(F.lit(1)).alias("spans"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"))


def batch_by_size_or_time(arrivals: DataFrame, config: BatchConfig, keys: list[str] | None = None) -> DataFrame:
    """Batches that flush when they hold ``size_limit`` spans, or at the first arrival ``timeout_us`` after the last flush.

    The rule is looked at on every arrival, after it is added; the clock starts at
    the first one.  ``keys`` name the collectors if there are several.
    """
    rows = arrivals.select(*(keys or []), "pos", "ts_us", F.lit(0).alias("_collector"))

    def step(state, row):
        number, n, first, flushed = state
        ts = row[0]
        flushed = ts if flushed is None else flushed
        n, first = n + 1, ts if n == 0 else first
        if n >= config.size_limit or ts - flushed >= config.timeout_us:
            return (number + 1, 0, None, ts), [(number, n, first, ts)]
        return (number, n, first, flushed), []

    def step_last(state, row):
        (state, last), (new, made) = state, step(state[0], row)
        return (new, row[0]), made

    out = ordered_fold(rows, keys or ["_collector"], ["pos"], ["ts_us"], lambda: ((0, 0, None, None), None), step_last, lambda s: [(s[0][0], s[0][1], s[0][2], s[1])] if s[0][1] else [], "batch_no long, spans long, first_us long, last_us long")
    return out.drop("_collector")


def decode_ids(spans: DataFrame) -> DataFrame:
    return spans.select("span_id", id_producer(F.col("span_id")).alias("producer"), id_sequence(F.col("span_id")).alias("sequence"))
