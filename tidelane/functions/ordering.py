"""Positions in a global order, without one task for all rows."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one sorting task numbers, by expectation, the most tasks, and sampled rows
#: for each bound.
ROWS_PER_RANGE, MOST_RANGES, SAMPLED = 1_000_000, 4096, 32


def with_position(df: DataFrame, order: list[str], name: str, *, start: int = 0, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Add the position of each row in the total order of the columns ``order``.

    Rows are dealt to ranges of the whole key, whose bounds come from a sample by
    hash of ``SAMPLED`` rows a range, numbered within their range by a window, and
    shifted by the rows of the ranges before.  So many rows that agree on the first
    columns still spread.  Only the bounds and the ranges' counts reach the driver;
    ``MOST_RANGES`` bounds the plan, and ranges grow beyond it.  Nulls come first.
    """
    key = F.struct(*order)
    n = df.count()
    ranges = max(1, min(MOST_RANGES, -(-n // rows_per_range)))
    bucket = F.lit(0)
    offset = F.lit(0).cast("long")
    if ranges > 1:
        part = max(1, n // (SAMPLED * ranges))
        sample = df.where(F.pmod(F.xxhash64(*order), F.lit(part)) == 0).select(*order).orderBy(*[F.col(c).asc_nulls_first() for c in order]).collect()
        cuts = list(dict.fromkeys(sample[k * len(sample) // ranges] for k in range(1, ranges))) if sample else []
        kinds = df.select(*order).schema
        bucket = _range_of(key, [F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(c, kinds, strict=True)]) for c in cuts])
        counts = {r["_b"]: r["count"] for r in df.groupBy(bucket.alias("_b")).count().collect()}
        keys = sorted(counts)
        before = dict(zip(keys, accumulate([0, *[counts[k] for k in keys[:-1]]]), strict=True))
        offset = F.element_at(F.create_map(*[F.lit(x) for k in keys for x in (k, before[k])]), F.col("_b")).cast("long")
    window = Window.partitionBy("_b").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    return df.withColumn("_b", bucket).withColumn(name, F.row_number().over(window) + offset + F.lit(start - 1)).drop("_b").withColumn(name, F.col(name).cast("long"))


def _range_of(value: Column, cuts: list[Column]) -> Column:
    """How many cuts lie below the value, by a balanced tree of comparisons."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value > cuts[mid], tree(mid + 1, hi)).otherwise(tree(lo, mid))

    return tree(0, len(cuts))


def lane_positions(df: DataFrame, lane: str, seq: str, name: str) -> DataFrame:
    """Position in (lane, seq) order, where seq counts every lane's rows from 0.

    Lanes are few (128 at most in a channel), so their offsets are a small
    broadcast table if its size allows, else a join on the lane.
    """
    counts = df.groupBy(lane).agg(F.count(F.lit(1)).alias("_n"))
    window = Window.orderBy(lane).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(lane, F.coalesce(F.sum("_n").over(window), F.lit(0)).alias("_before"))
    return df.join(offsets, lane).withColumn(name, (F.col("_before") + F.col(seq)).cast("long")).drop("_before")


def running(df: DataFrame, pos: str, value: Column, kind: str, name: str, *, block: int = ROWS_PER_RANGE) -> DataFrame:
    """Add the running ``sum`` or ``max`` of a value in the order of dense positions, this row included.

    Rows are taken in blocks of positions: a window inside each, and one over the
    blocks' totals, so that no task sees all rows.
    """
    fold = {"sum": F.sum, "max": F.max}[kind]
    rows = df.withColumn("_value", value).withColumn("_block", F.floor(F.col(pos) / block))
    totals = rows.groupBy("_block").agg(fold("_value").alias("_total"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_block", fold("_total").over(before).alias("_before"))
    inside = fold("_value").over(Window.partitionBy("_block").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0))
    both = rows.withColumn("_inside", inside).join(totals, "_block")
    whole = F.col("_inside") + F.coalesce("_before", F.lit(0)) if kind == "sum" else F.greatest("_inside", "_before")
    return both.withColumn(name, whole).drop("_value", "_block", "_inside", "_before")
