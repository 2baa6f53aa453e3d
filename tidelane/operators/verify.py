"""Crashes, faults and what recovery must and must not bring back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lost_write(lsn: Column, every: int) -> Column:
    """A deterministic write fault."""
    return lsn % every == 0


def seeded_fault(seed: int, kind: str, lsn: Column, ppm: int) -> Column:
    """A fault that strikes ``ppm`` of a million entries, the same ones for one seed and kind."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:{kind}:"), lsn.cast("string")).cast("binary")), 1, 8)
    return F.conv(digits, 16, 10).cast("long") % 1_000_000 < ppm


def strike(data: DataFrame, seed: int, rates: dict[str, int]) -> DataFrame:
    """Entries with the first fault that strikes them (``rates``: kind to parts in a million), or null."""
    fault = F.lit(None).cast("string")
    for kind, ppm in reversed(rates.items()):
        fault = F.when(seeded_fault(seed, kind, F.col("lsn"), ppm), kind).otherwise(fault)
    return data.withColumn("fault", fault)


def durable_lsn(data: DataFrame, batch: int, failed_sync: Column) -> DataFrame:
    """The end of the last batch whose sync succeeded: one row; 0 if there was none."""
    b = data.groupBy(F.floor((F.col("lsn") - 1) / batch).alias("batch_no")).agg(F.max("lsn").alias("end"))
    return b.where(~failed_sync).agg(F.coalesce(F.max("end"), F.lit(0)).alias("durable_lsn"))


def crash(data: DataFrame, batch: int, failed_sync: Column, write_fault: Column) -> DataFrame:
    """Every entry with its tier after a crash: durable, lost (not synced), or never written."""
    cut = durable_lsn(data, batch, failed_sync).scalar()
    return data.withColumn("tier", F.when(write_fault, "unwritten").when(F.col("lsn") <= cut, "durable").otherwise("lost"))


def verify_recovery(acknowledged: DataFrame, recovered: DataFrame) -> DataFrame:
    """Transactions as (status, tx_id): found, lost (acknowledged only), phantom (recovered only)."""
    a, r = acknowledged.select("tx_id").distinct(), recovered.select("tx_id").distinct()
    found = a.join(r, "tx_id", "left_semi").select(F.lit("found").alias("status"), "tx_id")
    lost = a.join(r, "tx_id", "left_anti").select(F.lit("lost").alias("status"), "tx_id")
    phantom = r.join(a, "tx_id", "left_anti").select(F.lit("phantom").alias("status"), "tx_id")
    return found.unionByName(lost).unionByName(phantom)


def atomicity(committed: DataFrame, replayed: DataFrame) -> DataFrame:
    """Committed transactions with logged and replayed entries, and whether all came back."""
    logged = committed.groupBy("tx_id").agg(F.count(F.lit(1)).alias("logged"))
    back = replayed.groupBy("tx_id").agg(F.count(F.lit(1)).alias("replayed"))
    both = logged.join(back, "tx_id", "left").withColumn("replayed", F.coalesce("replayed", F.lit(0)))
    return both.select("tx_id", "logged", "replayed", (F.col("logged") == F.col("replayed")).alias("atomic"))
