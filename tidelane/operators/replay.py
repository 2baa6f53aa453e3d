"""Replay of committed transactions into a key-value state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelane.operators.log import last_markers


def committed_entries(data: DataFrame, markers: DataFrame, order: str = "mlsn") -> DataFrame:
    """Entries of committed transactions with the place of their commit."""
    done = last_markers(markers, order).where("marker = 'Commit'").select("tx_id", F.col("marker_at").alias("commit_at"))
    return data.join(done, "tx_id")


def replay(data: DataFrame, markers: DataFrame, order: str = "mlsn", entry: str | list[str] = "lsn") -> DataFrame:
    """State (key, value) after all commits in commit order: the last writer of a key wins.

    An aggregate with partial maxima, so a hot key costs one row per task.  Old
    values are not compared, and deleting a missing key is no error.
    """
    within = [entry] if isinstance(entry, str) else entry
    last = F.max(F.struct("commit_at", *within, "op", "value")).alias("w")
    return committed_entries(data, markers, order).groupBy("key").agg(last).where("w.op <> 'Delete'").select("key", F.col("w.value").alias("value"))


def point_get(state: DataFrame, keys: list[int]) -> DataFrame:
    return state.where(F.col("key").isin(keys))


def snapshot_size(state: DataFrame) -> DataFrame:
    return state.agg(F.count(F.lit(1)).alias("keys"), F.coalesce(F.sum("value"), F.lit(0)).alias("total"))


def apply_each(data: DataFrame, markers: DataFrame, apply: Callable, schema: str, order: str = "mlsn") -> DataFrame:
    """A user's apply rule: ``apply(entries of one key in order)`` gives the rows of its state.

    Keys are independent; one key's entries are handled together.
    """
    return committed_entries(data, markers, order).groupBy("key").applyInPandas(lambda pdf: apply(pdf.sort_values(["commit_at", "lsn"])), schema)
