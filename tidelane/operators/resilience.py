"""Export of batches under retries, a circuit breaker and a rate limit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelane.functions.folds import ordered_fold
from tidelane.functions.ordering import running, with_position
from tidelane.model import BreakerConfig, RetryConfig

CLOSED, OPEN, HALF_OPEN = "Closed", "Open", "HalfOpen"


def export_metrics(batches: DataFrame) -> DataFrame:
    return batches.agg(F.count(F.lit(1)).alias("batches"), F.sum("n_spans").alias("spans"), F.count_if(F.col("failed")).alias("failed_batches"), F.sum(F.when(F.col("failed"), F.col("n_spans")).otherwise(0)).alias("failed_spans"))


def retry(batches: DataFrame, config: RetryConfig) -> DataFrame:
    """Attempts, total wait and outcome of each batch whose first ``fails`` attempts fail."""
    most = config.max_retries + 1
    attempts = F.least(F.col("fails") + 1, F.lit(most)).cast("long")
    waits = [0]
    for k in range(1, most):
        waits.append(waits[-1] + config.delay_ms(k))
    waited = F.element_at(F.array(*[F.lit(w).cast("long") for w in waits]), attempts.cast("int"))
    return batches.select("batch_id", attempts.alias("attempts"), waited.alias("waited_ms"), (F.col("fails") < most).alias("recovered"))


def circuit_breaker(batches: DataFrame, config: BreakerConfig, keys: list[str] | None = None) -> DataFrame:
    """Each batch's outcome (ok, failed, rejected) and the breaker's state after it.

    Consecutive failures open the breaker; after ``reset_us`` since the last
    failure it is half open and admits every batch: one failure opens it again,
    ``success_threshold`` successes close it.
    """
    rows = batches.select(*(keys or []), "batch_id", "at_us", "failed", F.lit(0).alias("_exporter"))

    def step(state, row):
        name, failures, successes, last = state
        batch, at, failed = row
        if name == OPEN:
            if at - last < config.reset_us:
                return state, [(batch, "rejected", OPEN)]
            name, successes = HALF_OPEN, 0
        if failed:
            successes, last = 0, at
            if name == CLOSED:
                failures += 1
                name = OPEN if failures >= config.failure_threshold else CLOSED
            else:
                name = OPEN
        elif name == CLOSED:
            failures = 0
        else:
            successes += 1
            if successes >= config.success_threshold:
                name, failures = CLOSED, 0
        return (name, failures, successes, last), [(batch, "failed" if failed else "ok", name)]

    out = ordered_fold(rows, keys or ["_exporter"], ["batch_id"], ["batch_id", "at_us", "failed"], lambda: (CLOSED, 0, 0, 0), step, lambda s: [], "batch_id long, outcome string, state string")
    return out.drop("_exporter")


def rate_limit(batches: DataFrame, period_us: int, keys: list[str] | None = None) -> DataFrame:
    """When each batch leaves: on the tick grid that starts with the first, one batch a tick, missed ticks skipped.

    The tick in which batch i leaves is the greatest of tick(j) + i - j over all
    j up to i, a running maximum; one exporter's batches are taken in blocks.
    """
    if not keys:
        placed = with_position(batches.select("batch_id", "at_us"), ["batch_id"], "_i")
        start = placed.where("_i = 0").select(F.col("at_us").alias("_origin"))
        origin = start.scalar()
        tick = F.floor((F.col("at_us") - origin) / period_us)
        peak = running(placed, "_i", tick - F.col("_i"), "max", "_peak")
        # the batch before left in tick peak(i - 1) + i - 1, so this one not before the next
        earlier = peak.select((F.col("_i") + 1).alias("_i"), (F.col("_peak") + F.col("_i") + 1).alias("_due"))
        both = peak.join(earlier, "_i", "left")
        leaves = F.greatest("at_us", origin + F.col("_due") * period_us)
        return both.select("batch_id", leaves.cast("long").alias("leaves_us"), (leaves - F.col("at_us")).cast("long").alias("waited_us"))
    rows = batches.select(*keys, "batch_id", "at_us")

    def step(state, row):
        batch, at = row
        if state is None:
            return (at, at + period_us), [(batch, at, 0)]
        origin, due = state
        leaves = max(at, due)
        # the next tick after leaving, on the grid
        after = origin + ((leaves - origin) // period_us + 1) * period_us
        return (origin, after), [(batch, leaves, leaves - at)]

    return ordered_fold(rows, keys, ["batch_id"], ["batch_id", "at_us"], lambda: None, step, lambda s: [], "batch_id long, leaves_us long, waited_us long")
