"""Exporters of micro-batches, and wrappers that retry, break, limit and deduplicate.

An exporter is a function of (batch DataFrame, batch id), as ``foreachBatch``
takes it; wrappers take and give exporters.
"""

from __future__ import annotations

import json as jsonlib
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidelane.model import BreakerConfig, RetryConfig

Exporter = Callable[[DataFrame, int], None]


class CircuitOpen(RuntimeError):
    """The breaker rejects the batch; retrying does not help."""


def console(rows: int = 20) -> Exporter:
    def export(batch: DataFrame, batch_id: int) -> None:
        batch.show(rows, truncate=False)

    return export


def null() -> Exporter:
    def export(batch: DataFrame, batch_id: int) -> None:
        batch.write.format("noop").mode("overwrite").save()

    return export


def json(path: str, append: bool = False) -> Exporter:
    """JSON lines; every batch replaces what is there, or has a folder of its own.

    A batch that is delivered again replaces its own folder, so appending is
    idempotent.
    """

    def export(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").json(f"{path}/batch_id={batch_id}" if append else path)

    return export


def retrying(inner: Exporter, config: RetryConfig, sleep: Callable[[float], None] = time.sleep, counts: dict | None = None) -> Exporter:
    """Up to ``max_retries`` further attempts with exponential waits; an open circuit is not retried."""

    def export(batch: DataFrame, batch_id: int) -> None:
        for attempt in range(config.max_retries + 1):
            if attempt:
                sleep(config.delay_ms(attempt) / 1000)
            if counts is not None:
                counts["attempts"] = counts.get("attempts", 0) + 1
            try:
                return inner(batch, batch_id)
            except CircuitOpen:
                raise
            except Exception:
                if attempt == config.max_retries:
                    raise

    return export


class StateFile:
    """A small JSON value in a file that a driver started elsewhere can read too.

    The new value is written beside the old one, which goes only when it is whole;
    whatever moment a driver ends at, one whole value is left.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.jvm = spark._jvm
        make = self.jvm.org.apache.hadoop.fs.Path
        self.path, self.next, self.part = make(path), make(path + ".next"), make(path + ".part")
        self.fs = self.path.getFileSystem(spark._jsc.hadoopConfiguration())

    def load(self) -> dict | None:
        for path in (self.next, self.path):
            if self.fs.exists(path):
                stream = self.fs.open(path)
                try:
                    return jsonlib.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
                finally:
                    stream.close()
        return None

    def save(self, value: dict) -> None:
        stream = self.fs.create(self.part, True)
        try:
            stream.write(bytearray(jsonlib.dumps(value).encode()))
        finally:
            stream.close()
        if self.fs.exists(self.next):  # left by a driver that ended here
            self.fs.delete(self.path, False)
            self.fs.rename(self.next, self.path)
        self.fs.rename(self.part, self.next)
        self.fs.delete(self.path, False)
        self.fs.rename(self.next, self.path)


class Breaker:
    """Closed, Open or HalfOpen, around an exporter.

    With a ``store`` the state outlives the driver: it is loaded at the start and
    saved after every batch that changes it.  Its clock must then be the time of day.
    """

    _KEPT = ("state", "failures", "successes", "last", "opened")

    def __init__(self, inner: Exporter, config: BreakerConfig, clock: Callable[[], float] | None = None, store: StateFile | None = None) -> None:
        self.inner, self.config, self.store = inner, config, store
        self.clock = clock or (time.monotonic if store is None else time.time)
        self.state, self.failures, self.successes, self.last, self.opened = "Closed", 0, 0, 0.0, 0
        self.saved = store.load() if store else None
        for name, value in (self.saved or {}).items():
            setattr(self, name, value)

    def _open(self) -> None:
        self.state, self.opened = "Open", self.opened + 1

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        try:
            self._export(batch, batch_id)
        finally:
            now = {name: getattr(self, name) for name in self._KEPT}
            if self.store and now != self.saved:
                self.store.save(now)
                self.saved = now

    def _export(self, batch: DataFrame, batch_id: int) -> None:
        if self.state == "Open":
            if (self.clock() - self.last) * 1e6 < self.config.reset_us:
                raise CircuitOpen
            self.state, self.successes = "HalfOpen", 0
        try:
            self.inner(batch, batch_id)
        except Exception:
            self.last, self.successes = self.clock(), 0
            self.failures += self.state == "Closed"
            if self.state == "HalfOpen" or self.failures >= self.config.failure_threshold:
                self._open()
            raise
        if self.state == "Closed":
            self.failures = 0
        else:
            self.successes += 1
            if self.successes >= self.config.success_threshold:
                self.state, self.failures = "Closed", 0


def limited(inner: Exporter, period: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> Exporter:
    """At most one batch a tick of ``period`` seconds; missed ticks are skipped; 0 is unlimited."""
    due: list[float] = []

    def export(batch: DataFrame, batch_id: int) -> None:
        if period > 0:
            now = clock()
            if not due:
                due[:] = [now, now]
            if now < due[1]:
                sleep(due[1] - now)
                now = clock()
            due[1] = due[0] + (int((max(now, due[1]) - due[0]) / period + 1e-9) + 1) * period
        inner(batch, batch_id)

    return export


def resilient(inner: Exporter, retry: RetryConfig | None = None, breaker: BreakerConfig | None = None, store: StateFile | None = None) -> Exporter:
    """Retries inside a breaker, either left out if it is None; a ``store`` keeps the breaker's state."""
    out = inner if retry is None else retrying(inner, retry)
    return out if breaker is None else Breaker(out, breaker, store=store)
