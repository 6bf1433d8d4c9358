"""Metrics sinks, throttles and status."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, functions as F

# Seconds between looks at the lag and at a closed throttle, and looks before work goes on anyway.
LAG_POLL_S, WAIT_S, WAITS = 5, 1, 60


@dataclass(frozen=True)
class Metric:
    name: str
    kind: str  # gauge or counter
    value: float


class Sink(Protocol):
    def send(self, metrics: list[Metric]) -> None: ...


class NoopSink:
    def send(self, metrics: list[Metric]) -> None:
        pass


@dataclass
class LogSink:
    logger: logging.Logger = field(default_factory=lambda: logging.getLogger("keyweave"))

    def send(self, metrics: list[Metric]) -> None:
        for m in metrics:
            self.logger.info("metric %s %s %s", m.name, m.kind, m.value)


def report(sink: Sink, metrics: list[Metric]) -> bool:
    """Send; a failing sink is logged and never stops the work."""
    try:
        sink.send(metrics)
        return True
    except Exception as e:
        logging.getLogger("keyweave").warning("metrics not sent: %s", e)
        return False


def chunk_metrics(seconds: float, logical_rows: int, affected_rows: int) -> list[Metric]:
    return [Metric("chunk_processing_ms", "gauge", round(seconds * 1000)), Metric("chunk_logical_rows", "counter", logical_rows), Metric("chunk_affected_rows", "counter", affected_rows)]


class Throttle(Protocol):
    def closed(self) -> bool: ...


class NoThrottle:
    def closed(self) -> bool:
        return False


@dataclass
class LagThrottle:
    """Closed while the lag that `lag` tells is above the limit; asks at most every LAG_POLL_S seconds."""

    lag: Callable[[], float]
    limit_s: float
    clock: Callable[[], float] = time.monotonic
    _at: float = field(default=float("-inf"))
    _lag: float = 0.0

    def closed(self) -> bool:
        if self.clock() - self._at >= LAG_POLL_S:
            self._at, self._lag = self.clock(), self.lag()
        return self._lag >= self.limit_s


def wait_open(throttle: Throttle, sleep: Callable[[float], None] = time.sleep) -> int:
    """Wait for an open throttle, WAITS times WAIT_S seconds at most; returns the waits."""
    for n in range(WAITS):
        if not throttle.closed():
            return n
        sleep(WAIT_S)
    return WAITS


@dataclass
class Progress:
    state: str
    summary: str
    copied: int = 0
    expected: int = 0


def replica_lag(newest: DataFrame, workers: DataFrame, connected: DataFrame) -> DataFrame:
    """One row, lag: how far the slowest connected channel is behind, in what it applied or in what it has queued.

    newest has one row (newest); workers (channel, applied, queued) one a channel; connected (channel) the live ones.
    """
    live = workers.join(connected, "channel")
    applier = live.join(F.broadcast(newest)).agg(F.max(F.col("newest") - F.col("applied")).alias("a"))  # one row each side
    queue = live.agg(F.max(F.coalesce(F.col("applied") - F.col("queued"), F.lit(0))).alias("q"))
    return applier.join(F.broadcast(queue)).select(F.greatest("a", "q").alias("lag"))


def seconds_behind(applied: DataFrame) -> DataFrame:
    """(channel, seconds, days) of (channel, at): whole seconds behind the newest row of all, and days from first to last."""
    per = applied.groupBy("channel").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    newest = per.agg(F.max("last").alias("newest"))  # one row
    behind = F.unix_timestamp("newest") - F.unix_timestamp("last")
    return per.join(F.broadcast(newest)).select("channel", behind.alias("seconds"), F.date_diff(F.to_date("last"), F.to_date("first")).cast("long").alias("days"))
