"""A circuit breaker: as a guard for calls to services, and replayed over a table of outcomes."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class BreakerConfig:
    failure_threshold: int = 5
    recovery_timeout_s: float = 30.0
    half_open_max_calls: int = 3
    max_backoff_s: float = 300.0
    exponential_backoff: bool = True


class CircuitOpen(RuntimeError):
    """The call was not made."""


class Breaker:
    """closed -> open after enough failures; open -> half_open when the wait is over; half_open -> closed or open again.

    Successes while closed do not reset the failures. ``clock`` gives seconds, ``jitter`` a number from 0 to 1.
    """

    def __init__(self, config: BreakerConfig = BreakerConfig(), clock: Callable[[], float] = time.monotonic, jitter: Callable[[], float] = random.random):
        self.config, self.clock, self.jitter = config, clock, jitter
        self.state, self.failures, self.successes, self.retries = "closed", 0, 0, 0
        self._trials, self._again = 0, 0.0

    def backoff(self) -> float:
        if not self.config.exponential_backoff:
            return self.config.recovery_timeout_s
        delay = min(self.config.recovery_timeout_s * 2.0 ** min(self.retries, 60), self.config.max_backoff_s)
        return float(int(delay * (0.5 + 0.5 * self.jitter())))

    def allow(self) -> bool:
        if self.state == "open" and self.clock() >= self._again:
            self.state, self._trials = "half_open", 0
            return True
        return self.state == "closed" or self.state == "half_open" and self._trials < self.config.half_open_max_calls

    def success(self) -> None:
        self.successes += 1
        if self.state == "half_open":
            self._trials += 1
            if self._trials >= self.config.half_open_max_calls:
                self.state, self.retries, self.failures = "closed", 0, 0

    def failure(self) -> None:
        self.failures += 1
        if self.state == "half_open" or self.state == "closed" and self.failures >= self.config.failure_threshold:
            self._again = self.clock() + self.backoff()
            self.state = "open"
            self.retries += 1

    def call(self, f: Callable, *args, **kwargs):
        if not self.allow():
            raise CircuitOpen(f"retry in {self._again - self.clock():.1f} s")
        try:
            result = f(*args, **kwargs)
        except Exception:
            self.failure()
            raise
        self.success()
        return result

    def stats(self) -> dict:
        return {"state": self.state, "failures": self.failures, "successes": self.successes, "retry_count": self.retries}


def replayed(outcomes: DataFrame, config: BreakerConfig = BreakerConfig(), jitter: float = 1.0) -> DataFrame:
    """(service, ts, seq, ok, allowed, state) for outcomes (service string, ts timestamp, seq bigint, ok boolean).

    A service's calls are a sequence by nature and are streamed in order through one breaker, with constant memory.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, name, own = [0.0], None, None
        for batch in batches:
            services, times, oks = (batch.column(i).to_pylist() for i in (0, 1, 3))
            allowed, states = [], []
            for service, ts, ok in zip(services, times, oks):
                if own is None or service != name:
                    name, own = service, Breaker(config, lambda: now[0], lambda: jitter)
                now[0] = ts.timestamp()
                let = own.allow()
                if let:
                    own.success() if ok else own.failure()
                allowed.append(let)
                states.append(own.state)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(allowed, pa.bool_()), pa.array(states, pa.string())], ["service", "ts", "seq", "ok", "allowed", "state"])

    ordered = outcomes.select("service", F.col("ts").cast("timestamp").alias("ts"), F.col("seq").cast("bigint").alias("seq"), "ok").filter("ts IS NOT NULL AND ok IS NOT NULL")
    return ordered.repartition("service").sortWithinPartitions("service", "ts", "seq").mapInArrow(
        run, "service string, ts timestamp, seq bigint, ok boolean, allowed boolean, state string")
