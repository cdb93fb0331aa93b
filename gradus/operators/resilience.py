"""Bounded fallback over injected models, and spans of a run. These run on the driver, around lazy plans."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


class Exhausted(RuntimeError):
    """Every backend failed; the names of the errors, in order."""

    def __init__(self, reasons: Sequence[str]) -> None:
        super().__init__("every backend failed: " + ", ".join(reasons))
        self.reasons = tuple(reasons)


@dataclass(frozen=True)
class Served:
    text: str
    backend: str
    attempts: int
    fallback_used: bool
    latency_ms: float
    reason: str | None = None


def complete(prompt: str, backends: Sequence[tuple[str, Callable[[str], str]]]) -> Served:
    """The first backend's answer; each is tried once, and only the type of an error is kept."""
    reasons: list[str] = []
    for attempt, (name, call) in enumerate(backends, 1):
        start = time.perf_counter()
        try:
            text = call(prompt)
        except Exception as error:  # any failure of one backend leads to the next
            reasons.append(type(error).__name__)
            continue
        return Served(text, name, attempt, attempt > 1, (time.perf_counter() - start) * 1000, reasons[-1] if reasons else None)
    raise Exhausted(reasons)


@dataclass
class Trace:
    """Spans of a run, as rows."""

    trace_id: str = field(default_factory=lambda: uuid.uuid4().hex)
    rows: list[tuple[str, str, float, bool]] = field(default_factory=list)

    @contextmanager
    def span(self, operation: str) -> Iterator[None]:
        start, fine = time.perf_counter(), False
        try:
            yield
            fine = True
        finally:
            self.rows.append((self.trace_id, operation, (time.perf_counter() - start) * 1000, fine))

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "trace_id string, operation string, latency_ms double, ok boolean")
