"""Builds of cached artifacts as they happen: one builder an artifact, waiters served, abandoned builds taken over when their time is up.

Requests and results come as events (artifact_key, event_id, ts, event). Decisions follow from their order in event time, whatever
order they arrive in: events wait until the watermark has passed them, and what happens between events (a build that is given up, a waiter that
has waited long enough) is a timer. The rules are one fold, ``Artifact``; the stream runs it inside ``transformWithState``, with
its state in the state store, and the batch twin runs it over sorted rows. The state of an artifact that is removed or was given up, and that nobody waits for, expires.

* A request builds where there is nothing, something failed or something is corrupt; it reuses what is ready; else it waits.
* A result ends a build: waiters are served; after a failure the first waiter builds in its turn.
* A build of over ``timeout`` is abandoned: the first waiter takes it over, else the next request does.
* A waiter waits ``timeout`` at most.

Defined results: events of null key or time are passed over, unknown events change nothing, equal rows are one event, equal times go by id.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

REQUEST, BUILT, FAILED, CORRUPT, REMOVED = "request", "artifact_built", "artifact_failed", "artifact_corrupt", "artifact_cleanup"
#: Decisions on requests.
BUILD, RETRY, TAKEN, REUSE, WAIT, SERVED, GIVEN_UP = "build", "retried", "recovered", "reuse", "wait", "served", "timed_out"
TIMEOUT_MS = 60_000
SHAPE = "at_ms long, request_id long, decision string"
#: Decisions that the batch twin passes on at once.
ROWS = 20_000
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass
class Artifact:
    """What is known of one artifact; times are milliseconds. Waiters stand in the order in which they came, so the first is due first."""

    state: str = "absent"
    since: int = 0
    waiters: deque[list[int]] = field(default_factory=deque)

    def due(self, timeout: int) -> int | None:
        """When something happens by itself."""
        first = self.waiters[0][1] + timeout if self.waiters else None
        if self.state != "building":
            return first
        return self.since + timeout if first is None else min(first, self.since + timeout)

    def _builds(self, at: int) -> None:
        self.state, self.since = "building", at

    def elapse(self, timeout: int) -> list[tuple[int, int, str]]:
        """What happens at ``due``: an abandoned build goes to the first waiter, before that waiter's own time is up."""
        at = self.due(timeout)
        out = []
        if self.state == "building" and self.since + timeout == at:
            if self.waiters:
                out.append((at, self.waiters.popleft()[0], TAKEN))
                self._builds(at)
            else:
                self.state = "abandoned"
        while self.waiters and self.waiters[0][1] + timeout <= at:
            out.append((at, self.waiters.popleft()[0], GIVEN_UP))
        return out

    def take(self, ident: int, at: int, event: str) -> list[tuple[int, int, str]]:
        if event == REQUEST:
            if self.state == "ready":
                return [(at, ident, REUSE)]
            if self.state == "building":
                self.waiters.append([ident, at])
                return [(at, ident, WAIT)]
            first = {"abandoned": TAKEN, "failed": RETRY, "corrupt": RETRY}.get(self.state, BUILD)
            self._builds(at)
            return [(at, ident, first)]
        if event == BUILT:
            served = [(at, who, SERVED) for who, _ in self.waiters]
            self.state, self.since, self.waiters = "ready", at, deque()
            return served
        if event in (FAILED, CORRUPT):
            self.state, self.since = ("failed" if event == FAILED else "corrupt"), at
            if self.waiters:
                self._builds(at)
                return [(at, self.waiters.popleft()[0], RETRY)]
        elif event == REMOVED:
            self.state, self.since = "absent", at
            if self.waiters:
                self._builds(at)
                return [(at, self.waiters.popleft()[0], BUILD)]
        return []

    def until(self, limit: int | None, timeout: int) -> list[tuple[int, int, str]]:
        """All that happens by itself before ``limit`` (None: ever)."""
        out = []
        while (at := self.due(timeout)) is not None and (limit is None or at < limit):
            out += self.elapse(timeout)
        return out

    @property
    def idle(self) -> bool:
        return self.state in ("absent", "abandoned") and not self.waiters


def _frame(rows: list[tuple[int, int, str]], key) -> pd.DataFrame:
    made = pd.DataFrame(rows, columns=["at_ms", "request_id", "decision"])
    made.insert(0, "artifact_key", pd.Series([key] * len(rows), dtype=object))
    return made


def _shaped(events: DataFrame) -> DataFrame:
    rows = events.select("artifact_key", F.col("event_id").cast("long").alias("event_id"), F.col("ts").cast("timestamp").alias("ts"), F.coalesce("event", F.lit("")).alias("event"))
    return rows.where("artifact_key IS NOT NULL AND event_id IS NOT NULL AND ts IS NOT NULL")


class Builds(StatefulProcessor):
    def __init__(self, timeout: int) -> None:
        self.timeout = timeout

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("artifact", "said string")
        self.early = handle.getListState("early", "event_id long, at long, event string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            at = part["ts"].to_numpy().astype("datetime64[ms]").astype("int64").tolist()
            self.early.appendList([(int(i), int(t), str(e)) for i, t, e in zip(part["event_id"], at, part["event"], strict=True)])
        yield self._advance(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._advance(key, timerValues.getCurrentWatermarkInMs())

    def _advance(self, key, watermark: int) -> pd.DataFrame:
        said = self.known.get()
        held = json.loads(said[0]) if said else {"state": "absent", "since": 0, "waiters": []}
        one = Artifact(held["state"], held["since"], deque(held["waiters"]))
        waiting = sorted({(int(t), int(i), str(e)) for i, t, e in self.early.get()})
        ripe, later = [x for x in waiting if x[0] < watermark], [x for x in waiting if x[0] >= watermark]
        out = []
        for at, ident, event in ripe:
            out += one.until(at, self.timeout) + one.take(ident, at, event)
        out += one.until(watermark, self.timeout)

        if later:
            self.early.put([(i, t, e) for t, i, e in later])
        else:
            self.early.clear()
        if one.idle and not later:
            self.known.clear()
        else:
            self.known.update((json.dumps({"state": one.state, "since": one.since, "waiters": list(one.waiters)}),))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        times = [t + 1 for t, _, _ in later[:1]] + [t + 1 for t in (one.due(self.timeout),) if t is not None]
        if times:
            self.handle.registerTimer(max(min(times), watermark + 1))
        return _frame(out, key[0])

    def close(self) -> None:
        pass


def live(events: DataFrame, *, timeout_ms: int = TIMEOUT_MS, late: str = "10 minutes") -> DataFrame:
    """(artifact_key, at_ms, request_id, decision) of a stream; events more than ``late`` behind are dropped by the watermark."""
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    timed = _shaped(events).withWatermark("ts", late)
    kind = dict(timed.dtypes)["artifact_key"]
    return timed.groupBy("artifact_key").transformWithStateInPandas(statefulProcessor=Builds(timeout_ms), outputStructType=f"artifact_key {kind}, {SHAPE}", outputMode="Append", timeMode="EventTime")


def replayed(events: DataFrame, *, timeout_ms: int = TIMEOUT_MS, until_ms: int | None = None) -> DataFrame:
    """The batch twin over all events, up to the time ``until_ms``; rows of an artifact are sorted, not held, and decisions go out many at a time."""
    rows = _shaped(events)
    rows = rows.where(F.unix_millis("ts") < until_ms) if until_ms is not None else rows
    kind = dict(rows.dtypes)["artifact_key"]

    def over(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, one, last, out = None, Artifact(), None, []
        for part in parts:
            for key, ident, at, event in zip(*(part[c].tolist() for c in ("artifact_key", "event_id", "at", "event")), strict=True):
                if now is None or key != now:
                    if now is not None:
                        yield _frame(out + one.until(until_ms, timeout_ms), now)
                    now, one, last, out = key, Artifact(), None, []
                if (at, ident, event) == last:
                    continue
                last = (at, ident, event)
                out += one.until(at, timeout_ms)
                out += one.take(ident, at, event)
                if one.idle:
                    one = Artifact()
                if len(out) >= ROWS:
                    yield _frame(out, key)
                    out = []
        if now is not None:
            yield _frame(out + one.until(until_ms, timeout_ms), now)

    ordered = rows.select("artifact_key", "event_id", F.unix_millis("ts").alias("at"), "event").repartition("artifact_key").sortWithinPartitions("artifact_key", "at", "event_id", "event")
    return ordered.mapInPandas(over, f"artifact_key {kind}, {SHAPE}")
