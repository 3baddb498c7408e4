"""Keyed stream machines with timers: a feed that goes stale, a delivery nobody acknowledges and an alert nobody takes say so by
themselves, without a further event of their key.

State is columns and maps of Spark's state store, read and written entry by entry: what a micro-batch doesn't touch isn't
rewritten. Timers run by event time (they fire as the watermark passes, so that a replay gives the same rows) or by the
clock. In event time, rows behind the watermark are dropped by Spark: choose `lateness` wide enough.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tidemark.operators.delivery import ChannelPolicy
from tidemark.streaming.folds import Collector, _clean

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MODES = ("EventTime", "ProcessingTime")


def _run(events: DataFrame, key: str, at: str, processor: StatefulProcessor, output: str, lateness: str, mode: str) -> DataFrame:
    """events through a processor, by key. `at`: seconds since the epoch."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    if mode == "EventTime":
        events = events.withColumn("__ts", F.timestamp_micros((F.col(at) * 1e6).cast("long"))).withWatermark("__ts", lateness)
    return events.groupBy(key).transformWithStateInPandas(processor, output, "append", mode)


def _after(seconds: float) -> int:
    """The first millisecond that is later than this instant."""
    return math.floor(seconds * 1000) + 1


class _Timed(StatefulProcessor):
    """One row of state (named columns), one timer at a time. Subclasses give `shape`, `step`, `due` and `fire`."""

    shape: str
    order = ["seq"]

    def __init__(self, output: str):
        self.output = [c.split()[0] for c in output.split(", ")]

    def init(self, handle) -> None:
        self.handle = handle
        self.columns = [c.split()[0] for c in self.shape.split(", ")]
        self.kept = handle.getValueState("kept", f"{self.shape}, timer long")

    def _load(self) -> tuple[dict[str, Any], int | None]:
        found = self.kept.get()
        if found is None:
            return {}, None
        values = [None if x is None or x != x else x for x in found]
        return {k: v for k, v in zip(self.columns, values, strict=False) if v is not None}, values[-1]

    def _save(self, state: dict[str, Any], timer: int | None) -> None:
        due = self.due(state)  # one that is past already fires in this micro-batch
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(int(timer))
            if due is not None:
                self.handle.registerTimer(due)
        self.kept.update((*(state.get(c) for c in self.columns), due))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, timer = self._load()
        out = []
        for row in map(_clean, pd.concat(list(rows)).sort_values(self.order, kind="stable").to_dict("records")):
            out += self.step(state, row)
        self._save(state, timer)
        yield pd.DataFrame(out, columns=self.output)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state, _ = self._load()
        out = self.fire(key[0], state, expiredTimerInfo.getExpiryTimeInMs() / 1000)
        self._save(state, None)
        yield pd.DataFrame(out, columns=self.output)

    def due(self, state: dict[str, Any]) -> int | None:
        raise NotImplementedError

    def step(self, state: dict[str, Any], row: dict[str, Any]) -> list[dict[str, Any]]:
        raise NotImplementedError

    def fire(self, key: str, state: dict[str, Any], at: float) -> list[dict[str, Any]]:
        raise NotImplementedError

    def close(self) -> None:
        pass


FEED = "provider string, seq long, at double, state string, accepted boolean, reasons string, watermark double, next_retry_at double, attempts long"


class _Feed(_Timed):
    shape = "state string, tries long, retry double, mark double, last double, seen double"

    def __init__(self, machine: Collector, keep_ms: int | None):
        super().__init__(FEED)
        self.machine, self.keep_ms = machine, keep_ms

    def init(self, handle) -> None:
        super().init(handle)
        self.known = {kind: handle.getMapState(kind, "id string", "at double", self.keep_ms) for kind in ("events", "quotes")}
        self.machine.memory = self._is_new

    def _is_new(self, kind: str, name: str, at: float) -> bool:
        fresh = not self.known[kind].containsKey((name,))
        if fresh:
            self.known[kind].updateValue((name,), (at,))
        return fresh

    def step(self, state: dict[str, Any], row: dict[str, Any]) -> list[dict[str, Any]]:
        new, found = self.machine(state, row)
        state.clear()
        state.update({k: v for k, v in new.items() if v is not None})
        return [{**found, "at": row["at"]}]

    def due(self, state: dict[str, Any]) -> int | None:
        if state.get("state") == "STREAMING" and "last" in state:
            return _after(state["last"] + self.machine.fresh)
        return None

    def fire(self, key: str, state: dict[str, Any], at: float) -> list[dict[str, Any]]:
        if state.get("state") != "STREAMING" or at - state["last"] <= self.machine.fresh:
            return []
        state["state"] = "DEGRADED"
        return [{"provider": key, "at": at, "state": "DEGRADED", "accepted": False, "reasons": "COLLECTOR_STALE", "watermark": state.get("mark"), "next_retry_at": state.get("retry"), "attempts": state.get("tries", 0)}]


def watched_feed(events: DataFrame, machine: Collector, lateness: str = "0 seconds", mode: str = "EventTime", keep_ms: int | None = None) -> DataFrame:
    """A stream of collector events -> a row for each, and one without seq when a streaming feed's last quote is older than the
    machine's freshness. Rows of a micro-batch go in the order of seq.

    Ids and fingerprints are remembered for ever, each an entry of its own in the state store; keep_ms forgets them so
    long after they came, which is the only bound, and needs mode ProcessingTime.
    """
    if keep_ms is not None and mode != "ProcessingTime":
        raise ValueError("entries expire by the clock only: keep_ms needs mode ProcessingTime")
    return _run(events, "provider", "at", _Feed(machine, keep_ms), FEED, lateness, mode)


DELIVERY = "message_id string, kind string, recorded_at double, next_attempt_at double, escalation_level long, attempt_number long, reason_code string"


class _Delivery(_Timed):
    shape = "last string, ack_due double, level long, attempts long, acknowledged boolean, dead boolean"

    def __init__(self, policy: ChannelPolicy):
        super().__init__(DELIVERY)
        self.policy = policy

    def step(self, state: dict[str, Any], row: dict[str, Any]) -> list[dict[str, Any]]:
        kind = row["kind"]
        state["last"] = kind
        if kind == "ATTEMPTED":
            state["attempts"] = state.get("attempts", 0) + 1
        elif kind == "DELIVERED":
            state.pop("ack_due", None)
            if self.policy.require_ack:
                state["ack_due"] = row["ack_due_at"] if row.get("ack_due_at") is not None else row["recorded_at"] + self.policy.ack_timeout
        elif kind == "ACKNOWLEDGED":
            state["acknowledged"] = True
        elif kind == "DEAD_LETTERED":
            state["dead"] = True
        return []

    def due(self, state: dict[str, Any]) -> int | None:
        waits = state.get("last") == "DELIVERED" and "ack_due" in state and not state.get("acknowledged") and not state.get("dead")
        return math.ceil(state["ack_due"] * 1000) if waits else None

    def fire(self, key: str, state: dict[str, Any], at: float) -> list[dict[str, Any]]:
        if self.due(state) is None:
            return []
        level = state.get("level", 0)
        base = {"message_id": key, "recorded_at": at}
        if level >= self.policy.max_escalations:
            state.update(last="DEAD_LETTERED", dead=True)
            return [{**base, "kind": "DEAD_LETTERED", "escalation_level": level, "reason_code": "ACK_TIMEOUT"}]
        state.update(last="RETRY_SCHEDULED", level=level + 1)
        retry = {"kind": "RETRY_SCHEDULED", "next_attempt_at": at, "escalation_level": level + 1, "attempt_number": state.get("attempts", 0) + 1, "reason_code": "ACK_ESCALATION"}
        return [{**base, "kind": "ESCALATED", "escalation_level": level + 1, "reason_code": "ACK_TIMEOUT"}, {**base, **retry}]


def watched_deliveries(events: DataFrame, policy: ChannelPolicy, lateness: str = "0 seconds", mode: str = "EventTime") -> DataFrame:
    """A stream of delivery events (message_id, seq, kind, recorded_at, ack_due_at) -> the events that a missing acknowledgement causes,
    when it is overdue: ESCALATED and RETRY_SCHEDULED up to max_escalations levels, then DEAD_LETTERED. What the retry comes to must come
    back as events of the stream."""
    return _run(events, "message_id", "recorded_at", _Delivery(policy), DELIVERY, lateness, mode)


ALERT = "alert_id string, at double, status string, escalation_level long, reason string"


class _Alert(_Timed):
    shape = "status string, priority string, since double, level long"

    def __init__(self, after: float):
        super().__init__(ALERT)
        self.after = after

    def step(self, state: dict[str, Any], row: dict[str, Any]) -> list[dict[str, Any]]:
        if "since" not in state:
            state.update(since=row["at"], priority=row["priority"], level=row.get("escalation_level") or 0)
        state["status"] = row["status"]
        return []

    def due(self, state: dict[str, Any]) -> int | None:
        waits = state.get("status") == "OPEN" and state.get("priority") == "P0" and not state.get("level")
        return math.ceil((state["since"] + self.after) * 1000) if waits else None

    def fire(self, key: str, state: dict[str, Any], at: float) -> list[dict[str, Any]]:
        if self.due(state) is None:
            return []
        state["level"] = 1
        return [{"alert_id": key, "at": at, "status": state["status"], "escalation_level": 1, "reason": "NO_FEEDBACK"}]


def watched_alerts(events: DataFrame, after: float, lateness: str = "0 seconds", mode: str = "EventTime") -> DataFrame:
    """A stream of alert states (alert_id, seq, at, priority, status, escalation_level) -> one escalation of each alert of the highest
    priority that is still OPEN `after` seconds after its first row."""
    return _run(events, "alert_id", "at", _Alert(after), ALERT, lateness, mode)
