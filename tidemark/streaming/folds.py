"""Ordered state machines over event tables and streams: feed collection, alerting, delivery.

Each machine is a pure step (state, event) -> (state, output) with a JSON-like state. `fold` runs one over a table: rows
are dealt by key, sorted, and read in Arrow batches, so that a hot key streams through its task instead of being held.
`stream_fold` runs the same step over a stream with Spark's keyed state.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

Step = Callable[[dict[str, Any], dict[str, Any]], tuple[dict[str, Any], dict[str, Any]]]


def _clean(row: dict[str, Any]) -> dict[str, Any]:
    return {k: None if v is None or v is pd.NaT or v != v else v for k, v in row.items()}


def fold(rows: DataFrame, key: str, order: list[str], step: Step, output: str) -> DataFrame:
    """Runs step over each key's rows in order -> one output row (schema `output`) for each."""
    names = [c.split()[0] for c in output.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, {}
        for batch in batches:
            out = []
            for row in map(_clean, batch.to_dict("records")):
                if row[key] != now or not state:
                    now, state = row[key], {"__": 1}
                state, found = step(state, row)
                out.append(found)
            yield pd.DataFrame(out, columns=names)

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, output)


def stream_fold(events: DataFrame, key: str, order: list[str], step: Step, output: str, hold: float = 0.0, at: str = "at") -> DataFrame:
    """The same over a stream, with the state kept as JSON. Rows of one micro-batch are sorted.

    A stream may bring a key's rows over several micro-batches in another order than they happened. With `hold` (seconds of
    the column `at`), rows wait in the state until the key has a row that is `hold` later, and then go through in order; what
    comes later still meets the step as it is. Rows that nothing later ever follows stay held: end a stream with a later row.
    """
    names = [c.split()[0] for c in output.split(",")]

    def run(_key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state = json.loads(held.get[0]) if held.exists else {"__": 1}
        waiting = state.pop("__held", [])
        for batch in batches:
            waiting += map(_clean, batch.to_dict("records"))
        waiting.sort(key=lambda row: [row[c] for c in order])
        upto = max((row[at] for row in waiting), default=0.0) - hold if hold else None
        go = [row for row in waiting if upto is None or row[at] <= upto]
        later = [row for row in waiting if upto is not None and row[at] > upto]
        out = []
        for row in go:
            state, found = step(state, row)
            out.append(found)
        if later:
            state["__held"] = later
        held.update((json.dumps(state),))
        yield pd.DataFrame(out, columns=names)

    return events.groupBy(key).applyInPandasWithState(run, output, "state string", "append", GroupStateTimeout.NoTimeout)


def _remember(known: dict[str, float], name: str, at: float, keep: float | None) -> bool:
    """Whether a name is new; notes it. With `keep`, one that came longer ago (in seconds) is new again, and forgotten."""
    if keep is None:
        fresh = name not in known
        known[name] = at
        return fresh
    fresh = known.get(name, -float("inf")) < at - keep
    known.pop(name, None)
    known[name] = at
    while known[first := next(iter(known))] < at - keep:
        del known[first]
    return fresh


def alert_step(cooldown: float = 300.0, needed: int = 2) -> Step:
    """fingerprint, at (seconds), active -> outcome. An alert is made at the `needed`-th active observation in a row and
    each later one, unless the last alert was made less than the cooldown ago. Such an observation from before the last
    alert is refused; others may come in any order of time."""

    def step(s: dict, e: dict) -> tuple[dict, dict]:
        s = dict(s)
        s["run"] = s.get("run", 0) + 1 if e["active"] else 0
        if not e["active"]:
            outcome = "INACTIVE"
        elif s["run"] < needed:
            outcome = "PENDING"
        elif "made" in s and e["at"] < s["made"]:
            outcome = "TIME_REGRESSION"
        elif "made" in s and e["at"] - s["made"] < cooldown:
            outcome, s["dropped"] = "SUPPRESSED", s.get("dropped", 0) + 1
        else:
            outcome, s["made"], s["dropped"] = "CREATED", e["at"], 0
        return s, {"fingerprint": e["fingerprint"], "seq": e["seq"], "outcome": outcome, "suppressed": s.get("dropped", 0)}

    return step


def outbox_step(cooldown: float = 300.0, keep: float | None = None) -> Step:
    """dedupe_key, message_id, at -> outcome. The cooldown runs from the latest message of the key, suppressed ones too."""

    def step(s: dict, e: dict) -> tuple[dict, dict]:
        s = dict(s)
        if not _remember(s.setdefault("seen", {}), e["message_id"], e["at"], keep):
            outcome = "DUPLICATE"
        else:
            outcome = "SUPPRESSED" if "at" in s and e["at"] - s["at"] < cooldown else "ENQUEUED"
            s["at"] = e["at"]
        return s, {"dedupe_key": e["dedupe_key"], "message_id": e["message_id"], "outcome": outcome}

    return step


def delivery_step(base: float = 1.0, most: float = 4.0, attempts: int = 3) -> Step:
    """message_id, at, ok -> attempt number, outcome and when the next attempt is due: the delay doubles up to `most`."""

    def step(s: dict, e: dict) -> tuple[dict, dict]:
        s, due = dict(s), None
        if s.get("end"):
            outcome = "TERMINAL"
        elif e["at"] < s.get("due", e["at"]):
            outcome = "NOT_DUE"
        else:
            s["n"] = s.get("n", 0) + 1
            outcome = "DELIVERED" if e["ok"] else "RETRY_SCHEDULED" if s["n"] < attempts else "DEAD_LETTERED"
            if outcome == "RETRY_SCHEDULED":
                due = s["due"] = e["at"] + min(base * 2 ** (s["n"] - 1), most)
            else:
                s["end"] = True
        return s, {"message_id": e["message_id"], "seq": e["seq"], "attempt": s.get("n", 0), "outcome": outcome, "due": due}

    return step


class Collector:
    """A feed's connection: STOPPED, CONNECTING, STREAMING, DEGRADED, BACKING_OFF, RATE_LIMITED or HALTED.

    Events: provider, event_id, seq, kind, at (first seen, seconds), schema_version, source_ts, payload (a quote's
    fingerprint, or the seconds of a rate limit), and instrument_id if the collector has an instrument. Rejected events leave
    the state alone but for what is said below. Ids and fingerprints are remembered for ever, or for `keep` seconds of event time;
    `memory` (kind, name, at) -> whether it is new, if given, remembers them elsewhere than in the state.
    """

    LIVE = ("STREAMING", "DEGRADED")

    def __init__(self, schema: str = "v1", base: float = 1.0, most: float = 4.0, attempts: int = 3, lateness: float = 0.25, fresh: float = 5.0, instrument: str | None = None, keep: float | None = None):
        self.instrument, self.keep, self.memory = instrument, keep, None
        self.schema, self.base, self.most, self.attempts, self.lateness, self.fresh = schema, base, most, attempts, lateness, fresh

    def __call__(self, s: dict, e: dict) -> tuple[dict, dict]:
        s = {"state": "STOPPED", "tries": 0, "retry": None, "mark": None, "last": None, "seen": None, **s}
        why: list[str] = []
        if not self._new(s, "events", e["event_id"], e["at"]):
            why.append("DUPLICATE_EVENT")
        if s["seen"] is not None and e["at"] < s["seen"]:
            why.append("EVENT_TIME_REGRESSION")
        s["seen"] = e["at"] if s["seen"] is None else max(s["seen"], e["at"])
        if not why:
            if e["schema_version"] != self.schema:
                s["state"] = "HALTED"
                why.append("SCHEMA_DRIFT")
            elif s["state"] == "HALTED":
                why.append("COLLECTOR_HALTED")
            else:
                why += getattr(self, f"on_{e['kind'].lower()}")(s, e)
        accepted = not why
        if s["state"] in self.LIVE and (s["last"] is None or e["at"] - s["last"] > self.fresh):
            s["state"] = "DEGRADED"
            why.append("COLLECTOR_STALE")
        return s, {
            "provider": e["provider"], "seq": e["seq"], "state": s["state"], "accepted": accepted, "reasons": ",".join(sorted(set(why))),
            "watermark": s["mark"], "next_retry_at": s["retry"], "attempts": s["tries"],
        }

    def _new(self, s: dict, kind: str, name: str, at: float) -> bool:
        return self.memory(kind, name, at) if self.memory else _remember(s.setdefault(kind, {}), name, at, self.keep)

    def _drop(self, s: dict, state: str, retry: float | None) -> None:
        s.update(state=state, retry=retry, last=None)

    def on_start(self, s: dict, e: dict) -> list[str]:
        if s["state"] != "STOPPED":
            return ["INVALID_TRANSITION"]
        s["state"] = "CONNECTING"
        return []

    def on_connected(self, s: dict, e: dict) -> list[str]:
        if s["state"] in ("STOPPED", "STREAMING"):
            return ["INVALID_TRANSITION"]
        if s["retry"] is not None and e["at"] < s["retry"]:
            return ["RETRY_TOO_EARLY"]
        s.update(state="STREAMING", retry=None, tries=0)
        return []

    def on_connection_lost(self, s: dict, e: dict) -> list[str]:
        s["tries"] += 1
        if s["tries"] > self.attempts:
            self._drop(s, "HALTED", None)
            return ["RECONNECT_BUDGET_EXHAUSTED"]
        self._drop(s, "BACKING_OFF", e["at"] + min(self.base * 2 ** (s["tries"] - 1), self.most))
        return []

    def on_rate_limited(self, s: dict, e: dict) -> list[str]:
        try:
            wait = float(e["payload"])
        except (TypeError, ValueError):
            wait = 0.0
        if not wait > 0:
            self._drop(s, "HALTED", None)
            return ["INVALID_RETRY_AFTER"]
        self._drop(s, "RATE_LIMITED", e["at"] + max(wait, self.base))
        return []

    def on_schema_drift(self, s: dict, e: dict) -> list[str]:
        s["state"] = "HALTED"
        return ["SCHEMA_DRIFT"]

    def on_stop(self, s: dict, e: dict) -> list[str]:
        self._drop(s, "STOPPED", None)
        return []

    def on_heartbeat(self, s: dict, e: dict) -> list[str]:
        return [] if s["state"] in self.LIVE else ["INVALID_TRANSITION"]

    def on_quote(self, s: dict, e: dict) -> list[str]:
        if s["state"] not in self.LIVE:
            return ["COLLECTOR_NOT_STREAMING"]
        if self.instrument is not None and e.get("instrument_id") != self.instrument:
            return ["INSTRUMENT_MISMATCH"]
        if not self._new(s, "quotes", e["payload"], e["at"]):
            return ["DUPLICATE_OBSERVATION"]
        if s["mark"] is not None and e["source_ts"] < s["mark"]:
            return ["OUT_OF_ORDER_OBSERVATION"] + ["BEHIND_WATERMARK"] * (e["source_ts"] < s["mark"] - self.lateness)
        s.update(mark=e["source_ts"], last=e["at"], state="STREAMING")
        return []
