"""The collector over a whole table, for feeds of any length: what `folds.Collector` says row by row, worked out in scans.

* Repeated event ids and observations are told by the first occurrence of each, an aggregate dealt by id: nothing is remembered
  in a state, and nothing is ever forgotten.
* The connection (stopped, connecting, live, waiting, halted) hangs on control events only. A part's control events are
  summed up as a function of the state that they begin with; functions are composed part by part, and then each part is run
  from its own beginning.
* The clock, the watermark, the last quote and staleness are running maxima and last values (`scans.Ordered`).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import asof, quality
from tidemark.operators.scans import PART_ROWS, Ordered
from tidemark.session import cut
from tidemark.sources import records
from tidemark.streaming.folds import Collector, _clean

OUTPUT = "provider string, seq long, state string, accepted boolean, reasons string, watermark double, next_retry_at double, attempts long"
CONTROL = ("START", "CONNECTED", "CONNECTION_LOST", "RATE_LIMITED", "SCHEMA_DRIFT", "OTHER_SCHEMA", "STOP")
#: A feed's own word of a drift, and an event of another schema version: both halt, and leave a wait as it was.
DRIFTS = ("SCHEMA_DRIFT", "OTHER_SCHEMA")


class Line(NamedTuple):
    """A connection's state: STOPPED, CONNECTING, LIVE, BACKING_OFF, RATE_LIMITED or HALTED; lost connections since the last success; when
    the next try may be."""

    state: str = "STOPPED"
    tries: int = 0
    retry: float | None = None


class Connection:
    """The connection's part of a Collector: control events (kind, at, payload; an event of another schema version is OTHER_SCHEMA)."""

    def __init__(self, base: float, most: float, attempts: int):
        self.base, self.most, self.attempts = base, most, attempts

    def step(self, line: Line, kind: str, at: float, payload: Any) -> tuple[Line, str | None]:
        """(the state after, what is wrong with the event). CONNECTED on a live line is told apart later."""
        if kind == "OTHER_SCHEMA":
            return line._replace(state="HALTED"), "SCHEMA_DRIFT"
        if line.state == "HALTED":
            return line, "COLLECTOR_HALTED"
        if kind == "SCHEMA_DRIFT":
            return line._replace(state="HALTED"), "SCHEMA_DRIFT"
        if kind == "START":
            return (line._replace(state="CONNECTING"), None) if line.state == "STOPPED" else (line, "INVALID_TRANSITION")
        if kind == "CONNECTED":
            if line.state == "STOPPED":
                return line, "INVALID_TRANSITION"
            if line.retry is not None and at < line.retry:
                return line, "RETRY_TOO_EARLY"
            return Line("LIVE"), None
        if kind == "STOP":
            return Line("STOPPED", line.tries), None
        if kind == "CONNECTION_LOST":
            tries = line.tries + 1
            if tries > self.attempts:
                return Line("HALTED", tries), "RECONNECT_BUDGET_EXHAUSTED"
            return Line("BACKING_OFF", tries, at + min(self.base * 2 ** (tries - 1), self.most)), None
        try:
            wait = float(payload)
        except (TypeError, ValueError):
            wait = 0.0
        if not wait > 0:
            return Line("HALTED", line.tries), "INVALID_RETRY_AFTER"
        return Line("RATE_LIMITED", line.tries, at + max(wait, self.base)), None

    def summary(self, events: list[tuple[str, float, Any]]) -> dict[str, Any]:
        """What a run of control events (in order, times never falling) makes of any state.

        Until its first event that sets the state whatever it was, a run starts a stopped line, connects it, or connects a
        waiting one if its time has come by the run's last CONNECTED till then. From there on only the number of lost
        connections counts: `after` holds the last state for each number.
        """
        lead = next((k for k, (kind, _, _) in enumerate(events) if kind not in ("START", "CONNECTED")), len(events))
        ends = [Line("STOPPED"), Line("CONNECTING")]
        for kind, at, payload in events[:lead]:
            ends = [self.step(x, kind, at, payload)[0] for x in ends]
        connected = [at for kind, at, _ in events[:lead] if kind == "CONNECTED"]
        after = None
        if lead < len(events):
            after = [Line("LIVE", tries) for tries in range(self.attempts + 2)]
            for kind, at, payload in events[lead:]:
                after = [self.step(x, kind, at, payload)[0] for x in after]
        return {"stopped": ends[0].state, "connecting": ends[1].state, "connected": max(connected, default=None), "after": after}

    def through(self, line: Line, run: dict[str, Any]) -> Line:
        """The state after a run, by its summary."""
        if line.state == "HALTED":
            return line
        if line.state in ("STOPPED", "CONNECTING"):
            state = run[line.state.lower()]
            line = Line("LIVE") if state == "LIVE" else line._replace(state=state)
        elif line.state != "LIVE" and run["connected"] is not None and line.retry <= run["connected"]:
            line = Line("LIVE")
        if run["after"] is None:
            return line
        end = Line(*run["after"][min(line.tries, self.attempts + 1)])
        # A halt by drift as the run's first such event leaves the wait as it was.
        return end._replace(retry=line.retry) if run["drifts"] else end


def _runs(connection: Connection, order: list[str]):
    """Control events of one part -> its summary."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([*order, "row"])
        events = [(r["kind"], r["at"], r["payload"]) for r in map(_clean, rows[["kind", "at", "payload"]].to_dict("records"))]
        s = connection.summary(events)
        lead = next((k for k, e in enumerate(events) if e[0] not in ("START", "CONNECTED")), None)
        after = s["after"] or []
        return pd.DataFrame({
            "provider": rows["provider"].iloc[:1].to_list(), "part": rows["part"].iloc[:1].to_list(), "stopped": [s["stopped"]], "connecting": [s["connecting"]], "connected": [s["connected"]],
            "drifts": [lead is not None and events[lead][0] in DRIFTS], "states": [[x.state for x in after]], "tries": [[x.tries for x in after]], "retries": [[x.retry for x in after]],
        })

    return run


_SUMMARY = "provider string, part int, stopped string, connecting string, connected double, drifts boolean, states array<string>, tries array<long>, retries array<double>"


def _carried(connection: Connection):
    """A provider's summaries, one a part -> the state that each part begins with."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        line, out = Line(), []
        for r in rows.sort_values("part").to_dict("records"):
            out.append({"provider": r["provider"], "part": r["part"], "state": line.state, "tries": line.tries, "retry": line.retry})
            after = [Line(s, int(t), None if x is None or x != x else float(x)) for s, t, x in zip(r["states"], r["tries"], r["retries"], strict=True)]
            connected = r["connected"]
            run_ = {"stopped": r["stopped"], "connecting": r["connecting"], "connected": None if connected is None or connected != connected else connected, "after": after or None, "drifts": r["drifts"]}
            line = connection.through(line, run_)
        return pd.DataFrame(out)

    return run


def _applied(connection: Connection, order: list[str]):
    """Control events of one part, from the state that it begins with -> each event's state after it, and what is wrong."""

    def run(rows: pd.DataFrame, begin: pd.DataFrame) -> pd.DataFrame:
        line = Line()
        if len(begin):
            b = _clean(begin.iloc[0].to_dict())
            line = Line(b["state"], int(b["tries"]), b["retry"])
        out = []
        for r in map(_clean, rows.sort_values([*order, "row"])[["row", "kind", "at", "payload"]].to_dict("records")):
            line, wrong = connection.step(line, r["kind"], r["at"], r["payload"])
            out.append((r["row"], line.state, line.tries, line.retry, wrong))
        return pd.DataFrame(out, columns=["row", "state", "tries", "retry", "wrong"])

    return run


def _first(rows: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """The row numbers of the first rows of each of the keys (nulls are a key too)."""
    return rows.groupBy(*keys).agg(F.min(F.struct(*order, "row")).alias("x")).select("x.row", F.lit(True).alias(name))


def collect(events: DataFrame, machine: Collector, order: list[str] | None = None, part_rows: int = PART_ROWS) -> DataFrame:
    """events (provider, event_id, seq, kind, at, schema_version, source_ts, payload, with an instrument instrument_id) -> one row each,
    as `machine` says them in the order of `order` (seq): provider, seq, state, accepted, reasons, watermark, next_retry_at, attempts.

    Rows that `order` doesn't tell apart go in an order of their own. A quote without source_ts isn't behind the watermark; null ids and
    fingerprints are values like any other; an empty table gives an empty result.
    """
    order = order or ["seq"]
    connection = Connection(machine.base, machine.most, machine.attempts)
    scan = Ordered(events.withColumn("row", F.monotonically_increasing_id()), ["provider"], [*order, "row"], part_rows)
    rows = scan.rows.join(_first(scan.rows, ["provider", "event_id"], order, "first_event"), "row", "left")
    rows = scan.running(rows, before={"clock": ("max", F.col("at"))})
    regress = F.coalesce(F.col("at") < F.col("clock"), F.lit(False))
    heard = F.col("first_event").isNotNull() & ~regress
    drift = F.coalesce(F.col("schema_version") != machine.schema, F.lit(True))
    kind = F.when(drift, "OTHER_SCHEMA").otherwise(F.col("kind"))
    rows = cut(rows.withColumns({"regress": regress, "heard": heard, "kind": F.when(heard, kind).otherwise(F.col("kind"))}))

    control = rows.where(F.col("heard") & F.col("kind").isin(*CONTROL)).select("provider", "part", *order, "row", "kind", "at", "payload")
    shape = "row long, state string, tries long, retry double, wrong string"
    if scan.split:
        control = cut(control)
        runs = control.groupBy("provider", "part").applyInPandas(_runs(connection, order), _SUMMARY)
        begin = cut(runs.groupBy("provider").applyInPandas(_carried(connection), "provider string, part int, state string, tries long, retry double"))
        lines = control.groupBy("provider", "part").cogroup(begin.groupBy("provider", "part")).applyInPandas(_applied(connection, order), shape)
    else:  # one part a provider, which begins stopped
        alone = _applied(connection, order)
        lines = control.groupBy("provider").applyInPandas(lambda own: alone(own, pd.DataFrame()), shape)
    lines = lines.select("row", F.struct("state", "tries", "retry").alias("line"), "wrong")

    rows = scan.running(rows.join(lines, "row", "left"), before={"was": ("last", F.col("line"))}, upto={"now": ("last", F.col("line"))})
    was, now = F.coalesce("was.state", F.lit("STOPPED")), F.coalesce("now.state", F.lit("STOPPED"))
    live = (was == "LIVE") & F.col("heard")
    is_ = lambda k: F.col("heard") & (F.col("kind") == k)
    fits = F.lit(True) if machine.instrument is None else F.col("instrument_id").eqNullSafe(F.lit(machine.instrument))
    rows = cut(rows.withColumns({"was": was, "live": live, "now_live": now == "LIVE", "fits": fits, "asked": is_("QUOTE") & live & fits}))
    rows = rows.join(_first(rows.where("asked"), ["provider", "payload"], order, "first_quote"), "row", "left")
    rows = scan.running(rows, before={"mark": ("max", F.when(F.col("first_quote"), F.col("source_ts")))})
    late = F.coalesce(F.col("source_ts") < F.col("mark"), F.lit(False))
    quoted = F.col("first_quote").isNotNull() & ~late
    dropped = is_("CONNECTION_LOST") | is_("RATE_LIMITED") | is_("STOP")
    last = F.when(quoted | (dropped & (F.col("was") != "HALTED")), F.struct(F.when(quoted, F.col("at")).alias("at")))
    rows = scan.running(rows.withColumns({"late": late, "quoted": quoted}), upto={"last": ("last", last)})
    age = F.col("at") - F.col("last.at")
    stale = F.col("now_live") & (F.col("last.at").isNull() | (age > machine.fresh))
    tone = F.when(stale, "DEGRADED").when(F.col("quoted") | (is_("CONNECTED") & F.col("now_live")), "STREAMING")
    rows = scan.running(rows.withColumn("stale", stale), before={"tone_was": ("last", tone)}, upto={"tone": ("last", tone)})
    return rows.select("provider", "seq", *_told(machine, is_))


def _told(machine: Collector, is_) -> Iterator[Column]:
    """The output's columns, of the scans' results."""
    now = F.coalesce("now.state", F.lit("STOPPED"))
    again = is_("CONNECTED") & F.col("live") & (F.col("tone_was") == "STREAMING")
    quote, halted, behind = is_("QUOTE"), F.col("was") == "HALTED", F.col("source_ts") < F.col("mark") - machine.lateness
    first = F.col("first_quote").isNotNull()
    rules = {
        "DUPLICATE_EVENT": F.col("first_event").isNull(), "EVENT_TIME_REGRESSION": F.col("regress"), "COLLECTOR_HALTED": F.col("heard") & halted & ~F.col("kind").isin(*CONTROL),
        "INVALID_TRANSITION": again | (is_("HEARTBEAT") & ~F.col("live") & ~halted), "COLLECTOR_NOT_STREAMING": quote & ~F.col("live") & ~halted, "INSTRUMENT_MISMATCH": quote & F.col("live") & ~F.col("fits"),
        "DUPLICATE_OBSERVATION": F.col("asked") & ~first, "OUT_OF_ORDER_OBSERVATION": first & F.col("late"), "BEHIND_WATERMARK": first & F.col("late") & behind,
    }
    why = F.array_compact(F.array(F.col("wrong"), *(F.when(c, F.lit(k)) for k, c in rules.items())))
    every = F.concat(why, F.when(F.col("stale"), F.array(F.lit("COLLECTOR_STALE"))).otherwise(F.array().cast("array<string>")))
    yield F.when(F.col("now_live"), F.col("tone")).otherwise(now).alias("state")
    yield (F.size(why) == 0).alias("accepted")
    yield F.array_join(F.array_sort(F.array_distinct(every)), ",").alias("reasons")
    yield F.greatest("mark", F.when(F.col("quoted"), F.col("source_ts"))).alias("watermark")
    yield F.col("now.retry").alias("next_retry_at")
    yield F.coalesce("now.tries", F.lit(0)).cast("long").alias("attempts")


def outbox(messages: DataFrame, cooldown: float = 300.0, order: list[str] | None = None, part_rows: int = PART_ROWS) -> DataFrame:
    """messages (dedupe_key, message_id, at) -> dedupe_key, message_id, outcome, as folds.outbox_step says it in the order of `order` (at, seq): DUPLICATE for a
    key's message that came before, SUPPRESSED within the cooldown of the key's latest other message (suppressed ones too), ENQUEUED. No state, and
    so nothing is forgotten; a key of any number of messages is dealt over tasks."""
    order = order or ["at", "seq"]
    scan = Ordered(messages.withColumn("row", F.monotonically_increasing_id()), ["dedupe_key"], [*order, "row"], part_rows)
    rows = scan.rows.join(_first(scan.rows, ["dedupe_key", "message_id"], order, "first_message"), "row", "left")
    fresh = F.col("first_message").isNotNull()
    rows = scan.running(rows, before={"latest": ("last", F.when(fresh, F.col("at")))})
    near = F.coalesce(F.col("at") - F.col("latest") < cooldown, F.lit(False))
    return rows.select("dedupe_key", "message_id", F.when(~fresh, "DUPLICATE").when(near, "SUPPRESSED").otherwise("ENQUEUED").alias("outcome"))


#: What a run tells of its events, however long ago.
LASTING = ("SCHEMA_DRIFT", "RECONNECT_BUDGET_EXHAUSTED", "INVALID_RETRY_AFTER")


def counting_quotes(events: DataFrame, told: DataFrame, seq: str = "seq") -> DataFrame:
    """Of events (provider, seq, source and more) the quotes that count for the feed's quality: of every source the latest accepted quote since the
    provider's connection was last lost, limited or stopped. told: what collect() says of the events."""
    rows = events.join(told.select("provider", seq, "accepted", F.split("reasons", ",").alias("__why")), ["provider", seq])
    heard = ~F.arrays_overlap("__why", F.array(*(F.lit(c) for c in ("DUPLICATE_EVENT", "EVENT_TIME_REGRESSION", "COLLECTOR_HALTED"))))
    cleared = rows.where(F.col("kind").isin(*quality.CLEARING) & heard).groupBy("provider").agg(F.max(seq).alias("__cleared"))
    quotes = rows.where((F.col("kind") == "QUOTE") & F.col("accepted")).join(cleared, "provider", "left")
    quotes = quotes.where(F.col("__cleared").isNull() | (F.col(seq) > F.col("__cleared")))
    return asof.latest_per_key(quotes, ["provider", "source"], [seq], [c for c in events.columns if c not in ("provider", "source")])


def run_report(
    events: DataFrame, told: DataFrame, capabilities: DataFrame, report: DataFrame | None = None, gate: Callable[[Column], Column] | None = None
) -> DataFrame:
    """One row a provider: state, sorted reasons, accepted_quotes, duplicate_events, duplicate_observations, out_of_order, watermark, next_retry_at.

    told: what collect() says of events (provider, seq, kind, at). capabilities: provider, configured, verification_status, production_ready, quality;
    a provider without a row fails closed. report: provider, status, reasons of the quotes that count (quality.evaluate_quotes), NO_QUALITY_REPORT
    without a row. gate: the session's reasons at an instant, asked for the last event's. A run without reasons may be decided upon.
    """
    rows = told.join(events.select("provider", "seq", "kind", "at"), ["provider", "seq"])
    why = F.split("reasons", ",")
    has = lambda code: F.count_if(F.array_contains(why, code))
    lasting = F.array_compact(F.array(*(F.when(has(code) > 0, F.lit(code)) for code in LASTING)))
    last = F.max_by(F.struct("state", "watermark", "next_retry_at", "at"), "seq").alias("last")
    runs = rows.groupBy("provider").agg(
        last, lasting.alias("lasting"), F.count_if(F.col("accepted") & (F.col("kind") == "QUOTE")).alias("accepted_quotes"), has("DUPLICATE_EVENT").alias("duplicate_events"),
        has("DUPLICATE_OBSERVATION").alias("duplicate_observations"), has("OUT_OF_ORDER_OBSERVATION").alias("out_of_order"),
    )
    able = capabilities.select("provider", quality.capability_reasons().alias("able"))
    runs = runs.join(able, "provider", "left").withColumn("able", F.coalesce("able", F.array(*(F.lit(c) for c in quality.CAPABILITY_CODES))))
    none = F.array().cast("array<string>")
    if report is None:
        good = F.array(F.lit("NO_QUALITY_REPORT"))
    else:
        runs = runs.join(report.select("provider", F.col("status").alias("__status"), F.col("reasons").alias("__reasons")), "provider", "left")
        fails = F.when(F.size("__reasons") > 0, F.col("__reasons")).otherwise(F.array(F.lit("QUALITY_NOT_GREEN")))
        good = F.when(F.col("__status").isNull(), F.array(F.lit("NO_QUALITY_REPORT"))).when(F.col("__status") == "GREEN", none).otherwise(fails)
    state = F.when(F.col("last.state") != "STREAMING", F.array(F.concat(F.lit("COLLECTOR_"), F.col("last.state")))).otherwise(none)
    closed = none if gate is None else F.coalesce(gate(F.timestamp_micros((F.col("last.at") * 1e6).cast("long"))), none)
    every = F.array_sort(F.array_distinct(F.concat("able", "lasting", state, closed, good)))
    counts = ["accepted_quotes", "duplicate_events", "duplicate_observations", "out_of_order"]
    return runs.select("provider", F.col("last.state").alias("state"), every.alias("reasons"), *counts, F.col("last.watermark").alias("watermark"), F.col("last.next_retry_at").alias("next_retry_at"))


def event_records(events: DataFrame, content: list[str], provider_version: str) -> DataFrame:
    """Every event (provider, event_id, kind, at, published_at, schema_version) as a point-in-time record of its content (event_id, kind and the columns
    of `content`), which must have been published before it was seen."""
    seen = F.timestamp_micros((F.col("at") * 1e6).cast("long"))
    rows = events.withColumns({"logical_key": F.concat_ws(":", F.lit("collector-event"), "provider", "event_id"), "first_seen_at": seen, "provider_version": F.lit(provider_version)})
    return records.records(rows, ["event_id", "kind", *content])


def output_records(events: DataFrame, told: DataFrame, author: str, author_version: str = "collector-v1") -> DataFrame:
    """What the collector says of every event as a point-in-time record of `author`, seen with the event."""
    rows = told.join(events.select("provider", "seq", "event_id", "at"), ["provider", "seq"])
    instant = lambda c: F.timestamp_micros((F.col(c) * 1e6).cast("long"))
    why = F.when(F.col("reasons") == "", F.array().cast("array<string>")).otherwise(F.split("reasons", ","))
    rows = rows.withColumns({
        "logical_key": F.concat_ws(":", F.lit("collector-output"), "provider", "event_id"), "published_at": instant("at"), "first_seen_at": instant("at"), "provider": F.lit(author), "provider_version": F.lit(author_version),
        "schema_version": F.lit("collector-output-v1"), "reasons": why, "watermark": instant("watermark"), "next_retry_at": instant("next_retry_at"), "reconnect_attempts": F.col("attempts"),
    })
    return records.records(rows, ["event_id", "state", "accepted", "reasons", "watermark", "next_retry_at", "reconnect_attempts"])
