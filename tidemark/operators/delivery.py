"""Delivery of alerts as an event-sourced table: what is due, attempted, acknowledged, escalated, projected.

events: message_id, seq, kind, recorded_at, next_attempt_at, ack_due_at, escalation_level; times are in seconds (double). Each
step reads the events so far and returns the events to append, so that a run can be repeated and a lost one resumed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import backoff_seconds, content_id

TERMINAL = ("SUPPRESSED", "DELIVERY_DISABLED", "DEAD_LETTERED", "ACKNOWLEDGED")
_EVENT = ("message_id", "kind", "recorded_at", "next_attempt_at", "ack_due_at", "escalation_level", "attempt_number", "reason_code")


@dataclass(frozen=True)
class ChannelPolicy:
    """Seconds, tries and levels of one channel."""

    base: float = 1.0
    most: float = 60.0
    max_attempts: int = 3
    require_ack: bool = True
    ack_timeout: float = 60.0
    max_escalations: int = 2
    enabled: bool = True

    def __post_init__(self) -> None:
        if self.base <= 0 or self.most < self.base or self.max_attempts <= 0 or self.ack_timeout < 0 or self.max_escalations < 0:
            raise ValueError("delays, tries and levels must be positive")


def message_state(events: DataFrame) -> DataFrame:
    """The fold of each message's events: its last event, whether it has ended, its last delivery, and how far it has got."""
    last = F.max_by(F.struct("kind", "recorded_at", "next_attempt_at"), "seq")
    is_ = lambda k: F.col("kind") == k
    found = events.groupBy("message_id").agg(
        last.alias("last"), F.bool_or(F.col("kind").isin(*TERMINAL)).alias("ended"), F.bool_or(is_("ACKNOWLEDGED")).alias("acknowledged"), F.bool_or(is_("DEAD_LETTERED")).alias("dead"),
        F.max_by(F.when(is_("DELIVERED"), F.struct("recorded_at", "ack_due_at")), F.when(is_("DELIVERED"), F.col("seq"))).alias("delivery"),
        F.count_if(is_("ESCALATED")).alias("level"), F.count_if(is_("ATTEMPTED")).alias("attempts"), F.max("seq").alias("last_seq"),
    )
    return found.select("message_id", "ended", "acknowledged", "dead", "level", "attempts", "last_seq", "last.*", F.col("delivery.recorded_at").alias("delivered_at"), F.col("delivery.ack_due_at").alias("ack_due_at"))


def is_due(now: Column) -> Column:
    """Over message_state: enqueued, or scheduled for a retry, by now, and not ended."""
    enqueued = (F.col("kind") == "ENQUEUED") & (F.col("recorded_at") <= now)
    retry = (F.col("kind") == "RETRY_SCHEDULED") & (F.col("next_attempt_at") <= now)
    return ~F.col("ended") & F.coalesce(enqueued | retry, F.lit(False))


def _events(rows: DataFrame, **given: Column) -> DataFrame:
    types = {"message_id": "string", "kind": "string", "reason_code": "string", "escalation_level": "long", "attempt_number": "long"}
    return rows.select(*(given.get(c, F.col(c) if c == "message_id" else F.lit(None)).cast(types.get(c, "double")).alias(c) for c in _EVENT))


def dispatched(state: DataFrame, outcomes: DataFrame, now: Column, policy: ChannelPolicy) -> DataFrame:
    """The event that follows each due message's attempt. outcomes: message_id, outcome SENT, TRANSIENT_FAILURE or
    PERMANENT_FAILURE, reason. A channel that isn't enabled delivers nothing; a missing outcome is a transient failure."""
    rows = state.where(is_due(now)).join(outcomes, "message_id", "left")
    attempt = F.col("attempts") + 1
    outcome = F.coalesce("outcome", F.lit("TRANSIENT_FAILURE")) if policy.enabled else F.lit("DISABLED")
    spent = (outcome == "TRANSIENT_FAILURE") & (attempt >= policy.max_attempts)
    retry = (outcome == "TRANSIENT_FAILURE") & ~spent
    kind = F.when(outcome == "SENT", "DELIVERED").when(spent | (outcome == "PERMANENT_FAILURE"), "DEAD_LETTERED").when(retry, "RETRY_SCHEDULED").otherwise("DELIVERY_DISABLED")
    why = F.when(outcome == "SENT", F.lit(None)).when(spent, F.lit("RETRY_BUDGET_EXHAUSTED")).when(outcome == "DISABLED", F.lit("CHANNEL_NOT_OPTED_IN")).otherwise(F.coalesce("reason", outcome))
    due = F.when((outcome == "SENT") & F.lit(policy.require_ack), now + policy.ack_timeout)
    return _events(
        rows, kind=kind, recorded_at=now, ack_due_at=due, reason_code=why, attempt_number=F.when(retry, attempt + 1).otherwise(attempt),
        next_attempt_at=F.when(retry, now + backoff_seconds(attempt, policy.base, policy.most)),
    )


def acknowledgements(state: DataFrame, requests: DataFrame) -> DataFrame:
    """Each request (message_id, actor, at) with what comes of it: ACKNOWLEDGED once (the first by time), then a repetition of
    it; refused before the delivery, without one, without an actor, or for an unknown message."""
    rows = requests.join(state.select("message_id", "acknowledged", "delivered_at"), "message_id", "left")
    first = F.min(F.struct("at", "actor")).over(_by_message()) == F.struct("at", "actor")
    blank = F.coalesce(F.trim("actor"), F.lit("")) == ""
    refusal = F.when(blank, "NO_ACTOR").when(F.col("acknowledged").isNull(), "UNKNOWN_MESSAGE").when(F.col("delivered_at").isNull(), "NOT_DELIVERED").when(F.col("at") < F.col("delivered_at"), "BEFORE_DELIVERY")
    rows = rows.withColumn("refusal", refusal)
    good = rows.where("refusal IS NULL")
    good = good.withColumn("outcome", F.when(F.col("acknowledged") | ~first, "REPEATED").otherwise("ACKNOWLEDGED"))
    return good.select("message_id", "actor", "at", "outcome").unionByName(rows.where("refusal IS NOT NULL").select("message_id", "actor", "at", F.col("refusal").alias("outcome")))


def _by_message():
    from pyspark.sql import Window

    return Window.partitionBy("message_id")


def escalations(state: DataFrame, now: Column, policy: ChannelPolicy) -> DataFrame:
    """Events of delivered messages whose acknowledgement is overdue: ESCALATED with a retry at once, up to max_escalations
    levels, then DEAD_LETTERED. An escalation that still waits for its dispatch takes no further level."""
    overdue = ~F.col("acknowledged") & (F.col("kind") == "DELIVERED") & (F.col("ack_due_at") <= now)
    rows = state.where(F.coalesce(overdue, F.lit(False)) & F.lit(policy.require_ack))
    more = rows.where(F.col("level") < policy.max_escalations)
    level = F.col("level") + 1
    up = _events(more, kind=F.lit("ESCALATED"), recorded_at=now, escalation_level=level, reason_code=F.lit("ACK_TIMEOUT"))
    retry = _events(more, kind=F.lit("RETRY_SCHEDULED"), recorded_at=now, next_attempt_at=now, escalation_level=level, attempt_number=F.col("attempts") + 1, reason_code=F.lit("ACK_ESCALATION"))
    ended = rows.where((F.col("level") >= policy.max_escalations) & ~F.col("dead"))
    dead = _events(ended, kind=F.lit("DEAD_LETTERED"), recorded_at=now, escalation_level=F.col("level"), reason_code=F.lit("ACK_TIMEOUT"))
    return up.unionByName(retry).unionByName(dead)


def due_escalations(alerts: DataFrame, now: Column, after: float) -> DataFrame:
    """Open alerts of the highest priority that have waited `after` seconds or more, one level up."""
    due = (F.col("priority") == "P0") & (F.col("status") == "OPEN") & (now - F.col("created_at") >= after)
    return alerts.where(due).withColumn("escalation_level", F.col("escalation_level") + 1)


def projection(alerts: DataFrame, columns: list[str], known: DataFrame | None = None) -> DataFrame:
    """The alert states that a stream has not shown yet, by the hash of their content: (projection_key, columns)."""
    rows = alerts.withColumn("projection_key", content_id(*columns)).select("projection_key", *columns).dropDuplicates(["projection_key"])
    return rows if known is None else rows.join(known.select("projection_key"), "projection_key", "left_anti")


def cursor_fault(cursor: Column, last: Column) -> Column:
    """Why a resume position (a string) can't be one: null if it is canonical digits, however many, up to the last sequence, or absent."""
    digits, end = cursor.rlike("^(0|[1-9][0-9]*)$"), last.cast("string")
    beyond = (F.length(cursor) > F.length(end)) | ((F.length(cursor) == F.length(end)) & (cursor > end))
    return F.when(cursor.isNull(), F.lit(None).cast("string")).when(~digits, "NOT_CANONICAL").when(beyond, "BEYOND_END")
