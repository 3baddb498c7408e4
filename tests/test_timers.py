"""Stream machines with timers: what fires without a further event, what doesn't, and restarts."""

import json
import os

import pytest

from tidemark.operators.delivery import ChannelPolicy
from tidemark.streaming import folds, timers

FEED = "provider string, event_id string, seq long, kind string, at double, schema_version string, source_ts double, payload string, instrument_id string"
T0 = 1_700_000_000.0


def play(spark, tmp_path, schema, batches, build, name, stop_after=None):
    """Runs batches one by one, stopping and starting the query anew after each if so asked -> all rows."""
    source = tmp_path / f"{name}-in"
    source.mkdir()
    out = str(tmp_path / f"{name}-out")

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source))
        query = build(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / f"{name}-cp")).trigger(availableNow=True).start()
        query.awaitTermination(240)
        assert query.exception() is None

    for k, rows in enumerate(batches):
        (source / f"{k}.json").write_text("\n".join(json.dumps(r) for r in rows))
        os.utime(source / f"{k}.json", (T0 + k, T0 + k))
        if stop_after and (k + 1) % stop_after == 0:
            run()
    run()
    return spark.read.parquet(out)


def feed(provider, seq, kind, at, payload=None, event_id=None):
    return {"provider": provider, "event_id": event_id or f"{provider}{seq}", "seq": seq, "kind": kind, "at": T0 + at, "schema_version": "v1", "source_ts": T0 + at, "payload": payload or f"q{seq}", "instrument_id": None}


FEED_BATCHES = [
    [feed("a", 1, "START", 0), feed("a", 2, "CONNECTED", 1), feed("a", 3, "QUOTE", 2), feed("b", 1, "START", 0)],
    [feed("b", 2, "CONNECTED", 6), feed("b", 3, "QUOTE", 7.5)],  # a says nothing more; time goes on
    [feed("b", 4, "QUOTE", 9, payload="q3"), feed("b", 5, "QUOTE", 9.5)],
    [feed("b", 6, "HEARTBEAT", 20)],
    [feed("a", 4, "QUOTE", 21, event_id="a3"), feed("a", 5, "QUOTE", 22), feed("b", 7, "STOP", 23)],
    [feed("c", 1, "START", 60)],
    [feed("c", 2, "STOP", 61)],
]


@pytest.mark.parametrize("stop_after", [None, 1])
def test_feeds_go_stale_by_themselves(spark, tmp_path, stop_after):
    machine = folds.Collector(fresh=5.0)
    got = play(spark, tmp_path, FEED, FEED_BATCHES, lambda s: timers.watched_feed(s, machine), "feed", stop_after)
    rows = sorted(((r.provider, r.at - T0, r.seq or 0, r.state, r.reasons) for r in got.collect()))
    stale = [(p, round(at, 3), state, why) for p, at, seq, state, why in rows if not seq]
    assert stale == [("a", 7.001, "DEGRADED", "COLLECTOR_STALE"), ("a", 27.001, "DEGRADED", "COLLECTOR_STALE")]  # of b, its heartbeat says so
    own = {(p, seq): (state, why) for p, _, seq, state, why in rows if seq}
    assert own["a", 3] == ("STREAMING", "") and own["b", 4] == ("STREAMING", "DUPLICATE_OBSERVATION") and own["b", 5] == ("STREAMING", "")
    assert own["b", 6] == ("DEGRADED", "COLLECTOR_STALE")
    assert own["a", 4] == ("DEGRADED", "COLLECTOR_STALE,DUPLICATE_EVENT") and own["a", 5] == ("STREAMING", "")
    assert own["b", 7] == ("STOPPED", "") and len(own) == sum(map(len, FEED_BATCHES))


def delivery(m, seq, kind, at, due=None):
    return {"message_id": m, "seq": seq, "kind": kind, "recorded_at": T0 + at, "ack_due_at": None if due is None else T0 + due}


def test_overdue_acknowledgements_escalate(spark, tmp_path):
    schema = "message_id string, seq long, kind string, recorded_at double, ack_due_at double"
    batches = [
        [delivery("m", 1, "ENQUEUED", 0), delivery("m", 2, "ATTEMPTED", 1), delivery("m", 3, "DELIVERED", 1, 11), delivery("n", 1, "ATTEMPTED", 1), delivery("n", 2, "DELIVERED", 1, 11)],
        [delivery("n", 3, "ACKNOWLEDGED", 5)],
        [delivery("x", 1, "ENQUEUED", 30)],
        [delivery("m", 4, "ATTEMPTED", 31), delivery("m", 5, "DELIVERED", 31)],  # due by the policy: 41
        [delivery("x", 2, "ENQUEUED", 60)],
        [delivery("x", 3, "ENQUEUED", 90)],
    ]
    policy = ChannelPolicy(ack_timeout=10.0, max_escalations=1)
    got = play(spark, tmp_path, schema, batches, lambda s: timers.watched_deliveries(s, policy), "delivery", 1)
    rows = sorted(((r.message_id, r.recorded_at - T0, r.kind, r.escalation_level, r.attempt_number, r.reason_code) for r in got.collect()), key=str)
    assert rows == [("m", 11.0, "ESCALATED", 1, None, "ACK_TIMEOUT"), ("m", 11.0, "RETRY_SCHEDULED", 1, 2, "ACK_ESCALATION"), ("m", 41.0, "DEAD_LETTERED", 1, None, "ACK_TIMEOUT")]


def test_alerts_that_nobody_takes(spark, tmp_path):
    def row(a, seq, at, priority="P0", status="OPEN"):
        return {"alert_id": a, "seq": seq, "at": T0 + at, "priority": priority, "status": status, "escalation_level": 0}

    batches = [[row("a", 1, 0), row("b", 1, 0), row("c", 1, 0, "P1"), row("d", 1, 5)], [row("b", 2, 10, status="ACCEPTED")], [row("z", 1, 40, "P2")], [row("z", 2, 50, "P2"), row("a", 2, 51)], [row("z", 3, 99, "P2")]]
    schema = "alert_id string, seq long, at double, priority string, status string, escalation_level long"
    got = play(spark, tmp_path, schema, batches, lambda s: timers.watched_alerts(s, 30.0), "alerts")
    assert sorted((r.alert_id, r.at - T0, r.escalation_level, r.reason) for r in got.collect()) == [("a", 30.0, 1, "NO_FEEDBACK"), ("d", 35.0, 1, "NO_FEEDBACK")]


def test_modes(spark):
    stream = spark.readStream.format("rate").load()
    with pytest.raises(ValueError, match="keep_ms"):
        timers.watched_feed(stream, folds.Collector(), keep_ms=1000)
    with pytest.raises(ValueError, match="mode is one of"):
        timers.watched_alerts(stream, 1.0, mode="Never")
