"""The collector in scans against the machine row by row, on random feeds."""

import datetime as dt
import random

import pytest

from tidemark.sources import records
from tidemark.streaming import feeds, folds

SCHEMA = "provider string, event_id string, seq long, kind string, at double, schema_version string, source_ts double, payload string, instrument_id string"


def random_feed(rng, provider, n, halting):
    rows, at = [], 0.0
    kinds = ["QUOTE"] * 8 + ["HEARTBEAT", "CONNECTED", "CONNECTED", "START"] + ["CONNECTION_LOST", "RATE_LIMITED", "STOP"][: rng.choice([1, 2, 3])]
    for i in range(n):
        at += rng.choice([0.0, 0.1, 0.5, 2.0, 7.0]) - rng.choice([0.0] * 9 + [1.0])
        kind = rng.choice(kinds) if i > 2 else ["START", "CONNECTED", "QUOTE"][i]
        if halting and rng.random() < 0.01:
            kind = "SCHEMA_DRIFT"
        payload = rng.choice(["3", "0.5", "8", "bad" if halting else "1"]) if kind == "RATE_LIMITED" else f"q{rng.randrange(n)}"
        version = "v2" if halting and rng.random() < 0.005 else "v1"
        rows.append((provider, f"e{i if rng.random() < 0.9 else rng.randrange(n)}", i, kind, at, version, at - rng.choice([0.0, 0.1, 0.4, 3.0]), payload, rng.choice(["I"] * 6 + ["J", None])))
    return rows


def by_hand(rows, machine):
    out, states = [], {}
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    for row in sorted(rows, key=lambda r: (r[0], r[2])):
        state, found = machine(states.get(row[0], {}), dict(zip(names, row, strict=True)))
        states[row[0]] = state
        out.append(found)
    return out


def told(rows):
    return sorted((r["provider"], r["seq"], r["state"], r["accepted"], r["reasons"], r["watermark"], r["next_retry_at"], r["attempts"]) for r in rows)


@pytest.mark.parametrize(("seed", "part_rows"), [(1, 1 << 20), (2, 17), (3, 40), (4, 5)])
def test_equals_the_machine(spark, seed, part_rows):
    rng = random.Random(seed)
    rows = [r for p, n in (("hot", 400), ("mild", 60), ("one", 1)) for r in random_feed(rng, p, n, halting=False)]
    rows += [r for k in range(6) for r in random_feed(rng, f"halt{k}", 60, halting=True)]
    shuffled = rng.sample(rows, len(rows))
    machine = folds.Collector(instrument=rng.choice([None, "I"]), attempts=rng.choice([1, 3]), fresh=rng.choice([1.0, 5.0]))
    got = feeds.collect(spark.createDataFrame(shuffled, SCHEMA).repartition(4), machine, part_rows=part_rows).collect()
    assert told([r.asDict() for r in got]) == told(by_hand(rows, machine))


def test_runs_compose():
    """A run's summary makes of any state what its events make of it one by one."""
    rng = random.Random(11)
    connection = feeds.Connection(1.0, 4.0, 3)
    for _ in range(3000):
        at, events = 10.0, []
        for _ in range(rng.randrange(7)):
            at += rng.choice([0.0, 0.5, 2.0])
            events.append((rng.choice(["START", "CONNECTED", "CONNECTED", "CONNECTION_LOST", "RATE_LIMITED", "STOP", *feeds.DRIFTS]), at, rng.choice(["1", "0.5", "x"])))
        summary = connection.summary(events)
        lead = next((k for k, e in enumerate(events) if e[0] not in ("START", "CONNECTED")), None)
        summary["drifts"] = lead is not None and events[lead][0] in feeds.DRIFTS
        begin = rng.choice([feeds.Line(s, t) for s in ("STOPPED", "CONNECTING") for t in range(4)] + [feeds.Line("LIVE"), feeds.Line("HALTED", 2, 12.0)] + [feeds.Line(s, t, r) for s in ("BACKING_OFF", "RATE_LIMITED") for t in (1, 3) for r in (9.0, 11.0, 13.0, 99.0)])
        line = begin
        for e in events:
            line, _ = connection.step(line, *e)
        assert connection.through(begin, summary) == line, (begin, events)


@pytest.mark.parametrize("part_rows", [1 << 20, 13])
def test_outbox_equals_the_machine(spark, part_rows):
    rng = random.Random(part_rows)
    rows = [(rng.choice(["hot"] * 5 + ["k", None]), f"m{rng.randrange(150)}", i, float(rng.randrange(4000))) for i in range(300)]
    step, states, want = folds.outbox_step(cooldown=40.0), {}, []
    for key, message, seq, at in sorted(rows, key=lambda r: (str(r[0]), r[3], r[2])):
        states[key], found = step(states.get(key, {}), {"dedupe_key": key, "message_id": message, "at": at})
        want.append((str(key), message, found["outcome"]))
    got = feeds.outbox(spark.createDataFrame(rows, "dedupe_key string, message_id string, seq int, at double"), cooldown=40.0, part_rows=part_rows).collect()
    assert sorted((str(r.dedupe_key), r.message_id, r.outcome) for r in got) == sorted(want) and len({o for _, _, o in want}) == 3


def test_a_duplicate_is_refused_at_any_age(spark):
    day = 86400.0
    rows = [("p", "a", 1, "START", 0.0, "v1", 0.0, "", None), ("p", "b", 2, "CONNECTED", 1.0, "v1", 0.0, "", None), ("p", "c", 3, "QUOTE", 2.0, "v1", 2.0, "q", None), ("p", "c", 4, "QUOTE", 8 * day, "v1", 8 * day, "r", None), ("p", "d", 5, "QUOTE", 400 * day, "v1", 400 * day, "q", None)]
    got = feeds.collect(spark.createDataFrame(rows, SCHEMA), folds.Collector()).orderBy("seq").collect()
    assert [r.reasons for r in got[2:]] == ["", "COLLECTOR_STALE,DUPLICATE_EVENT", "COLLECTOR_STALE,DUPLICATE_OBSERVATION"]
    assert feeds.collect(spark.createDataFrame([], SCHEMA), folds.Collector()).collect() == []


def test_report_of_a_run(spark):
    from pyspark.sql import functions as F

    names = "provider string, event_id string, seq long, kind string, at double, schema_version string, source_ts double, payload string, source string, published_at timestamp"
    t = 1_700_000_000.0
    rows = [(p, f"{p}{i}", i, k, t + i, "v1" if not (p == "bad" and i == 3) else "v2", t + i - (2.0 if (p, i) == ("good", 5) else 0), f"q{i}", s) for p in ("good", "bad") for i, (k, s) in enumerate([("START", None), ("CONNECTED", None), ("QUOTE", "x"), ("QUOTE", "y"), ("QUOTE", "x"), ("QUOTE", "x")])]
    rows += [("lost", "l0", 0, "START", t, "v1", t, "", None), ("lost", "l1", 1, "CONNECTED", t, "v1", t, "", None), ("lost", "l2", 2, "QUOTE", t, "v1", t, "q", "x"), ("lost", "l3", 3, "CONNECTION_LOST", t + 1, "v1", t, "", None), ("lost", "l3", 4, "QUOTE", t + 2, "v1", t, "q", "x")]
    events = spark.createDataFrame([(*r, None) for r in rows], names).withColumn("published_at", F.timestamp_micros((F.col("at") * 1e6).cast("long")))
    told = feeds.collect(events, folds.Collector())
    quotes = feeds.counting_quotes(events, told)
    assert {(r.provider, r.source): r.seq for r in quotes.collect()} == {("good", "x"): 4, ("good", "y"): 3, ("bad", "x"): 2}
    able = spark.createDataFrame([("good", True, "VERIFIED", True, "GREEN"), ("bad", True, "VERIFIED", False, "GREEN")], "provider string, configured boolean, verification_status string, production_ready boolean, quality string")
    report = spark.createDataFrame([("good", "GREEN", []), ("bad", "RED", ["STALE"])], "provider string, status string, reasons array<string>")
    gate = lambda at: F.when(F.unix_seconds(at) >= int(t) + 5, F.array(F.lit("SESSION_CLOSED")))
    got = {r.provider: r for r in feeds.run_report(events, told, able, report).collect()}
    assert (got["good"].state, got["good"].reasons, got["good"].accepted_quotes, got["good"].out_of_order) == ("STREAMING", [], 3, 1)
    assert got["bad"].reasons == ["CAPABILITY_NOT_PRODUCTION_READY", "COLLECTOR_HALTED", "SCHEMA_DRIFT", "STALE"]
    assert got["lost"].reasons == ["CAPABILITY_NOT_CONFIGURED", "CAPABILITY_NOT_PRODUCTION_READY", "CAPABILITY_QUALITY_NOT_GREEN", "CAPABILITY_UNVERIFIED", "COLLECTOR_BACKING_OFF", "NO_QUALITY_REPORT"]
    assert (got["lost"].duplicate_events, got["lost"].accepted_quotes) == (1, 1)
    closed = {r.provider: r.reasons for r in feeds.run_report(events, told, able, report, gate).collect()}
    assert closed["good"] == ["SESSION_CLOSED"] and "SESSION_CLOSED" not in closed["lost"]
    distinct = events.where("NOT (provider = 'lost' AND seq = 4)")
    inputs, outputs = feeds.event_records(distinct, ["payload"], "v1"), feeds.output_records(distinct, told, "tidemark")
    for found in (inputs, outputs):
        assert found.count() == 16 and records.record_faults(found).where("size(faults) > 0").count() == 0
    one = outputs.where("logical_key = 'collector-output:good:good5'").first()
    assert '"reasons":["BEHIND_WATERMARK","OUT_OF_ORDER_OBSERVATION"]' in one.canonical_content and one.provider == "tidemark"


def test_tasks_are_what_their_reviews_make_of_them(spark, tmp_path):
    from tidemark.sources.attribution_log import REVIEWS, TASKS, AttributionLog
    from tidemark.sources.sinks import Conflict

    log, at = AttributionLog(spark, str(tmp_path / "a")), dt.datetime(2026, 8, 17)
    assert log.tasks().collect() == []
    task = lambda i, s, keep=False: (f"t{i}", s, at + dt.timedelta(hours=i), "PENDING", keep)
    assert log.add_tasks(spark.createDataFrame([task(1, "s1"), task(2, "s2", True)], TASKS)).count() == 2
    assert [r.task_id for r in log.add_tasks(spark.createDataFrame([task(9, "s1")], TASKS)).collect()] == ["t1"]  # one task a signal
    review = lambda i, t, status, keep, h: (f"r{i}", t, at + dt.timedelta(days=1, hours=h), status, keep, "x")
    assert log.add_reviews(spark.createDataFrame([review(1, "t1", "ACCEPTED", True, 2), review(2, "t1", "REJECTED", False, 3), review(3, "t2", "ACCEPTED", None, 0)], REVIEWS)) == 3
    assert {r.task_id: (r.review_status, r.retained) for r in log.tasks().collect()} == {"t1": ("REJECTED", True), "t2": ("ACCEPTED", True)}
    assert log.add_reviews(spark.createDataFrame([review(1, "t1", "ACCEPTED", True, 2)], REVIEWS)) == 0
    with pytest.raises(Conflict):
        log.add_reviews(spark.createDataFrame([review(1, "t1", "REJECTED", True, 2)], REVIEWS))
    with pytest.raises(Exception, match="unknown attribution task"):
        log.add_reviews(spark.createDataFrame([review(4, "t7", "ACCEPTED", True, 2)], REVIEWS))
    assert [r.task_id for r in log.latest(1).collect()] == ["t2"]
