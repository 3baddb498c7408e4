"""Appended governance events, and runs of ingest plans, against hand-made sequences."""

import datetime as dt
import threading

import pytest
from pyspark.sql import functions as F

from tidemark.sources import ingest, ledgers, records
from tidemark.sources.governance_log import VERSIONS, GovernanceLog
from tidemark.sources.log import Log

T = dt.datetime(2026, 8, 17, 12)
APPROVALS = "approval_id string, action string, model_id string, source_version string, target_version string, evidence_hash string, approved_at timestamp"


def versions(spark, rows):
    return spark.createDataFrame([(m, v, p, h, T + dt.timedelta(hours=k)) for k, (m, v, p, h) in enumerate(rows)], VERSIONS)


def approvals(spark, rows):
    return spark.createDataFrame([(i, a, m, s, t, e, T + dt.timedelta(days=1, minutes=k)) for k, (i, a, m, s, t, e) in enumerate(rows)], APPROVALS)


def outcomes(df):
    return {r.approval_id: r.reasons for r in df.collect()}


def test_champions_come_from_appended_events(spark, tmp_path):
    log = GovernanceLog(spark, str(tmp_path / "g"))
    assert log.champions().collect() == [] and log.champion_of(spark.createDataFrame([("m", "s")], "model_id string, session_id string")).first().version is None
    told = log.register(versions(spark, [("m", "1", None, "h1"), ("m", "2", "1", "h2"), ("m", "3", "9", "h3"), ("n", "1", None, None)]))
    assert {(r.model_id, r.version): r.fault for r in told.collect()} == {("m", "1"): None, ("m", "2"): None, ("m", "3"): "UNKNOWN_PARENT", ("n", "1"): None}
    assert [r.fault for r in log.register(versions(spark, [("m", "2", "1", "other")])).collect()] == ["ALREADY_REGISTERED"]
    # One batch: the second promotion is judged by the champion that the first makes.
    got = outcomes(log.apply(approvals(spark, [("a1", "PROMOTE", "m", None, "1", "h1"), ("a2", "PROMOTE", "m", "1", "2", "h2"), ("b1", "PROMOTE", "n", None, "1", "h"), ("a3", "PROMOTE", "m", "1", "2", "h2")])))
    assert got["a1"] == got["a2"] == [] and got["b1"] == ["NO_VALIDATION_REPORT"] and "SOURCE_IS_NOT_THE_CHAMPION" in got["a3"]
    assert [(r.model_id, r.version) for r in log.champions().collect()] == [("m", "2")]
    sessions = spark.createDataFrame([("m", "s1"), ("m", " "), ("n", "s1")], "model_id string, session_id string")
    assert {(r.model_id, r.session_id): (r.version, r.fault) for r in log.freeze(sessions).collect()} == {("m", "s1"): ("2", None), ("m", " "): (None, "BLANK_SESSION"), ("n", "s1"): (None, "NO_CHAMPION")}
    assert outcomes(log.apply(approvals(spark, [("r1", "ROLLBACK", "m", "2", "1", "x"), ("a1", "ROLLBACK", "m", "1", "2", "x"), ("r2", "ROLLBACK", "m", "1", "1", "x")]))) == {"r1": [], "a1": ["APPROVAL_USED"], "r2": ["ALREADY_THE_CHAMPION"]}
    log.freeze(sessions.where("session_id = 's1'"))  # stays with what it has
    asked = spark.createDataFrame([("m", "s1"), ("m", "s2"), ("m", None)], "model_id string, session_id string")
    assert {r.session_id: (r.version, r.frozen) for r in log.champion_of(asked).collect()} == {"s1": ("2", True), "s2": ("1", False), None: ("1", False)}
    assert [(r.seq, r.approval_id) for r in log.events().orderBy("seq").collect()] == [(1, "a1"), (2, "a2"), (3, "r1")]


def test_approvals_at_once_are_judged_one_after_the_other(spark, tmp_path):
    path = str(tmp_path / "g")
    GovernanceLog(spark, path).register(versions(spark, [("m", str(k), None, f"h{k}") for k in range(4)]))
    told = []
    threads = [threading.Thread(target=lambda k=k: told.append(outcomes(GovernanceLog(spark, path).apply(approvals(spark, [(f"a{k}", "PROMOTE", "m", None, str(k), f"h{k}")]))))) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sum(why == [] for x in told for why in x.values()) == 1 and len(told) == 4
    assert GovernanceLog(spark, path).events().count() == 1


def plan(spark, rows):
    return spark.createDataFrame([(f"D/s/x/{day}", "D", "s", "x", dt.date.fromisoformat(day), o, c) for day, o, c in rows], "logical_key string, dataset string, schema string, scope string, day date, outcome string, cost double")


def test_runs_of_a_plan(spark, tmp_path):
    path, key, now = str(tmp_path / "i"), F.lit(b"0123456789abcdef"), dt.datetime(2026, 8, 18, 3, 59, 59)
    items = plan(spark, [("2026-08-14", "PLANNED", 1.5), ("2026-08-17", "PLANNED", 2.0), ("2026-08-18", "PLANNED", 1.0), ("2026-08-13", "EMPTY_CHAIN", 0.5), ("2026-08-12", "PLANNED", 1.0), ("2026-08-11", "PLANNED", 1.0)])
    asked = []

    def download(pulls):
        asked.append(sorted(str(r.day) for r in pulls.collect()))
        fails = F.col("day") == F.lit("2026-08-12").cast("date")
        answered = pulls.where("day <> DATE'2026-08-11'")
        return answered.select("logical_key", F.when(~fails, F.encode("logical_key", "UTF-8")).alias("payload"), F.lit(7).alias("record_count"), F.when(fails, "TIMEOUT").alias("failure"))

    run = lambda plan_id: {r.logical_key[-10:]: (r.outcome, r.detail) for r in ingest.run_plan(spark, items, download, path, key, plan_id, now, "feed", "v1").collect()}
    got = run("p1")
    ids = {r.logical_key[-10:]: r.record_id for r in records.load(spark, f"{path}/records").collect()}
    assert got == {
        "2026-08-14": ("LANDED", ids["2026-08-14"]), "2026-08-17": ("LANDED", ids["2026-08-17"]), "2026-08-18": ("NOT_DUE", "day has not closed yet"), "2026-08-13": ("EMPTY_CHAIN", None),
        "2026-08-12": ("GAP", "download failed (TIMEOUT)"), "2026-08-11": ("GAP", "download failed (NO_ANSWER)"),
    }
    assert asked == [["2026-08-11", "2026-08-12", "2026-08-14", "2026-08-17"]]
    stored = {r.logical_key: bytes(r.payload) for r in ledgers.landed(spark, f"{path}/batches", key).collect()}
    assert stored == {k: k.encode() for k in ("D/s/x/2026-08-14", "D/s/x/2026-08-17")}
    content = records.load(spark, f"{path}/records").where("logical_key LIKE '%08-14'").select(records.content_field("estimated_usd", "double").alias("c"), records.content_field("record_count", "int").alias("n"), records.content_field("object_key").alias("o")).first()
    assert (content.c, content.n) == (1.5, 7) and content.o in {r.landing_id for r in ledgers.landed(spark, f"{path}/batches", key).collect()}
    again = run("p2")
    assert again["2026-08-14"] == ("SKIPPED_PRESENT", "already landed") and asked[1] == ["2026-08-11", "2026-08-12"]
    reports = Log(spark, f"{path}/reports").read()
    assert {r.plan_id: r["count"] for r in reports.groupBy("plan_id").count().collect()} == {"p1": 6, "p2": 6}


def test_a_run_broken_off_is_finished(spark, tmp_path, monkeypatch):
    path, key, now = str(tmp_path / "i"), F.lit(b"0123456789abcdef"), dt.datetime(2026, 8, 20)
    items = plan(spark, [("2026-08-14", "PLANNED", 1.0)])
    download = lambda pulls: pulls.select("logical_key", F.encode("logical_key", "UTF-8").alias("payload"), F.lit(1).alias("record_count"), F.lit(None).cast("string").alias("failure"))
    with monkeypatch.context() as m:
        m.setattr(records, "append", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            ingest.run_plan(spark, items, download, path, key, "p", now, "feed", "v1")
    got = ingest.run_plan(spark, items, download, path, key, "p", now + dt.timedelta(hours=1), "feed", "v1").collect()
    assert [r.outcome for r in got] == ["LANDED"] and records.load(spark, f"{path}/records").first().first_seen_at == now
