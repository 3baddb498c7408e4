"""The landing boundary and document repositories: who may, what stays, what is refused."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.sources.landing import RECEIPT, AccessDenied, Landing
from tidemark.sources.repository import Repository
from tidemark.sources.sinks import Conflict

T = dt.datetime(2026, 8, 17, 20)


def batches(spark, rows):
    return spark.createDataFrame([("feed", d, k, T, T + dt.timedelta(hours=h), bytearray(p)) for d, k, h, p in rows], "provider string, dataset string, logical_key string, published_at timestamp, first_seen_at timestamp, payload binary")


def test_landing_asks_first_and_receipts_hold_no_payload(spark, tmp_path):
    asked = []

    def authorize(c):
        asked.append((c.principal, c.operation, c.dataset))
        return c.principal == "loader" or (c.principal == "reader" and c.operation == "READ" and c.dataset == "A")

    landing = Landing(spark, str(tmp_path / "l"), F.lit(b"0123456789abcdef"), "key-1", authorize)
    rows = batches(spark, [("A", "A/1", 1, b"one"), ("B", "B/1", 2, b"two")])
    with pytest.raises(AccessDenied, match="WRITE"):
        landing.land(rows, "reader", "audit", "text")
    assert landing.receipts() is None and asked[-1][0] == "reader"
    got = landing.land(rows, "loader", "backfill", "text")
    assert got.columns == RECEIPT and got.count() == 2 and landing.land(rows, "loader", "backfill", "text").count() == 2 and landing.receipts().count() == 2
    assert not {"payload", "sealed"} & set(landing.receipts().columns) and got.first().object_key == f"licensed/feed/{got.first().dataset}/{got.first().landing_id}"
    with pytest.raises(AccessDenied, match="feed/B"):
        landing.read(got, "reader", "audit")
    opened = landing.read(got.where("dataset = 'A'"), "reader", "audit").collect()
    assert [(r.logical_key, bytes(r.payload)) for r in opened] == [("A/1", b"one")]
    for bad in (got.withColumn("plaintext_sha256", F.lit("0" * 64)), got.withColumn("landing_id", F.lit("none")), got.withColumn("key_id", F.lit("key-2"))):
        with pytest.raises(Exception, match="missing, or can't be opened"):
            landing.read(bad, "loader", "audit").collect()
    for wrong in ([("A", " ", 1, b"x")], [("A", "A/2", -1, b"x")], [("A", "A/2", 1, b"")], [("A/../B", "A/2", 1, b"x")]):
        with pytest.raises(Exception, match="a batch needs a key|landing needs safe names"):
            landing.land(batches(spark, wrong), "loader", "backfill", "text")
    with pytest.raises(ValueError, match="blank"):
        landing.land(rows, "loader", " ", "text")
    assert landing.receipts().count() == 2


def test_documents_are_immutable(spark, tmp_path):
    store = Repository(spark, str(tmp_path / "r"))
    alerts = spark.createDataFrame([(f"a{k}", T + dt.timedelta(minutes=k), "OPEN") for k in range(5)], "alert_id string, created_at timestamp, status string")
    feedback = lambda i, a: spark.createDataFrame([(i, a, T, "ACKNOWLEDGED")], "feedback_id string, alert_id string, recorded_at timestamp, kind string")
    assert store.read("alerts") is None and store.latest("alerts") is None
    with pytest.raises(KeyError, match="unknown alert_id"):
        store.append("feedback", feedback("f1", "a1"))
    assert store.append("alerts", alerts) == 5 and store.append("alerts", alerts) == 0 and store.append("feedback", feedback("f1", "a1")) == 1
    with pytest.raises(Conflict):
        store.append("alerts", alerts.withColumn("status", F.lit("CLOSED")))
    with pytest.raises(KeyError, match="unknown alert_id"):
        store.append("feedback", feedback("f2", "zz"))
    assert [r.alert_id for r in store.latest("alerts", 2).collect()] == ["a4", "a3"] and store.get("alerts", "a2").first().status == "OPEN" and store.get("alerts", "none").count() == 0
    with pytest.raises(KeyError, match="unknown table"):
        store.read("other")
    with pytest.raises(ValueError, match="limit"):
        store.latest("alerts", 0)
    report = {r.table: (r.n_rows, r.sound) for r in store.integrity().collect()}
    assert report["alerts"] == (5, True) and report["feedback"] == (1, True) and report["decisions"] == (0, True)
    file = next((tmp_path / "r" / "alerts").glob("commit=*"))
    forged = spark.read.parquet(str(file)).withColumn("status", F.lit("CLOSED")).collect()
    spark.createDataFrame(forged, spark.read.parquet(str(file)).schema).write.mode("overwrite").parquet(str(file))
    bad = {r.table: r for r in store.integrity().collect()}["alerts"]
    assert (bad.bad_hashes, bad.sound) == (5, False)
