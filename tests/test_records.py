"""Canonical JSON and the records made of it against Python's own JSON and fixed digests."""

import datetime as dt
import hashlib
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.functions import snapshots
from tidemark.sources import records
from tidemark.sources.sinks import Conflict

UTC = dt.timezone.utc


def plain(value):
    def default(v):
        return format(v, "f") if isinstance(v, Decimal) else v.isoformat()

    return json.dumps(value, default=default, ensure_ascii=False, allow_nan=False, sort_keys=True, separators=(",", ":"))


def test_fixed_digests():
    assert snapshots.of({}) == "sha256:44136fa355b3678a1146ad16f7e8649e94fb4fc21fe77e8310c060f61caaff8a"
    assert snapshots.of({"b": 1, "a": [1.5, None, "é"]}) == "sha256:" + hashlib.sha256('{"a":[1.5,null,"é"],"b":1}'.encode()).hexdigest()


def test_equals_pythons_json(spark):
    at = dt.datetime(2026, 8, 17, 13, 30, 0, 250_000)
    rows = [
        (2, "é\"\n ", 1e16, 0.1, True, Decimal("1.50"), dt.date(2026, 8, 17), at, {"z": 1.0, "a": None}, [{"y": 1, "x": [2.5]}], ("q", {"k": dt.date(2020, 1, 1)})),
        (None, None, -0.0, 1e-7, None, None, None, dt.datetime(2026, 8, 17), {}, [], (None, None)),
        (3, "", 5e-324, 123456789.125, False, Decimal("-0.01"), dt.date(1970, 1, 1), dt.datetime(1970, 1, 1), None, None, None),
    ]
    names = ["n", "s", "big", "f", "b", "d", "day", "at", "m", "list", "deep"]
    shape = "n long, s string, big double, f double, b boolean, d decimal(10,2), day date, at timestamp, m map<string,double>, list array<struct<y:int,x:array<double>>>, deep struct<p:string,o:map<string,date>>"
    df = spark.createDataFrame(rows, shape)
    got = df.select(snapshots.canonical(*names).alias("c"), snapshots.snapshot_id(*names).alias("i")).collect()
    for row, r in zip(rows, got, strict=True):
        value = dict(zip(names, row, strict=True))
        value["at"] = row[7].replace(tzinfo=UTC)
        value["deep"] = None if row[10] is None else {"p": row[10][0], "o": row[10][1]}
        assert r.c == plain(value) and r.i == "sha256:" + hashlib.sha256(r.c.encode()).hexdigest()
    with pytest.raises(Exception, match="not JSON compliant"):
        spark.createDataFrame([(float("nan"),)], "x double").select(snapshots.canonical("x")).collect()
    texts = spark.createDataFrame([('{"b": {"d":1e5, "c":[ 1.0 ]}, "a":"\\u00e9"}',), ("not json",), (None,)], "t string").select(snapshots.canonical_text(F.col("t")).alias("c")).collect()
    assert [r.c for r in texts] == ['{"a":"é","b":{"c":[1.0],"d":100000.0}}', None, None]


def rows_of(spark, n=3):
    at = dt.datetime(2026, 8, 17, 20, 0)
    rows = [(f"P/s/x/{k}", at, at + dt.timedelta(seconds=k, microseconds=5 * k), "p", "v1", "s1", f"obj/{k}", 0.1 * k) for k in range(n)]
    return spark.createDataFrame(rows, "logical_key string, published_at timestamp, first_seen_at timestamp, provider string, provider_version string, schema_version string, object_key string, cost double")


def test_records_have_the_identity_of_their_content(spark):
    for r in records.records(rows_of(spark), ["object_key", "cost"]).collect():
        k = int(r.logical_key[-1])
        assert r.canonical_content == plain({"object_key": f"obj/{k}", "cost": 0.1 * k})
        body = {c: r[c] for c in (*records.TEXTS, "content_hash")} | {c: r[c].replace(tzinfo=UTC) for c in ("published_at", "first_seen_at")}
        assert r.record_id == "sha256:" + hashlib.sha256(plain(body).encode()).hexdigest()
    late = rows_of(spark, 1).withColumn("published_at", F.expr("first_seen_at + INTERVAL 1 SECOND"))
    for bad in (late, rows_of(spark, 1).withColumn("provider", F.lit(" ")), rows_of(spark, 1).withColumn("schema_version", F.lit(None).cast("string"))):
        with pytest.raises(Exception, match="a record needs its texts"):
            records.records(bad, ["cost"]).collect()


def test_logs_and_lines_are_verified(spark, tmp_path):
    made = records.records(rows_of(spark), ["object_key", "cost"])
    path = str(tmp_path / "pit")
    assert records.load(spark, path).collect() == [] and records.append(spark, made, path) == 3 and records.append(spark, made, path) == 0
    with pytest.raises(Conflict):
        records.append(spark, records.records(rows_of(spark, 1).withColumn("cost", F.lit(9.0)), ["object_key", "cost"]), path)
    got = records.load(spark, path)
    assert sorted(got.select("record_id").collect()) == sorted(made.select("record_id").collect())
    assert {r.c for r in got.select(records.content_field("cost", "double").alias("c")).collect()} == {0.0, 0.1, 0.2}
    faults = {
        "CONTENT_HASH": made.withColumn("canonical_content", F.lit("{}")), "RECORD_ID": made.withColumn("provider", F.lit("q")), "SEEN_BEFORE_PUBLISHED": made.withColumn("published_at", F.expr("first_seen_at + INTERVAL 1 DAY")),
    }
    for code, forged in faults.items():
        assert all(code in r.faults for r in records.record_faults(forged).collect())
        with pytest.raises(Exception, match="hash or identity is false"):
            records.verified(forged).collect()
    spaced = made.withColumn("canonical_content", F.regexp_replace("canonical_content", ",", ", "))  # the same content, written otherwise
    assert all(r.faults == [] for r in records.record_faults(spaced).collect())
    lines = tmp_path / "lines.jsonl"
    lines.write_text("\n".join(json.dumps({c: r[c].replace(tzinfo=UTC).isoformat() if c.endswith("_at") else r[c] for c in r.asDict()}) for r in made.collect()))
    assert records.load_lines(spark, str(lines)).count() == 3 and records.load_lines(spark, str(tmp_path / "none")).collect() == []
