import json
import os

import pytest

from tidemark.plans.models import Descriptor, Registry
from tidemark.sources import loaders, sinks
from tidemark.streaming import folds


def write(path, text):
    path.write_text(text)
    return str(path)


def test_closes(spark, tmp_path):
    rows = loaders.closes_csv(spark, write(tmp_path / "a.csv", "DATE,SPX\n08/14/2026,6400.5\n08/17/2026,1\n08/17/2026,6441\n")).collect()
    assert sorted((str(r.day), r.close) for r in rows) == [("2026-08-14", 6400.5), ("2026-08-17", 6441.0)]
    with pytest.raises(Exception, match="positive"):
        loaders.closes_csv(spark, write(tmp_path / "b.csv", "DATE,SPX\n08/14/2026,0\n")).collect()
    with pytest.raises(ValueError, match="missing columns: SPX"):
        loaders.closes_csv(spark, write(tmp_path / "c.csv", "DATE,X\n08/14/2026,0\n"))
    doc = {"status": "OK", "results": [{"t": 1786665600000, "c": 2.5}]}
    assert [(str(r.day), r.close) for r in loaders.closes_json(spark, write(tmp_path / "a.json", json.dumps(doc))).collect()] == [("2026-08-14", 2.5)]


def test_definitions(spark, tmp_path):
    text = f"raw_symbol,expiration\nB,1786665600000000000\nA,1786665600000000000\nA,1786665600000000000\nC,{loaders.UNDEFINED_NS}\nD,1786752000000000000\n"
    assert [r.raw_symbol for r in loaders.expiring(spark, write(tmp_path / "d.csv", text), "2026-08-14").collect()] == ["A", "B"]


def test_distances_have_exact_keys(spark, tmp_path):
    row = {"day": "2026-08-14", "down_distance": 40.0, "up_distance": 30.0, "regime": "ALL", "model_version": "m", "quantile": 0.975}
    assert loaders.distances(spark, write(tmp_path / "a", json.dumps(row))).first().up_distance == 30.0
    for bad in (row | {"x": 1}, {k: v for k, v in row.items() if k != "regime"}, row | {"up_distance": 0.0}):
        with pytest.raises(Exception, match="keys|positive"):
            loaders.distances(spark, write(tmp_path / "b", json.dumps(bad))).collect()


def test_bars_and_calendar(spark):
    raw = spark.createDataFrame([("d", "2026-08-14 13:30:00", 1.0, 2.0, 0.5, 1.5, 3.0), ("d", None, 1.0, 2.0, 1.2, 1.5, -1.0), ("d", "2026-08-14 13:31:00", float("nan"), 2.0, 1.0, 1.5, 0.0)], "day string, ts_event string, open double, high double, low double, close double, volume double")
    assert [r.violations for r in loaders.bars(raw).collect()] == [[], ["ENVELOPE", "VOLUME", "TIME"], ["ENVELOPE"]]
    days = [str(r.day) for r in loaders.trading_days(spark, "2026-12-23", "2026-12-29", ["2026-12-25"]).orderBy("day").collect()]
    assert days == ["2026-12-23", "2026-12-24", "2026-12-28", "2026-12-29"]


def test_append_once(spark, tmp_path):
    path, rows = str(tmp_path / "ledger"), spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    assert sinks.append_once(spark, rows, path, "k") == 2
    assert sinks.append_once(spark, rows.union(spark.createDataFrame([(3, "c")], "k int, v string")), path, "k") == 1
    with pytest.raises(sinks.Conflict):
        sinks.append_once(spark, spark.createDataFrame([(2, "b")], "k int, v string"), path, "k")
    assert spark.read.parquet(path).count() == 3


def run(step, events):
    state, out = {"__": 1}, []
    for e in events:
        state, found = step(state, e)
        out.append(found)
    return out


def test_alerts_and_delivery():
    events = [(0, True), (1, True), (2, True), (3, False), (4, True), (302, True), (301, True), (303, True)]
    out = run(folds.alert_step(), [{"fingerprint": "f", "seq": i, "at": a, "active": x} for i, (a, x) in enumerate(events)])
    assert [o["outcome"] for o in out] == ["PENDING", "CREATED", "SUPPRESSED", "INACTIVE", "PENDING", "CREATED", "TIME_REGRESSION", "SUPPRESSED"]
    out = run(folds.outbox_step(10), [{"dedupe_key": "k", "message_id": m, "at": a} for m, a in (("a", 0), ("b", 9), ("c", 18), ("a", 40), ("d", 40))])
    assert [o["outcome"] for o in out] == ["ENQUEUED", "SUPPRESSED", "SUPPRESSED", "DUPLICATE", "ENQUEUED"]
    out = run(folds.delivery_step(), [{"message_id": "m", "seq": i, "at": a, "ok": False} for i, a in enumerate((0, 0.5, 1, 3, 9))])
    assert [o["outcome"] for o in out] == ["RETRY_SCHEDULED", "NOT_DUE", "RETRY_SCHEDULED", "DEAD_LETTERED", "TERMINAL"]


def collector_events():
    rows = [("START", 0), ("CONNECTED", 1), ("QUOTE", 2), ("QUOTE", 3), ("QUOTE", 4), ("CONNECTION_LOST", 5), ("CONNECTED", 5.5), ("CONNECTED", 6), ("HEARTBEAT", 7), ("RATE_LIMITED", 8), ("QUOTE", 9)]
    return [{"provider": "p", "event_id": f"e{i}", "seq": i, "kind": k, "at": float(t), "schema_version": "v1", "source_ts": 10.0 - (i == 4), "payload": "q3" if i == 3 else f"q{i + (i == 2)}"} for i, (k, t) in enumerate(rows)]


WANT = [("CONNECTING", ""), ("DEGRADED", "COLLECTOR_STALE"), ("STREAMING", ""), ("STREAMING", "DUPLICATE_OBSERVATION"), ("STREAMING", "BEHIND_WATERMARK,OUT_OF_ORDER_OBSERVATION"), ("BACKING_OFF", ""),
        ("BACKING_OFF", "RETRY_TOO_EARLY"), ("DEGRADED", "COLLECTOR_STALE"), ("DEGRADED", "COLLECTOR_STALE"), ("HALTED", "INVALID_RETRY_AFTER"), ("HALTED", "COLLECTOR_HALTED")]


def test_collector():
    out = run(folds.Collector(), collector_events())
    assert [(o["state"], o["reasons"]) for o in out] == WANT


def test_collector_over_a_stream(spark, tmp_path):
    schema = "provider string, event_id string, seq long, kind string, at double, schema_version string, source_ts double, payload string"
    events = collector_events()
    for k, part in enumerate((events[:4], events[4:])):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(json.dumps(e) for e in part))
        os.utime(tmp_path / "in" / f"{k}.json", (1_700_000_000 + k, 1_700_000_000 + k))  # the file source takes files by their times
    output = "provider string, seq long, state string, accepted boolean, reasons string, watermark double, next_retry_at double, attempts long"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    query = folds.stream_fold(stream, "provider", ["seq"], folds.Collector(), output).writeStream.format("memory").queryName("collected").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [(r.state, r.reasons) for r in spark.table("collected").orderBy("seq").collect()] == WANT
    batch = folds.fold(spark.createDataFrame(events, schema), "provider", ["seq"], folds.Collector(), output)
    assert [(r.state, r.reasons) for r in batch.orderBy("seq").collect()] == WANT


def test_held_rows_go_through_in_order(spark, tmp_path):
    """Batches that overlap in time: with a hold, the machine sees what it would see over a table."""
    schema = "provider string, event_id string, seq long, kind string, at double, schema_version string, source_ts double, payload string"
    events = collector_events()
    end = {**events[-1], "event_id": "end", "seq": 99, "at": 100.0}
    parts = (events[0:2] + events[3:4], events[2:3] + events[4:7], events[7:], [end], [{**end, "event_id": "end2", "seq": 100, "at": 200.0}])
    (tmp_path / "in").mkdir()
    for k, part in enumerate(parts):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(json.dumps(e) for e in part))
        os.utime(tmp_path / "in" / f"{k}.json", (1_700_000_000 + k, 1_700_000_000 + k))
    output = "provider string, seq long, state string, accepted boolean, reasons string, watermark double, next_retry_at double, attempts long"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    query = folds.stream_fold(stream, "provider", ["seq"], folds.Collector(), output, hold=1.5).writeStream.format("memory").queryName("held").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = [(r.state, r.reasons) for r in spark.table("held").orderBy("seq").collect()]
    assert got[: len(WANT)] == WANT


def test_ids_are_forgotten_after_a_while():
    step = folds.outbox_step(cooldown=1, keep=10)
    out = run(step, [{"dedupe_key": "k", "message_id": m, "at": a} for m, a in (("a", 0.0), ("b", 5.0), ("a", 9.0), ("b", 16.0), ("a", 40.0))])
    assert [o["outcome"] for o in out] == ["ENQUEUED", "ENQUEUED", "DUPLICATE", "ENQUEUED", "ENQUEUED"]
    one = folds.Collector(instrument="I")
    rows = [{"provider": "p", "event_id": str(i), "seq": i, "kind": k, "at": float(i), "schema_version": "v1", "source_ts": float(i), "payload": str(i), "instrument_id": x} for i, (k, x) in enumerate((("START", None), ("CONNECTED", None), ("QUOTE", "J"), ("QUOTE", "I")))]
    assert [o["reasons"] for o in run(one, rows)][2:] == ["COLLECTOR_STALE,INSTRUMENT_MISMATCH", ""]


def test_missing_labels_are_an_empty_table(spark, tmp_path):
    assert loaders.labels(spark, str(tmp_path / "none.jsonl")).collect() == []


def test_chain_day(spark):
    t0, symbol = "2026-08-17 13:30:00", "SPXW  260817C06400000"
    raw_bars = spark.createDataFrame([("2026-08-17", t0, 1.0, 2.0, 0.5, 1.5, 3.0), ("2026-08-18", t0, 9.0, 2.0, 0.5, 1.5, 3.0)], "day string, ts_event string, open double, high double, low double, close double, volume double").selectExpr("CAST(day AS DATE) AS day", "CAST(ts_event AS TIMESTAMP) AS ts_event", "open", "high", "low", "close", "volume")
    rows = [("2026-08-17", None, t0, symbol, float("nan"), 1.2, 1, 2), ("2026-08-17", "2026-08-17 13:29:00", t0, symbol, 1.0, 1.2, 1, 2), ("2026-08-18", t0, t0, "short", 1.3, 1.2, -1, 2)]
    raw_quotes = spark.createDataFrame(rows, "day string, ts_event string, ts_recv string, symbol string, bid_px_00 double, ask_px_00 double, bid_sz_00 int, ask_sz_00 int").selectExpr("CAST(day AS DATE) AS day", "CAST(ts_event AS TIMESTAMP) AS ts_event", "CAST(ts_recv AS TIMESTAMP) AS ts_recv", "symbol", "bid_px_00", "ask_px_00", "bid_sz_00", "ask_sz_00")
    bars, chain = loaders.chain_day(raw_bars, raw_quotes, "2026-08-17")
    assert [(r.bid, str(r.ts)) for r in chain.collect()] == [(1.0, "2026-08-17 13:29:00"), (None, t0)] and bars.count() == 1
    assert loaders.chain_day(raw_bars, None, "2026-08-17")[1] is None
    assert loaders.quotes(raw_quotes.where("symbol = 'short'")).first().violations == ["SYMBOL_NOT_PADDED", "CROSSED", "NEGATIVE_SIZE"]
    with pytest.raises(Exception, match="break a rule"):
        loaders.chain_day(raw_bars, raw_quotes, "2026-08-18")[1].collect()
    with pytest.raises(ValueError, match="no bars"):
        loaders.chain_day(raw_bars, raw_quotes, "2026-08-19")
    with pytest.raises(ValueError, match="missing columns: ask_px_00"):
        loaders.quotes(raw_quotes.drop("ask_px_00"))


def test_detectors_as_table_functions(spark):
    def detect(row):
        for i in range(row["n"] or 0):
            yield f"{row['k']}{i}", i

    registry = Registry()
    registry.register_rows(spark, Descriptor("copies", "v1", "h"), detect, ["k", "n"], "name string, i int")
    df = spark.createDataFrame([("a", 2, 1.0), ("b", 0, 2.0), ("c", None, 3.0), ("d", 1, 4.0)], "k string, n int, extra double")
    df.createOrReplaceTempView("counted")
    want = [("a", "a0", 0, "copies@v1#h"), ("a", "a1", 1, "copies@v1#h"), ("d", "d0", 0, "copies@v1#h")]
    assert sorted(map(tuple, spark.sql("SELECT c.k, d.* FROM counted c, LATERAL copies(c.k, c.n) d").collect())) == want
    assert sorted(map(tuple, spark.sql("SELECT * FROM copies(TABLE(counted) PARTITION BY k)").collect())) == [w[1:] for w in want]
    for bad, why in (("SELECT * FROM copies(TABLE(SELECT k FROM counted))", "missing columns: n"), ("SELECT * FROM copies(1)", "reads k, n")):
        with pytest.raises(Exception, match=why):
            spark.sql(bad).collect()
    with pytest.raises(ValueError, match="taken"):
        registry.register_rows(spark, Descriptor("copies", "v2", "h"), detect, ["k"], "name string")
