"""Workflows, ledgers and extension points on hand-made tables."""

import datetime as dt
import struct

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.operators import delivery, market, workflows
from tidemark.plans import models
from tidemark.sources import ledgers, sinks

DAY = dt.date(2026, 8, 17)
T = dt.datetime(2026, 8, 17)


def day_bars(day, prices, start=13 * 60 + 30):
    t = dt.datetime.combine(day, dt.time())
    return [(day, t + dt.timedelta(minutes=start + m), float(p)) for m, p in prices]


def test_label_batch_outcomes(spark):
    days = [DAY + dt.timedelta(days=k) for k in range(8)]
    full = [(m, 6400 + m) for m in range(31)]
    bars = day_bars(days[0], full) + day_bars(days[1], full) + day_bars(days[3], full) + day_bars(days[4], full) + day_bars(days[5], full[:10] + full[20:]) + day_bars(days[6], full) + day_bars(days[7], full[:28])
    bars = spark.createDataFrame(bars, "day date, ts timestamp, close double")
    only = lambda ds: spark.createDataFrame([(d,) for d in ds], "day date")
    anchors = spark.createDataFrame([(d, 3200.0) for d in days if d != days[3]], "day date, close double")
    at = lambda d, m: dt.datetime.combine(d, dt.time()) + dt.timedelta(minutes=13 * 60 + 30 + m)
    windows = spark.createDataFrame([(d, at(d, 15), at(d, 15 if d == days[6] else 30)) for d in days], "day date, entry_ts timestamp, close_ts timestamp")
    got = {r.day: r for r in workflows.label_batch(bars, only(days), anchors, only([days[3]]), F.lit(days[0]), F.lit(days[7]), windows).collect()}
    assert [got[d].outcome for d in days] == ["SKIPPED_NO_PRIOR", "LABELLED", "GAP", "ALREADY_PRESENT", "SKIPPED_NO_ANCHOR", "SKIPPED_COVERAGE", "SKIPPED_ENTRY_AFTER_CLOSE", "LABELLED"]
    r = got[days[1]]
    # The anchor is 3200 for a future of 6430: every point of the future is 3200 / 6430.
    assert r.f_a == 6430.0 and r.entry_price == pytest.approx(3200 * 6415 / 6430) and r.close_price == pytest.approx(3200.0) and r.up_max == pytest.approx(3200 * 15 / 6430) and r.down_max == 0.0
    assert r.sample_count == 15 and r.up_max_ts == at(days[1], 30) and r.down_max_ts == at(days[1], 16) and r.prior_day == days[0]
    assert got[days[7]].sample_count == 12 and got[days[5]].up_max is None


def chain(spark, quotes):
    rows = [(DAY, s, T + dt.timedelta(minutes=m), i, b, a) for i, (s, m, b, a) in enumerate(quotes)]
    return spark.createDataFrame(rows, "day date, symbol string, ts timestamp, seq long, bid double, ask double")


SP, LP, SC, LC = (f"SPXW  260817{x}" for x in ("P06400000", "P06395000", "C06450000", "C06455000"))
OPEN = [(SP, 0, 1.5, 1.7), (LP, 0, 0.5, 0.6), (SC, 0, 1.4, 1.6), (LC, 0, 0.4, 0.5)]


def test_economics_of_a_day(spark):
    labels = spark.createDataFrame([(DAY, T, 6441.0, 6397.0)], "day date, entry_ts timestamp, center double, close_price double")
    distances = spark.createDataFrame([(DAY, 8.0, 40.0, "ALL")], "day date, up_distance double, down_distance double, regime string")
    r = workflows.economics_days(labels, distances, chain(spark, OPEN + [(SP, 1, 9.0, 9.1)]), fees=0.028).first()
    assert (r.status, r.put_breached, r.call_breached) == ("PRICED", True, False)
    assert r.credit == pytest.approx(1.8) and r.settlement_loss == pytest.approx(3.0) and r.pnl == pytest.approx(-1.2) and r.net_pnl == pytest.approx(-1.228) and r.max_loss == pytest.approx(3.2)
    crossed = workflows.economics_days(labels, distances, chain(spark, OPEN + [(SP, 0, 2.0, 1.7)]), fees=0.028).first()
    assert crossed.status == "UNPRICEABLE" and crossed.pnl is None and crossed.fees is None
    assert workflows.economics_days(labels, distances, chain(spark, OPEN).limit(0)).first().status == "MISSING_CHAIN"
    assert workflows.economics_days(labels, distances.limit(0), chain(spark, OPEN)).first().status == "MISSING_DISTANCE"
    days = spark.createDataFrame([("a", "PRICED", 1.0, 0.1), ("a", "PRICED", -3.0, 0.1), ("a", "UNPRICEABLE", None, None), ("b", "UNPRICEABLE", None, None), ("b", "MISSING_CHAIN", None, None)], "k string, status string, pnl double, fees double")
    got = {r.k: r for r in workflows.summarize(days, ["k"]).collect()}
    assert (got["a"].n_priced, got["a"].n_unpriceable, got["a"].total_pnl, got["a"].mean_pnl, got["a"].max_daily_loss, got["a"].win_rate, got["a"].cvar_95) == (2, 1, -2.0, -1.0, 3.0, 0.5, -3.0)
    assert got["a"].ev == pytest.approx(-2 / 3) and got["a"].net_total_pnl == pytest.approx(-2.2) and (got["b"].n_unpriceable, got["b"].mean_pnl, got["b"].cvar_95, got["b"].max_daily_loss) == (1, None, None, None)


def test_exit_rules(spark):
    positions = spark.createDataFrame([(DAY, T, T + dt.timedelta(minutes=10), 6420.0, 1.8, 6441.0, 40.0, 8.0)], "day date, entry_ts timestamp, close_ts timestamp, close_price double, credit double, center double, down_distance double, up_distance double")
    later = [(SP, 2, 0.3, 0.5), (SC, 2, 0.3, 0.5), (SP, 4, None, None), (SP, 6, 3.0, 3.2)]
    rule = workflows.ExitRule
    rules = [rule("HOLD"), rule("PROFIT_TARGET", profit_fraction=0.5), rule("STOP_LOSS", stop_multiple=0.5), rule("TIME_EXIT", after_seconds=240), rule("TIME_EXIT", after_seconds=601)]
    got = workflows.exit_outcomes(positions, chain(spark, OPEN + later), rules)
    out = {r.rule: (r.reason, round(r.exit_cost, 6), r.holding_minutes, round(r.pnl, 6)) for r in got.collect()}
    # Cost: both shorts at the ask less both longs at the bid (0.9). Minutes 4 and 5 lack the short put.
    assert out == {0: ("EXPIRY", 0.0, 10.0, 1.8), 1: ("PROFIT_TARGET", 0.1, 2.0, 1.7), 2: ("STOP_LOSS", 2.8, 6.0, -1.0), 3: ("TIME_EXIT", 2.8, 6.0, -1.0), 4: ("EXPIRY", 0.0, 10.0, 1.8)}
    none = spark.createDataFrame([(DAY + dt.timedelta(days=1),)], "day date")
    s = {r.rule: r for r in workflows.exit_summary(got, none, rules).collect()}
    assert s[2].n_stop_loss == 1 and s[2].n_expiry == s[2].n_time_exit == 0 and s[2].ev == pytest.approx(-0.5) and s[2].n_unpriceable == 1 and s[0].mean_holding_minutes == 10.0
    with pytest.raises(ValueError):
        rule("OTHER").triggered()


def test_clock_exits_are_at_one_time_whatever_the_entry(spark):
    shape = "day date, entry_ts timestamp, close_ts timestamp, close_price double, credit double, center double, down_distance double, up_distance double"
    begin = T + dt.timedelta(hours=14)
    end, clock = begin + dt.timedelta(minutes=10), begin + dt.timedelta(minutes=5)
    local = (clock - dt.timedelta(hours=4)).strftime("%H:%M")  # summer time
    rule = workflows.ExitRule("TIME_EXIT", time_exit_et=local)
    for start in (0, 3):
        positions = spark.createDataFrame([(DAY, begin + dt.timedelta(minutes=start), end, 6420.0, 1.8, 6441.0, 40.0, 8.0)], shape)
        r = workflows.exit_outcomes(positions, chain(spark, OPEN), [rule]).first()
        assert (r.reason, r.exit_ts, r.holding_minutes) == ("TIME_EXIT", clock, 5.0 - start)
    r = workflows.exit_outcomes(positions, chain(spark, OPEN), [workflows.ExitRule("TIME_EXIT", time_exit_et="15:59")]).first()
    assert r.reason == "EXPIRY"


def test_entry_snapshot_finds_the_volatility(spark):
    entry, expiry = T.replace(hour=13, minute=45), T.replace(hour=20)
    strikes = [float(k) for k in range(6200, 6601, 5)]
    tau = (expiry - entry).total_seconds() / market.YEAR_SECONDS
    quotes = []
    for k in strikes:
        for right in "CP":
            mid = float(market.black_scholes([6400.0], [k], [tau], [0.045], [0.15], [right == "C"])[0])
            if mid > 0.2:
                quotes.append((f"SPXW  260817{right}{int(k * 1000):08d}", 13 * 60 + 44, mid - 0.05, mid + 0.05))
    bars = spark.createDataFrame(day_bars(DAY, [(m, 6400.0) for m in range(15)]), "day date, ts timestamp, close double")
    entries = spark.createDataFrame([(DAY, entry, 6400.0, expiry)], "day date, entry_ts timestamp, center double, expiry_ts timestamp")
    r = workflows.entry_snapshot(chain(spark, quotes), bars, entries).first()
    assert r.atm_iv_valid and r.atm_iv == pytest.approx(0.15, abs=1e-3) and abs(r.skew) < 0.02 and r.median_spread == pytest.approx(0.1) and r.realized_vol == 0.0
    empty = workflows.entry_snapshot(chain(spark, quotes).limit(0), bars, entries).first()
    assert not empty.atm_iv_valid and empty.atm_iv is None and empty.skew == 0.0 and empty.median_spread == 0.0


def test_buffers_and_models(spark):
    days = [(DAY + dt.timedelta(days=i), float(i % 10), float(9 - i % 10), None if i % 10 == 9 else float(i % 4)) for i in range(100)]
    df = spark.createDataFrame(days, "day date, up_max double, down_max double, iv double").withColumn("fold", F.lit(0).cast("long"))
    c = workflows.buffer_calibration(df, ["fold"], 0.5, 1.0, 10.0, 1.0).first()
    assert (c.base_up, c.base_down, c.buffer_up, c.buffer_down, c.calibrated, c.train_coverage) == (4.0, 4.0, 5.0, 5.0, True, 1.0)
    worse = workflows.buffer_calibration(df, ["fold"], 0.5, 1.0, 4.0, 1.0).first()
    assert (worse.buffer_up, worse.calibrated, worse.train_coverage) == (4.0, False, pytest.approx(0.8))
    test = df.limit(0).unionByName(spark.createDataFrame([(DAY, 1.0, 1.0, 2.0, 0), (DAY, 1.0, 1.0, None, 0)], "day date, up_max double, down_max double, iv double, fold long"))
    told = lambda kind, **o: [(r.up_distance, r.regime) for r in workflows.TailModel(kind, 0.9, **o).recommend(df, test, ["fold"]).orderBy(F.col("iv").isNull()).collect()]
    assert told("unconditional") == [(8.0, "UNCONDITIONAL")] * 2 and told("unconditional", min_distance=30.0)[0][0] == 30.0
    # Cuts of iv are 0, 1 and 2 (of 25, 20, 25 and 20 days); a value on a cut belongs to the upper regime.
    assert told("iv_regime", min_regime_days=10)[0][1] == "IV_Q4" and told("iv_regime", min_regime_days=10)[1] == (None, None)
    assert told("iv_regime", min_regime_days=1000)[0][1] == "IV_Q4_FALLBACK" and told("iv_regime", min_regime_days=1000, allow_fallback=False)[0] == (None, None)
    assert told("buffered", target=0.99, buffer_max=1.0, buffer_step=1.0)[0] == (9.0, "BUFFERED") and told("buffered", target=0.99, buffer_max=0.5, buffer_step=0.5)[0] == (None, None)
    assert told("buffered_iv", min_regime_days=1000)[0][1] == "IV_Q4_BUFFERED_FALLBACK"


def test_chained_ledger(spark, tmp_path):
    path, shape = str(tmp_path / "l"), "k string, day int, cost double"
    one = spark.createDataFrame([("a", 2, 2.0), ("a", 1, 1.0), ("b", 1, 5.0)], shape)
    assert ledgers.append_chained(spark, one, path, ["k"], "day") == 3
    assert ledgers.append_chained(spark, spark.createDataFrame([("a", 3, 3.0)], shape), path, ["k"], "day") == 1
    rows = ledgers.chained(spark, path, ["k"], ["k", "day", "cost"]).orderBy("k", "seq").collect()
    assert [(r.k, r.seq, r.day) for r in rows] == [("a", 1, 1), ("a", 2, 2), ("a", 3, 3), ("b", 1, 5 - 4)] and rows[1].previous_hash == rows[0].entry_hash
    forged = str(tmp_path / "f")
    spark.read.parquet(path).withColumn("cost", F.when(F.col("day") == 2, 9.0).otherwise(F.col("cost"))).write.parquet(forged)
    with pytest.raises(ValueError, match="broken"):
        ledgers.chained(spark, forged, ["k"], ["k", "day", "cost"])


def test_ledger_is_verified(spark, tmp_path):
    path, shape = str(tmp_path / "l"), "id int, v string"
    assert ledgers.ledger(spark, path, "id", shape).collect() == []
    sinks.append_once(spark, spark.createDataFrame([(1, "a"), (2, None)], shape), path, "id")
    assert ledgers.ledger(spark, path, "id", shape).count() == 2
    spark.createDataFrame([(3, "c", "0")], shape + ", content_hash string").write.mode("append").parquet(path)
    with pytest.raises(Exception, match="content hash"):
        ledgers.ledger(spark, path, "id", shape).collect()
    keys = spark.createDataFrame([("A/b/scope/2026-08-17",), ("A/b/other/x",), ("scope",)], "k string")
    assert [r.s for r in keys.select(ledgers.scope(F.col("k"), "scope").alias("s")).collect()] == [True, False, False]
    assert [r.s for r in keys.select(ledgers.without_prefix(F.col("k"), "A/b/").alias("s")).collect()] == ["scope/2026-08-17", "other/x", None]


def test_landing(spark, tmp_path):
    path, key = str(tmp_path / "landed"), F.lit(b"0123456789abcdef")
    rows = spark.createDataFrame([("p", "d", "k1", T, bytearray(b"one")), ("p", "d", "k2", T, bytearray(b"two"))], "provider string, dataset string, logical_key string, first_seen_at timestamp, payload binary")
    assert ledgers.land(spark, rows, path, key, scalars.seal) == 2 and ledgers.land(spark, rows, path, key, scalars.seal) == 0
    assert sorted(bytes(r.payload) for r in ledgers.landed(spark, path, key).collect()) == [b"one", b"two"]
    assert b"one" not in b"".join(p.read_bytes() for p in (tmp_path / "landed").glob("*.parquet"))
    with pytest.raises(Exception, match="opened or verified"):
        ledgers.landed(spark, path, F.lit(b"another key 1234")).collect()
    with pytest.raises(Exception, match="safe names"):
        ledgers.land(spark, rows.withColumn("provider", F.lit("a/b")), path, key, scalars.seal)


def test_binary_bars(spark, tmp_path):
    meta = b"\0" * 20
    bar = lambda ts, *p: struct.pack("<BBHIQqqqqQ", 14, 33, 1, 7, ts, *(int(x * 1e9) for x in p), 5)
    (tmp_path / "a.dbn").write_bytes(b"DBN\x01" + struct.pack("<I", len(meta)) + meta + bar(1786973400000000000, 1.5, 2.0, 1.0, 1.25) + bar(1786973460000000000, 1, 1, 1, 1))
    rows = ledgers.binary_bars(spark, str(tmp_path)).orderBy("ts_event").collect()
    assert [(r.instrument_id, r.open, r.high, r.low, r.close, r.volume) for r in rows] == [(7, 1.5, 2.0, 1.0, 1.25, 5.0), (7, 1.0, 1.0, 1.0, 1.0, 5.0)] and str(rows[0].ts_event) == "2026-08-17 13:30:00"
    for bad in (b"XXX\x01", b"DBN\x01" + struct.pack("<I", 0) + b"abc"):
        (tmp_path / "a.dbn").write_bytes(bad)
        with pytest.raises(Exception, match="a.dbn"):
            ledgers.binary_bars(spark, str(tmp_path)).collect()


def test_small_readers(spark, tmp_path):
    (tmp_path / "t.csv").write_text("\n".join(str(i) for i in range(50)))
    assert ledgers.preview(spark, str(tmp_path / "t.csv"), 3).count() == 3
    with pytest.raises(ValueError, match="bytes"):
        ledgers.preview(spark, str(tmp_path / "t.csv"), 3, most_bytes=10)
    (tmp_path / "r.json").write_text('{"a": 1}')
    assert ledgers.latest_report(spark, str(tmp_path / "r.json")) == {"a": 1} and ledgers.latest_report(spark, str(tmp_path / "t.csv")) is None and ledgers.latest_report(spark, str(tmp_path / "no")) is None
    closes = spark.createDataFrame([(DAY, 1.0)], "day date, close double")
    assert ledgers.anchor_closes(lambda: spark.read.json(str(tmp_path / "no")), lambda: closes, "2026-08-01", "2026-08-31").count() == 1
    with pytest.raises(ValueError, match="no closes"):
        ledgers.anchor_closes(lambda: closes, lambda: closes, "2025-01-01", "2025-01-31")
    rows = spark.createDataFrame([(0.1, None), (None, None), (0.2, False)], "atm_iv double, atm_iv_valid boolean")
    assert [tuple(r) for r in ledgers.with_validity(rows).collect()] == [(0.1, True), (None, False), (None, False)]
    assert ledgers.report_lines(closes) == ['{"day":"2026-08-17","close":1.0}']


def test_models_and_senders(spark):
    registry = models.Registry()
    registry.register(models.Descriptor("m", "1", "h"), lambda: F.col("x") + 1)
    with pytest.raises(ValueError):
        registry.register(models.Descriptor("m", "2", "h"), lambda: F.lit(1))
    with pytest.raises(KeyError):
        registry.get("none")
    shut = "data_quality string, contract_matches boolean, event_cleared boolean, unscheduled_shock boolean, option_chain_usable boolean, tail_expanding boolean, next_event_in_holding boolean, edge_ok boolean, risk_budget_ok boolean"
    rows = spark.createDataFrame([(1, "GREEN", True, True, False, True, False, False, True, True), (2, "RED", True, True, False, True, False, False, True, True)], f"x int, {shut}")
    got = {r.x: (r.action, r.output, r.model) for r in registry.decide("m", rows).collect()}
    assert got == {1: ("WAIT", 2, "m@1#h"), 2: ("NO_TRADE", None, "m@1#h")}
    assert registry.decide("m", rows.where("x = 1"), F.lit("m@2#h")).first().reasons == ["MODEL_VERSION_NOT_LOADED"]
    shape = "target string, direction string, as_of timestamp, next_checkpoint timestamp, confidence double, evidence array<string>, invalidation_conditions array<string>, data_manifest_id string, kind string, estimate_method string"
    found = [("A", "UP", T, T + dt.timedelta(hours=1), 0.5, ["b", "a"], ["x"], "m", "PRICE", None), ("A", "UP", T, T + dt.timedelta(hours=1), 0.5, ["a", "b"], ["x"], "m", "PRICE", None), ("B", "UP", T, T, 1.5, [], ["x"], "m", "FLOW", None)]
    registry.register(models.Descriptor("d", "1", "h", ("A",)), lambda df: df)
    out = registry.detect("d", spark.createDataFrame(found, shape), ("FLOW",)).collect()
    assert out[0].violations == [] and out[0].candidate_id == out[1].candidate_id != out[2].candidate_id
    assert out[2].violations == ["CHECKPOINT_NOT_AHEAD", "CONFIDENCE_OUT_OF_RANGE", "OUTSIDE_UNIVERSE", "NO_EVIDENCE", "NO_ESTIMATE_METHOD"]
    messages = spark.createDataFrame([("a",), ("b",)], "message_id string")
    assert [r.outcome for r in models.scripted_sender({"a": "SENT"})(messages).orderBy("message_id").collect()] == ["SENT", "TRANSIENT_FAILURE"]
    assert {r.outcome for r in models.null_sender(messages).collect()} == {"PERMANENT_FAILURE"} and delivery.TERMINAL
