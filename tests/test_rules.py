"""Rule sets against hand-computed cases: each rule alone, boundaries, nulls and empty groups."""

import datetime as dt
import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.operators import calendar, delivery, execution, gates, governance, market, quality
from tidemark.plans import rule_queries

NOW = dt.datetime(2026, 8, 17, 14, 0, 0)
POLICY = quality.QualityPolicy(green_max_age=2, amber_max_age=5, max_receive_latency=1, conflict_absolute=0.5, conflict_relative=0.0001)
OBSERVATION = (
    "k int, source string, instrument_id string, entitlement string, delayed boolean, source_ts timestamp, received_ts timestamp, bid double, ask double, bid_size int, ask_size int,"
    " bid_ts timestamp, ask_ts timestamp, bid_size_ts timestamp, ask_size_ts timestamp"
)


def ago(seconds):
    return NOW - dt.timedelta(seconds=seconds)


def observation(k, source, **other):
    at = ago(1)
    row = {"k": k, "source": source, "instrument_id": "I", "entitlement": "VERIFIED", "delayed": False, "source_ts": at, "received_ts": at, "bid": 6399.875, "ask": 6400.125, "bid_size": 10, "ask_size": 12}
    row |= {f"{c}_ts": at for c in ("bid", "ask", "bid_size", "ask_size")}
    row |= other
    return tuple(row[c.split()[0]] for c in OBSERVATION.split(", "))


def test_quote_quality(spark):
    cases = {
        1: ({}, "GREEN", []), 2: ({"bid_ts": ago(3)}, "AMBER", []), 3: ({"bid_ts": ago(6)}, "RED", ["B:BID_STALE"]), 4: ({"delayed": None}, "RED", ["B:DELAY_STATUS_UNKNOWN"]),
        5: ({"bid": 6401.0, "ask": 6401.25}, "RED", ["DUAL_SOURCE_CONFLICT"]), 6: ({"bid_size": 0}, "RED", ["B:EMPTY_QUOTE_SIZE"]), 7: ({"bid": None}, "RED", ["B:MISSING_BID"]), 8: ({"ask": 6399.0}, "RED", ["B:CROSSED_QUOTE"]),
        9: ({"instrument_id": "J"}, "RED", ["INSTRUMENT_MISMATCH"]), 10: ({"source": "A"}, "RED", ["DUPLICATE_SOURCE", "SECOND_SOURCE_MISSING"]), 11: ({"entitlement": "UNVERIFIED"}, "RED", ["B:ENTITLEMENT_UNVERIFIED"]),
        12: ({"received_ts": ago(-1), "bid_ts": ago(1)}, "RED", ["B:RECEIVE_LATENCY_EXCEEDED", "B:received_ts:FUTURE_TIMESTAMP"]), 13: ({"ask_ts": None}, "RED", ["B:MISSING_ASK_TIMESTAMP"]), 14: ({"ask_size": -1}, "RED", ["B:NEGATIVE_QUOTE_VALUE"]),
        15: ({"source_ts": ago(0.5)}, "RED", ["B:RECEIVED_BEFORE_SOURCE"]), 16: ({"bid": 6400.0, "ask": 6400.5}, "GREEN", []), 17: ({"delayed": True}, "RED", ["B:DELAYED"]), 18: ({"bid_ts": ago(0.5)}, "RED", ["B:BID_AFTER_RECEIPT"]),
    }
    rows = [r for k, (other, _, _) in cases.items() for r in (observation(k, "A"), observation(k, other.get("source", "B"), **{x: v for x, v in other.items() if x != "source"}))]
    df = spark.createDataFrame(rows, OBSERVATION)
    got = {r.k: r for r in quality.evaluate_quotes(df, ["k"], F.lit(NOW), POLICY, expected=spark.range(1, 20).select(F.col("id").cast("int").alias("k"))).collect()}
    for k, (_, status, reasons) in cases.items():
        assert (got[k].status, got[k].reasons) == (status, reasons), k
        assert got[k].freeze == (status == "RED")
    assert got[2].stale_fields == ["B:bid"] and got[1].sources == ["A", "B"] and got[19].reasons == ["NO_SOURCES", "SECOND_SOURCE_MISSING"]
    with pytest.raises(ValueError):
        quality.QualityPolicy(5, 2, 1, 0.5)


def test_snapshot_forgets_what_was_before_a_lost_connection(spark):
    rows = [("p", "A", 1, "QUOTE", 1.0), ("p", "B", 2, "QUOTE", 2.0), ("p", None, 3, "CONNECTION_LOST", None), ("p", "A", 4, "QUOTE", 4.0), ("p", "A", 5, "QUOTE", 5.0), ("q", "A", 1, "QUOTE", 9.0)]
    got = quality.quality_snapshot(spark.createDataFrame(rows, "provider string, source string, seq int, kind string, v double"), ["provider"], "seq").collect()
    assert sorted((r.provider, r.source, r.v) for r in got) == [("p", "A", 5.0), ("q", "A", 9.0)]


def test_nine_gates_in_order(spark):
    names = ["data_quality", "contract_matches", "event_cleared", "unscheduled_shock", "option_chain_usable", "tail_expanding", "next_event_in_holding", "edge_ok", "risk_budget_ok"]
    fine = ["GREEN", True, True, False, True, False, False, True, True]
    bad = ["RED", False, False, True, False, True, True, False, False]
    want = ["STALE_MARKET_DATA", "CONTRACT_MISMATCH", "EVENT_PENDING", "UNSCHEDULED_SHOCK", "OPTION_CHAIN_UNUSABLE", "TAIL_EXPANDING", "NEXT_EVENT_TOO_CLOSE", "NEGATIVE_EDGE", "RISK_BUDGET_EXCEEDED"]
    rows = [(0, *fine), (1, *bad), (2, *([None] * 9))] + [(3 + i, *[b if i == j else f for j, (f, b) in enumerate(zip(fine, bad, strict=True))]) for i in range(9)]
    df = spark.createDataFrame(rows, "k int, " + ", ".join(f"{n} {'string' if n == 'data_quality' else 'boolean'}" for n in names))
    got = {r.k: r for r in gates.decide(df, F.lit("out"), F.when(F.col("k") == 0, F.lit("m2")), F.lit("m1")).collect()}
    assert got[0].reasons == ["MODEL_VERSION_NOT_LOADED"] and got[0].action == "NO_TRADE" and got[1].reasons == got[2].reasons == want
    assert [got[3 + i].reasons for i in range(9)] == [[w] for w in want]
    free = gates.decide(df.where("k = 0"), F.lit("out")).first()
    assert (free.action, free.output, free.reasons) == ("WAIT", "out", [])


def test_promotion_thresholds_and_missing_slices(spark):
    c = gates.PromotionCriteria(100, 0.05, 0.10, 500.0, 1000.0, 0.0)
    fine = (100, 0.05, 0.10, 500.0, 1000.0, 0.0)
    rows = [("e", "ok", *fine), ("e", "bad", 99, 0.06, 0.2, 501.0, 1001.0, -0.1), ("e", "null", *([None] * 6)), ("e", "unasked", *fine)]
    ev = spark.createDataFrame(rows, "event_type string, regime string, sample_count int, expiry_cross_rate double, touch_rate double, cvar double, maximum_drawdown double, no_trade_pnl_difference double")
    need = spark.createDataFrame([("e", r) for r in ("ok", "bad", "null", "gone")], "event_type string, regime string")
    got = {r.regime: r for r in gates.promotion_gate(need, ev, c).collect()}
    every = ["INSUFFICIENT_SAMPLES", "EXPIRY_CROSS_EXCEEDED", "TOUCH_RATE_EXCEEDED", "CVAR_EXCEEDED", "DRAWDOWN_EXCEEDED", "NO_TRADE_EFFECT_BELOW_MINIMUM"]
    assert len(got) == 4 and got["ok"].passed and got["bad"].failures == got["null"].failures == every and got["gone"].failures == ["MISSING_SLICE"]


LEG = "k int, leg_id string, quantity int, multiplier double, bid double, ask double, bid_size int, ask_size int, quoted_at timestamp"


def test_conservative_execution(spark):
    a = execution.Assumptions(max_quote_age=2, fee=0.5, slippage=0.05, participation=0.5)
    leg = lambda k, i, q, **o: tuple(({"k": k, "leg_id": i, "quantity": q, "multiplier": 100.0, "bid": 1.0, "ask": 1.2, "bid_size": 10, "ask_size": 10, "quoted_at": ago(1)} | o).values())
    rows = [
        leg(1, "a", -2), leg(1, "b", 1, bid=0.4, ask=0.5), leg(2, "a", 1, quoted_at=ago(3)), leg(2, "b", 1, quoted_at=ago(-1)), leg(3, "a", 1, ask_size=None), leg(3, "b", -11), leg(4, "a", 6), leg(5, "a", -1, bid=0.0), leg(6, "a", 5),
    ]
    legs = spark.createDataFrame(rows, LEG)
    got = {r.k: r for r in execution.value_execution(legs, ["k"], F.lit(NOW), a, expected=spark.createDataFrame([(i,) for i in range(1, 8)], "k int")).collect()}
    # Sells two at 0.95, buys one at 0.55: 190 - 55 gross, three fees.
    assert got[1].gross == pytest.approx(135.0) and got[1].fees == 1.5 and got[1].net == got[1].net_credit == pytest.approx(133.5) and got[1].half_spread_cost == pytest.approx(25.0)
    assert [got[k].failures for k in (2, 3, 4, 5, 6, 7)] == [["QUOTE_IN_FUTURE", "STALE_NBBO"], ["INSUFFICIENT_SIZE", "MISSING_SIZE"], ["LIQUIDITY_LIMIT"], ["INVALID_NBBO"], [], ["MISSING_LEGS"]]
    assert got[6].net_credit == 0.0 and got[4].net is None
    opening = legs.where("k = 1")
    marks = opening.crossJoin(spark.createDataFrame([(1,), (2,)], "m int")).select("k", "leg_id", "quantity", "multiplier", "bid", (F.col("ask") + F.col("m")).alias("ask"), "bid_size", "ask_size", "quoted_at", (F.lit(NOW) + F.expr("INTERVAL 1 SECOND")).alias("at"), "m")
    path = execution.executable_pnl(opening, marks.where("m = 1").drop("m"), ["k"], "at", F.lit(NOW), a)
    # Closing buys two at 2.25 and sells one at 0.35: -450 + 35 - 1.5.
    assert path.first().pnl == pytest.approx(133.5 - 416.5) and execution.pnl_path(path, ["k"]).first().maximum_mtm_loss == pytest.approx(283.0)
    short = execution.executable_pnl(opening, marks.where("m = 1 AND leg_id = 'a'").drop("m"), ["k"], "at", F.lit(NOW), a)
    assert short.first().pnl is None and execution.pnl_path(short, ["k"]).first().maximum_mtm_loss is None


def test_positions_are_dealt_out_once(spark):
    own = spark.newSession()
    for k, v in {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}.items():
        own.conf.set(k, v)
    plan = lambda name: rule_queries.QUERIES[name][0](own, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    path, opening = plan("execution_pnl_path"), plan("execution_opening")
    dealt = [line.strip(" +-:") for line in path.splitlines() if "Exchange" in line.split("[")[0]]
    assert sorted(line.split()[0] for line in dealt) == ["Exchange", "ReusedExchange"]
    # Each of the two sides has one aggregation with sets, partial and final; fills alone have none.
    assert path.count("ObjectHashAggregate") == 4 and "ObjectHashAggregate" not in opening


def test_marks_need_exactly_the_legs_of_the_opening(spark):
    a = execution.Assumptions(60.0, 0.0, 0.0)
    row = lambda k, i, q, m=100.0, at=None: (k, i, q, m, 1.0, 1.0, 9, 9, NOW, at)
    mark = NOW + dt.timedelta(seconds=1)
    opening = spark.createDataFrame([row(1, "a", 1), row(1, "b", -1), row(2, "a", 1), row(3, "a", 1), row(4, "a", 1), row(4, "a", 1), row(5, "a", 20), row(None, "a", 1)], LEG + ", at timestamp").drop("at")
    # 1 in another order; 2 and 3 with another quantity or multiplier, as many legs; 4 twice on both sides; 5 doesn't fill; 6 was never opened; no key or mark, no row.
    closing = [row(1, "b", -1, at=mark), row(1, "a", 1, at=mark), row(2, "a", 2, at=mark), row(3, "a", 1, 10.0, at=mark), row(4, "a", 1, at=mark), row(4, "a", 1, at=mark), row(5, "a", 20, at=mark), row(6, "a", 1, at=mark), row(None, "a", 1, at=mark), row(1, "a", 1)]
    closing = spark.createDataFrame(closing, LEG + ", at timestamp")
    got = execution.executable_pnl(opening, closing, ["k"], "at", F.lit(NOW), a, unique=False).collect()
    assert sorted((r.k, r.pnl) for r in got) == [(1, 0.0), (2, None), (3, None), (4, 0.0), (5, None), (6, None)]
    with pytest.raises(Exception, match="leg_id values must be unique"):
        execution.executable_pnl(opening, closing, ["k"], "at", F.lit(NOW), a).collect()


def test_calendars(spark):
    c = calendar.EquityCalendar(dt.date(2026, 1, 1), dt.date(2026, 12, 31), frozenset({dt.date(2026, 12, 25)}), {dt.date(2026, 11, 27): dt.time(13)})
    days = ["2026-08-15", "2027-01-04", "2026-12-25", "2026-11-27", "2026-07-06", "2026-03-06"]
    got = spark.createDataFrame([(d,) for d in days], "d string").select("d", c.session(F.to_date("d")).alias("s")).collect()
    assert [r.s.status for r in got] == ["WEEKEND", "UNVERIFIED", "HOLIDAY", "TRADING_DAY", "TRADING_DAY", "TRADING_DAY"]
    text = lambda t: t.strftime("%H:%M:%S")
    assert [(text(r.s.opens_at), text(r.s.preopen_cutoff_at), text(r.s.closes_at), r.s.is_early_close) for r in got[3:]] == [("14:30:00", "14:29:59", "18:00:00", True), ("13:30:00", "13:29:59", "20:00:00", False), ("14:30:00", "14:29:59", "21:00:00", False)]
    assert got[0].s.opens_at is None and got[3].s.anchor_at == got[3].s.closes_at
    f = calendar.FuturesCalendar(dt.date(2026, 1, 1), dt.date(2026, 12, 31), frozenset({dt.date(2026, 7, 3)}))
    at = {"2026-07-06 20:59:59": "OPEN", "2026-07-06 21:00:00": "MAINTENANCE", "2026-07-06 22:00:00": "OPEN", "2026-07-10 21:00:00": "CLOSED", "2026-07-12 21:59:59": "CLOSED", "2026-07-12 22:00:00": "OPEN", "2026-07-11 12:00:00": "CLOSED", "2026-07-03 12:00:00": "CLOSED", "2027-01-05 12:00:00": "UNVERIFIED"}
    got = {r.t: r.s for r in spark.createDataFrame([(t,) for t in at], "t string").select("t", f.state_at(F.to_timestamp("t")).alias("s")).collect()}
    assert got == at
    states = {"2026-07-06 13:29:59": "CLOSED", "2026-07-06 13:30:00": "OPEN", "2026-07-06 20:00:00": "OPEN", "2026-07-06 20:00:01": "CLOSED", "2026-11-27 18:00:01": "CLOSED", "2026-12-25 16:00:00": "HOLIDAY"}
    got = {r.t: r.s for r in spark.createDataFrame([(t,) for t in states], "t string").select("t", c.state_at(F.to_timestamp("t")).alias("s")).collect()}
    assert got == states
    window = spark.range(1).select(calendar.day_window(F.lit("2026-03-08").cast("date")).alias("w")).first().w
    assert (window.end - window.start).total_seconds() == 23 * 3600
    for bad in ({"holidays": frozenset({dt.date(2026, 8, 15)})}, {"early_closes": {dt.date(2026, 11, 27): dt.time(16)}}, {"holidays": frozenset({dt.date(2027, 1, 4)})}):
        with pytest.raises(ValueError):
            calendar.EquityCalendar(dt.date(2026, 1, 1), dt.date(2026, 12, 31), **bad)


def test_delivery(spark):
    p = delivery.ChannelPolicy(base=1, most=4, max_attempts=3, ack_timeout=1, max_escalations=1)
    rows = [
        ("new", 1, "ENQUEUED", 0.0, None, None), ("later", 1, "ENQUEUED", 99.0, None, None), ("retry", 1, "ENQUEUED", 0.0, None, None), ("retry", 2, "ATTEMPTED", 0.0, None, None), ("retry", 3, "RETRY_SCHEDULED", 0.0, 1.0, None),
        ("sent", 1, "ENQUEUED", 0.0, None, None), ("sent", 2, "DELIVERED", 1.0, None, 2.0), ("up", 1, "DELIVERED", 1.0, None, 2.0), ("up", 2, "ESCALATED", 3.0, None, None), ("up", 3, "DELIVERED", 4.0, None, 5.0), ("done", 1, "DELIVERED", 1.0, None, 2.0), ("done", 2, "ACKNOWLEDGED", 1.5, None, None),
        ("wait", 1, "DELIVERED", 1.0, None, 2.0), ("wait", 2, "ESCALATED", 3.0, None, None), ("wait", 3, "RETRY_SCHEDULED", 3.0, 3.0, None),
    ]
    state = delivery.message_state(spark.createDataFrame(rows, "message_id string, seq int, kind string, recorded_at double, next_attempt_at double, ack_due_at double"))
    outcomes = spark.createDataFrame([("new", "SENT", None), ("wait", "PERMANENT_FAILURE", "GONE")], "message_id string, outcome string, reason string")
    got = {r.message_id: (r.kind, r.attempt_number, r.next_attempt_at, r.ack_due_at, r.reason_code) for r in delivery.dispatched(state, outcomes, F.lit(10.0), p).collect()}
    assert got == {"new": ("DELIVERED", 1, None, 11.0, None), "retry": ("RETRY_SCHEDULED", 3, 12.0, None, "TRANSIENT_FAILURE"), "wait": ("DEAD_LETTERED", 1, None, None, "GONE")}
    off = delivery.dispatched(state, outcomes, F.lit(10.0), delivery.ChannelPolicy(enabled=False)).collect()
    assert {r.kind for r in off} == {"DELIVERY_DISABLED"}
    up = sorted((r.message_id, r.kind, r.escalation_level) for r in delivery.escalations(state, F.lit(10.0), p).collect())
    assert up == [("sent", "ESCALATED", 1), ("sent", "RETRY_SCHEDULED", 1), ("up", "DEAD_LETTERED", 1)]
    requests = [("sent", "x", 3.0), ("sent", "y", 2.0), ("sent", "z", 0.5), ("done", "x", 9.0), ("new", "x", 9.0), ("none", "x", 9.0), ("sent", " ", 9.0)]
    acks = {(r.message_id, r.actor): r.outcome for r in delivery.acknowledgements(state, spark.createDataFrame(requests, "message_id string, actor string, at double")).collect()}
    assert acks == {("sent", "x"): "REPEATED", ("sent", "y"): "ACKNOWLEDGED", ("sent", "z"): "BEFORE_DELIVERY", ("done", "x"): "REPEATED", ("new", "x"): "NOT_DELIVERED", ("none", "x"): "UNKNOWN_MESSAGE", ("sent", " "): "NO_ACTOR"}
    faults = spark.createDataFrame([("0",), ("7",), ("8",), ("07",), ("-1",), (None,)], "c string").select(delivery.cursor_fault(F.col("c"), F.lit(7)).alias("f")).collect()
    assert [r.f for r in faults] == [None, None, "BEYOND_END", "NOT_CANONICAL", "NOT_CANONICAL", None]
    long = spark.createDataFrame([("9" * 32,), ("1" + "0" * 400,), ("12",), ("99",)], "c string").select(delivery.cursor_fault(F.col("c"), F.lit(12)).alias("f")).collect()
    assert [r.f for r in long] == ["BEYOND_END", "BEYOND_END", None, "BEYOND_END"]


def test_capabilities_fees_repeated_legs_and_order(spark):
    rows = [(True, "VERIFIED", True, "GREEN"), (False, "PENDING", None, "AMBER"), (None, None, None, None)]
    every = ["CAPABILITY_NOT_CONFIGURED", "CAPABILITY_UNVERIFIED", "CAPABILITY_NOT_PRODUCTION_READY", "CAPABILITY_QUALITY_NOT_GREEN"]
    got = spark.createDataFrame(rows, "configured boolean, verification_status string, production_ready boolean, quality string").select(quality.capability_reasons().alias("r")).collect()
    assert [r.r for r in got] == [[], every, every]
    assert market.round_trip_fees(2, 0.65, 0.05, fixed=1.0) == pytest.approx(2 * (8 * 0.7 + 1.0))
    legs = spark.createDataFrame([(1, 7, 1, 100, 1.0, 1.2, 9, 9, NOW), (1, 7, -1, 100, 1.0, 1.2, 9, 9, NOW)], "k int, leg_id int, quantity int, multiplier int, bid double, ask double, bid_size int, ask_size int, quoted_at timestamp")
    a = execution.Assumptions(60.0, 0.0, 0.0)
    with pytest.raises(Exception, match="leg_id values must be unique"):
        execution.value_execution(legs, ["k"], F.lit(NOW), a).collect()
    assert execution.value_execution(legs.drop("leg_id"), ["k"], F.lit(NOW), a).first().executable
    bars = spark.createDataFrame([("d", i, t, 1.0, 2.0, 0.5, 1.5, 1.0) for i, t in enumerate((1, 3, 2))], "day string, seq int, ts int, open double, high double, low double, close double, volume double")
    quotes = spark.createDataFrame([("d", i, t, "x" * 21, 1.0, 2.0, 1, 1) for i, t in enumerate((1, 1, 2))], "day string, seq int, ts int, symbol string, bid double, ask double, bid_size int, ask_size int")
    days = spark.createDataFrame([("d",)], "day string")
    assert quality.day_violations(bars, quotes, days).first().reasons == []
    assert quality.day_violations(bars, quotes, days, order="seq").first().reasons == ["BARS_OUT_OF_ORDER"]


def test_risk_lock_and_timeline(spark):
    shape = "id int, scheduled_at timestamp, source_published_at timestamp, first_seen_at timestamp, confirmed_at timestamp, cross_asset_confirmed boolean, cross_asset_confirmed_at timestamp, stable_since timestamp, session_close_at timestamp, next_cash_open_at timestamp, contradictory_evidence boolean, corroborating_sources int, stable_observations int"
    event = lambda i, **o: tuple(({"id": i, "scheduled_at": ago(600), "p": ago(600), "first": ago(590), "confirmed_at": ago(500), "x": True, "cross_asset_confirmed_at": ago(400), "stable_since": ago(120), "close": None, "open": None, "contra": False, "sources": 2, "stable": 3} | o).values())
    rows = [event(1), event(2, stable_since=ago(119)), event(3, contra=True, sources=1), event(4, stable_since=None, stable=2), event(5, first=ago(-1)), event(6, x=False, cross_asset_confirmed_at=None, confirmed_at=ago(-5)), event(7, scheduled_at=ago(9999), open=ago(100))]
    df = spark.createDataFrame(rows, shape)
    got = {r.id: r.r for r in df.select("id", gates.risk_lock(F.lit(NOW)).alias("r")).collect()}
    assert [(got[i].state, got[i].reasons) for i in range(1, 7)] == [
        ("CLEARED", ["EVENT_STABLE"]), ("STABILIZING", ["STABILITY_WINDOW_INCOMPLETE"]), ("LOCKED", ["CONTRADICTORY_EVIDENCE", "INSUFFICIENT_CORROBORATION"]),
        ("STABILIZING", ["STABILITY_WINDOW_NOT_STARTED", "INSUFFICIENT_STABLE_OBSERVATIONS"]), ("NOT_VISIBLE", []), ("LOCKED", ["EVENT_NOT_CONFIRMED", "CROSS_ASSET_NOT_CONFIRMED"]),
    ]
    assert got[1].next_checkpoint == "T+15m" and got[7].next_checkpoint == "MONITORING_COMPLETE" and got[2].rerun_at == ago(-1)
    late = {r.id: r.v for r in df.select("id", gates.timeline_violations().alias("v")).collect()}
    assert late[1] == [] and late[5] == ["CONFIRMED_BEFORE_SEEN", "CROSS_ASSET_BEFORE_SEEN"]


def test_contracts_and_reviews(spark):
    rows = [("esu6", "2026-09-18"), ("ES", "2026-09-18"), ("ESU5", "2026-09-18"), ("ESZ6", "2026-09-18"), ("ESU2026", "2026-09-18"), ("NQU6", "2026-09-18"), (None, "2026-09-18")]
    got = spark.createDataFrame(rows, "symbol string, expiry string").withColumn("expiry", F.to_date("expiry")).select(gates.contract_violations().alias("v")).collect()
    assert [r.v for r in got] == [[], ["CONTINUOUS_CONTRACT"], ["YEAR_MISMATCH"], ["MONTH_MISMATCH"], [], ["NOT_EXPLICIT"], ["CONTINUOUS_CONTRACT", "NOT_EXPLICIT"]]
    reviews = spark.createDataFrame([("r", 1, "IN_REVIEW"), ("r", 2, "OPEN"), ("r", 3, "CONFIRMED"), ("r", 4, "REJECTED")], "k string, seq int, status string")
    assert [r.refusal for r in gates.review_transitions(reviews, "k", "seq", "status").orderBy("seq").collect()] == [None, "RETURNS_TO_OPEN", None, "REVIEW_IS_TERMINAL"]


def test_governance(spark):
    v = spark.createDataFrame([("m", "1", None, 1), ("m", "2", "1", 2), ("m", "2", "1", 3), ("m", "3", "9", 4)], "model_id string, version string, parent_version string, seq int")
    assert [r.fault for r in governance.registration_faults(v).orderBy("seq").collect()] == [None, None, "ALREADY_REGISTERED", "UNKNOWN_PARENT"]
    events = spark.createDataFrame([("m", 1, "1"), ("m", 2, "2"), ("m", 3, "1")], "model_id string, seq int, target_version string")
    now = governance.champions(events)
    assert [tuple(r) for r in now.collect()] == [("m", "1")]
    asked = spark.createDataFrame([("m", "s"), ("m", "t"), ("x", "s")], "model_id string, session_id string")
    frozen = spark.createDataFrame([("m", "s", 2, "2"), ("m", "s", 3, "1")], "model_id string, session_id string, seq int, version string")
    got = {(r.model_id, r.session_id): (r.version, r.frozen) for r in governance.session_champions(asked, frozen, now).collect()}
    assert got == {("m", "s"): ("2", True), ("m", "t"): ("1", False), ("x", "s"): (None, False)}


def test_scalars(spark):
    key, one = b"k" * 100, spark.createDataFrame([("payload é", '{"b": [{"c": 1}, {"d": 2}], "a": {"x": null}}')], "s string, j string")
    r = one.select(scalars.hmac_sha256(F.col("s"), key).alias("h"), scalars.hmac_sha256(F.col("s"), b"k").alias("g"), scalars.json_paths()(F.col("j")).alias("p"), scalars.run_id("s").alias("i")).first()
    assert r.h == "hmac-sha256:" + hmac.new(key, "payload é".encode(), hashlib.sha256).hexdigest() and r.g == "hmac-sha256:" + hmac.new(b"k", "payload é".encode(), hashlib.sha256).hexdigest()
    assert r.p == ["a", "a.x", "b", "b[]", "b[].c"] and len(r.i) == 36 and scalars.verify_signature("payload é".encode(), r.g, b"k")
    sealed = one.select(scalars.seal(F.encode("s", "UTF-8"), F.lit(b"0123456789abcdef"), F.lit("ctx")).alias("x"))
    opened = sealed.select(*(F.decode(scalars.unseal(F.col("x"), F.lit(b"0123456789abcdef"), F.lit(c)), "UTF-8").alias(c) for c in ("ctx", "other"))).first()
    assert opened.ctx == "payload é" and opened.other is None
    got = spark.range(1).select(scalars.max_loss_dollars(F.lit(5.0), F.lit(1.8)).alias("a"), scalars.max_loss_dollars(F.lit(5.0), F.lit(5.0)).alias("b"), scalars.implied_index(F.lit(6400.0), F.lit(6464.0), F.lit(6400.0)).alias("c"), scalars.backoff_seconds(F.lit(4), 1, 4).alias("d")).first()
    assert got.a == pytest.approx(320.0) and got.b is None and got.c == pytest.approx(6464.0) and got.d == 4.0
