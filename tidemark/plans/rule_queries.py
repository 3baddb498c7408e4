"""Rule sets on the driver's tables. The tables hold no quotes, events or approvals of a trading desk, so each query stages the
columns of its rule set from keys (by remainders), with every rule broken somewhere; the oracle restates the rules in SQL."""

from __future__ import annotations

from datetime import date, time

from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.operators import calendar, delivery, execution, gates, governance, quality
from tidemark.session import table

_NOW = "TIMESTAMP '2024-01-02 12:00:00'"
#: Staged inputs, in SQL that Spark and DuckDB both run.
STAGED = {
    "observations": ("events", f"""
        SELECT CAST(floor(event_id / 3.0) AS BIGINT) AS g, CASE WHEN event_id % 3 = 0 THEN 'A' WHEN event_id % 3 = 1 THEN 'B' WHEN event_id % 21 = 2 THEN 'A' ELSE 'C' END AS source,
          CASE WHEN event_id % 29 = 0 THEN 'X' ELSE 'I' END AS instrument_id, CASE WHEN event_id % 61 = 0 THEN 'UNKNOWN' WHEN event_id % 67 = 0 THEN NULL ELSE 'VERIFIED' END AS entitlement,
          CASE WHEN event_id % 71 = 0 THEN NULL ELSE event_id % 73 = 0 END AS delayed,
          {_NOW} - CAST(event_id % 7 AS INTEGER) * INTERVAL '1' SECOND AS source_ts,
          {_NOW} - CAST(event_id % 7 - 1 - CASE WHEN event_id % 43 = 0 THEN 3 ELSE 0 END + CASE WHEN event_id % 47 = 0 THEN 2 ELSE 0 END AS INTEGER) * INTERVAL '1' SECOND AS received_ts,
          CASE WHEN event_id % 53 = 0 THEN NULL WHEN event_id % 59 = 0 THEN -1.0 ELSE 100 + event_id % 3 * 0.25 END AS bid, CASE WHEN event_id % 79 = 0 THEN 90.0 ELSE 101 + event_id % 3 * 0.25 END AS ask,
          CASE WHEN event_id % 83 = 0 THEN 0 ELSE 10 END AS bid_size, CASE WHEN event_id % 89 = 0 THEN NULL ELSE 12 END AS ask_size,
          CASE WHEN event_id % 97 = 0 THEN NULL ELSE {_NOW} - CAST(event_id % 7 AS INTEGER) * INTERVAL '1' SECOND END AS bid_ts, {_NOW} - CAST(event_id % 11 - 1 AS INTEGER) * INTERVAL '1' SECOND AS ask_ts,
          {_NOW} - INTERVAL '1' SECOND AS bid_size_ts, {_NOW} - INTERVAL '1' SECOND AS ask_size_ts
        FROM events"""),
    "gates": ("orders", """
        SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'RED' WHEN o_orderkey % 31 = 0 THEN NULL ELSE 'GREEN' END AS data_quality, o_orderkey % 7 <> 0 AS contract_matches,
          CASE WHEN o_orderkey % 37 = 0 THEN NULL ELSE o_orderkey % 11 <> 0 END AS event_cleared, o_orderkey % 13 = 0 AS unscheduled_shock, o_orderkey % 17 <> 0 AS option_chain_usable, o_orderkey % 19 = 0 AS tail_expanding,
          o_orderkey % 23 = 0 AS next_event_in_holding, o_orderkey % 29 <> 0 AS edge_ok, o_totalprice < 400000 AS risk_budget_ok, 'm' || CAST(o_orderkey % 2 AS VARCHAR(1)) AS loaded, o_totalprice AS price
        FROM orders"""),
    "risk_events": ("orders", """
        SELECT o_orderkey, o_orderdate AS source_published_at, o_orderdate + CAST(o_orderkey % 9 - 1 AS INTEGER) * INTERVAL '1' MINUTE AS first_seen_at,
          CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderdate + CAST(o_orderkey % 50 AS INTEGER) * INTERVAL '1' MINUTE END AS confirmed_at,
          o_orderkey % 3 <> 0 OR o_orderkey % 41 = 0 AS cross_asset_confirmed, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate + CAST(o_orderkey % 60 AS INTEGER) * INTERVAL '1' MINUTE END AS cross_asset_confirmed_at,
          CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderdate + CAST(o_orderkey % 70 AS INTEGER) * INTERVAL '1' MINUTE END AS stable_since, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderdate + INTERVAL '6' HOUR END AS session_close_at,
          CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE o_orderdate + CAST(o_orderkey % 24 AS INTEGER) * INTERVAL '1' HOUR END AS next_cash_open_at, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate + INTERVAL '10' MINUTE ELSE NULL END AS scheduled_at,
          o_orderkey % 17 = 0 AS contradictory_evidence, CAST(o_orderkey % 4 AS INTEGER) AS corroborating_sources, CAST(o_orderkey % 6 AS INTEGER) AS stable_observations,
          o_orderdate + CAST(o_orderkey % 100 AS INTEGER) * INTERVAL '1' MINUTE AS as_of
        FROM orders"""),
    "legs": ("lineitem", f"""
        SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS leg_id, CAST(CASE WHEN l_returnflag = 'R' THEN -(l_partkey % 3 + 1) ELSE l_partkey % 3 + 1 END AS BIGINT) AS quantity, CAST(100 AS BIGINT) AS multiplier,
          CAST(l_suppkey % 50 AS DOUBLE) / 8 AS bid, CAST(l_suppkey % 50 AS DOUBLE) / 8 + CAST(l_partkey % 4 AS DOUBLE) / 8 AS ask, CASE WHEN l_partkey % 41 = 0 THEN NULL ELSE l_partkey % 7 + 2 END AS bid_size,
          CASE WHEN l_partkey % 43 = 0 THEN NULL ELSE l_partkey % 8 + 2 END AS ask_size, {_NOW} - CAST(l_suppkey % 14 - 1 AS INTEGER) * INTERVAL '200' MILLISECOND AS quoted_at
        FROM lineitem"""),
    "sessions": ("orders", """
        SELECT o_custkey % 25 AS k, o_orderdate AS started_at, o_orderdate + INTERVAL '6' HOUR AS ended_at, CAST(o_orderdate AS DATE) AS trading_date, 'v' || CAST(o_orderkey % 7 AS VARCHAR(1)) AS code_version, o_orderkey % 3 <> 0 AS audit_passed,
          CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'ESU6' END AS contract, o_orderkey % 4 AS n_capability_reports, o_orderkey % 6 AS n_decisions, o_orderkey % 211 = 1 AS degradation_drill, o_orderkey % 97 = 1 AS recovery_drill
        FROM orders"""),
    "symbols": ("customer", """
        SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN ' es ' WHEN c_custkey % 13 = 0 THEN 'ES-main' WHEN c_custkey % 17 = 0 THEN NULL WHEN c_custkey % 19 = 0 THEN 'NQU6' WHEN c_custkey % 3 = 0 THEN 'esu6' WHEN c_custkey % 3 = 1 THEN 'ESZ2026' ELSE 'ESH7' END AS symbol,
          CASE WHEN c_custkey % 2 = 0 THEN DATE '2026-09-18' WHEN c_custkey % 5 = 0 THEN DATE '2027-03-19' ELSE DATE '2026-12-18' END AS expiry, CASE WHEN c_custkey % 7 = 0 THEN '-bad' ELSE c_name END AS identifier,
          CASE WHEN c_custkey % 4 = 0 THEN 'LIVE' WHEN c_custkey % 23 = 0 THEN 'OTHER' ELSE 'SCENARIO' END AS mode, c_custkey % 8 = 0 AS has_gates, c_custkey % 12 = 0 AS has_values, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE DATE '2026-01-05' END AS as_of
        FROM customer"""),
}


def staged(spark, sf_dir, name):
    source, sql = STAGED[name]
    return spark.sql(sql.replace(f"FROM {source}", "FROM {src}"), src=table(spark, sf_dir, source))


def _with(name: str, sql: str) -> str:
    return f"WITH {name} AS ({STAGED[name][1]}){sql}"


_joined = lambda c: F.array_join(c, ",")
_now = lambda: F.expr(f"{_NOW}")
_list = lambda *cases: "list_filter([" + ", ".join(f"CASE WHEN {c} THEN {n if n.startswith('(') else repr(n)} END" for c, n in cases) + "], lambda x: x IS NOT NULL)"


def feed_quality(spark, sf_dir):
    """Every three events are the observations of one instrument: all quote-quality rules, the status, and the freeze."""
    policy = quality.QualityPolicy(green_max_age=3.0, amber_max_age=5.0, max_receive_latency=1.5, conflict_absolute=0.30, conflict_relative=0.0001)
    found = quality.evaluate_quotes(staged(spark, sf_dir, "observations"), ["g"], _now(), policy)
    return found.select("g", "status", "freeze", *(_joined(c).alias(c) for c in ("reasons", "stale_fields", "sources")))


_age = lambda c: f"((epoch_us({_NOW}) - epoch_us({c})) / 1e6)"
_fields = ("bid", "ask", "bid_size", "ask_size")
_code = lambda s: f"(source || ':{s}')"
_OBSERVED = _list(
    ("coalesce(entitlement, 'UNKNOWN') <> 'VERIFIED'", "(source || ':ENTITLEMENT_' || coalesce(entitlement, 'UNKNOWN'))"), ("delayed IS NULL", _code("DELAY_STATUS_UNKNOWN")), ("delayed", _code("DELAYED")),
    ("received_ts < source_ts", _code("RECEIVED_BEFORE_SOURCE")), ("epoch_us(received_ts) - epoch_us(source_ts) > 1500000", _code("RECEIVE_LATENCY_EXCEEDED")),
    *(x for f in _fields for x in (
        (f"{f} IS NULL", _code(f"MISSING_{f.upper()}")), (f"{f}_ts IS NULL", _code(f"MISSING_{f.upper()}_TIMESTAMP")), (f"{f}_ts > received_ts", _code(f"{f.upper()}_AFTER_RECEIPT")),
        (f"{f}_ts > {_NOW}", _code(f"{f}:FUTURE_TIMESTAMP")), (f"{_age(f + '_ts')} > 5", _code(f"{f.upper()}_STALE")))),
    (f"source_ts > {_NOW}", _code("source_ts:FUTURE_TIMESTAMP")), (f"received_ts > {_NOW}", _code("received_ts:FUTURE_TIMESTAMP")), (f"greatest({_age('source_ts')}, {_age('received_ts')}) > 5", _code("OBSERVATION_STALE")),
    ("bid < 0 OR ask < 0 OR bid_size < 0 OR ask_size < 0", _code("NEGATIVE_QUOTE_VALUE")), ("bid_size = 0 OR ask_size = 0", _code("EMPTY_QUOTE_SIZE")), ("bid > ask", _code("CROSSED_QUOTE")),
)
_STALE = _list(*((f"{_age(f + '_ts')} > 3", f"(source || ':{f}')") for f in _fields))
_ALL_AGES = ", ".join(_age(c) for c in ("source_ts", "received_ts", *(f"{f}_ts" for f in _fields)))
FEED_QUALITY = _with("observations", f""", o AS (SELECT g, source, instrument_id, (bid + ask) / 2 AS mid, {_OBSERVED} AS r, {_STALE} AS s, coalesce(greatest({_ALL_AGES}) > 3, false) AS old FROM observations),
a AS (SELECT g, count(*) AS n, count(DISTINCT source) AS ns, list_sort(list_distinct(list(source))) AS sources, min(instrument_id) <> max(instrument_id) AS mixed, flatten(list(r)) AS r, flatten(list(s)) AS s, bool_or(old) AS old,
  coalesce(count(*) >= 2 AND count(mid) = count(*) AND max(mid) - min(mid) > greatest(0.30, abs(min(mid)) * 0.0001), false) AS conflict FROM o GROUP BY g),
b AS (SELECT *, list_sort(list_distinct(list_concat(r, {_list(("ns <> n", "DUPLICATE_SOURCE"), ("ns < 2", "SECOND_SOURCE_MISSING"), ("mixed", "INSTRUMENT_MISMATCH"), ("conflict", "DUAL_SOURCE_CONFLICT"))}))) AS reasons FROM a)
SELECT g, CASE WHEN len(reasons) > 0 THEN 'RED' WHEN old THEN 'AMBER' ELSE 'GREEN' END AS status, conflict OR len(reasons) > 0 AS freeze, array_to_string(reasons, ',') AS reasons,
  array_to_string(list_sort(list_distinct(s)), ',') AS stale_fields, array_to_string(sources, ',') AS sources FROM b""")


def feed_snapshot(spark, sf_dir):
    """Events as a provider's feed (event types): each user's last quote after the last lost connection."""
    e = table(spark, sf_dir, "events").select("event_type", F.col("user_id").alias("source"), "event_id", "value", F.when(F.col("event_id") % 997 == 0, "CONNECTION_LOST").when(F.col("event_id") % 101 == 0, "HEARTBEAT").otherwise("QUOTE").alias("kind"))
    return quality.quality_snapshot(e, ["event_type"], "event_id").select("event_type", "source", "event_id", "value")


FEED_SNAPSHOT = """WITH e AS (SELECT *, CASE WHEN event_id % 997 = 0 THEN 'L' WHEN event_id % 101 = 0 THEN 'H' ELSE 'Q' END AS kind FROM events), c AS (SELECT event_type, max(event_id) AS cleared FROM e WHERE kind = 'L' GROUP BY event_type)
SELECT event_type, user_id AS source, max(event_id) AS event_id, max_by(value, event_id) AS value FROM e LEFT JOIN c USING (event_type) WHERE kind = 'Q' AND event_id > coalesce(cleared, -1) GROUP BY event_type, user_id"""


def risk_gate_nine(spark, sf_dir):
    """All nine gates in order, the identity of the model, and the decision with its output."""
    rows = gates.decide(staged(spark, sf_dir, "gates"), F.col("price"), required_model=F.when(F.col("o_orderkey") % 3 == 0, F.lit("m1")), loaded_model=F.col("loaded"))
    return rows.select("o_orderkey", _joined("reasons").alias("reasons"), "action", "output")


_GATES = _list(
    ("data_quality = 'GREEN' IS NOT TRUE", "STALE_MARKET_DATA"), ("contract_matches IS NOT TRUE", "CONTRACT_MISMATCH"), ("event_cleared IS NOT TRUE", "EVENT_PENDING"), ("unscheduled_shock IS NOT FALSE", "UNSCHEDULED_SHOCK"),
    ("option_chain_usable IS NOT TRUE", "OPTION_CHAIN_UNUSABLE"), ("tail_expanding IS NOT FALSE", "TAIL_EXPANDING"), ("next_event_in_holding IS NOT FALSE", "NEXT_EVENT_TOO_CLOSE"), ("edge_ok IS NOT TRUE", "NEGATIVE_EDGE"),
    ("risk_budget_ok IS NOT TRUE", "RISK_BUDGET_EXCEEDED"), ("o_orderkey % 3 = 0 AND loaded <> 'm1'", "MODEL_VERSION_NOT_LOADED"),
)
RISK_GATE = _with("gates", f", r AS (SELECT *, {_GATES.replace('data_quality = ' + repr('GREEN') + ' IS NOT TRUE', '(data_quality = ' + repr('GREEN') + ') IS NOT TRUE')} AS w FROM gates) SELECT o_orderkey, array_to_string(w, ',') AS reasons, CASE WHEN len(w) > 0 THEN 'NO_TRADE' ELSE 'WAIT' END AS action, CASE WHEN len(w) = 0 THEN price END AS output FROM r")


def promotion_six_thresholds(spark, sf_dir):
    """Line status by return flag as slices: six thresholds and the missing slice."""
    cents = lambda e: F.sum(e).cast("double")
    li = table(spark, sf_dir, "lineitem")
    d = F.col("l_discount").cast("decimal(18,2)")
    evidence = li.groupBy(F.col("l_linestatus").alias("event_type"), F.col("l_returnflag").alias("regime")).agg(
        F.count("*").alias("sample_count"), (F.count_if(F.col("l_discount") > 0.085) / F.count("*")).alias("expiry_cross_rate"), (F.count_if(F.col("l_tax") > 0.045) / F.count("*")).alias("touch_rate"),
        (cents(d) * 100 / F.count("*")).alias("cvar"), F.max("l_quantity").cast("double").alias("maximum_drawdown"), F.min(F.col("l_discount") - 0.02).alias("no_trade_pnl_difference"),
    )
    required = spark.createDataFrame([(e, r) for e in "FO" for r in "ANRX"], "event_type string, regime string")
    found = gates.promotion_gate(required, evidence, gates.PromotionCriteria(min_samples=12000, max_cross_rate=0.09, max_touch_rate=0.45, max_cvar=5.0, max_drawdown=49.0, min_effect=0.0))
    return found.select("event_type", "regime", "sample_count", _joined("failures").alias("failures"), "passed")


_PROMOTION = _list(
    ("n IS NULL", "MISSING_SLICE"), ("n < 12000", "INSUFFICIENT_SAMPLES"), ("cross_rate > 0.09", "EXPIRY_CROSS_EXCEEDED"), ("touch > 0.45", "TOUCH_RATE_EXCEEDED"), ("cvar > 5.0", "CVAR_EXCEEDED"),
    ("dd > 49", "DRAWDOWN_EXCEEDED"), ("effect < 0", "NO_TRADE_EFFECT_BELOW_MINIMUM"),
)
PROMOTION_SIX = f"""WITH need AS (SELECT e.e AS event_type, r.r AS regime FROM (VALUES ('F'), ('O')) e(e), (VALUES ('A'), ('N'), ('R'), ('X')) r(r)),
ev AS (SELECT l_linestatus AS event_type, l_returnflag AS regime, count(*) AS n, count(*) FILTER (l_discount > 0.085) / count(*) AS cross_rate, count(*) FILTER (l_tax > 0.045) / count(*) AS touch,
  CAST(sum(CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) * 100 / count(*) AS cvar, max(l_quantity) AS dd, min(l_discount - 0.02) AS effect FROM lineitem GROUP BY 1, 2), j AS (SELECT *, {_PROMOTION} AS w FROM need LEFT JOIN ev USING (event_type, regime))
SELECT event_type, regime, n AS sample_count, array_to_string(w, ',') AS failures, len(w) = 0 AS passed FROM j"""


def readiness_evidence(spark, sf_dir):
    """Seven requirements of every nation against suppliers as evidence, with status and expiry."""
    need = table(spark, sf_dir, "nation").select("n_nationkey", F.explode(F.expr("sequence(0, 6)")).alias("requirement"))
    s = table(spark, sf_dir, "supplier")
    status = F.when(F.col("s_acctbal") < 0, "REVOKED").when(F.col("s_acctbal") < 1000, "PENDING").otherwise("VERIFIED")
    last = s.groupBy(F.col("s_nationkey").alias("n_nationkey"), (F.col("s_suppkey") % 9).cast("int").alias("requirement")).agg(F.max_by(F.struct(status.alias("status"), F.col("s_suppkey")), "s_suppkey").alias("e"))
    expires = F.when(F.col("e.s_suppkey") % 5 != 0, F.expr("date_add(DATE '2024-01-01', CAST(e.s_suppkey % 3 AS INT) - 1)"))
    found = gates.readiness(need, last.select("n_nationkey", "requirement", "e.status", expires.alias("expires_at")), ["n_nationkey", "requirement"], F.lit("2024-01-01").cast("date"))
    return found.select("n_nationkey", "requirement", "blocker")


READINESS_EVIDENCE = """WITH need AS (SELECT n_nationkey, CAST(range AS INTEGER) AS requirement FROM nation, range(7)),
s AS (SELECT s_nationkey AS n_nationkey, CAST(s_suppkey % 9 AS INTEGER) AS requirement, max(s_suppkey) AS k, max_by(CASE WHEN s_acctbal < 0 THEN 'REVOKED' WHEN s_acctbal < 1000 THEN 'PENDING' ELSE 'VERIFIED' END, s_suppkey) AS status FROM supplier GROUP BY 1, 2)
SELECT n_nationkey, requirement, CASE WHEN status IS NULL THEN 'EVIDENCE_MISSING' WHEN status <> 'VERIFIED' THEN 'EVIDENCE_' || status WHEN k % 5 = 0 OR k % 3 - 1 <= 0 THEN 'EVIDENCE_EXPIRED' END AS blocker FROM need LEFT JOIN s USING (n_nationkey, requirement)"""


def shadow_evidence(spark, sf_dir):
    found = gates.shadow_evidence(staged(spark, sf_dir, "sessions"), ["k"], F.expr("TIMESTAMP '1996-01-01 00:00:00'"), F.expr("TIMESTAMP '2001-01-01 00:00:00'"), F.lit("v1"), min_sessions=20, min_dates=20)
    return found.select("k", "recorded", "qualifying", "dates", "rejected_window", "other_code", "degradation", "recovery", _joined("blockers").alias("blockers"))


SHADOW = _with("sessions", f""", q AS (SELECT *, started_at < TIMESTAMP '1996-01-01' OR ended_at > TIMESTAMP '2001-01-01' AS w, code_version <> 'v1' AS o FROM sessions),
f AS (SELECT *, NOT w AND NOT o AND audit_passed AND contract IS NOT NULL AND n_capability_reports > 0 AND n_decisions > 0 AS q FROM q),
a AS (SELECT k, count(*) AS recorded, count(*) FILTER (q) AS qualifying, count(DISTINCT CASE WHEN q THEN trading_date END) AS dates, count(*) FILTER (w) AS rejected_window, count(*) FILTER (o) AS other_code, bool_or(q AND degradation_drill) AS degradation, bool_or(q AND recovery_drill) AS recovery FROM f GROUP BY k)
SELECT *, array_to_string({_list(("rejected_window > 0", "SESSION_TIME_WINDOW"), ("other_code > 0", "CODE_VERSION_MISMATCH"), ("qualifying < 20", "SHADOW_SESSION_COUNT"), ("dates < 20", "SHADOW_TRADING_DATE_COUNT"), ("NOT degradation", "SOURCE_DEGRADATION_DRILL"), ("NOT recovery", "RECOVERY_DRILL"))}, ',') AS blockers FROM a""")


def event_timeline(spark, sf_dir):
    return staged(spark, sf_dir, "risk_events").select("o_orderkey", _joined(gates.timeline_violations()).alias("violations"))


_TIMELINE = _list(
    ("source_published_at > first_seen_at", "PUBLISHED_AFTER_SEEN"), ("confirmed_at < first_seen_at", "CONFIRMED_BEFORE_SEEN"), ("cross_asset_confirmed <> (cross_asset_confirmed_at IS NOT NULL)", "CROSS_ASSET_DISAGREES"),
    ("cross_asset_confirmed_at < first_seen_at", "CROSS_ASSET_BEFORE_SEEN"), ("cross_asset_confirmed_at < confirmed_at", "CROSS_ASSET_BEFORE_CONFIRMED"),
    ("stable_since < coalesce(cross_asset_confirmed_at, confirmed_at, first_seen_at)", "STABLE_BEFORE_CONFIRMED"), ("next_cash_open_at <= session_close_at", "OPEN_NOT_AFTER_CLOSE"),
)
EVENT_TIMELINE = _with("risk_events", f" SELECT o_orderkey, array_to_string({_TIMELINE}, ',') AS violations FROM risk_events")


def event_risk_lock(spark, sf_dir):
    """Orders as events: state, reasons, the time to look again, and the next checkpoint."""
    rows = staged(spark, sf_dir, "risk_events").select("o_orderkey", gates.risk_lock(F.col("as_of")).alias("r"))
    return rows.select("o_orderkey", "r.state", _joined("r.reasons").alias("reasons"), "r.rerun_at", "r.next_checkpoint")


_POINTS = ", ".join(f"struct_pack(at := coalesce(scheduled_at, first_seen_at) + INTERVAL ({s}) SECOND, name := '{n}')" for n, s in gates.CHECKPOINTS)
_POINTS += ", struct_pack(at := session_close_at, name := 'SESSION_CLOSE'), struct_pack(at := next_cash_open_at, name := 'NEXT_CASH_OPEN')"
EVENT_RISK_LOCK = _with("risk_events", f""", a AS (SELECT *, {_list(("contradictory_evidence", "CONTRADICTORY_EVIDENCE"), ("confirmed_at IS NULL OR confirmed_at > as_of", "EVENT_NOT_CONFIRMED"), ("corroborating_sources < 2", "INSUFFICIENT_CORROBORATION"),
  ("NOT cross_asset_confirmed OR cross_asset_confirmed_at IS NULL OR cross_asset_confirmed_at > as_of", "CROSS_ASSET_NOT_CONFIRMED"))} AS lk,
  {_list(("stable_since IS NULL OR stable_since > as_of", "STABILITY_WINDOW_NOT_STARTED"), ("stable_since <= as_of AND stable_since + INTERVAL 120 SECOND > as_of", "STABILITY_WINDOW_INCOMPLETE"), ("stable_observations < 3", "INSUFFICIENT_STABLE_OBSERVATIONS"))} AS st,
  list_sort(list_filter([{_POINTS}], lambda p: p.at > as_of))[1].name AS point FROM risk_events),
b AS (SELECT *, CASE WHEN first_seen_at > as_of THEN 'NOT_VISIBLE' WHEN len(lk) > 0 THEN 'LOCKED' WHEN len(st) > 0 THEN 'STABILIZING' ELSE 'CLEARED' END AS state FROM a)
SELECT o_orderkey, state, CASE state WHEN 'LOCKED' THEN array_to_string(lk, ',') WHEN 'STABILIZING' THEN array_to_string(st, ',') WHEN 'CLEARED' THEN 'EVENT_STABLE' ELSE '' END AS reasons, CASE WHEN state = 'STABILIZING' THEN stable_since + INTERVAL 120 SECOND END AS rerun_at,
  coalesce(point, CASE WHEN next_cash_open_at IS NOT NULL THEN 'MONITORING_COMPLETE' ELSE 'SESSION_BOUNDARY_UNCONFIGURED' END) AS next_checkpoint FROM b""")


def execution_opening(spark, sf_dir):
    """Each order's lines as legs: every failure code, and the value of what fills."""
    a = execution.Assumptions(max_quote_age=2.0, fee=0.5, slippage=0.125, participation=0.75)
    found = execution.value_execution(staged(spark, sf_dir, "legs"), ["l_orderkey"], _now(), a, expected=table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey")), unique=False)
    return found.withColumn("failures", _joined("failures"))


def _execution_sql(closing: bool, extra: str = "") -> str:
    q, price = ("-quantity", "CASE WHEN -quantity > 0 THEN ask + 0.125 ELSE bid - 0.125 END") if closing else ("quantity", "CASE WHEN quantity > 0 THEN ask + 0.125 ELSE bid - 0.125 END")
    shown = f"CASE WHEN {q} > 0 THEN ask_size ELSE bid_size END"
    why = _list(("age < 0", "QUOTE_IN_FUTURE"), ("age > 2", "STALE_NBBO"), ("shown IS NULL", "MISSING_SIZE"), ("shown < n", "INSUFFICIENT_SIZE"), ("shown >= n AND n / shown > 0.75", "LIQUIDITY_LIMIT"))
    return f"""x AS (SELECT *, {q} AS q, abs(quantity) AS n, {price} AS price, {shown} AS shown, {_age('quoted_at')} AS age FROM legs{extra}),
y AS (SELECT l_orderkey, list_sort(list_distinct(flatten(list({why})))) AS f, bool_or(price < 0) AS low, CAST(sum(-q * price * multiplier) AS DOUBLE) AS gross, CAST(sum(n * 0.5) AS DOUBLE) AS fees,
  CAST(sum(abs(CASE WHEN q > 0 THEN ask ELSE bid END - (bid + ask) / 2) * n * multiplier) AS DOUBLE) AS half FROM x GROUP BY l_orderkey)"""


EXECUTION = _with("legs", f""", {_execution_sql(False)}, z AS (SELECT o_orderkey AS l_orderkey, CASE WHEN f IS NULL THEN ['MISSING_LEGS'] WHEN len(f) > 0 THEN f WHEN low THEN ['INVALID_NBBO'] ELSE [] END AS w, gross, fees, half FROM orders LEFT JOIN y ON l_orderkey = o_orderkey)
SELECT l_orderkey, len(w) = 0 AS executable, array_to_string(w, ',') AS failures, CASE WHEN len(w) = 0 THEN gross END AS gross, CASE WHEN len(w) = 0 THEN fees END AS fees, CASE WHEN len(w) = 0 THEN half END AS half_spread_cost,
  CASE WHEN len(w) = 0 THEN gross - fees END AS net, CASE WHEN len(w) = 0 THEN greatest(gross - fees, 0) END AS net_credit FROM z""")


def execution_pnl_path(spark, sf_dir):
    """Each order opened now and marked three times later, on quotes that widen; one mark of some orders lacks a leg."""
    a = execution.Assumptions(max_quote_age=20.0, fee=0.5, slippage=0.125)
    legs = staged(spark, sf_dir, "legs").where("bid_size IS NOT NULL AND ask_size IS NOT NULL").withColumns({"bid": F.col("bid") + 1, "ask": F.col("ask") + 1, "quoted_at": _now()})
    legs = legs.repartition("l_orderkey")  # dealt out once, before each leg becomes three
    marks = legs.withColumn("step", F.explode(F.expr("sequence(1, 3)"))).where("NOT (step = 2 AND l_orderkey % 7 = 0 AND leg_id = 1)")
    marks = marks.withColumn("marked_at", F.expr(f"{_NOW} + step * INTERVAL '1' SECOND")).withColumn("ask", F.col("ask") + F.col("step") * 0.25).drop("step")
    path = execution.executable_pnl(legs, marks, ["l_orderkey"], "marked_at", _now(), a, unique=False)  # some orders have a line twice
    return execution.pnl_path(path, ["l_orderkey"])


_SIDE = "CASE WHEN {q} > 0 THEN (ask + {w}) + 1.125 ELSE bid + 0.875 END"
PNL_PATH = _with("legs", f""", g AS (SELECT *, abs(quantity) AS n FROM legs WHERE bid_size IS NOT NULL AND ask_size IS NOT NULL),
o AS (SELECT l_orderkey, count(*) AS legs, bool_or((CASE WHEN quantity > 0 THEN ask_size ELSE bid_size END) < n) AS bad, bool_or({_SIDE.format(q='quantity', w='0')} < 0) AS low, sum(-quantity * ({_SIDE.format(q='quantity', w='0')}) * 100) - sum(n * 0.5) AS net FROM g GROUP BY l_orderkey),
m AS (SELECT * FROM g, range(1, 4) t(step) WHERE NOT (step = 2 AND l_orderkey % 7 = 0 AND leg_id = 1)),
c AS (SELECT l_orderkey, step, count(*) AS legs, bool_or((CASE WHEN -quantity > 0 THEN ask_size ELSE bid_size END) < n) AS bad, bool_or({_SIDE.format(q='-quantity', w='step * 0.25')} < 0) AS low, sum(quantity * ({_SIDE.format(q='-quantity', w='step * 0.25')}) * 100) - sum(n * 0.5) AS net FROM m GROUP BY 1, 2),
p AS (SELECT c.l_orderkey, CASE WHEN c.legs = o.legs AND NOT o.bad AND NOT c.bad AND NOT o.low AND NOT c.low THEN o.net + c.net END AS pnl FROM c JOIN o ON c.l_orderkey = o.l_orderkey)
SELECT l_orderkey, count(*) AS n_marks, CASE WHEN count(pnl) = count(*) THEN CAST(greatest(0, -min(pnl)) AS DOUBLE) END AS maximum_mtm_loss FROM p GROUP BY l_orderkey""")


CALENDAR = calendar.EquityCalendar(date(1996, 1, 1), date(2000, 12, 31), frozenset({date(1996, 12, 25), date(1997, 7, 4), date(1998, 1, 1), date(1999, 5, 31)}), {date(1996, 7, 5): time(13), date(1998, 11, 27): time(13), date(1999, 11, 26): time(12, 30)})


def calendar_sessions(spark, sf_dir):
    """Every order day with its status and session, summer time and half-days included."""
    days = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")).distinct().select("day", CALENDAR.session(F.col("day")).alias("s"))
    return days.select("day", "s.status", F.unix_seconds("s.opens_at").alias("opens"), F.unix_seconds("s.preopen_cutoff_at").alias("cutoff"), F.unix_seconds("s.closes_at").alias("closes"), "s.is_early_close")


_dates = lambda ds: ", ".join(f"DATE '{d}'" for d in sorted(ds))
CALENDAR_SESSIONS = f"""WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders), s AS (SELECT day, CASE WHEN isodow(day) >= 6 THEN 'WEEKEND' WHEN day NOT BETWEEN DATE '1996-01-01' AND DATE '2000-12-31' THEN 'UNVERIFIED' WHEN day IN ({_dates(CALENDAR.holidays)}) THEN 'HOLIDAY' ELSE 'TRADING_DAY' END AS status,
  CASE day {" ".join(f"WHEN DATE '{d}' THEN {t.hour * 60 + t.minute}" for d, t in CALENDAR.early_closes.items())} ELSE 960 END AS m FROM d)
SELECT day, status, CASE WHEN status = 'TRADING_DAY' THEN CAST(epoch(timezone('America/New_York', CAST(day AS TIMESTAMP) + INTERVAL 570 MINUTE)) AS BIGINT) END AS opens, CASE WHEN status = 'TRADING_DAY' THEN CAST(epoch(timezone('America/New_York', CAST(day AS TIMESTAMP) + INTERVAL 34199 SECOND)) AS BIGINT) END AS cutoff,
  CASE WHEN status = 'TRADING_DAY' THEN CAST(epoch(timezone('America/New_York', CAST(day AS TIMESTAMP) + INTERVAL (m) MINUTE)) AS BIGINT) END AS closes, status = 'TRADING_DAY' AND m < 960 AS is_early_close FROM s"""

EVENT_CALENDARS = (calendar.EquityCalendar(date(2024, 1, 2), date(2024, 1, 20), frozenset({date(2024, 1, 15)}), {date(2024, 1, 5): time(13)}), calendar.FuturesCalendar(date(2024, 1, 2), date(2024, 1, 20), frozenset({date(2024, 1, 9)})))


def market_states(spark, sf_dir):
    """Every event's state in the cash and the futures market, counted by New York day and hour."""
    equity, futures = EVENT_CALENDARS
    ts, et = F.col("ts"), calendar.to_new_york(F.col("ts"))
    return table(spark, sf_dir, "events").groupBy(F.to_date(et).alias("day_et"), F.hour(et).alias("hour_et"), equity.state_at(ts).alias("equity"), futures.state_at(ts).alias("futures")).agg(F.count("*").alias("n"))


MARKET_STATES = """WITH e AS (SELECT timezone('America/New_York', timezone('UTC', ts)) AS et FROM events), c AS (SELECT et, CAST(et AS DATE) AS d, isodow(et) AS w, epoch(et - date_trunc('day', et)) AS s FROM e)
SELECT d AS day_et, CAST(hour(et) AS INTEGER) AS hour_et,
  CASE WHEN w >= 6 THEN 'WEEKEND' WHEN d NOT BETWEEN DATE '2024-01-02' AND DATE '2024-01-20' THEN 'UNVERIFIED' WHEN d = DATE '2024-01-15' THEN 'HOLIDAY' WHEN s BETWEEN 34200 AND CASE WHEN d = DATE '2024-01-05' THEN 46800 ELSE 57600 END THEN 'OPEN' ELSE 'CLOSED' END AS equity,
  CASE WHEN d NOT BETWEEN DATE '2024-01-02' AND DATE '2024-01-20' THEN 'UNVERIFIED' WHEN d = DATE '2024-01-09' OR w = 6 OR (w = 5 AND s >= 61200) OR (w = 7 AND s < 64800) THEN 'CLOSED' WHEN s >= 61200 AND s < 64800 THEN 'MAINTENANCE' ELSE 'OPEN' END AS futures, count(*) AS n
FROM c GROUP BY ALL"""


def contract_rules(spark, sf_dir):
    """Futures symbols, identifiers and decision requests, each with what forbids it."""
    c = staged(spark, sf_dir, "symbols")
    return c.select("c_custkey", _joined(gates.contract_violations()).alias("contract"), gates.is_identifier(F.col("identifier"), 32).alias("is_identifier"), _joined(gates.request_violations()).alias("request"))


_S = "upper(trim(symbol))"
_FINE = f"regexp_full_match({_S}, 'ES[HMUZ][0-9]{{1,4}}')"
_ALIAS = f"({_S} IN ('ES', '/ES', 'ESMAIN', 'ES-MAIN', 'ES1!', 'ES.C.0') OR contains({_S}, 'MAIN'))"
CONTRACT = _with("symbols", f""" SELECT c_custkey, array_to_string({_list((f"{_ALIAS} OR symbol IS NULL", "CONTINUOUS_CONTRACT"), (f"(NOT {_ALIAS} AND NOT {_FINE}) IS NOT FALSE", "NOT_EXPLICIT"), (f"{_FINE} AND month(expiry) <> CASE substring({_S}, 3, 1) WHEN 'H' THEN 3 WHEN 'M' THEN 6 WHEN 'U' THEN 9 ELSE 12 END", "MONTH_MISMATCH"),
  (f"{_FINE} AND NOT suffix(CAST(year(expiry) AS VARCHAR), substring({_S}, 4))", "YEAR_MISMATCH"))}, ',') AS contract, regexp_full_match(identifier, '[A-Za-z0-9][A-Za-z0-9._:/-]{{0,31}}') AS is_identifier,
  array_to_string({_list(("mode NOT IN ('LIVE', 'SCENARIO')", "UNKNOWN_MODE"), ("mode = 'LIVE' AND has_gates", "LIVE_WITH_GATES"), ("mode = 'LIVE' AND has_values", "LIVE_WITH_VALUES"), ("mode = 'LIVE' AND as_of IS NOT NULL", "LIVE_WITH_AS_OF"), ("mode = 'SCENARIO' AND as_of IS NULL", "SCENARIO_WITHOUT_AS_OF"))}, ',') AS request FROM symbols""")


def scout_candidates(spark, sf_dir):
    """Each order as a detector's candidate; its lines' comments are the evidence."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.max("l_returnflag").alias("flag"), F.max("l_discount").alias("best"))
    k = F.col("l_orderkey")
    rows = li.select(
        "l_orderkey", F.lit("2024-01-02").cast("date").alias("as_of"), F.when(k % 7 == 0, F.lit("2024-01-02")).otherwise("2024-01-03").cast("date").alias("next_checkpoint"), (F.col("best") + F.when(k % 11 == 0, 1.0).otherwise(0.0)).alias("confidence"),
        F.when(k % 13 == 0, F.lit(" ")).otherwise(F.concat(F.lit(" "), F.col("flag"))).alias("target"), F.when(F.col("n") == 1, F.array().cast("array<string>")).otherwise(F.array(F.lit("e"), F.when(k % 17 == 0, F.lit("")).otherwise("f"))).alias("evidence"),
        F.array(F.when(k % 19 == 0, F.lit(" ")).otherwise("i")).alias("invalidation_conditions"), F.when(k % 23 != 0, F.lit("m")).alias("data_manifest_id"), F.when(k % 2 == 0, F.lit("FLOW")).otherwise("PRICE").alias("kind"), F.when(k % 4 == 0, F.lit("q")).alias("estimate_method"),
    )
    return rows.select("l_orderkey", _joined(gates.candidate_violations(F.array(F.lit("N"), F.lit("R")), ("FLOW",))).alias("violations"))


SCOUT = f"""WITH o AS (SELECT l_orderkey AS k, count(*) AS n, max(l_returnflag) AS flag, max(l_discount) AS best FROM lineitem GROUP BY 1)
SELECT k AS l_orderkey, array_to_string({_list(("k % 7 = 0", "CHECKPOINT_NOT_AHEAD"), ("best + CASE WHEN k % 11 = 0 THEN 1.0 ELSE 0.0 END NOT BETWEEN 0 AND 1", "CONFIDENCE_OUT_OF_RANGE"), ("k % 13 = 0", "BLANK_TARGET"), ("k % 13 <> 0 AND flag NOT IN ('N', 'R')", "OUTSIDE_UNIVERSE"),
  ("n = 1 OR k % 17 = 0", "NO_EVIDENCE"), ("k % 19 = 0", "NO_INVALIDATION"), ("k % 23 = 0", "NO_MANIFEST"), ("k % 2 = 0 AND k % 4 <> 0", "NO_ESTIMATE_METHOD"))}, ',') AS violations FROM o"""


def attribution_signals(spark, sf_dir):
    """Each order as a signal, its lines as candidate causes and observed assets: what forbids it, and its reading."""
    li = table(spark, sf_dir, "lineitem")
    lines = li.groupBy("l_orderkey").agg(
        F.collect_list(F.struct((F.col("l_suppkey") % 40).alias("cause_id"), F.to_date("l_shipdate").alias("first_seen_at"))).alias("candidates"), F.collect_list(F.struct(F.to_date("l_shipdate").alias("observed_at"))).alias("observations"),
        F.count_if(F.col("l_returnflag") == "N").alias("coherent"), F.count_if(F.col("l_returnflag") != "A").alias("n_observed"), F.max("l_discount").alias("best"),
    )
    o = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    day, k = F.to_date("o_orderdate"), F.col("o_orderkey")
    rows = o.select(
        "o_orderkey", F.when(k % 3 == 0, F.lit("MAJOR_EVENT")).otherwise("SHOCK").alias("kind"), F.concat(F.lit("P"), (k % 4).cast("string")).alias("severity"), F.when(k % 5 == 0, F.lit("x")).otherwise("sha256:1").alias("snapshot_id"), F.when(k % 7 == 0, F.lit("x")).otherwise("sha256:2").alias("replay_manifest_hash"),
        F.date_add(day, (k % 70).cast("int")).alias("first_seen_at"), F.date_add(day, (k % 66).cast("int")).alias("market_reaction_start_at"), F.date_add(day, 60).alias("observed_as_of"), "candidates", "observations",
        gates.attribution(F.least("coherent", "n_observed"), F.col("n_observed"), F.col("best"), k % 3 - 1).alias("a"),
    )
    return rows.select("o_orderkey", _joined(gates.signal_violations()).alias("violations"), "a.coherence", "a.confidence", "a.timing")


SIGNALS = f"""WITH l AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_suppkey % 40) AS nd, max(CAST(l_shipdate AS DATE)) AS last, count(*) FILTER (l_returnflag = 'N') AS c, count(*) FILTER (l_returnflag <> 'A') AS m, max(l_discount) AS best FROM lineitem GROUP BY 1),
x AS (SELECT *, o_orderkey AS k, CAST(o_orderdate AS DATE) AS d FROM orders JOIN l ON l_orderkey = o_orderkey), y AS (SELECT *, CASE WHEN m = 0 THEN 'UNKNOWN' WHEN least(c, m) = m THEN 'COHERENT' WHEN c = 0 THEN 'DIVERGENT' ELSE 'MIXED' END AS coherence FROM x)
SELECT o_orderkey, array_to_string({_list(("k % 3 = 0 AND k % 4 > 1", "MAJOR_EVENT_SEVERITY"), ("k % 5 = 0", "SNAPSHOT_ID"), ("k % 7 = 0", "MANIFEST_HASH"), ("k % 70 > 60", "SEEN_IN_FUTURE"), ("k % 66 > 60", "REACTION_IN_FUTURE"), ("last > d + 60", "FUTURE_CANDIDATE"), ("last > d + 60", "FUTURE_OBSERVATION"), ("nd <> n", "REPEATED_CAUSE"))}, ',') AS violations,
  coherence, round(best * CASE coherence WHEN 'COHERENT' THEN 1.0 WHEN 'MIXED' THEN 0.85 WHEN 'DIVERGENT' THEN 0.6 ELSE 0.75 END, 4) AS confidence, CASE k % 3 WHEN 0 THEN 'MARKET_PRECEDED_SIGNAL' WHEN 1 THEN 'SIMULTANEOUS' ELSE 'SIGNAL_PRECEDED_MARKET' END AS timing FROM y"""


def _line():
    """A place of each line in its order (line numbers repeat in the driver's table)."""
    return F.col("l_linenumber") * 10**17 + F.col("l_partkey") * 10**10 + F.col("l_suppkey") * 10**5 + F.unix_date(F.to_date("l_shipdate"))


_LINE = "(l_linenumber * 100000000000000000 + l_partkey * 10000000000 + l_suppkey * 100000 + (CAST(l_shipdate AS DATE) - DATE '1970-01-01'))"


def outcome_requests(spark, sf_dir):
    """Each order as a label request: its lines, in line order, are the observations."""
    obs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), _line().alias("seq"), F.to_date("l_shipdate").alias("observed_at"))
    last = obs.groupBy("o_orderkey").agg(F.max_by("observed_at", "seq").alias("last"))
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    req = table(spark, sf_dir, "orders").join(last, "o_orderkey", "left").select(
        "o_orderkey", F.date_add(day, F.when(k % 10 == 0, 40).otherwise(0)).alias("cutoff"), F.date_add(day, F.when(k % 9 == 0, 2).otherwise(60)).alias("intraday_end"), F.when(k % 2 == 0, F.greatest(F.col("last"), F.date_add(day, 60))).otherwise(F.date_add(day, 60)).alias("expiry"),
        F.lit(100.0).alias("reference"), F.when(k % 8 == 0, 101.0).otherwise(90.0).alias("lower"), F.lit(110.0).alias("upper"),
    )
    return gates.outcome_request_violations(req, obs, "o_orderkey").select("o_orderkey", _joined("violations").alias("violations"))


OUTCOME_REQUESTS = f"""WITH l AS (SELECT l_orderkey, {_LINE} AS seq, CAST(l_shipdate AS DATE) AS d, CAST(l_shipdate AS DATE) <= lag(CAST(l_shipdate AS DATE)) OVER (PARTITION BY l_orderkey ORDER BY {_LINE}) AS back FROM lineitem),
o AS (SELECT l_orderkey, min(d) AS first, max(d) AS last, max_by(d, seq) AS fin, bool_or(coalesce(back, false)) AS back FROM l GROUP BY 1),
r AS (SELECT o_orderkey, o_orderkey AS k, CAST(o_orderdate AS DATE) AS day FROM orders), q AS (SELECT *, day + CASE WHEN k % 10 = 0 THEN 40 ELSE 0 END AS cutoff, day + CASE WHEN k % 9 = 0 THEN 2 ELSE 60 END AS ie, CASE WHEN k % 2 = 0 THEN greatest(fin, day + 60) ELSE day + 60 END AS expiry FROM r LEFT JOIN o ON l_orderkey = o_orderkey)
SELECT o_orderkey, array_to_string({_list(("NOT (cutoff < ie AND ie <= expiry)", "WINDOW_ORDER"), ("k % 8 = 0", "LEVEL_ORDER"), ("first IS NULL", "NO_OBSERVATIONS"), ("first <= cutoff", "NOT_AFTER_CUTOFF"), ("last > expiry", "AFTER_EXPIRY"), ("back", "NOT_ORDERED"), ("fin <> expiry", "NOT_AT_EXPIRY"), ("first > ie", "NO_INTRADAY"))}, ',') AS violations FROM q"""


def review_transitions(spark, sf_dir):
    """Each order's lines as review requests in turn."""
    status = F.element_at(F.array(*(F.lit(s) for s in ("IN_REVIEW", "NEEDS_EVIDENCE", "OPEN", "CONFIRMED", "REJECTED", "INCONCLUSIVE", "IN_REVIEW"))), (F.col("l_suppkey") % 7 + 1).cast("int"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", _line().alias("seq"), status.alias("status"))
    return gates.review_transitions(rows, "l_orderkey", "seq", "status")


REVIEWS = f"""WITH r AS (SELECT l_orderkey, {_LINE} AS seq, ['IN_REVIEW', 'NEEDS_EVIDENCE', 'OPEN', 'CONFIRMED', 'REJECTED', 'INCONCLUSIVE', 'IN_REVIEW'][l_suppkey % 7 + 1] AS status FROM lineitem),
t AS (SELECT l_orderkey, min(seq) AS ended FROM r WHERE status IN ('CONFIRMED', 'REJECTED', 'INCONCLUSIVE') GROUP BY 1)
SELECT l_orderkey, seq, status, CASE WHEN status = 'OPEN' THEN 'RETURNS_TO_OPEN' WHEN seq > ended THEN 'REVIEW_IS_TERMINAL' END AS refusal FROM r LEFT JOIN t USING (l_orderkey)"""


def replay_faults(spark, sf_dir):
    """A manifest of every customer's latest order, with every kind of fault in it, against the records."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record_id"), F.col("o_custkey").alias("logical_key"), F.concat(F.lit("h"), F.col("o_orderkey").cast("string")).alias("content_hash"), F.to_date("o_orderdate").alias("first_seen_at"))
    as_of = F.lit("2000-06-01").cast("date")
    visible = o.where(F.col("first_seen_at") <= as_of).groupBy("logical_key").agg(F.max_by(F.struct("record_id", "content_hash", "first_seen_at"), F.struct("first_seen_at", "record_id")).alias("v")).select("logical_key", "v.*")
    last = o.groupBy("logical_key").agg(F.max("record_id").alias("newest"))
    k, r = F.col("logical_key"), F.col("record_id")
    manifest = visible.join(last, "logical_key").where(k % 23 != 0).select(
        F.when(k % 19 == 0, -r).when(k % 17 == 0, F.col("newest")).otherwise(r).alias("record_id"), F.when(k % 13 == 0, -k).otherwise(k).alias("logical_key"), F.when(k % 11 == 0, F.lit("x")).otherwise(F.concat(F.lit("h"), F.when(k % 17 == 0, F.col("newest")).otherwise(r).cast("string"))).alias("content_hash"),
    )
    return gates.replay_faults(manifest, o, visible, as_of)


REPLAY = """WITH o AS (SELECT o_orderkey AS record_id, o_custkey AS logical_key, CAST(o_orderdate AS DATE) AS seen FROM orders), v AS (SELECT logical_key, max_by(record_id, (seen, record_id)) AS r FROM o WHERE seen <= DATE '2000-06-01' GROUP BY 1),
n AS (SELECT logical_key, max(record_id) AS newest FROM o GROUP BY 1), m AS (SELECT CASE WHEN k % 19 = 0 THEN -r WHEN k % 17 = 0 THEN newest ELSE r END AS record_id, CASE WHEN k % 13 = 0 THEN -k ELSE k END AS logical_key, CASE WHEN k % 11 = 0 THEN 'x' ELSE 'h' || CASE WHEN k % 17 = 0 THEN newest ELSE r END END AS hash FROM (SELECT v.logical_key AS k, r, newest FROM v JOIN n USING (logical_key)) WHERE k % 23 <> 0),
j AS (SELECT coalesce(m.logical_key, v.logical_key) AS logical_key, m.record_id, m.hash, o.seen, o.logical_key AS own, o.record_id AS found, v.r FROM m LEFT JOIN o ON m.record_id = o.record_id FULL JOIN v ON m.logical_key = v.logical_key),
f AS (SELECT logical_key, record_id, CASE WHEN record_id IS NULL THEN 'LEFT_OUT' WHEN seen IS NULL THEN 'RECORD_MISSING' WHEN seen > DATE '2000-06-01' THEN 'FUTURE_RECORD' WHEN 'h' || found <> hash THEN 'CONTENT_MISMATCH' WHEN own <> logical_key THEN 'KEY_MISMATCH' WHEN record_id IS DISTINCT FROM r THEN 'NOT_VISIBLE_REVISION' ELSE 'OK' END AS fault FROM j)
SELECT * FROM f WHERE fault <> 'OK'"""


def shared_samples(spark, sf_dir):
    """Sample and group ids found both in a calibration and a holdout part of the orders: none of the first, many of the second."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sample_id"), F.col("o_custkey").alias("group_id"), "o_orderdate")
    early = F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")
    return gates.shared_keys(o.where(early), o.where(~early), ["sample_id", "group_id"]).groupBy("column").agg(F.count("*").alias("n"))


SHARED = "SELECT 'group_id' AS \"column\", count(*) AS n FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING min(o_orderdate) < TIMESTAMP '1998-01-01' AND max(o_orderdate) >= TIMESTAMP '1998-01-01') HAVING count(*) > 0"


def governance_champions(spark, sf_dir):
    """Customers as models: champions by their orders as promotions, sessions frozen by some of these, and requests."""
    o = table(spark, sf_dir, "orders")
    events = o.select(F.col("o_custkey").alias("model_id"), F.col("o_orderkey").alias("seq"), (F.col("o_orderkey") % 50).alias("target_version"))
    freezes = o.where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("model_id"), F.col("o_orderpriority").alias("session_id"), F.col("o_orderkey").alias("seq"), (F.col("o_orderkey") % 50).alias("version"))
    requests = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("model_id"), F.explode(F.array(F.lit("1-URGENT"), F.lit("5-LOW"), F.lit("none"))).alias("session_id"))
    return governance.session_champions(requests, freezes, governance.champions(events)).select("model_id", "session_id", "version", "frozen")


CHAMPIONS = """WITH c AS (SELECT o_custkey AS model_id, max_by(o_orderkey % 50, o_orderkey) AS cur FROM orders GROUP BY 1), f AS (SELECT o_custkey AS model_id, o_orderpriority AS session_id, min_by(o_orderkey % 50, o_orderkey) AS v FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1, 2)
SELECT r.model_id, r.session_id, coalesce(v, cur) AS version, v IS NOT NULL AS frozen FROM (SELECT c_custkey AS model_id, unnest(['1-URGENT', '5-LOW', 'none']) AS session_id FROM customer) r LEFT JOIN f USING (model_id, session_id) LEFT JOIN c USING (model_id)"""


def governance_approvals(spark, sf_dir):
    """Orders as approvals of versions (parts), with every reason against one."""
    p = table(spark, sf_dir, "part")
    v = p.select(F.lit(1).alias("model_id"), F.col("p_partkey").alias("version"), (F.col("p_partkey") - 1).alias("parent_version"), F.when(F.col("p_partkey") % 4 != 0, F.concat(F.lit("r"), F.col("p_partkey").cast("string"))).alias("validation_report_hash"), F.lit("1997-01-01").cast("date").alias("trained_at"))
    k = F.col("o_orderkey")
    target = F.when(k % 6 == 0, F.lit(-1)).when(k % 5 == 0, F.lit(41)).otherwise(F.when(k % 2 == 0, F.lit(43)).otherwise(F.lit(44))).cast("long")
    a = table(spark, sf_dir, "orders").select(
        k.alias("approval_id"), F.when(k % 7 == 0, F.lit("ROLLBACK")).otherwise("PROMOTE").alias("action"), F.lit(1).alias("model_id"), F.when(k % 8 == 0, F.lit(40)).otherwise(42).cast("long").alias("source_version"), target.alias("target_version"),
        F.concat(F.lit("r"), (target + F.when(k % 9 == 0, 1).otherwise(0)).cast("string")).alias("evidence_hash"), F.to_date("o_orderdate").alias("approved_at"),
    )
    current = spark.createDataFrame([(1, 42)], "model_id int, version long")
    used = a.where("approval_id % 11 = 0").select("approval_id")
    return governance.approval_faults(a, v, current, used).select("approval_id", "target_version", _joined("reasons").alias("reasons"))


APPROVALS = f"""WITH v AS (SELECT p_partkey AS target, p_partkey - 1 AS parent, CASE WHEN p_partkey % 4 <> 0 THEN 'r' || p_partkey END AS report FROM part),
a AS (SELECT o_orderkey AS k, CAST(CASE WHEN o_orderkey % 6 = 0 THEN -1 WHEN o_orderkey % 5 = 0 THEN 41 WHEN o_orderkey % 2 = 0 THEN 43 ELSE 44 END AS BIGINT) AS target, CAST(o_orderdate AS DATE) AS approved FROM orders), x AS (SELECT a.*, v.target IS NOT NULL AS known, parent, report, k % 7 <> 0 AS up, 'r' || (a.target + CASE WHEN k % 9 = 0 THEN 1 ELSE 0 END) AS evidence FROM a LEFT JOIN v USING (target))
SELECT k AS approval_id, target AS target_version, array_to_string({_list(("NOT known", "UNKNOWN_VERSION"), ("k % 11 = 0", "APPROVAL_USED"), ("k % 8 = 0", "SOURCE_IS_NOT_THE_CHAMPION"), ("known AND up AND report IS NULL", "NO_VALIDATION_REPORT"), ("known AND up AND report <> evidence", "EVIDENCE_MISMATCH"), ("known AND up AND approved < DATE '1997-01-01'", "APPROVED_BEFORE_TRAINED"),
  ("known AND up AND parent <> 42", "NOT_A_DESCENDANT"), ("NOT up AND target = 42", "ALREADY_THE_CHAMPION"))}, ',') AS reasons FROM x"""


def _outbox(spark, sf_dir):
    """Users as messages: their events, in order, are the outbox events of a channel."""
    kinds = ("ENQUEUED", "ATTEMPTED", "RETRY_SCHEDULED", "ATTEMPTED", "DELIVERED", "ESCALATED", "RETRY_SCHEDULED", "DELIVERED")
    at = F.unix_micros(F.col("ts").cast("timestamp")).cast("double") / 1e6
    first = F.min("event_id").over(delivery._by_message())
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("message_id"), "event_id", at.alias("recorded_at"))
    e = e.withColumn("kind", F.when(F.col("event_id") == first, "ENQUEUED").otherwise(F.element_at(F.array(*(F.lit(k) for k in kinds)), (F.col("event_id") % 8 + 1).cast("int"))))
    e = e.withColumn("kind", F.when((F.col("event_id") % 331 == 0) & (F.col("event_id") != first), "ACKNOWLEDGED").otherwise(F.col("kind")))
    return e.select("message_id", F.col("event_id").alias("seq"), "kind", "recorded_at", F.when(F.col("kind") == "RETRY_SCHEDULED", F.col("recorded_at") + 3600).alias("next_attempt_at"), F.when(F.col("kind") == "DELIVERED", F.col("recorded_at") + 7200).alias("ack_due_at"))


_OUTBOX = """WITH f AS (SELECT user_id, min(event_id) AS first FROM events GROUP BY 1), e AS (SELECT CAST(events.user_id AS VARCHAR) AS message_id, event_id AS seq, epoch_us(ts) / 1e6 AS t,
  CASE WHEN event_id = first THEN 'ENQUEUED' WHEN event_id % 331 = 0 THEN 'ACKNOWLEDGED' ELSE ['ENQUEUED', 'ATTEMPTED', 'RETRY_SCHEDULED', 'ATTEMPTED', 'DELIVERED', 'ESCALATED', 'RETRY_SCHEDULED', 'DELIVERED'][event_id % 8 + 1] END AS kind FROM events JOIN f ON events.user_id = f.user_id),
s AS (SELECT message_id, max_by(kind, seq) AS kind, max_by(t, seq) AS t, bool_or(kind = 'ACKNOWLEDGED') AS acked, count(*) FILTER (kind = 'ESCALATED') AS level, count(*) FILTER (kind = 'ATTEMPTED') AS attempts, max_by(t, seq) FILTER (kind = 'DELIVERED') AS delivered FROM e GROUP BY 1)"""
#: A time by which some retries and acknowledgements are due and others aren't.
_WHEN = 1706659200.0
_POLICY = delivery.ChannelPolicy(base=60.0, most=600.0, max_attempts=4, ack_timeout=7200.0, max_escalations=5)


def delivery_dispatch(spark, sf_dir):
    """What follows the attempt of every message that is due: delivered, retried with a growing delay, or given up."""
    state = delivery.message_state(_outbox(spark, sf_dir))
    m = F.col("message_id").cast("long")
    outcomes = state.select("message_id", F.when(m % 3 == 0, "SENT").when(m % 3 == 1, "TRANSIENT_FAILURE").otherwise("PERMANENT_FAILURE").alias("outcome"), F.lit("R").alias("reason"))
    return delivery.dispatched(state, outcomes, F.lit(_WHEN), _POLICY).select("message_id", "kind", "next_attempt_at", "ack_due_at", "attempt_number", "reason_code")


DISPATCH = _OUTBOX + f""", d AS (SELECT *, CAST(message_id AS BIGINT) % 3 AS m, attempts + 1 AS n FROM s WHERE NOT acked AND ((kind = 'ENQUEUED' AND t <= {_WHEN}e0) OR (kind = 'RETRY_SCHEDULED' AND t + 3600 <= {_WHEN}e0)))
SELECT message_id, CASE WHEN m = 0 THEN 'DELIVERED' WHEN m = 2 OR n >= 4 THEN 'DEAD_LETTERED' ELSE 'RETRY_SCHEDULED' END AS kind, CASE WHEN m = 1 AND n < 4 THEN {_WHEN}e0 + least(60.0 * pow(2, n - 1), 600.0) END AS next_attempt_at, CASE WHEN m = 0 THEN {_WHEN}e0 + 7200 END AS ack_due_at,
  CAST(CASE WHEN m = 1 AND n < 4 THEN n + 1 ELSE n END AS BIGINT) AS attempt_number, CASE WHEN m = 0 THEN NULL WHEN m = 1 AND n >= 4 THEN 'RETRY_BUDGET_EXHAUSTED' ELSE 'R' END AS reason_code FROM d"""


def delivery_escalations(spark, sf_dir):
    """Delivered messages without an acknowledgement in time: one level up with a retry, or given up beyond the last level."""
    return delivery.escalations(delivery.message_state(_outbox(spark, sf_dir)), F.lit(_WHEN), _POLICY).select("message_id", "kind", "next_attempt_at", "escalation_level", "attempt_number", "reason_code")


ESCALATIONS = _OUTBOX + f""", d AS (SELECT * FROM s WHERE NOT acked AND kind = 'DELIVERED' AND delivered + 7200 <= {_WHEN}e0)
SELECT message_id, 'ESCALATED' AS kind, CAST(NULL AS DOUBLE) AS next_attempt_at, level + 1 AS escalation_level, CAST(NULL AS BIGINT) AS attempt_number, 'ACK_TIMEOUT' AS reason_code FROM d WHERE level < 5
UNION ALL SELECT message_id, 'RETRY_SCHEDULED', {_WHEN}e0, level + 1, attempts + 1, 'ACK_ESCALATION' FROM d WHERE level < 5 UNION ALL SELECT message_id, 'DEAD_LETTERED', NULL, level, NULL, 'ACK_TIMEOUT' FROM d WHERE level >= 5"""


def delivery_acknowledgements(spark, sf_dir):
    """Orders as requests of acknowledgement by customers, for the messages of the same number."""
    state = delivery.message_state(_outbox(spark, sf_dir))
    k = F.col("o_orderkey")
    requests = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 200).cast("string").alias("message_id"), F.when(k % 9 == 0, F.lit(" ")).otherwise(k.cast("string")).alias("actor"), (F.lit(_WHEN) - (k % 1000) * 1000.0).alias("at"))
    return delivery.acknowledgements(state, requests).groupBy("outcome").agg(F.count("*").alias("n"))


ACKS = _OUTBOX + f""", r AS (SELECT CAST(o_custkey % 200 AS VARCHAR) AS message_id, CASE WHEN o_orderkey % 9 = 0 THEN ' ' ELSE CAST(o_orderkey AS VARCHAR) END AS actor, {_WHEN}e0 - (o_orderkey % 1000) * 1000.0 AS t FROM orders),
j AS (SELECT r.*, acked, delivered, CASE WHEN trim(actor) = '' THEN 'NO_ACTOR' WHEN acked IS NULL THEN 'UNKNOWN_MESSAGE' WHEN delivered IS NULL THEN 'NOT_DELIVERED' WHEN r.t < delivered THEN 'BEFORE_DELIVERY' END AS refusal FROM r LEFT JOIN s USING (message_id)),
g AS (SELECT *, CASE WHEN refusal IS NOT NULL THEN refusal WHEN acked OR row_number() OVER (PARTITION BY message_id, refusal ORDER BY t, actor) > 1 THEN 'REPEATED' ELSE 'ACKNOWLEDGED' END AS outcome FROM j) SELECT outcome, count(*) AS n FROM g GROUP BY 1"""


def alert_escalations(spark, sf_dir):
    """Orders as alerts: open ones of the highest priority that waited long enough, one level up; counts of all beside them."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("P"), (F.col("o_orderkey") % 3).cast("string")).alias("priority"), F.when(F.col("o_orderstatus") == "O", "OPEN").otherwise("CLOSED").alias("status"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).cast("double").alias("us"), (F.col("o_orderkey") % 4).alias("escalation_level"))
    due = delivery.due_escalations(o.withColumn("created_at", F.col("us") / 1e6), F.lit(946684800.0), 120.0)
    return due.select("o_orderkey", "escalation_level")


ALERT_ESCALATIONS = "SELECT o_orderkey, o_orderkey % 4 + 1 AS escalation_level FROM orders WHERE o_orderkey % 3 = 0 AND o_orderstatus = 'O' AND 946684800.0 - epoch_us(o_orderdate) / 1e6 >= 120.0"


def alert_projection(spark, sf_dir):
    """Orders as alert states by content (status and priority of a customer): how many are new against what was shown before."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority", "o_orderkey")
    columns = ["o_custkey", "o_orderstatus", "o_orderpriority"]
    known = delivery.projection(o.where("o_orderkey % 2 = 0"), columns)
    return delivery.projection(o, columns, known).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count_distinct("projection_key").alias("n_keys"))


PROJECTION = """WITH a AS (SELECT DISTINCT o_custkey, o_orderstatus, o_orderpriority FROM orders), k AS (SELECT DISTINCT o_custkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 2 = 0)
SELECT o_orderstatus, count(*) AS n, count(*) AS n_keys FROM (SELECT * FROM a EXCEPT SELECT * FROM k) GROUP BY 1"""


def operations_overview(spark, sf_dir):
    scenarios = staged(spark, sf_dir, "risk_events").select(gates.risk_lock(F.col("as_of"))["state"].alias("state"))
    alerts = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") == "O", "OPEN").otherwise("CLOSED").alias("status"))
    return governance.overview(scenarios, alerts)


OVERVIEW = f"SELECT count(*) AS n_scenarios, count(*) FILTER (state <> 'CLEARED') AS n_not_cleared, (SELECT count(*) FROM orders) AS n_alerts, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS n_open FROM ({EVENT_RISK_LOCK})"


def scalar_prices(spark, sf_dir):
    """Implied index with carry, largest loss, years to expiry, backoff and finiteness on orders."""
    price, k = F.col("o_totalprice"), F.col("o_orderkey")
    odd = F.when(k % 7 == 0, F.lit(float("nan"))).when(k % 11 == 0, F.lit(float("inf"))).when(k % 13 == 0, F.lit(None)).otherwise(price)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.round(scalars.implied_index(price, price + 10, F.when(k % 5 == 0, F.lit(0.0)).otherwise(price), (k % 100) / 10000.0), 6).alias("implied"), scalars.max_loss_dollars(F.lit(5.0), (k % 28) / 4.0 - 1).alias("loss"),
        F.round(scalars.years_between(F.col("o_orderdate"), F.expr("TIMESTAMP_NTZ '2002-01-01 00:00:00'")), 9).alias("years"), scalars.backoff_seconds(k % 9 + 1, 1.0, 60.0).alias("backoff"), scalars.is_finite(odd).alias("finite"),
        scalars.lookup(F.col("o_orderstatus"), {"O": "open", "F": "filled"}, "other").alias("status"), scalars.in_entry_window(F.hour("o_orderdate"), F.lit(9), F.lit(16)).alias("in_window"),
    )


SCALAR_PRICES = """SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN round(o_totalprice * ((o_totalprice + 10) / o_totalprice) * exp((o_orderkey % 100) / 10000.0), 6) END AS implied, CASE WHEN (o_orderkey % 28) / 4.0 - 1 >= 0 AND (o_orderkey % 28) / 4.0 - 1 < 5 THEN (5.0 - ((o_orderkey % 28) / 4.0 - 1)) * 100 END AS loss,
round((epoch_us(TIMESTAMP '2002-01-01') - epoch_us(o_orderdate)) / 1e6 / (365.25 * 86400), 9) AS years, least(pow(2.0, o_orderkey % 9), 60.0) AS backoff, o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0 AS finite, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'filled' ELSE 'other' END AS status, hour(o_orderdate) >= 9 AND hour(o_orderdate) < 16 AS in_window FROM orders"""

_KEY = b"a public test key"


def signed_ids(spark, sf_dir):
    """Short ids, signatures (and whether they hold), and sealed payloads that open with the same context only."""
    name, key = F.col("c_name"), F.lit(b"0123456789abcdef")
    signed = scalars.hmac_sha256(name, _KEY)
    forged = F.when(F.col("c_custkey") % 5 == 0, F.lit("hmac-sha256:0")).otherwise(signed)
    sealed = scalars.seal(F.encode(name, "UTF-8"), key, name)
    opened = scalars.unseal(sealed, key, F.when(F.col("c_custkey") % 3 == 0, F.lit("other")).otherwise(name))
    return table(spark, sf_dir, "customer").select("c_custkey", scalars.short_id(name).alias("id"), signed.alias("signature"), scalars.signature_holds(name, forged, _KEY).alias("holds"), F.decode(opened, "UTF-8").alias("opened"))


_pad = lambda x: "".join(f"\\x{b ^ x:02X}" for b in _KEY.ljust(64, b"\0"))
SIGNED = f"""WITH s AS (SELECT *, 'hmac-sha256:' || sha256('{_pad(0x5C)}'::BLOB || unhex(sha256('{_pad(0x36)}'::BLOB || encode(c_name)))) AS signature FROM customer)
SELECT c_custkey, substring(sha256(c_name), 1, 24) AS id, signature, c_custkey % 5 <> 0 AS holds, CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS opened FROM s"""


def field_paths(spark, sf_dir):
    """Paths of each event's properties, with a nested list put around some of them."""
    text = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"a": [{"b": '), F.col("props"), F.lit('}, 1], "c": {}}'))).otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select(F.array_join(scalars.json_paths()(text), ",").alias("paths")).groupBy("paths").agg(F.count("*").alias("n"))


FIELD_PATHS = """SELECT paths, count(*) AS n FROM (SELECT CASE WHEN event_id % 2 = 0 THEN array_to_string(list_sort(list_concat(['a', 'a[]', 'a[].b', 'c'], list_transform(json_keys(props), lambda k: 'a[].b.' || k))), ',') ELSE array_to_string(list_sort(json_keys(props)), ',') END AS paths FROM events) GROUP BY 1"""


def chain_days(spark, sf_dir):
    """Days that make a chain day: bars of the events and quotes of both kinds, with some broken."""
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    v, k = F.col("value"), F.col("event_id")
    bars = e.where("event_type <> 'click'").select("day", v.alias("open"), (v + F.when(k % 4001 == 0, -1).otherwise(1)).alias("high"), (v * 0.5).alias("low"), v.alias("close"), (k % 50).cast("double").alias("volume"))
    quotes = e.where("event_type = 'click'").select("day", F.when(k % 3001 == 0, F.repeat(F.lit("S"), 20)).otherwise(F.repeat(F.lit("S"), 21)).alias("symbol"), F.when(k % 17 != 0, v).alias("bid"), (v + 1).alias("ask"), F.lit(1).alias("bid_size"), F.lit(1).alias("ask_size"))
    days = e.select("day").union(spark.sql("SELECT DATE '1990-01-01' AS day"))
    return quality.day_violations(bars, quotes, days).withColumn("reasons", _joined("reasons"))


CHAIN_DAYS = f"""WITH e AS (SELECT *, CAST(ts AS DATE) AS day, value AS v, event_id AS k FROM events), b AS (SELECT day, count(*) AS n, count(*) FILTER (v * 0.5 > v + CASE WHEN k % 4001 = 0 THEN -1 ELSE 1 END OR NOT v BETWEEN v * 0.5 AND v + CASE WHEN k % 4001 = 0 THEN -1 ELSE 1 END OR least(v, v * 0.5, v - 1) <= 0 AND least(v, v + CASE WHEN k % 4001 = 0 THEN -1 ELSE 1 END, v * 0.5) <= 0) AS bad FROM e WHERE event_type <> 'click' GROUP BY 1),
q AS (SELECT day, count(*) AS n, count(*) FILTER (k % 3001 = 0 OR (k % 17 <> 0 AND v < 0) OR v + 1 < 0) AS bad FROM e WHERE event_type = 'click' GROUP BY 1), d AS (SELECT DISTINCT day FROM e UNION SELECT DATE '1990-01-01'),
j AS (SELECT d.day, coalesce(b.n, 0) AS n_bars, coalesce(b.bad, 0) AS n_bars_bad, coalesce(q.n, 0) AS n_quotes, coalesce(q.bad, 0) AS n_quotes_bad FROM d LEFT JOIN b ON d.day = b.day LEFT JOIN q ON d.day = q.day)
SELECT *, array_to_string({_list(("n_bars = 0", "NO_BARS"), ("n_quotes = 0", "NO_QUOTES"), ("n_bars_bad > 0", "BAD_BARS"), ("n_quotes_bad > 0", "BAD_QUOTES"))}, ',') AS reasons FROM j"""


QUERIES = {
    "feed_quality": (feed_quality, FEED_QUALITY), "feed_snapshot": (feed_snapshot, FEED_SNAPSHOT), "risk_gate_nine": (risk_gate_nine, RISK_GATE), "promotion_six_thresholds": (promotion_six_thresholds, PROMOTION_SIX),
    "readiness_evidence": (readiness_evidence, READINESS_EVIDENCE), "shadow_evidence": (shadow_evidence, SHADOW), "event_timeline": (event_timeline, EVENT_TIMELINE), "event_risk_lock": (event_risk_lock, EVENT_RISK_LOCK),
    "execution_opening": (execution_opening, EXECUTION), "execution_pnl_path": (execution_pnl_path, PNL_PATH), "calendar_sessions": (calendar_sessions, CALENDAR_SESSIONS), "market_states": (market_states, MARKET_STATES),
    "contract_rules": (contract_rules, CONTRACT), "scout_candidates": (scout_candidates, SCOUT), "attribution_signals": (attribution_signals, SIGNALS), "outcome_requests": (outcome_requests, OUTCOME_REQUESTS),
    "review_transitions": (review_transitions, REVIEWS), "replay_faults": (replay_faults, REPLAY), "shared_samples": (shared_samples, SHARED), "governance_champions": (governance_champions, CHAMPIONS),
    "governance_approvals": (governance_approvals, APPROVALS), "delivery_dispatch": (delivery_dispatch, DISPATCH), "delivery_escalations": (delivery_escalations, ESCALATIONS), "delivery_acknowledgements": (delivery_acknowledgements, ACKS),
    "alert_escalations": (alert_escalations, ALERT_ESCALATIONS), "alert_projection": (alert_projection, PROJECTION), "operations_overview": (operations_overview, OVERVIEW), "scalar_prices": (scalar_prices, SCALAR_PRICES),
    "signed_ids": (signed_ids, SIGNED), "field_paths": (field_paths, FIELD_PATHS), "chain_days": (chain_days, CHAIN_DAYS),
}
