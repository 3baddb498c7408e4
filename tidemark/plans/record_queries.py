"""Point-in-time records, ledgers, gates, workflow state and ordered folds."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import asof, rules
from tidemark.session import cut, table
from tidemark.streaming import feeds, folds


def pit_latest_revision(spark, sf_dir):
    """The view of every customer's latest order that had been seen by a day (first seen up to 4 days after its date)."""
    o = table(spark, sf_dir, "orders")
    rows = o.select(F.col("o_custkey").alias("logical_key"), F.col("o_orderkey").alias("record_id"), F.to_date("o_orderdate").alias("published"), F.expr("date_add(to_date(o_orderdate), CAST(o_orderkey % 5 AS INT))").alias("first_seen"), "o_totalprice")
    return asof.latest_revision(rows, "logical_key", F.lit("1998-06-01").cast("date"), "first_seen", ["first_seen", "published", "record_id"])


PIT = """SELECT logical_key, record_id, published, first_seen, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY logical_key ORDER BY first_seen DESC, published DESC, record_id DESC) AS rn FROM (
  SELECT o_custkey AS logical_key, o_orderkey AS record_id, CAST(o_orderdate AS DATE) AS published, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 5 AS INTEGER) AS first_seen, o_totalprice FROM orders) WHERE first_seen <= DATE '1998-06-01') WHERE rn = 1"""


def outcome_counts(spark, sf_dir):
    """Every order ends in exactly one outcome, in fixed precedence."""
    k, total = F.col("o_orderkey"), F.col("o_totalprice")
    outcome = rules.first_of([(k % 13 == 0, "GAP"), (k % 7 == 0, "ALREADY_PRESENT"), (total < 1000, "SKIPPED_NO_ANCHOR"), (F.col("o_orderstatus") == "P", "SKIPPED_COVERAGE")], "LABELLED")
    return table(spark, sf_dir, "orders").groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


OUTCOMES = "SELECT CASE WHEN o_orderkey % 13 = 0 THEN 'GAP' WHEN o_orderkey % 7 = 0 THEN 'ALREADY_PRESENT' WHEN o_totalprice < 1000 THEN 'SKIPPED_NO_ANCHOR' WHEN o_orderstatus = 'P' THEN 'SKIPPED_COVERAGE' ELSE 'LABELLED' END AS outcome, count(*) AS n FROM orders GROUP BY 1"


def promotion_gate(spark, sf_dir):
    """Required slices (line status by return flag, and one that never occurs) against their evidence: a missing slice
    and every broken threshold is a reason."""
    evidence = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linestatus").alias("event_type"), F.col("l_returnflag").alias("regime")).agg(
        F.count("*").alias("n"), F.round(F.avg((F.col("l_discount") > 0.08).cast("int").cast("double")), 6).alias("cross_rate"), F.max("l_quantity").alias("worst")
    )
    need = spark.createDataFrame([(e, r) for e in "FO" for r in "ANRX"], "event_type string, regime string")
    rows = need.join(evidence, ["event_type", "regime"], "left")
    seen = F.col("n").isNotNull()
    why = rules.reasons([(~seen, "MISSING_SLICE"), (seen & F.coalesce(F.col("n") < 10000, F.lit(False)), "TOO_FEW_SAMPLES"), (seen & F.coalesce(F.col("cross_rate") > 0.15, F.lit(False)), "CROSS_RATE"), (seen & F.coalesce(F.col("worst") > 100, F.lit(False)), "DRAWDOWN")])
    return rows.select("event_type", "regime", "n", F.array_join(why, ",").alias("reasons"), (F.size(why) == 0).alias("passed"))


PROMOTION = """WITH need AS (SELECT e.e AS event_type, r.r AS regime FROM (VALUES ('F'), ('O')) e(e), (VALUES ('A'), ('N'), ('R'), ('X')) r(r)),
ev AS (SELECT l_linestatus AS event_type, l_returnflag AS regime, count(*) AS n, round(avg(CAST(l_discount > 0.08 AS INTEGER)), 6) AS cross_rate, max(l_quantity) AS worst FROM lineitem GROUP BY 1, 2),
j AS (SELECT event_type, regime, n, concat_ws(',', CASE WHEN n IS NULL THEN 'MISSING_SLICE' END, CASE WHEN n < 10000 THEN 'TOO_FEW_SAMPLES' END, CASE WHEN cross_rate > 0.15 THEN 'CROSS_RATE' END, CASE WHEN worst > 100 THEN 'DRAWDOWN' END) AS reasons
FROM need LEFT JOIN ev USING (event_type, regime)) SELECT event_type, regime, n, reasons, reasons = '' AS passed FROM j"""


def readiness_blockers(spark, sf_dir):
    """Seven requirements of every nation against its evidence (suppliers): missing, not verified or expired."""
    need = table(spark, sf_dir, "nation").select("n_nationkey", F.explode(F.array(*(F.lit(k) for k in range(7)))).alias("requirement"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), (F.col("s_suppkey") % 9).cast("int").alias("requirement"), "s_suppkey", F.col("s_acctbal").alias("score"))
    last = asof.latest_per_key(s, ["n_nationkey", "requirement"], ["s_suppkey"], ["score"])
    rows = need.join(last, ["n_nationkey", "requirement"], "left")
    state = rules.first_of([(F.col("score").isNull(), "MISSING"), (F.col("score") < 0, "NOT_VERIFIED"), (F.col("score") < 2000, "EXPIRED")], "VERIFIED")
    return rows.select("n_nationkey", "requirement", state.alias("state"))


READINESS = """WITH need AS (SELECT n_nationkey, CAST(range AS INTEGER) AS requirement FROM nation, range(7)),
s AS (SELECT s_nationkey AS n_nationkey, CAST(s_suppkey % 9 AS INTEGER) AS requirement, max_by(s_acctbal, s_suppkey) AS score FROM supplier GROUP BY 1, 2)
SELECT n_nationkey, requirement, CASE WHEN score IS NULL THEN 'MISSING' WHEN score < 0 THEN 'NOT_VERIFIED' WHEN score < 2000 THEN 'EXPIRED' ELSE 'VERIFIED' END AS state FROM need LEFT JOIN s USING (n_nationkey, requirement)"""


def decision_gates(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    bal, seg = F.col("c_acctbal"), F.col("c_mktsegment")
    why = rules.reasons([(bal < 0, "RISK_LOCK"), (seg == "MACHINERY", "STALE_DATA"), (F.col("c_nationkey") % 5 == 0, "SESSION_CLOSED"), (bal > 9000, "LIMIT")])
    return c.select("c_custkey", F.array_join(why, ",").alias("reasons"), rules.decision(why).alias("action"))


GATES = """WITH r AS (SELECT c_custkey, concat_ws(',', CASE WHEN c_acctbal < 0 THEN 'RISK_LOCK' END, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'STALE_DATA' END, CASE WHEN c_nationkey % 5 = 0 THEN 'SESSION_CLOSED' END, CASE WHEN c_acctbal > 9000 THEN 'LIMIT' END) AS reasons FROM customer)
SELECT c_custkey, reasons, CASE WHEN reasons = '' THEN 'WAIT' ELSE 'NO_TRADE' END AS action FROM r"""


def risk_lock_state(spark, sf_dir):
    """Orders as risk events: locked until settled, then stabilising for 30 days, then cleared; with the time to look again."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"), "o_orderstatus")
    now = F.lit("2000-01-01").cast("date")
    state = rules.first_of([(F.col("day") > now, "SCHEDULED"), (F.col("o_orderstatus") == "O", "LOCKED"), (F.date_add("day", 30) > now, "STABILIZING")], "CLEARED")
    return o.withColumn("state", state).select("o_orderkey", "state", F.when(F.col("state") == "STABILIZING", F.date_add("day", 30)).alias("rerun_at"))


RISK = """SELECT o_orderkey, state, CASE WHEN state = 'STABILIZING' THEN day + 30 END AS rerun_at FROM (SELECT o_orderkey, day, CASE WHEN day > DATE '2000-01-01' THEN 'SCHEDULED' WHEN o_orderstatus = 'O' THEN 'LOCKED' WHEN day + 30 > DATE '2000-01-01' THEN 'STABILIZING' ELSE 'CLEARED' END AS state
FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, o_orderstatus FROM orders))"""


def next_checkpoint(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    points = F.array(*(F.date_add("day", k) for k in (1, 7, 30)))
    return o.select("o_orderkey", F.array_min(F.filter(points, lambda p: p > F.lit("1998-01-01").cast("date"))).alias("next_at"))


CHECKPOINT = """SELECT o_orderkey, list_min(list_filter([day + 1, day + 7, day + 30], lambda p: p > DATE '1998-01-01')) AS next_at FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders)"""


def hash_chain_verify(spark, sf_dir):
    """Every nation's customers as a ledger: entry hashes are of the own content, previous hashes link to the entry before.
    Some links and some hashes are false; the operator finds them without trusting any stored value."""
    c = table(spark, sf_dir, "customer")
    w = Window.partitionBy("c_nationkey").orderBy("c_custkey")
    own = lambda name: F.sha2(F.concat_ws("|", F.col("seq").cast("string"), F.col(name)), 256)
    rows = c.withColumn("seq", F.row_number().over(w)).withColumn("good", own("c_name"))
    rows = rows.withColumn("entry", F.when(F.col("c_custkey") % 211 == 0, F.lit("x")).otherwise(F.col("good")))
    rows = rows.withColumn("previous", F.when(F.col("c_custkey") % 97 == 0, "y").otherwise(F.coalesce(F.lag("entry").over(w), F.lit("GENESIS"))))
    return rules.chain_breaks(rows, ["c_nationkey"], "seq", "previous", "entry", own("c_name"), "GENESIS")


CHAIN = """WITH a AS (SELECT c_nationkey, c_custkey, c_name, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS seq FROM customer),
b AS (SELECT *, sha256(CAST(seq AS VARCHAR) || '|' || c_name) AS good FROM a), c AS (SELECT *, CASE WHEN c_custkey % 211 = 0 THEN 'x' ELSE good END AS entry FROM b),
d AS (SELECT *, coalesce(lag(entry) OVER (PARTITION BY c_nationkey ORDER BY seq), 'GENESIS') AS want FROM c), e AS (SELECT *, CASE WHEN c_custkey % 97 = 0 THEN 'y' ELSE want END AS previous FROM d)
SELECT c_nationkey, count(*) AS entries, count(*) FILTER (previous <> want) AS bad_links, CAST(0 AS BIGINT) AS bad_sequence, count(*) FILTER (entry <> good) AS bad_hashes FROM e GROUP BY c_nationkey"""


def lineage_recursive(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") > 1, F.floor(F.col("s_suppkey") / 2)).alias("parent"))
    return rules.lineage(s, "s_suppkey", "parent")


LINEAGE = """WITH RECURSIVE s AS (SELECT s_suppkey, CASE WHEN s_suppkey > 1 THEN s_suppkey // 2 END AS parent FROM supplier),
l AS (SELECT s_suppkey, parent AS ancestor, 1 AS distance FROM s WHERE parent IS NOT NULL UNION ALL SELECT l.s_suppkey, s.parent, l.distance + 1 FROM l JOIN s ON l.ancestor = s.s_suppkey WHERE s.parent IS NOT NULL)
SELECT s_suppkey, ancestor, distance FROM l"""


def attribution_confidence(spark, sf_dir):
    """Per order: whether all, some or none of its lines agree, and the best confidence damped accordingly."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.bool_and(F.col("l_returnflag") == "N").alias("every"), F.bool_or(F.col("l_returnflag") == "N").alias("some"), F.max("l_discount").alias("best"))
    factor = F.when(F.col("every"), 1.0).when(F.col("some"), 0.5).otherwise(0.25)
    return rows.select("l_orderkey", rules.first_of([(F.col("every"), "ALL"), (F.col("some"), "SOME")], "NONE").alias("coherence"), F.round(F.col("best") * factor, 4).alias("confidence"))


ATTRIBUTION = """SELECT l_orderkey, CASE WHEN every THEN 'ALL' WHEN part THEN 'SOME' ELSE 'NONE' END AS coherence, round(best * CASE WHEN every THEN 1.0 WHEN part THEN 0.5 ELSE 0.25 END, 4) AS confidence
FROM (SELECT l_orderkey, bool_and(l_returnflag = 'N') AS every, bool_or(l_returnflag = 'N') AS part, max(l_discount) AS best FROM lineitem GROUP BY l_orderkey)"""


def effective_status(spark, sf_dir):
    """Each order's last flag. Some orders have a line number twice on one day: of such lines the first in the table's files counts."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
    changes = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'N'").select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag", "l_shipdate", "l_linenumber", *place)
    return rules.effective_status(o, changes, "o_orderkey", "l_returnflag", ["l_shipdate", "l_linenumber"], "OPEN", ["file", "row"]).select("o_orderkey", "effective_status")


STATUS = """SELECT o_orderkey, coalesce(s, 'OPEN') AS effective_status FROM orders LEFT JOIN (SELECT l_orderkey, first(l_returnflag ORDER BY l_shipdate DESC, l_linenumber DESC) AS s FROM lineitem WHERE l_returnflag <> 'N' GROUP BY l_orderkey) ON l_orderkey = o_orderkey"""


def union_all_tagged(spark, sf_dir):
    tag = lambda name, key: table(spark, sf_dir, name).select(F.lit(name).alias("kind"), F.col(key).cast("long").alias("id"))
    return tag("customer", "c_custkey").unionByName(tag("supplier", "s_suppkey")).unionByName(tag("nation", "n_nationkey")).groupBy("kind").agg(F.count("*").alias("n"), F.max("id").alias("last"))


UNION = "SELECT kind, count(*) AS n, max(id) AS last FROM (SELECT 'customer' AS kind, c_custkey AS id FROM customer UNION ALL SELECT 'supplier', s_suppkey FROM supplier UNION ALL SELECT 'nation', CAST(n_nationkey AS BIGINT) FROM nation) GROUP BY kind"


def ordered_digest(spark, sf_dir):
    """A digest of each nation's customers in order, in two levels: of at most 256 consecutive keys, then of the digests,
    so that no list grows with the table beyond one hash for 256 rows."""
    c = table(spark, sf_dir, "customer").select("c_nationkey", F.expr("c_custkey div 256").alias("part"), "c_custkey", F.concat_ws("|", F.col("c_custkey").cast("string"), "c_name").alias("row"))
    level = lambda rows, keys, order, value: rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, value))).alias("x")).select(*keys, F.sha2(F.array_join(F.col(f"x.{value}"), "\n"), 256).alias("digest"))
    return level(level(c, ["c_nationkey", "part"], "c_custkey", "row"), ["c_nationkey"], "part", "digest")


DIGEST = """SELECT c_nationkey, sha256(string_agg(d, chr(10) ORDER BY part)) AS digest FROM (SELECT c_nationkey, c_custkey // 256 AS part, sha256(string_agg(CAST(c_custkey AS VARCHAR) || '|' || c_name, chr(10) ORDER BY c_custkey)) AS d FROM customer GROUP BY 1, 2) GROUP BY c_nationkey"""


def json_key_allowlist(spark, sf_dir):
    keys = F.json_object_keys("props")
    fine = F.size(F.array_except(keys, F.array(F.lit("k")))) == 0
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(fine).alias("n_allowed"), F.count_if(~fine).alias("n_refused"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("total"))


ALLOWLIST = """SELECT event_type, count(*) FILTER (len(list_filter(json_keys(props), lambda k: k <> 'k')) = 0) AS n_allowed, count(*) FILTER (len(list_filter(json_keys(props), lambda k: k <> 'k')) > 0) AS n_refused, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY event_type"""


def tumbling_bars(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    bars = e.groupBy("event_type", F.window("ts", "6 hours").alias("w")).agg(F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "ts").alias("close"), F.count("*").alias("n"))
    return bars.select("event_type", F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("start"), "open", "high", "low", "close", "n")


TUMBLING = """SELECT event_type, strftime(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2000-01-01'), '%Y-%m-%d %H:%M') AS start, min_by(value, ts) AS open, max(value) AS high, min(value) AS low, max_by(value, ts) AS close, count(*) AS n FROM events GROUP BY 1, 2"""


def user_sessions(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = e.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))
    return rows.select("user_id", "n", "first_id", "last_id")


SESSIONS = """WITH g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM s GROUP BY user_id, k"""


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value", F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("us"))


def alert_cooldown_fold(spark, sf_dir):
    """Each user's events as alert candidates: active above a value, two in a row needed, a cooldown of six hours."""
    rows = _events(spark, sf_dir).select(F.col("user_id").cast("string").alias("fingerprint"), F.col("event_id").alias("seq"), (F.col("us") / 1e6).alias("at"), (F.col("value") > 20).alias("active"))
    return folds.fold(rows, "fingerprint", ["seq"], folds.alert_step(cooldown=21600.0), "fingerprint string, seq long, outcome string, suppressed long")


def outbox_fold(spark, sf_dir):
    """Each user's events as messages: one for each cooldown window that slides with every message."""
    rows = _events(spark, sf_dir).select(F.concat_ws(":", "user_id", "event_type").alias("dedupe_key"), F.col("event_id").cast("string").alias("message_id"), F.col("event_id").alias("seq"), (F.col("us") / 1e6).alias("at"))
    return feeds.outbox(rows, cooldown=86400.0)


OUTBOX = """SELECT dedupe_key, CAST(event_id AS VARCHAR) AS message_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY dedupe_key ORDER BY ts, event_id) < INTERVAL 24 HOUR THEN 'SUPPRESSED' ELSE 'ENQUEUED' END AS outcome
FROM (SELECT user_id || ':' || event_type AS dedupe_key, * FROM events)"""


def delivery_fold(spark, sf_dir):
    rows = _events(spark, sf_dir).select(F.col("user_id").cast("string").alias("message_id"), F.col("event_id").alias("seq"), (F.col("us") / 1e6).alias("at"), (F.col("value") > 60).alias("ok"))
    return folds.fold(rows, "message_id", ["at", "seq"], folds.delivery_step(), "message_id string, seq long, attempt long, outcome string, due double")


def _feed(spark, sf_dir):
    kind = F.when(F.col("event_id") % 500 == 0, "CONNECTION_LOST").when(F.col("event_id") % 90 < 2, "CONNECTED").when(F.col("event_id") % 100 == 7, "HEARTBEAT").otherwise("QUOTE")
    first = F.row_number().over(Window.partitionBy("event_type").orderBy("event_id")) == 1
    rows = _events(spark, sf_dir).select(
        F.col("event_type").alias("provider"), F.col("event_id").cast("string").alias("event_id"), F.col("event_id").alias("seq"), F.when(first, "START").otherwise(kind).alias("kind"), (F.col("us") / 1e6).alias("at"),
        F.lit("v1").alias("schema_version"), ((F.col("us") / 1e6) - F.col("event_id") % 3).alias("source_ts"), F.col("event_id").cast("string").alias("payload"),
    )
    return rows


def collector_fold(spark, sf_dir):
    """Each event type's feed: event kinds by id, quotes in between."""
    return feeds.collect(_feed(spark, sf_dir), folds.Collector(fresh=3600.0))


def collector_report(spark, sf_dir):
    """What a run of each of these feeds comes to, with capabilities by the length of their names, and a session that is closed at odd hours."""
    events = cut(_feed(spark, sf_dir))
    told = cut(feeds.collect(events, folds.Collector(fresh=3600.0)))
    size = F.length("provider")
    able = events.select("provider").distinct().select("provider", (size % 2 == 0).alias("configured"), F.when(size % 3 != 0, F.lit("VERIFIED")).alias("verification_status"), F.lit(True).alias("production_ready"), F.lit("GREEN").alias("quality"))
    gate = lambda at: F.when(F.hour(at) % 2 == 1, F.array(F.lit("SESSION_CLOSED")))
    found = feeds.run_report(events, told, able, gate=gate)
    return found.withColumn("reasons", F.array_join("reasons", ","))


def checkpoint_manifests(spark, sf_dir):
    """Events as checkpoints and customers as manifests, joined on what their JSON documents say, with the schema's version."""
    c = table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
    doc = F.to_json(F.struct(F.struct(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 3).alias("schema")).alias("manifest")))
    m = table(spark, sf_dir, "customer").select(doc.alias("doc")).select(F.get_json_object("doc", "$.manifest.id").cast("long").alias("k"), F.get_json_object("doc", "$.manifest.schema").cast("int").alias("schema"))
    versions = spark.createDataFrame([(0, "v1"), (1, "v2")], "schema int, version string")
    return c.join(m, "k").join(versions, "schema").groupBy("version").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


CHECKPOINTS = """SELECT CASE c_custkey % 3 WHEN 0 THEN 'v1' ELSE 'v2' END AS version, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM events JOIN customer ON CAST(json_extract_string(props, '$.k') AS BIGINT) = c_custkey WHERE c_custkey % 3 < 2 GROUP BY 1"""


def audit_integrity(spark, sf_dir):
    """One row of what an audit counts: lines without an order, orders without a line, repeated keys, and values out of range."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    lines = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n_lines"), F.count_if((F.col("l_discount") < 0) | (F.col("l_discount") > 0.1)).alias("bad"))
    both = o.groupBy("o_orderkey").agg(F.count("*").alias("n")).join(lines, "o_orderkey", "full")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return both.agg(zero(F.sum(F.when(F.col("n").isNull(), F.col("n_lines")))).alias("lines_without_order"), F.count_if(F.col("n_lines").isNull()).alias("orders_without_line"), F.count_if(F.col("n") > 1).alias("repeated_keys"), zero(F.sum("bad")).alias("out_of_range"))


INTEGRITY = """SELECT (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) AS lines_without_order, (SELECT count(DISTINCT o_orderkey) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) AS orders_without_line,
(SELECT count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)) AS repeated_keys, (SELECT count(*) FROM lineitem WHERE l_discount < 0 OR l_discount > 0.1) AS out_of_range"""


ALERTS = """WITH RECURSIVE e AS (SELECT user_id, event_id AS seq, epoch_us(ts) / 1e6 AS t, value > 20 AS active, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
f AS (SELECT user_id, rn, seq, CASE WHEN active THEN 1 ELSE 0 END AS run, CAST(NULL AS DOUBLE) AS made, CAST(0 AS BIGINT) AS suppressed, CASE WHEN active THEN 'PENDING' ELSE 'INACTIVE' END AS outcome FROM e WHERE rn = 1
UNION ALL SELECT user_id, rn, seq, run, CASE WHEN outcome = 'CREATED' THEN t ELSE made END, CASE outcome WHEN 'CREATED' THEN 0 WHEN 'SUPPRESSED' THEN suppressed + 1 ELSE suppressed END, outcome
  FROM (SELECT e.user_id, e.rn, e.seq, t, made, suppressed, CASE WHEN active THEN run + 1 ELSE 0 END AS run, CASE WHEN NOT active THEN 'INACTIVE' WHEN run + 1 < 2 THEN 'PENDING' WHEN t < made THEN 'TIME_REGRESSION' WHEN t - made < 21600 THEN 'SUPPRESSED' ELSE 'CREATED' END AS outcome
    FROM f JOIN e ON e.user_id = f.user_id AND e.rn = f.rn + 1))
SELECT CAST(user_id AS VARCHAR) AS fingerprint, seq, outcome, suppressed FROM f"""

DELIVERY = """WITH RECURSIVE e AS (SELECT user_id, event_id AS seq, epoch_us(ts) / 1e6 AS t, value > 60 AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
f AS (SELECT user_id, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS seq, CAST(0 AS BIGINT) AS attempt, false AS ended, CAST(NULL AS DOUBLE) AS next, '' AS outcome, CAST(NULL AS DOUBLE) AS due FROM (SELECT DISTINCT user_id FROM events)
UNION ALL SELECT user_id, rn, seq, attempt, ended OR outcome IN ('DELIVERED', 'DEAD_LETTERED'), CASE WHEN outcome = 'RETRY_SCHEDULED' THEN t + least(pow(2, attempt - 1), 4.0) ELSE next END, outcome, CASE WHEN outcome = 'RETRY_SCHEDULED' THEN t + least(pow(2, attempt - 1), 4.0) END
  FROM (SELECT e.user_id, e.rn, e.seq, t, ended, next, CASE WHEN ended OR t < next THEN attempt ELSE attempt + 1 END AS attempt, CASE WHEN ended THEN 'TERMINAL' WHEN t < next THEN 'NOT_DUE' WHEN ok THEN 'DELIVERED' WHEN attempt + 1 < 3 THEN 'RETRY_SCHEDULED' ELSE 'DEAD_LETTERED' END AS outcome
    FROM f JOIN e ON e.user_id = f.user_id AND e.rn = f.rn + 1))
SELECT CAST(user_id AS VARCHAR) AS message_id, seq, attempt, outcome, due FROM f WHERE rn > 0"""

#: x: the event with the state before it; y: what is wrong with it, and the state after it; z: freshness.
COLLECTED = """WITH RECURSIVE e AS (SELECT event_type AS provider, event_id AS seq, epoch_us(ts) / 1e6 AS t, epoch_us(ts) / 1e6 - event_id % 3 AS source_ts, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn,
  CASE WHEN row_number() OVER (PARTITION BY event_type ORDER BY event_id) = 1 THEN 'START' WHEN event_id % 500 = 0 THEN 'CONNECTION_LOST' WHEN event_id % 90 < 2 THEN 'CONNECTED' WHEN event_id % 100 = 7 THEN 'HEARTBEAT' ELSE 'QUOTE' END AS kind FROM events),
f AS (SELECT provider, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS seq, 'STOPPED' AS state, CAST(0 AS BIGINT) AS tries, CAST(NULL AS DOUBLE) AS retry, CAST(NULL AS DOUBLE) AS mark, CAST(NULL AS DOUBLE) AS last, CAST(NULL AS DOUBLE) AS seen, CAST('' AS VARCHAR) AS why, false AS stale FROM (SELECT DISTINCT event_type AS provider FROM events)
UNION ALL SELECT provider, rn, seq, CASE WHEN stale THEN 'DEGRADED' ELSE state END, tries, retry, mark, last, seen, why, stale FROM (
  SELECT provider, rn, seq, new_state AS state, new_tries AS tries, CASE WHEN fine AND kind = 'CONNECTED' THEN NULL WHEN lost THEN CASE WHEN new_state = 'BACKING_OFF' THEN t + least(pow(2, new_tries - 1), 4.0) END ELSE retry END AS retry, CASE WHEN fine AND kind = 'QUOTE' THEN source_ts ELSE mark END AS mark,
    CASE WHEN lost THEN NULL WHEN fine AND kind = 'QUOTE' THEN t ELSE last END AS last, greatest(coalesce(seen, t), t) AS seen, why,
    new_state IN ('STREAMING', 'DEGRADED') AND NOT lost AND (CASE WHEN fine AND kind = 'QUOTE' THEN t ELSE last END IS NULL OR t - CASE WHEN fine AND kind = 'QUOTE' THEN t ELSE last END > 3600) AS stale
  FROM (SELECT *, why = '' AS fine, heard AND kind = 'CONNECTION_LOST' AS lost, CASE WHEN NOT heard OR (why <> '' AND why <> 'RECONNECT_BUDGET_EXHAUSTED') THEN state WHEN kind = 'START' THEN 'CONNECTING' WHEN kind IN ('CONNECTED', 'QUOTE') THEN 'STREAMING' WHEN kind = 'CONNECTION_LOST' THEN CASE WHEN tries + 1 > 3 THEN 'HALTED' ELSE 'BACKING_OFF' END ELSE state END AS new_state,
      CASE WHEN heard AND kind = 'CONNECTION_LOST' THEN tries + 1 WHEN heard AND why = '' AND kind = 'CONNECTED' THEN 0 ELSE tries END AS new_tries
    FROM (SELECT *, NOT coalesce(t < seen, false) AND state <> 'HALTED' AS heard, CASE WHEN t < seen THEN 'EVENT_TIME_REGRESSION' WHEN state = 'HALTED' THEN 'COLLECTOR_HALTED'
        WHEN kind = 'START' THEN CASE WHEN state <> 'STOPPED' THEN 'INVALID_TRANSITION' ELSE '' END
        WHEN kind = 'CONNECTED' THEN CASE WHEN state IN ('STOPPED', 'STREAMING') THEN 'INVALID_TRANSITION' WHEN t < retry THEN 'RETRY_TOO_EARLY' ELSE '' END
        WHEN kind = 'CONNECTION_LOST' THEN CASE WHEN tries + 1 > 3 THEN 'RECONNECT_BUDGET_EXHAUSTED' ELSE '' END
        WHEN state NOT IN ('STREAMING', 'DEGRADED') THEN CASE kind WHEN 'HEARTBEAT' THEN 'INVALID_TRANSITION' ELSE 'COLLECTOR_NOT_STREAMING' END
        WHEN kind = 'QUOTE' AND source_ts < mark THEN CASE WHEN source_ts < mark - 0.25 THEN 'BEHIND_WATERMARK,OUT_OF_ORDER_OBSERVATION' ELSE 'OUT_OF_ORDER_OBSERVATION' END ELSE '' END AS why
      FROM (SELECT e.provider, e.rn, e.seq, e.t, e.source_ts, e.kind, f.state, f.tries, f.retry, f.mark, f.last, f.seen FROM f JOIN e ON e.provider = f.provider AND e.rn = f.rn + 1) x) y) z))
SELECT provider, seq, state, why = '' AS accepted, array_to_string(list_sort(list_filter([CASE WHEN why <> '' THEN why END, CASE WHEN stale THEN 'COLLECTOR_STALE' END], lambda r: r IS NOT NULL)), ',') AS reasons, mark AS watermark, retry AS next_retry_at, tries AS attempts FROM f WHERE rn > 0"""

COLLECTOR_REPORT = f"""WITH k AS (SELECT event_id AS seq, ts, CASE WHEN row_number() OVER (PARTITION BY event_type ORDER BY event_id) = 1 THEN 'START' WHEN event_id % 500 = 0 THEN 'CONNECTION_LOST' WHEN event_id % 90 < 2 THEN 'CONNECTED' WHEN event_id % 100 = 7 THEN 'HEARTBEAT' ELSE 'QUOTE' END AS kind FROM events),
c AS (SELECT * FROM ({COLLECTED}) JOIN k USING (seq)),
r AS (SELECT provider, arg_max(state, seq) AS state, count(*) FILTER (accepted AND kind = 'QUOTE') AS accepted_quotes, count(*) FILTER (contains(reasons, 'OUT_OF_ORDER')) AS out_of_order, bool_or(contains(reasons, 'RECONNECT_BUDGET')) AS spent, arg_max(ts, seq) AS last,
  arg_max(coalesce(watermark, 'NaN'::DOUBLE), seq) AS watermark, arg_max(coalesce(next_retry_at, 'NaN'::DOUBLE), seq) AS next_retry_at FROM c GROUP BY provider)
SELECT provider, state, array_to_string(list_sort(list_filter([CASE WHEN length(provider) % 2 <> 0 THEN 'CAPABILITY_NOT_CONFIGURED' END, CASE WHEN length(provider) % 3 = 0 THEN 'CAPABILITY_UNVERIFIED' END, CASE WHEN spent THEN 'RECONNECT_BUDGET_EXHAUSTED' END,
  CASE WHEN state <> 'STREAMING' THEN 'COLLECTOR_' || state END, CASE WHEN hour(last) % 2 = 1 THEN 'SESSION_CLOSED' END, 'NO_QUALITY_REPORT'], lambda x: x IS NOT NULL)), ',') AS reasons, accepted_quotes, CAST(0 AS BIGINT) AS duplicate_events, CAST(0 AS BIGINT) AS duplicate_observations, out_of_order,
  CASE WHEN NOT isnan(watermark) THEN watermark END AS watermark, CASE WHEN NOT isnan(next_retry_at) THEN next_retry_at END AS next_retry_at FROM r"""


QUERIES = {
    "pit_latest_revision": (pit_latest_revision, PIT), "outcome_counts": (outcome_counts, OUTCOMES), "promotion_gate": (promotion_gate, PROMOTION), "readiness_blockers": (readiness_blockers, READINESS),
    "decision_gates": (decision_gates, GATES), "risk_lock_state": (risk_lock_state, RISK), "next_checkpoint": (next_checkpoint, CHECKPOINT), "hash_chain_verify": (hash_chain_verify, CHAIN),
    "lineage_recursive": (lineage_recursive, LINEAGE), "attribution_confidence": (attribution_confidence, ATTRIBUTION), "effective_status": (effective_status, STATUS), "union_all_tagged": (union_all_tagged, UNION),
    "ordered_digest": (ordered_digest, DIGEST), "json_key_allowlist": (json_key_allowlist, ALLOWLIST), "tumbling_bars": (tumbling_bars, TUMBLING), "user_sessions": (user_sessions, SESSIONS), "checkpoint_manifests": (checkpoint_manifests, CHECKPOINTS), "audit_integrity": (audit_integrity, INTEGRITY),
    "alert_cooldown_fold": (alert_cooldown_fold, ALERTS), "outbox_fold": (outbox_fold, OUTBOX), "delivery_fold": (delivery_fold, DELIVERY), "collector_fold": (collector_fold, COLLECTED), "collector_report": (collector_report, COLLECTOR_REPORT),
}
