"""Composite workflows: labels, features, walk-forward distances and economics in one plan; checks of legs and plans."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import asof, market, rules, tails
from tidemark.plans.views import view, with_views
from tidemark.session import table


def implied_series(spark, sf_dir):
    """Each bar's close scaled by the day's anchor: official close times bar close over the prior day's last close."""
    bars = view(spark, sf_dir, "bars")
    last = bars.groupBy("symbol", "day").agg(F.max_by("close", "ts").alias("f"))
    prior = last.withColumn("f_a", F.lag("f").over(Window.partitionBy("symbol").orderBy("day"))).where("f_a IS NOT NULL").select("symbol", "day", "f_a")
    rows = bars.join(prior, ["symbol", "day"])
    return rows.select("symbol", "ts", F.round(F.lit(100.0) * F.col("close") / F.col("f_a"), 6).alias("implied"))


IMPLIED = with_views(""", l AS (SELECT symbol, day, max_by(close, ts) AS f FROM bars GROUP BY symbol, day), p AS (SELECT symbol, day, lag(f) OVER (PARTITION BY symbol ORDER BY day) AS f_a FROM l)
SELECT symbol, ts, round(100.0 * close / f_a, 6) AS implied FROM bars JOIN p USING (symbol, day) WHERE f_a IS NOT NULL""", "bars")


def _labels(bars):
    """Moves of each symbol and day after its morning price, with the outcome of days that can't be labelled."""
    entry = asof.latest_per_key(bars.where("hour(ts) < 9"), ["symbol", "day"], ["ts"], ["close"]).withColumnRenamed("close", "entry")
    path = bars.where("hour(ts) BETWEEN 9 AND 16").join(entry, ["symbol", "day"])
    moved = market.excursions(path, ["symbol", "day"], "ts", "high", "low", "close", "entry")
    days = bars.select("symbol", "day").distinct().join(entry, ["symbol", "day"], "left").join(moved, ["symbol", "day"], "left")
    outcome = rules.first_of([(F.col("entry").isNull(), "SKIPPED_NO_ENTRY"), (F.coalesce("sample_count", F.lit(0)) < 6, "SKIPPED_COVERAGE")], "LABELLED")
    return days.withColumn("outcome", outcome)


LABELS = """, entry AS (SELECT symbol, day, max_by(close, ts) AS entry FROM bars WHERE hour(ts) < 9 GROUP BY symbol, day),
moved AS (SELECT symbol, day, greatest(0.0, max(high - entry)) AS up_max, greatest(0.0, max(entry - low)) AS down_max, max_by(close, ts) AS close_price, count(*) AS sample_count FROM bars JOIN entry USING (symbol, day) WHERE hour(ts) BETWEEN 9 AND 16 GROUP BY symbol, day),
labels AS (SELECT *, CASE WHEN entry IS NULL THEN 'SKIPPED_NO_ENTRY' WHEN coalesce(sample_count, 0) < 6 THEN 'SKIPPED_COVERAGE' ELSE 'LABELLED' END AS outcome FROM (SELECT DISTINCT symbol, day FROM bars) LEFT JOIN entry USING (symbol, day) LEFT JOIN moved USING (symbol, day))"""


def label_outcomes(spark, sf_dir):
    return _labels(view(spark, sf_dir, "bars")).groupBy("outcome").agg(F.count("*").alias("n"), F.round(F.max("up_max"), 6).alias("worst_up"))


LABEL_OUTCOMES = with_views(LABELS + " SELECT outcome, count(*) AS n, round(max(up_max), 6) AS worst_up FROM labels GROUP BY outcome", "bars")


def _distances(labels):
    """Walk-forward: each day's distances are the conservative quantiles of all symbols' earlier labels, at least 20 of them."""
    fine = labels.where("outcome = 'LABELLED'")
    up, down = (tails.expanding_quantile(fine, "day", c, 0.9, 1).withColumnRenamed("q", to) for c, to in (("up_max", "up"), ("down_max", "down")))
    return up.where("n_train >= 20").join(down.drop("n_train"), "day").select("day", "up", "down")


def walk_forward_economics(spark, sf_dir):
    """The whole spine: labels, walk-forward distances, coverage and settlement per day, with every day's disposition."""
    labels = _labels(view(spark, sf_dir, "bars"))
    joined = asof.reconcile(labels.where("outcome = 'LABELLED'").groupBy("day").agg(F.count("*").alias("n"), F.max("up_max").alias("up_max"), F.max("down_max").alias("down_max")), _distances(labels), "day", "LABEL", "DISTANCE")
    breach = (F.col("up_max") > F.col("up")) | (F.col("down_max") > F.col("down"))
    return joined.select("day", "disposition", F.round("up", 6).alias("up"), F.round("down", 6).alias("down"), breach.alias("breached"))


ECONOMICS = with_views(LABELS + """, f AS (SELECT * FROM labels WHERE outcome = 'LABELLED'), d AS (SELECT a.day, quantile_disc(b.up_max, 0.9) AS up, quantile_disc(b.down_max, 0.9) AS down
  FROM (SELECT DISTINCT day FROM f) a JOIN f b ON b.day < a.day GROUP BY a.day HAVING count(*) >= 20), l AS (SELECT day, max(up_max) AS up_max, max(down_max) AS down_max FROM f GROUP BY day)
SELECT coalesce(l.day, d.day) AS day, CASE WHEN l.day IS NULL THEN 'MISSING_LABEL' WHEN d.day IS NULL THEN 'MISSING_DISTANCE' ELSE 'JOINED' END AS disposition, round(up, 6) AS up, round(down, 6) AS down, up_max > up OR down_max > down AS breached
FROM l FULL JOIN d ON l.day = d.day""", "bars")


def entry_features(spark, sf_dir):
    """Per day and symbol: the latest usable quote before 15:00, median spread and realized volatility, with validity."""
    quotes, bars = view(spark, sf_dir, "quotes"), view(spark, sf_dir, "bars")
    last = asof.latest_per_key(quotes.where("hour(ts) < 15"), ["day", "symbol"], ["ts", "seq"], ["bid", "ask"])
    spread = quotes.where("hour(ts) < 15 AND bid <= ask").groupBy("day", "symbol").agg(F.median(F.col("ask") - F.col("bid")).alias("median_spread"))
    vol = market.realized_volatility(bars.where("hour(ts) < 15"), ["day", "symbol"], "ts", "close", least=10)
    rows = last.join(spread, ["day", "symbol"], "left").join(vol, ["day", "symbol"], "left")
    valid = F.coalesce((F.col("bid") <= F.col("ask")) & (F.col("n") >= 10), F.lit(False))
    return rows.select("day", "symbol", F.when(valid, F.round((F.col("bid") + F.col("ask")) / 2, 6)).alias("mid"), F.round("median_spread", 6).alias("median_spread"), F.round("vol", 6).alias("vol"), valid.alias("valid"))


FEATURES = with_views(""", l AS (SELECT day, symbol, bid, ask FROM (SELECT *, row_number() OVER (PARTITION BY day, symbol ORDER BY ts DESC, seq DESC) AS rn FROM quotes WHERE hour(ts) < 15) WHERE rn = 1),
s AS (SELECT day, symbol, median(ask - bid) AS median_spread FROM quotes WHERE hour(ts) < 15 AND bid <= ask GROUP BY day, symbol),
r AS (SELECT symbol, day, ln(close / lag(close) OVER (PARTITION BY symbol, day ORDER BY ts)) AS r FROM bars WHERE close > 0 AND hour(ts) < 15),
v AS (SELECT symbol, day, count(*) AS n, CASE WHEN count(*) >= 10 THEN coalesce(stddev_samp(r), 0.0) * sqrt(252 * 390) ELSE 0.0 END AS vol FROM r GROUP BY symbol, day)
SELECT day, symbol, CASE WHEN coalesce(bid <= ask AND n >= 10, false) THEN round((bid + ask) / 2, 6) END AS mid, round(median_spread, 6) AS median_spread, round(vol, 6) AS vol, coalesce(bid <= ask AND n >= 10, false) AS valid
FROM l LEFT JOIN s USING (day, symbol) LEFT JOIN v USING (day, symbol)""", "quotes", "bars")


def leg_match(spark, sf_dir):
    """Opening legs (odd lines) against closing legs (even lines) of each order and part group: matched only if both sides
    agree on the quantity; otherwise there is no result."""
    legs = table(spark, sf_dir, "lineitem").withColumn("leg", F.expr("(l_linenumber + 1) div 2"))
    one = legs.where("l_linenumber % 2 = 1").select("l_orderkey", "leg", F.col("l_quantity").alias("q1"), F.col("l_extendedprice").cast("decimal(18,2)").alias("p1"))
    two = legs.where("l_linenumber % 2 = 0").select("l_orderkey", "leg", F.col("l_quantity").alias("q2"), F.col("l_extendedprice").cast("decimal(18,2)").alias("p2"))
    both = one.join(two, ["l_orderkey", "leg"], "full")
    rows = both.groupBy("l_orderkey").agg(F.bool_and(F.col("q1").eqNullSafe(F.col("q2"))).alias("matched"), F.sum(F.col("p2") - F.col("p1")).cast("double").alias("pnl"), F.count("*").alias("legs"))
    return rows.select("l_orderkey", "legs", "matched", F.when(F.col("matched"), F.col("pnl")).alias("pnl"))


LEGS = """WITH l AS (SELECT *, (l_linenumber + 1) // 2 AS leg FROM lineitem), a AS (SELECT l_orderkey, leg, l_quantity AS q1, CAST(l_extendedprice AS DECIMAL(18,2)) AS p1 FROM l WHERE l_linenumber % 2 = 1),
b AS (SELECT l_orderkey, leg, l_quantity AS q2, CAST(l_extendedprice AS DECIMAL(18,2)) AS p2 FROM l WHERE l_linenumber % 2 = 0)
SELECT l_orderkey, count(*) AS legs, bool_and(q1 IS NOT DISTINCT FROM q2) AS matched, CASE WHEN bool_and(q1 IS NOT DISTINCT FROM q2) THEN CAST(sum(p2 - p1) AS DOUBLE) END AS pnl FROM a FULL JOIN b USING (l_orderkey, leg) GROUP BY l_orderkey"""


def timeline_violations(spark, sf_dir):
    """Ordering rules of each line's times, as an ordered list of the rules it breaks."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("ship")).join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.to_date("o_orderdate").alias("day")), "l_orderkey")
    why = rules.reasons([(F.col("ship") < F.col("day"), "SHIPPED_BEFORE_ORDER"), (F.col("ship") > F.date_add("day", 100), "TOO_LATE"), (F.dayofweek("ship") == 1, "ON_SUNDAY")])
    return rows.withColumn("why", F.array_join(why, ",")).groupBy("why").agg(F.count("*").alias("n"))


TIMELINE = """SELECT concat_ws(',', CASE WHEN ship < day THEN 'SHIPPED_BEFORE_ORDER' END, CASE WHEN ship > day + 100 THEN 'TOO_LATE' END, CASE WHEN isodow(ship) = 7 THEN 'ON_SUNDAY' END) AS why, count(*) AS n
FROM (SELECT CAST(l_shipdate AS DATE) AS ship, CAST(o_orderdate AS DATE) AS day FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY 1"""


def plan_cost(spark, sf_dir):
    """Cost of each customer's plan, approved up to a ceiling."""
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("cost"), F.count("*").alias("n"))
    return rows.select("o_custkey", "n", F.col("cost").cast("double").alias("cost"), F.when(F.col("cost") <= 1500000, "APPROVED").otherwise("REFUSED").alias("state"))


PLAN = "SELECT o_custkey, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS cost, CASE WHEN sum(CAST(o_totalprice AS DECIMAL(18,2))) <= 1500000 THEN 'APPROVED' ELSE 'REFUSED' END AS state FROM orders GROUP BY o_custkey"


def status_rollup(spark, sf_dir):
    """Per customer: ERROR over FAIL over PASS of its orders' states, and whether ids are unique."""
    rank = F.when(F.col("o_orderstatus") == "P", 2).when(F.col("o_orderstatus") == "F", 1).otherwise(0)
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max(rank).alias("r"), (F.count_distinct("o_orderkey") == F.count("o_orderkey")).alias("unique_ids"), F.count_distinct(F.to_date("o_orderdate")).alias("days"))
    return rows.select("o_custkey", rules.first_of([(F.col("r") == 2, "ERROR"), (F.col("r") == 1, "FAIL")], "PASS").alias("status"), "unique_ids", "days")


ROLLUP = "SELECT o_custkey, CASE WHEN bool_or(o_orderstatus = 'P') THEN 'ERROR' WHEN bool_or(o_orderstatus = 'F') THEN 'FAIL' ELSE 'PASS' END AS status, count(DISTINCT o_orderkey) = count(o_orderkey) AS unique_ids, count(DISTINCT CAST(o_orderdate AS DATE)) AS days FROM orders GROUP BY o_custkey"


def latest_decisions(spark, sf_dir):
    """The 1000 most recent records, newest first (the limit is the feature)."""
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(1000).select("o_orderkey", "o_orderdate")


DECISIONS = "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1000"


def events_after_cursor(spark, sf_dir):
    """Every event after one cursor, the first purchase, in the order of ids."""
    e = table(spark, sf_dir, "events")
    first = e.where("event_type = 'purchase'").agg(F.coalesce(F.min("event_id"), F.lit(0)).alias("cursor"))
    return e.crossJoin(F.broadcast(first)).where("event_id > cursor").select("event_id", "event_type").orderBy("event_id")  # one row


CURSOR = "SELECT event_id, event_type FROM events, (SELECT coalesce(min(event_id), 0) AS first FROM events WHERE event_type = 'purchase') WHERE event_id > first ORDER BY event_id"


def events_after_delivery(spark, sf_dir):
    """Every event after its user's cursor, the user's last purchase (all events of a user without one), ordered by id."""
    e = table(spark, sf_dir, "events")
    cursors = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.max("event_id").alias("cursor"))
    return asof.after_cursor(e, cursors, ["user_id"], "event_id", "cursor").select("event_id", "user_id", "event_type").orderBy("event_id")


DELIVERY = """WITH c AS (SELECT user_id, max(event_id) AS upto FROM events WHERE event_type = 'purchase' GROUP BY user_id)
SELECT event_id, e.user_id, event_type FROM events e LEFT JOIN c ON e.user_id = c.user_id WHERE upto IS NULL OR event_id > upto ORDER BY event_id"""


def manifest_check(spark, sf_dir):
    """A manifest (every customer's order count, some of them false or missing) against what the orders hold."""
    have = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("have"))
    want = table(spark, sf_dir, "customer").where("c_custkey % 10 <> 3").select(F.col("c_custkey").alias("k"), F.col("c_custkey").alias("c")).join(have, "k", "left").select("k", F.when(F.col("k") % 7 == 0, F.lit(-1)).otherwise(F.coalesce("have", F.lit(0))).alias("want"))
    rows = asof.reconcile(want, have, "k", "ENTRY", "RECORD")
    reason = rules.first_of([(F.col("disposition") != "JOINED", "x"), (F.col("want") != F.col("have"), "HASH_MISMATCH")], "OK")
    return rows.select(F.when(F.col("disposition") != "JOINED", F.col("disposition")).otherwise(reason).alias("state")).groupBy("state").agg(F.count("*").alias("n"))


MANIFEST = """WITH h AS (SELECT o_custkey AS k, count(*) AS have FROM orders GROUP BY 1), w AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 7 = 0 THEN -1 ELSE coalesce(have, 0) END AS want FROM customer LEFT JOIN h ON k = c_custkey WHERE c_custkey % 10 <> 3)
SELECT CASE WHEN w.k IS NULL THEN 'MISSING_ENTRY' WHEN h.k IS NULL THEN 'MISSING_RECORD' WHEN want <> have THEN 'HASH_MISMATCH' ELSE 'OK' END AS state, count(*) AS n FROM w FULL JOIN h ON w.k = h.k GROUP BY 1"""


def tail_recommendation(spark, sf_dir):
    """Distances of three quantiles for each regime, with the overall ones where a regime has fewer than 80 days."""
    days = view(spark, sf_dir, "labels_day").withColumn("regime", F.concat(F.lit("D"), F.dayofmonth("day").cast("string")))
    q = [tails.quantile_higher("up_max", x).alias(f"q{int(x * 1000)}") for x in (0.95, 0.975, 0.99)]
    own = days.groupBy("regime").agg(F.count("*").alias("n"), *q)
    every = days.agg(*q).select(*(F.col(f"q{k}").alias(f"all{k}") for k in (950, 975, 990)))
    rows = own.crossJoin(F.broadcast(every))  # one row
    enough = F.col("n") >= 80
    return rows.select(F.when(enough, F.col("regime")).otherwise(F.concat("regime", F.lit("_FALLBACK"))).alias("regime"), "n", *(F.when(enough, F.col(f"q{k}")).otherwise(F.col(f"all{k}")).alias(f"q{k}") for k in (950, 975, 990)))


RECOMMEND = with_views(""", d AS (SELECT *, 'D' || day(day) AS regime FROM labels_day), o AS (SELECT regime, count(*) AS n, quantile_disc(up_max, 0.95) AS a, quantile_disc(up_max, 0.975) AS b, quantile_disc(up_max, 0.99) AS c FROM d GROUP BY regime),
e AS (SELECT quantile_disc(up_max, 0.95) AS a, quantile_disc(up_max, 0.975) AS b, quantile_disc(up_max, 0.99) AS c FROM d)
SELECT CASE WHEN n >= 80 THEN regime ELSE regime || '_FALLBACK' END AS regime, n, CASE WHEN n >= 80 THEN o.a ELSE e.a END AS q950, CASE WHEN n >= 80 THEN o.b ELSE e.b END AS q975, CASE WHEN n >= 80 THEN o.c ELSE e.c END AS q990 FROM o, e""", "labels_day")


QUERIES = {
    "implied_series": (implied_series, IMPLIED), "label_outcomes": (label_outcomes, LABEL_OUTCOMES), "walk_forward_economics": (walk_forward_economics, ECONOMICS), "entry_features": (entry_features, FEATURES),
    "leg_match": (leg_match, LEGS), "timeline_violations": (timeline_violations, TIMELINE), "plan_cost": (plan_cost, PLAN), "status_rollup": (status_rollup, ROLLUP), "latest_decisions": (latest_decisions, DECISIONS),
    "events_after_cursor": (events_after_cursor, CURSOR), "events_after_delivery": (events_after_delivery, DELIVERY), "manifest_check": (manifest_check, MANIFEST), "tail_recommendation": (tail_recommendation, RECOMMEND),
}
