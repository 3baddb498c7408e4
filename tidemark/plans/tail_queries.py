"""Quantile, tail-loss, drawdown, corridor and walk-forward queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import asof, tails
from tidemark.plans.views import view, with_views
from tidemark.session import table


def quantile_higher(spark, sf_dir):
    d = view(spark, sf_dir, "labels_day").withColumn("year", F.year("day"))
    return d.groupBy("year").agg(tails.quantile_higher("up_max", 0.975).alias("up_q"), tails.quantile_higher("down_max", 0.975).alias("down_q"), F.count("*").alias("n"))


QUANTILE = with_views(" SELECT CAST(year(day) AS INTEGER) AS year, quantile_disc(up_max, 0.975) AS up_q, quantile_disc(down_max, 0.975) AS down_q, count(*) AS n FROM labels_day GROUP BY 1", "labels_day")


def full_outer_disposition(spark, sf_dir):
    """Days with labels against days with shipped lines: every day is joined or counted as missing on one side."""
    labels = view(spark, sf_dir, "labels_day").where("first_key % 3 <> 0").select("day", "up_max")
    distances = view(spark, sf_dir, "pnl").groupBy("day").agg(F.count("*").alias("n_lines"))
    return asof.reconcile(labels, distances, "day", "LABEL", "DISTANCE").groupBy("disposition").agg(F.count("*").alias("n"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


DISPOSITION = with_views(""", l AS (SELECT day, up_max FROM labels_day WHERE first_key % 3 <> 0), d AS (SELECT day, count(*) AS n_lines FROM pnl GROUP BY day)
SELECT CASE WHEN l.day IS NULL THEN 'MISSING_LABEL' WHEN d.day IS NULL THEN 'MISSING_DISTANCE' ELSE 'JOINED' END AS disposition, count(*) AS n, min(coalesce(l.day, d.day)) AS first_day, max(coalesce(l.day, d.day)) AS last_day
FROM l FULL JOIN d ON l.day = d.day GROUP BY 1""", "labels_day", "pnl")


def missing_days_anti(spark, sf_dir):
    """Weekdays of the table's span without any order."""
    days = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day"))
    span = days.agg(F.min("day").alias("a"), F.max("day").alias("b")).select(F.explode(F.sequence("a", "b")).alias("day"))
    return asof.absent(span.where(F.weekday("day") < 5), days.where("day(day) % 5 <> 0"), "day")


MISSING = """WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders), s AS (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM d)
SELECT day FROM s WHERE isodow(day) <= 5 AND day NOT IN (SELECT day FROM d WHERE day(day) % 5 <> 0)"""


def present_skip_anti(spark, sf_dir):
    """Orders still to be computed: those of which no line has been shipped by a day."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), "o_orderdate")
    done = table(spark, sf_dir, "lineitem").where("l_shipdate < '1998-01-01'").select(F.col("l_orderkey").alias("key"))
    return asof.absent(orders, done, "key")


PRESENT = "SELECT o_orderkey AS key, o_orderdate FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01')"


def economics_summary(spark, sf_dir):
    """Totals, means, win rate and worst result over all rows and per regime, in one pass of grouping sets. Rows of every 11th
    order key are unpriceable and count as candidates only."""
    pnl = view(spark, sf_dir, "pnl").withColumn("priced", F.col("l_orderkey") % 11 != 0)
    own = F.when(F.col("priced"), F.col("pnl"))
    out = pnl.cube("regime").agg(
        F.count(own).alias("n_priced"), F.count_if(~F.col("priced")).alias("n_unpriceable"), F.sum(own).cast("double").alias("total"),
        F.round(F.sum(own).cast("double") / F.count("*"), 6).alias("ev"), F.max(-own).cast("double").alias("max_loss"),
        F.round(F.count_if(own > 0) / F.count(own), 6).alias("win_rate"), F.grouping_id().alias("g"),
    )
    return out.withColumn("regime", F.when(F.col("g") == 1, "ALL").otherwise(F.col("regime"))).drop("g")


ECONOMICS = with_views(""", r AS (SELECT *, CASE WHEN l_orderkey % 11 <> 0 THEN pnl END AS own FROM pnl)
SELECT CASE WHEN grouping(regime) = 1 THEN 'ALL' ELSE regime END AS regime, count(own) AS n_priced, count(*) - count(own) AS n_unpriceable, CAST(sum(own) AS DOUBLE) AS total,
  round(CAST(sum(own) AS DOUBLE) / count(*), 6) AS ev, CAST(max(-own) AS DOUBLE) AS max_loss, round(count(*) FILTER (own > 0) / count(own), 6) AS win_rate
FROM r GROUP BY GROUPING SETS ((), (regime))""", "pnl")


def cvar_signed(spark, sf_dir):
    """Mean of the worst 5 % results of each regime (n * 0.05 rows, rounded up)."""
    out = tails.worst_mean(view(spark, sf_dir, "pnl"), ["regime"], "pnl", 0.05, "day", "cvar")
    return out.withColumn("cvar", F.round("cvar", 4))


def _cvar(share: str, expr: str) -> str:
    return with_views(f""", r AS (SELECT regime, pnl, row_number() OVER (PARTITION BY regime ORDER BY pnl) AS k, count(*) OVER (PARTITION BY regime) AS n FROM pnl)
SELECT regime, round({expr}, 4) AS cvar FROM r WHERE k <= greatest(1, ceil(n * {share})) GROUP BY regime""", "pnl")


MEAN = "CAST(sum(CAST(pnl AS DECIMAL(24,8))) AS DOUBLE) / count(*)"
CVAR_SIGNED = _cvar("CAST(0.05 AS DOUBLE)", MEAN)


def cvar_loss(spark, sf_dir):
    """The same as a loss of at least 0, with the share 1 - 0.95 in floating point, which takes one more row at some n."""
    out = tails.worst_mean(view(spark, sf_dir, "pnl"), ["regime"], "pnl", 1 - 0.95, "day", "cvar")
    return out.withColumn("cvar", F.round(F.greatest(F.lit(0.0), -F.col("cvar")), 4))


CVAR_LOSS = _cvar("(CAST(1 AS DOUBLE) - CAST(0.95 AS DOUBLE))", f"greatest(0.0, -({MEAN}))")


def _scenarios(spark, sf_dir):
    """Each order's lines as scenarios with equal probabilities."""
    n = F.count("*").over(Window.partitionBy("l_orderkey"))  # by the exchange that the tail's window needs anyway
    return view(spark, sf_dir, "pnl").select("l_orderkey", "l_linenumber", "pnl", (F.lit(1.0) / n).cast("decimal(12,8)").alias("p"))


def cvar_weighted(spark, sf_dir):
    return tails.weighted_tail_loss(_scenarios(spark, sf_dir), ["l_orderkey"], "pnl", "p", 0.25, "cvar")


CVAR_WEIGHTED = with_views(""", s AS (SELECT l_orderkey, pnl, CAST(CAST(1 AS DOUBLE) / count(*) OVER (PARTITION BY l_orderkey) AS DECIMAL(12,8)) AS p, l_linenumber FROM pnl),
u AS (SELECT *, least(p, greatest(0, 0.25 - coalesce(sum(p) OVER (PARTITION BY l_orderkey ORDER BY pnl, p, l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS used FROM s)
SELECT l_orderkey, greatest(0.0, -CAST(sum(pnl * used) AS DOUBLE) / 0.25) AS cvar FROM u GROUP BY l_orderkey""", "pnl")


def scenario_stats(spark, sf_dir):
    s = _scenarios(spark, sf_dir)
    return s.groupBy("l_orderkey").agg(
        F.sum(F.col("p") * F.col("pnl")).cast("double").alias("expected"), F.greatest(F.lit(0.0), -F.min("pnl").cast("double")).alias("max_loss"), (F.abs(F.sum("p") - 1) <= 1e-6).alias("proper")
    )


SCENARIOS = with_views(""", s AS (SELECT l_orderkey, pnl, CAST(CAST(1 AS DOUBLE) / count(*) OVER (PARTITION BY l_orderkey) AS DECIMAL(12,8)) AS p FROM pnl)
SELECT l_orderkey, CAST(sum(p * pnl) AS DOUBLE) AS expected, greatest(0.0, -CAST(min(pnl) AS DOUBLE)) AS max_loss, abs(sum(p) - 1) <= 1e-6 AS proper FROM s GROUP BY l_orderkey""", "pnl")


def max_drawdown(spark, sf_dir):
    """Drawdown of the daily results of each regime: rows are summed by day first."""
    daily = view(spark, sf_dir, "pnl").groupBy("regime", "event_type", "day").agg(F.sum("pnl").alias("pnl"))
    return tails.max_drawdown(daily, ["regime", "event_type"], ["day"], "pnl", "drawdown")


DRAWDOWN = with_views(""", d AS (SELECT regime, event_type, day, sum(pnl) AS pnl FROM pnl GROUP BY ALL), e AS (SELECT *, sum(pnl) OVER (PARTITION BY regime, event_type ORDER BY day) AS equity FROM d),
p AS (SELECT *, greatest(0, max(equity) OVER (PARTITION BY regime, event_type ORDER BY day)) AS peak FROM e)
SELECT regime, event_type, greatest(0.0, CAST(max(peak - equity) AS DOUBLE)) AS drawdown FROM p GROUP BY regime, event_type""", "pnl")


def joint_corridor(spark, sf_dir):
    return tails.joint_corridor(view(spark, sf_dir, "labels_day"), "up_max", "down_max", 0.9).withColumn("buffer", F.round("buffer", 6))


CORRIDOR = with_views(""", m AS (SELECT quantile_disc(up_max, 0.9) AS up_q, quantile_disc(down_max, 0.9) AS down_q, count(*) AS n FROM labels_day),
s AS (SELECT m.*, greatest(0.0, up_max - up_q, down_max - down_q) AS miss FROM labels_day, m), r AS (SELECT *, row_number() OVER (ORDER BY miss) AS k FROM s)
SELECT up_q, down_q, n, round(miss, 6) AS buffer FROM r WHERE k = least(n, CAST(ceil((n + 1) * CAST(0.9 AS DOUBLE)) AS BIGINT))""", "labels_day")


def buffer_grid(spark, sf_dir):
    return tails.buffer_grid(view(spark, sf_dir, "labels_day"), "up_max", "down_max", 300.0, 50.0, 0.9, 2.0, 100)


BUFFER = with_views(""", g AS (SELECT a.range AS u, b.range AS d FROM range(101) a, range(101) b),
c AS (SELECT u, d, count(*) FILTER (up_max <= 300.0 + 2.0 * u AND down_max <= 50.0 + 2.0 * d) AS covered, count(*) AS n FROM g, labels_day GROUP BY u, d)
SELECT n, 2.0 * CAST(u AS DOUBLE) AS up_buffer, 2.0 * CAST(d AS DOUBLE) AS down_buffer, covered FROM c WHERE covered >= 0.9 * n ORDER BY u + d, u, d LIMIT 1""", "labels_day")


def iv_regime_buckets(spark, sf_dir):
    """Quartile regimes of a daily volatility (null on every 7th day), and each regime's conservative quantile with at
    least 20 days."""
    days = view(spark, sf_dir, "labels_day").withColumn("iv", F.when(F.day("day") % 7 != 0, F.col("up_max") / F.col("down_max")))
    cuts = days.agg(*(tails.quantile_higher("iv", q).alias(f"c{k}") for k, q in ((1, 0.25), (2, 0.5), (3, 0.75))))
    rows = days.crossJoin(F.broadcast(cuts))  # one row
    out = rows.withColumn("regime", tails.quartile_regime("iv", [F.col("c1"), F.col("c2"), F.col("c3")])).groupBy("regime")
    return out.agg(F.count("*").alias("n"), F.when(F.count("*") >= 20, tails.quantile_higher("up_max", 0.95)).alias("up_q"))


REGIMES = with_views(""", d AS (SELECT *, CASE WHEN day(day) % 7 <> 0 THEN up_max / down_max END AS iv FROM labels_day),
c AS (SELECT quantile_disc(iv, 0.25) AS c1, quantile_disc(iv, 0.5) AS c2, quantile_disc(iv, 0.75) AS c3 FROM d)
SELECT CASE WHEN iv IS NULL THEN 'UNKNOWN' WHEN iv < c1 THEN 'IV_Q1' WHEN iv < c2 THEN 'IV_Q2' WHEN iv < c3 THEN 'IV_Q3' ELSE 'IV_Q4' END AS regime, count(*) AS n,
  CASE WHEN count(*) >= 20 THEN quantile_disc(up_max, 0.95) END AS up_q FROM d, c GROUP BY 1""", "labels_day")


def coverage_rollup(spark, sf_dir):
    """Coverage of fixed distances per year and overall; a side is covered when the distance is at least the move."""
    days = view(spark, sf_dir, "labels_day").withColumn("year", F.year("day"))
    up, down = F.col("up_max") <= 400, F.col("down_max") <= 120
    share = lambda c: F.round(F.avg(c.cast("int").cast("double")), 9)
    return days.rollup("year").agg(F.count("*").alias("n"), share(up).alias("up"), share(down).alias("down"), share(up & down).alias("joint"), F.median("up_max").alias("median_up"))


COVERAGE = with_views(""" SELECT CAST(year(day) AS INTEGER) AS year, count(*) AS n, round(avg(CAST(up_max <= 400 AS INTEGER)), 9) AS up, round(avg(CAST(down_max <= 120 AS INTEGER)), 9) AS down,
  round(avg(CAST(up_max <= 400 AND down_max <= 120 AS INTEGER)), 9) AS joint, median(up_max) AS median_up FROM labels_day GROUP BY ROLLUP (CAST(year(day) AS INTEGER))""", "labels_day")


def validation_slices(spark, sf_dir):
    pnl = view(spark, sf_dir, "pnl").withColumn("action", F.when(F.col("pnl") > 0, "ENTER").otherwise("NO_TRADE"))
    return pnl.groupBy("event_type", "regime").agg(
        F.count_if(F.col("action") == "ENTER").alias("n_enter"), F.count_if(F.col("action") == "NO_TRADE").alias("n_no_trade"),
        F.sum(F.when(F.col("action") == "ENTER", F.col("pnl")).otherwise(0)).cast("double").alias("realized"), F.sum("pnl").cast("double").alias("counterfactual"),
    )


SLICES = with_views(""" SELECT event_type, regime, count(*) FILTER (pnl > 0) AS n_enter, count(*) FILTER (pnl <= 0) AS n_no_trade, CAST(sum(CASE WHEN pnl > 0 THEN pnl ELSE 0 END) AS DOUBLE) AS realized,
  CAST(sum(pnl) AS DOUBLE) AS counterfactual FROM pnl GROUP BY event_type, regime""", "pnl")


def walk_forward_folds(spark, sf_dir):
    samples = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("at")).withColumn("grp", F.date_format("at", "yyyy-MM"))
    return tails.walk_forward_folds(samples, "grp", "at", 24, 6, 30)


def _folds_sql(step: int) -> str:
    return f"""WITH s AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS seen, strftime(o_orderdate, '%Y-%m') AS grp FROM orders),
g AS (SELECT grp, row_number() OVER (ORDER BY min(seen), grp) - 1 AS rk FROM s GROUP BY grp), f AS (SELECT unnest(range(0, (count(*) - 30) // {step} + 1)) AS fold FROM g), r AS (SELECT s.*, rk FROM s JOIN g USING (grp)),
t AS (SELECT fold, min(seen) AS test_start, max(seen) AS test_end, count(*) AS n_test FROM f JOIN r ON rk >= 24 + fold * {step} AND rk < 24 + fold * {step} + 6 GROUP BY fold)
SELECT fold, test_start, test_end, n_test, (SELECT count(*) FROM r WHERE rk < 24 + t.fold * {step} AND seen < t.test_start - INTERVAL 30 DAY) AS n_train FROM t"""


FOLDS = _folds_sql(6)


def overlapping_folds(spark, sf_dir):
    """Folds that step by two months with test windows of six: the members are listed, then counted by role."""
    samples = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("at")).withColumn("grp", F.date_format("at", "yyyy-MM"))
    members = tails.fold_members(samples, "grp", "at", 24, 6, 30, step_groups=2)
    test, train = F.col("role") == "TEST", F.col("role") == "TRAIN"
    return members.groupBy("fold").agg(F.min(F.when(test, F.col("at"))).alias("test_start"), F.max(F.when(test, F.col("at"))).alias("test_end"), F.count_if(test).alias("n_test"), F.count_if(train).alias("n_train"))


OVERLAPPING = _folds_sql(2)


def range_expanding_quantile(spark, sf_dir):
    """Every day with the conservative quantile of all days before it."""
    return tails.expanding_quantile(view(spark, sf_dir, "labels_day"), "day", "up_max", 0.95, 1).withColumn("n_train", F.col("n_train").cast("int"))


def expanding_quantile_all_days(spark, sf_dir):
    """The same with its number of days as a long; tests compare with brute force too."""
    return tails.expanding_quantile(view(spark, sf_dir, "labels_day"), "day", "up_max", 0.95, 1)


EXPANDING = with_views(""" SELECT a.day, CAST(count(b.day) AS INTEGER) AS n_train, quantile_disc(b.up_max, 0.95) AS q FROM labels_day a LEFT JOIN labels_day b ON b.day <= a.day - INTERVAL 1 DAY GROUP BY a.day""", "labels_day")


QUERIES = {
    "quantile_higher": (quantile_higher, QUANTILE), "full_outer_disposition": (full_outer_disposition, DISPOSITION), "missing_days_anti": (missing_days_anti, MISSING),
    "present_skip_anti": (present_skip_anti, PRESENT), "economics_summary": (economics_summary, ECONOMICS), "cvar_signed": (cvar_signed, CVAR_SIGNED), "cvar_loss": (cvar_loss, CVAR_LOSS),
    "cvar_weighted": (cvar_weighted, CVAR_WEIGHTED), "scenario_stats": (scenario_stats, SCENARIOS), "max_drawdown": (max_drawdown, DRAWDOWN), "joint_corridor": (joint_corridor, CORRIDOR),
    "buffer_grid": (buffer_grid, BUFFER), "iv_regime_buckets": (iv_regime_buckets, REGIMES), "coverage_rollup": (coverage_rollup, COVERAGE), "validation_slices": (validation_slices, SLICES),
    "walk_forward_folds": (walk_forward_folds, FOLDS), "overlapping_folds": (overlapping_folds, OVERLAPPING), "range_expanding_quantile": (range_expanding_quantile, EXPANDING),
    "expanding_quantile_all_days": (expanding_quantile_all_days, EXPANDING.replace("AS INTEGER) AS n_train", "AS BIGINT) AS n_train")),
}
