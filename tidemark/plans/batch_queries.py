"""Workflows on the driver's tables: hourly prices of the events stand for bars, events for option quotes of a day's four legs, and
the days of the orders for labelled days. What a batch has to find (gaps, missing anchors, chains without a leg) is staged
from the calendar day, in the query and in its oracle alike."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.functions.scalars import years_between
from tidemark.operators import execution, market, refits, tails, workflows
from tidemark.plans import rule_queries
from tidemark.plans.views import view, with_views
from tidemark.session import cut, table

_BARS = "SELECT CAST(ts AS DATE) AS day, date_trunc('hour', ts) AS ts, max_by(value, ts) AS close FROM events GROUP BY CAST(ts AS DATE), date_trunc('hour', ts)"


def _bars(spark, sf_dir):
    return spark.sql(_BARS.replace("FROM events", "FROM {src}"), src=table(spark, sf_dir, "events"))


def _label_inputs(spark, sf_dir):
    bars = _bars(spark, sf_dir)
    days, d = bars.select("day").distinct(), F.dayofmonth("day")
    hours = lambda n: F.col("day").cast("timestamp_ntz") + n
    windows = days.select("day", hours(F.expr("INTERVAL 9 HOURS")).alias("entry_ts"), F.when(d % 7 == 0, hours(F.expr("INTERVAL 8 HOURS"))).otherwise(hours(F.expr("INTERVAL 16 HOURS"))).alias("close_ts"))
    anchors = days.where(d % 5 != 0).select("day", (F.lit(100.0) + d).alias("close"))
    return bars.where(d % 6 != 0), days, anchors, days.where(d % 11 == 0), windows


def _labels(spark, sf_dir):
    bars, definitions, anchors, present, windows = _label_inputs(spark, sf_dir)
    return workflows.label_batch(bars, definitions, anchors, present, F.lit("2000-01-01").cast("date"), F.lit("2100-01-01").cast("date"), windows, max_gap=7200)


def label_batch(spark, sf_dir):
    """A label batch with all its outcomes: gaps, days present, without a prior day or an anchor, without a window, uncovered."""
    return _labels(spark, sf_dir).select("day", "outcome", "prior_day", *(F.round(c, 9).alias(c) for c in ("spx_a", "f_a", "entry_price", "close_price", "up_max", "down_max")), "up_max_ts", "down_max_ts", "sample_count")


_LABELS = f"""allbars AS ({_BARS}), b AS (SELECT * FROM allbars WHERE day(day) % 6 <> 0), days AS (SELECT DISTINCT day FROM allbars),
landed AS (SELECT day, lag(day) OVER (ORDER BY day) AS prior_day, lag(f) OVER (ORDER BY day) AS f_a FROM (SELECT day, max_by(close, ts) AS f FROM b GROUP BY day)),
j AS (SELECT days.day, landed.day IS NOT NULL AS has, prior_day, f_a, CASE WHEN prior_day IS NOT NULL AND day(prior_day) % 5 <> 0 THEN 1e2 + day(prior_day) END AS spx_a, CAST(days.day AS TIMESTAMP) + INTERVAL 9 HOUR AS e, CAST(days.day AS TIMESTAMP) + CASE WHEN day(days.day) % 7 = 0 THEN 8 ELSE 16 END * INTERVAL 1 HOUR AS c FROM days LEFT JOIN landed ON days.day = landed.day),
p AS (SELECT j.*, b.ts, spx_a * close / f_a AS price, b.ts > e AND b.ts <= c AS inside, epoch(b.ts) - epoch(lag(b.ts) OVER (PARTITION BY j.day ORDER BY b.ts)) AS gap FROM j JOIN b ON j.day = b.day WHERE spx_a IS NOT NULL AND b.ts <= c),
m AS (SELECT day, max_by(price, ts) FILTER (ts <= e) AS entry_price, count(*) FILTER (ts <= e) AS nb, max_by(price, ts) FILTER (inside) AS close_price, max(price) FILTER (inside) AS hi, min(price) FILTER (inside) AS lo, count(*) FILTER (inside) AS sample_count, max(gap) FILTER (inside) AS g, max(ts) FILTER (inside) AS last, max(c) AS c,
  arg_min(ts, (-price, ts)) FILTER (inside) AS up_max_ts, arg_min(ts, (price, ts)) FILTER (inside) AS down_max_ts FROM p GROUP BY day),
x AS (SELECT j.day, prior_day, spx_a, f_a, entry_price, close_price, greatest(0.0, hi - entry_price) AS up_max, greatest(0.0, entry_price - lo) AS down_max, up_max_ts, down_max_ts, sample_count,
  CASE WHEN NOT has THEN 'GAP' WHEN day(j.day) % 11 = 0 THEN 'ALREADY_PRESENT' WHEN prior_day IS NULL THEN 'SKIPPED_NO_PRIOR' WHEN spx_a IS NULL THEN 'SKIPPED_NO_ANCHOR' WHEN e >= j.c THEN 'SKIPPED_ENTRY_AFTER_CLOSE'
    WHEN coalesce(nb > 0 AND sample_count > 0 AND g <= 7200 AND epoch(j.c) - epoch(last) <= 7200, false) THEN 'LABELLED' ELSE 'SKIPPED_COVERAGE' END AS outcome FROM j LEFT JOIN m ON j.day = m.day)"""
_on = lambda c, r=True: f"CASE WHEN outcome = 'LABELLED' THEN {f'round({c}, 9)' if r else c} END AS {c}"
LABEL_BATCH = f"WITH {_LABELS} SELECT day, outcome, prior_day, {', '.join(_on(c) for c in ('spx_a', 'f_a', 'entry_price', 'close_price', 'up_max', 'down_max'))}, {', '.join(_on(c, False) for c in ('up_max_ts', 'down_max_ts', 'sample_count'))} FROM x"


def feature_outcomes(spark, sf_dir):
    """Which labelled days get features: those that have none yet, and a chain."""
    labelled = _labels(spark, sf_dir).where("outcome = 'LABELLED'")
    days = _bars(spark, sf_dir).select("day").distinct()
    return workflows.feature_outcomes(labelled, days.where(F.dayofmonth("day") % 4 == 0), days.where(F.dayofmonth("day") % 3 != 0))


FEATURES = f"WITH {_LABELS} SELECT day, CASE WHEN day(day) % 4 = 0 THEN 'ALREADY_PRESENT' WHEN day(day) % 3 = 0 THEN 'GAP' ELSE 'COMPUTED' END AS outcome FROM x WHERE outcome = 'LABELLED'"

#: Staged legs: the event types that quote each leg of a structure 10 around the centre of 100.
_STRIKES = {"click": ("P", 90.0), "purchase": ("P", 85.0), "signup": ("C", 110.0), "view": ("C", 115.0)}


def _chain(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts")).where(F.dayofmonth("day") % 13 != 0)
    right = F.when(F.col("event_type").isin("click", "purchase"), "P").otherwise("C")
    strike = scalars.lookup(F.col("event_type"), {k: str(s) for k, (_, s) in _STRIKES.items()}).cast("double")
    k, sold = F.col("event_id"), F.col("event_type").isin("click", "signup")
    bid = F.when(k % 41 != 0, F.round(F.col("value") / 50, 3) + F.when(sold, 1.0).otherwise(0.0))
    rows = e.where(F.col("event_type").isin(*_STRIKES)).select("day", market.osi_symbol(F.lit("SPXW"), F.col("day"), right, strike).alias("symbol"), "ts", k.alias("seq"), bid.alias("bid"))
    return rows.withColumn("ask", F.coalesce(F.col("bid"), F.lit(0.5)) + 0.125)


def _trades(spark, sf_dir):
    days = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day")).distinct()
    d, at = F.dayofmonth("day"), lambda h: F.col("day").cast("timestamp_ntz") + F.expr(f"INTERVAL {h} HOURS")
    labels = days.where(d % 10 != 0).select("day", at(15).alias("entry_ts"), at(20).alias("close_ts"), F.lit(100.0).alias("center"), (F.lit(88.0) + (d % 7) * 4).alias("close_price"))
    distance = F.when(d % 8 == 0, 20.0).otherwise(10.0)
    return labels, days.where(d % 9 != 0).select("day", distance.alias("up_distance"), distance.alias("down_distance"), F.concat(F.lit("IV_Q"), (d % 4 + 1).cast("string")).alias("regime"))


FEES = 0.028


def _economics(spark, sf_dir):
    labels, distances = _trades(spark, sf_dir)
    return workflows.economics_days(labels, distances, _chain(spark, sf_dir), fees=FEES)


def economics_days(spark, sf_dir):
    """Every day with its disposition: strikes, four-leg fill at the entry, settlement, fees and breaches."""
    n = ("credit", "max_loss", "settlement_loss", "pnl", "fees", "net_pnl")
    return _economics(spark, sf_dir).select("day", "regime", "status", *(F.round(c, 9).alias(c) for c in n), "put_breached", "call_breached")


_CHAIN = """q AS (SELECT CAST(ts AS DATE) AS day, ts, event_id AS seq, event_type AS leg, CASE WHEN event_id % 41 <> 0 THEN round(value / 50, 3) + CASE WHEN event_type IN ('click', 'signup') THEN 1.0 ELSE 0.0 END END AS bid FROM events WHERE event_type IN ('click', 'purchase', 'signup', 'view') AND day(ts) % 13 <> 0),
qa AS (SELECT *, coalesce(bid, 0.5) + 0.125 AS ask FROM q)"""
_ECONOMICS = _CHAIN + """, days AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events), last AS (SELECT day, leg, q.sell AS sell, q.buy AS buy FROM (SELECT day, leg, max_by({'sell': CASE WHEN bid > 0 AND bid <= ask THEN bid END, 'buy': CASE WHEN bid IS NULL OR bid <= ask THEN ask END}, (ts, seq)) AS q FROM qa WHERE ts <= CAST(day AS TIMESTAMP) + INTERVAL 15 HOUR GROUP BY day, leg)),
fill AS (SELECT day, max(sell) FILTER (leg = 'click') + max(sell) FILTER (leg = 'signup') - max(buy) FILTER (leg = 'purchase') - max(buy) FILTER (leg = 'view') AS credit FROM last GROUP BY day), chains AS (SELECT DISTINCT day FROM qa),
e AS (SELECT d.day, day(d.day) % 10 <> 0 AS has_label, day(d.day) % 9 <> 0 AS has_distance, c.day IS NOT NULL AS has_chain, CASE WHEN day(d.day) % 8 <> 0 THEN credit END AS credit, 88e0 + (day(d.day) % 7) * 4 AS close FROM days d LEFT JOIN chains c ON d.day = c.day LEFT JOIN fill f ON d.day = f.day WHERE day(d.day) % 10 <> 0 OR day(d.day) % 9 <> 0),
s AS (SELECT *, CASE WHEN NOT has_label THEN 'MISSING_LABEL' WHEN NOT has_distance THEN 'MISSING_DISTANCE' WHEN NOT has_chain THEN 'MISSING_CHAIN' WHEN credit IS NULL THEN 'UNPRICEABLE' ELSE 'PRICED' END AS status, least(greatest(0e0, 90 - close) + greatest(0e0, close - 110), 5e0) AS loss FROM e),
economics AS (SELECT day, CASE WHEN has_distance THEN 'IV_Q' || (day(day) % 4 + 1) END AS regime, status, CASE WHEN status = 'PRICED' THEN credit END AS credit, CASE WHEN status = 'PRICED' THEN 5e0 - credit END AS max_loss, CASE WHEN status = 'PRICED' THEN loss END AS settlement_loss, CASE WHEN status = 'PRICED' THEN credit - loss END AS pnl,
  CASE WHEN status = 'PRICED' THEN 28e-3 END AS fees, CASE WHEN status = 'PRICED' THEN credit - loss - 28e-3 END AS net_pnl, CASE WHEN status = 'PRICED' THEN close < 90 END AS put_breached, CASE WHEN status = 'PRICED' THEN close > 110 END AS call_breached, close FROM s)"""
ECONOMICS = f"WITH {_ECONOMICS} SELECT day, regime, status, {', '.join(f'round({c}, 9) AS {c}' for c in ('credit', 'max_loss', 'settlement_loss', 'pnl', 'fees', 'net_pnl'))}, put_breached, call_breached FROM economics"


def _rounded(df, *keep):
    kept = {c: t for c, t in df.dtypes}
    return df.select(*((F.round(c, 9).alias(c) if kept[c] == "double" and c not in keep else F.col(c)) for c in df.columns))


def economics_report(spark, sf_dir):
    """The days' summary overall and by regime: totals, value per candidate, the worst 5 %, fees and net."""
    days = cut(_economics(spark, sf_dir))  # one row a day, read by every figure
    return _rounded(workflows.summarize(days.withColumn("slice", F.explode(F.array(F.lit("ALL"), F.col("regime")))), ["slice"]))


_SUMMARY = """count(pnl) AS n_priced, count(*) - count(pnl) AS n_unpriceable, round(coalesce(sum(pnl), 0.0), 9) AS total_pnl, round(avg(pnl), 9) AS mean_pnl, round(coalesce(sum(pnl), 0.0) / count(*), 9) AS ev, round(CASE WHEN count(pnl) > 0 THEN greatest(0.0, -min(pnl)) END, 9) AS max_daily_loss,
  round(count(*) FILTER (pnl > 0) / nullif(count(pnl), 0), 9) AS win_rate"""
REPORT = f"""WITH {_ECONOMICS}, f AS (SELECT 'ALL' AS slice, * FROM economics UNION ALL SELECT regime, * FROM economics), t AS (SELECT * FROM f WHERE status IN ('PRICED', 'UNPRICEABLE')),
w AS (SELECT slice, avg(pnl) AS cvar FROM (SELECT *, row_number() OVER (PARTITION BY slice ORDER BY pnl) AS k, count(*) OVER (PARTITION BY slice) AS n FROM t WHERE pnl IS NOT NULL) WHERE k <= greatest(1, ceil(n * CAST(0.05 AS DOUBLE))) GROUP BY slice)
SELECT slice, {_SUMMARY}, round(coalesce(sum(fees), 0.0), 9) AS total_fees, round(coalesce(sum(pnl), 0.0) - coalesce(sum(fees), 0.0), 9) AS net_total_pnl, round((coalesce(sum(pnl), 0.0) - coalesce(sum(fees), 0.0)) / count(*), 9) AS net_ev, round(max(cvar), 9) AS cvar_95 FROM t LEFT JOIN w USING (slice) GROUP BY slice"""

RULES = [workflows.ExitRule("HOLD"), workflows.ExitRule("PROFIT_TARGET", profit_fraction=0.25), workflows.ExitRule("STOP_LOSS", stop_multiple=0.5), workflows.ExitRule("TIME_EXIT", after_seconds=7200)]


def _exits(spark, sf_dir):
    labels, distances = _trades(spark, sf_dir)
    priced = _economics(spark, sf_dir).where("status IN ('PRICED', 'UNPRICEABLE')").select("day", "status", "credit")
    positions = labels.join(distances.drop("regime"), "day").join(priced, "day")
    return workflows.exit_outcomes(positions.where("status = 'PRICED'").drop("status"), _chain(spark, sf_dir), RULES, step_seconds=600), positions.where("status = 'UNPRICEABLE'")


def exit_comparison(spark, sf_dir):
    """Every priced day under four exit rules, on the cost of closing all four legs at each step."""
    found, _ = _exits(spark, sf_dir)
    return _rounded(found.drop("kind"))


_EXITS = _ECONOMICS + """, pos AS (SELECT * FROM economics WHERE status = 'PRICED'), grid AS (SELECT day, close, credit, CAST(day AS TIMESTAMP) + INTERVAL 15 HOUR + k * INTERVAL 10 MINUTE AS ts, leg FROM pos, range(1, 31) t(k), (VALUES ('click'), ('purchase'), ('signup'), ('view')) l(leg)),
known AS (SELECT g.day, g.ts, g.leg, CASE WHEN q.bid > 0 AND q.bid <= q.ask THEN q.bid END AS sell, CASE WHEN q.bid IS NULL OR q.bid <= q.ask THEN q.ask END AS buy FROM grid g ASOF LEFT JOIN (SELECT day, leg, ts, x.bid AS bid, x.ask AS ask FROM (SELECT day, leg, ts, max_by({'bid': bid, 'ask': ask}, seq) AS x FROM qa GROUP BY day, leg, ts)) q ON g.day = q.day AND g.leg = q.leg AND g.ts >= q.ts),
cost AS (SELECT day, ts, max(buy) FILTER (leg = 'click') + max(buy) FILTER (leg = 'signup') - max(sell) FILTER (leg = 'purchase') - max(sell) FILTER (leg = 'view') AS cost FROM known GROUP BY day, ts),
hit AS (SELECT c.day, rule, min((c.ts, cost)) AS h FROM cost c JOIN pos USING (day), range(4) r(rule) WHERE cost IS NOT NULL AND CASE rule WHEN 1 THEN cost <= credit * (1.0 - 0.25) WHEN 2 THEN cost >= credit * (1.0 + 0.5) WHEN 3 THEN c.ts >= CAST(c.day AS TIMESTAMP) + INTERVAL 17 HOUR ELSE false END GROUP BY c.day, rule),
exits AS (SELECT day, CAST(r.rule AS INTEGER) AS rule, coalesce(h[1], CAST(day AS TIMESTAMP) + INTERVAL 20 HOUR) AS exit_ts, CASE WHEN h IS NULL THEN 'EXPIRY' ELSE ['HOLD', 'PROFIT_TARGET', 'STOP_LOSS', 'TIME_EXIT'][r.rule + 1] END AS reason, coalesce(h[2], settlement_loss) AS exit_cost, credit FROM pos CROSS JOIN range(4) r(rule) LEFT JOIN hit ON hit.day = pos.day AND hit.rule = r.rule)"""
_EXITS = _EXITS.replace("SELECT day, CAST(r.rule AS INTEGER)", "SELECT pos.day, CAST(r.rule AS INTEGER)").replace("CAST(day AS TIMESTAMP) + INTERVAL 20 HOUR", "CAST(pos.day AS TIMESTAMP) + INTERVAL 20 HOUR")
EXITS = f"WITH {_EXITS} SELECT day, rule, exit_ts, reason, round(exit_cost, 9) AS exit_cost, round(credit - exit_cost, 9) AS pnl, round((epoch(exit_ts) - epoch(CAST(day AS TIMESTAMP) + INTERVAL 15 HOUR)) / 60.0, 9) AS holding_minutes FROM exits"


def exit_report(spark, sf_dir):
    """Per exit rule: totals, the worst 5 %, mean holding time, and a count for every reason."""
    found, none = map(cut, _exits(spark, sf_dir))
    return _rounded(workflows.exit_summary(found, none, RULES))


EXIT_REPORT = f"""WITH {_EXITS}, t AS (SELECT rule, credit - exit_cost AS pnl, (epoch(exit_ts) - epoch(CAST(day AS TIMESTAMP) + INTERVAL 15 HOUR)) / 60.0 AS held, reason FROM exits UNION ALL SELECT CAST(rule AS INTEGER), NULL, NULL, NULL FROM economics, range(4) r(rule) WHERE status = 'UNPRICEABLE'),
w AS (SELECT rule, avg(pnl) AS cvar FROM (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY pnl) AS k, count(*) OVER (PARTITION BY rule) AS n FROM t WHERE pnl IS NOT NULL) WHERE k <= greatest(1, ceil(n * CAST(0.05 AS DOUBLE))) GROUP BY rule)
SELECT rule, ['HOLD', 'PROFIT_TARGET', 'STOP_LOSS', 'TIME_EXIT'][rule + 1] AS kind, {_SUMMARY.replace("round(CASE WHEN count(pnl) > 0 THEN greatest(0.0, -min(pnl)) END, 9) AS max_daily_loss,", "")}, round(avg(held), 9) AS mean_holding_minutes, {', '.join(f"count(*) FILTER (reason = '{r}') AS n_{r.lower()}" for r in workflows.REASONS)}, round(max(cvar), 9) AS cvar_95
FROM t LEFT JOIN w USING (rule) GROUP BY rule"""


def entry_risk(spark, sf_dir):
    """Each order's lines as scenarios, and as legs to be filled: what may be entered."""
    pnl = view(spark, sf_dir, "pnl")
    n = F.count("*").over(tails.Window.partitionBy("l_orderkey"))
    scenarios = pnl.select("l_orderkey", "pnl", F.when(F.col("l_orderkey") % 50 == 0, F.lit(0.5)).otherwise(F.lit(1.0) / n).cast("decimal(12,8)").alias("probability"))
    a = execution.Assumptions(max_quote_age=2.0, fee=0.5, slippage=0.125, participation=0.75)
    fills = execution.value_execution(rule_queries.staged(spark, sf_dir, "legs"), ["l_orderkey"], F.expr("TIMESTAMP '2024-01-02 12:00:00'"), a, unique=False).select("l_orderkey", "executable")
    bound = F.when(F.col("l_orderkey") % 4 != 0, F.lit(4000.0) - F.col("l_orderkey") % 7 * 500.0)
    return workflows.entry_risk(scenarios.where("l_orderkey % 3 <> 0"), ["l_orderkey"], fills, bound, 3500.0, 500.0, 0.75)


ENTRY_RISK = f"""WITH legs AS ({rule_queries.STAGED['legs'][1]}), {rule_queries._execution_sql(False)}, pnl AS ({with_views('', 'pnl')[len('WITH pnl AS ('):-1]}),
s AS (SELECT l_orderkey, l_linenumber, pnl, CAST(CASE WHEN l_orderkey % 50 = 0 THEN 0.5 ELSE CAST(1 AS DOUBLE) / count(*) OVER (PARTITION BY l_orderkey) END AS DECIMAL(12,8)) AS p FROM pnl WHERE l_orderkey % 3 <> 0),
u AS (SELECT *, least(p, greatest(0, 0.25 - coalesce(sum(p) OVER (PARTITION BY l_orderkey ORDER BY pnl, p, l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS used FROM s),
g AS (SELECT l_orderkey, CAST(sum(p * pnl) AS DOUBLE) AS expected, greatest(0.0, -CAST(min(pnl) AS DOUBLE)) AS scenario_max_loss, CAST(sum(p) AS DOUBLE) AS mass, greatest(0.0, -CAST(sum(pnl * used) AS DOUBLE) / 0.25) AS tail_loss FROM u GROUP BY l_orderkey),
h AS (SELECT g.*, len(f) = 0 AND NOT low AS executable, CASE WHEN l_orderkey % 4 <> 0 THEN 4e3 - l_orderkey % 7 * 5e2 END AS max_loss FROM g LEFT JOIN y USING (l_orderkey)),
r AS (SELECT *, CASE WHEN abs(mass - 1) > 1e-9 THEN 'PROBABILITIES' WHEN max_loss IS NOT NULL AND scenario_max_loss > max_loss + 1e-9 THEN 'BEYOND_MAX_LOSS' END AS fault, CASE WHEN NOT coalesce(executable, false) THEN 'OPTION_CHAIN_UNUSABLE' WHEN max_loss IS NULL OR max_loss > 3500 OR tail_loss > 500 THEN 'RISK_BUDGET_EXCEEDED' END AS reason FROM h)
SELECT l_orderkey, expected, scenario_max_loss, tail_loss, executable, max_loss, fault, reason, CASE WHEN reason IS NULL AND fault IS NULL THEN 'WAIT' ELSE 'NO_TRADE' END AS action FROM r"""

MODELS = [workflows.TailModel(k, 0.9, target=0.85, min_regime_days=100, buffer_max=40.0, buffer_step=4.0, min_distance=1.0) for k in ("unconditional", "iv_regime", "buffered", "buffered_iv")]
_MIN_TRAIN, _TEST, _GAP = 600, 200, 5


def walk_forward_models(spark, sf_dir):
    """Four tail models on the same purged folds of the labelled days: coverage, breaches, distances and efficiency by fold and in
    all. The volatility is missing on every 7th of a month."""
    days = view(spark, sf_dir, "labels_day").select("day", "up_max", "down_max", F.when(F.dayofmonth("day") % 7 != 0, F.col("up_max") / F.col("down_max")).alias("iv"))
    return _rounded(workflows.walk_forward_evaluation(days, MODELS, _MIN_TRAIN, _TEST, _GAP))


_buffers = lambda keys, source: f"""SELECT {keys}, CASE WHEN count(*) FILTER (cov >= 0.85) > 0 THEN min(bu) + 4.0 * arg_min(u, (u + d, u, d)) FILTER (cov >= 0.85) END AS up, CASE WHEN count(*) FILTER (cov >= 0.85) > 0 THEN min(bd) + 4.0 * arg_min(d, (u + d, u, d)) FILTER (cov >= 0.85) END AS down, min(n) AS n
  FROM (SELECT {keys}, u, d, min(bu) AS bu, min(bd) AS bd, count(*) AS n, count(*) FILTER (up_max - bu <= 4.0 * u AND down_max - bd <= 4.0 * d) / count(*) AS cov FROM (SELECT *, quantile_disc(up_max, 0.9) OVER (PARTITION BY {keys}) AS bu, quantile_disc(down_max, 0.9) OVER (PARTITION BY {keys}) AS bd FROM {source}), range(11) a(u), range(11) b(d) GROUP BY {keys}, u, d) GROUP BY {keys}"""  # noqa: E731
WALK_FORWARD = with_views(f""", l AS (SELECT *, CASE WHEN day(day) % 7 <> 0 THEN up_max / down_max END AS iv, row_number() OVER (ORDER BY day) - 1 AS rk FROM labels_day), f AS (SELECT unnest(range(0, (count(*) - {_MIN_TRAIN + _TEST}) // {_TEST} + 1)) AS fold FROM l),
test AS (SELECT fold, day, up_max, down_max, iv FROM f JOIN l ON rk >= {_MIN_TRAIN} + fold * {_TEST} AND rk < {_MIN_TRAIN} + (fold + 1) * {_TEST}), st AS (SELECT fold, min(day) AS start FROM test GROUP BY fold), train AS (SELECT fold, l.* FROM st JOIN l ON rk < {_MIN_TRAIN} + fold * {_TEST} AND day < start - INTERVAL {_GAP} DAY),
u AS (SELECT fold, quantile_disc(up_max, 0.9) AS up, quantile_disc(down_max, 0.9) AS down FROM train GROUP BY fold), bf AS ({_buffers('fold', 'train')}),
cuts AS (SELECT fold, quantile_disc(iv, 0.25) AS c1, quantile_disc(iv, 0.5) AS c2, quantile_disc(iv, 0.75) AS c3 FROM train WHERE iv IS NOT NULL GROUP BY fold), tv AS (SELECT t.*, CASE WHEN iv < c1 THEN 'IV_Q1' WHEN iv < c2 THEN 'IV_Q2' WHEN iv < c3 THEN 'IV_Q3' ELSE 'IV_Q4' END AS bucket FROM train t JOIN cuts USING (fold) WHERE iv IS NOT NULL),
xv AS (SELECT t.*, CASE WHEN iv IS NULL THEN NULL WHEN iv < c1 THEN 'IV_Q1' WHEN iv < c2 THEN 'IV_Q2' WHEN iv < c3 THEN 'IV_Q3' ELSE 'IV_Q4' END AS bucket FROM test t JOIN cuts USING (fold)), ur AS (SELECT fold, bucket, quantile_disc(up_max, 0.9) AS up, quantile_disc(down_max, 0.9) AS down FROM tv GROUP BY ALL HAVING count(*) >= 100), uv AS (SELECT fold, quantile_disc(up_max, 0.9) AS up, quantile_disc(down_max, 0.9) AS down FROM tv GROUP BY fold),
br AS (SELECT * FROM ({_buffers('fold, bucket', 'tv')}) WHERE n >= 100), bv AS ({_buffers('fold', 'tv')}),
r AS (SELECT 'unconditional' AS model, t.*, up, down FROM test t LEFT JOIN u USING (fold) UNION ALL SELECT 'buffered', t.*, up, down FROM test t LEFT JOIN bf USING (fold)
  UNION ALL SELECT 'iv_regime', t.* EXCLUDE (bucket), CASE WHEN t.bucket IS NULL THEN NULL WHEN ur.up IS NOT NULL THEN ur.up ELSE uv.up END, CASE WHEN t.bucket IS NULL THEN NULL WHEN ur.up IS NOT NULL THEN ur.down ELSE uv.down END FROM xv t LEFT JOIN ur ON t.fold = ur.fold AND t.bucket = ur.bucket LEFT JOIN uv ON t.fold = uv.fold
  UNION ALL SELECT 'buffered_iv', t.* EXCLUDE (bucket), CASE WHEN t.bucket IS NULL THEN NULL WHEN br.up IS NOT NULL THEN br.up ELSE bv.up END, CASE WHEN t.bucket IS NULL THEN NULL WHEN br.up IS NOT NULL THEN br.down ELSE bv.down END FROM xv t LEFT JOIN br ON t.fold = br.fold AND t.bucket = br.bucket LEFT JOIN bv ON t.fold = bv.fold),
x AS (SELECT model, fold, up_max, down_max, CASE WHEN up IS NOT NULL THEN greatest(up, 1.0) END AS ud, CASE WHEN down IS NOT NULL THEN greatest(down, 1.0) END AS dd FROM r)
SELECT model, fold, count(*) AS test_days, count(*) - count(ud) AS abstain_days, count(ud) AS evaluated_days, count(*) FILTER (up_max <= ud AND down_max <= dd) AS covered_days, count(*) FILTER (up_max > ud) AS up_breaches, count(*) FILTER (down_max > dd) AS down_breaches, round(count(*) FILTER (up_max <= ud AND down_max <= dd) / nullif(count(ud), 0), 9) AS coverage,
  round((count(*) - count(ud)) / count(*), 9) AS no_trade_share, round(avg(ud), 9) AS mean_up, round(avg(dd), 9) AS mean_down, round(median(ud), 9) AS median_up, round(median(dd), 9) AS median_down, round(count(*) FILTER (up_max <= ud AND down_max <= dd) / nullif(count(ud), 0) / (avg(ud) + avg(dd)), 9) AS coverage_per_distance
FROM x GROUP BY GROUPING SETS ((model, fold), (model))""", "labels_day")


def _refit_days(spark, sf_dir):
    return view(spark, sf_dir, "labels_day").select("day", "up_max", "down_max", F.when(F.dayofmonth("day") % 7 != 0, F.col("up_max") / F.col("down_max")).alias("iv"))


def daily_refits(spark, sf_dir):
    """Every labelled day's distances by two models that are fitted anew on the days before it."""
    return refits.daily_recommendations(_refit_days(spark, sf_dir), MODELS[:2], _MIN_TRAIN, _GAP)


def daily_buffered_refits(spark, sf_dir):
    """The same by the two models with buffers; tests/test_refits.py holds them against models fitted day by day."""
    return refits.daily_recommendations(_refit_days(spark, sf_dir), MODELS[2:], _MIN_TRAIN, _GAP)


REFITS = with_views(f""", l AS (SELECT *, CASE WHEN day(day) % 7 <> 0 THEN up_max / down_max END AS iv FROM labels_day), train AS (SELECT a.day AS fold, b.up_max, b.down_max, b.iv FROM l a JOIN l b ON b.day <= a.day - INTERVAL {_GAP} DAY),
u AS (SELECT fold, count(*) AS n, quantile_disc(up_max, 0.9) AS up, quantile_disc(down_max, 0.9) AS down FROM train GROUP BY fold),
cuts AS (SELECT fold, quantile_disc(iv, 0.25) AS c1, quantile_disc(iv, 0.5) AS c2, quantile_disc(iv, 0.75) AS c3, quantile_disc(up_max, 0.9) AS vup, quantile_disc(down_max, 0.9) AS vdown FROM train WHERE iv IS NOT NULL GROUP BY fold),
tv AS (SELECT t.fold, up_max, down_max, CASE WHEN iv < c1 THEN 'IV_Q1' WHEN iv < c2 THEN 'IV_Q2' WHEN iv < c3 THEN 'IV_Q3' ELSE 'IV_Q4' END AS bucket FROM train t JOIN cuts USING (fold) WHERE iv IS NOT NULL),
ur AS (SELECT fold, bucket, quantile_disc(up_max, 0.9) AS up, quantile_disc(down_max, 0.9) AS down FROM tv GROUP BY ALL HAVING count(*) >= 100),
x AS (SELECT day, coalesce(n, 0) AS n, u.up, u.down, vup, vdown, CASE WHEN iv IS NULL OR c1 IS NULL THEN NULL WHEN iv < c1 THEN 'IV_Q1' WHEN iv < c2 THEN 'IV_Q2' WHEN iv < c3 THEN 'IV_Q3' ELSE 'IV_Q4' END AS bucket FROM l LEFT JOIN u ON u.fold = day LEFT JOIN cuts ON cuts.fold = day),
r AS (SELECT day, 'unconditional' AS model, n, up, down, 'UNCONDITIONAL' AS regime FROM x
  UNION ALL SELECT day, 'iv_regime', n, CASE WHEN x.bucket IS NOT NULL THEN coalesce(ur.up, vup) END, CASE WHEN x.bucket IS NOT NULL THEN coalesce(ur.down, vdown) END, CASE WHEN ur.up IS NULL THEN x.bucket || '_FALLBACK' ELSE x.bucket END FROM x LEFT JOIN ur ON ur.fold = day AND ur.bucket = x.bucket)
SELECT day, model, n AS n_train, CASE WHEN n < {_MIN_TRAIN} THEN 'INSUFFICIENT_HISTORY' WHEN up IS NULL THEN 'ABSTAIN' ELSE 'RECOMMENDED' END AS outcome, CASE WHEN n >= {_MIN_TRAIN} AND up IS NOT NULL THEN greatest(up, 1.0) END AS up_distance, CASE WHEN n >= {_MIN_TRAIN} AND down IS NOT NULL THEN greatest(down, 1.0) END AS down_distance,
  CASE WHEN n >= {_MIN_TRAIN} THEN regime END AS regime FROM r""", "labels_day")


def entry_volatilities(spark, sf_dir):
    """Each order day's chain, priced at a volatility of the day, and its minute bars: what an entry knows. Every 5th day of a month has no
    two-sided quote, and quotes after the entry are wild."""
    day = F.to_date("o_orderdate").alias("day")
    days = table(spark, sf_dir, "orders").groupBy(day).agg(F.count("*").alias("n"))
    at = lambda h, m: F.timestamp_seconds(F.unix_date("day").cast("long") * 86400 + (h * 60 + m) * 60)
    days = days.select("day", "n", at(13, 45).alias("entry_ts"), F.expr("timestampadd(DAY, 30, CAST(day AS TIMESTAMP))").alias("expiry_ts"), F.lit(6400.0).alias("center"), (F.lit(0.1) + F.dayofyear("day") % 20 / 100.0).alias("sigma"))
    options = days.withColumn("k", F.explode(F.sequence(F.lit(6240), F.lit(6560), F.lit(20)))).withColumn("is_call", F.explode(F.array(F.lit(True), F.lit(False))))
    options = options.withColumns({"strike": F.col("k").cast("double"), "tau": years_between(F.col("entry_ts"), F.col("expiry_ts"))})
    options = market.with_option_price(options, "sigma", "center", "strike", "tau", "is_call", 0.045, "mid")
    symbol = market.osi_symbol(F.lit("SPXW"), F.col("day"), F.when(F.col("is_call"), "C").otherwise("P"), F.col("strike"))
    known = F.struct(at(13, 44).alias("ts"), F.lit(1).alias("seq"), F.when(F.dayofmonth("day") % 5 != 0, F.col("mid") - 0.05).alias("bid"), (F.col("mid") + 0.05).alias("ask"))
    later = F.struct(at(13, 46).alias("ts"), F.lit(2).alias("seq"), (F.col("mid") * 3).alias("bid"), (F.col("mid") * 3 + 1).alias("ask"))
    quotes = options.select("day", symbol.alias("symbol"), F.inline(F.array(known, later)))
    bars = days.select("day", F.explode(F.sequence(F.lit(0), F.lit(39))).alias("m"), "n").select("day", F.timestamp_seconds(F.unix_date("day").cast("long") * 86400 + (13 * 60 + F.col("m") + 20) * 60).alias("ts"), (6400.0 + F.col("m") * F.col("n") % 11).alias("close"))
    found = workflows.entry_snapshot(quotes, bars, days.select("day", "entry_ts", "center", "expiry_ts"))
    return found.select("day", F.round("atm_iv", 3).alias("atm_iv"), (F.round("skew", 3) + 0.0).alias("skew"), F.round("realized_vol", 9).alias("realized_vol"), F.round("median_spread", 6).alias("median_spread"), "atm_iv_valid")


VOLATILITIES = """WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT day, m, 6400.0::DOUBLE + m * n % 11 AS close FROM d, range(0, 25) t(m)),
r AS (SELECT day, ln(close / lag(close) OVER (PARTITION BY day ORDER BY m)) AS x FROM b), v AS (SELECT day, stddev_samp(x) * sqrt(252 * 390) AS vol FROM r GROUP BY day)
SELECT day, CASE WHEN day(day) % 5 <> 0 THEN round(CAST(0.1 AS DOUBLE) + dayofyear(day) % 20 / CAST(100 AS DOUBLE), 3) END AS atm_iv, CAST(0 AS DOUBLE) AS skew, round(vol, 9) AS realized_vol, CASE WHEN day(day) % 5 <> 0 THEN CAST(0.1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS median_spread, day(day) % 5 <> 0 AS atm_iv_valid
FROM d JOIN v USING (day)"""


def ingest_plan(spark, sf_dir):
    """Orders as pulls of their days, by their costs: what is present, not due, a gap, without a chain, or planned."""
    o, k, day = table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.to_date("o_orderdate").alias("day")
    pulls = o.select(k.alias("logical_key"), day, (k % 2 == 0).alias("needs_chain"))
    estimates = o.where("o_orderkey % 7 <> 0").select(k.alias("logical_key"), F.when(k % 11 != 0, F.col("o_totalprice")).alias("usd"))
    chains = o.groupBy(day).agg(F.count_if(k % 3 == 0).alias("n_symbols"))
    items, decision = workflows.ingest_plan(pulls, o.where("o_orderkey % 5 = 0").select(k.alias("logical_key")), estimates, chains, F.lit("2000-01-01").cast("date"), 1e9)
    return items.groupBy("outcome").agg(F.count("*").alias("n"), F.sum(F.col("cost").cast("decimal(18,2)")).cast("double").alias("cost")).crossJoin(decision.select("decision"))  # one row


PLAN = """WITH c AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) FILTER (o_orderkey % 3 = 0) AS n FROM orders GROUP BY 1), i AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS day, o_totalprice AS usd FROM orders),
x AS (SELECT usd, CASE WHEN k % 5 = 0 THEN 'SKIPPED_PRESENT' WHEN i.day >= DATE '2000-01-01' THEN 'NOT_DUE' WHEN k % 7 = 0 OR k % 11 = 0 THEN 'GAP' WHEN k % 2 = 0 AND n = 0 THEN 'EMPTY_CHAIN' ELSE 'PLANNED' END AS outcome FROM i JOIN c USING (day)),
y AS (SELECT outcome, CASE WHEN outcome IN ('PLANNED', 'EMPTY_CHAIN') THEN CAST(usd AS DECIMAL(18,6)) ELSE 0 END AS cost FROM x)
SELECT outcome, count(*) AS n, CAST(sum(CAST(cost AS DECIMAL(18,2))) AS DOUBLE) AS cost, (SELECT CASE WHEN sum(cost) <= 1e9 THEN 'APPROVED' ELSE 'BLOCKED' END FROM y) AS decision FROM y GROUP BY outcome"""


QUERIES = {
    "ingest_plan": (ingest_plan, PLAN),
    "label_batch": (label_batch, LABEL_BATCH), "feature_outcomes": (feature_outcomes, FEATURES), "economics_days": (economics_days, ECONOMICS), "economics_report": (economics_report, REPORT), "exit_comparison": (exit_comparison, EXITS),
    "exit_report": (exit_report, EXIT_REPORT), "entry_risk": (entry_risk, ENTRY_RISK), "walk_forward_models": (walk_forward_models, WALK_FORWARD), "entry_volatilities": (entry_volatilities, VOLATILITIES), "daily_refits": (daily_refits, REFITS), "daily_buffered_refits": (daily_buffered_refits, None),
}
