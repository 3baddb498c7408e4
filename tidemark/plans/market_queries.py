"""Quote, bar and structure queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import asof, market, rules
from tidemark.plans.views import view, with_views
from tidemark.session import table


def asof_latest_quote(spark, sf_dir):
    quotes = view(spark, sf_dir, "quotes").where("hour(ts) < 15")
    return asof.latest_per_key(quotes, ["day", "symbol"], ["ts", "seq"], ["bid", "ask"])


LATEST = "SELECT day, symbol, bid, ask FROM (SELECT *, row_number() OVER (PARTITION BY day, symbol ORDER BY ts DESC, seq DESC) AS rn FROM quotes WHERE hour(ts) < 15) WHERE rn = 1"
ASOF_LATEST_QUOTE = with_views(" " + LATEST, "quotes")


def asof_join(spark, sf_dir):
    """Each purchase with the user's latest earlier other event, of any day. Keys are users, spread over days, so that a user
    with most of the events isn't one task's."""
    e = table(spark, sf_dir, "events")
    left = e.where("event_type = 'purchase'").select("user_id", "ts", "event_id")
    right = e.where("event_type <> 'purchase'").select("user_id", "ts", F.col("event_id").alias("prior_id"), F.col("value").alias("prior_value"))
    return asof.asof_backward(left, right, ["user_id"], "ts", ["prior_id", "prior_value"], "prior_id", spread=F.to_date("ts"))


ASOF_JOIN = """SELECT l.user_id, l.ts, l.event_id, r.event_id AS prior_id, r.value AS prior_value
FROM (SELECT * FROM events WHERE event_type = 'purchase') l
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type <> 'purchase') r ON l.user_id = r.user_id AND l.ts >= r.ts"""


def asof_minute_grid(spark, sf_dir):
    """The running latest quote of each symbol on a 10-minute grid of every day."""
    quotes = view(spark, sf_dir, "quotes")
    days = quotes.select("symbol", "day").distinct()
    grid = days.select("symbol", "day", F.explode(F.expr("sequence(CAST(day AS TIMESTAMP_NTZ), CAST(day AS TIMESTAMP_NTZ) + INTERVAL 1430 MINUTES, INTERVAL 10 MINUTES)")).alias("ts"))
    return asof.asof_backward(grid, quotes, ["symbol", "day"], "ts", ["bid", "ask"], "seq")


ASOF_MINUTE_GRID = with_views(""", grid AS (SELECT symbol, day, CAST(day AS TIMESTAMP) + INTERVAL 10 MINUTE * k AS ts
  FROM (SELECT DISTINCT symbol, day FROM quotes), range(144) t(k))
SELECT g.symbol, g.day, g.ts, q.bid, q.ask FROM grid g ASOF LEFT JOIN quotes q ON g.symbol = q.symbol AND g.day = q.day AND g.ts >= q.ts""", "quotes")


def strict_prior_day(spark, sf_dir):
    return asof.strict_prior(table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")))


STRICT_PRIOR_DAY = "SELECT day, lag(day) OVER (ORDER BY day) AS prior_day FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders)"


def _legs(spark, sf_dir):
    names = ["short_put", "long_put", "short_call", "long_call"]
    symbols = ["click", "purchase", "signup", "view"]
    days = view(spark, sf_dir, "quotes").select("day").distinct()
    pairs = F.array(*(F.struct(F.lit(n).alias("leg"), F.lit(s).alias("symbol")) for n, s in zip(names, symbols, strict=True)))
    return days.select("day", F.inline(pairs))


def condor_fill_pivot(spark, sf_dir):
    return market.condor_price(_legs(spark, sf_dir), asof_latest_quote(spark, sf_dir), ["day"]).select(
        "day", F.round("credit", 6).alias("credit"), F.round("close_cost", 6).alias("close_cost"), "priced"
    )


CONDOR = with_views(f""", latest AS ({LATEST}),
legs AS (SELECT day, leg, symbol FROM (SELECT DISTINCT day FROM quotes), (VALUES ('short_put', 'click'), ('long_put', 'purchase'), ('short_call', 'signup'), ('long_call', 'view')) t(leg, symbol)),
filled AS (SELECT day, leg, CASE WHEN bid > 0 AND (ask IS NULL OR bid <= ask) THEN bid END AS sell, CASE WHEN bid IS NULL OR bid <= ask THEN ask END AS buy
  FROM legs LEFT JOIN latest USING (day, symbol)),
p AS (SELECT day, max(sell) FILTER (leg = 'short_put') + max(sell) FILTER (leg = 'short_call') - max(buy) FILTER (leg = 'long_put') - max(buy) FILTER (leg = 'long_call') AS credit,
  max(buy) FILTER (leg = 'short_put') + max(buy) FILTER (leg = 'short_call') - max(sell) FILTER (leg = 'long_put') - max(sell) FILTER (leg = 'long_call') AS close_cost FROM filled GROUP BY day)
SELECT day, round(credit, 6) AS credit, round(close_cost, 6) AS close_cost, credit IS NOT NULL AS priced FROM p""", "quotes")


def settlement_loss(spark, sf_dir):
    bars = view(spark, sf_dir, "bars")
    strikes = market.condor_strikes(F.col("open"), F.lit(10), F.lit(10))
    rows = bars.withColumn("k", strikes)
    loss = market.settlement_loss(F.col("close"), F.col("k.short_put").cast("double"), F.col("k.short_call").cast("double"), F.lit(5.0))
    return rows.select("symbol", "ts", "k.short_put", "k.short_call", F.round(loss, 6).alias("loss"))


SETTLEMENT = with_views(""" SELECT symbol, ts, sp AS short_put, sc AS short_call,
  round(least(greatest(0.0, sp - close) + greatest(0.0, close - sc), 5.0), 6) AS loss
FROM (SELECT *, CAST(5 * floor((open - 10) / 5) AS INTEGER) AS sp, CAST(5 * ceil((open + 10) / 5) AS INTEGER) AS sc FROM bars)""", "bars")


def realized_vol(spark, sf_dir):
    bars = view(spark, sf_dir, "bars")
    return market.realized_volatility(bars, ["symbol", "day"], "ts", "close").withColumn("vol", F.round("vol", 6))


REALIZED_VOL = with_views(""", r AS (SELECT symbol, day, ln(close / lag(close) OVER (PARTITION BY symbol, day ORDER BY ts)) AS r FROM bars WHERE close > 0)
SELECT symbol, day, count(*) AS n, round(CASE WHEN count(*) >= 15 THEN coalesce(stddev_samp(r), 0.0) * sqrt(252 * 390) ELSE 0.0 END, 6) AS vol FROM r GROUP BY symbol, day""", "bars")


def log_returns(spark, sf_dir):
    w = Window.partitionBy("symbol").orderBy("ts")
    return view(spark, sf_dir, "bars").where("close > 0").select("symbol", "ts", F.round(F.log(F.col("close") / F.lag("close").over(w)), 9).alias("r"))


LOG_RETURNS = with_views(" SELECT symbol, ts, round(ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY ts)), 9) AS r FROM bars WHERE close > 0", "bars")


def excursions_argmax(spark, sf_dir):
    bars = view(spark, sf_dir, "bars")
    entry = asof.latest_per_key(bars.where("hour(ts) < 9"), ["symbol", "day"], ["ts"], ["close"]).withColumnRenamed("close", "entry")
    path = bars.where("hour(ts) BETWEEN 9 AND 16").join(entry, ["symbol", "day"])
    out = market.excursions(path, ["symbol", "day"], "ts", "high", "low", "close", "entry")
    return out.withColumns({c: F.round(c, 6) for c in ("up_max", "down_max")})


EXCURSIONS = with_views(""", entry AS (SELECT symbol, day, max_by(close, ts) AS entry FROM bars WHERE hour(ts) < 9 GROUP BY symbol, day)
SELECT symbol, day, round(greatest(0.0, max(high - entry)), 6) AS up_max, round(greatest(0.0, max(entry - low)), 6) AS down_max,
  first(ts ORDER BY high DESC, ts) AS up_ts, first(ts ORDER BY low, ts) AS down_ts, max_by(close, ts) AS close_price, count(*) AS sample_count
FROM bars JOIN entry USING (symbol, day) WHERE hour(ts) BETWEEN 9 AND 16 GROUP BY symbol, day""", "bars")


def outcome_labels(spark, sf_dir):
    """Per day and symbol: largest moves from the first price, whether inclusive barriers are touched, and the worst mark."""
    q = view(spark, sf_dir, "quotes")
    first = q.groupBy("day", "symbol").agg(F.min_by("value", F.struct("ts", "seq")).alias("start"))
    rows = q.join(first, ["day", "symbol"])
    return rows.groupBy("day", "symbol").agg(
        F.round(F.max(F.col("value") - F.col("start")), 6).alias("up"), F.round(F.max(F.col("start") - F.col("value")), 6).alias("down"),
        F.bool_or(F.col("value") >= F.col("start") * 2).alias("touched_up"), F.bool_or(F.col("value") <= F.col("start") / 2).alias("touched_down"),
        (F.max_by("value", F.struct("ts", "seq")) > F.first("start")).alias("crossed"),
    )


OUTCOME_LABELS = with_views(""", f AS (SELECT day, symbol, min_by(value, ts) AS start FROM quotes GROUP BY day, symbol)
SELECT day, symbol, round(max(value - start), 6) AS up, round(max(start - value), 6) AS down, bool_or(value >= start * 2) AS touched_up,
  bool_or(value <= start / 2) AS touched_down, max_by(value, ts) > first(start) AS crossed FROM quotes JOIN f USING (day, symbol) GROUP BY day, symbol""", "quotes")


def median_spread(spark, sf_dir):
    two_sided = view(spark, sf_dir, "quotes").where("bid IS NOT NULL AND ask IS NOT NULL AND bid <= ask")
    sane = two_sided.where(market.is_sane(F.col("bid"), F.col("ask")))
    return sane.groupBy("day", "symbol").agg(F.round(F.median(F.col("ask") - F.col("bid")), 6).alias("median_spread"), F.count("*").alias("n"))


MEDIAN_SPREAD = with_views(""" SELECT day, symbol, round(median(ask - bid), 6) AS median_spread, count(*) AS n FROM quotes
WHERE bid IS NOT NULL AND ask IS NOT NULL AND bid <= ask AND (bid + ask) / 2 >= 0.10 AND ask - bid <= 0.5 * ((bid + ask) / 2) GROUP BY day, symbol""", "quotes")


def quote_quality(spark, sf_dir):
    """Reasons of each quote, then the state of its symbol and day: RED with any reason, else GREEN."""
    bid, ask, name = F.col("bid"), F.col("ask"), F.upper("symbol")
    why = rules.reasons([(bid.isNull(), F.concat_ws(":", name, F.lit("MISSING_BID"))), (F.coalesce(bid > ask, F.lit(False)), F.concat_ws(":", name, F.lit("CROSSED"))), (ask < 1, F.concat_ws(":", name, F.lit("TOO_LOW")))])
    rows = view(spark, sf_dir, "quotes").withColumn("why", why)
    out = rows.groupBy("day", "symbol").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("why")))).alias("r"), F.count_if(F.size("why") > 0).alias("n_bad"))
    return out.select("day", "symbol", "n_bad", F.array_join("r", ",").alias("reasons"), F.when(F.size("r") > 0, "RED").otherwise("GREEN").alias("state"))


QUOTE_QUALITY = with_views(""", w AS (SELECT day, symbol, seq, unnest([CASE WHEN bid IS NULL THEN upper(symbol) || ':MISSING_BID' END, CASE WHEN bid > ask THEN upper(symbol) || ':CROSSED' END,
  CASE WHEN ask < 1 THEN upper(symbol) || ':TOO_LOW' END]) AS why FROM quotes)
SELECT day, symbol, count(DISTINCT seq) FILTER (why IS NOT NULL) AS n_bad, coalesce(string_agg(DISTINCT why, ',' ORDER BY why), '') AS reasons,
  CASE WHEN count(why) > 0 THEN 'RED' ELSE 'GREEN' END AS state FROM w GROUP BY day, symbol""", "quotes")


def exit_first_trigger(spark, sf_dir):
    """For each of four exit rules and each user and day, the first quote that triggers it (rules are a fixed list of four)."""
    q = view(spark, sf_dir, "quotes")
    first = q.groupBy("day", "user_id").agg(F.min_by("value", F.struct("ts", "seq")).alias("entry"))
    rows = q.join(first, ["day", "user_id"])
    hits = {
        "HOLD": F.lit(False), "PROFIT_TARGET": F.col("value") <= F.col("entry") * 0.5, "STOP_LOSS": F.col("value") >= F.col("entry") * 2, "TIME_EXIT": F.hour("ts") >= 15,
    }
    aggs = [F.min(F.when(c, F.struct("ts", "seq", "value"))).alias(k) for k, c in hits.items()]
    found = rows.groupBy("day", "user_id").agg(*aggs)
    flat = found.select("day", "user_id", F.inline(F.array(*(F.struct(F.lit(k).alias("rule"), F.col(f"{k}.ts").alias("exit_ts"), F.col(f"{k}.value").alias("cost")) for k in hits))))
    return flat


EXIT = with_views(""", f AS (SELECT day, user_id, min_by(value, ts) AS entry FROM quotes GROUP BY day, user_id),
r AS (SELECT q.*, entry FROM quotes q JOIN f USING (day, user_id)),
h AS (SELECT day, user_id, ts, value, unnest([CASE WHEN value <= entry * 0.5 THEN 'PROFIT_TARGET' END, CASE WHEN value >= entry * 2 THEN 'STOP_LOSS' END, CASE WHEN hour(ts) >= 15 THEN 'TIME_EXIT' END]) AS rule FROM r),
g AS (SELECT day, user_id, rule, min(ts) AS exit_ts, min_by(value, ts) AS cost FROM h WHERE rule IS NOT NULL GROUP BY day, user_id, rule)
SELECT day, user_id, rule, exit_ts, cost FROM (SELECT * FROM f, (VALUES ('HOLD'), ('PROFIT_TARGET'), ('STOP_LOSS'), ('TIME_EXIT')) t(rule)) x LEFT JOIN g USING (day, user_id, rule)""", "quotes")


def exit_summary(spark, sf_dir):
    """Per rule: days out, mean cost, and zero-filled counts."""
    rows = exit_first_trigger(spark, sf_dir)
    exact = F.sum(F.col("cost").cast("decimal(18,4)")).cast("double")
    return rows.groupBy("rule").agg(F.count("*").alias("n"), F.count("exit_ts").alias("n_triggered"), F.round(exact / F.count("exit_ts"), 6).alias("mean_cost"))


EXIT_SUMMARY = EXIT.rsplit("SELECT day, user_id, rule, exit_ts, cost FROM (", 1)[0] + """
SELECT rule, count(*) AS n, count(exit_ts) AS n_triggered, round(CAST(sum(CAST(cost AS DECIMAL(18,4))) AS DOUBLE) / nullif(count(exit_ts), 0), 6) AS mean_cost
FROM (SELECT * FROM f, (VALUES ('HOLD'), ('PROFIT_TARGET'), ('STOP_LOSS'), ('TIME_EXIT')) t(rule)) x LEFT JOIN g USING (day, user_id, rule) GROUP BY rule"""


def coverage_gaps(spark, sf_dir):
    return asof.coverage_gaps(view(spark, sf_dir, "bars"), ["symbol"], "ts", 7200)


COVERAGE_GAPS = with_views(""", g AS (SELECT symbol, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY symbol ORDER BY ts)) AS gap FROM bars)
SELECT symbol, count(*) AS n_rows, CAST(coalesce(max(gap), 0) AS BIGINT) AS max_gap, coalesce(max(gap), 0) <= 7200 AS covered FROM g GROUP BY symbol""", "bars")


def monotonic_violations(spark, sf_dir):
    return asof.order_violations(table(spark, sf_dir, "events"), ["user_id"], "event_id", "ts")


MONOTONIC = """SELECT user_id, CAST(coalesce(sum(CASE WHEN ts < b THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_decreasing, CAST(coalesce(sum(CASE WHEN ts <= b THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_not_increasing
FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) GROUP BY user_id"""


def nearest_strikes_topk(spark, sf_dir):
    """The four parts nearest in price to each size's mean price; ties go to the lower price."""
    p = table(spark, sf_dir, "part").select("p_size", "p_partkey", F.col("p_retailprice").cast("decimal(18,2)").alias("strike"))
    center = p.groupBy("p_size").agg((F.sum("strike").cast("double") / F.count("*")).alias("center"))
    rows = p.join(center, "p_size").withColumn("gap", F.abs(F.col("strike").cast("double") - F.col("center")))
    w = Window.partitionBy("p_size").orderBy("gap", "strike", "p_partkey")
    return rows.withColumn("k", F.row_number().over(w)).where("k <= 4").select("p_size", "k", "p_partkey", F.col("strike").cast("double").alias("strike"))


NEAREST = """WITH p AS (SELECT p_size, p_partkey, CAST(p_retailprice AS DECIMAL(18,2)) AS strike FROM part),
c AS (SELECT p_size, CAST(sum(strike) AS DOUBLE) / count(*) AS center FROM p GROUP BY p_size)
SELECT p_size, CAST(k AS INTEGER) AS k, p_partkey, CAST(strike AS DOUBLE) AS strike FROM (SELECT p.*, row_number() OVER (PARTITION BY p.p_size ORDER BY abs(CAST(strike AS DOUBLE) - center), strike, p_partkey) AS k
FROM p JOIN c USING (p_size)) WHERE k <= 4"""


def osi_roundtrip(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("day", F.expr("date_add(DATE'2026-01-01', CAST(p_partkey % 365 AS INT))"))
    symbol = market.osi_symbol(F.lit("TIDE"), F.col("day"), F.when(F.col("p_size") % 2 == 0, "C").otherwise("P"), F.col("p_size") * 5 + 1000)
    rows = p.select("p_partkey", symbol.alias("symbol")).withColumn("x", market.parse_osi(F.col("symbol")))
    return rows.select("p_partkey", "symbol", "x.is_call", "x.strike")


OSI = """WITH s AS (SELECT p_partkey, rpad('TIDE', 6, ' ') || strftime(DATE '2026-01-01' + CAST(p_partkey % 365 AS INTEGER), '%y%m%d') || CASE WHEN p_size % 2 = 0 THEN 'C' ELSE 'P' END
  || lpad(CAST((p_size * 5 + 1000) * 1000 AS VARCHAR), 8, '0') AS symbol FROM part)
SELECT p_partkey, symbol, symbol[13] = 'C' AS is_call, CAST(symbol[14:21] AS DOUBLE) / 1000 AS strike FROM s"""


def session_state_et(spark, sf_dir):
    """Whether each event falls into the 09:30-16:00 New York session of a weekday, both ends included."""
    et = F.from_utc_timestamp(F.col("ts").cast("timestamp"), "America/New_York")
    clock = F.hour(et) * 3600 + F.minute(et) * 60 + F.second(et)
    state = F.when(F.weekday(et) >= 5, "WEEKEND").when(clock < 34200, "BEFORE").when(clock > 57600, "AFTER").otherwise("OPEN")
    return table(spark, sf_dir, "events").groupBy(F.to_date(et).alias("day_et"), state.alias("state")).agg(F.count("*").alias("n"))


SESSION = """WITH e AS (SELECT timezone('America/New_York', timezone('UTC', ts)) AS et FROM events), c AS (SELECT et, hour(et) * 3600 + minute(et) * 60 + floor(second(et)) AS clock FROM e)
SELECT CAST(et AS DATE) AS day_et, CASE WHEN isodow(et) >= 6 THEN 'WEEKEND' WHEN clock < 34200 THEN 'BEFORE' WHEN clock > 57600 THEN 'AFTER' ELSE 'OPEN' END AS state, count(*) AS n FROM c GROUP BY 1, 2"""


def executable_value(spark, sf_dir):
    """Value of opening each order's lines at conservative prices: sold lines (returned) get, others pay, less fees."""
    q = F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity")).cast("decimal(18,2)")
    value = -q * F.col("l_extendedprice").cast("decimal(18,2)")
    fee = F.lit(0.70).cast("decimal(18,2)") * F.abs(q)
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", value.alias("v"), fee.alias("f"))
    return rows.groupBy("l_orderkey").agg((F.sum("v") - F.sum("f")).cast("double").alias("net"), F.greatest(F.lit(0.0), (F.sum("v") - F.sum("f")).cast("double")).alias("net_credit"))


EXECUTABLE = """WITH r AS (SELECT l_orderkey, CAST(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS DECIMAL(18,2)) AS q, CAST(l_extendedprice AS DECIMAL(18,2)) AS p FROM lineitem),
s AS (SELECT l_orderkey, CAST(sum(-q * p) - sum(CAST(0.70 AS DECIMAL(18,2)) * abs(q)) AS DOUBLE) AS net FROM r GROUP BY l_orderkey) SELECT l_orderkey, net, greatest(0.0, net) AS net_credit FROM s"""


def latency_percentiles(spark, sf_dir):
    p = lambda q: F.round(F.expr(f"percentile(value, {q})"), 2)
    return table(spark, sf_dir, "events").groupBy("event_type").agg(p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"))


LATENCY = "SELECT event_type, round(quantile_cont(value, 0.5), 2) AS p50, round(quantile_cont(value, 0.95), 2) AS p95, round(quantile_cont(value, 0.99), 2) AS p99 FROM events GROUP BY event_type"


def implied_vol_inversion(spark, sf_dir):
    """The price of a known volatility is inverted again: whether it comes back; prices that no volatility has give none."""
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select("p_partkey", F.lit(6400.0).alias("spot"), (6100.0 + F.col("p_size") * 10).alias("strike"), F.lit(0.02).alias("tau"), (F.col("p_size") % 2 == 0).alias("is_call"), (F.lit(0.1) + (k % 50) / 100.0).alias("sigma"))
    p = market.with_option_price(p, "sigma", "spot", "strike", "tau", "is_call", 0.045)
    p = p.withColumn("price", F.when(k % 7 == 0, F.lit(-1.0)).when(k % 11 == 0, F.lit(1e6)).otherwise(F.col("model_price")))
    p = market.with_implied_volatility(p, "price", "spot", "strike", "tau", "is_call", 0.045)
    again = market.with_option_price(p, "iv", "spot", "strike", "tau", "is_call", 0.045, "again")
    sure = lambda c: F.coalesce(c, F.lit(False))
    same = (F.col("model_price") <= 1.0) | (F.abs(F.col("iv") - F.col("sigma")) < 1e-4)  # cheap options don't tell volatilities apart
    return again.select("p_partkey", F.col("iv").isNotNull().alias("found"), sure(F.abs(F.col("again") - F.col("price")) <= 1e-6).alias("reprices"), sure(same & F.col("iv").isNotNull()).alias("same"))


IMPLIED_VOL = "SELECT p_partkey, p_partkey % 7 <> 0 AND p_partkey % 11 <> 0 AS found, p_partkey % 7 <> 0 AND p_partkey % 11 <> 0 AS reprices, p_partkey % 7 <> 0 AND p_partkey % 11 <> 0 AS same FROM part"


QUERIES = {
    "asof_latest_quote": (asof_latest_quote, ASOF_LATEST_QUOTE), "asof_join": (asof_join, ASOF_JOIN), "asof_minute_grid": (asof_minute_grid, ASOF_MINUTE_GRID),
    "strict_prior_day": (strict_prior_day, STRICT_PRIOR_DAY), "condor_fill_pivot": (condor_fill_pivot, CONDOR), "settlement_loss": (settlement_loss, SETTLEMENT),
    "realized_vol": (realized_vol, REALIZED_VOL), "log_returns": (log_returns, LOG_RETURNS), "excursions_argmax": (excursions_argmax, EXCURSIONS),
    "outcome_labels": (outcome_labels, OUTCOME_LABELS), "median_spread": (median_spread, MEDIAN_SPREAD), "quote_quality": (quote_quality, QUOTE_QUALITY),
    "exit_first_trigger": (exit_first_trigger, EXIT), "exit_summary": (exit_summary, EXIT_SUMMARY), "coverage_gaps": (coverage_gaps, COVERAGE_GAPS),
    "monotonic_violations": (monotonic_violations, MONOTONIC), "nearest_strikes_topk": (nearest_strikes_topk, NEAREST), "osi_roundtrip": (osi_roundtrip, OSI),
    "session_state_et": (session_state_et, SESSION), "executable_value": (executable_value, EXECUTABLE), "latency_percentiles": (latency_percentiles, LATENCY),
    "implied_vol_inversion": (implied_vol_inversion, IMPLIED_VOL),
}
