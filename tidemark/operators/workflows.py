"""Composite workflows: label and feature batches, economics of days, exit rules, calibrated tail models and their walk-forward
evaluation. Every stage takes DataFrames, and every day of a batch ends in exactly one outcome."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import time

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import years_between
from tidemark.operators import asof, market, rules, tails
from tidemark.operators.calendar import new_york_instant
from tidemark.operators.exact import exact_sums
from tidemark.operators.quality import beside_center, seconds
from tidemark.session import cut

#: Most seconds between neighbouring bars of a label's window.
MAX_GAP = 180
#: Options whose volatilities make the at-the-money one, and the offset of the skew's legs from the centre.
ATM_OPTIONS, SKEW_OFFSET = 4, 0.02
LEGS = (("short_put", "P"), ("long_put", "P"), ("short_call", "C"), ("long_call", "C"))


def label_batch(bars: DataFrame, definitions: DataFrame, anchors: DataFrame, present: DataFrame, start: Column, end: Column, windows: DataFrame, max_gap: int = MAX_GAP) -> DataFrame:
    """One row for each day from start to end on which bars or definitions landed: its outcome, and its label where it has one.

    bars: day, ts, high, low, close; definitions, present: day; anchors: day, close (official); windows: day, entry_ts,
    close_ts (of the session, an early close included). Outcomes, in this order: GAP (definitions without bars),
    ALREADY_PRESENT, SKIPPED_NO_PRIOR (no earlier day with bars), SKIPPED_NO_ANCHOR (no official close of that day),
    SKIPPED_ENTRY_AFTER_CLOSE, SKIPPED_COVERAGE (nothing at or before the entry, nothing after it, a gap above max_gap, or an
    end too far from the close), LABELLED. Prices are implied: the anchor times the bar over the prior day's last close.
    """
    landed = bars.groupBy("day").agg(F.max_by("close", "ts").alias("last_close"))
    w = Window.orderBy("day")  # one row a day
    landed = landed.select("day", F.lit(True).alias("has_bars"), F.lag("day").over(w).alias("prior_day"), F.lag("last_close").over(w).alias("f_a"))
    days = landed.join(definitions.select("day").distinct(), "day", "full").where(F.col("day").between(start, end))
    days = days.join(present.select("day", F.lit(True).alias("is_present")).distinct(), "day", "left").join(windows, "day", "left")
    days = days.join(anchors.select(F.col("day").alias("prior_day"), F.col("close").alias("spx_a")), "prior_day", "left")
    path = bars.join(days.where("spx_a IS NOT NULL").select("day", "entry_ts", "close_ts", "spx_a", "f_a"), "day")
    scale = lambda c: F.col("spx_a") * F.col(c) / F.col("f_a")
    before, inside = F.col("ts") <= F.col("entry_ts"), (F.col("ts") > F.col("entry_ts")) & (F.col("ts") <= F.col("close_ts"))
    price = F.when(inside, scale("close"))
    path = path.where(F.col("ts") <= F.col("close_ts")).withColumn("gap", F.when(inside, seconds(F.col("ts"), F.lag("ts").over(Window.partitionBy("day").orderBy("ts")))))
    at = lambda pick, c: pick(F.when(inside, F.struct(c, F.col("ts"))))
    moved = path.groupBy("day", "close_ts").agg(
        F.max_by(scale("close"), F.when(before, F.col("ts"))).alias("entry_price"), F.count(F.when(before, F.col("ts"))).alias("n_before"), F.max_by(price, F.when(inside, F.col("ts"))).alias("close_price"),
        F.max(price).alias("high"), F.min(price).alias("low"), at(F.min, -scale("close"))["ts"].alias("up_max_ts"), at(F.min, scale("close"))["ts"].alias("down_max_ts"), F.count(price).alias("sample_count"), F.max("gap").alias("max_gap"), F.max(F.when(inside, F.col("ts"))).alias("last_ts"),
    )
    covered = (F.col("n_before") > 0) & (F.col("sample_count") > 0) & (F.col("max_gap") <= max_gap) & (seconds(F.col("close_ts"), F.col("last_ts")) <= max_gap)
    up, down = F.greatest(F.lit(0.0), F.col("high") - F.col("entry_price")), F.greatest(F.lit(0.0), F.col("entry_price") - F.col("low"))
    moved = moved.select("day", covered.alias("covered"), "entry_price", "close_price", up.alias("up_max"), down.alias("down_max"), "up_max_ts", "down_max_ts", "sample_count")
    rows = days.join(moved, "day", "left")
    outcome = rules.first_of([
        (F.col("has_bars").isNull(), "GAP"), (F.col("is_present").isNotNull(), "ALREADY_PRESENT"), (F.col("prior_day").isNull(), "SKIPPED_NO_PRIOR"), (F.col("spx_a").isNull(), "SKIPPED_NO_ANCHOR"),
        (F.col("entry_ts") >= F.col("close_ts"), "SKIPPED_ENTRY_AFTER_CLOSE"), (~F.coalesce("covered", F.lit(False)), "SKIPPED_COVERAGE"),
    ], "LABELLED")
    rows = rows.withColumn("outcome", outcome)
    label = ("spx_a", "f_a", "entry_price", "close_price", "up_max", "down_max", "up_max_ts", "down_max_ts", "sample_count")
    return rows.select("day", "outcome", "prior_day", *(F.when(F.col("outcome") == "LABELLED", F.col(c)).alias(c) for c in label))


def entry_snapshot(quotes: DataFrame, bars: DataFrame, entries: DataFrame, rate: float = 0.045) -> DataFrame:
    """Per entry (day, entry_ts, center, expiry_ts): atm_iv, skew, realized volatility of the last 30 minutes, median spread,
    atm_iv_valid, from what was known at the entry. quotes: day, symbol, ts, seq, bid, ask; bars: day, ts, close.

    The at-the-money volatility is the median over the sane options nearest to the centre, each used on its own side; null
    (and not valid) where none can be inverted. Without both legs the skew is 0.
    """
    known = quotes.join(entries, "day").where("ts <= entry_ts")
    last = asof.latest_per_key(known, ["day", "entry_ts", "center", "expiry_ts", "symbol"], ["ts", "seq"], ["bid", "ask"])
    two = last.where("bid IS NOT NULL AND ask IS NOT NULL").withColumn("o", market.parse_osi(F.col("symbol"))).select("*", "o.is_call", "o.strike").where("strike IS NOT NULL")
    center = F.col("center")
    band = two.where(F.col("strike").between(center * 0.97, center * 1.03)).groupBy("day").agg(F.median(F.col("ask") - F.col("bid")).alias("median_spread"))
    sane = two.where(market.is_sane(F.col("bid"), F.col("ask"))).withColumn("mid", (F.col("bid") + F.col("ask")) / 2)
    rank = lambda target: F.row_number().over(Window.partitionBy("day").orderBy(F.abs(F.col("strike") - target), "strike"))
    atm = beside_center(sane, center, band=None).withColumn("k", rank(center)).where(F.col("k") <= ATM_OPTIONS).withColumn("use", F.lit("ATM"))
    put = sane.where("NOT is_call").withColumn("k", rank(center * (1 - SKEW_OFFSET))).where("k = 1").withColumn("use", F.lit("PUT"))
    call = sane.where("is_call").withColumn("k", rank(center * (1 + SKEW_OFFSET))).where("k = 1").withColumn("use", F.lit("CALL"))
    chosen = atm.unionByName(put).unionByName(call).withColumn("tau", years_between(F.col("entry_ts"), F.col("expiry_ts")))
    iv = market.with_implied_volatility(chosen, "mid", "center", "strike", "tau", "is_call", rate)
    of = lambda use: F.when(F.col("use") == use, F.col("iv"))
    vols = iv.groupBy("day").agg(F.median(of("ATM")).alias("atm_iv"), (F.max(of("PUT")) - F.max(of("CALL"))).alias("skew"))
    window = bars.join(entries.select("day", "entry_ts"), "day").where("ts >= entry_ts - INTERVAL 30 MINUTES AND ts < entry_ts")
    real = market.realized_volatility(window, ["day"], "ts", "close").select("day", F.col("vol").alias("realized_vol"))
    rows = entries.join(vols, "day", "left").join(real, "day", "left").join(band, "day", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return rows.select("day", "entry_ts", "center", "atm_iv", zero("skew"), zero("realized_vol"), zero("median_spread"), F.col("atm_iv").isNotNull().alias("atm_iv_valid"))


def feature_outcomes(labels: DataFrame, present: DataFrame, chain_days: DataFrame) -> DataFrame:
    """Each labelled day: ALREADY_PRESENT, GAP (no chain of the day), or COMPUTED."""
    rows = labels.select("day").distinct().join(present.select("day", F.lit(True).alias("p")).distinct(), "day", "left").join(chain_days.select("day", F.lit(True).alias("c")).distinct(), "day", "left")
    return rows.select("day", rules.first_of([(F.col("p").isNotNull(), "ALREADY_PRESENT"), (F.col("c").isNull(), "GAP")], "COMPUTED").alias("outcome"))


def ingest_plan(pulls: DataFrame, landed: DataFrame, estimates: DataFrame, chains: DataFrame, now: Column, ceiling: float) -> tuple[DataFrame, DataFrame]:
    """(items, decision) of a cost-gated plan. items: each pull (logical_key, day, needs_chain) with its outcome, in this order:
    SKIPPED_PRESENT (landed before), NOT_DUE (the day hasn't closed by now), GAP (no estimate), EMPTY_CHAIN (a pull of a chain
    on a day without contracts), PLANNED; and its cost. decision, one row: the total and whether it keeps to the ceiling.
    landed: logical_key; estimates: logical_key, usd (null if it failed); chains: day, n_symbols."""
    rows = pulls.join(landed.select("logical_key", F.lit(True).alias("__landed")).distinct(), "logical_key", "left").join(estimates, "logical_key", "left").join(chains, "day", "left")
    outcome = rules.first_of([
        (F.col("__landed").isNotNull(), "SKIPPED_PRESENT"), (F.col("day") >= now, "NOT_DUE"), (F.col("usd").isNull(), "GAP"), (F.col("needs_chain") & (F.coalesce("n_symbols", F.lit(0)) == 0), "EMPTY_CHAIN"),
    ], "PLANNED")
    items = rows.withColumn("outcome", outcome).withColumn("cost", F.when(F.col("outcome").isin("PLANNED", "EMPTY_CHAIN"), F.col("usd").cast("decimal(18,6)")).otherwise(F.lit(0)))
    total = F.coalesce(F.sum("cost"), F.lit(0))
    counts = [F.count_if(F.col("outcome") == o).alias(f"n_{o.lower()}") for o in ("PLANNED", "SKIPPED_PRESENT", "NOT_DUE", "GAP", "EMPTY_CHAIN")]
    decision = items.agg(total.cast("double").alias("total_usd"), F.when(total <= F.lit(ceiling).cast("decimal(18,6)"), "APPROVED").otherwise("BLOCKED").alias("decision"), *counts)
    return items.select("logical_key", "day", "outcome", F.col("cost").cast("double").alias("cost")), decision


def structure_legs(positions: DataFrame, root: str = "SPXW", grid: int = 5, wing: int = 5) -> DataFrame:
    """positions (day, center, down_distance, up_distance, ...) with strikes k and one row a leg (leg, symbol)."""
    rows = positions.withColumn("k", market.condor_strikes(F.col("center"), F.col("down_distance"), F.col("up_distance"), grid, wing))
    legs = [F.struct(F.lit(n).alias("leg"), market.osi_symbol(F.lit(root), F.col("day"), F.lit(r), F.col("k")[n].cast("double")).alias("symbol")) for n, r in LEGS]
    return rows.select("*", F.inline(F.array(*legs)))


def economics_days(labels: DataFrame, distances: DataFrame, quotes: DataFrame, fees: float = 0.0, grid: int = 5, wing: int = 5) -> DataFrame:
    """One row a day of labels or distances: its disposition, and credit, settlement loss, pnl, fees, net and breaches where all
    four legs fill. labels: day, entry_ts, center, close_price; distances: day, up_distance, down_distance, regime; quotes:
    day, symbol, ts, seq, bid, ask. Dispositions: MISSING_LABEL, MISSING_DISTANCE, MISSING_CHAIN, UNPRICEABLE, PRICED."""
    joined = asof.reconcile(labels, distances, "day", "LABEL", "DISTANCE")
    chains = quotes.select("day").distinct().withColumn("has_chain", F.lit(True))
    joined = joined.join(chains, "day", "left")
    ready = structure_legs(joined.where("disposition = 'JOINED' AND has_chain"), grid=grid, wing=wing)
    legs = ready.select("day", "entry_ts", "leg", "symbol")
    known = quotes.join(legs.select("day", "entry_ts", "symbol"), ["day", "symbol"]).where("ts <= entry_ts")
    last = asof.latest_per_key(known, ["day", "symbol"], ["ts", "seq"], ["bid", "ask"])
    priced = market.condor_price(legs.select("day", "leg", "symbol"), last, ["day"]).select("day", "credit")
    rows = joined.join(ready.select("day", "k").dropDuplicates(["day"]), "day", "left").join(priced, "day", "left")
    which = rules.first_of([(F.col("disposition") != "JOINED", "x"), (F.col("has_chain").isNull(), "MISSING_CHAIN"), (F.col("credit").isNull(), "UNPRICEABLE")], "PRICED")
    rows = rows.withColumn("status", F.when(F.col("disposition") != "JOINED", F.col("disposition")).otherwise(which))
    close, on = F.col("close_price"), lambda c: F.when(F.col("status") == "PRICED", c)
    loss = market.settlement_loss(close, F.col("k.short_put"), F.col("k.short_call"), F.lit(float(wing)))
    pnl = F.col("credit") - loss
    return rows.select(
        "day", "regime", "status", on(F.col("credit")).alias("credit"), on(F.lit(float(wing)) - F.col("credit")).alias("max_loss"), on(loss).alias("settlement_loss"), on(pnl).alias("pnl"), on(F.lit(fees)).alias("fees"), on(pnl - fees).alias("net_pnl"),
        on(close < F.col("k.short_put")).alias("put_breached"), on(close > F.col("k.short_call")).alias("call_breached"),
    )


def summarize(days: DataFrame, keys: list[str], extra: dict[str, Column] | None = None) -> DataFrame:
    """Per key of days with a status, pnl and fees: counts, totals, means, value per candidate day, the mean of the worst 5 %,
    the worst day, and the share of wins. Sums of doubles are exact but for the last rounding. Figures over days are null where none
    is priced; a day without a price counts as a candidate. extra: further aggregates."""
    days = cut(days.where(F.col("status").isin("PRICED", "UNPRICEABLE")))  # narrow, and read several times
    sums = exact_sums(days, keys, {"__pnl": F.col("pnl"), "__fees": F.col("fees")})
    counts = days.groupBy(*keys).agg(
        F.count("pnl").alias("n_priced"), F.count("*").alias("__n"), F.min("pnl").alias("__least"), F.count_if(F.col("pnl") > 0).alias("__wins"), *(c.alias(k) for k, c in (extra or {}).items()),
    )
    total, fee, n = F.coalesce("__pnl", F.lit(0.0)), F.coalesce("__fees", F.lit(0.0)), F.col("n_priced")
    out = tails.beside(counts, sums, keys).select(
        *keys, "n_priced", (F.col("__n") - n).alias("n_unpriceable"), total.alias("total_pnl"), F.try_divide("__pnl", n).alias("mean_pnl"), (total / F.col("__n")).alias("ev"), F.greatest(F.lit(0.0), -F.col("__least")).alias("max_daily_loss"),
        F.try_divide("__wins", n).alias("win_rate"), fee.alias("total_fees"), (total - fee).alias("net_total_pnl"), ((total - fee) / F.col("__n")).alias("net_ev"), *(extra or {}),
    )
    out = out.withColumn("max_daily_loss", F.when(F.col("n_priced") > 0, F.col("max_daily_loss")))
    return out.join(tails.worst_mean(days.where("pnl IS NOT NULL"), keys, "pnl", 0.05, "pnl", "cvar_95"), keys, "left")


@dataclass(frozen=True)
class ExitRule:
    """HOLD, PROFIT_TARGET (at a share of the credit), STOP_LOSS (at a multiple of it) or TIME_EXIT (at a New York clock time of the
    position's day, HH:MM, or else some seconds after the entry)."""

    kind: str
    profit_fraction: float = 0.5
    stop_multiple: float = 1.0
    after_seconds: float = 0.0
    time_exit_et: str | None = None

    def triggered(self) -> Column:
        if self.kind == "PROFIT_TARGET":
            return F.col("cost") <= F.col("credit") * (1.0 - self.profit_fraction)
        if self.kind == "STOP_LOSS":
            return F.col("cost") >= F.col("credit") * (1.0 + self.stop_multiple)
        if self.kind == "TIME_EXIT" and self.time_exit_et is not None:
            clock = time.fromisoformat(self.time_exit_et)
            return F.col("ts") >= new_york_instant(F.col("day").cast("date"), clock.hour * 3600 + clock.minute * 60 + clock.second)
        if self.kind == "TIME_EXIT":
            return seconds(F.col("ts"), F.col("entry_ts")) >= self.after_seconds
        if self.kind != "HOLD":
            raise ValueError(f"unknown exit rule {self.kind}")
        return F.lit(False)


REASONS = ("EXPIRY", "PROFIT_TARGET", "STOP_LOSS", "TIME_EXIT")


def exit_outcomes(positions: DataFrame, quotes: DataFrame, rule_list: list[ExitRule], step_seconds: int = 60, wing: int = 5) -> DataFrame:
    """Each position (day, entry_ts, close_ts, close_price, credit, center, down_distance, up_distance) under each rule: exit_ts,
    reason, cost, pnl, holding minutes. The cost of closing is of each leg's latest quote at every step after the entry up to
    the close; steps at which a leg can't be traded are passed over; without a trigger the position settles."""
    positions = cut(positions)  # read several times
    legs = structure_legs(positions, wing=wing)
    times = F.expr(f"sequence(entry_ts + INTERVAL {step_seconds} SECONDS, close_ts, INTERVAL {step_seconds} SECONDS)")
    open_ = F.col("entry_ts") + F.expr(f"INTERVAL {step_seconds} SECONDS") <= F.col("close_ts")
    grid = legs.where(open_).select("day", "symbol", "leg", F.explode(times).alias("ts"))
    needed = quotes.join(legs.select("day", "symbol").distinct(), ["day", "symbol"], "left_semi").select("day", "symbol", "ts", "seq", "bid", "ask")
    q = asof.asof_backward(grid, needed, ["day", "symbol"], "ts", ["bid", "ask"], "seq").withColumns({"sell": market.sell_price(F.col("bid"), F.col("ask")), "buy": market.buy_price(F.col("bid"), F.col("ask"))})
    of = lambda leg, c: F.max(F.when(F.col("leg") == leg, F.col(c)))
    cost = of("short_put", "buy") + of("short_call", "buy") - of("long_put", "sell") - of("long_call", "sell")
    costs = q.groupBy("day", "ts").agg(cost.alias("cost")).where("cost IS NOT NULL").join(positions.select("day", "entry_ts", "credit"), "day")
    hits = costs.groupBy("day").agg(*(F.min(F.when(r.triggered(), F.struct("ts", "cost"))).alias(f"r{i}") for i, r in enumerate(rule_list)))
    strikes = legs.select("day", "k").dropDuplicates(["day"])
    loss = market.settlement_loss(F.col("close_price"), F.col("k.short_put"), F.col("k.short_call"), F.lit(float(wing)))
    rows = positions.join(strikes, "day").join(hits, "day", "left").withColumn("settled", loss)
    each = [F.struct(F.lit(i).alias("rule"), F.lit(r.kind).alias("kind"), F.col(f"r{i}").alias("hit")) for i, r in enumerate(rule_list)]
    rows = rows.select("day", "entry_ts", "close_ts", "credit", "settled", F.inline(F.array(*each)))
    hit = F.col("hit").isNotNull()
    out, ts = F.when(hit, F.col("hit.cost")).otherwise(F.col("settled")), F.when(hit, F.col("hit.ts")).otherwise(F.col("close_ts"))
    return rows.select("day", "rule", "kind", ts.alias("exit_ts"), F.when(hit, F.col("kind")).otherwise("EXPIRY").alias("reason"), out.alias("exit_cost"), (F.col("credit") - out).alias("pnl"), (seconds(ts, F.col("entry_ts")) / 60.0).alias("holding_minutes"))


def exit_summary(outcomes: DataFrame, unpriceable: DataFrame, rule_list: list[ExitRule]) -> DataFrame:
    """Per rule: the summary with mean holding minutes and a count for every reason, zero if none. unpriceable: days (day) whose
    position never opened; they are candidates of every rule."""
    kinds = outcomes.sparkSession.createDataFrame([(i, r.kind) for i, r in enumerate(rule_list)], "rule int, kind string")
    none = unpriceable.select("day").distinct().crossJoin(kinds).withColumn("status", F.lit("UNPRICEABLE"))  # a few rules
    rows = outcomes.withColumn("status", F.lit("PRICED")).unionByName(none, allowMissingColumns=True).withColumn("fees", F.lit(0.0))
    extra = {"mean_holding_minutes": F.avg("holding_minutes")} | {f"n_{r.lower()}": F.count_if(F.col("reason") == r) for r in REASONS}
    return summarize(rows, ["rule", "kind"], extra).drop("total_fees", "net_total_pnl", "net_ev", "max_daily_loss")


def entry_risk(scenarios: DataFrame, keys: list[str], executable: DataFrame, max_loss: Column, risk_budget: float, cvar_budget: float, confidence: float) -> DataFrame:
    """Per position: expected and worst result over its scenarios (pnl, probability), the loss of the worst tail, and whether it
    may be entered: NO_TRADE if it can't fill, has no bounded loss, or is over a budget, else WAIT. A scenario beyond the
    declared largest loss, or probabilities that don't add up to 1, are a fault. executable: keys, executable."""
    p, pnl = F.col("probability"), F.col("pnl")
    found = scenarios.groupBy(*keys).agg(F.sum(p * pnl).cast("double").alias("expected"), F.greatest(F.lit(0.0), -F.min(pnl).cast("double")).alias("scenario_max_loss"), F.sum(p).cast("double").alias("mass"))
    tail = tails.weighted_tail_loss(scenarios, keys, "pnl", "probability", 1.0 - confidence, "tail_loss")
    rows = found.join(tail, keys).join(executable, keys, "left").withColumn("max_loss", max_loss)
    fault = F.when(F.abs(F.col("mass") - 1) > 1e-9, "PROBABILITIES").when(F.col("max_loss").isNotNull() & (F.col("scenario_max_loss") > F.col("max_loss") + 1e-9), "BEYOND_MAX_LOSS")
    over = F.col("max_loss").isNull() | (F.col("max_loss") > risk_budget) | (F.col("tail_loss") > cvar_budget)
    reason = F.when(~F.coalesce("executable", F.lit(False)), "OPTION_CHAIN_UNUSABLE").when(over, "RISK_BUDGET_EXCEEDED")
    rows = rows.withColumns({"fault": fault, "reason": reason})
    return rows.drop("mass").withColumn("action", F.when(F.col("reason").isNull() & F.col("fault").isNull(), "WAIT").otherwise("NO_TRADE"))


def buffer_calibration(train: DataFrame, keys: list[str], quantile: float, target: float, buffer_max: float, step: float) -> DataFrame:
    """Per key: the conservative quantiles of both sides and the cheapest pair of buffers (least sum, then least up) on a grid
    for which the share of days covered on both sides reaches the target; the largest pair, not calibrated, if none does.
    train: keys, up_max, down_max. Days are counted into the grid's cells, and two cumulative sums count every pair."""
    steps = round(buffer_max / step)
    q = train.groupBy(*keys).agg(tails.quantile_higher("up_max", quantile).alias("base_up"), tails.quantile_higher("down_max", quantile).alias("base_down"), F.count("*").alias("n_train"))
    rows = train.join(q, keys)
    cell = lambda c, base: F.greatest(F.lit(0), F.ceil((F.col(c) - F.col(base)) / F.lit(step))).cast("int")
    cells = rows.groupBy(*keys, cell("up_max", "base_up").alias("u"), cell("down_max", "base_down").alias("d")).agg(F.count("*").alias("c"))
    sides = F.sequence(F.lit(0), F.lit(steps))
    grid = q.select(*keys, "n_train", F.explode(sides).alias("u")).withColumn("d", F.explode(sides))  # (steps + 1)^2 rows a key
    full = grid.join(cells, [*keys, "u", "d"], "left").withColumn("c", F.coalesce("c", F.lit(0)))
    full = full.withColumn("x", F.sum("c").over(Window.partitionBy(*keys, "u").orderBy("d")))
    full = full.withColumn("covered", F.sum("x").over(Window.partitionBy(*keys, "d").orderBy("u"))).withColumn("coverage", F.col("covered") / F.col("n_train"))
    best = F.min(F.when(F.col("coverage") >= F.lit(target), F.struct((F.col("u") + F.col("d")).alias("s"), "u", "d", "coverage"))).alias("b")
    most = F.max(F.when((F.col("u") == steps) & (F.col("d") == steps), F.col("coverage"))).alias("most")
    found = q.join(full.groupBy(*keys).agg(best, most), keys)
    pick = lambda field, otherwise: F.coalesce(F.col(f"b.{field}"), otherwise)
    return found.select(
        *keys, "n_train", "base_up", "base_down", (pick("u", F.lit(steps)) * F.lit(step)).alias("buffer_up"), (pick("d", F.lit(steps)) * F.lit(step)).alias("buffer_down"), F.col("b").isNotNull().alias("calibrated"), pick("coverage", F.col("most")).alias("train_coverage")
    )


@dataclass(frozen=True)
class TailModel:
    """unconditional, iv_regime, buffered or buffered_iv, fitted on training days only (up_max, down_max, iv)."""

    kind: str
    quantile: float
    target: float | None = None
    min_distance: float = 0.0
    min_regime_days: int = 20
    allow_fallback: bool = True
    buffer_max: float = 40.0
    buffer_step: float = 2.0

    def __post_init__(self) -> None:
        if self.kind not in ("unconditional", "iv_regime", "buffered", "buffered_iv"):
            raise ValueError(f"unknown tail model {self.kind}")
        if not 0 < self.quantile < 1 or (self.target is not None and not 0 < self.target < 1):
            raise ValueError("quantile and target must lie in (0, 1)")

    def _table(self, train: DataFrame, keys: list[str]) -> DataFrame:
        """keys, n_train, up, down (null where the buffers can't be calibrated)."""
        if self.kind in ("unconditional", "iv_regime"):
            return train.groupBy(*keys).agg(F.count("*").alias("n_train"), tails.quantile_higher("up_max", self.quantile).alias("up"), tails.quantile_higher("down_max", self.quantile).alias("down"))
        c = buffer_calibration(train, keys, self.quantile, self.target or self.quantile, self.buffer_max, self.buffer_step)
        side = lambda s: F.when(F.col("calibrated"), F.col(f"base_{s}") + F.col(f"buffer_{s}")).alias(s)
        return c.select(*keys, "n_train", side("up"), side("down"))

    def recommend(self, train: DataFrame, test: DataFrame, keys: list[str]) -> DataFrame:
        """test (keys, day, iv, ...) with up_distance, down_distance and regime, all null where the model abstains."""
        if self.kind in ("unconditional", "buffered"):
            rows = test.join(self._table(train, keys), keys, "left").withColumn("regime", F.when(F.col("up").isNotNull(), "UNCONDITIONAL" if self.kind == "unconditional" else "BUFFERED"))
        else:
            valid = train.where("iv IS NOT NULL")
            cuts = valid.groupBy(*keys).agg(*(tails.quantile_higher("iv", q).alias(f"c{k}") for k, q in ((1, 0.25), (2, 0.5), (3, 0.75))))
            bucket = tails.quartile_regime("iv", [F.col("c1"), F.col("c2"), F.col("c3")])
            own = self._table(valid.join(cuts, keys).withColumn("bucket", bucket), [*keys, "bucket"]).where(F.col("n_train") >= self.min_regime_days).select(*keys, "bucket", F.col("up").alias("own_up"), F.col("down").alias("own_down"))
            every = self._table(valid, keys)
            rows = test.join(cuts, keys, "left").withColumn("bucket", F.when(F.col("iv").isNotNull(), bucket)).join(own, [*keys, "bucket"], "left").join(every, keys, "left")
            fall = F.lit(self.allow_fallback) & F.col("bucket").isNotNull()
            name = "_FALLBACK" if self.kind == "iv_regime" else "_BUFFERED_FALLBACK"
            found = F.col("own_up").isNotNull()
            rows = rows.withColumn("regime", F.when(found, F.col("bucket")).when(fall & F.col("up").isNotNull(), F.concat("bucket", F.lit(name))))
            rows = rows.withColumn("up", F.when(found, F.col("own_up")).when(fall, F.col("up"))).withColumn("down", F.when(found, F.col("own_down")).when(fall, F.col("down")))
        out = lambda c: F.greatest(F.col(c), F.when(F.col(c).isNotNull(), F.lit(self.min_distance)))
        return rows.select(*test.columns, out("up").alias("up_distance"), out("down").alias("down_distance"), "regime")


def evaluation_metrics(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per fold and over all of them (fold null): days, abstentions, coverage, breaches, means and medians of distances, and the
    coverage bought per unit of distance. rows: keys, fold, up_max, down_max, up_distance, down_distance."""
    told = F.col("up_distance").isNotNull()
    up, down = F.col("up_max") <= F.col("up_distance"), F.col("down_max") <= F.col("down_distance")
    n = F.count("up_distance")
    parts = rows.withColumn("fold", F.explode(F.array(F.col("fold"), F.lit(None).cast("long"))))
    share = F.try_divide(F.count_if(told & up & down), n)
    total = F.avg("up_distance") + F.avg("down_distance")
    return parts.groupBy(*keys, "fold").agg(
        F.count("*").alias("test_days"), F.count_if(~told).alias("abstain_days"), n.alias("evaluated_days"), F.count_if(told & up & down).alias("covered_days"), F.count_if(told & ~up).alias("up_breaches"), F.count_if(told & ~down).alias("down_breaches"),
        share.alias("coverage"), (F.count_if(~told) / F.count("*")).alias("no_trade_share"), F.avg("up_distance").alias("mean_up"), F.avg("down_distance").alias("mean_down"), F.median("up_distance").alias("median_up"), F.median("down_distance").alias("median_down"),
        F.try_divide(share, total).alias("coverage_per_distance"),
    )


def walk_forward_evaluation(days: DataFrame, models: list[TailModel], min_train: int, test_days: int, gap_days: int) -> DataFrame:
    """Every model on the same purged folds of days (day, up_max, down_max, iv): metrics by model and fold."""
    members = tails.fold_members(days.withColumn("__g", F.col("day").cast("string")), "__g", "day", min_train, test_days, gap_days).drop("__g")
    train, test = members.where("role = 'TRAIN'").drop("role"), members.where("role = 'TEST'").drop("role")
    out = None
    for m in models:
        rows = m.recommend(train, test, ["fold"]).withColumn("model", F.lit(m.kind))
        out = rows if out is None else out.unionByName(rows)
    return evaluation_metrics(out, ["model"])
