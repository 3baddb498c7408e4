"""Conservative execution of multi-leg positions: what can be proven to fill, and what it is worth."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.quality import seconds

FAILURES = ("INSUFFICIENT_SIZE", "INVALID_NBBO", "LIQUIDITY_LIMIT", "MISSING_LEGS", "MISSING_SIZE", "QUOTE_IN_FUTURE", "STALE_NBBO")


@dataclass(frozen=True)
class Assumptions:
    """Ages in seconds; fee and slippage a contract; the share of the shown size that may be taken."""

    max_quote_age: float
    fee: float
    slippage: float
    participation: float = 1.0

    def __post_init__(self) -> None:
        if self.max_quote_age < 0 or self.fee < 0 or self.slippage < 0 or not 0 < self.participation <= 1:
            raise ValueError("ages, fees and slippage must not be negative, participation must lie in (0, 1]")


def value_execution(
    legs: DataFrame, keys: list[str], valued_at: Column, a: Assumptions, closing: bool = False, expected: DataFrame | None = None, unique: bool = True, with_legs: bool = False
) -> DataFrame:
    """Per position (keys): executable, sorted failures, gross, fees, net, net_credit; figures are null unless every leg
    fills. legs: quantity (its sign is the side), multiplier, bid, ask, bid_size, ask_size, quoted_at, one row a leg.

    Bought legs pay the ask and slippage, sold ones get the bid less slippage. Stale, future, unsized and too thin quotes
    and prices below zero fail; `expected` (keys) adds positions without any leg. Where legs have a leg_id, one that a position
    has twice fails the job, unless `unique` is false. `with_legs` adds legs, the position's set of (leg_id, quantity, multiplier).
    One aggregation with map-side combine, of numbers only where neither leg ids nor sets are asked for.
    """
    q = -F.col("quantity") if closing else F.col("quantity")
    shown = F.when(q > 0, F.col("ask_size")).otherwise(F.col("bid_size"))
    n = F.abs(q)
    price = F.when(q > 0, F.col("ask") + a.slippage).otherwise(F.col("bid") - a.slippage)
    age = seconds(valued_at, F.col("quoted_at"))
    broken = {
        "QUOTE_IN_FUTURE": age < 0, "STALE_NBBO": age > a.max_quote_age, "MISSING_SIZE": shown.isNull(), "INSUFFICIENT_SIZE": shown.isNotNull() & (shown < n),
        "LIQUIDITY_LIMIT": shown.isNotNull() & (shown >= n) & (n / shown > a.participation), "INVALID_NBBO": price < 0,
    }
    named = unique and "leg_id" in legs.columns
    rows = legs.select(
        *keys, *(["leg_id"] if named else []), *([F.struct("leg_id", "quantity", "multiplier").alias("leg")] if with_legs else []), *[F.coalesce(c, F.lit(True)).alias(name) for name, c in broken.items()],
        (-q * price * F.col("multiplier")).alias("cash"), (n * F.lit(a.fee)).alias("fee"), (F.abs(F.when(q > 0, F.col("ask")).otherwise(F.col("bid")) - (F.col("bid") + F.col("ask")) / 2) * n * F.col("multiplier")).alias("half"),
    )
    sets = [(F.count("leg_id") > F.size(F.collect_set("leg_id"))).alias("twice")] if named else []
    sets += [F.sort_array(F.collect_set("leg")).alias("legs")] if with_legs else []
    found = rows.groupBy(*keys).agg(
        *[F.bool_or(name).alias(name) for name in broken], F.count("*").alias("n_legs"), F.sum("cash").alias("gross"), F.sum("fee").alias("fees"), F.sum("half").alias("half_spread_cost"), *sets
    )
    if named:
        checked = F.when(F.col("twice"), F.raise_error(F.lit("leg_id values must be unique")).cast("long")).otherwise(F.col("n_legs"))
        found = found.withColumn("n_legs", checked).drop("twice")
    if expected is not None:
        found = expected.select(*keys).distinct().join(found, keys, "left")
    missing = F.col("n_legs").isNull()
    unfit = F.lit(False)
    for name in sorted(set(broken) - {"INVALID_NBBO"}):
        unfit |= F.col(name)
    # Prices are looked at only where every quote is fit for use.
    holds = {name: F.col(name) for name in broken} | {"MISSING_LEGS": missing, "INVALID_NBBO": ~unfit & F.col("INVALID_NBBO")}
    failures = F.array_compact(F.array(*[F.when(holds[name], F.lit(name)) for name in FAILURES]))
    ok = ~missing & ~unfit & ~F.col("INVALID_NBBO")
    on = lambda c: F.when(ok, c)
    net = F.col("gross") - F.col("fees")
    return found.select(
        *keys, ok.alias("executable"), failures.alias("failures"), on(F.col("gross")).alias("gross"), on(F.col("fees")).alias("fees"), on(F.col("half_spread_cost")).alias("half_spread_cost"),
        on(net).alias("net"), on(F.greatest(net, F.lit(0.0))).alias("net_credit"), *(["legs"] if with_legs else []),
    )


def executable_pnl(opening: DataFrame, closing: DataFrame, keys: list[str], mark: str, opened_at: Column, a: Assumptions, unique: bool = True) -> DataFrame:
    """Per position and mark: pnl of opening at opened_at and closing at the mark's time, null unless both sides fill with
    exactly the same legs (leg_id, quantity, multiplier). closing has a column `mark` with the time of each mark. Both sides are
    aggregated once, and dealt out once where they come from one table that is partitioned by keys."""
    o = value_execution(opening, keys, opened_at, a, unique=unique, with_legs=True).select(*keys, F.col("net").alias("opening_net"), F.col("legs").alias("__o"))
    for c in (*keys, mark):
        closing = closing.where(F.col(c).isNotNull())
    c = value_execution(closing, [*keys, mark], F.col(mark), a, closing=True, unique=unique, with_legs=True).select(*keys, mark, F.col("net").alias("closing_net"), F.col("legs").alias("__c"))
    pnl = F.when(F.col("__c") == F.col("__o"), F.col("opening_net") + F.col("closing_net"))
    return c.join(o, keys, "left").select(*keys, mark, "opening_net", "closing_net", pnl.alias("pnl"))


def pnl_path(marks: DataFrame, keys: list[str]) -> DataFrame:
    """Per position: marks and the largest loss on the way; null if any mark can't be proven."""
    proven = F.bool_and(F.col("pnl").isNotNull())
    return marks.groupBy(*keys).agg(F.count("*").alias("n_marks"), F.when(proven, F.greatest(F.lit(0.0), -F.min("pnl"))).alias("maximum_mtm_loss"))
