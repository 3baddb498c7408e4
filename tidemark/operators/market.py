"""Option symbols, quote usability, structure prices, settlement, fees, volatility features and excursions."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

YEAR_SECONDS = 365.25 * 86400
#: Bisection for implied volatility: bracket, rounds and relative tolerance.
VOL_LOW, VOL_HIGH, VOL_ROUNDS, VOL_TOLERANCE = 1e-4, 5.0, 64, 1e-9


def osi_symbol(root: Column, day: Column, right: Column, strike: Column) -> Column:
    return F.format_string("%-6s%s%s%08d", root, F.date_format(day, "yyMMdd"), right, F.round(strike * 1000).cast("long"))


def parse_osi(symbol: Column) -> Column:
    """struct(is_call, strike), null where the 21 characters don't parse."""
    fine = symbol.rlike("^.{6}[0-9]{6}[CP][0-9]{8}$")
    return F.when(fine, F.struct((F.substring(symbol, 13, 1) == "C").alias("is_call"), (F.substring(symbol, 14, 8).cast("double") / 1000).alias("strike")))


def sell_price(bid: Column, ask: Column) -> Column:
    return F.when((bid > 0) & (ask.isNull() | (bid <= ask)), bid)


def buy_price(bid: Column, ask: Column) -> Column:
    return F.when(bid.isNull() | (bid <= ask), ask)


def is_sane(bid: Column, ask: Column, least_mid: float = 0.10, most_spread: float = 0.5) -> Column:
    mid = (bid + ask) / 2
    return (mid >= least_mid) & (ask - bid <= most_spread * mid)


def condor_strikes(center: Column, down: Column, up: Column, grid: int = 5, wing: int = 5) -> Column:
    """struct of the four strikes: shorts are on the grid, at or beyond the distances; wings lie `wing` beyond."""
    # Ten digits, so that a sum a hair off the grid is on it.
    short_put = grid * F.floor(F.round((center - down) / grid, 10))
    short_call = grid * F.ceil(F.round((center + up) / grid, 10))
    return F.struct(
        short_put.cast("int").alias("short_put"), (short_put - wing).cast("int").alias("long_put"),
        short_call.cast("int").alias("short_call"), (short_call + wing).cast("int").alias("long_call"),
    )


def settlement_loss(close: Column, short_put: Column, short_call: Column, wing: Column) -> Column:
    beyond = F.greatest(F.lit(0.0), short_put - close) + F.greatest(F.lit(0.0), close - short_call)
    return F.least(F.greatest(beyond, F.lit(0.0)), wing)


def condor_price(legs: DataFrame, quotes: DataFrame, keys: list[str]) -> DataFrame:
    """legs (keys..., leg in short_put, long_put, short_call, long_call; symbol) with the latest quotes (keys..., symbol,
    bid, ask) -> keys, credit, close_cost, priced: null unless all four legs can be traded."""
    filled = legs.join(quotes, [*keys, "symbol"], "left").withColumns({"sell": sell_price(F.col("bid"), F.col("ask")), "buy": buy_price(F.col("bid"), F.col("ask"))})
    of = lambda leg, c: F.max(F.when(F.col("leg") == leg, F.col(c)))
    out = filled.groupBy(*keys).agg(
        (of("short_put", "sell") + of("short_call", "sell") - of("long_put", "buy") - of("long_call", "buy")).alias("credit"),
        (of("short_put", "buy") + of("short_call", "buy") - of("long_put", "sell") - of("long_call", "sell")).alias("close_cost"),
    )
    return out.withColumn("priced", F.col("credit").isNotNull())


def round_trip_fees(contracts: int | Column, commission: float, regulatory: float, fixed: float = 0.0) -> float | Column:
    """Fees of opening and closing four legs, in currency; contracts: a number or a column."""
    return 2 * (4 * contracts * (commission + regulatory) + fixed)


def realized_volatility(bars: DataFrame, keys: list[str], ts: str, close: str, least: int = 15, per_year: float = 252 * 390) -> DataFrame:
    """Annualised sample deviation of log returns between neighbouring positive closes; 0 with fewer than `least` closes."""
    fine = bars.where(F.col(close) > 0)
    r = F.log(F.col(close) / F.lag(close).over(Window.partitionBy(*keys).orderBy(ts)))
    vol = F.when(F.count("*") >= least, F.coalesce(F.stddev_samp("r"), F.lit(0.0)) * math.sqrt(per_year)).otherwise(0.0)
    return fine.withColumn("r", r).groupBy(*keys).agg(F.count("*").alias("n"), vol.alias("vol"))


def excursions(path: DataFrame, keys: list[str], ts: str, high: str, low: str, reference: str, entry: str) -> DataFrame:
    """Largest moves up and down from the entry price, floored at 0, with the first time of each extreme; the last
    reference; the number of rows."""
    up = F.greatest(F.lit(0.0), F.max(F.col(high) - F.col(entry)))
    down = F.greatest(F.lit(0.0), F.max(F.col(entry) - F.col(low)))
    return path.groupBy(*keys).agg(
        up.alias("up_max"), down.alias("down_max"), F.min_by(ts, F.struct(-F.col(high), F.col(ts))).alias("up_ts"),
        F.min_by(ts, F.struct(F.col(low), F.col(ts))).alias("down_ts"), F.max_by(reference, ts).alias("close_price"), F.count("*").alias("sample_count"),
    )


# The rational approximations of erf and erfc by W. J. Cody (1969), on |x| <= 0.46875, up to 4, and beyond.
_A = (1.85777706184603153e-1, 3.16112374387056560e0, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3)
_B = (1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3)
_C = (2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e1, 2.98635138197400131e2, 8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3)
_D = (1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3, 3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3)
_P = (1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4)
_Q = (1.0, 2.56852019228982242e0, 1.87295284992346725e0, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3)


def erf(x: np.ndarray) -> np.ndarray:
    """The error function of whole arrays."""
    x = np.asarray(x, float)
    y = np.abs(x)
    near, far = np.minimum(y, 0.46875), np.clip(y, 0.46875, 30)
    small = near * np.polyval(_A, near * near) / np.polyval(_B, near * near)
    middle = np.polyval(_C, np.minimum(far, 4)) / np.polyval(_D, np.minimum(far, 4))
    z = 1 / np.maximum(far, 4) ** 2
    tail = (1 / math.sqrt(math.pi) - z * np.polyval(_P, z) / np.polyval(_Q, z)) / np.maximum(far, 4)
    large = 1 - np.exp(-far * far) * np.where(far <= 4, middle, tail)
    return np.copysign(np.where(y <= 0.46875, small, large), x)


def _cdf(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + erf(x / math.sqrt(2)))


def black_scholes(spot, strike, tau, rate, sigma, is_call) -> np.ndarray:
    """Prices of European options; with no time or no volatility, the discounted intrinsic value."""
    spot, strike, tau, rate, sigma = (np.asarray(x, float) for x in (spot, strike, tau, rate, sigma))
    live = (tau > 0) & (sigma > 0)
    t, s = np.where(live, tau, 1.0), np.where(live, sigma, 1.0)
    root = s * np.sqrt(t)
    d1 = (np.log(spot / strike) + (rate + s * s / 2) * t) / root
    kept = strike * np.exp(-rate * np.maximum(tau, 0))
    call = np.where(live, spot * _cdf(d1) - kept * _cdf(d1 - root), np.maximum(spot - kept, 0))
    return np.where(np.asarray(is_call, bool), call, np.where(live, call - spot + kept, np.maximum(kept - spot, 0)))


def implied_volatility(price, spot, strike, tau, rate, is_call) -> np.ndarray:
    """Volatility by bisection in [VOL_LOW, VOL_HIGH]; NaN where the price isn't bracketed."""
    price = np.asarray(price, float)
    low, high = np.full(len(price), VOL_LOW), np.full(len(price), VOL_HIGH)
    value = lambda s: black_scholes(spot, strike, tau, rate, s, is_call)
    tolerance = VOL_TOLERANCE * np.maximum(1, price)
    fine = (value(low) <= price + tolerance) & (value(high) >= price - tolerance) & (np.asarray(tau, float) > 0)
    for _ in range(VOL_ROUNDS):
        mid = (low + high) / 2
        below = value(mid) < price
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return np.where(fine, (low + high) / 2, np.nan)


def with_option_price(rows: DataFrame, sigma: str, spot: str, strike: str, tau: str, is_call: str, rate: float, name: str = "model_price") -> DataFrame:
    """Adds the model price, in Arrow batches."""

    @F.pandas_udf("double")
    def price(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for v, s, k, t, c in batches:
            yield pd.Series(black_scholes(s, k, t, rate, v, c.fillna(False)))

    return rows.withColumn(name, price(sigma, spot, strike, tau, is_call))


def with_implied_volatility(rows: DataFrame, price: str, spot: str, strike: str, tau: str, is_call: str, rate: float, name: str = "iv") -> DataFrame:
    """Adds the implied volatility, in Arrow batches (SQL has no error function); null where there is none."""

    @F.pandas_udf("double")
    def solve(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for p, s, k, t, c in batches:
            iv = pd.Series(implied_volatility(p, s, k, t, rate, c.fillna(False)))
            yield iv.where(iv.notna(), None)

    return rows.withColumn(name, solve(price, spot, strike, tau, is_call))
