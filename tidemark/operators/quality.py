"""Quality of quotes: rules of one observation, the status of an instrument over its sources, and validation of days."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import asof, rules

#: Events after which a provider's earlier observations no longer count.
CLEARING = ("CONNECTION_LOST", "RATE_LIMITED", "STOP")


@dataclass(frozen=True)
class QualityPolicy:
    """Ages and latency in seconds. required: columns that must have a value and a time (`<column>_ts`)."""

    green_max_age: float
    amber_max_age: float
    max_receive_latency: float
    conflict_absolute: float
    conflict_relative: float = 0.0
    two_sources: bool = True
    required: tuple[str, ...] = ("bid", "ask", "bid_size", "ask_size")

    def __post_init__(self) -> None:
        if not 0 <= self.green_max_age <= self.amber_max_age:
            raise ValueError("need 0 <= green_max_age <= amber_max_age")
        if min(self.max_receive_latency, self.conflict_absolute, self.conflict_relative) < 0:
            raise ValueError("latency and tolerances must not be negative")


def seconds(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 1e6


def _holds(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def observation_reasons(as_of: Column, policy: QualityPolicy) -> Column:
    """What is wrong with one observation (source, entitlement, delayed, source_ts, received_ts, bid, ask, bid_size, ask_size
    and the times <field>_ts), as an array of `SOURCE:CODE`. Missing times of the observation itself fail closed."""
    code = lambda *parts: F.concat_ws(":", F.col("source"), *(F.lit(p) for p in parts))
    received, source = F.col("received_ts"), F.col("source_ts")
    entitled = F.coalesce(F.col("entitlement"), F.lit("UNKNOWN"))
    found: list[tuple[Column, Column]] = [
        (entitled != "VERIFIED", F.concat(F.col("source"), F.lit(":ENTITLEMENT_"), entitled)),
        (F.col("delayed").isNull(), code("DELAY_STATUS_UNKNOWN")),
        (_holds(F.col("delayed")), code("DELAYED")),
        (received.isNull() | source.isNull(), code("MISSING_TIMES")),
        (_holds(received < source), code("RECEIVED_BEFORE_SOURCE")),
        (_holds(seconds(received, source) > policy.max_receive_latency), code("RECEIVE_LATENCY_EXCEEDED")),
    ]
    for name in policy.required:
        at, upper = F.col(f"{name}_ts"), name.upper()
        found += [
            (F.col(name).isNull(), code(f"MISSING_{upper}")),
            (at.isNull(), code(f"MISSING_{upper}_TIMESTAMP")),
            (_holds(at > received), code(f"{upper}_AFTER_RECEIPT")),
            (_holds(at > as_of), code(name, "FUTURE_TIMESTAMP")),
            (_holds(seconds(as_of, at) > policy.amber_max_age), code(f"{upper}_STALE")),
        ]
    found += [(_holds(F.col(c) > as_of), code(c, "FUTURE_TIMESTAMP")) for c in ("source_ts", "received_ts")]
    oldest = F.greatest(seconds(as_of, source), seconds(as_of, received))
    values = ("bid", "ask", "bid_size", "ask_size")
    found += [
        (_holds(oldest > policy.amber_max_age), code("OBSERVATION_STALE")),
        (F.greatest(*(_holds(F.col(v) < 0) for v in values)), code("NEGATIVE_QUOTE_VALUE")),
        (_holds(F.col("bid_size") == 0) | _holds(F.col("ask_size") == 0), code("EMPTY_QUOTE_SIZE")),
        (_holds(F.col("bid") > F.col("ask")), code("CROSSED_QUOTE")),
    ]
    return rules.reasons(found)


def stale_fields(as_of: Column, policy: QualityPolicy) -> Column:
    old = lambda name: _holds(seconds(as_of, F.col(f"{name}_ts")) > policy.green_max_age)
    return F.array_compact(F.array(*(F.when(old(n), F.concat(F.col("source"), F.lit(f":{n}"))) for n in policy.required)))


def evaluate_quotes(observations: DataFrame, keys: list[str], as_of: Column, policy: QualityPolicy, expected: DataFrame | None = None) -> DataFrame:
    """Per key (of an instrument): status GREEN, AMBER or RED, freeze, sorted reasons, stale fields and sources.

    Any reason is RED; ages above green are AMBER. Sources that disagree by more than the tolerance are a conflict, which
    freezes. `expected` (keys) adds instruments that nobody observed. Each observation is reduced to its arrays first, and
    equal arrays meet once, so that a hot key aggregates map-side to as many rows as it has kinds of trouble.
    """
    mid = (F.col("bid") + F.col("ask")) / 2
    ages = [seconds(as_of, F.col(c)) for c in ("source_ts", "received_ts", *(f"{n}_ts" for n in policy.required))]
    rows = observations.select(
        *keys, "source", "instrument_id", observation_reasons(as_of, policy).alias("r"), stale_fields(as_of, policy).alias("s"), mid.alias("mid"),
        _holds(F.greatest(*ages) > policy.green_max_age).alias("old"),
    )
    found = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.array_sort(F.collect_set("source")).alias("sources"), F.min("instrument_id").alias("i0"), F.max("instrument_id").alias("i1"),
        F.flatten(F.collect_set("r")).alias("r"), F.flatten(F.collect_set("s")).alias("s"), F.bool_or("old").alias("old"),
        F.bool_and(F.col("mid").isNotNull()).alias("whole"), F.min("mid").alias("low"), F.max("mid").alias("high"),
    )
    if expected is not None:
        found = expected.select(*keys).distinct().join(found, keys, "left")
    n, n_sources = F.coalesce("n", F.lit(0)), F.coalesce(F.size("sources"), F.lit(0))
    n_sources = F.greatest(n_sources, F.lit(0))  # size of null
    allowed = F.greatest(F.lit(policy.conflict_absolute), F.abs("low") * F.lit(policy.conflict_relative))
    conflict = _holds((n >= 2) & F.col("whole") & (F.col("high") - F.col("low") > allowed))
    own = rules.reasons([
        (n == 0, "NO_SOURCES"), (n_sources != n, "DUPLICATE_SOURCE"), (F.lit(policy.two_sources) & (n_sources < 2), "SECOND_SOURCE_MISSING"),
        (_holds(F.col("i0") != F.col("i1")), "INSTRUMENT_MISMATCH"), (conflict, "DUAL_SOURCE_CONFLICT"),
    ])
    none = F.array().cast("array<string>")
    every = F.array_sort(F.array_distinct(F.concat(own, F.coalesce("r", none))))
    status = F.when(F.size(every) > 0, "RED").when(_holds(F.col("old")), "AMBER").otherwise("GREEN")
    return found.select(
        *keys, status.alias("status"), (conflict | (F.size(every) > 0)).alias("freeze"), every.alias("reasons"),
        F.array_sort(F.array_distinct(F.coalesce("s", none))).alias("stale_fields"), F.coalesce("sources", none).alias("sources"),
    )


def quality_snapshot(events: DataFrame, keys: list[str], seq: str, kind: str = "kind") -> DataFrame:
    """The observations that count for a quality report: of each key, every source's latest quote after the key's last
    clearing event (a lost connection, a rate limit, a stop)."""
    cleared = events.where(F.col(kind).isin(*CLEARING)).groupBy(*keys).agg(F.max(seq).alias("__cleared"))
    quotes = events.where(F.col(kind) == "QUOTE").join(cleared, keys, "left").where(F.col("__cleared").isNull() | (F.col(seq) > F.col("__cleared"))).drop("__cleared")
    return asof.latest_per_key(quotes, [*keys, "source"], [seq], [c for c in events.columns if c not in (*keys, "source", kind)])


#: What can be wrong with a capability.
CAPABILITY_CODES = ("CAPABILITY_NOT_CONFIGURED", "CAPABILITY_UNVERIFIED", "CAPABILITY_NOT_PRODUCTION_READY", "CAPABILITY_QUALITY_NOT_GREEN")


def capability_reasons() -> Column:
    """Of a provider's capability (configured, verification_status, production_ready, quality); null fails closed."""
    broken = (~F.col("configured"), F.col("verification_status") != "VERIFIED", ~F.col("production_ready"), F.col("quality") != "GREEN")
    return rules.reasons(list(zip(broken, CAPABILITY_CODES, strict=True)))


def bar_violations() -> Column:
    """Of a bar (open, high, low, close, volume): what breaks its envelope. Nulls fail closed."""
    low, high = F.col("low"), F.col("high")
    return rules.reasons([
        (low > high, "LOW_ABOVE_HIGH"), (~F.col("open").between(low, high), "OPEN_OUTSIDE"), (~F.col("close").between(low, high), "CLOSE_OUTSIDE"),
        (F.col("volume") < 0, "NEGATIVE_VOLUME"), (F.least("open", "high", "low", "close") <= 0, "PRICE_NOT_POSITIVE"),
    ])


def quote_violations() -> Column:
    """Of a quote (symbol, bid, ask, bid_size, ask_size): prices may be null, sizes may not; symbols have 21 characters."""
    return rules.reasons([
        (F.length("symbol") != 21, "SYMBOL_NOT_PADDED"), (_holds(F.col("bid") < 0) | _holds(F.col("ask") < 0), "NEGATIVE_PRICE"),
        (_holds(F.col("bid") > F.col("ask")), "CROSSED"), ((F.col("bid_size") < 0) | (F.col("ask_size") < 0), "NEGATIVE_SIZE"),
    ])


def day_violations(bars: DataFrame, quotes: DataFrame, days: DataFrame, day: str = "day", order: str | None = None) -> DataFrame:
    """Per expected day, whether it makes a chain day: bars and quotes are there, and none breaks a rule of its own. order: a
    column of both that says in which order rows came; by it, times (ts) may not step back."""
    side = lambda rows, why, n: rows.groupBy(day).agg(F.count("*").alias(n), F.sum(F.least(F.size(why), F.lit(1))).alias(f"{n}_bad"))
    found = days.select(day).distinct().join(side(bars, bar_violations(), "n_bars"), day, "left").join(side(quotes, quote_violations(), "n_quotes"), day, "left")
    names = ["n_bars", "n_bars_bad", "n_quotes", "n_quotes_bad"]
    if order is not None:
        for rows, n in ((bars, "n_bars"), (quotes, "n_quotes")):
            back = asof.order_violations(rows, [day], order, "ts").select(day, F.col("n_decreasing").alias(f"{n}_back"))
            found = found.join(back, day, "left")
            names.append(f"{n}_back")
    found = found.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in names})
    broken = [(F.col("n_bars") == 0, "NO_BARS"), (F.col("n_quotes") == 0, "NO_QUOTES"), (F.col("n_bars_bad") > 0, "BAD_BARS"), (F.col("n_quotes_bad") > 0, "BAD_QUOTES")]
    if order is not None:
        broken += [(F.col("n_bars_back") > 0, "BARS_OUT_OF_ORDER"), (F.col("n_quotes_back") > 0, "QUOTES_OUT_OF_ORDER")]
    why = rules.reasons(broken)
    return found.withColumn("reasons", why)


def beside_center(rows: DataFrame, center: Column, band: float | None = 0.03) -> DataFrame:
    """Options used on their own side (calls at and above the centre, puts below), strikes within the band, both ends included;
    without a band any strike."""
    own = rows.where(F.col("is_call") == (F.col("strike") >= center))
    return own if band is None else own.where(F.col("strike").between(center * (1 - band), center * (1 + band)))
