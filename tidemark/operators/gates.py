"""Gates of decisions, promotions, readiness and reviews: every rule set as a reason array over a table's columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import rules

#: Checkpoints of an event by name and seconds from its scheduled (else first seen) time. Fixed values.
CHECKPOINTS = (("T-30m", -1800), ("T-5m", -300), ("T+30s", 30), ("T+2m", 120), ("T+5m", 300), ("T+15m", 900), ("T+30m", 1800), ("T+60m", 3600))
TERMINAL_REVIEWS = ("CONFIRMED", "REJECTED", "INCONCLUSIVE")
CONTINUOUS_ALIASES = ("ES", "/ES", "ESMAIN", "ES-MAIN", "ES1!", "ES.C.0")


def _holds(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _blank(c: str | Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def risk_gate(data_quality: str = "data_quality") -> Column:
    """The nine gates of a decision, in their order, over the columns contract_matches, event_cleared, unscheduled_shock,
    option_chain_usable, tail_expanding, next_event_in_holding, edge_ok, risk_budget_ok. A null fails closed."""
    col = F.col
    return rules.reasons([
        (col(data_quality) != "GREEN", "STALE_MARKET_DATA"), (~col("contract_matches"), "CONTRACT_MISMATCH"), (~col("event_cleared"), "EVENT_PENDING"),
        (col("unscheduled_shock"), "UNSCHEDULED_SHOCK"), (~col("option_chain_usable"), "OPTION_CHAIN_UNUSABLE"), (col("tail_expanding"), "TAIL_EXPANDING"),
        (col("next_event_in_holding"), "NEXT_EVENT_TOO_CLOSE"), (~col("edge_ok"), "NEGATIVE_EDGE"), (~col("risk_budget_ok"), "RISK_BUDGET_EXCEEDED"),
    ])


def decide(rows: DataFrame, output: Column, required_model: Column | None = None, loaded_model: Column | None = None) -> DataFrame:
    """rows with reasons, action and output: NO_TRADE with any reason (a model of another identity is one), else WAIT with
    the model's output. There is no other action."""
    why = risk_gate()
    if required_model is not None and loaded_model is not None:
        other = F.when(required_model.isNotNull() & ~required_model.eqNullSafe(loaded_model), F.lit("MODEL_VERSION_NOT_LOADED"))
        why = F.concat(why, F.array_compact(F.array(other)))
    rows = rows.withColumn("reasons", why)
    return rows.withColumn("action", rules.decision(F.col("reasons"))).withColumn("output", F.when(F.size("reasons") == 0, output))


@dataclass(frozen=True)
class PromotionCriteria:
    """Thresholds registered before the holdout was frozen; the same for every required slice (event_type, regime)."""

    min_samples: int
    max_cross_rate: float
    max_touch_rate: float
    max_cvar: float
    max_drawdown: float
    min_effect: float

    def __post_init__(self) -> None:
        if self.min_samples <= 0:
            raise ValueError("min_samples must be positive")
        if not (0 <= self.max_cross_rate <= 1 and 0 <= self.max_touch_rate <= 1):
            raise ValueError("rates must lie in [0, 1]")
        if self.max_cvar < 0 or self.max_drawdown < 0:
            raise ValueError("cvar and drawdown must not be negative")


def promotion_gate(required: DataFrame, evidence: DataFrame, criteria: PromotionCriteria) -> DataFrame:
    """Each required slice with its evidence (sample_count, expiry_cross_rate, touch_rate, cvar, maximum_drawdown,
    no_trade_pnl_difference), failures and whether it passed. A missing slice, and a missing figure, fails."""
    rows = required.select("event_type", "regime").distinct().join(evidence.withColumn("__seen", F.lit(True)), ["event_type", "regime"], "left")
    seen = F.col("__seen").isNotNull()
    broken = lambda c: seen & F.coalesce(c, F.lit(True))
    why = rules.reasons([
        (~seen, "MISSING_SLICE"),
        (broken(F.col("sample_count") < criteria.min_samples), "INSUFFICIENT_SAMPLES"),
        (broken(F.col("expiry_cross_rate") > criteria.max_cross_rate), "EXPIRY_CROSS_EXCEEDED"),
        (broken(F.col("touch_rate") > criteria.max_touch_rate), "TOUCH_RATE_EXCEEDED"),
        (broken(F.col("cvar") > criteria.max_cvar), "CVAR_EXCEEDED"),
        (broken(F.col("maximum_drawdown") > criteria.max_drawdown), "DRAWDOWN_EXCEEDED"),
        (broken(F.col("no_trade_pnl_difference") < criteria.min_effect), "NO_TRADE_EFFECT_BELOW_MINIMUM"),
    ])
    return rows.withColumn("failures", why).drop("__seen").withColumn("passed", F.size("failures") == 0)


def readiness(required: DataFrame, evidence: DataFrame, keys: list[str], now: Column, generated_at: Column | None = None) -> DataFrame:
    """Each required evidence (keys) with its blocker, null if it is verified and not expired. evidence: keys, status,
    expires_at. A manifest from the future blocks everything."""
    rows = required.join(evidence, keys, "left")
    state = F.when(F.lit(False) if generated_at is None else generated_at > now, "MANIFEST_GENERATED_IN_FUTURE").when(F.col("status").isNull(), "EVIDENCE_MISSING")
    state = state.when(F.col("status") != "VERIFIED", F.concat(F.lit("EVIDENCE_"), F.col("status")))
    return rows.withColumn("blocker", state.when(F.col("expires_at").isNull() | (F.col("expires_at") <= now), "EVIDENCE_EXPIRED"))


def shadow_evidence(sessions: DataFrame, keys: list[str], generated_at: Column, now: Column, code_version: Column, min_sessions: int = 5, min_dates: int = 3) -> DataFrame:
    """Per key: recorded and qualifying sessions, their dates, drills seen, and blockers in order.

    A session qualifies if it ran wholly between generated_at and now, with the expected code, a passed audit, an explicit
    contract, capability reports and at least one decision.
    """
    window = (F.col("started_at") < generated_at) | (F.col("ended_at") > now)
    other = F.coalesce(F.col("code_version") != code_version, code_version.isNotNull())
    fine = ~window & ~other & F.col("audit_passed") & F.col("contract").isNotNull() & (F.col("n_capability_reports") > 0) & (F.col("n_decisions") > 0)
    rows = sessions.withColumns({"__w": _holds(window), "__o": other, "__q": _holds(fine)})
    of = lambda c: F.coalesce(F.bool_or(F.col("__q") & _holds(F.col(c))), F.lit(False))
    found = rows.groupBy(*keys).agg(
        F.count("*").alias("recorded"), F.count_if("__q").alias("qualifying"), F.count_distinct(F.when(F.col("__q"), F.col("trading_date"))).alias("dates"),
        F.count_if("__w").alias("rejected_window"), F.count_if("__o").alias("other_code"), of("degradation_drill").alias("degradation"), of("recovery_drill").alias("recovery"),
    )
    why = rules.reasons([
        (F.col("rejected_window") > 0, "SESSION_TIME_WINDOW"), (F.col("other_code") > 0, "CODE_VERSION_MISMATCH"), (F.col("qualifying") < min_sessions, "SHADOW_SESSION_COUNT"),
        (F.col("dates") < min_dates, "SHADOW_TRADING_DATE_COUNT"), (~F.col("degradation"), "SOURCE_DEGRADATION_DRILL"), (~F.col("recovery"), "RECOVERY_DRILL"),
    ])
    return found.withColumn("blockers", why)


def timeline_violations() -> Column:
    """What contradicts itself in an event's times (source_published_at, first_seen_at, confirmed_at, cross_asset_confirmed,
    cross_asset_confirmed_at, stable_since, session_close_at, next_cash_open_at)."""
    t = F.col
    floor = F.coalesce(t("cross_asset_confirmed_at"), t("confirmed_at"), t("first_seen_at"))
    return rules.reasons([
        (t("source_published_at") > t("first_seen_at"), "PUBLISHED_AFTER_SEEN"), (_holds(t("confirmed_at") < t("first_seen_at")), "CONFIRMED_BEFORE_SEEN"),
        (t("cross_asset_confirmed") != t("cross_asset_confirmed_at").isNotNull(), "CROSS_ASSET_DISAGREES"),
        (_holds(t("cross_asset_confirmed_at") < t("first_seen_at")), "CROSS_ASSET_BEFORE_SEEN"), (_holds(t("cross_asset_confirmed_at") < t("confirmed_at")), "CROSS_ASSET_BEFORE_CONFIRMED"),
        (_holds(t("stable_since") < floor), "STABLE_BEFORE_CONFIRMED"), (_holds(t("next_cash_open_at") <= t("session_close_at")), "OPEN_NOT_AFTER_CLOSE"),
    ])


def risk_lock(as_of: Column, min_sources: int = 2, min_stable: int = 3, stability_seconds: int = 120) -> Column:
    """struct(state, reasons, rerun_at, next_checkpoint) of an event at as_of: LOCKED while evidence is missing, STABILIZING
    until it has been stable long enough, then CLEARED; NOT_VISIBLE before it was first seen."""
    t = F.col
    later = lambda c: c.isNull() | (c > as_of)
    locked = rules.reasons([
        (t("contradictory_evidence"), "CONTRADICTORY_EVIDENCE"), (later(t("confirmed_at")), "EVENT_NOT_CONFIRMED"),
        (t("corroborating_sources") < min_sources, "INSUFFICIENT_CORROBORATION"),
        (~t("cross_asset_confirmed") | later(t("cross_asset_confirmed_at")), "CROSS_ASSET_NOT_CONFIRMED"),
    ])
    until = t("stable_since") + F.expr(f"INTERVAL {int(stability_seconds)} SECONDS")
    unstable = rules.reasons([
        (later(t("stable_since")), "STABILITY_WINDOW_NOT_STARTED"), (~later(t("stable_since")) & (until > as_of), "STABILITY_WINDOW_INCOMPLETE"),
        (t("stable_observations") < min_stable, "INSUFFICIENT_STABLE_OBSERVATIONS"),
    ])
    state = F.when(later(t("first_seen_at")), "NOT_VISIBLE").when(F.size(locked) > 0, "LOCKED").when(F.size(unstable) > 0, "STABILIZING").otherwise("CLEARED")
    why = F.when(state == "LOCKED", locked).when(state == "STABILIZING", unstable).when(state == "CLEARED", F.array(F.lit("EVENT_STABLE"))).otherwise(F.array().cast("array<string>"))
    anchor = F.coalesce(t("scheduled_at"), t("first_seen_at"))
    points = [F.struct((anchor + F.expr(f"INTERVAL {s} SECONDS")).alias("at"), F.lit(n).alias("name")) for n, s in CHECKPOINTS]
    points += [F.struct(t(c).alias("at"), F.lit(n).alias("name")) for c, n in (("session_close_at", "SESSION_CLOSE"), ("next_cash_open_at", "NEXT_CASH_OPEN"))]
    ahead = F.array_min(F.filter(F.array(*points), lambda p: p["at"] > as_of))
    done = F.when(t("next_cash_open_at").isNotNull(), "MONITORING_COMPLETE").otherwise("SESSION_BOUNDARY_UNCONFIGURED")
    return F.struct(
        state.alias("state"), why.alias("reasons"), F.when(state == "STABILIZING", until).alias("rerun_at"), F.coalesce(ahead["name"], done).alias("next_checkpoint")
    )


def candidate_violations(universe: Column, inferred_kinds: tuple[str, ...]) -> Column:
    """Of a detector's candidate (as_of, next_checkpoint, confidence, target, evidence, invalidation_conditions,
    data_manifest_id, kind, estimate_method)."""
    blank_list = lambda c: (F.coalesce(F.size(c), F.lit(0)) <= 0) | F.exists(c, lambda x: _blank(x))
    return rules.reasons([
        (F.col("next_checkpoint") <= F.col("as_of"), "CHECKPOINT_NOT_AHEAD"), (~F.col("confidence").between(0, 1), "CONFIDENCE_OUT_OF_RANGE"), (_blank("target"), "BLANK_TARGET"),
        (~_blank("target") & ~_holds(F.array_contains(universe, F.trim("target"))), "OUTSIDE_UNIVERSE"), (blank_list(F.col("evidence")), "NO_EVIDENCE"),
        (blank_list(F.col("invalidation_conditions")), "NO_INVALIDATION"), (_blank("data_manifest_id"), "NO_MANIFEST"),
        (F.col("kind").isin(*inferred_kinds) & _blank("estimate_method"), "NO_ESTIMATE_METHOD"),
    ])


def candidate_id() -> Column:
    """A candidate's identity: the hash of what it claims, whatever the order of its evidence."""
    parts = F.struct("detector_id", "detector_version", "kind", "target", "direction", "as_of", "confidence", F.array_sort("evidence").alias("evidence"), "data_manifest_id", "estimate_method")
    return F.concat(F.lit("sha256:"), F.sha2(F.to_json(parts, {"ignoreNullFields": "false"}), 256))


def signal_violations() -> Column:
    """Of an attribution signal (kind, severity, snapshot_id, replay_manifest_hash, first_seen_at, market_reaction_start_at,
    observed_as_of; candidates: array of (cause_id, first_seen_at, ...); observations: array of (observed_at, ...))."""
    t, now = F.col, F.col("observed_as_of")
    causes = F.transform("candidates", lambda c: c["cause_id"])
    return rules.reasons([
        ((t("kind") == "MAJOR_EVENT") & ~t("severity").isin("P0", "P1"), "MAJOR_EVENT_SEVERITY"), (~t("snapshot_id").startswith("sha256:"), "SNAPSHOT_ID"),
        (~t("replay_manifest_hash").startswith("sha256:"), "MANIFEST_HASH"), (t("first_seen_at") > now, "SEEN_IN_FUTURE"), (t("market_reaction_start_at") > now, "REACTION_IN_FUTURE"),
        (F.exists("candidates", lambda c: c["first_seen_at"] > now), "FUTURE_CANDIDATE"), (F.exists("observations", lambda o: o["observed_at"] > now), "FUTURE_OBSERVATION"),
        (F.size(F.array_distinct(causes)) != F.size(causes), "REPEATED_CAUSE"),
    ])


def attribution(coherent: Column, n_observations: Column, best_confidence: Column, lag_seconds: Column) -> Column:
    """struct(coherence, confidence, timing) of a signal: the best candidate's confidence damped by how far the observed
    assets agree; a reaction before the signal stays visible as such."""
    coherence = F.when(n_observations == 0, "UNKNOWN").when(coherent == n_observations, "COHERENT").when(coherent == 0, "DIVERGENT").otherwise("MIXED")
    factor = F.when(coherence == "COHERENT", 1.0).when(coherence == "MIXED", 0.85).when(coherence == "DIVERGENT", 0.6).otherwise(0.75)
    timing = F.when(lag_seconds < 0, "MARKET_PRECEDED_SIGNAL").when(lag_seconds > 0, "SIGNAL_PRECEDED_MARKET").when(lag_seconds == 0, "SIMULTANEOUS")
    return F.struct(coherence.alias("coherence"), F.round(F.coalesce(best_confidence * factor, F.lit(0.0)), 4).alias("confidence"), timing.alias("timing"))


def outcome_request_violations(requests: DataFrame, observations: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """Each label request (key, cutoff, intraday_end, expiry, reference, lower, upper) with what forbids it; observations:
    key, seq, observed_at."""
    w = Window.partitionBy(key).orderBy(seq)
    o = observations.withColumn("__back", F.col("observed_at") <= F.lag("observed_at").over(w))
    o = o.groupBy(key).agg(F.min("observed_at").alias("__first"), F.max("observed_at").alias("__last"), F.max_by("observed_at", seq).alias("__end"), F.bool_or(_holds(F.col("__back"))).alias("__back"))
    t = F.col
    none = t("__first").isNull()
    why = rules.reasons([
        (~((t("cutoff") < t("intraday_end")) & (t("intraday_end") <= t("expiry"))), "WINDOW_ORDER"),
        (~((t("lower") > 0) & (t("lower") < t("reference")) & (t("reference") < t("upper"))), "LEVEL_ORDER"), (none, "NO_OBSERVATIONS"),
        (~none & (t("__first") <= t("cutoff")), "NOT_AFTER_CUTOFF"), (~none & (t("__last") > t("expiry")), "AFTER_EXPIRY"), (~none & t("__back"), "NOT_ORDERED"),
        (~none & (t("__end") != t("expiry")), "NOT_AT_EXPIRY"), (~none & (t("__first") > t("intraday_end")), "NO_INTRADAY"),
    ])
    return requests.join(o, key, "left").withColumn("violations", why).drop("__first", "__last", "__end", "__back")


def review_transitions(reviews: DataFrame, key: str, seq: str, status: str, opened: str = "OPEN") -> DataFrame:
    """Each requested review status with whether it is allowed, judged by the accepted ones before it: nothing returns to
    OPEN, and the first terminal status ends the review."""
    w = Window.partitionBy(key).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    ended = F.coalesce(F.bool_or(F.col(status).isin(*TERMINAL_REVIEWS)).over(w), F.lit(False))
    why = F.when(F.col(status) == opened, "RETURNS_TO_OPEN").when(ended, "REVIEW_IS_TERMINAL")
    return reviews.withColumn("refusal", why)


def contract_violations(symbol: str = "symbol", expiry: str = "expiry") -> Column:
    """Of a quarterly futures symbol with its expiry: aliases of a continuous contract, other forms, and symbols whose month
    or year isn't that of the expiry are refused."""
    s = F.upper(F.trim(symbol))
    alias = s.isin(*CONTINUOUS_ALIASES) | s.contains("MAIN")
    fine = s.rlike(r"^ES[HMUZ][0-9]{1,4}$")
    month = F.element_at(F.create_map(*(F.lit(x) for x in ("H", 3, "M", 6, "U", 9, "Z", 12))), F.substring(s, 3, 1))
    year = F.substring(s, 4, 4)
    return rules.reasons([
        (alias, "CONTINUOUS_CONTRACT"), (~alias & ~fine, "NOT_EXPLICIT"), (_holds(fine) & (F.month(expiry) != month), "MONTH_MISMATCH"),
        (_holds(fine) & ~F.year(expiry).cast("string").endswith(year), "YEAR_MISMATCH"),
    ])


def is_identifier(c: Column, longest: int = 128) -> Column:
    """A bounded identifier: letters, digits and . _ : / - after a letter or digit."""
    return _holds(c.rlike(rf"^[A-Za-z0-9][A-Za-z0-9._:/-]{{0,{longest - 1}}}$"))


def request_violations() -> Column:
    """Of a decision request (mode, has_gates, has_values, as_of): a LIVE one may not bring gates, values or a time of its own;
    a SCENARIO must bring its time."""
    live = F.col("mode") == "LIVE"
    return rules.reasons([
        (~F.col("mode").isin("LIVE", "SCENARIO"), "UNKNOWN_MODE"), (live & F.col("has_gates"), "LIVE_WITH_GATES"), (live & F.col("has_values"), "LIVE_WITH_VALUES"),
        (live & F.col("as_of").isNotNull(), "LIVE_WITH_AS_OF"), ((F.col("mode") == "SCENARIO") & F.col("as_of").isNull(), "SCENARIO_WITHOUT_AS_OF"),
    ])


def replay_faults(manifest: DataFrame, records: DataFrame, visible: DataFrame, as_of: Column) -> DataFrame:
    """Why a manifest (record_id, logical_key, content_hash) can't be replayed, one row a fault: records that are missing,
    from the future, or of another content or key; entries that aren't the visible revision; visible keys left out.
    records, visible: record_id, logical_key, content_hash, first_seen_at."""
    r = records.select("record_id", F.col("logical_key").alias("__key"), F.col("content_hash").alias("__hash"), F.col("first_seen_at").alias("__seen"))
    v = visible.select(F.col("logical_key"), F.col("record_id").alias("__visible"))
    rows = manifest.join(r, "record_id", "left").join(v, "logical_key", "full")
    fault = rules.first_of([
        (F.col("record_id").isNull(), "LEFT_OUT"), (F.col("__seen").isNull(), "RECORD_MISSING"), (F.col("__seen") > as_of, "FUTURE_RECORD"), (F.col("__hash") != F.col("content_hash"), "CONTENT_MISMATCH"),
        (F.col("__key") != F.col("logical_key"), "KEY_MISMATCH"), (~F.col("record_id").eqNullSafe(F.col("__visible")), "NOT_VISIBLE_REVISION"),
    ], "OK")
    return rows.select("logical_key", "record_id", fault.alias("fault")).where("fault <> 'OK'")


def shared_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(column, value) found on both sides, for every one of the keys: empty where two samples are disjoint."""
    parts = [left.select(F.col(k).cast("string").alias("value")).distinct().intersect(right.select(F.col(k).cast("string").alias("value"))).select(F.lit(k).alias("column"), "value") for k in keys]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
