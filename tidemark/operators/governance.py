"""Model governance over append-only tables: champions, frozen sessions, and the checks of promotions and rollbacks. What is appended when
these hold is sources.governance_log's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import asof, rules


def champions(events: DataFrame) -> DataFrame:
    """(model_id, version): the target of each model's last promotion or rollback. events: model_id, seq, target_version."""
    return asof.latest_per_key(events, ["model_id"], ["seq"], ["target_version"]).withColumnRenamed("target_version", "version")


def session_champions(requests: DataFrame, freezes: DataFrame, current: DataFrame) -> DataFrame:
    """Each request (model_id, session_id) with the version it gets: what its session was frozen to first, else the current
    champion. freezes: model_id, session_id, seq, version."""
    first = freezes.groupBy("model_id", "session_id").agg(F.min_by("version", "seq").alias("__frozen"))
    rows = requests.join(first, ["model_id", "session_id"], "left").join(current.withColumnRenamed("version", "__current"), "model_id", "left")
    return rows.withColumn("version", F.coalesce("__frozen", "__current")).withColumn("frozen", F.col("__frozen").isNotNull()).drop("__frozen", "__current")


def registration_faults(versions: DataFrame) -> DataFrame:
    """Each registration (model_id, version, parent_version, seq) with what forbids it: a version registered before, or a parent
    that wasn't."""
    first = versions.groupBy("model_id", "version").agg(F.min("seq").alias("__first"))
    parents = first.select("model_id", F.col("version").alias("parent_version"), F.col("__first").alias("__parent"))
    rows = versions.join(first, ["model_id", "version"]).join(parents, ["model_id", "parent_version"], "left")
    fault = F.when(F.col("seq") > F.col("__first"), "ALREADY_REGISTERED").when(F.col("parent_version").isNotNull() & (F.col("__parent").isNull() | (F.col("__parent") >= F.col("seq"))), "UNKNOWN_PARENT")
    return rows.withColumn("fault", fault).drop("__first", "__parent")


def approval_faults(approvals: DataFrame, versions: DataFrame, current: DataFrame, used: DataFrame) -> DataFrame:
    """Each approval (approval_id, action, model_id, source_version, target_version, evidence_hash, approved_at) with the
    reasons against it, judged by the champion it would replace. versions: model_id, version, parent_version,
    validation_report_hash, trained_at; used: approval_id."""
    v = versions.select("model_id", F.col("version").alias("target_version"), "parent_version", "validation_report_hash", "trained_at", F.lit(True).alias("__known"))
    rows = approvals.join(v, ["model_id", "target_version"], "left").join(current.select("model_id", F.col("version").alias("__current")), "model_id", "left")
    rows = rows.join(used.select("approval_id", F.lit(True).alias("__used")).distinct(), "approval_id", "left")
    col, up = F.col, F.col("action") == "PROMOTE"
    known = col("__known").isNotNull()
    report = col("validation_report_hash").isNotNull()
    why = rules.reasons([
        (~known, "UNKNOWN_VERSION"), (col("__used").isNotNull(), "APPROVAL_USED"), (~col("source_version").eqNullSafe(col("__current")), "SOURCE_IS_NOT_THE_CHAMPION"),
        (known & up & ~report, "NO_VALIDATION_REPORT"), (known & up & report & ~col("evidence_hash").eqNullSafe(col("validation_report_hash")), "EVIDENCE_MISMATCH"),
        (known & up & (col("approved_at") < col("trained_at")), "APPROVED_BEFORE_TRAINED"), (known & up & col("__current").isNotNull() & ~col("parent_version").eqNullSafe(col("__current")), "NOT_A_DESCENDANT"),
        (~up & col("__current").isNull(), "NO_CHAMPION"), (~up & F.coalesce(col("target_version") == col("__current"), F.lit(False)), "ALREADY_THE_CHAMPION"),
    ])
    return rows.withColumn("reasons", why).drop("__known", "__used", "__current")


def overview(scenarios: DataFrame, alerts: DataFrame) -> DataFrame:
    """One row: scenarios, those that aren't cleared, alerts, and open ones."""
    a = scenarios.agg(F.count("*").alias("n_scenarios"), F.count_if(F.col("state") != "CLEARED").alias("n_not_cleared"))
    b = alerts.agg(F.count("*").alias("n_alerts"), F.count_if(F.col("status") == "OPEN").alias("n_open"))
    return a.crossJoin(b)  # one row each
