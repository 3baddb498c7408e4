"""The run of an approved plan: planned pulls are downloaded, landed sealed, and recorded; every pull has an outcome, and every run a report."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import seal
from tidemark.operators import rules
from tidemark.operators.calendar import new_york_instant
from tidemark.session import cut
from tidemark.sources import ledgers, records
from tidemark.sources.log import Log

#: The last second of a New York day, from which its data counts as published.
_CLOSE = 24 * 3600 - 1
CONTENT = ["dataset", "schema", "day", "scope", "object_key", "plaintext_sha256", "record_count", "estimated_usd"]


def run_plan(
    spark: SparkSession, items: DataFrame, download: Callable[[DataFrame], DataFrame], path: str, key: Column, plan_id: str, now: datetime, provider: str, provider_version: str
) -> DataFrame:
    """items of a plan (logical_key, dataset, schema, scope, day, outcome, cost) -> (logical_key, outcome, detail): LANDED with its record's id,
    SKIPPED_PRESENT, NOT_DUE, GAP with what failed; items that weren't PLANNED keep their outcome.

    download: pulls (logical_key, dataset, schema, scope, day) -> (logical_key, payload, record_count, failure), at most one row a pull; a pull
    without a row, or with neither payload nor failure, is a GAP. It is asked once for what is due and not recorded, and its answer is written to the
    shared folder. Batches, records and reports are logs under `path`: a run that was broken off is finished by running the plan again.
    """
    at = F.lit(now).cast("timestamp")
    known = records.load(spark, f"{path}/records").select("logical_key", F.col("record_id").alias("__present"))
    rows = items.dropDuplicates(["logical_key"]).withColumn("published_at", new_york_instant(F.col("day"), _CLOSE)).join(known, "logical_key", "left")
    state = rules.first_of([(F.col("outcome") != "PLANNED", "x"), (F.col("__present").isNotNull(), "SKIPPED_PRESENT"), (F.col("published_at") > at, "NOT_DUE")], "DUE")
    rows = cut(rows.withColumn("state", F.when(F.col("outcome") != "PLANNED", F.col("outcome")).otherwise(state)))
    pulls = rows.where("state = 'DUE'").select("logical_key", "dataset", "schema", "scope", "day")
    answers = cut(download(pulls).select("logical_key", "payload", "record_count", "failure"), "zstd")
    got = answers.where("payload IS NOT NULL AND failure IS NULL").join(rows.where("state = 'DUE'"), "logical_key")
    batches = got.select(F.lit(provider).alias("provider"), "dataset", "logical_key", at.alias("first_seen_at"), "payload")
    ledgers.land(spark, batches, f"{path}/batches", key, seal)
    landed = Log(spark, f"{path}/batches").read()
    if landed is not None:
        # A batch that an earlier, broken run has landed counts as this run's: of several the first.
        first = landed.groupBy("logical_key").agg(F.min(F.struct("first_seen_at", "landing_id", "payload_sha256")).alias("b")).select("logical_key", "b.*")
        made = got.drop("payload").join(first, "logical_key").select(
            "logical_key", "published_at", "first_seen_at", F.lit(provider).alias("provider"), F.lit(provider_version).alias("provider_version"), F.col("schema").alias("schema_version"),
            "dataset", "schema", F.col("day").cast("date").alias("day"), "scope", F.col("landing_id").alias("object_key"), F.col("payload_sha256").alias("plaintext_sha256"), F.col("record_count").cast("long").alias("record_count"), F.col("cost").cast("double").alias("estimated_usd"),
        )
        records.append(spark, cut(records.records(made, CONTENT)), f"{path}/records")
    kept = records.load(spark, f"{path}/records").select("logical_key", "record_id")
    told = rows.join(kept, "logical_key", "left").join(answers.drop("payload"), "logical_key", "left")
    due = F.col("state") == "DUE"
    outcome = F.when(due & F.col("record_id").isNotNull(), "LANDED").when(due, "GAP").otherwise(F.col("state"))
    failed = F.concat(F.lit("download failed ("), F.coalesce("failure", F.lit("NO_ANSWER")), F.lit(")"))
    detail = F.when(outcome == "LANDED", F.col("record_id")).when(due, failed).when(F.col("state") == "SKIPPED_PRESENT", "already landed").when(F.col("state") == "NOT_DUE", "day has not closed yet")
    out = cut(told.select("logical_key", outcome.alias("outcome"), detail.alias("detail")))
    Log(spark, f"{path}/reports", order=["logical_key"]).append(out.select(F.lit(plan_id).alias("plan_id"), at.alias("started_at"), "*"))
    return out
