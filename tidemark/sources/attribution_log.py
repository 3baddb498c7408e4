"""Attribution tasks and their reviews as appended rows: one task a signal, reviews that are never changed, and what a task is by them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import cut
from tidemark.sources.loaders import or_fail
from tidemark.sources.log import Log

TASKS = "task_id string, signal_id string, created_at timestamp, review_status string, retained boolean"
REVIEWS = "review_id string, task_id string, reviewed_at timestamp, status string, retain boolean, reviewer string"


def with_review_state(tasks: DataFrame, reviews: DataFrame) -> DataFrame:
    """tasks (task_id, review_status, retained and more) as their reviews (task_id, reviewed_at, review_id, status, retain) leave them: the status of the
    last review, and retained if the task or any review says so. One aggregate of the reviews with map-side combine."""
    state = reviews.groupBy("task_id").agg(F.max_by("status", F.struct("reviewed_at", "review_id")).alias("__status"), F.bool_or(F.coalesce("retain", F.lit(False))).alias("__retain"))
    rows = tasks.join(state, "task_id", "left")
    kept = F.coalesce("retained", F.lit(False)) | F.coalesce("__retain", F.lit(False))
    return rows.withColumns({"review_status": F.coalesce("__status", "review_status"), "retained": kept}).select(*tasks.columns)


class AttributionLog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self._tasks, self._reviews = Log(spark, f"{path}/tasks"), Log(spark, f"{path}/reviews")

    def _read(self, log: Log, shape: str) -> DataFrame:
        found = log.read()
        return self.spark.createDataFrame([], shape) if found is None else found.select(*(c.split()[0] for c in shape.split(", ")))

    def add_tasks(self, tasks: DataFrame) -> DataFrame:
        """Appends a task for each signal that has none -> the tasks of these signals as they are stored."""
        tasks = cut(tasks.select(*(c.split()[0] for c in TASKS.split(", "))))
        self._tasks.append(tasks, "signal_id", keep_first=True)
        return self.tasks().join(tasks.select("signal_id"), "signal_id", "left_semi")

    def add_reviews(self, reviews: DataFrame) -> int:
        """Appends reviews -> how many are new. Fails for an unknown task; a known review with other content is a Conflict."""
        known = self._read(self._tasks, TASKS).select("task_id", F.lit(True).alias("__known")).distinct()
        rows = reviews.select(*(c.split()[0] for c in REVIEWS.split(", "))).join(known, "task_id", "left")
        rows = rows.withColumn("review_id", or_fail(F.col("review_id"), F.col("__known"), "unknown attribution task")).drop("__known")
        return self._reviews.append(rows, "review_id")

    def tasks(self) -> DataFrame:
        """Every task as its reviews leave it."""
        return with_review_state(self._read(self._tasks, TASKS), self._read(self._reviews, REVIEWS))

    def latest(self, n: int) -> DataFrame:
        """The n latest tasks (a report)."""
        return self.tasks().orderBy(F.desc("created_at"), "task_id").limit(n)
