"""A model registry of appended events: versions, promotions and rollbacks with their approvals, and champions frozen for sessions.

Nothing is ever changed: a champion is the target of its model's last event. Each append is bound to the version of the log that it was
judged by, so that of two approvals at once the second is judged by the champion that the first has made.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import governance
from tidemark.session import cut
from tidemark.sources.log import Log
from tidemark.sources.sinks import Conflict

VERSIONS = "model_id string, version string, parent_version string, validation_report_hash string, trained_at timestamp"
EVENTS = "model_id string, action string, source_version string, target_version string, approval_id string, approved_at timestamp, evidence_hash string"
FREEZES = "model_id string, session_id string, version string"
_TRIES = 100


def _names(shape: str) -> list[str]:
    return [c.split()[0] for c in shape.split(", ")]


class GovernanceLog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self._versions, self._events, self._freezes = (Log(spark, f"{path}/{n}", order=["model_id", o]) for n, o in (("versions", "version"), ("events", "approval_id"), ("freezes", "session_id")))

    def _read(self, log: Log, shape: str) -> DataFrame:
        found = log.read()
        return self.spark.createDataFrame([], f"{shape}, seq long") if found is None else found.select(*_names(shape), "seq")

    def versions(self) -> DataFrame:
        return self._read(self._versions, VERSIONS)

    def events(self) -> DataFrame:
        """Promotions and rollbacks, numbered in the order in which they took effect."""
        return self._read(self._events, EVENTS)

    def freezes(self) -> DataFrame:
        return self._read(self._freezes, FREEZES)

    def champions(self) -> DataFrame:
        return governance.champions(self.events())

    def register(self, new: DataFrame) -> DataFrame:
        """Registers challengers (the columns of VERSIONS) -> each with `fault`, null where it is registered now. A parent may be new too, if its
        row has been trained no later."""
        for _ in range(_TRIES):
            head = self._versions.version()
            old = self.versions().withColumn("__new", F.lit(False))
            order = F.row_number().over(Window.orderBy("trained_at", "model_id", "version"))  # a batch of registrations is small
            rows = cut(new.select(*_names(VERSIONS)).withColumn("seq", order + self._versions.last_seq()).withColumn("__new", F.lit(True)))
            judged = cut(governance.registration_faults(old.unionByName(rows.select(*old.columns))).where("__new").drop("__new"))
            try:
                self._versions.append(judged.where("fault IS NULL").select(*_names(VERSIONS)), expect=head)
                return judged.select(*_names(VERSIONS), "fault")
            except Conflict:
                continue
        raise RuntimeError("too many writers at once")

    def apply(self, approvals: DataFrame) -> DataFrame:
        """Applies approvals (approval_id, action PROMOTE or ROLLBACK, model_id, source_version, target_version, evidence_hash, approved_at) -> each with
        `reasons`, empty where it took effect. A model's approvals go one after the other, in the order of approved_at: each round judges every
        model's next one by the champions of that moment."""
        turn = F.row_number().over(Window.partitionBy("model_id").orderBy("approved_at", "approval_id"))
        left = cut(approvals.withColumn("__turn", turn))
        told, last = None, left.agg(F.max("__turn")).first()[0] or 0
        for n in range(1, last + 1):
            for _ in range(_TRIES):
                head, events = self._events.version(), self.events()
                used = events.select("approval_id")
                judged = cut(governance.approval_faults(left.where(F.col("__turn") == n).drop("__turn"), self.versions(), governance.champions(events), used))
                good = judged.where(F.size("reasons") == 0)
                try:
                    self._events.append(good.select(*_names(EVENTS)), expect=head)
                    break
                except Conflict:
                    continue
            else:
                raise RuntimeError("too many writers at once")
            told = judged if told is None else told.unionByName(judged)
        return approvals.limit(0).withColumn("reasons", F.array().cast("array<string>")) if told is None else told.select(*approvals.columns, "reasons")

    def freeze(self, sessions: DataFrame) -> DataFrame:
        """Freezes sessions (model_id, session_id) to their models' champions -> (model_id, session_id, version, fault): a session stays with
        what it was frozen to first; NO_CHAMPION and BLANK_SESSION freeze nothing."""
        current = self.champions().withColumnRenamed("version", "__current")
        rows = sessions.select("model_id", "session_id").distinct().join(current, "model_id", "left")
        blank = F.coalesce(F.trim("session_id"), F.lit("")) == ""
        rows = cut(rows.withColumn("fault", F.when(blank, "BLANK_SESSION").when(F.col("__current").isNull(), "NO_CHAMPION")))
        key = F.concat_ws("\x1f", "model_id", "session_id").alias("frozen_key")
        self._freezes.append(rows.where("fault IS NULL").select("model_id", "session_id", F.col("__current").alias("version"), key), key="frozen_key", keep_first=True)
        kept = self.freezes().select("model_id", "session_id", "version")
        return rows.drop("__current").join(kept, ["model_id", "session_id"], "left").select("model_id", "session_id", "version", F.when(F.col("version").isNull(), F.col("fault")).alias("fault"))

    def champion_of(self, requests: DataFrame) -> DataFrame:
        """Each request (model_id, session_id or null) with its version, and whether it was frozen."""
        return governance.session_champions(requests, self.freezes(), self.champions())
