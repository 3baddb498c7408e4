"""Repositories of immutable documents: named tables of rows by key, which grow by atomic commits and refuse other content for a known key."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.log import Log


@dataclass(frozen=True)
class Table:
    """A table's key, the time by which its latest rows come first, and, if rows belong to those of another table, the column and that table."""

    key: str
    at: str
    parent: tuple[str, str] | None = None


AUDIT = {
    "decisions": Table("run_id", "recorded_at"), "alerts": Table("alert_id", "created_at"), "feedback": Table("feedback_id", "recorded_at", ("alert_id", "alerts")),
    "records": Table("record_id", "first_seen_at"), "manifests": Table("manifest_hash", "as_of"), "checkpoints": Table("checkpoint_id", "captured_at"),
}
SCHEMA_VERSION = "audit-v1"


class Repository:
    """Tables under a path. Reading a table without rows gives None."""

    def __init__(self, spark: SparkSession, path: str, tables: dict[str, Table] | None = None):
        self.spark, self.path, self.tables = spark, path, tables or AUDIT

    def _log(self, name: str) -> Log:
        if name not in self.tables:
            raise KeyError(f"unknown table: {name}")
        return Log(self.spark, f"{self.path}/{name}")

    def append(self, name: str, rows: DataFrame) -> int:
        """Appends rows -> how many are new. The same row again is passed over, other content for its key a Conflict, and a row whose parent isn't
        there an error; nothing is written then."""
        log, table = self._log(name), self.tables[name]
        if table.parent is not None:
            column, of = table.parent
            known = self.read(of)
            lone = rows.select(column) if known is None else rows.select(column).join(known.select(F.col(self.tables[of].key).alias(column)), column, "left_anti")
            if not lone.isEmpty():
                raise KeyError(f"unknown {column}")
        return log.append(rows, table.key)

    def read(self, name: str) -> DataFrame | None:
        found = self._log(name).read()
        return None if found is None else found.drop("content_hash")

    def get(self, name: str, key: str) -> DataFrame | None:
        """The row of a key, or none."""
        found = self.read(name)
        return None if found is None else found.where(F.col(self.tables[name].key) == key)

    def latest(self, name: str, limit: int = 100) -> DataFrame | None:
        """The latest rows, the newest first (a report; the limit is the feature)."""
        if limit < 1:
            raise ValueError("limit must be positive")
        found, table = self.read(name), self.tables[name]
        return None if found is None else found.orderBy(F.desc(table.at), table.key).limit(limit)

    def integrity(self) -> DataFrame:
        """One row a table: rows, rows whose content isn't that of their hash, keys that are there twice, rows without their parent, and whether all
        is well."""
        out = self.spark.createDataFrame([], "table string, n_rows long, bad_hashes long, repeated_keys long, lone_rows long, sound boolean")
        for name, table in self.tables.items():
            found = self._log(name).read()
            if found is None:
                out = out.unionByName(self.spark.range(1).selectExpr(f"'{name}' AS table", "0L AS n_rows", "0L AS bad_hashes", "0L AS repeated_keys", "0L AS lone_rows", "true AS sound"))
                continue
            kept = found.select(F.struct(*(c for c in found.columns if c != "content_hash")).alias("row"), F.col("content_hash").alias("__kept"))
            rest = sorted(c for c in found.columns if c not in (table.key, "content_hash"))
            own = F.sha2(F.to_json(F.struct(*(F.col(f"row.{c}").alias(c) for c in rest)), {"ignoreNullFields": "false"}), 256)  # as sinks.content_hash
            both = kept.select(F.col(f"row.{table.key}").alias(table.key), "__kept", own.alias("content_hash"))
            counts = both.groupBy(table.key).agg(F.count_if(F.col("content_hash") != F.col("__kept")).alias("bad"), F.count("*").alias("n"))
            checks = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count_if(F.col("bad") > 0).alias("bad_hashes"), F.count_if(F.col("n") > 1).alias("repeated_keys"))
            lone = F.lit(0).cast("long")
            if table.parent is not None:
                column, of = table.parent
                known = self.read(of)
                alone = found.select(column) if known is None else found.select(column).join(known.select(F.col(self.tables[of].key).alias(column)), column, "left_anti")
                checks = checks.crossJoin(alone.agg(F.count("*").alias("lone_rows")))  # one row each
                lone = F.col("lone_rows")
            row = checks.select(F.lit(name).alias("table"), "n_rows", "bad_hashes", "repeated_keys", lone.alias("lone_rows"))
            out = out.unionByName(row.withColumn("sound", F.col("bad_hashes") + F.col("repeated_keys") + F.col("lone_rows") == 0))
        return out

    def schema_version(self) -> str:
        return SCHEMA_VERSION
