"""Append-only sinks: what is there already is skipped, and what disagrees with it fails."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(ValueError):
    """A key was to be appended again with other content."""


def content_hash(df: DataFrame, key: str) -> DataFrame:
    """df with content_hash: SHA-256 of the row's other columns as JSON, in the order of their names."""
    rest = sorted(c for c in df.columns if c != key)
    return df.withColumn("content_hash", F.sha2(F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}), 256))


def append_once(spark: SparkSession, rows: DataFrame, path: str, key: str) -> int:
    """Appends rows whose key isn't in the ledger at a path yet -> how many. The same key with the same content is passed
    over; with other content, or twice in rows with different contents, nothing is written and Conflict is raised.

    An append is one commit of a log (log.Log): what is checked is what is appended, and of several writers at once one comes
    first and the others check against it.
    """
    from tidemark.sources.log import Log

    return Log(spark, path).append(rows, key)


def write_records(rows: DataFrame, path: str, append: bool = True) -> None:
    """JSON lines; distances are overwritten, everything else is appended."""
    rows.write.mode("append" if append else "overwrite").json(path)
