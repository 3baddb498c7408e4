"""Point-in-time records: a content with its hash, and an identity made of everything that says where and when it is from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.snapshots import canonical, canonical_text, digest
from tidemark.operators import rules
from tidemark.sources.loaders import exists, or_fail
from tidemark.sources.log import Log

TEXTS = ("logical_key", "provider", "provider_version", "schema_version")
SHAPE = "record_id string, logical_key string, published_at timestamp, first_seen_at timestamp, provider string, provider_version string, schema_version string, content_hash string, canonical_content string"
_NAMES = [c.split()[0] for c in SHAPE.split(", ")]


def _identity() -> Column:
    return digest(canonical(*TEXTS, "published_at", "first_seen_at", "content_hash"))


def records(rows: DataFrame, content: list[str]) -> DataFrame:
    """rows (logical_key, published_at, first_seen_at, provider, provider_version, schema_version and the content's columns) as records. Fails
    for a blank or missing text, and for what was seen before it was published."""
    filled = [F.coalesce(F.trim(c), F.lit("")) != "" for c in TEXTS]
    fine = (F.col("published_at") <= F.col("first_seen_at")) & filled[0] & filled[1] & filled[2] & filled[3]
    made = rows.withColumn("canonical_content", canonical(*content)).withColumn("content_hash", digest(F.col("canonical_content")))
    made = made.withColumn("logical_key", or_fail(F.col("logical_key"), fine, "a record needs its texts, and to be published before it is seen"))
    return made.withColumn("record_id", _identity()).select(*_NAMES)


def record_faults(found: DataFrame) -> DataFrame:
    """found with `faults`: SEEN_BEFORE_PUBLISHED, CONTENT_HASH (the content, put in canonical form, has another hash), RECORD_ID; nulls
    fail closed."""
    again = digest(canonical_text(F.col("canonical_content")))
    why = rules.reasons([
        (F.col("published_at") > F.col("first_seen_at"), "SEEN_BEFORE_PUBLISHED"), (F.col("content_hash") != F.col("__hash"), "CONTENT_HASH"), (F.col("record_id") != F.col("__id"), "RECORD_ID"),
    ])
    return found.withColumns({"__hash": again, "__id": _identity()}).withColumn("faults", why).drop("__hash", "__id")


def verified(found: DataFrame) -> DataFrame:
    """found, or a failed job at the first false record."""
    return record_faults(found).withColumn("record_id", or_fail(F.col("record_id"), F.size("faults") == 0, "a record's hash or identity is false")).drop("faults")


def append(spark: SparkSession, new: DataFrame, path: str) -> int:
    """Appends verified records to the log at a path, one a logical key -> how many; another record for a known key is a Conflict."""
    return Log(spark, path).append(verified(new).withColumnRenamed("content_hash", "hash"), "logical_key")


def load(spark: SparkSession, path: str) -> DataFrame:
    """The records of a log, each verified; a missing log is empty."""
    found = Log(spark, path).read()
    return spark.createDataFrame([], SHAPE) if found is None else verified(found.drop("content_hash").withColumnRenamed("hash", "content_hash").select(*_NAMES))


def load_lines(spark: SparkSession, path: str) -> DataFrame:
    """Records of JSON lines, one a line, each verified; a missing file is empty, and a line that isn't JSON fails the job."""
    if not exists(spark, path):
        return spark.createDataFrame([], SHAPE)
    return verified(spark.read.schema(SHAPE).option("mode", "FAILFAST").json(path))


def content_field(name: str, kind: str = "string") -> Column:
    """A field of a record's content, by its path ($.a.b without the dollar)."""
    return F.get_json_object("canonical_content", f"$.{name}").cast(kind)
