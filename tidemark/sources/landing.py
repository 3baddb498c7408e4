"""The boundary of licensed payloads: who may write or read is asked first, payloads are only kept sealed, and receipts never hold them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import seal, unseal
from tidemark.session import cut
from tidemark.sources import ledgers
from tidemark.sources.loaders import or_fail
from tidemark.sources.log import Log

ALGORITHM = "AES-GCM"
RECEIPT = ["landing_id", "object_key", "provider", "dataset", "logical_key_hash", "published_at", "first_seen_at", "plaintext_sha256", "key_id", "algorithm", "content_type"]


class AccessDenied(PermissionError):
    """The authorizer didn't let a principal write or read."""


@dataclass(frozen=True)
class Context:
    """Who asks for what: operation is WRITE or READ."""

    principal: str
    purpose: str
    operation: str
    provider: str
    dataset: str


class Landing:
    """Sealed batches and receipts under a path. authorize: a context -> whether it may; key: the sealing key's column, key_id its name."""

    def __init__(self, spark: SparkSession, path: str, key: Column, key_id: str, authorize: Callable[[Context], bool]):
        if not key_id.strip():
            raise ValueError("the key needs a name")
        self.spark, self.key, self.key_id, self.authorize = spark, key, key_id, authorize
        self.objects, self._receipts = f"{path}/objects", Log(spark, f"{path}/receipts")

    def _allow(self, rows: DataFrame, principal: str, purpose: str, operation: str) -> None:
        """Asks once for each provider and dataset (a handful)."""
        if not principal.strip() or not purpose.strip():
            raise ValueError("landing fields must not be blank")
        for r in rows.select("provider", "dataset").distinct().collect():
            if not self.authorize(Context(principal, purpose, operation, r.provider, r.dataset)):
                raise AccessDenied(f"{operation} of {r.provider}/{r.dataset} is denied")

    def receipts(self) -> DataFrame | None:
        found = self._receipts.read()
        return None if found is None else found.select(*RECEIPT)

    def land(self, batches: DataFrame, principal: str, purpose: str, content_type: str) -> DataFrame:
        """batches (provider, dataset, logical_key, published_at, first_seen_at, payload) -> their receipts. Nothing is written if any isn't allowed, has a blank
        field or no payload, or was seen before it was published. The same batch again gives the same receipt."""
        if not content_type.strip():
            raise ValueError("landing fields must not be blank")
        self._allow(batches, principal, purpose, "WRITE")
        fine = (F.col("published_at") <= F.col("first_seen_at")) & (F.trim("logical_key") != "")
        rows = cut(batches.withColumn("logical_key", or_fail(F.col("logical_key"), fine, "a batch needs a key, and to be published before it is seen")))
        ledgers.land(self.spark, rows.drop("published_at"), self.objects, self.key, seal)
        stored = Log(self.spark, self.objects).read()
        digest = F.sha2("payload", 256)
        asked = rows.select("provider", "dataset", "logical_key", "published_at", "first_seen_at", digest.alias("payload_sha256"))
        found = asked.join(stored.select("landing_id", "provider", "dataset", "logical_key", "first_seen_at", "payload_sha256"), ["provider", "dataset", "logical_key", "first_seen_at", "payload_sha256"])
        made = found.select(
            "landing_id", F.concat_ws("/", F.lit("licensed"), "provider", "dataset", "landing_id").alias("object_key"), "provider", "dataset", F.sha2("logical_key", 256).alias("logical_key_hash"), "published_at", "first_seen_at",
            F.col("payload_sha256").alias("plaintext_sha256"), F.lit(self.key_id).alias("key_id"), F.lit(ALGORITHM).alias("algorithm"), F.lit(content_type).alias("content_type"),
        )
        made = cut(made.dropDuplicates(["landing_id"]))
        self._receipts.append(made, "landing_id")
        return made

    def read(self, receipts: DataFrame, principal: str, purpose: str) -> DataFrame:
        """receipts -> landing_id, logical_key, payload, opened for a principal who may read; fails for a receipt without its batch, with another key's
        name, or whose payload isn't what was landed."""
        self._allow(receipts, principal, purpose, "READ")
        stored = Log(self.spark, self.objects).read()
        if stored is None:
            raise ValueError("nothing has landed")
        rows = receipts.select("landing_id", "plaintext_sha256", "key_id").join(stored.select("landing_id", "provider", "dataset", "logical_key", "sealed"), "landing_id", "left")
        payload = unseal(F.col("sealed"), self.key, F.concat_ws(":", "landing_id", "provider", "dataset"))
        rows = rows.withColumn("payload", F.when(F.col("key_id") == self.key_id, payload))
        same = F.sha2("payload", 256) == F.col("plaintext_sha256")
        return rows.select("landing_id", "logical_key", or_fail(F.col("payload"), same, "a landed batch is missing, or can't be opened or verified").alias("payload"))
