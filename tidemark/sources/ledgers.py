"""Ledgers and landed batches: verified reads, chained appends, sealed payloads, binary day files, previews and reports."""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import canonical_json, unseal
from tidemark.operators import rules
from tidemark.session import cut
from tidemark.sources.loaders import exists, or_fail
from tidemark.sources.log import Log
from tidemark.sources.sinks import content_hash

GENESIS = "GENESIS"
#: Fixed values of the binary day format: its magic, the record type of minute bars, and the unit of prices.
DBN_MAGIC, DBN_MINUTE_BARS, DBN_UNIT = b"DBN", 33, 1e-9
_BAR = np.dtype([("length", "u1"), ("rtype", "u1"), ("publisher", "<u2"), ("instrument", "<u4"), ("ts_event", "<u8"), ("open", "<i8"), ("high", "<i8"), ("low", "<i8"), ("close", "<i8"), ("volume", "<u8")])


def verified(records: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """records with content_hash, each of which must be that of its own columns; the job fails at the first that isn't."""
    own = content_hash(records.select(key, *columns), key).select(key, F.col("content_hash").alias("__own"))
    return records.join(own, key).withColumn("content_hash", or_fail(F.col("content_hash"), F.col("content_hash") == F.col("__own"), "a record's content hash is false")).drop("__own")


def ledger(spark: SparkSession, path: str, key: str, shape: str) -> DataFrame:
    """A ledger written by append_once, verified row by row; a missing one is empty. shape: its columns without the hash. Files that
    were put beside the ledger's commits are read, and so verified, too."""
    names = [c.split()[0] for c in shape.split(", ")]
    log = Log(spark, path)
    strays = any(n.endswith(".parquet") for n in log.files.names(path))
    found = [x for x in (log.read(), spark.read.parquet(f"{path}/*.parquet") if strays else None) if x is not None]
    if not found:
        return spark.createDataFrame([], f"{shape}, content_hash string")
    return verified(functools.reduce(DataFrame.unionByName, found), key, [c for c in names if c != key]).select(*names, "content_hash")


def scope(logical_key: Column, wanted: str) -> Column:
    """Whether a composite key (provider/schema/scope/day) is of a scope."""
    parts = F.split(logical_key, "/")
    return (F.size(parts) == 4) & (F.get(parts, F.lit(2)) == wanted)


def without_prefix(logical_key: Column, prefix: str) -> Column:
    """What follows the prefix of a key; null for other keys."""
    return F.when(logical_key.startswith(prefix), F.substring(logical_key, F.lit(len(prefix) + 1), F.length(logical_key)))


def _chain(keys: list[str], names: list[str]):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("ordinal")
        seq, previous = int(group["last_seq"].iloc[0]), group["last_hash"].iloc[0]
        out = []
        for row in group.to_dict("records"):
            seq += 1
            entry = hashlib.sha256(f"{seq}|{previous}|{row['content']}".encode()).hexdigest()
            out.append({**{c: row[c] for c in names}, "seq": seq, "previous_hash": previous, "entry_hash": entry})
            previous = entry
        return pd.DataFrame(out)

    return run


def chain_hash(columns: list[str]) -> Column:
    """The hash that an entry of a chained ledger must have."""
    return F.sha2(F.concat_ws("|", F.col("seq").cast("string"), F.col("previous_hash"), canonical_json(*columns)), 256)


def append_chained(spark: SparkSession, rows: DataFrame, path: str, keys: list[str], order: str, first: int = 1) -> int:
    """Appends rows, in order, to the hash-chained ledger of their keys -> how many. The whole ledger is verified before. One
    writer a ledger. A chain is a sequence by nature: the new entries of one key are hashed in one task. first: the number of a
    chain's first entry (0 in cost ledgers)."""
    names = rows.columns
    old = chained(spark, path, keys, names, first) if exists(spark, path) else None
    shape = rows.schema.simpleString()[len("struct<") : -1].replace(":", " ").replace(",", ", ")
    if old is None:
        rows = rows.withColumns({"last_seq": F.lit(first - 1).cast("long"), "last_hash": F.lit(GENESIS)})
    else:
        last = old.groupBy(*keys).agg(F.max_by(F.struct("seq", "entry_hash"), "seq").alias("l")).select(*keys, F.col("l.seq").alias("last_seq"), F.col("l.entry_hash").alias("last_hash"))
        rows = rows.join(last, keys, "left").withColumns({"last_seq": F.coalesce("last_seq", F.lit(first - 1)), "last_hash": F.coalesce("last_hash", F.lit(GENESIS))})
    rows = rows.withColumns({"ordinal": F.col(order), "content": canonical_json(*names)})
    new = cut(rows.groupBy(*keys).applyInPandas(_chain(keys, names), f"{shape}, seq long, previous_hash string, entry_hash string"))
    n = new.count()
    if n:
        new.write.mode("append").parquet(path)
    return n


def chained(spark: SparkSession, path: str, keys: list[str], columns: list[str], first: int = 1) -> DataFrame:
    """A chained ledger; raises if any link, number or hash of any of its chains is false."""
    rows = spark.read.parquet(path)
    breaks = rules.chain_breaks(rows, keys, "seq", "previous_hash", "entry_hash", chain_hash(columns), GENESIS, first)
    if not breaks.where("bad_links + bad_sequence + bad_hashes > 0").isEmpty():
        raise ValueError("the ledger's chain is broken")
    return rows


def land(spark: SparkSession, batches: DataFrame, path: str, key: Column, seal_with) -> int:
    """Lands payloads (provider, dataset, logical_key, first_seen_at, payload) sealed and content-addressed, in one commit -> how many are new.
    seal_with: (payload, key, context) -> sealed column, such as scalars.seal. The same batch again is passed over."""
    ids = F.sha2(F.concat_ws("|", "provider", "dataset", F.sha2("logical_key", 256), F.col("first_seen_at").cast("string"), F.sha2("payload", 256)), 256)
    rows = batches.withColumn("landing_id", ids).withColumn("payload_sha256", F.sha2("payload", 256))
    safe = F.col("provider").rlike("^[A-Za-z0-9._-]+$") & F.col("dataset").rlike("^[A-Za-z0-9._-]+$") & (F.length("payload") > 0)
    rows = rows.withColumn("landing_id", or_fail(F.col("landing_id"), safe, "landing needs safe names and a payload"))
    known = Log(spark, path).read()
    fresh = rows.dropDuplicates(["landing_id"])
    fresh = fresh if known is None else fresh.join(known.select("landing_id"), "landing_id", "left_anti")  # a nonce makes each seal differ: ids decide
    sealed = fresh.withColumn("sealed", seal_with(F.col("payload"), key, F.concat_ws(":", "landing_id", "provider", "dataset"))).drop("payload")
    return Log(spark, path).append(sealed, "landing_id", keep_first=True)


def landed(spark: SparkSession, path: str, key: Column) -> DataFrame:
    """The landed batches with their payloads, opened and checked against their hashes; the job fails at a false one."""
    stored = Log(spark, path).read()
    if stored is None:
        raise ValueError(f"nothing has landed at {path}")
    rows = stored.drop("content_hash").withColumn("payload", unseal(F.col("sealed"), key, F.concat_ws(":", "landing_id", "provider", "dataset")))
    return rows.withColumn("payload", or_fail(F.col("payload"), F.sha2("payload", 256) == F.col("payload_sha256"), "a landed batch can't be opened or verified")).drop("sealed")


def put_if_absent(spark: SparkSession, objects: DataFrame, path: str, key: str) -> DataFrame:
    """A create-exclusive object store: of an object (key and its columns) the first content stays, whichever writer comes first
    -> the objects as they are stored."""
    log = Log(spark, path)
    log.append(objects, key, keep_first=True)
    stored = log.read()
    asked = objects.select(key).distinct()
    return asked.limit(0) if stored is None else stored.join(asked, key, "left_semi").drop("content_hash")


def _minute_bars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if content[:3] != DBN_MAGIC:
                raise ValueError(f"{name} isn't a binary day file")
            at = 8 + int.from_bytes(content[4:8], "little")  # magic, version, length of the metadata, metadata
            data = np.frombuffer(content, np.uint8)[at:]
            if len(data) % _BAR.itemsize:
                raise ValueError(f"{name} ends within a record")
            rows = data.view(_BAR)
            if len(rows) and ((rows["rtype"] != DBN_MINUTE_BARS) | (rows["length"] != _BAR.itemsize // 4)).any():
                raise ValueError(f"{name} holds other records than minute bars")
            price = lambda c: pa.array(np.where(rows[c] == np.iinfo(np.int64).max, np.nan, rows[c] * DBN_UNIT))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(rows), pa.string()), pa.array(rows["instrument"].astype(np.int64)), pa.array((rows["ts_event"] // 1000).astype(np.int64)), *(price(c) for c in ("open", "high", "low", "close")), pa.array(rows["volume"].astype(np.float64))],
                ["path", "instrument_id", "us", "open", "high", "low", "close", "volume"],
            )


def binary_bars(spark: SparkSession, path: str) -> DataFrame:
    """Minute bars of uncompressed binary day files -> path, instrument_id, ts_event, open, high, low, close, volume. One file a
    task, as a day's bars are some 100 KB; undefined prices are NaN; a file of another kind fails the job."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    rows = files.mapInArrow(_minute_bars, "path string, instrument_id long, us long, open double, high double, low double, close double, volume double")
    return rows.select("path", "instrument_id", F.timestamp_micros("us").alias("ts_event"), "open", "high", "low", "close", "volume")


def anchor_closes(first, second, start: str, end: str) -> DataFrame:
    """The closes (day, close) of the first of two sources (functions without arguments) that has any from start to end; raises
    if neither has. A source that fails counts as empty, but for the last."""
    for source in (first, second):
        try:
            found = cut(source().where(F.col("day").between(F.lit(start).cast("date"), F.lit(end).cast("date"))))
        except Exception:
            if source is second:
                raise
            continue
        if not found.isEmpty():
            return found
    raise ValueError(f"no closes from {start} to {end}")


def preview(spark: SparkSession, path: str, n: int = 20, most_bytes: int = 256 << 20) -> DataFrame:
    """The first n lines of a text file (the limit is the feature); files above most_bytes are refused unread."""
    size = spark.read.format("binaryFile").load(path).agg(F.max("length")).first()[0] or 0
    if size > most_bytes:
        raise ValueError(f"{path} has {size} bytes, over {most_bytes}")
    return spark.read.text(path).limit(n)


def latest_report(spark: SparkSession, path: str) -> dict | None:
    """A small JSON document, read through Spark; None where it is missing or isn't JSON."""
    if not exists(spark, path):
        return None
    try:
        found = json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).limit(1).collect()))
    except ValueError:
        return None
    return found if isinstance(found, dict) else None


def report_lines(df: DataFrame, most: int = 1000) -> list[str]:
    """The rows of a report as JSON lines on the driver; raises beyond `most`, which a report never reaches."""
    lines = df.limit(most + 1).toJSON().collect()
    if len(lines) > most:
        raise ValueError(f"a report has at most {most} rows")
    return sorted(lines)


def with_validity(features: DataFrame) -> DataFrame:
    """Feature records typed, with atm_iv_valid where it isn't given: whether there is an atm_iv. An invalid one is null."""
    given = F.col("atm_iv_valid") if "atm_iv_valid" in features.columns else F.lit(None).cast("boolean")
    valid = F.coalesce(given, F.col("atm_iv").isNotNull())
    return features.withColumns({"atm_iv": F.when(valid, F.col("atm_iv").cast("double")), "atm_iv_valid": valid})
