"""Tables that grow by atomic commits: data files first, then one commit file a version, which only one writer can create.

`path/commit=<id>/` holds the Parquet files of a commit, `path/_commits/<version>.json` names them. A writer whose version
another one has taken looks at what was committed meanwhile and tries the next; data of a writer that died is in no commit
and so isn't read. Commits also carry numbers: a row's `seq` is its place in its commit after the last number of the commits before, so
that numbers have no gap and no repetition, whatever the partitioning and however often a batch is tried.

Commit files are created exclusively: by a hard link on local file systems, and elsewhere by Hadoop's rename, which must
be atomic and refuse an existing target, as that of HDFS is.
"""

from __future__ import annotations

import contextlib
import json
import os
import time
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.delivery import cursor_fault
from tidemark.session import cut
from tidemark.sources.sinks import Conflict, content_hash

_TRIES = 1000


class _Files:
    """The few file operations of a log, through Hadoop's file systems."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._path(path).getFileSystem(self.conf)
        self.local = self.fs.getUri().getScheme() == "file"

    def _path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def names(self, folder: str) -> list[str]:
        if not self.fs.exists(self._path(folder)):
            return []
        return sorted(x.getPath().getName() for x in self.fs.listStatus(self._path(folder)))

    def ages(self, folder: str) -> dict[str, float]:
        """Names in a folder with the seconds since they changed."""
        if not self.fs.exists(self._path(folder)):
            return {}
        return {x.getPath().getName(): time.time() - x.getModificationTime() / 1000 for x in self.fs.listStatus(self._path(folder))}

    def read(self, file: str) -> str:
        stream = self.fs.open(self._path(file))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _write(self, file: str, text: str) -> None:
        out = self.fs.create(self._path(file), False)
        out.write(bytearray(text.encode()))
        out.close()

    def create(self, file: str, text: str) -> bool:
        """Whether this call made the file, with its whole content at once; False if it is there."""
        folder, _, name = file.rpartition("/")
        self.fs.mkdirs(self._path(folder))
        temporary = f"{folder}/.{name}.{uuid.uuid4().hex}"
        self._write(temporary, text)
        try:
            if self.local:
                place = self.fs.makeQualified(self._path(temporary)).toUri().getPath()
                os.link(place, os.path.join(os.path.dirname(place), name))
                return True
            context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
            kind = self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
            context.rename(self._path(temporary), self._path(file), self.jvm.java.lang.reflect.Array.newInstance(kind, 0))  # no overwriting
            return True
        except FileExistsError:
            return False
        except Exception as e:
            if "FileAlreadyExistsException" in str(e):
                return False
            raise
        finally:
            with contextlib.suppress(Exception):
                self.fs.delete(self._path(temporary), False)

    def delete(self, folder: str) -> None:
        self.fs.delete(self._path(folder), True)


class Log:
    """A table at a path. order: columns by which a commit's rows are numbered (`seq`, from 1 over the whole table); without it rows have
    no numbers. Any number of writers at once; readers see whole commits."""

    def __init__(self, spark: SparkSession, path: str, order: list[str] | None = None):
        self.spark, self.path, self.order = spark, path.rstrip("/"), order
        self.files = _Files(spark, self.path)

    def commits(self, after: int = -1) -> list[dict[str, Any]]:
        """The commits after a version, in order; of compacted ones only what replaced them."""
        names = [n for n in self.files.names(f"{self.path}/_commits") if n.endswith(".json") and not n.startswith(".") and int(n[:-5]) > after]
        found = [json.loads(self.files.read(f"{self.path}/_commits/{n}")) for n in names]
        base = max((i for i, c in enumerate(found) if c["base"]), default=0)
        return found[base:]

    def _read(self, commits: list[dict[str, Any]]) -> DataFrame | None:
        parts = [(d["name"], d["first"]) for c in commits for d in c["data"]]
        if not parts:
            return None
        schema = T.StructType.fromJson(commits[-1]["schema"])
        rows = self.spark.read.schema(schema).parquet(*(f"{self.path}/commit={name}" for name, _ in parts))
        if "__rel" not in schema.names:
            return rows
        first = self.spark.createDataFrame(parts, "__dir string, __first long")
        rows = rows.withColumn("__dir", F.regexp_extract("_metadata.file_path", "/commit=([0-9a-f]+)/[^/]*$", 1))
        return rows.join(F.broadcast(first), "__dir").withColumn("seq", F.col("__first") + F.col("__rel") - 1).drop("__dir", "__first", "__rel")  # a row a commit

    def read(self, after: int = -1) -> DataFrame | None:
        """The rows of all commits after a version, None before the first."""
        return self._read(self.commits(after))

    def version(self) -> int:
        """The last commit's, -1 before the first."""
        found = self.commits()
        return found[-1]["version"] if found else -1

    def last_seq(self) -> int:
        found = self.commits()
        return found[-1]["next"] - 1 if found else 0

    def _write(self, rows: DataFrame) -> tuple[str, int, dict[str, Any]]:
        """Writes rows, numbered within -> (folder, rows, schema)."""
        if self.order:
            dealt = cut(rows.repartitionByRange(*self.order).withColumn("__part", F.spark_partition_id()))
            sizes = dealt.groupBy("__part").agg(F.count("*").alias("n"))  # a row a part
            before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
            own = F.row_number().over(Window.partitionBy("__part").orderBy(*self.order))
            rows = dealt.join(F.broadcast(sizes.select("__part", before.alias("__before"))), "__part").withColumn("__rel", F.col("__before") + own).drop("__part", "__before")
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/commit={name}")
        kept = self.spark.read.schema(rows.schema).parquet(f"{self.path}/commit={name}")
        return name, kept.count(), kept.schema.jsonValue()

    def _commit(self, head: dict[str, Any] | None, data: list[dict[str, Any]], rows: int, schema: dict[str, Any] | None, batches: dict[str, int], info: dict[str, Any], base: bool = False) -> bool:
        version, first = (head["version"] + 1, head["next"]) if head else (0, 1)
        after = head["next"] if base else first + rows
        entry = {"version": version, "data": data, "next": after, "schema": schema or (head or {}).get("schema"), "batches": batches, "info": info, "base": base, "at": time.time()}
        return self.files.create(f"{self.path}/_commits/{version:020d}.json", json.dumps(entry))

    def append(self, rows: DataFrame, key: str | None = None, keep_first: bool = False, batch: tuple[str, int] | None = None, info: dict[str, Any] | None = None, expect: int | None = None) -> int:
        """Appends rows in one commit -> how many. expect: the version (-1 for none) that rows were worked out from; a log that has gone on
        since is a Conflict.

        With a key (and a column content_hash, which is added), a key that is there is passed over if its content is the same; other content,
        there or within rows, is a Conflict and nothing is appended, or with keep_first passed over too. batch (query, number): a batch
        that was committed before, or an older one of its query, isn't appended again.
        """
        new = cut(content_hash(rows, key) if key else rows)
        if key:
            new = new.dropDuplicates([key, "content_hash"])
            if not keep_first and not new.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
                raise Conflict(f"different contents for one {key}")
            new = cut(new.dropDuplicates([key]) if keep_first else new)
        seen, written = -1, None
        for _ in range(_TRIES):
            commits = self.commits()
            head = commits[-1] if commits else None
            if expect is not None and (head["version"] if head else -1) != expect:
                raise Conflict("the log has gone on")
            batches = dict(head["batches"]) if head else {}
            if batch:
                if batches.get(batch[0], -1) >= batch[1]:
                    return 0
                batches[batch[0]] = batch[1]
            later = self._read([c for c in commits if c["version"] > seen]) if key else None
            if later is not None:
                both = new.join(later.select(F.col(key), F.col("content_hash").alias("__known")), key)
                if not keep_first and not both.where("__known <> content_hash").isEmpty():
                    raise Conflict(f"other content for a known {key}")
                if not both.isEmpty():
                    new, written = cut(new.join(later.select(key), key, "left_anti")), None
            seen = head["version"] if head else -1
            if written is None:
                if new.isEmpty() and not batch:
                    return 0
                written = self._write(new)
            name, n, schema = written
            fields = [{(f["name"], json.dumps(f["type"])) for f in x["fields"]} for x in (schema, head["schema"] if head and head["schema"] else schema)]
            if fields[0] != fields[1]:
                raise ValueError("rows have other columns than the log")
            data = [{"name": name, "first": head["next"] if head else 1}] if n else []
            if self._commit(head, data, n, schema, batches, info or {}):
                return n
        raise RuntimeError("too many writers at once")

    def compact(self) -> bool:
        """Rewrites all commits as one; False if another writer came in between. Older data stays until vacuum()."""
        commits = self.commits()
        rows = self._read(commits)
        if rows is None:
            return False
        numbered = "seq" in rows.columns
        name = uuid.uuid4().hex
        (rows.withColumnRenamed("seq", "__rel") if numbered else rows).write.parquet(f"{self.path}/commit={name}")
        return self._commit(commits[-1], [{"name": name, "first": 1}], 0, None, commits[-1]["batches"], {"compacted": len(commits)}, base=True)

    def vacuum(self, seconds: float = 7 * 86400.0) -> int:
        """Deletes folders that no commit names and that haven't changed for so long (a writer's data isn't named until its commit)."""
        named = {d["name"] for c in self.commits() for d in c["data"]}
        old = [n for n, age in self.files.ages(self.path).items() if n.startswith("commit=") and n[len("commit=") :] not in named and age >= seconds]
        for n in old:
            self.files.delete(f"{self.path}/{n}")
        return len(old)

    def foreach_batch(self, query: str, key: str | None = None, keep_first: bool = False) -> Callable[[DataFrame, int], None]:
        """For writeStream.foreachBatch: each micro-batch is one commit, which carries the batch's number; a repeated batch is a no-op."""

        def run(rows: DataFrame, number: int) -> None:
            self.append(rows, key, keep_first, batch=(query, number))

        return run


class AlertStream:
    """What readers of alerts get: every new state of an alert once, in the order of gapless numbers, from any number on; each delivery
    is on record in the audit log before it is handed out."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.events = Log(spark, f"{path}/events", order=["recorded_at", "projection_key"])
        self.audit = Log(spark, f"{path}/audit")

    def sync(self, projected: DataFrame, now: float) -> int:
        """Appends the states (projection_key and columns, as delivery.projection gives them) that aren't there yet -> how many."""
        return self.events.append(projected.withColumn("recorded_at", F.lit(now)), "projection_key", keep_first=True)

    def frames(self, connection: str, cursor: str | None, now: float, heartbeat_seconds: float = 15.0) -> DataFrame:
        """The events after a cursor (a number as its reader got it, or None), in order; without any, one row without seq if nothing has gone
        out on this connection for heartbeat_seconds. Raises for a cursor that can't be one. What is returned was recorded before, in
        one commit; a reader that got less than that asks again with the last number it has."""
        fault = self.spark.range(1).select(cursor_fault(F.lit(cursor).cast("string"), F.lit(self.events.last_seq())).alias("f")).first().f
        if fault:
            raise ValueError(fault)
        rows = self.events.read()
        pending = None if rows is None else cut(rows.where(F.col("seq") > int(cursor or 0)))
        record = lambda seq: (F.sha2(F.concat_ws("|", F.lit(connection), F.coalesce(seq.cast("string"), F.lit("")), F.lit(repr(now))), 256).alias("delivery_id"), F.lit(connection).alias("connection_id"), seq.cast("long").alias("seq"), F.lit(float(now)).alias("attempted_at"))
        if pending is not None and not pending.isEmpty():
            self.audit.append(pending.select(*record(F.col("seq"))))
            return pending.drop("content_hash").orderBy("seq")
        sent = self.audit.read()
        last = None if sent is None else sent.where(F.col("connection_id") == connection).agg(F.max("attempted_at")).first()[0]
        beat = self.spark.range(1).select(*record(F.lit(None)))
        if last is None or now - last >= heartbeat_seconds:
            self.audit.append(beat)
            return beat.select("seq", F.col("attempted_at").alias("recorded_at"))
        return beat.limit(0).select("seq", F.col("attempted_at").alias("recorded_at"))
