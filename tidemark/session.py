"""Session helpers shared by every layer."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


class _Held(threading.local):
    def __init__(self) -> None:
        self.scratches: list[Scratch] = []


_held = _Held()  # by thread, as jobs of several threads share this module


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own in local mode."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


class Scratch:
    """The tables cut within a scratch() block: all but those kept are deleted at its end."""

    def __init__(self) -> None:
        self.paths: dict[str, SparkSession] = {}
        self.kept: set[str] = set()

    def keep(self, df: DataFrame) -> DataFrame:
        """A table that what the block returns still reads."""
        self.kept.add(df._cut_path)
        return df


@contextmanager
def scratch() -> Iterator[Scratch]:
    """Within, tables cut are scratch, and go from the shared folder once the block has ended; those kept become scratch of the
    block around, if there is one. What a block returns may read kept tables only."""
    own = Scratch()
    _held.scratches.append(own)
    try:
        yield own
    finally:
        _held.scratches.remove(own)
        for path, spark in own.paths.items():
            if path not in own.kept:
                _delete(spark, path)
            elif _held.scratches:
                _held.scratches[-1].paths[path] = spark


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def cut(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Write df to the shared folder as Parquet and read it back: ends its lineage and survives lost executors. compression: the
    files' codec, such as zstd for texts."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    if _held.scratches:
        _held.scratches[-1].paths[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
