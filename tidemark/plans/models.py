"""Extension points: decision models, detectors, senders and sources as named functions of DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from tidemark.operators import gates


@dataclass(frozen=True)
class Descriptor:
    """Who a model or detector is; universe: the targets of a detector."""

    name: str
    version: str
    artifact_hash: str
    universe: tuple[str, ...] = ()

    @property
    def identity(self) -> str:
        return f"{self.name}@{self.version}#{self.artifact_hash}"


@dataclass
class Registry:
    """Functions by unique names. A decision model is a column over the snapshot's columns; a detector turns inputs into
    candidates (any number a row); a sender turns due messages into outcomes; a source gives a day's table."""

    known: dict[str, tuple[Descriptor, Callable]] = field(default_factory=dict)

    def register(self, descriptor: Descriptor, run: Callable) -> None:
        if not descriptor.name.strip() or descriptor.name in self.known:
            raise ValueError(f"the name {descriptor.name!r} is blank or taken")
        self.known[descriptor.name] = (descriptor, run)

    def get(self, name: str) -> tuple[Descriptor, Callable]:
        if name not in self.known:
            raise KeyError(f"unknown model: {name}")
        return self.known[name]

    def decide(self, name: str, snapshots: DataFrame, required: Column | None = None) -> DataFrame:
        """snapshots with reasons, action, output and the model's identity: the model only speaks where no gate is shut."""
        descriptor, model = self.get(name)
        loaded = F.lit(descriptor.identity)
        rows = gates.decide(snapshots, model(), required, loaded)
        return rows.withColumn("model", loaded)

    def register_rows(self, spark: SparkSession, descriptor: Descriptor, detect: Callable[[dict[str, Any]], Iterable[tuple]], reads: list[str], gives: str) -> None:
        """Registers a detector that finds any number of candidates in one row as a table function of its name, for SQL and lateral joins:

            SELECT t.id, d.* FROM t, LATERAL name(t.a, t.b) d          one argument for each column of `reads`, in order
            SELECT * FROM name(TABLE(t) PARTITION BY k)                a table that has these columns

        gives: the columns of a candidate, to which `detector`, the identity, is added. Rows travel in Arrow batches.
        """
        self.register(descriptor, detect)
        spark.udtf.register(descriptor.name, F.udtf(row_detector(descriptor.identity, detect, reads, gives), useArrow=True))

    def detect(self, name: str, inputs: DataFrame, inferred_kinds: tuple[str, ...] = ()) -> DataFrame:
        """The detector's candidates with what forbids them and their identities."""
        descriptor, detector = self.get(name)
        found = detector(inputs).withColumns({"detector_id": F.lit(descriptor.name), "detector_version": F.lit(descriptor.version)})
        universe = F.array(*(F.lit(t) for t in descriptor.universe)).cast("array<string>")
        return found.withColumn("violations", gates.candidate_violations(universe, inferred_kinds)).withColumn("candidate_id", gates.candidate_id())


def row_detector(identity: str, detect: Callable[[dict[str, Any]], Iterable[tuple]], reads: list[str], gives: str) -> type:
    """The handler of a table function: checks what it is called with, and hands rows to `detect` as dicts."""
    schema = StructType.fromDDL(gives).add("detector", StringType())

    class Handler:
        @staticmethod
        def analyze(*args: AnalyzeArgument) -> AnalyzeResult:
            if len(args) == 1 and args[0].isTable:
                if missing := sorted(set(reads) - set(args[0].dataType.names)):
                    raise ValueError(f"missing columns: {', '.join(missing)}")
            elif len(args) != len(reads):
                raise ValueError(f"the detector reads {', '.join(reads)}")
            return AnalyzeResult(schema=schema)

        def eval(self, *args: Any) -> Iterable[tuple]:
            row = args[0].asDict() if isinstance(args[0], Row) else dict(zip(reads, args, strict=True))
            for found in detect(row):
                yield (*found, identity)

    return Handler


def null_sender(messages: DataFrame) -> DataFrame:
    """Sends nothing: every message fails for good."""
    return messages.select("message_id", F.lit("PERMANENT_FAILURE").alias("outcome"), F.lit("NO_SENDER").alias("reason"))


def scripted_sender(outcomes: dict[str, str]) -> Callable[[DataFrame], DataFrame]:
    """A sender with a given outcome for each message, for tests: others fail for a while."""

    def send(messages: DataFrame) -> DataFrame:
        given = F.try_element_at(F.create_map(*(F.lit(x) for kv in outcomes.items() for x in kv)), F.col("message_id")) if outcomes else F.lit(None).cast("string")
        return messages.select("message_id", F.coalesce(given, F.lit("TRANSIENT_FAILURE")).alias("outcome"), F.lit(None).cast("string").alias("reason"))

    return send
