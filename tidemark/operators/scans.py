"""Running values over sequences of any length: a key's rows may be dealt to many tasks.

Rows are cut into ranges ("parts") of (keys, order). Within a part a running value is a window; what a part brings to those
after it is one summary row, and summaries are scanned by key. As parts are ranges, a part goes on with at most one key of
the part before it: what is carried into parts has at most one row a part.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut

#: Rows of a part, about. Keys of no more rows stay whole: one part each, without ranges.
PART_ROWS = 1 << 20
_OF = {"sum": F.sum, "max": F.max, "min": F.min, "last": lambda c: F.last(c, ignorenulls=True)}


class Ordered:
    """rows, written to the shared folder, with `part`, for scans by keys in the order of columns that tell a key's rows apart."""

    def __init__(self, rows: DataFrame, keys: list[str], order: list[str], part_rows: int = PART_ROWS):
        self.keys, self.order = keys, order
        rows = cut(rows)
        size = rows.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n"), F.sum("n")).first()
        self.split = (size[0] or 0) > part_rows
        if self.split:
            dealt = rows.repartitionByRange(math.ceil(size[1] / part_rows), *keys, *order)
            self.rows = cut(dealt.withColumn("part", F.spark_partition_id()))
        else:
            self.rows = rows.withColumn("part", F.lit(0))

    def window(self, upto: int = 0):
        """A part's rows of a key up to the current one (0) or the one before it (-1)."""
        return Window.partitionBy(*self.keys, "part").orderBy(*self.order).rowsBetween(Window.unboundedPreceding, upto)

    def over_parts(self, upto: int = -1):
        """A key's summaries up to the part before (-1)."""
        return Window.partitionBy(*self.keys).orderBy("part").rowsBetween(Window.unboundedPreceding, upto)

    def running(self, rows: DataFrame, before: dict[str, tuple[str, Column]] | None = None, upto: dict[str, tuple[str, Column]] | None = None) -> DataFrame:
        """rows (of this order, with more columns) with running values: name -> (sum, max, min or last, of a column). `before`: of the key's
        rows before each; `upto`: the row itself included. Nulls are passed over; where there is none the value is null."""
        scans = {**{n: (*x, -1) for n, x in (before or {}).items()}, **{n: (*x, 0) for n, x in (upto or {}).items()}}
        out = rows.select("*", *(_OF[kind](c).over(self.window(end)).alias(n) for n, (kind, c, end) in scans.items()))
        if not self.split:
            return out
        at = F.struct(*self.order)
        total = {n: F.max_by(c, F.when(c.isNotNull(), at)) if kind == "last" else _OF[kind](c) for n, (kind, c, _) in scans.items()}
        parts = rows.groupBy(*self.keys, "part").agg(*(c.alias(n) for n, c in total.items()), F.lit(True).alias("__some"))
        carried = parts.select(*(F.col(k).alias(f"__key_{k}") for k in self.keys), F.col("part").alias("__part"), *(_OF[kind](F.col(n)).over(self.over_parts()).alias(f"__{n}") for n, (kind, _, _) in scans.items()), F.lag("__some").over(Window.partitionBy(*self.keys).orderBy("part")).alias("__goes_on"))
        carried = F.broadcast(carried.where("__goes_on").drop("__goes_on"))  # at most one row a part
        same = F.col("part") == F.col("__part")
        for k in self.keys:
            same &= F.col(k).eqNullSafe(F.col(f"__key_{k}"))
        join = {"sum": lambda a, b: F.coalesce(a + b, a, b), "max": F.greatest, "min": F.least, "last": lambda a, b: F.coalesce(b, a)}
        joined = out.join(carried, same, "left")
        names = [c for c in out.columns if c not in scans]
        return joined.select(*names, *(join[kind](F.col(f"__{n}"), F.col(n)).alias(n) for n, (kind, _, _) in scans.items()))
