"""As-of, reconciliation and gap operators over keyed, time-ordered tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.scans import PART_ROWS, Ordered


def latest_per_key(rows: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """The values of each key's last row by `order`, as they stand (a null or crossed latest value hides earlier good
    ones). One hash aggregation with map-side combine; no sort."""
    last = F.max_by(F.struct(*values), F.struct(*order))
    return rows.groupBy(*keys).agg(last.alias("last")).select(*keys, *(F.col(f"last.{v}").alias(v) for v in values))


def asof_backward(left: DataFrame, right: DataFrame, keys: list[str], ts: str, values: list[str], order: str, bucket: Column | None = None, spread: Column | None = None) -> DataFrame:
    """Each left row with the values of the latest right row of the same key at or before its time.

    Both sides go through one exchange and one sort: a union in which right rows carry a struct and a window carries the
    last struct on. Struct nulls are skipped, nulls within it aren't. `bucket` (a column over both sides, such as the
    day) splits hot keys where an as-of match never has to look beyond its bucket. `spread` (such as the day, too) splits
    them where it has to: each part carries its last struct on to the key's later parts, by one row a part.
    """
    none = F.lit(None)
    r = right.select(*keys, F.col(ts), F.lit(0).alias("__left"), F.col(order).alias("__order"), F.struct(*values).alias("__v"))
    shape = r.schema["__v"].dataType
    own = [c for c in left.columns if c not in (*keys, ts)]
    l_ = left.select(*keys, F.col(ts), F.lit(1).alias("__left"), none.cast("long").alias("__order"), none.cast(shape).alias("__v"), F.struct(*own).alias("__own") if own else none.cast("boolean").alias("__own"))
    r = r.withColumn("__order", F.col("__order").cast("long")).withColumn("__own", none.cast(l_.schema["__own"].dataType))
    rows = l_.unionByName(r)
    if spread is not None:
        rows = rows.withColumn("__part", spread)
    parts = [*keys, *([bucket] if bucket is not None else []), *(["__part"] if spread is not None else [])]
    w = Window.partitionBy(*parts).orderBy(ts, "__left", "__order").rowsBetween(Window.unboundedPreceding, 0)
    got = rows.withColumn("__last", F.last("__v", ignorenulls=True).over(w)).where("__left = 1")
    if spread is not None:
        ends = rows.groupBy(*keys, "__part").agg(F.max_by("__v", F.when(F.col("__left") == 0, F.struct(ts, "__order"))).alias("__end"))
        before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.select(*keys, "__part", F.last("__end", ignorenulls=True).over(before).alias("__carry"))
        same = F.lit(True)
        for c in (*keys, "__part"):
            same = same & F.col(f"l.{c}").eqNullSafe(F.col(f"c.{c}"))
        got = got.alias("l").join(carried.alias("c"), same, "left").select("l.*", F.coalesce("l.__last", "c.__carry").alias("__found")).withColumn("__last", F.col("__found"))
    return got.select(*keys, ts, *(F.col("__own").getField(c).alias(c) for c in own), *(F.col("__last").getField(v).alias(v) for v in values))


def strict_prior(days: DataFrame, day: str = "day") -> DataFrame:
    """Each distinct day with the nearest earlier one in the same table. The table is a calendar: one row a day."""
    return days.select(day).distinct().withColumn("prior_day", F.lag(day).over(Window.orderBy(day)))


def reconcile(left: DataFrame, right: DataFrame, key: str, left_name: str, right_name: str) -> DataFrame:
    """Full outer join on a unique key with a disposition of every row, so that nothing disappears."""
    a, b = left.withColumn("__l", F.lit(True)), right.withColumn("__r", F.lit(True))
    which = F.when(F.col("__l").isNull(), F.lit(f"MISSING_{left_name}")).when(F.col("__r").isNull(), F.lit(f"MISSING_{right_name}")).otherwise("JOINED")
    return a.join(b, key, "full").withColumn("disposition", which).drop("__l", "__r")


def absent(expected: DataFrame, recorded: DataFrame, key: str) -> DataFrame:
    """Expected keys that aren't recorded (also the skip of what is already present, the other way round)."""
    return expected.join(recorded.select(key).distinct(), key, "left_anti")


def coverage_gaps(rows: DataFrame, keys: list[str], ts: str, limit_seconds: int) -> DataFrame:
    """Per key: number of rows, largest gap between neighbours in seconds, and whether it keeps to the limit."""
    before = F.lag(ts).over(Window.partitionBy(*keys).orderBy(ts))
    gap = F.unix_seconds(F.col(ts).cast("timestamp")) - F.unix_seconds(before.cast("timestamp"))
    found = rows.withColumn("gap", gap).groupBy(*keys).agg(F.count("*").alias("n_rows"), F.coalesce(F.max("gap"), F.lit(0)).alias("max_gap"))
    return found.withColumn("covered", F.col("max_gap") <= limit_seconds)


def order_violations(rows: DataFrame, keys: list[str], seq: str, ts: str, part_rows: int = PART_ROWS) -> DataFrame:
    """Per key: rows that step back in time, and rows that don't step forward; seq tells a key's rows apart."""
    scan = Ordered(rows.select(*keys, seq, F.col(ts).alias("__ts")), keys, [seq], part_rows)
    stepped = scan.running(scan.rows, before={"__last": ("last", F.struct("__ts"))})
    before = F.col("__last.__ts")
    stepped = stepped.withColumn("back", (F.col("__ts") < before).cast("int")).withColumn("flat", (F.col("__ts") <= before).cast("int"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return stepped.groupBy(*keys).agg(total("back").alias("n_decreasing"), total("flat").alias("n_not_increasing"))


def latest_revision(records: DataFrame, key: str, as_of: Column, visible_by: str, order: list[str]) -> DataFrame:
    """The point-in-time view: of the records visible at as_of, the last revision of each key."""
    seen = records.where(F.col(visible_by) <= as_of)
    return latest_per_key(seen, [key], order, [c for c in records.columns if c != key])


def after_cursor(events: DataFrame, cursors: DataFrame, keys: list[str], seq: str, cursor: str) -> DataFrame:
    """Every event whose seq is above its key's cursor, without a limit or an upper bound; a key without a cursor (or with
    a null one) starts at the beginning. cursors: one row a key."""
    rows = events.join(cursors.select(*keys, F.col(cursor).alias("__after")), keys, "left")
    return rows.where(F.col("__after").isNull() | (F.col(seq) > F.col("__after"))).select(*events.columns)
