"""Ordered, fail-closed rules: reason arrays, gates, states and hash chains as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.scans import PART_ROWS, Ordered
from tidemark.session import cut, scratch


def reasons(rules: list[tuple[Column, str | Column]]) -> Column:
    """The names of all rules that are broken, in their order. A rule whose condition is null is broken (fail closed)."""
    names = [F.when(F.coalesce(broken, F.lit(True)), name if isinstance(name, Column) else F.lit(name)) for broken, name in rules]
    return F.array_compact(F.array(*names))


def first_of(outcomes: list[tuple[Column, str]], otherwise: str) -> Column:
    """The outcome of the first condition that holds, in fixed precedence."""
    c = F.when(outcomes[0][0], F.lit(outcomes[0][1]))
    for condition, name in outcomes[1:]:
        c = c.when(condition, F.lit(name))
    return c.otherwise(otherwise)


def decision(reason: Column) -> Column:
    return F.when(F.size(reason) > 0, F.lit("NO_TRADE")).otherwise("WAIT")


def chain_breaks(
    ledger: DataFrame, keys: list[str], seq: str, previous: str, entry: str, recomputed: Column, genesis: str, first: int = 1, part_rows: int = PART_ROWS
) -> DataFrame:
    """Per ledger: entries, and how many break the chain: a wrong previous hash, a gap in the sequence (which begins with
    `first`), a wrong own hash. A chain of any length is checked in parts."""
    rows = ledger.select(*keys, F.col(seq).alias("__seq"), F.col(previous).alias("__previous"), F.col(entry).alias("__entry"), recomputed.alias("__own"))
    scan = Ordered(rows, keys, ["__seq"], part_rows)
    rows = scan.running(scan.rows, before={"__last": ("last", F.struct("__seq", "__entry"))})
    rows = rows.select(
        *keys, (F.col("__previous") != F.coalesce(F.col("__last.__entry"), F.lit(genesis))).cast("int").alias("link"),
        (F.col("__seq") != F.coalesce(F.col("__last.__seq") + 1, F.lit(first))).cast("int").alias("gap"), (F.col("__entry") != F.col("__own")).cast("int").alias("own"),
    )
    total = lambda c: F.sum(F.coalesce(F.col(c), F.lit(1))).cast("long")
    return rows.groupBy(*keys).agg(F.count("*").alias("entries"), total("link").alias("bad_links"), total("gap").alias("bad_sequence"), total("own").alias("bad_hashes"))


def lineage(rows: DataFrame, key: str, parent: str) -> DataFrame:
    """(key, ancestor, distance) over parent links, by doubling: as many joins as the longest line has binary digits. Raises if
    a key reaches itself. Each turn is written to the shared folder, where it ends the plan's growth."""
    with scratch() as tables:
        step = cut(rows.where(F.col(parent).isNotNull()).select(F.col(key).alias("k"), F.col(parent).alias("a"), F.lit(1).alias("d")))
        known, n = step, step.count()
        while True:
            if not known.where("k = a").isEmpty():
                raise ValueError("the lineage contains a cycle")
            more = known.alias("x").join(known.alias("y"), F.col("x.a") == F.col("y.k")).select(F.col("x.k").alias("k"), F.col("y.a").alias("a"), (F.col("x.d") + F.col("y.d")).alias("d"))
            known = cut(known.union(more).groupBy("k", "a").agg(F.min("d").alias("d")))
            before, n = n, known.count()
            if n == before:
                tables.keep(known)
                return known.select(F.col("k").alias(key), F.col("a").alias("ancestor"), F.col("d").alias("distance"))


def effective_status(items: DataFrame, changes: DataFrame, key: str, status: str, order: list[str], default: str, place: list[str] | None = None) -> DataFrame:
    """Each item with the last status that changes give it. Of changes alike in `order` the first by `place` counts; without
    place, any of them."""
    lately = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order], *(place or []))
    last = changes.withColumn("__n", F.row_number().over(lately)).where("__n = 1").select(key, F.col(status).alias("__s"))
    return items.join(last, key, "left").withColumn("effective_status", F.coalesce("__s", F.lit(default))).drop("__s")
