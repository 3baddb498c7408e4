"""Sums of doubles without any rounding but the last, in any partitioning: what math.fsum gives for a list.

A double is a whole number of up to 57 bits times a power of two. Whole numbers of one power are summed as decimals, with
map-side combine; only at the end, at most some 2,100 sums a key, one for each power, are added as fractions and rounded once.
"""

from __future__ import annotations

import math
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the whole number, over those of a double: the logarithm's whole part may be one too high.
_BITS = 54


def _power(exponent: Column) -> Column:
    """2 to a whole power from -1074 to 1023, exactly."""
    return F.pow(F.lit(2.0), exponent)


def _parts(value: Column, weight: Column) -> Column:
    """(e, m): value * weight = m * 2^e; for values that aren't finite m is null and e says which: 9999 NaN, 9998 infinity, 9997 its negative."""
    size = F.abs(value)
    # The logarithm of the smallest values is taken after scaling, and the scaling to a whole number is done in two steps.
    tiny = size < 1e-290
    top = F.floor(F.log2(F.when(tiny, size * _power(F.lit(200))).otherwise(size))).cast("int") - F.when(tiny, 200).otherwise(0)
    shift = F.lit(_BITS) - top
    half = F.floor(shift / 2).cast("int")
    whole = (value * _power(half) * _power(shift - half)).cast("decimal(20,0)")
    odd = F.when(F.isnan(value), 9999).when(value == math.inf, 9998).when(value == -math.inf, 9997)
    number = F.when(value == 0, F.struct(F.lit(0).alias("e"), F.lit(0).cast("decimal(38,0)").alias("m")))
    number = number.otherwise(F.struct((-shift).alias("e"), (whole * weight.cast("decimal(18,0)")).cast("decimal(38,0)").alias("m")))
    return F.when(odd.isNotNull(), F.struct(odd.alias("e"), F.lit(None).cast("decimal(38,0)").alias("m"))).otherwise(number)


def rounded(sums: list[tuple[int, int | None]]) -> float:
    """The double nearest to the sum of m * 2^e; what isn't finite goes as in IEEE sums, and a sum beyond the largest double is infinite."""
    odd = {e for e, m in sums if m is None}
    if odd:
        return math.nan if 9999 in odd or len(odd) > 1 else math.inf if 9998 in odd else -math.inf
    total = sum((Fraction(int(m)) * Fraction(2) ** int(e) for e, m in sums), Fraction(0))
    try:
        return float(total)
    except OverflowError:
        return math.inf if total > 0 else -math.inf


def exact_sums(rows: DataFrame, keys: list[str], values: dict[str, Column], weight: Column | None = None) -> DataFrame:
    """Per key: the sum of each column of doubles (times a whole weight of up to 18 digits), exact but for the last rounding; null without any
    value. Nulls, and rows whose weight is null, are passed over; null keys are a key; without keys there is one row, also
    of an empty table."""
    weight = F.lit(1) if weight is None else weight
    names = [*values]
    entries = [F.struct(F.lit(i).alias("__c"), v.cast("double").alias("__v"), weight.cast("long").alias("__w")) for i, v in enumerate(values.values())]
    long = rows.select(*keys, F.inline(F.array(*entries))).where("__v IS NOT NULL AND __w IS NOT NULL")
    parts = long.select(*keys, "__c", _parts(F.col("__v"), F.col("__w")).alias("__x")).select(*keys, "__c", F.col("__x.e").alias("__e"), F.col("__x.m").alias("__m"))
    sums = parts.groupBy(*keys, "__c", "__e").agg(F.sum("__m").alias("__m"))

    def finish(part: pa.Table) -> pa.Table:
        own: list[list[tuple[int, int | None]]] = [[] for _ in names]
        for i, e, m in zip(*(part[c].to_pylist() for c in ("__c", "__e", "__m")), strict=True):
            own[i].append((e, m))
        out = part.slice(0, 1).select(keys)
        for n, x in zip(names, own, strict=True):
            out = out.append_column(n, pa.array([rounded(x) if x else None], pa.float64()))
        return out

    kinds = ", ".join([f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys] + [f"`{n}` double" for n in names])
    found = sums.groupBy(*keys).applyInArrow(finish, kinds)
    if keys:
        every = rows.groupBy(*(F.col(k).alias(f"__key_{k}") for k in keys)).agg(F.lit(1).alias("__one"))
        same = F.lit(True)
        for k in keys:
            same &= F.col(f"__key_{k}").eqNullSafe(F.col(k))
        return every.join(found, same, "left").select(*(F.col(f"__key_{k}").alias(k) for k in keys), *names)
    return rows.sparkSession.range(1).join(found, F.lit(True), "left").select(*names)  # one row each
