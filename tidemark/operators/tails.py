"""Conservative quantiles, tail losses, drawdowns, corridors and walk-forward folds."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.exact import exact_sums
from tidemark.operators.scans import PART_ROWS, Ordered
from tidemark.session import cut


def quantile_higher(value: str, q: float) -> Column:
    """The smallest value with at least a share q of the values at or below it."""
    return F.expr(f"percentile_disc({q!r}D) WITHIN GROUP (ORDER BY {value})")


#: Distinct values of a key that one window orders; more are halved by their own quantiles first.
MOST_VALUES = 1 << 18
#: Accuracy of the quantile sketches (a rank is known to n / ACCURACY), and keys of so few rows that they need none.
ACCURACY, FEW = 10_000, 4096
_GRID = 64
#: Rows that are counted by their values straight away.
DIRECT_ROWS = 1 << 16


def beside(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """left with the columns of right (one row a key); null keys are a key."""
    if not keys:
        return left.crossJoin(F.broadcast(right))  # one row
    renamed = right.withColumnsRenamed({k: f"__key_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"__key_{k}"))
    return left.join(renamed, same).drop(*(f"__key_{k}" for k in keys))


def _around(rows: DataFrame, keys: list[str], value: str, rank: Callable[[Column], Column], share: float | None = None) -> DataFrame:
    """Per key the counts __c of the distinct values __v around the rank-th smallest, with the key's number of values __n, the rank __k, and
    the number __upto and the sum __sum (of decimals) of values before these. Written; rows are read twice.

    Mergeable sketches bracket the rank; what lies before the bracket is one counted row. Should the rank not lie in the
    bracket (a function that isn't a share of n), all values of the key count as bracket. share: of n, that the rank is about.
    Of few rows all values are the bracket, without sketches.
    """
    rows = rows.select(*keys, F.col(value).alias("__v")).where("__v IS NOT NULL")
    if rows.count() <= DIRECT_ROWS:
        counts = rows.groupBy(*keys, "__v").agg(F.count("*").alias("__c"))
        counts = counts.withColumn("__n", F.sum("__c").over(Window.partitionBy(*keys)))
        none = F.sum(_summed(rows, F.col("__v")) * F.col("__c")).over(Window.partitionBy(*keys)) * 0  # of the sums' type
        return counts.withColumns({"__k": rank(F.col("__n")), "__upto": F.lit(0).cast("long"), "__sum": none})
    if share is None:
        share = rows.sparkSession.range(1).select((rank(F.lit(10**12)) / 10**12).alias("s")).first().s
    ends = [max(0.0, share - 10 / ACCURACY), min(1.0, share + 10 / ACCURACY)]
    stats = rows.groupBy(*keys).agg(
        F.count("*").alias("__n"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"), F.percentile_approx("__v", ends, ACCURACY).alias("__p")
    )
    few = F.col("__n") <= FEW
    stats = stats.select(*keys, "__n", rank(F.col("__n")).alias("__k"), *(F.when(few, F.col(f"__{e}")).otherwise(F.col("__p")[i]).alias(f"__{e}") for i, e in enumerate(("lo", "hi"))))
    total = F.sum(_summed(rows, F.col("__v")))

    def counted(bracket: DataFrame) -> DataFrame:
        kept = beside(rows, bracket, keys).where(F.col("__v") <= F.col("__hi"))
        inside = F.when(F.col("__v") >= F.col("__lo"), F.col("__v"))
        return cut(kept.groupBy(*keys, "__n", "__k", inside.alias("__v")).agg(F.count("*").alias("__c"), total.alias("__s")))

    def met(found: DataFrame) -> DataFrame:
        first = lambda c: F.coalesce(F.sum(F.when(F.col("__v").isNull(), F.col(c))).over(Window.partitionBy(*keys)), F.lit(0).cast(found.schema[c].dataType))
        own = F.count("__v").over(Window.partitionBy(*keys))
        return found.withColumns({"__upto": first("__c"), "__sum": first("__s"), "__m": own, "__all": F.sum("__c").over(Window.partitionBy(*keys))})

    found = counted(stats)
    out = F.col("__k").between(F.col("__upto") + 1, F.col("__all"))
    n_missed, most = met(found).agg(F.count_if(~out), F.max("__m")).first()
    if n_missed:
        missed = met(found).where(~out).select(*keys, "__n", "__k").distinct()
        whole = rows.groupBy(*keys).agg(F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
        found = cut(_without(found, missed, keys).unionByName(counted(beside(whole, missed, keys))))
        most = met(found).agg(F.max("__m")).first()[0]
    values = met(found).where("__v IS NOT NULL").drop("__all", "__s")
    while (most or 0) > MOST_VALUES:
        values = cut(values.where(F.col("__m") <= MOST_VALUES).unionByName(_halved(values.where(F.col("__m") > MOST_VALUES), keys)))
        most = values.agg(F.max("__m")).first()[0]
    return values.drop("__m")


def _summed(rows: DataFrame, value: Column) -> Column:
    """What sums are made of: a decimal itself; nothing for doubles, whose exact sums are another's work."""
    return value if isinstance(rows.schema["__v"].dataType, T.DecimalType) else F.lit(0)


def _without(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    marked = gone.select(*(F.col(k).alias(f"__key_{k}") for k in keys), F.lit(True).alias("__gone"))
    same = F.col("__gone")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"__key_{k}"))
    return rows.join(marked, same, "left_anti")


def _halved(values: DataFrame, keys: list[str]) -> DataFrame:
    """Of keys with many distinct values around the rank: those of one of some 64 equal shares of them, in which the rank lies."""
    bounds = values.groupBy(*keys).agg(F.percentile_approx("__v", [i / _GRID for i in range(1, _GRID)], 1000).alias("__g"))
    binned = beside(values, bounds, keys).withColumn("__bin", F.size(F.filter("__g", lambda b: b < F.col("__v")))).drop("__g")
    part = _summed(values, F.col("__v")) * F.col("__c")
    counts = binned.groupBy(*keys, "__bin").agg(F.sum("__c").alias("__cs"), F.sum(part).alias("__ss"), F.count("*").alias("__own"), *(F.first(f"__{c}").alias(f"__first_{c}") for c in ("upto", "sum", "k")))
    before = Window.partitionBy(*keys).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    new = {f"__new_{c}": (F.col(f"__first_{c}") + F.coalesce(F.sum(x).over(before), F.lit(0))).cast(values.schema[f"__{c}"].dataType) for c, x in (("upto", "__cs"), ("sum", "__ss"))}
    counts = counts.withColumns(new).where("__new_upto < __first_k AND __new_upto + __cs >= __first_k")
    picked = beside(binned, counts.select(*keys, F.col("__bin").alias("__pick"), *new, "__own"), keys).where("__bin = __pick")
    kept = {"__upto": F.col("__new_upto"), "__sum": F.col("__new_sum"), "__m": F.col("__own")}
    return picked.withColumns(kept).select(*values.columns)


def _at_rank(values: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: __n, __k, the rank-th smallest value __v, and the number __below and sum __sum of the key's values before it."""
    w = Window.partitionBy(*keys).orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0)
    part = F.coalesce(F.sum(_summed(values, F.col("__v")) * F.col("__c")).over(w), none)
    values = values.withColumns({"__below": F.col("__upto") + F.coalesce(F.sum("__c").over(w), none), "__sum": F.col("__sum") + part})
    return values.where((F.col("__below") < F.col("__k")) & (F.col("__below") + F.col("__c") >= F.col("__k"))).select(*keys, "__n", "__k", "__v", "__below", "__sum")


def kth_smallest(rows: DataFrame, keys: list[str], value: str, rank: Callable[[Column], Column], name: str, share: float | None = None) -> DataFrame:
    """Per key, its number of values n and the rank-th smallest one; rank: a function of n, best a share of it. Nulls count nowhere.

    Exact, however the values lie: only the values around the rank, which sketches of the values themselves bracket, are
    counted apart and ordered, at most MOST_VALUES of a key. rows are read twice.
    """
    found = _at_rank(_around(rows, keys, value, rank, share), keys)
    return found.select(*keys, F.col("__n").alias("n"), F.col("__v").alias(name))


def worst_mean(rows: DataFrame, keys: list[str], value: str, share: float, tie: str, name: str) -> DataFrame:
    """Mean of the worst max(1, ceil(n * share)) values of each key. Nulls count nowhere. Sums are exact: of decimals as decimals, of doubles
    but for the last rounding (for which rows are read a third time). Rows are neither sorted nor held."""
    edge = _at_rank(_around(rows, keys, value, lambda n: F.greatest(F.lit(1), F.ceil(n * F.lit(share))), share), keys)
    if isinstance(edge.schema["__v"].dataType, T.DecimalType):
        total = F.col("__sum") + F.col("__v") * (F.col("__k") - F.col("__below"))
        return edge.select(*keys, (total.cast("double") / F.col("__k")).alias(name))
    edge = cut(edge)
    rows = rows.select(*keys, F.col(value).alias("__x"))
    below = beside(rows, edge.select(*keys, "__v"), keys).where("__x < __v").select(*keys, "__x", F.lit(1).cast("long").alias("__w"))
    last = edge.select(*keys, F.col("__v").alias("__x"), (F.col("__k") - F.col("__below")).cast("long").alias("__w"))
    total = exact_sums(below.unionByName(last), keys, {"__total": F.col("__x")}, F.col("__w"))
    return beside(total, edge.select(*keys, "__k"), keys).select(*keys, (F.col("__total") / F.col("__k")).alias(name))


def weighted_tail_loss(rows: DataFrame, keys: list[str], pnl: str, probability: str, tail: float, name: str) -> DataFrame:
    """Expected loss of the worst scenarios up to a mass of `tail`: their signed results count with what of the mass is left,
    gains too, and only the whole is floored at 0."""
    kind = rows.schema[probability].dataType  # decimals stay exact
    w = Window.partitionBy(*keys).orderBy(pnl, probability).rowsBetween(Window.unboundedPreceding, -1)
    used = F.least(F.col(probability), F.greatest(F.lit(0).cast(kind), F.lit(tail).cast(kind) - F.coalesce(F.sum(probability).over(w), F.lit(0).cast(kind)))).cast(kind)
    total = F.sum(F.col(pnl) * F.col("used")).cast("double")
    return rows.withColumn("used", used).groupBy(*keys).agg(F.greatest(F.lit(0.0), -total / F.lit(tail)).alias(name))


def max_drawdown(rows: DataFrame, keys: list[str], order: list[str], pnl: str, name: str, part_rows: int = PART_ROWS) -> DataFrame:
    """Largest fall of the running sum below its running maximum, both from 0; order tells a key's rows apart. One key's rows
    may be any number, without a key too: each part of them is summed up as its sum, highest and lowest running sum and largest fall."""
    scan = Ordered(rows.select(*keys, *order, F.col(pnl).alias("__pnl")), keys, order, part_rows)
    own = scan.rows.withColumn("__e", F.sum("__pnl").over(scan.window()))
    own = own.withColumn("__fall", F.max("__e").over(scan.window()) - F.col("__e"))
    parts = own.groupBy(*keys, "part").agg(F.sum("__pnl").alias("__sum"), F.max("__e").alias("__high"), F.min("__e").alias("__low"), F.max("__fall").alias("__fall"))
    zero = F.lit(0).cast(own.schema["__e"].dataType)
    parts = parts.withColumn("__base", F.coalesce(F.sum("__sum").over(scan.over_parts()), zero))
    peak = F.coalesce(F.greatest(zero, F.max(F.col("__base") + F.col("__high")).over(scan.over_parts())), zero)
    parts = parts.withColumn("__worst", F.greatest(peak - F.col("__base") - F.col("__low"), F.col("__fall")))
    return parts.groupBy(*keys).agg(F.greatest(F.lit(0.0), F.max("__worst").cast("double")).alias(name))


def joint_corridor(rows: DataFrame, up: str, down: str, target: float) -> DataFrame:
    """Marginal quantiles of both sides, and one conformal buffer that makes the share covered on both sides at once
    reach the target. One row. rows are read once."""
    rows = cut(rows.select(F.col(up).alias("up"), F.col(down).alias("down")))
    sides = rows.select(F.inline(F.array(*(F.struct(F.lit(c).alias("side"), F.col(c).alias("x")) for c in ("up", "down")))))
    higher = kth_smallest(sides, ["side"], "x", lambda n: F.greatest(F.lit(1), F.ceil(n * F.lit(target))), "q", target)
    m = higher.agg(*(F.max(F.when(F.col("side") == c, F.col("q"))).alias(f"{c}_q") for c in ("up", "down")))  # one row
    miss = F.greatest(F.lit(0.0), F.col("up") - F.col("up_q"), F.col("down") - F.col("down_q"))
    scored = rows.crossJoin(F.broadcast(m)).select(miss.alias("miss"))
    rank = lambda n: F.least(n, F.ceil((n + 1) * F.lit(target)))
    return m.crossJoin(kth_smallest(scored, [], "miss", rank, "buffer", target)).select("up_q", "down_q", "n", "buffer")


def buffer_grid(rows: DataFrame, up: str, down: str, up_q: float, down_q: float, target: float, step: float, steps: int) -> DataFrame:
    """The cheapest pair of buffers (least sum, then least up) of a grid for which the joint coverage reaches target.

    A row isn't expanded over the grid: it falls into the one cell of the least buffers that cover it, and two cumulative
    sums over the (steps + 1)^2 cells count the rows covered by every pair.
    """
    cell = lambda c, q: F.greatest(F.lit(0), F.ceil((F.col(c) - F.lit(q)) / F.lit(step))).cast("int")
    cells = rows.groupBy(cell(up, up_q).alias("u"), cell(down, down_q).alias("d")).agg(F.count("*").alias("c"))
    spark = rows.sparkSession
    grid = spark.range(steps + 1).select(F.col("id").cast("int").alias("u"), F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("d"))
    full = grid.join(cells, ["u", "d"], "left").withColumn("c", F.coalesce("c", F.lit(0)))
    first = full.withColumn("x", F.sum("c").over(Window.partitionBy("u").orderBy("d")))
    both = first.withColumn("covered", F.sum("x").over(Window.partitionBy("d").orderBy("u")))
    n = rows.agg(F.count("*").alias("n"))
    good = both.crossJoin(F.broadcast(n)).where(F.col("covered") >= F.lit(target) * F.col("n"))
    least = F.min(F.struct((F.col("u") + F.col("d")).alias("s"), "u", "d", "covered"))
    best = good.groupBy("n").agg(least.alias("b"))
    return best.select("n", (F.col("b.u") * F.lit(step)).alias("up_buffer"), (F.col("b.d") * F.lit(step)).alias("down_buffer"), F.col("b.covered").alias("covered"))


def quartile_regime(value: str, cuts: list[Column], missing: str = "UNKNOWN") -> Column:
    """IV_Q1 to IV_Q4 by three cuts; a value on a cut belongs to the upper bucket."""
    c = F.when(F.col(value).isNull(), F.lit(missing))
    for k, cut in enumerate(cuts, 1):
        c = c.when(F.col(value) < cut, F.lit(f"IV_Q{k}"))
    return c.otherwise("IV_Q4")


def _folds(samples: DataFrame, group: str, at: str, min_train: int, test_groups: int, gap_days: int, step_groups: int | None) -> tuple[DataFrame, DataFrame]:
    """(samples with the rank of their group and the folds that they are tested in (__tests) and might train for (__trains), folds): fold f tests
    ranks [least, least + test_groups) from test_start; its training groups have a lower rank and its training samples were observed
    before `cut`."""
    step = step_groups or test_groups
    if min(min_train, test_groups, step) <= 0 or gap_days < 0:
        raise ValueError("groups must be positive, and the gap not negative")
    groups = samples.groupBy(group).agg(F.min(at).alias("first_at"))
    ranked = groups.withColumn("rank", F.row_number().over(Window.orderBy("first_at", group)) - 1)  # one row a group
    last = F.floor((F.col("__n") - (min_train + test_groups)) / step)
    ranked = ranked.crossJoin(F.broadcast(groups.agg(F.count("*").alias("__n"))))  # one row
    after = F.floor((F.col("rank") - min_train) / step)
    tested = F.greatest(F.lit(0), F.ceil((F.col("rank") - (min_train + test_groups - 1)) / step)), F.least(last, after)
    trained = F.greatest(F.lit(0), after + 1), last
    spans = {name: F.when(a <= b, F.sequence(a, b)) for name, (a, b) in (("__tests", tested), ("__trains", trained))}
    ranked = ranked.select(group, "first_at", "rank", *(c.alias(n) for n, c in spans.items()))
    first = ranked.select(F.explode("__tests").alias("fold"), "first_at").groupBy("fold").agg(F.min("first_at").alias("test_start"))
    folds = first.select("fold", (F.lit(min_train) + F.col("fold") * step).alias("least"), "test_start", (F.col("test_start") - F.expr(f"INTERVAL {gap_days} DAYS")).alias("cut"))
    return samples.join(ranked.drop("first_at"), group), folds


def fold_members(samples: DataFrame, group: str, at: str, min_train: int, test_groups: int, gap_days: int, step_groups: int | None = None) -> DataFrame:
    """(fold, role TEST or TRAIN, the sample's columns): purged expanding folds with their members. A training sample is a member
    of every later fold, as the method has it: rows grow with the number of folds, so use walk_forward_folds for counts."""
    rows, folds = _folds(samples, group, at, min_train, test_groups, gap_days, step_groups)
    test = rows.select(F.explode("__tests").alias("fold"), F.lit("TEST").alias("role"), *samples.columns)
    train = rows.select(F.explode("__trains").alias("fold"), *samples.columns).join(folds.select("fold", F.col("cut").alias("__cut")), "fold").where(F.col(at) < F.col("__cut"))
    return test.unionByName(train.select("fold", F.lit("TRAIN").alias("role"), *samples.columns))


def walk_forward_folds(samples: DataFrame, group: str, at: str, min_train: int, test_groups: int, gap_days: int, step_groups: int | None = None) -> DataFrame:
    """(fold, test_start, test_end, n_test, n_train) with purging: groups are ranked by their first time; fold f tests
    test_groups of them from min_train + f * step_groups on, and trains on earlier groups' samples observed strictly before
    the first test time less the gap. A fold whose purge leaves no training sample fails the job."""
    rows, folds = _folds(samples, group, at, min_train, test_groups, gap_days, step_groups)
    # By counts of each rank and time: no sample is expanded over the folds.
    daily = rows.groupBy("__tests", "__trains", F.col(at).alias("at")).agg(F.count("*").alias("c"))
    tested = daily.select(F.explode("__tests").alias("fold"), "at", "c").groupBy("fold").agg(F.max("at").alias("test_end"), F.sum("c").alias("n_test"))
    met = daily.select(F.explode("__trains").alias("fold"), "at", "c").join(folds.select("fold", "cut"), "fold").where("at < cut")
    trained = met.groupBy("fold").agg(F.sum("c").alias("n_train"))
    out = folds.select("fold", "test_start").join(tested, "fold").join(trained, "fold", "left")
    enough = F.when(F.col("n_train") > 0, F.col("n_train")).otherwise(F.raise_error(F.lit("the purge gap leaves a fold without training samples")).cast("long"))
    return out.withColumn("n_train", enough)


def _in_ranges(bounds: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = pa.array(np.searchsorted(bounds, batch["v"].to_numpy(), side="right").astype(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, part], ["t", "v", "c", "part"])

    return run


def _ranked(gap_days: int):
    """Of one value range: the value at rank k among the pairs (t, v, c) up to gap_days before each asked t, by a wavelet
    matrix over the pairs in order of t."""

    def run(asked: pa.Table, pairs: pa.Table) -> pa.Table:
        pairs = pairs.sort_by("t")
        t, v, w = (pairs[c].to_numpy() for c in ("t", "v", "c"))
        values, rank = np.unique(v, return_inverse=True)
        k, end = asked["k"].to_numpy(), np.searchsorted(t, asked["t"].to_numpy() - gap_days, side="right")
        begin, found = np.zeros(len(k), np.int64), np.zeros(len(k), np.int64)
        for bit in reversed(range(max(0, len(values) - 1).bit_length())):
            low = (rank >> bit) & 1 == 0
            place, weight = (np.concatenate([[0], np.cumsum(x)]) for x in (low, np.where(low, w, 0)))
            below = weight[end] - weight[begin]
            left = k <= below
            k, found = np.where(left, k, k - below), found | (~left).astype(np.int64) << bit
            begin, end = (np.where(left, place[x], place[-1] + x - place[x]) for x in (begin, end))
            order = np.argsort(~low, kind="stable")
            rank, w = rank[order], w[order]
        q = values[found] if len(k) else np.zeros(0)
        return pa.table({"t": asked["t"], "n_train": asked["n_train"], "q": pa.array(q, pa.float64())})

    return run


def expanding_quantile(rows: DataFrame, day: str, value: str, q: float, gap_days: int, range_pairs: int = 65_536) -> DataFrame:
    """For every day, the number of values up to gap_days before it and their higher quantile, as a double (null before the
    first). A day may have any number of rows; null values, and values of a null day, count nowhere.

    Values are counted by day and dealt by value into ranges of about range_pairs such counts. Cumulative counts of each
    range show in which range a day's rank falls; only there are values compared.
    """
    t = F.datediff(F.col(day), F.lit("1970-01-01")).alias("t")
    days = rows.select(day).distinct().select(day, t)
    pairs = cut(rows.where(F.col(day).isNotNull() & F.col(value).isNotNull()).groupBy(t, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c")))
    n, n_days = pairs.agg(F.count("*"), F.count_distinct("t")).first()
    ranges = max(1, math.ceil(n / max(range_pairs, n_days)))  # so that there are no more (range, day) than counts
    bounds = pairs.approxQuantile("v", [k / ranges for k in range(1, ranges)], 0.1 / ranges) if ranges > 1 else []
    pairs = cut(pairs.mapInArrow(_in_ranges(np.unique(bounds)), "t int, v double, c long, part long"))
    counts = pairs.groupBy("part", "t").agg(F.sum("c").alias("c"))
    grid = days.select("t").where("t IS NOT NULL").distinct().crossJoin(pairs.select("part").distinct()).join(counts, ["part", "t"], "left")
    past = Window.partitionBy("part").orderBy("t").rangeBetween(Window.unboundedPreceding, -gap_days)
    sums = grid.select("part", "t", F.coalesce(F.sum("c").over(past), F.lit(0)).alias("x"))
    upto = Window.partitionBy("t").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.withColumn("upto", F.sum("x").over(upto)).withColumn("n_train", F.sum("x").over(Window.partitionBy("t")))
    sums = sums.withColumn("k", F.greatest(F.lit(1), F.ceil(F.col("n_train") * F.lit(q))) - F.col("upto") + F.col("x"))
    asked = sums.where("k BETWEEN 1 AND x").select("part", "t", "n_train", "k")
    found = asked.groupBy("part").cogroup(pairs.select(F.col("part").alias("of"), "t", "v", "c").groupBy("of")).applyInArrow(_ranked(gap_days), "t int, n_train long, q double").withColumnRenamed("t", "at")
    return days.join(found, F.col("t") == F.col("at"), "left").select(day, F.coalesce("n_train", F.lit(0)).alias("n_train"), "q")


def conformal_rank(n: int, target: float) -> int:
    return min(n, math.ceil((n + 1) * target))
