"""Scans over parts of a key's rows against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof, rules, tails
from tidemark.operators.scans import Ordered


def sequence(n=400, seed=3):
    """(key, order, value): a hot key, small keys, a null key; some null values."""
    rng = random.Random(seed)
    return [(rng.choice(["hot"] * 6 + ["a", "b", None]), i, rng.choice([None, *range(-9, 10)])) for i in rng.sample(range(10_000), n)]


def by_key(rows):
    keys = sorted({r[0] for r in rows}, key=str)
    return {k: sorted(r[1:] for r in rows if r[0] == k) for k in keys}


@pytest.mark.parametrize("part_rows", [1 << 20, 37, 3])
def test_running_values(spark, part_rows):
    rows = sequence()
    scan = Ordered(spark.createDataFrame(rows, "k string, i int, v int").repartition(5), ["k"], ["i"], part_rows)
    assert scan.split == (part_rows < 100)
    out = scan.running(scan.rows, before={"m": ("max", F.col("v")), "l": ("last", F.col("v"))}, upto={"s": ("sum", F.col("v")), "w": ("last", F.struct("v")), "x": ("min", F.col("v"))}).collect()
    got = {(r.k, r.i): (r.m, r.l, r.s, r.w.v, r.x) for r in out}
    assert len(got) == len(rows)
    for k, own in by_key(rows).items():
        for j, (i, v) in enumerate(own):
            past = [x for _, x in own[:j] if x is not None]
            upto = past + [v] * (v is not None)
            assert got[k, i] == (max(past, default=None), past[-1] if past else None, sum(upto) if upto else None, v, min(upto, default=None))
    if scan.split:
        assert scan.rows.where("k = 'hot'").select("part").distinct().count() > 5


def brute_drawdown(values):
    equity = peak = fall = 0
    for v in values:
        equity += v
        peak = max(peak, equity)
        fall = max(fall, peak - equity)
    return float(fall)


@pytest.mark.parametrize("part_rows", [1 << 20, 23, 1])
def test_drawdown_in_parts(spark, part_rows):
    rows = [(k, i, float(v)) for k, i, v in sequence(300, 8) if v is not None]
    df = spark.createDataFrame(rows, "k string, i int, v double")
    got = {r.k: r.d for r in tails.max_drawdown(df, ["k"], ["i"], "v", "d", part_rows).collect()}
    assert got == {k: brute_drawdown([v for _, v in own]) for k, own in by_key(rows).items()}
    whole = tails.max_drawdown(df, [], ["i"], "v", "d", part_rows).first().d  # one key of all rows
    assert whole == brute_drawdown([v for _, _, v in sorted(rows, key=lambda r: r[1])])
    assert tails.max_drawdown(df.limit(0), ["k"], ["i"], "v", "d", part_rows).collect() == []


@pytest.mark.parametrize("part_rows", [1 << 20, 11])
def test_order_and_chains_in_parts(spark, part_rows):
    rows = sequence(200, 5)
    df = spark.createDataFrame(rows, "k string, i int, v int")
    got = {r.k: (r.n_decreasing, r.n_not_increasing) for r in asof.order_violations(df, ["k"], "i", "v", part_rows).collect()}
    for k, own in by_key(rows).items():
        steps = [(a, b) for (_, a), (_, b) in zip(own, own[1:], strict=False) if a is not None and b is not None]
        assert got[k] == (sum(b < a for a, b in steps), sum(b <= a for a, b in steps))
    chain = [("c", i + 5, "GENESIS" if i == 0 else f"h{i - 1}", f"h{i}", f"h{i}") for i in range(100) if i != 60] + [("d", 5, "GENESIS", "x", "y")]
    chain[30] = ("c", 35, "false", "h30", "h30")
    df = spark.createDataFrame(chain, "k string, seq int, prev string, entry string, own string")
    got = {r.k: tuple(r)[1:] for r in rules.chain_breaks(df, ["k"], "seq", "prev", "entry", F.col("own"), "GENESIS", first=5, part_rows=part_rows).collect()}
    assert got == {"c": (99, 2, 1, 0), "d": (1, 0, 0, 1)}


def test_a_long_sequence_runs_in_all_tasks(spark):
    n = 300_000
    df = spark.range(n).select(F.col("id").alias("i"), F.when(F.col("id") % 7 < 4, 3).otherwise(-4).cast("long").alias("v"))
    scan = Ordered(df, [], ["i"], n // 12)
    parts = [r["count"] for r in scan.rows.groupBy("part").count().collect()]
    assert len(parts) >= 11 and max(parts) < n // 8
    assert tails.max_drawdown(df, [], ["i"], "v", "d", n // 12).first().d == brute_drawdown([3 if i % 7 < 4 else -4 for i in range(n)])
