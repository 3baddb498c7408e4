import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tidemark.operators.exact import exact_sums


def lists(seed):
    rng = random.Random(seed)
    wild = [1e300, -1e300, 1e-300, 5e-324, -5e-324, 1.7976931348623157e308, 0.1, -0.1, 1.0, 2.0**53, 1.5, -0.0, 2.2250738585072014e-308, 1e16, 3.0]
    out = {"cancel": [1e300, 1.0, -1e300, 1e-300], "tenths": [0.1] * 1000, "tiny": [5e-324] * 7 + [-5e-324] * 3, "null": [None, None], "zero": [0.0, -0.0], "over": [1.7e308, 1.7e308, -1.7e308]}
    for k in range(12):
        out[f"r{k}"] = [rng.choice([None, rng.choice(wild), rng.gauss(0, 1) * 10.0 ** rng.randrange(-320, 300), float(rng.randrange(-99, 99)), 2.0 ** rng.randrange(-1074, 1000)]) for _ in range(rng.randrange(1, 200))]
    return out


def whole(values):
    """What fsum gives where it doesn't overflow on its way."""
    values = [Fraction(x) for x in values if x is not None]
    try:
        return float(sum(values)) if values else None
    except OverflowError:
        return math.inf if sum(values) > 0 else -math.inf


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_fsum_in_any_partitioning(spark, seed):
    want = {k: whole(v) for k, v in lists(seed).items()}
    assert want["tenths"] == math.fsum([0.1] * 1000) and want["cancel"] == math.fsum(lists(seed)["cancel"])
    rows = [(k, x) for k, v in lists(seed).items() for x in v]
    random.Random(seed).shuffle(rows)
    for parts in (1, 7):
        got = exact_sums(spark.createDataFrame(rows, "k string, x double").repartition(parts), ["k"], {"s": F.col("x"), "minus": -F.col("x")}).collect()
        assert {r.k: r.s for r in got} == want
        assert all(r.minus == (None if r.s is None else -r.s) for r in got)


def test_what_is_not_finite_and_weights(spark):
    inf, nan = math.inf, math.nan
    rows = [("a", inf), ("a", 1.0), ("b", -inf), ("c", inf), ("c", -inf), ("d", nan), ("e", 1.7e308), ("e", 1.7e308), (None, 2.5)]
    got = {r.k: r.s for r in exact_sums(spark.createDataFrame(rows, "k string, x double"), ["k"], {"s": F.col("x")}).collect()}
    assert (got["a"], got["b"], got["e"], got[None]) == (inf, -inf, inf, 2.5) and math.isnan(got["c"]) and math.isnan(got["d"])
    df = spark.createDataFrame([(0.1, 10**12), (-0.3, 7), (5.0, None)], "x double, w long")
    assert exact_sums(df, [], {"s": F.col("x")}, F.col("w")).first().s == float(Fraction(0.1) * 10**12 + Fraction(-0.3) * 7)
    assert exact_sums(df.limit(0), [], {"s": F.col("x")}).first().s is None
    assert exact_sums(df.limit(0), ["w"], {"s": F.col("x")}).collect() == []
