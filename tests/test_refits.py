"""Daily refits against the models fitted day by day."""

import datetime as dt
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import refits
from tidemark.operators.workflows import TailModel

KINDS = ("unconditional", "iv_regime", "buffered", "buffered_iv")


@pytest.mark.parametrize("dims", [1, 2, 3, 4])
def test_counts_equal_loops(dims):
    rng = np.random.default_rng(dims)
    for n in (0, 1, 2, 37, 200):
        points = [np.arange(n), *(rng.integers(0, rng.integers(1, 40), n) for _ in range(dims - 1))]
        bounds = [rng.integers(-1, 45, 60) for _ in range(dims)]
        bounds[0] = rng.integers(0, n + 3, 60)
        want = [sum(all(p[i] < b[j] for p, b in zip(points, bounds, strict=True)) for i in range(n)) for j in range(60)]
        assert refits.Counts(points).below(bounds).tolist() == want


def days_of(rng, key, n, start=dt.date(2024, 1, 1)):
    rows, at = [], start
    for _ in range(n):
        at += dt.timedelta(days=int(rng.choice([1, 1, 1, 3])))
        iv = None if rng.random() < 0.15 else float(np.round(rng.gamma(2, 0.1), 2))
        rows.append((key, at, float(np.round(rng.gamma(2, 15), rng.integers(0, 3))), float(np.round(rng.gamma(2, 12), 1)), iv))
    return rows


SHAPE = "k string, day date, up_max double, down_max double, iv double"


@pytest.mark.parametrize(("seed", "options"), [
    (1, {"quantile": 0.9, "target": 0.85, "min_regime_days": 5, "buffer_max": 20.0, "buffer_step": 2.5}), (2, {"quantile": 0.8, "target": 0.97, "min_regime_days": 12, "buffer_max": 9.0, "buffer_step": 0.3, "min_distance": 25.0}),
    (3, {"quantile": 0.7, "min_regime_days": 9, "allow_fallback": False}),
])
def test_equals_the_model_fitted_for_each_day(spark, seed, options):
    rng = np.random.default_rng(seed)
    rows = days_of(rng, "a", 90) + days_of(rng, "b", 40) + days_of(rng, "c", 3)
    df = spark.createDataFrame(rows, SHAPE)
    models = [TailModel(kind, **options) for kind in KINDS]
    got = {(r.k, r.day, r.model): r for r in refits.daily_recommendations(df, models, min_train=10, gap_days=2, keys=["k"]).collect()}
    assert len(got) == 4 * len(rows)
    # Every day is a fold of its own, with a copy of its past.
    test = df.withColumn("fold", F.concat_ws(":", "k", "day"))
    past = test.select("fold", F.col("k").alias("own"), F.col("day").alias("at")).join(df, (F.col("own") == F.col("k")) & (F.col("day") <= F.expr("at - INTERVAL 2 DAYS"))).drop("own", "at")
    sizes = {r.fold: r["count"] for r in past.groupBy("fold").count().collect()}
    for m in models:
        for r in m.recommend(past, test, ["fold"]).collect():
            x = got[r.k, r.day, m.kind]
            assert x.n_train == sizes.get(r.fold, 0)
            if x.n_train < 10:
                assert (x.outcome, x.up_distance, x.regime) == ("INSUFFICIENT_HISTORY", None, None)
            else:
                assert (x.outcome, x.up_distance, x.down_distance, x.regime) == ("ABSTAIN" if r.up_distance is None else "RECOMMENDED", r.up_distance, r.down_distance, r.regime)
    assert {x.outcome for x in got.values()} >= {"RECOMMENDED", "INSUFFICIENT_HISTORY", "ABSTAIN"}


def test_odd_days(spark):
    rows = [("a", dt.date(2024, 1, 1), 1.0, 2.0, float("nan")), ("a", None, 1.0, 1.0, 1.0), ("a", dt.date(2024, 1, 2), None, 1.0, 1.0), ("a", dt.date(2024, 1, 3), 5.0, 1.0, 0.2), (None, dt.date(2024, 1, 3), 5.0, 1.0, 0.2)]
    df = spark.createDataFrame(rows, SHAPE)
    got = refits.daily_recommendations(df, [TailModel("iv_regime", 0.9)], min_train=1, keys=["k"]).collect()
    assert sorted((str(r.k), r.day.day, r.outcome) for r in got) == [("None", 3, "INSUFFICIENT_HISTORY"), ("a", 1, "INSUFFICIENT_HISTORY"), ("a", 3, "ABSTAIN")]
    assert refits.daily_recommendations(df.limit(0), [TailModel("buffered", 0.9)], keys=["k"]).collect() == []
    with pytest.raises(Exception, match="a day has two rows"):
        refits.daily_recommendations(df.union(df), [TailModel("buffered", 0.9)]).collect()


def test_work_grows_with_the_days():
    """Four times the days take much less than sixteen times as long."""
    rng, took = np.random.default_rng(0), []
    m = TailModel("buffered", 0.9, target=0.9, buffer_max=20.0, buffer_step=4.0)
    for n in (2000, 8000):
        past = refits.Past(rng.gamma(2, 15, n), rng.gamma(2, 12, n), rng.gamma(2, 0.1, n))
        begin = time.process_time()
        past.recommend(m, np.arange(60, n), np.arange(59, n - 1))
        took.append(time.process_time() - begin)
    assert took[1] < 9 * took[0]
