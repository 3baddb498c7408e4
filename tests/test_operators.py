"""Hand-computed numbers, boundaries and leak guards of the analytics operators."""

import datetime as dt
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof, market, rules, tails
from tidemark.plans import record_queries, tail_queries, workflow_queries
from tidemark.plans.views import view


def test_condor_price_of_known_legs(spark):
    legs = [("short_put", "P6400", 1.5, 1.7), ("long_put", "P6395", 0.5, 0.6), ("short_call", "C6450", 1.4, 1.6), ("long_call", "C6455", 0.4, 0.5)]
    table = spark.createDataFrame([(1, n, s) for n, s, _, _ in legs] + [(2, n, s) for n, s, _, _ in legs], "day int, leg string, symbol string")
    quotes = spark.createDataFrame([(1, s, b, a) for _, s, b, a in legs] + [(2, s, b if n != "short_put" else 1.8, a) for n, s, b, a in legs], "day int, symbol string, bid double, ask double")
    got = {r.day: r for r in market.condor_price(table, quotes, ["day"]).collect()}
    assert got[1].credit == pytest.approx(1.8) and got[1].close_cost == pytest.approx(2.4) and got[1].priced
    assert got[2].credit is None and not got[2].priced  # a crossed leg can't be traded
    k = spark.range(1).select(market.condor_strikes(F.lit(6441.0), F.lit(40), F.lit(8)).alias("k")).first().k
    assert (k.short_put, k.long_put, k.short_call, k.long_call) == (6400, 6395, 6450, 6455)


def test_a_bad_latest_quote_hides_a_good_one(spark):
    q = spark.createDataFrame([("d", "s", 1, 1, 1.0, 1.1), ("d", "s", 2, 2, None, 1.2), ("d", "s", 2, 3, 1.3, None)], "day string, symbol string, ts int, seq int, bid double, ask double")
    r = asof.latest_per_key(q, ["day", "symbol"], ["ts", "seq"], ["bid", "ask"]).first()
    assert (r.bid, r.ask) == (1.3, None)
    left = spark.createDataFrame([("s", 0, 7), ("s", 1, 8), ("s", 2, 9)], "symbol string, ts int, id int")
    got = asof.asof_backward(left, q.where("seq < 3"), ["symbol"], "ts", ["bid", "ask"], "seq").orderBy("ts").collect()
    assert [(x.id, x.bid, x.ask) for x in got] == [(7, None, None), (8, 1.0, 1.1), (9, None, 1.2)]


def test_higher_quantile_and_two_tail_losses(spark):
    df = spark.createDataFrame([(float(x), -x * 1.0) for x in range(1, 21)], "v double, pnl double").withColumn("k", F.lit(1))
    assert df.agg(tails.quantile_higher("v", 0.975).alias("q")).first().q == 20.0
    assert df.agg(tails.quantile_higher("v", 0.95).alias("q")).first().q == 19.0
    assert tails.worst_mean(df, ["k"], "pnl", 0.05, "v", "m").first().m == -20.0  # one row
    assert tails.worst_mean(df, ["k"], "pnl", 1 - 0.95, "v", "m").first().m == -19.5  # two rows: 1 - 0.95 is a little more than 0.05


def test_drawdown_starts_at_zero(spark):
    df = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate((-3, 5, -4, -1, 10))], "k int, t int, pnl double")
    assert tails.max_drawdown(df, ["k"], ["t"], "pnl", "d").first().d == 5.0


def test_excursions(spark):
    t0 = dt.datetime(2026, 8, 17, 14, 0)
    moves = [(10, 101.0), (12, 103.0), (14, 105.0), (16, 107.0), (18, 107.0), (20, 104.0)]
    df = spark.createDataFrame([("d", t0 + dt.timedelta(minutes=m), p, 101.0) for m, p in moves[1:]], "day string, ts timestamp, p double, entry double")
    r = market.excursions(df, ["day"], "ts", "p", "p", "p", "entry").first()
    assert (r.up_max, r.down_max, r.close_price, r.sample_count) == (6.0, 0.0, 104.0, 5)
    assert r.up_ts == t0 + dt.timedelta(minutes=16) and r.down_ts == t0 + dt.timedelta(minutes=12)  # first of equals


def test_implied_volatility_round_trip(spark):
    rng = np.random.default_rng(2)
    n = 50
    spot, strike, tau = np.full(n, 6400.0), 6300 + rng.random(n) * 200, np.full(n, 0.02)
    sigma, call = 0.1 + rng.random(n) * 0.3, rng.random(n) < 0.5
    price = market.black_scholes(spot, strike, tau, np.full(n, 0.045), sigma, call)
    assert np.allclose(market.implied_volatility(price, spot, strike, tau, 0.045, call), sigma, atol=1e-6)
    df = spark.createDataFrame([(float(price[0]), 6400.0, float(strike[0]), 0.02, bool(call[0])), (1e9, 6400.0, 6400.0, 0.02, True), (5.0, 6400.0, 6400.0, 0.0, True)], "p double, s double, k double, t double, c boolean")
    iv = [r.iv for r in market.with_implied_volatility(df, "p", "s", "k", "t", "c", 0.045).collect()]
    assert iv[0] == pytest.approx(sigma[0], abs=1e-6) and iv[1] is None and iv[2] is None
    assert market.black_scholes([110.0], [100.0], [0.0], [0.0], [0.2], [True])[0] == 10.0


def test_realized_volatility_needs_enough_bars(spark):
    df = spark.createDataFrame([(k, i, 100.0 * math.exp(0.001 * (i % 2))) for k, n in ((1, 16), (2, 14)) for i in range(n)], "k int, t int, c double")
    got = {r.k: r.vol for r in market.realized_volatility(df, ["k"], "t", "c").collect()}
    want = np.std(np.diff([0.001 * (i % 2) for i in range(16)]), ddof=1) * math.sqrt(252 * 390)
    assert got[1] == pytest.approx(want) and got[2] == 0.0


def test_regime_boundary_goes_up_and_rules_fail_closed(spark):
    df = spark.createDataFrame([(0.1,), (0.2,), (0.3,), (None,)], "iv double")
    cuts = [F.lit(0.2), F.lit(0.25), F.lit(0.3)]
    assert [r.r for r in df.select(tails.quartile_regime("iv", cuts).alias("r")).collect()] == ["IV_Q1", "IV_Q2", "IV_Q4", "UNKNOWN"]
    why = rules.reasons([(F.col("iv") > 0.25, "HIGH"), (F.lit(False), "NEVER")])
    assert [r.w for r in df.select(why.alias("w")).collect()] == [[], [], ["HIGH"], ["HIGH"]]


def test_walk_forward_never_trains_on_the_future(spark):
    days = [(i, dt.date(2024, 1, 1) + dt.timedelta(days=i), float(i)) for i in range(40)]
    df = spark.createDataFrame(days, "id int, day date, v double")
    q = {r.day: (r.n_train, r.q) for r in tails.expanding_quantile(df, "day", "v", 0.9, 1).collect()}
    assert q[dt.date(2024, 1, 1)] == (0, None) and q[dt.date(2024, 1, 11)] == (10, 8.0)
    folds = tails.walk_forward_folds(df.withColumn("g", F.col("id")), "g", "day", 10, 5, 2).orderBy("fold").collect()
    assert [(r.fold, r.n_test, r.n_train) for r in folds][:2] == [(0, 5, 8), (1, 5, 13)] and len(folds) == 6


def brute_quantiles(rows, q, gap):
    """day -> (n_train, higher quantile) of all values up to gap days before it."""
    out = {}
    for d in {d for d, _ in rows}:
        past = sorted(v for e, v in rows if d and e and v is not None and e <= d - dt.timedelta(days=gap))
        out[d] = (len(past), past[max(1, math.ceil(len(past) * q)) - 1] if past else None)
    return out


def test_expanding_quantile_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(dt.date(1995, 1, 1) + dt.timedelta(days=int(a)), float(b)) for a, b in zip(rng.integers(0, 90, 700), rng.integers(-9, 60, 700), strict=True)]
    rows += [(dt.date(2001, 8, 1), 7.0)] * 50 + [(dt.date(2002, 1, 1), None), (None, 3.0)]
    df = spark.createDataFrame(rows, "day date, v double")
    for q, gap, size in ((0.9, 1, 65_536), (0.95, 3, 40), (0.5, 1, 1)):
        got = tails.expanding_quantile(df, "day", "v", q, gap, range_pairs=size).collect()
        assert len(got) == len({r.day for r in got})  # one row a day
        assert {r.day: (r.n_train, r.q) for r in got} == brute_quantiles(rows, q, gap)
    assert tails.expanding_quantile(df.limit(0), "day", "v", 0.9, 1).collect() == []


def test_expanding_quantile_has_every_day(spark):
    data = "/root/testdata/sf0.001"
    rows = [(r.day, r.up_max) for r in view(spark, data, "labels_day").collect()]
    got = tail_queries.expanding_quantile_all_days(spark, data).collect()
    assert max(r.day.year for r in got) > 1996
    assert {r.day: (r.n_train, r.q) for r in got} == brute_quantiles(rows, 0.95, 1)


def test_buffer_grid_takes_the_cheapest_pair(spark):
    df = spark.createDataFrame([(10.0, 5.0)] * 8 + [(13.0, 5.0), (10.0, 9.0)], "u double, d double")
    r = tails.buffer_grid(df, "u", "d", 10.0, 5.0, 0.9, 1.0, 10).first()
    assert (r.up_buffer, r.down_buffer, r.covered) == (3.0, 0.0, 9)
    c = tails.joint_corridor(df, "u", "d", 0.9).first()
    assert c.buffer >= 0 and c.n == 10


def test_chain_and_lineage(spark):
    df = spark.createDataFrame([("l", 1, "GENESIS", "a"), ("l", 2, "a", "b"), ("l", 4, "b", "c"), ("l", 5, "x", "d")], "k string, seq int, prev string, entry string")
    r = rules.chain_breaks(df, ["k"], "seq", "prev", "entry", F.when(F.col("seq") == 2, "z").otherwise(F.col("entry")), "GENESIS").first()
    assert (r.entries, r.bad_links, r.bad_sequence, r.bad_hashes) == (4, 1, 1, 1)
    tree = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3)], "id int, parent int")
    got = {(r.id, r.ancestor): r.distance for r in rules.lineage(tree, "id", "parent").collect()}
    assert got == {(2, 1): 1, (3, 2): 1, (4, 3): 1, (3, 1): 2, (4, 2): 2, (4, 1): 3}


def test_symbols_round_trip(spark):
    row = spark.range(1).select(market.osi_symbol(F.lit("SPXW"), F.lit("2026-08-17").cast("date"), F.lit("C"), F.lit(6450)).alias("s")).select("s", market.parse_osi(F.col("s")).alias("x"), market.parse_osi(F.lit("bad")).alias("y")).first()
    assert row.s == "SPXW  260817C06450000" and row.x.is_call and row.x.strike == 6450.0 and row.y is None


def test_after_cursor_has_no_limit(spark):
    rows = [(i, "a" if i % 2 else "b") for i in range(2000)] + [(5000 + i, None) for i in range(3)]
    df = spark.createDataFrame(rows, "seq int, user string")
    cursors = spark.createDataFrame([("a", 301), ("c", 7)], "user string, upto int")
    got = sorted(r.seq for r in asof.after_cursor(df, cursors, ["user"], "seq", "upto").collect())
    assert got == [i for i, user in rows if user != "a" or i > 301]


def test_events_after_delivery_is_whole(spark):
    data = "/root/testdata/sf0.001"
    e = spark.read.parquet(f"{data}/events.parquet").collect()
    last = {}
    for r in e:
        if r.event_type == "purchase":
            last[r.user_id] = max(r.event_id, last.get(r.user_id, r.event_id))
    want = sorted(r.event_id for r in e if r.user_id not in last or r.event_id > last[r.user_id])
    got = [r.event_id for r in workflow_queries.events_after_delivery(spark, data).collect()]
    assert got == want and want


def test_lineage_of_any_length_and_cycles(spark):
    line = spark.range(1, 201).selectExpr("id", "IF(id > 1, id - 1, NULL) AS parent")
    got = rules.lineage(line, "id", "parent")
    assert got.count() == 200 * 199 // 2 and got.agg(F.max("distance")).first()[0] == 199
    with pytest.raises(ValueError, match="cycle"):
        rules.lineage(spark.createDataFrame([(1, 3), (2, 1), (3, 2)], "id int, parent int"), "id", "parent")


def test_tail_loss_counts_gains_and_is_floored_once(spark):
    df = spark.createDataFrame([("a", -10.0, 0.1), ("a", 5.0, 0.9), ("b", 3.0, 1.0)], "k string, pnl double, p double")
    got = {r.k: r.cvar for r in tails.weighted_tail_loss(df, ["k"], "pnl", "p", 0.25, "cvar").collect()}
    assert got["a"] == pytest.approx(1.0) and got["b"] == 0.0  # (0.1 * -10 + 0.15 * 5) / 0.25


def test_folds_step_and_purge(spark):
    rows = [(i, f"g{i // 2:02d}", dt.date(2026, 1, 1) + dt.timedelta(days=i)) for i in range(20)]
    df = spark.createDataFrame(rows, "id int, grp string, at date")
    members = tails.fold_members(df, "grp", "at", 4, 2, 1, step_groups=3).collect()
    got = {f: tuple(sorted(r.id for r in members if r.fold == f and r.role == role) for role in ("TEST", "TRAIN")) for f in {r.fold for r in members}}
    assert got == {0: ([8, 9, 10, 11], [0, 1, 2, 3, 4, 5, 6]), 1: ([14, 15, 16, 17], list(range(13)))}
    counts = tails.walk_forward_folds(df, "grp", "at", 4, 2, 1, step_groups=3).orderBy("fold").collect()
    assert [(r.n_test, r.n_train) for r in counts] == [(4, 7), (4, 13)]
    with pytest.raises(Exception, match="without training samples"):
        tails.walk_forward_folds(df, "grp", "at", 1, 1, 30).collect()


def test_kth_smallest_equals_sorting(spark):
    rng = np.random.default_rng(4)
    rows = [(k, float(v)) for k in range(3) for v in np.round(rng.normal(size=500) ** 3, k)] + [(3, 7.0)] * 5 + [(4, None)]
    df = spark.createDataFrame(rows, "k int, v double")
    got = {r.k: (r.n, r.x) for r in tails.kth_smallest(df, ["k"], "v", lambda n: F.ceil(n * 0.9), "x").collect()}
    for k in range(4):
        own = sorted(v for i, v in rows if i == k)
        assert got[k] == (len(own), own[math.ceil(len(own) * 0.9) - 1])
    assert 4 not in got


@pytest.mark.parametrize(("most", "direct"), [(1 << 18, 1 << 20), (1 << 18, 10), (20, 10)])
def test_ranks_however_the_values_lie(spark, monkeypatch, most, direct):
    monkeypatch.setattr(tails, "MOST_VALUES", most)
    monkeypatch.setattr(tails, "DIRECT_ROWS", direct)
    monkeypatch.setattr(tails, "FEW", 50)
    rng = np.random.default_rng(9)
    lists = {
        "outlier": [*rng.random(3000), 1e15], "ties": [1.0] * 2500 + [2.0] * 400 + [0.5], "wild": [float(x) for x in rng.normal(size=3000) * 10.0 ** rng.integers(-200, 200, 3000)],
        "few": [3.0, 1.0, 2.0], "one": [7.0], None: [*rng.integers(0, 9, 1000).astype(float)], "whole": [*map(float, range(-1500, 1500))],
    }
    rows = [(k, float(x)) for k, v in lists.items() for x in v] + [("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    for rank, f in ((lambda n: math.ceil(n * 0.9), lambda n: F.ceil(n * 0.9)), (lambda n: min(n, 3), lambda n: F.least(n, F.lit(3))), (lambda n: n // 2 + 1, lambda n: F.floor(n / 2) + 1), (lambda n: n, lambda n: n)):
        got = {r.k: (r.n, r.x) for r in tails.kth_smallest(df, ["k"], "v", f, "x").collect()}
        assert got == {k: (len(v), sorted(v)[rank(len(v)) - 1]) for k, v in lists.items()}
    got = {r.k: r.m for r in tails.worst_mean(df, ["k"], "v", 0.05, "v", "m").collect()}
    assert got == {k: math.fsum(sorted(v)[: max(1, math.ceil(len(v) * 0.05))]) / max(1, math.ceil(len(v) * 0.05)) for k, v in lists.items()}
    assert tails.kth_smallest(df.limit(0), ["k"], "v", lambda n: n, "x").collect() == [] and tails.kth_smallest(df.limit(0), [], "v", lambda n: n, "x").collect() == []
    assert tails.kth_smallest(df.where("k = 'whole'"), [], "v", lambda n: F.ceil(n * 0.5), "x").first().x == -1.0
    cents = df.where("k IN ('whole', 'ties')").selectExpr("k", "CAST(v AS DECIMAL(18,4)) AS v")
    want = {k: math.fsum(sorted(lists[k])[:150]) / 150 for k in ("whole",)} | {"ties": math.fsum(sorted(lists["ties"])[: math.ceil(2901 * 0.05)]) / math.ceil(2901 * 0.05)}
    assert {r.k: r.m for r in tails.worst_mean(cents, ["k"], "v", 0.05, "v", "m").collect()} == want


def test_joint_corridor_equals_sorting(spark):
    rng = np.random.default_rng(3)
    up, down = rng.gamma(2, 10, 4000), rng.gamma(2, 12, 4000)
    r = tails.joint_corridor(spark.createDataFrame(list(zip(up.tolist(), down.tolist(), strict=True)), "u double, d double"), "u", "d", 0.9).first()
    q = [sorted(x)[math.ceil(4000 * 0.9) - 1] for x in (up, down)]
    miss = sorted(max(0.0, a - q[0], b - q[1]) for a, b in zip(up, down, strict=True))
    assert (r.up_q, r.down_q, r.n, r.buffer) == (*q, 4000, miss[min(4000, math.ceil(4001 * 0.9)) - 1])


def test_of_changes_alike_the_first_in_the_table_counts(spark, tmp_path):
    con = duckdb.connect(config={"threads": 1})
    con.sql("CREATE TABLE orders AS SELECT range AS o_orderkey, TIMESTAMP '1998-01-01' AS o_orderdate FROM range(400)")
    # Orders have the same line twice with either flag first, some a later line, a null day or no change at all.
    con.sql("""CREATE TABLE lineitem AS SELECT i % 397 AS l_orderkey, CASE WHEN i % 5 = 0 THEN 'N' WHEN i % 2 = 0 THEN 'A' ELSE 'R' END AS l_returnflag,
        CASE WHEN i % 11 > 0 THEN TIMESTAMP '1998-02-01' + INTERVAL (i % 3) DAY END AS l_shipdate, CAST(i % 397 % 3 AS INTEGER) AS l_linenumber FROM range(6000) t(i)""")
    con.sql(f"COPY orders TO '{tmp_path}/orders.parquet'")
    (tmp_path / "lineitem.parquet").mkdir()
    con.sql(f"COPY (SELECT * FROM lineitem LIMIT 2500) TO '{tmp_path}/lineitem.parquet/a.parquet'")
    con.sql(f"COPY (SELECT * FROM lineitem OFFSET 2500) TO '{tmp_path}/lineitem.parquet/b.parquet'")
    want = con.sql(record_queries.STATUS).fetchall()
    assert {s for _, s in want} == {"A", "R", "OPEN"}
    assert sorted(map(tuple, record_queries.effective_status(spark, str(tmp_path)).collect())) == sorted(want)
