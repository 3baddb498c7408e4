import math

import numpy as np

from tidemark.llm.embedding_dup import embedding_duplicates, quantise, tile


def brute(rows, least):
    fine = {i: np.array(v, float) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    n, comp = {i: 0 for i, _ in rows}, {i: i for i, _ in rows}
    ids = sorted(fine)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            p, q = fine[a], fine[b]
            if len(p) == len(q) and p @ q / math.sqrt((p @ p) * (q @ q)) >= least:
                n[a] += 1
                n[b] += 1
                lo, hi = sorted((comp[a], comp[b]))
                comp = {i: lo if c == hi else c for i, c in comp.items()}
    return {i: (n[i], comp[i], comp[i] == i) for i, _ in rows}


def test_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(30, 16))
    rows = []
    for k in range(300):
        v = base[k % 30] + rng.normal(size=16) * rng.choice([0, 0.1, 0.4])
        rows.append((k * 7 % 1000, [float(np.float32(x)) for x in v]))
    rows += [(2000 + k, v) for k, v in enumerate([None, [], [0.0] * 16, [1.0] * 15 + [None], [1.0] * 15 + [math.nan], [math.inf] * 16])]
    rows += [(3000, [1.0, 0.0]), (3001, [2.0, 0.1]), (3002, [-1.0, 0.0]), (3003, [1.0, 0.0]), (3004, [1e-30, 0.0])]
    df = spark.createDataFrame([(i, v, 0, 1) for i, v in rows], "vec_id long, embedding array<float>, n_links int, h1 int")
    for block in (1000, 37):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_duplicates(df, block=block).collect()}
        assert got == brute(rows, 0.9)


def test_no_pair_over_the_threshold_is_missed_by_a_tile():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 64))
    x[200:] = x[:200] + rng.normal(size=(200, 64)) * 0.48
    x /= np.linalg.norm(x, axis=1)[:, None]
    q, u, e = quantise(x)
    i, j = tile(q, u, e, q, u, e, 0.9)
    exact = set(zip(*np.nonzero(x @ x.T >= 0.9), strict=True))
    assert exact <= set(zip(i, j, strict=True)) and len(i) < 1.2 * len(exact) + 20


def test_empty_table(spark):
    assert embedding_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
