import itertools
import random
import re

import duckdb
import pytest

from tidemark.llm import divergence, queries
from tidemark.llm.divergence import source_divergence

SCHEMA = "text string, lang string, source string, term string, n int, count int"


def brute(rows, min_docs, top):
    rows = [tuple(x or "" for x in r[:3]) for r in rows]
    terms = [["".join(c.lower() if c.isascii() else c for c in w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t)] for t, _, _ in rows]
    out = []
    for lang in {r[1] for r in rows}:
        own = [(r[2], w) for r, w in zip(rows, terms, strict=True) if r[1] == lang]
        sources = sorted({s for s, _ in own})
        kept = [t for t in {t for _, w in own for t in w} if sum(t in w for _, w in own) >= min_docs]
        count = {s: {t: sum(w.count(t) for z, w in own if z == s) for t in kept} for s in sources}
        whole = {t: sum(count[s][t] for s in sources) for t in kept}
        share = lambda c: {t: 1 + (10**9 * (c[t] + 5)) // (sum(c.values()) + 5 * len(kept)) for t in kept}
        p, q = {s: share(count[s]) for s in sources}, share(whole)
        for s in sources:
            pair = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            most = [(q[t] - p[s][t], t.encode(), t) for t in kept if count[s][t] and p[s][t] > q[t]]
            for part, items in (("pair", sorted(pair)), ("term", sorted(most)[:top])):
                out += [(lang, s, part, x, -v, k) for k, (v, _, x) in enumerate(items, 1)]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize(("seed", "broadcast"), [(0, 100_000), (1, 100_000), (2, 0)])
def test_equals_brute_force(spark, monkeypatch, seed, broadcast):
    monkeypatch.setattr(divergence, "BROADCAST_GROUPS", broadcast)
    rng = random.Random(seed)
    words = ["A", "b", "É", "é", "ab1c", "x_y", "漢字", "z\x00q", "", "7", "\U0001f600", "￮", "don't"]
    rows = [(rng.choice([None, "", " ".join(rng.choices(words, k=rng.randrange(30)))]), rng.choice([None, "", "en", "é"]), rng.choice([None, *"qrstuvw"]), "t", 1, 2) for _ in range(120)]
    rows += [("never often", "xx", "one", "", 0, 0), (None, "yy", "one", "", 0, 0), ("", "yy", "two", "", 0, 0)]
    assert got(source_divergence(spark.createDataFrame(rows, SCHEMA).repartition(3), min_docs=4, top=3)) == brute(rows, 4, 3)


def test_large_counts_stay_exact(spark):
    from pyspark.sql import functions as F

    cases = [(n, total, v) for n, total, v in itertools.product((0, 10**12, 3 * 10**17), (7, 10**13, 9 * 10**18), (1, 10**6))]
    df = spark.createDataFrame(cases, "n long, total long, v long").select("*", divergence._share(F.col("n"), F.col("total"), F.col("v")).alias("p"))
    for r in df.where("(n + 5) / (total + 5 * v) < 1000").collect():
        assert r.p == 1 + 10**9 * (r.n + 5) // (r.total + 5 * r.v)


def test_empty(spark):
    assert got(source_divergence(spark.createDataFrame([], SCHEMA))) == []


def test_query_equals_its_sql(spark):
    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    out = queries.op13_source_divergence(spark, data)
    assert got(out) == sorted(con.sql(f"SELECT {', '.join(out.columns)} FROM ({queries.OP13_SQL})").fetchall())
