import itertools
import random
import re

import duckdb
import pytest

from tidemark.llm import queries
from tidemark.llm.filter_audit import FILTERS, filter_audit

SCHEMA = "doc_id long, text string, source string, mask int, edge long"
LABELS = "doc_id long, quality int, toxic int"


def brute(rows, labels):
    rows = [(i, t or "", p or "") for i, t, p, *_ in rows]
    fails = []
    for i, t, _ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        same = i is not None and any(j is not None and j < i and t == u for j, u, _ in rows)
        tests = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search(r"[#$%&*|]", t)), same]
        fails.append({f for f, x in zip(FILTERS, tests, strict=True) if x})
    good, toxic = ({i for i, *y in labels if i is not None and y[k] == 1} for k in (0, 1))
    out, shapley = [], {}
    for part in {p for _, _, p in rows}:
        for order in map("".join, itertools.permutations(FILTERS)):
            left = [k for k, r in enumerate(rows) if r[2] == part]
            gone = []
            for step, f in enumerate(order, 1):
                removed = [k for k in left if f in fails[k]]
                redundant = [k for k in gone if f in fails[k]]
                left = [k for k in left if f not in fails[k]]
                gone += removed
                unique = [k for k, r in enumerate(rows) if r[2] == part and fails[k] == {f}]
                shapley[part, f] = shapley.get((part, f), 0) + len(removed)
                out.append([part, order, step, len(left), len(removed), len(redundant), len(unique), sum(rows[k][0] in good for k in removed), sum(rows[k][0] in toxic for k in removed)])
    return sorted((*x, shapley[x[0], x[1][x[2] - 1]]) for x in out)


def got(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    def text():
        base = rng.choice(["", "a", "A B", "x#y", "lorem ", "ÄÖ ", "q\x0bq\x1c ", "Zz|"])
        return rng.choice([None, base, base * rng.choice([3, 250]), " ".join(str(k) for k in range(rng.choice([150, 220])))])
    rows = [(rng.choice([None, k, rng.randrange(40)]), text(), rng.choice([None, "", "s", "t"]), 99, 7) for k in range(150)]
    labels = [(rng.choice([None, *range(60)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(80)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert got(filter_audit(docs, spark.createDataFrame(labels, LABELS))) == brute(rows, labels)


def test_one_text_over_many_ranges(spark):
    """A third of the rows are copies of one text, some with the same id; ranges split them."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    rows = [(k % 4000 + 5, "copy " * 30, "s", 0, 0) for k in range(6000)] + [(5, "copy " * 30, "s", 0, 0)] * 2000 + [(k, f"own {k % 9000}", "t", 0, 0) for k in range(10_000)]
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 23)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        out = {r.part: r for r in filter_audit(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([], LABELS)).where("step = 1 AND filter_order = 'EABCD'").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    first = sum(i == 5 for i, *_ in rows[:8000])
    assert (out["s"].removed, out["s"].kept) == (8000 - first, first)
    assert (out["t"].removed, out["t"].kept) == (1000, 9000)


def test_empty(spark):
    assert got(filter_audit(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], LABELS))) == []


def test_query_equals_its_sql(spark):
    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    out = queries.op12_filter_audit(spark, data)
    names = ", ".join(out.columns)
    assert got(out) == sorted(con.sql(f"SELECT {names} FROM ({queries.OP12_SQL})").fetchall())
