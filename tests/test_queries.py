"""Every query with oracle SQL against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from tidemark.plans import registry

DATA = "/root/testdata/sf0.001"
SQL, QUERIES = registry.oracle_sql(), registry.queries()


def canonical(relation: duckdb.DuckDBPyRelation) -> list[tuple]:
    columns = sorted(relation.columns)
    rows = relation.project(", ".join(f'"{c}"' for c in columns)).fetchall()
    return sorted(tuple("" if x is None else f"{x:.6f}" if isinstance(x, float) else str(x) for x in row) for row in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_the_oracle(spark, duck, tmp_path, name):
    QUERIES[name](spark, DATA).write.parquet(str(tmp_path / "out"))
    got, want = duck.sql(f"SELECT * FROM '{tmp_path}/out/*.parquet'"), duck.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
