"""Market-like views of the driver tables, and the same views as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.session import table

#: Every view as SQL that Spark and DuckDB both run; times are naive and stand for UTC.
SQL = {
    "quotes": """
        SELECT event_id AS seq, CAST(ts AS DATE) AS day, event_type AS symbol, ts, user_id,
               CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 31 = 0 THEN value * 1.05 ELSE value END AS bid,
               value * 1.02 AS ask, value
        FROM events""",
    "bars": """
        SELECT event_type AS symbol, CAST(ts AS DATE) AS day, date_trunc('hour', ts) AS ts, min_by(value, ts) AS open,
               max(value) AS high, min(value) AS low, max_by(value, ts) AS close, CAST(count(*) AS DOUBLE) AS volume
        FROM events GROUP BY event_type, CAST(ts AS DATE), date_trunc('hour', ts)""",
    "pnl": """
        SELECT CAST(l_shipdate AS DATE) AS day, l_returnflag AS regime, l_linestatus AS event_type, l_orderkey, l_linenumber,
               CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount - 0.05 AS DECIMAL(18,2)) AS DECIMAL(18,4)) AS pnl
        FROM lineitem""",
    "labels_day": """
        SELECT CAST(o_orderdate AS DATE) AS day, CAST(max(o_totalprice) / 1000 AS DOUBLE) AS up_max,
               CAST(min(o_totalprice) / 1000 AS DOUBLE) AS down_max, min(o_orderkey) AS first_key
        FROM orders GROUP BY CAST(o_orderdate AS DATE)""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view as a DataFrame; its source stays a lazy Parquet scan."""
    source = SQL[name].split("FROM")[1].split()[0]
    return spark.sql(SQL[name].replace(f"FROM {source}", "FROM {src}"), src=table(spark, sf_dir, source))


def with_views(sql: str, *names: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in names) + sql
