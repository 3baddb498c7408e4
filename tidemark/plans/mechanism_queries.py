"""Queries of the library's mechanisms: table functions, canonical ids, exact sums, numbered commits, scans without a key."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import Any

from pyspark.sql import functions as F

from tidemark.functions import snapshots
from tidemark.operators import market, quality, tails
from tidemark.operators.exact import exact_sums
from tidemark.plans.models import Descriptor, Registry
from tidemark.plans.views import view, with_views
from tidemark.session import shared_dir, table
from tidemark.sources.attribution_log import with_review_state
from tidemark.sources.log import Log


def _surges(row: dict[str, Any]) -> Iterator[tuple[str, float]]:
    """None for a small value, one candidate for a large one, two for a purchase among these."""
    if row["value"] is not None and row["value"] > 60.0:
        yield "SURGE", row["value"]
        if row["event_type"] == "purchase":
            yield "LARGE_PURCHASE", 2 * row["value"]


def detector_lateral(spark, sf_dir):
    """Every event through a registered detector, as a table function in a lateral join."""
    Registry().register_rows(spark, Descriptor("surges", "v1", "a1"), _surges, ["event_type", "value"], "target string, score double")
    events = table(spark, sf_dir, "events")
    return spark.sql("SELECT e.event_id, d.target, d.score, d.detector FROM {events} e, LATERAL surges(e.event_type, e.value) d", events=events)


LATERAL = """SELECT event_id, 'SURGE' AS target, value AS score, 'surges@v1#a1' AS detector FROM events WHERE value > 60
UNION ALL SELECT event_id, 'LARGE_PURCHASE', 2 * value, 'surges@v1#a1' FROM events WHERE value > 60 AND event_type = 'purchase'"""


def snapshot_ids(spark, sf_dir):
    """Each customer as canonical JSON with an object in it, and the id of this content."""
    c = table(spark, sf_dir, "customer")
    more = F.struct(F.col("c_nationkey").cast("long").alias("nation"), F.array(F.col("c_custkey") % 7, F.col("c_custkey") % 3).alias("codes"), F.lit(None).cast("string").alias("note")).alias("more")
    rows = c.select("c_custkey", "c_name", more)
    text = snapshots.canonical("more", "c_name", F.col("c_custkey").cast("long").alias("id"))
    return rows.select("c_custkey", text.alias("canonical")).withColumn("snapshot_id", snapshots.digest(F.col("canonical")))


SNAPSHOTS = """WITH j AS (SELECT c_custkey, '{"c_name":"' || c_name || '","id":' || c_custkey || ',"more":{"codes":[' || c_custkey % 7 || ',' || c_custkey % 3 || '],"nation":' || c_nationkey || ',"note":null}}' AS canonical FROM customer)
SELECT c_custkey, canonical, 'sha256:' || sha256(canonical) AS snapshot_id FROM j"""


def exact_totals(spark, sf_dir):
    """Sums of doubles of both signs by flag, and of one column with whole weights."""
    li = table(spark, sf_dir, "lineitem")
    price = F.col("l_extendedprice").cast("double")
    sums = exact_sums(li, ["l_returnflag"], {"net": price * F.when(F.col("l_linestatus") == "O", 1.0).otherwise(-1.0), "gross": price})
    weighted = exact_sums(li, ["l_returnflag"], {"weighted": price}, F.col("l_linenumber"))
    return sums.join(weighted, "l_returnflag").select("l_returnflag", *(F.round(c, 4).alias(c) for c in ("net", "gross", "weighted")))


TOTALS = """SELECT l_returnflag, round(CAST(sum(CASE WHEN l_linestatus = 'O' THEN p ELSE -p END) AS DOUBLE), 4) AS net, round(CAST(sum(p) AS DOUBLE), 4) AS gross, round(CAST(sum(p * l_linenumber) AS DOUBLE), 4) AS weighted
FROM (SELECT *, CAST(l_extendedprice AS DECIMAL(18,4)) AS p FROM lineitem) GROUP BY l_returnflag"""


def numbered_commits(spark, sf_dir):
    """Customers in two commits of a log, numbered through."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    log = Log(spark, f"{shared_dir(spark)}/log-{uuid.uuid4().hex}", order=["c_nationkey", "c_custkey"])
    for odd in (0, 1):
        log.append(c.where(F.col("c_custkey") % 2 == odd), key="c_custkey")
    return log.read().select("c_custkey", "seq")


NUMBERED = "SELECT c_custkey, row_number() OVER (ORDER BY c_custkey % 2, c_nationkey, c_custkey) AS seq FROM customer"


def drawdown_of_all(spark, sf_dir):
    """The drawdown of all lines in the order of day and key, as one sequence without a key."""
    rows = view(spark, sf_dir, "pnl").groupBy("day", "l_orderkey", "l_linenumber").agg(F.sum("pnl").alias("pnl"))
    return tails.max_drawdown(rows, [], ["day", "l_orderkey", "l_linenumber"], "pnl", "drawdown")


DRAWDOWN = with_views(""", d AS (SELECT day, l_orderkey, l_linenumber, sum(pnl) AS pnl FROM pnl GROUP BY ALL), e AS (SELECT *, sum(pnl) OVER w AS equity FROM d WINDOW w AS (ORDER BY day, l_orderkey, l_linenumber)),
p AS (SELECT *, greatest(0, max(equity) OVER (ORDER BY day, l_orderkey, l_linenumber)) AS peak FROM e)
SELECT greatest(0.0, CAST(max(peak - equity) AS DOUBLE)) AS drawdown FROM p""", "pnl")


def capability_faults(spark, sf_dir):
    """Suppliers as providers whose capabilities were verified to some extent."""
    s = table(spark, sf_dir, "supplier").select(
        "s_suppkey", (F.col("s_suppkey") % 3 != 0).alias("configured"), F.when(F.col("s_suppkey") % 4 != 0, F.when(F.col("s_suppkey") % 5 == 0, "PENDING").otherwise("VERIFIED")).alias("verification_status"),
        F.when(F.col("s_suppkey") % 7 != 0, F.col("s_suppkey") % 2 == 0).alias("production_ready"), F.when(F.col("s_suppkey") % 11 == 0, "AMBER").otherwise("GREEN").alias("quality"),
    )
    return s.select("s_suppkey", F.array_join(quality.capability_reasons(), ",").alias("reasons"))


CAPABILITIES = """SELECT s_suppkey, array_to_string(list_filter([CASE WHEN s_suppkey % 3 = 0 THEN 'CAPABILITY_NOT_CONFIGURED' END, CASE WHEN s_suppkey % 4 = 0 OR s_suppkey % 5 = 0 THEN 'CAPABILITY_UNVERIFIED' END,
  CASE WHEN s_suppkey % 7 = 0 OR s_suppkey % 2 <> 0 THEN 'CAPABILITY_NOT_PRODUCTION_READY' END, CASE WHEN s_suppkey % 11 = 0 THEN 'CAPABILITY_QUALITY_NOT_GREEN' END], lambda x: x IS NOT NULL), ',') AS reasons FROM supplier"""


def structure_fees(spark, sf_dir):
    """Fees of opening and closing a structure of each order's largest quantity, in currency."""
    n = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_quantity").cast("long").alias("contracts"))
    return n.select("l_orderkey", F.round(market.round_trip_fees(F.col("contracts"), 0.65, 0.05, fixed=0.1), 6).alias("fees"))


FEES = "SELECT l_orderkey, round(2 * (4 * CAST(max(l_quantity) AS BIGINT) * (CAST(0.65 AS DOUBLE) + CAST(0.05 AS DOUBLE)) + CAST(0.1 AS DOUBLE)), 6) AS fees FROM lineitem GROUP BY l_orderkey"


def reviewed_tasks(spark, sf_dir):
    """Orders as attribution tasks, their lines as reviews: the last review's status, and whether any keeps the task as a sample."""
    tasks = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task_id"), F.lit("PENDING").alias("review_status"), (F.col("o_orderkey") % 50 == 0).alias("retained")).where("task_id % 7 <> 0")
    review = F.concat_ws(":", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int"))
    status = F.when(F.col("l_returnflag") == "R", "REJECTED").when(F.col("l_returnflag") == "A", "ACCEPTED").otherwise("PENDING")
    reviews = table(spark, sf_dir, "lineitem").where("l_orderkey % 3 <> 0").select(F.col("l_orderkey").alias("task_id"), review.alias("review_id"), F.col("l_shipdate").alias("reviewed_at"), status.alias("status"), (F.col("l_linenumber") == 6).alias("retain"))
    return with_review_state(tasks, reviews)


REVIEWED = """WITH r AS (SELECT l_orderkey AS task_id, arg_max(CASE l_returnflag WHEN 'R' THEN 'REJECTED' WHEN 'A' THEN 'ACCEPTED' ELSE 'PENDING' END, (l_shipdate, concat_ws(':', l_linenumber, l_partkey, l_suppkey, CAST(floor(l_quantity) AS INTEGER)))) AS status, bool_or(l_linenumber = 6) AS retain
  FROM lineitem WHERE l_orderkey % 3 <> 0 GROUP BY l_orderkey)
SELECT o_orderkey AS task_id, coalesce(status, 'PENDING') AS review_status, o_orderkey % 50 = 0 OR coalesce(retain, false) AS retained FROM orders LEFT JOIN r ON task_id = o_orderkey WHERE o_orderkey % 7 <> 0"""


QUERIES = {
    "reviewed_tasks": (reviewed_tasks, REVIEWED), "detector_lateral": (detector_lateral, LATERAL), "snapshot_ids": (snapshot_ids, SNAPSHOTS), "exact_totals": (exact_totals, TOTALS), "numbered_commits": (numbered_commits, NUMBERED),
    "drawdown_of_all": (drawdown_of_all, DRAWDOWN), "capability_faults": (capability_faults, CAPABILITIES), "structure_fees": (structure_fees, FEES),
}
