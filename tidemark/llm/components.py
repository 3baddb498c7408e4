"""Connected components of a link table by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut, scratch

MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    linked = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.union(low.select("a", F.col("m").alias("b")))


def connected_components(links: DataFrame) -> DataFrame:
    """links (a, b) of longs, best a written table (it is read several times) -> (id, component): component is the smallest id reachable. Ids without links are absent.

    Each round is cut in the shared folder. A round moves two narrow columns; hubs are pre-aggregated (min) or meet in
    an equi-join that adaptive execution can split. Raises if MAX_ROUNDS rounds (far beyond the O(log^2 n) bound of
    practical inputs) don't converge.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    with scratch() as tables:
        for _ in range(MAX_ROUNDS):
            edges = cut(_small_star(_large_star(edges)).where("a <> b").distinct())
            # Done when every id hangs on one root that hangs on nothing, and each id on one root only.
            hung = edges.groupBy("a").agg(F.count("*").alias("n"))
            if hung.where("n > 1").isEmpty() and edges.join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi").isEmpty():
                tables.keep(edges)
                roots = edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
                return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots)
    raise RuntimeError("components did not converge")
