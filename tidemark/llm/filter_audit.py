"""Audit of how quality filters overlap, in every order in which they can be applied.

Duplicates are found by sorting: rows are dealt in ranges of (text fingerprint, doc_id, a row's own salt) and sorted within
by fingerprint, full text and doc_id; every row is compared with the one before it, and groups that may begin in an earlier
range are settled by a small table of the ranges' edges. What is left of a row, its mask of failed filters, is counted, and
these counters are additive: every order of the filters is worked out from at most 32 of them a part.
"""

from __future__ import annotations

import hashlib
import itertools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut

FILTERS = "ABCDE"
#: The bit of a filter in a mask of failed ones.
BIT = {f: 1 << k for k, f in enumerate(FILTERS)}
#: Rows that are compared in one numpy step.
_STEP = 1024
_ROWS = "doc_id long, part string, mask int, edge long, fp long, digest binary"


def failures(text: Column, min_words: int = 200, distinct_percent: int = 50, upper_percent: int = 2, marks: str = r"[#$%&*|]") -> Column:
    """The mask of the filters A to D that a text (not null) fails; words are runs without ASCII white space, case-sensitive."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    upper = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))

    def mask(w: Column) -> Column:
        few = F.size(w) < min_words
        repetitive = 100 * F.size(F.array_distinct(w)).cast("long") < distinct_percent * F.size(w).cast("long")
        loud = 100 * upper.cast("long") > upper_percent * F.length(text).cast("long")
        conditions = {"A": few, "B": repetitive, "C": loud, "D": text.rlike(marks)}
        return sum((F.when(c, BIT[f]).otherwise(0) for f, c in conditions.items()), F.lit(0))

    return F.transform(F.array(words), mask)[0]  # the words are worked out once


class _Range:
    """The sorted rows (fp, text, doc_id, part, mask) of one range, step by step.

    Equal texts are a group; its smallest doc_id comes first. A group is an edge if its fingerprint is the range's first or
    may be its last, so that earlier or later ranges may hold the same text.
    """

    def __init__(self, number: int):
        self.number, self.edges, self.first_fp, self.last_fp = number, 0, None, None
        self.last: tuple[str, int, int] | None = None  # text, smallest doc_id and edge of the latest row's group
        self.held: list[tuple[int, str, int]] = []  # edges (number, text, smallest doc_id) of the latest fingerprint

    def step(self, rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[tuple[int, str, int]]]:
        """(whether an earlier row has the same text and a smaller doc_id; each row's edge or -1; new edges of the first fingerprint)."""
        fp, text, ids = rows.column(0).to_numpy(), rows.column(1), rows.column(2).to_numpy()
        near = np.flatnonzero(fp[1:] == fp[:-1]) + 1
        begins = np.ones(len(fp), bool)
        begins[near] = pc.not_equal(text.take(pa.array(near)), text.take(pa.array(near - 1))).to_numpy(zero_copy_only=False)
        goes_on = self.last is not None and int(fp[0]) == self.last_fp and text[0].as_py() == self.last[0]
        begin = np.flatnonzero(begins)
        group = np.cumsum(begins) - 1
        smallest, edge, told = ids[begin].copy(), np.full(len(begin), -1), []
        if self.first_fp is None:
            self.first_fp = int(fp[0])
        if self.last_fp != int(fp[-1]):
            self.held, self.last_fp = [], int(fp[-1])
        for g in np.flatnonzero((fp[begin] == self.first_fp) | (fp[begin] == self.last_fp)).tolist():
            if g == 0 and goes_on:
                continue
            edge[g] = self.number << 32 | self.edges
            self.edges += 1
            found = told if fp[begin[g]] == self.first_fp else self.held
            found.append((int(edge[g]), text[int(begin[g])].as_py(), int(smallest[g])))
        if goes_on:
            smallest[0], edge[0] = self.last[1:]
        self.last = (text[len(fp) - 1].as_py(), int(smallest[-1]), int(edge[-1]))
        return ids > smallest[group], edge[group], told


def _told(fp: int | None, edges: list[tuple[int, str, int]]) -> pa.RecordBatch:
    numbers, texts, ids = zip(*edges, strict=True)
    n = len(edges)
    columns = [pa.array(ids, pa.int64()), pa.nulls(n, pa.string()), pa.nulls(n, pa.int32()), pa.array(numbers, pa.int64()), pa.array([fp] * n, pa.int64())]
    return pa.RecordBatch.from_arrays([*columns, pa.array([hashlib.sha256(t.encode()).digest() for t in texts])], ["doc_id", "part", "mask", "edge", "fp", "digest"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of one range -> its rows, and its edges (those rows that have a digest)."""
    state = _Range(TaskContext.get().partitionId())
    for batch in batches:
        for at in range(0, batch.num_rows, _STEP):
            rows = batch.slice(at, _STEP)
            later, edge, told = state.step(rows)
            mask = rows.column(4).to_numpy() | np.where(later, BIT["E"], 0)
            nothing = [pa.nulls(rows.num_rows, pa.int64()), pa.nulls(rows.num_rows, pa.binary())]
            own = [rows.column(2), rows.column(3), pa.array(mask.astype(np.int32)), pa.array(edge, pa.int64(), mask=(edge < 0) | later)]
            yield pa.RecordBatch.from_arrays(own + nothing, ["doc_id", "part", "mask", "edge", "fp", "digest"])
            if told:
                yield _told(state.first_fp, told)
    if state.held:
        yield _told(state.last_fp, state.held)


def failure_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """-> (part, mask, n, good, toxic): the documents of each part by the set of filters that they fail, and how many of these are
    labelled quality 1, and toxic 1. Additive: counters of several tables of different texts can be summed.

    Null texts are empty, null parts the empty string. A document fails E if a smaller doc_id has the same text; a row whose doc_id is null has no smaller
    one, and is none to others; it has no labels. Repeated rows are documents of their own. A document with several rows of
    labels is good, or toxic, if one of them says so. Other columns are ignored; an empty table gives an empty result.
    """
    docs = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
    )
    dealt = docs.where("doc_id IS NOT NULL").withColumn("fp", F.xxhash64("text")).withColumn("salt", F.monotonically_increasing_id())
    # The salt tells rows of one doc_id and text apart: a range never has to hold them all.
    ranges = dealt.repartitionByRange("fp", "doc_id", "salt").sortWithinPartitions("fp", "text", "doc_id")
    compared = cut(ranges.select("fp", "text", "doc_id", "part", failures(F.col("text")).alias("mask")).mapInArrow(_compare, _ROWS))
    nameless = docs.where("doc_id IS NULL").select("part", failures(F.col("text")).alias("mask"), F.lit(None).cast("long").alias("edge"), F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    flags = [F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0))).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))]
    known = cut(labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*flags))
    rows = compared.where("digest IS NULL").join(known, "doc_id", "left").select("part", "mask", "edge", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    counted = rows.union(nameless).groupBy("part", "mask", "edge").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    # Edges: a few for each range. One that has a smaller doc_id of its text in another range fails E.
    group = Window.partitionBy("fp", "digest")
    late = compared.where("digest IS NOT NULL").withColumn("least", F.min("doc_id").over(group)).where("doc_id > least").select("edge", F.lit(BIT["E"]).alias("late"))
    settled = counted.join(late, "edge", "left").withColumn("mask", F.col("mask").bitwiseOR(F.coalesce("late", F.lit(0))))
    return settled.groupBy("part", "mask").agg(*(F.sum(c).cast("long").alias(c) for c in ("n", "good", "toxic")))


def order_effects(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """failure_counts() -> for each part, each order of the filters and each step in it: part, filter_order, step, kept, removed,
    redundant, unique_fails, good_lost, toxic_lost and shapley (removed by the filter, summed over all orders)."""
    orders = ["".join(x) for x in itertools.permutations(filters)]
    steps = [{"filter_order": o, "step": k + 1, "bit": BIT[f], "before": sum(BIT[x] for x in o[:k])} for o in orders for k, f in enumerate(o)]
    plan = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order string, step int, bit int, before int>>")
    masks = F.sequence(F.lit(0), F.lit((1 << len(filters)) - 1))
    entry = F.struct("mask", F.struct("n", "good", "toxic"))
    parts = counts.groupBy("part").agg(F.map_from_entries(F.collect_list(entry)).alias("by_mask"))  # at most 2^filters entries

    def by_mask(column: str) -> Column:
        return F.transform(masks, lambda m: F.coalesce(F.element_at("by_mask", m)[column], F.lit(0))).alias(column)

    rows = parts.select("part", by_mask("n"), by_mask("good"), by_mask("toxic")).select("*", F.explode(plan).alias("s")).select("*", "s.*")

    def total(column: str, when) -> Column:
        """The column's sum over the masks for which it holds."""
        return F.aggregate(masks, F.lit(0).cast("long"), lambda acc, m: acc + F.when(when(m), F.element_at(column, m + 1)).otherwise(0))

    bit, before = F.col("bit"), F.col("before")
    fails, earlier = (lambda m: m.bitwiseAND(bit) != 0), (lambda m: m.bitwiseAND(before) != 0)
    removed = lambda m: fails(m) & ~earlier(m)
    # Of the orders, the one-in-|m| share in which the filter is first among those that a document fails removes it there.
    share = F.aggregate(masks, F.lit(0).cast("long"), lambda acc, m: acc + F.when(fails(m), F.element_at("n", m + 1) * F.floor(F.lit(len(orders)) / F.greatest(F.bit_count(m), F.lit(1)))).otherwise(0))
    return rows.select(
        "part", "filter_order", "step", total("n", lambda m: ~fails(m) & ~earlier(m)).alias("kept"), total("n", removed).alias("removed"),
        total("n", lambda m: fails(m) & earlier(m)).alias("redundant"), total("n", lambda m: m == bit).alias("unique_fails"),
        total("good", removed).alias("good_lost"), total("toxic", removed).alias("toxic_lost"), share.alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The effects of every order of the five filters, for each source of docs. Odd rows: see failure_counts()."""
    return order_effects(failure_counts(docs, labels))
