"""Embedding near-duplicates: int8 tile products with rigorous error bounds, then exact cosines of what may be a link.

Distinct vectors are scaled to length 1 and quantised to int8 with a scale of their own; the length of what quantisation
loses is kept. A tile multiplies two blocks of quantised vectors (in float32, where sums of int8 products are exact), and
by the triangle and Cauchy-Schwarz inequalities |x.y - x'.y'| <= ex (1 + ey) + ey (1 + ex) + ex ey: pairs that may reach
the threshold by this bound, and no others, are computed again in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import connected_components
from tidemark.session import cut, scratch

#: Vectors of a block, on average. Memory of a tile: the square of it, in float32. Each block goes to half as many tiles as
#: there are blocks.
BLOCK = 2048
#: Dimensions of one exact float32 product: 1024 * 127 * 127 < 2**24.
EXACT_DIMS = 1024
#: Pairs of a tile that are computed again in double precision at a time.
RECHECK = 1 << 16


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 vectors, value of one unit, length of the loss) of unit vectors, the loss rounded up."""
    unit = np.abs(x).max(1) / 127
    q = np.rint(x / unit[:, None])
    return q.astype(np.int8), unit, np.sqrt(((x - q * unit[:, None]) ** 2).sum(1)) + 1e-12


def _packed(x: np.ndarray) -> np.ndarray:
    """In float32 where that loses nothing (as from a table of floats), else in float64."""
    short = x.astype(np.float32)
    return short if np.array_equal(short, x) else x


def _block(rows: pa.Table) -> pa.Table:
    x = _matrix(rows["v"])
    x = x / np.abs(x).max(1, keepdims=True)  # keeps squares in range
    q, unit, loss = quantise(x / np.sqrt((x * x).sum(1, keepdims=True)))
    one = lambda a, t: pa.array([a.tobytes()], t)
    return pa.table({
        "dim": rows["dim"].slice(0, 1), "block": rows["block"].slice(0, 1), "blocks": rows["blocks"].slice(0, 1),
        "ids": one(rows["id"].to_numpy(), pa.binary()), "copies": one(rows["n"].to_numpy(), pa.binary()), "v": one(_packed(_matrix(rows["v"])), pa.binary()), "q": one(q, pa.binary()), "unit": one(unit, pa.binary()), "loss": one(loss, pa.binary()),
    })


def tile(q1: np.ndarray, u1: np.ndarray, e1: np.ndarray, q2: np.ndarray, u2: np.ndarray, e2: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs whose product may reach `least`."""
    dots = np.zeros((len(q1), len(q2)), np.float32 if q1.shape[1] <= EXACT_DIMS else np.float64)
    for d in range(0, q1.shape[1], EXACT_DIMS):
        dots += q1[:, d : d + EXACT_DIMS].astype(np.float32) @ q2[:, d : d + EXACT_DIMS].astype(np.float32).T
    # First by the whole tile's largest loss and units row by row, then pair by pair.
    most = e1.max() * (1 + e2.max()) + e2.max() * (1 + e1.max()) + e1.max() * e2.max() + 1e-9
    i, j = np.nonzero(dots >= ((least - most) / u1 / u2.max() * (1 - 1e-6) - 1).astype(np.float32)[:, None])
    bound = e1[i] * (1 + e2[j]) + e2[j] * (1 + e1[i]) + e1[i] * e2[j] + 1e-9
    may = dots[i, j].astype(np.float64) * u1[i] * u2[j] + bound >= least
    return i[may], j[may]


def _cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row, in double precision."""
    x, y = x.astype(np.float64), y.astype(np.float64)
    x, y = x / np.abs(x).max(1, keepdims=True), y / np.abs(y).max(1, keepdims=True)
    return np.einsum("ij,ij->i", x, y) / (np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y)))


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of links, so that a group of any density gives fewer rows than it has vectors."""
    top: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := top.setdefault(x, x)) != x:
            top[x] = x = top[up]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        rx, ry = root(x), root(y)
        if rx != ry:
            top[max(rx, ry)] = min(rx, ry)
            out.append((x, y))
    return out


def _tiles(least: float):
    """Tiles -> (id, other, n): with `other`, a link of the tile's spanning forest (n is 0); without, the number n of vectors
    (copies counted) that the tile links with id."""

    def read(x: dict, k: int) -> tuple[np.ndarray, ...]:
        i, n, u, e, q = (np.frombuffer(x[f"{c}{k}"], t) for c, t in (("ids", np.int64), ("copies", np.int64), ("unit", float), ("loss", float), ("q", np.int8)))
        v = np.frombuffer(x[f"v{k}"], np.float32 if len(x[f"v{k}"]) == 4 * len(q) else np.float64)
        return i, n, u, e, q.reshape(len(i), -1), v.reshape(len(i), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                x = batch.slice(r, 1).to_pylist()[0]
                (i1, n1, u1, e1, q1, v1), (i2, n2, u2, e2, q2, v2) = read(x, 1), read(x, 2)
                i, j = tile(q1, u1, e1, q2, u2, e2, least)
                if x["same"]:
                    i, j = i[i < j], j[i < j]
                sure = np.zeros(len(i), bool)
                for at in range(0, len(i), RECHECK):
                    some = slice(at, at + RECHECK)
                    sure[some] = _cosines(v1[i[some]], v2[j[some]]) >= least
                i, j = i[sure], j[sure]
                links = _forest(i1[i], i2[j])
                ids, other, n = [a for a, _ in links], [b for _, b in links], [0] * len(links)
                for own, place, weight in ((i1, i, n2[j]), (i2, j, n1[i])):
                    total = np.bincount(place, weight, len(own)).astype(np.int64)
                    linked = np.flatnonzero(total)
                    ids += own[linked].tolist()
                    other += [None] * len(linked)
                    n += total[linked].tolist()
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(other, pa.int64()), pa.array(n, pa.int64())], ["id", "other", "n"])

    return run


def embedding_duplicates(vectors: DataFrame, least: float = 0.9, block: int = BLOCK, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vectors -> (vec_id, n_links, component_id, kept): all vectors linked by a cosine of `least` or more.

    Equal vectors are one class, linked with each other. Distinct vectors are dealt at random to blocks; each unordered
    pair of blocks is one tile. Vectors of different lengths are never linked. n_links counts every linked vector.

    A tile computes again in double precision what may be a link, and returns only sums and a spanning forest: no pair of a
    group is ever a row.

    Vectors that are null, empty, zero or hold a null or non-finite component link with nothing. Equal vectors with
    ids of their own count each; rows that repeat an id and its vector get a result each (n_links then counts rows of the
    own vector); rows with a null id link with nothing (component_id null, kept). An empty table gives an empty result.
    """
    v = F.col(vector_col).cast("array<double>")
    fine = F.col(id_col).isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"), F.coalesce(fine, F.lit(False)).alias("fine"))
    rows = rows.select("vec_id", "v", "fine", F.when(F.col("fine"), F.xxhash64("v")).alias("h1"), F.when(F.col("fine"), F.xxhash64(F.lit(1), "v")).alias("h2"))
    with scratch() as tables:
        classes = cut(rows.where("fine").groupBy("h1", "h2").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"), F.first("v").alias("v")))
        sizes = classes.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("m"))
        own = classes.select("id", "n", "v", F.size("v").alias("dim")).join(sizes, "dim")
        blocks = F.ceil(F.col("m") / block).cast("long")
        own = own.select("id", "n", "v", "dim", blocks.alias("blocks"), F.pmod(F.xxhash64("id"), blocks).alias("block"))
        shape = "dim int, block long, blocks long, ids binary, copies binary, v binary, q binary, unit binary, loss binary"
        packed = cut(own.groupBy("dim", "block").applyInArrow(_block, shape))
        # Block i meets i, i + 1, ... i + half, modulo the number of blocks: every unordered pair once, the same number for each.
        half = F.floor(F.col("blocks") / 2)
        parts = ("ids", "copies", "v", "q", "unit", "loss")
        one = packed.select("dim", "blocks", *(F.col(c).alias(f"{c}1") for c in ("block", *parts)), F.explode(F.sequence(F.lit(0).cast("long"), half)).alias("step"))
        one = one.where((F.col("blocks") % 2 == 1) | (F.col("step") < half) | (F.col("block1") < half) | (F.col("blocks") == 1))
        one = one.withColumn("block2", F.pmod(F.col("block1") + F.col("step"), F.col("blocks"))).withColumn("same", F.col("step") == 0)
        two = packed.select("dim", *(F.col(c).alias(f"{c}2") for c in ("block", *parts)))
        met = cut(one.join(two, ["dim", "block2"]).mapInArrow(_tiles(least), "id long, other long, n long"))
        more = met.where("other is null").groupBy("id").agg(F.sum("n").alias("more"))
        links = cut(met.where("other is not null").select(F.greatest("id", "other").alias("a"), F.least("id", "other").alias("b")).distinct())
        found = classes.join(more, "id", "left").join(connected_components(links), "id", "left")
        found = tables.keep(cut(found.select("h1", "h2", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("links"), F.coalesce("component", "id").alias("class_id"))))
    component = F.coalesce("class_id", "vec_id")
    return rows.select("vec_id", "h1", "h2").join(found, ["h1", "h2"], "left").select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept")
    )
