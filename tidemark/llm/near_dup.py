"""MinHash near-duplicates: fast similarity sketches, banding, exact verification and connected components.

The sketch is that of Dahlgaard, Knudsen and Thorup (Fast Similarity Sketching, 2017): in round i every shingle is
thrown into one hashed bin with a value in [i, i + 1); rounds COORDS to 2 * COORDS - 1 throw every shingle into the one
bin i - COORDS, so that every coordinate of any set that isn't empty is filled, and the number of equal coordinates of
two sets is concentrated around COORDS times their Jaccard similarity.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import connected_components
from tidemark.llm.text import NOT_SPACE, byte_slices, distinct_sets, mix, shingles, words_of
from tidemark.session import cut, scratch

#: 128 coordinates in 32 bands of 4: a pair at similarity 0.8 shares no band with probability 5e-8.
COORDS, BANDS = 128, 32
ROWS = COORDS // BANDS
#: What buckets still hold apart is compared by sketch bytes first. 0.16 below the threshold is over 4.5 standard deviations.
SKETCH_SLACK = 0.16
#: Members of a block of a tile, and their weight (elements of full sets), on average.
BLOCK, WEIGHT = 512, 1 << 20
#: Columns of the 0/1 matrices that count common elements at a time.
COLUMNS = 4096
_SEED = np.random.Generator(np.random.PCG64(7)).integers(0, 2**64, 2 * COORDS, dtype=np.uint64)


def sketch(h: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """(n, COORDS) sketch of the distinct sets (hash, text number); rows of empty sets hold the largest value."""
    full = np.iinfo(np.uint64).max
    out = np.full(n * COORDS, full, np.uint64)
    for i in range(2 * COORDS):
        if not len(h):
            break
        v = mix(h ^ _SEED[i])
        place = (v & np.uint64(COORDS - 1)) if i < COORDS else np.full(len(v), i - COORDS, np.uint64)
        # The round is the value's leading byte, so that earlier rounds always win.
        value = (np.uint64(i) << np.uint64(56)) | (v >> np.uint64(8))
        np.minimum.at(out, text * COORDS + place.astype(np.int64), value)
        open_ = (out.reshape(n, COORDS) == full).any(1)
        keep = open_[text]
        h, text = h[keep], text[keep]
    return out.reshape(n, COORDS)


def _signatures(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for row, to, data, offsets in byte_slices(batch.column(1)):
                n = to - row
                h, text = distinct_sets(*shingles(words_of(data, offsets, NOT_SPACE), words))
                size = np.bincount(text, minlength=n)
                s = sketch(h, text, n)
                bands = np.zeros((n, BANDS), np.uint64)
                for j in range(ROWS):
                    bands = mix(bands + s[:, j::ROWS] + np.uint64(j + 1))
                bands = mix(bands + np.arange(BANDS, dtype=np.uint64))
                sums = []
                for seed in (11, 12):
                    total = np.zeros(n, np.uint64)
                    np.add.at(total, text, mix(h ^ _SEED[seed]))
                    sums.append(mix(total + size.astype(np.uint64)).view(np.int64))
                filled = size > 0
                at = np.concatenate([[0], np.cumsum(filled * BANDS)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(row, n),
                        pa.array(size.astype(np.int64)),
                        pa.array(sums[0]),
                        pa.array(sums[1]),
                        pa.ListArray.from_arrays(pa.array(at), pa.array(bands[filled].reshape(-1).view(np.int64))),
                        pa.array([x.tobytes() for x in (s >> np.uint64(3)).astype(np.uint8)], pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "fp1", "fp2", "bands", "sketch"],
                )

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, to, data, offsets in byte_slices(batch.column(1)):
                h, text = distinct_sets(*shingles(words_of(data, offsets, NOT_SPACE), words))
                at = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=to - row))]).astype(np.int32)
                sets = pa.ListArray.from_arrays(pa.array(at), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, to - row), sets], ["id", "items"])

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b), those whose full sets reach the similarity. A pair's two sets meet by one join on the id, in
    which few pairs can be broadcast (Spark decides by their size), and one exchange of the sets that are needed."""
    both = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("id")).join(sets, "id").groupBy("a", "b")
    of = lambda c: F.first(F.when(F.col("id") == F.col(c), F.col("items")), ignorenulls=True)
    met = both.agg(of("a").alias("x"), of("b").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    x, y = F.col("x"), F.col("y")
    common, size = F.size(F.array_intersect(x, y)), F.size(x) + F.size(y)
    near = 100 * F.least(F.size(x), F.size(y)) >= percent * F.greatest(F.size(x), F.size(y))
    return met.where(F.when(near, 100 * common >= percent * (size - common)).otherwise(False)).select("a", "b")


def _forest(c1: np.ndarray, c2: np.ndarray) -> tuple[list[int], list[int]]:
    """A spanning forest of the edges between components: fewer edges than components, whatever the number of pairs."""
    top: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := top.setdefault(x, x)) != x:
            top[x] = x = top[up]
        return x

    a, b = [], []
    for x, y in np.unique(np.stack([np.maximum(c1, c2), np.minimum(c1, c2)], 1), axis=0).tolist():
        rx, ry = root(x), root(y)
        if rx != ry:
            top[max(rx, ry)] = min(rx, ry)
            a.append(x)
            b.append(y)
    return a, b


def _edges(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b = _forest(*(np.concatenate([np.zeros(0, np.int64), *(f[k] for f in found)]) for k in (0, 1)))
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _alike(least: float):
    """Tiles (c1, v1, c2, v2) of components and sketches -> a forest of the components whose sketches agree often enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                c1, c2 = (np.array(x[k], np.int64) for k in ("c1", "c2"))
                p, q = (np.frombuffer(b"".join(x[k]), np.uint8).reshape(-1, COORDS) for k in ("v1", "v2"))
                found = []
                for r in range(len(p)):
                    near = np.flatnonzero(((q == p[r]).sum(1) >= least) & (c2 != c1[r]))
                    found.append((np.full(len(near), c1[r]), c2[near]))
                yield _edges(found)

    return run


def common_sizes(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of all pairs of two lists of sets: 0/1 matrices over the elements that both lists hold, in
    column runs of bounded memory."""
    out = np.zeros((len(one), len(two)), np.int64)
    flat = [np.concatenate([np.zeros(0, np.int64), *x]) for x in (one, two)]
    both = np.intersect1d(*flat)
    own = []
    for sets, items in zip((one, two), flat, strict=True):
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(both, items), max(0, len(both) - 1))
        keep = both[at] == items if len(both) else np.zeros(len(items), bool)
        order = np.argsort(at[keep], kind="stable")
        own.append((at[keep][order], row[keep][order]))
    for begin in range(0, len(both), COLUMNS):
        m = []
        for (at, row), sets in zip(own, (one, two), strict=True):
            lo, hi = np.searchsorted(at, (begin, begin + COLUMNS))
            x = np.zeros((len(sets), min(COLUMNS, len(both) - begin)), np.float32)
            x[row[lo:hi], at[lo:hi] - begin] = 1
            m.append(x)
        out += np.rint(m[0] @ m[1].T).astype(np.int64)
    return out


def _linked(percent: int):
    """Tiles (c1, v1, c2, v2) of components and full sets -> a forest of the components that are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                c1, c2 = (batch[c][r].values.to_numpy(zero_copy_only=False) for c in ("c1", "c2"))
                one, two = ([s.values.to_numpy() for s in batch[c][r].values] for c in ("v1", "v2"))
                common = common_sizes(one, two)
                union = np.array([len(s) for s in one])[:, None] + np.array([len(s) for s in two])[None, :] - common
                i, j = np.nonzero((100 * common >= percent * union) & (c1[:, None] != c2[None, :]))
                yield _edges([(c1[i], c2[j])])

    return run


def _tiles(rows: DataFrame, percent: int) -> DataFrame:
    """rows (g, c, size, v), with a weight w, of groups g -> (c1, v1, c2, v2): blocks of a group that are to be compared.

    A large group is cut into blocks by set size (sizes that differ by more than the similarity allows never meet) and by
    a hash, each of about BLOCK members and WEIGHT weight; blocks that lie in the group's largest component aren't
    compared with each other. So a group that is linked already costs its other members times the group, in bounded tiles.
    """
    parts = rows.groupBy("g", "c").agg(F.count("*").alias("n"), F.sum("w").alias("w"))
    whole = parts.groupBy("g").agg(F.max(F.struct("n", "c")).alias("m"), F.sum("n").alias("n"), F.sum("w").alias("w"))
    whole = whole.select("g", F.col("m.c").alias("main"), "n", "w")
    large = (F.col("n") > BLOCK) | (F.col("total") > WEIGHT)
    dealt = rows.withColumnRenamed("w", "own").join(whole.withColumnRenamed("w", "total"), "g")
    step = math.log(100 / percent) * (1 + 1e-9) if percent < 100 else 1e-9
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("total") / WEIGHT))
    dealt = dealt.select(
        "g", "c", "v",
        (large & (F.col("c") == F.col("main"))).alias("side"),
        F.when(large, F.floor(F.log(F.col("size").cast("double")) / step)).otherwise(F.lit(0)).cast("long").alias("class"),
        F.when(large, F.pmod(F.xxhash64("v"), blocks)).otherwise(F.lit(0)).cast("long").alias("block"),
    )
    packed = cut(dealt.groupBy("g", "side", "class", "block").agg(F.collect_list(F.struct("c", "v")).alias("m")))
    x, y = packed.alias("x").where("NOT side"), packed.alias("y")
    near = F.abs(F.col("x.class") - F.col("y.class")) <= 1
    once = F.col("y.side") | (F.struct("x.class", "x.block") <= F.struct("y.class", "y.block"))
    met = x.join(y, (F.col("x.g") == F.col("y.g")) & near & once)
    return met.select(F.col("x.m.c").alias("c1"), F.col("x.m.v").alias("v1"), F.col("y.m.c").alias("c2"), F.col("y.m.v").alias("v2"))


def _apart(members: DataFrame, found: DataFrame) -> DataFrame:
    """(key, id, c) of the buckets that hold several components."""
    tagged = members.select("key", "id").join(found, "id", "left").select("key", "id", F.coalesce("component", "id").alias("c"))
    several = tagged.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("key")
    return tagged.join(several, "key")


def _by_rows(docs: DataFrame, words: int, percent: int, tables) -> DataFrame:
    """near_duplicates() of docs in which an id has several texts: rows are linked under numbers of their own, and then ids by the groups of
    rows that they are in."""
    keyed = cut(docs.withColumn("row", F.monotonically_increasing_id()))
    rows = near_duplicates(keyed.select("row", "text"), words, percent, "row", "text", unique=True).select(F.col("doc_id").alias("row"), "n_shingles", F.col("component_id").alias("g"))
    rows = tables.keep(cut(rows.join(keyed.select("row", F.col("doc_id").alias("id")), "row")))
    named = rows.where("n_shingles > 0 AND id IS NOT NULL")
    # An id is one node: it hangs on the smallest id of each group that it is in.
    least = cut(named.groupBy("g").agg(F.min("id").alias("b")))
    found = tables.keep(cut(connected_components(cut(named.join(least, "g").where("id <> b").select(F.col("id").alias("a"), "b").distinct()))))
    out = rows.select(F.col("id").alias("doc_id"), "n_shingles").join(found.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    linked = F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", linked.alias("component_id"), F.col("doc_id").eqNullSafe(linked).alias("kept"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", unique: bool = False) -> DataFrame:
    """docs -> (doc_id, n_shingles, component_id, kept): groups of documents linked at 100 * intersection >= percent *
    union of their sets of distinct word shingles (lower-cased A-Z, words divided by ASCII white space).

    Equal sets are one class from the start. Candidates come from bands. Every class first meets the pivot of one of its
    buckets. Buckets that still hold several components are compared by sketches, in tiles that give a forest of the
    components that may be linked; then the classes of each such neighbourhood meet once with their full sets, in tiles
    that again give no more than a forest. No pair of a group is ever a row, no bucket is capped, and every link is
    confirmed on full sets. unique: ids are known to be those of one row each.

    Null and empty texts, and texts without words, have an empty set and link with nothing; repeated texts are
    links between equal sets; rows that repeat an id get a result each, and are one document, whether their texts are the same or not: what
    links with any of them links with the id (see _by_rows). Rows with a null id link with nothing (component_id null, kept); an empty
    table gives an empty result; other columns are ignored.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    with scratch() as tables:
        sig = tables.keep(cut(docs.mapInArrow(_signatures(words), "doc_id long, n_shingles long, fp1 long, fp2 long, bands array<long>, sketch binary")))
        # One row for each distinct set: its smallest document stands for it, with its bands and sketch.
        one = F.min_by(F.struct("bands", "sketch"), "doc_id").alias("s")
        own = sig.where("n_shingles > 0 and doc_id is not null")
        if not unique:
            sets = own.groupBy("doc_id").agg(F.min("fp1").alias("lo1"), F.max("fp1").alias("hi1"), F.min("fp2").alias("lo2"), F.max("fp2").alias("hi2"))
            if not sets.where("lo1 < hi1 OR lo2 < hi2").isEmpty():
                return _by_rows(docs, words, percent, tables)
        classes = cut(own.groupBy("fp1", "fp2").agg(F.min("doc_id").alias("rep"), F.min("n_shingles").alias("size"), one))
        reps = classes.select(F.col("rep").alias("id"), "size", "s.bands", "s.sketch")

        banded = reps.select("id", F.explode("bands").alias("key"))
        first = F.min(F.struct(F.xxhash64("id").alias("h"), "id"))
        buckets = banded.groupBy("key").agg(F.count("*").alias("n"), first.alias("p")).where("n > 1").select("key", F.col("p.id").alias("p"))
        members = cut(banded.join(buckets, "key"))
        # The pivot of one bucket of each class: the first by a hash that is the same for all, so that a group meets few.
        first = F.min(F.struct(F.xxhash64("p").alias("h"), "p")).alias("first")
        pairs = members.where("id <> p").groupBy("id").agg(first).select(F.greatest("id", "first.p").alias("a"), F.least("id", "first.p").alias("b"))
        ids = members.select(F.col("id").alias("doc_id")).distinct()
        sets = cut(docs.join(ids, "doc_id").groupBy("doc_id").agg(F.min("text")).mapInArrow(_sets(words), "id long, items array<long>"))
        links = cut(_confirmed(cut(pairs.distinct()), sets, percent))
        found = connected_components(links)

        apart = cut(_apart(members, found))
        rows = apart.join(reps.select("id", "size", "sketch"), "id").select(F.col("key").alias("g"), "c", "size", F.col("sketch").alias("v"), F.lit(1).alias("w"))
        least = (percent / 100 - SKETCH_SLACK) * COORDS
        maybe = cut(_tiles(rows, percent).mapInArrow(_alike(least), "a long, b long").distinct())
        zones = connected_components(maybe).select(F.col("id").alias("c"), F.col("component").alias("g"))
        rows = apart.select("id", "c").distinct().join(zones, "c").join(sets, "id")
        rows = rows.select("g", "c", F.size("items").alias("size"), F.col("items").alias("v"), F.size("items").alias("w"))
        more = cut(_tiles(rows, percent).mapInArrow(_linked(percent), "a long, b long").distinct())
        found = connected_components(cut(found.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more)))

        classes = classes.join(found.withColumnRenamed("id", "rep"), "rep", "left")
        classes = tables.keep(cut(classes.select("fp1", "fp2", F.coalesce("component", "rep").alias("class_id"))))
    return sig.select("doc_id", "n_shingles", "fp1", "fp2").join(classes, ["fp1", "fp2"], "left").select(
        "doc_id", "n_shingles",
        (id_ := F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("class_id")).otherwise(F.col("doc_id"))).alias("component_id"),
        F.col("doc_id").eqNullSafe(id_).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents of which one row of each group stays (the one with the smallest id, null ids last), all columns as
    they were. Groups are of rows, under a key written at the start beside the row, so that null and repeated ids are rows
    like any other and no column name clashes. Null texts and texts without words stay; an empty table gives an empty one."""
    with scratch() as tables:
        keyed = tables.keep(cut(docs.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("doc"))))
        texts = keyed.select("row", F.col("doc").getField(text_col).alias("text"))
        groups = near_duplicates(texts, words, percent, "row", "text", unique=True).where("n_shingles > 0").select(F.col("doc_id").alias("row"), F.col("component_id").alias("group"))
        groups = cut(groups.join(keyed.select("row", F.col("doc").getField(id_col).cast("long").alias("id")), "row"))
        stays = groups.groupBy("group").agg(F.count("*").alias("n"), F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("first"))
        several = stays.where("n > 1").select("group", F.col("first.row").alias("stay"))
        gone = tables.keep(cut(groups.join(several, "group").where("row <> stay").select("row")))
    return keyed.join(gone, "row", "left_anti").select("doc.*")
