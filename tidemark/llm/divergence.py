"""Audit of how the term use of a language's sources diverges.

Terms are counted by (lang, source, term); a kept term is then one wide row, its counts in an array indexed by the language's
sources. Higher-order functions turn the array into smoothed integer shares and emit the differences of every pair of
sources, which partial aggregates sum on the map side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.text import byte_slices
from tidemark.session import cut

#: Bytes that terms are made of: ASCII letters, and all of characters beyond ASCII.
TERM = np.zeros(256, bool)
TERM[0x41:0x5B] = TERM[0x61:0x7B] = TERM[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
#: Shares are whole numbers of a billionth; each term counts so many times more than it occurs.
SCALE, EXTRA = 1_000_000_000, 5
#: (lang, source) groups up to which a language's list of sources is broadcast (at most some 20 MB); beyond, it is joined by salted keys.
BROADCAST_GROUPS = 100_000
_SALTS = 64


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) -> (lang, source, term, n, docs), summed over a run of texts; docs: texts of the run with the term."""
    for batch in batches:
        for row, to, data, offsets in byte_slices(batch.column(2)):
            groups = pa.StructArray.from_arrays([batch.column(0).slice(row, to - row), batch.column(1).slice(row, to - row)], ["l", "s"])
            names, group = {}, np.empty(to - row, np.int64)
            for i, x in enumerate(zip(groups.field(0).to_pylist(), groups.field(1).to_pylist(), strict=True)):
                group[i] = names.setdefault(x, len(names))
            inside = np.zeros(len(data) + 1, bool)
            inside[:-1] = TERM[data]
            begins = np.zeros(len(data) + 1, bool)
            begins[offsets] = True
            before = np.concatenate([[False], inside[:-1]])
            start = np.flatnonzero(inside & (begins | ~before))
            if not len(start):
                continue
            end = np.flatnonzero(before & (begins | ~inside))
            own = _LOWER[data[inside[:-1]]]  # the terms' bytes in a row
            at = np.concatenate([[0], np.cumsum(end - start)])
            words = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(own)]).dictionary_encode()
            term, many = words.indices.to_numpy().astype(np.int64), len(words.dictionary)
            doc = np.searchsorted(offsets, start, "right") - 1
            pairs, n = np.unique(doc * many + term, return_counts=True)
            keys, place = np.unique(group[pairs // many] * many + pairs % many, return_inverse=True)
            listed = [*names]
            which = pa.array(keys // many)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([x for x, _ in listed], pa.string()).take(which), pa.array([x for _, x in listed], pa.string()).take(which),
                    words.dictionary.take(pa.array(keys % many)).cast(pa.string()), pa.array(np.bincount(place, n).astype(np.int64)), pa.array(np.bincount(place).astype(np.int64)),
                ],
                ["lang", "source", "term", "n", "docs"],
            )


def _named(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))


def _share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + EXTRA) / (total + EXTRA * kept)), exact for any counts."""
    over = (count.cast("decimal(19,0)") + EXTRA).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    under = (total.cast("decimal(19,0)") + EXTRA * kept.cast("decimal(17,0)")).cast("decimal(22,0)")
    return 1 + F.call_function("div", over, under)


def _beside(wide: DataFrame, sides: DataFrame, groups: int) -> DataFrame:
    """wide (lang, ...) with the columns of sides (one row a language)."""
    if groups <= BROADCAST_GROUPS:
        return wide.join(F.broadcast(sides), "lang")
    salted = sides.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    return wide.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(_SALTS)).cast("int")).join(salted, ["lang", "salt"]).drop("salt")


def source_divergence(
    docs: DataFrame, min_docs: int = 30, top: int = 50, text_col: str = "text", lang_col: str = "lang", source_col: str = "source"
) -> DataFrame:
    """docs -> (lang, source, part, item, value, rank). Part "pair": every other source of the language by how far its shares of the
    kept terms are from this source's, in sum. Part "term": the `top` kept terms that this source uses more than its language does.

    A language keeps the terms that at least min_docs of its rows hold. Null texts, languages and sources are empty strings; repeated rows count
    each; sources without terms have pairs (of value 0 if the language keeps no term); a language of one source has no
    pairs. Other columns are ignored; an empty table gives an empty result. Work and result grow with the square of a
    language's number of sources; a term's row holds one number for each of them.
    """
    named = _named(docs, text_col, lang_col, source_col)
    groups = cut(named.select("lang", "source").distinct())
    counts = named.mapInArrow(_term_counts, "lang string, source string, term string, n long, docs long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    numbered = groups.withColumn("s", F.row_number().over(Window.partitionBy("lang").orderBy("source")))
    terms = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("found"))
    kept = cut(terms.where(F.col("docs") >= min_docs).select("lang", "term", "found"))
    totals = kept.select("lang", F.explode("found").alias("x")).groupBy("lang", F.col("x.source").alias("source")).agg(F.sum("x.n").alias("total"))
    sizes = kept.groupBy("lang").agg(F.count("*").alias("kept"))
    group = numbered.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
    group = cut(group.select("lang", "source", "s", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("kept", F.lit(0)).alias("kept")))
    sides = group.groupBy("lang").agg(
        F.array_sort(F.collect_list(F.struct("s", "source", "total"))).alias("sources"), F.max("kept").alias("kept"), F.sum("total").alias("all"),
    )
    wide = _beside(kept.withColumn("found", F.map_from_entries("found")), sides, groups.count())
    count = F.transform("sources", lambda g: F.coalesce(F.element_at("found", g["source"]), F.lit(0)))
    wide = wide.select("lang", "term", "sources", "kept", "all", count.alias("count"))
    share = F.transform("sources", lambda g: _share(F.element_at("count", g["s"]), g["total"], F.col("kept")))
    summed = F.aggregate("count", F.lit(0).cast("long"), lambda a, x: a + x)
    wide = cut(wide.select("lang", "term", "count", share.alias("p"), _share(summed, F.col("all"), F.col("kept")).alias("q")))

    # One row for each source of a term, then one for each later source: no row holds more than a language's sources.
    of_one = wide.select("lang", "p", F.posexplode("p").alias("i", "own"))
    of_two = of_one.select("lang", (F.col("i") + 1).alias("i"), "own", F.posexplode(F.expr("slice(p, i + 2, size(p))")).alias("k", "other"))
    pairs = of_two.groupBy("lang", "i", (F.col("i") + F.col("k") + 1).alias("j")).agg(F.sum(F.abs(F.col("own") - F.col("other"))).alias("value"))
    both = pairs.select("lang", F.explode(F.array(F.struct("i", "j", "value"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), "value"))).alias("x")).select("lang", "x.*")
    one, two = (numbered.select("lang", F.col("source").alias(name), F.col("s").alias(key)) for name, key in (("source", "i"), ("item", "j")))
    every = one.join(two, "lang").where("i <> j").join(both, ["lang", "i", "j"], "left")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair_rows = every.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value")).withColumn("rank", F.row_number().over(order))

    used = wide.select("lang", F.col("term").alias("item"), "q", F.posexplode(F.arrays_zip("count", "p")).alias("i", "x"))
    used = used.where("x.count > 0 AND x.p > q").select("lang", (F.col("i") + 1).alias("i"), "item", (F.col("x.p") - F.col("q")).alias("value"))
    first = used.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "i").orderBy(F.desc("value"), "item"))).where(F.col("rank") <= top)
    term_rows = first.join(one, ["lang", "i"]).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return pair_rows.union(term_rows)
