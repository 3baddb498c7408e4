"""Line deduplication through a sharded minimal perfect hash over the distinct line hashes.

Every shard is one row: the bit levels of a minimal perfect hash (Limasset et al., 2017), and the arrays of
fingerprints and document counts that it indexes. Blocks of documents send their distinct line hashes to the shards and
get back those that are too frequent; lines themselves are never joined.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import mix
from tidemark.session import cut

#: Keys of one shard, and documents and characters of one block, on average.
SHARD_KEYS, BLOCK_DOCS, BLOCK_CHARS = 16384, 400, 1 << 20
#: Blocks that may ask one shard for the same key; shards with keys of more blocks are salted.
ASKING = 65536
_WHITE = " \t\n\x0b\x0c\r"
_ROOM = 2  # bits for a key of each level


def _bit_counts(bits: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(bits)])


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: key k lands on the first level where it is alone on its bit. Equal keys
    would never be alone: build() raises on them."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.base = np.concatenate([[0], np.cumsum([x.sum() for x in levels])]).astype(np.int64)
        self.rank = [_bit_counts(x) for x in levels]

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels = []
        if len(np.unique(keys)) < len(keys):
            raise ValueError("keys repeat")
        while len(keys):
            size = max(8, _ROOM * len(keys))
            at = cls._place(keys, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            keys = keys[~alone[at]]
        return cls(levels)

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys ^ np.uint64(0xA5A5 + 7919 * level)) % np.uint64(size)).astype(np.int64)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """0 to n - 1 for keys of the set, any of these or -1 for others."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            at = self._place(keys[left], level, len(bits))
            hit = bits[at]
            out[left[hit]] = self.base[level] + self.rank[level][at[hit]]
            left = left[~hit]
        return out

    def pack(self) -> tuple[list[int], bytes]:
        return [len(x) for x in self.levels], np.packbits(np.concatenate([*self.levels, np.zeros(0, bool)])).tobytes()

    @classmethod
    def unpack(cls, sizes: list[int], raw: bytes) -> PerfectHash:
        bits = np.unpackbits(np.frombuffer(raw, np.uint8)).astype(bool)
        ends = np.cumsum(sizes)
        return cls([bits[e - s : e] for s, e in zip(sizes, ends, strict=True)])


def _build_shard(rows: pa.Table) -> pa.Table:
    """One shard. The function is over the distinct first hashes; where different keys share one, the first of them is
    indexed and the others stand in an exact side list (h1, h2, count)."""
    h1, h2 = (rows[c].to_numpy().view(np.uint64) for c in ("h1", "h2"))
    count = rows["n"].to_numpy()
    order = np.lexsort((h2, h1))
    again = np.zeros(len(h1), bool)
    again[order[1:]] = h1[order[1:]] == h1[order[:-1]]
    side = np.stack([h1[again].view(np.int64), h2[again].view(np.int64), count[again]])
    h1, h2, count = h1[~again], h2[~again], count[~again]
    function = PerfectHash.build(h1)
    at = function.index(h1)
    marks, counts = np.empty(len(at), np.uint32), np.empty(len(at), np.min_scalar_type(int(count.max())))
    marks[at], counts[at] = h2.astype(np.uint32), count
    sizes, bits = function.pack()
    return pa.table({
        "shard": rows["shard"].slice(0, 1), "sizes": pa.array([sizes], pa.list_(pa.int64())), "bits": pa.array([bits], pa.binary()),
        "marks": pa.array([marks.tobytes()], pa.binary()), "counts": pa.array([counts.tobytes()], pa.binary()),
        "width": pa.array([counts.itemsize], pa.int32()), "side": pa.array([side.tobytes()], pa.binary()),
    })


def _probe(least: int):
    def run(asked: pa.Table, index: pa.Table) -> pa.Table:
        if not index.num_rows or not asked.num_rows:
            return asked.slice(0, 0).select(["block", "h1", "h2"])
        x = index.slice(0, 1).to_pylist()[0]
        marks = np.frombuffer(x["marks"], np.uint32)
        counts = np.frombuffer(x["counts"], f"u{x['width']}")
        h1, h2 = (asked[c].to_numpy().view(np.uint64) for c in ("h1", "h2"))
        at = PerfectHash.unpack(x["sizes"], x["bits"]).index(h1)
        often = (at >= 0) & (marks[at] == h2.astype(np.uint32)) & (counts[at] >= least)
        for a, b, n in np.frombuffer(x["side"], np.int64).reshape(3, -1).T.tolist():
            own = (h1.view(np.int64) == a) & (h2.view(np.int64) == b)
            often[own] = n >= least
        return asked.filter(pa.array(often)).select(["block", "h1", "h2"])

    return run


def _drop(docs: pa.Table, often: pa.Table) -> pa.Table:
    gone = set(zip(often["h1"].to_pylist(), often["h2"].to_pylist(), strict=True))
    texts, dropped = docs["text"].to_pylist(), np.zeros(docs.num_rows, np.int64)
    if gone:
        for i, (a, b) in enumerate(zip(docs["a"].to_pylist(), docs["b"].to_pylist(), strict=True)):
            keep = [x not in gone for x in zip(a, b, strict=True)]
            if n := len(keep) - sum(keep):
                texts[i] = "\n".join(line for line, k in zip(texts[i].split("\n"), keep, strict=True) if k)
                dropped[i] = n
    return pa.table({
        "doc_id": docs["doc_id"], "text": pa.array(texts, pa.string()), "n_lines": docs["n_lines"], "n_dropped": pa.array(dropped), "row": docs["row"],
    })


def _line_key(line: Column) -> Column:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.trim(line, F.lit(_WHITE)), upper, lower)


def drop_frequent_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_columns: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    r"""docs -> (doc_id, text, n_lines, n_dropped): without the lines whose key is found in min_docs documents or more.

    A key is the line without ASCII white space at its ends and with A-Z lower-cased; keys under min_chars code points
    stay. Keys are told apart by two 64-bit hashes (the shard's fingerprint keeps 32 bits of the second).

    keep_columns: the result is instead docs with the new text, all other columns as they were.

    Null or empty text is one empty line and comes back as the empty text. Repeated lines of one document count once.
    Every row is a document of its own, whether its id is null or repeated. Other columns are ignored.
    """
    names = docs.columns
    row = F.struct(*(F.col(c) for c in names if c != text_col)) if keep_columns else F.lit(None).cast("boolean")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), row.alias("row"))
    # Rows get a number that is written once, so that all passes deal them alike, and repeated rows apart.
    docs = cut(docs.withColumn("number", F.monotonically_increasing_id()), "zstd")
    n, chars = docs.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    blocks = max(1, math.ceil(n / BLOCK_DOCS), math.ceil(chars / BLOCK_CHARS))
    keys = F.transform(F.split("text", "\n", -1), _line_key)
    hashed = docs.withColumn("keys", keys).select(
        "doc_id", "text", "row", F.size("keys").cast("long").alias("n_lines"),
        F.pmod(F.xxhash64("number"), F.lit(blocks)).alias("block"),
        F.transform("keys", lambda k: F.when(F.length(k) >= min_chars, F.xxhash64(k))).alias("a"),
        F.transform("keys", lambda k: F.when(F.length(k) >= min_chars, F.xxhash64(F.lit(1), k))).alias("b"),
    )
    lines = cut(
        hashed.select("block", F.explode(F.array_distinct(F.arrays_zip("a", "b"))).alias("x"))
        .select("block", F.col("x.a").alias("h1"), F.col("x.b").alias("h2")).where("h1 is not null")
    )
    # A key that only one row holds can't reach two documents; the index holds all keys all the same.
    counts = cut(lines.groupBy("h1", "h2").agg(F.count("*").alias("n")))
    shards = max(1, math.ceil(counts.count() / SHARD_KEYS))
    shard = F.pmod("h1", F.lit(shards)).alias("shard")
    counts = counts.select("h1", "h2", "n", shard)
    shape = "shard long, sizes array<long>, bits binary, marks binary, counts binary, width int, side binary"
    index = counts.groupBy("shard").applyInArrow(_build_shard, shape)
    hot = cut(counts.where(F.col("n") > ASKING).groupBy("shard").agg(F.ceil(F.max("n") / ASKING).alias("salts")))
    asked = lines.distinct().select("block", "h1", "h2", shard)
    if hot.isEmpty():
        asked, index = asked.withColumn("salt", F.lit(0)), index.withColumn("salt", F.lit(0))
    else:
        salts = F.coalesce("salts", F.lit(1)).cast("int")
        asked = asked.join(hot, "shard", "left").withColumn("salt", F.pmod(F.xxhash64("block"), salts).cast("int")).drop("salts")
        index = index.join(hot, "shard", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    often = asked.groupBy("shard", "salt").cogroup(index.groupBy("shard", "salt")).applyInArrow(_probe(min_docs), "block long, h1 long, h2 long")
    shape = f"doc_id long, text string, n_lines long, n_dropped long, row {docs.schema['row'].dataType.simpleString()}"
    kept = hashed.groupBy("block").cogroup(often.groupBy("block")).applyInArrow(_drop, shape)
    if keep_columns:
        return kept.select(*(F.col("text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in names))
    return kept.drop("row")
