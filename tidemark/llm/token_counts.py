"""Token counts of documents by a separator scan over flat, unindexed token streams.

A token file is a run of little-endian ids in which every document ends with one separator id; nothing says where
documents begin. Tasks search fixed-size blocks for the separator with one vector comparison each; documents that cross
blocks are stitched together by a prefix scan over block summaries, in two levels, so that no task sees all blocks of a
long file.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import shared_dir

VOCABULARY = "byte_bpe_50k.tiktoken"
END_OF_DOCUMENT = 50256
#: Tokens of a block, and blocks that one window of the first level of the prefix scan holds.
BLOCK_TOKENS, SPAN = 65536, 1024
_BLOCKS = "file string, block long, data binary"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def load_encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _tokens(path: str, separator: int, block_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = load_encoding(path)
        file = f"part-{TaskContext.get().partitionId():06d}"
        held: list[np.ndarray] = []
        size = block = 0

        def rows(blocks: list[bytes], ids: list[int] | None, first: int) -> pa.RecordBatch:
            n = len(blocks) + (ids is not None)
            lists = [None] * len(blocks) + ([ids] if ids is not None else [])
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([file] * n, pa.string()), pa.array([first + k for k in range(len(blocks))] + [None] * (ids is not None), pa.int64()),
                    pa.array(blocks + [None] * (ids is not None), pa.binary()), pa.array(lists, pa.list_(pa.int64())),
                ],
                ["file", "block", "data", "doc_ids"],
            )

        order: list[int] = []
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for at, text in enumerate(batch.column(1)):
                held.append(np.array([*encoding.encode_ordinary(text.as_py() or ""), separator], np.uint16))
                size += len(held[-1])
                order.append(ids[at])
                if size >= 16 * block_tokens:
                    flat = np.concatenate(held)
                    whole = len(flat) // block_tokens
                    cuts = [flat[k * block_tokens : (k + 1) * block_tokens].tobytes() for k in range(whole)]
                    yield rows(cuts, None, block)
                    block, held = block + whole, [flat[whole * block_tokens :]]
                    size = len(held[0])
        flat = np.concatenate([np.zeros(0, np.uint16), *held])
        yield rows([flat[k : k + block_tokens].tobytes() for k in range(0, len(flat), block_tokens)], None, block)
        for k in range(0, len(order), 4096):  # which documents the file holds, in its order
            yield rows([], [k, *order[k : k + 4096]], 0)

    return run


def write_tokens(docs: DataFrame, path: str | None = None, separator: int = END_OF_DOCUMENT, block_tokens: int = BLOCK_TOKENS) -> tuple[DataFrame, DataFrame]:
    """Tokenises whole texts into one flat stream of 16-bit ids for each input partition, in blocks that take no notice
    of documents. -> (blocks: file, block, data; manifest: file, place, doc_id), both read back from the shared folder."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = docs.mapInArrow(_tokens(path or vocabulary_path(), separator, block_tokens), _BLOCKS + ", doc_ids array<long>")
    to = f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    rows.write.option("compression", "zstd").parquet(to)
    kept = docs.sparkSession.read.schema(rows.schema).parquet(to)
    listed = kept.where("doc_ids IS NOT NULL").select("file", F.col("doc_ids")[0].alias("first"), F.posexplode(F.slice("doc_ids", 2, 1 << 30)).alias("k", "doc_id"))
    return kept.where("data IS NOT NULL").select("file", "block", "data"), listed.select("file", (F.col("first") + F.col("k")).alias("place"), "doc_id")


def read_token_files(spark: SparkSession, path: str, width: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Blocks of flat token files. A file is read by one task (Spark's binaryFile source: at most 2 GB a file)."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                view, step = memoryview(content.as_buffer()), block_tokens * width
                for k, at in enumerate(range(0, len(view), step)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([file]), pa.array([k], pa.int64()), pa.array([view[at : at + step].tobytes()], pa.binary())], ["file", "block", "data"]
                    )

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(cut_up, _BLOCKS)


def _scan(separator: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                lengths, tails = [], []
                for data in part.column(2):
                    ids = np.frombuffer(data.as_buffer(), f"<u{width}")
                    at = np.flatnonzero(ids == separator)
                    lengths.append(np.diff(at, prepend=-1) - 1)
                    tails.append(len(ids) - (int(at[-1]) + 1 if len(at) else 0))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(map(len, lengths), pa.int64()), pa.array(tails, pa.int64()), pa.array(lengths, pa.list_(pa.int64()))],
                    ["file", "block", "seps", "tail", "lengths"],
                )

    return run


def _carry(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Adds, over the rows before each: `before` (separators) and `carry` (tokens since the last separator)."""
    w = Window.partitionBy(*keys).orderBy(order)
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("upto", F.coalesce(F.sum("tail").over(past), F.lit(0)))
    reset = F.last(F.when(F.col("seps") > 0, F.col("upto")), ignorenulls=True).over(past)
    seps = F.coalesce(F.sum("seps").over(past), F.lit(0))
    return rows.select("*", seps.alias("before"), (F.col("upto") - F.coalesce(reset, F.lit(0))).alias("carry")).drop("upto")


def token_counts(blocks: DataFrame, separator: int = END_OF_DOCUMENT, width: int = 2) -> DataFrame:
    """blocks (file, block, data) -> (file, place, n_tokens, ended): tokens of each document without its separator, with
    its place in the file from 0. A run after a file's last separator is a document that hasn't ended; no tokens after it
    means no such document. Blocks may have any sizes (whole ids each); empty blocks and files and an empty table are fine.
    """
    own = blocks.select("file", "block", "data").where("data IS NOT NULL").mapInArrow(_scan(separator, width), "file string, block long, seps long, tail long, lengths array<long>")
    own = own.withColumn("span", F.expr(f"block div {SPAN}"))
    inner = _carry(own, ["file", "span"], "block")
    # A span's tail: what its last block carries on.
    final = F.max(F.struct("block", F.when(F.col("seps") > 0, F.col("tail")).otherwise(F.col("carry") + F.col("tail")).alias("t")))
    spans = inner.groupBy("file", "span").agg(F.sum("seps").alias("seps"), final["t"].alias("tail"))
    outer = _carry(spans, ["file"], "span").select("file", "span", F.col("before").alias("b0"), F.col("carry").alias("c0"))
    whole = inner.join(outer, ["file", "span"]).select(
        "file", "block", "seps", "tail", "lengths", (F.col("before") + F.col("b0")).alias("before"),
        (F.col("carry") + F.when(F.col("before") > 0, 0).otherwise(F.col("c0"))).alias("carry"),
    )
    docs = whole.select("file", "before", "carry", F.posexplode("lengths").alias("k", "n")).select(
        "file", (F.col("before") + F.col("k")).alias("place"), (F.col("n") + F.when(F.col("k") == 0, F.col("carry")).otherwise(0)).alias("n_tokens"),
        F.lit(True).alias("ended"),
    )
    last = whole.groupBy("file").agg(
        F.max(F.struct("block", F.when(F.col("seps") > 0, F.col("tail")).otherwise(F.col("carry") + F.col("tail")).alias("n"), (F.col("before") + F.col("seps")).alias("p"))).alias("m")
    )
    return docs.union(last.where("m.n > 0").select("file", "m.p", "m.n", F.lit(False)))


def document_token_counts(docs: DataFrame, path: str | None = None, separator: int = END_OF_DOCUMENT) -> DataFrame:
    """docs -> (doc_id, n_tokens), through token streams. Null and empty texts have 0 tokens; null ids and repeated rows
    are kept; other columns are ignored; an empty table gives an empty result."""
    blocks, manifest = write_tokens(docs, path, separator)
    counts = token_counts(blocks, separator).select("file", "place", "n_tokens")
    return manifest.join(counts, ["file", "place"]).select("doc_id", "n_tokens")
