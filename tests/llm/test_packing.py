import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm.packing import OpenBins, WordTokenizer, pack, vocabulary_path

TOKENIZER = Tokenizer.from_file(vocabulary_path())
FAST = WordTokenizer(vocabulary_path())


def plain(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


def fast(texts):
    return [ids[a:b].tolist() for _, _, ids, first in FAST.encode(pa.array(texts, pa.string())) for a, b in zip(first, first[1:], strict=False)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=40) | st.text("aB'sé́ ñ1.<|>ß \x1c\n\x85½", max_size=30) | st.lists(st.sampled_from(["<|endoftext|>", "<|STARTOFTEXT|>", "<|startoftext|>", "A", " ", "é", "Ж", "'s", "\xa0"]), max_size=8).map("".join), max_size=6))
def test_ids_equal_the_tokenizers(texts):
    assert fast(texts) == [plain(t) for t in texts]


def test_ids_of_the_documents():
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist() + ["<|endoftext|> x<|startoftext|>", "I'M we'LL ΟΔΟΣ İstanbul"]
    assert fast(texts) == [plain(t) for t in texts]


def test_pack_keeps_every_id_in_place(spark):
    rng = np.random.default_rng(1)
    texts = [" ".join("abcdefgh"[x] for x in rng.integers(0, 8, n)) for n in rng.integers(0, 60, 300)] + [None, "", "z " * 200, "z " * 200]
    rows = [(i, t, 7, 8) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, packer int, length int")
    out = [r.asDict() for r in pack(df, length=64, with_ids=True).collect()]
    docs, seqs = {}, {}
    for r in out:
        assert r["length"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        docs.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["ids"]))
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, t in enumerate(texts):
        pieces = sorted(docs[i])
        assert [x for _, _, ids in pieces for x in ids] == [*plain(t), 0]
        assert [s for _, s, _ in pieces] == [64 * k for k in range(len(pieces))]
        assert all(len(ids) == 64 for _, _, ids in pieces[:-1])
    for places in seqs.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= 64
    least = -(-sum(r["length"] for r in out) // 64)
    assert len(seqs) <= 1.02 * least + 1


def test_bins_bound_and_best_fit():
    bins = OpenBins(10, 2)
    assert [bins.put(n) for n in (6, 7, 3, 5, 4, 5)] == [(0, 0), (1, 0), (1, 7), (2, 0), (0, 6), (2, 5)]
    assert bins.put(9) == (3, 0) and bins.put(8) == (4, 0) and bins.put(8) == (5, 0)
    assert bins.open == 2 and bins.put(2) == (5, 8)  # bin 3, the fullest, was closed


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_repeated_rows_are_dealt_apart(spark):
    """200,000 copies of a row without id and text fill many packers evenly."""
    df = spark.range(200_000).selectExpr("CAST(NULL AS LONG) AS doc_id", "CAST(NULL AS STRING) AS text").union(spark.range(1000).selectExpr("id", "'a b c'"))
    out = pack(df, length=64, packer_pieces=20_000)
    rows = out.selectExpr("sequence_id >> 32 AS packer", "sequence_id", "offset", "length").groupBy("packer").agg({"length": "sum", "*": "count"}).collect()
    counts = [r["count(1)"] for r in rows]
    assert len(counts) == 11 and sum(counts) == 201_000 and max(counts) < 1.1 * min(counts)
    assert out.select("sequence_id").distinct().count() <= 1.02 * (200_000 + 4000) / 64 + 11
