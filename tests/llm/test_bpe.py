import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import queries
from tidemark.llm.bpe import BytePairs, Merges, decode, encode
from tidemark.llm.packing import vocabulary_path

TOKENIZER = Tokenizer.from_file(vocabulary_path())
PAIRS = BytePairs(vocabulary_path())


def plain(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


def batched(texts):
    return [ids[a:b].tolist() for _, _, ids, first in PAIRS.encode(pa.array(texts, pa.string())) for a, b in zip(first, first[1:], strict=False)]


def one_word(ranks, symbols):
    """Pairs one by one: of the lowest rank the leftmost."""
    symbols = [*symbols]
    while found := [(ranks[p], i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)) if p in ranks]:
        _, i = min(found)
        symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
    return symbols


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=40) | st.text("aB'sé́ ñ1.<|>ß \x1c\n\x85½", max_size=30) | st.lists(st.sampled_from(["<|endoftext|>", "<|STARTOFTEXT|>", "<|startoftext|>", "A", " ", "é", "Ж", "'s", "\xa0", "漢字", "ΣΣ", "İ"]), max_size=8).map("".join), max_size=6))
def test_equals_the_library(texts):
    ids = batched(texts)
    assert ids == [plain(t) for t in texts]
    assert [PAIRS.decode(np.array(x, np.uint32)).decode() for x in ids] == [TOKENIZER.decode(x, skip_special_tokens=False) for x in ids]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text("abc", min_size=1, max_size=3), st.text("abc", min_size=1, max_size=3)), max_size=14, unique=True), st.lists(st.text("abc", min_size=1, max_size=12), min_size=1, max_size=6))
def test_any_merge_list(merges, words):
    """Also lists in which a pair comes before the merges that make its parts."""
    tokens = ["a", "b", "c", *dict.fromkeys(x for a, b in merges for x in (a, b, a + b) if len(x) > 1)]
    vocab = {t: i for i, t in enumerate(tokens)}
    if not merges:
        merges = [("a", "b")]
        vocab.setdefault("ab", len(vocab))
    ranks = {p: r for r, p in enumerate(merges)}
    ids, sizes = Merges(vocab, merges).apply(np.array([vocab[c] for w in words for c in w], np.int64), np.array([len(w) for w in words]))
    names = [*vocab]
    got = [[names[i] for i in x] for x in np.split(ids, np.cumsum(sizes)[:-1])]
    assert got == [one_word(ranks, w) for w in words]


@pytest.mark.parametrize("text", ["a" * 30_000, "ab" * 9_999 + "é" * 5, "的一是不了人我在有他" * 800, "".join(chr(97 + (7 * i * i) % 26) for i in range(20_000)), "<|endoftext|>" * 3000, " \n\t " * 5000, "x " * 70_000])
def test_long_texts(text):
    assert batched([text, "z", text]) == [plain(text), plain("z"), plain(text)]


def test_decodes_ids_that_the_vocabulary_lacks():
    ids = [5, 49405, 49406, 49407, 60_000, 49408, 7]
    assert PAIRS.decode(np.array(ids, np.uint32)).decode() == TOKENIZER.decode(ids, skip_special_tokens=False)


def test_query_equals_the_library(spark):
    got = {r.doc_id: r for r in queries.op11_bpe_round_trip(spark, "/root/testdata/sf0.001").collect()}
    docs = pq.read_table("/root/testdata/sf0.001/documents.parquet")
    assert len(got) == docs.num_rows
    for i, text in zip(docs["doc_id"].to_pylist(), docs["text"].to_pylist(), strict=True):
        ids, r = plain(text), got[i]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(TOKENIZER.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_odd_rows(spark):
    rows = [(1, None, 0, "x"), (1, "", 1, "y"), (None, "The cat", 2, None), (None, "The cat", 2, None), (2, " \n ", 3, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, ids string")
    out = decode(encode(df))
    assert out.columns == ["doc_id", "n_tokens", "ids", "text"]
    got = sorted((r.doc_id or 0, r.n_tokens, np.frombuffer(r.ids, "<u4").tolist(), r.text) for r in out.collect())
    cat = (0, 2, plain("The cat"), "the</w> cat</w>")
    assert got == [cat, cat, (1, 0, [], ""), (1, 0, [], ""), (2, 0, [], "")]
    assert decode(encode(df.limit(0))).collect() == []
    nulls = spark.createDataFrame([(1, None), (2, bytearray())], "doc_id long, ids binary")
    assert sorted((r.doc_id, r.n_tokens, r.text) for r in decode(nulls).collect()) == [(1, 0, ""), (2, 0, "")]
