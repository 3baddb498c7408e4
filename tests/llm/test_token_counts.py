import numpy as np
import pyarrow.parquet as pq
import pytest

from tidemark.llm import token_counts as T


def brute(ids, end):
    out, now = [], 0
    for x in ids:
        if x == end:
            out.append((len(out), now, True))
            now = 0
        else:
            now += 1
    return out + ([(len(out), now, False)] if now else [])


def test_stitching_equals_brute_force(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(T, "SPAN", 3)
    rng = np.random.default_rng(4)
    rows, want = [], set()
    for f in range(12):
        ids = rng.integers(0, 40, rng.integers(0, 400)).astype(np.uint16)
        if f % 3 == 0:
            ids[ids == 7] = 8  # hardly any separator
            ids[len(ids) // 2 :: 97] = 7
        want |= {(f"f{f}", *x) for x in brute(ids, 7)}
        cuts = [0, *sorted(rng.integers(0, len(ids) + 1, 9)), len(ids)]
        rows += [(f"f{f}", k, bytearray(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    got = {tuple(r) for r in T.token_counts(spark.createDataFrame(rows, "file string, block long, data binary"), 7).collect()}
    assert got == want
    ids = rng.integers(0, 50, 5000).astype("<u4")
    (tmp_path / "a.bin").write_bytes(ids.tobytes())
    got = T.token_counts(T.read_token_files(spark, str(tmp_path), width=4, block_tokens=64), 7, width=4).collect()
    assert {tuple(r)[1:] for r in got} == set(brute(ids, 7))


def test_documents(spark):
    enc = T.load_encoding(T.vocabulary_path())
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist() + [None, "", "x", "<|endoftext|>", "a " * 90_000]
    df = spark.createDataFrame([(i, t, "f") for i, t in enumerate(texts)], "doc_id long, text string, file string").repartition(3)
    got = {r.doc_id: r.n_tokens for r in T.document_token_counts(df).collect()}
    assert got == {i: len(enc.encode_ordinary(t or "")) for i, t in enumerate(texts)}


def test_same_ids_as_the_tokenizers_file():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    enc = T.load_encoding(T.vocabulary_path())
    for text in pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()[:60]:
        assert enc.encode_ordinary(text) == t.encode(text, add_special_tokens=False).ids


def test_empty_table(spark):
    assert T.document_token_counts(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("n", [0, 1, 65535, 65536, 65537])
def test_block_edges(spark, n):
    df = spark.createDataFrame([(5, "a " * n)], "doc_id long, text string")
    assert [tuple(r) for r in T.document_token_counts(df).collect()] == [(5, 0 if not n else len(T.load_encoding(T.vocabulary_path()).encode_ordinary("a " * n)))]
