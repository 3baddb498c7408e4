import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import queries
from tidemark.llm import toxicity as T


def test_learns_from_document_labels_and_finds_the_sentence():
    rng = np.random.default_rng(0)
    words = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(10)]
    rows = []
    for k in range(600):
        sentences = [" ".join(rng.choice(words, 8)) + "." for _ in range(rng.integers(1, 12))]
        if k % 5 == 0:
            s = rng.integers(len(sentences))
            sentences[s] = "vile " + sentences[s]
        rows.append((" ".join(sentences), int(k % 5 == 0)))
    model = T.Model.fit(iter(rows))
    assert max(model.number, key=lambda f: model.weight[model.number[f]]) == "vile"
    assert model.token_weight("VILE!!".lower()) == model.token_weight("vile")


def test_held_out_accuracy_and_odd_texts(spark):
    path = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    model = T.fit_toxicity(docs, labels, ~T.held_out(), sample_docs=3000)
    held = labels.where(T.held_out() & F.col("toxic").isNotNull())
    got = T.toxicity(docs.join(held.select("doc_id"), "doc_id"), model).join(held, "doc_id").select("toxic", "predicted", "sentences", "sentence_texts").collect()
    toxic, clean = [r for r in got if r.toxic == 1], [r for r in got if r.toxic == 0]
    assert np.mean([r.predicted for r in toxic]) > 0.8 and np.mean([r.predicted for r in clean]) < 0.03
    assert all(len(r.sentences) == len(r.sentence_texts) for r in got) and any(r.sentences for r in toxic)
    odd = spark.createDataFrame([(1, None, 1.0), (2, "", 1.0), (3, "idiot. " * 20_000, 1.0), (3, "a\nb", 1.0), (None, "!", 1.0)], "doc_id long, text string, score double")
    scores = {(r.doc_id, i): r.score for i, r in enumerate(T.toxicity(odd, model).collect())}
    assert len(scores) == 5 and all(0 <= s <= 1 for s in scores.values())
    assert T.toxicity(odd.limit(0), model).collect() == []
    none = T.fit_toxicity(docs.limit(0), labels, ~T.held_out())
    assert {r.score for r in T.toxicity(odd, none).collect()} == {0.0}


def test_the_query_equals_sentences_scored_one_by_one(spark):
    """Plain loops over the feature sets of every document's sentences, with the model that the query fits."""
    data = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    model = T.fit_toxicity(docs, labels, ~T.held_out(parts=4, part=2))
    got = {r.doc_id: r for r in queries.op5_toxicity(spark, data).collect()}
    assert len(got) == docs.count()
    for r in docs.collect():
        clean, bad, number, seen = 1.0, [], 0, set()
        for token in [*(r.text or "").lower().replace("\n", " \0 ").split(), "\0"]:
            seen |= {f for f in T.features_of(token) if f in model.number}
            if token == "\0" or token[-1] in ".!?…。":
                z = model.bias + sum(model.weight[model.number[f]] for f in seen)
                p = 1 / (1 + math.exp(-z))
                clean *= 1 - p
                if p >= 0.3:
                    bad.append(number)
                number, seen = number + 1, set()
        x = got[r.doc_id]
        assert x.score == pytest.approx(1 - clean, abs=1e-9) and x.sentences == bad and len(x.sentence_texts) == len(bad)
        assert x.predicted == int(x.score >= 0.3) and x.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_the_sample_is_bounded_by_characters(spark):
    docs = spark.createDataFrame([(i, ("vile " if i % 2 else "kind ") * 10 + "a b.") for i in range(400)] + [(1000, "vile " * 10_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(1000, 1)], "doc_id long, toxic int")
    assert T.fit_toxicity(docs, labels, F.lit(True)).number  # learns
    few = list(T._up_to(iter([("abc", 1), ("de", 0), ("f", 1)]), 5))
    assert few == [("abc", 1), ("de", 0)]
    small = T.fit_toxicity(docs, labels, F.lit(True), sample_chars=2000)
    assert small.prior != 1.0 and {r.doc_id for r in T.toxicity(docs, small).collect()} == {r.doc_id for r in docs.collect()}


def test_features_that_tokens_share_count_once_a_sentence(spark):
    """Repetition, punctuation and common beginnings don't add up."""
    model = T.Model({"idiot": 0, "idio-": 1}, np.array([1.0, 0.5]), -3.0, 0.1)
    texts = ["idiot", "idiot idiot,", 'idiot, "idiot" (idiot)', "idiots idiotic", "idiots", "Idiot\nidiot. x\n\nİdiot idiot!"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in T.toxicity(docs, model, least=0.15).collect()}
    one, begin, none = (1 / (1 + math.exp(-z)) for z in (-1.5, -2.5, -3.0))
    assert [got[k].score for k in range(5)] == pytest.approx([one, one, one, begin, begin])
    r = got[5]
    assert r.score == pytest.approx(1 - (1 - one) ** 3 * (1 - none) ** 3) and r.sentences == [0, 1, 4]
    assert r.sentence_texts == ["Idiot", "idiot.", "İdiot idiot!"] == [texts[5][a:b] for a, b in zip(r.sentence_starts, r.sentence_ends, strict=True)]
