import hashlib
import re
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from test_near_dup import LOWER, brute

import corpus_pipeline
from tidemark.llm import decontaminate, lang_id, line_dedup, near_dup

DATA = "/root/testdata/sf0.001"


def brute_lines(rows, least):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    seen = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")})
    return {i: "\n".join(x for x in (t or "").split("\n") if not key(x) or seen[key(x)] < least) for i, t in rows}


def brute_hits(rows, items, size):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = defaultdict(set)
    for item, t in items:
        w = split(t)
        k = min(size, len(w))
        for a in range(len(w) - k + 1 if k else 0):
            windows[tuple(w[a : a + k])].update([] if item is None else [str(item)])
    sizes = {len(w) for w in windows}
    out = {}
    for i, t in rows:
        w, hit, found = split(t), set(), set()
        for k in sizes:
            for a in range(len(w) - k + 1):
                if (x := windows.get(tuple(w[a : a + k]))) is not None:
                    hit.update(range(a, a + k))
                    found |= x
        out[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest())
    return out


def test_pipeline_equals_brute_force(spark):
    docs = {r["doc_id"]: r for r in pq.read_table(f"{DATA}/documents.parquet").to_pylist()}
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{DATA}/benchmark.parquet").to_pylist()]
    rows = [(i, r["text"]) for i, r in docs.items() if any(map(str.isalpha, r["text"] or ""))]
    rows = sorted(brute_lines(rows, 10).items())
    rows = [(i, t) for i, t in rows if brute(rows, 5, 80)[i][2]] if len(rows) < 5 else (lambda kept: [(i, t) for i, t in rows if kept[i][2]])(brute(rows, 5, 80))
    hits = brute_hits(rows, items, 10)
    rows = [(i, t) for i, t in rows if not hits[i][1]]
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = df.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, DATA)
        assert df.columns == columns
    got = df.collect()
    assert sorted((r.doc_id, r.text) for r in got) == rows
    assert all(r.n_chars == len(r.text) and r.lang == docs[r.doc_id]["lang"] and r.source == docs[r.doc_id]["source"] for r in got)
    packed = corpus_pipeline.run(spark, DATA).collect()
    assert {r.doc_id for r in packed} == {i for i, _ in rows}


@pytest.fixture
def odd(spark):
    rows = [None, "", "\n", "A b\na B \n\nc", "a b", "1234 -- 5", "ж ж ж", "x\n" * 3000, "a b\t", "word " * 40_000, "a b", "a b"]
    return [(i, t) for i, t in enumerate(rows)], spark.createDataFrame([(i, t, "m", 3) for i, t in enumerate(rows)], "doc_id long, text string, row string, block int")


def test_lines(spark, odd, monkeypatch):
    rows, df = odd
    monkeypatch.setattr(line_dedup, "BLOCK_DOCS", 3)
    monkeypatch.setattr(line_dedup, "ASKING", 2)  # salts the hot shard
    got = {r.doc_id: r for r in line_dedup.drop_frequent_lines(df, min_docs=3).collect()}
    assert {i: r.text for i, r in got.items()} == brute_lines(rows, 3)
    assert got[3].n_lines == 4 and got[3].n_dropped == 2 and got[0].n_lines == got[1].n_lines == 1
    kept = line_dedup.drop_frequent_lines(df, min_docs=3, keep_columns=True)
    assert kept.columns == df.columns and {r.row for r in kept.collect()} == {"m"}
    assert line_dedup.drop_frequent_lines(df.limit(0)).collect() == []


def test_perfect_hash():
    import numpy as np

    keys = np.unique(np.random.default_rng(0).integers(0, 2**64, 5000, dtype=np.uint64))
    function = line_dedup.PerfectHash.unpack(*line_dedup.PerfectHash.build(keys).pack())
    assert sorted(function.index(keys)) == list(range(len(keys)))


def test_windows(spark, odd):
    _, df = odd
    words = "one two three four five six seven eight nine ten eleven twelve thirteen"
    rows = [(i, t) for i, t in enumerate([None, "", words, words.upper() + "!", "x " + words[4:] + " " + words, "seven. Eight", "seven é eight", words[:40], "ab ab ab ab", "é9 é9"])]
    items = [(1, words), (2, "seven eight"), (2, words[4:]), (10, None), (11, "--"), (9, "ab ab"), (None, "ab ab"), (5, "É9"), (6, "é9")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_words int")
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, words int")
    want = brute_hits(rows, items, 10)
    for pass_words in (400_000, 14):  # one pass and several
        got = decontaminate.contamination(docs, bench, pass_words=pass_words).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in got} == want
        assert all(r.n_hit == sum(s.end - s.start for s in r.spans) for r in got)
    assert decontaminate.contamination(docs.limit(0), bench).collect() == []
    assert not any(r.contaminated for r in decontaminate.contamination(docs, bench.limit(0)).collect())


@pytest.mark.parametrize("pass_words", [400_000, 8])  # one pass and several
def test_windows_of_rows_with_null_and_repeated_ids(spark, pass_words):
    one, two = "one two three four five six seven eight", "red green blue cyan pink grey teal gold"
    rows = [(None, one), (None, "clean"), (None, "x " + two), (3, one), (3, "clean too"), (3, one), (4, one + " " + two), (None, None)]
    docs = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, n int")
    bench = spark.createDataFrame([(1, one), (2, two)], "item_id long, text string")
    want = brute_hits(list(enumerate(t for _, t in rows)), [(1, one), (2, two)], 8)
    got = decontaminate.contamination(docs, bench, window=8, pass_words=pass_words).collect()
    key = lambda x: (x[0] or 0, *x[1:])
    assert sorted(key((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256)) for r in got) == sorted(key((i, *want[n])) for n, (i, _) in enumerate(rows))
    kept = decontaminate.drop_contaminated(docs, bench, window=8, pass_words=pass_words)
    assert kept.columns == docs.columns and sorted(r.n for r in kept.collect()) == [1, 4, 7]


def test_languages(spark, odd):
    _, df = odd
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = lang_id.fit_languages(docs, ~lang_id.held_out(), sample_docs=60)
    found = lang_id.identify(docs.where(lang_id.held_out()), model).join(docs, "doc_id")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.99
    got = {r.doc_id: (r.lang_pred, r.score) for r in lang_id.identify(df, model).collect()}
    assert {i for i, (lang, _) in got.items() if lang == "und"} == {0, 1, 2, 5} and got[6][0] in model.langs
    assert lang_id.identify(df.limit(0), model).collect() == []
    none = lang_id.fit_languages(docs.limit(0), ~lang_id.held_out())
    assert {r.lang_pred for r in lang_id.identify(df, none).collect()} == {"und"}


def test_forward_sums_all_segmentations():
    import numpy as np

    pieces = {"▁a": 0, "b": 1, "ab": 2, "▁": 3, "a": 4, "▁ab": 5}
    p = np.array([[0.2], [0.1], [0.05], [0.3], [0.15], [0.02], [1e-7]])
    score = lang_id.Lattice(["ab"], pieces).score(p)[0, 0]
    assert np.isclose(np.exp(score), 0.2 * 0.1 + 0.3 * 0.15 * 0.1 + 0.3 * 0.05 + 0.02)


def test_different_lines_that_share_a_hash():
    import numpy as np
    import pyarrow as pa

    with pytest.raises(ValueError, match="repeat"):
        line_dedup.PerfectHash.build(np.array([5, 5], np.uint64))
    keys = pa.table({"shard": [0] * 4, "h1": [5, 5, 5, 9], "h2": [1, 2, 3, 4], "n": [20, 3, 30, 10]})
    asked = pa.table({"block": [0] * 5, "h1": [5, 5, 5, 9, 9], "h2": [1, 2, 3, 4, 5]})
    often = line_dedup._probe(10)(asked, line_dedup._build_shard(keys))
    assert list(zip(often["h1"].to_pylist(), often["h2"].to_pylist(), strict=True)) == [(5, 1), (5, 3), (9, 4)]


def test_lines_of_rows_with_null_and_repeated_ids(spark):
    rows = [(None, "a\nx"), (None, "a\ny"), (7, "a"), (7, "A \nz"), (7, "A \nz"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.text) for r in line_dedup.drop_frequent_lines(df, min_docs=5).collect())
    assert got == [(0, ""), (0, "x"), (0, "y"), (7, ""), (7, "z"), (7, "z")]


STAGED = "doc_id long, text string, lang string, source string, n_chars int, __id int, row string, id string, doc string, block int"


def test_stages_on_odd_rows_and_clashing_names(spark):
    """Null and repeated ids, empty texts, an empty table and columns with the names that stages use inside."""
    text = "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf in the deep dark wood"
    rows = [(None, text), (None, text), (3, text), (3, "other words here that nobody else has written down before today at all"), (4, ""), (5, None), (None, "12 34")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "r", "i", "d", 2) for i, t in rows], STAGED)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = lang_id.fit_languages(docs, ~lang_id.held_out(), sample_docs=60)
    stages = {
        "lang": lambda d: lang_id.drop_unidentified(d, model), "lines": lambda d: line_dedup.drop_frequent_lines(d, min_docs=3, keep_columns=True), "near": lambda d: near_dup.drop_near_duplicates(d),
        "clean": lambda d: decontaminate.drop_contaminated(d, spark.createDataFrame([(1, text[:80])], "item_id long, text string")),
    }
    want = {"lang": 4, "lines": 7, "near": 5, "clean": 4}
    for name, stage in stages.items():
        out = stage(df)
        assert out.schema.names == df.schema.names and out.count() == want[name], name
        assert stage(df.limit(0)).collect() == [], name
    kept = stages["near"](df).where("text LIKE 'the quick%'").collect()
    assert [r.doc_id for r in kept] == [3]  # the smallest id stays, null ids last


def test_language_stage_takes_its_parameters(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = lang_id.fit_languages(docs, ~lang_id.held_out(), sample_docs=60)
    some = docs.where("lang IS NOT NULL AND length(text) > 200")
    only = lang_id.drop_unidentified(some, model, langs=["de"])
    assert {r.lang for r in only.select("lang").distinct().collect()} == {"de"} and only.count() > 0.95 * some.where("lang = 'de'").count()
    assert lang_id.drop_unidentified(some, model, least=1.1).count() == 0


def test_runs_of_any_length_are_summed_exactly():
    import math
    from fractions import Fraction

    pieces = {"▁a": 0, "b": 1, "ab": 2, "▁": 3, "a": 4, "▁ab": 5}
    p = [Fraction(1, 5), Fraction(1, 10), Fraction(1, 20), Fraction(3, 10), Fraction(3, 20), Fraction(1, 50), Fraction(1, 10**7)]
    word = "ab" * 60
    sums = [Fraction(1)] + [Fraction(0)] * (len(word) + 1)
    for end in range(1, len(word) + 2):
        for start in range(max(0, end - 3), end):
            if (k := pieces.get(("▁" + word)[start:end])) is not None:
                sums[end] += sums[start] * p[k]
    want = math.log(sums[-1].numerator) - math.log(sums[-1].denominator)
    rows = [[float(x), float(x) / 2] for x in p]
    got = lang_id.score_long(word, pieces, rows)
    assert got[0] == pytest.approx(want, rel=1e-12) and got[1] < got[0]
    assert lang_id.score_long(word[:8], pieces, rows) == pytest.approx(lang_id.Lattice([word[:8]], pieces).score(__import__("numpy").array(rows))[0].tolist())


def test_the_language_query_equals_words_scored_one_by_one(spark):
    """Plain loops over the words of every document, with the model that the query fits."""
    import math
    import zlib

    from tidemark.llm import queries

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = lang_id.fit_languages(docs, ~lang_id.held_out(parts=5, part=0))
    plain = model.p.tolist()
    got = {r.doc_id: r for r in queries.op10_language_id(spark, DATA).collect()}
    assert len(got) == docs.count()
    scores: dict[str, list[float]] = {}
    for r in docs.collect():
        total, told = [0.0] * len(model.langs), False
        for token in (r.text or "").split():
            for run in lang_id.runs_of_letters(token):
                if run not in scores:
                    scores[run] = lang_id.score_long(run, model.pieces, plain)
                total, told = [a + b for a, b in zip(total, scores[run], strict=True)], True
        x = got[r.doc_id]
        assert x.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        if not told:
            assert (x.lang_pred, x.score) == ("und", 0.0)
            continue
        best = max(total)
        assert x.lang_pred == model.langs[total.index(best)]
        assert x.score == pytest.approx(1 / sum(math.exp(t - best) for t in total), abs=1e-9)
