import numpy as np
import pytest

from tidemark.llm import decontaminate
from tidemark.llm.decontaminate import contamination, drop_contaminated


def text(rng, n):
    return " ".join(f"w{x}" for x in rng.integers(0, 5000, n))


def brute(docs, items, window=10):
    out = {}
    for i, t in docs:
        words, hit, found = (t or "").split(), set(), set()
        for name, item in items:
            own = item.split()
            k = min(window, len(own))
            wanted = {tuple(own[a : a + k]) for a in range(len(own) - k + 1)} if k else set()
            for a in range(len(words) - k + 1):
                if k and tuple(words[a : a + k]) in wanted:
                    hit |= set(range(a, a + k))
                    found.add(name)
        out[i] = (len(words), len(hit), sorted(found))
    return out


@pytest.mark.parametrize(("chunk", "pass_words"), [(4096, 400_000), (7, 400_000), (16, 150)])
def test_long_and_repeated_items(spark, monkeypatch, chunk, pass_words):
    """Items longer than a pass, and many times the same item: every pass stays small, and nothing is missed."""
    monkeypatch.setattr(decontaminate, "CHUNK", chunk)
    rng = np.random.default_rng(chunk)
    long, short, other = text(rng, 300), "only three words", text(rng, 12)
    items = [("long", long), ("short", short), ("other", other), ("same", other), ("none", "")] + [("other", other)] * 500
    w = long.split()
    docs = [(k, " ".join([*text(rng, 30).split(), *w[a : a + n], *text(rng, 5).split()])) for k, (a, n) in enumerate([(0, 10), (3, 9), (0, 300), (120, 40), (290, 10), (291, 9), (5, 14)])]
    docs += [(10, f"x {short} y"), (11, other), (12, None), (13, "only three wordy")]
    seen = []
    real = decontaminate.Windows.__init__
    monkeypatch.setattr(decontaminate.Windows, "__init__", lambda self, names, words, size: seen.append(sum(map(len, words))) or real(self, names, words, size))
    got = {r.doc_id: (r.n_words, r.n_hit, r.items) for r in contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string"), pass_words=pass_words).collect()}
    assert got == brute(docs, items)
    if pass_words < 400_000:
        assert len(seen) > 2 and max(seen) < 3 * pass_words
    else:
        assert len(seen) == 1
    clean = drop_contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string"), pass_words=pass_words)
    assert sorted(r.doc_id for r in clean.collect()) == sorted(i for i, (_, n, _) in got.items() if not n)


def test_an_item_repeated_often(spark):
    rng = np.random.default_rng(3)
    own = text(rng, 40)
    items = spark.range(100_000).selectExpr("'one' AS item_id", f"'{own}' AS text")
    docs = spark.createDataFrame([(1, own), (2, "nothing of it")], "doc_id long, text string")
    passes, _ = decontaminate._passes(docs.select("text"), items, 10, 400_000)
    assert passes == 1
    assert {r.doc_id: (r.n_hit, r.items) for r in contamination(docs, items).collect()} == {1: (40, ["one"]), 2: (0, [])}
