import re
from collections import defaultdict

import numpy as np

from tidemark.llm.near_dup import COORDS, drop_near_duplicates, near_duplicates, sketch
from tidemark.llm.text import mix

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    comp = {i: i for i in sets}

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    where = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    seen = defaultdict(int)
    for ids in where.values():
        for a in ids:
            for b in ids:
                if a < b:
                    seen[a, b] += 1
    for (a, b), n in seen.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            comp[y] = x
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def rows_with_copies():
    rng = np.random.default_rng(3)
    rows = []
    for g in range(12):
        base = [f"w{x}" for x in rng.integers(0, 5000, rng.integers(5, 120))]
        for _ in range(rng.integers(1, 40)):
            w = list(base)
            for _ in range(rng.integers(0, 3)):
                w[rng.integers(0, len(w))] = f"x{rng.integers(0, 99)}"
            rows.append((len(rows) * 3 + g, " ".join(w)))
    extra = [None, "", "  \n\t ", "one", "One", "ONE two", "Ünïcode é", "Ünïcode É", "a " * 3000, "A\n" * 3000, "0 " + "b " * 9000]
    return rows + [(10_000 + i, t) for i, t in enumerate(extra)]


def test_equals_brute_force(spark):
    rows = rows_with_copies()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'x' AS id", "1 AS component_id", "NULL AS items")
    for k in (4, 5):
        assert got(near_duplicates(df, words=k)) == brute(rows, k, 80)
    twice = near_duplicates(df.union(df), words=5).collect()
    assert len(twice) == 2 * len(rows) and {r.doc_id: r.component_id for r in twice} == {i: x[1] for i, x in brute(rows, 5, 80).items()}
    kept = drop_near_duplicates(df, words=5)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, x in brute(rows, 5, 80).items() if x[2])


def test_components_left_by_the_pivots_are_joined(spark):
    # A sliding window over one long text: neighbours are links, far ones are not, so that one pivot can't settle a bucket.
    words = [f"t{i}" for i in range(900)]
    rows = [(i, " ".join(words[4 * i : 4 * i + 60])) for i in range(200)]
    assert got(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=4)) == brute(rows, 4, 80)


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_sketch_fills_every_coordinate_and_is_concentrated():
    a = mix(np.arange(1000, dtype=np.uint64))
    sets = [a[:1], a[:900], a[100:1000]]
    h, text = np.concatenate(sets), np.repeat(np.arange(3), [1, 900, 900])
    s = sketch(h, text, 3)
    assert (s != np.iinfo(np.uint64).max).all()
    assert abs((s[1] == s[2]).sum() / COORDS - 0.8) < 0.15


def test_null_and_repeated_ids_are_rows_like_others(spark):
    one, two = "a b c d e f g h", "p q r s t u v w x"
    rows = [(None, one, 1), (None, one, 2), (7, one, 3), (7, one, 4), (7, two, 5), (None, two, 6), (None, "other words of its own here", 7), (8, "", 8), (8, "", 9), (None, None, 10), (None, "lone copy of null ids", 11), (None, "lone copy of null ids", 12)]
    kept = drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, n int"), words=5)
    assert kept.columns == ["doc_id", "text", "n"]
    got = kept.collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == sorted([(7, one), (7, two), (0, "other words of its own here"), (8, ""), (8, ""), (0, ""), (0, "lone copy of null ids")])


def test_an_id_with_several_texts_links_what_links_with_any(spark):
    rng = np.random.default_rng(12)
    a, b, c, d = (" ".join(f"w{x}" for x in rng.integers(0, 9000, 60)) for _ in range(4))
    near = lambda t: t + " one more"
    rows = [(1, a), (1, b), (3, near(b)), (5, near(a)), (9, c), (8, c), (8, d), (4, near(d)), (6, ""), (6, None), (20, "alone in all the world of words"), (None, a), (1, a)]
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=4).collect()
    assert len(out) == len(rows) and sorted(r.n_shingles for r in out if r.doc_id == 1) == [57, 57, 57]
    found = {r.doc_id: (r.component_id, r.kept) for r in out}
    assert found == {1: (1, True), 3: (1, False), 5: (1, False), 9: (4, False), 8: (4, False), 4: (4, True), 6: (6, True), 20: (20, True), None: (None, True)}
