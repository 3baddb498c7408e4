import hashlib
import re

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tidemark.llm.pii import KINDS, classifier, find_pii, inputs, redact, reliabilities, span_list

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def passes(kind, hit):
    d = re.sub("[^0-9]", "", hit)
    return {
        "email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in hit.split(".")),
        "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15,
    }[kind]


def brute(text):
    return {k: [(m.start(), m.end()) for m in re.finditer(BASE[k], text or "") if passes(k, m[0])] for k in KINDS}


ODD = [
    None, "", "no data", "a@b.c", "a@b@c.d", "x@y.z_w@q.r..", "é@b.c €a.b@c-d.e.f. 𝒳 a@b.co", "1.2.3.4.5 256.1.1.1 0001.2.3.255 9.9.9", "1.2.3.4" * 3,
    "4111 1111 1111 1111", "4111-1111-1111-1111 4111 1111 1111 1112", "4111111111111111 4111111111111111", "5500005555555559.", "1 2 3 4 5 6 7 8",
    "+1 (555) 123-4567 +4912", "+1 555) x +44 20 7946 0958.", "++1-2345678- +123456789012345678", "9" * 30_000, "1 " * 30_000, "a." * 30_000, "a@" * 20_000 + "b.c",
    "@" + ".a" * 30_000, "x@y" + ".a" * 30_000, "+" + "1" * 9 + " " * 20_000 + "1", "é" * 50_000 + " j@k.lm " + "é" * 50_000, "a@b.c " * 500,
]


def test_base_equals_brute_force(spark):
    texts = ODD + pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist()
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, base_email string, n_ip int").repartition(8)
    found = find_pii(df).select("doc_id", span_list("base").alias("base"), F.sha2(span_list("base"), 256).alias("sha"), span_list("spans").alias("spans"))
    got = {r.doc_id: r for r in found.collect()}
    for i, t in rows:
        want = [f"{k}:{a}:{b}" for k in KINDS for a, b in brute(t)[k]]
        assert got[i].base == ",".join(want), (i, (t or "")[:80])
        assert got[i].sha == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(got[i].spans.split(",")) | ({""} if not want else set())


def added_by_hand(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r.s for r in find_pii(df).select("doc_id", span_list("spans").alias("s")).collect()}


def test_loose_spans_need_the_classifier(spark):
    texts = [f"write to user{i}@mail.example.com or call +1 (555) 555-{1000 + i} today" for i in range(200)]
    real = [
        ("please call (212) 555-0187 now", "phone", "(212) 555-0187"), ("mail: jane.roe (at) example (dot) com", "email", "jane.roe (at) example (dot) com"),
        ("pay to IBAN DE89 3704 0044 0532 0130 00, thanks", "iban", "DE89 3704 0044 0532 0130 00"), ("amex card 3782 822463 10005.", "card", "3782 822463 10005"),
        ("the host 2001:0db8:85a3:0000:0000:8a2e:0370:7334 answers", "ip", "2001:0db8:85a3:0000:0000:8a2e:0370:7334"),
        ('token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" end', "secret", "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"),
        ("é password: Xk29dkLs02mfAq81ZzPp", "secret", "Xk29dkLs02mfAq81ZzPp"), ("API_KEY='ghp_A1b2C3d4E5f6G7h8I9j0K1l2M3n4'", "secret", "ghp_A1b2C3d4E5f6G7h8I9j0K1l2M3n4"),
    ]
    clean = [
        "order 2024/05/06/some-long-article-title here", "a very_long_snake_case_name_2024_final", "IBAN DE89 3704 0044 0532 0130 01 is false", "card 3782 822463 10006",
        "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "version 1.2.3 of 2020-10-10", "x" * 100_000, "Thisisaverylongwordinsomelanguage", "=" * 40, "ISBN 978-3-16-148410-0",
    ]
    got = added_by_hand(spark, texts + [t for t, _, _ in real] + clean)
    for i, (t, kind, hit) in enumerate(real):
        at = t.index(hit)
        assert got[200 + i] == f"{kind}:{at}:{at + len(hit)}", t
    for i, t in enumerate(clean):
        assert got[200 + len(real) + i] == "", t


def test_planted_secrets_are_found(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: {(s.start, s.end) for s in r.spans_secret} for r in find_pii(df).collect()}
    want = {r.doc_id: {m.span(1) for m in re.finditer('token = "([0-9a-f]{40})"', r.text or "")} for r in df.collect()}
    planted = [(i, s) for i, spans in want.items() for s in spans]
    assert len(planted) > 10 and sum(s in got[i] for i, s in planted) >= 0.9 * len(planted)
    assert sum(bool(got[i]) and not want[i] for i in got) <= 0.005 * len(got)


def test_reliable_labelers_outweigh_others():
    none = (0, 0, 1, 0, 0)
    counts = [("email", (1, 1, 1, 1, 1), none, 500), ("email", (1, 1, None, 1, 1), none, 300), ("email", (1, 0, None, 1, 1), none, 100), ("email", (0, 0, None, 0, 1), none, 200)]
    post, hit = reliabilities(counts)
    assert post["email", (1, 1, 1, 1, 1)] > 0.99 > 0.5 > post["email", (0, 0, None, 0, 1)]
    assert hit["email", "form"][0] > hit["email", "form"][1]
    w = classifier(counts)
    score = lambda votes: sum(a * b for a, b in zip(w, inputs("email", votes, none), strict=True))
    assert score((1, 1, 1, 1, 1)) > 0 > score((0, 0, None, 0, 0))


def test_empty_table_and_redaction(spark):
    assert find_pii(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    row = redact(spark.createDataFrame([(1, "a@b.c, 1.2.3.4\n+1 555 555 5555\n4111111111111111"), (2, None)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.text for r in row] == ["[email], [ip]\n[phone]\n[card]", None]
    odd = spark.createDataFrame([(None, "x", "a@b.c a@b.c"), (None, "x", "a@b.c a@b.c"), (3, None, ""), (3, None, "4111111111111112 256.1.1.1")], "doc_id long, spans string, text string")
    assert sorted(r.text for r in redact(odd).collect()) == ["", "4111111111111112 256.1.1.1", "[email] [email]", "[email] [email]"]
    assert redact(odd.limit(0)).collect() == [] and redact(odd).columns == odd.columns
