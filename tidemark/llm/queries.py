"""One query per operator of this subpackage, applied with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, html_text, pii, toxicity
from tidemark.llm.decontaminate import contamination
from tidemark.llm.divergence import source_divergence
from tidemark.llm.embedding_dup import embedding_duplicates
from tidemark.llm.filter_audit import filter_audit
from tidemark.llm.lang_id import fit_languages, held_out, identify
from tidemark.llm.line_dedup import drop_frequent_lines
from tidemark.llm.near_dup import near_duplicates
from tidemark.llm.packing import pack
from tidemark.llm.token_counts import document_token_counts
from tidemark.session import table


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_duplicates(table(spark, sf_dir, "embeddings"), least=0.9)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    counts = [F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in pii.KINDS]
    added = [F.size(f"spans_{k}").cast("long").alias(f"n_{k}") for k in pii.MORE_KINDS]
    n_spans = sum((F.size(f"spans_{k}") for k in pii.ALL_KINDS), F.lit(0)).cast("long").alias("n_spans")
    return found.select("doc_id", *counts, F.sha2(pii.span_list("base"), 256).alias("base_sha256"), pii.span_list("spans").alias("spans"), *added, n_spans)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"), ~toxicity.held_out(parts=4, part=2))
    found = toxicity.toxicity(docs, model, least=0.3)
    return found.select("doc_id", toxicity.held_out(parts=4, part=2).alias("held_out"), "score", "predicted", "sentences", "sentence_starts", "sentence_ends", "sentence_texts")


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_text.extract_text(pages, html_text.fit_labeller(pages))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_token_counts(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_frequent_lines(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, fit_languages(docs, ~held_out(parts=5, part=0)))
    return found.select("doc_id", held_out(parts=5, part=0).alias("held_out"), "lang_pred", "score")


def op11_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = bpe.decode(bpe.encode(table(spark, sf_dir, "documents")))
    return decoded.select("doc_id", "n_tokens", F.sha2(F.coalesce("ids", F.lit(b"")), 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"), min_docs=30, top=50)


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS words
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(words[p : p + least(4, len(words)) - 1], ' ') AS x
  FROM w, unnest(range(1, len(words) - least(4, len(words)) + 2)) AS t(p) WHERE len(words) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM common JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * k >= 80 * (x.n + y.n - k)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.b) AS component_id, min(r.b) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN reach r ON r.a = d.doc_id GROUP BY d.doc_id, n.n
"""

OP9_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), often AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines,
       CAST(count(*) FILTER (WHERE o.key IS NOT NULL) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE o.key IS NULL), '')) AS kept_sha256
FROM keyed k LEFT JOIN often o ON k.key = o.key
GROUP BY doc_id
"""

OP2_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, min(b) AS component_id, min(b) = vec_id AS kept
FROM embeddings JOIN reach ON a = vec_id GROUP BY vec_id
"""

OP6_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
), i AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(10, len(words)) AS k, array_to_string(words[p : p + least(10, len(words)) - 1], ' ') AS win
  FROM i, unnest(range(1, len(words) - least(10, len(words)) + 2)) AS t(p) WHERE len(words) > 0
), sizes AS (SELECT DISTINCT k FROM windows), places AS (
  SELECT doc_id, k, p, array_to_string(words[p : p + k - 1], ' ') AS win
  FROM w, sizes, unnest(range(1, len(words) - k + 2)) AS t(p)
), found AS (
  SELECT doc_id, item_id, p, k FROM places JOIN windows USING (k, win)
), hit AS (
  SELECT doc_id, count(DISTINCT p + o) AS n_hit FROM found, unnest(range(0, k)) AS t(o) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(item_id) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
  FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""

OP12_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first_id FROM t
), l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(words) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN w.doc_id > first_id THEN 'E' ELSE '' END AS failed
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id
), x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f
), o AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order
  FROM x a JOIN x b ON a.f <> b.f JOIN x c ON c.f NOT IN (a.f, b.f) JOIN x d ON d.f NOT IN (a.f, b.f, c.f) JOIN x e ON e.f NOT IN (a.f, b.f, c.f, d.f)
), s AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS f, substr(filter_order, 1, step - 1) AS before FROM o, unnest(range(1, 6)) AS r(step)
), g AS (
  SELECT part, failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, failed
), r AS (
  SELECT part, filter_order, CAST(step AS INTEGER) AS step, f, n, good, toxic, failed, contains(failed, f) AS fails,
    before <> '' AND regexp_matches(failed, '[' || before || 'z]') AS earlier
  FROM g, s
), y AS (
  SELECT part, filter_order, step, f, sum(CASE WHEN NOT fails AND NOT earlier THEN n ELSE 0 END) AS kept, sum(CASE WHEN fails AND NOT earlier THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN fails AND earlier THEN n ELSE 0 END) AS redundant, sum(CASE WHEN failed = f THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN fails AND NOT earlier THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN fails AND NOT earlier THEN toxic ELSE 0 END) AS toxic_lost
  FROM r GROUP BY ALL
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM y
"""

OP13_SQL = r"""
WITH t AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), g AS (SELECT DISTINCT lang, source FROM t
), w AS (SELECT row, lang, source, unnest(terms) AS term FROM t
), kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT row) >= 30
), v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang
), c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL
), wide AS (SELECT lang, source, term, coalesce(n, 0) AS n FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)
), p AS (
  SELECT lang, source, term, n, 1 + (CAST(1000000000 AS HUGEINT) * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v) AS p
  FROM wide JOIN v USING (lang)
), q AS (
  SELECT lang, term, 1 + (CAST(1000000000 AS HUGEINT) * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * v) AS q
  FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL) JOIN v USING (lang)
), pair AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = a.lang AND y.source = b.source AND y.term = x.term
  GROUP BY ALL
), most AS (SELECT lang, source, term AS item, p - q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
), r AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pair
  UNION ALL
  SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM most) WHERE rank <= 50
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_minhash_near_dedup, op2_embedding_near_dedup, op3_pii, op4_best_fit_packing, op5_toxicity, op6_benchmark_decontamination, op7_html_extraction, op8_token_counts, op9_line_dedup, op10_language_id, op11_bpe_round_trip, op12_filter_audit, op13_source_divergence)}


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash_near_dedup": OP1_SQL, "op2_embedding_near_dedup": OP2_SQL, "op6_benchmark_decontamination": OP6_SQL, "op9_line_dedup": OP9_SQL, "op12_filter_audit": OP12_SQL, "op13_source_divergence": OP13_SQL}
