"""The corpus pipeline: language ID, line dedup, near-dedup, decontamination and packing of the documents table.

Every stage takes (spark, docs, sf_dir); all but the last return documents with the columns they got, in rows that they judge
one by one: null and repeated ids are rows like any other, further columns may have any name, and an empty table gives an
empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, lang_id, line_dedup, near_dup, packing
from tidemark.session import cut, table

#: A SQL engine can't express language ID and packing; tests/llm/test_pipeline.py compares with brute force.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language of the labelled rows; those without any letter (null texts among them) go, and those of which no
    language is likelier than all others together."""
    return lang_id.drop_unidentified(docs, lang_id.fit_languages(docs, ~lang_id.held_out()), langs=None, least=0.5)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the lines that 10 documents or more hold; n_chars is that of the text that stays. Every document stays, one of
    frequent lines only with an empty text."""
    kept = line_dedup.drop_frequent_lines(docs, min_docs=10, min_chars=1, keep_columns=True)
    return kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five words a shingle, similarity 0.8. Texts without words stay."""
    return near_dup.drop_near_duplicates(docs, words=5, percent=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of ten words (or a whole shorter item) of the benchmark. Texts without words stay."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"), window=10)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places in sequences; texts without words are their separator."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_deduplication),
    ("minhash_near_dedup", near_deduplication),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
