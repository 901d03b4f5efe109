"""The corpus pipeline: stages over ``documents``, each written as Parquet and reread before the next.

Every stage takes tables with null and repeated ids, null, empty and very long texts, repeated rows, no rows, and
further columns of any name, which all but the last carry along; a row's fate follows from its text, source and
label, so rows that repeat share it, but for near-duplicates, of which one row stays.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from codeloom.llm import decontaminate, neardup, pieces, quality, shared, toxicity
from codeloom.llm.queries import held_out, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, with what is known of their sites, accepts.

    Null and empty texts are judged by their features; without labels all are at one half and stay.
    """
    labels = table(spark, sf_dir, "labels")
    return quality.keep_good(docs, labels, quality.learn(docs, labels))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic; null and empty texts stay unless most labels are toxic."""
    return toxicity.remove_toxic(docs, toxicity.learn(docs, table(spark, sf_dir, "labels").where(~held_out(0))))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near-duplicates (five words, similarity of 0.8); texts without words all stay."""
    return neardup.keep_first(docs)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark items; null and empty texts stay."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's pieces, encoded and decoded again, as counts and digests; null and empty texts have none."""
    return pieces.digests(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality", good_quality),
    ("toxicity", not_toxic),
    ("near_duplicates", one_of_each_group),
    ("decontamination", without_benchmarks),
    ("sentencepiece", encoded),
]

#: SQL can express neither the fitted models nor the encoding; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        last, docs = docs, shared.save(stage(spark, docs, sf_dir), f"stage-{name}")
        if k:
            shared.forget(last)  # nothing reads the stage before again
    return docs
