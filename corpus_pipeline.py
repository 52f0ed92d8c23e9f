"""A training corpus from raw documents: quality, language, near duplicates, source mix, packed sequences.

Each stage takes (spark, docs, sf_dir), where ``docs`` is what the stage before
it wrote, and returns a DataFrame; all but the last return the columns of
``documents``. ``run`` writes every stage's result as Parquet to the shared
folder and reads it again.

Defined results: documents with null, empty or unreadable texts leave with the
language stage; rows without an id are rows like any other, but have no label
and no class of their own in near duplicates; repeated rows are copies of one
another, of which one stays; repeated label rows count as often as they occur;
extra columns pass through every stage but the last; empty tables give an
empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wardlight.llm import apportion, jaccard, langid, nbsvm, packing
from wardlight.llm.textio import handed_over, key_remainder
from wardlight.session import ship_package, small_batches

ship_package()

#: Near duplicates: shingles of five words, similarity 0.8 or more.
WORDS, PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labelled ones, does not reject."""
    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    return nbsvm.good_documents(docs, nbsvm.fit(docs, labels))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the corpus names."""
    small_batches(spark)
    known = docs.where(key_remainder("doc_id", 4) != 2).select("text", "lang")
    return langid.readable_documents(docs, langid.learn(known))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    small_batches(spark)
    return jaccard.one_of_each(docs, WORDS, PERCENT)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents cut and repeated so that the sources have their target weights."""
    small_batches(spark)
    return apportion.mixed_texts(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    small_batches(spark)
    return packing.pack(docs)


STAGES = [("quality", quality), ("language", language), ("near_duplicates", near_duplicates), ("mixture", mixture),
          ("sequences", sequences)]

#: A trained classifier and a tokenizer are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = handed_over(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
