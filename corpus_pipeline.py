"""The training-data pipeline: five filters and transforms over `documents`, one after the other.

Every stage is one of the operators in ``tideline.llm``. A stage takes (spark, docs,
sf_dir) and returns a DataFrame, which is written as Parquet and reread as the next
stage's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tideline.llm import decontaminate, langid, quality, sentencepieces, simhash
from tideline.llm.queries import model_path
from tideline.session import discard, scratch_path

#: Bits a byte above which a text is in no learned language, and the score below which it may as well be in another.
MOST_BITS, LEAST_SCORE = 6.0, 0.75


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores at 0.5 or more."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep(docs, quality.learn(docs, labels), least=0.5)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters, in one of the learned languages: those whose best code is short enough, and clearly shorter than the others."""
    return langid.keep(docs, langid.learn(docs), MOST_BITS, LEAST_SCORE)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id."""
    return simhash.one_of_each(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of `benchmark`."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document and the digests of them and of what they decode to."""
    return sentencepieces.encode(docs, model_path(), ids=True, decoded=False, digests=True)


STAGES = [
    ("quality classifier", keep_good),
    ("language id", keep_known_languages),
    ("simhash near-dedup", keep_one_of_each),
    ("benchmark decontamination", drop_benchmark),
    ("sentencepiece encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and reread."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = scratch_path(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:  # the stage's input, which nothing reads any more
            discard(spark, before)
        before = path
    return docs


#: No SQL can express these stages; tests/llm/test_pipeline.py holds them against brute force.
ORACLE_SQL = None
