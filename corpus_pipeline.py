"""A training corpus from the documents table, stage by stage.

Every stage works on all that its predecessor kept and returns the columns of documents;
the last returns the packed pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyloom.llm import line_dedup, mixing, near_dup, packing, quality
from tallyloom.llm.common import durable, fold
from tallyloom.llm.queries import domains, table, word_tokenizer

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: What is to stay of the tokens that each domain has, whatever its share. No document
#: appears more than once, so clean documents keep their rate of 1 and toxic ones go.
WEIGHTS = {"clean": 1.0, "toxic": 0.0}


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    labels = table(spark, sf_dir, "labels").filter(fold(F.col("doc_id"), 5) != 0)
    model = quality.learn(docs, labels)
    return quality.classify(docs, model).filter("predicted = 1").select(docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go."""
    lean = line_dedup.dedup_lines(docs)
    return lean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return near_dup.drop_near_duplicates(docs).select(docs.columns)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay by their rate."""
    labels = domains(spark, sf_dir).filter("domain <> 'low'")
    return mixing.resample(docs, mixing.mix(docs, labels, WEIGHTS, ceiling=1.0, of_own=True))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048."""
    return packing.pack_documents(docs, word_tokenizer())


STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_good),
    ("line dedup", drop_repeated_lines),
    ("near duplicates", drop_near_duplicates),
    ("mixing", mix_domains),
    ("packing", pack_sequences),
]

#: Classifiers and a tokenizer are not SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each one written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
