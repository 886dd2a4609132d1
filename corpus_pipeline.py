"""Cleaning a corpus in five stages, each an operator over all that the stage before it kept.

Every stage but the last returns the columns of `documents`. A null text counts as an empty one; rows
that repeat, null ids, empty tables and further columns pass through as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollmill.llm.classifier import score, train
from rollmill.llm.decontamination import with_leaks
from rollmill.llm.neardup import near_duplicates
from rollmill.llm.pieces import Vocabulary, encode
from rollmill.llm.privacy import find_pii, sanitised
from rollmill.session import written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    model = train(docs, _table(spark, sf_dir, "labels"))
    return score(docs, model).where("predicted = 1").select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return near_duplicates(docs).where("is_first").select(*docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return with_leaks(docs, _table(spark, sf_dir, "benchmark")).where(F.size("leaks") == 0).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and the terms that reveal them generalised, n_chars to match."""
    clean = find_pii(docs).withColumn("text", sanitised())
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of all texts, and whether they decode to the text."""
    vocabulary = Vocabulary.load()
    done = encode(docs.select("doc_id", "lang", "source", "text"), vocabulary, decoded="decoded")
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return done.select("doc_id", "lang", "source", "ids", F.size("ids").alias("n_ids"), same.alias("round_trip"))


STAGES = [
    ("quality", quality),
    ("near_copies", near_copies),
    ("benchmark", benchmark),
    ("personal_data", personal_data),
    ("tokens", tokens),
]
ORACLE_SQL = None  # the learned model, the signatures and the lattice are not expressible


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each result stored and read again."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
