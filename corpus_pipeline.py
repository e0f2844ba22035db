"""A training corpus from raw documents: five stages over one table.

Rules reject junk, one document of each group of near copies stays, documents with
benchmark passages go, personal data becomes pseudonyms, and the sources are mixed to
their weights. Each stage is written to the shared folder before the next one reads it,
so a lost executor costs at most the stage that runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import decontaminate, mixing, ngram_join, pseudonyms, quality
from tidewire.llm.queries import PSEUDONYM_KEY
from tidewire.llm.words import space_words
from tidewire.session import Scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the thresholds."""
    return quality.keep(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at 0.8 or more."""
    return ngram_join.keep_one(spark, docs, n=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return decontaminate.clean(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents under pseudonyms; ``n_chars`` follows the new text."""
    done = pseudonyms.pseudonymise(docs, PSEUDONYM_KEY)
    if "n_chars" in docs.columns:
        length = F.when(F.col("n_found") > 0, F.length("text").cast(docs.schema["n_chars"].dataType))
        done = done.withColumn("n_chars", length.otherwise(F.col("n_chars")))
    return done.select(*[F.col(f"`{c}`") for c in docs.columns])


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: documents with the number of copies that enter it."""
    return mixing.mix(spark, docs, F.size(space_words(F.col("text")))).where("taken > 0")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_copies", near_copies),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
]
# Keyed permutations cannot be written in SQL; the tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names: list[str] = []
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        scratch.drop(*names)
        names = [name]
    return docs
