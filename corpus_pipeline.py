"""A training corpus from raw documents: language, repeated lines, near copies, benchmark passages, token ids.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; all but the last
return the columns of ``documents``. A stage's rows are written as Parquet and read again for the next.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlog.llm import decontamination, language_id, line_dedup, near_dups, piece_codec
from lumenlog.llm.common import stored, table
from lumenlog.session import ship_package

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def shipped(stage: Stage) -> Stage:
    """The executors have the package when the stage runs."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


@shipped
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose margin between languages is too narrow, go."""
    dictionaries = language_id.learn_dictionaries(language_id.training_rows(docs))
    return language_id.predict_language(docs, dictionaries).where(~F.col("rejected")).select(*docs.columns)


@shipped
def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go; so does a document of which nothing but white space is left."""
    found = line_dedup.dedup_lines(docs)
    left = found.where((F.col("n_removed") == 0) | F.col("text").rlike(r"\S"))
    length = {"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return left.withColumns(length).select(*docs.columns) if length else left.select(*docs.columns)


@shipped
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: of five-word shingles, at a similarity of 0.8 and more."""
    return near_dups.keep_one(docs, percent=80)


@shipped
def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item stands go."""
    return decontamination.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


@shipped
def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left."""
    return piece_codec.encode_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark_passages),
    ("piece_encoding", encode_pieces),
]

#: The stages train a classifier and call tokenizer libraries; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
