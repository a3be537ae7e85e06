"""A training corpus from raw documents: five stages, each written and read again.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows its predecessor kept.
All but the last return the columns of ``documents``; the last stores the mixed shards, the
corpus, and returns one row per document with the words taken of it.

A stage's result has to be written before the next stage is called: that one deletes the
tables which the earlier one stored on its way, and its shuffle files.

Defined cases, in every stage: a null or empty text has no words, repeats nothing, holds no
benchmark passage and is left to the classifier; repeated rows and rows without an id are
judged by id and text together; of equal candidates the smallest id stays; extra columns,
whatever their names, pass through; an empty table gives an empty table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from boxloom.llm import classifier, decontamination, jaccard, mixing, substrings
from boxloom.llm.tables import discard, noting, release, table
from boxloom.session import shared_folder

#: No SQL can express the learned classifier; tests hold the stages against brute force.
ORACLE_SQL = None


#: Tables that the stage called last stored on its way.
_left: list[str] = []


def alone(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The stage, after what an earlier stage left in the shared folder is deleted."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, **more: str) -> DataFrame:
        discard(spark, *_left)
        _left.clear()
        release(spark)
        with noting(_left):
            return stage(spark, docs, sf_dir, **more)

    return run_stage


@alone
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return classifier.accepted(docs, table(spark, sf_dir, "labels"))


@alone
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at a similarity of 0.8, one stays."""
    return jaccard.one_of_each(docs, shingle=5, percent=80)


@alone
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Twenty-word passages that stand earlier go from later texts."""
    return substrings.without_repeats(docs)


@alone
def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


@alone
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str, folder: str | None = None) -> DataFrame:
    """What is left is mixed to the target weights of its sources; shards go to ``folder``."""
    return mixing.report(docs, folder=folder)


STAGES = [
    ("quality_classifier", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("benchmark_decontamination", benchmark_passages),
    ("mixing", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the corpus is the last one's neighbour, ``corpus``."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        more = {"folder": f"{folder}/corpus"} if stage is mix else {}
        result = stage(spark, docs, sf_dir, **more)
        result.write.option("compression", "zstd").parquet(f"{folder}/{name}")
        docs = spark.read.schema(result.schema).parquet(f"{folder}/{name}")
    return docs
