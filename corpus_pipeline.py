"""The corpus pipeline: language, near duplicates, benchmark passages, source mix, shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the next one's docs.  All but the last return the columns of ``documents``.

Nulls and edges: a document without text or letters has no language and goes with the first stage; one with a null id is
judged by its own text in each stage, but is no near duplicate of another; rows that repeat an id are documents by their texts, and of
repeats of one such document the second stage keeps one; texts of any length are read whole; ties go to the smallest id;
extra columns are carried along to the last stage, but for those named as the mixing stage's own; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronolake.llm import decontaminate, language, mixing, neardup, sharding
from chronolake.llm.common import drop_stored, made, stored, table


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a wide enough margin."""
    return language.accepted(docs)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: shingles of five words, similarity 0.8."""
    return neardup.unique(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any run of ten words of a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated, or left out, so that sources have their target weights; shuffled."""
    return mixing.replicate(docs).drop(*mixing.ADDED)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every document; equal texts stay together."""
    return sharding.shard(docs)


STAGES = [
    ("language", by_language),
    ("near_duplicates", without_near_duplicates),
    ("benchmark", without_benchmark),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: Compression sizes and xxHash are not in SQL's reach; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage stored on its way is deleted when its output is written."""
    docs, mark = table(spark, sf_dir, "documents"), made()
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
        drop_stored(spark, mark, keep=1)
    return STAGES[-1][1](spark, docs, sf_dir)
