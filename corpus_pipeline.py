"""A training corpus in five stages; each takes (spark, docs, sf_dir) and returns a DataFrame.

Every stage but the last returns the columns of ``documents``. Between stages the rows are
written as Parquet into the shared folder and read again, so a lost executor costs only the
tasks of its stage.

1. language: documents without an identifiable language go.
2. near_duplicates: one document of each SimHash group stays, the one with the least doc_id.
3. decontaminate: documents with a word inside a window of the benchmark go.
4. mix: sources are brought to their temperature weights; no document is lost, documents of
   small sources repeat, twice at most.
5. shards: equal texts share one of 24 shards of near equal bytes, in the column ``shard``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import bin_packing, decontaminate, language_id, mixing, simhash
from sparkloom.storage import staged, table

SHARDS = 24


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bin_packing.with_shards(docs, SHARDS)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminated),
    ("mix", mixed),
    ("shards", shards),
]
#: Fingerprint components and bin packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
