"""Relational operators: access, latest rows, retention, merges and listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest(rows: DataFrame, keys: list[str], order: list[Column], keep: int = 1) -> DataFrame:
    """The first ``keep`` rows of each key in an order."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_n", n).where(F.col("_n") <= keep).drop("_n")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Old and new rows, the newest version of each key."""
    order = [F.desc(version), F.desc("_new")]
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return latest(both, keys, order).drop("_new")


def sync(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, state) of a snapshot merge: inserted, updated, deleted or same."""
    a, b = old.select(key, F.col(digest).alias("_a")), new.select(key, F.col(digest).alias("_b"))
    had, has = F.col("_a").isNotNull(), F.col("_b").isNotNull()
    state = F.when(~had, "inserted").when(~has, "deleted").when(F.col("_a") != F.col("_b"), "updated").otherwise("same")
    return a.join(b, key, "full").select(key, state.alias("state"))


def tiered_grant(grants: DataFrame, keys: list[str], tier: str, level: str) -> DataFrame:
    """The highest level of the first tier that grants anything for each key."""
    best = F.min(F.struct(F.col(tier), (-F.col(level)).alias("_r")))
    return grants.groupBy(*keys).agg(best.alias("_b")).select(*keys, F.col(f"_b.{tier}").alias(tier), (-F.col("_b._r")).alias(level))


def with_all_tags(file_tags: DataFrame, tags: list[str]) -> DataFrame:
    """Files that have every one of the tags."""
    wanted = sorted(set(tags))
    hits = file_tags.where(F.col("tag").isin(wanted)).groupBy("file_id").agg(F.countDistinct("tag").alias("n"))
    return hits.where(F.col("n") == len(wanted)).select("file_id")


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def capped(rows: DataFrame, order: list[Column], most: int) -> DataFrame:
    """The first rows of a listing, and whether there were more."""
    some = rows.orderBy(*order).limit(most + 1)
    numbered = some.withColumn("_n", F.row_number().over(Window.orderBy(*order)))  # most + 1 rows
    return numbered.withColumn("truncated", F.max("_n").over(Window.partitionBy()) > most).where(F.col("_n") <= most).drop("_n")
