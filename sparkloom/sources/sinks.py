"""Sinks: replacement by key, exports and retained snapshots; all written by the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 64


def replace_by_key(rows: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> None:
    """Replace all rows of the keys in ``rows``: only the buckets they fall into are rewritten.

    The rows of those buckets that stay are written to a side folder first, since a folder
    cannot be read and overwritten in one job.
    """
    spark = rows.sparkSession
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    new = rows.withColumn("bucket", bucket)
    try:
        old = spark.read.parquet(path)
    except Exception as e:  # noqa: BLE001 - only a missing folder means a first write
        if "PATH_NOT_FOUND" not in str(e):
            raise
        new.repartition("bucket").write.partitionBy("bucket").parquet(path)
        return
    kept = old.join(new.select("bucket").distinct(), "bucket", "left_semi").join(rows.select(key).distinct(), key, "left_anti")
    merged = kept.select(new.columns).unionByName(new)
    side = f"{path.rstrip('/')}__replacing"
    merged.write.mode("overwrite").parquet(side)
    spark.read.parquet(side).repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def tsv_line(columns: list[Column]) -> Column:
    """One line of tab-separated values; tabs, newlines and backslashes are escaped, nulls are empty."""
    clean = [F.replace(F.replace(F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("\t"), F.lit("\\t")), F.lit("\n"), F.lit("\\n")) for c in columns]
    return F.concat_ws("\t", *clean)


def export_tsv(rows: DataFrame, path: str, order: list[Column], newest: int) -> None:
    rows.orderBy(*order).limit(newest).select(tsv_line([F.col(c) for c in rows.columns]).alias("value")).write.mode("overwrite").text(path)


def bundle_text(meta: Column, body: Column) -> Column:
    """Front matter in the order of its keys, then the body."""
    lines = F.array_join(F.transform(F.array_sort(F.map_entries(meta)), lambda e: F.concat(e.key, F.lit(": "), e.value)), "\n")
    return F.concat(F.lit("---\n"), lines, F.lit("\n---\n"), body)


def export_bundle(concepts: DataFrame, path: str) -> None:
    """``concepts(concept, meta, body)`` as a table of file names and contents, one folder per top concept."""
    top = F.when(F.contains("concept", F.lit("/")), F.substring_index("concept", "/", 1)).otherwise("root")
    concepts.select(top.alias("top"), F.concat("concept", F.lit(".md")).alias("name"), bundle_text(F.col("meta"), F.col("body")).alias("content")).write.mode("overwrite").partitionBy("top").parquet(path)
