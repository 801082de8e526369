"""Tables that several writers change: versions in a folder, committed by compare-and-swap.

A version is a file whose name is its number and whose only line is the folder of its rows. A
writer reads a version, writes its rows into a folder of their own and creates the next
number's file, which fails if another writer was first. Readers see whole versions only; what
a writer left that lost or died is never named by a version.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.functions.vectors import similarity
from sparkloom.storage import exists

# Fixed value: seconds without a sign of life after which a claim can be taken over.
STALE_SECONDS = 3600


class StaleVersion(Exception):
    """Another writer committed first."""


class VersionedTable:
    """The table in ``path``; ``schema`` is that of its rows."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema

    def _file(self, version: int) -> str:
        return f"{self.path}/versions/{version:012d}"

    def version(self) -> int:
        """The newest version, 0 where there is none."""
        if not exists(self.spark, f"{self.path}/versions"):
            return 0
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/versions")
        found = place.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(place)
        return max((int(f.getPath().getName()) for f in found if f.getPath().getName().isdigit()), default=0)

    def read(self, version: int | None = None) -> DataFrame:
        version = self.version() if version is None else version
        if version == 0:
            return self.spark.createDataFrame([], self.schema)
        folder = self.spark.read.text(self._file(version)).first()[0]
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/rows/{folder}")

    def commit(self, rows: DataFrame, after: int) -> int:
        """Make ``rows`` the version after ``after``, or raise ``StaleVersion``."""
        folder = uuid.uuid4().hex
        rows.select(*self.spark.createDataFrame([], self.schema).columns).write.parquet(f"{self.path}/rows/{folder}")
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self._file(after + 1))
        files = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
        try:
            out = files.create(place, False)
        except Py4JJavaError as e:
            if "AlreadyExists" in e.java_exception.getClass().getName():
                raise StaleVersion(f"version {after + 1} of {self.path} is taken") from None
            raise
        out.write(bytearray(folder.encode()))
        out.close()
        return after + 1

    def update(self, change: Callable[[DataFrame], DataFrame], tries: int = 10) -> int:
        """Commit ``change`` of the newest version; where another writer was first, of that one's."""
        for _ in range(tries - 1):
            version = self.version()
            try:
                return self.commit(change(self.read(version)), version)
            except StaleVersion:
                continue
        version = self.version()
        return self.commit(change(self.read(version)), version)


class JobClaims:
    """Jobs that workers claim; each claim raises the job's generation, and only its holder may finish it.

    A worker that was taken for lost and comes back late holds an older generation: what it
    reports is refused, for single jobs, whatever else has been committed meanwhile.
    """

    SCHEMA = "job_id bigint, status string, owner string, generation bigint, seen timestamp"

    def __init__(self, spark: SparkSession, path: str):
        self.table = VersionedTable(spark, path, self.SCHEMA)

    def submit(self, jobs: DataFrame) -> None:
        """Queue ``jobs(job_id)`` that are not known yet."""
        none = lambda kind: F.lit(None).cast(kind)
        fresh = jobs.select(F.col("job_id").cast("bigint").alias("job_id")).distinct()
        made = lambda old: fresh.join(old, "job_id", "left_anti").select("job_id", F.lit("queued").alias("status"), none("string").alias("owner"), F.lit(0).cast("bigint").alias("generation"), none("timestamp").alias("seen"))
        self.table.update(lambda old: old.unionByName(made(old)))

    def claim(self, owner: str, now: str, n: int = 1) -> list[tuple[int, int]]:
        """(job_id, generation) of up to ``n`` jobs, first ones first, that wait or whose holder is lost."""
        at = F.lit(now).cast("timestamp")
        lost = (F.col("status") == "running") & (F.col("seen") < at - F.expr(f"INTERVAL {STALE_SECONDS} SECONDS"))

        def take(old: DataFrame) -> DataFrame:
            first = old.where((F.col("status") == "queued") | lost).orderBy("job_id").limit(n).select("job_id", F.lit(True).alias("mine"))
            met = old.join(F.broadcast(first), "job_id", "left")  # n rows
            new = lambda name, value: F.when(F.col("mine"), value).otherwise(F.col(name)).alias(name)
            return met.select("job_id", new("status", F.lit("running")), new("owner", F.lit(owner)), new("generation", F.col("generation") + 1), new("seen", at))

        while True:
            before = self.table.version()
            held = {(r.job_id, r.generation) for r in self.table.read(before).where((F.col("owner") == owner) & (F.col("status") == "running")).collect()}
            try:
                after = self.table.commit(take(self.table.read(before)), before)
            except StaleVersion:
                continue
            mine = self.table.read(after).where((F.col("owner") == owner) & (F.col("status") == "running")).collect()
            return sorted({(r.job_id, r.generation) for r in mine} - held)

    def report(self, claims: list[tuple[int, int]], status: str, now: str) -> list[int]:
        """Set ``status`` (running: a sign of life; done, queued, ...) of the held jobs; returns those that were refused."""
        spark, at = self.table.spark, F.lit(now).cast("timestamp")
        held = spark.createDataFrame(claims, "job_id bigint, held bigint") if claims else spark.createDataFrame([], "job_id bigint, held bigint")
        valid = (F.col("held") == F.col("generation")) & (F.col("status") == "running")

        def put(old: DataFrame) -> DataFrame:
            met = old.join(F.broadcast(held), "job_id", "left").withColumn("ok", F.coalesce(valid, F.lit(False)))  # the worker's own claims
            return met.select("job_id", F.when(F.col("ok"), F.lit(status)).otherwise(F.col("status")).alias("status"), "owner", "generation", F.when(F.col("ok"), at).otherwise(F.col("seen")).alias("seen"))

        while True:
            before = self.table.version()
            old = self.table.read(before)
            accepted = {r.job_id for r in old.join(held, "job_id").where(valid).collect()}
            try:
                self.table.commit(put(old), before)
            except StaleVersion:
                continue
            return sorted(j for j, _ in claims if j not in accepted)


class QueryCache:
    """Answers by the embedding of the question, within a user and scope: lookups, counters, new entries and eviction in one version.

    An answer is served if the nearest entry is near enough and not expired: its last hit, or
    its last change where it was never hit, is within ``ttl_hours``. An expired nearest entry
    goes. A user keeps ``most`` entries: those never hit go first, then those hit longest ago.
    That bounds what a question is compared with.
    """

    SCHEMA = "entry_id bigint, user_id bigint, scope string, query string, embedding array<double>, payload string, hits bigint, last_hit timestamp, updated timestamp"

    def __init__(self, spark: SparkSession, path: str, threshold: float = 0.92, ttl_hours: float = 24.0, most: int = 200):
        self.table, self.threshold, self.ttl_hours, self.most = VersionedTable(spark, path, self.SCHEMA), threshold, ttl_hours, most

    def nearest(self, entries: DataFrame, asked: DataFrame, now: str) -> DataFrame:
        """(query_id, entry_id, similarity, payload, expired) of each question's nearest entry."""
        pairs = asked.select("query_id", "user_id", "scope", "embedding").join(entries.withColumnRenamed("embedding", "kept").select("entry_id", "user_id", "scope", "kept", "payload", "last_hit", "updated"), ["user_id", "scope"])
        scored = pairs.where(F.size("embedding") == F.size("kept")).select("query_id", "entry_id", F.round(similarity(F.col("embedding"), F.col("kept")), 6).alias("similarity"), "payload", F.coalesce("last_hit", "updated").alias("used"))
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "entry_id"))
        expired = F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros("used") > int(self.ttl_hours * 3600 * 1_000_000)
        return scored.withColumn("n", place).where("n = 1").select("query_id", "entry_id", "similarity", "payload", expired.alias("expired"))

    def turn(self, asked: DataFrame, now: str) -> DataFrame:
        """(query_id, entry_id, similarity, payload) of the questions that are served from the version before.

        ``asked(query_id, user_id, scope, query, embedding, payload)``; a payload is the answer
        to keep if the question is not served, null for none.
        """
        spark, at = self.table.spark, F.lit(now).cast("timestamp")
        while True:
            version = self.table.version()
            old = self.table.read(version)
            near = self.nearest(old, asked, now)
            served = near.where(~F.col("expired") & (F.col("similarity") >= self.threshold))
            hits = served.groupBy("entry_id").agg(F.count("*").alias("more"))
            left = old.join(near.where("expired").select("entry_id").distinct(), "entry_id", "left_anti").join(hits, "entry_id", "left")
            kept = left.select("entry_id", "user_id", "scope", "query", "embedding", "payload", (F.col("hits") + F.coalesce("more", F.lit(0))).alias("hits"), F.when(F.col("more") > 0, at).otherwise(F.col("last_hit")).alias("last_hit"), "updated")
            fresh = asked.where("payload IS NOT NULL").join(served.select("query_id"), "query_id", "left_anti")
            fresh = fresh.withColumn("entry_id", F.xxhash64("user_id", "scope", "query")).withColumn("n", F.row_number().over(Window.partitionBy("entry_id").orderBy(F.desc("query_id")))).where("n = 1")
            changed = kept.select("entry_id", F.col("hits").alias("old_hits"), F.col("last_hit").alias("old_hit"))
            made = fresh.join(changed, "entry_id", "left").select("entry_id", "user_id", "scope", "query", F.col("embedding").cast("array<double>").alias("embedding"), "payload", F.coalesce("old_hits", F.lit(0)).alias("hits"), F.col("old_hit").alias("last_hit"), at.alias("updated"))
            both = kept.join(fresh.select("entry_id"), "entry_id", "left_anti").unionByName(made)
            place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc_nulls_last("last_hit"), F.desc("updated"), "entry_id"))
            try:
                self.table.commit(both.withColumn("place", place).where(F.col("place") <= self.most), version)
            except StaleVersion:
                continue
            return self.nearest(self.table.read(version), asked, now).where(~F.col("expired") & (F.col("similarity") >= self.threshold)).drop("expired") if version else spark.createDataFrame([], "query_id bigint, entry_id bigint, similarity double, payload string")
