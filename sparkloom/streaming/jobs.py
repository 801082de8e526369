"""Stateful processing of job events with Structured Streaming.

Every stream can be run to the end of what its source holds (``available``); results are
written per micro-batch under the batch's number, so a repeated batch overwrites itself.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.window import Window

from sparkloom.storage import run_dir

# Attempts before a job is dead, seconds without a sign of life, length of a window.
MAX_ATTEMPTS = 3
STALE_SECONDS = 3600
#: Seconds of event time for which a job that has ended, or waits in the queue, is remembered.
KEPT_SECONDS = 24 * 3600
SESSION_GAP = "15 minutes"


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """The events table as a stream with event time ``at``; the table is a folder of files or one file."""
    schema = spark.read.parquet(path).schema
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isFile():
        stream, path = stream.option("pathGlobFilter", place.getName()), place.getParent().toString()
    return stream.parquet(path).withColumn("at", F.col("ts").cast("timestamp"))


def available(stream: DataFrame, keys: list[str] | None = None, mode: str = "update") -> DataFrame:
    """Everything the stream yields from what is there now; with keys, the last row of each key."""
    spark, place = stream.sparkSession, f"{run_dir(stream.sparkSession)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/rows/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    rows = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", IntegerType())])).option("basePath", f"{place}/rows").parquet(f"{place}/rows/batch=*") if query.lastProgress else None
    if rows is None:
        return spark.createDataFrame([], stream.schema)
    if keys:
        order = Window.partitionBy(*keys).orderBy(F.desc("batch"))
        rows = rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    return rows.drop("batch")


FOLD = "job_id bigint, status string, attempts int, last_seen timestamp"


def job_states(events: DataFrame) -> DataFrame:
    """The state of each job of ``events(job_id, kind, at)``: one state machine per job.

    A success ends a job; a failure is an attempt, and the third makes it dead; anything else
    is a sign of life. A job that has ended takes no more events. One without a sign of life
    for an hour of event time is put back in the queue. State is bounded: a job that ended or
    was put back is forgotten after a day of event time. Events of one micro-batch are taken
    in the order of their time; a later batch's are taken after them.
    """

    def remember(state: GroupState, seconds: int, seen: int) -> None:
        state.setTimeoutTimestamp(max(seen // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            status, attempts, seen = state.get
            if status in ("done", "dead", "queued"):
                state.remove()
                return
            state.update(("queued", attempts, seen))
            remember(state, KEPT_SECONDS, seen)
            yield pd.DataFrame([(key[0], "queued", attempts, pd.Timestamp(seen, unit="us"))], columns=["job_id", "status", "attempts", "last_seen"])
            return
        status, attempts, seen = state.getOption or ("queued", 0, 0)
        rows = pd.concat(list(batches)).sort_values(["at", "event_id"])
        for kind, at in zip(rows["kind"], rows["at"]):
            if status in ("done", "dead"):
                break
            seen = max(seen, int(at.value // 1000))
            if kind == "success":
                status = "done"
            elif kind == "failure":
                attempts += 1
                status = "dead" if attempts >= MAX_ATTEMPTS else "retry"
            else:
                status = "running"
        state.update((status, attempts, seen))
        remember(state, KEPT_SECONDS if status in ("done", "dead") else STALE_SECONDS, seen)
        yield pd.DataFrame([(key[0], status, attempts, pd.Timestamp(seen, unit="us"))], columns=["job_id", "status", "attempts", "last_seen"])

    timed = events.withWatermark("at", "1 hour")
    return timed.groupBy("job_id").applyInPandasWithState(fold, FOLD, "status string, attempts int, seen bigint", "update", GroupStateTimeout.EventTimeTimeout)


def first_of_key(events: DataFrame, key: str, within: str = "1 day") -> DataFrame:
    """An outbox: the first event of each key, repeats within the watermark dropped."""
    return events.withWatermark("at", within).dropDuplicatesWithinWatermark([key])


def rate_windows(events: DataFrame, key: str, width: str = "10 minutes", limit: int = 3) -> DataFrame:
    """Events per key and tumbling window, and how many are over the limit."""
    w = events.withWatermark("at", width).groupBy(key, F.window("at", width).alias("w")).agg(F.count("*").alias("n"))
    return w.select(key, F.col("w.start").alias("start"), "n", F.greatest(F.lit(0), F.col("n") - limit).alias("rejected"))


def sessions(events: DataFrame, key: str, gap: str = SESSION_GAP) -> DataFrame:
    """Sessions of each key: runs of events with no pause longer than the gap."""
    s = events.withWatermark("at", "1 hour").groupBy(key, F.session_window("at", gap).alias("s")).agg(F.count("*").alias("n"))
    return s.select(key, F.col("s.start").alias("start"), "n")


def route_failures(batch: DataFrame, attempts: str, retry_path: str, dead_path: str, number: int) -> None:
    """A ``foreachBatch`` step: failed jobs go to the retry table, or to the dead-letter table after the last attempt."""
    batch.where(F.col(attempts) < MAX_ATTEMPTS).write.mode("overwrite").parquet(f"{retry_path}/batch={number}")
    batch.where(F.col(attempts) >= MAX_ATTEMPTS).write.mode("overwrite").parquet(f"{dead_path}/batch={number}")
