"""Streaming queries over events, run to the end of the table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.plans.registry import query
from sparkloom.streaming import jobs

JOBS = """j AS (SELECT event_id % 500 AS job_id, event_id, ts, CASE event_id % 7 WHEN 0 THEN 'failure' WHEN 3 THEN 'failure' WHEN 5 THEN CASE WHEN event_id % 3 = 0 THEN 'success' ELSE 'beat' END ELSE 'beat' END AS kind FROM events)"""


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    kind = F.when((i % 7).isin(0, 3), "failure").when((i % 7 == 5) & (i % 3 == 0), "success").otherwise("beat")
    return jobs.event_stream(spark, f"{sf_dir}/events.parquet").select((i % 500).alias("job_id"), "event_id", kind.alias("kind"), "at")


@query(f"""WITH {JOBS}, n AS (SELECT *, sum((kind = 'failure')::INT) OVER w AS fails, coalesce(max((kind = 'success')::INT) OVER (PARTITION BY job_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS was_done,
  coalesce(sum((kind = 'failure')::INT) OVER (PARTITION BY job_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM j WINDOW w AS (PARTITION BY job_id ORDER BY ts, event_id)),
live AS (SELECT * FROM n WHERE was_done = 0 AND before < 3),
l AS (SELECT * FROM live QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT job_id, CASE WHEN kind = 'success' THEN 'done' WHEN kind = 'failure' AND fails >= 3 THEN 'dead' WHEN kind = 'failure' THEN 'retry' ELSE 'running' END AS status, fails::INT AS attempts FROM l""")
def job_state_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last state that events lead each job to."""
    found = jobs.available(jobs.job_states(job_events(spark, sf_dir)).where("status <> 'queued'"), ["job_id"])
    return found.select("job_id", "status", "attempts")


@query("SELECT user_id, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY user_id")
def stream_outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Idempotent delivery: each key of (user, type) is sent once."""
    e = jobs.event_stream(spark, f"{sf_dir}/events.parquet").withColumn("key", F.concat_ws(":", "user_id", "event_type"))
    sent = jobs.available(jobs.first_of_key(e.select("key", "user_id", "at"), "key", "365 days"), mode="append")
    return sent.groupBy("user_id").agg(F.count("*").alias("n"))


@query("SELECT user_id, strftime(time_bucket(INTERVAL 10 MINUTE, ts), '%Y-%m-%d %H:%M') AS slot, count(*) AS n, greatest(0, count(*) - 3) AS rejected FROM events GROUP BY user_id, time_bucket(INTERVAL 10 MINUTE, ts)")
def stream_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jobs.available(jobs.rate_windows(jobs.event_stream(spark, f"{sf_dir}/events.parquet"), "user_id"), ["user_id", "start"])
    return found.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm").alias("slot"), "n", "rejected")
