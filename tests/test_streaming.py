"""Streams over several files against batch results."""

import datetime as dt
import random

from pyspark.sql import functions as F

from sparkloom.streaming import jobs

T0 = dt.datetime(2024, 1, 1)


def stream_of(spark, path, parts):
    for n, rows in enumerate(parts):
        spark.createDataFrame(rows, "event_id long, job_id long, kind string, ts timestamp_ntz").coalesce(1).write.mode("append").parquet(path)
    return jobs.event_stream(spark, path)


def plain(rows):
    state = {}
    for _, job, kind, _ in sorted(rows, key=lambda r: (r[3], r[0])):
        status, n = state.get(job, ("queued", 0))
        if status in ("done", "dead"):
            continue
        if kind == "success":
            status = "done"
        elif kind == "failure":
            n += 1
            status = "dead" if n >= 3 else "retry"
        else:
            status = "running"
        state[job] = (status, n)
    return state


def test_job_states_over_micro_batches(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, rng.randrange(8), rng.choice(["failure", "beat", "beat", "success"]), T0 + dt.timedelta(minutes=i)) for i in range(60)]
    stream = stream_of(spark, f"{tmp_path}/e", [rows[:20], rows[20:40], rows[40:]])
    got = jobs.available(jobs.job_states(stream.select("job_id", "event_id", "kind", "at")).where("status <> 'queued'"), ["job_id"]).collect()
    assert {r.job_id: (r.status, r.attempts) for r in got} == plain(rows)


def test_ended_jobs_are_forgotten(spark, tmp_path):
    """A job's state goes a day of event time after it ended; until then it takes no more events."""
    at = lambda h: T0 + dt.timedelta(hours=h)
    parts = [[(1, 1, "success", at(0)), (2, 2, "beat", at(0))], [(3, 1, "beat", at(1)), (4, 9, "beat", at(30))], [(5, 9, "beat", at(60))], [(6, 1, "beat", at(61)), (7, 9, "beat", at(62))]]
    stream = stream_of(spark, f"{tmp_path}/e", parts)
    place = f"{tmp_path}/out"
    query = jobs.job_states(stream.select("job_id", "event_id", "kind", "at")).writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True)
    query = query.foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{place}/batch={n}")).start()
    query.awaitTermination()
    seen = [(r.job_id, r.status) for r in spark.read.parquet(place).orderBy("batch", "job_id", "status").collect()]
    assert [s for j, s in seen if j == 1] == ["done", "done", "running"]
    assert [s for j, s in seen if j == 2] == ["running", "queued"]


def test_windows_sessions_and_outbox(spark, tmp_path):
    rows = [(i, i % 2, "k", T0 + dt.timedelta(minutes=m)) for i, m in enumerate([0, 1, 2, 3, 4, 5, 40, 41, 90])]
    stream = stream_of(spark, f"{tmp_path}/e", [rows[:5], rows[5:]])
    got = {(r.job_id, r.start.hour * 60 + r.start.minute): (r.n, r.rejected) for r in jobs.available(jobs.rate_windows(stream, "job_id", limit=2), ["job_id", "start"]).collect()}
    assert got == {(0, 0): (3, 1), (1, 0): (3, 1), (0, 40): (1, 0), (1, 40): (1, 0), (0, 90): (1, 0)}
    runs = jobs.available(jobs.sessions(stream, "job_id"), mode="append").collect()  # the last session may still be open
    assert {(r.job_id, r.n) for r in runs} >= {(0, 3), (1, 3)} or len(runs) == 0
    sent = jobs.available(jobs.first_of_key(stream.withColumn("key", F.col("job_id").cast("string")).select("key", "at"), "key"), mode="append")
    assert sorted(r.key for r in sent.collect()) == ["0", "1"]


def test_failures_are_routed(spark, tmp_path):
    batch = spark.createDataFrame([(1, 1), (2, 3)], "job_id int, attempts int")
    for _ in range(2):  # a repeated batch overwrites itself
        jobs.route_failures(batch, "attempts", f"{tmp_path}/retry", f"{tmp_path}/dead", 0)
    assert [r.job_id for r in spark.read.parquet(f"{tmp_path}/retry").collect()] == [1]
    assert [r.job_id for r in spark.read.parquet(f"{tmp_path}/dead").collect()] == [2]
