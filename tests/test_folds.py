"""Folds as streams over shuffled micro-batches against batches, and batches against plain loops."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sparkloom.streaming import folds, jobs

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "job_id long, event_id long, at timestamp, kind string, stage string, percent double"
DELAY = "1 day"


def events(seed, n, keys=6):
    rng, rows, at = random.Random(seed), [], {}
    for i in range(n):
        k = rng.randrange(keys)
        at[k] = at.get(k, 0) + rng.choice([0, 1, 2, 20, 45, 200, 900, 5000])
        rows.append((k, i, T0 + dt.timedelta(seconds=at[k]), rng.choice(["submit", "start", "start", "beat", "failure", "success"]), rng.choice(["a", "a", "b"]), rng.choice([None, float(rng.randrange(100))])))
    return rows


def streamed(spark, path, rows, fold, parts=4):
    """The stream over shuffled files, ended by an event of another key that takes the watermark past all others."""
    rng = random.Random(1)
    rows = rng.sample(rows, len(rows))
    last = max(r[2] for r in rows) + dt.timedelta(days=1, milliseconds=1500)
    files = [rows[k::parts] for k in range(parts)] + [[(-1, 10_000, last, "none", "z", None)]]
    for part in files:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    return folds.stream(source, "job_id", fold, DELAY), int((last - dt.timedelta(days=1) - dt.datetime(1970, 1, 1)).total_seconds() * 1000)


FOLDS = [folds.SlidingLimit(), folds.Throttle(), folds.Replay(most=4), folds.Retries(again=1200)]


@pytest.mark.parametrize("fold", FOLDS, ids=lambda f: type(f).__name__)
def test_a_stream_over_shuffled_micro_batches_equals_a_batch(spark, tmp_path, fold):
    rows = events(3, 150)
    stream, until = streamed(spark, f"{tmp_path}/e", rows, fold)
    got = jobs.available(stream, mode="append").where("job_id >= 0").collect()
    want = folds.batch(spark.createDataFrame(rows, SCHEMA).repartition(3), "job_id", fold, until).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and len(want) > 20


def by_key(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[2], r[1])):
        out.setdefault(r[0], []).append(r)
    return out


def test_a_limit_slides(spark):
    rows = events(4, 400)
    got = {r.event_id: r.accepted for r in folds.batch(spark.createDataFrame(rows, SCHEMA), "job_id", folds.SlidingLimit()).collect()}
    for own in by_key(rows).values():
        accepted = []
        for r in own:
            ok = sum((r[2] - t).total_seconds() < 600 for t in accepted) < 3
            accepted += [r[2]] * ok
            assert got[r[1]] == ok
    assert len(got) == 400 and 0 < sum(got.values()) < 400


def test_notices_wait_for_the_last_published_one(spark):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    rows = [(1, 0, at(0), "", "a", 10.0), (1, 1, at(1), "", "a", 12.0), (1, 2, at(1.9), "", "a", 14.0), (1, 3, at(2.1), "", "a", 14.0), (1, 4, at(3), "", "a", 14.0), (1, 5, at(3.1), "", "b", 14.0), (1, 6, at(3.2), "", "b", 19.0), (1, 7, at(3.3), "", "b", None), (2, 8, at(0), "", "a", None), (2, 9, at(1), "", "a", 1.0)]
    got = sorted(r.event_id for r in folds.batch(spark.createDataFrame(rows, SCHEMA), "job_id", folds.Throttle(seconds=2)).collect())
    assert got == [0, 3, 5, 6, 8, 9]


def test_retries_dead_letters_replays_and_lost_jobs(spark):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    e = lambda i, s, kind, job=1: (job, i, at(s), kind, None, None)
    rows = [e(0, 0, "submit"), e(1, 10, "start"), e(2, 20, "failure"), e(3, 55, "start"), e(4, 60, "failure"), e(5, 95, "start"), e(6, 100, "failure"), e(7, 101, "beat")]
    rows += [e(10, 0, "submit", 2), e(11, 130, "start", 2), e(12, 140, "beat", 2), e(13, 4000, "success", 2), e(20, 5, "beat", 3)]
    frame = spark.createDataFrame(rows, SCHEMA)
    base = int((T0 - dt.datetime(1970, 1, 1)).total_seconds() * 1000)
    got = sorted((r.job_id, (r.as_of - base) // 1000, r.output, r.attempts) for r in folds.batch(frame, "job_id", folds.Retries()).collect())
    assert got[:4] == [(1, 0, "publish", 0), (1, 50, "retry", 1), (1, 90, "retry", 2), (1, 100, "dead", 3)]
    assert got[4:8] == [(2, 0, "publish", 0), (2, 60, "replay", 0), (2, 120, "replay", 0), (2, 3740, "lost", 0)] and all(o == "replay" and j == 2 for j, _, o, _ in got[8:]) and len(got) == 12


def test_outputs_are_routed_and_state_shrinks(spark, tmp_path):
    """Every job succeeds in the end: its state is gone when the watermark has passed that."""
    rows = [(k, 10 * k + n, T0 + dt.timedelta(minutes=10 * k + n), kind, None, None) for k in range(30) for n, kind in enumerate(["submit", "start", "success"])]
    rows.append((99, 9999, T0 + dt.timedelta(days=3), "submit", None, None))
    for part in (rows[:30], rows[30:60], rows[60:]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/e")
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/e")
    found = folds.stream(source, "job_id", folds.Retries(again=100_000), DELAY)
    outputs = ["publish", "retry", "replay", "lost", "dead"]
    query = found.writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True)
    query = query.foreachBatch(lambda b, n: folds.route(b, f"{tmp_path}/out", outputs, n)).start()
    query.awaitTermination()
    assert {r.job_id for r in spark.read.parquet(f"{tmp_path}/out/publish").collect()} == set(range(30))
    assert spark.read.parquet(f"{tmp_path}/out/dead").count() == 0
    held = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
    assert max(held) >= 30 and held[-1] < max(held) / 3


def test_keys_without_events_and_null_keys(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert folds.batch(none, "job_id", folds.Replay()).count() == 0
    rows = [(None, 1, T0, "submit", None, None), (4, 2, T0, "submit", None, None)]
    assert [r.job_id for r in folds.batch(spark.createDataFrame(rows, SCHEMA), "job_id", folds.SlidingLimit()).collect()] == [4]
    assert folds.batch(spark.createDataFrame(rows, SCHEMA).where(F.lit(False)), "job_id", folds.Retries()).count() == 0


def test_replay_buffer_keeps_the_last_events_however_old(spark, tmp_path):
    """A user's 32 last events stay, also those of months ago; ties by the larger id."""
    from sparkloom.plans.registry import QUERIES

    rows = [(1, i, T0 + dt.timedelta(days=20 * i)) for i in range(40)] + [(2, 100, T0), (2, 101, T0), (2, 102, T0 + dt.timedelta(days=300))]
    spark.createDataFrame(rows, "user_id long, event_id long, ts timestamp").write.parquet(f"{tmp_path}/events.parquet")
    got = {(r.user_id, r.event_id) for r in QUERIES["replay_buffer"](spark, str(tmp_path)).collect()}
    assert got == {(1, i) for i in range(8, 40)} | {(2, 100), (2, 101), (2, 102)}
