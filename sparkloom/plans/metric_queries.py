"""Metrics and evaluation analytics over events, labels and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.functions import text as T
from sparkloom.plans.registry import query
from sparkloom.storage import table
from sparkloom.streaming import folds

# Thresholds of warnings.
LOW_SCORE, FAIL_RATE, MIN_SAMPLES, QUEUE_DEPTH = 0.7, 0.15, 5, 50

#: Averages are lifted by 1e-9 before rounding, so that engines that round ties differently agree.
#: Evaluation samples made of events: a status, two scores, a failure stage.
SAMPLES = """s AS (SELECT event_id, user_id, ts, event_type, CASE event_id % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'pending' WHEN 2 THEN 'skipped' ELSE 'done' END AS status,
  CASE WHEN event_id % 5 > 2 THEN (event_id % 101) / 100.0::DOUBLE END AS faith, CASE WHEN event_id % 5 > 2 THEN (event_id % 37) / 36.0::DOUBLE END AS precision_,
  CASE WHEN event_id % 5 = 0 AND event_id % 3 > 0 THEN 'stage' || (event_id % 3) END AS stage FROM events)"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 5
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", "ts", "event_type",
        F.when(k == 0, "failed").when(k == 1, "pending").when(k == 2, "skipped").otherwise("done").alias("status"),
        F.when(k > 2, (F.col("event_id") % 101) / 100.0).alias("faith"),
        F.when(k > 2, (F.col("event_id") % 37) / 36.0).alias("precision_"),
        F.when((k == 0) & (F.col("event_id") % 3 > 0), F.concat(F.lit("stage"), F.col("event_id") % 3)).alias("stage"),
    )


@query(f"""WITH {SAMPLES} SELECT count(*) AS total, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'pending') AS pending,
  count(*) FILTER (status = 'skipped') AS skipped, round(count(*) FILTER (status = 'failed') / count(*), 4) AS failure_rate, round(avg(faith) + 1e-9, 4) AS avg_faith, round(avg(precision_) + 1e-9, 4) AS avg_precision FROM s""")
def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda v: F.count_if(F.col("status") == v)
    return samples(spark, sf_dir).agg(
        F.count("*").alias("total"), *(n(v).alias(v) for v in ("done", "failed", "pending", "skipped")),
        F.round(n("failed") / F.count("*"), 4).alias("failure_rate"), F.round(F.avg("faith") + 1e-9, 4).alias("avg_faith"), F.round(F.avg("precision_") + 1e-9, 4).alias("avg_precision"),
    )


def _trend(spark: SparkSession, sf_dir: str, unit: str) -> DataFrame:
    b = F.date_format(F.date_trunc(unit, "ts"), "yyyy-MM-dd HH:mm").alias("bucket")
    return samples(spark, sf_dir).groupBy(b).agg(F.count("*").alias("total"), F.count_if(F.col("status") == "failed").alias("failed"), F.round(F.avg("faith") + 1e-9, 4).alias("avg_faith"))


TREND = "WITH {s} SELECT strftime(date_trunc('{u}', ts), '%Y-%m-%d %H:%M') AS bucket, count(*) AS total, count(*) FILTER (status = 'failed') AS failed, round(avg(faith) + 1e-9, 4) AS avg_faith FROM s GROUP BY 1"


@query(TREND.format(s=SAMPLES, u="day"))
def eval_trend_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trend(spark, sf_dir, "day")


@query(TREND.format(s=SAMPLES, u="hour"))
def eval_trend_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trend(spark, sf_dir, "hour")


@query(f"""WITH {SAMPLES}, c AS (SELECT date_trunc('day', ts) AS d, coalesce(stage, 'unknown') AS stage, count(*) AS n FROM s WHERE status = 'failed' GROUP BY 1, 2)
SELECT strftime(d, '%Y-%m-%d') AS day, string_agg(stage || '=' || n, ' ' ORDER BY stage) AS stages FROM c GROUP BY d""")
def failure_stage_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = samples(spark, sf_dir).where("status = 'failed'").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.coalesce("stage", F.lit("unknown")).alias("stage")).agg(F.count("*").alias("n"))
    m = c.groupBy("day").agg(F.map_from_entries(F.collect_list(F.struct("stage", F.col("n").cast("string")))).alias("m"))
    return m.select("day", T.format_key_values(F.col("m")).alias("stages"))


#: Log lines of ``key=value`` words, made of events.
DETAIL = "l AS (SELECT event_id, ts, 'provider=' || event_type || ' provider_ms=' || (event_id % 900) || CASE WHEN event_id % 4 = 0 THEN ' persist_ms=bad' ELSE ' persist_ms=' || (event_id % 90) END || ' ok=' || (event_id % 6 > 0) AS detail FROM events)"


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    persist = F.when(i % 4 == 0, "bad").otherwise((i % 90).cast("string"))
    detail = F.concat(F.lit("provider="), "event_type", F.lit(" provider_ms="), i % 900, F.lit(" persist_ms="), persist, F.lit(" ok="), (i % 6 > 0).cast("string"))
    return table(spark, sf_dir, "events").select("event_id", "ts", detail.alias("detail"))


@query(f"""WITH {DETAIL}, p AS (SELECT regexp_extract(detail, 'provider=([^ ]*)', 1) AS provider, regexp_extract(detail, 'ok=([^ ]*)', 1) = 'true' AS ok FROM l)
SELECT provider, count(*) FILTER (ok) AS succeeded, count(*) FILTER (NOT ok) AS failed, round(count(*) FILTER (NOT ok) / count(*), 4) AS rate FROM p GROUP BY provider""")
def provider_failure_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    kv = log_lines(spark, sf_dir).select(T.key_values(F.col("detail")).alias("kv"))
    p = kv.select(F.col("kv")["provider"].alias("provider"), (F.col("kv")["ok"] == "true").alias("ok"))
    bad = F.count_if(~F.col("ok"))
    return p.groupBy("provider").agg(F.count_if("ok").alias("succeeded"), bad.alias("failed"), F.round(bad / F.count("*"), 4).alias("rate"))


@query(f"""WITH {DETAIL} SELECT round(avg(TRY_CAST(regexp_extract(detail, 'provider_ms=([^ ]*)', 1) AS INT)), 1) AS provider_ms, round(avg(TRY_CAST(regexp_extract(detail, 'persist_ms=([^ ]*)', 1) AS INT)), 1) AS persist_ms,
  round(avg(TRY_CAST(regexp_extract(detail, 'missing_ms=([^ ]*)', 1) AS INT)), 1) AS missing_ms FROM l""")
def stage_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    kv = log_lines(spark, sf_dir).select(T.key_values(F.col("detail")).alias("kv"))
    return kv.agg(*(F.round(F.avg(F.col("kv")[k].try_cast("int")), 1).alias(k) for k in ("provider_ms", "persist_ms", "missing_ms")))


@query("""SELECT key, count(*) AS n FROM (SELECT unnest(['type:' || event_type, 'user:' || (user_id % 10), 'k:' || coalesce(json_extract_string(props, '$.k'), 'none')]) AS key FROM events) GROUP BY key""")
def telemetry_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.coalesce(F.get_json_object("props", "$.k"), F.lit("none"))
    keys = F.array(F.concat(F.lit("type:"), "event_type"), F.concat(F.lit("user:"), (F.col("user_id") % 10).cast("string")), F.concat(F.lit("k:"), k))
    return table(spark, sf_dir, "events").select(F.explode(keys).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


@query("SELECT lang AS bucket, count(*) AS files, sum(n_chars)::BIGINT AS chars, round(100.0 * count(*) / sum(count(*)) OVER (), 1) AS percent FROM documents GROUP BY lang")
def file_type_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("bucket")).agg(F.count("*").alias("files"), F.sum("n_chars").alias("chars"))
    total = F.broadcast(g.agg(F.sum("files").alias("total")))  # one row
    return g.join(total).select("bucket", "files", "chars", F.round(F.lit(100.0) * F.col("files") / F.col("total"), 1).alias("percent"))


@query("SELECT count(*) AS total, count(*) FILTER (quality = 1) AS ready, count(*) FILTER (quality = 0) AS failed, count(*) FILTER (quality IS NULL) AS not_indexed FROM documents LEFT JOIN labels USING (doc_id)")
def coverage_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    q = F.col("quality")
    return d.agg(F.count("*").alias("total"), F.count_if(q == 1).alias("ready"), F.count_if(q == 0).alias("failed"), F.count_if(q.isNull()).alias("not_indexed"))


@query("SELECT event_type, count(DISTINCT user_id) AS users, max(event_id) + 1 AS next_seq FROM events GROUP BY event_type")
def backlog_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.countDistinct("user_id").alias("users"), (F.max("event_id") + 1).alias("next_seq"))


@query("""WITH m AS (SELECT max(ts) AS now FROM events) SELECT event_type, count(*) FILTER (ts >= now - INTERVAL 1 HOUR) AS h1, count(*) FILTER (ts >= now - INTERVAL 24 HOUR) AS h24, count(*) FILTER (ts >= now - INTERVAL 7 DAY) AS d7 FROM events, m GROUP BY event_type""")
def window_action_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions in the last hour, day and week before ``as_of``, the newest event."""
    e = table(spark, sf_dir, "events")
    at = F.broadcast(e.agg(F.max("ts").alias("as_of")))  # one row
    n = lambda span: F.count_if(F.col("ts") >= F.col("as_of") - F.expr(f"INTERVAL {span}"))
    return e.join(at).groupBy("event_type").agg(n("1 HOUR").alias("h1"), n("24 HOURS").alias("h24"), n("7 DAYS").alias("d7"))


@query(f"""WITH {SAMPLES}, k AS (SELECT event_type, count(*) AS n, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'pending') AS pending FROM s GROUP BY event_type)
SELECT event_type, n, round(failed / n, 4) AS rate, CASE WHEN n >= 5 AND failed / n > 0.15 THEN 'fail-rate' WHEN pending > 50 THEN 'queue' ELSE 'ok' END AS warning FROM k""")
def kpi_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = samples(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status") == "pending").alias("pending"))
    rate = F.col("failed") / F.col("n")
    return k.select("event_type", "n", F.round(rate, 4).alias("rate"), F.when((F.col("n") >= MIN_SAMPLES) & (rate > FAIL_RATE), "fail-rate").when(F.col("pending") > QUEUE_DEPTH, "queue").otherwise("ok").alias("warning"))


@query("SELECT event_type, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95 FROM events GROUP BY event_type")
def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.percentile("value", F.lit(0.5)), 4).alias("p50"), F.round(F.percentile("value", F.lit(0.95)), 4).alias("p95"))


@query(f"WITH {SAMPLES} SELECT event_id FROM s WHERE faith < 0.7 OR precision_ < 0.7 OR status IN ('failed', 'skipped')")
def low_score_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).where((F.col("faith") < LOW_SCORE) | (F.col("precision_") < LOW_SCORE) | F.col("status").isin("failed", "skipped")).select("event_id")


@query("""WITH g AS (SELECT *, (lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 15 MINUTE)::INT AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT user_id, event_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM g)
SELECT user_id, run::BIGINT AS run, count(*) AS n, min(event_id) AS first_event FROM r GROUP BY user_id, run""")
def session_reuse_15m(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run is reused while its user comes back within fifteen minutes."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events")
    fresh = F.coalesce((F.col("ts") - F.lag("ts").over(w) > F.expr("INTERVAL 15 MINUTES")), F.lit(True)).cast("int")
    r = e.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(w))
    return r.groupBy("user_id", "run").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


@query("SELECT user_id, strftime(time_bucket(INTERVAL 10 MINUTE, ts), '%Y-%m-%d %H:%M') AS slot, count(*) AS n, greatest(0, count(*) - 3) AS rejected FROM events GROUP BY user_id, time_bucket(INTERVAL 10 MINUTE, ts)")
def rate_limit_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "events").groupBy("user_id", F.window(F.col("ts").cast("timestamp"), "10 minutes").alias("w")).agg(F.count("*").alias("n"))
    return g.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("slot"), "n", F.greatest(F.lit(0), F.col("n") - 3).alias("rejected"))


@query("""WITH m AS (SELECT max(ts) AS now FROM events), p AS (SELECT event_id, (CASE WHEN event_type = 'purchase' THEN 100 ELSE 50 END) + floor(least(900, epoch(now) - epoch(ts)) / 18)::BIGINT AS priority, epoch(now) - epoch(ts) > 900 AS overdue FROM events, m)
SELECT event_id, priority::BIGINT AS priority, overdue FROM p ORDER BY priority DESC, event_id LIMIT 5""")
def priority_aging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next batch of five: a kind's priority, plus one for each 18 s of waiting, up to 900 s."""
    e = table(spark, sf_dir, "events")
    at = F.broadcast(e.agg(F.max("ts").alias("as_of")))  # one row
    wait = F.unix_micros(F.col("as_of").cast("timestamp")) / 1e6 - F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    priority = F.when(F.col("event_type") == "purchase", 100).otherwise(50) + F.floor(F.least(F.lit(900.0), wait) / 18)
    return e.join(at).select("event_id", priority.cast("bigint").alias("priority"), (wait > 900).alias("overdue")).orderBy(F.desc("priority"), "event_id").limit(5)


#: Events in the order in which folds take them.
ORDERED = "e AS (SELECT user_id, event_id, event_type, value, epoch_ms(ts) AS ms, row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id) AS n FROM events)"


def timed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))


@query(f"""WITH RECURSIVE {ORDERED},
r AS (SELECT user_id, n, event_id, [ms] AS kept, true AS accepted FROM e WHERE n = 1
  UNION ALL SELECT user_id, n, event_id, CASE WHEN len(live) < 3 THEN list_append(live, ms) ELSE live END, len(live) < 3
  FROM (SELECT e.user_id, e.n, e.event_id, e.ms, list_filter(r.kept, lambda x: e.ms - x < 172800000) AS live FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1))
SELECT user_id, event_id, accepted FROM r""")
def rate_limit_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which events pass a limit of three accepted ones in the two days before."""
    return folds.batch(timed_events(spark, sf_dir), "user_id", folds.SlidingLimit(3, 172_800))


@query(f"""WITH RECURSIVE {ORDERED}, s AS (SELECT user_id, n, event_id, ms, CASE WHEN event_type = 'purchase' THEN 'sold' ELSE 'seen' END AS stage, floor(value / 5)::INT AS pct FROM e),
r AS (SELECT user_id, n, event_id, ms AS last, stage AS last_stage, pct AS last_pct, true AS sent FROM s WHERE n = 1
  UNION ALL SELECT user_id, n, event_id, CASE WHEN ok THEN ms ELSE last END, CASE WHEN ok THEN stage ELSE last_stage END, CASE WHEN ok THEN pct ELSE last_pct END, ok
  FROM (SELECT s.user_id, s.n, s.event_id, ms, stage, pct, last, last_stage, last_pct,
    stage <> last_stage OR (pct IS NOT NULL AND (last_pct IS NULL OR abs(pct - last_pct) >= 5)) OR ms - last >= 86400000 AS ok FROM r JOIN s ON s.user_id = r.user_id AND s.n = r.n + 1))
SELECT user_id, event_id FROM r WHERE sent""")
def progress_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress is published at first, on a change of stage, on a step of five since the last published one, and a day after it."""
    stage = F.when(F.col("event_type") == "purchase", "sold").otherwise("seen")
    e = timed_events(spark, sf_dir).select("user_id", "event_id", "at", stage.alias("stage"), F.floor(F.col("value") / 5).cast("double").alias("percent"))
    return folds.batch(e, "user_id", folds.Throttle(seconds=86_400))


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 32")
def replay_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a user's buffer holds after the last event: the last 32, however old."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, sf_dir, "events").withColumn("n", F.row_number().over(w)).where(F.col("n") <= folds.REPLAY_EVENTS).select("user_id", "event_id")


@query()
def job_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a queue does with each user's job: publish, retry after an hour, replay after a day, take back after two, give up; a test holds the fold."""
    i = F.col("event_id")
    kind = F.when(i % 5 == 0, "submit").when(i % 5 == 1, "start").when(i % 5 == 2, "beat").when(i % 10 == 3, "success").otherwise("failure")
    e = timed_events(spark, sf_dir).select("user_id", "event_id", "at", kind.alias("kind"))
    return folds.batch(e, "user_id", folds.Retries(retry=3600, again=86_400, lost=172_800))


@query("SELECT o_custkey AS file_id, o_orderkey AS job, o_orderkey < max(o_orderkey) OVER (PARTITION BY o_custkey) AS superseded FROM orders")
def superseded_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = F.max("o_orderkey").over(Window.partitionBy("o_custkey"))
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file_id"), F.col("o_orderkey").alias("job"), (F.col("o_orderkey") < newest).alias("superseded"))


@query("SELECT user_id, event_type, sha256(user_id || chr(31) || event_type || chr(31) || strftime(ts, '%Y-%m-%d')) AS failure_key, count(*) AS repeats FROM events GROUP BY user_id, event_type, strftime(ts, '%Y-%m-%d')")
def failure_event_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One failure per key, however often it is reported."""
    day = F.date_format("ts", "yyyy-MM-dd")
    e = table(spark, sf_dir, "events").select("user_id", "event_type", T.identity(F.col("user_id"), F.col("event_type"), day).alias("failure_key"))
    return e.groupBy("user_id", "event_type", "failure_key").agg(F.count("*").alias("repeats"))
