"""Streaming queries (family S): the tables are read as file streams and drained.

Each result must equal the batch form on the same rows, for windows the watermark has closed.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline.operators import drift, telemetry
from wardline.operators import release as rel
from wardline.plans import bridge as b
from wardline.plans.drifts import event_batches, windowed_sql
from wardline.plans.quality import _ROW_CONTRACT, _TEXT_SQL, as_text
from wardline.plans.registry import query
from wardline.plans.release import _EDGES, _HIST, _REQ, _SRV, history, hist_sql, quantile_sql, release_gates
from wardline.sources.tables import work_dir
from wardline.streaming import jobs, state

CLOSED = "(SELECT max(ts) FROM events) - INTERVAL 10 MINUTE"


def stream_table(spark, d, name):
    schema = b.table(spark, d, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(d)


def event_stream(spark, d):
    return stream_table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def drained(spark, stream, name):
    out, mark = work_dir(spark, name), work_dir(spark, f"{name}-progress")
    jobs.drain(stream, out, mark)
    return spark.read.schema(stream.schema).parquet(out)


@query(
    "s1_stream_validation",
    f"""WITH {_TEXT_SQL}, bad AS (SELECT DISTINCT o_orderkey FROM v WHERE rule_id <> 'ghost.required')
    SELECT CASE WHEN b.o_orderkey IS NULL THEN 'valid' ELSE 'quarantined' END AS sink, t.o_orderkey FROM t LEFT JOIN bad b USING (o_orderkey)""",
)
def s1(spark, d):
    valid, held = work_dir(spark, "valid"), work_dir(spark, "quarantined")
    jobs.validate_stream(as_text(stream_table(spark, d, "orders")), _ROW_CONTRACT, valid, held, work_dir(spark, "progress"))
    read = lambda p, n: spark.read.parquet(p).select(F.lit(n).alias("sink"), "o_orderkey")
    return read(valid, "valid").unionByName(read(held, "quarantined"))


@query("s2_stream_request_counts", f"SELECT strftime(w, '%Y-%m-%d %H:%M') AS minute, event_type, count(*) AS total FROM (SELECT date_trunc('minute', ts) AS w, event_type FROM events) WHERE w + INTERVAL 1 MINUTE <= {CLOSED} GROUP BY 1, 2")
def s2(spark, d):
    found = drained(spark, jobs.windowed_counts(event_stream(spark, d), "ts", ["event_type"], "1 minute"), "counts")
    return found.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("minute"), "event_type", "total")


_SLIDE = "sl AS (SELECT route, seconds, date_trunc('minute', ts) - to_minutes(k::INT) AS ws FROM srv, range(0, 5) t(k))"


@query(
    "s2_stream_windowed_p95",
    f"WITH {_SRV}, {_SLIDE}, {quantile_sql(hist_sql('sl', 'ws, route', 'seconds', telemetry.LATENCY_BUCKETS), 'ws, route', 0.95)} SELECT strftime(ws, '%Y-%m-%d %H:%M') AS minute, route, estimate FROM est WHERE ws + INTERVAL 5 MINUTE <= {CLOSED}",
    ["estimate"],
)
def s2_p95(spark, d):
    rows = event_stream(spark, d).select("ts", F.col("event_type").alias("route"), (F.col("value") / 1000).alias("seconds"))
    counted = jobs.windowed_histogram(rows, "ts", "seconds", telemetry.LATENCY_BUCKETS, ["route"])
    closed = drained(spark, counted, "histogram").select(F.col("_w.start").alias("ws"), "route", "le", "bucket_count")
    found = telemetry.histogram_quantile(closed, ["ws", "route"], 0.95)
    return found.select(F.date_format("ws", "yyyy-MM-dd HH:mm").alias("minute"), "route", "estimate")


@query("s3_stream_windowed_psi", windowed_sql(f"w + INTERVAL 1 DAY <= {CLOSED}"), ["psi"])
def s3(spark, d):
    rows = event_batches(spark, d)
    edges = drift.reference_edges(rows, ["value"])
    fixed = drift.bin_proportions(rows.where("batch = 'reference'"), ["value"], edges=edges)
    stream = event_stream(spark, d).where(F.col("ts") >= F.lit("2024-01-11").cast("timestamp"))
    closed = drained(spark, jobs.windowed_bins(stream, ["value"], edges, "ts", "1 day", "10 minutes"), "bins")
    found = jobs.psi_of_bins(closed, fixed)
    return found.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "feature", "row_count", "psi")


@query("s4_stream_rollout", _REQ + " SELECT version, stage, canary_share, rollback_reason FROM outc", ["canary_share"])
def s4(spark, d):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", state.ROCKSDB)
    checks = rel.checkpoint_results(release_gates(spark, d), ["version", "seq"])
    path = work_dir(spark, "checkpoints")
    checks.write.parquet(path)
    stream = spark.readStream.schema(checks.schema).parquet(path)
    found = drained(spark, state.rollout(stream), "rollout")
    last = F.max_by(F.struct("stage", "canary_share", "rollback_reason"), "seq")
    return found.groupBy("version").agg(last.alias("_l")).select("version", "_l.*")


_GAP = "INTERVAL 30 MINUTE"


@query(
    "s5_stream_sessions",
    f"""WITH s0 AS (SELECT event_type, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY event_type ORDER BY ts) < {_GAP} THEN 0 ELSE 1 END AS fresh FROM events),
    s1 AS (SELECT *, sum(fresh) OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM s0),
    s2 AS (SELECT event_type, count(*) AS event_count, min(ts) AS a, max(ts) AS z FROM s1 GROUP BY event_type, sid)
    SELECT event_type, event_count, epoch_us(a) AS start_us, ((epoch_us(z) - epoch_us(a)) // 60000000)::BIGINT AS observed_minutes, CASE WHEN (epoch_us(z) - epoch_us(a)) // 60000000 <= 60 THEN 'PASS' ELSE 'FAIL' END AS status FROM s2 WHERE z + {_GAP} <= {CLOSED}""",
)
def s5(spark, d):
    found = drained(spark, jobs.sessions(event_stream(spark, d), "ts", ["event_type"], "30 minutes", "10 minutes", 60), "sessions")
    return found.select("event_type", "event_count", F.unix_micros("session_start").alias("start_us"), "observed_minutes", "status")


@query("s6_stream_first_registration", "SELECT DISTINCT user_id FROM events WHERE event_type = 'signup'")
def s6(spark, d):
    stream = event_stream(spark, d).where("event_type = 'signup'").select("user_id", "ts")
    return drained(spark, jobs.first_registrations(stream, ["user_id"], "ts", "60 days"), "registrations").select("user_id")


@query("s7_stream_stage_history", _HIST + f" SELECT model, seq, stage, previous_stage, CASE WHEN previous_stage IS NULL THEN stage = 'REGISTERED' ELSE previous_stage || '>' || stage IN ({_EDGES}) END AS is_legal FROM hist")
def s7(spark, d):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", state.ROCKSDB)
    batch = history(spark, d)
    stages = F.create_map(*[F.lit(x) for kv in (("signup", "REGISTERED"), ("view", "CANDIDATE"), ("click", "STAGING"), ("purchase", "SHADOW"), ("error", "CANARY")) for x in kv])
    stream = stream_table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("model"), F.col("event_id").alias("seq"), stages[F.col("event_type")].alias("stage")
    )
    del batch
    return drained(spark, state.stage_history(stream), "history").withColumn("model", F.col("model").cast("bigint"))
