"""V. Event-time operators: batch twins, and the streams over the replayed events."""

from pyspark.sql import functions as F

from ..operators import monitoring as mo
from ..operators.linear import linear_fit
from ..operators.scoring import fill_from_medians
from ..operators.stats import medians
from ..streaming import lifecycles as lc
from ..streaming import rates
from ..streaming.runs import replay, run_now, zoneless
from .registry import query


def events_stream(t):
    return replay(t.spark, t.folder, "events.parquet")


_LIMITER = """
WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT user_id, 0::BIGINT AS i, NULL::BIGINT AS event_id, NULL::BOOLEAN AS accepted, []::BIGINT[] AS log FROM (SELECT DISTINCT user_id FROM e)
 UNION ALL SELECT e.user_id, e.i, e.event_id, len(list_filter(r.log, lambda x: e.us - x < 28800000000)) < 2,
  CASE WHEN len(list_filter(r.log, lambda x: e.us - x < 28800000000)) < 2 THEN list_append(list_filter(r.log, lambda x: e.us - x < 28800000000), e.us) ELSE list_filter(r.log, lambda x: e.us - x < 28800000000) END
 FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
SELECT user_id, event_id, accepted FROM r WHERE i > 0"""


@query("v01_sliding_log", _LIMITER)
def v01(t):
    out = rates.sliding_log(t.events.select("user_id", "event_id", "ts"), "user_id", "event_id", most=2, seconds=28800)
    return out.select("user_id", "event_id", "accepted")


#: What the watermark (ten minutes, in whole milliseconds) has passed at the end of a replay.
_PASSED = "(SELECT epoch_us(max(ts)) // 1000 * 1000 - 600000000 FROM events WHERE {})"


@query("v01_sliding_log_stream", _LIMITER + f" AND event_id IN (SELECT event_id FROM events WHERE epoch_us(ts) < {_PASSED.format('true')})")
def v01_stream(t):
    """Requests decided in event time, as far as the watermark has come."""
    return run_now(rates.sliding_log_stream(events_stream(t), "user_id", "event_id", most=2, seconds=28800), "v01")


_FIXED = "SELECT time_bucket(INTERVAL '15 minutes', ts) AS window_start, user_id, count(*) AS requests, count(*) > 1 AS over_limit FROM events GROUP BY ALL"


@query("v02_fixed_windows", _FIXED)
def v02(t):
    out = rates.fixed_window_counts(t.events, "user_id", most=1)
    return zoneless(out, "window_start").drop("window_end")


@query("v02_fixed_windows_stream", f"SELECT * FROM ({_FIXED}) WHERE window_start + INTERVAL 15 MINUTE <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)")
def v02_stream(t):
    """Windows already closed by the watermark."""
    out = run_now(rates.fixed_window_counts(events_stream(t), "user_id", most=1, late="10 minutes"), "v02")
    return zoneless(out, "window_start").drop("window_end")


@query("v03_hopping_windows", """
SELECT window_start, user_id, count(*) AS requests FROM (SELECT user_id, unnest([b, b - INTERVAL 5 MINUTE, b - INTERVAL 10 MINUTE]) AS window_start FROM (SELECT user_id, time_bucket(INTERVAL '5 minutes', ts) AS b FROM events)) GROUP BY ALL""")
def v03(t):
    return zoneless(rates.hopping_counts(t.events, "user_id"), "window_start")


_SESSIONS = """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS n, event_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS beats FROM s GROUP BY user_id, s"""


@query("v04_liveness_sessions", _SESSIONS)
def v04(t):
    return lc.liveness(t.events, "user_id", "event_id", gap_seconds=21600)


@query("v04_liveness_stream", _SESSIONS + " HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)")
def v04_stream(t):
    out = run_now(lc.liveness_stream(events_stream(t), "user_id", gap="6 hours", late="10 minutes"), "v04")
    return zoneless(out, "session_start", "session_end")


_STATUS = {"view": "started", "purchase": "completed", "error": "failed"}


def job_events(df):
    kind = F.col("event_type")
    status = F.when(kind == "view", "started").when(kind == "purchase", "completed").when(kind == "error", "failed")
    return df.where(kind.isin(*_STATUS)).select(
        F.concat_ws("-", "user_id", F.date_format("ts", "yyyy-MM-dd")).alias("job_id"),
        F.concat_ws("/", "user_id", F.date_format("ts", "yyyy-MM-dd")).alias("connection_id"), status.alias("status"), "ts",
    )


def closings(df):
    return df.where("event_type = 'signup'").select(
        F.lit(None).cast("string").alias("job_id"), F.concat_ws("/", "user_id", F.date_format("ts", "yyyy-MM-dd")).alias("connection_id"),
        F.lit("disconnected").alias("status"), "ts",
    )


_JOBS = """
WITH e AS (SELECT user_id || '-' || strftime(ts, '%Y-%m-%d') AS job_id, CASE event_type WHEN 'view' THEN 'started' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'disconnected' END AS status, ts FROM events WHERE event_type <> 'click'),
b AS (SELECT *, min(ts) FILTER (WHERE status = 'started') OVER (PARTITION BY job_id) AS started_at FROM e),
p AS (SELECT job_id, started_at, arg_min(status, ts) FILTER (WHERE status IN ('completed', 'failed') AND ts >= started_at) AS st, min(ts) FILTER (WHERE status IN ('completed', 'failed') AND ts >= started_at) AS en, min(ts) FILTER (WHERE status = 'disconnected' AND ts > started_at) AS cl FROM b WHERE started_at IS NOT NULL GROUP BY job_id, started_at),
c AS (SELECT *, coalesce(en IS NULL OR cl < en, false) AND cl IS NOT NULL AS cut FROM p)
SELECT job_id, started_at, CASE WHEN cut THEN 'cancelled_disconnection' ELSE coalesce(st, 'running') END AS status, (epoch_us(CASE WHEN cut THEN cl ELSE en END) // 1000) - (epoch_us(started_at) // 1000) AS duration_ms FROM c"""


@query("v05_job_lifecycle", _JOBS)
def v05(t):
    out = lc.jobs(job_events(t.events), closings(t.events))
    return out.select("job_id", "started_at", "status", "duration_ms")


@query("v05_job_lifecycle_stream", f"SELECT job_id, status, duration_ms FROM ({_JOBS.replace('FROM events', f'FROM events WHERE epoch_us(ts) < {_PASSED.format("event_type != $click$")} AND').replace('AND WHERE', 'AND').replace('$', chr(39))}) WHERE status <> 'running'")
def v05_stream(t):
    e = events_stream(t)
    return run_now(lc.jobs_stream(job_events(e).unionByName(closings(e))), "v05").select("job_id", "status", "duration_ms")


def request_sides(df):
    rid = F.floor(F.col("event_id") / 2).cast("bigint")
    starts = df.where("event_id % 2 = 0").select(rid.alias("request_id"), "ts")
    ends = df.where("event_id % 2 = 1").select(rid.alias("request_id"), "ts", F.col("event_type").alias("status"))
    return starts, ends


_PAIRS = """(SELECT a.event_id // 2 AS request_id, a.ts AS started_at, b.event_type AS status, epoch_us(b.ts) // 1000 - epoch_us(a.ts) // 1000 AS latency_ms FROM events a JOIN events b ON a.event_id % 2 = 0 AND b.event_id = a.event_id + 1 AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 10 MINUTE)"""


@query("v06_request_pairs", f"SELECT time_bucket(INTERVAL '6 hours', started_at) AS window_start, status, count(*) AS requests, round(avg(latency_ms), 4) AS avg_latency_ms, max(latency_ms) AS max_latency_ms FROM {_PAIRS} GROUP BY ALL")
def v06(t):
    pairs = lc.request_pairs(*request_sides(t.events), "request_id", within="10 minutes")
    out = zoneless(lc.latency_by_window(pairs, "6 hours"), "window_start").drop("p95_latency_ms")
    return out.withColumn("avg_latency_ms", F.round("avg_latency_ms", 4))


@query("v06_request_pairs_stream", f"SELECT request_id, status, latency_ms FROM {_PAIRS}")
def v06_stream(t):
    """A stream-stream join; each side is a reader of its own with a watermark."""
    starts = request_sides(events_stream(t))[0]
    ends = request_sides(events_stream(t))[1]
    out = run_now(lc.request_pairs(starts, ends, "request_id", within="10 minutes", late="10 minutes"), "v06")
    return out.select("request_id", "status", "latency_ms")


_HEALTH = "SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, count(*) AS checks, round(avg(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0.0 END) * 100, 2) AS success_rate FROM events GROUP BY 1"


@query("v07_health_ratio", _HEALTH)
def v07(t):
    df = t.events.select("ts", (F.col("event_type") != "error").alias("ok"))
    return zoneless(lc.health_ratio(df, "ok"), "window_start")


@query("v08_availability", f"SELECT window_start, CASE WHEN success_rate = 100 THEN 'excellent' WHEN success_rate >= 90 THEN 'good' WHEN success_rate >= 75 THEN 'warning' ELSE 'critical' END AS grade FROM ({_HEALTH})")
def v08(t):
    df = t.events.select("ts", (F.col("event_type") != "error").alias("ok"))
    return zoneless(lc.availability(lc.health_ratio(df, "ok")), "window_start").select("window_start", "grade")


def metric_records(df):
    return df.select(
        (F.col("user_id") % 25).alias("model_id"), F.col("event_id").alias("id"), "ts",
        F.create_map(F.lit("r2"), F.col("value") / 500, F.lit("mae"), F.col("value")).alias("metrics"),
    )


def bounds(t):
    n = F.col("n_nationkey").cast("bigint")
    return t.nation.select(n.alias("model_id"), F.create_map(F.lit("min_r2"), n / 100, F.lit("max_mae"), (n + 450).cast("double")).alias("thresholds"))


_VIOLATIONS = """
WITH h AS (SELECT user_id % 25 AS model_id, event_id AS id, value / 500 AS r2, value AS mae, n_nationkey / 100 AS lo, (n_nationkey + 450)::DOUBLE AS hi FROM events JOIN nation ON user_id % 25 = n_nationkey)
SELECT model_id, id, 'r2' AS metric, r2 AS current, lo AS threshold FROM h WHERE r2 < lo UNION ALL SELECT model_id, id, 'mae', mae, hi FROM h WHERE mae > hi"""


def _violation_rows(checked):
    return checked.select("model_id", "id", F.explode("violations").alias("v")).select("model_id", "id", "v.metric", "v.current", "v.threshold")


@query("v09_metric_violations", _VIOLATIONS)
def v09(t):
    return _violation_rows(mo.check(metric_records(t.events), bounds(t), "model_id"))


@query("v09_metric_violations_stream", _VIOLATIONS)
def v09_stream(t):
    return run_now(_violation_rows(mo.check(metric_records(events_stream(t)), bounds(t), "model_id")), "v09")


@query("v09_recent_checks_stream", """
SELECT model_id, count(*) AS checks, round(avg(value), 6) AS mean FROM (SELECT user_id % 25 AS model_id, value, row_number() OVER (PARTITION BY user_id % 25 ORDER BY ts DESC) AS r FROM events) WHERE r <= 100 GROUP BY model_id""")
def v09_state(t):
    e = events_stream(t).select((F.col("user_id") % 25).alias("model_id"), "ts", "value")
    out = run_now(lc.recent_checks_stream(e, "model_id"), "v09s", "update")
    last = out.groupBy("model_id").agg(F.max_by(F.struct("checks", "mean"), "_batch").alias("s"))
    return last.select("model_id", "s.checks", F.round("s.mean", 6).alias("mean"))


_RUNNING = "SELECT event_type AS experiment, CASE WHEN user_id % 2 = 1 THEN 'model_b' ELSE 'model_a' END AS arm, count(*) AS results, round(avg((value - p) ** 2), 4) AS mse, round(avg(abs(value - p)), 4) AS mae FROM (SELECT *, value * 0.8765432 + event_id % 21 AS p FROM events) GROUP BY ALL"


def _results(df):
    from ..streaming.lifecycles import running_results

    rows = df.select(
        F.col("event_type").alias("experiment"), F.when(F.col("user_id") % 2 == 1, F.lit("model_b")).otherwise(F.lit("model_a")).alias("arm"),
        F.col("value"), (F.col("value") * 0.8765432 + F.col("event_id") % 21).alias("p"),
    )
    return running_results(rows, "experiment", "arm", "value", "p").withColumns({"mse": F.round("mse", 4), "mae": F.round("mae", 4)})


@query("v10_running_results", _RUNNING)
def v10(t):
    return _results(t.events)


@query("v10_running_results_stream", _RUNNING)
def v10_stream(t):
    return run_now(_results(events_stream(t)), "v10", "complete")


@query("v11_streaming_scores", """
WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem)
SELECT event_id, round(a + b * CASE WHEN event_id % 4 = 0 THEN (SELECT median(l_quantity) FROM lineitem) ELSE value / 10 END, 4) AS prediction FROM events, f""")
def v11(t):
    fit = linear_fit(t.lineitem, ["l_quantity"], "l_extendedprice")
    rows = events_stream(t).select("event_id", F.when(F.col("event_id") % 4 != 0, F.col("value") / 10).alias("l_quantity"))
    scored = fill_from_medians(rows, medians(t.lineitem, ["l_quantity"])).withColumn("prediction", F.round(fit.column(), 4))
    return run_now(scored.select("event_id", "prediction"), "v11")


_PROGRESS = "SELECT user_id AS job_id, arg_max(event_type, (ts, event_id)) AS progress, max(ts) AS at FROM events GROUP BY user_id"


@query("v12_latest_progress", _PROGRESS)
def v12(t):
    df = t.events.select(F.col("user_id").alias("job_id"), "event_type", "ts", "event_id")
    return lc.latest_progress(df, "job_id", "event_type", tie="event_id")


@query("v12_latest_progress_stream", _PROGRESS)
def v12_stream(t):
    df = events_stream(t).select(F.col("user_id").alias("job_id"), "event_type", "ts", "event_id")
    return zoneless(run_now(lc.latest_progress(df, "job_id", "event_type", tie="event_id"), "v12", "complete"), "at")


def switches(df):
    return df.where(F.col("event_type").isin("signup", "error")).select("user_id", "event_id", "ts", (F.col("event_type") == "signup").alias("up"))


_UPTIME = """
WITH s AS (SELECT user_id, ts, event_type = 'signup' AS up, lag(event_type) OVER w = 'signup' AS was_up, lag(ts) OVER w AS before FROM events WHERE event_type IN ('signup', 'error') WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, CAST(coalesce(sum(epoch_us(ts) // 1000 - epoch_us(before) // 1000) FILTER (WHERE NOT up AND was_up), 0) AS BIGINT) AS uptime_ms, count(*) FILTER (WHERE NOT up AND was_up) AS spans FROM s GROUP BY user_id"""


@query("v13_uptime", _UPTIME)
def v13(t):
    return lc.uptime(switches(t.events), "user_id", "event_id", "up")


@query("v13_uptime_stream", f"SELECT * FROM ({_UPTIME.replace('WHERE event_type IN', f'WHERE epoch_us(ts) < {_PASSED.format("event_type IN ($signup$, $error$)")} AND event_type IN').replace('$', chr(39))}) WHERE spans > 0")
def v13_stream(t):
    """Uptime from the spans that the watermark has passed."""
    out = run_now(lc.uptime_stream(switches(events_stream(t)), "user_id", "event_id", "up"), "v13")
    return out.groupBy("user_id").agg(F.sum("span_ms").alias("uptime_ms"), F.count(F.lit(1)).alias("spans"))
