"""Sessions, jobs, request pairs, health, progress and uptime over event time."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..functions.scalars import elapsed_ms, label_by
from ..operators.windows import frame_window, running_sum
from .ordered import in_order

# Heartbeat tick and availability bands.
HEARTBEAT = "30 seconds"
TERMINAL = ("completed", "failed", "cancelled")
DISCONNECTED = "cancelled_disconnection"


def liveness_stream(df: DataFrame, key: str, ts: str = "ts", gap: str = HEARTBEAT, late: str | None = None) -> DataFrame:
    """Sessions of heartbeats closer than ``gap``; a session ends ``gap`` after its last one."""
    rows = df.withWatermark(ts, late) if late else df
    out = rows.groupBy(F.session_window(ts, gap).alias("s"), key).agg(F.count(F.lit(1)).alias("beats"))
    return out.select(key, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "beats")


def liveness(df: DataFrame, key: str, order: str, ts: str = "ts", gap_seconds: int = 30, **sizes) -> DataFrame:
    """Batch twin of the sessions, safe for a key with most of the heartbeats: the gap to the
    row before and the running session number are computed over blocks of rows."""
    gap = F.lit(gap_seconds * 1_000_000)
    rows = df.select(key, order, F.col(ts), F.unix_micros(F.col(ts).cast("timestamp")).alias("_us"))
    opened = frame_window(
        rows, ["_us", order], lambda w: {"_new": F.coalesce(F.col("_us") - F.lag("_us").over(w) >= gap, F.lit(True)).cast("int")},
        before=1, keys=[key], **sizes,
    )
    numbered = running_sum(opened, ["_us", order], F.col("_new"), "_session", [key], **sizes)
    end = F.col("session_end") + F.make_dt_interval(secs=F.lit(gap_seconds))
    return (
        numbered.groupBy(key, "_session").agg(F.min(ts).alias("session_start"), F.max(ts).alias("session_end"), F.count(F.lit(1)).alias("beats"))
        .withColumn("session_end", end).drop("_session")
    )


def jobs(events: DataFrame, disconnects: DataFrame, job: str = "job_id", connection: str = "connection_id", ts: str = "ts") -> DataFrame:
    """One row per started job: final status, end and duration; open jobs of a closed
    connection are cancelled at the time it closed.

    A job starts at its first ``started`` event; only what comes at or after that can end it, and
    only a closing after it can cancel it, so no duration is negative.
    """
    starts = events.where("status = 'started'").groupBy(job).agg(F.first(connection, ignorenulls=True).alias(connection), F.min(ts).alias("started_at"))
    ends = events.where(F.col("status").isin(*TERMINAL)).select(job, F.col("status").alias("_status"), F.col(ts).alias("_ended"))
    ended = ends.join(starts.select(job, "started_at"), job).where("_ended >= started_at").groupBy(job).agg(
        F.min_by("_status", "_ended").alias("_status"), F.min("_ended").alias("_ended")
    )
    # the next closing after each start: one pass over the starts and closings of a connection
    marks = starts.select(connection, job, F.col("started_at").alias("_at"), F.lit(None).cast(events.schema[ts].dataType).alias("_close"))
    marks = marks.unionByName(disconnects.select(connection, F.lit(None).cast("string").alias(job), F.col(ts).alias("_at"), F.col(ts).alias("_close")))
    later = Window.partitionBy(connection).orderBy(F.unix_micros(F.col("_at").cast("timestamp"))).rangeBetween(1, Window.unboundedFollowing)
    closed = marks.withColumn("_closed", F.min("_close").over(later)).where(F.col(job).isNotNull()).select(job, "_closed")
    rows = starts.join(ended, job, "left").join(closed, job, "left")
    cut = F.coalesce(F.col("_closed").isNotNull() & (F.col("_ended").isNull() | (F.col("_closed") < F.col("_ended"))), F.lit(False))
    ended = F.when(cut, F.col("_closed")).otherwise(F.col("_ended"))
    return rows.select(
        job, connection, "started_at", ended.alias("ended_at"),
        F.when(cut, F.lit(DISCONNECTED)).otherwise(F.coalesce("_status", F.lit("running"))).alias("status"),
        elapsed_ms(F.col("started_at"), ended).alias("duration_ms"),
    )


def jobs_stream(
    stream: DataFrame, job: str = "job_id", connection: str = "connection_id", ts: str = "ts", late: str = "10 minutes", remember: str = "1 day",
) -> DataFrame:
    """Finished jobs as they end, decided in event time once the watermark has passed the event.

    ``stream`` holds job events and ``disconnected`` events (job null) of one schema. The state of a connection is its
    events that the watermark has not passed, its open jobs with start times, and for ``remember`` the jobs that
    ended, so that a repeated start opens none of them again. A connection without open jobs is forgotten after that.
    """
    keep = int(pd.Timedelta(remember).total_seconds() * 1_000_000)
    rank = F.when(F.col("status") == "started", 0).when(F.col("status") == "disconnected", 2).otherwise(1)
    rows = stream.select(F.col(connection).cast("string").alias("c"), F.col(ts), rank.alias("rank"), F.col(job).cast("string").alias("j"), "status")

    def step(name, events, kept, now):
        opened, ended = (dict(zip(kept[0], kept[1])), dict(zip(kept[2], kept[3]))) if kept else ({}, {})
        out = []
        for us, _, j, status in events:
            if status == "started":
                if j not in opened and j not in ended:
                    opened[j] = us
                continue
            over = [k for k, at in opened.items() if at < us] if status == "disconnected" else [j] if status in TERMINAL and j in opened else []
            for k in over:
                out.append((name[0], k, DISCONNECTED if status == "disconnected" else status, us // 1000 - opened.pop(k) // 1000))
                ended[k] = us
        ended = {k: at for k, at in ended.items() if now - at < keep}
        if not opened and not ended:
            return out, None, None
        value = list(opened), [int(v) for v in opened.values()], list(ended), [int(v) for v in ended.values()]
        return out, value, min(ended.values()) + keep if ended else None

    kept = "jobs array<string>, starts array<bigint>, ended array<string>, ends array<bigint>"
    return in_order(rows, "c", ts, late, ["rank", "j", "status"], kept, "connection_id string, job_id string, status string, duration_ms bigint", step)


def request_pairs(starts: DataFrame, ends: DataFrame, key: str, ts: str = "ts", within: str = "60 seconds", late: str | None = None) -> DataFrame:
    """Requests joined with their responses by id inside a time bound, with the latency."""
    if late:
        starts, ends = starts.withWatermark(ts, late), ends.withWatermark(ts, late)
    a, b = starts.alias("a"), ends.alias("b")
    bound = (
        (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col(f"b.{ts}") >= F.col(f"a.{ts}"))
        & (F.col(f"b.{ts}") <= F.col(f"a.{ts}") + F.expr(f"INTERVAL {within}"))
    )
    return a.join(b, bound).select(
        F.col(f"a.{key}").alias(key), F.col(f"a.{ts}").alias("started_at"), F.col("b.status").alias("status"),
        elapsed_ms(F.col(f"a.{ts}"), F.col(f"b.{ts}")).alias("latency_ms"),
    )


def latency_by_window(pairs: DataFrame, window: str = "1 hour") -> DataFrame:
    out = pairs.groupBy(F.window("started_at", window).alias("w"), "status").agg(
        F.count(F.lit(1)).alias("requests"), F.avg("latency_ms").alias("avg_latency_ms"), F.max("latency_ms").alias("max_latency_ms"),
        F.percentile_approx("latency_ms", 0.95).alias("p95_latency_ms"),
    )
    return out.select(F.col("w.start").alias("window_start"), "status", "requests", "avg_latency_ms", "max_latency_ms", "p95_latency_ms")


def health_ratio(df: DataFrame, ok: str, ts: str = "ts", window: str = "1 hour", late: str | None = None) -> DataFrame:
    """Passed checks in percent to two decimals, per window."""
    rows = df.withWatermark(ts, late) if late else df
    out = rows.groupBy(F.window(ts, window).alias("w")).agg(
        F.count(F.lit(1)).alias("checks"), F.round(F.avg(F.col(ok).cast("double")) * 100, 2).alias("success_rate")
    )
    return out.select(F.col("w.start").alias("window_start"), "checks", "success_rate")


def availability(df: DataFrame, rate: str = "success_rate") -> DataFrame:
    """Grade of a success rate: all passed, at least 90, at least 75, or below."""
    r = F.col(rate)
    grade = F.when(r == 100, F.lit("excellent")).otherwise(label_by(r, [(75, "critical"), (90, "warning")], "good"))
    return df.withColumn("grade", grade)


def running_results(df: DataFrame, experiment: str, arm: str, actual: str, predicted: str) -> DataFrame:
    """Running error statistics per arm of an experiment; batch or stream."""
    e = F.col(actual) - F.col(predicted)
    return df.groupBy(experiment, arm).agg(
        F.count(F.lit(1)).alias("results"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"),
    )


def latest_progress(df: DataFrame, job: str, message: str, ts: str = "ts", tie: str | None = None) -> DataFrame:
    """Latest progress message of each job; batch or stream."""
    at = F.struct(ts, tie) if tie else F.col(ts)
    return df.groupBy(job).agg(F.max_by(message, at).alias("progress"), F.max(ts).alias("at"))


def uptime(df: DataFrame, key: str, order: str, connected: str, ts: str = "ts", **sizes) -> DataFrame:
    """Connected milliseconds per key: from the last connect before each disconnect."""
    rows = df.select(key, order, connected, F.unix_micros(F.col(ts).cast("timestamp")).alias("_us"))
    spans = frame_window(
        rows, ["_us", order],
        lambda w: {"_from": F.when(~F.col(connected) & F.lag(connected).over(w), F.lag("_us").over(w))},
        before=1, keys=[key], **sizes,
    )
    ms = F.floor(F.col("_us") / 1000) - F.floor(F.col("_from") / 1000)
    return spans.groupBy(key).agg(F.coalesce(F.sum(ms), F.lit(0)).cast("bigint").alias("uptime_ms"), F.count("_from").alias("spans"))


def uptime_stream(stream: DataFrame, key: str, order: str, connected: str, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Closed spans (key, span_ms, ended_us) as the watermark passes their ends; their sums are the uptime.

    A span runs from the last connect before a disconnect. The state of a key is its events that the watermark has not
    passed and, while it is connected, the time of the connect; nothing is kept of a key that is not.
    """
    def step(name, events, kept, now):
        since, out = kept[0] if kept else None, []
        for us, _, up in events:
            if up:
                since = us
            elif since is not None:
                out.append((name[0], us // 1000 - since // 1000, us))
                since = None
        return out, None if since is None else (int(since),), None

    kind = stream.schema[key].dataType.simpleString()
    return in_order(stream, key, ts, late, [order, connected], "since bigint", f"{key} {kind}, span_ms bigint, ended_us bigint", step)


def recent_checks_stream(
    stream: DataFrame, model: str, ts: str = "ts", value: str = "value", kept: int = 100, late: str = "10 minutes", idle: str = "90 days",
) -> DataFrame:
    """Per model the count and mean of its last ``kept`` checks by event time.

    The state of a model is those checks, in whatever order they arrive; it goes when the watermark is ``idle`` past the latest of them.
    """
    rest = int(pd.Timedelta(idle).total_seconds() * 1000)
    rows = stream.withWatermark(ts, late).select(F.col(model), F.col(ts), F.unix_micros(ts).alias("us"), F.col(value).cast("double").alias("v"))
    kind = {f.name: f.dataType for f in stream.schema.fields}[model]
    out = T.StructType([T.StructField(model, kind), T.StructField("checks", T.LongType()), T.StructField("mean", T.DoubleType())])

    def step(name, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        times, values = (list(state.get[0]), list(state.get[1])) if state.exists else ([], [])
        for b in batches:
            times, values = times + b["us"].tolist(), values + b["v"].tolist()
            keep = sorted(range(len(times)), key=times.__getitem__)[-kept:]
            times, values = [times[i] for i in keep], [values[i] for i in keep]
        state.update(([int(t) for t in times], [float(v) for v in values]))
        state.setTimeoutTimestamp(max(max(times) // 1000 + rest, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({model: [name[0]], "checks": [len(values)], "mean": [sum(values) / len(values)]})

    return rows.groupBy(model).applyInPandasWithState(step, out, "times array<bigint>, vals array<double>", "update", "EventTimeTimeout")
