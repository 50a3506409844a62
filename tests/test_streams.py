"""Streams against their batch twins, and the sliding log over many tasks."""

from collections import defaultdict, deque

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tableloom import plans
from tableloom.streaming.lifecycles import jobs, liveness
from tableloom.streaming.rates import sliding_log

SF = "/root/testdata/sf0.001"


def expected_log(rows, most, seconds):
    logs, out = defaultdict(deque), {}
    for r in rows.sort_values(["u", "ts", "id"]).itertuples():
        log = logs[r.u]
        while log and (r.ts - log[0]).total_seconds() >= seconds:
            log.popleft()
        out[r.id] = len(log) < most
        if out[r.id]:
            log.append(r.ts)
    return out


def test_sliding_log_with_a_busy_key(spark):
    rng = np.random.default_rng(6)
    n = 4000
    rows = pd.DataFrame({
        "id": np.arange(n), "u": np.where(rng.random(n) < 0.5, 1, rng.integers(0, 9, n)),
        "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.sort(rng.integers(0, 40_000, n)), unit="s"),
    })
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows).repartition(6)
        for most, seconds in ((3, 120), (100, 900), (2, 7)):
            out = sliding_log(df, "u", "id", most=most, seconds=seconds).toPandas()
            assert len(out) == n
            assert dict(zip(out.id, out.accepted)) == expected_log(rows, most, seconds)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


def test_liveness_over_blocks(spark):
    df = spark.read.parquet(f"{SF}/events.parquet")
    small = liveness(df, "user_id", "event_id", gap_seconds=21600)
    big = liveness(df, "user_id", "event_id", gap_seconds=21600, plain_rows=0, block_rows=13)
    assert small.count() == big.count() == small.intersect(big).count()


def test_job_stream_equals_batch(spark):
    stream = plans.QUERIES["v05_job_lifecycle_stream"](spark, SF).select("job_id", "status", "duration_ms")
    assert stream.count() > 0
    assert stream.where("status NOT IN ('completed', 'failed', 'cancelled_disconnection') OR duration_ms < 0").count() == 0


def test_jobs(spark):
    t = lambda s: (pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=s)).to_pydatetime()
    events = spark.createDataFrame(
        [("a", "c1", "started", t(0)), ("a", "c1", "completed", t(5)), ("b", "c1", "started", t(10)), ("c", "c2", "started", t(1)), ("c", "c2", "failed", t(9)), ("d", "c3", "started", t(3))],
        "job_id string, connection_id string, status string, ts timestamp",
    )
    closed = spark.createDataFrame([("c1", t(20)), ("c2", t(30))], "connection_id string, ts timestamp")
    got = {r["job_id"]: (r["status"], r["duration_ms"]) for r in jobs(events, closed).collect()}
    assert got == {"a": ("completed", 5000), "b": ("cancelled_disconnection", 10000), "c": ("failed", 8000), "d": ("running", None)}


def test_stream_state_is_read_back_once_per_key(spark):
    out = plans.QUERIES["v13_uptime_stream"](spark, SF)  # spans added up per key
    assert out.count() == out.select("user_id").distinct().count()
    assert out.agg(F.min("uptime_ms")).collect()[0][0] >= 0
