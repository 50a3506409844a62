"""Streams whose rows arrive out of order, in many files and micro-batches, against their batch twins."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tableloom.session import scratch_path
from tableloom.streaming import lifecycles as lc
from tableloom.streaming import rates
from tableloom.streaming.ordered import InOrder, in_order
from tableloom.streaming.runs import replay, run_now

LATE = "10 minutes"
START = pd.Timestamp("2024-03-01")


def rows_of(n=900, seed=4):
    rng = np.random.default_rng(seed)
    at = np.sort(rng.integers(0, 8 * 3_600_000, n)) * 1000 + rng.integers(0, 1000, n)
    return pd.DataFrame({"id": np.arange(n), "u": np.where(rng.random(n) < 0.4, 1, rng.integers(0, 12, n)), "ts": START + pd.to_timedelta(at, unit="us"), "us": at})


def arrive(spark, rows, files=9, seed=1):
    """A stream of small files: rows come up to eight minutes after their time, so neighbours swap places."""
    rng = np.random.default_rng(seed)
    order = np.argsort(rows["us"].to_numpy() + rng.integers(0, 480_000_000, len(rows)))
    folder = scratch_path(spark, "arrivals")
    for k, part in enumerate(np.array_split(order, files)):
        spark.createDataFrame(rows.iloc[part].drop(columns="us")).coalesce(1).write.mode("append").parquet(folder)
    return replay(spark, folder, "*.parquet", files_per_batch=1)


def passed(rows):
    """The microsecond up to which the watermark has come when all rows are there."""
    return rows["us"].max() // 1000 * 1000 - 600_000_000


def test_limiter_decides_in_event_time(spark):
    rows = rows_of()
    out = run_now(rates.sliding_log_stream(arrive(spark, rows), "u", "id", most=3, seconds=900, late=LATE), "limiter").toPandas()
    batch = rates.sliding_log(spark.createDataFrame(rows.drop(columns="us")), "u", "id", most=3, seconds=900).toPandas()
    want = batch[batch["id"].isin(rows[rows["us"] < passed(rows)]["id"])]
    assert dict(zip(out["id"], out["accepted"])) == dict(zip(want["id"], want["accepted"])) and len(out) == len(want)
    assert 0 < out["accepted"].mean() < 1


def test_spans_close_in_event_time(spark):
    rows = rows_of(700, 9)
    rows["up"] = np.random.default_rng(2).random(700) < 0.5
    out = run_now(lc.uptime_stream(arrive(spark, rows), "u", "id", "up", late=LATE), "spans")
    known = rows[rows["us"] < passed(rows)]
    want = lc.uptime(spark.createDataFrame(known.drop(columns="us")), "u", "id", "up").where("spans > 0").toPandas()
    got = out.groupBy("u").agg(F.sum("span_ms").alias("uptime_ms"), F.count(F.lit(1)).alias("spans")).toPandas()
    assert sorted(map(tuple, got[["u", "uptime_ms", "spans"]].to_numpy().tolist())) == sorted(map(tuple, want[["u", "uptime_ms", "spans"]].to_numpy().tolist()))


def job_rows(seed=6):
    rng = np.random.default_rng(seed)
    rows = rows_of(800, seed)
    kind = rng.choice(["started", "completed", "failed", "started", "disconnected"], 800)
    job = [None if k == "disconnected" else f"{u}-{j}" for k, u, j in zip(kind, rows["u"], rng.integers(0, 25, 800))]
    return rows.assign(connection_id=[f"c{u}" for u in rows["u"]], job_id=job, status=kind)


def test_jobs_end_in_event_time(spark):
    rows = job_rows()
    stream = arrive(spark, rows).select("job_id", "connection_id", "status", "ts")
    out = run_now(lc.jobs_stream(stream, late=LATE), "jobs").toPandas()
    known = spark.createDataFrame(rows[rows["us"] < passed(rows)].drop(columns="us"))
    batch = lc.jobs(known.where("status != 'disconnected'"), known.where("status = 'disconnected'")).where("status != 'running'").toPandas()
    assert set(zip(out["job_id"], out["status"], out["duration_ms"])) == set(zip(batch["job_id"], batch["status"], batch["duration_ms"])) and len(out) == len(batch) > 50


def test_idle_state_is_removed(spark):
    """What the step is given shows what was kept: nothing, once the window of a key has passed."""
    rows = pd.DataFrame({"id": range(6), "u": [1, 1, 2, 2, 1, 2], "us": np.array([0, 1, 2, 4000, 8000, 8001]) * 1_000_000})
    rows["ts"] = START + pd.to_timedelta(rows["us"], unit="us")
    seen = scratch_path(spark, "seen")

    def step(name, events, kept, now):
        out = [(name[0], e[1], kept is not None) for e in events]
        last = max([e[0] for e in events], default=kept[0] if kept else 0)
        return out, None if now - last >= 1_000_000_000 else (int(last),), last + 1_000_000_000

    folder = seen
    for part in ([0, 1, 2], [3], [4], [5]):
        spark.createDataFrame(rows.iloc[part].drop(columns="us")).coalesce(1).write.mode("append").parquet(folder)
    stream = replay(spark, folder, "*.parquet", files_per_batch=1)
    out = run_now(in_order(stream, "u", "ts", "1 second", ["id"], "last bigint", "u bigint, id bigint, had_state boolean", step), "idle").toPandas().set_index("id")["had_state"]
    assert not out.loc[0] and not out.loc[3] and set(out.index) >= {0, 1, 2, 3}
    assert 4 not in out.index or not out.loc[4]


@pytest.mark.parametrize("files", [1, 7])
def test_last_checks_by_event_time(spark, files):
    rows = rows_of(500, 3).assign(value=np.random.default_rng(0).random(500))
    out = run_now(lc.recent_checks_stream(arrive(spark, rows, files), "u", kept=10, late=LATE), "checks", "update")
    last = out.groupBy("u").agg(F.max_by(F.struct("checks", "mean"), "_batch").alias("s")).select("u", "s.*").toPandas().set_index("u")
    for u, part in rows.groupby("u"):
        want = part.sort_values("us").tail(10)["value"]
        assert last.loc[u, "checks"] == len(want) and last.loc[u, "mean"] == pytest.approx(want.mean())


class Counted:
    """A state variable, or the handle of a processor, that counts the calls it gets."""

    def __init__(self, calls):
        self.calls, self.elements, self.timers = calls, [], []

    def getListState(self, name, schema):
        return Counted(self.calls)

    getValueState = getListState

    def getCurrentWatermarkInMs(self):
        return 2000

    def exists(self):
        self.calls.append("exists")
        return bool(self.elements)

    def get(self):
        self.calls.append("get")
        return iter(list(self.elements))

    def put(self, elements):
        self.calls.append("put")
        self.elements = list(elements)

    def appendValue(self, element):
        self.calls.append("append")
        self.elements.append(element)

    def clear(self):
        self.calls.append("clear")
        self.elements = []

    def registerTimer(self, at):
        self.calls.append("timer")
        self.timers.append(at)


def test_state_calls_do_not_follow_the_keys():
    """Five hundred keys that share a bucket take as few calls to the state store as one key."""
    def step(name, events, kept, now):
        seen = (kept[0] if kept else 0) + len(events)
        return [(name[0], seen)], (seen,), None

    found = {}
    for keys in (1, 500):
        calls = []
        handle = Counted(calls)
        processor = InOrder(None, None, ["k", "seen"], step, [0, 1, 2])
        processor.init(handle)
        list(processor.handleInputRows((0,), ((k, at * 1_000_000, at) for k in range(keys) for at in (3, 1, 0)), handle))
        out = [tuple(r) for _ in range(2) for r in processor.handleExpiredTimer((0,), handle, None)]
        assert sorted(out) == [(k, 2) for k in range(keys)] and handle.timers == [1, 3001]
        assert sorted(zip(*processor.waiting.elements[0])) == [(k, 3_000_000, 3) for k in range(keys)]
        found[keys] = len(calls)
    assert found[1] == found[500] < 12


def test_rows_without_time_or_key(spark):
    """Rows without a time are never decided and harm no others; rows without a key share the limit of none."""
    rows = [(1, 2**60 + 1, 0), (2, None, 1), (3, 2**60 + 1, 2), (4, 2**60 + 2, 3), (5, None, 4), (6, 7, None), (None, 9, 5), (8, 9, 9000)]
    frame = [(i, u, None if at is None else (START + pd.Timedelta(seconds=at)).to_pydatetime()) for i, u, at in rows]
    folder = scratch_path(spark, "gaps")
    spark.createDataFrame(frame, "id long, u long, ts timestamp").coalesce(1).write.parquet(folder)
    stream = replay(spark, folder, "*.parquet")
    out = run_now(rates.sliding_log_stream(stream, "u", "id", most=1, seconds=900, late=LATE), "gaps").collect()
    assert {(r["id"], r["u"], r["accepted"]) for r in out} == {
        (1, 2**60 + 1, True), (3, 2**60 + 1, False), (4, 2**60 + 2, True), (2, None, True), (5, None, False), (None, 9, True)
    }
