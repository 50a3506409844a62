"""Request rates: fixed and hopping windows, and the sliding-log limiter."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from ..session import cut_lineage
from .ordered import in_order

# Fixed values: (window, allowed requests) per limiter, and the per-user sliding log.
LIMITS = {
    "general": ("15 minutes", 100), "ml": ("5 minutes", 30), "auth": ("15 minutes", 5), "upload": ("1 minute", 5),
}
USER_REQUESTS, USER_WINDOW_SECONDS = 100, 900


def fixed_window_counts(df: DataFrame, key: str, ts: str = "ts", window: str = "15 minutes", most: int = 100, late: str | None = None) -> DataFrame:
    """Requests per key and tumbling window, with an over-limit flag; batch or stream."""
    rows = df.withWatermark(ts, late) if late else df
    out = rows.groupBy(F.window(ts, window).alias("w"), key).agg(F.count(F.lit(1)).alias("requests"))
    return out.select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), key, "requests", (F.col("requests") > most).alias("over_limit")
    )


def hopping_counts(df: DataFrame, key: str, ts: str = "ts", window: str = "15 minutes", step: str = "5 minutes", late: str | None = None) -> DataFrame:
    """Requests per key in overlapping windows."""
    rows = df.withWatermark(ts, late) if late else df
    out = rows.groupBy(F.window(ts, window, step).alias("w"), key).agg(F.count(F.lit(1)).alias("requests"))
    return out.select(F.col("w.start").alias("window_start"), key, "requests")


def _admit(times: Sequence[int], log: deque, most: int, window: int) -> list[bool]:
    """Decide requests in order; rejected ones do not enter the log."""
    out = []
    for at in times:
        while log and at - log[0] >= window:
            log.popleft()
        ok = len(log) < most
        if ok:
            log.append(at)
        out.append(ok)
    return out


def sliding_log(df: DataFrame, key: str, order: str, ts: str = "ts", most: int = USER_REQUESTS, seconds: int = USER_WINDOW_SECONDS) -> DataFrame:
    """Batch form: every request with ``accepted``, decided in time order per key.

    Rows are range-partitioned by (key, time), so a busy key spans many tasks. Each task
    first reports the log it ends with; a task whose key began in an earlier one is decided
    again from that log, until all logs agree. Logs hold at most ``most`` times.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    sorted_rows = df.withColumn("_us", micros).repartitionByRange(key, "_us", order).sortWithinPartitions(key, "_us", order)
    rows = cut_lineage(sorted_rows.withColumn("_part", F.spark_partition_id()))
    width = seconds * 1_000_000
    slim = rows.select("_part", key, "_us")
    key_type = df.schema[key].dataType.simpleString()

    def walk(batches: Iterator[pd.DataFrame], carry: dict) -> Iterator[pd.DataFrame]:
        part = first = current = log = None
        for b in batches:
            for k, group in b.groupby(key, sort=False):
                if part is None:
                    part, first = int(group["_part"].iloc[0]), k
                    held = carry.get(part)
                    current, log = k, deque(held[1] if held and held[0] == k else ())
                elif k != current:
                    current, log = k, deque()
                _admit(group["_us"].tolist(), log, most, width)
        if part is not None:
            yield pd.DataFrame({"part": [part], "first": [first], "last": [current], "log": [list(log)]})

    schema = f"part int, first {key_type}, last {key_type}, log array<bigint>"
    carry: dict[int, tuple] = {}
    ends: dict[int, tuple] = {}
    todo = None
    while todo is None or todo:
        some = slim if todo is None else slim.where(F.col("_part").isin(todo))
        for r in some.mapInPandas(partial(walk, carry=dict(carry)), schema).collect():  # one row per task
            ends[r["part"]] = (r["first"], r["last"], list(r["log"]))
        wanted: dict[int, tuple] = {}
        before = None
        for part in sorted(ends):
            if before is not None and ends[before][1] == ends[part][0]:
                wanted[part] = (ends[before][1], ends[before][2])
            before = part
        todo = [p for p in ends if wanted.get(p) != carry.get(p)]
        carry = wanted

    final = dict(carry)

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        started, current, log = False, None, None
        for b in batches:
            marks = []
            for k, group in b.groupby(key, sort=False):
                if not started:
                    held = final.get(int(group["_part"].iloc[0]))
                    started, current, log = True, k, deque(held[1] if held and held[0] == k else ())
                elif k != current:
                    current, log = k, deque()
                marks += _admit(group["_us"].tolist(), log, most, width)
            if marks:
                yield b.assign(accepted=marks)

    out = T.StructType([*rows.schema.fields, T.StructField("accepted", T.BooleanType())])
    return rows.mapInPandas(decide, out).drop("_us", "_part")


def sliding_log_stream(
    stream: DataFrame, key: str, order: str, ts: str = "ts", most: int = USER_REQUESTS, seconds: int = USER_WINDOW_SECONDS, late: str = "10 minutes",
) -> DataFrame:
    """Stream form: (key, order, accepted), decided in event time once the watermark has passed a request.

    The state of a key is its requests that the watermark has not passed and the log of its accepted times, at most
    ``most``; a log is removed when its window has passed. Requests may arrive ``late`` in any order; what comes
    later still is dropped.
    """
    width = seconds * 1_000_000

    def step(name, rows, kept, now):
        log = deque(kept[0] if kept else ())
        marks = _admit([e[0] for e in rows], log, most, width)
        while log and now - log[0] >= width:
            log.popleft()
        out = [(name[0], e[1], ok) for e, ok in zip(rows, marks)]
        return out, ([int(v) for v in log],) if log else None, log[0] + width if log else None

    kinds = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    output = f"{key} {kinds[key]}, {order} {kinds[order]}, accepted boolean"
    return in_order(stream, key, ts, late, [order], "log array<bigint>", output, step)
