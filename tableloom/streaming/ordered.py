"""Stateful streams in event time: the rows of a key are decided in time order, whatever order they arrive in, and idle state goes."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import islice
from operator import itemgetter

from pyspark.sql import DataFrame, Row, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Keys are dealt by hash to so many buckets, each with one entry of state: calls to the state store are made per bucket, not per key.
BUCKETS = 4096
#: Rows in one element of the state of a bucket.
BLOCK = 4096


class InOrder(StatefulProcessor):
    """Keeps the rows of a bucket of keys as list state until the watermark has passed them, then hands them on in order, key by key.

    ``step((key,), rows, kept, now)`` gets the rows of a key that can have no earlier companion any more, ascending by time and
    order, and the value kept for the key (None at first). It returns (result rows, new value or None, microsecond at
    which an idle key is looked at again or None). It is called with no rows at that time; a value of None is removed. So
    state is rows not yet passed by the watermark and what ``step`` keeps.

    An element of state holds the columns of up to ``BLOCK`` rows as arrays: of the waiting rows (key, us, ...), and of the kept
    values (key, again, ...).
    """

    def __init__(self, waiting: T.StructType, kept: T.StructType, output: Sequence[str], step: Callable, places: Sequence[int]):
        self.waiting_schema, self.kept_schema, self.output, self.step, self.places = waiting, kept, list(output), step, list(places)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.waiting_schema)
        self.kept = handle.getListState("kept", self.kept_schema)
        self.decided: tuple[int, set] = (-1, set())

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        read, first = itemgetter(*self.places), []
        rows = iter(rows)
        while block := [read(r) for r in islice(rows, BLOCK)]:
            self.waiting.appendValue(_columns(block))
            first.append(min(r[1] for r in block))
        if first:
            self.handle.registerTimer(min(first) // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        if self.decided[0] != now:
            self.decided = now, set()
        if key[0] in self.decided[1]:  # by an earlier timer of this bucket
            return
        self.decided[1].add(key[0])
        ready: dict = {}
        rest = []
        for row in _rows(self.waiting):
            if row[1] < now:
                ready.setdefault(row[0], []).append(row[1:])
            else:
                rest.append(row)
        held = {row[0]: row[1:] for row in _rows(self.kept)}
        due = [k for k, (again, *_) in held.items() if again is not None and again < now and k not in ready]
        shape = Row(*self.output)
        for k in [*ready, *due]:
            events = sorted(ready.get(k, ()), key=lambda e: (e[0], e[1] is None, e[1]))
            out, value, again = self.step((k,), events, held[k][1:] if k in held else None, now)
            if value is not None:
                held[k] = again, *value
            else:
                held.pop(k, None)
            for row in out:
                yield shape(*row)
        if ready:
            _put(self.waiting, rest)
        if ready or due:
            _put(self.kept, [(k, *value) for k, value in held.items()])
        wake = [row[1] for row in rest] + [again for again, *_ in held.values() if again is not None]
        if wake:
            self.handle.registerTimer(max(min(wake), now) // 1000 + 1)

    def close(self) -> None:
        pass


def _columns(rows: Sequence[tuple]) -> tuple:
    return tuple(map(list, zip(*rows)))


def _rows(state) -> Iterator[tuple]:
    if state.exists():
        for columns in state.get():
            yield from zip(*columns)


def _put(state, rows: list[tuple]) -> None:
    if rows:
        state.put([_columns(rows[k:k + BLOCK]) for k in range(0, len(rows), BLOCK)])
    elif state.exists():
        state.clear()


def in_order(stream: DataFrame, key: str, ts: str, late: str, waiting: Sequence[str], kept: str, output: str, step: Callable) -> DataFrame:
    """``step`` (see ``InOrder``) over the rows of each key; ``waiting`` names the columns it gets after the time in microseconds,
    the first of which breaks ties. Rows more than ``late`` behind the latest are dropped by the watermark; rows without a time, which
    it never passes, are left out."""
    spark: SparkSession = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)  # the one that has list state and timers
    timed = stream.withWatermark(ts, late).where(F.col(ts).isNotNull())
    held = [F.col(key).alias("_key"), F.unix_micros(ts).alias("_us"), *[F.col(c).alias(f"_in_{c}") for c in waiting]]
    rows = timed.select(F.pmod(F.xxhash64(key), F.lit(BUCKETS)).alias("_bucket"), ts, *held)
    names, kinds = rows.schema.names, {f.name: f.dataType for f in rows.schema.fields}
    lists = T.StructType([T.StructField(c, T.ArrayType(kinds[c])) for c in names[2:]])
    values = T.StructType([T.StructField("_key", T.ArrayType(kinds["_key"])), T.StructField("_again", T.ArrayType(T.LongType())),
                           *[T.StructField(f.name, T.ArrayType(f.dataType)) for f in T.StructType.fromDDL(kept).fields]])
    shape = T.StructType.fromDDL(output)
    processor = InOrder(lists, values, shape.names, step, range(2, len(names)))
    return rows.groupBy("_bucket").transformWithState(processor, shape, "append", "eventTime")
