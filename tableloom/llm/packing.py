"""Best-fit packing of documents into training sequences under several capacities."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import arrow_rows, store
from .encoder import encoder

ITEM = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]


@dataclass(frozen=True)
class Capacities:
    """What one sequence can hold: tokens, pieces, and attention cost (the sum of squared piece lengths).

    The last two hold everything that fits by tokens if they are left out.
    """

    tokens: int = 2048
    pieces: int | None = None
    cost: int | None = None

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.pieces or self.tokens, self.cost or self.tokens**2], dtype=np.int64)


def plan_bins(counts: dict[int, int], limits: Capacities, rule: str = "norm", weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3)) -> list[tuple]:
    """Slots (length, first_rank, first_bin, per_bin, offset) for ``counts`` pieces of each length.

    Vector best-fit from the longest piece down. Bins with equal residual capacities stand together as one
    range of bin numbers. Among the ranges that can take the piece under every constraint, the chosen one has the least
    weighted norm of what would be left (``norm``) or the largest weighted dot-product of piece and residual (``dot``); its
    bins are filled with equal pieces as far as they go, and a range that is used in part is split. The work depends on
    the number of different lengths, at most the sequence length, and not on the number of documents.
    """
    limit = limits.vector()
    scale = np.sqrt(np.asarray(weights)) / limit
    residual = np.zeros((0, 3), dtype=np.int64)
    first = np.zeros(0, dtype=np.int64)  # of a range: its first bin
    size = np.zeros(0, dtype=np.int64)
    opened, slots = 0, []

    def most(left: np.ndarray, need: np.ndarray) -> int:
        return int((left // need).min())

    for length in sorted(counts, reverse=True):
        remaining, rank = counts[length], 0
        need = np.array([length, 1, length * length], dtype=np.int64)
        if (need > limit).any():
            raise ValueError(f"a piece of {length} ids is over the capacities {limit.tolist()}")
        added = []
        while remaining:
            fits = np.flatnonzero((residual >= need).all(axis=1))
            if len(fits):
                if rule == "norm":
                    chosen = fits[np.argmin((((residual[fits] - need) * scale) ** 2).sum(axis=1))]
                else:
                    chosen = fits[np.argmax(((residual[fits] * scale) * (need * scale)).sum(axis=1))]
                left, start, bins = residual[chosen].copy(), int(first[chosen]), int(size[chosen])
            else:
                chosen, left, start = None, limit, opened
                bins = -(-remaining // most(limit, need))
                opened += bins
            each = most(left, need)
            offset = int(limit[0] - left[0])
            used = 0
            for per_bin, times in ((each, min(bins, remaining // each)), (remaining % each, 1)):
                if not per_bin or not times or used >= bins or not remaining:
                    continue
                slots.append((length, rank, start + used, per_bin, offset))
                added.append((left - per_bin * need, start + used, times))
                rank, remaining, used = rank + per_bin * times, remaining - per_bin * times, used + times
            if used < bins:
                added.append((left, start + used, bins - used))
            keep = np.ones(len(size), dtype=bool)
            if chosen is not None:
                keep[chosen] = False
            residual, first, size = residual[keep], first[keep], size[keep]
            added = [a for a in added if a[0][0] > 0 and a[0][1] > 0]
            if added:
                residual = np.concatenate([residual, np.array([a[0] for a in added])])
                first, size = np.append(first, [a[1] for a in added]), np.append(size, [a[2] for a in added])
            added = []
    return slots


def cut_pieces(n_ids: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: whole if it fits, else full pieces after a shorter first one."""
    head = n_ids % length if n_ids > length else n_ids
    return ([(0, head)] if head else []) + [(s, length) for s in range(head, n_ids, length)]


def pack(
    docs: DataFrame, tokenizer: str, limits: Capacities = Capacities(), end_id: int = 0, rule: str = "norm",
    weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3), with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]) of every piece of every document.

    A document is its ids and ``end_id`` after them; only those longer than a sequence are cut. Pieces are numbered within
    their task and length while they are encoded. Counts per length, at most as many as a sequence has tokens, go
    through ``plan_bins``; a piece finds its place from its rank among those of its length, so equal lengths,
    however many, need no common task. Null texts are empty (the end id alone); null or repeated identifiers are packed
    like others; an empty table gives an empty result; other columns are ignored.
    """
    length = limits.tokens
    end = np.array([end_id], "<u4").tobytes()
    fields = [("part", pa.int32()), *ITEM, ("number", pa.int64())] + ([("ids", pa.binary())] if with_ids else [])
    schema = "part int, doc_id long, piece int, start long, length long, ids_crc32 long, number long" + (", ids binary" if with_ids else "")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, numbers = TaskContext.get().partitionId(), defaultdict(int)
        rows: list[tuple] = []

        def batch_of() -> pa.RecordBatch:
            columns = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])

        with encoder(tokenizer) as encode:
            for batch in batches:
                for doc_id, ids_of in zip(batch.column(0).to_pylist(), encode.encode_all(batch.column(1))):
                    data = ids_of + end
                    for piece, (start, n) in enumerate(cut_pieces(len(data) // 4, length)):
                        ids = data[4 * start:4 * (start + n)]
                        rows.append((part, doc_id, piece, start, n, zlib.crc32(ids), numbers[n]) + ((ids,) if with_ids else ()))
                        numbers[n] += 1
                    if len(rows) >= 4096:
                        yield batch_of()
                        rows.clear()
        if rows:
            yield batch_of()

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    with arrow_rows(docs.sparkSession, 512):
        items = store(source.mapInArrow(encode, schema))
    counts = items.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = np.array(sorted(plan_bins(histogram, limits, rule, weights)), dtype=np.int64).reshape(-1, 5)
    shared = docs.sparkSession.sparkContext.broadcast(slots)  # a few rows per length
    out = ITEM + [("sequence_id", pa.int64()), ("offset", pa.int64())] + ([("ids", pa.binary())] if with_ids else [])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        keys = table[:, 0] * (1 << 48) + table[:, 1]
        for batch in batches:
            n = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            slot = table[np.searchsorted(keys, n * (1 << 48) + rank, side="right") - 1]
            nth = rank - slot[:, 1]
            places = [pa.array(slot[:, 2] + nth // slot[:, 3]), pa.array(slot[:, 4] + nth % slot[:, 3] * n)]
            columns = [batch.column(c) for c, _ in ITEM] + places + ([batch.column("ids")] if with_ids else [])
            yield pa.RecordBatch.from_arrays(columns, names=[c for c, _ in out])

    ranked = items.join(before, ["length", "part"]).withColumn("rank", F.col("before") + F.col("number"))
    names = [c for c, _ in ITEM] + (["ids"] if with_ids else [])
    return ranked.select(*names, "rank").mapInArrow(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + (", ids binary" if with_ids else "")
    )


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids, pieces) of the packed sequences; needs ``pack(..., with_ids=True)``.

    A group is one sequence, at most as long as its capacity.
    """
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "length", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("p"), F.sum("length").alias("n_tokens")).select(
        "sequence_id", "n_tokens", F.expr("aggregate(p, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids"),
        F.transform("p", lambda x: F.struct(x["doc_id"], x["piece"], x["offset"], x["length"])).alias("pieces"),
    )
