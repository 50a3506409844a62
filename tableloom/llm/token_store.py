"""Token files: a concatenated id array with Elias-Fano encoded document boundaries."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import Publisher, arrow_rows, filesystem, store
from .encoder import encoder

MAGIC = b"TLTOKEN1"
#: magic, documents, documents without identifier, ids, bytes per id, least identifier, bytes of the two coded lists
HEADER = struct.Struct("<8sQQQBxxxxxxxqQQ")
_EF = struct.Struct("<QQB7x")
SAMPLE = 256
#: Numbers that are coded or decoded at once; a multiple of eight.
PIECE = 4096


class EliasFano:
    """A non-decreasing list of n numbers up to u in about 2 + log2(u / n) bits each.

    The low bits stand in one packed array; the high parts are a bit vector in which the i-th one is at
    (high part + i). ``select`` finds it from the position of every 256th one and a short count, so no table of
    64-bit offsets is needed.
    """

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.width, self.low, self.high, self.samples = n, width, low, high, samples

    @classmethod
    def build(cls, values: np.ndarray) -> "EliasFano":
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        width = max(0, (top // n).bit_length() - 1) if n else 0
        places = np.arange(width, dtype=np.uint64)
        low = [np.packbits(((values[k:k + PIECE, None] >> places) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little") for k in range(0, n, PIECE)]
        ones = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        marks = np.zeros(int(ones[-1]) + 1 if n else 0, dtype=np.uint8)
        marks[ones] = 1
        return cls(n, width, np.concatenate([np.zeros(0, np.uint8), *low]), np.packbits(marks, bitorder="little"), ones[::SAMPLE].astype("<u4"))

    def to_bytes(self) -> bytes:
        return _EF.pack(self.n, len(self.high), self.width) + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> "EliasFano":
        n, high, width = _EF.unpack_from(data)
        low = (n * width + 7) // 8
        at = _EF.size
        part = np.frombuffer(data, np.uint8)
        return cls(n, width, part[at:at + low], part[at + low:at + low + high], np.frombuffer(data, "<u4", -(-n // SAMPLE), at + low + high))

    def _low(self, i: int) -> int:
        first = i * self.width
        window = int.from_bytes(self.low[first // 8:(first + self.width + 7) // 8].tobytes(), "little")
        return (window >> (first % 8)) & ((1 << self.width) - 1)

    def _place(self, i: int) -> int:
        """Where the i-th one is."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        while left:  # `left` more ones after position `at`
            at += 1
            byte = int(self.high[at // 8]) >> (at % 8)
            if byte.bit_count() < left:
                left, at = left - byte.bit_count(), at // 8 * 8 + 7
            else:
                left -= byte & 1
        return at

    def select(self, i: int) -> int:
        """The i-th number (from 0)."""
        return ((self._place(i) - i) << self.width) | self._low(i)

    def between(self, first: int, last: int) -> np.ndarray:
        """Numbers [first, last) as unsigned 64-bit integers: the bits from one select to another, and no others, are decoded."""
        last = min(last, self.n)
        if first >= last:
            return np.zeros(0, np.uint64)
        begin, end = self._place(first), self._place(last - 1)
        ones = np.flatnonzero(np.unpackbits(self.high[begin // 8:end // 8 + 1], bitorder="little")) + begin // 8 * 8
        ones = ones[(ones >= begin) & (ones <= end)]
        high = (ones - np.arange(first, last)).astype(np.uint64) << np.uint64(self.width)
        if not self.width:
            return high
        at = first * self.width
        bits = np.unpackbits(self.low[at // 8:(last * self.width + 7) // 8], bitorder="little")[at % 8:at % 8 + (last - first) * self.width]
        return high + bits.reshape(-1, self.width).astype(np.uint64) @ (np.uint64(1) << np.arange(self.width, dtype=np.uint64))

    def values(self) -> np.ndarray:
        """All numbers."""
        return self.between(0, self.n)


def pack_file(doc_ids: list[int | None], ends: np.ndarray, ids: bytes, id_bytes: int) -> list[bytes]:
    """The parts of one file; ``doc_ids`` ascending with nulls first, ``ends`` the ids up to and with each document."""
    known = [d for d in doc_ids if d is not None]
    least = known[0] if known else 0
    names = EliasFano.build(np.array([d - least for d in known], dtype=np.uint64)).to_bytes()
    bounds = EliasFano.build(ends).to_bytes()
    head = HEADER.pack(MAGIC, len(doc_ids), len(doc_ids) - len(known), int(ends[-1]) if len(ends) else 0, id_bytes, least, len(names), len(bounds))
    return [head, names, bounds, ids]


class TokenFile:
    """Reads one file by ranges: the header and both coded lists at once, ids on demand."""

    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        self.source = fs.open_input_file(path)
        magic, self.n_docs, self.n_null, self.n_ids, self.id_bytes, least, names, bounds = HEADER.unpack(self.source.read_at(HEADER.size, 0))
        if magic != MAGIC:
            raise ValueError(f"not a token file: {uri}")
        self.names = EliasFano.from_bytes(self.source.read_at(names, HEADER.size))
        self.least = least
        self.bounds = EliasFano.from_bytes(self.source.read_at(bounds, HEADER.size + names))
        self.body = HEADER.size + names + bounds

    def doc_ids(self, first: int = 0, last: int | None = None) -> list[int | None]:
        """Identifiers of the documents [first, last)."""
        last = self.n_docs if last is None else min(last, self.n_docs)
        nulls = max(0, min(last, self.n_null) - first)
        known = self.names.between(max(0, first - self.n_null), max(0, last - self.n_null))
        return [None] * nulls + [v + self.least for v in known.tolist()]

    def edges(self, first: int, last: int) -> np.ndarray:
        """Places in the file's ids where the documents [first, last) begin, and where the last one ends."""
        ends = self.bounds.between(first, last).astype(np.int64)
        return np.concatenate([[self.bounds.select(first - 1) if first else 0], ends])

    def ids(self, first: int, last: int) -> np.ndarray:
        """Ids [first, last) of the file as unsigned 32-bit integers."""
        data = self.source.read_at((last - first) * self.id_bytes, self.body + first * self.id_bytes)
        return np.frombuffer(data, f"<u{self.id_bytes}").astype("<u4")

    def document(self, i: int) -> np.ndarray:
        """Ids of the i-th document, found by two selects."""
        return self.ids(self.bounds.select(i - 1) if i else 0, self.bounds.select(i))

    def __enter__(self):
        return self

    def __exit__(self, *error):
        self.source.close()


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", file_ids: int = 1 << 23, file_docs: int = 1 << 18,
) -> DataFrame:
    """Token files of ``docs`` in ascending identifier order, and their list (path, base, n_docs, n_ids).

    Range partitions by identifier are sorted and encoded by their tasks; each task writes files of about
    ``file_ids`` ids (2 bytes an id if the vocabulary allows) and ``file_docs`` documents, a document never being cut. ``base`` is the number
    of ids before a file. Null texts are empty and have the end id only; null identifiers come first; equal identifiers are
    ordered by text hash; an empty table writes no file. Other columns are ignored.
    """
    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("tie", F.xxhash64("text"))
    ordered = ordered.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")
    end = np.array([end_id], "<u4").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        publisher, part = Publisher(folder), TaskContext.get().partitionId()
        names, ends, ids, total, number = [], [], [], 0, 0

        def flush():
            nonlocal names, ends, ids, total, number
            name = f"{part:06d}-{number:06d}.tok"
            publisher.publish(name, pack_file(names, np.cumsum(ends), b"".join(ids), id_bytes))
            row = pa.RecordBatch.from_pydict({
                "part": [part], "number": [number], "path": [f"{folder}/{name}"], "n_docs": [len(names)], "n_ids": [total],
            }, schema=pa.schema([("part", pa.int32()), ("number", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))
            names, ends, ids, total, number = [], [], [], 0, number + 1
            return row

        with encoder(tokenizer) as encode:
            id_bytes = 2 if max(encode.vocabulary, end_id + 1) <= 1 << 16 else 4
            for batch in batches:
                for doc_id, ids_of in zip(batch.column(0).to_pylist(), encode.encode_all(batch.column(1))):
                    data = ids_of + end
                    names.append(doc_id)
                    ends.append(len(data) // 4)
                    total += ends[-1]
                    ids.append(np.frombuffer(data, "<u4").astype("<u2").tobytes() if id_bytes == 2 else data)
                    if total >= file_ids or len(names) >= file_docs:
                        yield flush()
            if names:
                yield flush()

    with arrow_rows(docs.sparkSession, 2048):
        files = store(ordered.mapInArrow(write, "part int, number int, path string, n_docs long, n_ids long"))
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("all"))  # one row per writing task
    before = parts.select("part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("before"))
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("number")) - F.col("n_ids")
    return files.join(before, "part").select("path", (F.col("before") + inside).alias("base"), "n_docs", "n_ids")


def read_documents(spark: SparkSession, files: DataFrame, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document, read back from the listed files.

    ``start`` counts the ids of all documents before; ``ids`` are little-endian unsigned 32-bit integers. A task reads one
    file at a time and holds the ids of one document.
    """
    kinds = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    kinds += [("ids", pa.binary())] if with_ids else []

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                with TokenFile(path) as file:
                    for k in range(0, file.n_docs, PIECE):
                        edges = file.edges(k, k + PIECE)
                        texts = [file.ids(int(a), int(b)).tobytes() for a, b in zip(edges[:-1], edges[1:])]
                        columns = [file.doc_ids(k, k + PIECE), edges[:-1] + base, np.diff(edges), [zlib.crc32(t) for t in texts]] + ([texts] if with_ids else [])
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, kinds)], names=[n for n, _ in kinds])

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")
    tasks = max(1, min(files.count(), 50_000))  # a file or a few each; the list itself is small enough to be merged into one task
    return files.repartition(tasks, "path").mapInArrow(read, schema)
