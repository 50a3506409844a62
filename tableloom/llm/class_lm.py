"""Scores of documents under a class-based bigram model whose word classes are found by exchange clustering."""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import LOWER_BYTES, Publisher, filesystem, forget, remove, shared_folder, store

#: Words up to this length name themselves; longer ones go by a space and their SHA-256.
LONGEST = 32
#: Tokens of one record batch of a block's file.
BATCH_TOKENS = 1 << 20
UNKNOWN = 255
_DOCS = pa.schema([("doc_id", pa.int64()), ("train", pa.bool_()), ("ids", pa.large_list(pa.int32()))])


# Blocks: the tokens of some documents as numbers of a dictionary of their own ------------------------------------------------


class _Numbers(dict):
    """The next free number for each new word."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def _key(word: bytes) -> bytes:
    return word if len(word) <= LONGEST else b" " + hashlib.sha256(word).digest()


def _write(publisher: Publisher, name: str, schema: pa.Schema, batches: list[pa.RecordBatch]) -> None:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        for batch in batches:
            out.write_batch(batch)
    publisher.publish(name, [sink.getvalue()])


def _read(folder: str, name: str) -> Iterator[pa.RecordBatch]:
    fs, path = filesystem(folder)
    with fs.open_input_stream(f"{path}/{name}", compression=None) as source, pa.ipc.open_stream(source) as stream:
        yield from stream


class _Block:
    """Documents gathered for one block, and the numbers of their words."""

    def __init__(self):
        self.words, self.batches, self.rows, self.tokens, self.bytes = _Numbers(), [], [], 0, 0
        self.n_docs = self.n_train = self.n_tokens = 0

    def add(self, doc_id: int | None, train: bool, text: bytes) -> None:
        words = text.translate(LOWER_BYTES).split()
        self.rows.append((doc_id, train, np.fromiter(map(self.words.__getitem__, words), np.int32, len(words))))
        self.tokens += len(words)
        self.bytes += len(text) + 16
        if self.tokens >= BATCH_TOKENS:
            self._close()

    def _close(self) -> None:
        if self.rows:
            ids, trains, numbers = zip(*self.rows)
            ends = np.cumsum([0, *map(len, numbers)])
            lists = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(np.concatenate(numbers), pa.int32()))
            self.batches.append(pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(trains, pa.bool_()), lists], schema=_DOCS))
            self.n_docs, self.n_train, self.n_tokens = self.n_docs + len(ids), self.n_train + sum(trains), self.n_tokens + int(ends[-1])
            self.rows, self.tokens = [], 0

    def publish(self, publisher: Publisher, name: str) -> None:
        self._close()
        counts = np.zeros(len(self.words), np.int64)
        for batch in self.batches:
            ids, lengths, train = _tokens(batch)
            counts += np.bincount(ids[np.repeat(train, lengths)], minlength=len(counts))
        _write(publisher, f"{name}.docs", _DOCS, self.batches)
        words = pa.RecordBatch.from_arrays([pa.array(list(map(_key, self.words)), pa.binary()), pa.array(counts)], names=["word", "n"])
        _write(publisher, f"{name}.words", words.schema, [words])


def _tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(numbers of all words, words of each document, whether it is for training)."""
    lists = batch.column(2)
    return lists.values.to_numpy(), np.diff(lists.offsets.to_numpy()), batch.column(1).to_numpy(zero_copy_only=False)


def _write_blocks(docs: DataFrame, folder: str, block_bytes: int) -> DataFrame:
    """(block, name, n_docs, n_train, n_tokens): the files of (doc_id, train, text), some ``block_bytes`` of text each.

    A file's name belongs to one attempt of a task and is listed with it, so a repeated task does no harm.
    """
    kinds = [("block", pa.int64()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_train", pa.int64()), ("n_tokens", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        publisher, part, number, block = Publisher(folder), TaskContext.get().partitionId(), 0, _Block()

        def flush() -> pa.RecordBatch:
            name = f"{part}-{number}-{os.urandom(4).hex()}"
            block.publish(publisher, name)
            row = (part << 24) + number, name, block.n_docs, block.n_train, block.n_tokens
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, (_, t) in zip(row, kinds)], names=[k for k, _ in kinds])

        for batch in batches:
            for doc_id, train, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                block.add(doc_id, train, text.as_py() or b"")
                if block.bytes >= block_bytes:
                    yield flush()
                    number, block = number + 1, _Block()
        if block.rows or block.batches:
            yield flush()

    return store(docs.mapInArrow(run, "block long, name string, n_docs long, n_train long, n_tokens long"))


def _by_block(blocks: DataFrame, tasks: int, run: Callable, schema: str) -> DataFrame:
    """``run`` over iterators of (block, name), dealt evenly."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run((b, n) for batch in batches for b, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))

    return blocks.select("block", "name").repartitionByRange(tasks, "block").mapInArrow(each, schema)


def _added(spark: SparkSession, parts: DataFrame, shape: tuple[int, ...], slices: int) -> np.ndarray:
    """The sum of the arrays of all tasks, given in ``slices`` rows (slice, part, counts), added up in two steps."""
    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zlib.decompress(c), np.int64) for c in pdf["counts"])
        return pd.DataFrame({"slice": [pdf["slice"].iloc[0]], "part": [pdf["part"].iloc[0] // 64], "counts": [zlib.compress(total.tobytes(), 1)]})

    schema = "slice int, part int, counts binary"
    some = parts.groupBy("slice", F.expr("part div 64").alias("p")).applyInPandas(add, schema)
    total = np.zeros((slices, int(np.prod(shape)) // slices), np.int64)
    for row in some.groupBy("slice").applyInPandas(add, schema).collect():
        total[row["slice"]] = np.frombuffer(zlib.decompress(row["counts"]), np.int64)
    return total.reshape(shape)


def _slices(total: np.ndarray, slices: int) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    for k, some in enumerate(np.split(total.ravel(), slices)):
        if some.any():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part], pa.int32()), pa.array([zlib.compress(some.tobytes(), 1)], pa.binary())], names=["slice", "part", "counts"])


def _line(of_word: np.ndarray, ids: np.ndarray, lengths: np.ndarray, end: int) -> np.ndarray:
    """What ``of_word`` says of each word of the documents, ``end`` after each document. The token before a document is an end too."""
    return np.insert(of_word[ids], np.cumsum(lengths), end)


def _shifted(line: np.ndarray, end: int) -> np.ndarray:
    return np.concatenate([[end], line[:-1]]).astype(line.dtype)


# Exchange clustering ----------------------------------------------------------------------------------------------------


@dataclass
class _Classes:
    """Classes 0 to k - 1 of the ``frequent`` words; as contexts k is the end and k + 1 a word without a class."""

    k: int
    frequent: dict[bytes, int]
    classes: np.ndarray

    @property
    def contexts(self) -> int:
        return self.k + 2

    def numbers(self, folder: str, name: str) -> np.ndarray:
        """The place among the frequent words of each word of a block, or their number for another."""
        other = len(self.frequent)
        words = [w for batch in _read(folder, f"{name}.words") for w in batch.column(0).to_pylist()]
        return np.fromiter((self.frequent.get(w, other) for w in words), np.int32, len(words))

    def of(self, numbers: np.ndarray) -> np.ndarray:
        return np.append(self.classes, self.k + 1).astype(np.int16)[numbers]


def _write_lines(blocks: DataFrame, tasks: int, folder: str, found: _Classes) -> None:
    """A file per block with the places of the training documents' tokens among the frequent words: m for other words, m + 1 for ends."""
    shared = blocks.sparkSession.sparkContext.broadcast(found)

    def run(names: Iterator[tuple[int, str]]) -> Iterator[pa.RecordBatch]:
        publisher, model = Publisher(folder), shared.value
        m = len(model.frequent)
        schema = pa.schema([("line", pa.uint16() if m + 1 < 1 << 16 else pa.int32())])
        for _, name in names:
            numbers, batches = model.numbers(folder, name), []
            for batch in _read(folder, f"{name}.docs"):
                ids, lengths, train = _tokens(batch)
                line = _line(numbers, ids, lengths, m + 1)[np.repeat(train, lengths + 1)]
                batches.append(pa.RecordBatch.from_arrays([pa.array(line, schema.field(0).type)], schema=schema))
            _write(publisher, f"{name}.line", schema, batches)
            yield pa.RecordBatch.from_arrays([pa.array([name])], names=["name"])

    store(_by_block(blocks, tasks, run, "name string"))


def _context_counts(blocks: DataFrame, tasks: int, folder: str, found: _Classes) -> np.ndarray:
    """(frequent word, left and right contexts): how often training documents have a frequent word beside each class."""
    shared = blocks.sparkSession.sparkContext.broadcast(found.classes)
    m, c, k, slices = len(found.frequent), found.contexts, found.k, 64
    rows = -(-m // slices) * slices

    def run(names: Iterator[tuple[int, str]]) -> Iterator[pa.RecordBatch]:
        classes = np.append(shared.value, [k + 1, k]).astype(np.uint8)
        total = np.zeros((2, m * c), np.int64)
        for _, name in names:
            for batch in _read(folder, f"{name}.line"):
                line = batch.column(0).to_numpy()
                near = classes[line]
                use = line < m
                word = line[use].astype(np.int64) * c
                total[0] += np.bincount(word + _shifted(near, k)[use], minlength=m * c)
                total[1] += np.bincount(word + np.append(near[1:], np.uint8(k))[use], minlength=m * c)
        both = np.zeros((rows, 2 * c), np.int64)
        both[:m, :c], both[:m, c:] = total[0].reshape(m, c), total[1].reshape(m, c)
        yield from _slices(both, slices)

    parts = _by_block(blocks, tasks, run, "slice int, part int, counts binary")
    return _added(blocks.sparkSession, parts, (rows, 2 * c), slices)[:m]


def _t_log_t(t: np.ndarray) -> np.ndarray:
    return t * np.log(np.maximum(t, 1))


def exchange(counts: np.ndarray, classes: np.ndarray, k: int, step: int = 64) -> np.ndarray:
    """Classes after every word has been moved once to where the bigram likelihood of classes gains most.

    ``counts`` has a row per word, the frequencies of its left and right contexts. Words leave their classes, some
    ``step`` at a time, and enter the best ones as they then are.
    """
    classes, counts = classes.copy(), counts.astype(np.float32)
    held, n = np.zeros((k, counts.shape[1]), np.float32), counts.sum(axis=1) / 2
    np.add.at(held, classes, counts)
    size = np.bincount(classes, weights=n, minlength=k).astype(np.float32)
    for a in range(0, len(counts), step):
        rows = slice(a, a + step)
        np.subtract.at(held, classes[rows], counts[rows])
        np.subtract.at(size, classes[rows], n[rows])
        gain = np.zeros((len(classes[rows]), k), np.float32)
        for x in range(0, len(gain), 16):  # a small array at a time stays in the cache
            part = slice(a + x, min(a + x + 16, a + step))
            seen = counts[part].any(axis=0)
            own, there = counts[part][:, seen], held[:, seen]
            gain[x:x + 16] = (_t_log_t(there[None] + own[:, None]) - _t_log_t(there)[None]).sum(axis=2)
            gain[x:x + 16] -= 2 * (_t_log_t(size[None] + n[part][:, None]) - _t_log_t(size)[None])
        classes[rows] = gain.argmax(axis=1)
        np.add.at(held, classes[rows], counts[rows])
        np.add.at(size, classes[rows], n[rows])
    return classes


def _rare_words(blocks: DataFrame, tasks: int, folder: str, found: _Classes) -> DataFrame:
    """(word, block, number, n, near) of each block's other words: n in training there, and ``near`` pairs of bytes
    (context, times it was seen; several pairs above 255)."""
    shared = blocks.sparkSession.sparkContext.broadcast(found)
    m, c = len(found.frequent), found.contexts

    def run(names: Iterator[tuple[int, str]]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for block, name in names:
            numbers = model.numbers(folder, name)
            classes, pairs = model.of(numbers), []
            for batch in _read(folder, f"{name}.docs"):
                ids, lengths, train = _tokens(batch)
                word = _line(np.where(numbers == m, np.arange(len(numbers)), -1), ids, lengths, -1)
                near = _line(classes, ids, lengths, model.k)
                use = (word >= 0) & np.repeat(train, lengths + 1)
                word = word[use].astype(np.int64) * (2 * c)
                both = np.concatenate([word + _shifted(near, model.k)[use], word + c + np.append(near[1:], model.k)[use]])
                pairs.append(np.unique(both, return_counts=True))
            keys, times = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (zip(*pairs) if pairs else ((), ())))
            order = np.argsort(keys, kind="stable")
            keys, times = keys[order], times[order]
            repeats = -(-times // 255)
            owner = np.repeat(keys // (2 * c), repeats)
            flat = np.empty((len(owner), 2), np.uint8)
            flat[:, 0], flat[:, 1] = np.repeat(keys % (2 * c), repeats), 255
            flat[np.cumsum(repeats) - 1, 1] = times - 255 * (repeats - 1)
            rare = np.flatnonzero(numbers == m)
            edges = np.searchsorted(owner, np.append(rare, len(numbers)))
            listed = pa.Table.from_batches(_read(folder, f"{name}.words")).combine_chunks()
            for a in range(0, len(rare), 8192):
                some, cut = rare[a:a + 8192], edges[a:a + 8193]
                near = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(((cut - cut[0]) * 2).astype(np.int32)), pa.py_buffer(flat[cut[0]:cut[-1]].tobytes())])
                at = pa.array(some)
                yield pa.RecordBatch.from_arrays(
                    [listed["word"].take(at).combine_chunks(), pa.array(np.full(len(some), block)), pa.array(some.astype(np.int32)), listed["n"].take(at).combine_chunks(), near],
                    names=["word", "block", "number", "n", "near"],
                )

    return _by_block(blocks, tasks, run, "word binary, block long, number int, n long, near binary")


def _assigned(rare: DataFrame, profiles: np.ndarray, k: int) -> DataFrame:
    """(block, number, n, class, first) of each block's rare words: their number in all training documents and the class
    whose contexts make theirs most likely; ``first`` is set in one row of each word. A word never seen in training is ``UNKNOWN``."""
    likely = np.log((profiles + 0.1) / (profiles.sum(axis=1, keepdims=True) / 2 + 0.1 * profiles.shape[1])).T.astype(np.float32)
    shared = rare.sparkSession.sparkContext.broadcast(np.ascontiguousarray(likely))

    def judge(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        words, near = rows["word"].chunk(0), rows["near"].chunk(0)
        runs = np.concatenate([[0], pc.run_end_encode(words).run_ends.to_numpy()])
        total = np.add.reduceat(rows["n"].to_numpy(), runs[:-1])
        ends = np.frombuffer(near.buffers()[1], np.int32, len(near) + 1, near.offset * 4) // 2
        data = near.buffers()[2]
        pairs = np.frombuffer(data, np.uint8, 2 * int(ends[-1])).reshape(-1, 2) if data and ends[-1] else np.zeros((0, 2), np.uint8)
        edges, best = ends[runs], np.full(len(total), UNKNOWN, np.uint8)
        seen = np.flatnonzero(np.diff(edges))
        for a in range(0, len(seen), 4096):
            some = seen[a:a + 4096]
            lo, hi = edges[some[0]], edges[some[-1] + 1]
            score = shared.value[pairs[lo:hi, 0]] * pairs[lo:hi, 1:].astype(np.float32)
            best[some] = np.add.reduceat(score, edges[some] - lo, axis=0).argmax(axis=1)
        lengths = np.diff(runs)
        first = np.zeros(len(words), np.int32)
        first[runs[:-1]] = 1
        return pa.RecordBatch.from_arrays(
            [rows["block"].chunk(0), rows["number"].chunk(0), pa.array(np.repeat(total, lengths)), pa.array(np.repeat(best, lengths).astype(np.int32)), pa.array(first)],
            names=["block", "number", "n", "class", "first"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])]).combine_chunks()
            last = int(pc.index(rows["word"], rows["word"][-1]).as_py())  # this word may go on in the next batch
            if last:
                yield judge(rows.slice(0, last))
            rest = rows.slice(last)
        if rest is not None:
            yield judge(rest)

    return rare.repartition("word").sortWithinPartitions("word").mapInArrow(run, "block long, number int, n long, class int, first int")


# The model -----------------------------------------------------------------------------------------------------------------


def _write_dictionaries(assigned: DataFrame, blocks: DataFrame, tasks: int, folder: str, found: _Classes, counts: np.ndarray) -> DataFrame:
    """A file per block with (n, class) of each of its words; (name, types) with the block's first rows of words by class and count."""
    shared = blocks.sparkSession.sparkContext.broadcast((found, counts))
    marks = blocks.select("block", F.lit(-1).alias("number"), F.lit(0).cast("long").alias("n"), F.lit(0).alias("class"), F.lit(0).alias("first"), "name")
    rows = assigned.withColumn("name", F.lit(None).cast("string")).unionByName(marks)
    k = found.k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, n_of = shared.value
        publisher, name, held = Publisher(folder), None, []

        def flush() -> pa.RecordBatch:
            numbers = model.numbers(folder, name)
            n, classes = np.append(n_of, 0)[numbers], model.of(numbers).astype(np.uint8)
            types = np.zeros((k, 3), np.int64)  # all, seen once, seen twice
            for number, total, best, first in held:
                n[number], classes[number] = total, best
                own = (first == 1) & (total > 0)
                for j, which in enumerate((own, own & (total == 1), own & (total == 2))):
                    types[:, j] += np.bincount(best[which], minlength=k)[:k]
            held.clear()
            words = pa.RecordBatch.from_arrays([pa.array(n), pa.array(classes)], names=["n", "class"])
            _write(publisher, f"{name}.dict", words.schema, [words])
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([types.ravel().tolist()], pa.list_(pa.int64()))], names=["name", "types"])

        for batch in batches:
            block = batch.column(0).to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [len(block)]])
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                part = batch.slice(a, b - a)
                if a < b and part.column(1)[0].as_py() == -1:  # the mark comes first in its block
                    if name is not None:
                        yield flush()
                    name, part = part.column(5)[0].as_py(), part.slice(1)
                if part.num_rows:
                    held.append([part.column(j).to_numpy() for j in (1, 2, 3, 4)])
        if name is not None:
            yield flush()

    ordered = rows.select("block", "number", "n", "class", "first", "name").repartition(tasks, "block").sortWithinPartitions("block", "number")
    return store(ordered.mapInArrow(run, "name string, types array<long>"))


def _transitions(blocks: DataFrame, tasks: int, folder: str, k: int) -> np.ndarray:
    """(context, class) in training documents; context k is the end, k + 1 a word that is seen once in training: it stands for unknown ones."""
    def run(names: Iterator[tuple[int, str]]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 2, k + 1), np.int64)
        for _, name in names:
            [words] = _read(folder, f"{name}.dict")
            n, classes = words.column(0).to_numpy(), words.column(1).to_numpy().astype(np.int64)
            for batch in _read(folder, f"{name}.docs"):
                ids, lengths, train = _tokens(batch)
                use = np.repeat(train, lengths + 1)
                line, once = _line(classes, ids, lengths, k), _shifted(_line(n == 1, ids, lengths, False), False)[use]
                before, line = _shifted(line, k)[use], line[use]
                total[: k + 1] += np.bincount(before * (k + 1) + line, minlength=(k + 1) ** 2).reshape(k + 1, k + 1)
                total[k + 1] += np.bincount(line[once], minlength=k + 1)
        yield from _slices(total, 1)

    parts = _by_block(blocks, tasks, run, "slice int, part int, counts binary")
    return _added(blocks.sparkSession, parts, (k + 2, k + 1), 1)


@dataclass
class ClassModel:
    """Class bigrams and word emissions.

    ``move[context, class]`` and ``unknown[context]`` are log10 probabilities of the next class and of a word not in training; a word seen n times
    has log10((n - discount) / size[class]) in its class, and the end is the only member of class k.
    """

    k: int
    discount: float
    size: np.ndarray
    move: np.ndarray
    unknown: np.ndarray
    tokens: int
    types: int
    ends: int


def fit_model(transitions: np.ndarray, types: np.ndarray, strength: float = 5.0) -> ClassModel:
    """The smoothed model of counts: moves lean on the classes' shares with ``strength`` counts, and the absolute discount of emissions
    is what words seen once and twice suggest. ``types`` has per class the words in all, seen once, seen twice."""
    k = transitions.shape[1] - 1
    size = transitions[: k + 1].sum(axis=0).astype(float)
    share = (size + 0.5) / (size.sum() + 0.5 * (k + 1))
    move = (transitions + strength * share) / (transitions.sum(axis=1, keepdims=True) + strength)
    once, twice = types[:, 1].sum(), types[:, 2].sum()
    discount = float(np.clip(once / (once + 2 * twice), 0.1, 0.9)) if once + twice else 0.5
    free = np.where(size[:k] > 0, discount * types[:, 0] / np.maximum(size[:k], 1), 1.0)
    unknown = move[:, :k] @ free
    return ClassModel(k, discount, size, np.log10(move), np.log10(np.maximum(unknown, 1e-12)), int(size.sum()), int(types[:, 0].sum()) + int(size[k] > 0), int(size[k]))


def _scores(blocks: DataFrame, tasks: int, folder: str, model: ClassModel) -> DataFrame:
    shared = blocks.sparkSession.sparkContext.broadcast(model)
    names_of = ["doc_id", "train", "n_tokens", "n_known", "base_score", "score"]

    def run(names: Iterator[tuple[int, str]]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        rest = m.tokens + 0.5 * (m.types + 1)
        for _, name in names:
            [words] = _read(folder, f"{name}.dict")
            n, classes = words.column(0).to_numpy(), words.column(1).to_numpy().astype(np.int64)
            known = n > 0
            emitted = np.where(known, np.log10(np.maximum(n - m.discount, 1e-12) / np.maximum(m.size[np.where(known, classes, 0)], 1)), 0.0)
            classes = np.where(known, classes, m.k + 1)
            base = np.log10((n + 0.5) / rest)
            for batch in _read(folder, f"{name}.docs"):
                ids, lengths, _ = _tokens(batch)
                line = _line(classes, ids, lengths, m.k)
                before, new = _shifted(line, m.k), line == m.k + 1
                score = np.where(new, m.unknown[before], m.move[before, np.where(new, 0, line)] + _line(emitted, ids, lengths, 0.0))
                starts = np.cumsum(lengths + 1) - (lengths + 1)
                found = _line(known, ids, lengths, m.ends > 0).astype(np.int64)
                bases = _line(base, ids, lengths, np.log10((m.ends + 0.5) / rest))
                sums = [np.add.reduceat(x, starts) if len(starts) else x for x in (found, bases, score)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(lengths + 1), pa.array(sums[0]), pa.array(sums[1]), pa.array(sums[2])], names=names_of
                )

    scored = _by_block(blocks, tasks, run, "doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.withColumns({"train_tokens": F.lit(model.tokens).cast("long"), "perplexity": F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))})


def score_documents(
    docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", classes: int = 64, clustered: int = 1 << 14, rounds: int = 6,
    block_bytes: int = 24 << 20,
) -> DataFrame:
    """(doc_id, train, n_tokens, n_known, train_tokens, base_score, score, perplexity) of every document under a model of those for which ``train`` holds.

    Tokens are the words of the whole text (split at ASCII white space, A-Z lower-cased) and one end. ``base_score`` is the
    add-half unigram score, ``score`` the log10 probability under the class model: p(class | class before) p(word | class).

    1. Texts become blocks of word numbers with a dictionary each, in files of the shared folder; later passes read those.
    2. Exchange clustering: all training documents are counted in every round; the most frequent words, ``clustered`` at most, move to
       the class in which the bigram likelihood gains most. Then every other word, however rare, moves once, to the class that
       makes its own contexts most likely; those contexts are shuffled by word in compressed form.
    3. Class transitions and word emissions come from all training documents, with the final classes of all words. Unknown
       words get what the discount leaves; after one, the model goes on as after words that are seen once.

    The driver holds ``clustered`` words and their contexts by class, and the transitions; the vocabulary stays on the executors: a task
    gets the counts of the words of one block. A null text is empty and has the end alone; a null identifier is kept as it
    is; a document for which ``train`` is null is not learnt from; repeated rows count each time; without a training
    document every word is unknown; an empty table gives an empty result; other columns are ignored.
    """
    if not 1 <= classes <= 120:
        raise ValueError("1 to 120 classes")
    spark = docs.sparkSession
    folder = shared_folder(spark, "class-lm")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(train, F.lit(False)).alias("train"), F.col(text_col).cast("string").cast("binary").alias("text"))
    blocks = _write_blocks(texts, folder, block_bytes)
    n_blocks = blocks.count()
    tasks = max(1, min(n_blocks, 16 * spark.sparkContext.defaultParallelism))

    def listed(names: Iterator[tuple[int, str]]) -> Iterator[pa.RecordBatch]:
        for _, name in names:
            for batch in _read(folder, f"{name}.words"):
                for a in range(0, batch.num_rows, 8192):
                    yield batch.slice(a, 8192).filter(pc.greater(batch.column(1).slice(a, 8192), 0))

    _by_block(blocks, tasks, listed, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).write.parquet(f"{folder}/words")
    words = spark.read.parquet(f"{folder}/words")
    # the most frequent words as far as whole grades of frequency, sixteen to an octave, go into ``clustered``
    grade = F.floor(16 * F.log2("n"))
    left, least = clustered, 0
    for r in words.groupBy(grade.alias("grade")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("grade")).collect():  # a thousand at most
        if r["words"] > left:
            least = r["grade"] + 1
            break
        left -= r["words"]
    top = words.where(grade >= least).orderBy(F.desc("n"), "word").collect()
    forget(spark)
    found = _Classes(classes, {bytes(r["word"]): i for i, r in enumerate(top)}, np.arange(len(top)) % classes)
    counts = np.array([r["n"] for r in top], np.int64)
    near = np.zeros((len(top), 2 * found.contexts), np.int64)
    if top:
        _write_lines(blocks, tasks, folder, found)
    for _ in range(rounds if top else 0):
        near = _context_counts(blocks, tasks, folder, found)
        found.classes = exchange(near, found.classes, classes)
    near = _context_counts(blocks, tasks, folder, found) if top else near
    profiles = np.zeros((classes, 2 * found.contexts))
    np.add.at(profiles, found.classes, near)
    forget(spark)

    assigned = _assigned(_rare_words(blocks, tasks, folder, found), profiles, classes)
    types = _write_dictionaries(assigned, blocks, tasks, folder, found, counts)
    kinds = np.zeros((classes, 3), np.int64)
    summed = types.select(F.posexplode("types").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n")).collect()  # 3 * classes rows
    kinds.ravel()[[r["at"] for r in summed]] = [r["n"] for r in summed]
    for j, which in enumerate((counts > 0, counts == 1, counts == 2)):
        kinds[:, j] += np.bincount(found.classes[which], minlength=classes)
    forget(spark)

    model = fit_model(_transitions(blocks, tasks, folder, classes), kinds)
    scored = store(_scores(blocks, tasks, folder, model))
    remove(spark, folder)
    return scored.select("doc_id", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
