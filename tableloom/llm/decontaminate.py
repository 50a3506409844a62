"""Benchmark items found in documents by the q-gram lemma over diagonal bands, and checked by banded alignment."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import release

Q = 8
#: Bytes of a document looked at together; parts overlap by more than the longest item of a block.
PART = 1 << 20
#: Bytes of item text in one block: what goes to every task at once.
BLOCK = 4 << 20
#: Meetings of q-grams that are held at once.
HITS = 1 << 18
_TABLE_BITS = 22
_ODD = np.uint64(0x9E3779B97F4A7C15)


def normalised(text: str | None) -> bytes:
    """Lower-cased UTF-8 with every run of white space as one space."""
    return " ".join((text or "").lower().split()).encode("utf-8", "replace")


def grams(data: bytes) -> np.ndarray:
    """The q-gram at every position, as an integer."""
    n = len(data) - Q + 1
    return np.ndarray((n,), "<u8", data, strides=(1,)) if n > 0 else np.zeros(0, "<u8")


def banded_edits(item: bytes, text: bytes, low: int, high: int, most: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best alignment of all of ``item`` with a part of ``text`` within the diagonals low..high, if at most ``most``.

    Rows are the bytes of ``item``; a row holds one cell per diagonal (text position minus item position). Steps to
    the right within a row are resolved by a running minimum.
    """
    width = high - low + 1
    column = np.arange(width)
    t = np.full(len(item) + width + 1, -1, np.int16)
    a, b = max(0, low), min(len(text), low + len(t))
    if b > a:
        t[a - low:b - low] = np.frombuffer(text, np.uint8, b - a, a)
    outside = 1 << 20
    cell = np.where((low + column >= 0) & (low + column <= len(text)), 0, outside)
    begin = low + column
    for i, byte in enumerate(item):
        same = cell + (t[i:i + width] != byte)
        from_above = np.append(cell[1:] + 1, outside)
        take = from_above < same
        best = np.where(take, from_above, same)
        origin = np.where(take, np.append(begin[1:], 0), begin)
        position = low + column + i + 1
        best = np.where((position < 0) | (position > len(text)), outside, best)
        key = (best - column) * (1 << 20) + column  # the least, then the leftmost
        run = np.minimum.accumulate(key)
        source = run & ((1 << 20) - 1)
        cell = np.minimum((run >> 20) + column, outside)
        begin = origin[source]
    k = int(cell.argmin())
    if cell[k] > most:
        return None
    return int(cell[k]), int(begin[k]), int(low + k + len(item))


@dataclass
class ItemIndex:
    """A block of items and the places of their q-grams."""

    ids: list[int | None]
    texts: list[bytes]
    short: list[int]
    budgets: np.ndarray
    needs: np.ndarray
    table: np.ndarray
    keys: np.ndarray
    first: np.ndarray
    item: np.ndarray
    place: np.ndarray
    window: int
    density: int
    reach: int

    @classmethod
    def build(cls, items: list[tuple[int, bytes]], rate: float) -> "ItemIndex":
        items = sorted(items, key=lambda x: len(x[1]) < Q)  # those shorter than a q-gram last; they have no part in the tables
        ids, texts = [i for i, _ in items], [t for _, t in items]
        short = [k for k, t in enumerate(texts) if len(t) < Q]
        longer = texts[:len(texts) - len(short)]
        sizes = np.array([len(t) for t in longer], dtype=np.int64)
        budgets = np.floor(sizes * rate).astype(np.int64)
        needs = sizes - Q + 1 - budgets * Q  # the lemma: so many q-grams are shared at least
        budgets = np.where(needs < 1, np.maximum(0, (sizes - Q) // Q), budgets)
        needs = np.maximum(1, sizes - Q + 1 - budgets * Q)
        all_grams = [grams(t) for t in longer]
        flat = np.concatenate([np.zeros(0, "<u8"), *all_grams])
        order = np.argsort(flat, kind="stable")
        keys, first = np.unique(flat[order], return_index=True)
        item = np.repeat(np.arange(len(longer)), np.array([len(g) for g in all_grams], dtype=np.int64))[order]
        place = np.concatenate([np.zeros(0, np.int64), *[np.arange(len(g)) for g in all_grams]])[order]
        table = np.zeros(1 << _TABLE_BITS, bool)
        table[(keys * _ODD) >> np.uint64(64 - _TABLE_BITS)] = True
        # a region of any item holds a window this long with this many hits
        reach = sizes + budgets
        window = int(reach.min(initial=1 << 40))
        density = int(np.ceil(needs / np.ceil(reach / window)).min(initial=1 << 40))
        return cls(ids, texts, short, budgets, needs, table, keys, np.append(first, len(flat)), item, place, window, density, int(reach.max(initial=0)))

    def hits(self, data: bytes) -> Iterator[tuple[int, int, int, int]]:
        """(item, start, end, edits) of item occurrences in one part of a document. Items shorter than a q-gram occur as whole words only."""
        if self.short:
            spaced = b" " + data + b" "
            for i in self.short:
                if (at := spaced.find(b" " + self.texts[i] + b" ")) >= 0:
                    yield i, at, at + len(self.texts[i]), 0
        g = grams(data)
        if len(g) < 1:
            return
        at = np.flatnonzero(self.table[(g * _ODD) >> np.uint64(64 - _TABLE_BITS)])
        if len(at) < self.density:
            return
        # an occurrence has one window so dense at least, and all its hits within its reach of that window's first
        ahead = np.searchsorted(at, at + self.window, side="right") - np.arange(len(at))
        dense = at[ahead >= self.density]
        if not len(dense):
            return
        cover = np.zeros(len(at) + 1, np.int64)
        np.add.at(cover, np.searchsorted(at, dense - self.reach), 1)
        np.add.at(cover, np.searchsorted(at, dense + self.reach, side="right"), -1)
        at = at[np.cumsum(cover[:-1]) > 0]
        where = np.searchsorted(self.keys, g[at])
        good = where < len(self.keys)
        good[good] = self.keys[where[good]] == g[at][good]
        at, where = at[good], where[good]
        if not len(at):
            return
        codes, n, least = self._bands(at, where)
        owner = codes >> 40
        passed = n >= self.needs[owner]
        exactly: set[int] = set()  # items of which the first exact place is known
        for i, start in zip(owner[passed].tolist(), ((codes[passed] & ((1 << 40) - 1)) + least).tolist()):
            if i in exactly:
                continue
            text, budget = self.texts[i], int(self.budgets[i])
            low, high = start * (budget + 1), (start + 2) * (budget + 1) - 1
            exact = data.find(text, max(0, low), max(0, high) + len(text))
            found = (0, exact, exact + len(text)) if exact >= 0 else banded_edits(text, data, low - budget, high + budget, budget)
            if found:
                if exact >= 0:
                    exactly.add(i)
                yield i, found[1], found[2], found[0]

    def _bands(self, at: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(item << 40 | band - least, hits, least): the q-grams each band of each item shares with the text.

        Bands are twice as wide as the budget and overlap by half, so the q-grams of one occurrence share one of them. A
        gram that repeats in text and item meets itself everywhere; such meetings are counted ``HITS`` at a time.
        """
        least = -(int(self.window) + max(map(len, self.texts))) - 1
        counts = self.first[where + 1] - self.first[where]
        ends = np.cumsum(counts)
        codes, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        k = 0
        while k < len(at):
            end = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + HITS, side="right")))
            each = counts[k:end]
            entry = np.repeat(self.first[where[k:end]] - np.concatenate([[0], np.cumsum(each)[:-1]]), each) + np.arange(each.sum())
            item, diagonal = self.item[entry], np.repeat(at[k:end], each) - self.place[entry]
            band = item * (1 << 40) + np.floor_divide(diagonal, self.budgets[item] + 1) - least
            some, times = np.unique(np.concatenate([band, band - 1]), return_counts=True)
            codes, places = np.unique(np.concatenate([codes, some]), return_inverse=True)
            n = np.bincount(places, weights=np.concatenate([n, times]), minlength=len(codes)).astype(np.int64)
            k = end
        return codes, n, least


def _blocks(items: DataFrame, item_col: str, item_text_col: str) -> Iterator[list[tuple[int, bytes]]]:
    """Items in blocks of at most ``BLOCK`` bytes, one after the other."""
    block: list[tuple[int, bytes]] = []
    size = 0
    rows = items.select(F.col(item_col).cast("long").alias("i"), F.col(item_text_col).alias("t")).where("t is not null")
    for r in rows.distinct().toLocalIterator():  # a block of items at a time
        text = normalised(r["t"])
        if not text:
            continue
        if block and size + len(text) > BLOCK:
            yield block
            block, size = [], 0
        block.append((r["i"], text))
        size += len(text)
    if block:
        yield block


def find_items(
    docs: DataFrame, items: DataFrame, rate: float = 0.06, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """(doc_id, item_id, start, end, edits) for every item that occurs in a document, at its best place.

    Texts are compared lower-cased with white space runs as one space; ``start`` and ``end`` count bytes of that
    form. An item of n bytes may have floor(n * ``rate``) edits, fewer where the lemma would ask for no shared q-gram;
    items shorter than a q-gram must occur as they are, as whole words; empty items occur nowhere. Of several places the one with fewest edits is given, then the first.

    Items go to the tasks in blocks of at most ``BLOCK`` bytes (one longer item is a block of its own), each block being
    compared with all documents; so what is sent is bounded however many items there are. Documents stay where they are. Null
    and empty texts have no match; null identifiers of documents and items are carried; a repeated item identifier (or null) with several texts counts as
    one item; repeated documents with one identifier give their best match each; empty tables give an empty result;
    other columns are ignored.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    result = None

    def search(block: list[tuple[int, bytes]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(ItemIndex.build(block, rate))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shared.value
            lap = 2 * max(map(len, index.texts)) + 2
            for batch in batches:
                rows = []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    data, best = normalised(text.as_py()), {}
                    for k in range(0, max(1, len(data)), PART):
                        for i, start, end, edits in index.hits(data[k:k + PART + lap]):
                            found = (edits, k + start, k + end)
                            if found < best.get(index.ids[i], (1 << 30,)):
                                best[index.ids[i]] = found
                    rows += [(doc_id, i, f[1], f[2], f[0]) for i, f in best.items()]
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64()] * 4 + [pa.int32()])], names=["doc_id", "item_id", "start", "end", "edits"]
                    )
            release()

        return texts.mapInArrow(run, "doc_id long, item_id long, start long, end long, edits int")

    for block in _blocks(items, item_col, item_text_col):
        found = search(block)
        result = found if result is None else result.unionByName(found)
    if result is None:
        return texts.limit(0).select("doc_id", F.lit(0).cast("long").alias("item_id"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"), F.lit(0).alias("edits"))
    return result


def remove_contaminated(docs: DataFrame, items: DataFrame, rate: float = 0.06, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, in whose own text no item occurs (see ``find_items``); identifiers play no part.

    Null and empty texts stay; repeated rows stay or go alike; without items every row stays; an empty table gives an empty result.
    """
    context, left = docs.sparkSession.sparkContext, docs

    def search(block: list[tuple[int, bytes]], rest: DataFrame) -> DataFrame:
        shared = context.broadcast(ItemIndex.build(block, rate))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shared.value
            lap = 2 * max(map(len, index.texts)) + 2

            def clean(text: str | None) -> bool:
                data = normalised(text)
                return not any(True for k in range(0, max(1, len(data)), PART) for _ in index.hits(data[k:k + PART + lap]))

            for batch in batches:
                texts = batch.column(batch.schema.get_field_index(text_col))
                yield batch.filter(pa.array([clean(t.as_py()) for t in texts], pa.bool_()))
            release()

        return rest.mapInArrow(run, docs.schema)

    for block in _blocks(items, "item_id", "text"):
        left = search(block, left)
    return left
