"""Benchmark items in documents against plain dynamic programming."""

import random
import tracemalloc

import pytest

from tableloom.llm import decontaminate, plans
from tableloom.llm.decontaminate import banded_edits, find_items, normalised, remove_contaminated


def best_edits(item, text):
    """Fewest edits between ``item`` and any part of ``text``."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item):
        new = [i + 1]
        for j, b in enumerate(text):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def edited(rng, text, n):
    text = bytearray(text)
    for _ in range(n):
        k = rng.randrange(len(text))
        kind = rng.randrange(3)
        if kind == 0:
            text[k] = rng.choice(b"xyzq")
        elif kind == 1:
            del text[k]
        else:
            text.insert(k, rng.choice(b"xyzq"))
    return bytes(text)


def test_banded_alignment():
    rng = random.Random(5)
    for _ in range(60):
        item = bytes(rng.choice(b"abcd ") for _ in range(rng.randint(20, 70)))
        before, after = (bytes(rng.choice(b"abcd ") for _ in range(rng.randint(0, 30))) for _ in range(2))
        text = before + edited(rng, item, rng.randint(0, 4)) + after
        want = best_edits(item, text)
        edits, start, end = banded_edits(item, text, len(before) - 12, len(before) + 12, 100)
        assert edits == want and best_edits(item, text[start:end]) == want


def test_against_brute_force(spark):
    rng = random.Random(9)
    syllables = ["the", "an", "er", "tion", "in", "on", "ed", "st"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(i, prose(rng.randint(12, 40)).capitalize() + ".") for i in range(8)]
    docs = []
    for d in range(40):
        text = prose(rng.randint(0, 60))
        if d % 2:
            planted = normalised(rng.choice(items)[1])
            text = text[: len(text) // 2] + " " + edited(rng, planted, rng.choice([0, 0, 2, 5, 9, 20])).decode() + "\n  " + text[len(text) // 2:]
        docs.append((d, text.upper() if d % 7 == 1 else text))
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in find_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    for d, text in docs:
        for i, item in items:
            n = best_edits(normalised(item), normalised(text))
            if n <= len(normalised(item)) * 0.06:
                want[d, i] = n
    assert want and got == want


@pytest.mark.parametrize("size", [100, 400])
def test_full_budget_beside_a_much_shorter_item(spark, size):
    rng = random.Random(size)
    letters = "abcdefghijklmnopqrstuvwxyz"
    short, long = ("".join(rng.choice(letters) for _ in range(n)) for n in (60, size))
    budget = int(size * 0.06)
    docs = []
    for gap in (8, 9, 10, 12, size // budget):
        for first in (4, size - 1 - gap * (budget - 1) - 4):
            text = list(long)
            for k in range(budget):
                text[first + k * gap] = "0"
            docs.append((len(docs), "1234567890" * 30 + "".join(text) + "0987654321" * 30))
    for _ in range(20):
        text = list(long)
        for k in rng.sample(range(size), budget):
            text[k] = "0"
        docs.append((len(docs), "".join(text)))
    items = spark.createDataFrame([(1, short), (2, long)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in find_items(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()}
    want = {}
    for d, text in docs:
        for i, item in ((1, short), (2, long)):
            n = best_edits(normalised(item), normalised(text))
            if n <= len(item) * 0.06:
                want[d, i] = n
    assert {d for d, i in want if i == 2} == set(range(len(docs))) and got == want


def test_query_finds_every_exact_passage(spark):
    folder = "/root/testdata/sf0.01"
    found = {(r["doc_id"], r["item_id"]) for r in plans.op4_decontamination(spark, folder).where("edits = 0").collect()}
    items = [(r["item_id"], normalised(r["text"])) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    docs = [(r["doc_id"], normalised(r["text"])) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert found == {(d, i) for d, t in docs for i, item in items if item in t}


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PART", 500)
    monkeypatch.setattr(decontaminate, "BLOCK", 40)
    item = "what is the capital of that small country"
    items = spark.createDataFrame([(1, item, "x"), (1, item, "x"), (2, None, "x"), (3, "short", "x"), (None, "no identifier here", "x"), (4, "another question about rivers", "x")], "item_id long, text string, doc_id string")
    long = "filler words go here " * 400 + item.upper().replace(" ", " \n ") + " and more " * 900
    rows = [(1, None, 1), (2, "", 2), (3, long, 3), (3, long, 3), (None, item, 1), (5, "short", 1), (6, "clean text without anything", 1), (7, "Short, but shorter", 1), (8, "there is No  identifier here", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id int")
    at = normalised(long).find(item.encode())
    got = sorted((r["doc_id"] or 0, r["item_id"] or 0, r["start"], r["end"], r["edits"]) for r in find_items(docs, items).collect())
    assert got == [(0, 1, 0, len(item), 0), (3, 1, at, at + len(item), 0), (3, 1, at, at + len(item), 0), (5, 3, 0, 5, 0), (8, 0, 9, 27, 0)]
    left = remove_contaminated(docs, items)
    assert sorted(r["doc_id"] for r in left.collect()) == [1, 2, 6, 7] and left.columns == docs.columns
    assert find_items(docs.limit(0), items).collect() == [] and find_items(docs, items.limit(0)).collect() == []


@pytest.mark.parametrize("size", [8, 9, 15, 16])
def test_shortest_items(spark, size):
    item = "abcdefghijklmnopqrst"[:size]
    docs = spark.createDataFrame([(1, f"zz {item} zz"), (2, "zz")], "doc_id long, text string")
    assert [r["doc_id"] for r in find_items(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()] == [1]


def test_repeated_characters_take_bounded_memory():
    """An item of equal characters meets a long line of them at every place."""
    index = decontaminate.ItemIndex.build([(1, b"=" * 400), (2, b"some other item")], 0.06)
    tracemalloc.start()
    found = list(index.hits(b"= " * 50 + b"=" * 100_000))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (0, 100, 500, 0) in found and {f[0] for f in found} == {0} and peak < 100 << 20


@pytest.mark.parametrize("hits", [1, 50])
def test_bands_counted_in_slices(monkeypatch, hits):
    item, text = b"abab" * 10 + b"end of it", b"xx" + b"abab" * 30 + b"end of it"
    index = decontaminate.ItemIndex.build([(1, item)], 0.06)
    want = sorted(index.hits(text))
    monkeypatch.setattr(decontaminate, "HITS", hits)
    assert sorted(index.hits(text)) == want and want


def test_short_items_are_whole_words(spark):
    items = spark.createDataFrame([(1, "Ab c"), (None, "é"), (2, " ")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "AB  c"), (2, "xab c"), (3, "so ab c, é"), (4, "é"), (5, " "), (6, "ab c" * 3)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["item_id"] or 0) for r in find_items(docs, items).collect()) == [(1, 1), (3, 0), (4, 0)]
