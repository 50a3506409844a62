"""Token files and packing against the tokenizer itself."""

import os
import random
import subprocess
import sys
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from tableloom.llm import packing, plans, token_store
from tableloom.llm.common import shared_folder
from tableloom.llm.encoder import Encoder
from tableloom.llm.packing import Capacities, cut_pieces, plan_bins
from tableloom.llm.token_store import EliasFano, TokenFile

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, tie string, part int"


@pytest.fixture(scope="module")
def reference():
    tokenizer = Tokenizer.from_file(plans.tokenizer_file())
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids + [0]


@pytest.fixture(scope="module")
def encode():
    return Encoder(plans.tokenizer_file(), limit=3000)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def odd_rows():
    long = " ".join(random.Random(3).choice(["alpha", "beta,", "12", "été.\nNext"]) for _ in range(40_000))
    return [(5, "same", "x", 1), (5, "same", "x", 1), (3, None, None, None), (None, "no id", "y", 2), (None, None, None, None), (4, "", "z", 3), (-7, long, "w", 4), (9, "  two  spaces \n\n end ", "v", 5)]


def test_encoder_agrees_with_the_library(encode, reference):
    alphabet = ["a", "B", "é", " ", "  ", "\n", "\t", " \n", "'s", "'", "1", "23", ".", ",", "!", "\xa0", "　", "the", "<|endoftext|>", "😀", "\x1c", "ſ", "ʼ", "中", " 'll"]
    rng, texts = random.Random(1), [None, " ".join(["word"] * 300)]
    for _ in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14)))
        assert np.frombuffer(encode.encode(text), "<u4").tolist() == reference(text)[:-1], repr(text)
        texts.append(text)
    for text, ids in zip(texts, encode.encode_all(pa.array(texts), most=200)):
        assert np.frombuffer(ids, "<u4").tolist() == reference(text)[:-1], repr(text)


@given(st.lists(st.integers(0, 1 << 45), max_size=700))
@settings(max_examples=50, deadline=None)
def test_elias_fano_round_trip(values):
    values.sort()
    coded = EliasFano.from_bytes(EliasFano.build(np.array(values, dtype=np.uint64)).to_bytes())
    assert coded.values().tolist() == values
    assert [coded.select(i) for i in range(len(values))] == values


def test_elias_fano_is_small():
    ends = np.cumsum(np.random.default_rng(0).integers(1, 3000, 100_000))
    assert len(EliasFano.build(ends).to_bytes()) * 8 / len(ends) < 14


def test_token_query_against_the_library(spark, reference):
    rows = {r["doc_id"]: r for r in plans.op1_token_store(spark, SF).collect()}
    at = 0
    for d in sorted(spark.read.parquet(f"{SF}/documents.parquet").collect(), key=lambda d: d["doc_id"]):
        ids = reference(d["text"])
        assert rows.pop(d["doc_id"]).asDict() == {"doc_id": d["doc_id"], "start": at, "n_tokens": len(ids), "ids_crc32": crc(ids)}
        at += len(ids)
    assert not rows


def test_token_files_with_odd_rows(spark, reference):
    docs = spark.createDataFrame(odd_rows(), SCHEMA)
    files = token_store.write_token_files(docs, shared_folder(spark, "t"), plans.tokenizer_file(), file_ids=50)
    got = token_store.read_documents(spark, files).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted([r[0] for r in odd_rows()], key=lambda d: (d is not None, d or 0))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, np.frombuffer(r["ids"], "<u4").tolist()) for r in got) == sorted(
        (r[0] is None, r[0] or 0, reference(r[1])) for r in odd_rows()
    )
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1].tolist()]
    first = files.orderBy("base").first()
    with TokenFile(first["path"]) as file:
        assert [file.document(i).tolist() for i in range(file.n_docs)] == [np.frombuffer(r["ids"], "<u4").tolist() for r in got[: file.n_docs]]
    empty = token_store.write_token_files(docs.limit(0), shared_folder(spark, "t"), plans.tokenizer_file())
    assert token_store.read_documents(spark, empty).collect() == []


def check_packing(rows, lengths, limits, reference=None):
    by_doc, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append(r)
    for content in bins.values():
        content.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in content] == [0, *np.cumsum([r["length"] for r in content])[:-1].tolist()]
        tokens, pieces, cost = limits.vector().tolist()
        assert sum(r["length"] for r in content) <= tokens and len(content) <= pieces and sum(r["length"] ** 2 for r in content) <= cost
    for doc, n in lengths.items():
        assert sorted((r["piece"], r["start"], r["length"]) for r in by_doc[doc]) == [(i, s, w) for i, (s, w) in enumerate(cut_pieces(n, limits.tokens))]
    return len(bins)


def test_packing_query(spark, reference):
    rows = plans.op5_packing(spark, SF).collect()
    ids = {d["doc_id"]: reference(d["text"]) for d in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    n = check_packing(rows, {d: len(i) for d, i in ids.items()}, Capacities())
    assert n <= 1.03 * sum(map(len, ids.values())) / 2048 + 1
    for r in rows:
        assert r["ids_crc32"] == crc(ids[r["doc_id"]][r["start"]:r["start"] + r["length"]])


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("limits", [Capacities(100), Capacities(100, pieces=4), Capacities(100, cost=5500), Capacities(100, 3, 10_000)])
def test_plan_respects_every_capacity(rule, limits):
    rng = random.Random(7)
    counts = {n: rng.randint(1, 40) for n in range(1, 75)}
    bins, place = defaultdict(list), defaultdict(int)
    slots = plan_bins(counts, limits, rule)
    for length, rank, first, per_bin, offset in slots:
        later = [s[1] for s in slots if s[0] == length and s[1] > rank]
        for k in range(rank, min(later, default=counts[length])):
            bins[first + (k - rank) // per_bin].append((offset + (k - rank) % per_bin * length, length))
            place[length] += 1
    assert place == counts
    tokens, pieces, cost = limits.vector().tolist()
    for content in bins.values():
        content.sort()
        assert [o for o, _ in content] == [0, *np.cumsum([n for _, n in content])[:-1].tolist()]
        assert sum(n for _, n in content) <= tokens and len(content) <= pieces and sum(n * n for _, n in content) <= cost


def test_packing_with_odd_rows_and_ids(spark, reference):
    docs = spark.createDataFrame(odd_rows(), SCHEMA)
    packed = packing.pack(docs, plans.tokenizer_file(), Capacities(64, pieces=5), with_ids=True)
    rows = packed.collect()
    assert sum(r["length"] for r in rows) == sum(len(reference(r[1])) for r in odd_rows())
    for s in packing.sequences(packed).collect():
        assert len(s["ids"]) == 4 * s["n_tokens"] <= 256 and len(s["pieces"]) <= 5
    assert packing.pack(docs.limit(0), plans.tokenizer_file()).collect() == []


@pytest.mark.parametrize("numbers", [[], [0], [5, 5, 5], [0, 2**63, 2**64 - 1], list(range(0, 90_000, 9)), [7] * 9000])
def test_ranges_of_coded_numbers(numbers):
    coded = EliasFano.from_bytes(EliasFano.build(np.array(numbers, dtype=np.uint64)).to_bytes())
    assert coded.values().tolist() == numbers
    for first, last in ((0, 1), (1, 4), (4095, 4098), (8000, 99_999), (3, 3)):
        assert coded.between(first, last).tolist() == numbers[first:last]
    assert all(coded.select(i) == numbers[i] for i in range(0, len(numbers), 997))


def test_identifiers_far_apart(spark):
    """Identifiers over the whole range of a long come back, as do many documents in several files."""
    ids = [-9 * 10**18, -(2**63), 5, 9 * 10**18, 2**63 - 1, -1, 0]
    docs = spark.createDataFrame([(i, f"text {i}") for i in ids] + [(None, "x")], "doc_id long, text string")
    files = token_store.write_token_files(docs.coalesce(1), shared_folder(spark, "t"), plans.tokenizer_file(), file_docs=3)
    assert files.count() >= 3
    rows = sorted(token_store.read_documents(spark, files).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None, *sorted(ids)]
    assert [r["start"] for r in rows] == np.concatenate([[0], np.cumsum([r["n_tokens"] for r in rows])[:-1]]).tolist()


def test_many_documents_of_one_id():
    from tableloom.llm.token_store import pack_file

    n = 300_000
    parts = pack_file(list(range(n)), np.arange(1, n + 1), b"\0\0" * n, 2)
    assert sum(map(len, parts)) < 3.0 * n


def test_memories_are_bounded_and_emptied(encode):
    from tableloom.llm.encoder import encoder

    with encoder(plans.tokenizer_file()) as one:
        list(one.encode_all(pa.array([" ".join(f"word{i}" for i in range(200_000))])))
        assert max(len(one.words), len(one.others), len(one.marks)) <= one.limit < 300_000
    assert not one.words and not one.others and not one.marks


def test_new_words_take_little_memory_beside_their_ids():
    """A batch of 8 MB of words not seen before: the worker grows by its memories and by little more."""
    code = """
import random, resource, pyarrow as pa
from tableloom.llm import plans
from tableloom.llm.encoder import Encoder
one, rng = Encoder(plans.tokenizer_file()), random.Random(1)
texts = pa.array([" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 9))) for _ in range(600)) for _ in range(2000)])
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
n = sum(1 for _ in one.encode_all(texts))
print(n, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=300)
    n, mb = map(int, done.stdout.split())
    assert n == 2000 and mb < 120


def test_calls_to_the_library_are_cut_anywhere(monkeypatch, reference):
    from tableloom.llm import encoder as en

    text = "start " + " ".join(random.Random(2).choice(["alpha", "beta,", "12", "été", "x" * 40, "don't", "中", "<|endoftext|>"]) + str(i % 7) for i in range(300))
    for most in (1, 30, 1 << 20):
        monkeypatch.setattr(en, "CALL", most)
        one = Encoder(plans.tokenizer_file(), limit=3000)
        [ids] = one.encode_all(pa.array([text]))
        assert np.frombuffer(ids, "<u4").tolist() == reference(text)[:-1]


def test_memories_below_their_limit_serve_the_next_task():
    from tableloom.llm import encoder as en

    assert 3 * 200 * en.MEMORY_ENTRIES < 52 << 20  # all three memories of a worker
    for limit, kept in ((100, True), (3, False)):
        coder = en.Encoder.__new__(en.Encoder)
        coder.limit, coder.words, coder.marks, coder.others = limit, {"a": b"", "b": b"", "c": b""}, {}, {}
        coder.forget()
        assert bool(coder.words) == kept
