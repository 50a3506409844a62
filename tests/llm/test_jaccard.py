"""The shingle join against all pairs."""

import random
import re
from collections import defaultdict

import pytest

from tableloom.llm import jaccard_join, plans

SF = "/root/testdata/sf0.001"
UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """Components over rows = [(doc_id, text)] with unique identifiers."""
    sets = {d: shingles(t) for d, t in rows}
    by = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            by[x].append(d)
    parent = {d: d for d in sets}

    def find(d):
        while parent[d] != d:
            d = parent[d]
        return d

    seen = set()
    for group in by.values():
        for a in group:
            for b in group:
                if a < b and (a, b) not in seen:
                    seen.add((a, b))
                    common = len(sets[a] & sets[b])
                    if 100 * common >= 80 * len(sets[a] | sets[b]):
                        low, high = sorted((find(a), find(b)))
                        parent[high] = low
    return {d: (len(sets[d]), find(d)) for d in sets}


def result(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def near_copies(seed, families=12):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(3))
    passage = [word() for _ in range(60)]
    rows = []
    for _ in range(families):
        base = [word() for _ in range(rng.choice([3, 5, 6, 8, 30, 100]))]
        if rng.random() < 0.5:
            base = passage + base
        for _ in range(rng.randint(1, 8)):
            text = list(base)
            for _ in range(rng.randint(0, 3)):
                text[rng.randrange(len(text))] = word()
            rows.append(" ".join(text + [word() for _ in range(rng.choice([0, 0, 2, 9]))]))
    rows += rows[:5] + [r.upper() for r in rows[5:8]]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_components_of_near_copies(spark, seed):
    rows = near_copies(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert result(jaccard_join.link_documents(docs)) == brute(rows)


def test_query_against_all_pairs(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert result(plans.op9_ngram_join(spark, SF)) == brute(rows)


def test_odd_rows(spark):
    long = " ".join(str(i) for i in range(30_000))
    rows = [(1, None, 1, "k"), (2, "", 2, None), (3, " \n\t", 3, "k"), (4, "a b", 1, "k"), (5, "A  B", 1, "k"), (None, "a b", 1, "k"), (6, long, 1, "k"),
            (7, long + " x", None, "k"), (8, "a b c", 1, "k"), (8, "a b c", 1, "k"), (8, "other words", 1, "k"), (None, None, 1, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int, sig string")
    got = sorted(map(tuple, jaccard_join.link_documents(docs).collect()), key=str)
    want = [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (None, 1, 4), (6, 29_996, 6), (7, 29_997, 6), (8, 1, 8), (8, 1, 8), (8, 1, 8), (None, 0, None)]
    assert got == sorted(want, key=str)
    assert sorted(r["doc_id"] or 0 for r in jaccard_join.keep_one(docs).collect()) == [0, 0, 1, 2, 3, 4, 6, 8, 8, 8]
    assert jaccard_join.link_documents(docs.limit(0)).collect() == []
