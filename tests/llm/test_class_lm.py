"""The class model against a plain restatement over lists of words."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tableloom.llm import class_lm, plans

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, train boolean, lang string, n int, block long"


def words(text):
    return (text or "").encode().translate(class_lm.LOWER_BYTES).split()


def score(spark, rows, **settings):
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], DOCS)
    return class_lm.score_documents(docs, F.col("train"), **settings).collect()


def odd_rows():
    rng = random.Random(4)
    text = lambda: " ".join(rng.choice("the a cat dog sat ran on under mat tree . IT it".split()) for _ in range(rng.randint(1, 40)))
    rows = [(i, text() + (f" rare{i % 37}" if i % 3 else ""), i % 5 != 1) for i in range(150)]
    rows += [(None, None, True), (7, "", False), (7, "same same", None), (7, "same same", None), (8, "z" * 100_000 + " the " + "z" * 33, True), (9, "z" * 100_000, False)]
    return rows + [(10, "the cat " * 30_000, True), (11, "\x1c\x1d  únknown\x0bİ", False), (12, "Tab\tline\nfeed", True)]


def brute(rows, k, m, rounds):
    """(n_tokens, n_known, N, base, score) per row: counts, contexts, transitions and scores one token at a time."""
    train = [words(t) for _, t, use in rows if use]
    count = Counter(w for d in train for w in d)
    ends, tokens = len(train), sum(map(len, train)) + len(train)
    types = len(count) + (ends > 0)
    grade = {w: math.floor(16 * math.log2(n)) for w, n in count.items()}
    room = [g for g in set(grade.values()) if sum(x >= g for x in grade.values()) <= m]
    top = sorted((w for w in count if room and grade[w] >= min(room)), key=lambda w: (-count[w], w))
    place, cls = {w: i for i, w in enumerate(top)}, np.arange(len(top)) % k

    def contexts():
        held = {w: np.zeros(2 * (k + 2), np.int64) for w in count}
        for d in train:
            near = [k, *(int(cls[place[w]]) if w in place else k + 1 for w in d), k]
            for i, w in enumerate(d):
                held[w][near[i]] += 1
                held[w][k + 2 + near[i + 2]] += 1
        return held

    for _ in range(rounds):
        held = contexts()
        cls = class_lm.exchange(np.array([held[w] for w in top]).reshape(len(top), 2 * (k + 2)), cls, k)
    held, profile = contexts(), np.zeros((k, 2 * (k + 2)))
    for w in top:
        profile[cls[place[w]]] += held[w]
    likely = np.log((profile + 0.1) / (profile.sum(axis=1, keepdims=True) / 2 + 0.1 * profile.shape[1]))
    of = {w: int(cls[place[w]]) if w in place else int((likely @ held[w]).argmax()) for w in count}
    move, kinds = np.zeros((k + 2, k + 1), np.int64), np.zeros((k, 3), np.int64)
    for w, n in count.items():
        kinds[of[w]] += [1, n == 1, n == 2]
    for d in train:
        line = [k, *(of[w] for w in d), k]
        for i in range(len(d) + 1):
            move[line[i], line[i + 1]] += 1
            if i and count[d[i - 1]] == 1:
                move[k + 1, line[i + 1]] += 1
    model = class_lm.fit_model(move, kinds)
    out = []
    for _, text, _ in rows:
        d = words(text)
        rest = tokens + 0.5 * (types + 1)
        base = sum(math.log10((count[w] + 0.5) / rest) for w in d) + math.log10((ends + 0.5) / rest)
        total, state = 0.0, k
        for w in d:
            if w in of:
                total += model.move[state, of[w]] + math.log10((count[w] - model.discount) / model.size[of[w]])
                state = of[w]
            else:
                total += model.unknown[state]
                state = k + 1
        out.append((len(d) + 1, sum(w in count for w in d) + (ends > 0), tokens, base, total + model.move[state, k]))
    return out


@pytest.mark.parametrize("clustered, block_bytes", [(14, 2000), (1 << 14, 1 << 20), (3, 1 << 20), (0, 5000)])
def test_scores_equal_the_plain_model(spark, clustered, block_bytes):
    rows = odd_rows()
    got = score(spark, rows, classes=5, clustered=clustered, rounds=3, block_bytes=block_bytes)
    columns = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    want = defaultdict(list)
    for (doc_id, text, train), values in zip(rows, brute(rows, 5, clustered, 3)):
        want[doc_id, bool(train)].append(values)
    seen = defaultdict(list)
    for r in got:
        seen[r["doc_id"], r["train"]].append(tuple(r[c] for c in columns))
        assert r["perplexity"] == pytest.approx(10 ** (-r["score"] / r["n_tokens"]))
    assert seen.keys() == want.keys()
    for key in want:
        for a, b in zip(sorted(seen[key]), sorted(want[key])):
            assert a[:3] == b[:3] and a[3:] == pytest.approx(b[3:], rel=1e-9)


def test_tables_without_training_rows(spark):
    assert score(spark, []) == []
    [row] = score(spark, [(1, "some words", False)])
    assert (row["n_tokens"], row["n_known"], row["train_tokens"]) == (3, 0, 0) and math.isfinite(row["score"]) and row["base_score"] == pytest.approx(0)
    [row] = score(spark, [(1, None, True)])
    assert (row["n_tokens"], row["n_known"], row["train_tokens"]) == (1, 1, 1)


def test_probabilities_add_up_to_one():
    rng = np.random.default_rng(3)
    sizes = rng.integers(3, 50, 6)  # tokens per class
    move = rng.integers(0, 9, (8, 7))
    move[:7, :6] = 0
    move[0, :6], move[1, 6] = sizes, 10
    move[7] = [1, 0, 2, 0, 0, 0, 1]
    types = np.stack([sizes // 3, sizes // 6, sizes // 9], axis=1)
    model = class_lm.fit_model(move, types)
    for context in range(8):
        p = 10 ** model.move[context]
        known = sum(p[c] * (1 - model.discount * types[c, 0] / model.size[c]) for c in range(6))
        assert p.sum() == pytest.approx(1) and known + 10 ** model.unknown[context] + p[6] == pytest.approx(1)


def test_exchange_raises_the_likelihood():
    rng = np.random.default_rng(1)
    # two kinds of words that follow each other: contexts tell them apart
    kinds = np.arange(60) % 2
    k, classes = 2, rng.integers(0, 2, 60)
    follows = rng.integers(1, 20, (60, 60)) * (kinds[:, None] != kinds[None, :])

    def contexts(c):
        right = np.stack([follows[:, c == j].sum(axis=1) for j in range(k)], axis=1)
        left = np.stack([follows[c == j].sum(axis=0) for j in range(k)], axis=1)
        return np.concatenate([left, right], axis=1)

    def likelihood(c):
        n = np.array([[follows[c == a][:, c == b].sum() for b in range(k)] for a in range(k)], float)
        flat = lambda t: (t * np.log(np.maximum(t, 1))).sum()
        return flat(n) - flat(n.sum(axis=0)) - flat(n.sum(axis=1))

    before = likelihood(classes)
    for _ in range(6):
        classes = class_lm.exchange(contexts(classes), classes, k, step=8)
    assert likelihood(classes) > before and len(set(zip(kinds, classes))) == 2


def test_query_on_the_tables(spark):
    rows = plans.op12_class_lm(spark, SF).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    count = Counter()
    for i, t in docs.items():
        if not held(i):
            count.update([*words(t), None])
    total = sum(count.values())
    assert {r["doc_id"] for r in rows} == set(docs) and len(rows) == len(docs)
    for r in rows:
        d = [*words(docs[r["doc_id"]]), None]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(r["doc_id"]), len(d), sum(w in count for w in d), total)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[w] + 0.5) / (total + 0.5 * (len(count) + 1))) for w in d))
    out = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in out) > 0.9 * sum(r["base_score"] for r in out)
