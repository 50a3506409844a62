"""Severity of toxic language by cumulative-link ordinal regression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import LOWER_BYTES

#: Bytes that end a word besides white space: ASCII marks and digits.
_SPLIT = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
_TABLE = bytes(_SPLIT[LOWER_BYTES[b]] for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a whole text in UTF-8: A-Z lower-cased, ASCII marks and digits taken as spaces."""
    return (text or b"").translate(_TABLE).split()


def feature(word: bytes, bits: int) -> int:
    return xxhash.xxh3_64_intdigest(word) >> (64 - bits)


@dataclass
class SeverityModel:
    """One weight per selected word hash, shared by all thresholds; ``cuts`` ascend, one between each two grades."""

    bits: int
    grades: list[int]
    weights: dict[int, float]
    cuts: np.ndarray

    def exceed(self, score: np.ndarray) -> np.ndarray:
        """P(grade above the k-th) for every threshold k."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.cuts[None, :], -40, 40)))


def _fit(rows: list[np.ndarray], grade: np.ndarray, levels: int, ridge: float, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending cuts maximising the cumulative logit likelihood, by gradient steps with momentum (Adam).

    ``rows`` are lists of feature numbers (presence); ``grade`` runs from 0 to levels - 1.
    """
    width = 1 + max((int(r.max()) for r in rows if len(r)), default=0)
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    columns = np.concatenate(rows) if len(at) else np.zeros(0, np.int64)
    share = np.array([np.clip((grade > k).mean(), 1e-3, 1 - 1e-3) for k in range(levels - 1)])
    first = -np.log(share / (1 - share))
    theta = np.concatenate([np.zeros(width), first[:1], np.log(np.maximum(np.diff(first), 1e-2))])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, rounds + 1):
        w = theta[:width]
        steps = np.exp(theta[width + 1:])
        cuts = theta[width] + np.concatenate([[0], np.cumsum(steps)])
        z = np.clip(cuts[None, :] - np.bincount(at, w[columns], len(rows))[:, None], -40, 40)
        below = 1 / (1 + np.exp(-z))  # P(grade <= k)
        full = np.concatenate([np.zeros((len(rows), 1)), below, np.ones((len(rows), 1))], axis=1)
        slope = np.concatenate([np.zeros((len(rows), 1)), below * (1 - below), np.zeros((len(rows), 1))], axis=1)
        i = np.arange(len(rows))
        p = np.maximum(full[i, grade + 1] - full[i, grade], 1e-12)
        d_score = (slope[i, grade + 1] - slope[i, grade]) / p  # of minus log likelihood by the score
        d_cut = np.zeros((len(rows), levels + 1))
        d_cut[i, grade + 1] -= slope[i, grade + 1] / p
        d_cut[i, grade] += slope[i, grade] / p
        d_cut = d_cut[:, 1:-1].sum(axis=0)
        later = d_cut[::-1].cumsum()[::-1]
        gradient = np.concatenate([np.bincount(columns, d_score[at], width) + ridge * w, [later[0]], later[1:] * steps]) / len(rows)
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        theta = theta - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return theta[:width], theta[width] + np.concatenate([[0], np.cumsum(np.exp(theta[width + 1:]))])


def train(
    docs: DataFrame, labels: DataFrame, grade: Column, id_col: str = "doc_id", text_col: str = "text", rows: int = 20_000, bits: int = 24,
    least: int = 5, z: float = 5.0, ridge: float = 0.01, rounds: int = 800,
) -> SeverityModel | None:
    """A model from at most about ``rows`` labelled documents, chosen by a hash of the identifier.

    ``grade`` is an expression over ``labels`` giving an integer severity (null: not used). Words are kept as features if
    at least ``least`` sampled documents have them and their share differs between grade 0 and the others by ``z``
    standard errors. None without labelled text or with one grade only.
    """
    graded = labels.select(F.col(id_col).cast("long").alias("id"), grade.cast("int").alias("grade")).where("id is not null and grade is not null")
    total = graded.count()
    if not total:
        return None
    sampled = graded.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < min(1.0, rows / total) * (1 << 20)).groupBy("id").agg(F.max("grade").alias("grade"))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    joined = texts.join(F.broadcast(sampled), "id").select("grade", "text")  # `rows` short rows at most

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.array(sorted({feature(w, bits) for w in set(words_of(t.as_py()))}), "<u4").tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("grade"), pa.array(sets, pa.binary())], names=["grade", "words"])

    table = joined.mapInArrow(hashes, "grade int, words binary").toArrow()
    grades = sorted(set(table.column("grade").to_pylist()))
    if len(grades) < 2:
        return None
    y = np.searchsorted(grades, table.column("grade").to_numpy())
    counts = np.array([len(w.as_py()) // 4 for w in table.column("words")])
    every = np.frombuffer(b"".join(w.as_py() for w in table.column("words")), "<u4")
    found, number = np.unique(every, return_inverse=True)
    tainted = np.repeat(y > 0, counts)
    n1, n0 = max(1, int((y > 0).sum())), max(1, int((y == 0).sum()))
    on1, on = np.bincount(number[tainted], minlength=len(found)), np.bincount(number, minlength=len(found))
    pooled = on / (n1 + n0)
    with np.errstate(divide="ignore", invalid="ignore"):
        score = (on1 / n1 - (on - on1) / n0) / np.sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n0))
    chosen = np.flatnonzero((on >= least) & (np.abs(np.nan_to_num(score)) >= z))
    kept, place = found[chosen], np.full(len(found), -1)
    place[chosen] = np.arange(len(chosen))
    rows_of = [p[p >= 0] for p in np.split(place[number], np.cumsum(counts)[:-1])]
    w, cuts = _fit(rows_of, y, len(grades), ridge, rounds)
    return SeverityModel(bits, grades, {int(k): float(x) for k, x in zip(kept, w)}, cuts)


def grade_texts(docs: DataFrame, model: SeverityModel | None, id_col: str = "doc_id", text_col: str = "text", decide: float = 0.3) -> DataFrame:
    """(doc_id, expected_severity, grade, toxic) for the whole text of every row of ``docs``.

    ``expected_severity`` is the sum of grade values weighted by their probabilities, ``grade`` the most probable one, and ``toxic`` says
    whether a grade above the lowest has a probability of at least ``decide``. Null and empty texts have no word and get what the cuts
    alone say; without a model all is 0. Rows are judged one by one, so ties, repeated rows and null identifiers
    change nothing; an empty table gives an empty result; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, memory = shared.value, {}
        for batch in batches:
            n = batch.num_rows
            if model is None:
                expected, best, toxic = np.zeros(n), np.zeros(n, np.int32), np.zeros(n, bool)
            else:
                score = np.zeros(n)
                for k, text in enumerate(batch.column("text")):
                    found = set()
                    for word in set(words_of(text.as_py())):
                        f = memory.get(word)
                        if f is None:
                            if len(memory) > 1_000_000:
                                memory.clear()
                            h = feature(word, model.bits)
                            f = memory[word] = h if h in model.weights else -1
                        if f >= 0:
                            found.add(f)
                    score[k] = sum(model.weights[f] for f in sorted(found))
                above = model.exceed(score)
                edges = np.concatenate([np.ones((n, 1)), above, np.zeros((n, 1))], axis=1)
                shares = edges[:, :-1] - edges[:, 1:]
                values = np.array(model.grades)
                expected, best, toxic = shares @ values, values[shares.argmax(axis=1)].astype(np.int32), above[:, 0] >= decide
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(expected), pa.array(best, pa.int32()), pa.array(toxic)], names=["doc_id", "expected_severity", "grade", "toxic"])

    return source.mapInArrow(run, "doc_id long, expected_severity double, grade int, toxic boolean")
