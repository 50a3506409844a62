"""Language identification: the family first, then pairwise machines among its languages."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.windows import top_per_key
from .common import release
from .features import linear_svm, ngram_counts, unit_rows

#: Families of closely related languages. A language not listed is a family of its own.
FAMILIES = {
    "germanic": ["en", "de", "nl", "af", "sv", "da", "no", "is"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl"],
    "slavic": ["ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl"],
    "uralic": ["fi", "et", "hu"],
    "turkic": ["tr", "az", "kk"],
}
UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}")


@dataclass
class LanguageModel:
    """Weights of one machine per family (against the rest) and one per pair of languages in a family."""

    bits: int
    families: dict[str, list[str]]
    family_weights: np.ndarray
    pair_weights: dict[tuple[str, str], np.ndarray]

    def predict(self, counts: np.ndarray) -> list[tuple[str, float]]:
        """(language, score) per row of n-gram counts.

        The family with the largest margin; in it the language with most pairwise wins, ties going to the larger sum
        of margins. The score is the product of both decisions' certainties.
        """
        x = unit_rows(counts)
        x = np.concatenate([x, np.ones((len(x), 1), x.dtype)], axis=1)
        names = list(self.families)
        margin = np.clip(4 * (x @ self.family_weights.T), -50, 50)
        power = np.exp(margin - margin.max(axis=1, keepdims=True))
        power /= power.sum(axis=1, keepdims=True)
        out = []
        for k, f in enumerate(margin.argmax(axis=1)):
            languages = self.families[names[f]]
            wins, sums = dict.fromkeys(languages, 0), dict.fromkeys(languages, 0.0)
            for a, b in combinations(languages, 2):
                m = float(x[k] @ self.pair_weights[a, b])
                wins[a if m >= 0 else b] += 1
                sums[a], sums[b] = sums[a] + m, sums[b] - m
            best = max(languages, key=lambda lang: (wins[lang], sums[lang]))
            certain = 1 / (1 + np.exp(-np.clip(4 * sums[best] / max(1, len(languages) - 1), -50, 50))) if len(languages) > 1 else 1.0
            out.append((best, float(np.clip(power[k, f] * certain, 0, 1))))
        return out


def _counted(texts: DataFrame, columns: list[str], bits: int) -> DataFrame:
    """``columns`` and the n-gram counts of ``text`` as 32-bit integers."""
    schema = texts.select(*columns).schema

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                counts = [ngram_counts(t.as_py() or "", bits).astype(np.int32).tobytes() for t in part.column("text")]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(counts, pa.binary())], names=[*columns, "counts"])

    return texts.select("text", *columns).mapInArrow(count, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema) + ", counts binary")


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", key: Column | None = None, per_language: int = 600, bits: int = 12) -> LanguageModel | None:
    """A model from a bounded sample of labelled rows: at most ``per_language`` of each language, chosen by a hash of ``key`` and text.

    All labelled rows are counted first, and a share of each language that makes up the number is taken by hash; of what is left the first
    ``per_language`` stay, so null or repeated keys, however many, do not widen the sample. A rare language gives all its
    rows. Null texts teach nothing; an empty text is a text without letters. None if no row has a label and a text.
    """
    key = F.lit(0) if key is None else key
    labelled = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(key, F.col(text_col)).alias("hash")).where(
        F.col("lang").isNotNull() & F.col("text").isNotNull()
    )
    totals = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not totals:
        return None
    share = F.lit(0.0)
    for lang, n in totals.items():
        share = F.when(F.col("lang") == lang, min(1.0, 1.1 * per_language / n)).otherwise(share)
    chosen = top_per_key(labelled.where(F.pmod("hash", F.lit(1 << 20)) < share * (1 << 20)), ["lang"], [F.col("hash")], per_language)
    table = _counted(chosen, ["lang"], bits).toArrow()
    if not table.num_rows:
        return None
    langs = np.array(table.column("lang").to_pylist())
    x, counts = np.empty((table.num_rows, 1 << bits), np.float32), table.column("counts")
    for k in range(0, len(x), 64):  # counts of all rows in 64 bits would take several times the room
        x[k:k + 64] = unit_rows(np.stack([np.frombuffer(c.as_py(), np.int32) for c in counts[k:k + 64]]))
    del table, counts
    release()
    families: dict[str, list[str]] = {}
    for lang in sorted(set(langs)):
        families.setdefault(next((f for f, members in FAMILIES.items() if lang in members), lang), []).append(lang)
    weights = []
    for members in families.values():
        y = np.where(np.isin(langs, members), 1, -1)
        weights.append(linear_svm(x, y) if len(families) > 1 else np.zeros(x.shape[1] + 1))
    pairs = {}
    for members in families.values():
        for a, b in combinations(members, 2):
            rows = np.isin(langs, [a, b])
            pairs[a, b] = linear_svm(x[rows], np.where(langs[rows] == a, 1, -1))
    return LanguageModel(bits, families, np.array(weights), pairs)


def _said(texts: list[str | None], model: LanguageModel | None) -> list[tuple[str, float]]:
    known = [i for i, t in enumerate(texts) if model is not None and t and _LETTER.search(t)]
    said = [(UNDETERMINED, 0.0)] * len(texts)
    if known:
        for i, answer in zip(known, model.predict(np.stack([ngram_counts(texts[i], model.bits) for i in known]))):
            said[i] = answer
    return said


def _parts(batches: Iterator[pa.RecordBatch], text_col: str, model: LanguageModel | None) -> Iterator[tuple[pa.RecordBatch, list[tuple[str, float]]]]:
    """Some hundred rows at a time, as their counts take more room than their texts."""
    for batch in batches:
        for k in range(0, batch.num_rows, 512):
            part = batch.slice(k, 512)
            yield part, _said([t.as_py() for t in part.column(part.schema.get_field_index(text_col))], model)


def identify(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) from the whole text of each row of ``docs``.

    A null text, or one without a letter, is ``und`` with score 0, as is every text without a model. Very long texts are
    counted in parts. Rows are judged one by one: ties, repeated rows, null identifiers and other columns change nothing;
    an empty table gives an empty result. The model has a fixed size and goes to the tasks whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, said in _parts(batches, "text", shared.value):
            arrays = [part.column(0), pa.array([s[0] for s in said], pa.string()), pa.array([s[1] for s in said], pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "lang_pred", "score"])
        release()

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: LanguageModel | None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text is in a language: those that ``identify`` finds ``und`` go.

    These are null texts and texts without a letter, however long; that much is known without a model too. Rows are judged one
    by one: ties, repeated rows, null identifiers and other columns change nothing; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, said in _parts(batches, text_col, shared.value):
            texts = part.column(part.schema.get_field_index(text_col))
            keep = [s[0] != UNDETERMINED for s in said] if shared.value else [bool(t.is_valid and _LETTER.search(t.as_py())) for t in texts]
            yield part.filter(pa.array(keep, pa.bool_()))
        release()

    return docs.mapInArrow(run, docs.schema)
