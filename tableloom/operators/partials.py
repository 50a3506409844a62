"""Numeric vectors summed over all rows, for iterative fits."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F


def sum_vectors(df: DataFrame, partial: Callable[[pd.DataFrame], np.ndarray]) -> np.ndarray:
    """Sum of ``partial(batch)`` over all Arrow batches.

    Each task adds up its own batches and emits one number per position; Spark adds those up,
    so the driver receives only the vector, whatever the number of tasks.
    """

    def per_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            if len(batch):
                part = np.asarray(partial(batch), dtype=float)
                total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"i": np.arange(len(total), dtype="int64"), "v": total})

    sums = df.mapInPandas(per_task, "i bigint, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(len(sums))
    for r in sums:
        out[r["i"]] = r["v"]
    return out


def fourier_map(features: int, width: int, gamma: float, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and phases whose cosines approximate the RBF kernel exp(-gamma d²)."""
    rng = np.random.default_rng(seed)
    return rng.normal(scale=np.sqrt(2 * gamma), size=(features, width)), rng.uniform(0, 2 * np.pi, width)


def fourier_features(x: np.ndarray, frequencies: np.ndarray, phases: np.ndarray) -> np.ndarray:
    return np.sqrt(2.0 / len(phases)) * np.cos(x @ frequencies + phases)


def landmark_rows(rows: DataFrame, columns: Sequence[str], most: int, seed: int = 42) -> np.ndarray:
    """At most ``most`` different rows, chosen by hash of their values."""
    spots = rows.select(*[F.col(c).cast("double").alias(c) for c in columns]).distinct()
    return spots.orderBy(F.xxhash64(*columns, F.lit(seed)), *columns).limit(most).toPandas().to_numpy(float)


class LandmarkMap:
    """Maps rows into the span of the landmarks ``x`` in the space of the kernel exp(-gamma d²) (Nyström)."""

    def __init__(self, x: np.ndarray, gamma: float):
        self.x, self.gamma = x, gamma
        values, vectors = np.linalg.eigh(self.kernel(x))
        kept = values > 1e-8 * values[-1]
        self.into = vectors[:, kept] / np.sqrt(values[kept])

    def kernel(self, rows: np.ndarray) -> np.ndarray:
        gaps = (rows**2).sum(axis=1)[:, None] + (self.x**2).sum(axis=1)[None, :] - 2 * rows @ self.x.T
        return np.exp(-self.gamma * np.maximum(gaps, 0.0))

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        return self.kernel(rows) @ self.into


def landmark_map(x: np.ndarray, gamma: float) -> LandmarkMap:
    """A function that maps rows into the span of the landmarks ``x``; ``kernel`` and ``into`` are its two factors."""
    return LandmarkMap(x, gamma)
