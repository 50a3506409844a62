"""Least squares from moments: one aggregate pass serves every fold, group or subset.

Count, means and covariances combine map-side, so only p x p numbers per key reach the
driver. Training moments of a fold are the total minus the fold, without another pass.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F


@dataclass
class Moments:
    """Row count, mean vector and centred cross products of some columns."""

    n: float
    mean: np.ndarray
    scatter: np.ndarray

    def __add__(self, other: "Moments") -> "Moments":
        n = self.n + other.n
        if n == 0:
            return self
        gap = other.mean - self.mean
        return Moments(
            n,
            self.mean + gap * (other.n / n),
            self.scatter + other.scatter + np.outer(gap, gap) * (self.n * other.n / n),
        )


def merge(parts: Iterable[Moments]) -> Moments:
    parts = [p for p in parts if p.n]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total


def moments(df: DataFrame, columns: Sequence[str], by: str | None = None) -> dict[object, Moments]:
    """Moments per value of ``by`` (a fold-like column with few values), or under None."""
    columns = list(columns)
    p = len(columns)
    x = [F.col(f"`{c}`").cast("double") for c in columns]
    aggs = [F.count(F.lit(1)).alias("n"), *[F.avg(x[i]).alias(f"m{i}") for i in range(p)]]
    aggs += [F.covar_pop(x[i], x[j]).alias(f"c{i}_{j}") for i in range(p) for j in range(i, p)]
    rows = df.dropna(subset=columns)
    grouped = rows.groupBy(F.col(by).alias("_by")) if by else rows.groupBy()
    out = {}
    for r in grouped.agg(*aggs).collect():
        if not r["n"]:
            continue
        cov = np.zeros((p, p))
        for i in range(p):
            for j in range(i, p):
                cov[i, j] = cov[j, i] = r[f"c{i}_{j}"]
        out[r["_by"] if by else None] = Moments(
            float(r["n"]), np.array([r[f"m{i}"] for i in range(p)]), cov * r["n"]
        )
    return out


@dataclass
class LinearFit:
    """Coefficients of a linear model and the column expression that applies it."""

    features: list[str]
    coefficients: list[float]
    intercept: float

    def column(self) -> Column:
        out = F.lit(float(self.intercept))
        for c, w in zip(self.features, self.coefficients):
            out = out + F.col(f"`{c}`").cast("double") * F.lit(float(w))
        return out


def solve(m: Moments, features: Sequence[str], ridge: float = 0.0) -> LinearFit:
    """Fit the last column of the moments on the others; ``ridge`` penalises the slopes only."""
    p = len(features)
    sxx = m.scatter[:p, :p] + ridge * np.eye(p)
    sxy = m.scatter[:p, p]
    w = np.linalg.solve(sxx, sxy) if np.linalg.matrix_rank(sxx) == p else np.linalg.lstsq(sxx, sxy, rcond=None)[0]
    return LinearFit(list(features), [float(v) for v in w], float(m.mean[p] - w @ m.mean[:p]))


def linear_fit(df: DataFrame, features: Sequence[str], target: str, ridge: float = 0.0) -> LinearFit:
    return solve(moments(df, [*features, target])[None], features, ridge)


def predict_linear(df: DataFrame, fit: LinearFit, name: str = "prediction") -> DataFrame:
    return df.withColumn(name, fit.column())


def predict_by_fold(df: DataFrame, fits: dict[object, LinearFit], fold: str, name: str = "prediction") -> DataFrame:
    """Each row is predicted by the model of its fold."""
    out = None
    for key, fit in fits.items():
        test = F.col(fold) == F.lit(key)
        out = F.when(test, fit.column()) if out is None else out.when(test, fit.column())
    return df.withColumn(name, out)


def out_of_fold_fits(df: DataFrame, features: Sequence[str], target: str, fold: str, ridge: float = 0.0) -> dict[object, LinearFit]:
    """For each fold the model trained on all other folds, from one pass over the rows."""
    parts = moments(df, [*features, target], fold)
    return {k: solve(merge(v for j, v in parts.items() if j != k), features, ridge) for k in sorted(parts)}
