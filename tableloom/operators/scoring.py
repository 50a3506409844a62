"""Scoring tables with intervals."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from math import factorial
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, functions as F

from .linear import LinearFit, Moments, linear_fit, moments, predict_linear, solve
from .models import Model
from .partials import sum_vectors
from .stats import column_stats, exact_quantiles, one_row

__all__ = ["linear_fit", "predict_linear"]

# Rule-based price parts (default, factor) and the interval z values.
RULE_BASE, RULE_FLOOR, RULE_BAND = 200_000.0, 50_000.0, 0.15
RULE_PARTS = {
    "bedrooms": (3, 25_000.0), "bathrooms": (2, 15_000.0), "sqft": (1800, 150.0),
    "school_rating": (7, 8_000.0), "crime_rate": (25, -800.0), "walkability_score": (60, 300.0),
}
RULE_YEAR = (2000, 1980, 500.0)
Z_VALUES = {0.95: 1.96, 0.99: 2.576}
Z_OTHER = 1.645


def z_value(level: float) -> float:
    return Z_VALUES.get(level, Z_OTHER)


def fill_from_medians(df: DataFrame, middle: Mapping[str, float]) -> DataFrame:
    """Absent or missing features take the training median, so any table can be scored."""
    return df.withColumns(
        {
            c: F.coalesce(F.col(c).cast("double"), F.lit(float(m))) if c in df.columns else F.lit(float(m))
            for c, m in middle.items()
        }
    )


def residual_interval(df: DataFrame, residual_std: float, level: float = 0.95) -> DataFrame:
    margin = F.lit(z_value(level) * residual_std)
    return df.withColumns({"lower": F.col("prediction") - margin, "upper": F.col("prediction") + margin})


def residual_std(df: DataFrame, actual: str, predicted: str = "prediction") -> float:
    return one_row(df, F.stddev_pop(F.col(actual) - F.col(predicted)).alias("s"))["s"]


def rule_based_price(df: DataFrame) -> DataFrame:
    """Rule-based price with a fixed band; absent features take the rule defaults."""

    def feature(name, default):
        return F.coalesce(F.col(name).cast("double"), F.lit(float(default))) if name in df.columns else F.lit(float(default))

    price = F.lit(RULE_BASE)
    for name, (default, factor) in RULE_PARTS.items():
        price = price + feature(name, default) * F.lit(factor)
    default, since, factor = RULE_YEAR
    price = price + F.greatest(F.lit(0.0), feature("year_built", default) - F.lit(float(since))) * F.lit(factor)
    price = F.greatest(F.lit(RULE_FLOOR), price)
    return df.withColumn("prediction", price).withColumns(
        {"lower": F.col("prediction") * (1 - RULE_BAND), "upper": F.col("prediction") * (1 + RULE_BAND)}
    )


def bootstrap_linear(df: DataFrame, features: Sequence[str], target: str, n: int = 20, share: float = 0.8, seed: int = 42, key: Sequence[str] = ()) -> list[LinearFit]:
    """``n`` models on resamples with replacement, all from one pass.

    Each row draws a Poisson weight per replicate, the large-table form of sampling with
    replacement; a task sums the weighted cross products of its own rows, and Spark adds up
    the tasks. A draw follows from the seed, the replicate and a hash of ``key`` (or of the values),
    so it does not depend on how rows are dealt to tasks.
    """
    columns = [*features, target]
    p = len(columns)
    centre = np.array([v["mean"] for v in column_stats(df, columns, "mean").values()])
    rows = df.dropna(subset=columns).select(
        *[F.col(c).cast("double").alias(c) for c in columns], F.xxhash64(*(key or columns), F.lit(seed)).alias("_row")
    )
    chance = np.cumsum([np.exp(-share) * share**k / factorial(k) for k in range(30)])
    replicates = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def weighted_sums(batch):
        x = batch[columns].to_numpy(float) - centre
        h = batch["_row"].to_numpy(np.int64).view(np.uint64)[:, None] + replicates
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
        w = np.searchsorted(chance, (h >> np.uint64(11)) / 2.0**53).astype(float)
        crossed = np.einsum("rb,ri,rj->bij", w, x, x)
        return np.concatenate([w.sum(axis=0), (w.T @ x).ravel(), crossed.ravel()])

    total = sum_vectors(rows, weighted_sums)
    counts, sums = total[:n], total[n : n + n * p].reshape(n, p)
    crossed = total[n + n * p :].reshape(n, p, p)
    return [
        solve(Moments(counts[b], sums[b] / counts[b] + centre, crossed[b] - np.outer(sums[b], sums[b]) / counts[b]), features)
        for b in range(n)
    ]


def poisson_draws(key: Sequence[str | Column], replicate: int, share: float = 1.0, seed: int = 42) -> Column:
    """How often a row is drawn into a replicate: a Poisson count of mean ``share`` that follows from its key alone."""
    u = F.pmod(F.xxhash64(*key, F.lit(replicate), F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    chance = np.cumsum([np.exp(-share) * share**k / factorial(k) for k in range(20)])
    return sum(((u >= F.lit(float(c))).cast("int") for c in chance[:-1]), F.lit(0))


def bootstrap_models(
    df: DataFrame, fit: Callable[[DataFrame], Model], key: Sequence[str], n: int = 20, share: float = 0.8, seed: int = 42, parallelism: int = 4,
) -> list[Model]:
    """``n`` models of any kind on resamples with replacement, some of them fitted at a time.

    A row is in a replicate as often as ``poisson_draws`` says, so resamples depend on the unique ``key`` and the seed and on nothing
    else. ``fit`` makes a model of a table; it gets the drawn rows with their copies.
    """
    if not key:
        raise ValueError("resamples need the columns that tell rows apart")
    rows = df.persist()
    rows.count()

    def one(replicate: int) -> Model:
        drawn = rows.withColumn("_times", poisson_draws(key, replicate, share, seed)).where("_times > 0")
        return fit(drawn.withColumn("_times", F.explode(F.sequence(F.lit(1), F.col("_times")))).drop("_times"))

    with ThreadPool(parallelism) as pool:
        models = pool.map(inheritable_thread_target(df.sparkSession)(one), range(n))
    rows.unpersist()
    return models


def interval_from_models(df: DataFrame, models: Sequence[Model], level: float = 0.95) -> DataFrame:
    """Mean prediction, percentile interval and deviation over the predictions of any models, side by side on the same rows."""
    alpha, n = (1 - level) / 2, len(models)
    out = df
    for k, model in enumerate(models):
        had = out.columns
        out = model.transform(out).withColumnRenamed("prediction", f"_m{k}").select(*had, f"_m{k}")
    out = out.withColumn("_members", F.sort_array(F.array(*[F.col(f"_m{k}").cast("double") for k in range(n)])))
    mean = F.aggregate("_members", F.lit(0.0), lambda s, v: s + v) / F.lit(float(n))
    spread = F.aggregate("_members", F.lit(0.0), lambda s, v: s + (v - F.col("prediction")) * (v - F.col("prediction")))
    return out.withColumn("prediction", mean).select(
        *df.columns, "prediction", array_percentile(F.col("_members"), alpha, n).alias("lower"), array_percentile(F.col("_members"), 1 - alpha, n).alias("upper"),
        F.sqrt(spread / F.lit(float(n))).alias("spread"),
    )


def array_percentile(sorted_array: Column, share: float, size: int) -> Column:
    """Linear percentile of a sorted array column with a known size."""
    h = (size - 1) * share
    k = int(np.floor(h))
    low = F.element_at(sorted_array, k + 1)
    high = F.element_at(sorted_array, min(k + 2, size))
    return low + (high - low) * F.lit(h - k)


def interval_from_members(df: DataFrame, members: Sequence[LinearFit], level: float = 0.95) -> DataFrame:
    """Percentile interval and deviation over member predictions, row by row in the JVM."""
    alpha, n = (1 - level) / 2, len(members)
    out = df.withColumn("_members", F.sort_array(F.array(*[m.column() for m in members])))
    mean = F.aggregate("_members", F.lit(0.0), lambda s, v: s + v) / F.lit(float(n))
    out = out.withColumn("_mean", mean).withColumns(
        {
            "lower": array_percentile(F.col("_members"), alpha, n),
            "upper": array_percentile(F.col("_members"), 1 - alpha, n),
            "spread": F.sqrt(
                F.aggregate("_members", F.lit(0.0), lambda s, v: s + (v - F.col("_mean")) * (v - F.col("_mean")))
                / F.lit(float(n))
            ),
        }
    )
    return out.drop("_members", "_mean")


def conformal_interval(df: DataFrame, calibration: DataFrame, actual: str, level: float = 0.95) -> DataFrame:
    """Prediction ± the ``level`` quantile of absolute residuals of a calibration set."""
    residual = calibration.select(F.abs(F.col(actual) - F.col("prediction")).alias("r"))
    q = exact_quantiles(residual, {"r": [level]})["r"][0]
    return df.withColumns({"lower": F.col("prediction") - F.lit(q), "upper": F.col("prediction") + F.lit(q)})


def bayesian_interval(df: DataFrame, train: DataFrame, features: Sequence[str], target: str, level: float = 0.95) -> DataFrame:
    """Predictive interval of least squares: s² (1 + 1/n + (x-m)' S⁻¹ (x-m))."""
    m = moments(train, [*features, target])[None]
    fit = solve(m, features)
    p = len(features)
    inverse = np.linalg.pinv(m.scatter[:p, :p])
    w = np.array(fit.coefficients)
    rss = m.scatter[p, p] - w @ m.scatter[:p, p]
    s2 = rss / (m.n - p - 1)
    leverage = F.lit(1.0 + 1.0 / m.n)
    d = [F.col(c).cast("double") - F.lit(float(m.mean[i])) for i, c in enumerate(features)]
    for i in range(p):
        for j in range(p):
            leverage = leverage + d[i] * d[j] * F.lit(float(inverse[i, j]))
    out = predict_linear(df, fit).withColumn("spread", F.sqrt(F.lit(float(s2)) * leverage))
    margin = F.col("spread") * F.lit(z_value(level))
    return out.withColumns({"lower": F.col("prediction") - margin, "upper": F.col("prediction") + margin})


def interval_quality(df: DataFrame, members: str, levels: Sequence[float] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """Coefficient of variation and quantile map of an array column of member predictions."""
    n = F.size(members)
    mean = F.aggregate(members, F.lit(0.0), lambda s, v: s + v) / n
    out = df.withColumn("_s", F.sort_array(F.col(members))).withColumn("_mean", mean)
    spread = F.sqrt(F.aggregate(members, F.lit(0.0), lambda s, v: s + (v - F.col("_mean")) * (v - F.col("_mean"))) / n)
    entries = []
    for q in levels:
        h = (n - 1) * F.lit(q)
        k = F.floor(h).cast("int")
        low, high = F.get("_s", k), F.coalesce(F.get("_s", k + 1), F.get("_s", k))
        entries += [F.lit(f"q{int(q * 100)}"), low + (high - low) * (h - k)]
    out = out.withColumns(
        {
            "std_deviation": spread,
            "coefficient_of_variation": F.when(F.col("_mean") != 0, spread / F.abs(F.col("_mean"))),
            "quantiles": F.create_map(*entries),
        }
    )
    return out.drop("_s", "_mean")
