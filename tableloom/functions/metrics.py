"""Error and class metrics as aggregate expressions, and a registry of metrics by name."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def regression_metrics(actual: str | Column, predicted: str | Column) -> dict[str, Column]:
    """mse, rmse, mae, r2 and mape (rows with a zero actual are left out of mape)."""
    y, p = _c(actual).cast("double"), _c(predicted).cast("double")
    y = F.when(p.isNotNull(), y)
    squared = (y - p) * (y - p)
    spread = F.var_pop(y)
    return {
        "mse": F.avg(squared),
        "rmse": F.sqrt(F.avg(squared)),
        "mae": F.avg(F.abs(y - p)),
        "r2": F.when(spread > 0, F.lit(1.0) - F.avg(squared) / spread).otherwise(F.lit(0.0)),
        "mape": F.avg(F.when(y != 0, F.abs((y - p) / y))),
    }


def class_scores(df: DataFrame, actual: str, predicted: str, keys: Sequence[str] = ()) -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1 per key; 0 for 0/0.

    Rows shrink to confusion counts map-side before anything is shuffled.
    """
    keys = list(keys)
    confusion = df.groupBy(*keys, F.col(actual).alias("_y"), F.col(predicted).alias("_p")).count()
    sides = F.array(
        F.struct(
            F.col("_y").cast("string").alias("cls"),
            F.col("count").alias("support"),
            F.lit(0).cast("bigint").alias("predicted"),
            F.when(F.col("_y").cast("string") == F.col("_p").cast("string"), F.col("count")).otherwise(0).alias("hit"),
        ),
        F.struct(
            F.col("_p").cast("string").alias("cls"),
            F.lit(0).cast("bigint").alias("support"),
            F.col("count").alias("predicted"),
            F.lit(0).cast("bigint").alias("hit"),
        ),
    )
    per_class = (
        confusion.select(*keys, F.explode(sides).alias("s"))
        .groupBy(*keys, "s.cls")
        .agg(F.sum("s.support").alias("support"), F.sum("s.predicted").alias("predicted"), F.sum("s.hit").alias("hit"))
    )
    precision = F.when(F.col("predicted") > 0, F.col("hit") / F.col("predicted")).otherwise(F.lit(0.0))
    recall = F.when(F.col("support") > 0, F.col("hit") / F.col("support")).otherwise(F.lit(0.0))
    f1 = F.when(
        F.col("support") + F.col("predicted") > 0, 2 * F.col("hit") / (F.col("support") + F.col("predicted"))
    ).otherwise(F.lit(0.0))
    total = F.sum("support")
    weighted = {
        "accuracy": F.sum("hit") / total,
        "precision": F.sum(precision * F.col("support")) / total,
        "recall": F.sum(recall * F.col("support")) / total,
        "f1": F.sum(f1 * F.col("support")) / total,
    }
    return per_class.groupBy(*keys).agg(*[v.alias(k) for k, v in weighted.items()])


# Metric callbacks by name: higher is better for all of them.
SCORERS: dict[str, Callable[[str, str], Column]] = {
    "neg_mean_squared_error": lambda y, p: -regression_metrics(y, p)["mse"],
    "neg_mean_absolute_error": lambda y, p: -regression_metrics(y, p)["mae"],
    "neg_root_mean_squared_error": lambda y, p: -regression_metrics(y, p)["rmse"],
    "r2": lambda y, p: regression_metrics(y, p)["r2"],
    "accuracy": lambda y, p: F.avg((F.col(y) == F.col(p)).cast("double")),
}
# The default metrics of each task.
DEFAULT_SCORING = {
    "classification": ["accuracy", "precision_weighted", "recall_weighted", "f1_weighted"],
    "regression": ["neg_mean_squared_error", "neg_mean_absolute_error", "r2"],
}


def register_scorer(name: str, build: Callable[[str, str], Column]) -> None:
    """Add a metric: a function of (actual, predicted) column names returning an aggregate."""
    SCORERS[name] = build


def default_scoring(task: str, scoring: str | Sequence[str] | None = None) -> list[str]:
    if scoring is None:
        return list(DEFAULT_SCORING[task])
    return [scoring] if isinstance(scoring, str) else list(scoring)


def score(df: DataFrame, names: Sequence[str], actual: str, predicted: str, keys: Sequence[str] = ()) -> DataFrame:
    """Long form (keys, metric, score) of the named metrics in one pass."""
    unknown = [n for n in names if n not in SCORERS]
    if unknown:
        raise ValueError(f"unknown metrics {unknown}; known: {sorted(SCORERS)}")
    aggs = [SCORERS[n](actual, predicted).cast("double").alias(f"m{i}") for i, n in enumerate(names)]
    wide = df.groupBy(*keys).agg(*aggs)
    entries = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(f"m{i}").alias("score")) for i, n in enumerate(names)])
    return wide.select(*keys, F.explode(entries).alias("e")).select(*keys, "e.metric", "e.score")
