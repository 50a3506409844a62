"""A/B experiments as tables: assignment, batch metrics, comparison and lifecycle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.metrics import class_scores, regression_metrics
from ..functions.scalars import label_by, percent_change
from ..functions.significance import student_p_column

REGRESSION = ("mse", "rmse", "mae", "r2")
CLASSES = ("accuracy", "precision", "recall", "f1")
# Effect-size bands and the distinct-value limit of a regression batch.
EFFECT_BANDS = ((0.2, "negligible"), (0.5, "small"), (0.8, "medium"))
REGRESSION_ABOVE = 10


def assign_arm(share: Column, split: Column | float, active: Column | None = None) -> Column:
    """``model_b`` where the unit's share in [0, 1) lies below the split; null if not active."""
    split = F.lit(split) if isinstance(split, (int, float)) else split
    arm = F.when(share < split, F.lit("model_b")).otherwise(F.lit("model_a"))
    return arm if active is None else F.when(active, arm)


def hashed_share(key: Column, experiment: Column, parts: int = 10_000) -> Column:
    """Stable share of a unit in an experiment: the same unit always gets the same arm."""
    return F.pmod(F.xxhash64(key, experiment), F.lit(parts)) / F.lit(parts)


def batch_metrics(df: DataFrame, keys: Sequence[str], actual: str, predicted: str) -> DataFrame:
    """One row per recorded batch.

    More than ten distinct actuals make a regression batch; otherwise the predictions are
    rounded half to even and compared as classes.
    """
    keys = list(keys)
    y, p = F.col(actual), F.col(predicted)
    numbers = regression_metrics(y, p)
    wide = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sample_size"),
        F.countDistinct(y).alias("_distinct"),
        *[numbers[m].alias(m) for m in REGRESSION],
    )
    is_regression = F.col("_distinct") > REGRESSION_ABOVE
    labels = df.join(wide.where(~is_regression).select(*keys), keys, "left_semi").select(
        *keys, y.cast("double").alias("_actual"), F.bround(p.cast("double"), 0).alias("_label")
    )
    classes = class_scores(labels, "_actual", "_label", keys)
    numbers_only = wide.select(*keys, "sample_size", *[F.when(is_regression, F.col(m)).alias(m) for m in REGRESSION])
    return numbers_only.join(classes, keys, "left")


def metric_rows(batches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Long form (keys, metric, value) of the metrics each batch has."""
    metrics = [c for c in batches.columns if c in REGRESSION + CLASSES]
    entries = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])
    return batches.select(*keys, F.explode(entries).alias("e")).select(*keys, "e.metric", "e.value").where("value IS NOT NULL")


def arm_statistics(rows: DataFrame, experiment: str = "experiment", arm: str = "arm") -> DataFrame:
    """Mean, deviations, extremes and count per experiment, arm and metric."""
    return rows.groupBy(experiment, arm, "metric").agg(
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"),
        F.var_samp("value").alias("var_samp"),
        F.var_pop("value").alias("var_pop"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.count("value").alias("samples"),
    )


def compare_arms(stats: DataFrame, level: float = 0.95, experiment: str = "experiment", arm: str = "arm") -> DataFrame:
    """Pooled two-sample t-test, effect size and improvement per metric of both arms."""
    keep = ("mean", "var_samp", "var_pop", "samples")
    a, b = (
        stats.where(F.col(arm) == name).select(experiment, "metric", *[F.col(c).alias(f"{c}_{s}") for c in keep])
        for name, s in (("model_a", "a"), ("model_b", "b"))
    )
    both = a.join(b, [experiment, "metric"]).where("samples_a >= 2 AND samples_b >= 2")
    na, nb = F.col("samples_a"), F.col("samples_b")
    pooled = ((na - 1) * F.col("var_samp_a") + (nb - 1) * F.col("var_samp_b")) / (na + nb - 2)
    t = (F.col("mean_a") - F.col("mean_b")) / F.sqrt(pooled * (1 / na + 1 / nb))
    spread = F.sqrt((F.col("var_pop_a") + F.col("var_pop_b")) / 2)
    d = F.when(spread > 0, (F.col("mean_b") - F.col("mean_a")) / spread).otherwise(F.lit(0.0))
    out = both.withColumns({"t_statistic": t, "freedom": (na + nb - 2).cast("double"), "cohens_d": d})
    out = out.withColumn("p_value", student_p_column("t_statistic", "freedom"))
    return out.select(
        experiment, "metric", "mean_a", "mean_b", "samples_a", "samples_b", "t_statistic", "p_value",
        (F.col("p_value") < F.lit(1 - level)).alias("is_significant"),
        "cohens_d", effect_label(F.col("cohens_d")).alias("effect_size"),
        percent_change(F.col("mean_b"), F.col("mean_a")).alias("improvement"),
    )


def effect_label(d: Column) -> Column:
    return label_by(F.abs(d), EFFECT_BANDS, "large")


def winners(tests: DataFrame, experiment: str = "experiment") -> DataFrame:
    """Winner per experiment on its primary metric (rmse if tested, else accuracy)."""
    primary = tests.where(F.col("metric").isin("rmse", "accuracy")).groupBy(experiment).agg(
        F.max_by(F.struct(*[c for c in tests.columns if c != experiment]), F.col("metric") == "rmse").alias("t")
    )
    rows = tests.select(experiment).distinct().join(primary, experiment, "left")
    better_b = F.when(F.col("t.metric") == "rmse", F.col("t.mean_b") < F.col("t.mean_a")).otherwise(
        F.col("t.mean_b") > F.col("t.mean_a")
    )
    winner = F.when(F.col("t.is_significant"), F.when(better_b, F.lit("model_b")).otherwise(F.lit("model_a")))
    out = rows.select(
        experiment, F.col("t.metric").alias("primary_metric"), winner.alias("winner"),
        F.col("t.improvement").alias("improvement"), F.col("t.effect_size").alias("effect_size"),
    )
    return out.withColumn("recommendation", recommendation())


def recommendation() -> Column:
    """Text for a row of (winner, improvement, primary_metric, effect_size)."""
    # The recommendation texts.
    better = "Model B shows statistically significant improvement (%.2f%% on %s, %s effect). Recommend deploying Model B."
    worse = "Model A (control) performs better (%.2f%% on %s, %s effect). Recommend keeping Model A."
    none = "No statistically significant difference found. Continue monitoring or increase sample size."
    args = (F.abs(F.col("improvement")), F.col("primary_metric"), F.col("effect_size"))
    return (
        F.when(F.col("winner") == "model_b", F.format_string(better, *args))
        .when(F.col("winner") == "model_a", F.format_string(worse, *args))
        .otherwise(F.lit(none))
    )


def experiment_list(lifecycle: DataFrame, results: DataFrame, experiment: str = "experiment", arm: str = "arm") -> DataFrame:
    """Status, creation time and recorded batches per arm; experiments without results stay."""
    counts = results.groupBy(experiment).agg(
        F.count_if(F.col(arm) == "model_a").alias("results_a"), F.count_if(F.col(arm) == "model_b").alias("results_b")
    )
    zero = F.lit(0).cast("bigint")
    return lifecycle.join(counts, experiment, "left").withColumns(
        {c: F.coalesce(c, zero) for c in ("results_a", "results_b")}
    )


def lifecycle(log: DataFrame, experiment: str = "experiment", at: str = "ts", status: str = "status", tie: str | None = None) -> DataFrame:
    """Latest status and first creation per experiment from an append-only status log.

    The first ``active`` entry creates; a later create of the same name changes nothing.
    """
    order = F.struct(F.col(at), F.col(tie)) if tie else F.col(at)
    return log.groupBy(experiment).agg(
        F.max_by(F.col(status), order).alias("status"),
        F.min(F.when(F.col(status) == "active", F.col(at))).alias("created_at"),
        F.max(F.when(F.col(status) == "stopped", F.col(at))).alias("stopped_at"),
    )
