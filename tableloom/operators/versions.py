"""Model registry kept as append-only tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import percent_change
from .windows import top_per_key, with_position

TTL_HOURS = 24


def assign_versions(created: DataFrame, model: str, order: Sequence[str], flagged: str, **sizes) -> DataFrame:
    """Version number and id per model in creation order, and whether the version is current.

    The first version becomes current, and so does every flagged one; the latest such wins.
    """
    out = with_position(created, order, [model], "_n", **sizes)
    out = out.withColumn("version_number", F.col("_n") + 1).drop("_n")
    current = current_versions(out, model, flagged)
    return (
        out.join(current, model)
        .withColumn("version_id", F.concat(F.lit("v"), F.col("version_number").cast("string")))
        .withColumn("is_active", F.col("version_number") == F.col("_current"))
        .drop("_current")
    )


def current_versions(versions: DataFrame, model: str, flagged: str) -> DataFrame:
    takes_over = (F.col("version_number") == 1) | F.coalesce(F.col(flagged), F.lit(False))
    return versions.groupBy(model).agg(F.max(F.when(takes_over, F.col("version_number"))).alias("_current"))


def version_list(versions: DataFrame, model: str) -> DataFrame:
    """Versions with the current id and the total per model."""
    per = versions.groupBy(model).agg(
        F.count(F.lit(1)).alias("total_versions"), F.max(F.when(F.col("is_active"), F.col("version_id"))).alias("current_version")
    )
    return versions.join(per, model)


def active_after(log: DataFrame, model: str, version: str, at: str, tie: str) -> DataFrame:
    """Active version per model after all activations and rollbacks: the latest event."""
    return log.groupBy(model).agg(F.max_by(version, F.struct(at, tie)).alias("active_version"))


def compare_versions(versions: DataFrame, model: str, metrics: str, first: int, second: int) -> DataFrame:
    """Difference and percent change of each metric both versions have, per model."""
    long = versions.where(F.col("version_number").isin(first, second)).select(
        model, "version_number", F.explode(metrics).alias("metric", "value")
    )
    a = long.where(F.col("version_number") == first).select(model, "metric", F.col("value").alias("version_1"))
    b = long.where(F.col("version_number") == second).select(model, "metric", F.col("value").alias("version_2"))
    return a.join(b, [model, "metric"]).select(
        model, "metric", "version_1", "version_2", (F.col("version_2") - F.col("version_1")).alias("difference"),
        percent_change(F.col("version_2"), F.col("version_1")).alias("percent_change"),
    )


def delete_versions(versions: DataFrame, requests: DataFrame, model: str) -> tuple[DataFrame, DataFrame]:
    """(versions left, requests with their outcome); the active version cannot be deleted."""
    key = [model, "version_number"]
    known = requests.join(versions.select(*key, F.col("is_active").alias("_active")), key, "left")
    outcome = (
        F.when(F.col("_active").isNull(), F.lit("not found"))
        .when(F.col("_active"), F.lit("active version cannot be deleted"))
        .otherwise(F.lit("deleted"))
    )
    answered = known.select(*requests.columns, outcome.alias("outcome"))
    left = versions.join(answered.where(F.col("outcome") == "deleted").select(*key), key, "left_anti")
    return left, answered


def store_statistics(entries: DataFrame, at: str, size: str, now: Column, ttl_hours: int = TTL_HOURS) -> DataFrame:
    """Entry, valid and expired counts and stored bytes."""
    valid = F.col(at) + F.make_dt_interval(hours=F.lit(ttl_hours)) > now
    total = F.coalesce(F.sum(size), F.lit(0)).cast("bigint")
    return entries.agg(
        F.count(F.lit(1)).alias("total_models"), F.count_if(valid).alias("valid_models"), F.count_if(~valid).alias("expired_models"),
        total.alias("total_size_bytes"), F.round(total / F.lit(1024 * 1024), 2).alias("total_size_mb"),
    )


def best_active(models: DataFrame, kind: str, score: str, key: str, n: int = 1) -> DataFrame:
    """The ``n`` best active models of each type by score."""
    return top_per_key(models.where(F.col("is_active")), [kind], [F.desc(score), F.asc(key)], n)
