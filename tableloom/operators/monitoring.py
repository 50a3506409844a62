"""Model monitoring: thresholds, degradation, histories, trends and configuration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .windows import top_per_key

# Threshold keys, the metrics they bound, settings and history lengths.
BELOW = {"min_r2": "r2", "min_accuracy": "accuracy"}
ABOVE = {"max_rmse": "rmse", "max_mae": "mae"}
THRESHOLD_KEYS = ("min_r2", "max_rmse", "max_mae", "min_accuracy", "max_error_rate", "performance_degradation_percent")
DEGRADING = ("r2", "accuracy")
SETTINGS = {
    "check_interval_hours": "24", "min_samples_for_retrain": "100",
    "auto_retrain_enabled": "true", "notification_enabled": "true",
}
CHECKS_KEPT, RETRAINS_KEPT, TREND_LENGTH = 100, 50, 10
ERROR_METRICS = ("rmse", "mae")
VIOLATION = "struct<metric:string,kind:string,current:double,threshold:double,degradation_percent:double>"


def violations(metrics: str = "metrics", thresholds: str = "thresholds", baseline: str | None = None) -> Column:
    """Array of violations of one row holding metric, threshold and baseline maps.

    Row-local, so the same expression serves a batch and a stream.
    """
    m, t = F.col(metrics), F.col(thresholds)
    found = []

    def entry(metric, kind, current, threshold, degradation=None):
        return F.struct(
            F.lit(metric).alias("metric"), F.lit(kind).alias("kind"), current.alias("current"), threshold.alias("threshold"),
            (degradation if degradation is not None else F.lit(None).cast("double")).alias("degradation_percent"),
        )

    for key, metric in BELOW.items():
        found.append(F.when(m[metric] < t[key], entry(metric, "below_minimum", m[metric], t[key])))
    for key, metric in ABOVE.items():
        found.append(F.when(m[metric] > t[key], entry(metric, "above_maximum", m[metric], t[key])))
    if baseline is not None:
        b, key = F.col(baseline), "performance_degradation_percent"
        for metric in DEGRADING:
            lost = degradation(m[metric], b[metric])
            found.append(F.when(lost > t[key], entry(metric, "performance_degradation", m[metric], t[key], lost)))
    return F.array_compact(F.array(*found)).cast(f"array<{VIOLATION}>")


def degradation(current: Column, baseline: Column) -> Column:
    return F.try_divide(baseline - current, baseline) * 100


def check(metrics: DataFrame, thresholds: DataFrame, model: str, baseline: DataFrame | None = None) -> DataFrame:
    """Metric rows with their violations, the retrain flag and the recommendation."""
    out = metrics.join(thresholds, model)
    if baseline is not None:
        out = out.join(baseline, model, "left")
    out = out.withColumn("violations", violations(baseline="baseline" if baseline is not None else None))
    return out.withColumns({"retrain_needed": F.size("violations") > 0, "recommendation": recommendation(F.col("violations"))})


def recommendation(found: Column) -> Column:
    def text(v: Column) -> Column:
        degraded = F.format_string("%s degraded by %.1f%%", v["metric"], v["degradation_percent"])
        side = F.when(v["kind"] == "below_minimum", F.lit("below")).otherwise(F.lit("above"))
        bound = F.format_string("%s (%.4f) %s threshold (%.4f)", v["metric"], v["current"], side, v["threshold"])
        return F.when(v["kind"] == "performance_degradation", degraded).otherwise(bound)

    listed = F.concat_ws("; ", F.transform(found, text))
    head = F.format_string("Retraining recommended due to %d threshold violation(s): ", F.size(found))
    return F.when(F.size(found) > 0, F.concat(head, listed)).otherwise(
        F.lit("No retraining needed - performance within acceptable thresholds")
    )


def recent(history: DataFrame, model: str, at: str, tie: str, n: int = CHECKS_KEPT) -> DataFrame:
    """The last ``n`` records of each model."""
    return top_per_key(history, [model], [F.desc(at), F.desc(tie)], n)


def trends(history: DataFrame, model: str, at: str, tie: str, metrics: Sequence[str] = ("r2", "rmse", "mae", "accuracy"), n: int = TREND_LENGTH) -> DataFrame:
    """Current value, average and direction per metric over each model's last records."""
    last = recent(history, model, at, tie, n)
    order = F.struct(at, tie)
    long = last.select(
        model, order.alias("_at"),
        F.explode(F.array(*[F.struct(F.lit(x).alias("metric"), F.col("metrics")[x].alias("value")) for x in metrics])).alias("e"),
    ).select(model, "_at", "e.metric", "e.value").where("value IS NOT NULL")
    per = long.groupBy(model, "metric").agg(
        F.max_by("value", "_at").alias("current"), F.min_by("value", "_at").alias("_first"),
        F.avg("value").alias("average"), F.count("value").alias("samples"),
    ).where("samples >= 2")
    rising = F.col("current") > F.col("_first")
    falling = F.col("current") < F.col("_first")
    improving = F.when(F.col("metric").isin(*ERROR_METRICS), falling).otherwise(rising)
    return per.select(
        model, "metric", "current", "average",
        F.when(improving, F.lit("improving")).otherwise(F.lit("degrading")).alias("trend"), "samples",
    )


def current_config(updates: DataFrame, model: str, at: str, tie: str) -> DataFrame:
    """Per model the latest value of every threshold and setting, over the defaults.

    ``updates`` is an append-only table (model, section, key, value, time). Threshold keys that
    are not known are left out; the latest update of a key wins.
    """
    known = updates.where((F.col("section") != "thresholds") | F.col("key").isin(*THRESHOLD_KEYS))
    latest = known.groupBy(model, "section", "key").agg(F.max_by("value", F.struct(at, tie)).alias("value"))
    # at most one entry per known key, so the collected lists are bounded
    per = latest.groupBy(model).agg(
        F.collect_list(F.when(F.col("section") == "thresholds", F.struct("key", "value"))).alias("t"),
        F.collect_list(F.when((F.col("section") == "settings") & F.col("key").isin(*SETTINGS), F.struct("key", "value"))).alias("s"),
        F.max(F.when(F.col("section") == "status", F.col("value"))).alias("status"),
    )
    defaults = F.create_map(*[F.lit(x) for kv in SETTINGS.items() for x in kv])
    given = F.map_from_entries("s")
    settings = F.map_concat(
        F.map_filter(defaults, lambda k, v: ~F.map_contains_key(given, k)), given
    )
    return per.select(
        model,
        F.transform_values(F.map_from_entries("t"), lambda k, v: v.cast("double")).alias("thresholds"),
        settings.alias("settings"),
        F.coalesce("status", F.lit("active")).alias("status"),
    )


def invalid_keys(updates: DataFrame) -> DataFrame:
    return updates.where((F.col("section") == "thresholds") & ~F.col("key").isin(*THRESHOLD_KEYS))


def accepted_retrains(requests: DataFrame, config: DataFrame, model: str) -> DataFrame:
    """Retrain requests of configured models with automatic retraining on, as log rows."""
    enabled = config.where(F.col("settings")["auto_retrain_enabled"] == "true").select(model)
    return requests.join(enabled, model, "left_semi").withColumns(
        {"trigger": F.coalesce(F.col("trigger"), F.lit("manual")), "status": F.lit("triggered")}
    )


def monitored_models(config: DataFrame, checks: DataFrame, retrains: DataFrame, model: str, at: str) -> DataFrame:
    """Status, last check and totals (of the kept histories) per configured model."""
    done = checks.groupBy(model).agg(F.max(at).alias("last_check"), F.least(F.count(F.lit(1)), F.lit(CHECKS_KEPT)).alias("total_checks"))
    again = retrains.groupBy(model).agg(F.least(F.count(F.lit(1)), F.lit(RETRAINS_KEPT)).alias("total_retrains"))
    zero = F.lit(0).cast("bigint")
    return (
        config.select(model, "status", (F.col("settings")["auto_retrain_enabled"] == "true").alias("auto_retrain_enabled"))
        .join(done, model, "left").join(again, model, "left")
        .withColumns({c: F.coalesce(c, zero).cast("bigint") for c in ("total_checks", "total_retrains")})
    )
