"""Grouped, bucketed and ranked summaries behind dashboards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import decade_label, range_label, step_floor

# Price ranges (label, inclusive low, exclusive high or None).
PRICE_RANGES = (
    ("$200K-$400K", 200_000, 400_000),
    ("$400K-$600K", 400_000, 600_000),
    ("$600K-$800K", 600_000, 800_000),
    ("$800K-$1M", 800_000, 1_000_000),
    ("$1M+", 1_000_000, None),
)


def histogram(df: DataFrame, value: str, ranges: Sequence[tuple] = PRICE_RANGES) -> DataFrame:
    """Count per fixed range in one pass; empty ranges keep a zero row."""
    x = F.col(value)
    aggs = []
    for i, (label, low, high) in enumerate(ranges):
        inside = (x >= low) if high is None else (x >= low) & (x < high)
        aggs.append(F.struct(F.lit(label).alias("range"), F.count_if(inside).alias("count")).alias(f"r{i}"))
    one = df.agg(*aggs)
    return one.select(F.explode(F.array(*[F.col(f"r{i}") for i in range(len(ranges))])).alias("r")).select("r.*")


def count_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("name")).agg(F.count(F.lit(1)).alias("value"))


def price_by_decade(df: DataFrame, price: str, year: str) -> DataFrame:
    return df.groupBy(decade_label(F.col(year)).alias("decade")).agg(
        F.round(F.avg(price)).alias("avg_price"), F.count(F.lit(1)).alias("count")
    )


def size_bands(df: DataFrame, price: str, size: str, rating: str, low: float, high: float, step: int = 500, n: int = 10) -> DataFrame:
    """Average price and rating per size band of rows inside a price filter; first bands only."""
    return (
        df.filter(F.col(price).between(low, high))
        .groupBy(step_floor(F.col(size), step).alias("_low"))
        .agg(
            F.first(range_label(F.col(size), step)).alias("range"),
            F.round(F.avg(price)).alias("avg_price"),
            F.round(F.avg(rating), 1).alias("avg_rating"),
            F.count(F.lit(1)).alias("count"),
        )
        .orderBy("_low")
        .limit(n)
        .drop("_low")
    )


def headline(df: DataFrame, entries: Sequence[tuple[str, Column]]) -> DataFrame:
    """Named whole-table aggregates as (name, value) rows, from one pass."""
    one = df.agg(*[e.cast("double").alias(f"v{i}") for i, (_, e) in enumerate(entries)])
    rows = F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"v{i}").alias("value")) for i, (n, _) in enumerate(entries)])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def yearly(df: DataFrame, year: str, outputs: dict[str, Column], last: int = 20) -> DataFrame:
    """Aggregates per year, the latest ``last`` years in rising order."""
    per_year = df.groupBy(F.col(year).cast("string").alias("year")).agg(*[c.alias(n) for n, c in outputs.items()])
    return per_year.orderBy(F.desc(F.col("year").cast("int"))).limit(last).orderBy(F.col("year").cast("int"))


def display_name(x: Column) -> Column:
    """Upper case, with the first underscore as a blank."""
    return F.upper(F.regexp_replace(x, r"^([^_]*)_", "$1 "))


def usage(df: DataFrame, model: str) -> DataFrame:
    return df.groupBy(display_name(F.col(model)).alias("model")).agg(F.count(F.lit(1)).alias("count"))


def confidence_trend(df: DataFrame, order: Sequence[Column], confidence: Column, n: int = 10) -> DataFrame:
    """The latest ``n`` confidences in percent, numbered from the latest, oldest first."""
    from pyspark.sql import Window

    latest = df.orderBy(*order).limit(n)
    numbered = latest.withColumn("prediction", F.row_number().over(Window.orderBy(*order)).cast("bigint"))
    return numbered.select("prediction", F.round(confidence * 100, 1).alias("confidence")).orderBy(F.desc("prediction"))


def prediction_summary(df: DataFrame, value: str, confidence: Column, model: str) -> DataFrame:
    """Totals, averages and the most used model (ties to the smaller name)."""
    per_model = df.groupBy(model).agg(
        F.count(F.lit(1)).alias("n"), F.sum(value).alias("sv"), F.sum(confidence).alias("sc")
    )
    return per_model.agg(
        F.sum("n").alias("total"),
        F.round(F.sum("sv") / F.sum("n")).alias("avg_prediction"),
        F.round(F.sum("sc") / F.sum("n"), 3).alias("avg_confidence"),
        F.min_by(model, F.struct(-F.col("n"), F.col(model))).alias("most_used"),
    )


def daily_series(df: DataFrame, at: str, value: str, days: int = 30) -> DataFrame:
    """Count and average per day over the latest ``days`` days; days without rows are kept."""
    day = F.to_date(F.col(at))
    per_day = df.groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 2).alias("avg_value"))
    last = df.agg(F.max(day).alias("last"))
    calendar = last.select(F.explode(F.sequence(F.date_sub("last", days - 1), F.col("last"))).alias("day"))
    return calendar.join(per_day, "day", "left").select("day", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), "avg_value")
