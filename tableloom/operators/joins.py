"""Lookups, range joins, membership and column-wise concatenation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, functions as F

BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 16 << 20


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Mark for broadcast only after counting at most ``rows`` rows of ``most_bytes`` together; else leave to Spark."""
    width = sum((F.coalesce(F.length(F.to_json(F.struct(c))), F.lit(0)) for c in df.columns), F.lit(0))
    size = df.limit(rows + 1).select(width.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("w"), F.lit(0)).alias("b")).first()
    return F.broadcast(df) if size["n"] <= rows and size["b"] <= most_bytes else df


def lookup(df: DataFrame, key: str, other: DataFrame, other_key: str, columns: Sequence[str], small_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Left lookup of columns by key; rows without a match keep nulls."""
    side = other.select(F.col(other_key).alias("_k"), *columns)
    return df.join(broadcast_if_small(side, small_rows), F.col(key) == F.col("_k"), "left").drop("_k")


def metric_pairs(left: DataFrame, right: DataFrame, metric: str, value: str) -> DataFrame:
    """Rows of metrics that both sides have: (metric, value_a, value_b)."""
    a = left.select(metric, F.col(value).alias(f"{value}_a"))
    return a.join(right.select(metric, F.col(value).alias(f"{value}_b")), metric)


def to_ranges(df: DataFrame, value: str, ranges: DataFrame, low: str, high: str, label: str, max_ranges: int = 10_000) -> DataFrame:
    """Label of the half-open range each value falls in; null where none does.

    The range table is checked to be small and disjoint. Each value finds its range by a
    binary search over the bounds, then an equi-join brings the label, so no pair of a row
    and a foreign range is ever formed.
    """
    rows = ranges.select(low, high, label).orderBy(low).limit(max_ranges + 1).collect()
    if len(rows) > max_ranges:
        raise ValueError("too many ranges")
    bounds = sorted({float(r[low]) for r in rows} | {float(r[high]) for r in rows if r[high] is not None})
    splits = [float("-inf"), *bounds, float("inf")]
    owner = {}
    for r in rows:
        start = splits.index(float(r[low]))
        end = splits.index(float(r[high])) if r[high] is not None else len(splits) - 1
        for i in range(start, end):
            if i in owner:
                raise ValueError("ranges overlap")
            owner[i] = r[label]
    cut = Bucketizer(splits=splits, inputCol="_x", outputCol="_bucket", handleInvalid="keep")
    bucketed = cut.transform(df.withColumn("_x", F.col(value).cast("double")))
    names = df.sparkSession.createDataFrame(
        [(float(i), v) for i, v in owner.items()], f"_b double, {label} {dict(ranges.dtypes)[label]}"
    )
    return bucketed.join(F.broadcast(names), F.col("_bucket") == F.col("_b"), "left").drop("_x", "_bucket", "_b")


def with_scalars(df: DataFrame, stats: DataFrame) -> DataFrame:
    """Every row with the columns of a one-row aggregate, as scalar subqueries: the values
    are computed once and planted as constants, without any join."""
    return df.withColumns({c: stats.select(c).scalar() for c in stats.columns})


def present(df: DataFrame, key: str, wanted: DataFrame, wanted_key: str) -> DataFrame:
    return df.join(wanted.select(F.col(wanted_key).alias("_k")), F.col(key) == F.col("_k"), "left_semi")


def absent(df: DataFrame, key: str, wanted: DataFrame, wanted_key: str) -> DataFrame:
    return df.join(wanted.select(F.col(wanted_key).alias("_k")), F.col(key) == F.col("_k"), "left_anti")


def side_by_side(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """Column-wise concatenation of two frames that share a row key."""
    return left.join(right, list(key))
