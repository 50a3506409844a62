"""Missing values and category codes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import finite_or_null
from .stats import categorical_columns, medians, numeric_columns
from .windows import with_position


def fill_median(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Missing (or non-finite) numbers become the exact column median."""
    columns = list(columns) if columns is not None else numeric_columns(df)
    clean = df.withColumns({c: finite_or_null(F.col(f"`{c}`")) for c in columns})
    middle = medians(clean, columns)
    known = {c: m for c, m in middle.items() if m is not None}
    return clean.withColumns({c: F.coalesce(F.col(f"`{c}`"), F.lit(m)) for c, m in known.items()})


def modes(df: DataFrame, columns: Sequence[str]) -> dict[str, object]:
    """Most frequent value per column, ties to the smallest.

    Counts are combined map-side per (column, value); the pick is an aggregate, not a sort.
    """
    pairs = F.explode(
        F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])
    )
    counts = (
        df.select(pairs.alias("p")).where("p.value IS NOT NULL").groupBy("p.name", "p.value").count()
    )
    best = counts.groupBy("name").agg(
        F.min_by("value", F.struct(-F.col("count"), F.col("value"))).alias("mode")
    )
    return {r["name"]: r["mode"] for r in best.collect()}


def fill_mode(df: DataFrame, columns: Sequence[str] | None = None, fallback: str = "Unknown") -> DataFrame:
    """Missing categories become the most frequent value, or the fallback where all are missing."""
    columns = list(columns) if columns is not None else categorical_columns(df)
    best = modes(df, columns) if columns else {}
    return df.withColumns(
        {c: F.coalesce(F.col(f"`{c}`"), F.lit(best.get(c) or fallback)) for c in columns}
    )


def category_codes(df: DataFrame, column: str, **sizes) -> DataFrame:
    """The class list of a column: each distinct value with its code in sorted order."""
    distinct = df.select(F.col(column).cast("string").alias(column)).where(F.col(column).isNotNull()).distinct()
    return with_position(distinct, [column], name="code", **sizes)


def label_encode(df: DataFrame, column: str, name: str | None = None, **sizes) -> DataFrame:
    """Add the code of each value; joined on the value, so the class list may be of any size."""
    codes = category_codes(df, column, **sizes).withColumnRenamed(column, "_value")
    codes = codes.withColumnRenamed("code", name or f"{column}_code")
    return df.join(codes, F.col(f"`{column}`").cast("string") == F.col("_value"), "left").drop("_value")


def label_decode(df: DataFrame, code: str, classes: DataFrame, value: str) -> DataFrame:
    """Replace codes by the values of a class list made by :func:`category_codes`."""
    lookup = classes.select(F.col("code").alias("_code"), F.col(value))
    return df.join(lookup, F.col(code) == F.col("_code"), "left").drop("_code")


def known_or(x: Column, default) -> Column:
    return F.coalesce(x, F.lit(default))
