"""Projection and column-role operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.scalars import finite_or_null
from .stats import numeric_columns

# Target names tried in order, and the default property features.
TARGET_NAMES = ("target", "actual_price", "price", "y")
PROPERTY_FEATURES = (
    "bedrooms", "bathrooms", "sqft", "year_built", "lot_size",
    "school_rating", "crime_rate", "walkability_score",
)
CLASSIFICATION_BELOW = 10


def select_features(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Exactly the named features; the error lists every missing one."""
    missing = [f for f in features if f not in df.columns]
    if missing:
        raise ValueError(f"features not found: {missing}")
    return df.select(*[F.col(f"`{f}`") for f in features])


def available_features(df: DataFrame, features: Sequence[str] | None = None) -> list[str]:
    """The wanted features that exist; all numeric columns where none is wanted."""
    if features:
        found = [f for f in features if f in df.columns]
    else:
        found = numeric_columns(df)
    if not found:
        raise ValueError("no usable feature columns")
    return found


def detect_target(df: DataFrame, target: str | None = None) -> str:
    for name in [target] if target else TARGET_NAMES:
        if name in df.columns:
            return name
    raise ValueError("no target column found")


def features_and_target(df: DataFrame, target: str | None = None) -> tuple[DataFrame, str]:
    """Rows without the target column, and the name of the target."""
    name = detect_target(df, target)
    return df.drop(name), name


def select_numeric(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in numeric_columns(df)])


def non_finite_to_null(df: DataFrame) -> DataFrame:
    """NaN and infinities of every float column become missing."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: finite_or_null(F.col(f"`{c}`")) for c in floats}) if floats else df


def task_type(df: DataFrame, target: str) -> str:
    """``classification`` for text or fewer than ten distinct values, else ``regression``.

    At most ten distinct values are ever looked at beyond the distinct step itself.
    """
    if isinstance(df.schema[target].dataType, (T.StringType, T.BooleanType)):
        return "classification"
    distinct = df.select(target).where(F.col(target).isNotNull()).distinct()
    few = distinct.limit(CLASSIFICATION_BELOW).count() < CLASSIFICATION_BELOW
    return "classification" if few else "regression"


def property_ratios(price: Column, sqft: Column, year_built: Column, beds: Column, baths: Column, year: int) -> dict[str, Column]:
    """Derived property columns; a zero divisor gives a missing value."""
    return {
        "price_per_sqft": F.try_divide(price, sqft),
        "age": F.lit(year) - year_built,
        "bed_bath_ratio": F.try_divide(beds, baths),
        "total_rooms": beds + baths,
    }


def flatten(df: DataFrame, paths: dict[str, str]) -> DataFrame:
    """Only the nested paths a consumer needs, as flat columns: ``{alias: 'a.b'}``."""
    return df.select(*[F.col(p).alias(a) for a, p in paths.items()])
