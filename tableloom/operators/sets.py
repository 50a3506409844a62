"""Set operations and sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def history_head(first: DataFrame, second: DataFrame, order: Sequence[str], n: int = 20) -> DataFrame:
    """Rows of ``first``, then of ``second``, each in order; the first ``n``."""
    both = first.withColumn("_source", F.lit(0)).unionByName(second.withColumn("_source", F.lit(1)))
    return both.orderBy("_source", *order).limit(n).drop("_source")


def append(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b)


def key_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def shared_keys(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def unmatched_keys(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def _order(key: Sequence[str], seed: int):
    return F.xxhash64(*[F.col(k) for k in key], F.lit(seed))


def sample_without(df: DataFrame, n: int, key: Sequence[str], seed: int = 42) -> DataFrame:
    """``n`` rows without replacement, the same ones on every run: a top-n by seeded hash."""
    return df.orderBy(_order(key, seed), *key).limit(n)


def sample_with(df: DataFrame, share: float, seed: int = 42) -> DataFrame:
    """Sample with replacement of about ``share`` of the rows (Poisson counts per row)."""
    return df.sample(withReplacement=True, fraction=share, seed=seed)


def shuffled(df: DataFrame, key: Sequence[str], seed: int = 42) -> DataFrame:
    """All rows in a seeded random order (a distributed sort by hash)."""
    return df.orderBy(_order(key, seed), *key)
