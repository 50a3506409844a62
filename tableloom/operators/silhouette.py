"""The Euclidean silhouette of labelled rows, with bounds, from summaries of small blocks instead of all pairs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .neighbors import curve_key
from .stats import column_stats
from .windows import with_position

#: Blocks of a cluster; one with no more rows than that is exact.
BLOCKS = 256
#: Columns that order rows into blocks, and numbers of all block centres together.
ORDER_COLUMNS, MOST_NUMBERS = 10, 20_000_000


@dataclass
class Silhouette:
    """The mean silhouette, which lies between ``low`` and ``high`` for certain; equal if all blocks are single spots."""

    score: float | None
    low: float | None
    high: float | None


def _widths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    top = np.maximum(a, b)
    return np.where(top > 0, (b - a) / np.where(top > 0, top, 1.0), 0.0)


def euclidean_silhouette(df: DataFrame, names: Sequence[str], label: str = "cluster", blocks: int = BLOCKS) -> Silhouette:
    """Silhouette of the rows whose ``label`` is not -1 (noise).

    Each cluster is laid along a space-filling curve over its widest columns and cut into at most ``blocks`` blocks of equal
    size, of which centre, count and spread are kept. The mean distance of a row to a block lies between the distance to its
    centre (Jensen's inequality) and the root of that squared plus the spread. So sums over blocks bound a row's mean
    distance to a cluster, and with it the silhouette, which falls with the distance to its own cluster and rises with
    that to the nearest other. The score takes the middle of both bounds. Rows are scored in Arrow batches against the
    block summaries, at most ``MOST_NUMBERS`` numbers. Fewer than two clusters have no score; a row alone in its cluster has 0.
    """
    names = list(names)
    rows = df.where(F.col(label) != -1).select(F.col(label).alias("_label"), *[F.col(c).cast("double").alias(f"_x{j}") for j, c in enumerate(names)])
    columns = [f"_x{j}" for j in range(len(names))]
    sizes = {r["_label"]: r["n"] for r in rows.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return Silhouette(None, None, None)
    blocks = max(1, min(blocks, MOST_NUMBERS // (len(sizes) * len(columns))))
    stats = column_stats(rows, columns, "min", "max", "var_pop")
    widest = sorted(columns, key=lambda c: -stats[c]["var_pop"])[:ORDER_COLUMNS]
    z = curve_key(widest, [stats[c]["min"] for c in widest], [stats[c]["max"] for c in widest])
    n_of = F.create_map(*[F.lit(v) for pair in sizes.items() for v in pair])[F.col("_label")]
    placed = with_position(rows.withColumn("_z", z), ["_z", *columns], ["_label"], "_pos", plain_rows=0)
    placed = placed.withColumn("_block", F.floor(F.col("_pos") * F.least(n_of, F.lit(blocks)) / n_of))
    table = placed.groupBy("_label", "_block").agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in columns], sum((F.var_pop(c) for c in columns), F.lit(0.0)).alias("spread")
    ).toPandas()
    labels = sorted(sizes)
    summaries = []
    for v in labels:
        part = table[table["_label"] == v].sort_values("_block")
        summaries.append((part[columns].to_numpy(float), part["n"].to_numpy(float), np.maximum(part["spread"].to_numpy(float), 0.0)))
    shared = df.sparkSession.sparkContext.broadcast((labels, summaries))

    @F.pandas_udf("struct<mid: double, low: double, high: double>")
    def score(own: pd.Series, *cols: pd.Series) -> pd.DataFrame:
        labels, summaries = shared.value
        x, spot = np.column_stack([c.to_numpy(float) for c in cols]), np.searchsorted(labels, own.to_numpy())
        out = np.zeros((len(x), 3))
        for k in range(0, len(x), 256):
            some, home = x[k:k + 256], spot[k:k + 256]
            least, most = np.zeros((2, len(some), len(labels)))
            for j, (centre, n, spread) in enumerate(summaries):
                gaps = np.zeros((len(some), len(centre)))
                for c in range(some.shape[1]):
                    step = some[:, c][:, None] - centre[:, c][None, :]
                    gaps += step * step
                least[:, j], most[:, j] = np.sqrt(gaps) @ n, np.sqrt(gaps + spread) @ n
            counts = np.array([n.sum() for _, n, _ in summaries])
            at = np.arange(len(some))
            others = np.maximum(counts[home] - 1, 1)
            a_low, a_high = least[at, home] / others, most[at, home] / others
            least, most = least / counts, most / counts
            least[at, home] = most[at, home] = np.inf
            b_low, b_high = least.min(axis=1), most.min(axis=1)
            alone = counts[home] <= 1
            for c, (a, b) in enumerate((((a_low + a_high) / 2, (b_low + b_high) / 2), (a_high, b_low), (a_low, b_high))):
                out[k:k + 256, c] = np.where(alone, 0.0, _widths(a, b))
        return pd.DataFrame(out, columns=["mid", "low", "high"])

    scored = rows.select(score("_label", *columns).alias("s")).agg(*[F.avg(f"s.{c}").alias(c) for c in ("mid", "low", "high")]).collect()[0]
    return Silhouette(scored["mid"], scored["low"], scored["high"])
