"""Exact k nearest rows in a few dimensions, without forming all pairs.

Copies are folded into one weighted row first. Rows are laid along a space-filling curve and
cut into blocks of equal size, so density does not matter. A row's own block bounds its k-th
distance; the boxes of blocks (and of groups of blocks above them) then rule out every block
that bound cannot reach. Only rows of the few blocks left are compared.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage
from .stats import one_row
from .windows import top_per_key, with_position

BLOCK = 128
FAN = 32
#: Boxes prune in a few columns only; in more of them ``nearest`` refuses and ``nearest_rows`` turns to the forest.
EXACT_COLUMNS = 8
#: Columns that the grid of ``within`` uses, and rows of a cell that meet its neighbours in one share.
GRID_COLUMNS, SHARE_ROWS = 3, 1000


def curve_key(columns: Sequence[str], low: Sequence[float], high: Sequence[float]) -> Column:
    """Interleaved bits of the coordinates on one common scale (a Z-order key), so that
    cells are square in the distance that is asked for."""
    d = len(columns)
    bits = min(20, 62 // d)
    key = F.lit(0).cast("bigint")
    span = max((b - a for a, b in zip(low, high)), default=0.0) or 1.0
    for j, c in enumerate(columns):
        cell = F.least(F.floor((F.col(c) - low[j]) / span * (2**bits)).cast("bigint"), F.lit(2**bits - 1).cast("bigint"))
        for i in range(bits):
            key = key.bitwiseOR(F.shiftleft(F.shiftright(cell, i).bitwiseAND(F.lit(1).cast("bigint")), i * d + j))
    return key


def _squared(a: Sequence[Column], b: Sequence[Column]) -> Column:
    total = F.lit(0.0)
    for x, y in zip(a, b):
        total = total + (x - y) * (x - y)
    return total


def _box_distance(point: Sequence[Column], node: Column) -> Column:
    """Squared distance of a point to a node's box."""
    total = F.lit(0.0)
    for j, x in enumerate(point):
        gap = F.greatest(node[f"lo{j}"] - x, x - node[f"hi{j}"], F.lit(0.0))
        total = total + gap * gap
    return total


def _block_bound(m: int, d: int):
    """Per block: squared distance within which a row is sure to see ``m`` rows (with copies)."""

    def bound(rows: pd.DataFrame) -> pd.DataFrame:
        x = rows[[f"x{j}" for j in range(d)]].to_numpy(float)
        weight = rows["weight"].to_numpy(float)
        gaps = np.zeros((len(x), len(x)))
        for j in range(d):
            step = x[:, None, j] - x[None, :, j]
            gaps += step * step
        order = np.argsort(gaps, axis=1, kind="stable")
        reach = np.cumsum(weight[order], axis=1) >= m
        first = reach.argmax(axis=1)
        picked = gaps[np.arange(len(x)), order[np.arange(len(x)), first]]
        rows = rows.assign(bound=np.where(reach[:, -1], picked, np.inf))
        return rows.loc[rows["is_query"], [f"x{j}" for j in range(d)] + ["block", "bound"]]

    return bound


def nearest(
    points: DataFrame,
    key: str,
    columns: Sequence[str],
    k: int,
    queries: DataFrame | None = None,
    query_key: str | None = None,
    block_rows: int = BLOCK,
    **sizes,
) -> DataFrame:
    """(id, neighbour, distance, rank): the ``k`` nearest points of every query row.

    Without ``queries`` every point is a query and is not its own neighbour. Ties go to the
    smaller key. Rows with a missing coordinate are left out. More than ``EXACT_COLUMNS`` columns
    are refused, as every row would be compared with every other.
    """
    d = len(columns)
    if d > EXACT_COLUMNS:
        raise ValueError(f"exact neighbours in more than {EXACT_COLUMNS} columns compare all pairs: use nearest_approximate")
    names = [f"x{j}" for j in range(d)]
    own = queries is None
    m = k + 1 if own else k
    base = points.dropna(subset=list(columns)).select(
        F.col(key).alias("id"), *[F.col(c).cast("double").alias(n) for c, n in zip(columns, names)]
    )
    asked = base if own else queries.dropna(subset=list(columns)).select(
        F.col(query_key or key).alias("id"), *[F.col(c).cast("double").alias(n) for c, n in zip(columns, names)]
    )
    # distinct coordinates: copy count and the m smallest keys, which are all that can be asked for
    weights = base.groupBy(*names).agg(F.count(F.lit(1)).alias("weight"))
    few = top_per_key(base, names, [F.asc("id")], m) if m <= 1000 else base
    keys = few.groupBy(*names).agg(F.array_sort(F.collect_list("id")).alias("ids"))
    folded = weights.join(keys, names).withColumn("is_query", F.lit(own))
    if not own:
        spots = asked.select(*names).distinct()
        empty = F.lit(None).cast(folded.schema["ids"].dataType)
        folded = (
            folded.unionByName(spots.select(*names, F.lit(0).cast("bigint").alias("weight"), empty.alias("ids"), F.lit(True).alias("is_query")))
            .groupBy(*names)
            .agg(F.sum("weight").alias("weight"), F.max("ids").alias("ids"), F.max("is_query").alias("is_query"))
        )
    box = one_row(folded, *[F.min(n).alias(f"lo{n}") for n in names], *[F.max(n).alias(f"hi{n}") for n in names])
    if box[f"lo{names[0]}"] is None:
        raise ValueError("no rows with coordinates")
    z = curve_key(names, [box[f"lo{n}"] for n in names], [box[f"hi{n}"] for n in names])
    placed = with_position(folded.withColumn("_z", z), ["_z", *names], name="_pos", **sizes)
    placed = cut_lineage(placed.withColumn("block", F.expr(f"_pos div {block_rows}")).drop("_z", "_pos"))

    schema = ", ".join(f"{n} double" for n in names) + ", block bigint, bound double"
    bounded = placed.select(*names, "block", "weight", "is_query").groupBy("block").applyInPandas(_block_bound(m, d), schema)

    leaf = placed.where("weight > 0").groupBy("block").agg(
        *[F.min(n).alias(f"lo{j}") for j, n in enumerate(names)], *[F.max(n).alias(f"hi{j}") for j, n in enumerate(names)],
        F.sum("weight").alias("rows"),
    ).withColumnRenamed("block", "node")
    levels = [cut_lineage(leaf)]
    while levels[-1].select(F.lit(1)).limit(FAN + 1).count() > FAN:
        up = levels[-1].groupBy(F.expr(f"node div {FAN}").alias("node")).agg(
            *[F.min(f"lo{j}").alias(f"lo{j}") for j in range(d)], *[F.max(f"hi{j}").alias(f"hi{j}") for j in range(d)],
            F.sum("rows").alias("rows"),
        )
        levels.append(cut_lineage(up))

    xs = [F.col(n) for n in names]
    # a block with too few rows bounds the distance by the far corner of an ancestor instead
    bounded = _bound_from_ancestors(bounded, levels, xs, m)
    fields = ["node", *[f"lo{j}" for j in range(d)], *[f"hi{j}" for j in range(d)]]
    top = levels[-1].select(*fields).collect()  # at most FAN rows
    literal = F.array(*[F.struct(*[F.lit(r[f]).alias(f) for f in fields]) for r in top])
    reached = _within(bounded, literal, names, xs)
    for level in reversed(levels[:-1]):
        children = level.groupBy(F.expr(f"node div {FAN}").alias("_parent")).agg(F.collect_list(F.struct(*fields)).alias("_kids"))
        joined = reached.withColumnRenamed("node", "_parent").join(children, "_parent")
        reached = _within(joined, F.col("_kids"), names, xs)

    # only rows of reached blocks meet, and a pair leaves the join only within the bound
    members = placed.where("weight > 0").select(F.col("block").alias("node"), *[F.col(n).alias(f"y{j}") for j, n in enumerate(names)], "ids")
    gap = _squared(xs, [F.col(f"y{j}") for j in range(d)])
    hits = reached.join(members, "node").withColumn("d2", gap).where(F.col("d2") <= F.col("bound"))
    found = hits.select(*names, "d2", F.explode("ids").alias("neighbour"))
    best = top_per_key(found, names, [F.asc("d2"), F.asc("neighbour")], m)

    rows = asked.join(best, names)
    if own:
        rows = rows.where(F.col("id") != F.col("neighbour"))
    window = Window.partitionBy("id").orderBy("d2", "neighbour")
    return (
        rows.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)
        .select("id", "neighbour", F.sqrt("d2").alias("distance"), "rank")
    )


def nearest_rows(points: DataFrame, key: str, columns: Sequence[str], k: int, queries: DataFrame | None = None, query_key: str | None = None) -> DataFrame:
    """``nearest`` for up to ``EXACT_COLUMNS`` columns, ``nearest_approximate`` for more."""
    if len(columns) <= EXACT_COLUMNS:
        return nearest(points, key, columns, k, queries, query_key)
    from .approximate import nearest_approximate

    return nearest_approximate(points, key, columns, k, queries, query_key)


def within(points: DataFrame, key: str, columns: Sequence[str], eps: float) -> DataFrame:
    """(id, neighbour, distance) of all pairs of rows, id < neighbour, that lie within ``eps`` of each other.

    Rows meet by the cells of a grid of width ``eps`` over the first columns (three at most), each pair of cells once;
    the distance in all columns decides. A cell with many rows is dealt out in shares, each of which meets the rows
    around it apart, so a dense spot is no hot key. Keys are unique; rows with a missing coordinate are left out.
    """
    if eps < 0:
        raise ValueError("a distance is not negative")
    names = [f"x{j}" for j in range(len(columns))]
    grid = names[:GRID_COLUMNS]
    width = max(eps, 1e-12) * (1 + 1e-9)  # so that rounding puts no pair two cells apart
    rows = points.dropna(subset=list(columns)).select(
        F.col(key).alias("id"), *[F.col(c).cast("double").alias(n) for c, n in zip(columns, names)]
    ).withColumn("cell", F.array(*[F.floor(F.col(n) / width) for n in grid]))
    counts = cut_lineage(rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / SHARE_ROWS).cast("int").alias("shares")))
    dealt = rows.join(counts, "cell").withColumn("share", F.pmod(F.xxhash64("id"), F.col("shares"))).drop("shares")
    steps = [[]]
    for _ in grid:
        steps = [s + [i] for s in steps for i in (-1, 0, 1)]
    steps = [s for s in steps if s >= [0] * len(grid)]  # a cell itself and those after it: the others look back
    around = F.array(*[F.array(*[F.col("cell")[j] + i for j, i in enumerate(s)]) for s in steps])
    moved = rows.select(F.col("id").alias("other"), F.col("cell").alias("own"), *[F.col(n).alias(f"y{j}") for j, n in enumerate(names)], F.explode(around).alias("cell"))
    moved = moved.join(counts, "cell").select("*", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share")).drop("shares")
    d2 = _squared([F.col(n) for n in names], [F.col(f"y{j}") for j in range(len(names))])
    met = dealt.withColumnRenamed("cell", "home").join(moved, (F.col("home") == F.col("cell")) & (dealt["share"] == moved["share"]))
    met = met.where((F.col("home") != F.col("own")) | (F.col("id") < F.col("other"))).withColumn("d2", d2).where(F.col("d2") <= float(eps) ** 2)
    return met.select(F.least("id", "other").alias("id"), F.greatest("id", "other").alias("neighbour"), F.sqrt("d2").alias("distance"))


def _within(rows: DataFrame, nodes: Column, names, xs) -> DataFrame:
    close = F.filter(nodes, lambda n: _box_distance(xs, n) <= F.col("bound"))
    return rows.select(*names, "bound", F.explode(F.transform(close, lambda n: n["node"])).alias("node"))


def _bound_from_ancestors(rows: DataFrame, levels: Sequence[DataFrame], xs: Sequence[Column], m: int) -> DataFrame:
    """Finite bounds for rows whose own block holds fewer than ``m`` points."""
    out = rows
    for i, level in enumerate(levels):
        node = F.expr(f"block div {FAN ** i}")
        far = F.lit(0.0)
        for j, x in enumerate(xs):
            gap = F.greatest(F.abs(x - F.col(f"_lo{j}")), F.abs(x - F.col(f"_hi{j}")))
            far = far + gap * gap
        side = level.select(
            F.col("node").alias("_node"), F.col("rows").alias("_n"),
            *[F.col(f"lo{j}").alias(f"_lo{j}") for j in range(len(xs))], *[F.col(f"hi{j}").alias(f"_hi{j}") for j in range(len(xs))],
        )
        joined = out.join(side, node == F.col("_node"), "left")
        better = F.when((F.col("bound") == float("inf")) & (F.col("_n") >= m), far).otherwise(F.col("bound"))
        out = joined.withColumn("bound", better).select(*rows.columns)
    return out


def knn_predict(train: DataFrame, rows: DataFrame, key: str, features: Sequence[str], target: str, k: int = 5, classify: bool = False) -> DataFrame:
    """Mean (or most frequent, ties to the smaller) target of the k nearest training rows."""
    pairs = nearest_rows(train, key, features, k, queries=rows, query_key=key)
    labelled = pairs.join(train.select(F.col(key).alias("neighbour"), F.col(target).alias("_y")), "neighbour")
    if not classify:
        out = labelled.groupBy("id").agg(F.avg("_y").alias("prediction"))
    else:
        votes = labelled.groupBy("id", "_y").agg(F.count(F.lit(1)).alias("_n"))
        out = votes.groupBy("id").agg(F.min_by("_y", F.struct(-F.col("_n"), F.col("_y"))).alias("prediction"))
    return out.withColumnRenamed("id", key)
