"""Density clustering: DBSCAN on a grid, and mean shift."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product
from math import ceil, sqrt

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage
from .components import connected_components
from .neighbors import nearest
from .stats import exact_quantiles
from .windows import with_position

MAX_GRID_DIMENSIONS = 3


def _gap2(a: Sequence[Column], b: Sequence[Column]) -> Column:
    total = F.lit(0.0)
    for x, y in zip(a, b):
        total = total + (x - y) * (x - y)
    return total


def _offsets(d: int) -> list[tuple[int, ...]]:
    """Neighbour cells that can hold a point within the radius, for cells of side radius / √d."""
    reach = ceil(sqrt(d))
    out = []
    for step in product(range(-reach, reach + 1), repeat=d):
        if sum(max(abs(s) - 1, 0) ** 2 for s in step) < d:
            out.append(step)
    return out


def dbscan(df: DataFrame, key: str, columns: Sequence[str], eps: float = 0.5, min_samples: int = 5, **sizes) -> DataFrame:
    """(key, cluster, is_core) with noise as -1, the same clusters as the textbook algorithm.

    Cells have side eps/√d, so a cell with ``min_samples`` rows holds only core rows and needs
    no comparisons. Rows of sparser cells, fewer than ``min_samples`` each, are compared with
    the neighbouring cells, which is linear in the rows. Two dense cells are linked by refining
    sub-cells until their boxes decide, never by pairing their rows.
    """
    d = len(columns)
    if d > MAX_GRID_DIMENSIONS:
        raise ValueError(f"project to at most {MAX_GRID_DIMENSIONS} columns first (reduce_dimensions)")
    names, cells = [f"x{j}" for j in range(d)], [f"c{j}" for j in range(d)]
    side = eps / sqrt(d)
    rows = df.dropna(subset=list(columns)).select(
        F.col(key).alias("id"), *[F.col(c).cast("double").alias(n) for c, n in zip(columns, names)]
    )
    folded = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("weight"), F.min("id").alias("point"))
    folded = folded.withColumns({c: F.floor(F.col(n) / side).cast("bigint") for c, n in zip(cells, names)})
    totals = folded.groupBy(*cells).agg(F.sum("weight").alias("cell_weight"), F.min("point").alias("cell_point"))
    points = cut_lineage(folded.join(totals, cells).withColumn("dense", F.col("cell_weight") >= min_samples))

    sparse = points.where(~F.col("dense"))
    steps = F.explode(F.array(*[F.struct(*[F.lit(s[j]).alias(f"s{j}") for j in range(d)]) for s in _offsets(d)]))
    looking = sparse.select(F.col("point").alias("p"), *[F.col(n).alias(f"p{n}") for n in names], *cells, steps.alias("s")).select(
        "p", *[f"p{n}" for n in names], *[(F.col(c) + F.col(f"s.s{j}")).alias(c) for j, c in enumerate(cells)]
    )
    seen = points.select(*cells, *names, "weight", "point", "dense", "cell_point")
    close = _gap2([F.col(f"p{n}") for n in names], [F.col(n) for n in names]) <= eps * eps
    pairs = cut_lineage(
        looking.join(seen, cells).where(close).select("p", F.col("point").alias("q"), "weight", F.col("dense").alias("q_dense"), "cell_point")
    )
    counts = pairs.groupBy("p").agg(F.sum("weight").alias("around"))
    sparse_core = cut_lineage(counts.where(F.col("around") >= min_samples).select("p"))

    # a node is a dense cell (named by its smallest row) or a core row of a sparse cell
    to_core = pairs.join(sparse_core.select(F.col("p").alias("q")).withColumn("q_core", F.lit(True)), "q", "left")
    to_core = to_core.where(F.col("q_dense") | F.coalesce("q_core", F.lit(False))).select(
        "p", F.when(F.col("q_dense"), F.col("cell_point")).otherwise(F.col("q")).alias("node")
    )
    to_core = cut_lineage(to_core.distinct())
    edges = to_core.join(sparse_core, "p", "left_semi").select(F.col("p").alias("a"), F.col("node").alias("b"))
    edges = edges.union(_dense_links(points.where("dense"), names, cells, side, eps))
    dense_nodes = points.where("dense").select(F.col("cell_point").alias("node")).distinct()
    nodes = dense_nodes.union(sparse_core.select(F.col("p").alias("node")))
    component = cut_lineage(connected_components(nodes, edges))

    # clusters are numbered by their first core row; a border row joins the first cluster it touches
    order = with_position(component.groupBy("component").agg(F.min("node").alias("_first")), ["_first"], name="cluster", **sizes)
    numbered = component.join(order.select("component", "cluster"), "component").select("node", "cluster")
    of_dense = points.where("dense").select("point", F.col("cell_point").alias("node")).join(numbered, "node").select("point", "cluster", F.lit(True).alias("is_core"))
    of_core = sparse_core.select(F.col("p").alias("node")).join(numbered, "node").select(F.col("node").alias("point"), "cluster", F.lit(True).alias("is_core"))
    border = to_core.join(sparse_core, "p", "left_anti").join(numbered, "node").groupBy(F.col("p").alias("point")).agg(F.min("cluster").alias("cluster"))
    labels = of_dense.union(of_core).union(border.select("point", "cluster", F.lit(False).alias("is_core")))
    labelled = points.select(*names, "point").join(labels, "point", "left")
    return rows.join(labelled, names, "left").select(
        F.col("id").alias(key), F.coalesce("cluster", F.lit(-1)).cast("bigint").alias("cluster"), F.coalesce("is_core", F.lit(False)).alias("is_core")
    )


def _dense_links(dense: DataFrame, names, cells, side: float, eps: float, levels: int = 40) -> DataFrame:
    """Pairs of dense cells with at least two rows within eps, by refining boxes."""
    d = len(names)
    forward = [s for s in _offsets(d) if s > (0,) * d]
    steps = F.explode(F.array(*[F.struct(*[F.lit(s[j]).alias(f"s{j}") for j in range(d)]) for s in forward]))
    boxes = dense.groupBy("cell_point", *cells).agg(
        *[F.min(n).alias(f"lo{j}") for j, n in enumerate(names)], *[F.max(n).alias(f"hi{j}") for j, n in enumerate(names)]
    )
    left = boxes.select(
        F.col("cell_point").alias("a"), *[F.col(f"lo{j}").alias(f"alo{j}") for j in range(d)], *[F.col(f"hi{j}").alias(f"ahi{j}") for j in range(d)],
        *cells, steps.alias("s"),
    ).withColumns({c: F.col(c) + F.col(f"s.s{j}") for j, c in enumerate(cells)}).drop("s")
    right = boxes.select(
        F.col("cell_point").alias("b"), *[F.col(f"lo{j}").alias(f"blo{j}") for j in range(d)], *[F.col(f"hi{j}").alias(f"bhi{j}") for j in range(d)], *cells,
    )
    near, far = F.lit(0.0), F.lit(0.0)
    for j in range(d):
        gap = F.greatest(F.col(f"alo{j}") - F.col(f"bhi{j}"), F.col(f"blo{j}") - F.col(f"ahi{j}"), F.lit(0.0))
        span = F.greatest(F.col(f"ahi{j}") - F.col(f"blo{j}"), F.col(f"bhi{j}") - F.col(f"alo{j}"))
        near, far = near + gap * gap, far + span * span
    bound = eps * eps
    open_pairs = left.join(right, cells).where(near <= bound).select("a", "b", (far <= bound).alias("sure"), F.lit(0).cast("bigint").alias("asub"), F.lit(0).cast("bigint").alias("bsub"))
    open_pairs = cut_lineage(open_pairs)
    links = open_pairs.where("sure").select("a", "b").distinct()
    open_pairs = open_pairs.where(~F.col("sure")).drop("sure")
    parts = 1
    for level in range(levels):
        if not open_pairs.select(F.lit(1)).limit(1).count():
            break
        finer = parts * 4
        touched = open_pairs.select(F.col("a").alias("cell_point")).union(open_pairs.select("b")).distinct()

        def sub(n_parts: int) -> Column:
            if n_parts == 1:
                return F.lit(0).cast("bigint")
            if n_parts > 1 << 48:  # finer than the numbers themselves: a part per different point
                return F.xxhash64(*names)
            steps = [F.floor((F.col(n) / side - F.col(c)) * n_parts).cast("bigint") for n, c in zip(names, cells)]
            return F.xxhash64(*[F.greatest(F.lit(0), F.least(s, F.lit(n_parts - 1))) for s in steps])

        subs = dense.join(touched, "cell_point", "left_semi").groupBy("cell_point", sub(parts).alias("up"), sub(finer).alias("sub")).agg(
            *[F.min(n).alias(f"lo{j}") for j, n in enumerate(names)], *[F.max(n).alias(f"hi{j}") for j, n in enumerate(names)]
        )
        a = subs.select(F.col("cell_point").alias("a"), F.col("up").alias("asub"), F.col("sub").alias("anew"), *[F.col(f"lo{j}").alias(f"alo{j}") for j in range(d)], *[F.col(f"hi{j}").alias(f"ahi{j}") for j in range(d)])
        b = subs.select(F.col("cell_point").alias("b"), F.col("up").alias("bsub"), F.col("sub").alias("bnew"), *[F.col(f"lo{j}").alias(f"blo{j}") for j in range(d)], *[F.col(f"hi{j}").alias(f"bhi{j}") for j in range(d)])
        tried = open_pairs.join(a, ["a", "asub"]).join(b, ["b", "bsub"]).where(near <= bound).select(
            "a", "b", (far <= bound).alias("sure"), F.col("anew").alias("asub"), F.col("bnew").alias("bsub")
        )
        tried = cut_lineage(tried)
        found = tried.where("sure").select("a", "b").distinct()
        links = links.union(found)
        open_pairs = tried.where(~F.col("sure")).drop("sure").join(found, ["a", "b"], "left_anti")
        parts = finer
    else:
        raise RuntimeError(f"links are undecided after {levels} levels")
    return links.select("a", "b")


def estimate_bandwidth(df: DataFrame, columns: Sequence[str], share: float = 0.3) -> float:
    """A radius holding about ``share`` of the rows around a typical row, from quartile widths."""
    q = exact_quantiles(df, {c: [0.25, 0.75] for c in columns})
    scale = sqrt(sum(((high - low) / 1.349) ** 2 for low, high in q.values()) / len(columns))
    return max(scale * sqrt(len(columns)) * share * 2, 1e-12)


def mean_shift(df: DataFrame, key: str, columns: Sequence[str], bandwidth: float | None = None, fine: int = 8, rounds: int = 300) -> tuple[DataFrame, DataFrame]:
    """((key, cluster), modes): an approximation on weighted fine bins.

    Rows are folded into bins of side bandwidth/``fine``; seeds start at the occupied coarse
    bins and move to the mean of bins within the bandwidth. Work per seed is bounded by the
    bins around it, however many rows they hold.
    """
    d = len(columns)
    bandwidth = bandwidth or estimate_bandwidth(df, columns)
    names, cells = [f"x{j}" for j in range(d)], [f"c{j}" for j in range(d)]
    rows = df.dropna(subset=list(columns)).select(
        F.col(key), *[F.col(c).cast("double").alias(n) for c, n in zip(columns, names)]
    )
    bins = rows.groupBy(*[F.floor(F.col(n) / (bandwidth / fine)).alias(f"f{j}") for j, n in enumerate(names)]).agg(
        F.count(F.lit(1)).alias("weight"), *[F.avg(n).alias(n) for n in names]
    )
    bins = cut_lineage(bins.select("weight", *names, *[F.floor(F.col(n) / bandwidth).cast("bigint").alias(c) for n, c in zip(names, cells)]))
    seeds = bins.groupBy(*cells).agg(*[(F.sum(F.col(n) * F.col("weight")) / F.sum("weight")).alias(n) for n in names])
    seeds = seeds.select(F.struct(*cells).alias("seed"), *[F.col(n).alias(f"s{n}") for n in names])
    around = F.explode(F.array(*[F.struct(*[F.lit(s[j]).alias(f"s{j}") for j in range(d)]) for s in product((-1, 0, 1), repeat=d)]))
    inside = _gap2([F.col(f"s{n}") for n in names], [F.col(n) for n in names]) <= bandwidth * bandwidth
    for _ in range(rounds):
        asked = seeds.select("seed", *[f"s{n}" for n in names], around.alias("o")).select(
            "seed", *[f"s{n}" for n in names], *[(F.floor(F.col(f"s{n}") / bandwidth) + F.col(f"o.s{j}")).cast("bigint").alias(c) for j, (n, c) in enumerate(zip(names, cells))]
        )
        moved = asked.join(bins, cells).where(inside).groupBy("seed", *[f"s{n}" for n in names]).agg(
            F.sum("weight").alias("weight"), *[(F.sum(F.col(n) * F.col("weight")) / F.sum("weight")).alias(f"t{n}") for n in names]
        )
        moved = cut_lineage(moved)
        shift = moved.agg(F.max(_gap2([F.col(f"s{n}") for n in names], [F.col(f"t{n}") for n in names]))).collect()[0][0]
        seeds = moved.select("seed", "weight", *[F.col(f"t{n}").alias(f"s{n}") for n in names])
        if shift is None or shift < (1e-3 * bandwidth) ** 2:
            break
    else:
        raise RuntimeError(f"seeds still move after {rounds} rounds; raise rounds or the bandwidth")
    # seeds that met are one mode; the heaviest mode of a neighbourhood survives
    merged = seeds.groupBy(*[F.round(F.col(f"s{n}") / (bandwidth * 0.05)).alias(f"r{n}") for n in names]).agg(
        F.max("weight").alias("weight"), *[F.avg(f"s{n}").alias(n) for n in names]
    )
    modes = _strongest(merged, names, bandwidth)
    modes = cut_lineage(with_position(modes, [F.desc("weight"), *names], name="cluster"))
    found = nearest(modes, "cluster", names, 1, queries=rows, query_key=key)
    return found.select(F.col("id").alias(key), F.col("neighbour").alias("cluster")), modes


def _strongest(modes: DataFrame, names: Sequence[str], radius: float) -> DataFrame:
    """Modes without a stronger mode within the radius, decided strongest first.

    Each round settles every mode that beats all of its open neighbours, so chains settle in
    a few parallel rounds. Modes were rounded to a grid, which bounds the neighbours of each.
    """
    d = len(names)
    ranked = cut_lineage(with_position(modes, [F.desc("weight"), *names], name="rank"))
    cells = [f"c{j}" for j in range(d)]
    placed = ranked.withColumns({c: F.floor(F.col(n) / radius).cast("bigint") for c, n in zip(cells, names)})
    around = F.explode(F.array(*[F.struct(*[F.lit(s[j]).alias(f"s{j}") for j in range(d)]) for s in product((-1, 0, 1), repeat=d)]))
    asked = placed.select(F.col("rank").alias("p"), *[F.col(n).alias(f"p{n}") for n in names], *cells, around.alias("o")).withColumns(
        {c: F.col(c) + F.col(f"o.s{j}") for j, c in enumerate(cells)}
    )
    pairs = asked.join(placed.select(*cells, *names, F.col("rank").alias("q")), cells).where(
        (F.col("q") < F.col("p")) & (_gap2([F.col(f"p{n}") for n in names], [F.col(n) for n in names]) <= radius * radius)
    )
    pairs = cut_lineage(pairs.select("p", "q"))
    open_modes, kept = ranked.select("rank"), None
    while True:
        blocked = pairs.join(open_modes.withColumnRenamed("rank", "q"), "q", "left_semi").select(F.col("p").alias("rank"))
        winners = cut_lineage(open_modes.join(blocked, "rank", "left_anti"))
        kept = winners if kept is None else kept.union(winners)
        beaten = pairs.join(winners.withColumnRenamed("rank", "q"), "q", "left_semi").select(F.col("p").alias("rank"))
        open_modes = cut_lineage(open_modes.join(winners, "rank", "left_anti").join(beaten, "rank", "left_anti"))
        if not open_modes.select(F.lit(1)).limit(1).count():
            break
    return ranked.join(kept, "rank", "left_semi").drop("rank")
