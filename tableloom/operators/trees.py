"""Rows as cells of binned columns, from which trees are grown: a tree tells rows of a cell apart by their target alone."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from math import exp, factorial
from operator import or_

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .passes import beginning
from .stats import one_row

#: Bins of a column, as Spark's trees have them.
BINS = 32
#: Cells up to which rows are summed up by cell; beyond that there is little to sum.
CELLS = 1 << 15
#: Rows that a task draws at once.
DRAWN = 1 << 16
_NODES = "tree int, node int, feature int, cut double, low int, high int, value double, count double, gain double"


def cut_points(values: np.ndarray, most: int = BINS - 1) -> np.ndarray:
    """The middles between neighbouring values, or ``most`` of them that cut the rows into nearly equal parts."""
    found, counts = np.unique(values, return_counts=True)
    middles = (found[:-1] + found[1:]) / 2
    if len(middles) <= most:
        return middles
    before = np.cumsum(counts)[:-1]
    wanted = len(values) * np.arange(1, most + 1) / (most + 1)
    after = np.minimum(np.searchsorted(before, wanted), len(before) - 1)
    nearer = np.maximum(after - 1, 0)
    return middles[np.unique(np.where(np.abs(before[nearer] - wanted) < np.abs(before[after] - wanted), nearer, after))]


def grid(df: DataFrame, features: Sequence[str], target: str, seed: int = 42) -> list[np.ndarray] | None:
    """The cut points of every column, chosen on some rows as Spark's trees choose them.

    None if there were more than ``CELLS`` cells, and for tables without rows or with gaps, which the trees refuse.
    """
    names = [f"_c{i}" for i in range(len(features))]
    rows = df.select(*[F.col(f).cast("double").alias(n) for f, n in zip(features, names)], F.col(target).alias("_y"))
    absent = [F.col("_y").isNull(), *[F.col(n).isNull() | F.isnan(n) for n in names]]
    if rows.schema["_y"].dataType.typeName() in ("double", "float"):
        absent.append(F.isnan("_y"))
    n, gaps = one_row(rows, F.count(F.lit(1)).alias("n"), F.count_if(reduce(or_, absent)).alias("gaps"))
    if not n or gaps:
        return None
    some = beginning(rows, names, n, seed)
    cuts = [cut_points(some[:, i]) for i in range(len(names))]
    return cuts if np.prod([len(c) + 1.0 for c in cuts]) <= CELLS else None


def bin_of(x: Column, cuts: np.ndarray) -> Column:
    """How many cut points lie below ``x``, by halving; null for a gap."""
    def place(a: int, b: int) -> Column:
        if a == b:
            return F.lit(float(a))
        middle = (a + b) // 2
        return F.when(x <= F.lit(float(cuts[middle])), place(a, middle)).otherwise(place(middle + 1, b))

    return F.when(x.isNotNull() & ~F.isnan(x), place(0, len(cuts)))


def with_bins(df: DataFrame, features: Sequence[str], cuts: Sequence[np.ndarray]) -> DataFrame:
    return df.withColumns({f"_b{i}": bin_of(F.col(f).cast("double"), c) for i, (f, c) in enumerate(zip(features, cuts))})


def cells(df: DataFrame, features: Sequence[str], cuts: Sequence[np.ndarray], target: str, by_class: bool = False) -> DataFrame:
    """A row per cell (and class) with its number of rows ``_weight`` and the mean of the target.

    Splits never cut a cell, so the spread inside cells changes no gain, and a boosted error's slope has the same mean as its rows'.
    """
    names = [f"_b{i}" for i in range(len(features))]
    binned = with_bins(df, features, cuts).select(*names, target)
    weight = F.count(F.lit(1)).cast("double").alias("_weight")
    if by_class:
        return binned.groupBy(*names, target).agg(weight).coalesce(1)  # the many short jobs that follow read CELLS rows of a class at most
    return binned.groupBy(*names).agg(weight, F.avg(F.col(target).cast("double")).alias("_y")).coalesce(1)


def cell_ends(cuts: Sequence[np.ndarray]) -> np.ndarray:
    """A row per cell: the values at its upper ends, which belong to it."""
    ends = [np.append(c, np.inf) for c in cuts]
    return np.stack([e[i.ravel()] for e, i in zip(ends, np.indices([len(e) for e in ends]))], axis=1)


def cell_of(x: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    """The row of ``cell_ends`` that every row of a float matrix belongs to."""
    return np.ravel_multi_index([np.searchsorted(c, x[:, i]) for i, c in enumerate(cuts)], [len(c) + 1 for c in cuts])


def cell_predictor(cuts: Sequence[np.ndarray], predict):
    """``predict`` of a float matrix, asked once for every cell: rows then only look up their cell."""
    table = predict(cell_ends(cuts))
    return lambda x: table[cell_of(x, cuts)]


# ---- forests ----


#: Where the chances of 0, 1, 2, ... draws end, on a scale of two bytes.
_EDGES = 65536 * np.cumsum([exp(-1) / factorial(k) for k in range(15)])
#: Draws by the whole part of a place on that scale; -1 where an edge lies inside.
_TIMES = np.searchsorted(_EDGES, np.arange(65536.0), side="right").astype(float)
_TIMES[_EDGES.astype(int)] = -1.0


def poisson_times(rng: np.random.Generator, n: int) -> np.ndarray:
    """Poisson numbers of mean 1, most of them read off two random bytes; only near an edge do the further digits decide."""
    place = rng.integers(0, 65536, n, dtype=np.uint16)
    times = _TIMES[place]
    near = np.flatnonzero(times < 0)
    times[near] = np.searchsorted(_EDGES, place[near] + rng.random(len(near)), side="right")
    return times


def _drawn(rows: DataFrame, size: int, trees: int, seed: int) -> DataFrame:
    """(tree, cell, w, s): how many rows of a cell a tree draws with replacement, and the sum of their targets.

    Every row is drawn a Poisson number of times by every tree; a task adds up its rows by cell, many rows at once.
    """
    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        sums = np.zeros((2, trees, size))

        def draw(frames: list[pd.DataFrame]) -> None:
            code, y = (np.concatenate([f[c].to_numpy() for f in frames]) for c in ("cell", "y"))
            for k in range(0, len(code), DRAWN):
                cell, target = code[k:k + DRAWN].astype(np.intp), y[k:k + DRAWN]
                for tree in range(trees):
                    times = poisson_times(rng, len(cell))
                    sums[0, tree] += np.bincount(cell, times, size)
                    sums[1, tree] += np.bincount(cell, times * target, size)

        waiting, n = [], 0
        for frame in batches:
            waiting.append(frame)
            n += len(frame)
            if n >= DRAWN:
                draw(waiting)
                waiting, n = [], 0
        if n:
            draw(waiting)
        for tree in range(trees):
            cell = np.flatnonzero(sums[0, tree])
            if len(cell):
                w, s = sums[:, tree, cell]
                yield pd.DataFrame({"tree": np.full(len(cell), tree, np.int32), "cell": cell.astype(np.int32), "w": w, "s": s})

    long = rows.mapInPandas(part, "tree int, cell int, w double, s double")
    return long.groupBy("tree", "cell").agg(F.sum("w").alias("w"), F.sum("s").alias("s"))


def _grow(bins: np.ndarray, w: np.ndarray, s: np.ndarray, cuts: Sequence[np.ndarray], depth: int, tried: int, rng) -> list[tuple]:
    """Nodes (feature or -1, cut, low, high, value, count, gain) of a tree that lowers the variance; each node tries ``tried`` columns."""
    middle = s.sum() / w.sum()
    s = s - w * middle
    least, nodes, todo = 1e-12 * (s * s / w).sum(), [None], [(0, np.arange(len(w)), 0)]
    while todo:
        node, rows, level = todo.pop()
        n, total, best = w[rows].sum(), s[rows].sum(), (least, -1, 0)
        if level < depth:
            for f in rng.choice(len(cuts), tried, replace=False):
                size = len(cuts[f]) + 1
                left, below = (np.bincount(bins[rows, f], v[rows], size).cumsum()[:-1] for v in (w, s))
                ok = np.flatnonzero((left > 0.5) & (n - left > 0.5))  # draws are whole numbers
                if len(ok):
                    left, below = left[ok], below[ok]
                    gains = below**2 / left + (total - below) ** 2 / (n - left) - total**2 / n
                    best = max(best, (float(gains.max()), int(f), int(ok[gains.argmax()])))
        gain, f, at = best
        if f < 0:
            nodes[node] = (-1, np.inf, node, node, total / n + middle, n, 0.0)
            continue
        low = bins[rows, f] <= at
        nodes[node] = (f, float(cuts[f][at]), len(nodes), len(nodes) + 1, total / n + middle, n, gain)
        todo += [(len(nodes), rows[low], level + 1), (len(nodes) + 1, rows[~low], level + 1)]
        nodes += [None, None]
    return nodes


class Forest:
    """Regression trees as arrays of nodes; a prediction is the trees' mean."""

    def __init__(self, trees: Sequence[pd.DataFrame], cuts: Sequence[np.ndarray], depth: int):
        self.trees = [tuple(t[c].to_numpy() for c in ("feature", "cut", "low", "high", "value", "count", "gain")) for t in trees]
        self.cuts, self.depth = list(cuts), depth

    def importance(self) -> np.ndarray:
        total = np.zeros(len(self.cuts))
        for feature, *_, gain in self.trees:
            one = np.bincount(feature[feature >= 0], gain[feature >= 0], len(self.cuts))
            total += one / (one.sum() or 1.0)
        return total / (total.sum() or 1.0)

    def predict(self, x: np.ndarray) -> np.ndarray:
        rows, total = np.arange(len(x)), np.zeros(len(x))
        for feature, cut, low, high, value, *_ in self.trees:
            at = np.zeros(len(x), int)
            for _ in range(self.depth):
                at = np.where(x[rows, feature[at]] <= cut[at], low[at], high[at])
            total += value[at]
        return total / len(self.trees)

    def leaves(self) -> list[tuple[float, float, list[tuple[int, float, float, float]]]]:
        """(weight, value, path) of every leaf, as ``explain.tree_leaves`` has them."""
        out = []
        for feature, cut, low, high, value, count, _ in self.trees:
            todo = [(0, {})]
            while todo:
                node, path = todo.pop()
                f = int(feature[node])
                if f < 0:
                    out.append((1.0 / len(self.trees), float(value[node]), [(g, *v) for g, v in path.items()]))
                    continue
                a, b, through = path.get(f, (-np.inf, np.inf, 1.0))
                c = float(cut[node])
                todo.append((low[node], {**path, f: (a, min(b, c), through * float(count[low[node]] / count[node]))}))
                todo.append((high[node], {**path, f: (max(a, c), b, through * float(count[high[node]] / count[node]))}))
        return out


def fit_forest(df: DataFrame, features: Sequence[str], target: str, cuts: Sequence[np.ndarray], trees: int, depth: int, seed: int = 42) -> Forest:
    """Trees on rows drawn with replacement, a third of the columns tried at every node.

    One pass over the rows adds up the draws of all trees by cell; a tree grows in a task from its cells, ``CELLS`` at most.
    """
    shape = tuple(len(c) + 1 for c in cuts)
    names, cell = [f"_b{i}" for i in range(len(features))], F.lit(0.0)
    for name, size in zip(names, shape):
        cell = cell * F.lit(float(size)) + F.col(name)
    rows = with_bins(df, features, cuts).select(cell.cast("int").alias("cell"), F.col(target).cast("double").alias("y"))
    tried = -(-len(features) // 3)

    def grow(frame: pd.DataFrame) -> pd.DataFrame:
        tree = int(frame["tree"].iloc[0])
        frame = frame.sort_values("cell")
        bins = np.stack(np.unravel_index(frame["cell"].to_numpy(), shape), axis=1)
        nodes = _grow(bins, frame["w"].to_numpy(), frame["s"].to_numpy(), cuts, depth, tried, np.random.default_rng([seed, 1, tree]))
        return pd.DataFrame([(tree, k, *node) for k, node in enumerate(nodes)], columns=[c.split()[0] for c in _NODES.split(", ")])

    grown = _drawn(rows, int(np.prod(shape)), trees, seed).groupBy("tree").applyInPandas(grow, _NODES).toPandas()
    return Forest([t.sort_values("node") for _, t in grown.groupby("tree")], cuts, depth)
