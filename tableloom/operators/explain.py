"""Explanations: Shapley values, local surrogates and importance comparisons."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import combinations
from math import comb
from operator import or_

import numpy as np
import pandas as pd
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .joins import side_by_side
from .linear import LinearFit
from .models import Model, assemble
from .stats import column_stats, one_row
from .trees import Forest, cell_ends, cell_of, cell_predictor
from .windows import top_per_key, with_position

MAX_EXPLAINED, BACKGROUND = 10, 100


def callback_model(predict, features: Sequence[str]) -> Model:
    """A model from a plain Python function of a float matrix, called on Arrow batches."""

    @F.pandas_udf(T.DoubleType())
    def apply(*cols: pd.Series) -> pd.Series:
        return pd.Series(np.asarray(predict(np.column_stack([c.to_numpy(float) for c in cols])), dtype=float))

    model = Model(lambda d: d.withColumn("prediction", apply(*[F.col(f).cast("double") for f in features])))
    model.function = predict
    return model


def linear_shapley(df: DataFrame, fit: LinearFit, key: Sequence[str]) -> tuple[DataFrame, float]:
    """Long (key, feature, value, contribution) and the base value: weight times deviation from the mean."""
    means = column_stats(df, fit.features, "mean")
    base = fit.intercept + sum(w * means[f]["mean"] for f, w in zip(fit.features, fit.coefficients))
    entries = F.array(*[
        F.struct(
            F.lit(f).alias("feature"), F.col(f).cast("double").alias("value"),
            ((F.col(f).cast("double") - F.lit(means[f]["mean"])) * F.lit(w)).alias("contribution"),
        )
        for f, w in zip(fit.features, fit.coefficients)
    ])
    return df.select(*key, F.explode(entries).alias("e")).select(*key, "e.*"), base


def tree_leaves(model, features: Sequence[str], cuts: Sequence[np.ndarray] | None = None) -> list[tuple[float, float, list[tuple[int, float, float, float]]]]:
    """Leaves of every tree of a fitted tree model as (weight, value, path).

    A path lists for each feature on it the interval (low, high] that leads to the leaf and
    the share of training rows that the splits on that feature let through. ``cuts`` has the values between bins for trees
    that split bin numbers.
    """
    if isinstance(model, Forest):
        return model.leaves()
    trees = model.trees if hasattr(model, "trees") else [model]
    weights = model.treeWeights if hasattr(model, "trees") else [1.0]
    averaging = type(model).__name__.startswith("RandomForest")
    leaves = []
    for tree, weight in zip(trees, weights):
        share = weight / len(trees) if averaging else weight
        todo = [(tree._call_java("rootNode"), {})]
        while todo:
            node, path = todo.pop()
            if node.subtreeDepth() == 0:
                leaves.append((float(share), float(node.prediction()), [(f, *v) for f, v in path.items()]))
                continue
            split = node.split()
            f, cut = int(split.featureIndex()), float(split.threshold())
            if cuts is not None:
                cut = float(cuts[f][int(cut)])
            left, right = node.leftChild(), node.rightChild()
            n = {s: float(c.impurityStats().count()) for s, c in (("l", left), ("r", right))}
            low, high, through = path.get(f, (-np.inf, np.inf, 1.0))
            whole = n["l"] + n["r"]
            todo.append((left, {**path, f: (low, min(high, cut), through * n["l"] / whole)}))
            todo.append((right, {**path, f: (max(low, cut), high, through * n["r"] / whole)}))
    return leaves


def _leaf_contributions(x: np.ndarray, leaves, width: int) -> np.ndarray:
    """Path-dependent Shapley values of every row.

    For a leaf, let a feature on its path contribute the factor o t + z (1 - t), where o says whether the row is inside its
    interval and z is the share let through. The product over the path is extended factor by factor; without
    feature i (unwound by a division) its integral over t in [0, 1] is the sum over subsets with Shapley weights. The
    integrand is a polynomial of degree below the path's length, so Gauss-Legendre points give it exactly, and all
    factors are positive, so nothing cancels. Rows inside the same intervals of a path are computed once.
    """
    out = np.zeros((len(x), width))
    for weight, value, path in leaves:
        m = len(path)
        if not m:
            continue
        features = [f for f, *_ in path]
        low, high, through = (np.array([step[k] for step in path]) for k in (1, 2, 3))
        inside = (x[:, features] > low) & (x[:, features] <= high)
        if m <= 12:  # few kinds of rows: told apart by counting, without sorting them
            code = inside @ (1 << np.arange(m))
            found = np.flatnonzero(np.bincount(code, minlength=1 << m))
            kinds = (found[:, None] >> np.arange(m) & 1).astype(bool)
            place = np.zeros(1 << m, int)
            place[found] = np.arange(len(found))
            which = place[code]
        else:
            kinds, which = np.unique(np.packbits(inside, axis=1), axis=0, return_inverse=True)
            kinds = np.unpackbits(kinds, axis=1)[:, :m].astype(bool)
        nodes, shares = np.polynomial.legendre.leggauss((m + 1) // 2)
        t = (nodes + 1) / 2
        factors = np.where(kinds[:, :, None], t + through[:, None] * (1 - t), through[:, None] * (1 - t))
        whole = factors.prod(axis=1) * (shares / 2)
        part = weight * value * (kinds - through) * (whole[:, None, :] / factors).sum(axis=2)
        out[:, features] += part[which.ravel()]  # a feature is on a path once
    return out


def _cell_contributions(spark: SparkSession, leaves, cuts: Sequence[np.ndarray]) -> np.ndarray:
    """The contributions of every cell, of which ``trees.grid`` allows ``CELLS``, worked out by tasks of some cells each."""
    points, width = cell_ends(cuts), len(cuts)

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            at = frame["id"].to_numpy()
            yield pd.DataFrame({"id": at, "c": list(_leaf_contributions(points[at], leaves.value, width))})

    cells = spark.range(0, len(points), 1, -(-len(points) // 1024)).mapInPandas(part, "id long, c array<double>").toPandas()
    return np.stack(cells.sort_values("id")["c"].to_numpy())


def tree_shapley(df: DataFrame, model: Model, features: Sequence[str], key: Sequence[str]) -> tuple[DataFrame, float]:
    """Long (key, feature, value, contribution) of a tree model, and the base value.

    The leaves (bounded by the model, not the data) are broadcast; rows are scored in Arrow
    batches. Trees on binned columns are asked once for every cell of bins, and rows look up their cell.
    Contributions add up to prediction minus base.
    """
    cuts = getattr(model.native if isinstance(model.native, Forest) else model, "cuts", None)
    leaves = tree_leaves(model.native, features, cuts)
    base = sum(w * v * float(np.prod([t for *_, t in path])) if path else w * v for w, v, path in leaves)
    context, width = df.sparkSession.sparkContext, len(features)
    shared = context.broadcast(leaves)
    by_cell = None if cuts is None else context.broadcast((cuts, _cell_contributions(df.sparkSession, shared, cuts)))
    names = [f"c{i}" for i in range(width)]

    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    def contributions(*cols: pd.Series) -> pd.DataFrame:
        x = np.column_stack([c.to_numpy(float) for c in cols])
        if by_cell is None:
            return pd.DataFrame(_leaf_contributions(x, shared.value, width), columns=names)
        cuts, table = by_cell.value
        out = table[cell_of(x, cuts)]
        outside = ~(x > -np.inf).all(axis=1)  # rows with gaps are in no cell
        if outside.any():
            out[outside] = _leaf_contributions(x[outside], shared.value, width)
        return pd.DataFrame(out, columns=names)

    scored = df.withColumn("_c", contributions(*[F.col(f).cast("double") for f in features]))
    entries = F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value"), F.col("_c")[n].alias("contribution")) for n, f in zip(names, features)
    ])
    return scored.select(*key, F.explode(entries).alias("e")).select(*key, "e.*"), float(base)


def background(df: DataFrame, key: Sequence[str], n: int = BACKGROUND, seed: int = 42) -> DataFrame:
    """At most ``n`` rows, the same ones on every run."""
    return df.orderBy(F.xxhash64(*key, F.lit(seed)), *key).limit(n)


def sampled_shapley(df: DataFrame, model: Model, features: Sequence[str], key: Sequence[str], permutations: int = 4, n_background: int = 20, seed: int = 42) -> tuple[DataFrame, float]:
    """Model-agnostic Shapley values by sampled feature orders against a background sample.

    Each row meets a few (order, background row) pairs; along an order the features switch from the background to the row, and
    each switch's change in prediction is that feature's share. The shares of a row add up exactly. A model that is known as a
    function of a matrix is asked inside the row's Arrow batch, so rows are not multiplied; rows with gaps take the longer way.
    """
    rng = np.random.default_rng(seed)
    width = len(features)
    ground = [[float(v) for v in r] for r in background(df, key, n_background, seed).select(*features).collect()]
    draws = []
    for g in range(len(ground)):
        for _ in range(max(1, permutations)):
            draws.append((ground[g], [int(v) for v in rng.permutation(width)]))
    base_rows = df.sparkSession.createDataFrame(ground, ", ".join(f"`{f}` double" for f in features))
    base = one_row(model.transform(base_rows), F.avg("prediction").alias("b"))["b"]
    gap = reduce(or_, [F.col(f).cast("double").isNull() | F.isnan(F.col(f).cast("double")) for f in features])
    try:
        predict = numpy_predictor(model, features)
    except ValueError:
        predict = None
    if predict is None or df.where(gap).limit(1).count():
        return _switched(df, model, features, key, draws), float(base)
    ground_rows, orders = np.array([g for g, _ in draws]), np.array([o for _, o in draws])
    shared = df.sparkSession.sparkContext.broadcast((ground_rows, orders))

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def contributions(*cols: pd.Series) -> pd.Series:
        """All draws of some rows at a time: one feature after the other switches to the row's value."""
        ground, orders = shared.value
        x = np.column_stack([c.to_numpy(float) for c in cols])
        out, draw = np.zeros(x.shape), np.arange(len(orders))
        for k in range(0, len(x), 512):
            some = x[k:k + 512]
            mixed = np.repeat(ground[None], len(some), axis=0)
            before = predict(mixed.reshape(-1, width)).reshape(len(some), -1)
            for step in range(width):
                f = orders[:, step]
                mixed[:, draw, f] = some[:, f]
                after = predict(mixed.reshape(-1, width)).reshape(len(some), -1)
                for i in range(width):
                    out[k:k + 512, i] += (after - before)[:, f == i].sum(axis=1)
                before = after
        return pd.Series(list(out / len(orders)))

    # rows that come several times have one share, their sum
    rows = df.select(*key, *[F.col(f).cast("double").alias(f"_x{i}") for i, f in enumerate(features)])
    names = [f"_x{i}" for i in range(width)]
    rows = rows.groupBy(*key, *names).agg(F.count(F.lit(1)).alias("_times")).withColumn("_c", contributions(*names))
    entries = F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(n).alias("value"), (F.col("_c")[i] * F.col("_times")).alias("contribution")) for i, (f, n) in enumerate(zip(features, names))
    ])
    return rows.select(*key, F.explode(entries).alias("e")).select(*key, "e.*"), float(base)


def _switched(df: DataFrame, model: Model, features: Sequence[str], key: Sequence[str], draws: Sequence[tuple]) -> DataFrame:
    """The contributions of ``sampled_shapley`` for models that only take tables: a row per step of every draw."""
    width = len(features)
    plan = F.array(*[F.struct(F.array(*map(F.lit, g)).alias("g"), F.array(*map(F.lit, o)).alias("o")) for g, o in draws])
    rows = df.select(*key, *[F.col(f).cast("double").alias(f) for f in features])
    spread = rows.select(*key, F.array(*features).alias("_x"), F.posexplode(plan).alias("_draw", "_d"))
    steps = spread.select(*key, "_x", "_draw", "_d", F.explode(F.sequence(F.lit(0), F.lit(width))).alias("_step"))
    # feature i comes from the row once its place in the order lies before the step
    mixed = steps.select(
        *key, "_x", "_draw", "_step", F.col("_d.o").alias("_o"),
        *[
            F.when(F.array_position(F.col("_d.o"), F.lit(i)) <= F.col("_step"), F.col("_x")[i]).otherwise(F.col("_d.g")[i]).alias(f)
            for i, f in enumerate(features)
        ],
    )
    scored = model.transform(mixed)
    # the change at step s belongs to feature o[s-1]: add p at its own step, take p at the step before
    gains = F.array_compact(F.array(
        F.when(F.col("_step") > 0, F.struct(F.get("_o", F.col("_step") - 1).alias("f"), F.col("prediction").alias("v"))),
        F.when(F.col("_step") < width, F.struct(F.get("_o", F.col("_step")).alias("f"), (-F.col("prediction")).alias("v"))),
    ))
    long = scored.select(*key, "_x", F.explode(gains).alias("e")).groupBy(*key, "_x", "e.f").agg((F.sum("e.v") / F.lit(float(len(draws)))).alias("contribution"))
    names = F.array(*map(F.lit, features))
    return long.select(*key, F.get(names, F.col("f")).alias("feature"), F.get("_x", F.col("f")).alias("value"), "contribution")


def numpy_predictor(model: Model, features: Sequence[str]):
    """The model as a function of a float matrix, for use inside tasks: linear fits, regression trees and their ensembles, and plain functions."""
    if isinstance(model.native, LinearFit):
        weights, intercept = np.array(model.native.coefficients), model.native.intercept
        return lambda x: x @ weights + intercept
    if callable(getattr(model, "function", None)):
        return model.function
    if hasattr(model.native, "coefficients") and hasattr(model.native, "intercept") and not hasattr(model.native, "numClasses"):
        weights, intercept = model.native.coefficients.toArray(), float(model.native.intercept)
        return lambda x: x @ weights + intercept
    if hasattr(model.native, "trees") or hasattr(model.native, "toDebugString"):
        leaves = [(w * v, *(np.array(c) for c in zip(*path))) if path else (w * v, np.zeros(0, int), np.zeros(0), np.zeros(0), np.zeros(0)) for w, v, path in tree_leaves(model.native, features, getattr(model, "cuts", None))]

        def predict(x: np.ndarray) -> np.ndarray:
            total = np.zeros(len(x))
            for amount, f, low, high, _ in leaves:
                total += amount * ((x[:, f.astype(int)] > low) & (x[:, f.astype(int)] <= high)).all(axis=1)
            return total

        return cell_predictor(model.cuts, predict) if hasattr(model, "cuts") else predict
    raise ValueError("no function of a matrix is known for this model: use sampled_shapley")


def coalitions(width: int, most: int = 2048, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """(0/1 matrix, weights) of feature coalitions with the Shapley kernel's weights.

    All of them if they fit into ``most``; else whole sizes from the outside in (the heaviest, with their complements) as
    far as they fit, and draws from the other sizes, each with its complement, which share what weight is left.
    """
    total = {s: (width - 1) / (s * (width - s)) for s in range(1, width)}  # of all coalitions of a size
    rows, weights, left = [], [], most
    sizes = sorted(total, key=lambda s: (min(s, width - s), s))
    rest = []
    for pair in [sizes[i:i + 2] for i in range(0, len(sizes), 2)]:
        number = sum(comb(width, s) for s in pair)
        if rest or number > left:
            rest += pair
            continue
        left -= number
        for s in pair:
            for chosen in combinations(range(width), s):
                z = np.zeros(width)
                z[list(chosen)] = 1
                rows.append(z)
                weights.append(total[s] / comb(width, s))
    draws = left // 2
    if rest and draws:
        rng = np.random.default_rng(seed)
        share = np.array([total[s] for s in rest])
        for s in rng.choice(rest, size=draws, p=share / share.sum()):
            z = np.zeros(width)
            z[rng.choice(width, size=s, replace=False)] = 1
            rows += [z, 1 - z]
            weights += [share.sum() / (2 * draws)] * 2
    return np.array(rows).reshape(-1, width), np.array(weights)


def kernel_shapley(
    df: DataFrame, model: Model, features: Sequence[str], key: Sequence[str], n_background: int = BACKGROUND, most: int = 2048, seed: int = 42,
) -> tuple[DataFrame, float]:
    """Long (key, feature, value, contribution) by coalition-weighted least squares (Kernel SHAP), and the base value.

    The background rows (``n_background`` at most) and the coalitions go to the tasks; a row's coalitions are predicted and
    its equation is solved inside its Arrow batch, so rows are neither multiplied nor shuffled. The solution for the
    coalitions is one matrix for all rows. Contributions add up to prediction minus base; they are exact when all coalitions fit.
    """
    width = len(features)
    predict = numpy_predictor(model, features)
    ground = np.array([[float(v) for v in r] for r in background(df, key, n_background, seed).select(*features).collect()]).reshape(-1, width)
    if not len(ground):
        raise ValueError("no background rows")
    base = float(np.mean(predict(ground)))
    z, weights = coalitions(width, most, seed)
    # the last feature's share is what the others leave of prediction minus base
    free = z[:, :-1] - z[:, -1:]
    solve = np.linalg.pinv((free * weights[:, None]).T @ free) @ (free * weights[:, None]).T if width > 1 else np.zeros((0, len(z)))
    shared = df.sparkSession.sparkContext.broadcast((ground, z, solve))

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def contributions(*cols: pd.Series) -> pd.Series:
        ground, z, solve = shared.value
        x = np.column_stack([c.to_numpy(float) for c in cols])
        gains = predict(x) - base
        out = np.zeros((len(x), width))
        step = max(1, (1 << 17) // max(1, len(z) * len(ground)))
        for k in range(0, len(x), step):
            some = x[k:k + step]
            if width == 1:
                out[k:k + step, 0] = gains[k:k + step]
                continue
            met = np.zeros((len(some), len(z)))
            for j in range(0, len(z), 256):
                mask = z[None, j:j + 256, None, :] == 1
                mixed = np.where(mask, some[:, None, None, :], ground[None, None, :, :])
                met[:, j:j + 256] = predict(mixed.reshape(-1, width)).reshape(len(some), -1, len(ground)).mean(axis=2)
            part = (met - base - gains[k:k + step, None] * z[:, -1]) @ solve.T
            out[k:k + step, :-1] = part
            out[k:k + step, -1] = gains[k:k + step] - part.sum(axis=1)
        return pd.Series(list(out))

    scored = df.withColumn("_c", contributions(*[F.col(f).cast("double") for f in features]))
    entries = F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value"), F.col("_c")[i].alias("contribution")) for i, f in enumerate(features)
    ])
    return scored.select(*key, F.explode(entries).alias("e")).select(*key, "e.*"), base


def global_importance(contributions: DataFrame) -> DataFrame:
    """Mean magnitude per feature, largest first."""
    return contributions.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("importance")).orderBy(F.desc("importance"), "feature")


def first_explanations(contributions: DataFrame, key: Sequence[str], n: int = MAX_EXPLAINED) -> DataFrame:
    """Contributions of the first rows with their rank by magnitude."""
    first = contributions.select(*key).distinct().orderBy(*key).limit(n)
    rows = contributions.join(F.broadcast(first), list(key), "left_semi")  # at most n keys
    from pyspark.sql import Window

    w = Window.partitionBy(*key).orderBy(F.desc(F.abs("contribution")), "feature")
    return rows.withColumn("rank", F.row_number().over(w).cast("bigint"))


def local_surrogate(df: DataFrame, model: Model, features: Sequence[str], instance: Column, num_features: int = 10, samples: int = 5000, seed: int = 42) -> DataFrame:
    """Weighted linear model around one row: (feature, weight, value, intercept, prediction).

    The row is perturbed with the columns' deviations; samples near it weigh more, by a
    Gaussian kernel of width 0.75 √p on standardised distance.
    """
    stats = column_stats(df, features, "std_pop")
    row = df.where(instance).select(*[F.col(f).cast("double").alias(f) for f in features]).limit(1).collect()
    if not row:
        raise ValueError("no such row")
    row = row[0]
    width = 0.75 * np.sqrt(len(features))
    noise = {f"_u{i}": F.randn(seed + i) for i in range(len(features))}
    near = df.sparkSession.range(samples).withColumns(noise)
    near = near.withColumns({f: F.lit(row[f]) + F.col(f"_u{i}") * F.lit(stats[f]["std_pop"] or 0.0) for i, f in enumerate(features)})
    gap2 = F.lit(0.0)
    for i in range(len(features)):
        gap2 = gap2 + F.col(f"_u{i}") * F.col(f"_u{i}")
    scored = model.transform(near.withColumn("_w", F.exp(-gap2 / F.lit(width**2)))).withColumnRenamed("prediction", "_y")
    units = [f"_u{i}" for i in range(len(features))]
    fit = LinearRegression(featuresCol="_features", labelCol="_y", weightCol="_w", regParam=1e-6, solver="normal").fit(assemble(scored, units))
    at = model.transform(df.sparkSession.createDataFrame([tuple(row)], ", ".join(f"`{f}` double" for f in features))).collect()[0]["prediction"]
    rows = [(f, float(w), float(row[f]), float(fit.intercept), float(at)) for f, w in zip(features, fit.coefficients)]
    rows = sorted(rows, key=lambda r: -abs(r[1]))[:num_features]
    return df.sparkSession.createDataFrame(rows, "feature string, weight double, value double, intercept double, prediction double")


def permutation_importance(df: DataFrame, model: Model, features: Sequence[str], key: Sequence[str], seed: int = 42, **sizes) -> DataFrame:
    """Change of the prediction's deviation when one column is permuted.

    Rows are placed once in key order and once in a seeded hash order per feature; joining the
    places is an exact permutation of the column.
    """
    rows = df.select(*key, *[F.col(f).cast("double").alias(f) for f in features])
    before = one_row(model.transform(rows), F.stddev_pop("prediction").alias("s"))["s"]
    placed = with_position(rows, list(key), name="_at", **sizes)
    out = []
    for i, f in enumerate(features):
        mixed = with_position(rows.select(*key, F.col(f).alias("_new")), [F.xxhash64(*key, F.lit(seed + i)), *key], name="_at", **sizes)
        permuted = side_by_side(placed.drop(f), mixed.select("_at", F.col("_new").alias(f)), ["_at"])
        after = one_row(model.transform(permuted), F.stddev_pop("prediction").alias("s"))["s"]
        out.append((f, abs(after - before)))
    return df.sparkSession.createDataFrame(out, "feature string, importance double")


def compared(importances: dict[str, DataFrame]) -> DataFrame:
    """(method, feature, share): each method's importances normalised to sum one."""
    from pyspark.sql import Window

    out = None
    for method, rows in importances.items():
        one = rows.select(F.lit(method).alias("method"), "feature", "importance")
        out = one if out is None else out.unionByName(one)
    total = F.sum("importance").over(Window.partitionBy("method"))
    return out.select("method", "feature", F.when(total > 0, F.col("importance") / total).otherwise(F.col("importance")).alias("share"))
