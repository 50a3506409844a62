"""Anomaly detectors: each adds ``is_anomaly`` and ``anomaly_score`` to the rows.

Missing values are median-filled first. The model-based detectors standardise the features
and flag the share of rows given by ``contamination``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import partial, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..session import cut_lineage
from .columns import select_features
from .impute import fill_median
from .linear import moments
from .neighbors import nearest_rows
from .partials import landmark_map, landmark_rows
from .passes import beginning, newton, summed, summed_here
from .stats import column_stats, exact_quantiles, numeric_columns

TREES, TREE_ROWS, NEIGHBOURS, CONTAMINATION = 100, 256, 20, 0.1


def _usable(df: DataFrame, features: Sequence[str]) -> list[str]:
    numeric = numeric_columns(select_features(df, features))
    if not numeric:
        raise ValueError("no numeric features")
    return numeric


def _greatest(columns: Sequence[Column]) -> Column:
    return columns[0] if len(columns) == 1 else F.greatest(*columns)


def _any(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns)


def zscore(df: DataFrame, features: Sequence[str], threshold: float = 3.0) -> DataFrame:
    """Any |z| above the threshold; the score is the largest |z|."""
    numeric = _usable(df, features)
    filled = fill_median(df, numeric)
    stats = column_stats(filled, numeric, "mean", "std_pop")
    z = [
        F.abs(F.col(c) - F.lit(s["mean"])) / F.lit(s["std_pop"]) if s["std_pop"] else F.lit(0.0)
        for c, s in stats.items()
    ]
    return df_with(df, filled, numeric, _greatest(z), _any([x > threshold for x in z]))


def iqr(df: DataFrame, features: Sequence[str], fence: float = 1.5) -> DataFrame:
    """Any value outside the quartile fences; the score is the largest distance outside."""
    numeric = _usable(df, features)
    filled = fill_median(df, numeric)
    quartiles = exact_quantiles(filled, {c: [0.25, 0.75] for c in numeric})
    outside = []
    for c, (q1, q3) in quartiles.items():
        low, high = q1 - fence * (q3 - q1), q3 + fence * (q3 - q1)
        outside.append(F.greatest(F.lit(low) - F.col(c), F.col(c) - F.lit(high), F.lit(0.0)))
    return df_with(df, filled, numeric, _greatest(outside), _any([x > 0 for x in outside]))


def df_with(df: DataFrame, filled: DataFrame, numeric: Sequence[str], score: Column, flag: Column) -> DataFrame:
    """Rows as given, with a score and flag computed on their filled values."""
    keep = [c for c in df.columns if c not in numeric]
    return filled.withColumns({"anomaly_score": score, "is_anomaly": flag}).select(
        *[F.col(f"`{c}`") for c in keep], *[F.col(f"`{c}`") for c in numeric], "anomaly_score", "is_anomaly"
    )


def standardised(df: DataFrame, numeric: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Filled rows with standardised copies ``_z0`` .. of the features."""
    filled = fill_median(df, numeric)
    stats = column_stats(filled, numeric, "mean", "std_pop")
    names = [f"_z{i}" for i in range(len(numeric))]
    return filled.withColumns(
        {n: (F.col(c) - F.lit(stats[c]["mean"])) / F.lit(stats[c]["std_pop"] or 1.0) for n, c in zip(names, numeric)}
    ), names


def contamination_cut(df: DataFrame, score: str, contamination: float) -> DataFrame:
    """Flag the rows whose score lies below the ``contamination`` quantile of scores."""
    cut = exact_quantiles(df, {score: [contamination]})[score][0]
    return df.withColumn("is_anomaly", F.col(score) < F.lit(cut))


def _average_path(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search among n rows."""
    n = np.asarray(n, dtype=float)
    out = np.where(n == 2, 1.0, 0.0)
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1) + np.euler_gamma) - 2.0 * (n[big] - 1) / n[big]
    return out


def _grow(x: np.ndarray, rng, limit: int) -> list[tuple]:
    """One isolation tree as node rows (node, feature, cut, left, right, size)."""
    nodes, todo = [], [(0, np.arange(len(x)), 0)]
    following = 1
    while todo:
        node, rows, depth = todo.pop()
        low, high = x[rows].min(axis=0), x[rows].max(axis=0)
        open_features = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or not len(open_features):
            nodes.append((node, -1, 0.0, -1, -1, len(rows)))
            continue
        f = int(rng.choice(open_features))
        cut = float(rng.uniform(low[f], high[f]))
        left = x[rows, f] < cut
        nodes.append((node, f, cut, following, following + 1, len(rows)))
        todo += [(following, rows[left], depth + 1), (following + 1, rows[~left], depth + 1)]
        following += 2
    return nodes


def isolation_forest(
    df: DataFrame, features: Sequence[str], contamination: float = CONTAMINATION, n_estimators: int = TREES,
    max_samples: int | str = "auto", seed: int = 42,
) -> DataFrame:
    """Scores −2^(−E[h]/c) over trees grown on bounded row samples.

    Every tree draws its rows independently; the sampled rows are grouped by tree, at most
    a few hundred per group, and grown in parallel. Only the trees are broadcast.
    """
    numeric = _usable(df, features)
    ready, names = standardised(df, numeric)
    rows = ready.count()
    size = min(TREE_ROWS, rows) if max_samples == "auto" else min(int(max_samples), rows)
    # about twice the rows a tree needs; the tree keeps the ones with the smallest draws
    share = min(1.0, 2.0 * size / rows)
    kept = min(1.0, 4.0 * n_estimators * share)  # thin a huge table before drawing per tree
    drawn = F.xxhash64(*ready.columns, F.lit(seed))  # follows the row, however rows are dealt to tasks
    thinned = ready.select(*names, drawn.alias("_salt")).where(F.pmod(F.xxhash64("_salt", F.lit(seed + 1)), F.lit(1_000_000_007)) < F.lit(kept * 1_000_000_007))
    share = share / kept
    uniform = lambda i: F.pmod(F.xxhash64("_salt", i, F.lit(seed)), F.lit(1_000_000_007)) / F.lit(1_000_000_007.0)
    per_tree = F.transform(
        F.sequence(F.lit(0), F.lit(n_estimators - 1)), lambda i: F.struct(i.alias("tree"), uniform(i).alias("u"))
    )
    sampled = (
        thinned.select(*names, F.explode(F.filter(per_tree, lambda e: e["u"] < F.lit(share))).alias("e"))
        .select(*names, "e.tree", "e.u")
    )
    limit = int(np.ceil(np.log2(max(size, 2))))

    def grow(batch: pd.DataFrame) -> pd.DataFrame:
        tree = int(batch["tree"].iloc[0])
        x = batch.sort_values("u").head(size)[names].to_numpy(float)
        nodes = _grow(x, np.random.default_rng(seed * 1000 + tree), limit)
        out = pd.DataFrame(nodes, columns=["node", "feature", "cut", "left", "right", "size"])
        return out.assign(tree=tree)[["tree", "node", "feature", "cut", "left", "right", "size"]]

    schema = "tree int, node int, feature int, cut double, left int, right int, size int"
    grown = sampled.groupBy("tree").applyInPandas(grow, schema).toPandas()  # n_estimators x 2 size nodes at most
    packed = []
    for _, t in grown.groupby("tree"):
        t = t.sort_values("node")
        packed.append(tuple(t[c].to_numpy() for c in ("feature", "cut", "left", "right", "size")))
    shared = df.sparkSession.sparkContext.broadcast(packed)
    norm = float(_average_path(np.array([size]))[0]) or 1.0

    @F.pandas_udf(T.DoubleType())
    def score(*cols: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(float) for c in cols])
        depth = np.zeros(len(x))
        for feature, cut, left, right, count in shared.value:
            node, path = np.zeros(len(x), dtype=int), np.zeros(len(x))
            for _ in range(limit):
                f = feature[node]
                inner = f >= 0
                go_left = x[np.arange(len(x)), np.where(inner, f, 0)] < cut[node]
                path += inner
                node = np.where(inner, np.where(go_left, left[node], right[node]), node)
            depth += path + _average_path(count[node])
        return pd.Series(-np.power(2.0, -(depth / len(shared.value)) / norm))

    scored = cut_lineage(ready.withColumn("anomaly_score", score(*names)).drop(*names))
    return contamination_cut(scored, "anomaly_score", contamination)


def local_outlier_factor(
    df: DataFrame, key: str, features: Sequence[str], contamination: float = CONTAMINATION, n_neighbors: int = NEIGHBOURS, scale: bool = True,
) -> DataFrame:
    """Negative local outlier factor from the nearest neighbours of each row: exact ones in a few columns, those of a forest in many."""
    numeric = _usable(df, features)
    if scale:
        ready, names = standardised(df, numeric)
    else:
        ready, names = fill_median(df, numeric), list(numeric)
    k = min(n_neighbors, max(ready.select(F.lit(1)).limit(n_neighbors + 1).count() - 1, 1))
    pairs = cut_lineage(nearest_rows(ready, key, names, k))
    reach_of = pairs.groupBy("id").agg(F.max("distance").alias("k_distance"))
    reach = pairs.join(reach_of.withColumnRenamed("id", "neighbour"), "neighbour").select(
        "id", "neighbour", F.greatest("distance", "k_distance").alias("reach")
    )
    density = cut_lineage(reach.groupBy("id").agg((1.0 / (F.avg("reach") + 1e-10)).alias("density")))
    around = pairs.join(density.withColumnRenamed("id", "neighbour"), "neighbour").groupBy("id").agg(F.avg("density").alias("around"))
    factor = around.join(density, "id").select(F.col("id").alias("_id"), (-F.col("around") / F.col("density")).alias("anomaly_score"))
    scored = cut_lineage(df.join(factor, F.col(key) == F.col("_id")).drop("_id"))
    return contamination_cut(scored, "anomaly_score", contamination)


def elliptic_envelope(
    df: DataFrame, features: Sequence[str], contamination: float = CONTAMINATION, support_fraction: float | None = None, steps: int = 10,
) -> DataFrame:
    """Robust Mahalanobis distances by concentration steps; the score is minus the distance.

    Each step is one aggregate over the rows nearest under the last estimate, from a
    median / quartile start; it stops when the determinant no longer falls.
    """
    numeric = _usable(df, features)
    ready, names = standardised(df, numeric)
    p, n = len(names), ready.count()
    share = support_fraction or min(1.0, (n + p + 1) / (2.0 * n))
    slim = ready.select(*names).persist()
    q = exact_quantiles(slim, {c: [0.25, 0.5, 0.75] for c in names})
    centre = np.array([q[c][1] for c in names])
    spread = np.array([max((q[c][2] - q[c][0]) / 1.349, 1e-6) for c in names])
    shape, last = np.diag(spread**2), np.inf
    for _ in range(steps):
        distance = slim.withColumn("_d", mahalanobis(names, centre, shape))
        cut = distance.agg(F.percentile_approx("_d", share, 10_000)).collect()[0][0]
        m = moments(distance.where(F.col("_d") <= F.lit(cut)), names)[None]
        new = m.scatter / m.n + 1e-9 * np.eye(p)
        size = np.linalg.slogdet(new)[1]
        if size >= last - 1e-9:
            break
        centre, shape, last = m.mean, new, size
    slim.unpersist()
    scored = ready.withColumn("anomaly_score", -F.sqrt(mahalanobis(names, centre, shape))).drop(*names)
    return contamination_cut(scored, "anomaly_score", contamination)


def mahalanobis(names: Sequence[str], centre: np.ndarray, shape: np.ndarray) -> Column:
    """Squared Mahalanobis distance as a column expression."""
    inverse = np.linalg.pinv(shape)
    gaps = [F.col(c) - F.lit(float(m)) for c, m in zip(names, centre)]
    total = F.lit(0.0)
    for i in range(len(names)):
        for j in range(len(names)):
            total = total + gaps[i] * gaps[j] * F.lit(float(inverse[i, j]))
    return F.greatest(total, F.lit(0.0))


def _rounded_hinge(z: np.ndarray, soft: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(loss, slope, curvature): 0 below 0, a square up to ``soft``, then a line."""
    up = np.maximum(z, 0.0)
    bent = (z > 0) & (z < soft)
    return np.where(bent, up**2 / (2 * soft), np.where(up > 0, up - soft / 2, 0.0)), np.minimum(up / soft, 1.0), bent / soft


def one_class_margin(
    rows: DataFrame, names: Sequence[str], nu: float, landmarks: int = 100, seed: int = 42, gap: float = 1e-3,
) -> tuple[np.ndarray, float, Callable[[np.ndarray], np.ndarray], float]:
    """(weights, threshold, feature map, relative duality gap) of the one-class machine on ``rows``.

    At most ``landmarks`` different rows, chosen by hash, span the kernel's space. The primal problem (half the squared
    weights minus the threshold, plus the mean shortfall over nu) is solved by Newton steps on moments summed over all rows, its hinge
    rounded less and less until the primal and the dual value differ by less than ``gap``. The steps down are made on some rows; from
    where they end the same steps and the same test of the gap go on over all rows, of which only those short of the threshold are
    mapped. The threshold is then the nu-quantile of the values, so the share of rows below it is nu: the property that gives nu its meaning.
    """
    mapped = landmark_map(landmark_rows(rows, names, landmarks, seed), 1.0 / len(names))
    n, width = rows.count(), mapped.into.shape[1]
    some = beginning(rows, names, n, seed)

    def problem(sums: Callable, n: int) -> tuple[Callable, Callable, Callable]:
        scale = 1.0 / (nu * n)

        def evaluate(v: np.ndarray, soft: float):
            into = mapped.into @ v[:-1]

            def part(x):
                kernel = mapped.kernel(x)
                loss, slope, curve = _rounded_hinge(v[-1] - kernel @ into, soft)
                short = slope > 0  # the other rows take no part
                phi = np.concatenate([-(kernel[short] @ mapped.into), np.ones((int(short.sum()), 1))], axis=1)  # of the shortfall threshold - w phi
                bent = curve[short] > 0
                return np.concatenate([[loss.sum()], phi.T @ slope[short], (phi[bent].T @ phi[bent] / soft).ravel()])

            total = scale * sums(part)
            slope, bend = total[1 : width + 2], total[width + 2 :].reshape(width + 1, width + 1)
            free = np.append(np.ones(width), 0.0)
            return total[0] + v[:-1] @ v[:-1] / 2 - v[-1], slope + free * v - np.append(np.zeros(width), 1.0), bend + np.diag(free + 1e-9)

        def losses(points, soft: float):
            v = np.stack(points, axis=1)
            into = mapped.into @ v[:-1]
            total = sums(lambda x: _rounded_hinge(v[-1] - mapped.kernel(x) @ into, soft)[0].sum(axis=0))
            return scale * total + (v[:-1] ** 2).sum(axis=0) / 2 - v[-1]

        def apart(v: np.ndarray, soft: float) -> float:
            """The relative gap of the primal value and the dual value of the shares that the rounded hinge's slopes give."""
            into = mapped.into @ v[:-1]

            def part(x):
                kernel = mapped.kernel(x)
                short = v[-1] - kernel @ into
                slope = _rounded_hinge(short, soft)[1]
                on = slope > 0
                return np.concatenate([[np.maximum(short, 0).sum(), slope.sum()], mapped.into.T @ (kernel[on].T @ slope[on])])

            total = sums(part)
            shares = total[2:] / max(total[1], 1e-300)
            primal, dual = v[:-1] @ v[:-1] / 2 - v[-1] + scale * total[0], -(shares @ shares) / 2
            return (primal - dual) / max(abs(primal), 1e-12)

        return evaluate, losses, apart

    v = np.append(mapped(some).mean(axis=0), 0.0)
    v[-1] = 0.9 * (v[:-1] @ v[:-1])
    soft, left = max(v[-1], 1e-3) / 2, np.inf
    for sums, count in ((partial(summed_here, some), len(some)), (partial(summed, rows, names), n)):  # a start on some rows, then all
        evaluate, losses, apart = problem(sums, count)
        for _ in range(12):
            v = newton(partial(evaluate, soft=soft), partial(losses, soft=soft), v, 12, enough=1e-2 * gap)
            left = apart(v, soft)
            if left < gap:
                break
            soft /= 3
    return v[:-1], float(v[-1]), mapped, float(left)


def one_class_svm(
    df: DataFrame, features: Sequence[str], contamination: float = CONTAMINATION, landmarks: int = 100, seed: int = 42,
) -> DataFrame:
    """One-class support vector machine with an RBF kernel on standardised columns; scores below 0 lie outside.

    nu is the contamination held within 0.01 and 0.5, and the share of rows outside.
    """
    numeric = _usable(df, features)
    ready, names = standardised(df, numeric)
    nu = min(0.5, max(0.01, contamination))
    slim = ready.select(*names).persist()
    weights, _, mapped, _ = one_class_margin(slim, names, nu, landmarks, seed)
    slim.unpersist()

    @F.pandas_udf(T.DoubleType())
    def value(*cols: pd.Series) -> pd.Series:
        return pd.Series(mapped(np.column_stack([c.to_numpy(float) for c in cols])) @ weights)

    valued = cut_lineage(ready.withColumn("_value", value(*names)).drop(*names))
    threshold = exact_quantiles(valued, {"_value": [nu]})["_value"][0]
    scored = valued.withColumn("anomaly_score", F.col("_value") - F.lit(threshold)).drop("_value")
    return contamination_cut(scored, "anomaly_score", nu)


# Detector names.
DETECTORS = {
    "isolation_forest": isolation_forest,
    "one_class_svm": one_class_svm,
    "local_outlier_factor": local_outlier_factor,
    "elliptic_envelope": elliptic_envelope,
    "statistical_outliers": zscore,
    "zscore": zscore,
    "iqr": iqr,
}


def register_detector(name: str, detector) -> None:
    """Add a detector by name: ``detector(df, features=..., **params)``."""
    DETECTORS[name] = detector


def detect(df: DataFrame, features: Sequence[str], algorithm: str, **params) -> DataFrame:
    if algorithm not in DETECTORS:
        raise ValueError(f"unknown algorithm {algorithm}; known: {sorted(DETECTORS)}")
    return DETECTORS[algorithm](df, features=features, **params)


def anomaly_summary(scored: DataFrame, features: Sequence[str]) -> DataFrame:
    """Per feature the statistics of anomalies and normals, with counts and share, in one pass."""
    numeric = numeric_columns(scored, features)
    bad = F.col("is_anomaly")
    aggs = [
        F.struct(
            F.lit(c).alias("feature"),
            F.avg(F.when(bad, F.col(c))).alias("anomaly_mean"), F.avg(F.when(~bad, F.col(c))).alias("normal_mean"),
            F.stddev_samp(F.when(bad, F.col(c))).alias("anomaly_std"), F.stddev_samp(F.when(~bad, F.col(c))).alias("normal_std"),
            F.min(F.when(bad, F.col(c))).alias("anomaly_min"), F.max(F.when(bad, F.col(c))).alias("anomaly_max"),
            F.count_if(bad).alias("anomaly_count"), (F.count_if(bad) / F.count(F.lit(1)) * 100).alias("anomaly_percentage"),
        ).alias(f"f{i}")
        for i, c in enumerate(numeric)
    ]
    return scored.agg(*aggs).select(F.explode(F.array(*[F.col(f"f{i}") for i in range(len(numeric))])).alias("f")).select("f.*")


def score_summary(scored: DataFrame) -> DataFrame:
    s, bad = F.col("anomaly_score"), F.col("is_anomaly")
    return scored.agg(
        F.avg(F.when(bad, s)).alias("mean_anomaly_score"), F.avg(F.when(~bad, s)).alias("mean_normal_score"),
        F.min(F.when(bad, s)).alias("min_anomaly_score"), F.max(F.when(bad, s)).alias("max_anomaly_score"),
    )


def anomaly_samples(scored: DataFrame, order: Sequence[str], n: int = 10) -> DataFrame:
    """The first anomalous rows in row order."""
    return scored.where("is_anomaly").orderBy(*order).limit(n)
