"""Supervised models by name, training runs and tuning."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import partial, reduce
from itertools import product
from multiprocessing.pool import ThreadPool
from operator import or_

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LogisticRegression, NaiveBayes, OneVsRest, RandomForestClassifier,
)
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.metrics import class_scores, regression_metrics
from .columns import detect_target
from .impute import fill_median
from .linear import linear_fit, out_of_fold_fits, predict_by_fold, predict_linear
from .partials import fourier_features, fourier_map, landmark_map, landmark_rows
from .passes import beginning, lbfgs, newton, summed, summed_here
from .stats import column_stats, numeric_columns, one_row
from .trees import cell_predictor, cells, fit_forest as grow_forest, grid, with_bins

SEED = 42
MOMENT_FEATURES = 32


class Model:
    """A fitted model: ``transform`` adds a ``prediction`` column."""

    def __init__(self, apply: Callable[[DataFrame], DataFrame], native=None, importance: Mapping[str, float] | None = None):
        self._apply, self.native, self.importance = apply, native, importance

    def transform(self, df: DataFrame) -> DataFrame:
        return self._apply(df)


def assemble(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="error").transform(
        df.withColumns({f: F.col(f).cast("double") for f in features})
    )


def _importance(native, features: Sequence[str]) -> dict[str, float] | None:
    kind = type(native)
    if hasattr(kind, "featureImportances"):
        return dict(zip(features, map(float, native.featureImportances.toArray())))
    if hasattr(kind, "coefficientMatrix"):
        return dict(zip(features, map(float, np.abs(native.coefficientMatrix.toArray()).mean(axis=0))))
    if hasattr(kind, "coefficients"):
        return dict(zip(features, map(abs, map(float, native.coefficients.toArray()))))
    return None


def _vector_model(estimator, df: DataFrame, features: Sequence[str], target: str) -> Model:
    estimator = estimator.copy().setFeaturesCol("_features").setLabelCol("_label")
    native = estimator.fit(assemble(df, features).withColumn("_label", F.col(target).cast("double")))

    def apply(rows: DataFrame) -> DataFrame:
        out = native.transform(assemble(rows, features))
        return out.drop("_features", "rawPrediction")

    return Model(apply, native, _importance(native, features))


def _binned(df: DataFrame, features: Sequence[str], cuts: Sequence[np.ndarray]) -> DataFrame:
    names = [f"_b{i}" for i in range(len(features))]
    return assemble(with_bins(df, features, cuts), names).drop(*names)


def _cell_model(estimator, df: DataFrame, features: Sequence[str], target: str) -> Model:
    """Trees on the cells of binned columns, weighted by their rows: one pass over the rows, however many trees.

    The native trees split bin numbers; ``cuts`` of the model has the values between bins. Rows of too many cells are fitted as they are.
    """
    cuts = grid(df, features, target, SEED)
    if cuts is None:
        return _vector_model(estimator, df, features, target)
    some = cells(df, features, cuts, target).persist()
    estimator = estimator.copy().setFeaturesCol("_features").setLabelCol("_y").setWeightCol("_weight")
    native = estimator.fit(assemble(some, [f"_b{i}" for i in range(len(features))]))
    some.unpersist()
    model = Model(lambda rows: native.transform(_binned(rows, features, cuts)).drop("_features"), native, _importance(native, features))
    model.cuts = cuts
    return model


def penalised(df: DataFrame, target: str, alpha: float, l1_ratio: float, kind: str) -> LinearRegression:
    """LinearRegression whose objective equals the usual ridge / lasso / elastic-net one.

    Spark scales the squared penalty by the target deviation, so the strengths are mapped.
    """
    row = one_row(df, F.stddev_pop(F.col(target).cast("double")).alias("s"), F.count(F.col(target)).alias("n"))
    if kind == "ridge":
        l1, l2 = 0.0, alpha * row["s"] / row["n"]
    else:
        l1, l2 = alpha * l1_ratio, alpha * (1 - l1_ratio) * row["s"]
    total = l1 + l2
    return LinearRegression(
        regParam=total, elasticNetParam=l1 / total if total else 0.0, standardization=False, maxIter=1000, tol=1e-12,
        solver="normal" if l1 == 0 else "auto",
    )


def fit_linear(df, features, target, **p):
    """Least squares; a few features need only one aggregate pass over plain columns."""
    if len(features) > MOMENT_FEATURES:
        return _vector_model(LinearRegression(solver="normal"), df, features, target)
    fit = linear_fit(df, features, target)
    return Model(lambda d: predict_linear(d, fit), fit, {f: abs(w) for f, w in zip(features, fit.coefficients)})


def fit_penalised(df, features, target, kind="ridge", alpha=1.0, l1_ratio=0.5, **p):
    if kind == "ridge" and len(features) <= MOMENT_FEATURES:
        fit = linear_fit(df, features, target, alpha)
        return Model(lambda d: predict_linear(d, fit), fit, {f: abs(w) for f, w in zip(features, fit.coefficients)})
    ratio = {"ridge": 0.0, "lasso": 1.0}.get(kind, l1_ratio)
    return _vector_model(penalised(df, target, alpha, ratio, kind), df, features, target)


def fit_forest(df, features, target, n_estimators=100, max_depth=5, **p):
    cuts = grid(df, features, target, SEED) if n_estimators > 1 else None
    if cuts is None:
        return _vector_model(RandomForestRegressor(numTrees=n_estimators, maxDepth=max_depth, seed=SEED), df, features, target)
    forest = grow_forest(df, features, target, cuts, n_estimators, max_depth, SEED)
    by_cell = cell_predictor(cuts, forest.predict)

    @F.pandas_udf(T.DoubleType())
    def predict(*cols: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(float) for c in cols])
        if np.isnan(x).any():
            raise ValueError("a row to predict has a gap")
        return pd.Series(by_cell(x))

    model = Model(lambda d: d.withColumn("prediction", predict(*[F.col(f).cast("double") for f in features])), forest, dict(zip(features, map(float, forest.importance()))))
    model.function = by_cell
    return model


def fit_boosting(df, features, target, n_estimators=100, learning_rate=0.1, max_depth=3, **p):
    return _cell_model(GBTRegressor(maxIter=n_estimators, stepSize=learning_rate, maxDepth=max_depth, seed=SEED), df, features, target)


def fit_tree(df, features, target, max_depth=5, **p):
    return _cell_model(DecisionTreeRegressor(maxDepth=max_depth, seed=SEED), df, features, target)


def _scaler(df: DataFrame, features: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    stats = column_stats(df, features, "mean", "std_pop")
    return np.array([stats[f]["mean"] for f in features]), np.array([stats[f]["std_pop"] or 1.0 for f in features])


def _layers(sizes: Sequence[int], weights: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    at, out = 0, []
    for a, b in zip(sizes, sizes[1:]):
        out.append((weights[at : at + a * b].reshape(a, b), weights[at + a * b : at + a * b + b]))
        at += a * b + b
    return out


def _forward(x: np.ndarray, layers) -> list[np.ndarray]:
    """The rows after every layer; all but the last are rectified."""
    steps = [x]
    for i, (w, b) in enumerate(layers):
        x = x @ w + b
        steps.append(np.maximum(x, 0.0) if i < len(layers) - 1 else x)
        x = steps[-1]
    return steps


def _squared_error(rows: np.ndarray, layers) -> np.ndarray:
    """Sum of squared errors of the last column, and its gradient by the weights."""
    x, y = rows[:, :-1], rows[:, -1]
    steps = _forward(x, layers)
    gap = steps[-1][:, 0] - y
    delta, grads = 2.0 * gap[:, None], []
    for i in range(len(layers) - 1, -1, -1):
        grads.append(np.concatenate([(steps[i].T @ delta).ravel(), delta.sum(axis=0)]))
        if i:
            delta = (delta @ layers[i][0].T) * (steps[i] > 0)
    return np.concatenate([[gap @ gap], *grads[::-1]])


def fit_mlp_regressor(df, features, target, hidden=(100, 50), rounds=60, alpha=1e-4, **p):
    """Perceptron with rectified layers, trained on all rows at once by limited-memory BFGS.

    Every task sums squared errors and gradients of its rows; the sums meet in a tree. So the weights do not depend
    on how rows are dealt to tasks, up to rounding. The search starts on some rows and ends on all, where the loss no longer falls.
    """
    mean, std = _scaler(df, features)
    y_mean, y_std = (one_row(df, F.avg(F.col(target).cast("double")).alias("m"), F.stddev_pop(F.col(target).cast("double")).alias("s")))
    y_std = y_std or 1.0
    sizes = [len(features), *hidden, 1]
    rng = np.random.default_rng(SEED)
    start = np.concatenate([
        np.concatenate([rng.normal(scale=np.sqrt(2.0 / a), size=a * b), np.zeros(b)]) for a, b in zip(sizes, sizes[1:])
    ])
    names = [f"_s{i}" for i in range(len(features))]
    rows = df.dropna(subset=[*features, target]).select(
        *[((F.col(f).cast("double") - F.lit(float(m))) / F.lit(float(s))).alias(n) for n, f, m, s in zip(names, features, mean, std)],
        ((F.col(target).cast("double") - F.lit(y_mean)) / F.lit(y_std)).alias("_y"),
    ).persist()
    n = rows.count()
    if not n:
        raise ValueError("no rows to train on")

    some = beginning(rows, [*names, "_y"], n, SEED)

    def evaluate(points: list[np.ndarray], sums: Callable, n: int) -> list[tuple[float, np.ndarray]]:
        nets = [_layers(sizes, w) for w in points]
        total = sums(lambda x: np.concatenate([_squared_error(x, net) for net in nets]))
        return [(t[0] / n + alpha * (w @ w) / n, t[1:] / n + 2 * alpha * w / n) for w, t in zip(points, np.split(total, len(points)))]

    weights = start
    for sums, count, still in ((partial(summed_here, some), len(some), 1e-9), (partial(summed, rows, [*names, "_y"]), n, 1e-9 if len(some) == n else 1e-5)):
        weights = lbfgs(partial(evaluate, sums=sums, n=count), weights, rounds, still=still)
    rows.unpersist()
    final = _layers(sizes, weights)

    @F.pandas_udf(T.DoubleType())
    def predict(*cols: pd.Series) -> pd.Series:
        x = (np.column_stack([c.to_numpy(float) for c in cols]) - mean) / std
        return pd.Series(_forward(x, final)[-1][:, 0] * y_std + y_mean)

    model = Model(lambda d: d.withColumn("prediction", predict(*[F.col(f).cast("double") for f in features])))
    model.weights = weights
    return model


def _tube(gap: np.ndarray, epsilon: float, soft: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(loss, slope, curvature) of residuals: none inside the tube, quadratic over ``soft`` beyond its edge, then linear."""
    beyond = np.abs(gap) - epsilon
    out, bent = np.maximum(beyond, 0.0), (beyond > 0) & (beyond < soft)
    loss = np.where(bent, out**2 / (2 * soft), np.where(out > 0, out - soft / 2, 0.0))
    return loss, np.sign(gap) * np.minimum(out / soft, 1.0), bent / soft


def fit_svr(df, features, target, C=1.0, epsilon=0.1, landmarks=150, soft=0.01, **p):
    """RBF support-vector regression on standardised features with the epsilon-insensitive loss.

    At most ``landmarks`` rows span the kernel's space. The target is standardised, so ``epsilon`` counts its deviations. The loss
    is rounded over ``soft`` at the edge of the tube and minimised by Newton steps on moments summed over all
    rows, from where they end on some rows; rows inside the tube take no part.
    """
    mean, std = _scaler(df, features)
    y_mean, y_std = one_row(df, F.avg(F.col(target).cast("double")).alias("m"), F.stddev_pop(F.col(target).cast("double")).alias("s"))
    y_std = y_std or 1.0
    columns = [f"_c{i}" for i in range(len(features))]
    rows = df.dropna(subset=[*features, target]).select(*[F.col(f).cast("double").alias(c) for f, c in zip(features, columns)], F.col(target).cast("double").alias("_y")).persist()
    n = rows.count()
    if not n:
        raise ValueError("no rows to train on")
    some = beginning(rows, [*columns, "_y"], n, SEED)

    spanned = landmark_map((landmark_rows(rows, columns, landmarks, SEED) - mean) / std, 1.0 / len(features))
    width = spanned(np.zeros((1, len(features)))).shape[1]

    def mapped(x: np.ndarray) -> np.ndarray:
        return np.concatenate([spanned((x - mean) / std), np.ones((len(x), 1))], axis=1)

    free = np.append(np.ones(width), 0.0)  # the intercept is not shrunk

    def evaluate(w: np.ndarray, soft: float, sums: Callable, share: float) -> tuple[float, np.ndarray, np.ndarray]:
        def part(x):
            phi = mapped(x[:, :-1])
            loss, slope, curve = _tube(phi @ w - (x[:, -1] - y_mean) / y_std, epsilon, soft)
            return np.concatenate([[loss.sum()], phi.T @ slope, ((phi * curve[:, None]).T @ phi).ravel()])

        total = C / share * sums(part)
        return total[0] + w @ (free * w) / 2, total[1 : width + 2] + free * w, total[width + 2 :].reshape(width + 1, width + 1) + np.diag(free + 1e-9)

    def losses(points: list[np.ndarray], soft: float, sums: Callable, share: float) -> np.ndarray:
        w = np.stack(points, axis=1)
        total = sums(lambda x: _tube(mapped(x[:, :-1]) @ w - ((x[:, -1] - y_mean) / y_std)[:, None], epsilon, soft)[0].sum(axis=0))
        return C / share * total + (w * free[:, None] * w).sum(axis=0) / 2

    weights = np.zeros(width + 1)
    here, everywhere = (partial(summed_here, some), len(some) / n), (partial(summed, rows, [*columns, "_y"]), 1.0)
    steps = [(edge * soft, *here) for edge in (100, 30, 10, 3, 1)]  # a round tube first, then a sharp one
    for edge, sums, share in [*steps, (soft, *everywhere)]:
        given = {"soft": edge, "sums": sums, "share": share}
        weights = newton(partial(evaluate, **given), partial(losses, **given), weights, 15)
    rows.unpersist()

    @F.pandas_udf(T.DoubleType())
    def predict(*cols: pd.Series) -> pd.Series:
        return pd.Series(mapped(np.column_stack([c.to_numpy(float) for c in cols])) @ weights * y_std + y_mean)

    model = Model(lambda d: d.withColumn("prediction", predict(*[F.col(f).cast("double") for f in features])))
    model.weights, model.mapped, model.scale = weights, mapped, (y_mean, y_std)
    return model


def fit_knn(df, features, target, key=None, n_neighbors=5, classify=False, **p):
    """k nearest neighbours on standardised features (exact in a few columns, by a forest in many); needs the row key."""
    from .neighbors import knn_predict

    mean, std = _scaler(df, features)
    names = [f"_k{i}" for i in range(len(features))]

    def scaled(d):
        return d.withColumns({n: (F.col(f) - F.lit(float(m))) / F.lit(float(s)) for n, f, m, s in zip(names, features, mean, std)})

    train = scaled(df)

    def apply(rows):
        return rows.join(knn_predict(train, scaled(rows), key, names, target, n_neighbors, classify), key)

    return Model(apply)


# ---- classification: string or numeric classes are indexed in sorted order ----


def _class_model(make, df, features, target, prepare=None, cuts=None) -> Model:
    kind = df.schema[target].dataType
    if cuts is not None:  # rows of a cell and class are one weighted row
        df = cells(df, features, cuts, target, by_class=True).persist()
    indexer = StringIndexer(inputCol="_class", outputCol="_label", stringOrderType="alphabetAsc").fit(df.withColumn("_class", F.col(target).cast("string")))
    add = prepare or (lambda d: assemble(d, features)) if cuts is None else lambda d: _binned(d, features, cuts)
    indexed = indexer.transform(df.withColumn("_class", F.col(target).cast("string")))
    native = make(len(indexer.labels)).fit(add(indexed) if cuts is None else assemble(indexed, [f"_b{i}" for i in range(len(features))]))
    if cuts is not None:
        df.unpersist()
    back = IndexToString(inputCol="_index", outputCol="_name", labels=indexer.labels)

    def apply(rows):
        out = native.transform(add(rows)).withColumnRenamed("prediction", "_index")
        out = back.transform(out).withColumn("prediction", F.col("_name").cast(kind))
        return out.drop("_features", "rawPrediction", "_index", "_name")

    model = Model(apply, native, _importance(native, features) if prepare is None else None)
    model.labels = indexer.labels
    if cuts is not None:
        model.cuts = cuts
    return model


_COLUMNS = {"featuresCol": "_features", "labelCol": "_label"}


def fit_logistic(df, features, target, C=1.0, **p):
    n = df.count()
    return _class_model(lambda k: LogisticRegression(maxIter=1000, regParam=1.0 / (C * n), standardization=False, family="multinomial", **_COLUMNS), df, features, target)


def fit_forest_classifier(df, features, target, n_estimators=100, max_depth=5, **p):
    return _class_model(lambda k: RandomForestClassifier(numTrees=n_estimators, maxDepth=max_depth, seed=SEED, **_COLUMNS), df, features, target)


def fit_tree_classifier(df, features, target, max_depth=5, **p):
    cuts = grid(df, features, target, SEED)
    weighted = {} if cuts is None else {"weightCol": "_weight"}
    return _class_model(lambda k: DecisionTreeClassifier(maxDepth=max_depth, seed=SEED, **weighted, **_COLUMNS), df, features, target, cuts=cuts)


def fit_boosting_classifier(df, features, target, n_estimators=100, learning_rate=0.1, max_depth=3, **p):
    cuts = grid(df, features, target, SEED)
    weighted = {} if cuts is None else {"weightCol": "_weight"}

    def make(k):
        base = GBTClassifier(maxIter=n_estimators, stepSize=learning_rate, maxDepth=max_depth, seed=SEED, **weighted, **_COLUMNS)
        return base if k == 2 else OneVsRest(classifier=base, parallelism=4, **weighted, **_COLUMNS)

    return _class_model(make, df, features, target, cuts=cuts)


def fit_naive_bayes(df, features, target, **p):
    return _class_model(lambda k: NaiveBayes(modelType="gaussian", **_COLUMNS), df, features, target)


def _class_shares(x: np.ndarray, layers) -> list[np.ndarray]:
    """The rows after every layer: logistic inside, shares of the classes at the end."""
    steps = [x]
    for w, b in layers[:-1]:
        steps.append(1.0 / (1.0 + np.exp(-np.clip(steps[-1] @ w + b, -500.0, 500.0))))
    z = steps[-1] @ layers[-1][0] + layers[-1][1]
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return [*steps, z / z.sum(axis=1, keepdims=True)]


def _log_loss(rows: np.ndarray, layers) -> np.ndarray:
    """Sum of the negative log shares of the classes in the last column, and its gradient by the weights."""
    steps, at = _class_shares(rows[:, :-1], layers), (np.arange(len(rows)), rows[:, -1].astype(int))
    loss, delta, grads = -np.log(np.maximum(steps[-1][at], 1e-300)).sum(), steps[-1].copy(), []
    delta[at] -= 1.0
    for i in range(len(layers) - 1, -1, -1):
        grads.append(np.concatenate([(steps[i].T @ delta).ravel(), delta.sum(axis=0)]))
        if i:
            delta = (delta @ layers[i][0].T) * steps[i] * (1.0 - steps[i])
    return np.concatenate([[loss], *grads[::-1]])


def fit_mlp_classifier(df, features, target, hidden=(100,), max_iter=100, **p):
    """Perceptron with logistic layers and class shares at the end, trained like ``fit_mlp_regressor``: the search starts on some
    rows and ends on all, where the loss no longer falls."""
    mean, std = _scaler(df, features)
    indexer = StringIndexer(inputCol="_class", outputCol="_label", stringOrderType="alphabetAsc").fit(df.withColumn("_class", F.col(target).cast("string")))
    names = [f"_s{i}" for i in range(len(features))]
    rows = indexer.transform(df.withColumn("_class", F.col(target).cast("string"))).select(
        *[((F.col(f).cast("double") - F.lit(float(m))) / F.lit(float(s))).alias(n) for n, f, m, s in zip(names, features, mean, std)], "_label"
    ).persist()
    absent = [F.col(c).isNull() | F.isnan(c) for c in names]
    n, gaps = one_row(rows, F.count("_label").alias("n"), F.count_if(reduce(or_, absent)).alias("gaps"))
    if not n or gaps:
        raise ValueError(f"{gaps} rows without a value among {n} rows to train on")
    some = beginning(rows, [*names, "_label"], n, SEED)
    sizes = [len(features), *hidden, len(indexer.labels)]
    rng = np.random.default_rng(SEED)
    weights = np.concatenate([np.concatenate([rng.normal(scale=np.sqrt(2.0 / (a + b)), size=a * b), np.zeros(b)]) for a, b in zip(sizes, sizes[1:])])

    def evaluate(points: list[np.ndarray], sums: Callable, n: int) -> list[tuple[float, np.ndarray]]:
        nets = [_layers(sizes, w) for w in points]
        total = sums(lambda x: np.concatenate([_log_loss(x, net) for net in nets])) / n
        return [(t[0], t[1:]) for t in np.split(total, len(points))]

    for sums, count, still in ((partial(summed_here, some), len(some), 1e-6), (partial(summed, rows, [*names, "_label"]), n, 1e-6 if len(some) == n else 1e-5)):
        weights = lbfgs(partial(evaluate, sums=sums, n=count), weights, max_iter, still=still)
    rows.unpersist()
    final = _layers(sizes, weights)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def shares(*cols: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(float) for c in cols])
        if np.isnan(x).any():
            raise ValueError("a row to predict has a gap")
        return pd.Series(list(_class_shares((x - mean) / std, final)[-1]))

    labels, kind = F.array(*map(F.lit, indexer.labels)), df.schema[target].dataType
    first_best = F.array_position("_shares", F.array_max("_shares")).cast("int")
    model = Model(lambda d: d.withColumn("_shares", shares(*[F.col(f).cast("double") for f in features])).withColumns(
        {"probability": array_to_vector("_shares"), "prediction": F.element_at(labels, first_best).cast(kind)}).drop("_shares"))
    model.labels, model.weights = indexer.labels, weights
    return model


def _short_of_margin(z: np.ndarray, soft: float) -> tuple[np.ndarray, np.ndarray]:
    """(loss, slope) of shortfalls: none below 0, quadratic up to ``soft``, then linear."""
    up = np.maximum(z, 0.0)
    return np.where(up < soft, up**2 / (2 * soft), up - soft / 2), np.minimum(up / soft, 1.0)


def fit_svc(df, features, target, C=1.0, width=100, calibrate=False, soft=0.1, **p):
    """RBF support-vector classes: random cosines, one linear machine per class.

    The cosines are made batch by batch inside the passes and never stored. The hinge is rounded over ``soft`` and minimised by
    limited-memory BFGS on sums over all rows, for all classes in the same passes, from where it ends on some rows. ``calibrate``
    adds class probabilities by a logistic fit on the margins.
    """
    mean, std = _scaler(df, features)
    frequencies, phases = fourier_map(len(features), width, 1.0 / len(features), SEED)
    indexer = StringIndexer(inputCol="_class", outputCol="_label", stringOrderType="alphabetAsc").fit(df.withColumn("_class", F.col(target).cast("string")))
    columns = [f"_c{i}" for i in range(len(features))]
    indexed = indexer.transform(df.withColumn("_class", F.col(target).cast("string")))
    rows = indexed.select(*[F.col(f).cast("double").alias(c) for f, c in zip(features, columns)], "_label").persist()
    absent = [F.col(c).isNull() | F.isnan(c) for c in columns]
    n, gaps = one_row(rows, F.count("_label").alias("n"), F.count_if(reduce(or_, absent)).alias("gaps"))
    if not n or gaps:
        raise ValueError(f"{gaps} rows without a value among {n} rows to train on")

    def cosines(x: np.ndarray) -> np.ndarray:
        return fourier_features((x - mean) / std, frequencies, phases)

    def spread(x: np.ndarray) -> np.ndarray:
        mapped = cosines(x[:, :-1])
        return np.concatenate([mapped.sum(axis=0), (mapped**2).sum(axis=0)])

    everywhere = partial(summed, rows, [*columns, "_label"])
    some = beginning(rows, [*columns, "_label"], n, SEED)
    first, second = np.split(everywhere(spread) / n, 2)
    scale = np.sqrt(np.maximum(second - first**2, 1e-12))  # weights are shrunk as those of standardised columns
    classes = len(indexer.labels)

    def evaluate(points: list[np.ndarray], sums: Callable, count: int) -> list[tuple[float, np.ndarray]]:
        """The machines of all classes together: their mean losses and gradients at several points from one pass."""
        def part(x):
            phi = np.column_stack([cosines(x[:, :-1]) / scale, np.ones(len(x))])
            y, out = np.where(x[:, -1:] == np.arange(classes), 1.0, -1.0), []
            for w in points:
                loss, slope = _short_of_margin(1 - y * (phi @ w.reshape(width + 1, classes)), soft)
                out += [[loss.sum()], (phi.T @ (-y * slope)).ravel()]
            return np.concatenate(out)

        free = np.repeat(np.append(np.full(width, 1.0 / (C * count)), 0.0), classes)  # the intercepts are not shrunk
        return [(t[0] + w @ (free * w) / 2, t[1:] + free * w) for w, t in zip(points, np.split(sums(part) / count, len(points)))]

    weights = np.zeros((width + 1) * classes)
    for sums, count, rounds, still in ((partial(summed_here, some), len(some), 200, 1e-6), (everywhere, n, 50, 1e-4)):
        weights = lbfgs(partial(evaluate, sums=sums, count=count), weights, rounds, still=still)
    machines = weights.reshape(width + 1, classes) / np.append(scale, 1.0)[:, None]
    rows.unpersist()

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def margins(*cols: pd.Series) -> pd.Series:
        return pd.Series(list(cosines(np.column_stack([c.to_numpy(float) for c in cols])) @ machines[:-1] + machines[-1]))

    def marked(d):
        return d.withColumn("_margins", margins(*[F.col(f).cast("double") for f in features]))

    if calibrate:
        model = _class_model(
            lambda k: LogisticRegression(family="multinomial", **_COLUMNS), df, features, target,
            lambda d: marked(d).withColumn("_features", array_to_vector("_margins")).drop("_margins"),
        )
    else:
        names, kind = F.array(*map(F.lit, indexer.labels)), df.schema[target].dataType
        first_best = F.array_position("_margins", F.array_max("_margins")).cast("int")
        model = Model(lambda d: marked(d).withColumn("prediction", F.element_at(names, first_best).cast(kind)).drop("_margins"))
        model.labels = indexer.labels
    model.machines = machines
    return model


# Model names per task.
REGRESSORS = {
    "linear_regression": fit_linear, "random_forest": fit_forest, "gradient_boosting": fit_boosting, "xgboost": fit_boosting,
    "neural_network": fit_mlp_regressor, "svm": fit_svr, "ridge": partial(fit_penalised, kind="ridge"),
    "lasso": partial(fit_penalised, kind="lasso"), "elastic_net": partial(fit_penalised, kind="elastic_net"),
    "knn": fit_knn, "decision_tree": fit_tree,
}
CLASSIFIERS = {
    "random_forest": fit_forest_classifier, "gradient_boosting": fit_boosting_classifier, "svm": fit_svc, "logistic_regression": fit_logistic,
    "naive_bayes": fit_naive_bayes, "knn": partial(fit_knn, classify=True), "decision_tree": fit_tree_classifier,
    "neural_network": fit_mlp_classifier,
}


def fit_model(df: DataFrame, name: str, features: Sequence[str], target: str, task: str = "regression", **params) -> Model:
    registry = REGRESSORS if task == "regression" else CLASSIFIERS
    if name not in registry:
        raise ValueError(f"model {name} not available for {task}; known: {sorted(registry)}")
    return registry[name](df, list(features), target, **params)


def register_model(name: str, fit: Callable, task: str = "regression") -> None:
    """Add a model by name: ``fit(df, features, target, **params) -> Model``."""
    (REGRESSORS if task == "regression" else CLASSIFIERS)[name] = fit


# ---- splits ----


def split_by_hash(df: DataFrame, key: Sequence[str], share: float = 0.2, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(train, test) by a seeded hash of the row key: the same rows on every run and cluster."""
    u = F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(1_000_000)) / 1_000_000
    return df.where(u >= share), df.where(u < share)


def split_by_modulo(df: DataFrame, key: Column, parts: int = 5, test: int = 0) -> tuple[DataFrame, DataFrame]:
    """(train, test) by a numeric key modulo ``parts``."""
    return df.where(F.pmod(key, F.lit(parts)) != test), df.where(F.pmod(key, F.lit(parts)) == test)


def stratified_split(df: DataFrame, label: str, order: Sequence[Column | str], share: float = 0.2, **sizes) -> DataFrame:
    """Rows with ``is_test``: the first ``share`` of every class in the given order.

    Positions inside a class are computed by a range-partitioned sort, so one class may hold
    most of the rows.
    """
    from .windows import with_position

    placed = with_position(df, order, [label], "_at", **sizes)
    totals = df.groupBy(F.col(label).alias("_l")).agg(F.count(F.lit(1)).alias("_n"))
    out = placed.join(totals, F.col(label).eqNullSafe(F.col("_l")))
    return out.withColumn("is_test", F.col("_at") < F.round(F.col("_n") * F.lit(share))).drop("_at", "_n", "_l")


# ---- importance, runs, tuning ----


def importance_rows(df: DataFrame, model: Model, features: Sequence[str]) -> DataFrame:
    """(feature, importance) sorted: native scores, |coefficients|, or equal shares."""
    given = model.importance or {f: 1.0 / len(features) for f in features}
    rows = sorted(given.items(), key=lambda kv: (-kv[1], kv[0]))
    return df.sparkSession.createDataFrame(rows, "feature string, importance double")


@dataclass
class Run:
    model: Model
    report: DataFrame
    importance: DataFrame
    scored_test: DataFrame


def train(
    df: DataFrame, name: str, key: str, target: str | None = None, features: Sequence[str] | None = None, test_share: float = 0.2,
    folds: int = 5, cross_validate: bool = True, **params,
) -> Run:
    """Fill, split, fit, score, cross-validate and rank features; one report row."""
    started = time.time()
    target = detect_target(df, target)
    features = list(features) if features else [c for c in numeric_columns(df) if c not in (target, key)]
    ready = fill_median(df, [*features, target]).persist()
    train_rows, test_rows = split_by_hash(ready, [key], test_share)
    extra = {"key": key} if name == "knn" else {}
    model = fit_model(train_rows, name, features, target, **extra, **params)
    scored = {s: model.transform(rows) for s, rows in (("train", train_rows), ("test", test_rows))}
    scores = {s: one_row(d, F.count(F.lit(1)).alias("n"), *[m.alias(k) for k, m in regression_metrics(target, "prediction").items()]) for s, d in scored.items()}
    cv = fold_rmse(ready, name, key, features, target, folds, **extra, **params) if cross_validate else []
    ready.unpersist()
    row = (
        name, target, features, scores["train"]["n"], scores["test"]["n"],
        *[float(scores[s][m]) for s in ("train", "test") for m in ("mse", "rmse", "mae", "r2")],
        float(np.mean(cv)) if cv else None, float(np.std(cv)) if cv else None, cv, time.time() - started,
    )
    schema = (
        "algorithm string, target string, features array<string>, train_samples bigint, test_samples bigint, train_mse double, train_rmse double, train_mae double, "
        "train_r2 double, test_mse double, test_rmse double, test_mae double, test_r2 double, cv_mean double, cv_std double, cv_scores array<double>, seconds double"
    )
    return Run(model, df.sparkSession.createDataFrame([row], schema), importance_rows(df, model, features), scored["test"])


def fold_rmse(df: DataFrame, name: str, key: str, features: Sequence[str], target: str, folds: int = 5, fold: Column | None = None, **params) -> list[float]:
    """Held-out RMSE per fold. Linear and ridge models need two passes in all; others one fit per fold."""
    rows = df.withColumn("_fold", fold if fold is not None else F.pmod(F.xxhash64(key, F.lit(SEED)), F.lit(folds)).cast("int"))
    if name in ("linear_regression", "ridge"):
        fits = out_of_fold_fits(rows, features, target, "_fold", params.get("alpha", 1.0) if name == "ridge" else 0.0)
        scored = predict_by_fold(rows, fits, "_fold")
        found = scored.groupBy("_fold").agg(regression_metrics(target, "prediction")["rmse"].alias("r")).orderBy("_fold").collect()
        return [r["r"] for r in found]
    out = []
    for i in range(folds):
        model = fit_model(rows.where(F.col("_fold") != i), name, features, target, **params)
        scored = model.transform(rows.where(F.col("_fold") == i))
        out.append(one_row(scored, regression_metrics(target, "prediction")["rmse"].alias("r"))["r"])
    return out


# Settings tried per model. The kernel width has one setting, as both usual rules agree on standardised columns;
# an unlimited depth is not offered.
GRIDS = {
    "random_forest": {"n_estimators": [50, 100], "max_depth": [10, 20]},
    "gradient_boosting": {"n_estimators": [50, 100], "learning_rate": [0.1, 0.2]},
    "svm": {"C": [0.1, 1.0, 10.0]},
}


def tuned(
    df: DataFrame, name: str, features: Sequence[str], target: str, folds: int = 3, parallelism: int = 2, key: Sequence[str] = (),
) -> tuple[DataFrame, Model]:
    """(settings with their cross-validated squared error, best first; the model of the best, fitted on all rows).

    Folds follow a hash of ``key`` (or of the values); some settings are fitted at a time. A model without a grid has one
    row without an error and its default settings.
    """
    schema = "settings map<string,double>, mse double"
    grid = GRIDS.get(name)
    if grid is None:
        return df.sparkSession.createDataFrame([({}, None)], schema), fit_model(df, name, features, target)
    settings = [dict(zip(grid, values)) for values in product(*grid.values())]
    fold = F.pmod(F.xxhash64(*(key or [*features, target]), F.lit(SEED)), F.lit(folds)).cast("int")
    ready = df.dropna(subset=[*features, target]).persist()

    def error(setting: dict) -> float:
        return float(np.mean(np.square(fold_rmse(ready, name, "", features, target, folds, fold, **setting))))

    with ThreadPool(parallelism) as pool:
        errors = pool.map(inheritable_thread_target(df.sparkSession)(error), settings)
    best = settings[int(np.argmin(errors))]
    model = fit_model(ready, name, features, target, **best)
    model.settings = best
    ready.unpersist()
    rows = [({k: float(v) for k, v in s.items()}, e) for s, e in zip(settings, errors)]
    return df.sparkSession.createDataFrame(sorted(rows, key=lambda r: r[1]), schema), model


def tune(df: DataFrame, name: str, features: Sequence[str], target: str, folds: int = 3, parallelism: int = 2) -> DataFrame:
    """Grid search by cross-validated squared error: one row per setting, best first (see ``tuned`` for the model)."""
    return tuned(df, name, features, target, folds, parallelism)[0]


def member_scores(df: DataFrame, predictions: Mapping[str, Column] | Sequence[str], target: str, task: str = "regression") -> DataFrame:
    """Metrics of several prediction columns, one row per model, from one pass."""
    names = list(predictions)
    if task == "regression":
        aggs = []
        for i, n in enumerate(names):
            m = regression_metrics(target, n)
            aggs.append(F.struct(F.lit(n).alias("model"), m["mse"].alias("mse"), m["mae"].alias("mae"), m["r2"].alias("r2")).alias(f"m{i}"))
        return df.agg(*aggs).select(F.explode(F.array(*[F.col(f"m{i}") for i in range(len(names))])).alias("m")).select("m.*")
    long = df.select(
        F.col(target).cast("string").alias("_y"),
        F.explode(F.array(*[F.struct(F.lit(n).alias("model"), F.col(n).cast("string").alias("p")) for n in names])).alias("e"),
    ).select("_y", "e.model", F.col("e.p").alias("_pred"))
    return class_scores(long, "_y", "_pred", ["model"])
