"""Ensembles of models: voting, bagging, stacking, blending, boosting and weighting."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage
from .crossval import cross_validate, cv_summary
from .linear import moments
from .models import SEED, Model, fit_model, member_scores, split_by_hash


def fit_members(df: DataFrame, names: Sequence[str], features: Sequence[str], target: str, task: str = "regression", params: Mapping[str, dict] | None = None) -> dict[str, Model]:
    params = params or {}
    return {n: fit_model(df, n, features, target, task, **params.get(n, {})) for n in names}


def with_members(df: DataFrame, members: Mapping[str, Model], task: str = "regression") -> DataFrame:
    """Each member's prediction (and class probabilities) side by side on the same rows."""
    out = df
    for name, model in members.items():
        had = set(out.columns)
        scored = model.transform(out).withColumnRenamed("prediction", f"_{name}")
        if "probability" in scored.columns and "probability" not in had:
            scored = scored.withColumn(f"_{name}_p", vector_to_array("probability")).drop("probability")
        out = scored
    return out


def _majority(columns: Sequence[Column]) -> Column:
    """Most frequent of a few values, ties to the smallest."""
    values = F.array_sort(F.array(*columns))
    counted = F.transform(
        F.array_distinct(values), lambda v: F.struct((-F.size(F.filter(values, lambda x: x == v))).alias("n"), v.alias("v"))
    )
    return F.array_min(counted)["v"]


def vote(df: DataFrame, members: Mapping[str, Model], task: str = "regression", voting: str = "soft", name: str = "prediction") -> DataFrame:
    """Mean prediction, or for classes the mean probability (soft) or the majority (hard).

    Members without probabilities count as certain of their class in a soft vote.
    """
    out = with_members(df, members, task)
    names = [f"_{m}" for m in members]
    if task == "regression":
        total = F.lit(0.0)
        for n in names:
            total = total + F.col(n)
        return out.withColumn(name, total / F.lit(float(len(names))))
    if voting == "hard":
        return out.withColumn(name, _majority([F.col(n) for n in names]))
    labels = next(m.labels for m in members.values() if hasattr(m, "labels"))
    weights = []
    for n in names:
        if f"{n}_p" in out.columns:
            weights.append(F.col(f"{n}_p"))
        else:
            weights.append(F.array(*[F.when(F.col(n).cast("string") == v, 1.0).otherwise(0.0) for v in labels]))
    total = weights[0]
    for w in weights[1:]:
        total = F.zip_with(total, w, lambda a, b: a + b)
    best = F.array_position(total, F.array_max(total))
    return out.withColumn(name, F.element_at(F.array(*[F.lit(v) for v in labels]), best.cast("int")))


def bag(df: DataFrame, name: str, features: Sequence[str], target: str, task: str = "regression", n_estimators: int = 10, seed: int = SEED, **params) -> dict[str, Model]:
    """Copies of one model on row samples with replacement (Poisson counts per row)."""
    return {
        f"{name}_{i}": fit_model(df.sample(True, 1.0, seed + i), name, features, target, task, **params) for i in range(n_estimators)
    }


def stack(df: DataFrame, names: Sequence[str], key: Sequence[str], features: Sequence[str], target: str, task: str = "regression", folds: int = 3, params: Mapping[str, dict] | None = None):
    """(apply, meta model): a linear (logistic) model over out-of-fold member predictions."""
    rows = df.withColumn("_fold", F.pmod(F.xxhash64(*key, F.lit(SEED)), F.lit(folds)))
    parts = None
    for f in range(folds):
        members = fit_members(rows.where(F.col("_fold") != f), names, features, target, task, params)
        part = _meta_columns(with_members(rows.where(F.col("_fold") == f), members, task), members, task).drop("_fold")
        parts = part if parts is None else parts.unionByName(part)
    meta_features = [c for c in parts.columns if c.startswith("meta_")]
    meta = fit_model(parts, "linear_regression" if task == "regression" else "logistic_regression", meta_features, target, task)
    full = fit_members(df, names, features, target, task, params)

    def apply(d: DataFrame) -> DataFrame:
        return meta.transform(_meta_columns(with_members(d, full, task), full, task)).drop("probability", *meta_features)

    return Model(apply), meta


def _meta_columns(df: DataFrame, members: Mapping[str, Model], task: str) -> DataFrame:
    out = df
    for name, model in members.items():
        if task == "regression":
            out = out.withColumn(f"meta_{name}", F.col(f"_{name}"))
        elif f"_{name}_p" in df.columns:
            out = out.withColumns({f"meta_{name}_{i}": F.col(f"_{name}_p")[i] for i in range(len(model.labels))})
        else:
            labels = model.labels
            out = out.withColumns({f"meta_{name}_{i}": (F.col(f"_{name}").cast("string") == v).cast("double") for i, v in enumerate(labels)})
    return out.drop(*[c for m in members for c in (f"_{m}", f"_{m}_p")])


def blend(df: DataFrame, names: Sequence[str], key: Sequence[str], features: Sequence[str], target: str, task: str = "regression", share: float = 0.2, params: Mapping[str, dict] | None = None):
    """Like stacking, with one hold-out part instead of folds."""
    train, held = split_by_hash(df, key, share, SEED + 7)
    members = fit_members(train, names, features, target, task, params)
    ready = _meta_columns(with_members(held, members, task), members, task)
    meta_features = [c for c in ready.columns if c.startswith("meta_")]
    meta = fit_model(ready, "linear_regression" if task == "regression" else "logistic_regression", meta_features, target, task)

    def apply(d: DataFrame) -> DataFrame:
        return meta.transform(_meta_columns(with_members(d, members, task), members, task)).drop("probability", *meta_features)

    return Model(apply), meta


def boost(df: DataFrame, features: Sequence[str], target: str, task: str = "regression", **params) -> Model:
    return fit_model(df, "gradient_boosting", features, target, task, **params)


def simplex_weights(df: DataFrame, predictions: Sequence[str], target: str, steps: int = 5000) -> dict[str, float]:
    """Non-negative weights with sum one that minimise the squared error of the mix.

    Rows enter once, as the cross products of the member errors; the small quadratic problem
    is solved by projected gradients.
    """
    errors = df.select(*[(F.col(p) - F.col(target)).alias(f"e{i}") for i, p in enumerate(predictions)])
    m = moments(errors, errors.columns)[None]
    gram = m.scatter / m.n + np.outer(m.mean, m.mean)
    k = len(predictions)
    w, rate = np.full(k, 1.0 / k), 1.0 / max(np.linalg.eigvalsh(gram).max(), 1e-300)
    for _ in range(steps):
        new = _to_simplex(w - rate * (gram @ w))
        if np.abs(new - w).max() < 1e-12:
            w = new
            break
        w = new
    return {p: float(v) for p, v in zip(predictions, w)}


def vote_patterns(df: DataFrame, predictions: Sequence[str], target: str) -> DataFrame:
    """(pattern, right, n): how often members vote alike. ``pattern`` has for each member the first one with the same vote, ``right``
    the first member that votes for the true class (-1: none does). The number of rows depends on the number of members alone."""
    votes = F.array(*[F.col(p).cast("string") for p in predictions])
    first = F.transform(F.col("_votes"), lambda v: F.array_position(F.col("_votes"), v).cast("int") - 1)
    right = F.coalesce(F.array_position(F.col("_votes"), F.col(target).cast("string")).cast("int") - 1, F.lit(-1))
    return df.select(target, votes.alias("_votes")).where(f"exists(_votes, v -> v is not null) and `{target}` is not null").select(
        F.transform("_votes", lambda v: F.coalesce(v, F.lit("\0"))).alias("_votes"), target
    ).groupBy(first.alias("pattern"), right.alias("right")).agg(F.count(F.lit(1)).alias("n"))


def class_weights(df: DataFrame, predictions: Sequence[str], target: str, most: int = 6, settings: int = 200_000) -> dict[str, float]:
    """Weights with sum one under which the weighted vote of the members is right most often.

    Rows enter as counts of ``vote_patterns``; on those every weighting by whole numbers up to ``most`` is tried (a smaller
    number if there were more than ``settings`` of them). A tie between classes counts as wrong; of equally good weightings the one
    nearest to equal weights is taken.
    """
    k = len(predictions)
    rows = vote_patterns(df, predictions, target).collect()
    while most > 1 and (most + 1) ** k > settings:
        most -= 1
    if 2**k > settings:
        raise ValueError("too many members")
    grid = np.stack(np.meshgrid(*[np.arange(most + 1)] * k, indexing="ij"), axis=-1).reshape(-1, k)[1:]
    won = np.zeros(len(grid))
    for r in rows:
        if r["right"] < 0:
            continue
        groups = np.array(r["pattern"])
        sums = {int(g): grid[:, groups == g].sum(axis=1) for g in set(groups.tolist())}
        others = [v for g, v in sums.items() if g != r["right"]]
        won += r["n"] * (sums[r["right"]] > np.max(others, axis=0) if others else sums[r["right"]] > 0)
    shares = grid / grid.sum(axis=1, keepdims=True)
    best = np.lexsort((np.round(((shares - 1 / k) ** 2).sum(axis=1), 12), -won))[0]
    return {p: float(v) for p, v in zip(predictions, shares[best])}


def weighted_vote(df: DataFrame, weights: Mapping[str, float], name: str = "prediction") -> DataFrame:
    """The class with the largest sum of weights, ties to the smaller one; members without a vote do not count."""
    kind = df.schema[next(iter(weights))].dataType
    votes = F.filter(F.array(*[F.struct(F.col(p).cast("string").alias("v"), F.lit(w).alias("w")) for p, w in weights.items()]), lambda e: e["v"].isNotNull())
    summed = F.transform(F.array_distinct(F.transform("_cast", lambda e: e["v"])), lambda v: F.struct(
        (-F.round(F.aggregate(F.filter("_cast", lambda e: e["v"] == v), F.lit(0.0), lambda s, e: s + e["w"]), 9)).alias("s"), v.alias("v")))
    return df.withColumn("_cast", votes).withColumn(name, F.array_min(summed)["v"].cast(kind)).drop("_cast")


def _to_simplex(v: np.ndarray) -> np.ndarray:
    falling = np.sort(v)[::-1]
    total = np.cumsum(falling) - 1
    last = np.nonzero(falling - total / np.arange(1, len(v) + 1) > 0)[0][-1]
    return np.maximum(v - total[last] / (last + 1), 0)


def weighted(df: DataFrame, weights: Mapping[str, float], name: str = "prediction") -> DataFrame:
    total = F.lit(0.0)
    for p, w in weights.items():
        total = total + F.col(p) * F.lit(w)
    return df.withColumn(name, total)


def member_cross_validation(
    df: DataFrame, names: Sequence[str], features: Sequence[str], target: str, scoring=None, fold: str = "fold", task: str = "regression", **params,
) -> DataFrame:
    """Mean and deviation of the cross-validation score of each member: r2, or accuracy for classes, if no other is named."""
    out = None
    scoring = scoring or ("r2" if task == "regression" else "accuracy")
    for n in names:
        one = cv_summary(cross_validate(df, n, features, target, scoring, task, False, fold, **params.get(n, {})))
        one = one.select(F.lit(n).alias("model"), "metric", "test_mean", "test_std")
        out = one if out is None else out.unionByName(one)
    return out


def build(
    df: DataFrame, key: Sequence[str], names: Sequence[str], features: Sequence[str], target: str, methods: Sequence[str] = ("voting",),
    task: str = "regression", params: Mapping[str, dict] | None = None,
) -> DataFrame:
    """One row per ensemble method and member with its held-out scores and the sizes."""
    train, test = split_by_hash(df, key)
    members = fit_members(train, names, features, target, task, params)
    scored = with_members(test, members, task).persist()
    made = member_scores(scored, {f"_{n}": None for n in names}, target, task)
    made = made.select(F.lit("member").alias("kind"), F.expr("substring(model, 2)").alias("model"), *[c for c in made.columns if c != "model"])
    for method in methods:
        if method == "voting":
            out = vote(test, members, task)
        elif method == "bagging":
            out = vote(test, bag(train, names[0], features, target, task, **((params or {}).get(names[0], {}))), task)
        elif method == "stacking":
            out = stack(train, names, key, features, target, task, params=params)[0].transform(test)
        elif method == "blending":
            out = blend(train, names, key, features, target, task, params=params)[0].transform(test)
        elif method == "boosting":
            out = boost(train, features, target, task, **((params or {}).get("gradient_boosting", {}))).transform(test)
        elif method == "weighted":
            fitting, holding = split_by_hash(train, key, 0.25, SEED + 1)
            held = with_members(holding, fit_members(fitting, names, features, target, task, params), task)
            columns = [f"_{n}" for n in names]
            if task == "regression":
                out = weighted(scored, simplex_weights(held, columns, target))
            else:
                out = weighted_vote(scored, class_weights(held, columns, target))
        else:
            raise ValueError(f"unknown ensemble method {method}")
        one = member_scores(out, {"prediction": None}, target, task)
        made = made.unionByName(one.select(F.lit("ensemble").alias("kind"), F.lit(method).alias("model"), *[c for c in one.columns if c != "model"]))
    sizes = {"train_samples": train.count(), "test_samples": test.count()}
    made = cut_lineage(made)
    scored.unpersist()
    return made.withColumns({k: F.lit(v).cast("bigint") for k, v in sizes.items()})
