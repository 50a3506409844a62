"""Fold assignment, cross-validation, learning curves and insights."""

from __future__ import annotations

import time
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.metrics import class_scores, default_scoring, score
from .columns import task_type
from .linear import LinearFit, Moments, merge, moments, out_of_fold_fits, predict_by_fold, solve
from .models import SEED, fit_model
from .windows import with_position

LINEAR = ("linear_regression", "ridge")


# ---- fold columns ----


def k_fold(df: DataFrame, key: Sequence[str], k: int = 5, seed: int = SEED) -> DataFrame:
    """``fold`` by a seeded hash of the row key: no sort, the same on every run."""
    return df.withColumn("fold", F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(k)).cast("int"))


def k_fold_modulo(df: DataFrame, key: Column, k: int = 5) -> DataFrame:
    return df.withColumn("fold", F.pmod(key, F.lit(k)).cast("int"))


def stratified_k_fold(df: DataFrame, label: str, order: Sequence[Column | str], k: int = 5, **sizes) -> DataFrame:
    """Every class is dealt over the folds in turn; a class may hold most of the rows."""
    placed = with_position(df, order, [label], "_at", **sizes)
    return placed.withColumn("fold", (F.col("_at") % k).cast("int")).drop("_at")


def shuffle_split(df: DataFrame, key: Sequence[str], repeats: int = 5, test_share: float = 0.2, seed: int = SEED) -> DataFrame:
    """``test_0`` .. : independent seeded test marks, one per repeat."""
    marks = {
        f"test_{i}": F.pmod(F.xxhash64(*key, F.lit(seed + i)), F.lit(1_000_000)) < int(test_share * 1_000_000)
        for i in range(repeats)
    }
    return df.withColumns(marks)


def time_series_split(df: DataFrame, order: Sequence[Column | str], k: int = 5, **sizes) -> DataFrame:
    """``position`` and ``fold``: fold i is tested after training on everything before it.

    The test size is rows // (k + 1); earlier rows have fold null and only train.
    """
    placed = with_position(df, order, name="position", **sizes)
    n = df.count()
    size = n // (k + 1)
    start = n - k * size
    fold = F.when(F.col("position") >= start, F.floor((F.col("position") - start) / F.lit(max(size, 1))).cast("int"))
    return placed.withColumn("fold", fold)


def group_k_fold(df: DataFrame, group: str, k: int = 5, **sizes) -> DataFrame:
    """Whole groups per fold, balanced: largest first, each to the lightest fold.

    Only the number of groups of each size reaches the driver. Groups of one size go to the
    folds in repeating turns, so a group's fold follows from its position among its equals.
    """
    if group not in df.columns:
        raise ValueError(f"no {group} column")
    groups = df.groupBy(F.col(group).alias("_g")).agg(F.count(F.lit(1)).alias("_rows"))
    histogram = groups.groupBy("_rows").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("_rows")).collect()
    turns = _turns([(r["_rows"], r["n"]) for r in histogram], k)
    table = df.sparkSession.createDataFrame(turns, "_rows bigint, _from bigint, _cycle array<int>")
    table = table.groupBy("_rows").agg(F.sort_array(F.collect_list(F.struct("_from", "_cycle"))).alias("_turns"))
    placed = with_position(groups, ["_g"], ["_rows"], "_at", **sizes).join(table, "_rows")
    turn = F.element_at(F.filter("_turns", lambda t: t["_from"] <= F.col("_at")), -1)
    cycle = turn["_cycle"]
    place = (F.col("_at") - turn["_from"]) % F.size(cycle)
    folds = placed.select("_g", F.get(cycle, place.cast("int")).alias("fold"))
    return df.join(folds, F.col(group).eqNullSafe(F.col("_g"))).drop("_g")


def _turns(histogram: Sequence[tuple[int, int]], k: int) -> list[tuple[int, int, list[int]]]:
    """Repeating turns (size, first position, folds in order) of greedy balancing."""
    load, out = [0] * k, []
    for size, n in histogram:
        at = 0
        while at < n:
            order = sorted(range(k), key=lambda f: (load[f], f))
            # folds within one group of the lightest take turns until the next fold joins
            turn = [f for f in order if load[f] < load[order[0]] + size]
            rest = [load[f] for f in order if f not in turn]
            rounds = (n - at) // len(turn)
            if rest:
                highest = max(load[f] for f in turn)
                rounds = min(rounds, max(0, (min(rest) - highest - 1) // size))
            if rounds >= 1:
                out.append((size, at, turn))
                for f in turn:
                    load[f] += rounds * size
                at += rounds * len(turn)
            else:
                out.append((size, at, [order[0]]))
                load[order[0]] += size
                at += 1
    return out


# Fold strategy names.
STRATEGIES = ("k_fold", "stratified_k_fold", "leave_one_out", "leave_p_out", "shuffle_split", "time_series_split", "group_k_fold")


def with_folds(df: DataFrame, method: str, key: Sequence[str], k: int = 5, label: str | None = None, order: Sequence[str] | None = None, group: str = "group", classification: bool = False) -> DataFrame:
    """Fold column by strategy name; k-fold on classes is stratified, and groups fall back to k-fold."""
    if method not in STRATEGIES:
        raise ValueError(f"unknown method {method}; known: {STRATEGIES}")
    if method == "group_k_fold" and group not in df.columns:
        method = "k_fold"
    if method == "stratified_k_fold" or (method == "k_fold" and classification):
        return stratified_k_fold(df, label, order or key, k)
    if method == "k_fold":
        return k_fold(df, key, k)
    if method == "group_k_fold":
        return group_k_fold(df, group, k)
    if method == "time_series_split":
        return time_series_split(df, order or key, k)
    raise ValueError(f"{method} has its own operator (leave_one_out, leave_p_out, shuffle_split)")


# ---- linear closed forms ----


def leave_one_out(df: DataFrame, features: Sequence[str], target: str, ridge: float = 0.0) -> DataFrame:
    """``loo_residual`` = e / (1 − h) of each row, from one pass of cross products."""
    m = moments(df, [*features, target])[None]
    fit = solve(m, features, ridge)
    p = len(features)
    inverse = np.linalg.pinv(m.scatter[:p, :p] + ridge * np.eye(p))
    gaps = [F.col(f).cast("double") - F.lit(float(v)) for f, v in zip(features, m.mean)]
    h = F.lit(1.0 / m.n)
    for i in range(p):
        for j in range(p):
            h = h + gaps[i] * gaps[j] * F.lit(float(inverse[i, j]))
    e = F.col(target).cast("double") - fit.column()
    return df.withColumns({"leverage": h, "loo_residual": e / (1 - h)})


def leave_p_out(df: DataFrame, key: Sequence[str], features: Sequence[str], target: str, p: int = 2, seed: int = SEED) -> DataFrame:
    """Held-out squared error of a linear model on disjoint p-row subsets: every row is held out once.

    All subsets of p rows cannot be listed, so the rows are cut into groups of p by their hashed order; fewer
    than p left over are held out together. A group's model is the total's moments minus its rows.
    """
    columns = [*features, target]
    total = moments(df, columns)[None]
    placed = with_position(
        df.select(*key, *[F.col(c).cast("double").alias(c) for c in columns]).dropna(subset=columns), [F.xxhash64(*key, F.lit(seed)), *key], name="_at"
    )
    groups = placed.groupBy(F.floor(F.col("_at") / p).alias("subset")).agg(F.flatten(F.collect_list(F.array(*columns))).alias("rows"))

    def errors(batches):
        for pdf in batches:
            mse, sizes = np.zeros(len(pdf)), pdf["rows"].map(len).to_numpy() // len(columns)
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                mse[at] = _held_out(np.stack(pdf["rows"].to_numpy()[at]).reshape(len(at), size, len(columns)), total, features)
            yield pd.DataFrame({"subset": pdf["subset"], "mse": mse})

    return groups.mapInPandas(errors, "subset bigint, mse double")


def _held_out(rows: np.ndarray, total: Moments, features: Sequence[str]) -> np.ndarray:
    """Squared errors of groups (group, row, column) under the linear models of all other rows, many groups at once."""
    p, n = len(features), total.n - rows.shape[1]
    centred = rows - total.mean
    shift = centred.sum(axis=1)
    scatter = total.scatter - centred.transpose(0, 2, 1) @ centred - shift[:, :, None] * shift[:, None, :] / n
    mean = (total.mean * total.n - rows.sum(axis=1)) / n
    w = np.zeros((len(rows), p))
    full = np.linalg.matrix_rank(scatter[:, :p, :p]) == p
    w[full] = np.linalg.solve(scatter[full][:, :p, :p], scatter[full][:, :p, p:])[:, :, 0]
    for k in np.flatnonzero(~full):
        w[k] = solve(Moments(n, mean[k], scatter[k]), features).coefficients
    intercept = mean[:, p] - (w * mean[:, :p]).sum(axis=1)
    gap = rows[:, :, p] - (rows[:, :, :p] @ w[:, :, None])[:, :, 0] - intercept[:, None]
    return (gap**2).mean(axis=1)


# ---- cross-validation ----


def cross_validate(
    df: DataFrame, name: str, features: Sequence[str], target: str, scoring: str | Sequence[str] | None = None, task: str | None = None,
    train_scores: bool = True, fold: str = "fold", **params,
) -> DataFrame:
    """Long table (fold, metric, test_score, train_score, fit_time, score_time).

    Linear and ridge models fit every fold from one pass and score all folds in one more.
    Folds by time train only on earlier positions (a ``position`` column must be there).
    """
    task = task or task_type(df, target)
    metrics = default_scoring(task, scoring)
    by_time = "position" in df.columns and df.where(F.col(fold).isNull()).limit(1).count() > 0
    if name in LINEAR and task == "regression" and not by_time:
        return _cross_validate_linear(df, name, features, target, metrics, train_scores, fold, **params)
    folds = [r[0] for r in df.where(F.col(fold).isNotNull()).select(fold).distinct().orderBy(fold).collect()]
    out = []
    for f in folds:
        test = df.where(F.col(fold) == f)
        rest = df.where(F.col(fold).isNull() | (F.col(fold) < f)) if by_time else df.where(F.col(fold) != f)
        started = time.time()
        model = fit_model(rest, name, features, target, task, **params)
        fitted = time.time()
        found = _scores(model.transform(test), metrics, target, task)
        scored = time.time()
        trained = _scores(model.transform(rest), metrics, target, task) if train_scores else {}
        out += [(int(f), m, found[m], trained.get(m), fitted - started, scored - fitted) for m in metrics]
    return df.sparkSession.createDataFrame(out, _CV_SCHEMA)


_CV_SCHEMA = "fold int, metric string, test_score double, train_score double, fit_time double, score_time double"


def _scores(scored: DataFrame, metrics: Sequence[str], target: str, task: str) -> dict[str, float]:
    if task == "classification":
        row = class_scores(scored, target, "prediction").collect()[0].asDict()
        return {m: float(row[m.replace("_weighted", "")]) for m in metrics}
    return {r["metric"]: r["score"] for r in score(scored, metrics, target, "prediction").collect()}


def _cross_validate_linear(df, name, features, target, metrics, train_scores, fold, **params):
    ridge = params.get("alpha", 1.0) if name == "ridge" else 0.0
    started = time.time()
    fits = out_of_fold_fits(df, features, target, fold, ridge)
    took = (time.time() - started) / max(len(fits), 1)
    tested = score(predict_by_fold(df, fits, fold), metrics, target, "prediction", [fold])
    out = tested.select(F.col(fold).cast("int").alias("fold"), "metric", F.col("score").alias("test_score"))
    if train_scores:
        # every row is scored by each model that trained on it: k - 1 rows, one aggregate pass
        models = F.array(*[F.struct(F.lit(k).alias("m"), fits[k].column().alias("p")) for k in fits])
        spread = df.select(F.col(target), F.col(fold).alias("_own"), F.explode(models).alias("e")).where(F.col("e.m") != F.col("_own"))
        spread = spread.select(F.col(target), F.col("e.m").alias("_model"), F.col("e.p").alias("prediction"))
        trained = score(spread, metrics, target, "prediction", ["_model"]).select(
            F.col("_model").cast("int").alias("fold"), "metric", F.col("score").alias("train_score")
        )
        out = out.join(trained, ["fold", "metric"])
    else:
        out = out.withColumn("train_score", F.lit(None).cast("double"))
    return out.withColumns({"fit_time": F.lit(took), "score_time": F.lit(0.0)})


def cv_summary(folds: DataFrame) -> DataFrame:
    """Per metric the mean and population deviation over folds, and the fold statistics."""
    x = F.col("test_score")
    return folds.groupBy("metric").agg(
        F.avg(x).alias("test_mean"), F.stddev_pop(x).alias("test_std"), F.avg("train_score").alias("train_mean"),
        F.stddev_pop("train_score").alias("train_std"), F.min(x).alias("min_score"), F.max(x).alias("max_score"),
        F.median(x).alias("median_score"), (F.max(x) - F.min(x)).alias("score_range"),
        F.percentile(x, F.array(F.lit(0.025), F.lit(0.975))).alias("interval_95"),
        F.avg("fit_time").alias("fit_time_mean"), F.stddev_pop("fit_time").alias("fit_time_std"),
        F.avg("score_time").alias("score_time_mean"), F.stddev_pop("score_time").alias("score_time_std"),
    )


# Insight limits and texts.
HIGH_VARIANCE, LOW_VARIANCE, GAP, SLOW_SECONDS = 0.1, 0.05, 0.1, 60
PRIMARY = {"classification": ("accuracy", "f1_weighted"), "regression": ("r2", "neg_mean_squared_error")}


def insights(summary: DataFrame, task: str = "regression") -> DataFrame:
    """Best primary metric with its insight texts.

    Scores are compared as they are, as the reference metrics are all "higher is better"; on
    a tie the first of the primary metrics wins. The gap rule applies to classes and to r2.
    """
    primary = F.array(*map(F.lit, PRIMARY[task]))
    best = summary.where(F.col("metric").isin(*PRIMARY[task])).agg(
        F.max_by(F.struct(*summary.columns), F.struct("test_mean", -F.array_position(primary, F.col("metric")))).alias("b")
    ).select("b.*")
    ratio = F.when(F.col("test_mean") != 0, F.col("test_std") / F.abs("test_mean")).otherwise(F.lit(0.0))
    gap_applies = F.lit(task == "classification") | (F.col("metric") == "r2")
    texts = F.array_compact(
        F.array(
            F.when(ratio > HIGH_VARIANCE, F.lit("High variance detected across folds - model may be overfitting")).when(
                ratio < LOW_VARIANCE, F.lit("Low variance across folds - consistent performance")
            ),
            F.when(gap_applies & (F.col("train_mean") - F.col("test_mean") > GAP), F.lit("Large train-validation gap - possible overfitting")),
            F.when(F.col("fit_time_mean") > SLOW_SECONDS, F.lit("Model training is slow")),
        )
    )
    advice = F.array_compact(
        F.array(
            F.when(ratio > HIGH_VARIANCE, F.lit("Consider regularization or simpler model")),
            F.when(
                F.lit(task == "classification") & (F.col("train_mean") - F.col("test_mean") > GAP),
                F.lit("Reduce model complexity or add regularization"),
            ),
            F.when(F.col("fit_time_mean") > SLOW_SECONDS, F.lit("Consider faster algorithms for large datasets")),
        )
    )
    return best.select(
        F.col("metric").alias("best_metric"), F.col("test_mean").alias("best_score"), F.col("test_std").alias("score_std"),
        texts.alias("insights"), advice.alias("recommendations"),
    )


def learning_curve(
    df: DataFrame, name: str, features: Sequence[str], target: str, metric: str | None = None, shares: Sequence[float] | None = None,
    fold: str = "fold", key: Sequence[str] = (), seed: int = SEED, task: str = "regression", **params,
) -> DataFrame:
    """Train and validation scores over growing nested training samples: r2, or accuracy for classes, if no other is named.

    A hash of the row key orders the sample, so every size contains the smaller ones. Linear
    models take all sizes and folds from one pass of moments per (fold, size step).
    """
    metric = metric or ("r2" if task == "regression" else "accuracy")
    shares = list(shares or [i / 10 for i in range(1, 11)])
    u = F.pmod(F.xxhash64(*key, F.lit(seed + 99)), F.lit(1_000_000)) / 1_000_000
    step = F.lit(len(shares))
    for i in range(len(shares) - 1, -1, -1):
        step = F.when(u < shares[i], F.lit(i)).otherwise(step)
    rows = df.withColumn("_step", step.cast("int"))
    folds = [r[0] for r in rows.select(fold).distinct().orderBy(fold).collect()]
    out = []
    if name in LINEAR and task == "regression":
        ridge = params.get("alpha", 1.0) if name == "ridge" else 0.0
        cells = moments(rows.withColumn("_cell", F.col(fold) * 1000 + F.col("_step")), [*features, target], "_cell")
        fits = {}
        for i in range(len(shares)):
            for f in folds:
                parts = [m for c, m in cells.items() if c // 1000 != f and c % 1000 <= i]
                if parts:
                    fits[(i, f)] = solve(merge(parts), features, ridge)
        if metric in SQUARED:
            for (i, f), fit in fits.items():
                for part, held in (("validation", lambda c: c // 1000 == f), ("train", lambda c: c // 1000 != f and c % 1000 <= i)):
                    some = [m for c, m in cells.items() if held(c)]
                    if some:
                        out.append((i, int(f), part, _squared_score(merge(some), fit, metric)))
            scored = df.sparkSession.createDataFrame(out, "size int, _model int, part string, score double")
            return _curve(scored, shares)
        models = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(f).alias("f"), fit.column().alias("p")) for (i, f), fit in fits.items()])
        spread = rows.select(F.col(target), F.col(fold).alias("_own"), "_step", F.explode(models).alias("e")).select(
            F.col(target), F.col("e.i").alias("size"), F.col("e.f").alias("_model"), F.col("e.p").alias("prediction"),
            F.when(F.col("_own") == F.col("e.f"), F.lit("validation")).when(F.col("_step") <= F.col("e.i"), F.lit("train")).alias("part"),
        ).where("part IS NOT NULL")
        scored = score(spread, [metric], target, "prediction", ["size", "_model", "part"])
    else:
        for i in range(len(shares)):
            for f in folds:
                rest = rows.where((F.col(fold) != f) & (F.col("_step") <= i))
                model = fit_model(rest, name, features, target, task, **params)
                for part, d in (("train", rest), ("validation", rows.where(F.col(fold) == f))):
                    out.append((i, int(f), part, _scores(model.transform(d), [metric], target, task)[metric]))
        scored = df.sparkSession.createDataFrame(out, "size int, _model int, part string, score double")
    return _curve(scored, shares)


#: Metrics that follow from the moments of the rows.
SQUARED = ("r2", "neg_mean_squared_error")


def _squared_score(m: Moments, fit: LinearFit, metric: str) -> float:
    """The score of a linear model on the rows of the moments (features, target), without reading them again."""
    w = np.append(np.array(fit.coefficients), -1.0)
    squares = m.n * (fit.intercept + w @ m.mean) ** 2 + w @ m.scatter @ w
    if metric == "neg_mean_squared_error":
        return float(-squares / m.n)
    return float(1 - squares / m.scatter[-1, -1]) if m.scatter[-1, -1] > 0 else 0.0


def _curve(scored: DataFrame, shares: Sequence[float]) -> DataFrame:
    label = F.element_at(F.array(*map(F.lit, shares)), F.col("size") + 1)
    return scored.groupBy("size").agg(
        F.avg(F.when(F.col("part") == "train", F.col("score"))).alias("train_mean"),
        F.stddev_pop(F.when(F.col("part") == "train", F.col("score"))).alias("train_std"),
        F.avg(F.when(F.col("part") == "validation", F.col("score"))).alias("validation_mean"),
        F.stddev_pop(F.when(F.col("part") == "validation", F.col("score"))).alias("validation_std"),
    ).select(label.alias("train_share"), "train_mean", "train_std", "validation_mean", "validation_std")


