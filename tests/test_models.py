"""Closed forms, folds, ensembles and explanations by their defining properties."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tableloom.functions.significance import student_p
from tableloom.operators import anomaly as an
from tableloom.operators import crossval as cv
from tableloom.operators import ensemble as en
from tableloom.operators import explain as ex
from tableloom.operators import models as mo
from tableloom.operators.linear import linear_fit, predict_linear


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(11)
    n = 400
    x = rng.normal(size=(n, 3)) * [1, 5, 0.2] + [0, 10, 3]
    y = 2 * x[:, 0] - 0.7 * x[:, 1] + 8 * x[:, 2] + np.where(x[:, 0] > 0.5, 4, 0) + rng.normal(size=n)
    out = pd.DataFrame(x, columns=["a", "b", "c"]).assign(id=np.arange(n), y=y)
    return out.assign(label=np.where(out.y > out.y.median(), "high", np.where(out.y > out.y.quantile(0.2), "mid", "low")))


@pytest.fixture(scope="module")
def df(spark, data):
    return spark.createDataFrame(data)


FEATURES = ["a", "b", "c"]


def test_linear_and_ridge_closed_form(df, data):
    x, y = data[FEATURES].to_numpy(), data.y.to_numpy()
    xc, yc = x - x.mean(axis=0), y - y.mean()
    for alpha in (0.0, 1.0, 30.0):
        w = np.linalg.solve(xc.T @ xc + alpha * np.eye(3), xc.T @ yc)
        fit = linear_fit(df, FEATURES, "y", alpha)
        np.testing.assert_allclose(fit.coefficients, w, rtol=1e-9)
        np.testing.assert_allclose(fit.intercept, y.mean() - w @ x.mean(axis=0), rtol=1e-9)


@pytest.mark.parametrize("kind,l1,l2", [("lasso", 1.0, 0.0), ("elastic_net", 0.5, 0.5)])
def test_penalised_objective_is_at_its_minimum(df, data, kind, l1, l2):
    model = mo.fit_model(df, kind, FEATURES, "y")
    x, y = data[FEATURES].to_numpy(), data.y.to_numpy()
    w, b = model.native.coefficients.toArray(), model.native.intercept

    def objective(w, b):
        r = y - x @ w - b
        return (r @ r) / (2 * len(y)) + l1 * np.abs(w).sum() + l2 / 2 * (w @ w)

    best = objective(w, b)
    rng = np.random.default_rng(0)
    assert all(objective(w + d[:3] * 1e-3, b + d[3] * 1e-3) >= best - 1e-9 for d in rng.normal(size=(200, 4)))


def test_leave_one_out_equals_refits(df, data):
    got = cv.leave_one_out(df, FEATURES, "y").toPandas().set_index("id")["loo_residual"].sort_index()
    x, y = np.column_stack([data[FEATURES], np.ones(len(data))]), data.y.to_numpy()
    for i in (0, 7, 399):
        keep = np.arange(len(y)) != i
        w = np.linalg.lstsq(x[keep], y[keep], rcond=None)[0]
        assert got[i] == pytest.approx(y[i] - x[i] @ w, rel=1e-8)


def test_fold_sizes_and_groups(spark):
    sizes = [500, 40, 40, 39, 30, 30, 30, 7, 7, 7, 7, 7, 3, 2, 2, 1, 1, 1, 1, 1]
    rows = [(g, i) for g, n in enumerate(sizes) for i in range(n)]
    df = spark.createDataFrame(rows, "g long, i long")
    got = {r["g"]: r["fold"] for r in cv.group_k_fold(df, "g", 4, plain_rows=0).select("g", "fold").distinct().collect()}
    assert len(got) == len(sizes)  # no group is split
    load, expected = [0] * 4, {}
    for g in sorted(range(len(sizes)), key=lambda g: (-sizes[g], g)):
        f = min(range(4), key=lambda f: (load[f], f))
        expected[g], load[f] = f, load[f] + sizes[g]
    assert got == expected


def test_stratified_split_shares(df, data):
    out = mo.stratified_split(df, "label", ["id"], 0.25, plain_rows=0).toPandas()
    for label, part in out.groupby("label"):
        assert part["is_test"].sum() == round(len(part) * 0.25)


def test_cross_validation_matches_refits(df, data):
    folds = cv.k_fold_modulo(df, F.col("id"), 4)
    got = {r["fold"]: r for r in cv.cross_validate(folds, "linear_regression", FEATURES, "y", "r2", "regression").collect()}
    x, y, f = np.column_stack([data[FEATURES], np.ones(len(data))]), data.y.to_numpy(), data.id.to_numpy() % 4
    for k in range(4):
        w = np.linalg.lstsq(x[f != k], y[f != k], rcond=None)[0]
        for part, name in ((f == k, "test_score"), (f != k, "train_score")):
            r = y[part] - x[part] @ w
            assert got[k][name] == pytest.approx(1 - (r @ r) / ((y[part] - y[part].mean()) ** 2).sum(), rel=1e-8)


def test_time_folds_only_look_back(df):
    out = cv.time_series_split(df, ["id"], 5, plain_rows=0).toPandas()
    size = len(out) // 6
    assert out.groupby("fold").size().tolist() == [size] * 5
    for k in range(5):
        assert out[out.fold == k].position.min() > out[(out.fold < k) | out.fold.isna()].position.max()


def test_simplex_weights(df, spark):
    mixed = df.select("y", (F.col("y") * 0.8 + F.col("a")).alias("p"), (F.col("y") * 1.3 - F.col("a")).alias("q"), (F.col("c") * 9).alias("r"))
    w = en.simplex_weights(mixed, ["p", "q", "r"], "y")
    assert sum(w.values()) == pytest.approx(1) and min(w.values()) >= 0
    table = mixed.toPandas()
    best = np.mean((table[["p", "q", "r"]].to_numpy() @ np.array(list(w.values())) - table.y) ** 2)
    for v in np.random.default_rng(0).dirichlet(np.ones(3), 300):
        assert np.mean((table[["p", "q", "r"]].to_numpy() @ v - table.y) ** 2) >= best - 1e-9


def test_soft_and_hard_votes(df):
    members = en.fit_members(df, ["decision_tree", "naive_bayes", "logistic_regression"], FEATURES, "label", "classification")
    for voting in ("soft", "hard"):
        out = en.vote(df, members, "classification", voting)
        row = out.agg(F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("acc"), F.count(F.lit(1)).alias("n")).collect()[0]
        assert row["n"] == 400 and row["acc"] > 0.7


@pytest.mark.parametrize("name", ["decision_tree", "random_forest", "gradient_boosting"])
def test_tree_contributions_add_up(df, name):
    model = mo.fit_model(df, name, FEATURES, "y", **({} if name == "decision_tree" else {"n_estimators": 5}))
    rows, base = ex.tree_shapley(df, model, FEATURES, ["id"])
    total = rows.groupBy("id").agg(F.sum("contribution").alias("s"))
    gap = model.transform(df).join(total, "id").agg(F.max(F.abs(F.col("prediction") - F.col("s") - base)).alias("g")).collect()[0]["g"]
    assert gap < 1e-8


def test_sampled_contributions_add_up(df):
    model = mo.fit_model(df, "decision_tree", FEATURES, "y")
    few = df.where("id < 20")
    rows, base = ex.sampled_shapley(few, model, FEATURES, ["id"], permutations=2, n_background=6)
    total = rows.groupBy("id").agg(F.sum("contribution").alias("s"))
    gap = model.transform(few).join(total, "id").agg(F.max(F.abs(F.col("prediction") - F.col("s") - base)).alias("g"), F.count(F.lit(1)).alias("n")).collect()[0]
    assert gap["n"] == 20 and gap["g"] < 1e-8


def test_local_surrogate_recovers_a_linear_model(df, data):
    model = ex.callback_model(lambda x: 3 * x[:, 0] - 2 * x[:, 1], FEATURES)
    rows = {r["feature"]: r for r in ex.local_surrogate(df, model, FEATURES, F.col("id") == 3).collect()}
    assert rows["a"]["weight"] == pytest.approx(3 * data.a.std(ddof=0), rel=1e-3)
    assert rows["b"]["weight"] == pytest.approx(-2 * data.b.std(ddof=0), rel=1e-3)


def test_permutation_importance_of_an_unused_feature(df):
    model = ex.callback_model(lambda x: 3 * x[:, 0] + x[:, 1] + 0 * x[:, 2], FEATURES)
    got = {r["feature"]: r["importance"] for r in ex.permutation_importance(df, model, FEATURES, ["id"], plain_rows=0).collect()}
    assert got["c"] == pytest.approx(0, abs=1e-9)


@pytest.mark.parametrize("name", ["isolation_forest", "elliptic_envelope", "one_class_svm", "local_outlier_factor"])
def test_detectors_flag_the_planted_rows(spark, name):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(300, 2)), [[9, 9], [-10, 8], [11, -9]]])
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(303), "x": x[:, 0], "y": x[:, 1]}))
    params = {"key": "id"} if name == "local_outlier_factor" else {}
    out = an.detect(df, ["x", "y"], name, contamination=0.05, **params).toPandas().set_index("id")
    assert out["is_anomaly"].loc[[300, 301, 302]].all()
    assert abs(out["is_anomaly"].sum() - 0.05 * 303) <= 1.5


@pytest.mark.parametrize("name", ["svm", "neural_network", "knn", "xgboost"])
def test_regressors_beat_the_mean(df, name):
    params = {"knn": {"key": "id"}, "xgboost": {"n_estimators": 10}, "neural_network": {"rounds": 30, "batch": 16, "rate": 5e-3}}.get(name, {})
    model = mo.fit_model(df, name, FEATURES, "y", **params)
    out = model.transform(df).agg(mo.regression_metrics("y", "prediction")["r2"].alias("r2")).collect()[0]
    assert out["r2"] > 0.5


def test_p_values():
    # published two-sided points of the t distribution
    for t, freedom, p in ((2.228, 10, 0.05), (2.576, 1e7, 0.01), (12.706, 1, 0.05), (1.725, 20, 0.10)):
        assert student_p(t, freedom) == pytest.approx(p, abs=2e-4)
    assert student_p(0.0, 5) == pytest.approx(1.0)


def test_linear_prediction_column(df, data):
    fit = linear_fit(df, FEATURES, "y")
    got = predict_linear(df, fit).toPandas()
    np.testing.assert_allclose(got["prediction"], data[FEATURES].to_numpy() @ fit.coefficients + fit.intercept, rtol=1e-9)


def test_bootstrap_interval_contains_the_mean_fit(df):
    from tableloom.operators.scoring import bootstrap_linear, interval_from_members

    members = bootstrap_linear(df, FEATURES, "y")
    again = bootstrap_linear(df, FEATURES, "y")
    np.testing.assert_allclose([m.coefficients for m in members], [m.coefficients for m in again])
    fit = linear_fit(df, FEATURES, "y")
    assert np.mean([m.coefficients for m in members], axis=0) == pytest.approx(np.array(fit.coefficients), rel=0.1)
    out = interval_from_members(predict_linear(df, fit), members).agg(
        F.avg(F.col("prediction").between(F.col("lower"), F.col("upper")).cast("double")).alias("inside"), F.min("spread").alias("s")
    ).collect()[0]
    assert out["inside"] > 0.95 and out["s"] > 0
