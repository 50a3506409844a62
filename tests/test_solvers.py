"""Perceptron, support-vector machines, explanations, bootstrap, silhouette and class weights against known answers."""

from itertools import combinations
from math import comb, factorial

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tableloom.operators import anomaly as an
from tableloom.operators import ensemble as en
from tableloom.operators import explain as ex
from tableloom.operators import models as mo
from tableloom.operators import scoring as sc
from tableloom.operators.crossval import k_fold, learning_curve
from tableloom.operators.passes import lbfgs, summed
from tableloom.operators.silhouette import euclidean_silhouette

XS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(11)
    x = rng.normal(size=(1200, 3))
    y = np.sin(2 * x[:, 0]) * 3 + x[:, 1] ** 2 + 0.5 * x[:, 2] + rng.normal(scale=0.05, size=1200)
    kind = np.where(x[:, 0] + x[:, 1] > 0.5, "high", np.where(x[:, 0] - x[:, 1] > 0, "mid", "low"))
    return pd.DataFrame(x, columns=XS).assign(id=np.arange(1200), y=y, kind=kind)


@pytest.fixture(scope="module")
def df(spark, table):
    return spark.createDataFrame(table).cache()


def r2(rows, prediction="prediction"):
    return rows.agg(mo.regression_metrics("y", prediction)["r2"].alias("r")).first()["r"]


def test_sums_do_not_depend_on_partitions(df, table):
    for parts in (1, 8, 150):
        got = summed(df.repartition(parts), XS, lambda x: np.concatenate([x.sum(axis=0), [len(x)]]))
        np.testing.assert_allclose(got, [*table[XS].sum(), len(table)], rtol=1e-9)
    assert summed(df.limit(0), XS, lambda x: x.sum(axis=0)) is None


def test_lbfgs_finds_the_minimum_of_a_bent_valley():
    def evaluate(points):
        return [((1 - p[0]) ** 2 + 100 * (p[1] - p[0] ** 2) ** 2, np.array([-2 * (1 - p[0]) - 400 * p[0] * (p[1] - p[0] ** 2), 200 * (p[1] - p[0] ** 2)])) for p in points]

    np.testing.assert_allclose(lbfgs(evaluate, np.array([-1.2, 1.0]), 200), [1, 1], atol=1e-3)


def test_perceptron_is_the_same_on_any_partitions(df):
    fits = [mo.fit_model(df.repartition(parts), "neural_network", XS, "y", hidden=(12,), rounds=5) for parts in (1, 8, 64)]
    for fit in fits[1:]:
        np.testing.assert_allclose(fit.weights, fits[0].weights, rtol=1e-4, atol=1e-5)


def test_perceptron_beats_the_linear_fit_on_a_curve(df):
    linear = r2(mo.fit_model(df, "linear_regression", XS, "y").transform(df))
    bent = r2(mo.fit_model(df, "neural_network", XS, "y", hidden=(30, 10), rounds=60).transform(df))
    assert bent > 0.95 > linear


def test_rows_inside_the_tube_have_no_pull(df, table):
    model = mo.fit_model(df, "svm", XS, "y", C=1.0, epsilon=0.1)
    assert r2(model.transform(df)) > 0.9
    phi = model.mapped(table[XS].to_numpy())
    mean, std = model.scale
    gap = phi @ model.weights - (table["y"].to_numpy() - mean) / std
    slope = mo._tube(gap, 0.1, 0.01)[1]
    assert (slope[np.abs(gap) < 0.1] == 0).all() and (np.abs(slope[np.abs(gap) > 0.111]) == 1).all()
    np.testing.assert_allclose(model.weights[:-1], -(phi[:, :-1].T @ slope), atol=1e-3)  # stationary
    assert abs(slope.sum()) < 1e-3


def exact_one_class(kernel, nu, steps=200_000):
    """The dual by pairwise exchange between the most violating rows."""
    n = len(kernel)
    top = 1 / (nu * n)
    alpha = np.zeros(n)
    alpha[: int(nu * n)] = top
    alpha[int(nu * n)] += 1 - alpha.sum()
    g = kernel @ alpha
    for _ in range(steps):
        up, down = np.where(alpha < top - 1e-15, g, np.inf).argmin(), np.where(alpha > 1e-15, g, -np.inf).argmax()
        if g[down] - g[up] < 1e-9:
            break
        move = min((g[down] - g[up]) / max(kernel[up, up] + kernel[down, down] - 2 * kernel[up, down], 1e-12), top - alpha[up], alpha[down])
        alpha[up] += move
        alpha[down] -= move
        g += move * (kernel[:, up] - kernel[:, down])
    return g, alpha


def test_one_class_machine_agrees_with_an_exact_solver(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(85, 2)), rng.uniform(-5, 5, size=(15, 2))])
    x = (x - x.mean(axis=0)) / x.std(axis=0)
    rows = spark.createDataFrame(pd.DataFrame(x, columns=["x", "y"])).repartition(3)
    w, rho, mapped, gap = an.one_class_margin(rows, ["x", "y"], 0.2, landmarks=100)
    kernel = np.exp(-0.5 * ((x[:, None] - x[None]) ** 2).sum(axis=2))
    g, alpha = exact_one_class(kernel, 0.2)
    free = (alpha > 1e-6) & (alpha < 1 / 20 - 1e-6)
    level = g[free].mean()
    assert gap < 1e-3 and rho == pytest.approx(level, rel=0.02)
    np.testing.assert_allclose(mapped(x) @ w, g, atol=0.02 * level)
    clear = np.abs(g - level) > 0.03 * level
    assert ((mapped(x) @ w < rho) == (g < level))[clear].all()


@pytest.mark.parametrize("nu", [0.05, 0.2])
def test_share_outside_is_nu(spark, nu):
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame(pd.DataFrame(rng.normal(size=(2000, 3)), columns=XS))
    out = an.detect(rows, XS, "one_class_svm", contamination=nu)
    share = out.agg(F.avg((F.col("anomaly_score") < 0).cast("double")).alias("s"), F.avg(F.col("is_anomaly").cast("double")).alias("f")).first()
    assert abs(share["s"] - nu) < 0.01 and abs(share["f"] - nu) < 0.01


def subsets(x, leaves, width):
    """Shapley values of tree leaves by sums over all subsets."""
    out = np.zeros(width)
    for weight, value, path in leaves:
        m = len(path)
        inside = [float(low < x[f] <= high) for f, low, high, _ in path]
        for i in range(m):
            others = [j for j in range(m) if j != i]
            for size in range(m):
                for chosen in combinations(others, size):
                    product = np.prod([inside[j] if j in chosen else path[j][3] for j in others])
                    out[path[i][0]] += weight * value * (inside[i] - path[i][3]) * product / (m * comb(m - 1, size))
    return out


def test_tree_contributions_equal_subset_sums():
    rng = np.random.default_rng(5)
    leaves = []
    for m in (0, 1, 2, 3, 6, 9):
        path = []
        for f in rng.choice(10, m, replace=False):
            low = rng.normal() - 1
            path.append((int(f), low, low + 2, float(rng.uniform(0.01, 0.9))))
        leaves.append((0.7, float(rng.normal()), path))
    x = rng.normal(size=(40, 10))
    np.testing.assert_allclose(ex._leaf_contributions(x, leaves, 10), [subsets(r, leaves, 10) for r in x], rtol=1e-9, atol=1e-12)


def test_deep_trees_over_many_features(spark):
    rng = np.random.default_rng(2)
    names = [f"f{j}" for j in range(30)]
    x = rng.normal(size=(1500, 30))
    rows = spark.createDataFrame(pd.DataFrame(x, columns=names).assign(id=np.arange(1500), y=(x**2).sum(axis=1) + x[:, 0] * x[:, 1] * 3)).cache()
    model = mo.fit_model(rows, "decision_tree", names, "y", max_depth=20)
    assert max(len(p) for *_, p in ex.tree_leaves(model.native, names)) > 12
    few = rows.where("id < 100")
    got, base = ex.tree_shapley(few, model, names, ["id"])
    total = got.groupBy("id").agg(F.sum("contribution").alias("s"))
    gap = model.transform(few).join(total, "id").agg(F.max(F.abs(F.col("prediction") - F.col("s") - base)).alias("g")).first()["g"]
    assert gap < 1e-8


def exact_shapley(predict, x, ground):
    width = len(x)
    value = {}
    for size in range(width + 1):
        for chosen in combinations(range(width), size):
            mixed = ground.copy()
            mixed[:, list(chosen)] = x[list(chosen)]
            value[frozenset(chosen)] = predict(mixed).mean()
    out = np.zeros(width)
    for i in range(width):
        for s, v in value.items():
            if i not in s:
                out[i] += factorial(len(s)) * factorial(width - len(s) - 1) / factorial(width) * (value[s | {i}] - v)
    return out


@pytest.mark.parametrize("kind", ["function", "tree", "linear", "one"])
def test_kernel_contributions_are_exact(df, table, kind):
    features = XS[:1] if kind == "one" else XS
    if kind == "tree":
        model = mo.fit_model(df, "random_forest", features, "y", n_estimators=4)
    elif kind == "linear":
        model = mo.fit_model(df, "linear_regression", features, "y")
    else:
        model = ex.callback_model(lambda x: x[:, 0] * x[:, -1] + np.abs(x[:, 0]), features)
    few = df.where("id < 12")
    got, base = ex.kernel_shapley(few, model, features, ["id"], n_background=9)
    ground = np.array([[float(v) for v in r] for r in ex.background(few, ["id"], 9).select(*features).collect()])
    predict = ex.numpy_predictor(model, features)
    assert base == pytest.approx(predict(ground).mean())
    values = {(r["id"], r["feature"]): r["contribution"] for r in got.collect()}
    for i in range(12):
        want = exact_shapley(predict, table.loc[i, features].to_numpy(float), ground)
        np.testing.assert_allclose([values[i, f] for f in features], want, atol=1e-9)
    scored = {r["id"]: r["prediction"] for r in model.transform(few).collect()}
    for i in range(12):
        assert sum(values[i, f] for f in features) + base == pytest.approx(scored[i])


def test_kernel_contributions_of_many_features_by_draws(spark):
    rng = np.random.default_rng(7)
    names = [f"f{j}" for j in range(20)]
    weights = rng.normal(size=20)
    rows = spark.createDataFrame(pd.DataFrame(rng.normal(size=(30, 20)), columns=names).assign(id=np.arange(30)))
    got, base = ex.kernel_shapley(rows, ex.callback_model(lambda x: x @ weights, names), names, ["id"], n_background=10, most=600)
    ground = np.array([[float(v) for v in r] for r in ex.background(rows, ["id"], 10).select(*names).collect()])
    table = got.toPandas()
    want = (table["value"] - table["feature"].map(dict(zip(names, ground.mean(axis=0))))) * table["feature"].map(dict(zip(names, weights)))
    np.testing.assert_allclose(table["contribution"], want, atol=1e-8)


def test_coalitions_have_the_kernels_weights():
    z, w = ex.coalitions(4, 100)
    assert len(z) == 2**4 - 2 and {tuple(r) for r in z.astype(int).tolist()} == {r for r in __import__("itertools").product((0, 1), repeat=4) if 0 < sum(r) < 4}
    for r, v in zip(z, w):
        s = int(r.sum())
        assert v == pytest.approx(3 / (comb(4, s) * s * (4 - s)))
    z, w = ex.coalitions(12, 200)
    assert len(z) <= 200 and w.sum() == pytest.approx(sum(11 / (s * (12 - s)) for s in range(1, 12)))


@pytest.mark.parametrize("name", ["decision_tree", "linear_regression"])
def test_bootstrap_of_any_model(spark, df, name):
    rows = df.withColumn("y", 2 * F.col("a") - F.col("b") + 0.3 * F.col("c"))
    fit = lambda d: mo.fit_model(d, name, XS, "y")
    models = sc.bootstrap_models(rows, fit, ["id"], n=12)
    out = sc.interval_from_models(rows, models, 0.9)
    assert out.columns == [*rows.columns, "prediction", "lower", "upper", "spread"]
    got = out.agg(
        F.avg(((F.col("lower") <= F.col("prediction")) & (F.col("prediction") <= F.col("upper"))).cast("double")).alias("inside"),
        F.avg((F.col("y").between(F.col("lower") - 1e-6, F.col("upper") + 1e-6)).cast("double")).alias("covered"), F.avg("spread").alias("s"),
    ).first()
    assert got["inside"] > 0.95
    assert got["covered"] > (0.99 if name == "linear_regression" else 0.4)
    assert (got["s"] > 0.01) == (name == "decision_tree")


def test_resamples_follow_the_key_alone(df):
    counts = [df.repartition(parts).select("id", sc.poisson_draws(["id"], 3, 0.8).alias("k")).toPandas().set_index("id")["k"].sort_index() for parts in (1, 8, 64)]
    assert (counts[0] == counts[1]).all() and (counts[0] == counts[2]).all()
    assert counts[0].mean() == pytest.approx(0.8, abs=0.08) and counts[0].var() == pytest.approx(0.8, abs=0.15)
    with pytest.raises(ValueError):
        sc.bootstrap_models(df, lambda d: None, [])


def brute_silhouette(x, labels):
    gaps = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    out = []
    for i in range(len(x)):
        own = labels == labels[i]
        if own.sum() == 1:
            out.append(0.0)
            continue
        a = gaps[i][own].sum() / (own.sum() - 1)
        b = min(gaps[i][labels == v].mean() for v in set(labels.tolist()) - {labels[i]})
        out.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return np.mean(out)


def test_silhouette_lies_between_its_bounds(spark):
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(c, 1, size=(250, 3)) for c in (0, 4, 9)] + [[[30, 30, 30]]])
    labels = np.repeat([0, 1, 2, 3], [250, 250, 250, 1])
    rows = spark.createDataFrame(pd.DataFrame(x, columns=XS).assign(cluster=labels)).unionByName(spark.createDataFrame([(9.0, 9.0, 9.0, -1)], "a double, b double, c double, cluster long"))
    want = brute_silhouette(x, labels)
    exact = euclidean_silhouette(rows, XS)
    assert exact.score == pytest.approx(want, abs=1e-9) and exact.high - exact.low < 1e-9
    rough = euclidean_silhouette(rows, XS, blocks=32)
    assert rough.low <= want <= rough.high and rough.high - rough.low < 0.2 and abs(rough.score - want) < 0.05
    finer = euclidean_silhouette(rows, XS, blocks=128)
    assert finer.high - finer.low < rough.high - rough.low
    assert euclidean_silhouette(rows.where("cluster < 1"), XS).score is None


def test_class_weights_beat_equal_votes(spark):
    rng = np.random.default_rng(6)
    truth = rng.choice(["x", "y", "z"], 900)
    wrong = lambda share: np.where(rng.random(900) < share, rng.choice(["x", "y", "z"], 900), truth)
    same = wrong(0.9)
    table = pd.DataFrame({"t": truth, "good": wrong(0.2), "bad1": same, "bad2": same, "bad3": wrong(0.8)})
    rows = spark.createDataFrame(table)
    members = ["good", "bad1", "bad2", "bad3"]
    weights = en.class_weights(rows, members, "t")
    assert sum(weights.values()) == pytest.approx(1) and weights["good"] > 0.4
    share = lambda w: en.weighted_vote(rows, w).agg(F.avg((F.col("prediction") == F.col("t")).cast("double"))).first()[0]
    equal = share(dict.fromkeys(members, 0.25))
    assert share(weights) > equal + 0.1
    votes = table[members].to_numpy()
    best = 0
    for w in np.random.default_rng(0).dirichlet(np.ones(4), 400):
        score = {v: (votes == v) @ w for v in "xyz"}
        best = max(best, np.mean([max("xyz", key=lambda v: score[v][i]) == truth[i] for i in range(900)]))
    assert share(weights) >= best - 1e-9
    assert en.vote_patterns(rows, members, "t").count() <= 15 * 5


def test_weighted_classes_in_a_build(df):
    report = en.build(df, ["id"], ["decision_tree", "naive_bayes", "logistic_regression"], XS, "kind", ["weighted", "voting"], "classification").toPandas()
    assert set(report[report["kind"] == "ensemble"]["model"]) == {"weighted", "voting"} and (report["accuracy"] > 0.6).all()


def test_class_scores_of_members_and_learning_curves(df):
    rows = k_fold(df, ["id"], 3)
    scores = en.member_cross_validation(rows, ["decision_tree", "naive_bayes"], XS, "kind", task="classification").toPandas()
    assert set(scores["metric"]) == {"accuracy"} and (scores["test_mean"] > 0.7).all()
    curve = learning_curve(rows, "decision_tree", XS, "kind", shares=[0.2, 1.0], key=["id"], task="classification").toPandas().sort_values("train_share")
    assert (curve["validation_mean"] > 0.7).all() and curve["validation_mean"].iloc[1] >= curve["validation_mean"].iloc[0] - 0.05


def test_bisecting_parts_standardised_rows(spark):
    """Rows around zero are parted too."""
    from tableloom.operators.clustering import bisecting

    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.1, size=(60, 2)) for c in (-3, 0, 3)])
    rows = spark.createDataFrame(pd.DataFrame(x - x.mean(axis=0), columns=["p", "q"]).assign(g=np.repeat([0, 1, 2], 60)))
    labelled, centres = bisecting(rows, ["p", "q"], 3)
    assert len(centres) == 3 and labelled.select("g", "cluster").distinct().count() == 3
