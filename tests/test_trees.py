"""Trees on cells of binned columns against trees on rows, and the forest grown from drawn cells."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor
from pyspark.sql import functions as F

from tableloom.operators import crossval as cv
from tableloom.operators import explain as ex
from tableloom.operators import models as mo
from tableloom.operators import trees as tr
from tableloom.operators.linear import moments, solve

XS = ["a", "b"]


@pytest.fixture(scope="module")
def df(spark):
    rng = np.random.default_rng(5)
    n = 4000
    a, b = rng.integers(0, 12, n), rng.integers(0, 9, n)  # so few values that rows and cells have the same cuts
    y = a * 3.0 + (b - 4.0) ** 2 + rng.normal(size=n)
    return spark.createDataFrame(pd.DataFrame({"id": np.arange(n), "a": a, "b": b, "y": y, "k": np.where(y > 20, "x", np.where(b > 5, "y", "z"))})).persist()


@pytest.mark.parametrize("native,name,params", [
    (lambda: GBTRegressor(maxIter=8, stepSize=0.1, maxDepth=3, seed=42), "gradient_boosting", {"n_estimators": 8}), (lambda: DecisionTreeRegressor(maxDepth=5, seed=42), "decision_tree", {}),
])
def test_trees_on_cells_are_those_on_rows(df, native, name, params):
    on_rows, on_cells = mo._vector_model(native(), df, XS, "y"), mo.fit_model(df, name, XS, "y", **params)
    assert [len(c) for c in on_cells.cuts] == [11, 8]
    both = on_cells.transform(on_rows.transform(df).withColumnRenamed("prediction", "p"))
    assert both.agg(F.max(F.abs(F.col("prediction") - F.col("p")))).first()[0] < 1e-6
    x = df.select(*XS).toPandas().to_numpy(float)
    np.testing.assert_allclose(ex.numpy_predictor(on_cells, XS)(x), on_cells.transform(df).toPandas()["prediction"], rtol=1e-9)


def test_boosted_classes_on_cells_are_those_on_rows(df):
    two = df.withColumn("k", F.when(F.col("y") > 20, "x").otherwise("z"))
    on_cells = mo.fit_model(two, "gradient_boosting", XS, "k", "classification", n_estimators=5)
    on_rows = mo._class_model(lambda k: GBTClassifier(maxIter=5, stepSize=0.1, maxDepth=3, seed=42, **mo._COLUMNS), two, XS, "k")
    p, q = (m.transform(two).orderBy("id").toPandas() for m in (on_cells, on_rows))
    assert on_cells.cuts is not None and (p["prediction"] == q["prediction"]).all()
    three = mo.fit_model(df, "gradient_boosting", XS, "k", "classification", n_estimators=5)
    assert three.transform(df).agg(F.avg((F.col("prediction") == F.col("k")).cast("double"))).first()[0] > 0.85


def test_cut_points_are_all_middles_or_equal_shares():
    assert tr.cut_points(np.array([3.0, 1.0, 1.0, 2.0])).tolist() == [1.5, 2.5]
    many = np.random.default_rng(1).normal(size=10_000)
    found = np.bincount(np.searchsorted(tr.cut_points(many), many))
    assert len(found) == 32 and found.max() <= 1.05 * found.min()


def test_forest_of_drawn_cells(df):
    model = mo.fit_model(df, "random_forest", XS, "y", n_estimators=30)
    assert isinstance(model.native, tr.Forest) and len(model.native.trees) == 30
    out = model.transform(df).toPandas()
    assert 1 - ((out["prediction"] - out["y"]) ** 2).mean() / out["y"].var() > 0.85
    assert all(abs(count[0] - len(out)) < 6 * len(out) ** 0.5 for *_, count, _ in model.native.trees)  # as many draws as rows
    x, total = out[XS].to_numpy(float), 0.0
    for weight, value, path in ex.tree_leaves(model.native, XS):
        total = total + weight * value * np.all([(x[:, f] > low) & (x[:, f] <= high) for f, low, high, _ in path], axis=0)
    np.testing.assert_allclose(total, out["prediction"], rtol=1e-9)
    found, base = ex.tree_shapley(df, model, XS, ["id"])
    sums = found.groupBy("id").agg(F.sum("contribution").alias("s")).orderBy("id").toPandas()["s"].to_numpy()
    np.testing.assert_allclose(sums + base, out.sort_values("id")["prediction"], rtol=1e-6)


@pytest.mark.parametrize("name", ["random_forest", "decision_tree"])
def test_leaves_are_asked_for_cells_not_for_rows(spark, df, monkeypatch, name):
    model = mo.fit_model(df, name, XS, "y", **({"n_estimators": 10} if name == "random_forest" else {}))
    odd = spark.createDataFrame(pd.DataFrame({"id": -np.arange(1.0, 5.0), "a": [np.nan, 2.5, 1e9, -np.inf], "b": [3.0, -7.0, 2.5, 1.0]}))
    rows = df.select(F.col("id").cast("double"), *[F.col(x).cast("double") for x in XS]).unionByName(odd)
    seen, of_leaves = spark.sparkContext.accumulator(0), ex._leaf_contributions

    def counted(x, leaves, width):
        seen.add(len(x))
        return of_leaves(x, leaves, width)

    monkeypatch.setattr(ex, "_leaf_contributions", counted)
    found, base = ex.tree_shapley(rows, model, XS, ["id"])
    got = found.groupBy("id").pivot("feature", XS).agg(F.first("contribution")).orderBy("id").toPandas()
    assert 0 < seen.value <= 12 * 9 + 2  # the cells, and the rows that are in none
    x = rows.orderBy("id").toPandas()[XS].to_numpy(float)
    cuts = (model.native if name == "random_forest" else model).cuts
    np.testing.assert_allclose(got[XS], of_leaves(x, ex.tree_leaves(model.native, XS, cuts), 2), rtol=1e-9, atol=1e-12)


def test_cells_have_the_values_at_their_upper_ends():
    cuts = [np.array([1.5, 2.5]), np.array([]), np.array([-1.0])]
    ends = tr.cell_ends(cuts)
    assert ends.shape == (6, 3) and tr.cell_of(ends, cuts).tolist() == list(range(6))
    assert tr.cell_of(np.array([[1.5, 0.0, -1.0], [1.6, 0.0, -0.9]]), cuts).tolist() == [0, 3]


def test_times_drawn_are_poisson_numbers():
    n = 1_000_000
    found = np.bincount(tr.poisson_times(np.random.default_rng(4), n).astype(int), minlength=8)
    chances = np.array([np.exp(-1) / math.factorial(k) for k in range(8)])
    assert (np.abs(found[:8] - n * chances) < 5 * np.sqrt(n * chances) + 5).all() and len(found) < 16


def test_draws_of_rows_by_cell(spark):
    """A task that draws in several goes gives each row to a tree once on average, and its target with it."""
    n = 150_000
    rows = spark.range(0, n, 1, 2).select((F.col("id") % 3).cast("int").alias("cell"), (F.col("id") % 3 + 1.0).alias("y"))
    got = tr._drawn(rows, 4, 5, 42).orderBy("tree", "cell").toPandas()
    assert got[["tree", "cell"]].to_numpy().tolist() == [[t, c] for t in range(5) for c in range(3)]
    assert (got["w"] == got["w"].round()).all() and (abs(got["w"] - n / 3) < 5 * (n / 3) ** 0.5).all() and got["w"].nunique() > 5
    np.testing.assert_allclose(got["s"], got["w"] * (got["cell"] + 1.0))


def test_trees_refuse_gaps_as_before(df):
    with pytest.raises(Exception):
        mo.fit_model(df.withColumn("a", F.when(F.col("id") > 0, F.col("a"))), "decision_tree", XS, "y")


def test_sampled_shares_without_copies_of_rows(df, monkeypatch):
    few = df.where("id < 200").unionByName(df.where("id < 5"))  # some rows come twice
    model = mo.fit_model(df, "decision_tree", XS, "y")
    quick, base = ex.sampled_shapley(few, model, XS, ["id"], 2, 5)
    assert "posexplode" not in quick._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(ex, "numpy_predictor", lambda *_: (_ for _ in ()).throw(ValueError()))
    slow, again = ex.sampled_shapley(few, model, XS, ["id"], 2, 5)
    p, q = (d.orderBy("id", "feature").toPandas() for d in (quick, slow))
    pd.testing.assert_frame_equal(p, q, rtol=1e-9, atol=1e-9)
    assert base == again


def test_held_out_groups_at_once_equal_one_at_a_time(df):
    data = df.limit(60).select("a", "b", "y").toPandas().to_numpy(float)
    m = moments(df.limit(60), ["a", "b", "y"])[None]
    groups = data.reshape(20, 3, 3)
    found = cv._held_out(groups, m, XS)
    for k in range(20):
        rest = np.delete(data, [3 * k, 3 * k + 1, 3 * k + 2], axis=0)
        w = np.linalg.lstsq(np.column_stack([rest[:, :2], np.ones(57)]), rest[:, 2], rcond=None)[0]
        gap = groups[k][:, 2] - np.column_stack([groups[k][:, :2], np.ones(3)]) @ w
        assert found[k] == pytest.approx((gap**2).mean(), rel=1e-8)
    assert solve(m, XS).features == XS


def test_class_perceptron_reads_all_rows_a_few_times(df, monkeypatch):
    reads, sums = [], mo.summed
    monkeypatch.setattr(mo, "summed", lambda *a: (reads.append(1), sums(*a))[1])
    model = mo.fit_model(df, "neural_network", XS, "k", "classification", hidden=(20,))
    assert model.transform(df).agg(F.avg((F.col("prediction") == F.col("k")).cast("double"))).first()[0] > 0.85
    assert 1 <= len(reads) < 20
