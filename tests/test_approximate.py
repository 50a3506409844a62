"""The forest of random-projection trees, and pairs within a distance, against brute force."""

import numpy as np
import pandas as pd
import pytest

from tableloom.operators import neighbors
from tableloom.operators.anomaly import local_outlier_factor
from tableloom.operators.approximate import Tree, nearest_approximate, nearest_of_few, recall, search_bucket
from tableloom.operators.neighbors import knn_predict, nearest, within

WIDE = [f"c{j}" for j in range(64)]


def wide_rows(n, seed=3, hidden=5):
    """Rows of 64 columns that follow a few hidden ones, with some noise."""
    rng = np.random.default_rng(seed)
    mixing = np.random.default_rng(1).normal(size=(hidden, 64))
    x = np.tanh(rng.normal(size=(n, hidden)) @ mixing / 2) + rng.normal(scale=0.02, size=(n, 64))
    return pd.DataFrame(x, columns=WIDE).assign(id=np.arange(n))


def test_recall_in_64_columns(spark):
    rows = wide_rows(12_000)
    df = spark.createDataFrame(rows).repartition(6).cache()
    found = nearest_approximate(df, "id", WIDE, 10, bucket_rows=1500, visited=True).cache()
    asked = df.where("id % 40 = 0")
    exact = nearest_of_few(df, "id", WIDE, 10, asked)
    assert recall(found, exact) >= 0.9
    assert found.agg({"visited": "avg"}).first()[0] < 0.1 * len(rows)
    counts = found.groupBy("id").count().toPandas()
    assert len(counts) == len(rows) and (counts["count"] == 10).all()
    x = rows[WIDE].to_numpy()
    for r in found.where("id < 20").collect():
        assert r["distance"] == pytest.approx(np.linalg.norm(x[r["id"]] - x[r["neighbour"]]))


def test_few_queries_are_exact(spark):
    rows = wide_rows(700)
    x = rows[WIDE].to_numpy()
    df = spark.createDataFrame(rows).repartition(5)
    got = nearest_of_few(df, "id", WIDE, 3, df.where("id < 9")).toPandas().sort_values(["id", "rank"])
    for i in range(9):
        gaps = np.linalg.norm(x - x[i], axis=1)
        gaps[i] = np.inf
        assert got[got["id"] == i]["neighbour"].tolist() == np.argsort(gaps)[:3].tolist()
    with pytest.raises(ValueError):
        nearest_of_few(df, "id", WIDE, 3, df, most=600).collect()


def test_many_copies_and_other_queries(spark):
    """A third of all rows on one spot; queries that are not points."""
    rows = wide_rows(900)
    rows.loc[:300, WIDE] = rows.loc[0, WIDE].to_numpy()
    df = spark.createDataFrame(rows)
    got = nearest_approximate(df, "id", WIDE, 4, bucket_rows=200).where("id < 300").toPandas()
    assert (got["distance"] == 0).all() and got.groupby("id").size().eq(4).all()
    assert got[got["id"] == 200].sort_values("rank")["neighbour"].tolist() == [0, 1, 2, 3]
    queries = spark.createDataFrame(wide_rows(50, seed=9)).withColumnRenamed("id", "q")
    answers = nearest_approximate(df, "id", WIDE, 2, queries=queries, query_key="q")
    assert answers.groupBy("id").count().where("count = 2").count() == 50
    assert nearest_approximate(df.where("id < 0"), "id", WIDE, 2, queries=queries, query_key="q").count() == 0
    assert nearest_approximate(df.limit(5), "id", WIDE, 9).count() == 20


def test_one_leaf_is_exact():
    rng = np.random.default_rng(0)
    points, queries = rng.normal(size=(40, 3)), rng.normal(size=(7, 3))
    q, p, gap, seen = search_bucket(points, queries, 5, rng, leaf=64)
    gaps = ((queries[:, None] - points[None]) ** 2).sum(axis=2)
    assert [p[q == i].tolist() for i in range(7)] == np.argsort(gaps, axis=1)[:, :5].tolist() and (seen == 40).all()
    np.testing.assert_allclose(gap, np.sort(gaps, axis=1)[:, :5].ravel())


def test_probes_are_different_buckets():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 4))
    tree = Tree.grow(x, 4, rng)
    buckets = tree.buckets(x, 3)
    assert all(len(set(row)) == 3 for row in buckets.tolist()) and buckets.min() >= 0 and buckets.max() < 16
    assert np.bincount(buckets[:, 0], minlength=16).max() < 2 * 500 / 16
    assert Tree.grow(x, 0, rng).buckets(x, 2)[:, 1].max() == -1


def test_exact_neighbours_refuse_many_columns(spark):
    df = spark.createDataFrame(wide_rows(30))
    with pytest.raises(ValueError):
        nearest(df, "id", WIDE[:9], 2)
    assert neighbors.nearest_rows(df, "id", WIDE[:9], 2).count() == 60


def test_outlier_factor_and_votes_in_many_columns(spark):
    rows = wide_rows(600)
    rows.loc[599, WIDE] = 9.0
    scored = local_outlier_factor(spark.createDataFrame(rows), "id", WIDE, contamination=0.01).toPandas().set_index("id")
    assert scored["anomaly_score"].idxmin() == 599 and scored.loc[599, "is_anomaly"]
    train = rows.assign(y=(rows["c0"] > 0).astype(float))
    got = knn_predict(spark.createDataFrame(train), spark.createDataFrame(rows[rows["id"] < 60]), "id", WIDE, "y", 5).toPandas().set_index("id")["prediction"]
    assert len(got) == 60 and ((got > 0.5) == (train["y"][got.index] > 0.5)).mean() > 0.9


@pytest.mark.parametrize("columns, eps", [(["x"], 0.3), (["x", "y"], 0.5), (["x", "y", "z", "w"], 0.9), (["x", "y"], 0.0)])
def test_pairs_within_a_distance(spark, monkeypatch, columns, eps):
    monkeypatch.setattr(neighbors, "SHARE_ROWS", 10)
    rng = np.random.default_rng(8)
    rows = pd.DataFrame(np.round(rng.normal(size=(150, 4)), 1), columns=["x", "y", "z", "w"])
    rows = pd.concat([rows, pd.DataFrame([[0.5, -0.5, 0, 0]] * 40, columns=rows.columns)], ignore_index=True).assign(id=lambda d: d.index)
    rows.loc[3, "x"] = None
    got = {(r["id"], r["neighbour"]) for r in within(spark.createDataFrame(rows), "id", columns, eps).collect()}
    x = rows.dropna(subset=columns)[columns].to_numpy()
    ids = rows.dropna(subset=columns)["id"].to_numpy()
    gaps = np.zeros((len(x), len(x)))
    for c in range(len(columns)):
        gaps += (x[:, None, c] - x[None, :, c]) ** 2
    assert got == {(int(ids[a]), int(ids[b])) for a, b in zip(*np.where(gaps <= eps**2)) if ids[a] < ids[b]}
