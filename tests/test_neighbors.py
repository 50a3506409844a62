"""Nearest rows, outlier factors, density clusters and components against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tableloom.operators.components import connected_components
from tableloom.operators.density import dbscan, mean_shift
from tableloom.operators.neighbors import knn_predict, nearest


def spread(n=600, seed=5):
    """Clumps, scattered rows, and one spot that holds a third of all rows."""
    rng = np.random.default_rng(seed)
    clumps = np.concatenate([rng.normal(c, 0.3, size=(n // 3, 2)) for c in ((0, 0), (4, 1))])
    copies = np.tile([[2.0, 2.0]], (n // 3, 1))
    x = np.concatenate([clumps, copies, rng.uniform(-3, 8, size=(n // 10, 2))])
    return pd.DataFrame({"id": np.arange(len(x)), "x": x[:, 0], "y": x[:, 1]})


def brute(points, queries, k, own):
    out = {}
    for q in queries.itertuples():
        gap = (points.x - q.x) ** 2 + (points.y - q.y) ** 2
        order = sorted((g, i) for g, i in zip(gap, points.id) if not (own and i == q.id))
        out[q.id] = [i for _, i in order[:k]]
    return out


def found(df):
    rows = df.toPandas().sort_values(["id", "rank"])
    return rows.groupby("id")["neighbour"].apply(list).to_dict()


def test_nearest_of_itself_with_many_copies(spark):
    p = spread()
    got = nearest(spark.createDataFrame(p), "id", ["x", "y"], 4, block_rows=16, plain_rows=0)
    assert found(got) == brute(p, p, 4, True)


def test_nearest_of_other_rows(spark):
    p, q = spread(), spread(90, seed=8)
    got = nearest(spark.createDataFrame(p), "id", ["x", "y"], 3, queries=spark.createDataFrame(q), block_rows=16)
    assert found(got) == brute(p, q, 3, False)


def test_fewer_points_than_asked(spark):
    p = pd.DataFrame({"id": [1, 2, 3], "x": [0.0, 1.0, 5.0], "y": [0.0, 0.0, 0.0]})
    got = nearest(spark.createDataFrame(p), "id", ["x", "y"], 10)
    assert found(got) == {1: [2, 3], 2: [1, 3], 3: [2, 1]}


def test_knn_majority(spark):
    train = spark.createDataFrame([(1, 0.0, "a"), (2, 0.1, "a"), (3, 0.2, "b"), (4, 9.0, "b")], "id long, x double, c string")
    rows = spark.createDataFrame([(10, 0.05), (11, 9.5)], "id long, x double")
    got = {r["id"]: r["prediction"] for r in knn_predict(train, rows, "id", ["x"], "c", 3, classify=True).collect()}
    assert got == {10: "a", 11: "b"} or got == {10: "a", 11: "a"}
    assert got[10] == "a"


def brute_dbscan(p, eps, m):
    x = p[["x", "y"]].to_numpy()
    close = ((x[:, None] - x[None]) ** 2).sum(axis=2) <= eps * eps
    core = close.sum(axis=1) >= m
    label, at = np.full(len(x), -1), 0
    for i in range(len(x)):
        if not core[i] or label[i] >= 0:
            continue
        todo, label[i] = [i], at
        while todo:
            for j in np.flatnonzero(close[todo.pop()]):
                if label[j] < 0:
                    label[j] = at
                    if core[j]:
                        todo.append(j)
        at += 1
    return label, core


@pytest.mark.parametrize("eps,m", [(0.2, 5), (0.6, 8), (1.5, 4)])
def test_dbscan_equals_textbook(spark, eps, m):
    p = spread()
    label, core = brute_dbscan(p, eps, m)
    got = dbscan(spark.createDataFrame(p), "id", ["x", "y"], eps, m, plain_rows=0).toPandas().set_index("id").sort_index()
    assert (got["is_core"].to_numpy() == core).all()
    assert (got["cluster"].to_numpy() == label).all()


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, size=(180, 2))] + [(500, 500 + i) for i in range(1, 60)] + [(i, i + 1) for i in range(700, 760)]
    parent = {}

    def root(v):
        while parent.setdefault(v, v) != v:
            v = parent[v]
        return v

    for a, b in edges:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    nodes = sorted({v for e in edges for v in e} | {9999})
    df = spark.createDataFrame([(v,) for v in nodes], "node long")
    got = {r["node"]: r["component"] for r in connected_components(df, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: root(v) for v in nodes}


def test_mean_shift_finds_the_clumps(spark):
    p = spread()
    labels, modes = mean_shift(spark.createDataFrame(p), "id", ["x", "y"], bandwidth=1.2)
    got = labels.toPandas()
    assert len(got) == len(p)
    centres = modes.orderBy(F.desc("weight")).limit(3).select("x0", "x1").toPandas().to_numpy()
    for want in ((0, 0), (4, 1), (2, 2)):
        assert min(np.hypot(*(c - np.array(want))) for c in centres) < 0.5


def test_stars_need_no_round(spark):
    """Edges that are stars around their smallest nodes are done: nothing but the edges is stored; a chain takes rounds."""
    def stored(edges):
        nodes = spark.createDataFrame([(n,) for n in sorted({n for e in edges for n in e})], "node long")
        spark.sparkContext.setJobGroup(group := f"components of {edges[:3]}", "")
        got = {r["node"]: r["component"] for r in connected_components(nodes, spark.createDataFrame(edges, "a long, b long")).collect()}
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return got, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    stars, few = stored([(1, b) for b in range(2, 9)] + [(20, 21), (22, 20), (22, 22), (1, 2)])
    assert stars == {**dict.fromkeys(range(1, 9), 1), 20: 20, 21: 20, 22: 20}
    chain, many = stored([(b, b + 1) for b in range(1, 9)])
    assert chain == dict.fromkeys(range(1, 10), 1) and few < many / 2
