"""Positions, frames, running totals and quantiles in their large-table form."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tableloom.operators.stats import exact_quantiles
from tableloom.operators.windows import frame_window, rolling_mean_std, running_sum, top_per_key, with_position


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    n = 3000
    key = np.where(rng.random(n) < 0.4, 0, rng.integers(1, 30, n))  # key 0 holds over a third
    return pd.DataFrame({"id": np.arange(n), "k": key, "t": rng.integers(0, 500, n), "v": rng.normal(size=n).round(4)})


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_position_equals_plain_sort(spark, rows, keys):
    out = with_position(spark.createDataFrame(rows), ["t", "id"], keys, plain_rows=0).toPandas()
    expected = rows.sort_values([*keys, "t", "id"])
    expected["position"] = expected.groupby(keys).cumcount() if keys else np.arange(len(rows))
    both = out.merge(expected, on="id")
    assert len(both) == len(rows)
    assert (both.position_x == both.position_y).all()


def test_position_keeps_null_keys(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "a")], "id int, k string")
    out = {r["id"]: r["position"] for r in with_position(df, ["id"], ["k"], plain_rows=0).collect()}
    assert out == {1: 0, 2: 1, 3: 0}


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_rolling_over_blocks(spark, rows, keys):
    df = spark.createDataFrame(rows)
    big = rolling_mean_std(df, ["v"], ["t", "id"], 5, keys, plain_rows=0, block_rows=37).toPandas().set_index("id").sort_index()
    small = rolling_mean_std(df, ["v"], ["t", "id"], 5, keys).toPandas().set_index("id").sort_index()
    assert len(big) == len(rows)
    np.testing.assert_allclose(big["v_rolling_mean"], small["v_rolling_mean"], atol=1e-12)
    np.testing.assert_allclose(big["v_rolling_std"], small["v_rolling_std"], atol=1e-12)


def test_frame_ahead_and_running_sum(spark, rows):
    df = spark.createDataFrame(rows)
    lead = frame_window(df, ["t", "id"], lambda w: {"n": F.lead("id").over(w)}, before=0, after=1, keys=["k"], plain_rows=0, block_rows=11)
    got = lead.toPandas().set_index("id")["n"].sort_index()
    ordered = rows.sort_values(["k", "t", "id"])
    expected = ordered.assign(n=ordered.groupby("k")["id"].shift(-1)).set_index("id")["n"].sort_index()
    assert got.fillna(-1).tolist() == expected.fillna(-1).tolist()
    total = running_sum(df, ["t", "id"], F.col("t"), "s", ["k"], plain_rows=0, block_rows=29).toPandas().set_index("id")["s"].sort_index()
    expected = ordered.assign(s=ordered.groupby("k")["t"].cumsum()).set_index("id")["s"].sort_index()
    assert total.tolist() == expected.tolist()


def test_quantiles_narrow_to_exact(spark):
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.normal(size=2000), np.full(1500, 0.25), rng.exponential(size=900)])
    w = rng.integers(0, 3, len(v)).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"v": v, "w": w}))
    shares = [0.0, 0.1, 0.25, 0.5, 0.77, 0.999, 1.0]
    for small in (10**6, 50):
        got = exact_quantiles(df, {"v": shares, "w": shares}, small_rows=small, accuracy=100)
        np.testing.assert_allclose(got["v"], np.quantile(v, shares), atol=1e-12)
        np.testing.assert_allclose(got["w"], np.quantile(w, shares), atol=1e-12)


def test_quantiles_skip_nulls_and_empty(spark):
    df = spark.createDataFrame([(None, 1.0), (2.0, None), (4.0, None)], "a double, b double").withColumn("c", F.lit(None).cast("double"))
    assert exact_quantiles(df, {"a": [0.5], "b": [0.5], "c": [0.5]}) == {"a": [3.0], "b": [1.0], "c": [None]}


def test_top_per_key_prunes_before_the_shuffle(spark, rows):
    top = top_per_key(spark.createDataFrame(rows), ["k"], [F.asc("t"), F.asc("id")], 3)
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()
    expected = rows.sort_values(["t", "id"]).groupby("k").head(3)["id"]
    assert sorted(r["id"] for r in top.collect()) == sorted(expected)
