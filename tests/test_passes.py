"""How often solvers read all rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tableloom.operators import anomaly as an
from tableloom.operators import clustering as cl
from tableloom.operators import crossval as cv
from tableloom.operators import models as mo
from tableloom.operators import passes

XS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def df(spark):
    rng = np.random.default_rng(5)
    x = rng.uniform(-1, 1, size=(3000, 3))
    y = 3 * x[:, 0] + np.where(x[:, 1] > 0, 2 * x[:, 1], 0) + 0.1 * x[:, 2]
    kind = np.where(x[:, 0] > 0.3, "p", np.where(x[:, 1] > 0.2, "q", "r"))
    return spark.createDataFrame(pd.DataFrame(x, columns=XS).assign(id=range(3000), y=y, kind=kind)).persist()


@pytest.fixture
def reads(monkeypatch):
    """Counts passes over all rows; solvers start from 500 rows."""
    done = []
    for module in (an, mo):
        monkeypatch.setattr(module, "summed", lambda *a: done.append(1) or passes.summed(*a))
    monkeypatch.setattr(passes, "START", 500)
    return done


def test_one_class_machine_reads_all_rows_a_few_times(df, reads):
    *_, gap = an.one_class_margin(df, XS, 0.1)
    assert gap < 1e-3 and 1 < len(reads) < 40


def test_kernel_classes_read_all_rows_a_few_times_and_store_no_vectors(df, reads):
    model = mo.fit_model(df, "svm", XS, "kind", "classification")
    right = model.transform(df).agg(F.avg((F.col("prediction") == F.col("kind")).cast("double"))).first()[0]
    assert right > 0.95 and 3 < len(reads) < 60
    with pytest.raises(ValueError, match="without a value"):
        mo.fit_model(df.withColumn("a", F.when(F.col("id") > 5, F.col("a"))), "svm", XS, "kind", "classification")


def test_perceptron_reads_all_rows_a_few_times(df, reads):
    model = mo.fit_model(df, "neural_network", XS, "y", hidden=(20,), rounds=60)
    left = model.transform(df).agg(F.avg((F.col("prediction") - F.col("y")) ** 2) / F.var_pop("y")).first()[0]
    assert left < 0.02 and 1 < len(reads) < 50


@pytest.mark.parametrize("metric", ["r2", "neg_mean_squared_error"])
def test_learning_curve_from_moments_equals_that_from_rows(df, monkeypatch, metric):
    gapped = cv.k_fold(df.withColumn("c", F.when(F.col("id") % 7 > 0, F.col("c"))), ["id"])
    quick = cv.learning_curve(gapped, "ridge", XS, "y", metric, [0.3, 1.0], key=["id"]).orderBy("train_share").toPandas()
    monkeypatch.setattr(cv, "SQUARED", ())
    slow = cv.learning_curve(gapped, "ridge", XS, "y", metric, [0.3, 1.0], key=["id"]).orderBy("train_share").toPandas()
    pd.testing.assert_frame_equal(quick, slow, rtol=1e-9)


def test_learning_curve_copies_no_rows(df, monkeypatch):
    monkeypatch.setattr(cv, "score", lambda *a: pytest.fail("rows are scored one by one"))
    assert cv.learning_curve(cv.k_fold(df, ["id"]), "linear_regression", XS, "y", key=["id"]).count() == 10


def test_k_means_uses_all_cores_on_one_file(df, monkeypatch):
    parts, fit = [], cl.KMeans.fit
    monkeypatch.setattr(cl.KMeans, "fit", lambda self, rows: parts.append(rows.rdd.getNumPartitions()) or fit(self, rows))
    cl.kmeans(df.coalesce(1), XS, 3, restarts=2)
    assert parts == [df.sparkSession.sparkContext.defaultParallelism] * 2
