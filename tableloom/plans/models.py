"""F. Supervised models and evaluation."""

from pyspark.sql import Window, functions as F

from ..functions.metrics import class_scores, regression_metrics
from ..operators import models as m
from ..operators.columns import task_type
from .registry import query
from .shared import LINE_KEY, counted, with_signal

FEATURES = ["l_quantity", "l_discount", "l_tax"]
TARGET = "l_extendedprice"
LABEL = "l_returnflag"
ONE = ["l_quantity"]


def coefficients(t, model):
    native = model.native
    return t.lineitem.agg(
        F.count(F.lit(1)).alias("n"), F.lit(round(float(native.coefficients[0]), 4)).alias("slope"), F.lit(round(float(native.intercept), 3)).alias("intercept")
    )


def _one_feature_sql(slope):
    return f"""WITH s AS (SELECT count(*) AS n, avg(l_quantity) AS mx, avg(l_extendedprice) AS my, covar_pop(l_quantity, l_extendedprice) AS c, var_pop(l_quantity) AS v FROM lineitem),
 w AS (SELECT *, {slope} AS w FROM s) SELECT n, round(w, 4) AS slope, round(my - w * mx, 3) AS intercept FROM w"""


@query("f01_linear_regression", _one_feature_sql("c / v"))
def f01(t):
    return coefficients(t, m.fit_model(t.lineitem, "linear_regression", ONE, TARGET))


def fitted_sql(name, what="fits"):
    return f"SELECT count(*) AS n, '{name}' AS model, true AS {what} FROM lineitem"


def scored_regression(t, name, least, **params):
    """Whether held-out rows of a target that follows from the columns are explained to the share ``least``."""
    rows = with_signal(t)
    train, test = m.split_by_hash(rows, ["row_key"])
    model = m.fit_model(train, name, FEATURES, "signal", **params)
    r2 = model.transform(test).agg(regression_metrics("signal", "prediction")["r2"].alias("r2")).first()["r2"]
    return counted(rows, model=name, fits=bool(r2 >= least))


def scored_classes(t, name, least, **params):
    """Whether the share ``least`` of held-out rows gets its class, which follows from the columns."""
    rows = with_signal(t)
    train, test = m.split_by_hash(rows, ["row_key"])
    model = m.fit_model(train, name, FEATURES, "kind", "classification", **params)
    accuracy = class_scores(model.transform(test), "kind", "prediction").first()["accuracy"]
    return counted(rows, model=name, fits=bool(accuracy >= least))


@query("f02_random_forest", fitted_sql("random_forest"))
def f02(t):
    return scored_regression(t, "random_forest", 0.85)


@query("f03_gradient_boosting", fitted_sql("gradient_boosting"))
def f03(t):
    return scored_regression(t, "gradient_boosting", 0.95)


@query("f04_neural_network", fitted_sql("neural_network"))
def f04(t):
    return scored_regression(t, "neural_network", 0.95)


@query("f05_kernel_regression", fitted_sql("svm"))
def f05(t):
    return scored_regression(t, "svm", 0.95)


@query("f06_ridge", _one_feature_sql("c * n / (v * n + 1.0)"))
def f06(t):
    return coefficients(t, m.fit_model(t.lineitem, "ridge", ONE, TARGET))


@query("f07_lasso", _one_feature_sql("sign(c) * greatest(abs(c) - 1.0, 0) / v"))
def f07(t):
    return coefficients(t, m.fit_model(t.lineitem, "lasso", ONE, TARGET))


@query("f08_elastic_net", _one_feature_sql("sign(c) * greatest(abs(c) - 0.5, 0) / (v + 0.5)"))
def f08(t):
    return coefficients(t, m.fit_model(t.lineitem, "elastic_net", ONE, TARGET))


_KNN = """
WITH tr AS (SELECT c_custkey AS id, c_acctbal AS x, c_nationkey AS y, CAST(c_custkey AS DOUBLE) AS v, c_mktsegment AS g FROM customer WHERE c_custkey % 5 <> 0),
te AS (SELECT c_custkey AS id, c_acctbal AS x, c_nationkey AS y FROM customer WHERE c_custkey % 5 = 0), s AS (SELECT stddev_pop(x) AS sx, stddev_pop(y) AS sy FROM tr),
n AS (SELECT te.id, tr.v, tr.g, row_number() OVER (PARTITION BY te.id ORDER BY ((te.x - tr.x) / sx) ** 2 + ((te.y - tr.y) / sy) ** 2, tr.id) AS r FROM te, tr, s)
"""


@query("f09_knn_regressor", _KNN + "SELECT id AS c_custkey, round(avg(v), 4) AS prediction FROM n WHERE r <= 5 GROUP BY id")
def f09(t):
    train, test = m.split_by_modulo(t.customer.withColumn("v", F.col("c_custkey").cast("double")), F.col("c_custkey"))
    model = m.fit_model(train, "knn", ["c_acctbal", "c_nationkey"], "v", key="c_custkey")
    return model.transform(test).select("c_custkey", F.round("prediction", 4).alias("prediction"))


@query("f09_knn_classifier", _KNN + "SELECT id AS c_custkey, prediction FROM (SELECT id, g AS prediction, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, g) AS k FROM n WHERE r <= 5 GROUP BY id, g) WHERE k = 1")
def f09_classes(t):
    train, test = m.split_by_modulo(t.customer, F.col("c_custkey"))
    model = m.fit_model(train, "knn", ["c_acctbal", "c_nationkey"], "c_mktsegment", "classification", key="c_custkey")
    return model.transform(test).select("c_custkey", "prediction")


@query("f10_decision_tree", fitted_sql("decision_tree"))
def f10(t):
    return scored_regression(t, "decision_tree", 0.85)


@query("f10_decision_tree_classifier", fitted_sql("decision_tree"))
def f10_classes(t):
    return scored_classes(t, "decision_tree", 0.97)


@query("f11_random_forest_classifier", fitted_sql("random_forest"))
def f11(t):
    return scored_classes(t, "random_forest", 0.9)


@query("f12_gradient_boosting_classifier", fitted_sql("gradient_boosting"))
def f12(t):
    return scored_classes(t, "gradient_boosting", 0.97)


@query("f13_kernel_classifier", fitted_sql("svm"))
def f13(t):
    return scored_classes(t, "svm", 0.85, calibrate=True)


@query("f14_logistic_regression", fitted_sql("logistic_regression"))
def f14(t):
    return scored_classes(t, "logistic_regression", 0.75)


@query("f15_naive_bayes", fitted_sql("naive_bayes"))
def f15(t):
    return scored_classes(t, "naive_bayes", 0.7)


@query("f16_perceptron_classifier", fitted_sql("neural_network"))
def f16(t):
    return scored_classes(t, "neural_network", 0.9)


@query("f17_modulo_split", "SELECT o_orderkey, o_orderkey % 5 = 0 AS is_test FROM orders")
def f17(t):
    train, test = m.split_by_modulo(t.orders.select("o_orderkey"), F.col("o_orderkey"))
    return train.withColumn("is_test", F.lit(False)).union(test.withColumn("is_test", F.lit(True)))


@query("f17_hash_split", "SELECT count(*) AS n, true AS near_share FROM orders")
def f17_hash(t):
    """Every row once, and about a fifth of them held out."""
    train, test = m.split_by_hash(t.orders.select("o_orderkey"), ["o_orderkey"])
    both = train.withColumn("is_test", F.lit(0)).union(test.withColumn("is_test", F.lit(1)))
    return both.agg(F.count(F.lit(1)).alias("n"), (F.abs(F.avg("is_test") - 0.2) < 0.05).alias("near_share"))


@query("f18_stratified_split", """
SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey * 7919 % 10007, o_orderkey) - 1 < round(count(*) OVER (PARTITION BY o_orderstatus) * 0.2) AS is_test FROM orders""")
def f18(t):
    out = m.stratified_split(t.orders, "o_orderstatus", [F.col("o_orderkey") * 7919 % 10007, F.col("o_orderkey")])
    return out.select("o_orderkey", "is_test")


PRED_SQL = "(SELECT l_returnflag, l_extendedprice AS y, l_extendedprice * 0.9271 + l_quantity * 97.3 AS p FROM lineitem)"


def predicted(t):
    return t.lineitem.select("l_returnflag", F.col("l_extendedprice").alias("y"), (F.col("l_extendedprice") * 0.9271 + F.col("l_quantity") * 97.3).alias("p"))


@query("f19_regression_metrics", f"""
SELECT l_returnflag, round(avg((y - p) ** 2), 2) AS mse, round(sqrt(avg((y - p) ** 2)), 4) AS rmse, round(avg(abs(y - p)), 4) AS mae, round(1 - avg((y - p) ** 2) / var_pop(y), 8) AS r2 FROM {PRED_SQL} GROUP BY l_returnflag""")
def f19(t):
    out = {**regression_metrics("y", "p")}
    places = {"mse": 2, "rmse": 4, "mae": 4, "r2": 8}
    return predicted(t).groupBy("l_returnflag").agg(*[F.round(out[k], n).alias(k) for k, n in places.items()])


@query("f20_class_metrics", """
WITH d AS (SELECT l_linestatus AS k, l_returnflag AS y, CASE WHEN l_quantity % 4 = 0 THEN 'A' WHEN l_quantity % 4 = 1 THEN 'X' ELSE l_returnflag END AS p FROM lineitem),
c AS (SELECT k, cls, count(*) FILTER (WHERE y = cls) AS s, count(*) FILTER (WHERE p = cls) AS q, count(*) FILTER (WHERE y = cls AND p = cls) AS h FROM d, (VALUES ('A'), ('N'), ('R'), ('X')) v(cls) GROUP BY k, cls)
SELECT k, round(sum(h) / sum(s), 6) AS accuracy, round(sum(CASE WHEN q > 0 THEN h / q ELSE 0 END * s) / sum(s), 6) AS precision, round(sum(h) / sum(s), 6) AS recall,
 round(sum(CASE WHEN s + q > 0 THEN 2 * h / (s + q) ELSE 0 END * s) / sum(s), 6) AS f1 FROM c GROUP BY k""")
def f20(t):
    q = F.col("l_quantity") % 4
    df = t.lineitem.select(
        F.col("l_linestatus").alias("k"), F.col("l_returnflag").alias("y"),
        F.when(q == 0, F.lit("A")).when(q == 1, F.lit("X")).otherwise(F.col("l_returnflag")).alias("p"),
    )
    out = class_scores(df, "y", "p", ["k"])
    return out.select("k", *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


def keyed(t):
    return t.lineitem.select(F.xxhash64(*LINE_KEY, "l_extendedprice").alias("row_key"), *FEATURES, TARGET)


@query("f21_training_run", "SELECT 'linear_regression' AS algorithm, 'signal' AS target, count(*) AS n, 5 AS folds, true AS fits FROM lineitem")
def f21(t):
    rows = with_signal(t).drop("kind")
    report = m.train(rows, "linear_regression", "row_key", "signal").report
    fits = (F.col("train_r2") > 0.9) & (F.col("test_r2") > 0.9) & (F.abs(F.col("cv_mean") - F.col("test_rmse")) < 0.2 * F.col("test_rmse"))
    return report.select("algorithm", "target", (F.col("train_samples") + F.col("test_samples")).alias("n"), F.size("cv_scores").alias("folds"), fits.alias("fits"))


_FOLDS = """WITH s AS (SELECT l_suppkey % 5 AS fold, l_quantity AS x, l_extendedprice AS y FROM lineitem),
f AS (SELECT k AS fold, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM s, range(5) r(k) WHERE s.fold <> k GROUP BY k)"""


@query("f22_fold_rmse", _FOLDS + "SELECT round(sqrt(avg((y - a - b * x) ** 2)), 4) AS rmse FROM s JOIN f USING (fold) GROUP BY fold")
def f22(t):
    scores = m.fold_rmse(t.lineitem, "linear_regression", "l_suppkey", ONE, TARGET, 5, F.pmod(F.col("l_suppkey"), F.lit(5)))
    return t.spark.createDataFrame([(s,) for s in scores], "rmse double").select(F.round("rmse", 4).alias("rmse"))


@query("f23_grid_search", """
SELECT model, settings::BIGINT AS settings, n, true AS best_fits FROM (SELECT count(*) AS n FROM part), (VALUES ('random_forest', 4), ('gradient_boosting', 4), ('svm', 3)) v(model, settings)""")
def f23(t):
    """All three grids, and whether the best model of each explains a target that follows from the columns."""
    size = F.col("p_size").cast("double")
    rows = t.part.select("p_partkey", size.alias("size"), "p_retailprice", (size * 20 + (size - 25) * (size - 25) + F.col("p_retailprice") / 10).alias("y"))
    out = []
    for name in m.GRIDS:
        tried, best = m.tuned(rows, name, ["size", "p_retailprice"], "y", parallelism=4, key=["p_partkey"])
        r2 = best.transform(rows).agg(regression_metrics("y", "prediction")["r2"].alias("r2"), F.count(F.lit(1)).alias("n")).first()
        out.append((name, tried.where("mse is not null").count(), r2["n"], bool(r2["r2"] > 0.9)))
    return t.spark.createDataFrame(out, "model string, settings bigint, n bigint, best_fits boolean")


@query("f24_feature_importance", "SELECT * FROM (VALUES ('l_quantity', 1), ('l_discount', 2), ('l_tax', 3)) v(feature, place), (SELECT true AS adds_up)")
def f24(t):
    """The order of importance follows what the columns add to the target's spread."""
    rows = with_signal(t)
    found = m.importance_rows(rows, m.fit_model(rows, "decision_tree", FEATURES, "signal"), FEATURES)
    place = F.row_number().over(Window.orderBy(F.desc("importance"))).cast("int")  # a row per feature
    total = F.sum("importance").over(Window.partitionBy())
    return found.select("feature", place.alias("place"), (F.abs(total - 1) < 1e-9).alias("adds_up"))


@query("f25_mape", "SELECT round(avg(CASE WHEN y <> 0 THEN abs((y - p) / y) END), 8) AS mape FROM (SELECT CASE WHEN l_returnflag = 'A' THEN 0.0 ELSE y END AS y, p FROM " + PRED_SQL + ")")
def f25(t):
    df = predicted(t).withColumn("y", F.when(F.col("l_returnflag") == "A", F.lit(0.0)).otherwise(F.col("y")))
    return df.agg(F.round(regression_metrics("y", "p")["mape"], 8).alias("mape"))


@query("f26_task_type", " UNION ALL ".join(
    f"SELECT '{c}' AS name, CASE WHEN {text} OR count(DISTINCT {c}) < 10 THEN 'classification' ELSE 'regression' END AS task FROM lineitem"
    for c, text in (("l_returnflag", "true"), ("l_linenumber", "false"), ("l_tax", "false"), ("l_quantity", "false"))))
def f26(t):
    rows = [(c, task_type(t.lineitem, c)) for c in ("l_returnflag", "l_linenumber", "l_tax", "l_quantity")]
    return t.spark.createDataFrame(rows, "name string, task string")
