"""G. Cross-validation."""

from pyspark.sql import Window, functions as F

from ..operators import crossval as cv
from ..operators.linear import linear_fit, predict_linear
from .models import FEATURES, ONE, TARGET
from .registry import query
from .shared import with_signal


def by_supplier(t):
    return cv.k_fold_modulo(t.lineitem, F.col("l_suppkey"))


@query("g01_k_fold", "SELECT o_orderkey, CAST(o_orderkey % 5 AS INTEGER) AS fold FROM orders")
def g01(t):
    return cv.k_fold_modulo(t.orders.select("o_orderkey"), F.col("o_orderkey"))


@query("g01_k_fold_hashed", "SELECT k AS fold, (SELECT count(DISTINCT o_orderkey) FROM orders) AS all_keys, true AS near_share FROM range(5) r(k)")
def g01_hashed(t):
    """Five folds that hold every key once, each about a fifth of them."""
    folds = cv.k_fold(t.orders.select("o_orderkey"), ["o_orderkey"]).groupBy("fold").agg(F.countDistinct("o_orderkey").alias("k"))
    everything = F.sum("k").over(Window.partitionBy())  # five rows
    return folds.select(F.col("fold").cast("bigint").alias("fold"), everything.alias("all_keys"), (F.abs(F.col("k") / everything - 0.2) < 0.05).alias("near_share"))


@query("g02_stratified_k_fold", "SELECT o_orderkey, CAST((row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1) % 5 AS INTEGER) AS fold FROM orders")
def g02(t):
    return cv.stratified_k_fold(t.orders, "o_orderpriority", ["o_orderkey"]).select("o_orderkey", "fold")


@query("g03_leave_one_out", """
WITH s AS (SELECT count(*) AS n, avg(l_quantity) AS mx, var_pop(l_quantity) AS v, regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem)
SELECT count(*) AS n, round(sqrt(avg(((l_extendedprice - a - b * l_quantity) / (1 - (1 / n + (l_quantity - mx) ** 2 / (n * v)))) ** 2)), 4) AS loo_rmse FROM lineitem, s""")
def g03(t):
    out = cv.leave_one_out(t.lineitem, ONE, TARGET)
    squared = F.col("loo_residual") * F.col("loo_residual")
    return out.agg(F.count(F.lit(1)).alias("n"), F.round(F.sqrt(F.avg(squared)), 4).alias("loo_rmse"))


@query("g04_leave_p_out", "SELECT (count(*) + 1) // 2 AS subsets, true AS near_the_fit FROM lineitem")
def g04(t):
    """All rows in pairs that are held out once, with an error that hardly exceeds that of the fit to all rows."""
    rows = with_signal(t)
    out = cv.leave_p_out(rows, ["row_key"], FEATURES, "signal")
    inside = predict_linear(rows, linear_fit(rows, FEATURES, "signal")).agg(F.avg((F.col("prediction") - F.col("signal")) ** 2).alias("mse")).first()["mse"]
    return out.agg(F.count(F.lit(1)).alias("subsets"), (F.avg("mse") / F.lit(inside)).between(0.99, 1.05).alias("near_the_fit"))


@query("g05_shuffle_split", "SELECT k AS split, (SELECT count(*) FROM orders) AS n, true AS near_share FROM range(5) r(k)")
def g05(t):
    """Independent draws over all rows, each with about a fifth held out."""
    marks = cv.shuffle_split(t.orders.select("o_orderkey"), ["o_orderkey"])
    long = marks.select(F.posexplode(F.array(*[F.col(f"test_{i}").cast("int") for i in range(5)])).alias("split", "held"))
    return long.groupBy(F.col("split").cast("bigint").alias("split")).agg(F.count(F.lit(1)).alias("n"), (F.abs(F.avg("held") - 0.2) < 0.05).alias("near_share"))


@query("g06_time_series_split", """
WITH p AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS position, count(*) OVER () AS n FROM events)
SELECT event_id, position, CASE WHEN position >= n - 5 * (n // 6) THEN CAST((position - (n - 5 * (n // 6))) // (n // 6) AS INTEGER) END AS fold FROM p""")
def g06(t):
    return cv.time_series_split(t.events.select("event_id", "ts"), ["ts", "event_id"]).drop("ts")


@query("g07_group_k_fold", """
WITH RECURSIVE g AS (SELECT user_id, row_number() OVER (ORDER BY n DESC, user_id) AS i, n FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id)),
r AS (SELECT 0::BIGINT AS i, NULL::BIGINT AS user_id, NULL::BIGINT AS f, [0, 0, 0, 0, 0]::BIGINT[] AS loads
 UNION ALL SELECT g.i, g.user_id, list_position(r.loads, list_min(r.loads))::BIGINT, list_transform(r.loads, lambda x, j: CASE WHEN j = list_position(r.loads, list_min(r.loads)) THEN x + g.n ELSE x END) FROM r JOIN g ON g.i = r.i + 1)
SELECT event_id, e.user_id, CAST(f - 1 AS INTEGER) AS fold FROM events e JOIN r ON r.user_id = e.user_id""")
def g07(t):
    return cv.group_k_fold(t.events.select("event_id", "user_id"), "user_id")


_FITS = """WITH s AS (SELECT l_suppkey % 5 AS fold, l_quantity AS x, l_extendedprice AS y FROM lineitem),
f AS (SELECT k AS m, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM s, range(5) r(k) WHERE s.fold <> k GROUP BY k),
e AS (SELECT m, fold = m AS test, y, a + b * x AS p FROM s, f),
z AS (SELECT m, test, -avg((y - p) ** 2) AS mse, -avg(abs(y - p)) AS mae, 1 - avg((y - p) ** 2) / var_pop(y) AS r2 FROM e GROUP BY m, test),
l AS (SELECT m, test, 'neg_mean_squared_error' AS metric, mse AS v FROM z UNION ALL SELECT m, test, 'neg_mean_absolute_error', mae FROM z UNION ALL SELECT m, test, 'r2', r2 FROM z)
"""


@query("g08_cross_validation", _FITS + "SELECT CAST(m AS INTEGER) AS fold, metric, round(max(v) FILTER (WHERE test), 6 - CASE metric WHEN 'neg_mean_squared_error' THEN 6 WHEN 'neg_mean_absolute_error' THEN 3 ELSE 0 END) AS test_score, round(max(v) FILTER (WHERE NOT test), 6 - CASE metric WHEN 'neg_mean_squared_error' THEN 6 WHEN 'neg_mean_absolute_error' THEN 3 ELSE 0 END) AS train_score FROM l GROUP BY m, metric")
def g08(t):
    out = cv.cross_validate(by_supplier(t), "linear_regression", ONE, TARGET, task="regression")
    places = lambda c: F.when(F.col("metric") == "neg_mean_squared_error", F.round(c, 0)).when(
        F.col("metric") == "neg_mean_absolute_error", F.round(c, 3)
    ).otherwise(F.round(c, 6))
    return out.select("fold", "metric", places("test_score").alias("test_score"), places("train_score").alias("train_score"))


@query("g09_learning_curve", "SELECT round(k / 10, 1) AS train_share, true AS fits FROM range(1, 11) r(k)")
def g09(t):
    df = with_signal(t)
    out = cv.learning_curve(cv.k_fold(df, ["row_key"]), "linear_regression", FEATURES, "signal", key=["row_key"])
    return out.select(F.round("train_share", 1).alias("train_share"), ((F.col("validation_mean") > 0.85) & (F.abs(F.col("train_mean") - F.col("validation_mean")) < 0.05)).alias("fits"))


@query("g09_class_learning_curve", "SELECT unnest([0.2, 0.6, 1.0])::DOUBLE AS train_share, true AS fits")
def g09_classes(t):
    """The curve of a classifier, by accuracy."""
    df = with_signal(t)
    out = cv.learning_curve(cv.k_fold(df, ["row_key"], 3), "decision_tree", FEATURES, "kind", shares=[0.2, 0.6, 1.0], key=["row_key"], task="classification")
    return out.select(F.round("train_share", 1).alias("train_share"), (F.col("validation_mean") > 0.95).alias("fits"))


@query("g10_insights", _FITS + """, q AS (SELECT avg(v) FILTER (WHERE test) AS tm, stddev_pop(v) FILTER (WHERE test) AS ts, avg(v) FILTER (WHERE NOT test) AS trm FROM l WHERE metric = 'r2')
SELECT 'r2' AS best_metric, round(tm, 6) AS best_score, round(ts, 6) AS score_std, list_filter([CASE WHEN ts / abs(tm) > 0.1 THEN 'High variance detected across folds - model may be overfitting' WHEN ts / abs(tm) < 0.05 THEN 'Low variance across folds - consistent performance' END,
 CASE WHEN trm - tm > 0.1 THEN 'Large train-validation gap - possible overfitting' END], lambda x: x IS NOT NULL) AS insights FROM q""")
def g10(t):
    folds = cv.cross_validate(by_supplier(t), "linear_regression", ONE, TARGET, task="regression")
    out = cv.insights(cv.cv_summary(folds))
    return out.select("best_metric", F.round("best_score", 6).alias("best_score"), F.round("score_std", 6).alias("score_std"), "insights")


@query("g11_fold_statistics", _FITS + """SELECT metric, round(min(v), 2) AS min_score, round(max(v), 2) AS max_score, round(median(v), 2) AS median_score, round(max(v) - min(v), 2) AS score_range,
 round(quantile_cont(v, 0.025), 2) AS low, round(quantile_cont(v, 0.975), 2) AS high FROM l WHERE test AND metric <> 'r2' GROUP BY metric""")
def g11(t):
    folds = cv.cross_validate(by_supplier(t), "linear_regression", ONE, TARGET, task="regression").where("metric <> 'r2'")
    s = cv.cv_summary(folds)
    return s.select(
        "metric", *[F.round(c, 2).alias(c) for c in ("min_score", "max_score", "median_score", "score_range")],
        F.round(F.col("interval_95")[0], 2).alias("low"), F.round(F.col("interval_95")[1], 2).alias("high"),
    )


@query("g12_fold_times", "SELECT k::INTEGER AS fold, count(*) AS metrics, true AS timed FROM range(5) r(k), (VALUES (1), (2), (3)) v(x) GROUP BY k")
def g12(t):
    """Fitting and scoring took time in every fold."""
    folds = cv.cross_validate(by_supplier(t), "decision_tree", FEATURES, TARGET, task="regression", train_scores=False)
    return folds.groupBy("fold").agg(F.count(F.lit(1)).alias("metrics"), F.min((F.col("fit_time") > 0) & (F.col("score_time") > 0)).alias("timed"))
