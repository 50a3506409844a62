"""H. Ensembles."""

from pyspark.sql import functions as F

from ..operators import crossval as cv
from ..operators import ensemble as en
from ..operators import models as m
from ..functions.metrics import class_scores, regression_metrics
from .models import FEATURES, TARGET, fitted_sql
from .registry import query
from .shared import counted, with_signal

KEY = ["row_key"]


def halves(t):
    rows = with_signal(t)
    return (rows, *m.split_by_hash(rows, KEY))


def r2(rows):
    return rows.agg(regression_metrics("signal", "prediction")["r2"].alias("r2")).first()["r2"]


def beats_the_linear_fit(t, name, scored):
    """Whether ``scored`` test rows are explained better than by a line through all columns."""
    rows, train, test = halves(t)
    line = r2(m.fit_model(train, "linear_regression", FEATURES, "signal").transform(test))
    return counted(rows, model=name, fits=bool(r2(scored) > line))


@query("h01_voting_regression", """
WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b1, regr_intercept(l_extendedprice, l_quantity) AS a1, avg(l_quantity) AS mx, avg(l_extendedprice) AS my, covar_pop(l_quantity, l_extendedprice) * count(*) / (var_pop(l_quantity) * count(*) + 1) AS b2 FROM lineitem)
SELECT l_orderkey, l_linenumber, round((a1 + b1 * l_quantity + my - b2 * mx + b2 * l_quantity) / 2, 3) AS prediction FROM lineitem, f""")
def h01(t):
    members = en.fit_members(t.lineitem, ["linear_regression", "ridge"], ["l_quantity"], TARGET)
    out = en.vote(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity"), members)
    return out.select("l_orderkey", "l_linenumber", F.round("prediction", 3).alias("prediction"))


def _voted(t, voting):
    """Whether the vote is right at least as often as its middle member."""
    rows, train, test = halves(t)
    members = en.fit_members(train, ["decision_tree", "naive_bayes", "logistic_regression"], FEATURES, "kind", "classification")
    right = [class_scores(d, "kind", "prediction").first()["accuracy"] for d in (en.vote(test, members, "classification", voting), *(x.transform(test) for x in members.values()))]
    return counted(rows, model=voting, fits=bool(right[0] >= sorted(right[1:])[1] and right[0] > 0.75))


@query("h01_voting_soft", fitted_sql("soft"))
def h01_soft(t):
    return _voted(t, "soft")


@query("h01_voting_hard", fitted_sql("hard"))
def h01_hard(t):
    return _voted(t, "hard")


@query("h02_bagging", fitted_sql("bagging"))
def h02(t):
    rows, train, test = halves(t)
    members = en.bag(train, "decision_tree", FEATURES, "signal")
    return counted(rows, model="bagging", fits=bool(r2(en.vote(test, members)) > 0.85 and len(members) == 10))


@query("h03_stacking", fitted_sql("stacking"))
def h03(t):
    _, train, test = halves(t)
    model, _ = en.stack(train, ["linear_regression", "decision_tree"], KEY, FEATURES, "signal")
    return beats_the_linear_fit(t, "stacking", model.transform(test))


@query("h04_weighted_average", """
WITH d AS (SELECT l_extendedprice AS y, l_extendedprice * 0.8 + l_quantity * 100 AS a, l_extendedprice * 1.1 + l_quantity * 37 AS b FROM lineitem),
w AS (SELECT greatest(0, least(1, -avg((a - b) * (b - y)) / avg((a - b) ** 2))) AS w FROM d)
SELECT round(w, 6) AS weight_a, round(1 - w, 6) AS weight_b, round(sqrt(avg((w * a + (1 - w) * b - y) ** 2)), 3) AS rmse FROM d, w GROUP BY w""")
def h04(t):
    q = F.col("l_quantity")
    df = t.lineitem.select(
        F.col(TARGET).alias("y"), (F.col(TARGET) * 0.8 + q * 100).alias("a"), (F.col(TARGET) * 1.1 + q * 37).alias("b")
    )
    weights = en.simplex_weights(df, ["a", "b"], "y")
    mixed = en.weighted(df, weights)
    squared = (F.col("prediction") - F.col("y")) * (F.col("prediction") - F.col("y"))
    return mixed.agg(
        F.lit(round(weights["a"], 6)).alias("weight_a"), F.lit(round(weights["b"], 6)).alias("weight_b"), F.round(F.sqrt(F.avg(squared)), 3).alias("rmse")
    )


@query("h05_member_scores", " UNION ALL ".join(
    f"SELECT '{n}' AS model, round(avg((p - y) ** 2), 2) AS mse, round(avg(abs(p - y)), 4) AS mae, round(1 - avg((p - y) ** 2) / var_pop(y), 8) AS r2 FROM (SELECT l_extendedprice AS y, {e} AS p FROM lineitem)"
    for n, e in (("a", "l_extendedprice * 0.8 + l_quantity * 100.3"), ("b", "l_extendedprice * 1.1 + l_quantity * 37.1"))))
def h05(t):
    q, y = F.col("l_quantity"), F.col(TARGET)
    df = t.lineitem.select(y.alias("y"), (y * 0.8 + q * 100.3).alias("a"), (y * 1.1 + q * 37.1).alias("b"))
    out = m.member_scores(df, ["a", "b"], "y")
    return out.select("model", F.round("mse", 2).alias("mse"), F.round("mae", 4).alias("mae"), F.round("r2", 8).alias("r2"))


@query("h06_member_cross_validation", """
SELECT * FROM (VALUES ('linear_regression', 'r2', true), ('ridge', 'r2', true), ('decision_tree', 'r2', true), ('logistic_regression', 'accuracy', true), ('naive_bayes', 'accuracy', true)) v(model, metric, fits)""")
def h06(t):
    """The members' scores over three folds: numbers by r2, classes by accuracy."""
    df = cv.k_fold(with_signal(t), KEY, 3)
    numbers = en.member_cross_validation(df, ["linear_regression", "ridge", "decision_tree"], FEATURES, "signal")
    classes = en.member_cross_validation(df, ["logistic_regression", "naive_bayes"], FEATURES, "kind", task="classification")
    return numbers.unionByName(classes).select("model", "metric", ((F.col("test_mean") > 0.7) & (F.col("test_std") < 0.05)).alias("fits"))


@query("h07_boosting", fitted_sql("boosting"))
def h07(t):
    rows, train, test = halves(t)
    return counted(rows, model="boosting", fits=bool(r2(en.boost(train, FEATURES, "signal").transform(test)) > 0.95))


@query("h08_blending", fitted_sql("blending"))
def h08(t):
    _, train, test = halves(t)
    model, _ = en.blend(train, ["linear_regression", "decision_tree"], KEY, FEATURES, "signal")
    return beats_the_linear_fit(t, "blending", model.transform(test))


@query("h09_ensemble_report", """
SELECT kind, model, (SELECT count(*) FROM lineitem) AS samples, true AS fits FROM (VALUES ('member', 'linear_regression'), ('member', 'decision_tree'), ('ensemble', 'voting'), ('ensemble', 'weighted'), ('ensemble', 'stacking')) v(kind, model)""")
def h09(t):
    out = en.build(with_signal(t), KEY, ["linear_regression", "decision_tree"], FEATURES, "signal", ["voting", "weighted", "stacking"])
    return out.select("kind", "model", (F.col("train_samples") + F.col("test_samples")).alias("samples"), (F.col("r2") > 0.8).alias("fits"))


@query("h09_class_report", """
SELECT kind, model, true AS fits FROM (VALUES ('member', 'decision_tree'), ('member', 'naive_bayes'), ('member', 'logistic_regression'), ('ensemble', 'voting'), ('ensemble', 'weighted')) v(kind, model)""")
def h09_classes(t):
    """Members and ensembles for classes; the weights of the vote are searched on counts of vote patterns."""
    out = en.build(with_signal(t), KEY, ["decision_tree", "naive_bayes", "logistic_regression"], FEATURES, "kind", ["voting", "weighted"], "classification")
    return out.select("kind", "model", (F.col("accuracy") > 0.7).alias("fits"))
