"""I. Scoring and uncertainty."""

from pyspark.sql import functions as F

from ..functions.metrics import regression_metrics
from ..operators import models as m
from ..operators import scoring as sc
from ..operators.linear import linear_fit, predict_linear
from ..operators.stats import medians
from .models import FEATURES, TARGET
from .registry import query
from .shared import with_signal

_FIT = "(SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem)"


def scored(t):
    return predict_linear(t.lineitem, linear_fit(t.lineitem, ["l_quantity"], TARGET))


@query("i01_score_rows", f"SELECT o_orderkey, round(a + b * coalesce(q, (SELECT median(l_quantity) FROM lineitem)), 4) AS prediction FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE (o_orderkey % 50)::DOUBLE END AS q FROM orders), {_FIT}")
def i01(t):
    fit = linear_fit(t.lineitem, ["l_quantity"], TARGET)
    rows = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey") % 50).cast("double").alias("l_quantity"))
    filled = sc.fill_from_medians(rows, medians(t.lineitem, ["l_quantity"]))
    return predict_linear(filled, fit).select("o_orderkey", F.round("prediction", 4).alias("prediction"))


_INTERVAL_SQL = "SELECT count(*) AS n, true AS ordered, true AS holds_the_fit FROM lineitem"


@query("i02_bootstrap_interval", _INTERVAL_SQL)
def i02(t):
    """Intervals of all rows from twenty resampled lines: nearly all hold the prediction of the fit to all rows."""
    rows = with_signal(t)
    members = sc.bootstrap_linear(rows, FEATURES, "signal", key=["row_key"])
    out = sc.interval_from_members(predict_linear(rows, linear_fit(rows, FEATURES, "signal")), members)
    return interval_facts(out, "prediction", 0.9)


@query("i02_bootstrap_tree", _INTERVAL_SQL)
def i02_tree(t):
    """The same from resampled trees: the target itself, free of noise, mostly lies inside or near the interval."""
    rows = with_signal(t)
    models = sc.bootstrap_models(rows, lambda d: m.fit_model(d, "decision_tree", FEATURES, "signal"), ["row_key"])
    out = sc.interval_from_models(rows, models)
    return interval_facts(out, "prediction", 0.9)


def interval_facts(rows, held, share):
    inside = F.col(held).between(F.col("lower") - 1e-9, F.col("upper") + 1e-9)
    return rows.agg(
        F.count(F.lit(1)).alias("n"), F.min((F.col("lower") <= F.col("upper")) & (F.col("spread") >= 0)).alias("ordered"),
        (F.avg(inside.cast("double")) >= share).alias("holds_the_fit"),
    )


@query("i03_residual_interval", f"""
WITH p AS (SELECT l_orderkey, l_linenumber, a + b * l_quantity AS prediction, l_extendedprice AS y FROM lineitem, {_FIT}), s AS (SELECT stddev_pop(y - prediction) AS s FROM p)
SELECT l_orderkey, l_linenumber, round(prediction, 3) AS prediction, round(prediction - 2.576 * s, 3) AS lower, round(prediction + 2.576 * s, 3) AS upper FROM p, s""")
def i03(t):
    df = scored(t)
    out = sc.residual_interval(df, sc.residual_std(df, TARGET), 0.99)
    return out.select("l_orderkey", "l_linenumber", *[F.round(c, 3).alias(c) for c in ("prediction", "lower", "upper")])


@query("i04_rule_based_price", """
WITH f AS (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size % 6 END AS bedrooms, p_retailprice AS sqft, (1950 + p_size)::DOUBLE AS year_built, (p_size * 3)::DOUBLE AS crime_rate FROM part),
v AS (SELECT p_partkey, greatest(50000.0, 200000 + coalesce(bedrooms, 3) * 25000.0 + 2 * 15000.0 + coalesce(sqft, 1800) * 150 + greatest(0, year_built - 1980) * 500 + 7 * 8000.0 - crime_rate * 800 + 60 * 300.0) AS p FROM f)
SELECT p_partkey, round(p, 2) AS prediction, round(p * 0.85, 2) AS lower, round(p * 1.15, 2) AS upper FROM v""")
def i04(t):
    s = F.col("p_size")
    rows = t.part.select(
        "p_partkey", F.when(s % 5 != 0, s % 6).alias("bedrooms"), F.col("p_retailprice").alias("sqft"), (1950 + s).alias("year_built"), (s * 3).alias("crime_rate")
    )
    return sc.rule_based_price(rows).select("p_partkey", *[F.round(c, 2).alias(c) for c in ("prediction", "lower", "upper")])


@query("i05_conformal_interval", f"""
WITH p AS (SELECT l_orderkey, l_linenumber, a + b * l_quantity AS prediction, l_extendedprice AS y FROM lineitem, {_FIT}), q AS (SELECT quantile_cont(abs(y - prediction), 0.95) AS q FROM p)
SELECT l_orderkey, l_linenumber, round(prediction - q, 3) AS lower, round(prediction + q, 3) AS upper FROM p, q""")
def i05(t):
    df = scored(t)
    out = sc.conformal_interval(df, df, TARGET, 0.95)
    return out.select("l_orderkey", "l_linenumber", F.round("lower", 3).alias("lower"), F.round("upper", 3).alias("upper"))


@query("i05_bayesian_interval", f"""
WITH s AS (SELECT count(*) AS n, avg(l_quantity) AS mx, var_pop(l_quantity) * count(*) AS sxx FROM lineitem), p AS (SELECT l_orderkey, l_linenumber, l_quantity AS x, a + b * l_quantity AS prediction, l_extendedprice AS y FROM lineitem, {_FIT}),
r AS (SELECT sum((y - prediction) ** 2) / (count(*) - 2) AS s2 FROM p)
SELECT l_orderkey, l_linenumber, round(sqrt(s2 * (1 + 1 / n + (x - mx) ** 2 / sxx)), 3) AS spread, round(prediction - 1.96 * sqrt(s2 * (1 + 1 / n + (x - mx) ** 2 / sxx)), 3) AS lower FROM p, s, r""")
def i05_bayesian(t):
    out = sc.bayesian_interval(t.lineitem, t.lineitem, ["l_quantity"], TARGET)
    return out.select("l_orderkey", "l_linenumber", F.round("spread", 3).alias("spread"), F.round("lower", 3).alias("lower"))


@query("i05_ensemble_interval", _INTERVAL_SQL)
def i05_ensemble(t):
    from ..operators.linear import LinearFit

    ridge = linear_fit(t.lineitem, FEATURES, TARGET, ridge=1000.0)
    members = [linear_fit(t.lineitem, FEATURES[:k], TARGET) for k in (1, 2, 3)] + [ridge]
    out = sc.interval_from_members(predict_linear(t.lineitem, members[2]), members, 1.0)
    return interval_facts(out, "prediction", 1.0)


@query("i06_interval_quality", """
WITH m AS (SELECT l_orderkey, l_linenumber, [l_quantity, l_tax * 100, l_discount * 100, 5.0::DOUBLE] AS m FROM lineitem), s AS (SELECT *, list_avg(m) AS mu FROM m)
SELECT l_orderkey, l_linenumber, round(sqrt(list_avg(list_transform(m, lambda x: (x - mu) * (x - mu)))), 6) AS std_deviation, CASE WHEN mu <> 0 THEN round(sqrt(list_avg(list_transform(m, lambda x: (x - mu) * (x - mu)))) / abs(mu), 6) END AS coefficient_of_variation,
 round(list_median(m), 6) AS q50, round(list_aggregate(m, 'quantile_cont', 0.95), 6) AS q95 FROM s""")
def i06(t):
    members = F.array(F.col("l_quantity"), F.col("l_tax") * 100, F.col("l_discount") * 100, F.lit(5.0))
    out = sc.interval_quality(t.lineitem.withColumn("m", members), "m")
    return out.select(
        "l_orderkey", "l_linenumber", F.round("std_deviation", 6).alias("std_deviation"),
        F.round("coefficient_of_variation", 6).alias("coefficient_of_variation"),
        F.round(F.col("quantiles")["q50"], 6).alias("q50"), F.round(F.col("quantiles")["q95"], 6).alias("q95"),
    )


@query("i07_latest_predictions", "SELECT event_id, ts, value FROM events ORDER BY ts DESC, event_id LIMIT 100")
def i07(t):
    from ..sources.datasets import newest

    return newest(t.events.select("event_id", "ts", "value"), "ts", ["event_id"], limit=250, cap=100)


@query("i08_holdout_performance", """
WITH tr AS (SELECT * FROM lineitem WHERE l_suppkey % 5 <> 0), f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM tr),
p AS (SELECT l_extendedprice AS y, a + b * l_quantity AS p FROM lineitem, f WHERE l_suppkey % 5 = 0)
SELECT round(sqrt(avg((y - p) ** 2)), 4) AS rmse, round(1 - avg((y - p) ** 2) / var_pop(y), 8) AS r2_score, round(avg(abs(y - p)), 4) AS mae FROM p""")
def i08(t):
    train, test = m.split_by_modulo(t.lineitem, F.col("l_suppkey"))
    out = regression_metrics(TARGET, "prediction")
    scored_test = predict_linear(test, linear_fit(train, ["l_quantity"], TARGET))
    return scored_test.agg(F.round(out["rmse"], 4).alias("rmse"), F.round(out["r2"], 8).alias("r2_score"), F.round(out["mae"], 4).alias("mae"))
