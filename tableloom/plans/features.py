"""C. Missing values, encoding and feature engineering."""

from pyspark.sql import Window, functions as F

from ..operators import features as fe
from ..operators import impute as im
from ..operators.stats import exact_quantiles
from .registry import query
from .shared import LINE_KEY

NUMBERS = ["l_quantity", "l_discount", "l_tax"]
GAPS_SQL = "(SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, nullif(l_quantity, 10) AS l_quantity, nullif(l_discount, 0) AS l_discount, l_extendedprice FROM lineitem)"


def gaps(t):
    return t.lineitem.select(
        *LINE_KEY, F.nullif(F.col("l_quantity"), F.lit(10.0)).alias("l_quantity"),
        F.nullif(F.col("l_discount"), F.lit(0.0)).alias("l_discount"), "l_extendedprice",
    )


def rounded(df, keep, columns, places=4):
    return df.select(*keep, *[F.round(F.col(f"`{c}`"), places).alias(c) for c in columns])


@query("c01_median_fill", f"SELECT l_orderkey, l_linenumber, coalesce(l_quantity, (SELECT median(l_quantity) FROM {GAPS_SQL})) AS l_quantity, coalesce(l_discount, (SELECT median(l_discount) FROM {GAPS_SQL})) AS l_discount FROM {GAPS_SQL}")
def c01(t):
    return im.fill_median(gaps(t), ["l_quantity", "l_discount"]).select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")


@query("c02_mode_fill", """
WITH d AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS p, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderstatus END AS s FROM orders)
SELECT o_orderkey, coalesce(p, (SELECT p FROM d WHERE p IS NOT NULL GROUP BY p ORDER BY count(*) DESC, p LIMIT 1)) AS p, coalesce(s, (SELECT s FROM d WHERE s IS NOT NULL GROUP BY s ORDER BY count(*) DESC, s LIMIT 1)) AS s FROM d""")
def c02(t):
    k = F.col("o_orderkey")
    df = t.orders.select(
        k, F.when(k % 3 != 0, F.col("o_orderpriority")).alias("p"), F.when(k % 4 != 0, F.col("o_orderstatus")).alias("s")
    )
    return im.fill_mode(df, ["p", "s"])


@query("c03_target_fill", "SELECT event_id, coalesce(v, (SELECT median(CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END) FROM events)) AS target FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS v FROM events)")
def c03(t):
    df = t.events.select("event_id", F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("target"))
    return im.fill_median(df, ["target"])


@query("c04_label_codes", "SELECT p_partkey, p_name, dense_rank() OVER (ORDER BY p_name) - 1 AS p_name_code FROM part")
def c04(t):
    return im.label_encode(t.part.select("p_partkey", "p_name"), "p_name")


@query("c05_target_classes", "SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS code, o_orderpriority FROM orders")
def c05(t):
    """Class codes, and the class values brought back from the codes."""
    classes = im.category_codes(t.orders, "o_orderpriority")
    coded = im.label_encode(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderpriority", "code")
    return im.label_decode(coded.drop("o_orderpriority"), "code", classes, "o_orderpriority")


@query("c06_one_hot", """
SELECT o_orderkey, CASE WHEN s = 'O' THEN 1 ELSE 0 END AS s_O, CASE WHEN s = 'P' THEN 1 ELSE 0 END AS s_P FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderstatus END AS s FROM orders)""")
def c06(t):
    df = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderstatus")).alias("s"))
    out, new = fe.add_dummies(df, ["s"])
    return out.select("o_orderkey", *new)


@query("c06_one_hot_long", "SELECT p_partkey, 'p_name_' || p_name AS feature, 1 AS value FROM part WHERE p_name <> (SELECT min(p_name) FROM part)")
def c06_long(t):
    return fe.long_dummies(t.part, ["p_partkey"], "p_name")


@query("c07_polynomials", """
SELECT l_orderkey, l_linenumber, round(l_quantity * l_quantity, 6) AS "l_quantity^2", round(l_quantity * l_discount, 6) AS "l_quantity l_discount", round(l_quantity * l_tax, 6) AS "l_quantity l_tax",
 round(l_discount * l_discount, 6) AS "l_discount^2", round(l_discount * l_tax, 6) AS "l_discount l_tax", round(l_tax * l_tax, 6) AS "l_tax^2" FROM lineitem""")
def c07(t):
    out, new = fe.add_polynomials(t.lineitem, NUMBERS)
    return rounded(out, ["l_orderkey", "l_linenumber"], new, 6)


@query("c08_interactions", "SELECT l_orderkey, l_linenumber, round(l_quantity * l_discount, 6) AS l_quantity_x_l_discount, round(l_quantity * l_tax, 6) AS l_quantity_x_l_tax, round(l_discount * l_tax, 6) AS l_discount_x_l_tax FROM lineitem")
def c08(t):
    out, new = fe.add_interactions(t.lineitem, NUMBERS)
    return rounded(out, ["l_orderkey", "l_linenumber"], new, 6)


@query("c09_logs", "SELECT l_orderkey, l_linenumber, round(ln(l_quantity), 8) AS l_quantity_log, round(ln(1 + l_discount), 8) AS l_discount_log1p FROM (SELECT *, l_tax - 1 AS neg FROM lineitem)")
def c09(t):
    out, new = fe.add_logs(t.lineitem.withColumn("neg", F.col("l_tax") - 1), ["l_quantity", "l_discount", "neg"])
    return rounded(out, ["l_orderkey", "l_linenumber"], new, 8)


@query("c10_square_roots", "SELECT l_orderkey, l_linenumber, round(sqrt(l_quantity), 8) AS l_quantity_sqrt, round(sqrt(l_discount), 8) AS l_discount_sqrt FROM lineitem")
def c10(t):
    out, new = fe.add_square_roots(t.lineitem.withColumn("neg", F.col("l_tax") - 1), ["l_quantity", "l_discount", "neg"])
    return rounded(out, ["l_orderkey", "l_linenumber"], new, 8)


@query("c11_minmax", """
SELECT l_orderkey, l_linenumber, round((l_quantity - (SELECT min(l_quantity) FROM lineitem)) / (SELECT max(l_quantity) - min(l_quantity) FROM lineitem), 6) AS l_quantity_minmax,
 round((l_extendedprice - (SELECT min(l_extendedprice) FROM lineitem)) / (SELECT max(l_extendedprice) - min(l_extendedprice) FROM lineitem), 6) AS l_extendedprice_minmax, 0.0::DOUBLE AS one_minmax FROM lineitem""")
def c11(t):
    out, new = fe.add_scaled(t.lineitem.withColumn("one", F.lit(1.0)), ["l_quantity", "l_extendedprice", "one"], "minmax")
    return rounded(out, ["l_orderkey", "l_linenumber"], new, 6)


@query("c12_standard", """
SELECT l_orderkey, l_linenumber, round((l_quantity - (SELECT avg(l_quantity) FROM lineitem)) / (SELECT stddev_pop(l_quantity) FROM lineitem), 6) AS l_quantity_standard,
 round((l_extendedprice - (SELECT avg(l_extendedprice) FROM lineitem)) / (SELECT stddev_pop(l_extendedprice) FROM lineitem), 6) AS l_extendedprice_standard FROM lineitem""")
def c12(t):
    out, new = fe.add_scaled(t.lineitem, ["l_quantity", "l_extendedprice"], "standard")
    return rounded(out, ["l_orderkey", "l_linenumber"], new, 6)


@query("c13_uniform_bins", """
WITH s AS (SELECT min(l_quantity) AS a, max(l_quantity) AS b, min(l_extendedprice) AS c, max(l_extendedprice) AS d FROM lineitem)
SELECT l_orderkey, l_linenumber, least(floor((l_quantity - a) * 5 / (b - a)), 4) AS l_quantity_binned, least(floor((l_extendedprice - c) * 5 / (d - c)), 4) AS l_extendedprice_binned FROM lineitem, s""")
def c13(t):
    out, new = fe.add_bins(t.lineitem, ["l_quantity", "l_extendedprice"])
    return out.select("l_orderkey", "l_linenumber", *new)


@query("c13_quantile_bins", """
WITH q AS (SELECT quantile_cont(l_extendedprice, [0.2, 0.4, 0.6, 0.8]) AS e FROM lineitem)
SELECT l_orderkey, l_linenumber, CAST(len(list_filter(e, lambda x: l_extendedprice >= x)) AS DOUBLE) AS l_extendedprice_binned FROM lineitem, q""")
def c13_quantile(t):
    out, new = fe.add_bins(t.lineitem, ["l_extendedprice"], strategy="quantile")
    return out.select("l_orderkey", "l_linenumber", *new)


@query("c13_kmeans_bins", "SELECT count(*) AS n, true AS ordered, true AS near_their_means FROM lineitem")
def c13_kmeans(t):
    """Bins that do not overlap and ascend with the value, and whose means are centres: every value is nearest to its own bin's."""
    out, [new] = fe.add_bins(t.lineitem, ["l_extendedprice"], strategy="kmeans")
    bins = out.groupBy(new).agg(F.count(F.lit(1)).alias("n"), F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"), F.avg("l_extendedprice").alias("mean"))
    after = Window.orderBy(new)  # a row per bin
    step = bins.select("n", "high", "mean", F.lead("low").over(after).alias("next_low"), F.lead("mean").over(after).alias("next_mean"))
    middle, width = (F.col("mean") + F.col("next_mean")) / 2, F.col("next_mean") - F.col("mean")
    near = (F.col("high") <= middle + 0.05 * width) & (F.col("next_low") >= middle - 0.05 * width)
    return step.agg(F.sum("n").alias("n"), F.coalesce(F.min(F.col("high") < F.col("next_low")), F.lit(True)).alias("ordered"), F.coalesce(F.min(near), F.lit(True)).alias("near_their_means"))


@query("c14_rolling_per_key", """
SELECT event_id, round(CASE WHEN count(value) OVER w = 5 THEN avg(value) OVER w ELSE value END, 4) AS value_rolling_mean,
 round(CASE WHEN count(value) OVER w = 5 THEN stddev_samp(value) OVER w ELSE 0 END, 4) AS value_rolling_std FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def c14(t):
    out, new = fe.add_rolling(t.events, ["value"], ["ts", "event_id"], ["user_id"])
    return rounded(out, ["event_id"], new)


@query("c15_varying", "SELECT l_orderkey, l_quantity FROM lineitem WHERE (SELECT var_pop(l_quantity) FROM lineitem) > 0.01 AND (SELECT var_pop(l_tax) FROM lineitem) <= 0.01")
def c15(t):
    return t.lineitem.select("l_orderkey", *fe.keep_varying(t.lineitem, ["l_quantity", "l_discount", "l_tax"]))


@query("c16_regression_scores", " UNION ALL ".join(f"SELECT '{c}' AS feature, round(corr({c}, l_extendedprice) ** 2 / (1 - corr({c}, l_extendedprice) ** 2) * (count(*) - 2), 3) AS f_score FROM lineitem" for c in NUMBERS))
def c16(t):
    out = fe.univariate_scores(t.lineitem, NUMBERS, "l_extendedprice", continuous=True)
    return out.select("feature", F.round("f_score", 3).alias("f_score"))


@query("c16_class_scores", " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, round((sum(n * (m - g) * (m - g)) / (count(*) - 1)) / (sum(n * s2) / (sum(n) - count(*))), 3) AS f_score
 FROM (SELECT l_returnflag, count(*) AS n, avg({c}) AS m, var_pop({c}) AS s2 FROM lineitem GROUP BY l_returnflag), (SELECT avg({c}) AS g FROM lineitem)""" for c in NUMBERS))
def c16_class(t):
    out = fe.univariate_scores(t.lineitem, NUMBERS, "l_returnflag", continuous=False)
    return out.select("feature", F.round("f_score", 3).alias("f_score"))


@query("c17_components", "SELECT count(*) AS n, true AS uncorrelated, true AS falling FROM lineitem")
def c17(t):
    """Three components of all rows that do not correlate, with falling variance."""
    out, new = fe.add_components(t.lineitem, [*NUMBERS, "l_extendedprice"], 3)
    pairs = [F.abs(F.corr(a, b)) < 1e-6 for a, b in ((new[0], new[1]), (new[0], new[2]), (new[1], new[2]))]
    falling = (F.var_pop(new[0]) >= F.var_pop(new[1])) & (F.var_pop(new[1]) >= F.var_pop(new[2]))
    return out.agg(F.count(F.lit(1)).alias("n"), (pairs[0] & pairs[1] & pairs[2]).alias("uncorrelated"), falling.alias("falling"))


@query("c18_target_encoding", """
SELECT p_partkey, p_brand, round((s + g * 10) / (n + 10), 4) AS p_brand_target FROM part JOIN (SELECT p_brand AS b, sum(p_retailprice) AS s, count(*) AS n FROM part GROUP BY p_brand) ON p_brand = b, (SELECT avg(p_retailprice) AS g FROM part)""")
def c18(t):
    out = fe.target_encode(t.part.select("p_partkey", "p_brand", "p_retailprice"), "p_brand", "p_retailprice", 10)
    return rounded(out, ["p_partkey", "p_brand"], ["p_brand_target"])


@query("c19_feature_summary", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, min({c}) AS min, max({c}) AS max, count(*) - count({c}) AS missing_count FROM {GAPS_SQL}" for c in ("l_quantity", "l_discount")))
def c19(t):
    out = fe.feature_summary(gaps(t), ["l_quantity", "l_discount"])
    return out.withColumns({c: F.round(c, 4) for c in ("mean", "std")})


@query("c20_pipeline", f"""
WITH f AS (SELECT median(l_quantity) AS mq, median(l_discount) AS md, min(l_quantity) AS nq, max(l_quantity) - min(l_quantity) AS wq, min(l_discount) AS nd, max(l_discount) - min(l_discount) AS wd,
  median(l_quantity * l_discount) AS mx, median(sqrt(l_quantity)) AS sq, median(sqrt(l_discount)) AS sd, median((l_quantity - (SELECT min(l_quantity) FROM {GAPS_SQL})) / (SELECT max(l_quantity) - min(l_quantity) FROM {GAPS_SQL})) AS zq,
  median((l_discount - (SELECT min(l_discount) FROM {GAPS_SQL})) / (SELECT max(l_discount) - min(l_discount) FROM {GAPS_SQL})) AS zd FROM {GAPS_SQL})
SELECT l_orderkey, l_linenumber, coalesce(l_quantity, mq) AS l_quantity, coalesce(l_discount, md) AS l_discount, round(coalesce(l_quantity * l_discount, mx), 6) AS l_quantity_x_l_discount,
 round(coalesce(sqrt(l_quantity), sq), 6) AS l_quantity_sqrt, round(coalesce(sqrt(l_discount), sd), 6) AS l_discount_sqrt, round(coalesce((l_quantity - nq) / wq, zq), 6) AS l_quantity_minmax, round(coalesce((l_discount - nd) / wd, zd), 6) AS l_discount_minmax
FROM {GAPS_SQL}, f""")
def c20(t):
    done = fe.engineer(
        gaps(t), ["l_quantity", "l_discount"],
        ["interaction_features", "sqrt_transform", "no_such_step", "normalization", "feature_selection"],
    )
    return rounded(done.frame, ["l_orderkey", "l_linenumber"], done.features, 6)


@query("c21_step_report", """SELECT 0 AS step, 'interaction_features' AS method, ['l_quantity_x_l_discount'] AS new_features, 1::BIGINT AS feature_count, false AS failed FROM (SELECT count(*) FROM lineitem)
 UNION ALL SELECT 1, 'log_transform', ['l_quantity_log', 'l_discount_log'], 2::BIGINT, false UNION ALL SELECT 2, 'no_such_step', []::VARCHAR[], 0::BIGINT, true""")
def c21(t):
    done = fe.engineer(gaps(t), ["l_quantity", "l_discount"], ["interaction_features", "log_transform", "no_such_step"])
    return done.report().select("step", "method", "new_features", "feature_count", F.col("error").isNotNull().alias("failed"))


@query("c22_lineage", """SELECT o_orderkey, ['fill_median', 'log_transform'] AS operations, ['o_totalprice', 'o_totalprice'] AS columns, o_orderdate AS first_at FROM orders""")
def c22(t):
    df = fe.with_lineage(t.orders, "fill_median", {"column": "o_totalprice"}, F.col("o_orderdate"))
    df = fe.with_lineage(df, "log_transform", {"column": "o_totalprice"}, F.col("o_orderdate"))
    steps = F.col("preprocessing_applied")
    return df.select(
        "o_orderkey", steps["operation"].alias("operations"), F.transform(steps, lambda s: s["parameters"]["column"]).alias("columns"),
        steps[0]["timestamp"].alias("first_at"),
    )


@query("c01_quantiles_exact", "SELECT round(quantile_cont(l_extendedprice, 0.05), 4) AS q05, round(quantile_cont(l_extendedprice, 0.5), 4) AS q50, round(quantile_cont(l_extendedprice, 0.99), 4) AS q99 FROM lineitem")
def c01_quantiles(t):
    """Exact quantiles by bracket narrowing, the form used beyond one task's memory."""
    q = exact_quantiles(t.lineitem, {"l_extendedprice": [0.05, 0.5, 0.99]}, small_rows=500, accuracy=200)["l_extendedprice"]
    return t.lineitem.agg(*[F.round(F.max(F.lit(v)), 4).alias(n) for v, n in zip(q, ("q05", "q50", "q99"))])
