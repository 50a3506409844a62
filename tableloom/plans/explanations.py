"""J. Explainability."""

from pyspark.sql import Window, functions as F

from ..operators import explain as ex
from ..operators import models as m
from ..operators.linear import linear_fit
from ..session import cut_lineage
from .models import FEATURES, TARGET
from .registry import query
from .shared import with_signal

_LIN = """WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, avg(l_quantity) AS mx FROM lineitem), c AS (SELECT l_orderkey, l_linenumber, 'l_quantity' AS feature, l_quantity AS value, (l_quantity - mx) * b AS contribution FROM lineitem, f)
"""


def linear(t):
    fit = linear_fit(t.lineitem, ["l_quantity"], TARGET)
    return ex.linear_shapley(t.lineitem, fit, ["l_orderkey", "l_linenumber"])


#: What the columns add to the target's spread decides their place.
_PLACES_SQL = "SELECT feature, place, n, true AS adds_up FROM (VALUES ('l_quantity', 1), ('l_discount', 2), ('l_tax', 3)) v(feature, place), (SELECT count(*) AS n FROM lineitem)"


def tree(t):
    return m.fit_model(with_signal(t), "random_forest", FEATURES, "signal")


def gap_to_prediction(rows, model, contributions, base, key):
    """The largest gap between a row's prediction and its contributions and the base together."""
    total = contributions.groupBy(*key).agg(F.sum("contribution").alias("_s"))
    return model.transform(rows).join(total, key).agg(F.max(F.abs(F.col("prediction") - F.col("_s") - base)).alias("g")).first()["g"]


def places(importances):
    return importances.withColumn("place", F.row_number().over(Window.orderBy(F.desc("importance"))).cast("int"))  # a row per feature


@query("j01_tree_shapley", _PLACES_SQL)
def j01(t):
    """Contributions of all rows to a forest of a hundred trees: they add up, and rank the columns."""
    rows, model = with_signal(t), tree(t)
    found, base = ex.tree_shapley(rows, model, FEATURES, ["row_key"])
    found = cut_lineage(found)
    gap = gap_to_prediction(rows, model, found, base, ["row_key"])
    ranked = places(found.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs("contribution")).alias("importance")))
    return ranked.select("feature", "place", "n", F.lit(gap < 1e-6).alias("adds_up"))


@query("j02_linear_shapley", _LIN + "SELECT l_orderkey, l_linenumber, feature, value, round(contribution, 4) AS contribution FROM c")
def j02(t):
    return linear(t)[0].withColumn("contribution", F.round("contribution", 4))


@query("j02_sampled_shapley", "SELECT count(*) AS n, 2 * count(*) AS shares, true AS adds_up FROM customer")
def j02_sampled(t):
    """Shares by sampled orders for every row and column; they add up to the prediction."""
    df = t.customer.select("c_custkey", F.col("c_nationkey").cast("double").alias("n"), "c_acctbal", (F.col("c_custkey") % 7).cast("double").alias("target"))
    model = m.fit_model(df, "decision_tree", ["n", "c_acctbal"], "target")
    rows, base = ex.sampled_shapley(df, model, ["n", "c_acctbal"], ["c_custkey"])
    rows = cut_lineage(rows)
    gap = gap_to_prediction(df, model, rows, base, ["c_custkey"])
    return rows.agg(F.countDistinct("c_custkey").alias("n"), F.count(F.lit(1)).alias("shares"), F.lit(gap < 1e-6).alias("adds_up"))


@query("j02_kernel_shapley", """
WITH p AS (SELECT c_custkey, c_nationkey::DOUBLE AS n, c_acctbal AS b FROM customer)
SELECT c_custkey, 'n' AS feature, round(300 * (n - (SELECT avg(n) FROM p)), 4) AS contribution FROM p
UNION ALL SELECT c_custkey, 'b', round(-2 * (b - (SELECT avg(b) FROM p)), 4) FROM p""")
def j02_kernel(t):
    """Shares of a linear function by coalitions; less their means, which follow the background rows, they are weight times deviation."""
    df = t.customer.select("c_custkey", F.col("c_nationkey").cast("double").alias("n"), F.col("c_acctbal").alias("b"))
    model = ex.callback_model(lambda x: 300 * x[:, 0] - 2 * x[:, 1], ["n", "b"])
    rows, _ = ex.kernel_shapley(df, model, ["n", "b"], ["c_custkey"])
    means = rows.groupBy(F.col("feature").alias("_f")).agg(F.avg("contribution").alias("_m"))
    centred = rows.join(F.broadcast(means), F.col("feature") == F.col("_f"))  # a row per feature
    return centred.select("c_custkey", "feature", F.round(F.col("contribution") - F.col("_m"), 4).alias("contribution"))


@query("j03_global_importance", _LIN + "SELECT feature, round(avg(abs(contribution)), 4) AS importance FROM c GROUP BY feature")
def j03(t):
    return ex.global_importance(linear(t)[0]).select("feature", F.round("importance", 4).alias("importance"))


@query("j04_first_explanations", """
WITH f AS (SELECT regr_slope(c_custkey, c_acctbal) AS b, avg(c_acctbal) AS mx FROM customer)
SELECT c_custkey, 'c_acctbal' AS feature, round((c_acctbal - mx) * b, 5) AS contribution, 1::BIGINT AS rank FROM customer, f ORDER BY c_custkey LIMIT 10""")
def j04(t):
    fit = linear_fit(t.customer, ["c_acctbal"], "c_custkey")
    rows, _ = ex.linear_shapley(t.customer, fit, ["c_custkey"])
    return ex.first_explanations(rows, ["c_custkey"]).select("c_custkey", "feature", F.round("contribution", 5).alias("contribution"), "rank")


@query("j05_local_surrogate", "SELECT feature, true AS rises FROM (VALUES ('l_quantity'), ('l_discount'), ('l_tax')) v(feature)")
def j05(t):
    """Around a row in the middle the target rises with every column."""
    row = (F.col("l_quantity") == 25) & (F.col("row_key") == with_signal(t).where("l_quantity = 25").agg(F.min("row_key")).scalar())
    found = ex.local_surrogate(with_signal(t), tree(t), FEATURES, row)
    return found.select("feature", (F.col("weight") > 0).alias("rises"))


@query("j06_permutation_importance", "SELECT feature, place FROM (VALUES ('l_quantity', 1), ('l_discount', 2), ('l_tax', 3)) v(feature, place)")
def j06(t):
    rows = with_signal(t)
    model = m.fit_model(rows, "decision_tree", FEATURES, "signal", max_depth=8)
    return places(ex.permutation_importance(rows, model, FEATURES, ["row_key"])).select("feature", "place")


_CORR = " UNION ALL ".join(f"SELECT '{c}' AS feature, abs(corr({c}, l_extendedprice)) AS r, stddev_pop({c}) AS s FROM lineitem" for c in FEATURES)


@query("j07_importance_comparison", f"WITH c AS ({_CORR}) SELECT 'correlation' AS method, feature, round(r / (SELECT sum(r) FROM c), 6) AS share FROM c UNION ALL SELECT 'spread', feature, round(s / (SELECT sum(s) FROM c), 6) FROM c")
def j07(t):
    from ..operators.profile import filter_importance

    spread = t.lineitem.agg(*[F.struct(F.lit(c).alias("feature"), F.stddev_pop(c).alias("importance")).alias(c) for c in FEATURES])
    spread = spread.select(F.explode(F.array(*FEATURES)).alias("e")).select("e.*")
    out = ex.compared({"correlation": filter_importance(t.lineitem, FEATURES, TARGET), "spread": spread})
    return out.withColumn("share", F.round("share", 6))


@query("j08_background_sample", "SELECT 50::BIGINT AS n, 50::BIGINT AS keys, true AS same_again")
def j08(t):
    """Fifty different rows, the same ones again."""
    sample, again = (ex.background(t.orders, ["o_orderkey"], 50).select("o_orderkey") for _ in range(2))
    repeated = sample.join(again, "o_orderkey", "left_semi").count()
    return sample.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_orderkey").alias("keys"), F.lit(repeated == 50).alias("same_again"))
