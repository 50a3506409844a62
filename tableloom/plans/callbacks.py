"""W. Callbacks: algorithms, models, validators and metrics added by name."""

from pyspark.sql import functions as F

from ..functions import metrics as me
from ..functions import rules as r
from ..operators import anomaly as an
from ..operators import explain as ex
from ..operators import features as fe
from .registry import query


@query("w01_custom_step", "SELECT o_orderkey, o_totalprice, o_totalprice * o_totalprice * o_totalprice / 1e9 AS o_totalprice_cubed FROM orders")
def w01(t):
    """A feature step and a detector registered by name, used through their pipelines."""

    def cubes(df, features, params):
        new = {f"{c}_cubed": F.col(c) * F.col(c) * F.col(c) / 1e9 for c in features}
        return df.withColumns(new), list(new)

    fe.register_step("cubes", cubes)
    out = fe.engineer(t.orders.select("o_orderkey", "o_totalprice"), ["o_totalprice"], ["cubes"])
    return out.frame.select("o_orderkey", "o_totalprice", "o_totalprice_cubed")


@query("w01_custom_detector", "SELECT o_orderkey, o_totalprice > 450000 AS is_anomaly FROM orders")
def w01_detector(t):
    an.register_detector(
        "above", lambda df, features, bound: df.withColumns({"anomaly_score": F.col(features[0]), "is_anomaly": F.col(features[0]) > bound})
    )
    return an.detect(t.orders, ["o_totalprice"], "above", bound=450000).select("o_orderkey", "is_anomaly")


@query("w02_model_callback", """
WITH m AS (SELECT avg(c_acctbal) AS a, avg(c_nationkey) AS b FROM customer)
SELECT c_custkey, 3 * c_acctbal - 5.0::DOUBLE * c_nationkey AS prediction FROM customer""")
def w02(t):
    model = ex.callback_model(lambda x: 3 * x[:, 0] - 5 * x[:, 1], ["c_acctbal", "c_nationkey"])
    return model.transform(t.customer).select("c_custkey", "prediction")


@query("w03_item_validator", "SELECT vec_id, len(list_filter(embedding, lambda x: x > 0.3)) = 0 AS valid FROM embeddings")
def w03(t):
    small = lambda x: x.cast("double") <= 0.3
    return t.embeddings.select("vec_id", r.array(item=small)(F.col("embedding"), "embedding").isNull().alias("valid"))


@query("w04_custom_metric", "SELECT l_returnflag, 'bias' AS metric, round(avg(p - y), 4) AS score FROM (SELECT l_returnflag, l_extendedprice AS y, l_extendedprice * 0.9271 + l_quantity * 97.3 AS p FROM lineitem) GROUP BY l_returnflag")
def w04(t):
    from .models import predicted

    me.register_scorer("bias", lambda y, p: F.avg(F.col(p) - F.col(y)))
    return me.score(predicted(t), ["bias"], "y", "p", ["l_returnflag"]).withColumn("score", F.round("score", 4))
