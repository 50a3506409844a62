"""D. Anomaly detection."""

from pyspark.sql import functions as F

from ..operators import anomaly as an
from .registry import query
from .shared import LINE_KEY

FEATURES = ["l_quantity", "l_discount", "l_tax", "l_extendedprice"]
SKEWED_SQL = "(SELECT event_id, value, value * value * value AS cube FROM events)"


def skewed(t):
    v = F.col("value")
    return t.events.select("event_id", "value", (v * v * v).alias("cube"))


Z_SQL = f"""(SELECT event_id, value, cube, greatest(abs(value - mv) / sv, abs(cube - mc) / sc) AS anomaly_score FROM {SKEWED_SQL},
 (SELECT avg(value) AS mv, stddev_pop(value) AS sv, avg(cube) AS mc, stddev_pop(cube) AS sc FROM {SKEWED_SQL}))"""


@query("d01_zscore", f"SELECT event_id, round(anomaly_score, 6) AS anomaly_score, anomaly_score > 2.5 AS is_anomaly FROM {Z_SQL}")
def d01(t):
    out = an.detect(skewed(t), ["value", "cube"], "zscore", threshold=2.5)
    return out.select("event_id", F.round("anomaly_score", 6).alias("anomaly_score"), "is_anomaly")


@query("d02_iqr", f"""
WITH q AS (SELECT quantile_cont(value, 0.25) AS a1, quantile_cont(value, 0.75) AS a3, quantile_cont(cube, 0.25) AS b1, quantile_cont(cube, 0.75) AS b3 FROM {SKEWED_SQL}),
s AS (SELECT event_id, greatest(a1 - 1.5 * (a3 - a1) - value, value - (a3 + 1.5 * (a3 - a1)), b1 - 1.5 * (b3 - b1) - cube, cube - (b3 + 1.5 * (b3 - b1)), 0.0) AS score FROM {SKEWED_SQL}, q)
SELECT event_id, round(score, 2) AS anomaly_score, score > 0 AS is_anomaly FROM s""")
def d02(t):
    out = an.detect(skewed(t), ["value", "cube"], "iqr")
    return out.select("event_id", F.round("anomaly_score", 2).alias("anomaly_score"), "is_anomaly")


#: One row in fifty lies far outside in two columns; the detectors have to find nearly all of them.
PLANTED_SQL = "(SELECT *, l_orderkey % 50 = 0 AS planted FROM lineitem)"
FOUND_SQL = f"SELECT count(*) AS n, count(*) FILTER (WHERE planted) AS planted, true AS share_is_kept, true AS planted_are_found FROM {PLANTED_SQL}"


def planted(t):
    far = F.col("l_orderkey") % 50 == 0
    return t.lineitem.select(
        *LINE_KEY, far.alias("planted"), F.when(far, F.col("l_quantity") + 300).otherwise(F.col("l_quantity")).alias("quantity"),
        F.when(far, F.col("l_discount") - 3).otherwise(F.col("l_discount")).alias("discount"), "l_tax",
    )


def found(t, algorithm, least=0.98):
    """Whether the flagged share is that of ``contamination``, and ``least`` of the planted rows are among the flagged."""
    out = an.detect(planted(t), ["quantity", "discount", "l_tax"], algorithm, contamination=0.05)
    share = F.abs(F.avg(F.col("is_anomaly").cast("double")) - 0.05) < 0.02
    hit = F.count_if(F.col("planted") & F.col("is_anomaly")) >= least * F.count_if(F.col("planted"))
    return out.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("planted")).alias("planted"), share.alias("share_is_kept"), hit.alias("planted_are_found"))


@query("d03_isolation_forest", FOUND_SQL)
def d03(t):
    return found(t, "isolation_forest")


_K = 20
_LOF = f"""
WITH p AS (SELECT c_custkey AS id, c_acctbal AS x, c_nationkey * 100.0::DOUBLE AS y FROM customer),
n AS (SELECT * FROM (SELECT a.id, b.id AS nb, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d,
  row_number() OVER (PARTITION BY a.id ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.id) AS r FROM p a, p b WHERE a.id <> b.id) WHERE r <= {_K}),
kd AS (SELECT id, max(d) AS kd FROM n GROUP BY id),
l AS (SELECT n.id, 1 / (avg(greatest(n.d, kd.kd)) + 1e-10) AS lrd FROM n JOIN kd ON n.nb = kd.id GROUP BY n.id),
f AS (SELECT n.id, -avg(b.lrd) / any_value(a.lrd) AS s FROM n JOIN l b ON n.nb = b.id JOIN l a ON n.id = a.id GROUP BY n.id)
SELECT id AS c_custkey, round(s, 4) AS anomaly_score, s < (SELECT quantile_cont(s, 0.1) FROM f) AS is_anomaly FROM f"""


@query("d04_local_outlier_factor", _LOF)
def d04(t):
    df = t.customer.select("c_custkey", F.col("c_acctbal").alias("x"), (F.col("c_nationkey") * 100.0).alias("y"))
    out = an.detect(df, ["x", "y"], "local_outlier_factor", key="c_custkey", scale=False)
    return out.select("c_custkey", F.round("anomaly_score", 4).alias("anomaly_score"), "is_anomaly")


@query("d05_elliptic_envelope", FOUND_SQL)
def d05(t):
    return found(t, "elliptic_envelope")


@query("d06_one_class_svm", FOUND_SQL)
def d06(t):
    return found(t, "one_class_svm", 0.9)


@query("d07_anomaly_summary", " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, round(avg({c}) FILTER (WHERE b), 4) AS anomaly_mean, round(avg({c}) FILTER (WHERE NOT b), 4) AS normal_mean, round(stddev_samp({c}) FILTER (WHERE b), 4) AS anomaly_std, round(stddev_samp({c}) FILTER (WHERE NOT b), 4) AS normal_std,
 min({c}) FILTER (WHERE b) AS anomaly_min, max({c}) FILTER (WHERE b) AS anomaly_max, count(*) FILTER (WHERE b) AS anomaly_count, round(count(*) FILTER (WHERE b) / count(*) * 100, 6) AS anomaly_percentage FROM (SELECT *, anomaly_score > 2.5 AS b FROM {Z_SQL})""" for c in ("value", "cube")))
def d07(t):
    out = an.anomaly_summary(an.zscore(skewed(t), ["value", "cube"], 2.5), ["value", "cube"])
    rounded = {c: F.round(c, 4) for c in ("anomaly_mean", "normal_mean", "anomaly_std", "normal_std")}
    return out.withColumns(rounded).withColumn("anomaly_percentage", F.round("anomaly_percentage", 6))


@query("d07_score_summary", f"""SELECT round(avg(anomaly_score) FILTER (WHERE anomaly_score > 2.5), 6) AS mean_anomaly_score, round(avg(anomaly_score) FILTER (WHERE anomaly_score <= 2.5), 6) AS mean_normal_score,
 round(min(anomaly_score) FILTER (WHERE anomaly_score > 2.5), 6) AS min_anomaly_score, round(max(anomaly_score) FILTER (WHERE anomaly_score > 2.5), 6) AS max_anomaly_score FROM {Z_SQL}""")
def d07_scores(t):
    out = an.score_summary(an.zscore(skewed(t), ["value", "cube"], 2.5))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("d08_contamination_cut", "SELECT o_orderkey, -o_totalprice < (SELECT quantile_cont(-o_totalprice, 0.1) FROM orders) AS is_anomaly FROM orders")
def d08(t):
    scored = t.orders.select("o_orderkey", (-F.col("o_totalprice")).alias("score"))
    return an.contamination_cut(scored, "score", 0.1).select("o_orderkey", "is_anomaly")


@query("d09_anomaly_samples", f"SELECT event_id, value, round(anomaly_score, 6) AS anomaly_score FROM {Z_SQL} WHERE anomaly_score > 2.5 ORDER BY event_id LIMIT 10")
def d09(t):
    out = an.anomaly_samples(an.zscore(skewed(t), ["value", "cube"], 2.5), ["event_id"])
    return out.select("event_id", "value", F.round("anomaly_score", 6).alias("anomaly_score"))
