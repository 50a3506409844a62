"""K. A/B experiments over events: type = experiment, user parity = arm, day = batch."""

from pyspark.sql import functions as F

from ..operators import experiments as ex
from .registry import query

KEYS = ["experiment", "arm", "batch"]


def recorded(t, classes=False):
    u, e = F.col("user_id"), F.col("event_id")
    actual = (u % 3).cast("double") if classes else F.col("value")
    predicted = e % 7 / 2.5 if classes else F.col("value") * 0.8765432 + e % 21 - u % 2 * 5
    return t.events.select(
        F.col("event_type").alias("experiment"),
        F.when(u % 2 == 1, F.lit("model_b")).otherwise(F.lit("model_a")).alias("arm"),
        F.to_date("ts").alias("batch"),
        actual.alias("actual"),
        predicted.cast("double").alias("predicted"),
    )


RECORDED = """(SELECT event_type AS experiment, CASE WHEN user_id % 2 = 1 THEN 'model_b' ELSE 'model_a' END AS arm, CAST(ts AS DATE) AS batch, value AS actual, value * 0.8765432 + event_id % 21 - user_id % 2 * 5 AS predicted FROM events)"""
BATCHES = f"""(SELECT experiment, arm, batch, count(*) AS sample_size, avg((actual - predicted) ** 2) AS mse, sqrt(avg((actual - predicted) ** 2)) AS rmse, avg(abs(actual - predicted)) AS mae,
 CASE WHEN var_pop(actual) > 0 THEN 1 - avg((actual - predicted) ** 2) / var_pop(actual) ELSE 0 END AS r2 FROM {RECORDED} GROUP BY experiment, arm, batch HAVING count(DISTINCT actual) > 10)"""
LONG = f"(SELECT experiment, arm, 'rmse' AS metric, rmse AS value FROM {BATCHES} UNION ALL SELECT experiment, arm, 'mse', mse FROM {BATCHES} UNION ALL SELECT experiment, arm, 'mae', mae FROM {BATCHES} UNION ALL SELECT experiment, arm, 'r2', r2 FROM {BATCHES})"
STATS = f"(SELECT experiment, arm, metric, avg(value) AS mean, stddev_pop(value) AS std, var_samp(value) AS vs, var_pop(value) AS vp, min(value) AS min, max(value) AS max, count(*) AS samples FROM {LONG} GROUP BY experiment, arm, metric)"
TESTS = f"""(SELECT a.experiment, a.metric, a.mean AS mean_a, b.mean AS mean_b, (a.mean - b.mean) / sqrt(((a.samples - 1) * a.vs + (b.samples - 1) * b.vs) / (a.samples + b.samples - 2) * (1 / a.samples + 1 / b.samples)) AS t_statistic,
 (b.mean - a.mean) / sqrt((a.vp + b.vp) / 2) AS cohens_d, CASE WHEN a.mean <> 0 THEN (b.mean - a.mean) / a.mean * 100 ELSE 0 END AS improvement FROM {STATS} a JOIN {STATS} b ON a.experiment = b.experiment AND a.metric = b.metric AND a.arm = 'model_a' AND b.arm = 'model_b')"""


def tests(t):
    batches = ex.batch_metrics(recorded(t), KEYS, "actual", "predicted")
    return ex.compare_arms(ex.arm_statistics(ex.metric_rows(batches, KEYS).where(F.col("metric").isin(*ex.REGRESSION))))


@query("k01_assign_arm", "SELECT event_id, CASE WHEN event_type = 'error' THEN NULL WHEN (event_id * 7919 % 10000) / 10000 < 0.3 THEN 'model_b' ELSE 'model_a' END AS arm FROM events")
def k01(t):
    share = F.col("event_id") * 7919 % 10000 / 10000
    return t.events.select("event_id", ex.assign_arm(share, 0.3, F.col("event_type") != "error").alias("arm"))


@query("k01_assign_hashed", "SELECT event_type, count(*) AS n, 1::BIGINT AS most_arms_of_a_user, true AS half FROM events GROUP BY event_type")
def k01_hashed(t):
    """Every user keeps one arm within an experiment, and the arms have half of the users each, within four standard errors."""
    share = ex.hashed_share(F.col("user_id"), F.col("event_type"))
    arms = t.events.select("user_id", "event_type", ex.assign_arm(share, 0.5).alias("arm"))
    users = arms.groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("arm").alias("arms"), F.first("arm").alias("arm"))
    return users.groupBy("event_type").agg(
        F.sum("rows").alias("n"), F.max("arms").alias("most_arms_of_a_user"), (F.abs(F.avg((F.col("arm") == "model_b").cast("double")) - 0.5) < 2 / F.sqrt(F.count(F.lit(1)))).alias("half")
    )


@query("k02_batch_metrics", f"""
SELECT experiment, arm, batch, sample_size, round(mse, 4) AS mse, round(rmse, 4) AS rmse, round(mae, 4) AS mae, round(r2, 6) AS r2 FROM {BATCHES}
UNION ALL SELECT experiment, arm, batch, count(*), NULL, NULL, NULL, NULL FROM {RECORDED} GROUP BY experiment, arm, batch HAVING count(DISTINCT actual) <= 10""")
def k02(t):
    out = ex.batch_metrics(recorded(t), KEYS, "actual", "predicted")
    return out.select(*KEYS, "sample_size", *[F.round(m, 4).alias(m) for m in ("mse", "rmse", "mae")], F.round("r2", 6).alias("r2"))


@query("k02_class_metrics", """
WITH r AS (SELECT event_type AS experiment, CASE WHEN user_id % 2 = 1 THEN 'model_b' ELSE 'model_a' END AS arm, CAST(ts AS DATE) AS batch, (user_id % 3)::DOUBLE AS y, round_even(event_id % 7 / 2.5, 0) AS p FROM events),
c AS (SELECT experiment, arm, batch, cls, count(*) FILTER (WHERE y = cls) AS s, count(*) FILTER (WHERE p = cls) AS q, count(*) FILTER (WHERE y = cls AND p = cls) AS h FROM r, (VALUES (0.0), (1.0), (2.0)) v(cls) GROUP BY experiment, arm, batch, cls)
SELECT experiment, arm, batch, CAST(sum(s) AS BIGINT) AS sample_size, round(sum(h) / sum(s), 6) AS accuracy, round(sum(CASE WHEN q > 0 THEN h / q ELSE 0 END * s) / sum(s), 6) AS precision,
 round(sum(h) / sum(s), 6) AS recall, round(sum(CASE WHEN s + q > 0 THEN 2 * h / (s + q) ELSE 0 END * s) / sum(s), 6) AS f1 FROM c GROUP BY experiment, arm, batch""")
def k02_classes(t):
    out = ex.batch_metrics(recorded(t, classes=True), KEYS, "actual", "predicted")
    return out.select(*KEYS, "sample_size", *[F.round(m, 6).alias(m) for m in ex.CLASSES])


@query("k03_arm_statistics", f"SELECT experiment, arm, metric, round(mean, 4) AS mean, round(std, 4) AS std, round(min, 4) AS min, round(max, 4) AS max, samples FROM {STATS}")
def k03(t):
    batches = ex.batch_metrics(recorded(t), KEYS, "actual", "predicted")
    rows = ex.metric_rows(batches, KEYS).where(F.col("metric").isin(*ex.REGRESSION))
    return ex.arm_statistics(rows).select(
        "experiment", "arm", "metric", *[F.round(c, 4).alias(c) for c in ("mean", "std", "min", "max")], "samples"
    )


@query("k04_t_test", f"SELECT experiment, metric, round(t_statistic, 4) AS t_statistic FROM {TESTS}")
def k04(t):
    return tests(t).select("experiment", "metric", F.round("t_statistic", 4).alias("t_statistic"))


@query("k04_p_values", f"SELECT experiment, metric, abs(t_statistic) > 2.001717 AS is_significant, true AS is_a_share FROM {TESTS}")
def k04_p(t):
    """Thirty days per arm: the SQL uses the critical |t| of 58 degrees of freedom."""
    return tests(t).select("experiment", "metric", "is_significant", F.col("p_value").between(0, 1).alias("is_a_share"))


@query("k05_effect_size", f"SELECT experiment, metric, round(cohens_d, 4) AS cohens_d, CASE WHEN abs(cohens_d) < 0.2 THEN 'negligible' WHEN abs(cohens_d) < 0.5 THEN 'small' WHEN abs(cohens_d) < 0.8 THEN 'medium' ELSE 'large' END AS effect_size FROM {TESTS}")
def k05(t):
    return tests(t).select("experiment", "metric", F.round("cohens_d", 4).alias("cohens_d"), "effect_size")


@query("k06_improvement", f"SELECT experiment, metric, round(improvement, 4) AS improvement FROM {TESTS}")
def k06(t):
    return tests(t).select("experiment", "metric", F.round("improvement", 4).alias("improvement"))


_WINNER = f"""(SELECT experiment, improvement, cohens_d, CASE WHEN abs(t_statistic) > 2.001717 THEN CASE WHEN mean_b < mean_a THEN 'model_b' ELSE 'model_a' END END AS winner FROM {TESTS} WHERE metric = 'rmse')"""


@query("k07_winner", f"SELECT experiment, 'rmse' AS primary_metric, winner FROM {_WINNER}")
def k07(t):
    """Thirty days per arm: the SQL uses the critical |t| of 58 degrees of freedom."""
    return ex.winners(tests(t)).select("experiment", "primary_metric", "winner")


@query("k08_recommendation", f"""
SELECT experiment, winner, CASE winner WHEN 'model_b' THEN printf('Model B shows statistically significant improvement (%.2f%% on rmse, %s effect). Recommend deploying Model B.', abs(improvement), effect)
 WHEN 'model_a' THEN printf('Model A (control) performs better (%.2f%% on rmse, %s effect). Recommend keeping Model A.', abs(improvement), effect)
 ELSE 'No statistically significant difference found. Continue monitoring or increase sample size.' END AS recommendation
FROM (SELECT *, CASE WHEN abs(cohens_d) < 0.2 THEN 'negligible' WHEN abs(cohens_d) < 0.5 THEN 'small' WHEN abs(cohens_d) < 0.8 THEN 'medium' ELSE 'large' END AS effect FROM {_WINNER})""")
def k08(t):
    return ex.winners(tests(t)).select("experiment", "winner", "recommendation")


def status_log(t):
    o = F.col("o_orderkey")
    return t.orders.select(
        (F.col("o_custkey") % 40).cast("string").alias("experiment"), F.col("o_orderdate").alias("ts"), o.alias("id"),
        F.when(o % 3 == 0, F.lit("stopped")).otherwise(F.lit("active")).alias("status"),
    )


LOG = "(SELECT CAST(o_custkey % 40 AS VARCHAR) AS experiment, o_orderdate AS ts, o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'stopped' ELSE 'active' END AS status FROM orders)"
LIFE = f"(SELECT experiment, arg_max(status, (ts, id)) AS status, min(CASE WHEN status = 'active' THEN ts END) AS created_at, max(CASE WHEN status = 'stopped' THEN ts END) AS stopped_at FROM {LOG} GROUP BY experiment)"


@query("k09_experiment_list", f"""
SELECT l.experiment, l.status, l.created_at, coalesce(a, 0) AS results_a, coalesce(b, 0) AS results_b FROM {LIFE} l LEFT JOIN
 (SELECT CAST(user_id % 30 AS VARCHAR) AS experiment, count(*) FILTER (WHERE event_id % 2 = 0) AS a, count(*) FILTER (WHERE event_id % 2 = 1) AS b FROM events GROUP BY 1) USING (experiment)""")
def k09(t):
    results = t.events.select(
        (F.col("user_id") % 30).cast("string").alias("experiment"),
        F.when(F.col("event_id") % 2 == 0, F.lit("model_a")).otherwise(F.lit("model_b")).alias("arm"),
    )
    out = ex.experiment_list(ex.lifecycle(status_log(t), tie="id"), results)
    return out.select("experiment", "status", "created_at", "results_a", "results_b")


@query("k10_lifecycle", f"SELECT * FROM {LIFE}")
def k10(t):
    return ex.lifecycle(status_log(t), tie="id")
