"""L. Model monitoring: orders of a customer group stand in for metric records of a model."""

from pyspark.sql import functions as F

from ..operators import monitoring as mo
from .registry import query


def history(t):
    x = F.col("o_orderkey")
    metrics = F.create_map(
        F.lit("r2"), x * 37 % 100 / 100, F.lit("rmse"), F.round(F.col("o_totalprice") / 997, 2),
        F.lit("mae"), (x * 11 % 50).cast("double"), F.lit("accuracy"), x * 53 % 100 / 100,
    )
    return t.orders.select((F.col("o_custkey") % 50).alias("model_id"), F.col("o_orderdate").alias("ts"), x.alias("id"), metrics.alias("metrics"))


def thresholds(t):
    n = F.col("n_nationkey").cast("bigint")
    return t.nation.select(
        n.alias("model_id"),
        F.create_map(
            F.lit("min_r2"), n % 10 / 50, F.lit("max_rmse"), (n * 10 + 200).cast("double"), F.lit("max_mae"), (n % 5 + 40).cast("double"),
            F.lit("min_accuracy"), n % 4 / 20, F.lit("performance_degradation_percent"), (n + 30).cast("double"),
        ).alias("thresholds"),
    )


def baseline(t):
    n = F.col("n_nationkey").cast("bigint")
    return t.nation.where("n_nationkey % 2 = 0").select(
        n.alias("model_id"), F.create_map(F.lit("r2"), F.lit(0.8), F.lit("accuracy"), F.lit(0.9)).alias("baseline")
    )


H = "(SELECT o_custkey % 50 AS model_id, o_orderdate AS ts, o_orderkey AS id, (o_orderkey * 37 % 100) / 100 AS r2, round(o_totalprice / 997, 2) AS rmse, (o_orderkey * 11 % 50)::DOUBLE AS mae, (o_orderkey * 53 % 100) / 100 AS accuracy FROM orders)"
T = "(SELECT n_nationkey::BIGINT AS m, n_nationkey % 10 / 50 AS min_r2, (n_nationkey * 10 + 200)::DOUBLE AS max_rmse, (n_nationkey % 5 + 40)::DOUBLE AS max_mae, n_nationkey % 4 / 20 AS min_accuracy, (n_nationkey + 30)::DOUBLE AS lost FROM nation)"
ABSOLUTE = f"""(SELECT model_id, id, 0 AS o, 'r2' AS metric, 'below_minimum' AS kind, r2 AS current, min_r2 AS threshold FROM {H} JOIN {T} ON model_id = m WHERE r2 < min_r2
 UNION ALL SELECT model_id, id, 1, 'accuracy', 'below_minimum', accuracy, min_accuracy FROM {H} JOIN {T} ON model_id = m WHERE accuracy < min_accuracy
 UNION ALL SELECT model_id, id, 2, 'rmse', 'above_maximum', rmse, max_rmse FROM {H} JOIN {T} ON model_id = m WHERE rmse > max_rmse
 UNION ALL SELECT model_id, id, 3, 'mae', 'above_maximum', mae, max_mae FROM {H} JOIN {T} ON model_id = m WHERE mae > max_mae)"""


def exploded(checked):
    return checked.select("model_id", "id", F.explode("violations").alias("v")).select("model_id", "id", "v.*")


@query("l01_threshold_violations", f"SELECT model_id, id, metric, kind, current, threshold FROM {ABSOLUTE}")
def l01(t):
    return exploded(mo.check(history(t), thresholds(t), "model_id")).drop("degradation_percent")


@query("l02_degradation", f"""
SELECT model_id, id, metric, round(degradation, 6) AS degradation_percent FROM (SELECT model_id, id, 'r2' AS metric, (0.8 - r2) / 0.8 * 100 AS degradation, lost FROM {H} JOIN {T} ON model_id = m WHERE model_id % 2 = 0
 UNION ALL SELECT model_id, id, 'accuracy', (0.9 - accuracy) / 0.9 * 100, lost FROM {H} JOIN {T} ON model_id = m WHERE model_id % 2 = 0) WHERE degradation > lost""")
def l02(t):
    out = exploded(mo.check(history(t), thresholds(t), "model_id", baseline(t))).where("kind = 'performance_degradation'")
    return out.select("model_id", "id", "metric", F.round("degradation_percent", 6).alias("degradation_percent"))


@query("l03_retrain_advice", f"""
WITH v AS (SELECT model_id, id, count(*) AS n, string_agg(printf('%s (%.4f) %s threshold (%.4f)', metric, current::DOUBLE, CASE WHEN kind = 'below_minimum' THEN 'below' ELSE 'above' END, threshold::DOUBLE), '; ' ORDER BY o) AS s FROM {ABSOLUTE} GROUP BY ALL)
SELECT h.model_id, h.id, n IS NOT NULL AS retrain_needed, CASE WHEN n IS NULL THEN 'No retraining needed - performance within acceptable thresholds' ELSE 'Retraining recommended due to ' || n || ' threshold violation(s): ' || s END AS recommendation
FROM {H} h JOIN {T} ON h.model_id = m LEFT JOIN v ON v.model_id = h.model_id AND v.id = h.id""")
def l03(t):
    return mo.check(history(t), thresholds(t), "model_id").select("model_id", "id", "retrain_needed", "recommendation")


@query("l04_recent_checks", f"SELECT model_id, id FROM (SELECT model_id, id, row_number() OVER (PARTITION BY model_id ORDER BY ts DESC, id DESC) AS r FROM {H}) WHERE r <= 100")
def l04(t):
    return mo.recent(history(t), "model_id", "ts", "id").select("model_id", "id")


@query("l05_trends", f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY ts DESC, id DESC) AS r FROM {H}), l AS (SELECT * FROM r WHERE r <= 10),
u AS (SELECT model_id, ts, id, 'r2' AS metric, r2 AS value FROM l UNION ALL SELECT model_id, ts, id, 'rmse', rmse FROM l UNION ALL SELECT model_id, ts, id, 'mae', mae FROM l UNION ALL SELECT model_id, ts, id, 'accuracy', accuracy FROM l),
a AS (SELECT model_id, metric, arg_max(value, (ts, id)) AS current, arg_min(value, (ts, id)) AS first, avg(value) AS average, count(*) AS samples FROM u GROUP BY model_id, metric)
SELECT model_id, metric, current, round(average, 6) AS average, CASE WHEN (metric IN ('rmse', 'mae') AND current < first) OR (metric NOT IN ('rmse', 'mae') AND current > first) THEN 'improving' ELSE 'degrading' END AS trend, samples FROM a WHERE samples >= 2""")
def l05(t):
    return mo.trends(history(t), "model_id", "ts", "id").withColumn("average", F.round("average", 6))


def updates(t):
    x = F.col("o_orderkey")
    section = F.when(x % 3 == 0, F.lit("settings")).otherwise(F.lit("thresholds"))
    pick = lambda *names: F.element_at(F.array(*map(F.lit, names)), (x % len(names) + 1).cast("int"))
    key = F.when(x % 3 == 0, pick("auto_retrain_enabled", "check_interval_hours")).otherwise(
        pick("min_r2", "max_rmse", "no_such_key", "max_mae")
    )
    value = F.when(key == "auto_retrain_enabled", (F.col("o_custkey") % 2 == 0).cast("string")).otherwise((x % 90).cast("string"))
    return t.orders.select(
        (F.col("o_custkey") % 50).alias("model_id"), section.alias("section"), key.alias("key"), value.alias("value"),
        F.col("o_orderdate").alias("ts"), x.alias("id"),
    )


U = """(SELECT *, CASE WHEN key = 'auto_retrain_enabled' THEN CASE WHEN o_custkey % 2 = 0 THEN 'true' ELSE 'false' END ELSE CAST(id % 90 AS VARCHAR) END AS value FROM (SELECT o_custkey, o_custkey % 50 AS model_id, o_orderdate AS ts, o_orderkey AS id,
 CASE WHEN o_orderkey % 3 = 0 THEN 'settings' ELSE 'thresholds' END AS section,
 CASE WHEN o_orderkey % 3 = 0 THEN ['auto_retrain_enabled', 'check_interval_hours'][o_orderkey % 2 + 1] ELSE ['min_r2', 'max_rmse', 'no_such_key', 'max_mae'][o_orderkey % 4 + 1] END AS key FROM orders))"""
CONFIG = f"""(SELECT model_id, arg_max(value, (ts, id)) FILTER (WHERE key = 'min_r2')::DOUBLE AS min_r2, arg_max(value, (ts, id)) FILTER (WHERE key = 'max_mae')::DOUBLE AS max_mae,
 coalesce(arg_max(value, (ts, id)) FILTER (WHERE key = 'auto_retrain_enabled'), 'true') AS auto_retrain_enabled, coalesce(arg_max(value, (ts, id)) FILTER (WHERE key = 'check_interval_hours'), '24') AS check_interval_hours,
 '100' AS min_samples FROM {U} WHERE key <> 'no_such_key' GROUP BY model_id)"""


@query("l06_current_config", f"SELECT * FROM {CONFIG}")
def l06(t):
    c = mo.current_config(updates(t), "model_id", "ts", "id")
    return c.select(
        "model_id", F.col("thresholds")["min_r2"].alias("min_r2"), F.col("thresholds")["max_mae"].alias("max_mae"),
        F.col("settings")["auto_retrain_enabled"].alias("auto_retrain_enabled"),
        F.col("settings")["check_interval_hours"].alias("check_interval_hours"),
        F.col("settings")["min_samples_for_retrain"].alias("min_samples"),
    )


@query("l06_invalid_keys", f"SELECT model_id, id FROM {U} WHERE key = 'no_such_key'")
def l06_invalid(t):
    return mo.invalid_keys(updates(t)).select("model_id", "id")


@query("l07_retrain_log", f"SELECT event_id, user_id % 60 AS model_id, CASE WHEN event_type = 'click' THEN 'manual' ELSE event_type END AS trigger FROM events WHERE user_id % 60 IN (SELECT model_id FROM {CONFIG} WHERE auto_retrain_enabled = 'true')")
def l07(t):
    requests = t.events.select(
        "event_id", (F.col("user_id") % 60).alias("model_id"), F.nullif(F.col("event_type"), F.lit("click")).alias("trigger")
    )
    config = mo.current_config(updates(t), "model_id", "ts", "id")
    return mo.accepted_retrains(requests, config, "model_id").select("event_id", "model_id", "trigger")


@query("l08_monitored_models", f"""
SELECT c.model_id, 'active' AS status, auto_retrain_enabled = 'true' AS auto_retrain_enabled, last_check, CASE WHEN n IS NULL THEN 0 ELSE least(n, 100) END AS total_checks, CASE WHEN r IS NULL THEN 0 ELSE least(r, 50) END AS total_retrains FROM {CONFIG} c
LEFT JOIN (SELECT model_id, max(ts) AS last_check, count(*) AS n FROM {H} GROUP BY model_id) USING (model_id) LEFT JOIN (SELECT user_id % 45 AS model_id, count(*) AS r FROM events GROUP BY 1) USING (model_id)""")
def l08(t):
    retrains = t.events.select((F.col("user_id") % 45).alias("model_id"))
    return mo.monitored_models(mo.current_config(updates(t), "model_id", "ts", "id"), history(t), retrains, "model_id", "ts")
