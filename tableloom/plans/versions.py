"""M. Model registry: orders of a customer stand in for versions of a model."""

from pyspark.sql import functions as F

from ..functions.scalars import config_key
from ..operators import versions as ve
from .registry import query


def created(t):
    return t.orders.select(
        F.col("o_custkey").alias("model_id"), F.col("o_orderdate").alias("created_at"), F.col("o_orderkey").alias("id"),
        (F.col("o_orderpriority") == "1-URGENT").alias("flagged"),
        F.create_map(F.lit("price"), F.col("o_totalprice"), F.lit("key"), F.col("o_orderkey").cast("double")).alias("metrics"),
    )


V = """(SELECT *, version_number = max(CASE WHEN version_number = 1 OR flagged THEN version_number END) OVER (PARTITION BY model_id) AS is_active, 'v' || version_number AS version_id FROM
 (SELECT o_custkey AS model_id, o_orderdate AS created_at, o_orderkey AS id, o_totalprice AS price, o_orderpriority = '1-URGENT' AS flagged, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version_number FROM orders))"""


def versions(t):
    return ve.assign_versions(created(t), "model_id", ["created_at", "id"], "flagged")


@query("m01_assign_versions", f"SELECT model_id, id, version_number, version_id, is_active FROM {V}")
def m01(t):
    return versions(t).select("model_id", "id", "version_number", "version_id", "is_active")


@query("m02_version_list", f"SELECT model_id, id, version_id, count(*) OVER (PARTITION BY model_id) AS total_versions, max(CASE WHEN is_active THEN version_id END) OVER (PARTITION BY model_id) AS current_version FROM {V}")
def m02(t):
    return ve.version_list(versions(t), "model_id").select("model_id", "id", "version_id", "total_versions", "current_version")


@query("m03_active_after_rollback", "SELECT user_id AS model_id, arg_max(event_id % 9, (ts, event_id)) AS active_version FROM events WHERE event_type IN ('click', 'view') GROUP BY user_id")
def m03(t):
    log = t.events.where(F.col("event_type").isin("click", "view")).select(
        F.col("user_id").alias("model_id"), (F.col("event_id") % 9).alias("version"), "ts", "event_id"
    )
    return ve.active_after(log, "model_id", "version", "ts", "event_id")


@query("m04_compare_versions", f"""
WITH a AS (SELECT model_id, price, id::DOUBLE AS key FROM {V} WHERE version_number = 1), b AS (SELECT model_id, price, id::DOUBLE AS key FROM {V} WHERE version_number = 2)
SELECT model_id, 'price' AS metric, a.price AS version_1, b.price AS version_2, round(b.price - a.price, 4) AS difference, round((b.price - a.price) / a.price * 100, 4) AS percent_change FROM a JOIN b USING (model_id)
UNION ALL SELECT model_id, 'key', a.key, b.key, b.key - a.key, CASE WHEN a.key = 0 THEN 0 ELSE round((b.key - a.key) / a.key * 100, 4) END FROM a JOIN b USING (model_id)""")
def m04(t):
    out = ve.compare_versions(versions(t), "model_id", "metrics", 1, 2)
    return out.withColumns({c: F.round(c, 4) for c in ("difference", "percent_change")})


DELETES = "(SELECT c_custkey AS model_id, 1 + c_custkey % 4 AS version_number FROM customer)"


def requests(t):
    return t.customer.select(F.col("c_custkey").alias("model_id"), (1 + F.col("c_custkey") % 4).alias("version_number"))


@query("m05_delete_outcomes", f"SELECT d.model_id, d.version_number, CASE WHEN v.is_active IS NULL THEN 'not found' WHEN v.is_active THEN 'active version cannot be deleted' ELSE 'deleted' END AS outcome FROM {DELETES} d LEFT JOIN {V} v USING (model_id, version_number)")
def m05(t):
    return ve.delete_versions(versions(t), requests(t), "model_id")[1]


@query("m05_versions_left", f"SELECT v.model_id, v.version_number FROM {V} v LEFT JOIN {DELETES} d USING (model_id, version_number) WHERE d.model_id IS NULL OR v.is_active")
def m05_left(t):
    return ve.delete_versions(versions(t), requests(t), "model_id")[0].select("model_id", "version_number")


@query("m06_run_key", """SELECT p_partkey, sha256(p_type || ':{"depth":' || p_size || ',"key":' || p_partkey || '}') AS run_key FROM part""")
def m06(t):
    config = F.create_map(F.lit("key"), F.col("p_partkey"), F.lit("depth"), F.col("p_size").cast("bigint"))
    return t.part.select("p_partkey", config_key(F.col("p_type"), config).alias("run_key"))


@query("m07_store_statistics", """
WITH n AS (SELECT max(ts) AS now FROM events)
SELECT count(*) AS total_models, count(*) FILTER (WHERE ts + INTERVAL 24 HOUR > now) AS valid_models, count(*) FILTER (WHERE NOT ts + INTERVAL 24 HOUR > now) AS expired_models,
 CAST(sum(user_id * 1000) AS BIGINT) AS total_size_bytes, round(sum(user_id * 1000) / 1048576, 2) AS total_size_mb FROM events, n""")
def m07(t):
    now = t.events.agg(F.max("ts").alias("now")).scalar()
    entries = t.events.select("ts", (F.col("user_id") * 1000).alias("bytes"))
    return ve.store_statistics(entries, "ts", "bytes", now)


@query("m08_best_active", f"""
SELECT kind, id, price FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY price DESC, id) AS r FROM (SELECT model_id % 7 AS kind, id, price FROM {V} WHERE is_active)) WHERE r <= 3""")
def m08(t):
    models = versions(t).select((F.col("model_id") % 7).alias("kind"), "id", F.col("metrics")["price"].alias("price"), "is_active")
    return ve.best_active(models, "kind", "price", "id", 3).select("kind", "id", "price")
