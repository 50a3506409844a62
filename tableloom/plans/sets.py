"""R. Set operations and sampling."""

from pyspark.sql import functions as F

from ..operators import sets as s
from .registry import query


@query("r01_history_head", """
SELECT event_id, src FROM (SELECT event_id, 'session' AS src, 0 AS o FROM events WHERE event_type = 'purchase' AND value > 480 UNION ALL SELECT event_id, 'stored', 1 FROM events WHERE event_type = 'error') ORDER BY o, event_id LIMIT 20""")
def r01(t):
    session = t.events.filter("event_type = 'purchase' AND value > 480").select("event_id", F.lit("session").alias("src"))
    stored = t.events.filter("event_type = 'error'").select("event_id", F.lit("stored").alias("src"))
    return s.history_head(session, stored, ["event_id"])


@query("r02_append", "SELECT c_custkey AS key, c_acctbal AS balance FROM customer UNION ALL SELECT s_suppkey, s_acctbal FROM supplier")
def r02(t):
    return s.append(
        t.customer.select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance")),
        t.supplier.select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance")),
    )


@query("r03_key_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def r03(t):
    return s.key_union(t.customer.select(F.col("c_nationkey").alias("k")), t.supplier.select("s_nationkey"))


@query("r04_shared_keys", "SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 49 INTERSECT SELECT p_partkey FROM part WHERE p_size < 10")
def r04(t):
    return s.shared_keys(
        t.lineitem.filter("l_quantity > 49").select(F.col("l_partkey").alias("k")),
        t.part.filter("p_size < 10").select(F.col("p_partkey").alias("k")),
    )


@query("r04_unmatched_keys", "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 40")
def r04_unmatched(t):
    return s.unmatched_keys(
        t.part.select(F.col("p_partkey").alias("k")), t.lineitem.filter("l_quantity > 40").select("l_partkey")
    )


@query("r05_distinct_count", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_returnflag")
def r05(t):
    return t.lineitem.groupBy("l_returnflag").agg(
        F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_suppkey").alias("suppliers")
    )


@query("r06_sample_without", "SELECT 100::BIGINT AS n, 100::BIGINT AS keys, 100::BIGINT AS known, true AS same_again")
def r06(t):
    """A hundred different rows of the table, the same ones again."""
    sample, again = (s.sample_without(t.orders, 100, ["o_orderkey"]).select("o_orderkey") for _ in range(2))
    known = sample.join(t.orders.select("o_orderkey"), "o_orderkey", "left_semi").count()
    repeated = sample.join(again, "o_orderkey", "left_semi").count()
    return sample.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_orderkey").alias("keys"), F.lit(known).cast("bigint").alias("known"), F.lit(repeated == 100).alias("same_again"))


@query("r06_sample_with", "SELECT true AS near_share, true AS with_copies, true AS poisson")
def r06_with(t):
    """About 0.8 draws a row, with copies; the share of rows that are not drawn is that of a Poisson count."""
    copies = s.sample_with(t.orders, 0.8).groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("copies"))
    rows = t.orders.count()
    return copies.agg(
        (F.abs(F.sum("copies") / rows - 0.8) < 0.1).alias("near_share"), (F.max("copies") > 1).alias("with_copies"),
        (F.abs(1 - F.count(F.lit(1)) / rows - 0.4493) < 0.05).alias("poisson"),
    )


@query("r06_shuffle", "SELECT count(*) AS n, count(DISTINCT c_custkey) AS keys, true AS out_of_order FROM customer")
def r06_shuffle(t):
    """All rows once, in an order that has nothing to do with the key's."""
    placed = s.shuffled(t.customer.select("c_custkey"), ["c_custkey"]).withColumn("at", F.monotonically_increasing_id())
    return placed.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("c_custkey").alias("keys"), (F.abs(F.corr("at", "c_custkey")) < 0.2).alias("out_of_order"))
