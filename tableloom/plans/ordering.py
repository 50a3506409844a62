"""S. Sorts, limits and top-k."""

from pyspark.sql import functions as F

from ..functions.scalars import entries_by_value
from ..operators.windows import top_per_key
from .filters import nested
from .registry import query


@query("s01_newest", "SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id LIMIT 25")
def s01(t):
    return t.events.select("event_id", "ts", "event_type").orderBy(F.desc("ts"), "event_id").limit(25)


@query("s02_ascending_sort", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice")
def s02(t):
    return t.part.select("p_partkey", "p_retailprice").orderBy("p_retailprice")


@query("s03_nested_sort", "SELECT p_partkey AS id, CAST(p_size * 0.5 AS DOUBLE) AS lat FROM part ORDER BY p_size, p_partkey LIMIT 20")
def s03(t):
    rows = nested(t).orderBy("coordinates.lat", "id").limit(20)
    return rows.select("id", F.col("coordinates.lat").alias("lat"))


@query("s04_map_by_value", "SELECT o_custkey, list(o_orderstatus ORDER BY n DESC, o_orderstatus) AS names FROM (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL) GROUP BY o_custkey")
def s04(t):
    """Entries of a small map sorted by value; the map has one entry per status."""
    counts = t.orders.groupBy("o_custkey").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))
    m = F.map_filter(
        F.create_map(F.lit("F"), F.col("F"), F.lit("O"), F.col("O"), F.lit("P"), F.col("P")),
        lambda k, v: v.isNotNull(),
    )
    return counts.select("o_custkey", F.transform(entries_by_value(m), lambda e: e["key"]).alias("names"))


@query("s05_head_per_key", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r <= 3")
def s05(t):
    return top_per_key(t.events.select("user_id", "event_id", "ts"), ["user_id"], [F.asc("ts"), F.asc("event_id")], 3).select("user_id", "event_id")


@query("s05_tail_per_key", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 10")
def s05_tail(t):
    return top_per_key(t.events.select("user_id", "event_id", "ts"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 10).select("user_id", "event_id")


@query("s06_owner_newest", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_custkey = 7 ORDER BY o_orderdate DESC, o_orderkey")
def s06(t):
    return t.orders.filter("o_custkey = 7").select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), "o_orderkey")
