"""Q. Joins."""

from pyspark.sql import functions as F

from ..operators import joins as j
from .registry import query


@query("q01_reference_lookup", """
SELECT o_orderkey, o_totalprice, c_mktsegment, n_name, r_name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey
LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def q01(t):
    known = t.customer.filter("c_acctbal > 0")
    out = j.lookup(t.orders, "o_custkey", known, "c_custkey", ["c_mktsegment", "c_nationkey"])
    out = j.lookup(out, "c_nationkey", t.nation, "n_nationkey", ["n_name", "n_regionkey"])
    out = j.lookup(out, "n_regionkey", t.region, "r_regionkey", ["r_name"])
    return out.select("o_orderkey", "o_totalprice", "c_mktsegment", "n_name", "r_name")


@query("q02_dataset_lookup", "SELECT l_orderkey, l_linenumber, l_partkey, p_name, p_brand FROM lineitem LEFT JOIN part ON l_partkey = p_partkey AND p_size > 10")
def q02(t):
    out = j.lookup(t.lineitem, "l_partkey", t.part.filter("p_size > 10"), "p_partkey", ["p_name", "p_brand"])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "p_name", "p_brand")


def _metrics(df, flag):
    one = df.filter(F.col("l_returnflag") == flag).agg(F.avg("l_quantity").alias("a"), F.avg("l_tax").alias("b"))
    entries = [F.struct(F.lit("quantity").alias("metric"), F.col("a").alias("value"))]
    if flag == "A":
        entries.append(F.struct(F.lit("tax").alias("metric"), F.col("b").alias("value")))
    return one.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


@query("q03_common_metrics", """SELECT 'quantity' AS metric, round((SELECT avg(l_quantity) FROM lineitem WHERE l_returnflag = 'A'), 4) AS value_a, round((SELECT avg(l_quantity) FROM lineitem WHERE l_returnflag = 'R'), 4) AS value_b""")
def q03(t):
    out = j.metric_pairs(_metrics(t.lineitem, "A"), _metrics(t.lineitem, "R"), "metric", "value")
    return out.select("metric", F.round("value_a", 4).alias("value_a"), F.round("value_b", 4).alias("value_b"))


@query("q04_scalar_broadcast", "SELECT o_orderkey, round((o_totalprice - (SELECT avg(o_totalprice) FROM orders)) / (SELECT stddev_pop(o_totalprice) FROM orders), 6) AS z FROM orders")
def q04(t):
    stats = t.orders.agg(F.avg("o_totalprice").alias("mean"), F.stddev_pop("o_totalprice").alias("std"))
    out = j.with_scalars(t.orders.select("o_orderkey", "o_totalprice"), stats)
    return out.select("o_orderkey", F.round((F.col("o_totalprice") - F.col("mean")) / F.col("std"), 6).alias("z"))


@query("q05_range_join", """
SELECT l_orderkey, l_linenumber, l_quantity, label FROM lineitem LEFT JOIN (VALUES ('small', 1, 10), ('middle', 10, 30), ('large', 35, 1000)) b(label, lo, hi) ON l_quantity >= lo AND l_quantity < hi""")
def q05(t):
    bands = t.spark.createDataFrame([("small", 1.0, 10.0), ("middle", 10.0, 30.0), ("large", 35.0, 1000.0)], "label string, lo double, hi double")
    out = j.to_ranges(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity"), "l_quantity", bands, "lo", "hi", "label")
    return out


@query("q06_nearest_neighbours", """
SELECT id, neighbour, rank FROM (SELECT a.c_custkey AS id, b.c_custkey AS neighbour,
  row_number() OVER (PARTITION BY a.c_custkey ORDER BY (a.c_acctbal - b.c_acctbal) * (a.c_acctbal - b.c_acctbal) + (a.c_nationkey - b.c_nationkey) * (a.c_nationkey - b.c_nationkey)::DOUBLE, b.c_custkey) AS rank
 FROM customer a, customer b WHERE a.c_custkey <> b.c_custkey) WHERE rank <= 5""")
def q06(t):
    """Exact k nearest rows by two columns, blocks pruned by their boxes."""
    from ..operators.neighbors import nearest

    out = nearest(t.customer, "c_custkey", ["c_acctbal", "c_nationkey"], k=5)
    return out.select(F.col("id"), F.col("neighbour"), F.col("rank").cast("bigint").alias("rank"))


@query("q06_within_distance", """
SELECT a.c_custkey AS id, b.c_custkey AS neighbour, round(sqrt((a.c_acctbal - b.c_acctbal) ** 2 + (a.c_nationkey - b.c_nationkey) ** 2), 6) AS distance
FROM customer a JOIN customer b ON a.c_custkey < b.c_custkey
 AND (a.c_acctbal - b.c_acctbal) * (a.c_acctbal - b.c_acctbal) + (a.c_nationkey - b.c_nationkey) * (a.c_nationkey - b.c_nationkey)::DOUBLE <= 25""")
def q06_within(t):
    """All pairs of rows within a distance, met by the cells of a grid."""
    from ..operators.neighbors import within

    out = within(t.customer, "c_custkey", ["c_acctbal", "c_nationkey"], 5.0)
    return out.select("id", "neighbour", F.round("distance", 6).alias("distance"))


@query("q06_nearest_wide")
def q06_wide(t):
    """About the ten nearest rows over all 64 coordinates, by random-projection trees, and the rows each was compared with."""
    from ..operators.approximate import nearest_approximate

    wide = t.embeddings.select("vec_id", *[F.col("embedding")[j].alias(f"e{j}") for j in range(64)])
    out = nearest_approximate(wide, "vec_id", [f"e{j}" for j in range(64)], k=10, visited=True)
    return out.select("id", "neighbour", F.round("distance", 6).alias("distance"), F.col("rank").cast("bigint").alias("rank"), "visited")


@query("q07_present_keys", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def q07(t):
    return j.present(t.customer.select("c_custkey"), "c_custkey", t.orders, "o_custkey")


@query("q07_absent_keys", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def q07_absent(t):
    return j.absent(t.customer.select("c_custkey"), "c_custkey", t.orders.filter("o_totalprice > 300000"), "o_custkey")


@query("q08_side_by_side", "SELECT o_orderkey, round(o_totalprice / 2, 4) AS half, o_totalprice * 2 AS twice FROM orders")
def q08(t):
    a = t.orders.select("o_orderkey", F.round(F.col("o_totalprice") / 2, 4).alias("half"))
    b = t.orders.select("o_orderkey", (F.col("o_totalprice") * 2).alias("twice"))
    return j.side_by_side(a, b, ["o_orderkey"])
