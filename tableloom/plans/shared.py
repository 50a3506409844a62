"""Stand-in relations used by many queries, in Spark and as SQL."""

from pyspark.sql import functions as F

#: A property table derived from order lines, as a SQL relation.
PROPERTIES_SQL = """(SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice AS actual_price, l_quantity * 100 AS sqft,
 l_discount * 100 AS school_rating, l_tax * 1000 AS walkability_score,
 CAST(year(l_shipdate) AS INTEGER) AS year_built, l_returnflag AS property_type FROM lineitem)"""


def properties(t):
    return t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        F.col("l_extendedprice").alias("actual_price"),
        (F.col("l_quantity") * 100).alias("sqft"),
        (F.col("l_discount") * 100).alias("school_rating"),
        (F.col("l_tax") * 1000).alias("walkability_score"),
        F.year("l_shipdate").alias("year_built"),
        F.col("l_returnflag").alias("property_type"),
    )


#: The pair of keys repeats in the supplied data; part and supplier complete a total order.
LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


#: A target and classes that follow from three columns of the order lines, so that models have something to find.
SIGNAL_SQL = "(l_quantity * 100 + l_discount * 30000 + l_tax * 10000 + 2 * (l_quantity - 25) * (l_quantity - 25))"
KIND_SQL = "(CASE WHEN l_quantity > 30 AND l_discount > 0.045 THEN 'large' WHEN l_tax > 0.045 THEN 'taxed' ELSE 'plain' END)"


def with_signal(t):
    """The order lines with a key of their own, the columns of the models, ``signal`` and ``kind``."""
    return t.lineitem.select(
        F.xxhash64(*LINE_KEY, "l_extendedprice").alias("row_key"), "l_quantity", "l_discount", "l_tax", "l_extendedprice",
        F.expr(SIGNAL_SQL).alias("signal"), F.expr(KIND_SQL).alias("kind"),
    )


def counted(df, **flags):
    """One row: the number of rows, and what was found out."""
    return df.agg(F.count(F.lit(1)).alias("n"), *[F.lit(v).alias(k) for k, v in flags.items()])
