"""B. Projections, filters and predicates."""

from pyspark.sql import functions as F

from ..functions import predicates as p
from ..operators import columns as c
from .registry import query


def nested(t):
    """Parts as nested property documents."""
    return t.part.select(
        F.col("p_partkey").alias("id"),
        F.struct(F.col("p_size").alias("bedrooms"), F.col("p_type").alias("property_type")).alias("features"),
        F.struct((F.col("p_size") * 0.5).alias("lat"), (F.col("p_partkey") % 180).cast("double").alias("lng")).alias("coordinates"),
        F.col("p_retailprice").alias("actual_price"),
        F.col("p_brand").alias("brand"),
    )


@query("b01_select_features", "SELECT l_orderkey, l_linenumber, l_quantity, l_tax FROM lineitem")
def b01(t):
    return c.select_features(t.lineitem, ["l_orderkey", "l_linenumber", "l_quantity", "l_tax"])


@query("b02_numeric_columns", "SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
def b02(t):
    return c.select_numeric(t.customer)


@query("b03_available_features", "SELECT p_size, p_retailprice FROM part")
def b03(t):
    return t.part.select(c.available_features(t.part, ["p_size", "sqft", "p_retailprice", "garage"]))


@query("b04_drop_target", "SELECT o_orderkey, o_totalprice FROM orders")
def b04(t):
    df = t.orders.select("o_orderkey", "o_totalprice", F.col("o_custkey").alias("target"))
    return c.features_and_target(df)[0]


@query("b05_detect_target", "SELECT 'price' AS target_name, count(*) AS n, round(avg(p_retailprice), 4) AS mean_target FROM part")
def b05(t):
    df = t.part.select("p_size", F.col("p_retailprice").alias("price"), F.col("p_partkey").alias("y"))
    name = c.detect_target(df)
    return df.agg(F.lit(name).alias("target_name"), F.count(name).alias("n"), F.round(F.avg(name), 4).alias("mean_target"))


@query("b06_nested_equality", "SELECT p_partkey AS id, p_retailprice AS actual_price FROM part WHERE p_size = 3")
def b06(t):
    return nested(t).filter(F.col("features.bedrooms") == 3).select("id", "actual_price")


@query("b07_closed_range", "SELECT p_partkey AS id, p_retailprice AS actual_price FROM part WHERE p_retailprice BETWEEN 950 AND 1050")
def b07(t):
    return nested(t).filter(F.col("actual_price").between(950, 1050)).select("id", "actual_price")


@query("b08_conjunction_top", "SELECT p_partkey AS id, p_retailprice AS actual_price FROM part WHERE p_type = 'ECONOMY' AND p_size BETWEEN 5 AND 20 AND p_retailprice >= 910 ORDER BY p_retailprice, p_partkey LIMIT 20")
def b08(t):
    rows = nested(t).filter(
        p.all_of(
            F.col("features.property_type") == "ECONOMY",
            F.col("features.bedrooms").between(5, 20),
            F.col("actual_price") >= 910,
        )
    )
    return rows.orderBy("actual_price", "id").limit(20).select("id", "actual_price")


@query("b09_field_exists", "SELECT p_partkey AS id, nullif(p_size, 7) AS bedrooms FROM part WHERE nullif(p_size, 7) IS NOT NULL")
def b09(t):
    df = t.part.select(F.col("p_partkey").alias("id"), F.nullif(F.col("p_size"), F.lit(7)).alias("bedrooms"))
    return df.filter(p.field_exists(F.col("bedrooms")))


@query("b10_bounding_box", "SELECT p_partkey AS id FROM part WHERE p_size * 0.5 BETWEEN 5 AND 12 AND CAST(p_partkey % 180 AS DOUBLE) BETWEEN 20 AND 95")
def b10(t):
    box = p.in_box(F.col("coordinates.lat"), F.col("coordinates.lng"), 5, 20, 12, 95)
    return nested(t).filter(box).select("id")


@query("b11_box_and_attributes", "SELECT p_partkey AS id FROM part WHERE p_size * 0.5 BETWEEN 2 AND 20 AND CAST(p_partkey % 180 AS DOUBLE) BETWEEN 0 AND 150 AND p_retailprice < 1500 AND p_type = 'ECONOMY'")
def b11(t):
    box = p.in_box(F.col("coordinates.lat"), F.col("coordinates.lng"), 2, 0, 20, 150)
    rows = nested(t).filter(box & (F.col("actual_price") < 1500) & (F.col("features.property_type") == "ECONOMY"))
    return rows.select("id")


@query("b12_date_range", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31'")
def b12(t):
    low, high = (F.lit(d).cast("timestamp_ntz") for d in ("1996-01-01 00:00:00", "1996-12-31 00:00:00"))
    return t.orders.filter(F.col("o_orderdate").between(low, high)).select("o_orderkey", "o_orderdate")


WORDS_SQL = r"string_split_regex(lower(concat_ws(' ', text, source)), '[^\p{L}\p{N}]+')"


@query("b13_text_any", f"SELECT doc_id FROM documents WHERE list_has_any({WORDS_SQL}, ['three', 'retition', 'le'])")
def b13(t):
    return t.documents.filter(p.text_matches([F.col("text"), F.col("source")], "Three retition le")).select("doc_id")


@query("b14_text_negated", f"SELECT doc_id FROM documents WHERE list_has_any({WORDS_SQL}, ['the', 'and']) AND NOT list_contains({WORDS_SQL}, 'where')")
def b14(t):
    return t.documents.filter(p.text_matches([F.col("text"), F.col("source")], "the and -where")).select("doc_id")


@query("b15_text_ranked", f"""
WITH w AS (SELECT doc_id, {WORDS_SQL} AS ws FROM documents),
tf AS (SELECT doc_id, len(list_filter(ws, lambda x: x = 'that')) AS a, len(list_filter(ws, lambda x: x = 'with')) AS b FROM w),
df AS (SELECT count(*) AS n, count(*) FILTER (WHERE a > 0) AS da, count(*) FILTER (WHERE b > 0) AS db FROM tf)
SELECT doc_id, round(a * ln(1 + n / da) + b * ln(1 + n / db), 4) AS score FROM tf, df WHERE a > 0 OR b > 0 ORDER BY a * ln(1 + n / da) + b * ln(1 + n / db) DESC, doc_id LIMIT 10""")
def b15(t):
    best = p.text_ranked(t.documents.select("doc_id", "text", "source"), ["text", "source"], "that with", 10, "doc_id")
    return best.select("doc_id", F.round("score", 4).alias("score"))


@query("b16_non_finite_to_null", """
SELECT count(*) AS n, count(r) AS kept, round(avg(r), 6) AS mean_ratio FROM (
 SELECT CASE WHEN l_discount = 0 THEN NULL WHEN l_tax = 0 THEN NULL ELSE l_tax / l_discount END AS r FROM lineitem)""")
def b16(t):
    ratio = (
        F.when(F.col("l_discount") == 0, F.lit(float("inf")))
        .when(F.col("l_tax") == 0, F.lit(float("nan")))
        .otherwise(F.col("l_tax") / F.col("l_discount"))
    )
    clean = c.non_finite_to_null(t.lineitem.select(ratio.alias("r")))
    return clean.agg(F.count(F.lit(1)).alias("n"), F.count("r").alias("kept"), F.round(F.avg("r"), 6).alias("mean_ratio"))


@query("b17_price_filter", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 100000 AND o_totalprice <= 200000")
def b17(t):
    return t.orders.filter(F.col("o_totalprice").between(100000, 200000)).select("o_orderkey", "o_totalprice")


@query("b18_derived_ratios", """
SELECT l_orderkey, l_linenumber, l_extendedprice / l_quantity AS price_per_sqft, CAST(2024 - year(l_shipdate) AS INTEGER) AS age,
 CASE WHEN l_tax = 0 THEN NULL ELSE l_quantity / l_tax END AS bed_bath_ratio, l_quantity + l_tax AS total_rooms FROM lineitem""")
def b18(t):
    out = c.property_ratios(
        F.col("l_extendedprice"), F.col("l_quantity"), F.year("l_shipdate"), F.col("l_quantity"), F.col("l_tax"), 2024
    )
    return t.lineitem.select("l_orderkey", "l_linenumber", *[v.alias(k) for k, v in out.items()])


@query("b19_drop_noise", "SELECT vec_id, label FROM (SELECT vec_id, label - 1 AS label FROM embeddings) WHERE label <> -1")
def b19(t):
    return t.embeddings.select("vec_id", (F.col("label") - 1).alias("label")).filter("label <> -1")


@query("b20_chart_projection", "SELECT p_partkey AS id, p_size AS bedrooms, CAST(p_size * 0.5 AS DOUBLE) AS lat, p_retailprice AS price FROM part")
def b20(t):
    out = c.flatten(
        nested(t), {"id": "id", "bedrooms": "features.bedrooms", "lat": "coordinates.lat", "price": "actual_price"}
    )
    return out
