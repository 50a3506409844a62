"""P. Dashboard aggregations."""

from pyspark.sql import functions as F

from ..operators import dashboard as d
from .registry import query
from .shared import LINE_KEY, PROPERTIES_SQL, properties


@query("p01_price_histogram", """
SELECT range, count(o_orderkey) AS count FROM (VALUES ('$200K-$400K', 200000, 400000), ('$400K-$600K', 400000, 600000), ('$600K-$800K', 600000, 800000), ('$800K-$1M', 800000, 1000000), ('$1M+', 1000000, 1e300)) r(range, lo, hi)
LEFT JOIN orders ON o_totalprice >= lo AND o_totalprice < hi GROUP BY range""")
def p01(t):
    return d.histogram(t.orders, "o_totalprice")


@query("p02_category_count", f"SELECT property_type AS name, count(*) AS value FROM {PROPERTIES_SQL} GROUP BY property_type")
def p02(t):
    return d.count_by(properties(t), "property_type")


@query("p03_price_trend", f"SELECT CAST(floor(year_built / 10) * 10 AS BIGINT)::VARCHAR || 's' AS decade, round(avg(actual_price)) AS avg_price, count(*) AS count FROM {PROPERTIES_SQL} GROUP BY 1")
def p03(t):
    return d.price_by_decade(properties(t), "actual_price", "year_built")


@query("p04_size_bands", f"""
SELECT CAST(lo AS VARCHAR) || '-' || CAST(lo + 500 AS VARCHAR) AS range, round(avg(actual_price)) AS avg_price, round(avg(school_rating), 1) AS avg_rating, count(*) AS count
FROM (SELECT *, CAST(floor(sqft / 500) * 500 AS BIGINT) AS lo FROM {PROPERTIES_SQL} WHERE actual_price BETWEEN 10000 AND 60000) GROUP BY lo ORDER BY lo LIMIT 10""")
def p04(t):
    return d.size_bands(properties(t), "actual_price", "sqft", "school_rating", 10000, 60000)


@query("p05_headline", f"""
WITH p AS (SELECT avg(actual_price) AS a, avg(school_rating) AS b, avg(walkability_score) AS c, avg(sqft) AS d FROM {PROPERTIES_SQL})
SELECT 'Price Score' AS name, round(a / 10000) AS value FROM p UNION ALL SELECT 'School Rating', round(b * 10) FROM p
UNION ALL SELECT 'Walkability', round(c) FROM p UNION ALL SELECT 'Size Index', round(d / 30) FROM p""")
def p05(t):
    return d.headline(
        properties(t),
        [
            ("Price Score", F.round(F.avg("actual_price") / 10000)),
            ("School Rating", F.round(F.avg("school_rating") * 10)),
            ("Walkability", F.round(F.avg("walkability_score"))),
            ("Size Index", F.round(F.avg("sqft") / 30)),
        ],
    )


@query("p06_yearly_trend", f"""
SELECT CAST(year_built AS VARCHAR) AS year, round(avg(actual_price) / 1000) AS price, round(avg(school_rating), 1) AS rating, round(avg(walkability_score)) AS walkability
FROM {PROPERTIES_SQL} GROUP BY year_built ORDER BY year_built DESC LIMIT 20""")
def p06(t):
    return d.yearly(
        properties(t),
        "year_built",
        {
            "price": F.round(F.avg("actual_price") / 1000),
            "rating": F.round(F.avg("school_rating"), 1),
            "walkability": F.round(F.avg("walkability_score")),
        },
    )


@query("p07_stat_cards", f"SELECT count(*) AS total_properties, round(avg(actual_price)) AS avg_price, round(avg(sqft)) AS avg_sqft, round(avg(school_rating), 1) AS avg_school_rating FROM {PROPERTIES_SQL}")
def p07(t):
    return properties(t).agg(
        F.count(F.lit(1)).alias("total_properties"),
        F.round(F.avg("actual_price")).alias("avg_price"),
        F.round(F.avg("sqft")).alias("avg_sqft"),
        F.round(F.avg("school_rating"), 1).alias("avg_school_rating"),
    )


@query("p08_scatter", f"SELECT sqft, actual_price FROM {PROPERTIES_SQL} ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 100")
def p08(t):
    return properties(t).orderBy(*LINE_KEY).limit(100).select("sqft", "actual_price")


@query("p09_model_usage", "SELECT upper(regexp_replace(replace(o_orderpriority, ' ', '_') , '_', ' ')) AS model, count(*) AS count FROM orders GROUP BY 1")
def p09(t):
    return d.usage(t.orders.select(F.translate("o_orderpriority", " ", "_").alias("m")), "m")


@query("p10_confidence_trend", """
SELECT row_number() OVER (ORDER BY ts DESC, event_id) AS prediction, round(c * 100, 1) AS confidence
FROM (SELECT ts, event_id, (event_id % 1000) / 1000 AS c FROM events ORDER BY ts DESC, event_id LIMIT 10)""")
def p10(t):
    df = t.events.select("ts", "event_id", (F.col("event_id") % 1000 / 1000).alias("c"))
    return d.confidence_trend(df, [F.desc("ts"), F.asc("event_id")], F.col("c"))


@query("p11_prediction_summary", """
SELECT count(*) AS total, round(avg(value)) AS avg_prediction, round(avg((event_id % 100) / 100), 3) AS avg_confidence,
 (SELECT event_type FROM events GROUP BY event_type ORDER BY count(*) DESC, event_type LIMIT 1) AS most_used FROM events""")
def p11(t):
    return d.prediction_summary(t.events, "value", F.col("event_id") % 100 / 100, "event_type")


@query("p12_daily_series", """
WITH last AS (SELECT max(CAST(ts AS DATE)) AS d FROM events), days AS (SELECT CAST(unnest(generate_series(d - INTERVAL 29 DAY, d, INTERVAL 1 DAY)) AS DATE) AS day FROM last)
SELECT day, count(event_id) AS n, round(avg(value), 2) AS avg_value FROM days LEFT JOIN events ON CAST(ts AS DATE) = day GROUP BY day""")
def p12(t):
    return d.daily_series(t.events, "ts", "value")
