"""O. Profiling and data quality."""

from pyspark.sql import functions as F

from ..operators import profile as pr
from .registry import query


def _profile_sql(table, columns):
    parts = []
    for c, kind, numeric in columns:
        stats = (
            f"round(avg({c}), 4), round(stddev_samp({c}), 4), CAST(min({c}) AS DOUBLE), CAST(max({c}) AS DOUBLE)"
            if numeric
            else "NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE"
        )
        parts.append(
            f"SELECT '{c}' AS name, '{kind}' AS type, true AS nullable, count(DISTINCT {c}) AS unique_values, "
            f"count(*) FILTER (WHERE {c} IS NULL) AS missing_count, {stats} FROM {table}"
        )
    first = parts[0].replace("NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE FROM", "NULL::DOUBLE AS mean, NULL::DOUBLE AS std, NULL::DOUBLE AS min, NULL::DOUBLE AS max FROM")
    parts[0] = first
    return " UNION ALL ".join(parts)


@query("o01_column_profile", _profile_sql("(SELECT o_orderstatus, nullif(o_totalprice, 0) AS o_totalprice, o_custkey, CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority FROM orders)", [("o_orderstatus", "string", False), ("o_totalprice", "double", True), ("o_custkey", "bigint", True), ("o_orderpriority", "string", False)]))
def o01(t):
    df = t.orders.select(
        "o_orderstatus", F.nullif(F.col("o_totalprice"), F.lit(0.0)).alias("o_totalprice"), "o_custkey",
        F.when(F.col("o_custkey") % 7 != 0, F.col("o_orderpriority")).alias("o_orderpriority"),
    )
    return pr.column_profile(df).withColumns({c: F.round(c, 4) for c in ("mean", "std")})


@query("o02_quality_scores", """
WITH d AS (SELECT l_quantity, l_discount, nullif(l_tax, 0) AS l_tax, l_returnflag FROM lineitem)
SELECT round((count(l_quantity) + count(l_discount) + count(l_tax) + count(l_returnflag)) / (count(*) * 4), 6) AS completeness,
 round(count(*) FILTER (WHERE l_quantity BETWEEN 1 AND 40) / count(*), 6) AS validity,
 round((SELECT count(*) FROM (SELECT DISTINCT * FROM d)) / count(*), 6) AS uniqueness,
 round(count(*) FILTER (WHERE l_discount >= l_tax) / count(*), 6) AS consistency FROM d""")
def o02(t):
    df = t.lineitem.select("l_quantity", "l_discount", F.nullif(F.col("l_tax"), F.lit(0.0)).alias("l_tax"), "l_returnflag")
    return pr.quality_scores(df, F.col("l_quantity").between(1, 40), F.col("l_discount") >= F.col("l_tax"))


@query("o03_duplicates", "SELECT text, lang, count(*) AS copies FROM documents GROUP BY text, lang HAVING count(*) > 1")
def o03(t):
    return pr.duplicate_groups(t.documents.select("text", "lang"), ["text", "lang"])


@query("o03_keep_first", "SELECT l_partkey, l_quantity, min(l_orderkey * 10 + l_linenumber) AS row_key FROM lineitem GROUP BY l_partkey, l_quantity")
def o03_keep(t):
    df = t.lineitem.select("l_partkey", "l_quantity", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_key"))
    return pr.keep_first(df, ["l_partkey", "l_quantity"], "row_key")


@query("o04_missing_report", """
WITH d AS (SELECT nullif(l_discount, 0) AS l_discount, nullif(l_tax, 0) AS l_tax, l_quantity FROM lineitem)
SELECT 'l_discount' AS name, count(*) - count(l_discount) AS missing, round((count(*) - count(l_discount)) / count(*) * 100, 4) AS percent FROM d
UNION ALL SELECT 'l_tax', count(*) - count(l_tax), round((count(*) - count(l_tax)) / count(*) * 100, 4) FROM d
UNION ALL SELECT 'l_quantity', count(*) - count(l_quantity), round((count(*) - count(l_quantity)) / count(*) * 100, 4) FROM d""")
def o04(t):
    zero = F.lit(0.0)
    df = t.lineitem.select(
        F.nullif(F.col("l_discount"), zero).alias("l_discount"), F.nullif(F.col("l_tax"), zero).alias("l_tax"), "l_quantity"
    )
    return pr.missing_report(df)


def _outlier_sql(c, table):
    return f"""SELECT '{c}' AS name, count(*) FILTER (WHERE abs({c} - m) / s > 3) AS z_outliers, count(*) FILTER (WHERE {c} < lo OR {c} > hi) AS iqr_outliers,
 round(any_value(lo), 4) AS lower_fence, round(any_value(hi), 4) AS upper_fence FROM {table},
 (SELECT avg({c}) AS m, stddev_pop({c}) AS s, quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS lo,
  quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS hi FROM {table})"""


@query("o05_outlier_report", _outlier_sql("value", "events") + " UNION ALL " + _outlier_sql("w", "(SELECT value * value AS w FROM events)"))
def o05(t):
    df = t.events.select("value", (F.col("value") * F.col("value")).alias("w"))
    return pr.outlier_report(df, ["value", "w"])


@query("o06_dataset_summary", """
SELECT count(*) AS total_records, CAST(11 AS BIGINT) AS column_count, round(avg(l_extendedprice), 4) AS mean_price, round(median(l_extendedprice), 4) AS median_price,
 min(l_extendedprice) AS min_price, max(l_extendedprice) AS max_price, round(stddev_samp(l_extendedprice), 4) AS std_price,
 CAST(min(l_quantity) AS BIGINT) || '-' || CAST(max(l_quantity) AS BIGINT) AS l_quantity_range, min(l_linenumber) || '-' || max(l_linenumber) AS l_linenumber_range FROM lineitem""")
def o06(t):
    return pr.dataset_summary(t.lineitem, "l_extendedprice", ["l_quantity", "l_linenumber"])


@query("o07_table_counts", "SELECT 'orders' AS table_name, count(*) AS rows FROM orders UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'events', count(*) FROM events")
def o07(t):
    return pr.table_counts({n: getattr(t, n) for n in ("orders", "customer", "events")})


@query("o08_descriptive", """
WITH d AS (SELECT 'l_quantity' AS name, l_quantity AS x FROM lineitem UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM lineitem),
m AS (SELECT name, avg(x) AS mu, stddev_pop(x) AS sp FROM d GROUP BY name)
SELECT name, count(x) AS n, round(avg(x), 4) AS mean, round(stddev_samp(x), 4) AS std, round(quantile_cont(x, 0.25), 4) AS q25, round(median(x), 4) AS q50, round(quantile_cont(x, 0.75), 4) AS q75,
 round(avg(power((x - mu) / sp, 3)), 4) AS skewness, round(avg(power((x - mu) / sp, 4)) - 3, 4) AS kurtosis,
 round(avg(x) - 1.96 * stddev_samp(x) / sqrt(count(x)), 4) AS ci_low, round(avg(x) + 1.96 * stddev_samp(x) / sqrt(count(x)), 4) AS ci_high
FROM d JOIN m USING (name) GROUP BY name""")
def o08(t):
    return pr.descriptive(t.lineitem, ["l_quantity", "l_extendedprice"])


_CORR = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("o09_correlation_matrix", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for a in _CORR for b in _CORR))
def o09(t):
    return pr.correlations(t.lineitem, _CORR).withColumn("r", F.round("r", 6))


@query("o09_rank_correlation", """
WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS a,
 rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2 AS b FROM lineitem)
SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, round(corr(a, b), 6) AS r FROM r UNION ALL SELECT 'l_extendedprice', 'l_quantity', round(corr(a, b), 6) FROM r
UNION ALL SELECT 'l_quantity', 'l_quantity', 1.0::DOUBLE UNION ALL SELECT 'l_extendedprice', 'l_extendedprice', 1.0::DOUBLE""")
def o09_rank(t):
    return pr.spearman(t.lineitem, ["l_quantity", "l_extendedprice"]).withColumn("r", F.round("r", 6))


@query("o10_histogram", """
WITH s AS (SELECT min(value) AS lo, max(value) AS hi, (max(value) - min(value)) / 10 AS w FROM events),
b AS (SELECT CAST(least(floor((value - lo) / ((hi - lo) / 10)), 9) AS BIGINT) AS bin FROM events, s)
SELECT i AS bin, round(lo + i * w, 4) AS low, round(lo + (i + 1) * w, 4) AS high, (SELECT count(*) FROM b WHERE b.bin = i) AS n FROM s, range(10) r(i)""")
def o10(t):
    return pr.value_histogram(t.events, "value")


@query("o10_normal_distance", "SELECT * FROM (VALUES ('logistic', true), ('two points', true)) v(sample, within_bounds)")
def o10_ks(t):
    """Known distances: the logistic distribution lies 0.02 from its normal, two equal points 0.34."""
    from ..operators.windows import with_position

    ranked = with_position(t.events.select("event_id"), ["event_id"], name="at").withColumn("u", (F.col("at") + 0.5) / F.lit(t.events.count()))
    out = None
    for name, value, low, high in (("logistic", F.log(F.col("u") / (1 - F.col("u"))), 0.012, 0.032), ("two points", (F.col("u") > 0.5).cast("double"), 0.32, 0.36)):
        one = pr.normal_distance(ranked.withColumn("v", value), "v").select(F.lit(name).alias("sample"), F.col("ks_distance").between(low, high).alias("within_bounds"))
        out = one if out is None else out.unionByName(one)
    return out


@query("o11_filter_importance", """
WITH c AS (SELECT 'l_quantity' AS feature, abs(corr(l_quantity, l_extendedprice)) AS r, count(*) AS n FROM lineitem
 UNION ALL SELECT 'l_discount', abs(corr(l_discount, l_extendedprice)), count(*) FROM lineitem UNION ALL SELECT 'l_tax', abs(corr(l_tax, l_extendedprice)), count(*) FROM lineitem)
SELECT feature, round(r, 6) AS importance, round(r * r / (1 - r * r) * (n - 2), 2) AS f_score FROM c""")
def o11(t):
    out = pr.filter_importance(t.lineitem, ["l_quantity", "l_discount", "l_tax"], "l_extendedprice")
    return out.select("feature", F.round("importance", 6).alias("importance"), F.round("f_score", 2).alias("f_score"))


_DIMENSIONS = ("l_quantity", "l_discount", "l_tax", "l_extendedprice")


@query("o12_dimensions_pca", "SELECT count(*) AS n, true AS uncorrelated, true AS widest_first FROM lineitem")
def o12_pca(t):
    """The first component is at least as wide as every column."""
    out = pr.reduce_dimensions(t.lineitem, _DIMENSIONS, "pca", 2, ["l_orderkey", "l_linenumber"])
    widest = max(t.lineitem.agg(*[F.var_pop(c) for c in _DIMENSIONS]).first())
    return out.agg(
        F.count(F.lit(1)).alias("n"), (F.abs(F.corr("component_1", "component_2")) < 1e-6).alias("uncorrelated"),
        ((F.var_pop("component_1") >= widest * (1 - 1e-9)) & (F.var_pop("component_1") >= F.var_pop("component_2"))).alias("widest_first"),
    )


@query("o12_dimensions_ica", "SELECT count(*) AS n, true AS sources_found FROM lineitem")
def o12_ica(t):
    """Two mixed sources come apart: each component goes with one of them."""
    q, d = F.col("l_quantity") / 14.4, F.pow(F.col("l_discount") * 30, 3)
    mixed = t.lineitem.select("l_orderkey", "l_linenumber", q.alias("first"), d.alias("second"), (q + 0.3 * d).alias("a"), (0.5 * q - d).alias("b"))
    out = pr.reduce_dimensions(mixed, ("a", "b"), "ica", 2, ["l_orderkey", "l_linenumber", "first", "second"])
    found = [F.greatest(F.abs(F.corr("component_1", s)), F.abs(F.corr("component_2", s))) > 0.95 for s in ("first", "second")]
    return out.agg(F.count(F.lit(1)).alias("n"), (found[0] & found[1]).alias("sources_found"))


@query("o12_dimensions_factors", "SELECT count(*) AS n, true AS factor_found FROM lineitem")
def o12_fa(t):
    """One hidden column behind four noisy ones comes back as the factor."""
    noise = [F.col("l_discount") * 100, F.col("l_tax") * 120, F.col("l_linenumber") * 2.0, (F.col("l_orderkey") % 11).cast("double")]
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", *[(F.col("l_quantity") + x).alias(f"x{i}") for i, x in enumerate(noise)])
    out = pr.reduce_dimensions(rows, ("x0", "x1", "x2", "x3"), "factor_analysis", 1, ["l_orderkey", "l_linenumber", "l_quantity"])
    return out.agg(F.count(F.lit(1)).alias("n"), (F.abs(F.corr("component_1", "l_quantity")) > 0.95).alias("factor_found"))


@query("o13_seasonal_parts", """
WITH d AS (SELECT CAST(ts AS DATE) AS day, sum(value) AS v FROM events GROUP BY 1),
t AS (SELECT day, v, CASE WHEN count(v) OVER w = 7 THEN avg(v) OVER w END AS trend, datediff('day', DATE '1970-01-01', day) % 7 AS season FROM d WINDOW w AS (ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
s AS (SELECT season, avg(v - trend) AS seasonal FROM t WHERE trend IS NOT NULL GROUP BY season)
SELECT day, round(v, 4) AS v, round(trend, 4) AS trend, season, round(seasonal, 4) AS seasonal, round(v - trend - seasonal, 4) AS remainder FROM t LEFT JOIN s USING (season)""")
def o13(t):
    daily = t.events.groupBy(F.to_date("ts").alias("day")).agg(F.sum("value").alias("v"))
    out = pr.seasonal_parts(daily, "day", "v")
    return out.select("day", "season", *[F.round(c, 4).alias(c) for c in ("v", "trend", "seasonal", "remainder")])
