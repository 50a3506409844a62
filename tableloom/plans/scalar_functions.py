"""U. Scalar functions."""

from pyspark.sql import functions as F

from ..functions import scalars as s
from .registry import query


@query("u01_math", "SELECT l_orderkey, round(ln(l_quantity), 8) AS lg, round(ln(1 + l_tax), 8) AS lg1, round(sqrt(l_extendedprice), 8) AS root, round(power(l_quantity, 2), 4) AS square FROM lineitem")
def u01(t):
    x = F.col("l_quantity")
    return t.lineitem.select(
        "l_orderkey", F.round(F.log(x), 8).alias("lg"), F.round(F.log1p("l_tax"), 8).alias("lg1"),
        F.round(F.sqrt("l_extendedprice"), 8).alias("root"), F.round(F.pow(x, 2), 4).alias("square"),
    )


@query("u02_clamp", "SELECT c_custkey, greatest(0.0::DOUBLE, least(5000.0::DOUBLE, c_acctbal)) AS clamped FROM customer")
def u02(t):
    return t.customer.select("c_custkey", s.clamp(F.col("c_acctbal"), 0, 5000).alias("clamped"))


@query("u03_rounding", "SELECT o_orderkey, CAST(round(o_totalprice) AS BIGINT) AS whole, round(o_custkey / 4, 1) AS tenth, CAST(round_even(o_custkey / 2, 0) AS BIGINT) AS even FROM orders")
def u03(t):
    return t.orders.select(
        "o_orderkey", F.round("o_totalprice").cast("bigint").alias("whole"),
        F.round(F.col("o_custkey") / 4, 1).alias("tenth"), F.bround(F.col("o_custkey") / 2, 0).cast("bigint").alias("even"),
    )


@query("u04_buckets", """
SELECT o_orderkey, CAST(floor(o_totalprice / 500) * 500 AS BIGINT) AS low, CAST(floor(o_totalprice / 500) * 500 AS BIGINT) || '-' || CAST(floor(o_totalprice / 500) * 500 + 500 AS BIGINT) AS band,
 CAST(floor(year(o_orderdate) / 10) * 10 AS BIGINT) || 's' AS decade FROM orders""")
def u04(t):
    x = F.col("o_totalprice")
    return t.orders.select(
        "o_orderkey", s.step_floor(x, 500).alias("low"), s.range_label(x, 500).alias("band"),
        s.decade_label(F.year("o_orderdate")).alias("decade"),
    )


@query("u05_norms", """
SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm,
 round(abs(embedding[1]::DOUBLE - embedding[2]::DOUBLE), 6) AS gap FROM embeddings""")
def u05(t):
    e = F.transform("embedding", lambda x: x.cast("double"))
    return t.embeddings.select("vec_id", F.round(s.l2_norm(e), 6).alias("norm"), F.round(F.abs(e[0] - e[1]), 6).alias("gap"))


@query("u06_strings", "SELECT p_partkey, lower(p_brand) AS low, trim('  ' || p_name || ' ') AS trimmed, upper(p_name) AS up, regexp_replace(p_name, ' ', '_') AS swapped, p_name LIKE 'red%' AS is_red, length(p_name) AS n FROM part")
def u06(t):
    return t.part.select(
        "p_partkey", F.lower("p_brand").alias("low"), F.trim(F.concat(F.lit("  "), "p_name", F.lit(" "))).alias("trimmed"),
        F.upper("p_name").alias("up"), F.regexp_replace("p_name", r"^([^ ]*) ", "$1_").alias("swapped"),
        F.col("p_name").startswith("red").alias("is_red"), F.length("p_name").cast("bigint").alias("n"),
    )


@query("u07_regex", r"SELECT page_id, regexp_matches(url, '^https://') AS at_start, regexp_matches(url, 'page=\d+') AS anywhere, regexp_full_match(url, 'https?://[A-Za-z.]+/en/\d+.*') AS whole FROM pages")
def u07(t):
    u = F.col("url")
    return t.pages.select(
        "page_id", u.rlike("^https://").alias("at_start"), u.rlike(r"page=\d+").alias("anywhere"),
        u.rlike(r"^(?:https?://[A-Za-z.]+/en/\d+.*)$").alias("whole"),
    )


@query("u08_extension", r"SELECT page_id, lower(regexp_extract(url || '/File.' || upper(left(html, 0)) || CASE page_id % 3 WHEN 0 THEN 'CSV' WHEN 1 THEN 'tar.gz' ELSE 'parquet' END, '\.([^./]+)$', 1)) AS ext FROM pages")
def u08(t):
    kinds = F.element_at(F.array(F.lit("CSV"), F.lit("tar.gz"), F.lit("parquet")), (F.col("page_id") % 3 + 1).cast("int"))
    return t.pages.select("page_id", s.file_extension(F.concat("url", F.lit("/File."), kinds)).alias("ext"))


@query("u09_byte_text", """
WITH b AS (SELECT doc_id, n_chars * n_chars * (doc_id % 5) AS b FROM documents),
v AS (SELECT doc_id, b, CASE WHEN b < 1024 THEN 0 WHEN b < 1048576 THEN 1 WHEN b < 1073741824 THEN 2 WHEN b < 1099511627776 THEN 3 ELSE 4 END AS i FROM b)
SELECT doc_id, CASE WHEN b = 0 THEN '0 Bytes' ELSE regexp_replace(CAST(CAST(round(b / power(1024, i), 2) AS DECIMAL(28,2)) AS VARCHAR), '\\.?0+$', '') || ' ' || (['Bytes', 'KB', 'MB', 'GB', 'TB'])[i + 1] END AS size FROM v""")
def u09(t):
    b = F.col("n_chars") * F.col("n_chars") * (F.col("doc_id") % 5)
    return t.documents.select("doc_id", s.byte_size_text(b).alias("size"))


@query("u10_duration_text", """
WITH d AS (SELECT o_orderkey, CAST(o_totalprice * (o_orderkey % 5) * 200 AS BIGINT) // 1000 AS s FROM orders)
SELECT o_orderkey, CASE WHEN s // 86400 > 0 THEN (s // 86400) || 'd ' || (s // 3600 % 24) || 'h ' || (s // 60 % 60) || 'm'
 WHEN s // 3600 > 0 THEN (s // 3600) || 'h ' || (s // 60 % 60) || 'm ' || (s % 60) || 's' WHEN s // 60 > 0 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE s || 's' END AS duration FROM d""")
def u10(t):
    ms = F.round(F.col("o_totalprice") * (F.col("o_orderkey") % 5) * 200).cast("bigint")
    return t.orders.select("o_orderkey", s.duration_text(ms).alias("duration"))


@query("u11_currency_text", "SELECT c_custkey, (CASE WHEN c_acctbal < 0 THEN '-$' ELSE '$' END) || format('{:,}', CAST(round(abs(c_acctbal)) AS BIGINT)) AS amount FROM customer")
def u11(t):
    return t.customer.select("c_custkey", s.currency_text(F.col("c_acctbal")).alias("amount"))


@query("u12_sha256", "SELECT doc_id, sha256(text) AS digest FROM documents")
def u12(t):
    return t.documents.select("doc_id", F.sha2("text", 256).alias("digest"))


@query("u13_dates", """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(day(o_orderdate) AS INTEGER) AS d,
 CAST(datediff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS since, CAST(CAST(o_orderdate AS DATE) + 30 AS DATE) AS due FROM orders""")
def u13(t):
    day = F.to_date("o_orderdate")
    return t.orders.select(
        "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("iso"), F.year(day).alias("y"), F.month(day).alias("m"),
        F.dayofmonth(day).alias("d"), F.datediff(day, F.to_date(F.lit("1995-01-01"))).alias("since"), F.date_add(day, 30).alias("due"),
    )


@query("u14_elapsed_ms", "SELECT event_id, (epoch_us(ts) - epoch_us(date_trunc('day', ts))) // 1000 AS ms FROM events")
def u14(t):
    return t.events.select("event_id", s.elapsed_ms(F.date_trunc("day", "ts"), F.col("ts")).alias("ms"))


@query("u15_arrays", """
SELECT vec_id, len(embedding) AS n, list_transform(embedding[1:3], lambda x: round(x::DOUBLE * 100, 3)) AS head, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS total,
 list_contains(list_transform(embedding, lambda x: x > 0.3), true) AS has_big, list_reverse(list_transform(embedding[1:2], lambda x: round(x::DOUBLE, 4))) AS back FROM embeddings""")
def u15(t):
    e = F.transform("embedding", lambda x: x.cast("double"))
    return t.embeddings.select(
        "vec_id", F.size(e).cast("bigint").alias("n"), F.transform(F.slice(e, 1, 3), lambda x: F.round(x * 100, 3)).alias("head"),
        F.round(F.aggregate(e, F.lit(0.0), lambda a, x: a + x), 6).alias("total"),
        F.array_contains(F.transform("embedding", lambda x: x.cast("double") > 0.3), True).alias("has_big"),
        F.reverse(F.transform(F.slice(e, 1, 2), lambda x: F.round(x, 4))).alias("back"),
    )


@query("u16_map_entries", "SELECT l_orderkey, l_linenumber, ['quantity', 'tax'] AS names, [l_quantity, l_tax] AS weights, l_tax AS tax FROM lineitem")
def u16(t):
    m = F.map_from_arrays(F.array(F.lit("quantity"), F.lit("tax")), F.array("l_quantity", "l_tax"))
    df = t.lineitem.withColumn("entries", s.map_to_entries(m, "feature", "importance"))
    back = s.entries_to_map(F.col("entries"), "feature", "importance")
    return df.select(
        "l_orderkey", "l_linenumber", F.col("entries.feature").alias("names"), F.col("entries.importance").alias("weights"), back["tax"].alias("tax")
    )


@query("u17_json", """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '{"k":' || json_extract_string(props, '$.k') || ',"u":' || user_id || '}' AS text FROM events""")
def u17(t):
    k = F.from_json("props", "k bigint")["k"]
    m = F.create_map(F.lit("u"), F.col("user_id"), F.lit("k"), k)
    return t.events.select("event_id", k.alias("k"), s.sorted_map_json(m).alias("text"))


@query("u18_defaults", "SELECT l_orderkey, coalesce(nullif(l_tax, 0), nullif(l_discount, 0), 0.5::DOUBLE) AS v FROM lineitem")
def u18(t):
    zero = F.lit(0.0)
    return t.lineitem.select(
        "l_orderkey", F.coalesce(F.nullif(F.col("l_tax"), zero), F.nullif(F.col("l_discount"), zero), F.lit(0.5)).alias("v")
    )


@query("u19_safe_division", "SELECT l_orderkey, CASE WHEN l_tax = 0 THEN NULL ELSE l_discount / l_tax END AS ratio, CASE WHEN l_tax = 0 THEN 0 ELSE round((l_discount - l_tax) / l_tax * 100, 6) END AS change FROM lineitem")
def u19(t):
    return t.lineitem.select(
        "l_orderkey", F.try_divide("l_discount", "l_tax").alias("ratio"),
        F.round(s.percent_change(F.col("l_discount"), F.col("l_tax")), 6).alias("change"),
    )


@query("u20_labels", """
SELECT l_orderkey, CASE WHEN l_tax < 0.02 THEN 'negligible' WHEN l_tax < 0.05 THEN 'small' WHEN l_tax < 0.08 THEN 'medium' ELSE 'large' END AS size,
 CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'R' THEN 'returned' ELSE 'none' END AS state FROM lineitem""")
def u20(t):
    return t.lineitem.select(
        "l_orderkey", s.label_by(F.col("l_tax"), [(0.02, "negligible"), (0.05, "small"), (0.08, "medium")], "large").alias("size"),
        s.lookup(F.col("l_returnflag"), {"A": "accepted", "R": "returned"}, "none").alias("state"),
    )


@query("u21_numeric_tests", """
SELECT o_orderkey, TRY_CAST(left(o_orderpriority, 1 + (o_orderkey % 2)::INTEGER) AS DOUBLE) AS number, TRY_CAST(left(o_orderpriority, 1 + (o_orderkey % 2)::INTEGER) AS DOUBLE) IS NOT NULL AS is_number FROM orders""")
def u21(t):
    text = F.left("o_orderpriority", (1 + F.col("o_orderkey") % 2).cast("int"))
    number = s.finite_or_null(text.try_cast("double"))
    return t.orders.select("o_orderkey", number.alias("number"), number.isNotNull().alias("is_number"))
