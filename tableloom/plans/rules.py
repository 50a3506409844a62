"""N. Row validation with a valid / quarantine split."""

from pyspark.sql import functions as F

from ..functions import rules as r
from .registry import query

BLOCKED_SQL = "(" + " OR ".join("regexp_matches({x}, '(?i)" + p.replace("'", "''") + "')" for p in r.BLOCKED) + ")"


@query("n01_required", "SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN 'status' END AS field, CASE WHEN o_orderkey % 6 = 0 THEN 'is required' END AS message FROM orders")
def n01(t):
    x = F.when(F.col("o_orderkey") % 6 != 0, F.col("o_orderstatus"))
    e = r.present(x, "status")
    return t.orders.select("o_orderkey", e["field"].alias("field"), e["message"].alias("message"))


@query("n02_string_rule", f"""
SELECT p_partkey, CASE WHEN length(p_name) < 8 THEN 'must be at least 8 characters' WHEN length(p_name) > 12 THEN 'exceeds maximum length of 12 characters'
 WHEN NOT regexp_matches(p_name, '^(?:[a-r]+ )') THEN 'does not match required pattern' END AS message FROM part""")
def n02(t):
    e = r.string(8, 12, "[a-r]+ ")(F.col("p_name"), "name")
    return t.part.select("p_partkey", e["message"].alias("message"))


@query("n03_blocked_patterns", f"SELECT page_id, {BLOCKED_SQL.format(x='html')} AS bad_html, {BLOCKED_SQL.format(x='url')} AS bad_url FROM pages")
def n03(t):
    return t.pages.select("page_id", r.blocked(F.col("html")).alias("bad_html"), r.blocked(F.col("url")).alias("bad_url"))


@query("n04_number_rule", """
SELECT o_orderkey, CASE WHEN v IS NULL THEN 'must be a number' WHEN isnan(v) THEN 'must be a finite number' WHEN v < 2 THEN 'must be at least 2' WHEN v > 4 THEN 'must be at most 4' END AS message
FROM (SELECT o_orderkey, TRY_CAST(CASE o_orderkey % 4 WHEN 0 THEN left(o_orderpriority, 1) WHEN 1 THEN left(o_orderpriority, 3) WHEN 2 THEN 'NaN' ELSE left(o_orderpriority, 1) || '.5' END AS DOUBLE) AS v FROM orders)""")
def n04(t):
    k, p = F.col("o_orderkey") % 4, F.col("o_orderpriority")
    x = F.when(k == 0, F.left(p, F.lit(1))).when(k == 1, F.left(p, F.lit(3))).when(k == 2, F.lit("NaN")).otherwise(
        F.concat(F.left(p, F.lit(1)), F.lit(".5"))
    )
    return t.orders.select("o_orderkey", r.number(2, 4)(x, "priority")["message"].alias("message"))


@query("n05_array_rule", "SELECT vec_id, CASE WHEN len(list_filter(embedding, lambda x: abs(x) > 0.35)) > 0 THEN 'has an invalid item' END AS message FROM embeddings")
def n05(t):
    e = r.array(1, 64, lambda x: F.abs(x.cast("double")) <= 0.35)(F.col("embedding"), "embedding")
    return t.embeddings.select("vec_id", e["message"].alias("message"))


@query("n06_object_rule", """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'props.k' WHEN CAST(json_extract(props, '$.k') AS BIGINT) > 50 THEN 'props.k' END AS field,
 CASE WHEN event_id % 3 = 0 THEN 'is missing' WHEN CAST(json_extract(props, '$.k') AS BIGINT) > 50 THEN 'must be at most 50' END AS message FROM events""")
def n06(t):
    x = F.when(F.col("event_id") % 3 == 0, F.lit('{"other": 1}')).otherwise(F.col("props"))
    e = r.json_object({"k": r.number(0, 50)})(x, "props")
    return t.events.select("event_id", e["field"].alias("field"), e["message"].alias("message"))


@query("n07_enum_rule", "SELECT event_id, CASE WHEN event_type NOT IN ('click', 'view') THEN 'must be one of: click, view' END AS message FROM events")
def n07(t):
    return t.events.select("event_id", r.one_of(["click", "view"])(F.col("event_type"), "type")["message"].alias("message"))


_FLAGS = ['{"f": true}', '{"f": 1}', '{"f": "true"}', '{"g": false}', '{"f": false}']


@query("n08_strict_boolean", """SELECT event_id, CASE event_id % 5 WHEN 1 THEN 'must be a boolean' WHEN 2 THEN 'must be a boolean' WHEN 3 THEN 'is required' END AS message FROM events""")
def n08(t):
    x = F.element_at(F.array(*map(F.lit, _FLAGS)), (F.col("event_id") % 5 + 1).cast("int"))
    return t.events.select("event_id", r.strict_boolean("$.f")(x, "f")["message"].alias("message"))


@query("n09_feature_map", """
SELECT event_id, CASE event_id % 4 WHEN 1 THEN ['b'] WHEN 2 THEN ['a', 'c'] WHEN 3 THEN ['d'] ELSE []::VARCHAR[] END AS fields FROM events""")
def n09(t):
    k = F.col("event_id") % 4
    v = F.format_number("value", 2)
    x = (
        F.when(k == 0, F.concat(F.lit('{"a": '), F.col("value").cast("string"), F.lit(', "b": true, "c": "text"}')))
        .when(k == 1, F.lit('{"a": 1, "b": [1, 2]}'))
        .when(k == 2, F.lit('{"a": 1e11, "b": 2.5, "c": "<script>"}'))
        .otherwise(F.concat(F.lit('{"d": "'), F.repeat(F.lit("x"), 101), F.lit('"}')))
    )
    return t.events.select("event_id", F.transform(r.feature_map_errors(x), lambda e: e["field"]).alias("fields"))


@query("n10_training_size", "SELECT count(*) AS n, count(*) BETWEEN 10 AND 100000 AS trainable, count(*) <= 10000 AS within_request_cap FROM lineitem")
def n10(t):
    return r.training_size(t.lineitem)


@query("n11_identifier_rule", "SELECT page_id, CASE WHEN url IS NULL OR url = '' THEN 'is required' WHEN length(url) > 200 OR NOT regexp_matches(url, '^[A-Za-z0-9 ._:-]+$') THEN 'is not a valid identifier' END AS message FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN replace(url, '/', '.') ELSE '' END AS url FROM pages)")
def n11(t):
    k = F.col("page_id") % 3
    x = F.when(k == 0, F.col("url")).when(k == 1, F.replace("url", F.lit("/"), F.lit("."))).otherwise(F.lit(""))
    return t.pages.select("page_id", r.identifier(x, "url")["message"].alias("message"))


@query("n12_json_parse", "SELECT count(*) AS n, count(*) FILTER (WHERE json_valid(x)) AS valid, count(*) FILTER (WHERE NOT json_valid(x)) AS invalid FROM (SELECT CASE WHEN event_id % 7 = 0 THEN left(props, 5) ELSE props END AS x FROM events)")
def n12(t):
    df = t.events.select(F.when(F.col("event_id") % 7 == 0, F.left("props", F.lit(5))).otherwise(F.col("props")).alias("x"))
    out = r.parse_json(df, "x")
    bad = F.col("parse_error").isNotNull()
    return out.agg(F.count(F.lit(1)).alias("n"), F.count_if(~bad).alias("valid"), F.count_if(bad).alias("invalid"))


@query("n13_sanitise", """
SELECT page_id, replace(replace(replace(replace(replace(replace(replace(replace(html, '&', '&amp;'), '"', '&quot;'), '''', '&#x27;'), '<', '&lt;'), '>', '&gt;'), '/', '&#x2F;'), '\\', '&#x5C;'), '`', '&#96;') AS html,
 CASE WHEN page_id % 3 = 0 THEN 0.0 ELSE page_id::DOUBLE END AS number FROM pages""")
def n13(t):
    number = F.when(F.col("page_id") % 3 == 0, F.lit(float("inf"))).otherwise(F.col("page_id").cast("double"))
    return r.sanitise(t.pages.select("page_id", "html", number.alias("number")))


@query("n14_byte_cap", "SELECT doc_id, octet_length(encode(text)) AS bytes, CASE WHEN octet_length(encode(text)) > 4096 THEN 'exceeds 4096 bytes' END AS message FROM documents")
def n14(t):
    x = F.col("text")
    return t.documents.select("doc_id", F.octet_length(x).cast("bigint").alias("bytes"), r.byte_cap(4096)(x, "text")["message"].alias("message"))


_LINE_RULES = [
    ("l_quantity", F.col, r.number(1, 40)),
    ("l_discount", F.col, r.number(0.02, 1)),
    ("l_returnflag", F.col, r.one_of(["A", "N"])),
]


def line_rules():
    return [(name, make(name), rule) for name, make, rule in _LINE_RULES]


_ERRORS = "(CASE WHEN l_quantity < 1 OR l_quantity > 40 THEN 1 ELSE 0 END + CASE WHEN l_discount < 0.02 OR l_discount > 1 THEN 1 ELSE 0 END + CASE WHEN l_returnflag NOT IN ('A', 'N') THEN 1 ELSE 0 END)"


@query("n15_valid_rows", f"SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE {_ERRORS} = 0")
def n15(t):
    return r.split_rows(t.lineitem, line_rules())[0].select("l_orderkey", "l_linenumber", "l_quantity")


@query("n15_quarantined_rows", f"SELECT l_orderkey, l_linenumber, {_ERRORS}::BIGINT AS errors FROM lineitem WHERE {_ERRORS} > 0")
def n15_bad(t):
    bad = r.split_rows(t.lineitem, line_rules())[1]
    return bad.select("l_orderkey", "l_linenumber", F.size("errors").cast("bigint").alias("errors"))
