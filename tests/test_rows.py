"""Row rules, feature steps and datasets on small rows with known answers."""

import math

import pytest
from pyspark.sql import functions as F

from tableloom.functions import rules as r
from tableloom.functions import scalars as s
from tableloom.functions.predicates import split_terms, text_matches
from tableloom.operators import columns as c
from tableloom.operators import features as fe
from tableloom.operators import impute as im
from tableloom.operators.joins import to_ranges
from tableloom.operators.profile import quality_scores
from tableloom.sources import datasets as ds


def message(spark, value, rule, kind="string"):
    row = spark.createDataFrame([(value,)], f"x {kind}").select(rule(F.col("x"), "f")["message"].alias("m")).collect()[0]
    return row["m"]


@pytest.mark.parametrize("value,rule,kind,expected", [
    ("ok", r.string(), "string", None),
    (None, r.string(), "string", "is required"),
    (None, r.string(required=False), "string", None),
    ("ab", r.string(min_length=3), "string", "must be at least 3 characters"),
    ("abc", r.string(min_length=3, max_length=3), "string", None),
    ("abcd", r.string(max_length=3), "string", "exceeds maximum length of 3 characters"),
    ("x" * 1000, r.string(), "string", None),
    ("x" * 1001, r.string(), "string", "exceeds maximum length of 1000 characters"),
    ("abc1", r.string(pattern="[a-z]+"), "string", None),
    ("1abc", r.string(pattern="[a-z]+"), "string", "does not match required pattern"),
    ("IMPORT  os", r.string(), "string", "blocked pattern detected"),
    ("../../x", r.string(), "string", "blocked pattern detected"),
    ("..\\x", r.string(), "string", "blocked pattern detected"),
    ("see /etc/passwd", r.string(), "string", "blocked pattern detected"),
    ("<SCRIPT>", r.string(), "string", "blocked pattern detected"),
    ("evaluate", r.string(), "string", None),
    ("eval (1)", r.string(), "string", "blocked pattern detected"),
    ("12.5", r.number(), "string", None),
    ("twelve", r.number(), "string", "must be a number"),
    ("NaN", r.number(), "string", "must be a finite number"),
    ("Infinity", r.number(), "string", None),
    ("Infinity", r.number(high=10), "string", "must be at most 10"),
    ("5", r.number(5, 5), "string", None),
    ("4.9", r.number(5), "string", "must be at least 5"),
    ("5.9", r.number(high=5, whole=True), "string", None),
    ([1, 2], r.array(1, 2), "array<int>", None),
    ([], r.array(1), "array<int>", "must have at least 1 items"),
    ([1, 2, 3], r.array(0, 2), "array<int>", "exceeds maximum length of 2 items"),
    ([1, -2], r.array(item=lambda x: x > 0), "array<int>", "has an invalid item"),
    ("b", r.one_of(["a", "b"]), "string", None),
    ("z", r.one_of(["a", "b"]), "string", "must be one of: a, b"),
    ("model v1.0:a_b-c", r.identifier, "string", None),
    ("", r.identifier, "string", "is required"),
    ("a/b", r.identifier, "string", "is not a valid identifier"),
    ("x" * 201, r.identifier, "string", "is not a valid identifier"),
    ("é" * 3, r.byte_cap(5), "string", "exceeds 5 bytes"),
    ('{"f": false}', r.strict_boolean("$.f"), "string", None),
    ('{"f": 0}', r.strict_boolean("$.f"), "string", "must be a boolean"),
    ('{"g": 0}', r.strict_boolean("$.f"), "string", "is required"),
    ('{"g": 0}', r.strict_boolean("$.f", required=False), "string", None),
    ('{"a": 5}', r.json_object({"a": r.number(0, 9)}), "string", None),
    ('{"a": 50}', r.json_object({"a": r.number(0, 9)}), "string", "must be at most 9"),
    ('{"b": 5}', r.json_object({"a": r.number(0, 9)}), "string", "is missing"),
])
def test_rule(spark, value, rule, kind, expected):
    assert message(spark, value, rule, kind) == expected


def test_split_keeps_every_row(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(20)], "id int, x double")
    good, bad = r.split_rows(df, [("x", F.col("x"), r.number(5, 12))])
    assert sorted(x["id"] for x in good.collect()) == list(range(5, 13))
    assert good.count() + bad.count() == 20


def test_sanitise(spark):
    df = spark.createDataFrame([("<a href='x'>&", float("inf"), ["`b`"], [float("nan"), 1.5])], "t string, n double, l array<string>, v array<double>")
    row = r.sanitise(df).collect()[0]
    assert row["t"] == "&lt;a href=&#x27;x&#x27;&gt;&amp;"
    assert row["n"] == 0.0 and row["l"] == ["&#96;b&#96;"] and row["v"] == [0.0, 1.5]


def test_known_keys(spark):
    row = spark.range(1).select(r.known_keys(F.create_map(F.lit("a"), F.lit(1), F.lit("z"), F.lit(2)), ["a"]).alias("m")).collect()[0]
    assert row["m"] == {"a": 1}


def test_texts(spark):
    values = [0, 1, 1023, 1024, 1536, 1048576, 5 * 1024**4]
    got = [x["t"] for x in spark.createDataFrame([(v,) for v in values], "b long").select(s.byte_size_text(F.col("b")).alias("t")).collect()]
    assert got == ["0 Bytes", "1 Bytes", "1023 Bytes", "1 KB", "1.5 KB", "1 MB", "5 TB"]
    values = [None, 0, 999, 61_000, 3_723_000, 90_061_000]
    got = [x["t"] for x in spark.createDataFrame([(v,) for v in values], "b long").select(s.duration_text(F.col("b")).alias("t")).collect()]
    assert got == ["0s", "0s", "0s", "1m 1s", "1h 2m 3s", "1d 1h 1m"]


def test_search_terms(spark):
    assert split_terms("Market -demo-graphic  Data") == (["market", "data"], ["demo", "graphic"])
    df = spark.createDataFrame([(1, "The MARKET, up"), (2, "marketing"), (3, "market data"), (4, "écart market_x")], "id int, t string")
    assert [x["id"] for x in df.where(text_matches([F.col("t")], "market -data")).orderBy("id").collect()] == [1, 4]


def test_feature_steps(spark):
    df = spark.createDataFrame([(1, 1.0, 10.0, "b"), (2, 2.0, 20.0, "a"), (3, 4.0, 40.0, None), (4, 5.0, 50.0, "c")], "id int, a double, b double, k string")
    out, new = fe.add_polynomials(df, ["a", "b"])
    assert new == ["a^2", "a b", "b^2"]
    assert [x["a b"] for x in out.orderBy("id").collect()] == [10.0, 40.0, 160.0, 250.0]
    assert fe.add_polynomials(df, ["a", "b"], interaction_only=True)[1] == ["a b"]
    assert fe.add_polynomials(df, ["a", "b"], degree=3)[1] == ["a^2", "a b", "b^2", "a^3", "a^2 b", "a b^2", "b^3"]
    assert fe.add_logs(df.withColumn("z", F.col("a") - 1), ["a", "z"])[1] == ["a_log", "z_log1p"]
    assert fe.add_square_roots(df.withColumn("z", F.col("a") - 3), ["a", "z"])[1] == ["a_sqrt"]
    out, new = fe.add_dummies(df, ["k"])
    assert new == ["k_b", "k_c"]
    assert [(x["k_b"], x["k_c"]) for x in out.orderBy("id").collect()] == [(1, 0), (0, 0), (0, 0), (0, 1)]
    out, _ = fe.add_scaled(df.withColumn("one", F.lit(3.0)), ["a", "one"], "standard")
    row = out.agg(F.avg("a_standard").alias("m"), F.stddev_pop("a_standard").alias("s"), F.max("one_standard").alias("o")).collect()[0]
    assert row["m"] == pytest.approx(0) and row["s"] == pytest.approx(1) and row["o"] == 0
    assert [x["a_binned"] for x in fe.add_bins(df, ["a"], 4)[0].orderBy("id").collect()] == [0, 1, 3, 3]


def test_components_are_uncorrelated(spark):
    df = spark.range(200).select((F.col("id") % 17).cast("double").alias("a"), (F.col("id") % 17 * 2 + F.col("id") % 5).cast("double").alias("b"))
    out, new = fe.add_components(df, ["a", "b"])
    row = out.agg(F.corr(*new).alias("r"), F.avg(new[0]).alias("m")).collect()[0]
    assert abs(row["r"]) < 1e-9 and abs(row["m"]) < 1e-9


def test_fills_and_codes(spark):
    df = spark.createDataFrame([(1.0, "b"), (float("nan"), None), (3.0, "a"), (None, "b"), (float("inf"), "a")], "x double, k string")
    assert sorted(x["x"] for x in im.fill_median(df).collect()) == [1.0, 2.0, 2.0, 2.0, 3.0]
    assert im.modes(df, ["k"]) == {"k": "a"}
    codes = {x["k"]: x["code"] for x in im.category_codes(df, "k", plain_rows=0).collect()}
    assert codes == {"a": 0, "b": 1}


def test_column_roles(spark):
    df = spark.createDataFrame([(1, 2.0, "x")], "a int, price double, t string")
    assert c.detect_target(df) == "price"
    with pytest.raises(ValueError, match="zz"):
        c.select_features(df, ["a", "zz"])
    assert c.available_features(df) == ["a", "price"]
    assert c.task_type(df, "t") == "classification"


def test_ranges(spark):
    bands = spark.createDataFrame([("low", 0.0, 5.0), ("high", 10.0, None)], "label string, lo double, hi double")
    df = spark.createDataFrame([(v,) for v in (-1.0, 0.0, 4.9, 5.0, 10.0, 99.0)], "x double")
    got = [x["label"] for x in to_ranges(df, "x", bands, "lo", "hi", "label").orderBy("x").collect()]
    assert got == [None, "low", "low", None, "high", "high"]
    with pytest.raises(ValueError, match="overlap"):
        to_ranges(df, "x", spark.createDataFrame([("a", 0.0, 5.0), ("b", 3.0, 6.0)], "label string, lo double, hi double"), "lo", "hi", "label")


def test_quality(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (4, None)], "x int, k string")
    row = quality_scores(df, F.col("x") > 0, F.col("k").isNotNull()).collect()[0]
    assert (row["completeness"], row["validity"], row["uniqueness"], row["consistency"]) == (0.75, 0.75, 0.75, 0.75)


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "x,y", 2.5), (2, None, math.pi)], "a int, t string, v double")
    path = str(tmp_path / "out.csv")
    ds.write_csv(df, path)
    back = ds.read_csv(spark, [str(tmp_path / "absent"), path])
    assert [f.dataType.simpleString() for f in back.schema] == ["int", "string", "double"]
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    with pytest.raises(FileNotFoundError):
        ds.read_csv(spark, [str(tmp_path / "absent")])
    (tmp_path / "up").mkdir()
    (tmp_path / "up" / "Data.CSV").write_text("a\n1\n")
    (tmp_path / "up" / "tool.exe").write_text("x")
    files = ds.list_files(spark, str(tmp_path / "up"))
    ok = files.where(ds.accepted_upload(F.col("path"), F.col("length")))
    row = ds.catalog_rows(ok, "me").collect()
    assert [(x["name"], x["format"], x["file_size"]) for x in row] == [("Data", "csv", 4)]
    with pytest.raises(ValueError, match="unsupported"):
        ds.read_dataset(spark, "x.avro")


def test_step_errors_are_reported(spark):
    df = spark.createDataFrame([(1.0,), (2.0,)], "a double")
    done = fe.engineer(df, ["a"], ["log_transform", "nonsense", "statistical_features"])
    rows = {x["method"]: x for x in done.report().collect()}
    assert rows["nonsense"]["error"] and rows["statistical_features"]["error"] and not rows["log_transform"]["error"]
    assert done.features == ["a", "a_log"]
