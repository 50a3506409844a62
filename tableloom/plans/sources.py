"""A. Scans, sources and sinks."""

from pyspark.sql import functions as F

from ..functions.scalars import file_extension
from ..operators.scoring import linear_fit, predict_linear
from ..session import scratch_path
from ..sources import datasets as ds
from .registry import query


@query("a01_csv_scan", "SELECT count(*) AS n, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key, CAST(round(sum(o_totalprice), 2) AS DOUBLE) AS total FROM orders")
def a01(t):
    """CSV written and read back through the candidate-path reader with inferred types."""
    path = scratch_path(t.spark, "orders-csv")
    ds.write_csv(t.orders, path)
    df = ds.read_csv(t.spark, [path + "-absent", path])
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        F.min("o_orderkey").cast("bigint").alias("first_key"),
        F.max("o_orderkey").cast("bigint").alias("last_key"),
        F.round(F.sum("o_totalprice"), 2).alias("total"),
    )


@query("a02_json_scan", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def a02(t):
    path = scratch_path(t.spark, "orders-json")
    ds.write_json(t.orders.select("o_orderkey", "o_orderstatus"), path)
    df = ds.read_json(t.spark, path, "o_orderkey bigint, o_orderstatus string")
    return df.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("a03_parquet_scan", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45")
def a03(t):
    df = ds.read_dataset(t.spark, t.path("lineitem"))
    return df.filter("l_quantity > 45").select("l_orderkey", "l_linenumber", "l_quantity")


@query("a04_newest_capped", "SELECT o_orderkey, o_orderdate, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 500")
def a04(t):
    rows = t.orders.select("o_orderkey", "o_orderdate", "o_totalprice")
    return ds.newest(rows, "o_orderdate", ["o_orderkey"], limit=1000)


@query("a05_csv_sink", "SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal), 4) AS avg_balance FROM customer GROUP BY c_mktsegment")
def a05(t):
    path = scratch_path(t.spark, "customer-csv")
    ds.write_csv(t.customer, path)
    df = ds.read_csv(t.spark, path, t.customer.schema)
    return df.groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("c_acctbal"), 4).alias("avg_balance")
    )


@query("a06_json_export", "SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand")
def a06(t):
    path = scratch_path(t.spark, "part-json")
    ds.write_json(t.part, path)
    return ds.read_json(t.spark, path).groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))


@query("a07_dataset_catalog")
def a07(t):
    """Catalog rows of the table files themselves."""
    return ds.catalog_rows(ds.list_files(t.spark, t.folder, "*.parquet"), owner="user-1")


@query("a08_upload_filter", """
SELECT ext, count(*) AS n, count(*) FILTER (WHERE ext IN ('csv','json','xlsx','xls') AND size <= 10485760) AS accepted
FROM (SELECT lower(regexp_extract('/up/' || doc_id || (CASE doc_id % 4 WHEN 0 THEN '.CSV' WHEN 1 THEN '.json' WHEN 2 THEN '.exe' ELSE '.xlsx' END), '\\.([^./]+)$', 1)) AS ext,
             n_chars * 1000 AS size FROM documents) GROUP BY ext""")
def a08(t):
    kinds = F.element_at(F.array(*map(F.lit, [".CSV", ".json", ".exe", ".xlsx"])), (F.col("doc_id") % 4 + 1).cast("int"))
    files = t.documents.select(
        F.concat(F.lit("/up/"), F.col("doc_id").cast("string"), kinds).alias("path"),
        (F.col("n_chars") * 1000).alias("length"),
    )
    ok = ds.accepted_upload(F.col("path"), F.col("length"))
    return files.groupBy(file_extension(F.col("path")).alias("ext")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("accepted")
    )


@query("a09_prediction_sink", """
SELECT l_returnflag AS model_type, count(*) AS n, round(avg(c0 + c1 * l_quantity), 2) AS avg_point
FROM lineitem, (SELECT regr_slope(l_extendedprice, l_quantity) AS c1, regr_intercept(l_extendedprice, l_quantity) AS c0 FROM lineitem)
GROUP BY l_returnflag""")
def a09(t):
    """Scored rows appended to the partitioned prediction store, read back by model type."""
    fit = linear_fit(t.lineitem, ["l_quantity"], "l_extendedprice")
    scored = predict_linear(t.lineitem, fit).withColumns(
        {"lower": F.col("prediction") * 0.9, "upper": F.col("prediction") * 1.1}
    )
    importance = F.array(F.struct(F.lit("l_quantity").alias("feature"), F.lit(1.0).alias("importance")))
    rows = ds.prediction_rows(scored, F.col("l_returnflag"), ["l_quantity"], importance, 0.95, F.col("l_shipdate"))
    path = scratch_path(t.spark, "predictions")
    ds.append_predictions(rows, path)
    stored = t.spark.read.parquet(path)
    return stored.groupBy("model_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("prediction.point_estimate"), 2).alias("avg_point")
    )


@query("a10_run_sink", "SELECT 'linear_regression' AS algorithm, count(*) AS sample_size, ['l_quantity'] AS features, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2_score FROM lineitem")
def a10(t):
    """A run row (hyperparameters, metrics, features) appended to the runs table."""
    fit = linear_fit(t.lineitem, ["l_quantity"], "l_extendedprice")
    scored = predict_linear(t.lineitem, fit)
    from ..functions.metrics import regression_metrics

    run = scored.agg(
        F.lit("linear_regression").alias("algorithm"),
        F.count(F.lit(1)).alias("sample_size"),
        F.array(F.lit("l_quantity")).alias("features"),
        F.create_map(F.lit("fit_intercept"), F.lit("true")).alias("hyperparameters"),
        F.round(regression_metrics("l_extendedprice", "prediction")["r2"], 6).alias("r2_score"),
    )
    path = scratch_path(t.spark, "runs")
    ds.append_run(run, path)
    return t.spark.read.parquet(path).select("algorithm", "sample_size", "features", "r2_score")
