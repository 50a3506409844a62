"""Reading, listing and writing datasets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.scalars import file_extension

# Accepted upload extensions, the size cap and the read limits.
UPLOAD_EXTENSIONS = ("csv", "json", "xlsx", "xls")
UPLOAD_BYTES = 10 * 1024 * 1024
DEFAULT_READ, MAX_READ = 100, 500


def first_existing(spark: SparkSession, candidates: Sequence[str]) -> str:
    """The first candidate path that exists on its own file system (local, HDFS, object store)."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for candidate in candidates:
        path = hadoop(candidate)
        if path.getFileSystem(conf).exists(path):
            return candidate
    raise FileNotFoundError(f"none of {list(candidates)} exists")


def read_csv(spark: SparkSession, candidates: str | Sequence[str], schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header; without a schema the types are inferred (one more pass)."""
    paths = [candidates] if isinstance(candidates, str) else list(candidates)
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    return reader.csv(first_existing(spark, paths))


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None, multi_line: bool = False) -> DataFrame:
    reader = spark.read.option("multiLine", multi_line)
    return (reader.schema(schema) if schema else reader).json(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


READERS = {"csv": read_csv, "json": read_json, "parquet": read_parquet}


def read_dataset(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Read by format name, or by the extension of the path."""
    kind = (kind or path.rsplit(".", 1)[-1]).lower()
    if kind not in READERS:
        raise ValueError(f"unsupported format {kind}")
    return READERS[kind](spark, path)


def newest(df: DataFrame, at: str, key: Sequence[str], limit: int = DEFAULT_READ, cap: int = MAX_READ) -> DataFrame:
    """Newest rows first, at most ``cap`` of them; a top-k, not a full sort."""
    return df.orderBy(F.desc(at), *key).limit(min(limit, cap))


def list_files(spark: SparkSession, folder: str, pattern: str | None = None) -> DataFrame:
    """Path, length and time of every file below a folder; contents are never read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(folder).select("path", "length", "modificationTime")


def accepted_upload(path: Column, length: Column) -> Column:
    """Allowed extension (any case) and size within the cap."""
    return file_extension(path).isin(*UPLOAD_EXTENSIONS) & (length <= UPLOAD_BYTES)


def catalog_rows(files: DataFrame, owner: str, description: str = "") -> DataFrame:
    """One catalog row per listed file."""
    file_name = F.regexp_extract("path", r"([^/]+)$", 1)
    return files.select(
        F.regexp_replace(file_name, r"\.[^.]+$", "").alias("name"),
        F.lit(description).alias("description"),
        F.col("path").alias("file_path"),
        F.col("length").alias("file_size"),
        file_extension(F.col("path")).alias("format"),
        F.lit(owner).alias("uploaded_by"),
        F.col("modificationTime").alias("created_at"),
    )


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def prediction_rows(scored: DataFrame, model_type: str | Column, features: Sequence[str], importance: Column, level: float, at: Column) -> DataFrame:
    """Scored rows (prediction, lower, upper) in the stored prediction shape."""
    pairs = [x for f in features for x in (F.lit(f), F.col(f).cast("double"))]
    kind = F.lit(model_type) if isinstance(model_type, str) else model_type
    return scored.select(
        F.create_map(*pairs).alias("property_features"),
        kind.alias("model_type"),
        F.struct(
            F.col("prediction").alias("point_estimate"),
            F.col("lower").alias("lower_bound"),
            F.col("upper").alias("upper_bound"),
            F.lit(level).alias("confidence_level"),
        ).alias("prediction"),
        importance.alias("feature_importance"),
        at.alias("created_at"),
    )


def append_predictions(rows: DataFrame, path: str) -> None:
    """Append to the prediction store, laid out by model type."""
    rows.write.mode("append").partitionBy("model_type").parquet(path)


def append_run(run: DataFrame, path: str) -> None:
    """Append model-run metadata to the runs table."""
    run.write.mode("append").parquet(path)
