"""Reading a table as a stream and running a stream over what is there now."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..session import scratch_path


def replay(spark: SparkSession, folder: str, file_glob: str, ts: str = "ts", files_per_batch: int = 1000) -> DataFrame:
    """Parquet files of a folder as a stream; a zone-less event time becomes a timestamp,
    which watermarks need."""
    schema = spark.read.option("pathGlobFilter", file_glob).parquet(folder).schema
    rows = (
        spark.readStream.schema(schema).option("pathGlobFilter", file_glob).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    )
    if isinstance(schema[ts].dataType, T.TimestampNTZType):
        rows = rows.withColumn(ts, F.col(ts).cast("timestamp"))
    return rows


def run_now(stream: DataFrame, name: str, mode: str = "append", path: str | None = None) -> DataFrame:
    """Process everything available, then return the result as a table.

    Appended rows go straight to files. With ``update`` or ``complete`` every micro-batch
    writes its own folder, and the last state is read back (for ``update`` with the batch
    number in ``_batch``, so that the latest row of a key can be taken).
    """
    spark = stream.sparkSession
    base = path or scratch_path(spark, name)
    out, log = f"{base}/rows", f"{base}/log"
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", log).queryName(f"{name}_{abs(hash(base))}")
    if mode == "append":
        query = writer.outputMode("append").format("parquet").start(out)
        query.awaitTermination()
        return spark.read.schema(stream.schema).parquet(out)
    seen: list[int] = []

    def write(rows: DataFrame, batch: int) -> None:
        seen.append(batch)
        rows.withColumn("_batch", F.lit(batch)).write.mode("overwrite").parquet(f"{out}/{batch}")

    query = writer.outputMode(mode).foreachBatch(write).start()
    query.awaitTermination()
    if mode == "complete":
        return spark.read.parquet(f"{out}/{max(seen)}").drop("_batch")
    return spark.read.parquet(*[f"{out}/{b}" for b in sorted(set(seen))])


def zoneless(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})
