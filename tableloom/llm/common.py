"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import os
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import checkpoint_dir, cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The same lower-casing for UTF-8 bytes: only A-Z change.
LOWER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def lower_ascii(text: Column) -> Column:
    """``text`` with A-Z lower-cased and every other letter as it is."""
    return F.translate(text, UPPER, LOWER)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or one made from it that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for files below ``spark.checkpoint.dir``."""
    return os.path.join(checkpoint_dir(spark), f"{name}-{os.urandom(6).hex()}")


def store(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in ``spark.checkpoint.dir``; the files go when nothing refers to them."""
    return cut_lineage(df)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows for what runs inside: whole texts take much room, in Spark and in Python."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def release() -> None:
    """Give back what a task of this Python worker no longer uses; idle workers stay for later tasks."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder that ``shared_folder`` named and nothing reads any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def forget(spark: SparkSession) -> None:
    """Let the driver drop finished plans now, so that Spark deletes the shuffle files and checkpoints only they used."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def spread(df: DataFrame, keys: list[str], salt: str, first: list[Column], then: list[Column]) -> DataFrame:
    """Totals per ``keys`` for joining back on ``keys`` and ``salt``, so that a hot key never meets in one task.

    ``first`` aggregates the rows of a key and salt, ``then`` those results per key. A key has as
    many rows in the second step and in the returned table as it has salts, however frequent it is.
    """
    part = df.groupBy(*keys, salt).agg(*first)
    total = part.groupBy(*keys).agg(*then)
    return part.select(*keys, salt).join(total, keys)


def filesystem(uri: str):
    """(file system, path) of a folder named by a URI, for reading and writing inside tasks."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


class Publisher:
    """Writes files whole: under a name of this attempt first, then renamed.

    A repeated or speculative attempt of a task writes the same bytes and renames them to the same
    name, so readers see one complete file whatever executor was lost.
    """

    def __init__(self, uri: str):
        self.fs, self.folder = filesystem(uri)
        self.fs.create_dir(self.folder, recursive=True)

    def publish(self, name: str, parts) -> None:
        draft = f"{self.folder}/.{name}.{os.urandom(6).hex()}"
        with self.fs.open_output_stream(draft, compression=None) as out:
            for part in parts:
                out.write(part)
        self.fs.move(draft, f"{self.folder}/{name}")
