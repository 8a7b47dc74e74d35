"""Helpers shared by the text operators."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabweft.cluster import materialize, new_folder, shared_dir, ship_package, shuffle_partitions

__all__ = ["arrow_map", "materialize", "new_folder", "open_shared", "prepare", "running_offsets", "shared_dir", "shuffle_partitions", "table", "unused", "with_rows"]

#: Bytes of one Arrow batch handed to Python; bounds a worker's memory however long the texts are.
BATCH_BYTES = 8 << 20


def prepare(spark: SparkSession) -> None:
    """Ship the package and bound the Arrow batches by bytes."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` after ``prepare``; a worker gives back what a partition has used before it takes the next."""
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        release()

    return df.mapInArrow(run, schema)


def release() -> None:
    """Hand freed memory back to the system; Arrow's pool and the C heap keep it otherwise."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def unused(df: DataFrame, name: str) -> str:
    """``name``, longer if ``df`` has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_rows(docs: DataFrame, label: str) -> tuple[DataFrame, str]:
    """``docs`` with a number of its own for every row, and that column's name; written out, so that every later read finds the same."""
    row = unused(docs, "__row")
    return materialize(docs.withColumn(row, F.monotonically_increasing_id()), label), row


def text_bytes(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The column as UTF-8 bytes; null becomes empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def running_offsets(df: DataFrame, key: str | None, order: str, weight: str, out: str, parts: int | None = None) -> DataFrame:
    """Add ``out``: the sum of ``weight`` over the rows before this one within ``key``, gapless.

    Rows are first dealt by a hash of ``order`` into chunks, whose sums per key are small; the chunk
    sums give each chunk its start, and a window inside (key, chunk) does the rest. A key with a third of
    all rows is therefore spread over all chunks and never meets in one task. The order within a key is
    (chunk, ``order``): fixed by the data alone.
    """
    spark = df.sparkSession
    parts = parts or shuffle_partitions(spark) * 4
    keys = [key] if key else []
    dealt = df.withColumn("__chunk", F.pmod(F.xxhash64(F.col(order)), F.lit(parts)).cast("int"))
    sums = dealt.groupBy(*keys, "__chunk").agg(F.sum(weight).alias("__sum"))
    before = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*keys, "__chunk", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("__chunk", *keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.withColumn("__local", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    joined = local.join(starts, [*keys, "__chunk"])
    return joined.withColumn(out, (F.col("__start") + F.col("__local")).cast("long")).drop("__chunk", "__start", "__local")


class _LocalStore:
    """Files of a folder that all machines mount."""

    def __init__(self, path: str):
        self.path = path

    def _full(self, name: str) -> str:
        return os.path.join(self.path, name)

    def write(self, name: str, data_writer: Callable) -> None:
        """Write through ``data_writer(file)`` to a name of this attempt, then rename: a repeated or lost task leaves no torn file."""
        os.makedirs(self.path, exist_ok=True)
        partial = self._full(f".{name}.{os.getpid()}.{os.urandom(4).hex()}")
        with open(partial, "wb") as f:
            data_writer(f)
        os.replace(partial, self._full(name))

    def open(self, name: str):
        return open(self._full(name), "rb")

    def remove(self, name: str) -> None:
        os.remove(self._full(name))


class _ArrowStore:
    """The same over any file system that Arrow opens (HDFS, S3, ...)."""

    def __init__(self, uri: str):
        from pyarrow import fs

        self.fs, self.path = fs.FileSystem.from_uri(uri)

    def write(self, name: str, data_writer: Callable) -> None:
        self.fs.create_dir(self.path, recursive=True)
        partial = f"{self.path}/.{name}.{os.urandom(8).hex()}"
        with self.fs.open_output_stream(partial) as f:
            data_writer(f)
        self.fs.move(partial, f"{self.path}/{name}")

    def open(self, name: str):
        return self.fs.open_input_file(f"{self.path}/{name}")

    def remove(self, name: str) -> None:
        self.fs.delete_file(f"{self.path}/{name}")


def open_shared(uri: str):
    """Reader and writer of plain files below a shared folder, usable on driver and executors."""
    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        return _LocalStore(parts.path or uri)
    return _ArrowStore(uri)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift-multiply), vectorised."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
