"""Where tables and results come from and go to."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet, CSV with header, or JSON lines, by suffix; anything else is Parquet."""
    if path.endswith(".csv"):
        return spark.read.option("header", True).option("inferSchema", True).csv(path)
    if path.endswith((".json", ".jsonl")):
        return spark.read.json(path)
    return spark.read.parquet(path)


def result_path(path: str, generator: str) -> str:
    """A path with a suffix as it is; a folder gets ``<generator>.csv``."""
    return path if path.rsplit("/", 1)[-1].count(".") else f"{path.rstrip('/')}/{generator}.csv"


def write_results(rows: DataFrame, path: str, generator: str = "results") -> None:
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(result_path(path, generator))


def append_results(rows: DataFrame, path: str, generator: str = "results") -> None:
    rows.coalesce(1).write.mode("append").option("header", True).csv(result_path(path, generator))


def read_results(spark: SparkSession, path: str, generator: str = "results") -> DataFrame:
    return spark.read.option("header", True).schema("metric string, value double, train_seed long, set long").csv(result_path(path, generator))


def write_synthetic(syn: DataFrame, syn_test: DataFrame, folder: str, train_seed: int, sampling_seed: int) -> None:
    """Parquet partitioned by seeds, so that a reader prunes to its own; a rerun replaces the tables of its seeds."""
    for name, df in (("train", syn), ("test", syn_test)):
        df.withColumn("train_seed", F.lit(train_seed)).withColumn("sampling_seed", F.lit(sampling_seed)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("train_seed", "sampling_seed").parquet(f"{folder}/synthetic_{name}")


def read_synthetic(spark: SparkSession, folder: str, train_seed: int, sampling_seed: int) -> tuple[DataFrame, DataFrame]:
    out = []
    for name in ("train", "test"):
        try:
            df = spark.read.parquet(f"{folder}/synthetic_{name}")
        except AnalysisException as e:
            raise FileNotFoundError(f"no synthetic tables below {folder}") from e
        df = df.where((F.col("train_seed") == train_seed) & (F.col("sampling_seed") == sampling_seed)).drop("train_seed", "sampling_seed")
        if df.isEmpty():
            raise FileNotFoundError(f"no synthetic table of seeds {train_seed}, {sampling_seed} below {folder}")
        out.append(df)
    return out[0], out[1]
