"""Corpus pipeline over ``documents``: quality rules, exact dedup, near dedup, substring dedup, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows of ``docs``; its result is written as Parquet and is the
next stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tabweft import cluster
from tabweft.llm import exact_dedup, near_dedup, packing, quality_rules, substring_dedup


class _Left:
    """The folders that a stage made, and how many rows its result had when it was first read to the end."""

    def __init__(self, out: DataFrame, folders: list[str]):
        self.folders, self.seen = folders, Observation()
        self.out = out.observe(self.seen, F.count(F.lit(1)).alias("rows"))

    def rows(self) -> int | None:
        return self.seen.get["rows"] if self.seen._jo.future().isCompleted() else None

    def void(self, docs: DataFrame, read: list[str]) -> bool:
        """Whether ``docs`` is a written copy of the result: it was read, has as many rows, and ``docs`` reads none of the folders."""
        return self.rows() is not None and bool(read) and not any(f.rsplit("/", 1)[-1] in file for f in self.folders for file in read) and docs.count() == self.rows()


#: What stages have left in the shared folder, the latest last.
_left: list[_Left] = []


def _stage(run: Callable[[SparkSession, DataFrame, str], DataFrame]):
    """A stage that first deletes what the stage before has left, once ``docs`` is a written copy of that stage's result.

    Results that were never read, and what other runs have left, stay; a result that the next stage has got a copy of is void.
    """

    @wraps(run)
    def staged(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if _left:
            read = docs.inputFiles()
            for left in [x for x in _left if x.void(docs, read)][-1:]:
                cluster.clear(spark, left.folders)
                _left.remove(left)
        before = set(cluster.made())
        out = run(spark, docs, sf_dir)
        _left.append(_Left(out, [x for x in cluster.made() if x not in before]))
        held, _left[-1].out = _left[-1].out, None
        return held

    return staged


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` after the text has changed."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


@_stage
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without their host's boilerplate lines."""
    return _counted(quality_rules.apply_rules(docs, without_id=True))


@_stage
def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_copies(docs)


@_stage
def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies."""
    return near_dedup.drop_near_copies(docs)


@_stage
def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the sentences that repeat a span of an earlier document."""
    return _counted(substring_dedup.drop_repeats(docs))


@_stage
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of every document with its place in a sequence."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("exact_dedup", exact_stage),
    ("minhash_near_dedup", near_stage),
    ("substring_dedup", substring_stage),
    ("best_fit_packing", packing_stage),
]

#: The stages hash, sketch and tokenize in ways that SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cluster.materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
