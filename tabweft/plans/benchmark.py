"""Train, sample and evaluate a generator over several seeds; results are long rows."""

from __future__ import annotations

import resource
import threading
import time
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweft.cluster import materialize
from tabweft.functions.randomness import hash_sample, stratified_split
from tabweft.generators.base import SyntheticTable
from tabweft.plans.evaluator import MetricEvaluator, get_metric
from tabweft.sources.tables import append_results, read_synthetic, write_results, write_synthetic


class TrainingTimeout(RuntimeError):
    pass


@contextmanager
def time_limit(spark, seconds: float | None):
    """Cancel the Spark jobs of this block after ``seconds``; TrainingTimeout then."""
    if not seconds:
        yield
        return
    group, over = f"tabweft-{time.time_ns()}", threading.Event()
    spark.sparkContext.setJobGroup(group, "training", True)
    timer = threading.Timer(seconds, lambda: (over.set(), spark.sparkContext.cancelJobGroup(group)))
    timer.start()
    try:
        yield
    except Exception as e:
        if over.is_set():
            raise TrainingTimeout(f"training took more than {seconds} s") from e
        raise
    finally:
        timer.cancel()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    if over.is_set():
        raise TrainingTimeout(f"training took more than {seconds} s")


def peak_memory_mb() -> float:
    """Largest resident size of the driver's Python so far."""
    return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024


class SynthesisBenchmark:
    """``run`` trains on ``n_train_seeds`` splits, draws ``n_sets`` synthetic tables of each, and evaluates them."""

    def __init__(self, df: DataFrame, generator: str, generator_params: dict | None = None, discrete=(), target: str | None = None, id: str = "id", random_state: int = 42, constraints=None, missing_imputation_method: str = "drop", monitor_memory: bool = False, max_eval_samples: int | None = None, dataset_save_dir: str | None = None, cap_train_time: float | None = None):
        self.df, self.generator, self.params = df, generator, generator_params or {}
        self.discrete, self.target, self.id, self.seed = list(discrete), target, id, random_state
        self.constraints, self.imputation, self.memory = constraints, missing_imputation_method, monitor_memory
        self.max_eval, self.save_dir, self.cap = max_eval_samples, dataset_save_dir, cap_train_time

    def split(self, seed: int, test_size: float) -> tuple[DataFrame, DataFrame]:
        parts = materialize(stratified_split(self.df, self.target if self.target in self.discrete else None, test_size, seed, self.id), "bench-split")
        return parts.where("NOT is_test").drop("is_test"), parts.where("is_test").drop("is_test")

    def train(self, seed: int, train: DataFrame) -> SyntheticTable:
        model = SyntheticTable(self.generator.partition("-")[0], {**self.params, "random_state": seed}, None, self.constraints, self.imputation, seed)
        with time_limit(self.df.sparkSession, self.cap):
            return model.fit(train.drop(self.id), self.discrete)

    def run(self, metrics, n_train_seeds: int = 1, n_sets: int = 1, test_size: float = 0.2, results_save_path: str | None = None, append: bool = False) -> DataFrame:
        """(metric, value, train_seed, set); a time-out ends the run after its two rows."""
        for key in metrics:
            get_metric(key.partition("-")[0])
        rows: list[tuple] = []
        for s in range(n_train_seeds):
            seed = self.seed + s
            train, test = self.split(seed, test_size)
            began = time.time()
            try:
                model = self.train(seed, train)
            except TrainingTimeout:
                rows += [("training_timed_out", 1.0, seed, None), ("training_time_seconds", time.time() - began, seed, None)]
                break
            rows.append(("training_time_seconds", time.time() - began, seed, None))
            if self.memory:
                rows.append(("training_peak_memory_mb", peak_memory_mb(), seed, None))
            for k in range(n_sets):
                rows += self._one_set(model, train, test, seed, k, metrics)
        spark = self.df.sparkSession
        out = spark.createDataFrame(rows, "metric string, value double, train_seed long, set long")
        if results_save_path:
            (append_results if append else write_results)(out, results_save_path, self.generator)
        return out

    def _one_set(self, model, train: DataFrame, test: DataFrame, seed: int, k: int, metrics) -> list[tuple]:
        if self.max_eval:
            train, test = (hash_sample(x, min(self.max_eval, x.count()), seed + k, "eval", self.id) for x in (train, test))
        n_train, n_test = train.count(), test.count()
        began = time.time()
        model.generator.random_state = seed * 1000 + k
        drawn = model.generate(n_train + n_test).withColumn(self.id, F.monotonically_increasing_id() + F.lit(1 << 40))
        drawn = materialize(drawn, "bench-syn")
        syn = hash_sample(drawn, n_train, seed, "head", self.id)
        syn_test = drawn.join(syn.select(self.id), self.id, "left_anti")
        rows = [("sampling_time_seconds", time.time() - began, seed, k)]
        if self.save_dir:
            write_synthetic(syn, syn_test, self.save_dir, seed, k)
        began = time.time()
        found = MetricEvaluator(metrics, self.discrete, self.target, self.id, seed).evaluate(train, test, syn, syn_test)
        rows += [(m, None if v is None else float(v), seed, k) for m, v in found.items()]
        return [*rows, ("evaluation_time_seconds", time.time() - began, seed, k)]

    def eval_saved(self, metrics, n_train_seeds: int = 1, n_sets: int = 1, test_size: float = 0.2) -> DataFrame:
        """Evaluate tables written by an earlier run; FileNotFoundError if there are none."""
        rows = []
        for s in range(n_train_seeds):
            seed = self.seed + s
            train, test = self.split(seed, test_size)
            for k in range(n_sets):
                syn, syn_test = read_synthetic(self.df.sparkSession, self.save_dir, seed, k)
                found = MetricEvaluator(metrics, self.discrete, self.target, self.id, seed).evaluate(train, test, syn, syn_test)
                rows += [(m, None if v is None else float(v), seed, k) for m, v in found.items()]
        return self.df.sparkSession.createDataFrame(rows, "metric string, value double, train_seed long, set long")
