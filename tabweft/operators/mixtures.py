"""Discretising a number: distributional trees and Gaussian mixtures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabweft.cluster import materialize, shuffle_partitions
from tabweft.functions import distances as dist
from tabweft.spec import as_number


def split_statistics(counts: DataFrame, min_bucket: int) -> DataFrame:
    """(node, x, k, stat) of every place of rows (node, x, n) after which a node may be split.

    The statistic is the quadratic form of the cumulated scores of a normal distribution (z and z^2 - 1) in the inverse
    of their covariance, over its variance under no change. Scores are sums of n, n z and n z^2, so one pass gives a
    node's moments, and cumulative sums over value ranges give all places.
    """
    moments = counts.groupBy("node").agg(F.sum("n").alias("rows"), (F.sum(F.col("n") * F.col("x")) / F.sum("n")).alias("m"))
    around = counts.join(moments, "node").withColumn("c", F.col("x") - F.col("m"))
    power = lambda k: (F.sum(F.col("n") * F.pow("c", F.lit(k))) / F.max("rows")).alias(f"p{k}")
    shape = around.groupBy("node").agg(F.max("rows").alias("rows"), F.max("m").alias("m"), power(2), power(3), power(4))
    shape = materialize(shape.where("p2 > 0").select("node", "rows", "m", F.sqrt("p2").alias("s"), (F.col("p3") / F.pow("p2", F.lit(1.5))).alias("skew"), (F.col("p4") / F.pow("p2", F.lit(2)) - 1).alias("v")), "tree-nodes")
    z = (F.col("x") - F.col("m")) / F.col("s")
    scored = counts.join(shape.select("node", "m", "s"), "node").select(F.col("node").alias("variable"), "x", "n", (F.col("n") * z).alias("a"), (F.col("n") * (z * z - 1)).alias("b"))
    parts = shuffle_partitions(counts.sparkSession)
    first = dist.ecdf(scored.select("variable", "x", F.col("n").alias("r"), F.col("a").alias("s")), parts).select("variable", "x", F.col("cr").alias("k"), F.col("cs").alias("a"), "next")
    second = dist.ecdf(scored.select("variable", "x", F.col("b").alias("r"), F.col("b").alias("s")), parts).select("variable", "x", F.col("cr").alias("b"))
    at = first.join(second, ["variable", "x"]).withColumnRenamed("variable", "node").join(shape, "node")
    det = F.col("v") - F.col("skew") * F.col("skew")
    form = F.when(det > 1e-10, (F.col("v") * F.col("a") * F.col("a") - 2 * F.col("skew") * F.col("a") * F.col("b") + F.col("b") * F.col("b")) / det).otherwise(F.col("a") * F.col("a"))
    stat = form * (F.col("rows") - 1) / (F.col("k") * (F.col("rows") - F.col("k")))
    inside = F.col("next").isNotNull() & (F.col("k") >= min_bucket) & (F.col("rows") - F.col("k") >= min_bucket)
    return at.where(inside).select("node", "x", "k", stat.alias("stat"))


def distributional_tree(df: DataFrame, column: str, max_depth: int = 3, min_bucket: int = 7, least_stat: float = 5.991) -> DataFrame:
    """(lo, hi, rows, mean, sd): the leaves of a tree that splits a number where its normal distribution changes most.

    A node is split if the statistic reaches ``least_stat`` (by default the 95 % point of its distribution with two
    degrees of freedom). All nodes of a depth are split together; lo and hi are the least and the largest value of a leaf.
    """
    x = as_number(df, column)
    counts = materialize(df.select(x.alias("x")).where("x IS NOT NULL").groupBy("x").agg(F.count("*").alias("n")), "tree-values")
    cuts: list[float] = []
    for _ in range(max_depth):
        node = sum((F.when(F.col("x") > F.lit(c), 1).otherwise(0) for c in cuts), F.lit(0)).cast("long")  # 2 ** max_depth cuts at most
        best = split_statistics(counts.withColumn("node", node), min_bucket).groupBy("node").agg(F.max_by(F.struct("x", "stat"), F.struct("stat", -F.col("x"))).alias("b"))
        new = [r["b"]["x"] for r in best.collect() if r["b"]["stat"] >= least_stat]  # one row per node
        if not new:
            break
        cuts = sorted([*cuts, *new])
    node = sum((F.when(F.col("x") > F.lit(c), 1).otherwise(0) for c in cuts), F.lit(0))
    placed = counts.withColumn("leaf", node)
    means = placed.groupBy("leaf").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.sum("n").alias("rows"), (F.sum(F.col("n") * F.col("x")) / F.sum("n")).alias("mean"))  # 2 ** max_depth rows at most
    around = F.col("n") * F.pow(F.col("x") - F.col("mean"), F.lit(2))  # about the mean, as a difference of squares loses all digits of far values
    spread = placed.join(F.broadcast(means.select("leaf", "mean")), "leaf").groupBy("leaf").agg(F.sum(around).alias("square"))
    return means.join(spread, "leaf").select("lo", "hi", "rows", "mean", F.sqrt(F.col("square") / F.col("rows")).alias("sd"))


def gaussian_mixture(df: DataFrame, column: str, components: int = 10, least_weight: float = 0.01, seed: int = 0):
    """(weights, means, deviations) of a normal mixture by expectation maximisation, without components below ``least_weight``, in order of the means."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.feature import VectorAssembler

    x = as_number(df, column)
    mean, sd = df.agg(F.avg(x), F.stddev_pop(x)).first()
    rows = df.select(((x - F.lit(mean)) / F.lit(sd or 1.0)).alias("x")).where("x IS NOT NULL")
    model = GaussianMixture(featuresCol="v", k=components, seed=seed).fit(VectorAssembler(inputCols=["x"], outputCol="v").transform(rows))
    found = [(w, g.mean[0] * (sd or 1.0) + mean, g.cov.toArray()[0][0] ** 0.5 * (sd or 1.0)) for w, g in zip(model.weights, model.gaussians, strict=True) if w >= least_weight]
    total = sum(w for w, _, _ in found)
    return sorted(((w / total, m, s) for w, m, s in found), key=lambda r: r[1])


def mixture_component(x, mixture) -> Column:
    """Number of the component with the largest share of the density at ``x``."""
    density = [F.lit(w / (s or 1e-12)) * F.exp(-0.5 * F.pow((x - F.lit(m)) / F.lit(s or 1e-12), 2)) for w, m, s in mixture]
    most, out = (F.greatest(*density) if len(density) > 1 else density[0]), F.lit(0)
    for i in reversed(range(len(density))):
        out = F.when(density[i] == most, i).otherwise(out)
    return F.when(x.isNotNull(), out)
