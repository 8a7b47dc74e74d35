import numpy as np
import pytest
from pyspark.sql import functions as F

from tabweft.functions.counter import normals, uniforms
from tabweft.generators.boosted import BoostedDiffusionGenerator, BoostedFlowGenerator, candidates
from tabweft.operators.boosting import BINS, Group, best_split, grow


def frame(spark, n=4000):
    x, c = normals(1, 0, np.arange(n), 2), (uniforms(1, 1, np.arange(n), 1)[:, 0] * 5).astype(int)
    y = np.where(x[:, 0] > 0.3, 2.0, -1.0) + np.isin(c, [0, 3]) * 3 + 0.1 * x[:, 1]
    return spark.createDataFrame([(i, float(a), float(b), int(k), float(v)) for i, (a, b, k, v) in enumerate(zip(x[:, 0], x[:, 1], c, y, strict=True))], "id long, a double, b double, c int, y double").repartition(5)


def made():
    """Two targets of all rows, and one of rows that stand there twice: for level 1 the sign is turned."""

    def blocks(data):  # local, so that it travels to the tasks by value
        return [data["a"], data["b"], data["c"]], [data["y"], -2 * data["y"]], {"y": data["y"]}

    def judged(data):
        sign = np.where(data["y"] > 1.5, 1.0, -1.0)
        return [(np.tile([0, 1], (len(sign), 1)), np.stack([sign, -sign], 1), np.full((len(sign), 2), 2.0))]

    return blocks, judged


def grown(df, rounds, step, depth):
    blocks, judged = made()
    return grow(df, blocks, [Group(FEATURES, 2, "squared"), Group([*FEATURES, ("level", 2)], 1, "logistic")], rounds, step, depth, judged, ["y"])


FEATURES = [("a", 0), ("b", 0), ("c", 5)]


def test_forests_of_all_targets_are_those_of_single_boosted_models(spark):
    """Against Spark's GBT on the same rows: mean errors are close, and the trees use a category's levels in the order of their means."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    df = frame(spark)
    one, two, judge = grown(df, 8, 0.3, 4)
    rows = df.orderBy("id").toPandas()
    columns = [rows.a.to_numpy(), rows.b.to_numpy(), rows.c.to_numpy()]
    said = one.said(columns)
    assert np.allclose(two.said(columns), -2 * said)
    assert np.allclose(said, one.margin(np.column_stack(columns)))  # whole columns and rows followed one by one
    nominal = F.col("c").cast("double").alias("c", metadata={"ml_attr": {"type": "nominal", "name": "c", "vals": list("01234")}})
    table = VectorAssembler(inputCols=["a", "b", "c"], outputCol="x").transform(df.select("a", "b", nominal, "y"))
    model = GBTRegressor(featuresCol="x", labelCol="y", maxIter=8, stepSize=0.3, maxDepth=4).fit(table)
    theirs = model.transform(table).agg(F.avg((F.col("y") - F.col("prediction")) ** 2)).first()[0]
    ours = float(((said - rows.y) ** 2).mean())
    assert ours < 1.2 * theirs + 0.01 and ours < 0.05 * rows.y.var()
    for level in (0, 1):
        assert ((judge.said([*columns, level]) > 0) == ((rows.y.to_numpy() > 1.5) ^ (level == 1))).mean() > 0.97
        assert np.allclose(judge.said([*columns, level]), judge.margin(np.column_stack([*columns, np.full(len(rows), level)])))
    root = one.first[0]
    assert one.sets[root].nonzero()[0].tolist() == [1, 2, 4] or one.feature[root] == 0


def test_partitioning_does_not_change_the_splits(spark):
    df = frame(spark, 900).coalesce(1)  # a batch, of which every task may hold a part: quantiles are of few distinct numbers
    df = df.withColumn("a", F.round("a")).withColumn("b", F.round("b"))
    a, b = (grown(x, 2, 0.5, 2) for x in (df, df.repartition(2)))
    for p, q in zip(a, b, strict=True):
        assert p.feature.tolist() == q.feature.tolist() and np.allclose(p.values, q.values)


def test_best_split():
    sums = np.array([[2, 2], [2, 10], [1, 5], [4, 0], [0, 0]], float)  # a number of three bins has the same rows as a category of two levels
    f, at, levels, mean, low, high = best_split(sums, [3, -2])
    assert (f, at, levels) == (0, 0, None) and (mean, low, high) == pytest.approx((17 / 5, 1, 5))
    assert best_split(np.array([[2, 6], [0, 0], [3, 9]], float), [3])[0] == -1  # equal means
    assert best_split(np.zeros((3, 2)), [3]) is None
    assert best_split(np.array([[1, 5], [1, 0], [1, 6]], float), [-3])[2] == [1]


def test_wide_categories_ask_their_own_level_and_different_others():
    code = np.arange(40) % 21
    got = candidates(code, 21, uniforms(0, 0, np.arange(40), 1)[:, 0])
    assert got.shape == (40, 16) and all(len(set(r)) == 16 for r in got.tolist()) and (got[:, 0] == code).all() and got.max() < 21
    assert candidates(code % 3, 3, code / 21).tolist() == [[0, 1, 2]] * 40


@pytest.mark.parametrize("kind", [BoostedFlowGenerator, BoostedDiffusionGenerator])
def test_jobs_do_not_grow_with_the_number_of_columns(spark, kind):
    """A level of the trees of all columns is one job: two wide categories take no more jobs than two narrow ones."""
    tracker, jobs = spark.sparkContext.statusTracker(), []
    for size in (2, 6):
        df = spark.range(300).select((F.col("id") * 37 % 101).cast("double").alias("x"), *[F.concat(F.lit("l"), (F.col("id") * p % size).cast("string")).alias(f"c{p}") for p in (3, 5)])
        spark.sparkContext.setJobGroup(f"{kind.__name__}-{size}", "")
        kind(num_timesteps=2, max_iter=2, max_depth=2, model_per_timestep=False).fit(df, ["c3", "c5"])
        jobs.append(len(tracker.getJobIdsForGroup(f"{kind.__name__}-{size}")))
    spark.sparkContext.setJobGroup("", "")
    assert jobs[1] <= jobs[0] + 4


def test_numbers_are_cut_at_quantiles_of_all_rows(spark):
    from tabweft.operators.boosting import _edges

    df = spark.range(5000).select("id", (F.col("id") * F.col("id")).cast("double").alias("a"))
    cut = _edges(df, lambda d: ([d["a"]], [], {}), Group([("a", 0)], 0, "squared"))["a"]
    assert len(cut) == BINS - 1 and np.allclose(np.sqrt(cut), np.arange(1, BINS) * 5000 / BINS, atol=20)
