"""Cases that once gave wrong results or crashed."""

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tabweft.functions.randomness import uniform
from tabweft.generators.base import SMOTEGenerator, UnivariateGenerator
from tabweft.generators.trees import ARFGenerator
from tabweft.operators import mixtures, ml, privacy
from tabweft.spec import FeatureSpec


def rows(spark, n=200, first=0):
    return spark.range(first, first + n).select("id", (F.col("id") % 10).cast("double").alias("x"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("t"))


def test_mle_of_constant_synthetic_labels_counts_all_rows(spark):
    df, spec = rows(spark), FeatureSpec(("t",), ("x",), "t", "id")
    got = ml.mle(df, df, df.withColumn("t", F.lit("b")), spec, "t", model_name="dt")
    assert got["mle.accuracy"] == 0.5 and got["mle.auc"] == 0.5 and got["mle.f1"] == pytest.approx(2 / 3)
    assert got["mle.baseline.accuracy"] > 0.9
    three = df.withColumn("t", F.element_at(F.array(*map(F.lit, "abc")), (F.col("id") % 3 + 1).cast("int")))
    got = ml.mle(three, three.where("t != 'c'"), three.withColumn("t", F.lit("c")), FeatureSpec(("t",), ("x",), "t", "id"), "t", model_name="dt")
    assert got["mle.accuracy"] == 0.0
    # two labels of three: a binary task
    got = ml.mle(three, three, three.where("t != 'c'"), FeatureSpec(("t",), ("x",), "t", "id"), "t", model_name="dt")
    assert set(got) >= {"mle.auc", "mle.f1", "mle.accuracy"}


def test_score_names(spark):
    assert [n for n, _ in ml.resolve_scores(["roc_auc_score", "accuracy_score", "f1_score"], "binary")] == ["auc", "accuracy", "f1"]


def test_tree_deviation_of_far_values(spark):
    x = np.random.default_rng(1).normal(1.7e9, 1.0, 3000)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    leaves = mixtures.distributional_tree(df, "x", max_depth=2).collect()
    for leaf in leaves:
        own = x[(x >= leaf.lo) & (x <= leaf.hi)]
        assert leaf.rows == len(own) and leaf.sd == pytest.approx(own.std(), rel=1e-6) and leaf.mean == pytest.approx(own.mean(), rel=1e-12)


def test_univariate_with_very_many_levels(spark):
    df = spark.range(100_000).select(F.format_string("v%06d", "id").alias("c"), F.when(F.col("id") % 3 == 0, None).otherwise("d").alias("d"))
    df = df.unionByName(df.where("c = 'v000007'").crossJoin(spark.range(50_000)).select("c", "d"))
    made = UnivariateGenerator(1).fit(df, ["c", "d"]).generate(30_000)
    n, distinct, hot, gone = made.agg(F.count("*"), F.countDistinct("c"), F.avg((F.col("c") == "v000007").cast("int")), F.avg(F.col("d").isNull().cast("int"))).first()
    assert n == 30_000 and distinct > 15_000 and abs(hot - 1 / 3) < 0.02 and abs(gone - 33_334 / 150_000) < 0.02


def test_smote_with_a_missing_class(spark):
    df = rows(spark, 90).drop("id").withColumn("t", F.when(F.col("x") < 3, None).otherwise(F.col("t")))
    made = SMOTEGenerator("t", 3).fit(df, ["t"]).generate(300)
    assert made.count() == 300
    assert abs(made.where("t IS NULL").count() / 300 - df.where("t IS NULL").count() / 90) < 0.02
    assert made.where("t IS NULL").agg(F.max("x")).first()[0] < 3


def test_classifier_attack_scores_rows_with_negative_ids(spark):
    spec = FeatureSpec(("t",), ("x",), None, "id")
    found = privacy.classifier_scores(rows(spark, 60, 500), rows(spark, 60, 1000), rows(spark, 80, -40), spec, "dt")
    assert found.count() == 80


def test_arf_gives_every_row(spark):
    """Shares of thirds and sevenths: bounds of neighbouring levels are the same number."""
    df = spark.range(210).select(F.concat(F.lit("l"), (F.col("id") % 7).cast("string")).alias("c"), F.concat(F.lit("m"), (F.col("id") % 3).cast("string")).alias("d"), (F.col("id") % 5).cast("double").alias("x"))
    model = ARFGenerator(num_trees=2, max_iters=1, max_depth=2).fit(df, ["c", "d"])
    assert model.generate(5000).count() == 5000
    for c, table in model.shares.items():
        by = {}
        for r in table.orderBy("tree", "leaf", c).collect():
            by.setdefault((r["tree"], r["leaf"]), []).append((r["lo"], r["hi"]))
        for own in by.values():
            assert own[0][0] == 0 and own[-1][1] == 1 and all(a[1] == b[0] for a, b in zip(own, own[1:], strict=False))


def test_fine_uniform_numbers(spark):
    u = np.array([r[0] for r in spark.range(5000).select(uniform(1, "f", "id", fine=True)).collect()])
    assert len(set(u)) == 5000 and abs(u.mean() - 0.5) < 0.02 and ((u * 2**32) % 1 > 0).mean() > 0.99


def test_attacks_repeat_on_subsamples(spark):
    spec = FeatureSpec(("t",), ("x",), None, "id")
    train, test, syn = rows(spark, 120), rows(spark, 80, 500), rows(spark, 100, 1000)
    value = lambda **kw: {r.metric: r.value for r in privacy.attack("dpi", train, test, syn, spec, **kw).collect()}
    runs = [value(subsample=True, seed=s) for s in (3, 4)]
    both = value(subsample=True, repeats=2, seed=3)
    assert set(both) == set(value()) and all(both[m] == pytest.approx((runs[0][m] + runs[1][m]) / 2) for m in both)
    with pytest.raises(ValueError, match="repeats"):
        value(repeats=0)
    with pytest.raises(ValueError, match="too few"):
        privacy.attack("dpi", train, test, syn.limit(10), spec, subsample=True)


@pytest.mark.parametrize("model_name", ["rf", "svm", "lr"])
def test_classifiers_apply_in_a_session_with_an_observation(spark, model_name):
    own = spark.newSession()  # what was observed stays in this one
    seen = Observation()
    own.range(3).observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get["n"] == 3
    df = rows(own).withColumn("x", F.col("x") + F.when(F.col("t") == "a", 100.0).otherwise(0.0))
    got = ml.ml_task(df, df, FeatureSpec(("t",), ("x",), "t", "id"), "t", "binary", model_name).collect()
    assert len(got) == 200 and all(r.label == r.prediction for r in got)
