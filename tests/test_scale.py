import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabweft.functions.distances import resolve_distance
from tabweft.functions.normal import truncated_normals
from tabweft.functions.order import dense_index, exact_quantiles
from tabweft.functions.randomness import bootstrap, hash_sample, stratified_split, uniform, uniform_rank
from tabweft.generators import diffusion
from tabweft.generators.boosted import BoostedDiffusionGenerator, BoostedFlowGenerator
from tabweft.generators.trees import ARFGenerator, SynthpopGenerator
from tabweft.operators import fidelity, mixtures, ml, privacy, scores
from tabweft.operators import preprocess as pp
from tabweft.operators.neighbours import _smallest
from tabweft.plans.evaluator import MetricEvaluator, get_metric
from tabweft.sources import tables
from tabweft.spec import FeatureSpec


def test_sampling_splits_and_ranks(spark):
    df = spark.range(3000).select(F.col("id").alias("k"), (F.col("id") % 3).alias("s")).withColumn("s", F.when(F.col("s") != 2, F.col("s")))
    u = {r.k: r.u for r in df.select("k", uniform(5, "n", "k").alias("u")).collect()}
    by = sorted(u, key=lambda k: (u[k], k))
    for n in (0, 1, 700, 3000, 5000):
        assert {r.k for r in hash_sample(df, n, 5, "n", "k").collect()} == set(by[:n])
    ranks = {r.k: r.at for r in uniform_rank(df, uniform(5, "n", "k"), "at", "k").collect()}
    assert [ranks[k] for k in by] == list(range(3000))
    parts = stratified_split(df, "s", 0.2, 5, "k")
    assert parts.columns == ["k", "s", "is_test"]
    assert {r.s: r.n for r in parts.where("is_test").groupBy("s").agg(F.count("*").alias("n")).collect()} == {0: 200, 1: 200, None: 200}
    drawn = bootstrap(df, 500, 5, "k").collect()
    at = {r.draw: math.floor(r.u * 3000) for r in spark.range(500).select(F.col("id").alias("draw"), uniform(5, "bootstrap", "id").alias("u")).collect()}
    assert {r.draw: r.k for r in drawn} == at
    plan = hash_sample(df, 700, 5, "n", "k")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan


def test_quantiles_and_index(spark):
    rng = random.Random(1)
    values = [rng.choice([rng.gauss(0, 10), 3.0, None, float(rng.randint(-5, 5))]) for _ in range(2000)]
    df = spark.createDataFrame([(x,) for x in values], "x double").repartition(5)
    levels = [0, 0.02, 0.3, 0.5, 0.999, 1]
    known = [x for x in values if x is not None]
    assert np.allclose(exact_quantiles(df, "x", levels), np.quantile(known, levels))
    assert exact_quantiles(df.where("x > 1e9"), "x", levels) is None
    at = dense_index(df, "x", "at").collect()
    assert sorted(r.at for r in at) == list(range(2000))
    assert [r.x for r in sorted(at, key=lambda r: r.at) if r.x is not None] == sorted(known)


def test_smallest_breaks_ties_to_the_left():
    rng = np.random.default_rng(2)
    d = rng.integers(0, 6, (50, 40)).astype(float)
    for k in (1, 2, 7, 40, 60):
        assert (_smallest(d, k) == np.argsort(d, axis=1, kind="stable")[:, :k]).all()


def test_lift_with_ties_of_scores(spark):
    rng = random.Random(3)
    rows = [(i, rng.randint(0, 1), float(rng.randint(0, 3))) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, y int, score double")
    for k in (0.1, 0.33, 0.9):
        top = sorted(rows, key=lambda r: (-r[2], -r[0]))[: math.ceil(k * 400)]
        want = statistics.mean(r[1] for r in top) / statistics.mean(r[1] for r in rows)
        assert scores.lift_at_k(df, k).first()["lift"] == pytest.approx(want)
    none = {r.metric: r.value for r in scores.attack_scores(df.withColumn("y", F.lit(0))).collect()}
    assert none["lift_010"] == 0 and none["tpr_at_fpr_010"] == 0 and none["auc"] is None


def separable(spark, n=300, shift=8.0):
    rng = random.Random(4)
    rows = [(i, rng.gauss(shift * (i % 2), 1), "ab"[rng.random() < 0.5], "yn"[i % 2]) for i in range(n)]
    return spark.createDataFrame(rows, "id long, x double, g string, t string")


@pytest.mark.parametrize("model", ["svm", "linear", "decision_tree"])
def test_models_tell_separable_classes(spark, model):
    df, spec = separable(spark), FeatureSpec(("g", "t"), ("x",), "t", "id")
    found = ml.score_predictions(ml.ml_task(df, df, spec, "t", "binary", model), "binary")
    assert found["auc"] > 0.98 and found["accuracy"] > 0.95
    mixed = df.withColumn("t", F.when(uniform(1, "m", "id") < 0.5, "y").otherwise("n"))
    other = ml.ml_task(mixed.where("id < 150"), mixed.where("id >= 150"), spec, "t", "binary", model)
    assert 0.3 < ml.score_predictions(other, "binary", ["auc"])["auc"] < 0.7


def test_scores_by_name_function_and_pair(spark):
    rows = spark.createDataFrame([(1.0, 1.0), (2.0, 3.0)], "label double, prediction double")
    share = lambda p: p.where("label = prediction").count() / p.count()
    found = ml.score_predictions(rows, "regression", ["root_mean_squared_error", ("same", share)])
    assert found == {"rmse": pytest.approx(math.sqrt(0.5)), "same": 0.5}
    for bad in (["auc"], [3], [("a", share), ("a", share)]):
        with pytest.raises(ValueError):
            ml.score_predictions(rows, "regression", bad)
    assert resolve_distance("Kolmogorov-Smirnov") == "ks" and resolve_distance("total variation") == "tvd" and resolve_distance("js") == "jsd"
    with pytest.raises(ValueError):
        resolve_distance("euclid")


def test_tuning_is_cached(spark, tmp_path):
    df, spec = separable(spark, 120), FeatureSpec(("g", "t"), ("x",), "t", "id")
    tuning = {"trials": 2, "folder": str(tmp_path)}
    first = ml.mle(df, df, df, spec, "t", model_name="dt", tuning=tuning)
    assert first["mle.auc"] > 0.95
    files = sorted(p.name for p in tmp_path.iterdir())
    assert len(files) == 1 and files[0].startswith("mle_decisiontree_")  # one search on real rows, for both fits
    ml.mle(df, df, df, spec, "g", model_name="dt", tuning=tuning)
    assert len(list(tmp_path.iterdir())) == 2  # another target is another search
    assert ml.tune(df, df, spec, "t", "binary", "dt", cache=f"{tmp_path}/{files[0]}") == ml._cached(spark, f"{tmp_path}/{files[0]}")
    assert ml.mle(df, df, df, spec, "t", "real", "dt")["mle.auc"] > 0.95
    fit, check = ml.split_validation(df, "t", 0.2, 1, "id")
    assert fit.count() + check.count() == 120 and check.groupBy("t").count().count() == 2
    with pytest.raises(ValueError):
        ml.classifier_test(df, df, df, None, spec)
    with pytest.raises(ValueError):
        ml.mle(df, df, df, spec, None)


def test_classifier_test_and_attacks_on_copied_and_foreign_rows(spark):
    df, spec = separable(spark, 240, 0.5), FeatureSpec(("g", "t"), ("x",), None, "id")
    train, test = df.where("id < 120"), df.where("id >= 120")
    far = train.withColumn("x", F.col("x") + 50).withColumn("id", F.col("id") + 1000)
    assert ml.classifier_test(train, test, far, far, spec, "dt") > 0.98
    copies = train.withColumn("id", F.col("id") + 1000)
    for name in ("domias",):
        value = {r.metric: r.value for r in privacy.attack(name, train, test, copies, spec).collect()}
        assert 0.4 < value["auc"] <= 1.0, name
    dpi = {r.metric: r.value for r in privacy.attack("dpi", train, test, copies, spec).collect()}
    found = privacy.ensemble_attack(train, test, copies, spec, include=("dpi", "classifier-dt"))
    assert {r.component for r in found.collect()} == {"ensemble", "dpi", "classifier-dt"}
    assert {r.metric: r.value for r in found.where("component = 'dpi'").collect()} == dpi
    with pytest.raises(ValueError):
        privacy.attack_of("dpi-rf")
    leak = ml.aia(train, train, spec, ["t"], ["x", "g"], "dt")
    assert set(leak) == {"aia.t.auc"}


def test_plots_as_data(spark, tmp_path):
    df, spec = separable(spark, 200), FeatureSpec(("g", "t"), ("x",), None, "id")
    found = get_metric("featurewiseplots")(df, df, df, spec, save_dir=str(tmp_path))
    assert 10 <= found["histograms_rows"] <= 20 and found["densities_rows"] == 200 and found["proportions_rows"] == 4
    curve = sorted((r.x, r.real_density) for r in spark.read.parquet(f"{tmp_path}/densities").collect())
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(curve, curve[1:], strict=False))
    assert 0.85 < area < 1.02
    assert any(k.startswith("featurewiseplots.") for k in MetricEvaluator(["featurewiseplots"], ["g", "t"]).evaluate(df, df, df))
    many = spark.range(300).select(F.col("id"), F.concat(F.lit("v"), F.least(F.col("id"), F.lit(40))).alias("g"))
    lumped = fidelity.proportions(many, many, FeatureSpec(("g",), ()), 5).collect()
    assert len(lumped) == 5 and "__other__" in {r.value for r in lumped} and sum(r.real_share for r in lumped) == pytest.approx(1)


def test_missing_values_in_comparisons(spark):
    df = spark.createDataFrame([(1.0, "a"), (None, None)], "x double, g string")
    found = {r.metric: r.value for r in fidelity.domain_constraints(df, df, ["x != 1", "x > 0", "g == 'a'", "x >= 0 and g != 'b'"]).collect()}
    assert [found[f"{fidelity.constraint_key(c)}_real"] for c in ("x != 1", "x > 0", "g == 'a'", "x >= 0 and g != 'b'")] == [0.5] * 4


def test_many_frequent_items_are_joined(spark, monkeypatch):
    rng = random.Random(6)
    df = spark.createDataFrame([tuple(rng.choice("pqr") for _ in range(4)) for _ in range(200)], "a string, b string, c string, d string")
    few = {(tuple(r["items"]), r["n"]) for r in fidelity.frequent_itemsets(df, df.columns, 10, 3).collect()}
    monkeypatch.setattr(fidelity, "FEW_ITEMS", 3)
    assert {(tuple(r["items"]), r["n"]) for r in fidelity.frequent_itemsets(df, df.columns, 10, 3).collect()} == few


def test_generators_learn_from_rows_with_missing_values(spark):
    rng = random.Random(7)
    rows = [(rng.gauss(10, 1) if i % 3 else None, None if i % 3 else rng.gauss(-5, 1), rng.choice(["u", "v", None])) for i in range(240)]
    df = spark.createDataFrame(rows, "a double, b double, g string")
    for made in (
        ARFGenerator(num_trees=2, max_iters=2, max_depth=3, alpha=0.5), SynthpopGenerator(K=1, max_depth=3, smoothing="kde"),
        BoostedFlowGenerator(num_timesteps=2, max_iter=2, diffusion_type="vp"), BoostedDiffusionGenerator(num_timesteps=2, max_iter=2, deterministic_sampler=False),
    ):
        out = made.fit(df, ["g"]).generate(300)
        assert out.columns[-3:] == ["a", "b", "g"] or set(out.columns) >= {"a", "b", "g"}
        row = out.agg(F.count("*").alias("n"), F.count("a").alias("a"), F.count("b").alias("b"), F.count("g").alias("g"), F.min("a").alias("lo"), F.max("b").alias("hi")).first()
        assert row.n == 300 and 120 < row.a < 270 and 30 < row.b < 180 and 120 < row.g < 270
        assert row.lo > 0 and row.hi < 8


def test_a_rerun_replaces_its_tables(spark, tmp_path):
    one = spark.range(3).toDF("x")
    for seed in (1, 1, 2):
        tables.write_synthetic(one, one, str(tmp_path), seed, 0)
    assert tables.read_synthetic(spark, str(tmp_path), 1, 0)[0].count() == 3
    assert spark.read.parquet(f"{tmp_path}/synthetic_test").count() == 6
    one.write.option("header", True).csv(f"{tmp_path}/t.csv")
    assert tables.read_table(spark, f"{tmp_path}/t.csv").count() == 3
    assert tables.result_path("a/b", "g") == "a/b/g.csv" and tables.result_path("a/b.csv", "g") == "a/b.csv"
    res = spark.createDataFrame([("m", 1.0, 1, 0)], "metric string, value double, train_seed long, set long")
    tables.write_results(res, f"{tmp_path}/r")
    tables.append_results(res, f"{tmp_path}/r")
    assert tables.read_results(spark, f"{tmp_path}/r").count() == 2


def test_truncated_draws(spark):
    rows = spark.range(4000).withColumn("u", uniform(3, "t", "id"))
    out = truncated_normals(rows, {"x": (F.col("u"), F.lit(1.0), F.lit(2.0), F.lit(0.0), F.lit(3.0)), "y": (F.col("u"), F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(3.0))})
    own = statistics.NormalDist(1, 2)
    lo, hi = own.cdf(0), own.cdf(3)
    for r in out.where("id % 37 = 0").collect():
        assert r.x == pytest.approx(own.inv_cdf(lo + r.u * (hi - lo)), abs=1e-4) and r.y == 1.0


def test_mixtures_and_tree(spark):
    rng = random.Random(8)
    df = spark.createDataFrame([(rng.gauss(0, 1) if i % 3 else rng.gauss(40, 2),) for i in range(900)], "x double")
    tree = sorted(mixtures.distributional_tree(df, "x", max_depth=1).collect(), key=lambda r: r.lo)
    assert [r.rows for r in tree] == [600, 300] and tree[0].hi < 10 < tree[1].lo
    values = [r.x for r in df.collect()]
    z = (np.sort(values) - np.mean(values)) / np.std(values)
    h = np.stack([z, z**2 - 1], 1)
    inverse, cum, n = np.linalg.inv(h.T @ h / 900), np.cumsum(h, 0), 900
    stat = [cum[k - 1] @ inverse @ cum[k - 1] * (n - 1) / (k * (n - k)) for k in range(7, n - 7)]
    counts = df.groupBy("x").agg(F.count("*").alias("n")).withColumn("node", F.lit(0).cast("long"))
    assert mixtures.split_statistics(counts, 7).agg(F.max("stat")).first()[0] == pytest.approx(max(stat))
    mix = mixtures.gaussian_mixture(df, "x", 2)
    assert [round(w, 1) for w, _, _ in mix] == [0.7, 0.3] and abs(mix[1][1] - 40) < 1
    assert df.groupBy(mixtures.mixture_component(F.col("x"), mix).alias("c")).count().count() == 2


def test_normal_quantile_map_and_onehot_inverse(spark):
    df = spark.range(500).select(F.col("id").alias("k"), F.pow("id", F.lit(2)).cast("double").alias("x"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("g"))
    m = pp.QuantileMap.fit(df, "x", 100)
    back = m.with_value(m.with_normal(df, F.col("x"), "z"), F.col("z"), "y")
    assert back.agg(F.max(F.abs(F.col("x") - F.col("y")))).first()[0] < 60 and abs(back.agg(F.avg("z")).first()[0]) < 0.05
    hot = pp.onehot(df.select("k", "g"), "g", ["b"])
    assert pp.onehot_inverse(hot, "g", ["b"], dropped="a").join(df, ["k", "g"]).count() == 500
    bars = [r.alpha_bar for r in diffusion.cosine_angle(spark, 50).orderBy("t").collect()]
    assert np.allclose(bars, diffusion.cosine_angle_bars(50))
