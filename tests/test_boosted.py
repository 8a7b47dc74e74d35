from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabweft.functions.counter import normals, uniforms
from tabweft.generators import base, boosted
from tabweft.generators.boosted import BoostedDiffusionGenerator, BoostedFlowGenerator
from tabweft.sources import state


def mixture(spark, n=3000):
    """The class decides the mean of x, and c for the most part; d is even; k is missing for a fifth."""
    u, z, rows = uniforms(9, 0, np.arange(n), 4), normals(9, 1, np.arange(n), 2), []
    for i in range(n):
        y = "a" if u[i, 0] < 0.7 else "b"
        c = "p" if u[i, 1] < (0.9 if y == "a" else 0.2) else "q"
        rows.append((float(z[i, 0] + (4 if y == "a" else -4)), int(10 * abs(z[i, 1])) if u[i, 2] < 0.8 else None, c, f"d{int(u[i, 3] * 3)}", y))
    return spark.createDataFrame(rows, "x double, k int, c string, d string, y string").repartition(3)


def shares(df, *columns):
    rows = df.groupBy(*columns).count().collect()
    total = sum(r["count"] for r in rows)
    return {tuple(r[c] for c in columns): r["count"] / total for r in rows}


def distance(a, b):
    return sum(abs(a.get(k, 0) - b.get(k, 0)) for k in {*a, *b}) / 2


def test_category_posterior_is_bayes_rule():
    one = lambda a: a * np.eye(4) + (1 - a) / 4
    for now in range(4):
        for start in range(4):
            joint = one(0.6)[start] * one(0.8)[:, now]
            got = boosted.category_posterior(np.array([now]), np.array([start]), 4, 0.8, 0.6)
            assert np.allclose(got / got.sum(), joint / joint.sum())


@pytest.mark.parametrize("make", [
    lambda: BoostedDiffusionGenerator("y", num_timesteps=10, max_iter=12, model_per_timestep=False, noise_samples_per_row=3),
    lambda: BoostedDiffusionGenerator("y", num_timesteps=2, max_iter=6, objective="x", deterministic_sampler=False),
    lambda: BoostedFlowGenerator("y", num_timesteps=10, max_iter=10, model_per_timestep=False, noise_samples_per_row=3),
], ids=["ddpm", "ddpm-steps", "flow"])
def test_joint_shares(spark, tmp_path, make):
    df = mixture(spark)
    model = make().fit(df, ["c", "d", "y"])
    syn = model.generate(3000)
    assert syn.columns == df.columns and dict(syn.dtypes) == dict(df.dtypes) and syn.count() == 3000
    assert distance(shares(df, "y"), shares(syn, "y")) < 0.04
    assert distance(shares(df, "c", "y"), shares(syn, "c", "y")) < 0.1
    assert distance(shares(df, "d"), shares(syn, "d")) < 0.1
    for label, mean in (("a", 4), ("b", -4)):
        assert abs(syn.where(F.col("y") == label).agg(F.avg("x")).first()[0] - mean) < 1
    assert abs(syn.where("k IS NULL").count() / 3000 - 0.2) < 0.08
    state.save(model, str(tmp_path / "m"), spark)
    assert sorted(map(str, state.load(str(tmp_path / "m"), spark).generate(40).collect())) == sorted(map(str, model.generate(40).collect()))


def test_new_combinations_and_wide_categories(spark):
    """Levels and their combinations are drawn, not copied; wider categories than CANDIDATES are judged by samples."""
    n = 1500
    u = uniforms(3, 0, np.arange(n), 3)
    rows = [(f"a{int(x * 24):02}", f"b{int(y * 12):02}", "only") for x, y, _ in u ** [1.5, 1, 1]]
    df = spark.createDataFrame(rows, "a string, b string, c string")
    syn = BoostedDiffusionGenerator(num_timesteps=6, max_iter=6, model_per_timestep=False).fit(df, ["a", "b", "c"]).generate(1500).toPandas()
    seen = Counter(map(tuple, syn[["a", "b"]].to_numpy()))
    assert set(seen) - {(a, b) for a, b, _ in rows}
    assert set(syn["c"]) == {"only"} and set(syn["a"]) <= {a for a, _, _ in rows}
    want, got = Counter(a for a, _, _ in rows), Counter(syn["a"])
    assert sum(abs(want[k] - got[k]) for k in {*want, *got}) / 2 / n < 0.2


def test_limits(spark, monkeypatch):
    df = mixture(spark, 60)
    with pytest.raises(ValueError, match="objective"):
        BoostedDiffusionGenerator(objective="z")
    with pytest.raises(ValueError, match="positive"):
        BoostedFlowGenerator(num_timesteps=0)
    with pytest.raises(ValueError, match="not found"):
        BoostedFlowGenerator("none").fit(df, ["c", "d", "y"])
    monkeypatch.setattr(base, "MAX_LEVELS", 5)
    with pytest.raises(ValueError, match="levels"):
        BoostedDiffusionGenerator("y").fit(df, ["c", "d", "y"])
