import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabweft.functions import counter
from tabweft.functions.counter import uniforms
from tabweft.generators.registry import get_generator
from tabweft.generators import tabddpm as td
from tabweft.operators.network import Adam, Denoiser, Trainer, silu
from tabweft.sources import state


def test_counter_numbers_depend_on_the_row_only():
    ids = np.array([5, -3, 7, 1 << 40, 5])
    u = counter.uniforms(1, 2, ids, 3)
    assert (u[0] == u[4]).all() and (u[0] == counter.uniforms(1, 2, ids[:1], 3)).all() and (u[0] == counter.uniforms(1, 2, ids[:1], 9)[:, :3]).all()
    many = counter.uniforms(3, 4, np.arange(100_000), 2)
    assert abs(many.mean() - 0.5) < 0.005 and abs(np.corrcoef(many.T)[0, 1]) < 0.01 and abs(np.corrcoef(many[1:, 0], many[:-1, 0])[0, 1]) < 0.01
    z = counter.normals(3, 4, np.arange(100_000), 3)
    assert np.abs(z.mean(0)).max() < 0.02 and np.abs(z.std(0) - 1).max() < 0.02 and np.abs(np.corrcoef(z.T) - np.eye(3)).max() < 0.02
    assert not (counter.uniforms(3, 5, np.arange(9), 1) == counter.uniforms(3, 4, np.arange(9), 1)).any()


def test_silu_derivative():
    x = np.linspace(-30, 30, 41)
    value, slope = silu(x)
    assert np.allclose(slope, (silu(x + 1e-6)[0] - silu(x - 1e-6)[0]) / 2e-6, atol=1e-6)


@pytest.mark.parametrize(("numbers", "sizes", "classes"), [(2, [3, 4], 3), (3, [], 0), (0, [5], 0)])
def test_gradient_equals_finite_differences(numbers, sizes, classes):
    rng = np.random.default_rng(0)
    model = td.MixedDiffusion(numbers, sizes, classes, 20, "cosine", 8, 6, 2)
    n = 40
    arrays = [np.arange(n), rng.normal(size=(n, numbers)), np.stack([rng.integers(0, s, n) for s in sizes], 1) if sizes else np.zeros((n, 0), int), rng.integers(0, max(1, classes), n)]
    p = model.network.start(1) + 0.1 * rng.normal(size=model.network.size)
    loss, grad = model.gradient(p, arrays, 7, 3)
    assert loss > 0
    for k in rng.choice(len(p), 60, replace=False):
        e = np.zeros_like(p)
        e[k] = 1e-5
        slope = (model.gradient(p + e, arrays, 7, 3)[0] - model.gradient(p - e, arrays, 7, 3)[0]) / 2e-5
        assert slope == pytest.approx(grad[k], rel=1e-3, abs=1e-5), k


def test_noise_and_posterior_of_categories():
    model = td.MixedDiffusion(0, [3], 0, 30, "cosine", 8, 6, 1)
    n = 200_000
    for t in (0, 10, 29):
        z = model.noised(np.zeros((n, 0)), np.ones((n, 1), int), np.full(n, t), np.zeros((n, 0)), counter.uniforms(1, t, np.arange(n), 1))
        want = np.full(3, (1 - model.bar[t]) / 3) + np.array([0, model.bar[t], 0])
        assert np.abs(z.mean(0) - want).max() < 0.005
    # Bayes' rule, by enumeration
    t, start = 10, np.array([[0.0, 1.0, 0.0]])
    one = lambda a: a * np.eye(3) + (1 - a) / 3
    for now in range(3):
        joint = (one(model.before[t])[1]) * one(model.alpha[t])[:, now]
        got, _ = model.posterior(np.eye(3)[now : now + 1], start, np.array([t]))
        assert np.allclose(got / got.sum(), joint / joint.sum())


def line():
    """Least squares: a model that training must solve."""

    class Line:
        columns = ("v", "w")

        def arrays(self, batch):
            return [batch.column(c).to_numpy() for c in ("id", "v", "w")]

        def gradient(self, p, arrays, seed, stream):
            _, v, w = arrays
            gap = p[0] * v + p[1] - w
            return float((gap * gap).sum()), np.array([(2 * gap * v).sum(), (2 * gap).sum()])

    return Line()


def line_rows(spark, n):
    return spark.range(n).select("id", (F.col("id") % 17 / 8.0 - 1).alias("v")).withColumn("w", 3 * F.col("v") - 1)


def test_averages_solve_least_squares(spark):
    trainer = Trainer(12, batch=32, optimizer=Adam(0.2, 0.0), mean_rate=0.8, seed=1)
    p, losses = trainer.fit(line_rows(spark, 6000).repartition(18), line(), np.zeros(2))
    assert np.allclose(p, [3, -1], atol=0.05) and losses[-1] < losses[0] / 50 and len(losses) == 12


def test_sums_equal_steps_on_one_machine(spark):
    """Full batches: the steps are those of plain Adam; the result is the mean with falling weights."""
    trainer = Trainer(6, "sum", batch=100, batches=1, optimizer=Adam(0.3, 0.01), mean_rate=0.5)
    p, losses = trainer.fit(line_rows(spark, 400).repartition(5), line(), np.zeros(2))
    rows = line_rows(spark, 400).toPandas().to_numpy()
    state, kept, weights, want = np.zeros((3, 2)), [], [], []
    for k in range(6):
        loss, grad = line().gradient(state[0], rows.T, 0, 0)
        want.append(loss / 400)
        Adam(0.3, 0.01).step(state, grad / 400, k + 1, 0.3 * (1 - k / 6))
        kept.append(state[0].copy())
        weights.append(0.5 ** (6 - k))
    assert np.allclose(p, np.average(kept, axis=0, weights=weights)) and np.allclose(losses, want)


def test_sums_do_not_depend_on_partitioning(spark):
    rows = line_rows(spark, 500)
    trainer = Trainer(4, "sum", batch=50, batches=2, optimizer=Adam(0.1, 0.0), seed=1)
    a, b = (trainer.fit(rows.repartition(k), line(), np.zeros(2))[0] for k in (1, 17))
    assert np.allclose(a, b, rtol=1e-9)


def test_trainer_ends_in_time_and_bounds_the_state(spark, monkeypatch):
    rows = spark.range(50).select("id", F.lit(1.0).alias("v"), F.lit(1.0).alias("w"))
    assert len(Trainer(1000, seconds=0.0).fit(rows, line(), np.zeros(2))[1]) == 1
    monkeypatch.setattr("tabweft.operators.network.STATE_BYTES", 10)
    with pytest.raises(ValueError, match="too many"):
        Trainer(1).fit(rows, line(), np.zeros(2))


def mixture(spark, n=4000):
    """Class decides the mean of x and the level of c; half of c's odd levels are missing flags of z."""
    u = counter.uniforms(9, 0, np.arange(n), 3)
    z = counter.normals(9, 1, np.arange(n), 2)
    rows = []
    for i in range(n):
        y = "a" if u[i, 0] < 0.7 else "b"
        c = "p" if u[i, 1] < (0.9 if y == "a" else 0.2) else "q"
        rows.append((float(z[i, 0] + (4 if y == "a" else -4)), int(10 * abs(z[i, 1])) if u[i, 2] < 0.8 else None, c, y))
    return spark.createDataFrame(rows, "x double, k int, c string, y string").repartition(3)


def shares(df, *columns):
    rows = df.groupBy(*columns).count().collect()
    total = sum(r["count"] for r in rows)
    return {tuple(r[c] for c in columns): r["count"] / total for r in rows}


@pytest.mark.parametrize("target", ["y", None])
def test_tabddpm_learns_a_mixture(spark, tmp_path, target):
    df = mixture(spark)
    model = get_generator("tabddpm")(target_column=target, epochs=20 if target else 45, lr=0.01, batch_size=64, num_timesteps=40, embedding_dim=32, model_params={"n_units_hidden": 64, "n_layers_hidden": 2}, random_state=3)
    model.fit(df, ["c", "y"])
    assert model.losses[-1] < 0.85 * model.losses[0]
    syn = model.generate(3000)
    assert syn.columns == df.columns and dict(syn.dtypes) == dict(df.dtypes) and syn.count() == 3000
    want, got = shares(df, "c", "y"), shares(syn, "c", "y")
    assert sum(abs(want.get(k, 0) - got.get(k, 0)) for k in {*want, *got}) / 2 < (0.08 if target else 0.12)
    for label, mean in (("a", 4), ("b", -4)):
        m, s = syn.where(F.col("y") == label).agg(F.avg("x"), F.stddev("x")).first()
        assert abs(m - mean) < 0.5 and 0.5 < s < 2
    gone = syn.where("k IS NULL").count() / 3000
    assert abs(gone - 0.2) < 0.06
    if target:
        state.save(model, str(tmp_path / "m"), spark)
        again = state.load(str(tmp_path / "m"), spark).generate(50)
        assert sorted(map(str, again.collect())) == sorted(map(str, model.generate(50).collect()))


def test_tabddpm_limits(spark, monkeypatch):
    df = mixture(spark, 50)
    with pytest.raises(ValueError, match="not found"):
        get_generator("tabddpm")(target_column="none", epochs=1).fit(df, ["c", "y"])
    with pytest.raises(ValueError, match="dropout"):
        get_generator("tabddpm")(model_params={"dropout": 0.5})
    monkeypatch.setattr(td, "MAX_LEVELS", 3)
    with pytest.raises(ValueError, match="levels"):
        get_generator("tabddpm")(epochs=1).fit(df, ["c", "y"])


def test_training_by_sums_and_numbers_only(spark):
    df = mixture(spark, 600).select("x")
    model = get_generator("tabddpm")(training_steps=8, training="sum", batch_size=128, num_timesteps=10, embedding_dim=8, model_params={"n_units_hidden": 8, "n_layers_hidden": 1}).fit(df, [])
    assert len(model.losses) == 8 and all(math.isfinite(x) for x in model.losses)
    assert model.generate(20).count() == 20 and Counter(dict(model.generate(3).dtypes)) == Counter({"x": "double"})


def test_embeddings_are_computed_once_for_each_step_of_a_batch(monkeypatch):
    net, asked, waves = Denoiser(4, 8, 16, 1, 3), [], Denoiser.waves
    monkeypatch.setattr(Denoiser, "waves", lambda self, t: asked.append(len(t)) or waves(self, t))
    p, u = net.start(1) + 0.1, uniforms(2, 1, np.arange(60), 8)
    x, t, y = u[:, :4], np.floor(u[:, 4] * 5), np.floor(u[:, 5] * 3).astype(int)
    out, kept = net.forward(p, x, t, y)
    grad = net.backward(p, kept, u[:, 4:])
    assert asked == [5]
    rows = [net.forward(p, x[i : i + 1], t[i : i + 1], y[i : i + 1]) for i in range(60)]
    assert np.allclose(out, np.concatenate([o for o, _ in rows]))
    assert np.allclose(grad, sum(net.backward(p, k, u[i : i + 1, 4:]) for i, (_, k) in enumerate(rows)))
