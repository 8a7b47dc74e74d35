"""Registered queries of preprocessing, neighbours, scores, splits, generators and models, and their SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tabweft.functions.normal import truncated_normals
from tabweft.functions.randomness import bootstrap, hash_sample, stratified_split, uniform
from tabweft.generators import diffusion as df_
from tabweft.generators.boosted import BoostedDiffusionGenerator, BoostedFlowGenerator
from tabweft.generators.base import SMOTEGenerator, UnivariateGenerator
from tabweft.generators.tabddpm import TabDDPMGenerator
from tabweft.generators.trees import ARFGenerator, SynthpopGenerator
from tabweft.operators import fidelity, mixtures, ml, privacy, scores
from tabweft.operators import neighbours as nb
from tabweft.operators import preprocess as pp
from tabweft.plans.fidelity_queries import rounded
from tabweft.plans.fixture import BASE_SQL, CAT, NUM, SPEC, base, real_sql, sides, u_sql, written
from tabweft.spec import FeatureSpec
from tabweft.streaming import monitor

_W = f"WITH {BASE_SQL}"
_union = " UNION ALL ".join


def _table(name):
    return lambda spark, d: spark.read.parquet(f"{d}/{name}.parquet")


def _gaps(spark, d):
    """Parts whose price is missing where a hash says so."""
    part = _table("part")(spark, d)
    return part.select("p_partkey", "p_brand", "p_size", F.when(uniform(1, "gap", "p_partkey") >= 0.2, F.col("p_retailprice")).alias("price"))


_GAPS = f"gaps AS (SELECT p_partkey, p_brand, p_size, CASE WHEN {u_sql(1, 'gap', 'p_partkey')} >= 0.2e0 THEN p_retailprice END AS price FROM part)"


def _impute(method):
    return lambda spark, d: rounded(pp.TabularImputer(method).fit_transform(g := _gaps(spark, d), ["p_size", "price"]).select("p_partkey", F.col("price").cast("double").alias("price")))


def _precision(spark, d):
    schema = pp.TabularSchema.from_dataframe(_table("part")(spark, d), ["p_size", "p_retailprice"])
    return spark.createDataFrame(list(schema.precision.items()), "variable string, decimals int")


def _restore(spark, d):
    part = _table("part")(spark, d).select("p_partkey", "p_size", "p_retailprice")
    schema = pp.TabularSchema.from_dataframe(part.select(F.bround("p_retailprice", 1).alias("p_retailprice"), "p_size", "p_partkey"))
    noisy = part.select((F.col("p_retailprice") + uniform(2, "noise", "p_partkey")).alias("p_retailprice"), (F.col("p_size") + uniform(3, "noise", "p_partkey")).alias("p_size"), "p_partkey")
    return schema.restore(noisy)


def _constants(spark, d):
    found = pp.constant_columns(base(spark, d).select(F.lit(1.5).alias("fixed"), F.lit(None).cast("string").alias("empty"), "status", "month"))
    return spark.createDataFrame([(k,) for k in found], "variable string")


def _constraints(spark, d):
    rows = base(spark, d).select("k", "total", "bal", (F.col("total") + F.col("bal")).alias("both"))
    e = pp.ConstraintEnforcer(["both = total + bal", "total > bal"])
    return rounded(e.inverse_transform(e.transform(rows)).select("k", "total", "bal", "both"))


def _constraint_model(spark, d):
    rows = base(spark, d).select("k", "total", "bal", (F.col("total") + F.col("bal")).alias("both"))
    return rounded(pp.ConstraintEnforcer(["both = total + bal", "total > bal"]).transform(rows))


def _space_rows(spark, d):
    train, syn = sides(spark, d, "real", "syn")
    space = nb.MixedSpace(train, SPEC)
    return space.of(train), space.of(syn)


def _nn1(spark, d):
    train, syn = _space_rows(spark, d)
    return rounded(nb.nearest(syn, train, 1).select("id", "d"))


def _top3(spark, d):
    train, syn = _space_rows(spark, d)
    return rounded(nb.nearest(syn, train, 3).select("id", "rank", "d"))


def _sides3(fn):
    return lambda spark, d: rounded(fn(*written(spark, d, "train", "test", "syn")))


def _scored(spark, d):
    """Every order with a label and two scores that know a little of it."""
    rows = base(spark, d)
    y = (F.col("status") == "F").cast("int")
    return rows.select(F.col("k").alias("id"), y.alias("y"), F.round(uniform(4, "s1", "k") + 0.3 * y, 3).alias("a"), F.round(uniform(5, "s2", "k") * 2 + 0.1 * y, 2).alias("b"))


_SCORED = f"{_W}, sc AS (SELECT k AS id, (status = 'F')::INT AS y, round({u_sql(4, 's1', 'k')} + 0.3e0 * (status = 'F')::INT, 3) AS a, round({u_sql(5, 's2', 'k')} * 2 + 0.1e0 * (status = 'F')::INT, 2) AS b FROM base)"


def _attack(spark, d):
    rows = _scored(spark, d)
    return rounded(scores.attack_scores(rows.withColumn("score", F.col("a"))))


def _ensemble(how):
    return lambda spark, d: rounded(scores.ensemble(_scored(spark, d), ["a", "b"], how).select("id", "score"))


def _predicted(spark, d):
    return base(spark, d).select(F.col("priority").alias("label"), F.when(uniform(6, "pred", "k") < 0.7, F.col("priority")).otherwise("5-LOW").alias("prediction"))


def _regressed(spark, d):
    return rounded(scores.regression(base(spark, d).select(F.col("total").alias("label"), (F.col("total") * 0.9 + F.col("bal")).alias("prediction"))))


def _split(spark, d):
    parts = stratified_split(base(spark, d), "status", 0.2, 11, "k")
    return parts.select("k", "is_test")


def _sample(spark, d):
    rows = base(spark, d)
    return hash_sample(rows, rows.count() // 3, 12, "sample", "k").select("k")


def _bootstrap(spark, d):
    rows = base(spark, d)
    drawn = bootstrap(rows, rows.count(), 13, "k")
    return rows.join(drawn.groupBy("k").agg(F.count("*").alias("times")), "k", "left").select("k", F.coalesce("times", F.lit(0)).alias("times"))


def _roles(spark, d):
    train, test = sides(spark, d, "train", "test")
    reference, rows = privacy.mia_roles(train, test, SPEC, 0.5, 0.7, 14)
    return reference.select("k", F.lit("reference").alias("part")).unionByName(rows.select("k", F.when(F.col("y") == 1, "member").otherwise("nonmember").alias("part")))


def _univariate(spark, d):
    train = sides(spark, d, "all")[0]
    made = UnivariateGenerator(21, 50).fit(train.select("total", "priority", "status"), ["priority", "status"])._generate(train.count())
    return rounded(made)


def _as_many(spark, d, model):
    """As many rows as were fitted."""
    rows = written(spark, d, "all")[0].drop("k")
    return rounded(model.fit(rows, list(CAT)).generate(rows.count()))


def _minmax(spark, d):
    return rounded(pp.minmax_scale(base(spark, d).select("k", "total", "bal"), ["total", "bal"]))


def _standard(spark, d):
    return rounded(pp.standard_scale(base(spark, d).select("k", "total", "bal"), ["total", "bal"]))


def _onehot(spark, d):
    return pp.onehot(base(spark, d).select("k", "status"), "status", ["F", "O"])


def _kbins(spark, d):
    return pp.kbins(base(spark, d).select("k", "total"), "total", 7)


def _quantile(spark, d):
    rows = base(spark, d).select("k", "bal")
    return rounded(rows.select("k", pp.QuantileMap.fit(rows, "bal", 21).value(uniform(8, "q", "k")).alias("bal")))


def _of_orders(spark, d, schedule, steps):
    """Every order with the step of a schedule that its key names."""
    rows = base(spark, d).select("k", (F.col("k") % steps).cast("int").alias("t"))
    return rounded(rows.join(F.broadcast(schedule), "t"))  # one row for each step


def _q_sample(spark, d):
    s = df_.schedule(spark, 10, "cosine")
    rows = base(spark, d).select("k", (F.col("bal") / 10000).alias("x"), (F.col("k") % 10).cast("int").alias("t")).join(F.broadcast(s), "t")
    return rounded(rows.select("k", df_.q_sample(F.col("x"), F.col("alpha_bar"), uniform(9, "noise", "k")).alias("xt")))


def _posterior(spark, d):
    s = df_.schedule(spark, 10, "cosine").withColumn("before", F.col("alpha_bar") / F.col("alpha"))
    rows = base(spark, d).select("k", (F.col("bal") / 10000).alias("x"), (F.col("k") % 10).cast("int").alias("t")).join(F.broadcast(s), "t")
    mean, variance = df_.posterior(F.col("x"), F.col("x") * 0.5, F.col("beta"), F.col("alpha_bar"), F.col("before"))
    return rounded(rows.select("k", mean.alias("mean"), variance.alias("variance")))


def _multinomial(spark, d):
    w = df_.multinomial_posterior(F.lit(0.6), (F.col("status") == "F").cast("double"), F.lit(0.9), F.lit(0.7), 3)
    return rounded(base(spark, d).select("k", w.alias("weight")))


def _times(spark, d):
    """Every order with a time in (0, 1), a place and a level."""
    return base(spark, d).select("k", ((F.col("k") % 97 + 1) / 99.0).alias("t"), (F.col("bal") / 10000).alias("x"), "status")


def _levels(spark, d):
    """Levels of a column among its quantiles, which a normal quantile function would take further."""
    rows = base(spark, d).select("k", "bal")
    return rows.select("k", pp.QuantileMap.fit(rows, "bal", 21).level(F.col("bal")).alias("level"))


def _truncated(spark, d):
    """A draw within [0, 2] around 0.5, from the exact ends of the distribution function at the levels."""
    rows = base(spark, d).select("k", uniform(33, "t", "k").alias("u"))
    out = truncated_normals(rows, {"x": (F.col("u"), F.lit(0.5), F.lit(1.0), F.lit(0.0), F.lit(2.0))})
    return out.agg(F.count("*").alias("rows"), F.sum((F.col("x") < 0).cast("long") + (F.col("x") > 2).cast("long")).alias("outside"), F.round(F.avg("x"), 1).alias("mean"))


def _steps_back(spark, d):
    """One step of each sampler for every order."""
    t, x = F.col("t"), F.col("x")
    noise, den, to = uniform(31, "noise", "k"), x * math.sqrt(0.5) + 0.1, t / 2
    euler = df_.edm_euler(x, den, t, to)
    beta = df_.vp_beta(t)
    return rounded(_times(spark, d).select(
        "k", df_.flow_step(x, den, 0.1).alias("flow"), df_.vp_alpha_bar(t).alias("vp_bar"), df_.vp_step(x, den, beta, 0.01, noise).alias("vp"), df_.ddim(x, noise, F.lit(0.8)).alias("ddim"),
        euler.alias("euler"), df_.edm_heun(x, den, t, euler, euler * math.sqrt(0.5) + 0.1, to).alias("heun"), df_.edm_weight(t).alias("weight"), df_.edm_churn(t, 50).alias("churn"),
    ))


def _noise_levels(spark, d):
    t = F.col("t")
    c = [F.lit(v) for v in (0.5, -0.3, 0.8)]
    return rounded(_times(spark, d).select(
        "k", df_.power_mean_sigma(t).alias("power_mean"), df_.log_linear_noise(t).alias("log_linear"), df_.log_linear_noise(t, power=1.5).alias("log_linear_column"),
        df_.logistic_timewarp(t, 0.3, 1.7).alias("warp"), df_.logistic_timewarp_density(t, 0.3, 1.7).alias("warp_density"), df_.logistic_timewarp_quantile(t, 0.3, 1.7).alias("warp_quantile"),
        df_.polynomial_gamma(t, *c).alias("gamma"), df_.polynomial_gamma_slope(t, *c).alias("gamma_slope"), df_.learning_rate(F.col("k") % 200, 150, 0.01, 0.001, 30).alias("rate"),
    ))


def _absorbing(spark, d):
    mask = F.col("status") == "P"
    return rounded(_times(spark, d).select("k", df_.absorbing_reverse(F.lit(0.6), mask, df_.masked_share(F.col("t")), df_.masked_share(F.col("t") / 2)).alias("share")))


def _spread_times(spark, d):
    rows = base(spark, d)
    return rounded(df_.low_discrepancy_times(rows.select("k"), 1000, 5, "k").select("k", "t"))


def _stamped(df):
    """Timestamps as text, the same in every engine and time zone."""
    return df.select(*[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) if t == "timestamp" else F.col(c) for c, t in df.dtypes])


def _long_row(df):
    return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in df.columns])).alias("e")).select("e.*")


def _dict(spark, values):
    return rounded(spark.createDataFrame([(k, None if v is None else float(v)) for k, v in values.items()], "metric string, value double"))


_ML_SPEC = FeatureSpec(CAT, NUM, "status", "k")
_SMALL = {"maxIter": 5, "maxDepth": 3}

QUERIES = {
    "schema_precision": _precision,
    "schema_restore": _restore,
    "impute_mean": _impute("mean"),
    "impute_median": _impute("median"),
    "impute_most_frequent": _impute("most_frequent"),
    "impute_drop": _impute("drop"),
    "constant_columns": _constants,
    "constraint_transform": _constraint_model,
    "constraint_round_trip": _constraints,
    "onehot_half": _onehot,
    "minmax_scale": _minmax,
    "standard_scale": _standard,
    "kbins_uniform": _kbins,
    "quantile_transform": _quantile,
    "gower_nearest": _nn1,
    "gower_top_3": _top3,
    "dcr_scores": _sides3(lambda tr, te, sy: _long_row(privacy.dcr_once(tr, te, sy, SPEC))),
    "prdc": lambda spark, d: rounded(nb.prdc(*written(spark, d, "real", "syn"), SPEC, 5)),
    "alpha_beta_curves": lambda spark, d: rounded(nb.alpha_beta_curves(*written(spark, d, "real", "syn"), SPEC)),
    "alpha_precision_beta_recall": lambda spark, d: rounded(nb.alpha_precision_beta_recall(*written(spark, d, "real", "syn"), SPEC)),
    "attack_scores": _attack,
    "ensemble_rank_avg": _ensemble("rank_avg"),
    "ensemble_mean": _ensemble("mean"),
    "weighted_f1": lambda spark, d: rounded(scores.weighted_f1(_predicted(spark, d))),
    "regression_scores": _regressed,
    "stratified_split": _split,
    "hash_sample": _sample,
    "bootstrap": _bootstrap,
    "mia_roles": _roles,
    "univariate_generator": _univariate,
    "diffusion_schedule_cosine": lambda spark, d: _of_orders(spark, d, df_.schedule(spark, 50, "cosine"), 50),
    "diffusion_schedule_linear": lambda spark, d: _of_orders(spark, d, df_.schedule(spark, 50, "linear"), 50),
    "edm_sigmas": lambda spark, d: _of_orders(spark, d, df_.edm_sigmas(spark, 18), 19),
    "q_sample": _q_sample,
    "gaussian_posterior": _posterior,
    "multinomial_posterior": _multinomial,
    "angle_schedule": lambda spark, d: _of_orders(spark, d, df_.cosine_angle(spark, 50), 50),
    "sampler_steps": _steps_back,
    "noise_levels": _noise_levels,
    "absorbing_reverse": _absorbing,
    "low_discrepancy_times": _spread_times,
    "quantile_normal": lambda spark, d: rounded(_levels(spark, d)),
    "onehot_inverse": lambda spark, d: pp.onehot_inverse(pp.onehot(base(spark, d).select("k", "status"), "status", ["F", "O", "P"]), "status", ["F", "O", "P"]),
    "density_curves": lambda spark, d: rounded(fidelity.density_curves(*sides(spark, d, "real", "syn"), FeatureSpec((), ("bal",)), 20)),
    "truncated_normals": _truncated,
    "distributional_tree": lambda spark, d: rounded(mixtures.distributional_tree(base(spark, d), "total", max_depth=2, min_bucket=20)),
    "dpi_attack": lambda spark, d: rounded(privacy.attack("dpi", *written(spark, d, "train", "test", "syn"), SPEC)),
    "classifier_attack": lambda spark, d: rounded(privacy.attack("classifier", *written(spark, d, "train", "test", "syn"), SPEC)),
    "domias_attack": lambda spark, d: rounded(privacy.attack("domias", *written(spark, d, "train", "test", "syn"), SPEC)),
    "ensemble_attack": lambda spark, d: rounded(privacy.ensemble_attack(*written(spark, d, "train", "test", "syn"), SPEC)),
    "event_constraint_rates": lambda spark, d: _stamped(monitor.constraint_rates(_table("events")(spark, d), ["value >= 50", "event_type != 'click'"])),
    "event_level_counts": lambda spark, d: _stamped(monitor.level_counts(_table("events")(spark, d), "event_type")),
    "mle": lambda spark, d: _dict(spark, ml.mle(*written(spark, d, "train", "test", "syn"), _ML_SPEC, "status", model_name="randomforest", params={"numTrees": 10, "maxDepth": 4})),
    "classifier_test": lambda spark, d: _dict(spark, {"auc": ml.classifier_test(*(x := written(spark, d, "train", "test", "syn"))[:2], x[2].where(uniform(1, "half", "k") < 0.7), x[2].where(uniform(1, "half", "k") >= 0.7), SPEC, params=_SMALL)}),
    "aia": lambda spark, d: _dict(spark, ml.aia(*written(spark, d, "real", "syn"), SPEC, ["priority", "bal"], model_name="decisiontree", params={"maxDepth": 4})),
    "smote_generator": lambda spark, d: _as_many(spark, d, SMOTEGenerator("status")),
    "synthpop_generator": lambda spark, d: _as_many(spark, d, SynthpopGenerator(K=2, max_depth=4)),
    "arf_generator": lambda spark, d: _as_many(spark, d, ARFGenerator(num_trees=5, max_iters=2, max_depth=5)),
    "xgbdiffusion_generator": lambda spark, d: _as_many(spark, d, BoostedFlowGenerator("status", num_timesteps=10, max_iter=4, model_per_timestep=False)),
    "xgbddpm_generator": lambda spark, d: _as_many(spark, d, BoostedDiffusionGenerator("status", num_timesteps=10, max_iter=4, model_per_timestep=False)),
    "tabddpm_generator": lambda spark, d: _as_many(spark, d, TabDDPMGenerator("status", epochs=10, lr=0.01, batch_size=256, num_timesteps=30, embedding_dim=32, model_params={"n_units_hidden": 64, "n_layers_hidden": 2})),
}

_LIM = "lim AS (SELECT " + ", ".join(f"min({c})::DOUBLE AS {c}_lo, (max({c}) - min({c}))::DOUBLE AS {c}_w" for c in NUM) + " FROM train)"


def _scaled(t: str) -> str:
    return f"s_{t} AS (SELECT k, {', '.join(f'({c} - {c}_lo) / {c}_w AS {c}' for c in NUM)}, {', '.join(CAT)} FROM {t}, lim)"


_D = " + ".join([f"abs(q.{c} - r.{c})" for c in NUM] + [f"(q.{c} <> r.{c})::INT" for c in CAT])
_SPACE = f"{_W}, {_LIM}, {_scaled('train')}, {_scaled('test')}, {_scaled('syn')}"


def _near(name: str, q: str, r: str, k: int, own: bool = False) -> str:
    return f"{name} AS (SELECT q.k AS id, min({_D}, {k}) AS ds FROM s_{q} q, s_{r} r {'WHERE q.k <> r.k' if own else ''} GROUP BY q.k)"


_AVG_RANK = lambda c: f"((rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2e0 - 1) / (count(*) OVER () - 1))"
_NNDR = lambda t: f"SELECT id, ds[1] AS d1, CASE WHEN ds[2] = 0 THEN 1e0 ELSE ds[1] / ds[2] END AS nndr FROM {t}"
_DCR = f"""{_SPACE}, {_near('a', 'syn', 'train', 2)}, {_near('b', 'syn', 'test', 1)}, {_near('c', 'test', 'train', 2)},
    s AS ({_NNDR('a')}), te AS ({_NNDR('c')}), q AS (SELECT quantile_cont(d1, 0.02) AS q2, quantile_cont(d1, 0.05) AS q5, avg(nndr) AS m, quantile_cont(nndr, 0.02) AS n2, quantile_cont(nndr, 0.05) AS n5 FROM te),
    o AS (SELECT avg((d1 < b.ds[1])::INT) AS train, avg((d1 < q2)::INT) AS p2, avg((d1 < q5)::INT) AS p5, avg(nndr) AS m, quantile_cont(nndr, 0.02) AS n2, quantile_cont(nndr, 0.05) AS n5 FROM s JOIN b USING (id), q)"""
_PRDC = f"""{_SPACE}, {_near('rr', 'train', 'train', 5, True)}, {_near('ss', 'syn', 'syn', 5, True)},
    p AS (SELECT q.k AS sid, r.k AS rid, {_D} AS d FROM s_syn q, s_train r),
    j AS (SELECT sid, rid, d, rr.ds[5] AS rrad, ss.ds[5] AS srad FROM p JOIN rr ON rr.id = rid JOIN ss ON ss.id = sid),
    bs AS (SELECT sid, max((d < rrad)::INT) AS hit, sum((d < rrad)::INT) AS n FROM j GROUP BY sid), br AS (SELECT rid, max((d < srad)::INT) AS hit, (min(d) < max(rrad))::INT AS cov FROM j GROUP BY rid)"""
_AB = f"""{_SPACE}, m AS (SELECT {', '.join(f'avg({c}) AS {c}' for c in NUM)} FROM s_train), ms AS (SELECT {', '.join(f'avg({c}) AS {c}' for c in NUM)} FROM s_syn),
    """ + ", ".join(f"f_{t}_{c} AS (SELECT {c} AS v, count(*) / (SELECT count(*) FROM s_{t})::DOUBLE AS f FROM s_{t} GROUP BY 1)" for t in ("train", "syn") for c in CAT)


def _centre(name: str, df: str, of: str) -> str:
    m = "m" if of == "train" else "ms"
    joins = " ".join(f"LEFT JOIN f_{of}_{c} ON f_{of}_{c}.v = x.{c}" for c in CAT)
    return f"{name} AS (SELECT k AS id, {' + '.join([f'abs(x.{c} - {m}.{c})' for c in NUM] + [f'1 - coalesce(f_{of}_{c}.f, 0)' for c in CAT])} AS dc FROM s_{df} x CROSS JOIN {m} {joins})"


_LEVELS = "[" + ", ".join(f"{i}e0 / 29" for i in range(30)) + "]"
_CURVES = f"""{_AB}, {_centre('ct', 'train', 'train')}, {_centre('cs', 'syn', 'train')}, {_centre('cy', 'syn', 'syn')},
    qt AS (SELECT unnest(range(30)) AS i, unnest(quantile_cont(dc, {_LEVELS})) AS r FROM ct), qy AS (SELECT unnest(range(30)) AS i, unnest(quantile_cont(dc, {_LEVELS})) AS r FROM cy),
    {_near('own', 'train', 'train', 1, True)}, ns AS (SELECT q.k AS id, arg_min(r.k, ({_D}, r.k)) AS sid, min({_D}) AS ds FROM s_train q, s_syn r GROUP BY q.k),
    h AS (SELECT ns.ds <= own.ds[1] AS near, cy.dc FROM ns JOIN own ON own.id = ns.id JOIN cy ON cy.id = ns.sid),
    curves AS (SELECT i / 29e0 AS alpha, (SELECT avg((dc <= qt.r)::INT) FROM cs) AS precision, (SELECT avg((near AND dc <= qy.r)::INT) FROM h) AS recall FROM qt JOIN qy USING (i))"""
_STEPS = "st AS (SELECT a AS x, sum(y) AS pos, sum(1 - y) AS neg FROM sc GROUP BY a), cu AS (SELECT *, sum(pos) OVER o AS cpos, sum(neg) OVER o AS cneg, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM st WINDOW o AS (ORDER BY x))"


def _top(k: float) -> str:
    return f"(SELECT avg(y) FROM (SELECT y FROM sc ORDER BY a DESC, id DESC LIMIT (SELECT greatest(1, ceil({k}e0 * count(*)))::BIGINT FROM sc))) / (SELECT avg(y) FROM sc)"


_ATTACK_SQL = "SELECT 'auc' AS metric, round(sum(pos * (cneg - neg / 2e0)) / max(p * n), 6) AS value FROM cu " + "".join(f" UNION ALL SELECT 'lift_{m}', round({_top(k)}, 6) UNION ALL SELECT 'tpr_at_fpr_{m}', round(coalesce((SELECT max((p - cpos + pos)::DOUBLE / p) FROM cu WHERE (n - cneg + neg)::DOUBLE / n <= {k}e0), 0), 6)" for k, m in ((0.1, "010"), (0.05, "005"), (0.01, "001")))
_FILL = lambda e: f"WITH {_GAPS} SELECT p_partkey, round(coalesce(price, (SELECT {e} FROM gaps))::DOUBLE, 6) AS price FROM gaps"
_BARS = lambda n: f"sch AS (SELECT t, beta, 1 - beta AS alpha, exp(sum(ln(1 - beta)) OVER (ORDER BY t)) AS alpha_bar FROM (SELECT t::INT AS t, least(1 - power(cos(((t + 1) / {n}e0 + 0.008e0) / 1.008e0 * pi() / 2), 2) / power(cos((t / {n}e0 + 0.008e0) / 1.008e0 * pi() / 2), 2), 0.999e0) AS beta FROM range({n}) r(t)))"
_UNI_Q = "[" + ", ".join(f"{i}e0 / 49" for i in range(50)) + "]"


_TIMES = f"{_W}, tm AS (SELECT k, (k % 97 + 1) / 99e0 AS t, bal / 10000 AS x, status FROM base)"
# the attack by the 20 nearest of reference and synthetic rows; ties go to the smaller 2 * key + side
_DPI = f"""{_W}, te AS (SELECT *, row_number() OVER (ORDER BY {u_sql(0, 'mia-test', 'k')}, k) <= floor(0.5e0 * count(*) OVER ()) AS ref FROM test), reference AS (SELECT * FROM te WHERE ref),
    rws AS (SELECT k, {', '.join(NUM + CAT)}, 0 AS y FROM te WHERE NOT ref UNION ALL SELECT k, {', '.join(NUM + CAT)}, 1 FROM train),
    lim AS (SELECT {', '.join(f'min({c})::DOUBLE AS {c}_lo, (max({c}) - min({c}))::DOUBLE AS {c}_w' for c in NUM)} FROM reference),
    pool AS (SELECT 2 * k AS id, 0 AS s, {', '.join(f'({c} - {c}_lo) / {c}_w AS {c}' for c in NUM)}, {', '.join(CAT)} FROM reference, lim UNION ALL SELECT 2 * k + 1, 1, {', '.join(f'({c} - {c}_lo) / {c}_w' for c in NUM)}, {', '.join(CAT)} FROM syn, lim),
    qs AS (SELECT k, y, {', '.join(f'({c} - {c}_lo) / {c}_w AS {c}' for c in NUM)}, {', '.join(CAT)}, {', '.join(f'CASE WHEN {c} IN (SELECT {c} FROM pool) THEN 1e0 ELSE 0.5e0 END AS {c}_cost' for c in CAT)} FROM rws, lim),
    nr AS (SELECT q.k, q.y, min((({' + '.join([f'abs(q.{c} - r.{c})' for c in NUM] + [f"CASE WHEN q.{c} = r.{c} THEN 0e0 ELSE q.{c}_cost END" for c in CAT])}), r.id), 20) AS best FROM qs q, pool r GROUP BY 1, 2),
    sc AS (SELECT k AS id, y, coalesce(list_sum([b[2] % 2 FOR b IN best])::DOUBLE / nullif(list_sum([1 - b[2] % 2 FOR b IN best]), 0), 0) AS a FROM nr)"""


def _cum(c: str) -> str:
    return f"w_{c} AS (SELECT v, hi, coalesce(lag(hi) OVER (ORDER BY v), 0) AS lo FROM (SELECT {c} AS v, sum(count(*)) OVER (ORDER BY {c}) / (sum(count(*)) OVER ())::DOUBLE AS hi FROM base GROUP BY {c}))"


SQL = {
    "schema_precision": "SELECT 'p_size' AS variable, 0 AS decimals UNION ALL SELECT 'p_retailprice', max(length(rtrim(split_part((p_retailprice::DECIMAL(38, 10))::VARCHAR, '.', 2), '0')))::INT FROM part",
    "schema_restore": f"SELECT round_even(p_retailprice + {u_sql(2, 'noise', 'p_partkey')}, 1)::DOUBLE AS p_retailprice, round_even(p_size + {u_sql(3, 'noise', 'p_partkey')}, 0)::INT AS p_size, p_partkey FROM part",
    "impute_mean": _FILL("avg(price)"),
    "impute_median": _FILL("median(price)"),
    "impute_most_frequent": f"WITH {_GAPS}, m AS (SELECT price AS p FROM gaps WHERE price IS NOT NULL GROUP BY price ORDER BY count(*) DESC, price LIMIT 1) SELECT p_partkey, round(coalesce(price, p)::DOUBLE, 6) AS price FROM gaps, m",
    "impute_drop": f"WITH {_GAPS} SELECT p_partkey, round(price, 6) AS price FROM gaps WHERE price IS NOT NULL",
    "constant_columns": "SELECT unnest(['fixed', 'empty']) AS variable",
    "constraint_transform": f"{_W} SELECT k, round(total - bal, 6) AS total, round(bal, 6) AS bal FROM base",
    "constraint_round_trip": f"{_W} SELECT k, round(total, 6) AS total, round(bal, 6) AS bal, round(total + bal, 6) AS both FROM base",
    "onehot_half": f"{_W} SELECT k, CASE WHEN status = 'F' THEN 0.5e0 ELSE 0e0 END AS \"status_F\", CASE WHEN status = 'O' THEN 0.5e0 ELSE 0e0 END AS \"status_O\" FROM base",
    "minmax_scale": f"{_W} SELECT k, " + ", ".join(f"round(({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()), 6) AS {c}" for c in ("total", "bal")) + " FROM base",
    "standard_scale": f"{_W}, z AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in ("total", "bal")) + " FROM base) SELECT k, round((total - m_total) / s_total, 6) AS total, round((bal - m_bal) / s_bal, 6) AS bal FROM base, z",
    "kbins_uniform": f"{_W}, z AS (SELECT min(total)::DOUBLE AS lo, max(total)::DOUBLE AS hi FROM base) SELECT k, (" + " + ".join(f"(total >= lo + {i} * (hi - lo) / 7)::INT" for i in range(1, 7)) + ")::INT AS total FROM base, z",
    "quantile_transform": f"{_W}, q AS (SELECT quantile_cont(bal, [" + ", ".join(f"{i}e0 / 20" for i in range(21)) + f"]) AS q FROM base), u AS (SELECT k, {u_sql(8, 'q', 'k')} * 20 AS a FROM base) SELECT k, round(q[floor(a)::INT + 1] + (a - floor(a)) * (q[floor(a)::INT + 2] - q[floor(a)::INT + 1]), 6) AS bal FROM u, q",
    "gower_nearest": f"{_SPACE}, {_near('n', 'syn', 'train', 1)} SELECT id, round(ds[1], 6) AS d FROM n",
    "gower_top_3": f"{_SPACE}, {_near('n', 'syn', 'train', 3)} SELECT id, unnest([1, 2, 3]) AS rank, round(unnest(ds), 6) AS d FROM n",
    "dcr_scores": f"{_DCR} " + _union(f"SELECT '{n}' AS metric, round(({e})::DOUBLE, 6) AS value FROM o, q" for n, e in (("score", "least(1, 2 * (1 - train))"), ("train", "train"), ("test", "1 - train"), ("002", "p2"), ("005", "p5"), ("nndr_train", "o.m"), ("nndr_train_002", "o.n2"), ("nndr_train_005", "o.n5"), ("nndr_baseline", "q.m"), ("nndr_baseline_002", "q.n2"), ("nndr_baseline_005", "q.n5"))),
    "prdc": f"{_PRDC} SELECT 'precision' AS metric, round(avg(hit), 6) AS value FROM bs UNION ALL SELECT 'density', round(avg(n) / 5, 6) FROM bs UNION ALL SELECT 'recall', round(avg(hit), 6) FROM br UNION ALL SELECT 'coverage', round(avg(cov), 6) FROM br",
    "alpha_beta_curves": f"{_CURVES} SELECT round(alpha, 6) AS alpha, round(precision, 6) AS precision, round(recall, 6) AS recall FROM curves",
    "alpha_precision_beta_recall": f"{_CURVES} SELECT 'precision' AS metric, round(1 - sum(abs(alpha - precision)) / sum(alpha), 6) AS value FROM curves UNION ALL SELECT 'recall', round(1 - sum(abs(alpha - recall)) / sum(alpha), 6) FROM curves",
    "attack_scores": f"{_SCORED}, {_STEPS} " + _ATTACK_SQL,
    "ensemble_rank_avg": f"{_SCORED} SELECT id, round(({_AVG_RANK('a')} + {_AVG_RANK('b')}) / 2, 6) AS score FROM sc",
    "ensemble_mean": f"{_SCORED} SELECT id, round(((a - min(a) OVER ()) / (max(a) OVER () - min(a) OVER ()) + (b - min(b) OVER ()) / (max(b) OVER () - min(b) OVER ())) / 2, 6) AS score FROM sc",
    "weighted_f1": f"{_W}, p AS (SELECT priority AS label, CASE WHEN {u_sql(6, 'pred', 'k')} < 0.7e0 THEN priority ELSE '5-LOW' END AS prediction FROM base), c AS (SELECT DISTINCT label AS c FROM p), f AS (SELECT c, (SELECT count(*) FROM p WHERE label = c) AS t, (SELECT count(*) FROM p WHERE prediction = c) AS s, (SELECT count(*) FROM p WHERE prediction = c AND label = c) AS h FROM c) SELECT round(sum(t * 2e0 * h / (t + s)) / sum(t), 6) AS f1, round(sum(h)::DOUBLE / sum(t), 6) AS accuracy FROM f",
    "regression_scores": f"{_W} SELECT round(1 - sum(power(total - total * 0.9e0 - bal, 2)) / (var_pop(total) * count(*)), 6) AS r2, round(sqrt(avg(power(total - total * 0.9e0 - bal, 2))), 6) AS rmse FROM base",
    "stratified_split": f"{_W} SELECT k, row_number() OVER (PARTITION BY status ORDER BY {u_sql(11, 'split', 'k')}, k) <= ceil(count(*) OVER (PARTITION BY status) * 0.2e0) AS is_test FROM base",
    "hash_sample": f"{_W} SELECT k FROM base ORDER BY {u_sql(12, 'sample', 'k')}, k LIMIT (SELECT count(*) // 3 FROM base)",
    "bootstrap": f"{_W}, i AS (SELECT k, row_number() OVER (ORDER BY k) - 1 AS i FROM base), n AS (SELECT count(*) AS n FROM base), d AS (SELECT floor({u_sql(13, 'bootstrap', 'i', fine=True)} * n)::BIGINT AS i, count(*) AS times FROM i, n GROUP BY 1) SELECT k, coalesce(times, 0) AS times FROM i LEFT JOIN d USING (i)",
    "mia_roles": f"{_W}, t AS (SELECT k, row_number() OVER (ORDER BY {u_sql(14, 'mia-test', 'k')}, k) <= floor(0.5e0 * count(*) OVER ()) AS ref FROM test), m AS (SELECT k, row_number() OVER (ORDER BY {u_sql(14, 'mia-train', 'k')}, k) <= floor(0.7e0 * count(*) OVER ()) AS mem FROM train) SELECT k, CASE WHEN ref THEN 'reference' ELSE 'nonmember' END AS part FROM t UNION ALL SELECT k, 'member' FROM m WHERE mem",
    "univariate_generator": f"{_W}, {_cum('priority')}, {_cum('status')}, q AS (SELECT quantile_cont(total, {_UNI_Q}) AS q FROM base), r AS (SELECT i, {u_sql(21, 'total', 'i')} * 49 AS a, {u_sql(21, 'priority', 'i')} AS b, {u_sql(21, 'status', 'i')} AS c FROM range((SELECT count(*) FROM base)) r(i)) SELECT round(q[floor(a)::INT + 1] + (a - floor(a)) * (q[floor(a)::INT + 2] - q[floor(a)::INT + 1]), 6) AS total, p.v AS priority, s.v AS status FROM r, q, w_priority p, w_status s WHERE b >= p.lo AND b < p.hi AND c >= s.lo AND c < s.hi",
    "diffusion_schedule_cosine": f"{_W} SELECT k, s.* FROM base JOIN (WITH {_BARS(50)} SELECT t, round(beta, 6) AS beta, round(alpha, 6) AS alpha, round(alpha_bar, 6) AS alpha_bar FROM sch) s ON base.k % 50 = s.t",
    "diffusion_schedule_linear": f"{_W} SELECT k, s.* FROM base JOIN (SELECT t::INT AS t, round(beta, 6) AS beta, round(1 - beta, 6) AS alpha, round(exp(sum(ln(1 - beta)) OVER (ORDER BY t)), 6) AS alpha_bar FROM (SELECT t, 20 * 0.0001e0 + t / 49e0 * 20 * (0.02e0 - 0.0001e0) AS beta FROM range(50) r(t))) s ON base.k % 50 = s.t",
    "edm_sigmas": f"{_W} SELECT k, s.* FROM base JOIN (SELECT t::INT AS t, round(CASE WHEN t < 18 THEN power(power(80e0, 1e0 / 7) + t / 17e0 * (power(0.002e0, 1e0 / 7) - power(80e0, 1e0 / 7)), 7) ELSE 0 END, 6) AS sigma FROM range(19) r(t)) s ON base.k % 19 = s.t",
    "q_sample": f"{_W}, {_BARS(10)} SELECT k, round(sqrt(alpha_bar) * bal / 10000 + sqrt(1 - alpha_bar) * {u_sql(9, 'noise', 'k')}, 6) AS xt FROM base JOIN sch ON t = k % 10",
    "gaussian_posterior": f"{_W}, {_BARS(10)} SELECT k, round(sqrt(alpha_bar / alpha) * beta / (1 - alpha_bar) * bal / 10000 + sqrt(alpha) * (1 - alpha_bar / alpha) / (1 - alpha_bar) * bal / 20000, 6) AS mean, round(beta * (1 - alpha_bar / alpha) / (1 - alpha_bar), 6) AS variance FROM base JOIN sch ON t = k % 10",
    "event_constraint_rates": "SELECT strftime(date_trunc('hour', ts)::TIMESTAMP, '%Y-%m-%d %H:%M:%S') AS start, strftime(date_trunc('hour', ts)::TIMESTAMP + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS \"end\", count(*) AS rows, sum((NOT value >= 50)::INT)::BIGINT AS value_gte_50_violations, sum((event_type = 'click')::INT)::BIGINT AS event_type_neq_click_violations FROM events GROUP BY 1, 2",
    "event_level_counts": "SELECT strftime(date_trunc('day', ts)::TIMESTAMP, '%Y-%m-%d %H:%M:%S') AS start, event_type AS value, count(*) AS n FROM events GROUP BY 1, 2",
    "angle_schedule": f"{_W} SELECT k, s.* FROM base JOIN (WITH a AS (SELECT t, pow(cos(acos(sqrt(0.9999e0)) + t * (acos(sqrt(0.0001e0)) - acos(sqrt(0.9999e0))) / 49), 2) AS bar FROM range(50) r(t)), b AS (SELECT t, least(greatest(1 - CASE WHEN t = 0 THEN bar ELSE bar / lag(bar) OVER (ORDER BY t) END, 0.00000001e0), 0.999e0) AS beta FROM a) SELECT t::INT AS t, round(beta, 6) AS beta, round(1 - beta, 6) AS alpha, round(exp(sum(ln(1 - beta)) OVER (ORDER BY t)), 6) AS alpha_bar FROM b) s ON base.k % 50 = s.t",
    "sampler_steps": f"{_TIMES}, n AS (SELECT *, {u_sql(31, 'noise', 'k')} AS z, x * sqrt(0.5e0) + 0.1e0 AS d, 0.1e0 + t * 7.9e0 AS b FROM tm), e AS (SELECT *, x + (t / 2 - t) * (x - d) / t AS e FROM n) SELECT k, round(x + 0.1e0 * d, 6) AS flow, round(exp(-0.5e0 * t * t * 7.9e0 - t * 0.1e0), 6) AS vp_bar, round(x + (0.5e0 * b * x + b * d) * 0.01e0 + sqrt(b * 0.01e0) * z, 6) AS vp, round(sqrt(0.8e0) * x + sqrt(0.2e0) * z, 6) AS ddim, round(e, 6) AS euler, round(x + (t / 2 - t) * 0.5e0 * ((x - d) / t + (e - (e * sqrt(0.5e0) + 0.1e0)) / (t / 2)), 6) AS heun, round((t * t + 0.25e0) / pow(t * 0.5e0, 2), 6) AS weight, round(t * 1.02e0, 6) AS churn FROM e",
    "noise_levels": f"{_TIMES}, p AS (SELECT *, exp(-1.7e0 * (ln(t / (1 - t)) - ln(0.3e0 / 0.7e0))) AS w, 0.25e0 / 5 + 0.5e0 * -0.3e0 / 2 + (0.09e0 + 2 * 0.5e0 * 0.8e0) / 3 + -0.3e0 * 0.8e0 + 0.64e0 AS whole FROM tm) SELECT k, round(pow(pow(0.002e0, 1e0 / 7) + t * (pow(80e0, 1e0 / 7) - pow(0.002e0, 1e0 / 7)), 7), 6) AS power_mean, round(-ln(1 - 0.999e0 * t), 6) AS log_linear, round(-ln(1 - 0.999e0 * pow(t, 1.5e0)), 6) AS log_linear_column, round(1 / (1 + w), 6) AS warp, round(1.7e0 / (t * (1 - t)) * w / pow(1 + w, 2), 6) AS warp_density, round(1 / (1 + exp(-(ln(0.3e0 / 0.7e0) + ln(t / (1 - t)) / 1.7e0))), 6) AS warp_quantile, round(-7 + 14 * (0.25e0 * pow(t, 5) / 5 + 0.5e0 * -0.3e0 * pow(t, 4) / 2 + (0.09e0 + 0.8e0) * pow(t, 3) / 3 + -0.3e0 * 0.8e0 * t * t + 0.64e0 * t) / whole, 6) AS gamma, round(14 * pow(0.5e0 * t * t - 0.3e0 * t + 0.8e0, 2) / whole, 6) AS gamma_slope, round(CASE WHEN k % 200 < 30 THEN 0.01e0 * (k % 200) / 30 ELSE 0.01e0 + (0.001e0 - 0.01e0) / 120 * (least(k % 200, 150) - 30) END, 6) AS rate FROM p",
    "absorbing_reverse": f"{_TIMES} SELECT k, round(CASE WHEN status = 'P' THEN 0.999e0 * t / 2 ELSE 0.6e0 * (0.999e0 * t - 0.999e0 * t / 2) END / (0.999e0 * t), 6) AS share FROM tm",
    "low_discrepancy_times": f"{_W} SELECT k, round(fmod({u_sql(5, 'time', '0')} + k / 1000e0, 1e0), 6) AS t FROM base",
    "quantile_normal": f"{_W}, q AS (SELECT quantile_cont(bal, [" + ", ".join(f"{i}e0 / 20" for i in range(21)) + "]) AS q FROM base), b AS (SELECT k, bal, q, len(list_filter(q, lambda v: v < bal)) AS lo, len(list_filter(q, lambda v: v <= bal)) AS up FROM base, q) SELECT k, round(((CASE WHEN lo = 0 THEN 0e0 WHEN lo >= 21 THEN 1e0 ELSE (lo - 1 + (bal - q[lo]) / (q[lo + 1] - q[lo])) / 20 END) + (CASE WHEN up = 0 THEN 0e0 WHEN up >= 21 THEN 1e0 ELSE (up - 1 + coalesce((bal - q[greatest(least(up, 20), 1)]) / (q[greatest(least(up, 20), 1) + 1] - q[greatest(least(up, 20), 1)]), 0)) / 20 END)) / 2, 6) AS level FROM b",
    "onehot_inverse": f"{_W} SELECT k, status FROM base",
    "density_curves": real_sql(f"{_W}, v AS (SELECT 0 AS side, bal AS x FROM train UNION ALL SELECT 1, bal FROM syn), l AS (SELECT min(x)::DOUBLE AS lo, max(x)::DOUBLE AS hi FROM v), c AS (SELECT side, least(floor((x - lo) / ((hi - lo) / 1000)), 999) AS b, count(*) AS n FROM v, l GROUP BY 1, 2), s AS (SELECT side, count(*) AS total, stddev_samp(x) * pow(count(*), -0.2e0) AS h FROM v GROUP BY 1), p AS (SELECT i, lo + i * (hi - lo) / 19 AS x FROM range(20) r(i), l), d AS (SELECT i, p.x, side, sum(n * exp(-0.5e0 * pow((p.x - (lo + (b + 0.5e0) * (hi - lo) / 1000)) / h, 2)) / (total * h * sqrt(2 * pi()))) AS d FROM p, c JOIN s USING (side), l GROUP BY 1, 2, 3) SELECT 'bal' AS variable, round(x, 6) AS x, round(max(d) FILTER (side = 0), 6) AS real_density, round(max(d) FILTER (side = 1), 6) AS syn_density FROM d GROUP BY i, x"),
    "dpi_attack": f"{_DPI}, {_STEPS} " + _ATTACK_SQL,
    "multinomial_posterior": f"{_W} SELECT k, round((0.9e0 * (status = 'F')::INT + 0.1e0 / 3) * (0.7e0 * 0.6e0 + 0.3e0 / 3), 6) AS weight FROM base",
}
SQL |= {name: real_sql(SQL[name]) for name in ("gower_nearest", "gower_top_3", "prdc", "alpha_beta_curves", "alpha_precision_beta_recall")}
