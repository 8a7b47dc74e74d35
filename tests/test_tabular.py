import pytest
from pyspark.sql import functions as F

from tabweft.generators.base import SMOTEGenerator, SyntheticTable, UnivariateGenerator
from tabweft.generators.registry import get_generator
from tabweft.generators.trees import ARFGenerator, SynthpopGenerator
from tabweft.operators import preprocess as pp
from tabweft.operators import privacy, scores
from tabweft.operators.neighbours import MixedSpace, nearest
from tabweft.plans.benchmark import SynthesisBenchmark
from tabweft.plans.evaluator import MetricEvaluator, get_metric
from tabweft.sources import tables
from tabweft.spec import FeatureSpec
from tabweft.streaming.monitor import level_counts


def test_schema_and_rounding(spark):
    df = spark.createDataFrame([(31, 0.25), (42, 0.75)], "age int, score double")
    schema = pp.TabularSchema.from_dataframe(df)
    assert schema.precision == {"age": 0, "score": 2}
    back = schema.restore(spark.createDataFrame([(0.125, 2.5), (0.375, 3.5)], "score double, age double"))
    assert back.columns == ["age", "score"] and [tuple(r) for r in back.collect()] == [(2, 0.12), (4, 0.38)]
    with pytest.raises(ValueError):
        schema.restore(df.drop("age"))
    assert pp.TabularSchema.from_json(schema.to_json()) == schema


def test_imputation(spark):
    df = spark.createDataFrame([(31.0, "a"), (None, "b"), (42.0, None)], "age double, g string")
    assert [r.age for r in pp.TabularImputer("median").fit_transform(df, ["age"]).collect()] == [31.0, 36.5, 42.0]
    assert pp.TabularImputer("drop").fit_transform(df, ["age"]).count() == 2
    late = pp.TabularImputer("mean").fit(df.na.drop(), ["age"])
    with pytest.raises(RuntimeError):
        late.transform(df)
    with pytest.raises(ValueError):
        pp.TabularImputer("guess")


def test_missforest_runs_until_it_converges(spark):
    df = spark.range(60).select(*[F.when(F.col("id") % 5 != k, F.col("id") * (k + 1.0) + F.col("id") % 3).alias(c) for k, c in enumerate("abc")])
    fit = lambda **kw: len(pp.MissForest(trees=3, depth=4, **kw).fit(df, list("abc")).models)
    assert fit(rounds=4, tolerance=-1.0) == 4
    assert fit(rounds=4, tolerance=1e9) == 1
    assert fit(rounds=2, tolerance=-1.0) == 2


def test_processor_round_trip(spark):
    rows = [(i, 2 * i + 1, 3 * i + 1, 7, "ab"[i % 2]) for i in range(20)]
    df = spark.createDataFrame(rows, "a int, b int, total int, fixed int, g string")
    p = pp.DataProcessor(["total = a + b", "b > a"])
    model = p.preprocess(df, ["g"])
    assert set(model.columns) == {"a", "b", "g"} and model.agg(F.min("b")).first()[0] == 1
    assert sorted(map(tuple, p.postprocess(model).collect())) == sorted(rows)
    chained = pp.ConstraintEnforcer(["a > b", "b > total"])
    assert sorted(map(tuple, chained.inverse_transform(chained.transform(df)).select(*df.columns).collect())) == sorted(rows)
    for bad in ("a == b", "nothing"):
        with pytest.raises(ValueError):
            pp.parse_constraint(bad)
    with pytest.raises(ValueError):
        pp.DataProcessor().preprocess(df.withColumnRenamed("a", "a b"))
    with pytest.raises(ValueError):
        pp.DataProcessor().preprocess(df.withColumn("n", F.lit(None).cast("int")))


def test_neighbours_with_missing_and_ties(spark):
    df = spark.createDataFrame([(1, 0.0, "p"), (2, 1.0, None), (3, None, None), (4, 0.0, "p")], "id long, x double, c string")
    space = MixedSpace(df, FeatureSpec(("c",), ("x",), None, "id"))
    rows = space.of(df)
    got = {(r.id, r.rank): (r.ref, r.d) for r in nearest(rows, rows, 2, exclude_self=True).collect()}
    assert got[(1, 1)] == (4, 0.0) and got[(1, 2)] == (2, 1.0)
    assert got[(2, 1)] == (1, 1.0) and (3, 1) not in got


def test_scores(spark):
    df = spark.createDataFrame([(1, 1, 0.9), (2, 0, 0.8), (3, 1, 0.8), (4, 0, 0.1)], "id long, y int, score double")
    assert scores.auc(df).first()[0] == pytest.approx(0.875)
    assert scores.lift_at_k(df, 0.25).first()[0] == 2.0
    assert scores.tpr_at_fpr(df, 0.1).first()[0] == 0.5
    one = df.where("y = 0")
    assert scores.lift_at_k(one).first()[0] == 0.0 and scores.tpr_at_fpr(one).first()[0] == 0.0
    assert scores.auc(df.withColumn("score", F.exp("score"))).first()[0] == pytest.approx(0.875)


def test_dcr_rules(spark):
    spec = FeatureSpec((), ("x",), None, "id")
    make = lambda n, s: spark.range(n).select("id", (F.col("id") * 1.0 + s).alias("x"))
    found = privacy.dcr(make(20, 0), make(10, 0.5), make(20, 0.1), spec)
    assert found["dcr.train"] + found["dcr.test"] == pytest.approx(1) and len(found) == 14
    with pytest.raises(ValueError):
        privacy.dcr(make(5, 0), make(10, 0), make(20, 0), spec)
    with pytest.raises(ValueError):
        privacy.dcr(make(20, 0), make(10, 0), make(2, 0), spec)


def train_frame(spark):
    return spark.range(200).select("id", (F.col("id") % 50 * 1.5).alias("x"), (F.col("id") % 7).cast("int").alias("n"), F.when(F.col("id") % 4 == 0, "p").otherwise("q").alias("c"))


def test_generators(spark, tmp_path):
    df = train_frame(spark).drop("id")
    a = UnivariateGenerator(3).fit(df, ["c"])
    one, two = a.generate(50), a.generate(50).repartition(5)
    assert sorted(one.collect()) == sorted(two.collect()) and one.dtypes == df.dtypes
    made = SMOTEGenerator("c", 3).fit(df, ["c"]).generate(40)
    assert made.count() == 40 and made.agg(F.max("x")).first()[0] <= 73.5
    with pytest.raises(ValueError):
        get_generator("unheard")
    with pytest.raises(NotImplementedError):
        get_generator("tabsyn")
    table = SyntheticTable("univariate", constraints=["x > n"], random_state=1).fit(df, ["c"])
    made = table.generate(30)
    assert made.dtypes == df.dtypes
    table.save(str(tmp_path / "table"))
    assert sorted(SyntheticTable.load(str(tmp_path / "table"), spark).generate(30).collect()) == sorted(made.collect())


def test_tree_generators(spark, tmp_path):
    df = train_frame(spark).drop("id")
    arf = ARFGenerator(num_trees=2, max_iters=1, max_depth=3).fit(df, ["c"])
    made = arf.generate(25)
    assert made.count() == 25 and made.dtypes == df.dtypes
    arf.save(str(tmp_path / "arf"))
    assert sorted(ARFGenerator.load(str(tmp_path / "arf"), spark).generate(25).collect()) == sorted(made.collect())
    assert SynthpopGenerator(K=1, max_depth=2).fit(df, ["c"]).generate(20).count() == 20


def test_evaluator_and_benchmark(spark, tmp_path):
    df = train_frame(spark)
    with pytest.raises(ValueError):
        get_metric("unheard")
    found = MetricEvaluator({"shapetrend": None, "domainconstraint-Age rule": {"constraint_list": ["x >= 0"]}}, ["c"], id="id").evaluate(df, df, df)
    assert found["shapetrend.train.shape"] == 1 and found["domainconstraint-age_rule.x_gte_0_real"] == 1
    bench = SynthesisBenchmark(df, "univariate", discrete=["c"], target="c", dataset_save_dir=str(tmp_path / "sets"))
    rows = bench.run(["shapetrend"], results_save_path=str(tmp_path / "out"))
    names = {r.metric for r in rows.collect()}
    assert {"training_time_seconds", "sampling_time_seconds", "shapetrend.test.trend"} <= names
    assert tables.read_results(spark, str(tmp_path / "out"), "univariate").count() == rows.count()
    assert {r.metric for r in bench.eval_saved(["shapetrend"]).collect()} <= names
    bench.save_dir = str(tmp_path / "none")
    with pytest.raises(FileNotFoundError):
        bench.eval_saved(["shapetrend"])


def test_streaming_counts_equal_static_ones(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    want = sorted(map(tuple, level_counts(events, "event_type").collect()))
    stream = spark.readStream.schema(events.schema).parquet("/root/testdata/sf0.001/events.parquet*")
    query = level_counts(stream, "event_type").writeStream.outputMode("complete").format("memory").queryName("levels").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.awaitTermination(120)
    assert sorted(map(tuple, spark.table("levels").collect())) == want
