import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor
from pyspark.sql import functions as F

from tabweft.functions.randomness import uniform
from tabweft.operators import forests


@pytest.fixture(scope="module")
def rows(spark):
    nominal = {"ml_attr": {"type": "nominal", "vals": list("pqrst"), "name": "c"}}
    d = spark.range(600).select("id", uniform(1, "a", "id").alias("a"), F.floor(uniform(1, "b", "id") * 9).cast("double").alias("b"), F.floor(uniform(1, "c", "id") * 5).cast("double").alias("c", metadata=nominal))
    d = d.withColumn("y", F.col("a") * 3 + F.col("b") + F.when(F.col("c").isin(1, 3), 4).otherwise(0)).withColumn("l", (F.col("y") > 7).cast("double"))
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="x").transform(d).cache()


def arrays(rows, *columns):
    got = rows.orderBy("id").select(vector_to_array("x").alias("x"), *columns).collect()
    return np.array([r["x"] for r in got]), got


@pytest.mark.parametrize("kind", ["boosted", "classifier", "forest", "tree"])
def test_forest_predicts_as_the_model(rows, kind):
    how = {"featuresCol": "x", "maxDepth": 4, "seed": 1, "leafCol": "leaf"}
    if kind == "boosted":
        model = GBTRegressor(labelCol="y", maxIter=4, **how).fit(rows)
    elif kind == "classifier":
        model = GBTClassifier(labelCol="l", maxIter=4, **how).fit(rows)
    elif kind == "forest":
        model = RandomForestClassifier(labelCol="l", numTrees=3, **how).fit(rows)
    else:
        model = DecisionTreeRegressor(labelCol="y", **how).fit(rows)
    forest = forests.Forest.of(model)
    found = model.transform(rows)
    if kind in ("boosted", "tree"):
        x, got = arrays(found, "prediction", "leaf")
        assert np.allclose(forest.margin(x), [r["prediction"] for r in got])
    elif kind == "classifier":
        x, got = arrays(found, vector_to_array("probability").alias("p"))
        assert np.allclose(1 / (1 + np.exp(-2 * forest.margin(x))), [r["p"][1] for r in got])
    else:
        x, got = arrays(found, vector_to_array("probability").alias("p"), vector_to_array("leaf").alias("leaves"))
        assert np.allclose(forest.sums(x) / 3, [r["p"] for r in got])
        for tree in range(3):
            assert forest.leaf(x, tree).tolist() == [r["leaves"][tree] for r in got]


def test_bounds_hold_exactly_the_rows_of_a_leaf(rows):
    model = RandomForestClassifier(featuresCol="x", labelCol="l", numTrees=3, maxDepth=5, seed=2, leafCol="leaf").fit(rows)
    bounds = forests.leaf_bounds(forests.node_table(model)).collect()
    x, got = arrays(model.transform(rows), vector_to_array("leaf").alias("leaves"))
    boxes = {}
    for b in bounds:
        boxes.setdefault((b["tree"], b["leaf"]), []).append(b)
    assert len(boxes) == sum(len({r["leaves"][t] for r in got}) for t in range(3))
    for (tree, leaf), own in boxes.items():
        inside = np.ones(len(x), bool)
        for b in own:
            if b["feature"] is None:
                continue
            v = x[:, b["feature"]]
            if b["lo"] is not None:
                inside &= v > b["lo"]
            if b["hi"] is not None:
                inside &= v <= b["hi"]
            if b["levels"] is not None:
                inside &= np.isin(v, b["levels"])
        assert inside.tolist() == [r["leaves"][tree] == leaf for r in got]
    assert len({(b["tree"], b["leaf"], b["feature"]) for b in bounds}) == len(bounds)


def test_sql_gives_the_same_bounds(rows):
    """The splits on the way to a node, by recursion over the written node table."""
    import duckdb

    model = DecisionTreeRegressor(featuresCol="x", labelCol="y", maxDepth=5, leafCol="leaf").fit(rows)
    nodes = forests.node_table(model)
    node_rows = nodes.select("tree", "node", "left", "right", "leaf", "feature", "threshold").toPandas()  # noqa: F841 - read by DuckDB
    want = duckdb.sql("""
        WITH RECURSIVE up AS (SELECT tree, node AS end_node, node FROM node_rows WHERE leaf IS NOT NULL
                              UNION ALL SELECT u.tree, u.end_node, p.node FROM up u JOIN node_rows p ON p.tree = u.tree AND u.node IN (p.left, p.right)),
        steps AS (SELECT u.tree, u.end_node, p.feature, p.threshold, u.node = p.left AS low FROM up u JOIN node_rows p ON p.tree = u.tree AND u.node IN (p.left, p.right) WHERE p.threshold IS NOT NULL)
        SELECT tree, end_node, feature::INT, max(threshold) FILTER (NOT low), min(threshold) FILTER (low) FROM steps GROUP BY 1, 2, 3""").fetchall()
    got = forests.node_paths(nodes).where("leaf IS NOT NULL AND levels IS NULL AND feature IS NOT NULL").select("tree", "node", "feature", "lo", "hi").collect()
    clean = lambda r: tuple(None if v is None or v != v else v for v in r)
    assert sorted(map(clean, got), key=str) == sorted(map(clean, want), key=str) and len(got) > 10


def test_a_single_leaf_has_no_bounds(spark, rows):
    model = DecisionTreeRegressor(featuresCol="x", labelCol="y", maxDepth=0).fit(rows)
    assert [tuple(r) for r in forests.leaf_bounds(forests.node_table(model)).collect()] == [(0, 0, None, None, None, None)]
