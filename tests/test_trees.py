from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tabweft.generators.trees import ARFGenerator, SynthpopGenerator
from tabweft.operators import forests


def frame(spark, n=400):
    """x follows c closely; y is its own; d has a level that goes with one of c only."""
    c = F.element_at(F.array(*map(F.lit, "pqr")), (F.col("id") % 3 + 1).cast("int"))
    return spark.range(n).select("id", (F.col("id") % 3 * 100 + F.col("id") % 17).cast("double").alias("x"), (F.col("id") * 37 % 23).cast("double").alias("y"), c.alias("c"), F.when((F.col("id") % 3 == 0) & (F.col("id") % 2 == 0), "u").otherwise("v").alias("d"))


@pytest.fixture(scope="module")
def arf(spark):
    return ARFGenerator(num_trees=3, max_iters=2, max_depth=4, alpha=0.5, random_state=2).fit(frame(spark).drop("id"), ["c", "d"])


def test_arf_draws_lie_within_the_bounds_of_a_leaf(spark, arf):
    made = arf.generate(500).collect()
    assert len(made) == 500
    bounds = defaultdict(dict)
    for b in forests.leaf_bounds(forests.node_table(arf.model.stages[-1])).collect():
        bounds[b["tree"], b["leaf"]][b["feature"]] = b
    kept = {(r["tree"], r["leaf"]) for r in arf.leaf_stats.collect()}
    assert {t for t, _ in kept} == {0, 1, 2}  # leaves of all trees
    codes = {2: arf.model.stages[0].labels, 3: arf.model.stages[1].labels}

    def inside(r, own):
        for i, name in enumerate(("x", "y", "c", "d")):
            b = own.get(i)
            if b is None:
                continue
            if b["levels"] is not None:
                if codes[i].index(r[name]) not in b["levels"]:
                    return False
            elif b["lo"] is not None and r[name] < b["lo"] or b["hi"] is not None and r[name] > b["hi"]:
                return False
        return True

    assert all(any(inside(r, bounds[k]) for k in kept) for r in made)
    assert all(0 <= r.x <= 216 and 0 <= r.y <= 22 for r in made)  # the columns' ranges, where a node has no bound


def test_arf_counts_only_levels_that_a_node_allows(spark, arf):
    bounds = {(b["tree"], b["leaf"]): b["levels"] for b in forests.leaf_bounds(forests.node_table(arf.model.stages[-1])).collect() if b["feature"] == 2}
    codes = arf.model.stages[0].labels
    assert bounds
    for r in arf.shares["c"].collect():
        assert r["hi"] > r["lo"]
        allowed = bounds.get((r["tree"], r["leaf"]))
        assert allowed is None or codes.index(r["c"]) in allowed
    sizes = arf.shares["c"].groupBy("tree", "leaf").count().collect()
    for r in sizes:  # every allowed level is there, observed or not
        allowed = bounds.get((r["tree"], r["leaf"]))
        assert r["count"] == (3 if allowed is None else len([x for x in allowed if x < 3]))


def test_redrawn_rows_take_each_column_from_their_leaf(spark, arf):
    rows = frame(spark).drop("id").withColumn("__id", F.monotonically_increasing_id())
    leafed = arf.model.transform(rows)
    made = arf._redrawn(leafed, 2000, 5)
    assert made.count() == 2000 and made.select("__id").distinct().count() == 2000
    again = arf._redrawn(leafed.repartition(7), 2000, 5)
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, again.collect()))
    from pyspark.ml.functions import vector_to_array

    seen = defaultdict(lambda: defaultdict(set))
    for r in leafed.select("x", "y", "c", "d", vector_to_array("__leaf").alias("l")).collect():
        for k in enumerate(r["l"]):
            for c in "xycd":
                seen[k][c].add(r[c])
    assert all(any(all(r[c] in own[c] for c in "xycd") for own in seen.values()) for r in made.limit(200).collect())
    assert len({(r.x, r.y, r.c, r.d) for r in made.collect()}) > 400  # new combinations


def test_thin_leaves_take_the_rows_of_their_ancestors(spark):
    r"""The tree      0
                    /   \
                   1     4      leaves: 2 -> 0, 3 -> 1, 5 -> 2, 6 -> 3
                  / \   / \
                 2   3 5   6
    """
    schema = "tree int, node int, left int, right int, leaf int"
    nodes = spark.createDataFrame([(0, 0, 1, 4, None), (0, 1, 2, 3, None), (0, 2, None, None, 0), (0, 3, None, None, 1), (0, 4, 5, 6, None), (0, 5, None, None, 2), (0, 6, None, None, 3)], schema)
    model = SynthpopGenerator(minibucket_sampling=3)
    filled = [(0, float(v), v) for v in (1, 2, 3, 4)] + [(2, 10.0, 10), (2, 11.0, 11)]  # leaf 1 is empty, leaves 2 and 3 hold two rows together
    filled = spark.createDataFrame([(leaf, v, i, 1) for leaf, v, i in filled], "__leaf int, __v double, __id long, __n int")
    model.rows = filled
    leaves, pools = model._pools(filled, nodes, True)
    value = {r["__at"]: r["__v"] for r in leaves.collect()}
    got = {r["__leaf"]: [value[i] for i in range(r["__first"], r["__first"] + r["__n"])] for r in pools.collect()}
    assert got == {0: [1, 2, 3, 4], 1: [1, 2, 3, 4], 2: [1, 2, 3, 4, 10, 11], 3: [1, 2, 3, 4, 10, 11]}
    spread = {r["__leaf"]: r["__h"] for r in pools.collect()}
    assert spread[0] == pytest.approx((5 / 3) ** 0.5 * 4**-0.2)


def test_synthpop_keeps_joint_shares(spark):
    df = frame(spark).drop("id")
    made = SynthpopGenerator(K=2, max_depth=5, minibucket=5).fit(df, ["c", "d"]).generate(600)
    assert made.count() == 600
    rows = made.collect()
    assert sum(r.d == "u" and r.c != "p" for r in rows) < 30  # u goes with p
    assert sum(abs(r.x - 100 * "pqr".index(r.c)) > 20 for r in rows) < 40  # x follows c
    assert {r.d for r in rows} == {"u", "v"} and min(r.y for r in rows) >= 0 and max(r.y for r in rows) <= 22
