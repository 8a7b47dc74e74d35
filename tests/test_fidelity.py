import pytest

from tabweft.functions import distances
from tabweft.functions.expressions import translate
from tabweft.operators import fidelity as fd
from tabweft.operators import neighbours as nb
from tabweft.spec import FeatureSpec

SPEC = FeatureSpec(("c", "d"), ("x", "y"), None, "id")


def frame(spark, shift=0):
    rows = [(i, float(i % 17) + shift, float((i * 7) % 23), "ab"[i % 2], "uvw"[i % 3]) for i in range(120)]
    return spark.createDataFrame(rows, "id long, x double, y double, c string, d string")


def values(df):
    return {r[0]: r[1] for r in df.collect()}


def test_identical_sides_are_at_distance_zero(spark):
    a = frame(spark)
    assert all(abs(v) < 1e-9 for v in values(fd.marginals(a, a, SPEC)).values())
    assert values(fd.shape_trend(a, a, SPEC)) == {"shape": 1.0, "trend": 1.0}
    assert abs(values(fd.correlations_l2(a, a, SPEC))["l2"]) < 1e-9
    assert values(fd.nmi_score(a, a, SPEC))["score"] == pytest.approx(1)
    rules = values(fd.AssociationRules(SPEC, 0.05, 0.1).evaluate(a, a))
    assert rules["precision"] == rules["recall"] == 1 and rules["n_rules_real"] == rules["n_rules_syn"] > 0
    found = values(nb.prdc(a, a, SPEC, 3))
    assert found["precision"] == found["recall"] == found["coverage"] == 1


def test_edge_cases(spark):
    a = spark.createDataFrame([(1, 5.0, "p"), (2, 5.0, None), (3, None, "q")], "id long, x double, c string")
    b = spark.createDataFrame([(1, 5.0, "r"), (2, 5.0, "p"), (3, 5.0, "p")], "id long, x double, c string")
    spec = FeatureSpec(("c",), ("x",), None, "id")
    assert {r.variable: (r.ks, r.wsd) for r in fd.ordered_distances(a, b, spec).collect()} == {"x": (0.0, 0.0)}
    assert fd.categorical_distances(a, b, spec).first()["tvd"] == pytest.approx(2 / 3)
    with pytest.raises(ValueError):
        nb.prdc(a, b, spec, 5)
    with pytest.raises(ValueError):
        fd.AssociationRules(spec, min_support=0.0)
    assert distances.resolve_distance("Wasserstein") == "wsd"
    with pytest.raises(ValueError):
        distances.resolve_distance("none")


def test_expressions(spark):
    df = spark.createDataFrame([(7, -3, None), (-7, 3, 1.0)], "a int, b int, c double")
    got = df.select(translate("a % b").alias("m"), translate("(a > 0) & ~(b > 0)").alias("l"), translate("-8 < a < 0 or c == 2").alias("r"), translate("a ** 2 // 2").alias("p"), translate("a in [7, 8]").alias("i")).collect()
    assert [tuple(r) for r in got] == [(-2, True, False, 24, True), (2, False, True, 24, False)]
    with pytest.raises(ValueError):
        translate("f(a)")
    with pytest.raises(ValueError):
        translate("a >")
    assert fd.constraint_key("Age >= 18") == "age_gte_18"
    found = values(fd.domain_constraints(df, df, ["c > 0"]))
    assert found == {"c_gt_0_real": 0.5, "c_gt_0_syn": 0.5, "c_gt_0_syn_n_violations": 1.0}
