from pyspark.sql import functions as F

from tabweft.operators.preprocess import QuantileMap


def test_levels_of_many_rows_are_looked_up_not_scanned(spark):
    found = QuantileMap([0.0, 1.0, 1.0, 2.0, 5.0, 5.0])
    df = spark.createDataFrame([(v,) for v in (-1.0, 0.0, 0.3, 1.0, 1.5, 2.0, 4.9, 5.0, 6.0, float("nan"), None)], "x double")
    rows = found.with_normal(df, F.col("x"), "z").select(found.level(F.col("x")).alias("a"), found.looked_up(F.col("x")).alias("b")).collect()
    assert [r["a"] for r in rows] == [r["b"] for r in rows] and len({r["a"] for r in rows}) > 5
    assert "filter(" not in found.with_normal(df, F.col("x"), "z")._jdf.queryExecution().toString().lower().replace("\n", "")
