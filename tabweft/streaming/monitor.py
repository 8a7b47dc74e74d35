"""Measures that are sums of row contributions, over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweft.functions.expressions import translate
from tabweft.operators.fidelity import constraint_key


def constraint_rates(events: DataFrame, constraints: list[str], time: str = "ts", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, end, rows, <constraint>_violations...) per event-time window; works on static and streaming frames."""
    counts = [F.sum((~F.coalesce(translate(c), F.lit(False))).cast("long")).alias(f"{constraint_key(c)}_violations") for c in constraints]
    found = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, window).alias("w")).agg(F.count("*").alias("rows"), *counts)
    return found.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "rows", *[f"{constraint_key(c)}_violations" for c in constraints])


def level_counts(events: DataFrame, column: str, time: str = "ts", window: str = "1 day", late: str = "10 minutes") -> DataFrame:
    """(start, value, n): the frequency table of a category per window, from which marginal distances follow."""
    found = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, window).alias("w"), F.coalesce(F.col(column).cast("string"), F.lit("__nan__")).alias("value")).agg(F.count("*").alias("n"))
    return found.select(F.col("w.start").alias("start"), "value", "n")
