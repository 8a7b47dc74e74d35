"""The table that the registered queries measure: orders with their customers, dealt to roles by key.

Roles cover the whole table: the last digit of the key makes a row train (0-4), test (5, 6) or synthetic (7-9); the
synthetic rows are perturbed by a rule on md5, which SQL repeats.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweft.cluster import materialize
from tabweft.functions.randomness import uniform
from tabweft.spec import FeatureSpec

NUM = ("total", "bal", "month")
CAT = ("status", "priority", "segment")
SPEC = FeatureSpec(CAT, NUM, None, "k")


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer"))
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    digit, u = F.col("o_orderkey") % 10, uniform(7, "perturb", "o_orderkey")
    syn = digit >= 7
    return rows.select(
        F.col("o_orderkey").alias("k"), F.when(digit < 5, "train").when(digit < 7, "test").otherwise("syn").alias("role"),
        F.when(syn, F.col("o_totalprice") * 1.1 + 1000 * u).otherwise(F.col("o_totalprice")).alias("total"), F.col("c_acctbal").alias("bal"), F.month("o_orderdate").alias("month"),
        F.when(syn & (u < 0.1), "P").otherwise(F.col("o_orderstatus")).alias("status"), F.when(syn & (u > 0.8), "5-LOW").otherwise(F.col("o_orderpriority")).alias("priority"), F.col("c_mktsegment").alias("segment"),
    )


def sides(spark: SparkSession, sf_dir: str, *roles: str) -> list[DataFrame]:
    """The rows of each role; ``real`` is train and test, ``all`` every row."""
    return _of(base(spark, sf_dir), roles)


def written(spark: SparkSession, sf_dir: str, *roles: str) -> list[DataFrame]:
    """:func:`sides` of rows that are joined and written once, for queries that read them many times."""
    return _of(materialize(base(spark, sf_dir), "base"), roles)


def _of(all_rows: DataFrame, roles: tuple[str, ...]) -> list[DataFrame]:
    which = {"real": F.col("role") != "syn", "all": F.lit(True)}
    return [all_rows.where(which.get(r, F.col("role") == r)).drop("role") for r in roles]


def u_sql(seed: int, name: str, row_id: str, fine: bool = False) -> str:
    digits = 13 if fine else 8
    return f"(('0x' || substr(md5('{seed}:{name}:' || {row_id}), 1, {digits}))::BIGINT / {16**digits}e0)"


BASE_SQL = f"""
    base0 AS (SELECT o_orderkey AS k, {u_sql(7, "perturb", "o_orderkey")} AS u, o_orderkey % 10 AS d, o_totalprice, c_acctbal, month(o_orderdate)::INT AS month, o_orderstatus, o_orderpriority, c_mktsegment
              FROM orders JOIN customer ON o_custkey = c_custkey),
    base AS (SELECT k, CASE WHEN d < 5 THEN 'train' WHEN d < 7 THEN 'test' ELSE 'syn' END AS role,
                    CASE WHEN d >= 7 THEN o_totalprice * 1.1e0 + 1000 * u ELSE o_totalprice END AS total, c_acctbal AS bal, month,
                    CASE WHEN d >= 7 AND u < 0.1e0 THEN 'P' ELSE o_orderstatus END AS status, CASE WHEN d >= 7 AND u > 0.8e0 THEN '5-LOW' ELSE o_orderpriority END AS priority, c_mktsegment AS segment FROM base0),
    train AS (SELECT * FROM base WHERE role = 'train'), test AS (SELECT * FROM base WHERE role = 'test'), syn AS (SELECT * FROM base WHERE role = 'syn')
"""


def long_sql(columns, tables=("train", "syn"), cast: str = "VARCHAR") -> str:
    """Rows (side, variable, value) as a SELECT."""
    return " UNION ALL ".join(f"SELECT {i} AS side, '{c}' AS variable, {c}::{cast} AS value FROM {t}" for i, t in enumerate(tables) for c in columns)


def bins_sql(n: int, fit=("train", "syn"), tables=("train", "syn")) -> str:
    """CTE ``binned``: (side, k, features as levels)."""
    lim = " UNION ALL ".join(f"SELECT {', '.join(NUM)} FROM {t}" for t in fit)
    limits = "lim AS (SELECT " + ", ".join(f"min({c})::DOUBLE AS {c}_lo, max({c})::DOUBLE AS {c}_hi" for c in NUM) + f" FROM ({lim}))"
    level = lambda c: "'bin_' || (" + " + ".join(f"CASE WHEN {c} >= {c}_lo + {i} * ({c}_hi - {c}_lo) / {n} THEN 1 ELSE 0 END" for i in range(1, n)) + f")::VARCHAR AS {c}"
    rows = " UNION ALL ".join(f"SELECT {i} AS side, k, {', '.join(level(c) for c in NUM)}, {', '.join(CAT)} FROM {t}, lim" for i, t in enumerate(tables))
    return f"{limits}, binned AS ({rows})"


def binned_long_sql(columns) -> str:
    return " UNION ALL ".join(f"SELECT side, '{c}' AS variable, {c} AS value FROM binned" for c in columns)


def real_sql(sql: str) -> str:
    """``sql`` with ``train`` standing for all real rows."""
    return sql.replace("train AS (SELECT * FROM base WHERE role = 'train')", "train AS (SELECT * FROM base WHERE role <> 'syn')")
