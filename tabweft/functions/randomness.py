"""Uniform numbers and ranks that depend on (seed, name, row id) only, so they survive any repartitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabweft.functions.order import dense_index

#: Equal parts of [0, 1) by which rows are counted before any is ranked; a task ranks the rows of some parts only.
PARTS = 65_536


def uniform(seed: int, name: str, row_id: Column | str, fine: bool = False) -> Column:
    """In [0, 1): the first 32 bits of md5("seed:name:row_id"); ``fine``: 52 bits, where one of very many places is drawn."""
    row_id = F.col(row_id) if isinstance(row_id, str) else row_id
    text = F.concat(F.lit(f"{seed}:{name}:"), row_id.cast("string"))
    digits = 13 if fine else 8
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("double") / F.lit(16.0**digits)


def _dealt(df: DataFrame, u: Column) -> DataFrame:
    return df.withColumn("__u", u).withColumn("__part", F.floor(F.col("__u") * PARTS).cast("int"))


def uniform_rank(df: DataFrame, u: Column, out: str, row_id: str) -> DataFrame:
    """Add ``out``: 0, 1, ... in ascending order of the uniform number ``u``."""
    dealt = _dealt(df, u)
    counts = dealt.groupBy("__part").agg(F.count("*").alias("__n"))
    starts = counts.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__start"))  # PARTS rows at most
    inside = F.row_number().over(Window.partitionBy("__part").orderBy("__u", row_id)) - 1
    return dealt.withColumn("__at", inside).join(F.broadcast(starts), "__part").withColumn(out, F.col("__start") + F.col("__at")).drop("__u", "__part", "__start", "__at")  # PARTS rows


def hash_sample(df: DataFrame, n: int, seed: int, name: str, row_id: str) -> DataFrame:
    """Exactly ``n`` rows (all if there are fewer) without replacement: those of smallest uniform number.

    Parts of [0, 1) that lie below the n-th number are taken whole; only the rows of the part that holds it are ranked.
    """
    dealt = _dealt(df, uniform(seed, name, row_id))
    upto = F.sum("__n").over(Window.orderBy("__part"))  # PARTS rows at most
    counts = dealt.groupBy("__part").agg(F.count("*").alias("__n")).withColumn("__upto", upto)
    whole = counts.where(F.col("__upto") <= n).select("__part")
    last = counts.where((F.col("__upto") > n) & (F.col("__upto") - F.col("__n") < n)).select("__part", (n - F.col("__upto") + F.col("__n")).alias("__left"))
    rank = F.row_number().over(Window.partitionBy("__part").orderBy("__u", row_id))
    some = dealt.join(F.broadcast(last), "__part").withColumn("__rank", rank).where("__rank <= __left")  # one row
    return dealt.join(F.broadcast(whole), "__part", "left_semi").select(df.columns).unionByName(some.select(df.columns))  # PARTS rows at most


def stratified_split(df: DataFrame, stratum: str | None, share: float, seed: int, row_id: str) -> DataFrame:
    """Add ``is_test``: in every stratum the ceil(n * share) rows of smallest uniform number.

    Ranks are counted inside parts of [0, 1) of a stratum and start from the counts of the parts before, so that a task
    holds parts, not strata.
    """
    dealt = _dealt(df, uniform(seed, "split", row_id)).withColumn("__s", F.col(stratum).cast("string") if stratum else F.lit(""))
    by = Window.partitionBy("__s")
    counts = dealt.groupBy("__s", "__part").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(by.orderBy("__part")) - F.col("__n")
    starts = counts.select(F.col("__s").alias("__t"), F.col("__part").alias("__p"), before.alias("__before"), F.ceil(F.sum("__n").over(by) * F.lit(share)).alias("__wanted"))
    rank = F.row_number().over(Window.partitionBy("__s", "__part").orderBy("__u", row_id))
    ranked = dealt.withColumn("__r", rank).join(starts, F.col("__s").eqNullSafe(F.col("__t")) & (F.col("__part") == F.col("__p")))
    return ranked.select(*df.columns, (F.col("__before") + F.col("__r") <= F.col("__wanted")).alias("is_test"))


def bootstrap(df: DataFrame, n: int, seed: int, row_id: str) -> DataFrame:
    """``n`` rows with replacement: draw i takes the row of dense index floor(u_i * rows). Adds ``draw``."""
    rows = df.count()
    indexed = dense_index(df, row_id, "__i")
    draws = df.sparkSession.range(n).select(F.col("id").alias("draw"), F.floor(uniform(seed, "bootstrap", "id", fine=True) * rows).cast("long").alias("__i"))
    return draws.join(indexed, "__i").drop("__i")
