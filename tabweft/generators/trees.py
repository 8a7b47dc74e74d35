"""Generators that draw from the leaves of Spark ML trees."""

from __future__ import annotations

import math
import random

from pyspark.ml import Pipeline
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabweft.cluster import materialize
from tabweft.functions.binning import ranges
from tabweft.functions.normal import quantile, truncated_normals
from tabweft.functions.randomness import uniform, uniform_rank
from tabweft.generators.base import BaseGenerator, LevelDraw, drawn, stretches
from tabweft.operators.forests import leaf_bounds, node_table
from tabweft.operators.ml import without_summaries
from tabweft.operators.preprocess import QuantileMap
from tabweft.spec import as_level, as_number


class SynthpopGenerator(BaseGenerator):
    """Sequential trees: the first column from its marginal, every other from the leaf of a tree on the columns before it.

    ``K`` bags of bootstrap rows (each row as often as a Poisson number says) have a column order and trees of their own
    and share the rows to generate. ``honest``: leaves are filled with rows that the bag's trees did not see. A leaf with
    fewer than ``minibucket_sampling`` rows takes those of its nearest ancestor that has as many. ``smoothing`` of drawn numbers: ``none``, ``kde``
    (normal noise of the leaf's bandwidth) or ``histogram`` (evenly within one of 64 bins of the column).
    """

    flags_missing = True

    def __init__(self, K: int = 100, minibucket: int = 10, max_depth: int = 8, honest_trees: bool = True, condition_y: str | None = None, target_column: str | None = None, random_state: int = 0, minibucket_sampling: int = 3, smoothing: str = "none"):  # noqa: N803
        super().__init__(random_state)
        if smoothing not in ("none", "kde", "histogram"):
            raise ValueError("smoothing is none, kde or histogram")
        self.least, self.smoothing = minibucket_sampling, smoothing
        self.K, self.minibucket, self.max_depth, self.honest, self.condition_y, self.target = K, minibucket, max_depth, honest_trees, condition_y, target_column

    def _fit(self, df: DataFrame) -> None:
        plain = [as_number(df, c).alias(c) if c in self.spec.numerical else as_level(c).alias(c) for c in self.columns]
        self.rows = materialize(df.select(F.monotonically_increasing_id().alias("__id"), *plain), "synthpop")
        self.limits = ranges([self.rows], list(self.spec.numerical), as_number) if self.spec.numerical else {}
        rng, self.bags = random.Random(self.random_state), []
        self.indexer = Pipeline(stages=[StringIndexer(inputCol=c, outputCol=f"__i_{c}", stringOrderType="alphabetAsc", handleInvalid="keep") for c in self.spec.discrete]).fit(self.rows)
        bins = 2 + max([self.rows.select(c).distinct().count() for c in self.spec.discrete], default=30)
        for bag in range(self.K):
            order = list(self.columns)
            rng.shuffle(order)
            order.sort(key=lambda c: c not in self.flags.values())  # what is missing comes first
            if self.condition_y and self.target in order:
                order.remove(self.target)
                order = [self.target, *order] if self.condition_y == "first" else [*order, self.target]
            coded = self.indexer.transform(self.rows).withColumn("__w", _poisson(uniform(self.random_state, f"bag{bag}", "__id")))
            train, source = coded.where("__w > 0"), coded.where("__w = 0") if self.honest else coded.where("__w > 0")
            steps = []
            for i, c in enumerate(order[1:], 1):
                steps.append((c, *self._tree(train, source, order[:i], c, max(32, bins))))
            self.bags.append((order, steps))

    def _tree(self, train: DataFrame, source: DataFrame, given: list[str], c: str, bins: int):
        from pyspark.ml.classification import DecisionTreeClassifier
        from pyspark.ml.regression import DecisionTreeRegressor

        inputs = [f"__i_{x}" if x in self.spec.discrete else x for x in given]
        kind = DecisionTreeClassifier if c in self.spec.discrete else DecisionTreeRegressor
        label = f"__i_{c}" if c in self.spec.discrete else c
        tree = kind(featuresCol="__x", labelCol=label, leafCol="__leaf", weightCol="__w", maxDepth=self.max_depth, minInstancesPerNode=self.minibucket, maxBins=bins, seed=self.random_state)
        model = Pipeline(stages=[VectorAssembler(inputCols=inputs, outputCol="__x"), tree]).fit(train)
        keep = ["__leaf", F.col(c).alias("__v"), "__id"]
        filled = model.transform(source).select(*keep).withColumn("__leaf", F.col("__leaf").cast("int"))
        if filled.limit(self.least).count() < self.least:  # fewer than a leaf needs
            filled = model.transform(train).select(*keep).withColumn("__leaf", F.col("__leaf").cast("int"))
        return model, *self._pools(filled.withColumn("__n", F.lit(1)), node_table(model.stages[-1]), c in self.spec.numerical)

    def _pools(self, filled: DataFrame, nodes: DataFrame, numeric: bool) -> tuple[DataFrame, DataFrame]:
        """(place, __v) of the rows in order of their leaves, and (leaf, first place, number of places, bandwidth) of the pool of every leaf.

        A leaf with fewer than ``minibucket_sampling`` rows takes those of its nearest ancestor that has as many. A node's leaves
        are numbered in a row, so every pool is a stretch of places.
        """
        placed, _, _ = stretches(filled, ["__leaf", "__id"])
        moments = [F.sum("__v").alias("__s"), F.sum(F.col("__v") * F.col("__v")).alias("__q")] if numeric else [F.lit(0.0).alias("__s"), F.lit(0.0).alias("__q")]
        own = {r["__leaf"]: r for r in placed.groupBy("__leaf").agg(F.count("*").alias("__n"), F.min("__from").alias("__first"), *moments).collect()}  # leaves of one tree
        tree = {r["node"]: r for r in nodes.collect()}  # nodes of one tree, 2 ** (max_depth + 1) at most
        span: dict[int, tuple[int, int]] = {}  # first and last leaf below each node
        for node in sorted(tree, reverse=True):  # children have larger numbers
            r = tree[node]
            span[node] = (r["leaf"], r["leaf"]) if r["left"] is None else (span[r["left"]][0], span[r["right"]][1])
        parent = {child: node for node, r in tree.items() for child in (r["left"], r["right"]) if child is not None}
        pools = []
        for node, r in tree.items():
            if r["left"] is None:
                at = node
                while True:
                    inside = [own[x] for x in range(span[at][0], span[at][1] + 1) if x in own]
                    n = sum(x["__n"] for x in inside)
                    if n >= self.least or at not in parent:
                        break
                    at = parent[at]
                mean = sum(x["__s"] or 0.0 for x in inside) / max(n, 1)
                square = sum(x["__q"] or 0.0 for x in inside) - n * mean * mean
                spread = math.sqrt(max(square, 0.0) / (n - 1)) * n**-0.2 if n > 1 else 0.0
                pools.append((r["leaf"], min((x["__first"] for x in inside), default=0), n, spread))
        pools = self.rows.sparkSession.createDataFrame(pools, "__leaf int, __first long, __n long, __h double")
        return materialize(placed.select(F.col("__from").alias("__at"), "__v"), "synthpop-leaves"), materialize(pools, "synthpop-pools")

    def _generate(self, n: int) -> DataFrame:
        out, start = None, 0
        for bag, (order, steps) in enumerate(self.bags):
            size = n // self.K + (bag < n % self.K)
            rows = self._marginal(self.spark.range(start, start + size), order[0], bag)
            start += size
            for c, model, leaves, pools in steps:
                coded = self.indexer.transform(rows.select("*", *[F.lit("").alias(x) for x in self.spec.discrete if x not in rows.columns]))
                leafed = model.transform(coded).select(*rows.columns, F.col("__leaf").cast("int").alias("__leaf"))
                place = F.col("__first") + F.floor(uniform(self.random_state, f"leaf{bag}:{c}", "id", fine=True) * F.col("__n")).cast("long")
                placed = leafed.join(F.broadcast(pools), "__leaf").withColumn("__at", place)  # a row for each leaf of a tree
                rows = placed.join(leaves.withColumnRenamed("__v", c), "__at").select(*rows.columns, self._smoothed(c, bag).alias(c))
                rows = materialize(rows, "synthpop-rows")
            out = rows.select("id", *self.columns) if out is None else out.unionByName(rows.select("id", *self.columns))
        return self._typed(out)

    def _smoothed(self, c: str, bag: int):
        if c not in self.limits or self.smoothing == "none":
            return F.col(c)
        (lo, hi), u = self.limits[c], uniform(self.random_state, f"smooth{bag}:{c}", "id")
        if self.smoothing == "kde":
            moved = F.col(c) + F.coalesce("__h", F.lit(0.0)) * quantile(u)
        else:
            width = (hi - lo) / 64
            moved = F.lit(lo) + (F.least(F.floor((F.col(c) - lo) / (width or 1.0)), F.lit(63)) + u) * width
        return F.least(F.greatest(moved, F.lit(lo)), F.lit(hi))

    def _marginal(self, rows: DataFrame, c: str, bag: int) -> DataFrame:
        if c in self.spec.discrete:
            draw = LevelDraw.fit(self.rows, c)
            return draw.add(rows, uniform(self.random_state, f"first{bag}", "id", draw.few is None), c)
        return rows.withColumn(c, QuantileMap.fit(self.rows, c, 1000).value(uniform(self.random_state, f"first{bag}", "id")))


def _poisson(u):
    """The Poisson number of mean 1 at level ``u``."""
    out, total, p = F.lit(9), 0.0, math.exp(-1)
    bounds = []
    for k in range(9):
        total += p
        bounds.append(total)
        p /= k + 1
    for k in reversed(range(9)):
        out = F.when(u < bounds[k], k).otherwise(out)
    return out.cast("double")


class ARFGenerator(BaseGenerator):
    """Adversarial random forest: tell rows from rows with permuted columns, then draw from the leaves' densities.

    A leaf of any tree is drawn by its coverage. Within it numbers are normals truncated to the bounds of its node; where it has
    none, to the column's range, or with ``retain_value_ranges`` off not at all. Categories have the leaf's shares; with ``alpha``
    every level that the node's splits allow counts that much besides.
    """

    flags_missing = True

    def __init__(self, num_trees: int = 20, delta: float = 0.0, max_iters: int = 10, min_node_size: int = 5, max_depth: int = 8, alpha: float = 0.0, retain_value_ranges: bool = True, random_state: int = 0):
        super().__init__(random_state)
        self.num_trees, self.delta, self.max_iters, self.min_node_size, self.max_depth, self.alpha, self.clip = num_trees, delta, max_iters, min_node_size, max_depth, alpha, retain_value_ranges

    def _permuted(self, rows: DataFrame) -> DataFrame:
        """Every column shuffled on its own: rows meet again by their rank."""
        base = None
        for c in self.columns:
            one = uniform_rank(rows.select("__id", c), uniform(self.random_state, f"perm:{c}", "__id"), "__r", "__id").select("__r", c)
            base = one if base is None else base.join(one, "__r")
        return base.withColumn("__id", F.monotonically_increasing_id() + F.lit(1 << 50))

    def _redrawn(self, leafed: DataFrame, n: int, round_: int) -> DataFrame:
        """``n`` rows of leaves of all trees: a leaf for each row in ``leafed`` and tree alike, and in it every column from a row of its own.

        Rows are numbered in the order of tree and leaf, so a leaf is a stretch of numbers and a draw is a join by number.
        """
        long = leafed.select("__id", *self.columns, F.posexplode(_leaves("__leaf")).alias("tree", "leaf")).withColumn("__n", F.lit(1))
        placed, total, _ = stretches(long, ["tree", "leaf", "__id"])
        leaves = materialize(placed.groupBy("tree", "leaf").agg(F.count("*").alias("__size"), F.min("__from").alias("__first")), "arf-leaves")
        seed = self.random_state + round_
        place = lambda name, first, size: (first + F.least(F.floor(uniform(seed, name, "id", fine=True) * size), size - 1)).cast("long")
        rows = self.spark_of(leafed).range(n).withColumn("__from", place("tree", F.lit(0), F.lit(total))).join(placed.select("__from", "tree", "leaf"), "__from").join(leaves, ["tree", "leaf"])
        rows = materialize(rows.select("id", *[place(f"redraw:{c}", F.col("__first"), F.col("__size")).alias(f"__p{i}") for i, c in enumerate(self.columns)]), "arf-places")
        for i, c in enumerate(self.columns):
            rows = rows.join(placed.select(F.col("__from").alias(f"__p{i}"), c), f"__p{i}").drop(f"__p{i}")
        return rows.select((F.col("id") + F.lit(1 << 50)).alias("__id"), *self.columns)

    @staticmethod
    def spark_of(df: DataFrame):
        return df.sparkSession

    def _fit(self, df: DataFrame) -> None:
        from pyspark.ml.classification import RandomForestClassifier

        plain = [as_number(df, c).alias(c) if c in self.spec.numerical else as_level(c).alias(c) for c in self.columns]
        rows = materialize(df.select(F.monotonically_increasing_id().alias("__id"), *plain), "arf")
        bins = max(32, 2 + max([rows.select(c).distinct().count() for c in self.spec.discrete], default=30))
        inputs = [f"__i_{c}" if c in self.spec.discrete else c for c in self.columns]
        stages = [StringIndexer(inputCol=c, outputCol=f"__i_{c}", stringOrderType="alphabetAsc", handleInvalid="keep") for c in self.spec.discrete]
        stages += [VectorAssembler(inputCols=inputs, outputCol="__x"), RandomForestClassifier(featuresCol="__x", labelCol="__y", leafCol="__leaf", numTrees=self.num_trees, maxDepth=self.max_depth, minInstancesPerNode=self.min_node_size, maxBins=bins, seed=self.random_state)]
        self.ranges = ranges([rows], list(self.spec.numerical), as_number) if self.spec.numerical else {}
        n = rows.count()
        fake, accuracy = materialize(self._permuted(rows), "arf-fake"), 1.0
        for i in range(self.max_iters):
            both = rows.withColumn("__y", F.lit(1.0)).unionByName(fake.select("__id", *self.columns).withColumn("__y", F.lit(0.0)))
            held = uniform(self.random_state, f"hold{i}", "__id") < 0.25
            model = without_summaries(Pipeline(stages=stages).fit(both.where(~held)))
            found = model.transform(both.where(held)).agg(F.avg((F.col("prediction") == F.col("__y")).cast("double"))).first()[0] or 0.0
            done = found <= 0.5 + self.delta or found > accuracy
            self.model, accuracy = model, found
            if done or i + 1 == self.max_iters:
                break
            fake = materialize(self._redrawn(model.transform(rows), n, i + 1), "arf-fake")
        codes = {c: list(self.model.stages[k].labels) for k, c in enumerate(self.spec.discrete)}
        self._estimate(self.model.transform(rows), leaf_bounds(node_table(self.model.stages[-1])), codes)

    def _estimate(self, leafed: DataFrame, bounds: DataFrame, codes: dict[str, list[str]]) -> None:
        """Leaves of all trees with their rows' means and deviations between the bounds of their nodes, and their shares of levels."""
        long = materialize(leafed.select(*self.columns, F.posexplode(_leaves("__leaf")).alias("tree", "leaf")).withColumn("leaf", F.col("leaf").cast("int")), "arf-long")
        numbers = [f.alias(f"{p}_{c}") for c in self.spec.numerical for p, f in (("m", F.avg(c)), ("s", F.coalesce(F.stddev_samp(c), F.lit(0.0))))]
        stats = long.groupBy("tree", "leaf").agg(F.count("*").alias("__n"), *numbers).where(F.col("__n") >= self.min_node_size)
        bounds = materialize(bounds, "arf-bounds")
        at = {c: i for i, c in enumerate(self.columns)}
        for c in self.spec.numerical:  # nodes without a split on the column have no bound on it
            own = bounds.where(F.col("feature") == at[c]).select("tree", "leaf", F.col("lo").alias(f"a_{c}"), F.col("hi").alias(f"b_{c}"))
            stats = stats.join(own, ["tree", "leaf"], "left")
        stats = materialize(stats, "arf-stats")
        self.leaf_stats, self.total, self.width = stretches(stats, ["tree", "leaf"])
        self.shares = {}
        for c in self.spec.discrete:
            leaf = Window.partitionBy("tree", "leaf")
            upto = leaf.orderBy(c).rowsBetween(Window.unboundedPreceding, 0)
            counts = long.groupBy("tree", "leaf", c).agg(F.count("*").cast("double").alias("w"))
            if self.alpha:  # the levels that a leaf's node allows, also those that it does not hold
                own = bounds.where(F.col("feature") == at[c]).select("tree", "leaf", "levels")
                every = F.array(*[F.lit(i) for i in range(len(codes[c]))])
                cells = stats.select("tree", "leaf").join(own, ["tree", "leaf"], "left").select("tree", "leaf", F.explode(F.coalesce("levels", every)).alias("code"))
                named = self.spark_of(long).createDataFrame(list(enumerate(codes[c])), f"code int, `{c}` string")
                cells = cells.join(named, "code").drop("code")  # the code of levels that were never seen has no name
                counts = cells.join(counts, ["tree", "leaf", c], "left").withColumn("w", F.coalesce("w", F.lit(0.0)) + self.alpha)
            shares = counts.withColumn("hi", F.sum("w").over(upto) / F.sum("w").over(leaf))
            self.shares[c] = materialize(shares.withColumn("lo", F.coalesce(F.lag("hi").over(leaf.orderBy(c)), F.lit(0.0))).drop("w"), "arf-shares")

    def _generate(self, n: int) -> DataFrame:
        seed = self.random_state
        rows = materialize(drawn(self.spark.range(n), uniform(seed, "leaf", "id", fine=True), self.leaf_stats, self.total, self.width), "arf-draw")
        far = lambda c, side: self.ranges[c][side > 0] if self.clip else F.col(f"m_{c}") + side * 8 * F.col(f"s_{c}")  # noqa: E731 - beyond 8 deviations is nothing
        end = lambda c, p, side: F.coalesce(F.col(f"{p}_{c}"), F.lit(far(c, side)) if self.clip else far(c, side))
        rows = truncated_normals(rows, {c: (uniform(seed, c, "id"), F.col(f"m_{c}"), F.col(f"s_{c}"), end(c, "a", -1), end(c, "b", 1)) for c in self.spec.numerical}) if self.spec.numerical else rows
        for c in self.spec.discrete:
            v = uniform(seed, c, "id")
            rows = rows.withColumn("v", v).join(self.shares[c], ["tree", "leaf"]).where((F.col("v") >= F.col("lo")) & (F.col("v") < F.col("hi"))).drop("lo", "hi", "v")
        return self._typed(rows.select("id", *self.columns))


def _leaves(column: str):
    from pyspark.ml.functions import vector_to_array

    return vector_to_array(column)
