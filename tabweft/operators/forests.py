"""Trees of Spark ML models as tables of nodes, and as arrays that evaluate many rows at once.

A saved model holds a row for each node. :func:`node_table` gives these rows with the path-independent facts;
:func:`leaf_bounds` pushes the splits down the trees, level by level, by joins: each leaf's range of every number and
its levels of every category. :class:`Forest` holds a model's nodes as NumPy arrays for use inside tasks.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweft.cluster import materialize, new_folder

#: Nodes that may be sent to the tasks: about 60 bytes each, and a byte for each level of a category.
MAX_NODES = 4_000_000


def node_table(model) -> DataFrame:
    """(tree, node, left, right, leaf, feature, threshold, levels, n_levels, prediction, stats, rows) of a model of one or more trees.

    ``left`` and ``right`` are null at leaves, ``leaf`` numbers a tree's leaves from the left as a model's ``leafCol`` does.
    A number goes left if it is at most ``threshold``, a category if its code is one of ``levels``. ``stats`` are the class weights, or (n, sum, sum of squares).
    """
    from pyspark.sql import SparkSession, Window

    spark = SparkSession.getActiveSession()
    path = new_folder(spark, "nodes")
    model.save(path)
    rows = spark.read.parquet(f"{path}/data")
    if "nodeData" not in rows.columns:  # a single tree
        rows = rows.select(F.lit(0).alias("treeID"), F.struct(*rows.columns).alias("nodeData"))
    inner, split = F.col("nodeData.leftChild") >= 0, F.col("nodeData.split")
    numeric = split["numCategories"] < 0
    place = Window.partitionBy("tree").orderBy("node")  # the nodes of one tree
    return rows.select(
        F.col("treeID").alias("tree"), F.col("nodeData.id").alias("node"),
        F.when(inner, F.col("nodeData.leftChild")).alias("left"), F.when(inner, F.col("nodeData.rightChild")).alias("right"),
        F.when(inner, split["featureIndex"]).alias("feature"), F.when(inner & numeric, split["leftCategoriesOrThreshold"][0]).alias("threshold"),
        F.when(inner & ~numeric, F.transform(split["leftCategoriesOrThreshold"], lambda x: x.cast("int"))).alias("levels"), F.when(inner & ~numeric, split["numCategories"]).alias("n_levels"),
        F.col("nodeData.prediction").alias("prediction"), F.col("nodeData.impurityStats").alias("stats"), F.col("nodeData.rawCount").alias("rows"),
    ).withColumn("leaf", F.when(F.col("left").isNull(), F.sum(F.col("left").isNull().cast("int")).over(place) - 1))


def node_paths(nodes: DataFrame) -> DataFrame:
    """(tree, node, leaf, feature, lo, hi, levels) for every node and every feature that a split above it bounds.

    One round for each level: the nodes of a level hand their bounds, narrowed by their own split, to their children.
    A number lies in (lo, hi], a category is one of ``levels``; null: no bound on that side. Nodes without bounds have one row with a null feature.
    """
    bounds = "array<struct<feature:int,lo:double,hi:double,levels:array<int>>>"
    edges = nodes.where("left IS NOT NULL")
    down = edges.select("tree", F.col("node").alias("parent"), F.explode(F.array(F.struct(F.col("left").alias("node"), F.lit(True).alias("low")), F.struct(F.col("right").alias("node"), F.lit(False).alias("low")))).alias("e"), "feature", "threshold", "levels", "n_levels")
    all_levels = F.transform(F.sequence(F.lit(0), F.col("n_levels") - 1), lambda x: x.cast("int"))
    side = F.when(F.col("e.low"), F.col("levels")).otherwise(F.array_except(all_levels, F.col("levels")))
    own = F.struct(
        F.col("feature").cast("int").alias("feature"), F.when(~F.col("e.low"), F.col("threshold")).alias("lo"), F.when(F.col("e.low"), F.col("threshold")).alias("hi"),
        F.when(F.col("n_levels").isNotNull(), side).alias("levels"),
    )
    down = materialize(down.select("tree", "parent", F.col("e.node").alias("node"), own.alias("own")), "tree-edges")
    level = nodes.where("node = 0").select("tree", "node", F.array().cast(bounds).alias("bounds"))
    found = None
    while True:
        level = materialize(level, "tree-level")
        found = level if found is None else found.unionByName(level)
        if level.isEmpty():
            break
        above = level.select("tree", F.col("node").alias("parent"), "bounds")
        met = down.join(above, ["tree", "parent"])
        same = F.filter("bounds", lambda b: b["feature"] == F.col("own.feature"))
        old = F.element_at(F.when(F.size(same) > 0, same).otherwise(F.array(F.lit(None).cast("struct<feature:int,lo:double,hi:double,levels:array<int>>"))), 1)
        narrowed = F.struct(
            F.col("own.feature").alias("feature"), F.greatest(old["lo"], F.col("own.lo")).alias("lo"), F.least(old["hi"], F.col("own.hi")).alias("hi"),
            F.when(old["levels"].isNull(), F.col("own.levels")).when(F.col("own.levels").isNull(), old["levels"]).otherwise(F.array_intersect(old["levels"], F.col("own.levels"))).alias("levels"),
        )
        rest = F.filter("bounds", lambda b: b["feature"] != F.col("own.feature"))
        level = met.select("tree", "node", F.concat(rest, F.array(narrowed)).cast(bounds).alias("bounds"))
    flat = found.select("tree", "node", F.explode_outer("bounds").alias("b")).select("tree", "node", "b.*")
    return nodes.select("tree", "node", "leaf").join(flat, ["tree", "node"])


def leaf_bounds(nodes: DataFrame) -> DataFrame:
    """:func:`node_paths` of the leaves: (tree, leaf, feature, lo, hi, levels)."""
    return node_paths(nodes).where("leaf IS NOT NULL").drop("node")


class Forest:
    """Trees as arrays. ``values`` has a row for each node: its class shares, or its prediction."""

    def __init__(self, first, left, right, feature, threshold, sets, values, weights, leaves):
        self.first, self.left, self.right, self.feature, self.threshold, self.sets, self.values, self.weights, self.leaves = first, left, right, feature, threshold, sets, values, weights, leaves

    @classmethod
    def of(cls, model, weights=None) -> Forest:
        """The trees of a model; ValueError beyond MAX_NODES."""
        nodes = node_table(model).orderBy("tree", "node").limit(MAX_NODES + 1).collect()
        if len(nodes) > MAX_NODES:
            raise ValueError(f"the model has more than {MAX_NODES} nodes")
        if weights is None:
            weights = list(getattr(model, "treeWeights", [1.0]))
        start: dict[int, int] = {}
        for i, r in enumerate(nodes):
            start.setdefault(r["tree"], i)
        base = [start[r["tree"]] for r in nodes]
        classes = getattr(model, "numClasses", 0) if hasattr(model, "numClasses") else 0
        width = max([r["n_levels"] or 0 for r in nodes], default=0)
        sets = np.zeros((len(nodes), width), bool)
        for i, r in enumerate(nodes):
            if r["n_levels"] is not None:
                sets[i, r["levels"]] = True
        whole = lambda c: np.array([-1 if r[c] is None else r[c] for r in nodes], np.int64)
        left, right = (np.where(whole(c) < 0, -1, whole(c) + np.array(base)) for c in ("left", "right"))
        boosted = len(weights) > 1 and any(len(r["stats"]) == 3 for r in nodes[:1]) or not classes
        values = np.array([[r["prediction"]] if boosted else [x / (sum(r["stats"]) or 1.0) for x in r["stats"]] for r in nodes])
        threshold = np.array([math.nan if r["threshold"] is None else r["threshold"] for r in nodes])
        return cls(np.array([start[t] for t in sorted(start)]), left, right, whole("feature"), threshold, sets, values, np.array(weights), whole("leaf"))

    def ends(self, x: np.ndarray, tree: int) -> np.ndarray:
        """The node at which each row of ``x`` ends in a tree."""
        at = np.full(len(x), self.first[tree])
        moving = np.flatnonzero(self.left[at] >= 0)
        while len(moving):
            node = at[moving]
            value = x[moving, self.feature[node]]
            numeric = np.isfinite(self.threshold[node])
            low = np.zeros(len(moving), bool)
            low[numeric] = value[numeric] <= self.threshold[node[numeric]]
            if not numeric.all():
                code = value[~numeric].astype(np.int64)
                inside = (code >= 0) & (code < self.sets.shape[1])
                low[~numeric] = inside & self.sets[node[~numeric], np.where(inside, code, 0)]
            at[moving] = np.where(low, self.left[node], self.right[node])
            moving = moving[self.left[at[moving]] >= 0]
        return at

    def sums(self, x: np.ndarray) -> np.ndarray:
        """Weighted sums of the trees' values, a row for each row of ``x``."""
        out = np.zeros((len(x), self.values.shape[1]))
        for tree, weight in enumerate(self.weights):
            out += weight * self.values[self.ends(x, tree)]
        return out

    def said(self, columns: list[np.ndarray | float]) -> np.ndarray:
        """:meth:`margin` of inputs given as columns, where one number stands for a column that is the same in all rows.

        The splits of a shallow tree are compared in whole columns; of deep trees rows are followed.
        """
        n = max((len(c) for c in columns if np.ndim(c)), default=1)
        out, ends = np.zeros(n), [*self.first[1:], len(self.left)]
        for tree, weight in enumerate(self.weights):
            if ends[tree] - self.first[tree] < 128:
                out += weight * self._whole(self.first[tree], columns, n)
            else:
                out += weight * self.values[self.ends(np.column_stack([np.broadcast_to(c, n) for c in columns]).astype(float), tree), 0]
        return out

    def _whole(self, root: int, columns: list[np.ndarray | float], n: int):
        """The value of every row in a tree, level by level: a level's splits say for all rows who goes right."""
        level, at = [root], np.zeros(n, np.uint8)
        while any(self.left[node] >= 0 for node in level):
            below, place, right = [], {}, np.zeros(n, bool)
            for i, node in enumerate(level):
                if self.left[node] < 0:
                    place[i] = len(below)
                    below.append(node)
                    continue
                low = self._low(node, columns)
                if np.ndim(low) == 0:
                    place[i] = len(below)
                    below.append(self.left[node] if low else self.right[node])
                else:
                    right |= (at == i) & ~low
                    place[i] = len(below)
                    below += [self.left[node], self.right[node]]
            at = np.array([place[i] for i in range(len(level))], np.uint8)[at] + right
            level = below
        return self.values[level, 0][at]

    def _low(self, node: int, columns: list[np.ndarray | float]):
        value, limit = columns[self.feature[node]], self.threshold[node]
        if math.isfinite(limit):
            return value <= limit
        code = np.asarray(value).astype(np.int64)
        inside = (code >= 0) & (code < self.sets.shape[1])
        return inside & self.sets[node][np.where(inside, code, 0)]

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Weighted sum of predictions: the prediction of a boosted regression, half the log odds of a boosted classifier."""
        return self.sums(x)[:, 0]

    def leaf(self, x: np.ndarray, tree: int) -> np.ndarray:
        """The number of the leaf of a tree, as in a model's ``leafCol``."""
        return self.leaves[self.ends(x, tree)]
