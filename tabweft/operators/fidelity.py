"""Fidelity of synthetic data: marginals, shape and trend, correlations, mutual information, rules, constraints."""

from __future__ import annotations

import math
import re
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabweft.cluster import materialize, shuffle_partitions
from tabweft.functions import distances as dist
from tabweft.functions.expressions import translate
from tabweft.operators.frequencies import binned, both_sides, fit_bins, frequencies, pairs_long, share, unpivot
from tabweft.spec import FeatureSpec, as_level, as_number


def metric_key(value: str) -> str:
    """Lower case, runs of other characters than letters and digits as one underscore."""
    return re.sub(r"[^a-z0-9]+", "_", str(value).strip().lower()).strip("_")


# --- marginals ---------------------------------------------------------------------------------------------------


def categorical_distances(real: DataFrame, syn: DataFrame, spec: FeatureSpec) -> DataFrame:
    """(variable, tvd, jsd, kld) of the discrete features; missing is a level."""
    sides = both_sides(real, syn, list(spec.discrete))
    levels = unpivot(sides.select("side", *[as_level(c).alias(c) for c in spec.discrete]), spec.discrete)
    return _level_distances(levels)


def _level_distances(levels: DataFrame) -> DataFrame:
    p, q = F.col("p"), F.col("q")
    return frequencies(levels).groupBy("variable").agg(dist.tvd(p, q).alias("tvd"), dist.jsd(p, q).alias("jsd"), dist.kld(p, q, F.col("n_levels")).alias("kld"))


def bins_for(real: DataFrame, syn: DataFrame, n_bins: int) -> int:
    return min(real.count(), syn.count(), n_bins)


def binned_distances(real: DataFrame, syn: DataFrame, spec: FeatureSpec, n_bins: int = 20) -> DataFrame:
    """(variable, tvd, jsd, kld) of the numerical features in bins over both sides; fewer than 2 bins: by value."""
    n = bins_for(real, syn, n_bins)
    sides = both_sides(real, syn, list(spec.numerical))
    if n < 2:
        levels = sides.select("side", *[F.coalesce(as_number(sides, c).cast("string"), F.lit("__nan__")).alias(c) for c in spec.numerical])
    else:
        levels = binned(sides, FeatureSpec((), spec.numerical), fit_bins([real, syn], spec), n)
    return _level_distances(unpivot(levels, spec.numerical))


def ordered_distances(real: DataFrame, syn: DataFrame, spec: FeatureSpec) -> DataFrame:
    """(variable, ks, wsd) of the numerical features; the Wasserstein distance is over joint min-max scaled values."""
    sides = both_sides(real, syn, list(spec.numerical))
    rows = unpivot(sides.select("side", *[as_number(sides, c).alias(c) for c in spec.numerical]), spec.numerical, "x").where("x IS NOT NULL")
    counts = rows.groupBy("variable", "x").agg(F.sum(1 - F.col("side")).alias("r"), F.sum("side").alias("s"))
    totals = counts.groupBy("variable").agg(F.sum("r").alias("tr"), F.sum("s").alias("ts"), (F.max("x") - F.min("x")).alias("width"))
    gap = F.abs(F.col("cr") / F.col("tr") - F.col("cs") / F.col("ts"))
    steps = dist.ecdf(counts, shuffle_partitions(real.sparkSession)).join(F.broadcast(totals), "variable")  # one row per variable
    area = F.sum(F.when(F.col("next").isNotNull(), gap * (F.col("next") - F.col("x"))).otherwise(0.0))
    return steps.groupBy("variable").agg(F.max(gap).alias("ks"), F.coalesce(F.try_divide(area, F.max("width")), F.lit(0.0)).alias("wsd"))


def marginals(real: DataFrame, syn: DataFrame, spec: FeatureSpec, n_bins: int = 20) -> DataFrame:
    """(metric, value): the means num_wsd, num_jsd, num_ks, num_tvd, num_kld, cat_jsd, cat_tvd, cat_kld; null without such features."""
    out = None
    for prefix, frame, names in (
        ("num", binned_distances(real, syn, spec, n_bins) if spec.numerical else None, ("jsd", "tvd", "kld")),
        ("num", ordered_distances(real, syn, spec) if spec.numerical else None, ("ks", "wsd")),
        ("cat", categorical_distances(real, syn, spec) if spec.discrete else None, ("jsd", "tvd", "kld")),
    ):
        if frame is None:
            frame = real.sparkSession.createDataFrame([(None,) * len(names)], ", ".join(f"{n} double" for n in names))
        means = frame.agg(*[F.avg(n).alias(n) for n in names])
        long = means.select(F.explode(F.array(*[F.struct(F.lit(f"{prefix}_{n}").alias("metric"), F.col(n).alias("value")) for n in names])).alias("e")).select("e.*")
        out = long if out is None else out.unionByName(long)
    return out


# --- shape and trend ---------------------------------------------------------------------------------------------


def shape_scores(real: DataFrame, syn: DataFrame, spec: FeatureSpec) -> DataFrame:
    """(variable, score): 1 - TVD of discrete features without missing, 1 - KS of numerical ones."""
    out = None
    if spec.discrete:
        sides = both_sides(real, syn, list(spec.discrete))
        levels = unpivot(sides.select("side", *[F.col(c).cast("string").alias(c) for c in spec.discrete]), spec.discrete).where("value IS NOT NULL")
        out = frequencies(levels).groupBy("variable").agg((1 - dist.tvd(F.col("p"), F.col("q"))).alias("score"))
    if spec.numerical:
        num = ordered_distances(real, syn, spec).select("variable", (1 - F.col("ks")).alias("score"))
        out = num if out is None else out.unionByName(num)
    return out


def average_rank(df: DataFrame, x: str, out: str) -> DataFrame:
    """Add the average rank of ``x`` (null for null): ranks are counted on distinct values by value ranges."""
    counts = df.where(F.col(x).isNotNull()).groupBy(F.col(x).cast("double").alias("x")).agg(F.count("*").alias("r"))
    steps = dist.ecdf(counts.select(F.lit("").alias("variable"), "x", "r", F.col("r").alias("s")), shuffle_partitions(df.sparkSession))
    ranks = steps.join(counts, "x").select(F.col("x").alias("__x"), (F.col("cr") - (F.col("r") - 1) / 2).alias(out))
    return df.join(ranks, F.col(x).cast("double") == F.col("__x"), "left").drop("__x")


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation over rows where both are present, null if one is constant. An aggregate."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(x) * F.var_pop(y)))


def _numbers(df: DataFrame, spec: FeatureSpec, ranked: bool) -> DataFrame:
    """The numerical features as numbers, or as average ranks: the ranks of all of them come from one table of distinct values."""
    out = df.select(*[as_number(df, c).alias(c) for c in spec.numerical], *spec.discrete)
    if not ranked:
        return out
    rows = materialize(out.withColumn("__row", F.monotonically_increasing_id()), "ranks")
    long = unpivot(rows.select("__row", *spec.numerical).withColumnRenamed("__row", "side"), spec.numerical, "x").where("x IS NOT NULL").withColumnRenamed("side", "__row")
    counts = materialize(long.groupBy("variable", "x").agg(F.count("*").alias("r")), "ranks")
    steps = dist.ecdf(counts.select("variable", "x", "r", F.col("r").alias("s")), shuffle_partitions(df.sparkSession))
    ranks = steps.join(counts, ["variable", "x"]).select("variable", "x", (F.col("cr") - (F.col("r") - 1) / 2).alias("rank"))
    wide = long.join(ranks, ["variable", "x"]).groupBy("__row").agg(*[F.max(F.when(F.col("variable") == c, F.col("rank"))).alias(c) for c in spec.numerical])
    return rows.select("__row", *spec.discrete).join(wide, "__row", "left").select(*spec.numerical, *spec.discrete)


def numeric_correlations(df: DataFrame, spec: FeatureSpec, method: str = "pearson") -> DataFrame:
    """(u, v, value) for u < v in the order of the spec; one pass for all pairs."""
    pairs = list(combinations(spec.numerical, 2))
    if not pairs:
        return df.sparkSession.createDataFrame([], "u string, v string, value double")
    wide = _numbers(df, FeatureSpec((), spec.numerical), method == "spearman")
    row = wide.agg(*[correlation(F.col(u), F.col(v)).alias(f"c{i}") for i, (u, v) in enumerate(pairs)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(u).alias("u"), F.lit(v).alias("v"), F.col(f"c{i}").alias("value")) for i, (u, v) in enumerate(pairs)])).alias("e")).select("e.*")


def trend_scores(real: DataFrame, syn: DataFrame, spec: FeatureSpec, method: str = "pearson", n_bins: int = 20) -> DataFrame:
    """(u, v, score) of every pair: correlations for two numbers, contingency tables otherwise (numbers in bins over both sides)."""
    out = None
    if len(spec.numerical) > 1:
        a, b = (numeric_correlations(x, spec, method).withColumnRenamed("value", n) for x, n in ((real, "cr"), (syn, "cs")))
        gap = F.abs(F.coalesce("cs", F.lit(0.0)) - F.coalesce("cr", F.lit(0.0)))
        out = a.join(b, ["u", "v"]).select("u", "v", (1 - gap / 2).alias("score"))  # one row per pair of columns
    if spec.discrete:
        sides = both_sides(real, syn, list(spec.features))
        bounds = fit_bins([real, syn], spec)
        levels = binned(sides, spec, bounds, n_bins)
        levels = levels.select("side", *[F.when(F.col(c) != "__nan__", F.col(c)).alias(c) for c in spec.features])
        long = pairs_long(levels, spec.features).where("a IS NOT NULL AND b IS NOT NULL")
        long = long.where(F.col("u").isin(*spec.discrete) | F.col("v").isin(*spec.discrete))
        counts = long.groupBy("u", "v", "a", "b").agg(F.sum(1 - F.col("side")).alias("r"), F.sum("side").alias("s"))
        totals = counts.groupBy("u", "v").agg(F.sum("r").alias("tr"), F.sum("s").alias("ts"))
        cat = counts.join(totals, ["u", "v"]).groupBy("u", "v").agg((1 - 0.5 * F.sum(F.abs(share("r", "tr") - share("s", "ts")))).alias("score"))
        out = cat if out is None else out.unionByName(cat)
    return out if out is not None else real.sparkSession.createDataFrame([], "u string, v string, score double")


def shape_trend(real: DataFrame, syn: DataFrame, spec: FeatureSpec, method: str = "pearson", n_bins: int = 20) -> DataFrame:
    """(metric, value) rows shape and trend."""
    shape = shape_scores(real, syn, spec).agg(F.avg("score").alias("value")).select(F.lit("shape").alias("metric"), "value")
    trend = trend_scores(real, syn, spec, method, n_bins).agg(F.avg("score").alias("value")).select(F.lit("trend").alias("metric"), "value")
    return shape.unionByName(trend)


# --- correlations ------------------------------------------------------------------------------------------------


def cramers_v(df: DataFrame, spec: FeatureSpec) -> DataFrame:
    """(u, v, value) of the discrete pairs, without correction; 0 if one has a single level."""
    pairs = list(combinations(spec.discrete, 2))
    if not pairs:
        return df.sparkSession.createDataFrame([], "u string, v string, value double")
    long = pairs_long(df.select(F.lit(0).alias("side"), *[as_level(c).alias(c) for c in spec.discrete]), spec.discrete)
    cell = long.groupBy("u", "v", "a", "b").agg(F.count("*").alias("n"))
    rows, cols = (cell.groupBy("u", "v", x).agg(F.sum("n").alias(f"n{x}")) for x in ("a", "b"))
    size = rows.groupBy("u", "v").agg(F.sum("na").alias("total"), F.count("*").alias("ka")).join(cols.groupBy("u", "v").agg(F.count("*").alias("kb")), ["u", "v"])
    # chi2 = total * (sum n^2 / (na * nb) - 1): empty cells need no rows
    both = cell.join(rows, ["u", "v", "a"]).join(cols, ["u", "v", "b"]).groupBy("u", "v").agg(F.sum(F.col("n") * F.col("n") / (F.col("na") * F.col("nb"))).alias("q"))
    value = F.sqrt(F.greatest(F.lit(0.0), F.try_divide(F.col("q") - 1, F.least("ka", "kb") - 1)))
    return both.join(size, ["u", "v"]).select("u", "v", F.coalesce(value, F.lit(0.0)).alias("value"))


def eta_squared(df: DataFrame, spec: FeatureSpec) -> DataFrame:
    """(u, v, value) for discrete u and numerical v: between-group share of the variance, 0 if there is none."""
    out = None
    for v in spec.numerical if spec.discrete else ():
        x = as_number(df, v)
        wide = df.select(*[as_level(c).alias(c) for c in spec.discrete], x.alias("x")).where("x IS NOT NULL")
        groups = wide.select("x", F.explode(F.array(*[F.struct(F.lit(c).alias("u"), F.col(c).alias("a")) for c in spec.discrete])).alias("e")).groupBy("e.u", "e.a").agg(F.count("*").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("s"))
        mean = groups.groupBy("u").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand"))
        joined = groups.join(F.broadcast(mean), "u")  # one row per feature
        between, within = F.sum(F.col("n") * F.pow(F.col("m") - F.col("grand"), 2)), F.sum(F.col("n") * F.col("s"))
        one = joined.groupBy("u").agg(F.coalesce(F.try_divide(between, between + within), F.lit(0.0)).alias("value")).select("u", F.lit(v).alias("v"), "value")
        out = one if out is None else out.unionByName(one)
    return out if out is not None else df.sparkSession.createDataFrame([], "u string, v string, value double")


def association_matrix(df: DataFrame, spec: FeatureSpec, method: str = "pearson") -> DataFrame:
    """(u, v, value) of every unordered pair: Pearson or Spearman, Cramer's V, or eta squared."""
    return numeric_correlations(df, spec, method).unionByName(cramers_v(df, spec)).unionByName(eta_squared(df, spec))


def correlations_l2(real: DataFrame, syn: DataFrame, spec: FeatureSpec, method: str = "pearson") -> DataFrame:
    """(metric, value): the Frobenius norm of the difference of the full matrices (each pair counts twice)."""
    a, b = (association_matrix(x, spec, method).withColumnRenamed("value", n) for x, n in ((real, "r"), (syn, "s")))
    return a.join(b, ["u", "v"]).agg(F.sqrt(2 * F.sum(F.pow(F.col("r") - F.col("s"), 2))).alias("value")).select(F.lit("l2").alias("metric"), "value")


# --- mutual information ------------------------------------------------------------------------------------------


def entropies(levels: DataFrame, columns) -> DataFrame:
    """(side, variable, h) in nats."""
    counts = unpivot(levels, columns).groupBy("side", "variable", "value").agg(F.count("*").alias("n"))
    total = counts.groupBy("side", "variable").agg(F.sum("n").alias("t"))
    p = F.col("n") / F.col("t")
    return counts.join(F.broadcast(total), ["side", "variable"]).groupBy("side", "variable").agg(F.sum(-p * F.ln(p)).alias("h"))


def nmi_pairs(real: DataFrame, syn: DataFrame, spec: FeatureSpec, n_bins: int = 20) -> DataFrame:
    """(side, u, v, nmi): mutual information over the geometric mean of the entropies; bins are those of ``real``."""
    levels = binned(both_sides(real, syn, list(spec.features)), spec, fit_bins([real], spec), n_bins)
    h = entropies(levels, spec.features)
    cell = pairs_long(levels, spec.features).groupBy("side", "u", "v", "a", "b").agg(F.count("*").alias("n"))
    total = cell.groupBy("side", "u", "v").agg(F.sum("n").alias("t"))
    p = F.col("n") / F.col("t")
    joint = cell.join(total, ["side", "u", "v"]).groupBy("side", "u", "v").agg(F.sum(-p * F.ln(p)).alias("huv"))
    hu, hv = (h.select("side", F.col("variable").alias(x), F.col("h").alias(f"h{x}")) for x in ("u", "v"))
    out = joint.join(F.broadcast(hu), ["side", "u"]).join(F.broadcast(hv), ["side", "v"])  # one row per feature
    value = F.try_divide(F.greatest(F.col("hu") + F.col("hv") - F.col("huv"), F.lit(0.0)), F.sqrt(F.col("hu") * F.col("hv")))
    return out.select("side", "u", "v", F.coalesce(value, F.lit(0.0)).alias("nmi"))


def nmi_score(real: DataFrame, syn: DataFrame, spec: FeatureSpec, n_bins: int = 20) -> DataFrame:
    """(metric, value): agreement of the pairs' NMI, weighted by its size; null with fewer than two features."""
    pairs = nmi_pairs(real, syn, spec, n_bins)
    wide = pairs.groupBy("u", "v").agg(F.max(F.when(F.col("side") == 0, F.col("nmi"))).alias("r"), F.max(F.when(F.col("side") == 1, F.col("nmi"))).alias("s"))
    score, weight = 1 - F.abs(F.col("r") - F.col("s")), F.abs(F.col("r") + F.col("s"))
    return wide.agg(F.coalesce(F.try_divide(F.sum(weight * score), F.sum(weight)), F.avg(score)).alias("value")).select(F.lit("score").alias("metric"), "value")


# --- association rules -------------------------------------------------------------------------------------------


#: Frequent items that a plan holds as literals; more are joined.
FEW_ITEMS = 2000


def frequent_itemsets(levels: DataFrame, columns, min_support: float | int, max_size: int = 2) -> DataFrame:
    """(items array<string> sorted, n) of ``column=value`` sets in at least ``min_support`` rows (a share, or a count if int).

    Rows that are alike are counted first and then go as one row of weight ``w``. Sizes grow one at a time: rows keep only
    frequent items, and sets with a part that is not frequent are not counted.
    """
    items = levels.select(F.array(*[F.concat(F.lit(f"{c}="), F.col(c)) for c in columns]).alias("row")).groupBy("row").agg(F.count("*").alias("w"))
    items = materialize(items, "itemset-rows")
    rows = items.agg(F.sum("w")).first()[0] or 0
    least = min_support if isinstance(min_support, int) else max(1, math.ceil(min_support * rows))
    counted = lambda sets: materialize(sets.groupBy("items").agg(F.sum("w").alias("n")).where(F.col("n") >= least), "itemsets")
    found = counted(items.select("w", F.explode("row").alias("item")).select("w", F.array("item").alias("items")))
    out, frequent = found, found.limit(FEW_ITEMS + 1).collect()
    if len(frequent) <= FEW_ITEMS:
        known = F.array(*[F.lit(r["items"][0]) for r in frequent]) if frequent else F.array().cast("array<string>")
        base = items.select("w", F.array_sort(F.array_intersect("row", known)).alias("row"))
    else:  # rows are split into items, which meet the frequent ones in a join
        single = items.withColumn("id", F.monotonically_increasing_id())
        single = materialize(single, "item-rows").select("id", "w", F.explode("row").alias("item"))
        base = single.join(found.select(F.col("items")[0].alias("item")), "item").groupBy("id", "w").agg(F.array_sort(F.collect_set("item")).alias("row"))
    for size in range(2, max_size + 1):
        sets = F.transform("row", lambda x: F.array(x))
        for _ in range(size - 1):
            sets = _extend(sets)
        candidates = base.select("w", F.explode(sets).alias("items"))
        if size > 2:  # what is left without the first or the last item is frequent too
            for part in (F.slice("items", 1, size - 1), F.slice("items", 2, size - 1)):
                candidates = candidates.withColumn("part", part).join(found.select(F.col("items").alias("part")), "part", "left_semi").drop("part")
        found = counted(candidates)
        out = out.unionByName(found)
    return out


def _extend(sets: Column) -> Column:
    """Every sorted set with every later item of the row."""
    longer = lambda p: F.transform(F.filter("row", lambda y: y > F.element_at(p, -1)), lambda y: F.concat(p, F.array(y)))
    return F.flatten(F.transform(sets, longer))


def rules(itemsets: DataFrame, min_confidence: float = 0.8, max_size: int = 2) -> DataFrame:
    """(antecedent, consequent, support_n, confidence): every split of every set, several consequents included."""
    out = None
    for size in range(2, max_size + 1):
        sets = itemsets.where(F.size("items") == size)
        for k in range(1, size):
            for left in combinations(range(size), k):
                pick = lambda at: F.array(*[F.col("items")[i] for i in at])
                one = sets.select(pick(left).alias("antecedent"), pick([i for i in range(size) if i not in left]).alias("consequent"), "n")
                out = one if out is None else out.unionByName(one)
    base = itemsets.select(F.col("items").alias("antecedent"), F.col("n").alias("na"))
    joined = out.join(base, "antecedent")
    return joined.select("antecedent", "consequent", F.col("n").alias("support_n"), (F.col("n") / F.col("na")).alias("confidence")).where(F.col("confidence") >= min_confidence)


class AssociationRules:
    """Rules of both sides over bins of the real side."""

    def __init__(self, spec: FeatureSpec, min_support: float | int = 0.1, min_confidence: float = 0.8, n_bins: int = 5, max_size: int = 2):
        if (isinstance(min_support, float) and not 0 < min_support <= 1) or min_support <= 0:
            raise ValueError("min_support is a share in (0, 1] or a positive count")
        if not 0 <= min_confidence <= 1:
            raise ValueError("min_confidence lies in [0, 1]")
        if n_bins < 1 or max_size < 2:
            raise ValueError("n_bins is at least 1 and max_size at least 2")
        self.spec, self.support, self.confidence, self.n_bins, self.max_size = spec, min_support, min_confidence, n_bins, max_size

    def itemsets(self, real: DataFrame, df: DataFrame) -> DataFrame:
        spec = self.spec
        levels = binned(df.select(*spec.features), FeatureSpec(spec.discrete, spec.numerical), fit_bins([real], spec), self.n_bins)
        return frequent_itemsets(levels, spec.features, self.support, self.max_size)

    def rules(self, real: DataFrame, df: DataFrame) -> DataFrame:
        return rules(self.itemsets(real, df), self.confidence, self.max_size)

    def missed(self, real: DataFrame, syn: DataFrame) -> DataFrame:
        """Rules of the real side only."""
        return self.rules(real, real).select("antecedent", "consequent").exceptAll(self.rules(real, syn).select("antecedent", "consequent"))

    def hallucinated(self, real: DataFrame, syn: DataFrame) -> DataFrame:
        """Rules of the synthetic side only."""
        return self.rules(real, syn).select("antecedent", "consequent").exceptAll(self.rules(real, real).select("antecedent", "consequent"))

    def evaluate(self, real: DataFrame, syn: DataFrame) -> DataFrame:
        """(metric, value): precision, recall, n_rules_real, n_rules_syn; precision or recall is null without rules."""
        a, b = (self.rules(real, x).select("antecedent", "consequent") for x in (real, syn))
        both = a.withColumn("r", F.lit(1)).withColumn("s", F.lit(0)).unionByName(b.withColumn("r", F.lit(0)).withColumn("s", F.lit(1)))
        each = both.groupBy("antecedent", "consequent").agg(F.max("r").alias("r"), F.max("s").alias("s"))
        row = each.agg(F.sum(F.col("r") * F.col("s")).alias("b"), F.coalesce(F.sum("r"), F.lit(0)).alias("r"), F.coalesce(F.sum("s"), F.lit(0)).alias("s"))
        values = {"precision": F.try_divide(F.col("b").cast("double"), F.col("s")), "recall": F.try_divide(F.col("b").cast("double"), F.col("r")), "n_rules_real": F.col("r").cast("double"), "n_rules_syn": F.col("s").cast("double")}
        return row.select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("value")) for k, v in values.items()])).alias("e")).select("e.*")


# --- domain constraints ------------------------------------------------------------------------------------------

#: Fixed names of the comparison operators in metric keys, longest first.
_OPERATOR_NAMES = ((">=", "_gte_"), ("<=", "_lte_"), ("==", "_eq_"), ("!=", "_neq_"), (">", "_gt_"), ("<", "_lt_"))


def constraint_key(text: str) -> str:
    for token, name in _OPERATOR_NAMES:
        text = text.replace(token, name)
    return metric_key(text)


def domain_constraints(real: DataFrame, syn: DataFrame, constraints: list[str]) -> DataFrame:
    """(metric, value): for each constraint the share of rows that meet it on both sides, and the synthetic violations."""
    out = None
    for side, df in (("real", real), ("syn", syn)):
        holds = {constraint_key(c): F.coalesce(translate(c), F.lit(False)) for c in constraints}
        row = df.agg(*[f.alias(f"{n}{i}") for i, h in enumerate(holds.values()) for n, f in (("m", F.avg(h.cast("double"))), ("v", F.sum((~h).cast("double"))))])
        parts = [F.struct(F.lit(f"{k}_{side}").alias("metric"), F.col(f"m{i}").alias("value")) for i, k in enumerate(holds)]
        parts += [F.struct(F.lit(f"{k}_syn_n_violations").alias("metric"), F.col(f"v{i}").alias("value")) for i, k in enumerate(holds) if side == "syn"]
        long = row.select(F.explode(F.array(*parts)).alias("e")).select("e.*")
        out = long if out is None else out.unionByName(long)
    return out


# --- plots as data -----------------------------------------------------------------------------------------------


def density_curves(real: DataFrame, syn: DataFrame, spec: FeatureSpec, points: int = 200, n_bins: int = 1000) -> DataFrame:
    """(variable, x, real_density, syn_density): Gaussian kernel estimates with Scott's bandwidth at ``points`` places.

    Values are counted in ``n_bins`` bins over both sides first, and a bin stands for its middle; null without spread.
    """
    bounds = {c: v for c, v in fit_bins([real, syn], spec).items() if c in spec.numerical}
    sides = both_sides(real, syn, list(spec.numerical))
    numbers = unpivot(sides.select("side", *[as_number(sides, c).alias(c) for c in spec.numerical]), spec.numerical, "x").where("x IS NOT NULL")
    limits = [(c, float(lo), float(hi)) for c, (lo, hi) in bounds.items()]
    limits = real.sparkSession.createDataFrame(limits, "variable string, lo double, hi double")
    binned_rows = numbers.join(F.broadcast(limits), "variable").withColumn("w", (F.col("hi") - F.col("lo")) / n_bins)  # one row per variable
    at = F.coalesce(F.least(F.floor(F.try_divide(F.col("x") - F.col("lo"), F.col("w"))), F.lit(n_bins - 1)), F.lit(0))
    cells = binned_rows.withColumn("bin", at).groupBy("variable", "side", "lo", "hi", "w", "bin").agg(F.count("*").alias("n"))
    spread = numbers.groupBy("variable", "side").agg(F.count("*").alias("total"), F.stddev_samp("x").alias("sd"))
    width = F.col("sd") * F.pow(F.col("total").cast("double"), F.lit(-0.2))
    places = F.explode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.struct(i.alias("i"), (F.col("lo") + i * (F.col("hi") - F.col("lo")) / (points - 1)).alias("x"))))
    middle = F.col("lo") + (F.col("bin") + 0.5) * F.col("w")
    # bins x points rows for each variable and side, summed where they arise
    parts = cells.join(spread, ["variable", "side"]).withColumn("h", width).withColumn("m", middle).withColumn("p", places)
    z = F.try_divide(F.col("p.x") - F.col("m"), F.col("h"))
    value = F.sum(F.col("n") * F.exp(-0.5 * z * z) / (F.col("total") * F.col("h") * math.sqrt(2 * math.pi)))
    each = parts.groupBy("variable", F.col("p.i").alias("i"), F.col("p.x").alias("x"), "side").agg(value.alias("d"))
    out = each.groupBy("variable", "i", "x").agg(F.max(F.when(F.col("side") == 0, F.col("d"))).alias("real_density"), F.max(F.when(F.col("side") == 1, F.col("d"))).alias("syn_density"))
    return out.select("variable", "x", "real_density", "syn_density")


def feature_plots(real: DataFrame, syn: DataFrame, spec: FeatureSpec, save_dir: str | None = None, n_bins: int = 20, max_categories: int = 20) -> dict[str, DataFrame]:
    """The data of a plot for every feature: histograms and density curves of numbers, shares of levels; as Parquet below ``save_dir`` if named."""
    if missing := [c for c in spec.features for df in (real, syn) if c not in df.columns]:
        raise ValueError(f"columns not found: {missing}")
    out = {}
    if spec.numerical:
        out |= {"histograms": histograms(real, syn, spec, n_bins), "densities": density_curves(real, syn, spec)}
    if spec.discrete:
        out["proportions"] = proportions(real, syn, spec, max_categories)
    for name, frame in out.items() if save_dir else ():
        frame.write.mode("overwrite").parquet(f"{save_dir}/{name}")
    return out


def histograms(real: DataFrame, syn: DataFrame, spec: FeatureSpec, n_bins: int = 20) -> DataFrame:
    """(variable, bin, lo, hi, real_density, syn_density) over bins of both sides."""
    bounds = fit_bins([real, syn], spec)
    sides = both_sides(real, syn, list(spec.numerical))
    levels = binned(sides, FeatureSpec((), spec.numerical), bounds, n_bins, label="")
    found = frequencies(unpivot(levels, spec.numerical).where("value != '__nan__'"))
    limits = real.sparkSession.createDataFrame([(c, lo, max(hi - lo, 0.0) / n_bins or 1.0) for c, (lo, hi) in bounds.items()], "variable string, lo double, w double")
    at = F.col("value").cast("int")
    return found.join(F.broadcast(limits), "variable").select("variable", at.alias("bin"), (F.col("lo") + at * F.col("w")).alias("lo"), (F.col("lo") + (at + 1) * F.col("w")).alias("hi"), (F.col("p") / F.col("w")).alias("real_density"), (F.col("q") / F.col("w")).alias("syn_density"))


def proportions(real: DataFrame, syn: DataFrame, spec: FeatureSpec, max_categories: int = 20) -> DataFrame:
    """(variable, value, real_share, syn_share); beyond ``max_categories`` levels the rarer ones are ``__other__``."""
    sides = both_sides(real, syn, list(spec.discrete))
    found = frequencies(unpivot(sides.select("side", *[as_level(c).alias(c) for c in spec.discrete]), spec.discrete))
    rank = F.row_number().over(Window.partitionBy("variable").orderBy(F.desc(F.col("p") + F.col("q")), "value"))
    kept = (F.col("n_levels") <= max_categories) | (F.col("k") < max_categories)
    return found.withColumn("k", rank).groupBy("variable", F.when(kept, F.col("value")).otherwise("__other__").alias("value")).agg(F.sum("p").alias("real_share"), F.sum("q").alias("syn_share"))
