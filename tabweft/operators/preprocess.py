"""Schema restoration, missing values, constraints, scalers, and the processor that chains them."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabweft.functions.binning import bin_index, edges, ranges
from tabweft.functions.expressions import translate
from tabweft.functions.normal import cdf as normal_cdf
from tabweft.functions.normal import quantile as normal_quantile
from tabweft.functions.order import exact_quantiles
from tabweft.spec import as_number

IMPUTATIONS = ("drop", "keep", "mean", "median", "most_frequent", "missforest")


def decimals(column: Column) -> Column:
    """Decimals that a number prints, trailing zeros aside; null for null."""
    digits = column.cast("decimal(38,10)").cast("string")
    return F.length(F.regexp_replace(F.regexp_extract(digits, r"\.(\d*)$", 1), "0+$", ""))


@dataclass(frozen=True)
class TabularSchema:
    """Order, types and printed precision of a table's columns."""

    column_order: tuple[str, ...]
    dtypes: dict[str, str]
    precision: dict[str, int]

    @classmethod
    def from_dataframe(cls, df: DataFrame, numerical=None) -> TabularSchema:
        numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)] if numerical is None else list(numerical)
        row = df.agg(*[F.coalesce(F.max(decimals(as_number(df, c))), F.lit(0)).alias(f"p{i}") for i, c in enumerate(numeric)]).first() if numeric else {}
        return cls(tuple(df.columns), dict(df.dtypes), {c: int(row[f"p{i}"]) for i, c in enumerate(numeric)})

    def validate_columns(self, df: DataFrame) -> None:
        if missing := [c for c in self.column_order if c not in df.columns]:
            raise ValueError(f"columns are missing: {missing}")

    def round_numeric(self, df: DataFrame) -> DataFrame:
        """Half-even rounding to the known precision."""
        known = {c for c, t in df.dtypes if t in ("double", "float") or t.startswith("decimal")}
        return df.select(*[F.bround(F.col(c), self.precision[c]).alias(c) if c in known and c in self.precision else F.col(c) for c in df.columns])

    def restore(self, df: DataFrame) -> DataFrame:
        self.validate_columns(df)
        rounded = self.round_numeric(df)
        whole = re.compile("tinyint|smallint|int|bigint")
        cast = lambda c: F.bround(F.col(c).cast("double"), 0).cast(self.dtypes[c]) if whole.fullmatch(self.dtypes[c]) else F.col(c).cast(self.dtypes[c])
        return rounded.select(*[cast(c).alias(c) for c in self.column_order])

    def to_json(self) -> str:
        return json.dumps({"column_order": self.column_order, "dtypes": self.dtypes, "precision": self.precision})

    @classmethod
    def from_json(cls, text: str) -> TabularSchema:
        d = json.loads(text)
        return cls(tuple(d["column_order"]), d["dtypes"], d["precision"])


class TabularImputer:
    """Missing numbers: drop, keep, mean, median (exact), most_frequent (the smallest mode) or missforest."""

    def __init__(self, method: str = "drop", random_state: int = 0):
        if method not in IMPUTATIONS:
            raise ValueError(f"method is one of {IMPUTATIONS}")
        self.method, self.random_state = method, random_state
        self.values: dict[str, float] | None = None
        self.numerical: list[str] = []
        self.forest: MissForest | None = None

    def fit(self, df: DataFrame, numerical, others: DataFrame | None = None) -> TabularImputer:
        """Nothing is fitted if neither frame has missing numbers."""
        self.numerical = list(numerical)
        if self.method in ("drop", "keep") or not self.numerical:
            return self
        if not any(_has_missing(x, self.numerical) for x in (df, others) if x is not None):
            return self
        if self.method == "missforest":
            self.forest = MissForest(self.random_state).fit(df, self.numerical)
            self.values = {}
            return self
        if self.method == "median":
            self.values = {c: (exact_quantiles(df, as_number(df, c), [0.5]) or [None])[0] for c in self.numerical}
            return self
        fill = {"mean": F.avg, "most_frequent": lambda c: F.mode(c, True)}[self.method]
        row = df.agg(*[fill(as_number(df, c)).alias(f"v{i}") for i, c in enumerate(self.numerical)]).first()
        self.values = {c: row[f"v{i}"] for i, c in enumerate(self.numerical)}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        if self.method == "keep" or not self.numerical:
            return df
        clean = df.select(*[as_number(df, c).cast(t).alias(c) if c in self.numerical else F.col(c) for c, t in df.dtypes])
        if self.method == "drop":
            return clean.na.drop(subset=self.numerical)
        if self.values is None:
            if _has_missing(df, self.numerical):
                raise RuntimeError("missing values, but none were seen when the imputer was fitted")
            return df
        if self.forest is not None:
            return self.forest.transform(clean)
        kinds = dict(df.dtypes)
        return clean.select(*[F.coalesce(F.col(c).cast("double"), F.lit(float(self.values[c]))).alias(c) if c in self.values and self.values[c] is not None else F.col(c) for c in kinds])

    def fit_transform(self, df: DataFrame, numerical, others: DataFrame | None = None) -> DataFrame:
        return self.fit(df, numerical, others).transform(df)


def _has_missing(df: DataFrame, columns) -> bool:
    row = df.agg(*[F.coalesce(F.max(as_number(df, c).isNull()), F.lit(False)).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    return any(row)


class MissForest:
    """Iterated random forests: every column with missing numbers is predicted from all others, from a mean start.

    At most ``rounds`` rounds, and none after one in which no imputed value changes by ``tolerance`` times the largest
    known number.
    """

    def __init__(self, seed: int = 0, trees: int = 20, depth: int = 10, rounds: int = 10, tolerance: float = 1e-3):
        self.seed, self.trees, self.depth, self.rounds, self.tolerance = seed, trees, depth, rounds, tolerance
        self.models: list = []

    def _encoded(self, df: DataFrame) -> DataFrame:
        kept = ["__row"] if "__row" in df.columns else []
        return df.select(*kept, *[F.pmod(F.xxhash64(F.col(c).cast("string")), F.lit(10_007)).cast("double").alias(c) if c in self.levels else as_number(df, c).alias(c) for c in self.columns])

    def fit(self, df: DataFrame, numerical) -> MissForest:
        self.numerical, self.columns = list(numerical), list(df.columns)
        self.levels = [c for c in df.columns if c not in self.numerical]
        row = df.agg(*[F.avg(as_number(df, c)).alias(c) for c in self.numerical]).first()
        self.start = {c: row[c] or 0.0 for c in self.numerical}
        missing = [c for c in self.numerical if _has_missing(df, [c])]
        work = self._start(df)
        for _ in range(self.rounds if missing else 0):
            stage = []
            work = work.select("*", *[F.col(c).alias(f"__b_{c}") for c in missing])
            for c in missing:
                model = self._forest(c).fit(self._assembled(work, c).where(~F.col(f"__m_{c}")))
                stage.append((c, model))
                work = self._predict(work, c, model)
            work = _cut(work)
            self.models.append(stage)
            moved = F.greatest(F.lit(0.0), *[F.abs(F.col(c) - F.col(f"__b_{c}")) for c in missing])
            known = F.greatest(F.lit(0.0), *[F.when(~F.col(f"__m_{c}"), F.abs(c)).otherwise(0.0) for c in self.numerical])
            change, largest = work.agg(F.max(moved), F.max(known)).first()
            if change < self.tolerance * largest:
                break
            work = work.drop(*[f"__b_{c}" for c in missing])
        return self

    def _start(self, df: DataFrame) -> DataFrame:
        coded = self._encoded(df)
        flags = [F.col(c).isNull().alias(f"__m_{c}") for c in self.numerical]
        kept = ["__row"] if "__row" in df.columns else []
        return coded.select(*kept, *[F.coalesce(F.col(c), F.lit(float(self.start[c]))).alias(c) if c in self.start else F.coalesce(c, F.lit(-2.0)).alias(c) for c in self.columns], *flags)

    def _forest(self, c: str):
        from pyspark.ml.regression import RandomForestRegressor

        return RandomForestRegressor(featuresCol="__x", labelCol=c, predictionCol="__p", numTrees=self.trees, maxDepth=self.depth, seed=self.seed)

    def _assembled(self, df: DataFrame, c: str) -> DataFrame:
        from pyspark.ml.feature import VectorAssembler

        return VectorAssembler(inputCols=[x for x in self.columns if x != c], outputCol="__x").transform(df)

    def _predict(self, df: DataFrame, c: str, model) -> DataFrame:
        out = model.transform(self._assembled(df, c))
        return out.withColumn(c, F.when(F.col(f"__m_{c}"), F.col("__p")).otherwise(F.col(c))).drop("__x", "__p")

    def transform(self, df: DataFrame) -> DataFrame:
        keyed = _cut(df.withColumn("__row", F.monotonically_increasing_id()))
        work = self._start(keyed)
        for stage in self.models:
            for c, model in stage:
                work = self._predict(work, c, model)
        filled = work.select("__row", *[F.col(c).alias(f"__f_{c}") for c in self.numerical])
        joined = keyed.join(filled, "__row")
        return joined.select(*[F.coalesce(F.col(c).cast("double"), F.col(f"__f_{c}")).alias(c) if c in self.numerical else F.col(c) for c in self.columns])


def _cut(df: DataFrame) -> DataFrame:
    from tabweft.cluster import materialize

    return materialize(df, "impute")


@dataclass(frozen=True)
class Constraint:
    left: str
    op: str
    right: str


def parse_constraint(text: str) -> Constraint:
    """``a = b + c`` or ``a > b``, ``a <= b`` (strictness is not kept); ValueError for anything else."""
    plain = text.replace(" ", "")
    if "==" in plain or "!=" in plain:
        raise ValueError(f"use a single = for equality: {text!r}")
    if m := re.fullmatch(r"([^<>=]+)(>=|<=|>|<)([^<>=]+)", plain):
        return Constraint(m[1], m[2][0], m[3])
    if m := re.fullmatch(r"([^<>=]+)=([^<>=]+)", plain):
        return Constraint(m[1], "=", m[2])
    raise ValueError(f"not a constraint: {text!r}")


class ConstraintEnforcer:
    """Equalities drop a column that the other side gives back; inequalities store the difference.

    The inverse undoes them in reverse order. ``clip`` keeps stored differences of generated rows on their side.
    """

    def __init__(self, constraints, clip: bool = False):
        self.constraints = [parse_constraint(c) if isinstance(c, str) else c for c in constraints or ()]
        self.clip = clip
        self.steps: list[tuple[str, str, str, str]] = []

    def transform(self, df: DataFrame) -> DataFrame:
        self.steps = []
        ordered = [c for c in self.constraints if c.op == "="] + [c for c in self.constraints if c.op != "="]
        for c in ordered:
            kind, column, other = ("left", c.left, c.right) if c.left in df.columns else ("right", c.right, c.left)
            if column not in df.columns:
                raise ValueError(f"neither side of {c.left} {c.op} {c.right} is a column")
            self.steps.append((c.op, kind, column, other))
            df = df.drop(column) if c.op == "=" else df.withColumn(column, F.col(column) - translate(other))
        return df

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        for op, kind, column, other in reversed(self.steps):
            if op == "=":
                df = df.withColumn(column, translate(other))
                continue
            stored = F.col(column)
            if self.clip:
                stored = F.greatest(stored, F.lit(0)) if (op == ">") == (kind == "left") else F.least(stored, F.lit(0))
            df = df.withColumn(column, stored + translate(other))
        return df


def constant_columns(df: DataFrame) -> dict[str, object]:
    """Columns with one value only, missing included, and that value."""
    row = df.agg(*[f.alias(f"{n}{i}") for i, c in enumerate(df.columns) for n, f in (("d", F.count_distinct(c)), ("m", F.max(F.col(c).isNull())), ("v", F.max(c)))]).first()
    return {c: row[f"v{i}"] for i, c in enumerate(df.columns) if row[f"d{i}"] + bool(row[f"m{i}"]) == 1}


class DataProcessor:
    """Validate, remember the schema, impute, drop constant columns, apply constraints; and back."""

    def __init__(self, constraints=None, missing_imputation_method: str = "drop", random_state: int = 0):
        self.enforcer, self.imputer = ConstraintEnforcer(constraints), TabularImputer(missing_imputation_method, random_state)
        self.schema: TabularSchema | None = None
        self.constants: dict[str, object] = {}
        self.discrete: tuple[str, ...] = ()

    def preprocess(self, df: DataFrame, discrete=None) -> DataFrame:
        """Fitted by the first call."""
        if self.schema is None:
            self._validate(df)
            self.discrete = tuple(discrete or ())
            self.schema = TabularSchema.from_dataframe(df, [c for c in df.columns if c not in self.discrete])
            self.imputer.fit(df, [c for c in df.columns if c not in self.discrete])
            self.constants = constant_columns(self.imputer.transform(df))
        self.schema.validate_columns(df)
        out = self.imputer.transform(df.select(*self.schema.column_order))
        out = self.enforcer.transform(out)  # constants are still there for the constraints
        return out.drop(*self.constants)

    def postprocess(self, df: DataFrame) -> DataFrame:
        if self.schema is None:
            raise RuntimeError("preprocess comes first")
        out = self.schema.round_numeric(df)
        for c, v in self.constants.items():
            out = out.withColumn(c, F.lit(v))
        return self.schema.restore(self.enforcer.inverse_transform(out))

    @staticmethod
    def _validate(df: DataFrame) -> None:
        if bad := [c for c in df.columns if " " in c]:
            raise ValueError(f"column names with spaces: {bad}")
        row = df.agg(*[F.count(c).alias(f"n{i}") for i, c in enumerate(df.columns)]).first()
        if empty := [c for i, c in enumerate(df.columns) if not row[f"n{i}"]]:
            raise ValueError(f"columns without any value: {empty}")


# --- scalers -----------------------------------------------------------------------------------------------------


def minmax_scale(df: DataFrame, columns, reference: DataFrame | None = None, lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    limits = ranges([reference or df], list(columns), as_number)
    for c in columns:
        a, b = limits[c]
        df = df.withColumn(c, lo + (hi - lo) * (as_number(df, c) - a) / ((b - a) or 1.0))
    return df


def standard_scale(df: DataFrame, columns, reference: DataFrame | None = None) -> DataFrame:
    """Mean 0 and population deviation 1; a constant column is only centred."""
    ref = reference or df
    row = ref.agg(*[f(as_number(ref, c)).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    for i, c in enumerate(columns):
        df = df.withColumn(c, (as_number(df, c) - row[f"m{i}"]) / (row[f"s{i}"] or 1.0))
    return df


def onehot(df: DataFrame, column: str, levels: list[str], weight: float = 0.5) -> DataFrame:
    """One column for each level, ``weight`` where it holds; an unknown level is all zero."""
    return df.select("*", *[F.when(F.col(column).cast("string") == v, weight).otherwise(0.0).alias(f"{column}_{v}") for v in levels]).drop(column)


def onehot_inverse(df: DataFrame, column: str, levels: list[str], baseline: float = 0.5, dropped: str | None = None) -> DataFrame:
    """The level of the largest column (the first of equals). ``dropped``: a level without a column, which holds where none exceeds ``baseline``."""
    names = [f"{column}_{v}" for v in levels]
    pairs = [(F.col(n).cast("double"), F.lit(v)) for n, v in zip(names, levels, strict=True)]
    most = F.greatest(*[c for c, _ in pairs]) if len(pairs) > 1 else pairs[0][0]
    out = F.lit(None).cast("string")
    for c, v in reversed(pairs):
        out = F.when(c == most, v).otherwise(out)
    if dropped is not None:
        out = F.when(most <= baseline / 2, F.lit(dropped)).otherwise(out)
    return df.withColumn(column, out).drop(*names)


def kbins(df: DataFrame, column: str, n_bins: int, reference: DataFrame | None = None) -> DataFrame:
    limits = ranges([reference or df], [column], as_number)
    return df.withColumn(column, bin_index(as_number(df, column), edges(*limits[column], n_bins)))


class QuantileMap:
    """Between a column and its quantile levels, linear between ``n`` exact quantiles; or the normal quantiles of these levels."""

    def __init__(self, values: list[float]):
        self.values = values

    @classmethod
    def fit(cls, df: DataFrame, column: str, n: int = 1000) -> QuantileMap:
        n = max(2, min(n, df.count()))
        return cls(exact_quantiles(df, as_number(df, column), [i / (n - 1) for i in range(n)]) or [])

    def value(self, u: Column) -> Column:
        """The quantile at level ``u`` in [0, 1]."""
        n, table = len(self.values), F.array(*[F.lit(float(v)) for v in self.values])
        at = u * (n - 1)
        i = F.least(F.floor(at).cast("int"), F.lit(n - 2))
        return F.element_at(table, i + 1) + (at - i) * (F.element_at(table, i + 2) - F.element_at(table, i + 1))

    @staticmethod
    def default_count(rows: int) -> int:
        """How many quantiles a transform to normal numbers takes."""
        return max(min(rows // 30, 1000), 10)

    def with_normal(self, df: DataFrame, x: Column, out: str, eps: float = 1e-7) -> DataFrame:
        """Add ``out``: the normal quantile of the value's level, which is kept within [eps, 1 - eps]."""
        level = df.withColumn(out, F.least(F.greatest(self.looked_up(x), F.lit(eps)), F.lit(1 - eps)))  # a column of its own keeps the plan small
        return level.withColumn(out, normal_quantile(F.col(out)))

    def with_value(self, df: DataFrame, z: Column, out: str) -> DataFrame:
        """Add ``out``: the value whose normal quantile is ``z``."""
        return df.withColumn(out, normal_cdf(z)).withColumn(out, self.value(F.col(out)))

    def level(self, x: Column) -> Column:
        """The level of a value: the mean of its interpolations from below and above, so ties get their middle."""
        n, table = len(self.values), F.array(*[F.lit(float(v)) for v in self.values])
        below = F.size(F.filter(table, lambda q: q < x))
        upto = F.size(F.filter(table, lambda q: q <= x))
        step = lambda i: F.try_divide(x - F.element_at(table, i), F.element_at(table, i + 1) - F.element_at(table, i))
        lower = F.when(below == 0, 0.0).when(below >= n, 1.0).otherwise((below - 1 + step(F.greatest(below, F.lit(1)))) / (n - 1))
        upper = F.when(upto == 0, 0.0).when(upto >= n, 1.0).otherwise((upto - 1 + F.coalesce(step(F.greatest(F.least(upto, F.lit(n - 1)), F.lit(1))), F.lit(0.0))) / (n - 1))
        return (lower + upper) / 2

    def looked_up(self, x: Column) -> Column:
        """:meth:`level` by binary search in whole batches, for tables of many rows."""
        values = np.array(self.values, float)
        n = len(values)
        if n < 2:
            return self.level(x)

        @F.pandas_udf("double")
        def place(v: pd.Series) -> pd.Series:
            v = v.to_numpy(float)

            def side(upto: np.ndarray) -> np.ndarray:
                i = np.clip(upto, 1, n - 1)
                width = values[i] - values[i - 1]
                inside = (i - 1 + (v - values[i - 1]) / np.where(width > 0, width, 1.0)) / (n - 1)
                return np.where(upto == 0, 0.0, np.where(upto >= n, 1.0, inside))

            return pd.Series((side(np.searchsorted(values, v, "left")) + side(np.searchsorted(values, v, "right"))) / 2)

        x = x.cast("double")
        return F.when(x.isNull(), 0.0).when(F.isnan(x), 1.0).otherwise(place(x))
