"""Declaration of a table's features."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The level that stands for a missing category.
MISSING = "__nan__"


@dataclass(frozen=True)
class FeatureSpec:
    """Discrete features are those named; all other features are numerical, whatever their type."""

    discrete: tuple[str, ...] = ()
    numerical: tuple[str, ...] = ()
    target: str | None = None
    id: str | None = None

    @classmethod
    def of(cls, df: DataFrame, discrete=(), target: str | None = None, id: str | None = None) -> FeatureSpec:
        """Spec of all columns of ``df`` but the id; ValueError for names that it does not have."""
        discrete = tuple(discrete or ())
        if missing := [c for c in (*discrete, *([target] if target else [])) if c not in df.columns]:
            raise ValueError(f"columns not found: {missing}")
        return cls(tuple(c for c in df.columns if c in discrete), tuple(c for c in df.columns if c not in discrete and c != id), target, id)

    @property
    def features(self) -> tuple[str, ...]:
        return (*self.numerical, *self.discrete)


def as_number(df: DataFrame, column: str):
    """The column as double; dates and timestamps as seconds, NaN as null."""
    kind = df.schema[column].dataType
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.BinaryType)):
        raise ValueError(f"column {column} of type {kind.simpleString()} is no numerical feature")
    c = F.col(column)
    if isinstance(kind, (T.DateType, T.TimestampType)):
        c = F.unix_timestamp(c.cast("timestamp"))
    c = c.cast("double")
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def as_level(column: str):
    """The column as a category; missing is a level of its own."""
    return F.coalesce(F.col(column).cast("string"), F.lit(MISSING))


@dataclass(frozen=True)
class Result:
    """Values of a metric, ``<metric>.<split>.<score>`` to number."""

    values: dict[str, float] = field(default_factory=dict)
