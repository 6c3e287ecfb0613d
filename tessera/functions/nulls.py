"""Missing values: one kind, NULL, and what follows from that."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nan_to_null(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """NaN as NULL in float columns, so that aggregates skip it."""
    kinds = dict(df.dtypes)
    which = [c for c in (columns or df.columns) if kinds[c] in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in which})


def ratio(a: Column, b: Column) -> Column:
    """a / b as double; NULL where b is 0 or either is NULL."""
    return F.when(b != 0, a.cast("double") / b)


def fired(c: Column, compat: bool = False) -> Column:
    """A rule's flag where it may be missing: not fired, or in ``compat`` mode fired."""
    return F.coalesce(c, F.lit(compat))


def not_null(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns]))


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` itself, where ``keys`` are unique in it; else ValueError naming one key."""
    twice = df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").head(1)
    if twice:
        raise ValueError(f"{keys} is not unique: {twice[0].asDict()}")
    return df


def one_to_one(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """The inner join of two tables in which ``keys`` are unique; else ValueError naming one key."""
    return assert_unique(a, keys).join(assert_unique(b, keys), keys)


def strict_pivot(df: DataFrame, keys: list[str], column: str, values: list, cell: str, prefix: str = "") -> DataFrame:
    """``cell`` by ``keys`` with the given values of ``column`` in columns; ValueError where a cell stands twice."""
    checked = assert_unique(df, [*keys, column])
    return checked.groupBy(*keys).agg(*[F.max(F.when(F.col(column) == v, F.col(cell))).alias(f"{prefix}{v}") for v in values])
