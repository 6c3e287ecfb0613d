"""Rankings with explicit tie-breaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def rank_min(df: DataFrame, by: list[str], value: Column, out: str = "rank") -> DataFrame:
    """Adds the rank by ``value`` descending; ties share the smallest rank."""
    return df.withColumn(out, F.rank().over(W.partitionBy(*by).orderBy(value.desc())))


def top_k(df: DataFrame, by: list[str], order: list[Column], member: str, k: int = 3, out: str = "top") -> DataFrame:
    """``by`` and the first k members as an array, in ``order``, which must decide every tie.

    The window keeps only k rows by group before anything is collected (Spark prunes it before the
    shuffle as well, by a group limit).
    """
    w = W.partitionBy(*by).orderBy(*order)
    kept = df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k)
    return kept.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", member))), lambda s: s[member]).alias(out))


def first_by(df: DataFrame, keys: list[str], order: list[str], last: bool = False) -> DataFrame:
    """One row by key, the first or last in ``order``; partial results before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if last else F.min_by
    return df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")
