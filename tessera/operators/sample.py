"""Samples and folds that depend on ids and a seed only, never on the order of rows.

Rows are ordered by the MD5 of id and seed.  Each rank is taken within a stratum; strata are few and
large, so ranks come from counts by hash bucket where a whole stratum needn't be ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shuffled(key: Column, seed: int = 42) -> Column:
    """The order key: hex digits of MD5 over ``key|seed``."""
    return F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed))))


def ranked(df: DataFrame, by: list[str], key: str, seed: int = 42, out: str = "draw") -> DataFrame:
    """Adds the place of each row (``key`` unique) in the shuffled order of its stratum, from 1.

    In two levels: the order is cut into 4096 ranges of the hash, rows are ranked within their range,
    and ranges by the counts before them.  A stratum with a third of all rows is thereby spread over
    many tasks.
    """
    h = df.withColumn("_h", shuffled(F.col(key), seed)).withColumn("_b", F.substring("_h", 1, 3))
    counts = h.groupBy(*by, "_b").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(W.partitionBy(*by).orderBy("_b").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_n")).drop("_n")
    inside = h.withColumn("_r", F.row_number().over(W.partitionBy(*by, "_b").orderBy("_h", key)))
    cond = [inside["_b"].eqNullSafe(before["_b"]), *(inside[c].eqNullSafe(before[c]) for c in by)]
    both = inside.join(before, cond)
    return both.select(*[inside[c] for c in df.columns], (F.col("_r") + F.col("_before")).alias(out))


def stratified_folds(df: DataFrame, stratum: str, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Adds ``fold`` (0..k-1): within each stratum the folds' sizes differ by one at most."""
    return ranked(df, [stratum], key, seed).withColumn("fold", ((F.col("draw") - 1) % k).cast("int")).drop("draw")


def group_folds(df: DataFrame, group: str) -> DataFrame:
    """Leave one group out: ``fold`` is the group; a table of one group has no folds."""
    several = df.agg((F.min(group) < F.max(group)).alias("_k")).scalar()
    return df.where(F.col(group).isNotNull() & several).withColumn("fold", F.col(group))


def fixed_per_stratum(df: DataFrame, stratum: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """The first n of each stratum in shuffled order."""
    return ranked(df, [stratum], key, seed).where(F.col("draw") <= n)


def seats(sizes: DataFrame, stratum: str, n: int) -> DataFrame:
    """stratum and seats of n in all: one each, the rest in proportion by largest remainder.

    A stratum gets no more than it holds.  ValueError where there are more strata than n.
    """
    k = sizes.count()
    if k > n:
        raise ValueError(f"{k} strata for {n} seats")
    rest = n - k
    total = F.sum(F.col("n") - 1).over(W.partitionBy())  # one row by stratum, at most n of them
    q = F.when(total > 0, (F.col("n") - 1) * F.lit(float(rest)) / total).otherwise(F.lit(0.0))
    s = sizes.withColumn("_q", q).withColumn("_f", F.floor("_q")).withColumn("_short", F.lit(rest) - F.sum("_f").over(W.partitionBy()))
    r = F.row_number().over(W.orderBy((F.col("_q") - F.col("_f")).desc(), stratum))
    return s.withColumn("_r", r).select(stratum, F.least(F.col("n"), 1 + F.col("_f") + (F.col("_r") <= F.col("_short")).cast("bigint")).cast("bigint").alias("seats"))


def stratified_sample(df: DataFrame, stratum: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows, at least one of each stratum, no row twice."""
    sizes = df.groupBy(stratum).agg(F.count("*").alias("n"))
    return ranked(df, [stratum], key, seed).join(seats(sizes, stratum, n), stratum).where(F.col("draw") <= F.col("seats"))
