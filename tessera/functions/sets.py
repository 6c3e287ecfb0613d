"""Sets of labels as arrays, and their overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.vocab import FAMILIES


def normalize(c: Column) -> Column:
    """The distinct trimmed labels of a pipe-separated text; NULL and blanks give the empty set."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), r"\|"), lambda x: F.trim(x))
    return F.array_distinct(F.filter(parts, lambda x: (x != "") & (F.lower(x) != "nan")))


def jaccard(a: Column, b: Column, empty: float | None = 0.0) -> Column:
    """Size of the intersection over that of the union; ``empty`` where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(empty).cast("double"))


def family_order(c: Column) -> Column:
    """The place of a family in the fixed order; unknown ones come last."""
    return F.coalesce(F.create_map(*[F.lit(x) for i, f in enumerate(FAMILIES) for x in (f, i)])[c], F.lit(len(FAMILIES)))


def pipe(c: Column) -> Column:
    return F.array_join(c, "|")


def alignment_metric(left: DataFrame, right: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Overlap of two set columns joined on ``keys``: jaccard, sizes and empty flags."""
    x, y = F.coalesce(F.col(a), F.array().cast("array<string>")), F.coalesce(F.col(b), F.array().cast("array<string>"))
    j = left.select(*keys, a).join(right.select(*keys, b), keys)
    return j.select(
        *keys, a, b, jaccard(x, y).alias("jaccard"), (F.size(x) == 0).alias(f"{a}_empty"), (F.size(y) == 0).alias(f"{b}_empty"),
        F.size(F.array_union(x, y)).alias("union_size"), F.size(F.array_intersect(x, y)).alias("intersection_size"),
    )
