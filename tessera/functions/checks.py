"""Small checks and formats that pipelines share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def drift(df: DataFrame, baseline: DataFrame, key: str, text: str) -> DataFrame:
    """key, sha256, expected and status (same, changed, new, gone) of texts against a baseline (key, sha256)."""
    now = df.select(key, F.sha2(text, 256).alias("sha256"))
    j = now.join(baseline.select(key, F.col("sha256").alias("expected")), key, "full")
    status = F.when(F.col("expected").isNull(), "new").when(F.col("sha256").isNull(), "gone").when(F.col("sha256") == F.col("expected"), "same").otherwise("changed")
    return j.withColumn("status", status)


def assert_no_drift(d: DataFrame) -> None:
    """ValueError naming one text that isn't the same as in the baseline."""
    bad = d.where("status <> 'same'").head(1)
    if bad:
        raise ValueError(f"drift: {bad[0].asDict()}")


def leftover_markers(c: Column) -> Column:
    """Does a filled template still hold a marker?"""
    return F.coalesce(c.rlike(r"\{\{[A-Z_]+\}\}"), F.lit(False))


def attempt_number(kind: Column) -> Column:
    """The number of an error kind like ``attempt2_validator``; 0 without one."""
    return F.coalesce(F.when(kind.rlike(r"^attempt\d+"), F.regexp_extract(kind, r"^attempt(\d+)", 1).cast("int")), F.lit(0))


def error_kind(kind: Column) -> Column:
    """schema, validator or api, by the end of an error kind; NULL for others."""
    return F.when(kind.contains("_non_json"), "schema").when(kind.contains("_validator"), "validator").when(kind.contains("_api_error"), "api")


def refuse_partial(todo: DataFrame, prior: DataFrame, keys: list[str]) -> DataFrame:
    """``todo``, where every row has a prior record; else ValueError with one that lacks it."""
    missing = todo.join(prior.select(*keys).distinct(), keys, "left_anti").head(1)
    if missing:
        raise ValueError(f"no prior record for {missing[0].asDict()}")
    return todo


def unresolved(errors: DataFrame, done: DataFrame, call: list[str], scope: str) -> DataFrame:
    """Errors without a success of the same call; a NULL ``scope`` on either side matches any.

    Split by scope, so that both joins are on equal keys.
    """
    some = done.where(F.col(scope).isNotNull()).select(*call, scope).distinct()
    wild = done.where(F.col(scope).isNull()).select(*call).distinct()
    left = errors.join(wild, call, "left_anti")
    named = left.where(F.col(scope).isNotNull()).join(some, [*call, scope], "left_anti")
    return named.unionByName(left.where(F.col(scope).isNull()).join(some.select(*call).distinct(), call, "left_anti"))


def format_p(c: Column) -> Column:
    """A p-value for reports."""
    return F.when(c.isNull(), "–").when(c < 0.0001, F.format_string("%.2e", c)).otherwise(F.format_string("%.4f", c))


def format_rate(c: Column, digits: int = 3) -> Column:
    return F.when(c.isNull(), "–").otherwise(F.format_string(f"%.{digits}f", c))


def morpheme_ttr(tokens: Column) -> dict[str, Column]:
    """Type-token ratio and types of an analyser's (form, tag) tokens, symbols left out; NULL without any."""
    kept = F.transform(F.filter(tokens, lambda t: ~t["tag"].startswith("S")), lambda t: F.concat_ws("/", t["form"], t["tag"]))
    n, types = F.size(kept), F.size(F.array_distinct(kept))
    return {"lex_ttr_morph": F.when(n > 0, types / n), "lex_types_morph": F.when(n > 0, types.cast("double"))}


def stamp(df: DataFrame, **facts) -> DataFrame:
    """``df`` with literal provenance columns."""
    return df.withColumns({k: F.lit(v) for k, v in facts.items()})
