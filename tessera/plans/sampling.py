"""Folds and samples of the rated essays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import sample
from tessera.plans.ratings import PAIRED, RATINGS, paired, r6, ratings
from tessera.session import table


def rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row by rated essay: grade, purpose, prompt_id, avg_score, na_flag of round 1."""
    r = ratings(spark, sf_dir).where("rating_round = 1")
    g = r.groupBy("essay_id").agg(F.max("grade").alias("grade"), F.max("purpose").alias("purpose"), F.max("prompt_id").alias("prompt_id"), F.avg((F.col("r1") + F.col("r2")) / 2).alias("avg_score"), F.bool_or(F.col("r1").isNull() | F.col("r2").isNull()).alias("na_flag"))
    band = F.when(F.col("avg_score").isNull(), "na").when(F.col("avg_score") < 2.5, "low").when(F.col("avg_score") < 4.0, "mid").otherwise("high")
    return g.withColumn("score_band", band)


RATED = f"""{RATINGS}, rated AS (SELECT essay_id, max(grade) AS grade, max(purpose) AS purpose, max(prompt_id) AS prompt_id, avg((r1 + r2) / 2.0) AS avg_score, bool_or(r1 IS NULL OR r2 IS NULL) AS na_flag FROM ratings WHERE rating_round = 1 GROUP BY essay_id),
bands AS (SELECT *, CASE WHEN avg_score IS NULL THEN 'na' WHEN avg_score < 2.5 THEN 'low' WHEN avg_score < 4 THEN 'mid' ELSE 'high' END AS score_band FROM rated)"""
_H = "md5(essay_id || '|42')"


def strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score band, missing flag and stratum of every essay."""
    s = rated(spark, sf_dir)
    flag = F.when(F.col("na_flag"), "True").otherwise("False")
    return s.select("essay_id", r6(F.col("avg_score")).alias("avg_score"), "na_flag", "score_band", "grade", F.concat_ws("|", "score_band", flag, "grade").alias("stratum"))


def grade_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample.stratified_folds(rated(spark, sf_dir).where("grade IS NOT NULL").select("essay_id", "grade"), "grade", "essay_id")


def prompt_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample.group_folds(rated(spark, sf_dir).select("essay_id", "prompt_id"), "prompt_id")


def proportional_sample(spark: SparkSession, sf_dir: str, n: int = 60) -> DataFrame:
    """Sixty essays over all strata of band and missing flag."""
    s = rated(spark, sf_dir).select("essay_id", F.concat_ws("|", "score_band", F.when(F.col("na_flag"), "True").otherwise("False")).alias("stratum"))
    return sample.stratified_sample(s, "stratum", "essay_id", n).select("essay_id", "stratum")


def purpose_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten essays of each purpose."""
    s = rated(spark, sf_dir).where("purpose IS NOT NULL").select("essay_id", "purpose")
    return sample.fixed_per_stratum(s, "purpose", "essay_id", 10).select("essay_id", "purpose", "draw")


def spotcheck_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty cells whose raters differ by two or more and twenty controls, blindly mixed."""
    p = paired(spark, sf_dir).where("rating_round = 1").select("essay_id", F.concat_ws("/", F.col("essay_id").cast("string"), "trait").alias("cell"), F.when(F.abs(F.col("r1") - F.col("r2")) >= 2, "failure").otherwise("control").alias("kind"))
    return sample.fixed_per_stratum(p, "kind", "cell", 20).select("cell", "kind", sample.shuffled(F.col("cell"), 7).alias("blind_order"))


def base_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical fifteen essays; smaller samples are its first rows."""
    s = rated(spark, sf_dir).select("essay_id", F.lit("all").alias("scope"))
    return sample.fixed_per_stratum(s, "scope", "essay_id", 15).select("essay_id", "draw")


def background_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred rows of the other folds, for each scheme, trait and fold of the predictions."""
    o = table(spark, sf_dir, "oof_predictions").where("essay_id IS NOT NULL AND fold IS NOT NULL AND trait IS NOT NULL").select("cv_scheme", "trait", "fold", "essay_id").distinct()
    own = o.where("cv_scheme = 'grade_stratified'")
    folds = own.select("trait", F.col("fold").alias("test_fold")).distinct()
    pool = own.join(folds, "trait").where("fold <> test_fold").select("test_fold", "trait", "essay_id").distinct()
    return sample.ranked(pool, ["test_fold", "trait"], "essay_id").where("draw <= 100").select("test_fold", "trait", "essay_id")


QUERIES = {
    "score_strata": strata,
    "grade_folds": grade_folds,
    "prompt_folds": prompt_folds,
    "proportional_sample": proportional_sample,
    "purpose_sample": purpose_sample,
    "spotcheck_sample": spotcheck_sample,
    "base_sample": base_sample,
    "background_sample": background_sample,
}
SQL = {
    "score_strata": f"WITH {RATED} SELECT essay_id, round(avg_score, 6) AS avg_score, na_flag, score_band, grade, concat_ws('|', score_band, CASE WHEN na_flag THEN 'True' ELSE 'False' END, grade) AS stratum FROM bands",
    "grade_folds": f"WITH {RATED} SELECT essay_id, grade, ((row_number() OVER (PARTITION BY grade ORDER BY {_H}, essay_id) - 1) % 5)::INT AS fold FROM bands WHERE grade IS NOT NULL",
    "prompt_folds": f"WITH {RATED} SELECT essay_id, prompt_id, prompt_id AS fold FROM bands WHERE prompt_id IS NOT NULL AND (SELECT count(DISTINCT prompt_id) FROM bands) > 1",
    "proportional_sample": f"""WITH {RATED}, s AS (SELECT essay_id, concat_ws('|', score_band, CASE WHEN na_flag THEN 'True' ELSE 'False' END) AS stratum FROM bands), z AS (SELECT stratum, count(*) AS n FROM s GROUP BY stratum), q AS (SELECT *, (n - 1) * (60 - (SELECT count(*) FROM z))::DOUBLE / (SELECT sum(n - 1) FROM z) AS q FROM z),
f AS (SELECT *, floor(q) AS f, 60 - (SELECT count(*) FROM z) - sum(floor(q)) OVER () AS short FROM q), t AS (SELECT *, least(n, 1 + f + (row_number() OVER (ORDER BY q - f DESC, stratum) <= short)::INT) AS seats FROM f), d AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY {_H}, essay_id) AS draw FROM s) SELECT essay_id, stratum FROM d JOIN t USING (stratum) WHERE draw <= seats""",
    "purpose_sample": f"WITH {RATED}, d AS (SELECT essay_id, purpose, row_number() OVER (PARTITION BY purpose ORDER BY {_H}, essay_id) AS draw FROM bands WHERE purpose IS NOT NULL) SELECT * FROM d WHERE draw <= 10",
    "spotcheck_sample": f"WITH {PAIRED}, c AS (SELECT essay_id || '/' || trait AS cell, CASE WHEN abs(r1 - r2) >= 2 THEN 'failure' ELSE 'control' END AS kind FROM paired WHERE rating_round = 1), d AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY md5(cell || '|42'), cell) AS k FROM c) SELECT cell, kind, md5(cell || '|7') AS blind_order FROM d WHERE k <= 20",
    "base_sample": f"WITH {RATED}, d AS (SELECT essay_id, row_number() OVER (ORDER BY {_H}, essay_id) AS draw FROM bands) SELECT * FROM d WHERE draw <= 15",
    "background_sample": f"""WITH o AS (SELECT DISTINCT trait, fold, essay_id FROM oof_predictions WHERE essay_id IS NOT NULL AND fold IS NOT NULL AND trait IS NOT NULL AND cv_scheme = 'grade_stratified'), f AS (SELECT DISTINCT trait, fold AS test_fold FROM o), p AS (SELECT DISTINCT test_fold, o.trait, essay_id FROM o JOIN f ON o.trait = f.trait AND o.fold <> f.test_fold),
d AS (SELECT *, row_number() OVER (PARTITION BY test_fold, trait ORDER BY {_H}, essay_id) AS k FROM p) SELECT test_fold, trait, essay_id FROM d WHERE k <= 100""",
}
