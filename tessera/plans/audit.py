"""Agreement of coders and of a detector with them, over flags made of the predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import stats
from tessera.plans.contrast import prevalence
from tessera.plans.decisions import OOF, oof
from tessera.plans.ratings import PAIRED, paired, r6

FAMILY = {"content_1": "content", "organization_1": "discourse", "expression_2": "surface"}


def coders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """essay_id, trait, family, a, b (two coders' detections: a low score) and m (the machine's)."""
    fam = F.create_map(*[F.lit(x) for kv in FAMILY.items() for x in kv])
    p = paired(spark, sf_dir).where("rating_round = 1").withColumn("family", fam[F.col("trait")]).where("family IS NOT NULL")
    c = p.select("essay_id", "trait", "family", (F.col("r1") <= 2).cast("int").alias("a"), (F.col("r2") <= 2).cast("int").alias("b"))
    m = oof(spark, sf_dir).where("cv_scheme = 'grade_stratified' AND y_pred IS NOT NULL").select("essay_id", "trait", (F.col("y_pred") < 2.5).cast("int").alias("m"))
    return c.join(m, ["essay_id", "trait"])


_FAM = "CASE trait " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in FAMILY.items()) + " END"
CODERS = f"""{PAIRED}, {OOF}, coders AS (SELECT essay_id, trait, {_FAM} AS family, (r1 <= 2)::INT AS a, (r2 <= 2)::INT AS b, (y_pred < 2.5)::INT AS m FROM paired JOIN oof USING (essay_id, trait) WHERE rating_round = 1 AND cv_scheme = 'grade_stratified' AND y_pred IS NOT NULL AND {_FAM} IS NOT NULL)"""


def coder_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kappa, prevalence and coverage of two coders, overall and by family, as grouping sets."""
    c = coders(spark, sf_dir)
    g = c.rollup("family").agg(
        F.count("*").alias("n"),
        r6(stats.cohen_kappa(F.col("a"), F.col("b"), [0, 1])).alias("kappa"),
        F.sum("a").alias("n_a"),
        F.sum("b").alias("n_b"),
        F.avg(((F.col("a") == 1) & (F.col("b") == 1)).cast("double")).alias("_r"),
        F.sum(((F.col("a") == 1) & (F.col("b") == 1)).cast("bigint")).alias("n_both"),
    )
    return g.select(F.coalesce("family", F.lit("overall")).alias("family"), "n", "kappa", "n_a", "n_b", "n_both", r6(F.col("_r")).alias("rate"), prevalence(F.col("_r"), F.col("n_both")).alias("prevalence"))


def detector_spotcheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The machine against the first coder by family: misses, false positives and agreement to three digits."""
    c = coders(spark, sf_dir)
    a, m = F.col("a"), F.col("m")
    s = lambda x: F.sum(x.cast("bigint"))
    return c.groupBy("family").agg(F.count("*").alias("n"), s(a == 1).alias("coder_positive"), s(m == 1).alias("machine_positive"), s((a == 1) & (m == 0)).alias("misses"), s((a == 0) & (m == 1)).alias("false_positives"), F.round(F.avg((a == m).cast("double")), 3).alias("agreement_rate"))


def cell_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of decisions detected, and of essays with any detection."""
    e = coders(spark, sf_dir).groupBy("essay_id").agg(F.count("*").alias("n"), F.sum("a").alias("s"), F.max("a").alias("any"))
    return e.agg(F.sum("n").alias("n_decisions"), r6(F.sum("s") / F.sum("n")).alias("decision_rate"), F.count("*").alias("n_cells"), r6(F.avg("any")).alias("cell_rate"))


def annotation_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each essay's cells by each family, to be coded; the families are three constants."""
    fams = F.explode(F.array(*[F.lit(f) for f in sorted(set(FAMILY.values()))])).alias("family_to_code")
    return coders(spark, sf_dir).select("essay_id", "trait", fams)


QUERIES = {"coder_audit": coder_audit, "detector_spotcheck": detector_spotcheck, "cell_detection": cell_detection, "annotation_grid": annotation_grid}
_K = "CASE WHEN abs(1 - (avg(a) * avg(b) + (1 - avg(a)) * (1 - avg(b)))) > 1e-12 THEN (avg((a = b)::INT) - (avg(a) * avg(b) + (1 - avg(a)) * (1 - avg(b)))) / (1 - (avg(a) * avg(b) + (1 - avg(a)) * (1 - avg(b)))) END"
SQL = {
    "coder_audit": f"WITH {CODERS}, g AS (SELECT family, count(*) AS n, round({_K}, 6) AS kappa, sum(a)::BIGINT AS n_a, sum(b)::BIGINT AS n_b, sum(a * b)::BIGINT AS n_both, avg(a * b) AS r FROM coders GROUP BY ROLLUP (family)) SELECT coalesce(family, 'overall') AS family, n, kappa, n_a, n_b, n_both, round(r, 6) AS rate, CASE WHEN n_both = 0 THEN 'DEGENERATE_ZERO' WHEN r < 0.2 THEN 'LOW_PREVALENCE' ELSE 'INTERPRETABLE' END AS prevalence FROM g",
    "detector_spotcheck": f"WITH {CODERS} SELECT family, count(*) AS n, sum(a)::BIGINT AS coder_positive, sum(m)::BIGINT AS machine_positive, sum((a = 1 AND m = 0)::INT)::BIGINT AS misses, sum((a = 0 AND m = 1)::INT)::BIGINT AS false_positives, round(avg((a = m)::INT), 3) AS agreement_rate FROM coders GROUP BY family",
    "cell_detection": f"WITH {CODERS}, e AS (SELECT essay_id, count(*) AS n, sum(a) AS s, max(a) AS any_a FROM coders GROUP BY essay_id) SELECT sum(n)::BIGINT AS n_decisions, round(sum(s) / sum(n)::DOUBLE, 6) AS decision_rate, count(*) AS n_cells, round(avg(any_a), 6) AS cell_rate FROM e",
    "annotation_grid": f"WITH {CODERS} SELECT essay_id, trait, unnest(['content', 'discourse', 'surface']) AS family_to_code FROM coders",
}
