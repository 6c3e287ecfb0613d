"""The evidence matrix, its labels, and what follows from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import stats
from tessera.functions import text as T
from tessera.functions.nulls import ratio
from tessera.functions.rules import classify, closer, family_match, level, reliability_weight
from tessera.functions.sets import jaccard
from tessera.functions.vocab import AREA_FAMILIES, TRAIT_AREA, TRAITS
from tessera.plans.features import _TOKENS, _families_sql
from tessera.plans.ratings import PURITY, latest, paired, purity, r6, ratings
from tessera.session import table

SCHEMES = ("grade_stratified", "leave_one_prompt_out")


def oof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each (essay, trait, scheme) once."""
    return latest(table(spark, sf_dir, "oof_predictions"), ["essay_id", "trait", "cv_scheme"], ["fold", "y_true", "y_pred"])


OOF = """oof AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY essay_id, trait, cv_scheme ORDER BY fold DESC NULLS LAST, y_true DESC NULLS LAST, y_pred DESC NULLS LAST) AS k FROM oof_predictions WHERE essay_id IS NOT NULL AND trait IS NOT NULL AND cv_scheme IS NOT NULL) WHERE k = 1)"""


def oof_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regression metrics by scheme, trait and fold: n, QWK of half-even scores, MAE, RMSE, Pearson."""
    d = oof(spark, sf_dir).where("fold IS NOT NULL AND y_true IS NOT NULL AND y_pred IS NOT NULL")
    t, p = F.col("y_true"), F.col("y_pred")
    a, b = stats.clip_round(t), stats.clip_round(p)
    return d.groupBy("cv_scheme", "trait", "fold").agg(F.count("*").alias("n"), r6(stats.qwk(a, b)).alias("qwk"), r6(F.avg(F.abs(t - p))).alias("mae"), r6(F.sqrt(F.avg((t - p) ** 2))).alias("rmse"), r6(stats.pearson(t, p)).alias("pearson_r"))


_CR = "CASE WHEN {0} IS NOT NULL THEN least(greatest(round_even({0}, 0), 1), 5) END"
METRICS = f"""{OOF}, om AS (SELECT cv_scheme, trait, fold, y_true AS t, y_pred AS p, {_CR.format('y_true')} AS a, {_CR.format('y_pred')} AS b FROM oof WHERE fold IS NOT NULL AND y_true IS NOT NULL AND y_pred IS NOT NULL),
met AS (SELECT cv_scheme, trait, fold, count(*) AS n, round(CASE WHEN var_pop(a) + var_pop(b) + (avg(a) - avg(b)) ** 2 <> 0 THEN 1 - avg((a - b) ** 2) / (var_pop(a) + var_pop(b) + (avg(a) - avg(b)) ** 2) END, 6) AS qwk, round(avg(abs(t - p)), 6) AS mae, round(sqrt(avg((t - p) ** 2)), 6) AS rmse, round(CASE WHEN var_pop(t) > 0 AND var_pop(p) > 0 THEN corr(t, p) END, 6) AS pearson_r FROM om GROUP BY ALL)"""


def oof_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and deviation over folds of each metric; a single fold has deviation 0."""
    m = oof_metrics(spark, sf_dir)
    cols = [c for k in ("qwk", "mae", "rmse", "pearson_r") for c in (F.round(F.avg(k), 5).alias(f"{k}_mean"), F.round(F.coalesce(F.stddev_samp(k), F.lit(0.0)), 5).alias(f"{k}_std"))]
    return m.groupBy("cv_scheme", "trait").agg(F.count("*").alias("n_folds"), *cols)


def score_qwk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions against the raters' mean, by purpose and trait, on half-even scores."""
    h = paired(spark, sf_dir).where("rating_round = 1 AND purpose IS NOT NULL").select("essay_id", "trait", "purpose", ((F.col("r1") + F.col("r2")) / 2).alias("human"))
    p = oof(spark, sf_dir).where("cv_scheme = 'grade_stratified' AND y_pred IS NOT NULL").select("essay_id", "trait", "y_pred")
    j = h.join(p, ["essay_id", "trait"]).select("purpose", "trait", stats.clip_round(F.col("human")).alias("a"), stats.clip_round(F.col("y_pred")).alias("b"))
    return j.groupBy("purpose", "trait").agg(F.count("*").alias("n"), r6(stats.qwk(F.col("a"), F.col("b"))).alias("qwk"), r6(F.avg("a")).alias("human_mean"), r6(F.avg("b")).alias("predicted_mean"))


SCORE_QWK = f"""{PURITY}, paired AS (SELECT * FROM ratings WHERE r1 IS NOT NULL AND r2 IS NOT NULL), {OOF}, sq AS (SELECT purpose, trait, {_CR.format('(r1 + r2) / 2.0')} AS a, {_CR.format('y_pred')} AS b FROM paired JOIN oof USING (essay_id, trait) WHERE rating_round = 1 AND purpose IS NOT NULL AND cv_scheme = 'grade_stratified' AND y_pred IS NOT NULL),
sqw AS (SELECT purpose, trait, count(*) AS n, CASE WHEN var_pop(a) + var_pop(b) + (avg(a) - avg(b)) ** 2 <> 0 THEN 1 - avg((a - b) ** 2) / (var_pop(a) + var_pop(b) + (avg(a) - avg(b)) ** 2) END AS q, avg(a) AS ma, avg(b) AS mb FROM sq GROUP BY purpose, trait)"""


def headline(spark: SparkSession, sf_dir: str, threshold: float = 0.5) -> DataFrame:
    """Variant by purpose from how many traits reach the threshold: three or more, two, fewer."""
    g = score_qwk(spark, sf_dir).groupBy("purpose").agg(F.count("*").alias("n_traits"), F.sum(F.coalesce((F.col("qwk") >= threshold).cast("bigint"), F.lit(0))).alias("n_passing"))
    return g.withColumn("variant", F.when(F.col("n_passing") >= 3, "V1").when(F.col("n_passing") == 2, "V2").otherwise("V3"))


def threshold_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One flag column for each threshold of the summary's kappa; a missing kappa fires none."""
    s = oof_summary(spark, sf_dir).select("cv_scheme", "trait", "qwk_mean")
    return s.select("*", *[F.coalesce(F.col("qwk_mean") < t, F.lit(False)).alias(f"flag_qwk_lt_{int(t * 100)}") for t in (0.10, 0.15, 0.20)])


def trait_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By trait over the schemes: least mean correlation with its flag, and overlap of the predictions."""
    m = oof_summary(spark, sf_dir).groupBy("trait").agg(F.min("pearson_r_mean").alias("tau_mean_min"), F.bool_or(F.coalesce(F.col("pearson_r_mean") < 0.5, F.lit(False))).alias("tau_unstable_any"))
    o = oof(spark, sf_dir).where("y_pred IS NOT NULL").groupBy("essay_id", "trait").agg(*[F.max(F.when(F.col("cv_scheme") == s, stats.clip_round(F.col("y_pred")))).alias(f"p{i}") for i, s in enumerate(SCHEMES)])
    j = o.where("p0 IS NOT NULL AND p1 IS NOT NULL").groupBy("trait").agg(r6(F.avg((F.col("p0") == F.col("p1")).cast("double"))).alias("stability_jaccard"))
    return m.join(j, "trait", "left").withColumn("jaccard_unstable", F.col("stability_jaccard") < 0.5)


STABILITY = f"""{METRICS}, osum AS (SELECT cv_scheme, trait, round(avg(pearson_r), 5) AS p FROM met GROUP BY ALL), s1 AS (SELECT trait, min(p) AS tau_mean_min, bool_or(coalesce(p < 0.5, false)) AS tau_unstable_any FROM osum GROUP BY trait),
s2 AS (SELECT a.trait, round(avg(({_CR.format('a.y_pred')} = {_CR.format('b.y_pred')})::INT), 6) AS stability_jaccard FROM oof a JOIN oof b ON a.essay_id = b.essay_id AND a.trait = b.trait WHERE a.cv_scheme = 'grade_stratified' AND b.cv_scheme = 'leave_one_prompt_out' AND a.y_pred IS NOT NULL AND b.y_pred IS NOT NULL GROUP BY a.trait),
stability AS (SELECT trait, tau_mean_min, tau_unstable_any, stability_jaccard, stability_jaccard < 0.5 AS jaccard_unstable FROM s1 LEFT JOIN s2 USING (trait))"""


def code(c):
    """The ordinal code of a score."""
    return F.when(c.isNull(), "NA").when(c >= 4, "상").when(c >= 2.5, "중").otherwise("하")


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row by rated essay and trait of round 1, with all evidence joined to it.

    The joins are on keys that are unique on the right; the two trait tables have eight rows.
    """
    r = ratings(spark, sf_dir).where("rating_round = 1").where(F.col("trait").isin(list(TRAITS))).withColumn("_t", T.tokens(F.col("feedback")))
    base = r.select("essay_id", "trait", "purpose", "grade", "prompt_id", F.col("r1").alias("human_r1"), F.col("r2").alias("human_r2"), ((F.col("r1") + F.col("r2")) / 2).alias("human_mean"), F.abs(F.col("r1") - F.col("r2")).alias("human_disagreement"), T.families(F.col("_t")).alias("llm_families"))
    p = oof(spark, sf_dir).where("cv_scheme = 'grade_stratified'").select("essay_id", "trait", stats.clip_round(F.col("y_pred")).cast("int").alias("llm_score"))
    pure = purity(spark, sf_dir).select("essay_id", "trait", F.col("impure_50pct").alias("feedback_impure_50"), ratio(F.col("on_area_mentions"), F.col("total_mentions")).alias("justification_rate"))
    m = base.join(p, ["essay_id", "trait"], "left").join(pure, ["essay_id", "trait"], "left").join(trait_stability(spark, sf_dir), "trait", "left")
    return m.withColumn("llm_is_na", F.col("llm_score").isNull()).withColumn("llm_code", code(F.col("llm_score"))).withColumn("human_code", code(F.col("human_mean"))).withColumn("family_rubric_match", F.when(F.size("llm_families") > 0, family_match(F.col("trait"), F.col("llm_families"))))


_CODE = "CASE WHEN {0} IS NULL THEN 'NA' WHEN {0} >= 4 THEN '상' WHEN {0} >= 2.5 THEN '중' ELSE '하' END"
_MATCH = "CASE " + " ".join(f"WHEN trait = '{t}' THEN len(list_intersect(llm_families, [{', '.join(repr(f) for f in AREA_FAMILIES[a][0] + AREA_FAMILIES[a][1])}])) > 0" for t, a in TRAIT_AREA.items()) + " END"
EVIDENCE = f"""{PURITY}, {STABILITY}, base AS (SELECT *, {_families_sql()} AS llm_families FROM (SELECT *, {_TOKENS.format('feedback')} AS t FROM ratings WHERE rating_round = 1 AND trait IN ({', '.join(f"'{t}'" for t in TRAITS)}))),
evidence AS (SELECT b.essay_id, trait, b.purpose, r1, r2, (r1 + r2) / 2.0 AS human_mean, abs(r1 - r2) AS human_disagreement, ({_CR.format('y_pred')})::INT AS llm_score, ratio >= 0.5 AS feedback_impure_50, on_area_mentions / total_mentions::DOUBLE AS justification_rate, tau_mean_min, tau_unstable_any, stability_jaccard, jaccard_unstable,
 CASE WHEN len(llm_families) > 0 THEN {_MATCH} END AS family_rubric_match, llm_families FROM base b LEFT JOIN (SELECT essay_id, trait, y_pred FROM oof WHERE cv_scheme = 'grade_stratified') o USING (essay_id, trait) LEFT JOIN (SELECT essay_id, trait, ratio, on_area_mentions, total_mentions FROM pure) p USING (essay_id, trait) LEFT JOIN stability USING (trait)),
coded AS (SELECT *, llm_score IS NULL AS llm_is_na, {_CODE.format('llm_score')} AS llm_code, {_CODE.format('human_mean')} AS human_code FROM evidence)"""


def coded_counts(spark: SparkSession, sf_dir: str, rounds: bool = False) -> DataFrame:
    """trait, first (is it of round 1 and a known trait?), r1, r2, llm_code, human_code, llm_families and n: the rated
    cells of :func:`evidence`, with ``rounds`` those of all rounds, as counts of those alike.

    What needs no more than codes and families is a statistic of these counts, so that each table is read once.
    """
    first = (F.col("rating_round") == 1) & F.col("trait").isin(list(TRAITS))
    r = ratings(spark, sf_dir)
    r = (r if rounds else r.where(first)).select("essay_id", "trait", first.alias("first"), "r1", "r2", F.when(first, T.named_families(T.spaced(F.col("feedback")))).alias("llm_families"))
    p = oof(spark, sf_dir).where("cv_scheme = 'grade_stratified'").select("essay_id", "trait", code(stats.clip_round(F.col("y_pred"))).alias("llm_code"))
    m = r.join(p, ["essay_id", "trait"], "left").withColumn("llm_code", F.coalesce("llm_code", F.lit("NA")))
    c = m.groupBy("trait", "first", "r1", "r2", "llm_code", "llm_families").agg(F.count("*").alias("n"))
    return c.withColumn("human_code", code((F.col("r1") + F.col("r2")) / 2))


def evidence_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = evidence(spark, sf_dir)
    return m.select("essay_id", "trait", "purpose", "human_r1", "human_r2", "human_mean", "human_disagreement", "llm_score", "llm_is_na", "llm_code", "human_code", "feedback_impure_50", r6(F.col("justification_rate")).alias("justification_rate"), "tau_mean_min", "tau_unstable_any", "stability_jaccard", "jaccard_unstable", "family_rubric_match")


def labelled(spark: SparkSession, sf_dir: str, compat: bool = False) -> DataFrame:
    return evidence(spark, sf_dir).withColumns(classify(compat))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).select("essay_id", "trait", "label", "priority_rank", "triggered_rules")


def labels_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir, True).select("essay_id", "trait", "label", "priority_rank", "triggered_rules")


def _labels_sql(compat: bool) -> str:
    f = "true" if compat else "false"
    no_match = f"coalesce(NOT family_rubric_match, {'false' if compat else 'true'})"
    return f"""{EVIDENCE}, fl AS (SELECT *, coalesce(tau_unstable_any, {f}) AS tau, coalesce(jaccard_unstable, {f}) AS jac, coalesce(feedback_impure_50, {f}) AS imp, llm_code = 'NA' OR llm_is_na AS lna, human_code = 'NA' AS hna, {no_match} AS nom, coalesce(justification_rate <= 0.1, false) AS civ,
 coalesce(family_rubric_match, false) AND llm_code = '상' AND human_code IN ('상', '중') AS ali FROM coded), fm AS (SELECT *, (tau AND jac)::INT + lna::INT + hna::INT + imp::INT >= 2 AS many, tau OR jac OR nom AS ur FROM fl),
labelled AS (SELECT *, CASE WHEN many THEN 'Indeterminate' WHEN ur THEN 'UR' WHEN civ THEN 'CIV' WHEN ali THEN 'Aligned' ELSE 'Indeterminate' END AS label, CASE WHEN many THEN 1 WHEN ur THEN 2 WHEN civ THEN 3 WHEN ali THEN 4 ELSE 1 END AS priority_rank,
 CASE WHEN many THEN concat_ws('|', CASE WHEN tau AND jac THEN 'both_tau_and_jaccard_unstable' END, CASE WHEN lna THEN 'llm_na' END, CASE WHEN hna THEN 'human_na' END, CASE WHEN imp THEN 'feedback_impure_50' END)
 WHEN ur OR civ THEN concat_ws('|', CASE WHEN ur THEN 'shap_absent_or_unstable' END, CASE WHEN civ THEN 'rationale_mapping_below_10pct' END, CASE WHEN ur AND civ THEN 'also_civ_triggered' END) WHEN ali THEN 'converge_on_rubric_relevant' ELSE 'residual_no_decisive_evidence' END AS triggered_rules FROM fm)"""


def label_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels by trait, in columns."""
    names = ["Aligned", "CIV", "Indeterminate", "UR"]
    return labelled(spark, sf_dir).groupBy("trait").agg(*[F.sum((F.col("label") == n).cast("bigint")).alias(n) for n in names], F.count("*").alias("total"))


def label_independence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chi-square of label by purpose within each trait, corrected for continuity with one degree of freedom."""
    l = labelled(spark, sf_dir).where("purpose IS NOT NULL").select("trait", "purpose", "label")
    return stats.chi_square(l, "purpose", "label", ["trait"]).withColumn("statistic", F.round("statistic", 4))


def label_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tests of independence with their p."""
    return label_independence(spark, sf_dir).withColumn("p", stats.chi_square_p(F.col("statistic"), F.col("dof")))


def threshold_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares that each pair of thresholds flags; a missing rate counts as 1, a missing overlap as 0."""
    grid = F.inline(F.array(*[F.struct(F.lit(a).alias("justification_max"), F.lit(b).alias("jaccard_min")) for a in (0.05, 0.10, 0.20, 0.30) for b in (0.3, 0.5, 0.7)]))
    m = evidence(spark, sf_dir).select(F.coalesce("justification_rate", F.lit(1.0)).alias("j"), F.coalesce("stability_jaccard", F.lit(0.0)).alias("s"))
    # values recur, so the twelve thresholds meet their counts, not the rows
    c = m.groupBy("j", "s").agg(F.count("*").alias("n")).select("j", "s", "n", grid)
    civ, ur, n = F.col("j") <= F.col("justification_max"), F.col("s") < F.col("jaccard_min"), F.col("n")
    share = lambda x: r6(F.sum(F.when(x, n).otherwise(0)) / F.sum(n))
    return c.groupBy("justification_max", "jaccard_min").agg(F.sum(n).alias("n"), share(civ).alias("civ_rate"), share(ur).alias("ur_rate"), share(civ | ur).alias("either_rate"))


def na_kappa(a: str, b: str, times=None):
    """Linear kappa of two code columns with NA as a category of its own, as an aggregate; ``times`` is how often a row counts."""
    codes = ["NA", "하", "중", "상"]
    w = lambda x, y: 0.0 if x == y else 1.0 if "NA" in (x, y) else abs(codes.index(x) - codes.index(y)) / 2
    k = F.lit(1) if times is None else times
    n = F.sum(k)
    held = lambda c: F.sum(F.when(c, k).otherwise(0).cast("double"))
    share = lambda c, v: held(F.col(c) == v) / n
    num = sum((held((F.col(a) == x) & (F.col(b) == y)) / n * w(x, y) for x in codes for y in codes if x != y), F.lit(0.0))
    den = sum((share(a, x) * share(b, y) * w(x, y) for x in codes for y in codes if x != y), F.lit(0.0))
    return F.when(den != 0, 1 - num / den)


_CODES = ["NA", "하", "중", "상"]


def _na_kappa_sql(a: str, b: str) -> str:
    w = lambda x, y: 1.0 if "NA" in (x, y) else abs(_CODES.index(x) - _CODES.index(y)) / 2
    pairs = [(x, y) for x in _CODES for y in _CODES if x != y]
    num = " + ".join(f"sum(({a} = '{x}' AND {b} = '{y}')::INT) / count(*)::DOUBLE * {w(x, y)}" for x, y in pairs)
    den = " + ".join(f"avg(({a} = '{x}')::INT) * avg(({b} = '{y}')::INT) * {w(x, y)}" for x, y in pairs)
    return f"CASE WHEN {den} <> 0 THEN 1 - ({num}) / ({den}) END"


def code_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kappa of the model's and the raters' codes by trait, with NA rates."""
    m = evidence(spark, sf_dir)
    return m.groupBy("trait").agg(F.count("*").alias("n"), r6(na_kappa("llm_code", "human_code")).alias("kappa_llm_human"), r6(F.avg((F.col("llm_code") == "NA").cast("double"))).alias("na_rate_llm"), r6(F.avg((F.col("human_code") == "NA").cast("double"))).alias("na_rate_human"))


def triangulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By rubric area: weighted and unweighted agreements, and which is closer to the raters."""
    area = F.create_map(*[F.lit(x) for kv in TRAIT_AREA.items() for x in kv])
    fam = F.array(*map(F.lit, AREA_FAMILIES["expression"][0]))
    m, n, x, y = coded_counts(spark, sf_dir, True), F.col("n"), F.col("r1"), F.col("r2")
    named = F.col("first") & (F.size("llm_families") > 0)
    both = x.isNotNull() & y.isNotNull()
    total = lambda c, v: F.sum(F.when(c, n * v))
    # of whole numbers, so that raters without any variation have exactly none
    k, sx, sy, squares = (total(both, v).cast("decimal(18,0)") for v in (F.lit(1), x, y, x * x + y * y))
    d = (k * squares - sx * sx - sy * sy + (sx - sy) * (sx - sy)).cast("double")
    t = m.groupBy("trait").agg(
        F.bool_or("first").alias("_first"),
        na_kappa("llm_code", "human_code", F.when(F.col("first"), n).otherwise(0)).alias("b"),
        (total(named, jaccard(F.col("llm_families"), fam)) / total(named, 1)).alias("a"),
        k.alias("_k"),
        F.when(d != 0, 1 - k.cast("double") * total(both, (x - y) ** 2) / d).alias("_q"),
    ).where("_first")
    t = t.withColumn("w", F.when(F.col("_k").isNotNull(), reliability_weight(F.col("_q"))).otherwise(1.0)).withColumn("rubric_domain", area[F.col("trait")])
    wmean = lambda c: F.sum(F.when(F.col(c).isNotNull(), F.col("w") * F.col(c))) / F.sum(F.when(F.col(c).isNotNull(), F.col("w")))
    g = t.groupBy("rubric_domain").agg(F.count("*").alias("n_traits"), F.avg("a").alias("a"), F.avg("b").alias("b"), wmean("a").alias("wa"), wmean("b").alias("wb"))
    a, b, wa, wb = (F.col(c) for c in ("a", "b", "wa", "wb"))
    return g.select("rubric_domain", "n_traits", r6(a).alias("shap_human_agreement"), r6(b).alias("llm_human_agreement"), closer(a, b).alias("closer_unweighted"), r6(wa).alias("shap_human_weighted"), r6(wb).alias("llm_human_weighted"), closer(wa, wb).alias("closer_weighted"))


def robustness_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All trait-level tables side by side, full outer, empty where a table lacks the trait."""
    frames = [oof_summary(spark, sf_dir).where(F.col("cv_scheme") == s).select("trait", F.col("qwk_mean").alias(f"qwk_{s}"), F.col("mae_mean").alias(f"mae_{s}")) for s in SCHEMES]
    frames.append(paired(spark, sf_dir).groupBy("trait").agg(r6(stats.qwk(F.col("r1"), F.col("r2"))).alias("qwk_raters")))
    frames.append(trait_stability(spark, sf_dir).select("trait", "stability_jaccard"))
    out = reduce(lambda a, b: a.join(b, "trait", "full"), frames)
    order = F.create_map(*[F.lit(x) for i, t in enumerate(TRAITS) for x in (t, i)])
    return out.withColumn("trait_order", F.coalesce(order[F.col("trait")], F.lit(len(TRAITS))))


def sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rater's run against the second's by trait: agreement, shift, and F1 on missing scores.

    ROBUST are traits that meet all criteria that can be computed, of which three are needed; partly
    so are those that meet three fifths.  (Two further criteria on rationales have no data, so a fixed
    five of five could never be met.)
    """
    r = ratings(spark, sf_dir).where("rating_round = 1").select("trait", "r1", "r2")
    x, y = F.col("r1"), F.col("r2")
    both = x.isNotNull() & y.isNotNull()
    on = lambda c: F.when(both, c)
    a, b = on(x), on(y)
    d = F.var_pop(a) + F.var_pop(b) + (F.avg(a) - F.avg(b)) ** 2
    tp, fp, fn = (F.sum(c.cast("double")) for c in (x.isNull() & y.isNull(), x.isNull() & y.isNotNull(), x.isNotNull() & y.isNull()))
    prec, rec = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0), F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(0.0)
    g = r.groupBy("trait").agg(
        F.sum(both.cast("bigint")).alias("n"), F.when(d != 0, 1 - F.avg((a - b) ** 2) / d).alias("q"), F.avg((a == b).cast("double")).alias("e"), F.avg((F.abs(a - b) <= 1).cast("double")).alias("adj"), F.avg(b - a).alias("shift"),
        prec.alias("p"), rec.alias("r"), f1.alias("f"), F.avg(x.isNull().cast("double")).alias("nm"), F.avg(y.isNull().cast("double")).alias("ns"),
    ).where("n >= 10")
    passed = sum((F.coalesce(c, F.lit(False)).cast("int") for c in (F.col("q") >= 0.70, F.col("e") >= 0.55, F.col("f") >= 0.50)), F.lit(0))
    known = sum((c.isNotNull().cast("int") for c in (F.col("q"), F.col("e"), F.col("f"))), F.lit(0))
    status = F.when((known >= 3) & (passed == known), "ROBUST").when(passed * 5 >= known * 3, "PARTIALLY_ROBUST").otherwise("NOT_ROBUST")
    return g.select("trait", "n", r6(F.col("q")).alias("qwk"), r6(F.col("e")).alias("exact_agreement_rate"), r6(F.col("adj")).alias("adjacent_agreement_rate"), r6(F.col("shift")).alias("mean_severity_shift"), r6(F.col("p")).alias("na_precision"), r6(F.col("r")).alias("na_recall"), r6(F.col("f")).alias("na_f1"), r6(F.col("nm")).alias("na_rate_main"), r6(F.col("ns")).alias("na_rate_sensitivity"), status.alias("robust_status"))


def code_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean level of the raters' codes by trait; NA counts for none."""
    m = evidence(spark, sf_dir).withColumn("l", level(F.col("human_code")))
    return m.groupBy("trait").agg(F.count("l").alias("n_determinate"), r6(F.avg("l")).alias("mean_level"))


QUERIES = {
    "oof_metrics": oof_metrics,
    "oof_summary": oof_summary,
    "score_qwk": score_qwk,
    "headline_variant": headline,
    "threshold_flags": threshold_flags,
    "trait_stability": trait_stability,
    "evidence_matrix": evidence_matrix,
    "decision_labels": labels,
    "decision_labels_compat": labels_compat,
    "label_distribution": label_distribution,
    "label_independence": label_independence,
    "label_tests": label_tests,
    "threshold_grid": threshold_grid,
    "code_agreement": code_agreement,
    "triangulation": triangulation,
    "robustness_table": robustness_table,
    "sensitivity_agreement": sensitivity,
    "code_levels": code_levels,
}

_SUMMARY = f"{METRICS}, osm AS (SELECT cv_scheme, trait, count(*) AS n_folds, {', '.join(f'round(avg({k}), 5) AS {k}_mean, round(coalesce(stddev_samp({k}), 0), 5) AS {k}_std' for k in ('qwk', 'mae', 'rmse', 'pearson_r'))} FROM met GROUP BY ALL)"
_Q = "CASE WHEN var_pop(r1) + var_pop(r2) + (avg(r1) - avg(r2)) ** 2 <> 0 THEN 1 - avg((r1 - r2) ** 2) / (var_pop(r1) + var_pop(r2) + (avg(r1) - avg(r2)) ** 2) END"
_CLOSER = "CASE WHEN {0} IS NULL AND {1} IS NULL THEN 'tied' WHEN {0} IS NULL THEN 'LLM' WHEN {1} IS NULL THEN 'SHAP' WHEN abs({0} - {1}) < 0.05 THEN 'tied' WHEN {0} > {1} THEN 'SHAP' ELSE 'LLM' END"
_AREA = "CASE trait " + " ".join(f"WHEN '{t}' THEN '{a}'" for t, a in TRAIT_AREA.items()) + " END"
_EXPR = "[" + ", ".join(repr(f) for f in AREA_FAMILIES["expression"][0]) + "]"
SQL = {
    "oof_metrics": f"WITH {METRICS} SELECT * FROM met",
    "oof_summary": f"WITH {_SUMMARY} SELECT * FROM osm",
    "score_qwk": f"WITH {SCORE_QWK} SELECT purpose, trait, n, round(q, 6) AS qwk, round(ma, 6) AS human_mean, round(mb, 6) AS predicted_mean FROM sqw",
    "headline_variant": f"WITH {SCORE_QWK}, g AS (SELECT purpose, count(*) AS n_traits, sum(coalesce((round(q, 6) >= 0.5)::INT, 0))::BIGINT AS n_passing FROM sqw GROUP BY purpose) SELECT *, CASE WHEN n_passing >= 3 THEN 'V1' WHEN n_passing = 2 THEN 'V2' ELSE 'V3' END AS variant FROM g",
    "threshold_flags": f"WITH {_SUMMARY} SELECT cv_scheme, trait, qwk_mean, {', '.join(f'coalesce(qwk_mean < {t / 100}, false) AS flag_qwk_lt_{t}' for t in (10, 15, 20))} FROM osm",
    "trait_stability": f"WITH {STABILITY} SELECT * FROM stability",
    "evidence_matrix": f"WITH {EVIDENCE} SELECT essay_id, trait, purpose, r1 AS human_r1, r2 AS human_r2, human_mean, human_disagreement, llm_score, llm_is_na, llm_code, human_code, feedback_impure_50, round(justification_rate, 6) AS justification_rate, tau_mean_min, tau_unstable_any, stability_jaccard, jaccard_unstable, family_rubric_match FROM coded",
    "decision_labels": f"WITH {_labels_sql(False)} SELECT essay_id, trait, label, priority_rank, triggered_rules FROM labelled",
    "decision_labels_compat": f"WITH {_labels_sql(True)} SELECT essay_id, trait, label, priority_rank, triggered_rules FROM labelled",
    "label_distribution": f"WITH {_labels_sql(False)} SELECT trait, {', '.join(f'''sum((label = '{n}')::INT)::BIGINT AS {n}''' for n in ('Aligned', 'CIV', 'Indeterminate', 'UR'))}, count(*) AS total FROM labelled GROUP BY trait",
    "label_independence": f"""WITH {_labels_sql(False)}, l AS (SELECT trait, purpose, label FROM labelled WHERE purpose IS NOT NULL), c AS (SELECT trait, purpose, label, count(*) AS o FROM l GROUP BY ALL), r AS (SELECT trait, purpose, count(*) AS r FROM l GROUP BY ALL), k AS (SELECT trait, label, count(*) AS c FROM l GROUP BY ALL), n AS (SELECT trait, count(*) AS n FROM l GROUP BY ALL),
e AS (SELECT trait, purpose, label, n, coalesce(o, 0) AS o, r * c / n::DOUBLE AS e FROM r JOIN k USING (trait) JOIN n USING (trait) LEFT JOIN c USING (trait, purpose, label)),
x AS (SELECT trait, sum((o - e) ** 2 / e) AS s, sum((abs(o - e) - least(0.5, abs(o - e))) ** 2 / e) AS y, (count(DISTINCT purpose) - 1) * (count(DISTINCT label) - 1) AS dof, any_value(n) AS n FROM e GROUP BY trait)
SELECT trait, CASE WHEN dof > 0 THEN round(CASE WHEN dof = 1 THEN y ELSE s END, 4) END AS statistic, dof, n FROM x""",
    "threshold_grid": f"WITH {EVIDENCE}, g AS (SELECT * FROM (SELECT unnest([0.05, 0.1, 0.2, 0.3])::DOUBLE AS justification_max), (SELECT unnest([0.3, 0.5, 0.7])::DOUBLE AS jaccard_min)), mm AS (SELECT coalesce(justification_rate, 1) AS j, coalesce(stability_jaccard, 0) AS s FROM coded) SELECT justification_max, jaccard_min, count(*) AS n, round(avg((j <= justification_max)::INT), 6) AS civ_rate, round(avg((s < jaccard_min)::INT), 6) AS ur_rate, round(avg((j <= justification_max OR s < jaccard_min)::INT), 6) AS either_rate FROM mm, g GROUP BY ALL",
    "code_agreement": f"WITH {EVIDENCE} SELECT trait, count(*) AS n, round({_na_kappa_sql('llm_code', 'human_code')}, 6) AS kappa_llm_human, round(avg((llm_code = 'NA')::INT), 6) AS na_rate_llm, round(avg((human_code = 'NA')::INT), 6) AS na_rate_human FROM coded GROUP BY trait",
    "triangulation": f"""WITH {EVIDENCE}, ll AS (SELECT trait, {_na_kappa_sql('llm_code', 'human_code')} AS b FROM coded GROUP BY trait), sh AS (SELECT trait, avg(len(list_intersect(llm_families, {_EXPR})) / len(list_distinct(list_concat(llm_families, {_EXPR})))::DOUBLE) AS a FROM coded WHERE len(llm_families) > 0 GROUP BY trait),
q AS (SELECT trait, least(greatest(coalesce({_Q}, 0) / 0.7, 0.2), 1) AS w FROM ratings WHERE r1 IS NOT NULL AND r2 IS NOT NULL GROUP BY trait), t AS (SELECT trait, a, b, coalesce(w, 1) AS w, {_AREA} AS rubric_domain FROM ll LEFT JOIN sh USING (trait) LEFT JOIN q USING (trait)),
g AS (SELECT rubric_domain, count(*) AS n_traits, avg(a) AS a, avg(b) AS b, sum(w * a) / sum(CASE WHEN a IS NOT NULL THEN w END) AS wa, sum(w * b) / sum(CASE WHEN b IS NOT NULL THEN w END) AS wb FROM t GROUP BY rubric_domain)
SELECT rubric_domain, n_traits, round(a, 6) AS shap_human_agreement, round(b, 6) AS llm_human_agreement, {_CLOSER.format('a', 'b')} AS closer_unweighted, round(wa, 6) AS shap_human_weighted, round(wb, 6) AS llm_human_weighted, {_CLOSER.format('wa', 'wb')} AS closer_weighted FROM g""",
    "robustness_table": f"""WITH {PURITY}, {STABILITY}, osm AS (SELECT cv_scheme, trait, round(avg(qwk), 5) AS q, round(avg(mae), 5) AS m FROM met GROUP BY ALL), a AS (SELECT trait, q AS qwk_grade_stratified, m AS mae_grade_stratified FROM osm WHERE cv_scheme = 'grade_stratified'), b AS (SELECT trait, q AS qwk_leave_one_prompt_out, m AS mae_leave_one_prompt_out FROM osm WHERE cv_scheme = 'leave_one_prompt_out'),
c AS (SELECT trait, round({_Q}, 6) AS qwk_raters FROM ratings WHERE r1 IS NOT NULL AND r2 IS NOT NULL GROUP BY trait), d AS (SELECT trait, stability_jaccard FROM stability)
SELECT *, CASE trait {' '.join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(TRAITS))} ELSE {len(TRAITS)} END AS trait_order FROM a FULL JOIN b USING (trait) FULL JOIN c USING (trait) FULL JOIN d USING (trait)""",
    "sensitivity_agreement": f"""WITH {PURITY}, b AS (SELECT trait, r1, r2, CASE WHEN r2 IS NOT NULL THEN r1 END AS x, CASE WHEN r1 IS NOT NULL THEN r2 END AS y FROM ratings WHERE rating_round = 1),
g AS (SELECT trait, count(x) AS n, CASE WHEN var_pop(x) + var_pop(y) + (avg(x) - avg(y)) ** 2 <> 0 THEN 1 - avg((x - y) ** 2) / (var_pop(x) + var_pop(y) + (avg(x) - avg(y)) ** 2) END AS q, avg((x = y)::INT) AS e, avg((abs(x - y) <= 1)::INT) AS adj, avg(y - x) AS shift,
 sum((r1 IS NULL AND r2 IS NULL)::INT)::DOUBLE AS tp, sum((r1 IS NULL AND r2 IS NOT NULL)::INT)::DOUBLE AS fp, sum((r1 IS NOT NULL AND r2 IS NULL)::INT)::DOUBLE AS fn, avg((r1 IS NULL)::INT) AS nm, avg((r2 IS NULL)::INT) AS ns FROM b GROUP BY trait HAVING count(x) >= 10),
h AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM g), i AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f FROM h), s AS (SELECT *, coalesce(q >= 0.7, false)::INT + (e >= 0.55)::INT + (f >= 0.5)::INT AS ok, 2 + (q IS NOT NULL)::INT AS known FROM i)
SELECT trait, n, round(q, 6) AS qwk, round(e, 6) AS exact_agreement_rate, round(adj, 6) AS adjacent_agreement_rate, round(shift, 6) AS mean_severity_shift, round(p, 6) AS na_precision, round(r, 6) AS na_recall, round(f, 6) AS na_f1, round(nm, 6) AS na_rate_main, round(ns, 6) AS na_rate_sensitivity,
 CASE WHEN known = 3 AND ok = 3 THEN 'ROBUST' WHEN ok * 5 >= known * 3 THEN 'PARTIALLY_ROBUST' ELSE 'NOT_ROBUST' END AS robust_status FROM s""",
    "code_levels": f"WITH {EVIDENCE}, l AS (SELECT trait, CASE human_code WHEN '하' THEN 0 WHEN '중' THEN 1 WHEN '상' THEN 2 END AS l FROM coded) SELECT trait, count(l) AS n_determinate, round(avg(l), 6) AS mean_level FROM l GROUP BY trait",
}
