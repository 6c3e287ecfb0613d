"""Rater agreement, score tables and feedback purity over the rating tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import stats
from tessera.functions.nulls import ratio
from tessera.functions.text import plain_id
from tessera.functions.vocab import AREA_KEYWORDS, TRAIT_AREA, TRAITS
from tessera.session import table

R = 6  # digits to which reports round


def r6(c: Column) -> Column:
    return F.round(c, R)


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last delivery of each key by ``order``; rows without a key are left out.

    As a maximum with partial sums, not a window: a redelivered key never gathers its rows.
    """
    rest = [c for c in df.columns if c not in keys]
    kept = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    # one struct, in which what decides stands first: a value and its order apart would hold the texts twice
    own = [c for c in order if c in rest]
    r = F.max_by(F.struct(*rest), F.struct(*order)) if own != order or any("map<" in t or t == "variant" for _, t in df.dtypes) else F.max(F.struct(*order, *(c for c in rest if c not in order)))
    return df.where(kept).groupBy(*keys).agg(r.alias("_r")).select(*keys, *(F.col(f"_r.{c}") for c in rest))


ORDER = ["received_at", "scored_at", "score_rater1", "score_rater2", "rater1_id", "rater2_id", "feedback", "rubric_key", "source"]


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each (essay, trait, round) once, as delivered last; scores off the scale are NULL (r1, r2)."""
    cols = ["essay_id", "trait", "rating_round", "purpose", "grade", "prompt_id", *ORDER]
    t = latest(table(spark, sf_dir, "trait_scores").select(*cols), ["essay_id", "trait", "rating_round"], ORDER)
    valid = lambda c: F.when(F.col(c).between(1, 5), F.col(c))
    return t.withColumn("r1", valid("score_rater1")).withColumn("r2", valid("score_rater2"))


RATINGS = """ratings AS (SELECT *, CASE WHEN score_rater1 BETWEEN 1 AND 5 THEN score_rater1 END AS r1, CASE WHEN score_rater2 BETWEEN 1 AND 5 THEN score_rater2 END AS r2 FROM (
 SELECT *, row_number() OVER (PARTITION BY essay_id, trait, rating_round ORDER BY received_at DESC NULLS LAST, scored_at DESC NULLS LAST, score_rater1 DESC NULLS LAST, score_rater2 DESC NULLS LAST, rater1_id DESC NULLS LAST, rater2_id DESC NULLS LAST, feedback DESC NULLS LAST, rubric_key DESC NULLS LAST, source DESC NULLS LAST) AS k
 FROM trait_scores WHERE essay_id IS NOT NULL AND trait IS NOT NULL AND rating_round IS NOT NULL) WHERE k = 1)"""
PAIRED = f"""{RATINGS}, paired AS (SELECT * FROM ratings WHERE r1 IS NOT NULL AND r2 IS NOT NULL)"""


def paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ratings(spark, sf_dir).where("r1 IS NOT NULL AND r2 IS NOT NULL")


def rater_agreement(spark: SparkSession, sf_dir: str, least: int = 10) -> DataFrame:
    """By purpose and trait with at least ten pairs: kappa, ICC, rho, exact and adjacent agreement, shift."""
    p = paired(spark, sf_dir).where("purpose IS NOT NULL")
    x, y = F.col("r1"), F.col("r2")
    g = p.groupBy("purpose", "trait").agg(
        F.count("*").alias("n_paired"),
        r6(stats.qwk(x, y)).alias("qwk"),
        r6(stats.icc21(x, y)).alias("icc_2_1"),
        r6(F.avg((x == y).cast("double"))).alias("exact_agreement_rate"),
        r6(F.avg((F.abs(x - y) <= 1).cast("double"))).alias("adjacent_agreement_rate"),
        r6(F.avg(F.abs(x - y))).alias("mean_abs_diff"),
        r6(F.avg(x)).alias("r1_mean"),
        r6(F.avg(y)).alias("r2_mean"),
        r6(F.avg(y - x)).alias("severity_shift_r2_minus_r1"),
    )
    rho = stats.spearman(p, "r1", "r2", ["purpose", "trait"]).withColumn("spearman_r", r6(F.col("spearman_r")))
    flag = lambda c: F.coalesce(F.col(c) < 0.70, F.lit(False))
    return g.where(F.col("n_paired") >= least).join(rho, ["purpose", "trait"]).withColumn("qwk_below_0_70", flag("qwk")).withColumn("icc_below_0_70", flag("icc_2_1"))


RANKED = """rx AS (SELECT purpose, trait, r1, r2, rank() OVER (PARTITION BY purpose, trait ORDER BY r1) + (count(*) OVER (PARTITION BY purpose, trait, r1) - 1) / 2.0 AS a, rank() OVER (PARTITION BY purpose, trait ORDER BY r2) + (count(*) OVER (PARTITION BY purpose, trait, r2) - 1) / 2.0 AS b FROM paired WHERE purpose IS NOT NULL)"""
QWK_SQL = "CASE WHEN var_pop(r1) + var_pop(r2) + (avg(r1) - avg(r2)) ** 2 <> 0 THEN 1 - avg((r1 - r2) ** 2) / (var_pop(r1) + var_pop(r2) + (avg(r1) - avg(r2)) ** 2) END"


def inter_rater_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By trait: kappa weighted by the index among the labels that occur, rounded to 4, and agreement in per cent."""
    p = paired(spark, sf_dir).select("trait", "r1", "r2", F.col("r1").alias("a"), F.col("r2").alias("b"))
    i = stats.index_pairs(p, "a", "b", ["trait"])
    x, y = F.col("r1"), F.col("r2")
    return i.groupBy("trait").agg(
        F.count("*").alias("n"),
        F.round(stats.qwk(F.col("a"), F.col("b")), 4).alias("qwk"),
        F.round(100 * F.avg((x == y).cast("double")), 2).alias("exact_pct"),
        F.round(100 * F.avg((F.abs(x - y) <= 1).cast("double")), 2).alias("adjacent_pct"),
        F.round(F.avg((x + y) / 2), 4).alias("mean_score"),
    )


def weighted_kappas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By trait: linear and unweighted kappa."""
    x, y = F.col("r1"), F.col("r2")
    return paired(spark, sf_dir).groupBy("trait").agg(r6(stats.linear_kappa(x, y)).alias("kappa_linear"), r6(stats.cohen_kappa(x, y, [1, 2, 3, 4, 5])).alias("kappa"))


def alpha_by_trait(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Krippendorff's alpha over all rounds of both raters, by trait."""
    t = ratings(spark, sf_dir).select("essay_id", "trait", F.explode(F.array("r1", "r2")).alias("score"))
    return stats.alpha_interval(t, "score", ["essay_id"], ["trait"]).withColumn("alpha", r6(F.col("alpha")))


def score_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both raters' scores by trait, in columns, with a total."""
    t = ratings(spark, sf_dir).select("trait", F.explode(F.array("r1", "r2")).alias("score")).where("score IS NOT NULL")
    n = [F.sum((F.col("score") == k).cast("bigint")).alias(f"score_{k}") for k in range(1, 6)]
    return t.groupBy("trait").agg(*n, F.count("*").alias("total"))


def length_by_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Essay lengths by the grade of the essay's prompt; each essay once, ids in whatever form they are written."""
    e = table(spark, sf_dir, "essays").select("essay_id", "prompt_id", "len_syllable", "received_at").where("essay_id IS NOT NULL")
    e = e.groupBy("essay_id").agg(F.max_by(F.struct("prompt_id", "len_syllable"), F.struct("received_at", "prompt_id", "len_syllable")).alias("r")).select("r.*")
    p = table(spark, sf_dir, "prompts").where("grade IS NOT NULL").groupBy(plain_id(F.col("prompt_id")).alias("_p")).agg(F.min_by("grade", "prompt_id").alias("grade")).where("_p IS NOT NULL")
    n = F.col("len_syllable")
    g = e.withColumn("_p", plain_id(F.col("prompt_id"))).join(p, "_p").groupBy("grade")
    return g.agg(F.count(n).alias("n"), F.round(F.avg(n), 1).alias("mean"), F.round(F.percentile(n, F.lit(0.5)), 1).alias("median"), F.min(n).alias("min"), F.max(n).alias("max"))


def rubric_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct rubric keys by trait."""
    return ratings(spark, sf_dir).groupBy("trait").agg(F.count_distinct("rubric_key").alias("n_keys"), F.count("*").alias("n_rows"))


def corpus_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rated essays by grade, purpose, prompt and source."""
    t = ratings(spark, sf_dir).groupBy("essay_id").agg(F.max(F.struct("grade", "purpose", "prompt_id", "source")).alias("r")).select("r.*")
    return t.groupBy("grade", "purpose", "prompt_id", "source").agg(F.count("*").alias("n_essays"))


def rubric_by_purpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By purpose and trait the number of distinct rubric keys and the first five."""
    keys = ratings(spark, sf_dir).where("purpose IS NOT NULL AND rubric_key IS NOT NULL").select("purpose", "trait", "rubric_key").distinct()
    keys = keys.withColumn("k", F.row_number().over(W.partitionBy("purpose", "trait").orderBy("rubric_key")))
    return keys.groupBy("purpose", "trait").agg(F.count("*").alias("n_keys"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("k") <= 5, F.col("rubric_key")))), "|").alias("samples"))


def trait_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct essays by purpose, traits in columns."""
    t = ratings(spark, sf_dir).where("purpose IS NOT NULL").select("purpose", "essay_id", "trait").distinct()
    return t.groupBy("purpose").agg(*[F.sum((F.col("trait") == k).cast("bigint")).alias(k) for k in TRAITS])


def rubric_key_parts(c: Column) -> Column:
    """purpose_code, segment2, area, detail of a rubric key as a struct; NULL where it is malformed."""
    pattern = r"^([A-Z])-([^-]+)-(1[A-Z])-(2[A-Z])$"
    t = F.trim(c)
    part = lambda i: F.regexp_extract(t, pattern, i)
    return F.when(t.rlike(pattern), F.struct(part(1).alias("purpose_code"), part(2).alias("segment2"), part(3).alias("area"), part(4).alias("detail")))


def rubric_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by parts of the rubric key; malformed keys together as NULL."""
    t = ratings(spark, sf_dir).select(rubric_key_parts(F.col("rubric_key")).alias("k")).select("k.*")
    area = F.when(F.col("area") == "1A", "task").when(F.col("area") == "1B", "content").when(F.col("area") == "1C", "organization").when(F.col("area") == "1D", "expression").when(F.col("area").isNotNull(), "unknown")
    return t.withColumn("area_name", area).groupBy("purpose_code", "segment2", "area", "detail", "area_name").agg(F.count("*").alias("n"))


def rubric_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of (trait, rubric key) that essays were rated by, commonest first."""
    t = ratings(spark, sf_dir).where("rating_round = 1 AND purpose IS NOT NULL").select("essay_id", "purpose", F.concat_ws("=", "trait", F.coalesce("rubric_key", F.lit("-"))).alias("k"))
    e = t.groupBy("essay_id", "purpose").agg(F.array_join(F.array_sort(F.collect_list("k")), "|").alias("fingerprint"))  # at most one by trait
    g = e.groupBy("purpose", "fingerprint").agg(F.count("*").alias("n_essays"), F.min("essay_id").alias("first_essay"))
    return g.withColumn("preview", F.when(F.char_length("fingerprint") > 80, F.concat(F.substring("fingerprint", 1, 80), F.lit("…"))).otherwise(F.col("fingerprint"))).drop("fingerprint")


def mentions(text: Column, keywords: tuple[str, ...]) -> Column:
    """Occurrences of all keywords as substrings; each keyword's don't overlap."""
    n = F.char_length(text)
    return sum(((n - F.char_length(F.replace(text, F.lit(k)))) / len(k) for k in keywords), F.lit(0.0)).cast("bigint")


def purity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By round-1 feedback that names any rubric area: mentions on and off its trait's area."""
    t = ratings(spark, sf_dir).where(F.col("rating_round") == 1).where(F.trim("feedback") != "").where(F.col("trait").isin(list(TRAITS)))
    area = F.create_map(*[F.lit(x) for kv in TRAIT_AREA.items() for x in kv])
    t = t.withColumn("on_area", area[F.col("trait")]).withColumns({f"_{a}": mentions(F.col("feedback"), k) for a, k in AREA_KEYWORDS.items()})
    total = sum((F.col(f"_{a}") for a in AREA_KEYWORDS), F.lit(0))
    on = sum((F.when(F.col("on_area") == a, F.col(f"_{a}")).otherwise(0) for a in AREA_KEYWORDS), F.lit(0))
    t = t.withColumn("total_mentions", total.cast("bigint")).withColumn("on_area_mentions", on.cast("bigint")).where("total_mentions > 0")
    t = t.withColumn("off_area_mentions", F.col("total_mentions") - F.col("on_area_mentions")).withColumn("_ratio", ratio(F.col("off_area_mentions"), F.col("total_mentions")))
    return t.select("essay_id", "purpose", "grade", "prompt_id", "trait", "on_area", "total_mentions", "on_area_mentions", "off_area_mentions", r6(F.col("_ratio")).alias("off_area_ratio"), (F.col("_ratio") >= 0.5).alias("impure_50pct"))


def _mentions_sql(area: str) -> str:
    return "(" + " + ".join(f"(length(feedback) - length(replace(feedback, '{k}', ''))) // {len(k)}" for k in AREA_KEYWORDS[area]) + ")"


PURITY = f"""{RATINGS}, m AS (SELECT essay_id, purpose, grade, prompt_id, trait, CASE trait {' '.join(f"WHEN '{t}' THEN '{a}'" for t, a in TRAIT_AREA.items())} END AS on_area, {', '.join(f'{_mentions_sql(a)} AS m_{a}' for a in AREA_KEYWORDS)}
 FROM ratings WHERE rating_round = 1 AND trim(feedback) <> '' AND trait IN ({', '.join(f"'{t}'" for t in TRAITS)})),
purity AS (SELECT essay_id, purpose, grade, prompt_id, trait, on_area, ({' + '.join(f'm_{a}' for a in AREA_KEYWORDS)})::BIGINT AS total_mentions, (CASE on_area {' '.join(f"WHEN '{a}' THEN m_{a}" for a in AREA_KEYWORDS)} END)::BIGINT AS on_area_mentions FROM m),
pure AS (SELECT *, total_mentions - on_area_mentions AS off_area_mentions, (total_mentions - on_area_mentions) / total_mentions::DOUBLE AS ratio FROM purity WHERE total_mentions > 0)"""


def purity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By purpose and trait: feedbacks, mean and median off-area ratio, impure share, mean mentions."""
    g = purity(spark, sf_dir).where("purpose IS NOT NULL").groupBy("purpose", "trait")
    x = F.col("off_area_mentions") / F.col("total_mentions")
    return g.agg(
        F.count("*").alias("n_feedbacks"),
        r6(F.avg(x)).alias("mean_off_area_ratio"),
        r6(F.percentile(x, F.lit(0.5))).alias("median_off_area_ratio"),
        r6(100 * F.avg(F.col("impure_50pct").cast("double"))).alias("pct_impure_50"),
        r6(F.avg("total_mentions")).alias("mean_total_mentions"),
    )


def missingness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By purpose, trait and grade: missing scores and feedback of round 1, with shares."""
    t = ratings(spark, sf_dir).where("rating_round = 1 AND purpose IS NOT NULL AND grade IS NOT NULL")
    miss = {"r1": F.col("r1").isNull(), "r2": F.col("r2").isNull(), "feedback": F.coalesce(F.trim("feedback") == "", F.lit(True))}
    aggs = [F.count("*").alias("n")]
    for k, c in miss.items():
        aggs += [F.sum(c.cast("bigint")).alias(f"n_missing_{k}"), F.round(100 * F.avg(c.cast("double")), 4).alias(f"pct_missing_{k}")]
    return t.groupBy("purpose", "trait", "grade").agg(*aggs)


def score_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score means, exact agreement and the half-even level of every rated essay and trait."""
    t = paired(spark, sf_dir).where("rating_round = 1")
    mean = (F.col("r1") + F.col("r2")) / 2
    return t.select("essay_id", "trait", mean.alias("score_mean"), (F.col("r1") == F.col("r2")).alias("exact_agreement"), stats.clip_round(mean).cast("int").alias("score_level"))


QUERIES = {
    "rater_agreement": rater_agreement,
    "inter_rater_by_index": inter_rater_by_index,
    "weighted_kappas": weighted_kappas,
    "alpha_by_trait": alpha_by_trait,
    "score_distribution": score_distribution,
    "length_by_grade": length_by_grade,
    "rubric_coverage": rubric_coverage,
    "corpus_composition": corpus_composition,
    "rubric_by_purpose": rubric_by_purpose,
    "trait_presence": trait_presence,
    "rubric_keys": rubric_keys,
    "rubric_variants": rubric_variants,
    "feedback_purity": purity,
    "purity_summary": purity_summary,
    "missingness": missingness,
    "score_flags": score_flags,
}

_PLAIN = "regexp_replace(upper({0}), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"
SQL = {
    "rater_agreement": f"""WITH {PAIRED}, {RANKED}, rho AS (SELECT purpose, trait, round(corr(a, b), 6) AS spearman_r FROM rx GROUP BY ALL),
g AS (SELECT purpose, trait, count(*) AS n_paired, {QWK_SQL} AS q, 2 * var_samp((r1 + r2) / 2.0) AS mt, var_samp(r1 - r2) / 2 AS me, count(*) * avg(r1 - r2) ** 2 / 2 AS mc,
 round(avg((r1 = r2)::INT), 6) AS exact_agreement_rate, round(avg((abs(r1 - r2) <= 1)::INT), 6) AS adjacent_agreement_rate, round(avg(abs(r1 - r2)), 6) AS mean_abs_diff, round(avg(r1), 6) AS r1_mean, round(avg(r2), 6) AS r2_mean, round(avg(r2 - r1), 6) AS severity_shift_r2_minus_r1
 FROM paired WHERE purpose IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
h AS (SELECT *, round(q, 6) AS qwk, round((mt - me) / (mt + me + 2 * (mc - me) / n_paired), 6) AS icc_2_1 FROM g)
SELECT purpose, trait, n_paired, qwk, icc_2_1, exact_agreement_rate, adjacent_agreement_rate, mean_abs_diff, r1_mean, r2_mean, severity_shift_r2_minus_r1, spearman_r, coalesce(qwk < 0.7, false) AS qwk_below_0_70, coalesce(icc_2_1 < 0.7, false) AS icc_below_0_70 FROM h JOIN rho USING (purpose, trait)""",
    "inter_rater_by_index": f"""WITH {PAIRED}, l AS (SELECT DISTINCT trait, v FROM (SELECT trait, r1 AS v FROM paired UNION ALL SELECT trait, r2 FROM paired)), i AS (SELECT trait, v, row_number() OVER (PARTITION BY trait ORDER BY v) AS k FROM l),
j AS (SELECT p.trait, r1 AS x, r2 AS y, a.k AS r1, b.k AS r2 FROM paired p JOIN i a ON a.trait = p.trait AND a.v = p.r1 JOIN i b ON b.trait = p.trait AND b.v = p.r2)
SELECT trait, count(*) AS n, round({QWK_SQL}, 4) AS qwk, round(100 * avg((x = y)::INT), 2) AS exact_pct, round(100 * avg((abs(x - y) <= 1)::INT), 2) AS adjacent_pct, round(avg((x + y) / 2.0), 4) AS mean_score FROM j GROUP BY trait""",
    "weighted_kappas": f"""WITH {PAIRED}, c AS (SELECT trait, count(*)::DOUBLE AS n, avg(abs(r1 - r2)) AS d, avg((r1 = r2)::INT) AS po, {', '.join(f'sum((r1 <= {k})::INT) / count(*)::DOUBLE AS a{k}, sum((r2 <= {k})::INT) / count(*)::DOUBLE AS b{k}' for k in range(1, 6))} FROM paired GROUP BY trait),
e AS (SELECT trait, d, po, {' + '.join(f'a{k} * (1 - b{k}) + b{k} * (1 - a{k})' for k in range(1, 5))} AS el, a1 * b1 + {' + '.join(f'(a{k} - a{k - 1}) * (b{k} - b{k - 1})' for k in range(2, 6))} AS pe FROM c)
SELECT trait, round(CASE WHEN el <> 0 THEN 1 - d / el END, 6) AS kappa_linear, round(CASE WHEN abs(1 - pe) > 1e-12 THEN (po - pe) / (1 - pe) END, 6) AS kappa FROM e""",
    "alpha_by_trait": f"""WITH {RATINGS}, s AS (SELECT essay_id, trait, r1 AS x FROM ratings UNION ALL SELECT essay_id, trait, r2 FROM ratings), i AS (SELECT trait, essay_id, count(*) AS m, sum(x::DOUBLE) AS s, sum(x::DOUBLE * x) AS q FROM s WHERE x IS NOT NULL GROUP BY ALL),
g AS (SELECT trait, sum(m)::BIGINT AS n, sum(s) AS s, sum(q) AS q, sum(CASE WHEN m > 1 THEN m * q - s * s END) AS d, sum(CASE WHEN m > 1 THEN m * (m - 1) / 2 END) AS k FROM i GROUP BY trait)
SELECT trait, n AS n_ratings, round(1 - (d / k) / ((n * q - s * s) / (n * (n - 1) / 2)), 6) AS alpha FROM g""",
    "score_distribution": f"""WITH {RATINGS}, s AS (SELECT trait, r1 AS x FROM ratings UNION ALL SELECT trait, r2 FROM ratings)
SELECT trait, {', '.join(f'sum((x = {k})::INT)::BIGINT AS score_{k}' for k in range(1, 6))}, count(*) AS total FROM s WHERE x IS NOT NULL GROUP BY trait""",
    "length_by_grade": f"""
WITH e AS (SELECT *, {_PLAIN.format('prompt_id')} AS p, row_number() OVER (PARTITION BY essay_id ORDER BY received_at DESC NULLS LAST, prompt_id DESC NULLS LAST, len_syllable DESC NULLS LAST) AS k FROM essays WHERE essay_id IS NOT NULL),
q AS (SELECT {_PLAIN.format('prompt_id')} AS p, arg_min(grade, prompt_id) AS grade FROM prompts WHERE grade IS NOT NULL GROUP BY 1)
SELECT grade, count(e.len_syllable) AS n, round(avg(e.len_syllable), 1) AS mean, round(quantile_cont(e.len_syllable, 0.5), 1) AS median, min(e.len_syllable) AS min, max(e.len_syllable) AS max FROM e JOIN q USING (p) WHERE k = 1 AND regexp_matches(p, '[1-9]') GROUP BY grade""",
    "rubric_coverage": f"WITH {RATINGS} SELECT trait, count(DISTINCT rubric_key) AS n_keys, count(*) AS n_rows FROM ratings GROUP BY trait",
    "corpus_composition": f"""WITH {RATINGS}, e AS (SELECT grade, purpose, prompt_id, source, row_number() OVER (PARTITION BY essay_id ORDER BY grade DESC NULLS LAST, purpose DESC NULLS LAST, prompt_id DESC NULLS LAST, source DESC NULLS LAST) AS j FROM ratings)
SELECT grade, purpose, prompt_id, source, count(*) AS n_essays FROM e WHERE j = 1 GROUP BY ALL""",
    "rubric_by_purpose": f"""WITH {RATINGS}, d AS (SELECT DISTINCT purpose, trait, rubric_key FROM ratings WHERE purpose IS NOT NULL AND rubric_key IS NOT NULL), n AS (SELECT *, row_number() OVER (PARTITION BY purpose, trait ORDER BY rubric_key) AS j FROM d)
SELECT purpose, trait, count(*) AS n_keys, string_agg(rubric_key, '|' ORDER BY rubric_key) FILTER (WHERE j <= 5) AS samples FROM n GROUP BY purpose, trait""",
    "trait_presence": f"""WITH {RATINGS}, d AS (SELECT DISTINCT purpose, essay_id, trait FROM ratings WHERE purpose IS NOT NULL) SELECT purpose, {', '.join(f"sum((trait = '{t}')::INT)::BIGINT AS {t}" for t in TRAITS)} FROM d GROUP BY purpose""",
    "rubric_keys": f"""WITH {RATINGS}, p AS (SELECT CASE WHEN regexp_matches(trim(rubric_key), '^[A-Z]-[^-]+-1[A-Z]-2[A-Z]$') THEN trim(rubric_key) END AS k FROM ratings),
q AS (SELECT split_part(k, '-', 1) AS purpose_code, split_part(k, '-', 2) AS segment2, split_part(k, '-', 3) AS area, split_part(k, '-', 4) AS detail FROM p)
SELECT purpose_code, segment2, area, detail, CASE WHEN area = '1A' THEN 'task' WHEN area = '1B' THEN 'content' WHEN area = '1C' THEN 'organization' WHEN area = '1D' THEN 'expression' WHEN area IS NOT NULL THEN 'unknown' END AS area_name, count(*) AS n FROM q GROUP BY ALL""",
    "rubric_variants": f"""WITH {RATINGS}, e AS (SELECT essay_id, purpose, string_agg(trait || '=' || coalesce(rubric_key, '-'), '|' ORDER BY trait || '=' || coalesce(rubric_key, '-')) AS f FROM ratings WHERE rating_round = 1 AND purpose IS NOT NULL GROUP BY essay_id, purpose)
SELECT purpose, count(*) AS n_essays, min(essay_id) AS first_essay, CASE WHEN length(f) > 80 THEN f[1:80] || '…' ELSE f END AS preview FROM e GROUP BY purpose, f""",
    "feedback_purity": f"WITH {PURITY} SELECT essay_id, purpose, grade, prompt_id, trait, on_area, total_mentions, on_area_mentions, off_area_mentions, round(ratio, 6) AS off_area_ratio, ratio >= 0.5 AS impure_50pct FROM pure",
    "purity_summary": f"""WITH {PURITY} SELECT purpose, trait, count(*) AS n_feedbacks, round(avg(ratio), 6) AS mean_off_area_ratio, round(quantile_cont(ratio, 0.5), 6) AS median_off_area_ratio, round(100 * avg((ratio >= 0.5)::INT), 6) AS pct_impure_50, round(avg(total_mentions), 6) AS mean_total_mentions FROM pure WHERE purpose IS NOT NULL GROUP BY purpose, trait""",
    "missingness": f"""WITH {RATINGS} SELECT purpose, trait, grade, count(*) AS n, sum((r1 IS NULL)::INT)::BIGINT AS n_missing_r1, round(100 * avg((r1 IS NULL)::INT), 4) AS pct_missing_r1, sum((r2 IS NULL)::INT)::BIGINT AS n_missing_r2, round(100 * avg((r2 IS NULL)::INT), 4) AS pct_missing_r2,
 sum(coalesce(trim(feedback) = '', true)::INT)::BIGINT AS n_missing_feedback, round(100 * avg(coalesce(trim(feedback) = '', true)::INT), 4) AS pct_missing_feedback FROM ratings WHERE rating_round = 1 AND purpose IS NOT NULL AND grade IS NOT NULL GROUP BY purpose, trait, grade""",
    "score_flags": f"WITH {PAIRED} SELECT essay_id, trait, (r1 + r2) / 2.0 AS score_mean, r1 = r2 AS exact_agreement, round_even((r1 + r2) / 2.0, 0)::INT AS score_level FROM paired WHERE rating_round = 1",
}
