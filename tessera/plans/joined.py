"""Evidence and robustness from separate tables, checked joins, prompts, rubrics and response records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import annotations as A
from tessera.functions import stats
from tessera.functions import text as T
from tessera.functions.nulls import one_to_one, ratio, strict_pivot
from tessera.functions.sets import pipe
from tessera.functions.vocab import AREA_FAMILIES, TRAIT_AREA, TRAITS
from tessera.operators.rank import top_k
from tessera.plans.features import owners
from tessera.plans import annotations, attribution, contrast, decisions, essay_records, ratings, sampling
from tessera.plans.ratings import PURITY, RATINGS, r6
from tessera.session import table

#: The attributed traits that stand for each rubric area, and the essay's order.
FLAG = {"expression": "R", "organization": "A", "content": "N", "task": "N"}
FIRST_ESSAY = 1_000_000
VARIANTS = (("primary", 0.05), ("robust_1", 0.04), ("robust_2", 0.06))
PREFLIGHT = (0.10, 0.15, 0.20)

# Corrections of known damage in rubric texts.
PATCHES = (("  ", " "), ("ㆍ", "·"), ("...", "…"))
TEMPLATE = "# {{PURPOSE}} / {{TYPE}}\n{{GRADE}} {{LEVEL}}: {{TOPIC}}\n\n{{PROMPT}}\n\n{{ESSAY_TEXT}}\n"


def flag_of_trait():
    return F.create_map(*[F.lit(x) for t, a in TRAIT_AREA.items() for x in (t, FLAG[a])])[F.col("trait")]


_FLAG = "CASE trait " + " ".join(f"WHEN '{t}' THEN '{FLAG[a]}'" for t, a in TRAIT_AREA.items()) + " END"


def llm_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """essay_id, trait, llm_code: the codes of the predicted scores, as a table of its own."""
    p = decisions.oof(spark, sf_dir).where("cv_scheme = 'grade_stratified'")
    return p.select("essay_id", "trait", decisions.code(stats.clip_round(F.col("y_pred"))).alias("llm_code"))


def human_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """essay_id, trait, human_code: the codes of the raters' means, as a table of its own."""
    r = ratings.ratings(spark, sf_dir).where("rating_round = 1")
    return r.select("essay_id", "trait", decisions.code((F.col("r1") + F.col("r2")) / 2).alias("human_code"))


def evidence_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rated cells of round 1 with eight tables joined to them, each unique on the key it is joined by.

    Of trait level are the leading families, their stability and the raters' flags; of cell level the
    predicted scores, the purity of feedback, both codes and the main metric.
    """
    r = ratings.ratings(spark, sf_dir).where("rating_round = 1").where(F.col("trait").isin(list(TRAITS)))
    base = r.select("essay_id", "trait", "purpose", "grade", "prompt_id", F.col("r1").alias("human_r1"), F.col("r2").alias("human_r2"), ((F.col("r1") + F.col("r2")) / 2).alias("human_mean"), flag_of_trait().alias("_flag"), (F.col("essay_id") - FIRST_ESSAY).alias("_order"))
    scores = decisions.oof(spark, sf_dir).where("cv_scheme = 'grade_stratified'").select("essay_id", "trait", stats.clip_round(F.col("y_pred")).cast("int").alias("llm_score"))
    tops = attribution.shap_top3(spark, sf_dir).where("cv = 'O'").select(F.col("trait").alias("_flag"), F.col("top_families").alias("shap_top3"))
    stability = attribution.shap_stability_any(spark, sf_dir).withColumnRenamed("trait", "_flag")
    pure = ratings.purity(spark, sf_dir).select("essay_id", "trait", F.col("off_area_ratio"), F.col("impure_50pct").alias("feedback_impure_50"))
    flags = ratings.rater_agreement(spark, sf_dir).select("purpose", "trait", F.col("qwk_below_0_70").alias("rater_qwk_flag"), F.col("icc_below_0_70").alias("rater_icc_flag"))
    metric = contrast.alignment(spark, sf_dir).select(F.col("essay_id").alias("_order"), F.col("trait").alias("_flag"), r6(F.col("jaccard")).alias("alignment_jaccard"))
    joins = [(scores, ["essay_id", "trait"]), (tops, ["_flag"]), (stability, ["_flag"]), (pure, ["essay_id", "trait"]), (flags, ["purpose", "trait"]), (llm_codes(spark, sf_dir), ["essay_id", "trait"]), (human_codes(spark, sf_dir), ["essay_id", "trait"]), (metric, ["_order", "_flag"])]
    return reduce(lambda a, b: a.join(b[0], b[1], "left"), joins, base).drop("_flag", "_order")


def code_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both codes of each cell that has both; either table must hold a cell once."""
    return one_to_one(llm_codes(spark, sf_dir), human_codes(spark, sf_dir), ["essay_id", "trait"])


def area_agreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By trait, three agreement tables joined to the list of traits: mean and median overlap of named with
    the area's families, and with all of them, and the kappa of codes."""
    area = F.create_map(*[F.lit(x) for t, a in TRAIT_AREA.items() for x in (t, F.array(*map(F.lit, AREA_FAMILIES[a][0])))])
    own, n = area[F.col("trait")], F.col("n")
    both, any_ = F.size(F.array_intersect("llm_families", own)), F.size(F.array_union("llm_families", own))
    named = F.size("llm_families") > 0
    e = decisions.coded_counts(spark, sf_dir).select("trait", "llm_code", "human_code", "n", F.when(named, both / any_).alias("v"), F.when(named, (both == F.size(own)).cast("int")).alias("all"), F.when(named, n).alias("k"))
    g = e.groupBy("trait").agg(
        F.sum("k").alias("n_named"),
        r6(F.sum(F.col("k") * F.col("v")) / F.sum("k")).alias("overlap_mean"),
        r6(F.percentile("v", F.lit(0.5), F.coalesce("k", F.lit(0)))).alias("overlap_median"),
        r6(F.sum(F.col("k") * F.col("all")) / F.sum("k")).alias("covered_rate"),
        r6(decisions.na_kappa("llm_code", "human_code", n)).alias("kappa"),
    )
    return spark.createDataFrame([(t,) for t in TRAITS], "trait string").join(g, "trait", "left")


def round_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first round against the second, by trait: cells joined one to one, kappa and agreement of the means."""
    r = ratings.ratings(spark, sf_dir).select("essay_id", "trait", "rating_round", ((F.col("r1") + F.col("r2")) / 2).alias("score")).where("score IS NOT NULL")
    runs = [r.where(F.col("rating_round") == k).select("essay_id", "trait", F.col("score").alias(f"score_{n}")) for k, n in ((1, "main"), (2, "sensitivity"))]
    j = one_to_one(*runs, ["essay_id", "trait"])
    x, y = stats.clip_round(F.col("score_main")), stats.clip_round(F.col("score_sensitivity"))
    return j.groupBy("trait").agg(F.count("*").alias("n"), r6(stats.qwk(x, y)).alias("qwk"), r6(F.avg((x == y).cast("double"))).alias("exact"), r6(F.avg(F.col("score_sensitivity") - F.col("score_main"))).alias("shift"))


def round_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean scores of the rounds in columns by essay and trait; a round that a cell holds twice is an error."""
    r = ratings.ratings(spark, sf_dir).where("rating_round IN (1, 2, 3)").select("essay_id", "trait", "rating_round", ((F.col("r1") + F.col("r2")) / 2).alias("score"))
    return strict_pivot(r, ["essay_id", "trait"], "rating_round", [1, 2, 3], "score", "round_")


def robustness_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By attributed trait: stability under either scheme (full outer), the leading families of three variants,
    their overlaps, the mean sign agreement, and the preflight flags of the traits it stands for."""
    s = attribution.shap_stability(spark, sf_dir)
    frames = [s.where(F.col("cv") == cv).select("trait", *(F.col(c).alias(f"{c}_{cv}") for c in ("tau_mean", "tau_min", "unstable"))) for cv in ("F", "O")]
    out = reduce(lambda a, b: a.join(b, "trait", "full"), frames)
    for name, base in VARIANTS:
        g = attribution.global_shap(attribution.attributions(spark, sf_dir, base), ["trait"])
        out = out.join(top_k(g, ["trait"], [F.col("rank"), F.col("family")], "family", out=f"_{name}"), "trait", "left")
    for name, _ in VARIANTS[1:]:
        out = out.withColumn(f"jaccard_{name}", r6(ratio(F.size(F.array_intersect("_primary", f"_{name}")), F.size(F.array_union("_primary", f"_{name}")))))
    sign = attribution.sign_consistency(spark, sf_dir).groupBy("trait").agg(r6(F.avg("match_rate")).alias("sign_match_mean"))
    m = decisions.oof_summary(spark, sf_dir).where("cv_scheme = 'grade_stratified'").select(flag_of_trait().alias("trait"), "qwk_mean").where("trait IS NOT NULL")
    preflight = m.groupBy("trait").agg(*(F.bool_or(F.coalesce(F.col("qwk_mean") < t, F.lit(False))).alias(f"preflight_lt_{int(t * 100)}") for t in PREFLIGHT))
    out = out.join(sign, "trait", "left").join(preflight, "trait", "left")
    return out.withColumns({f"top3_{n}": pipe(F.col(f"_{n}")) for n, _ in VARIANTS}).drop(*(f"_{n}" for n, _ in VARIANTS))


def kept_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ratings of the essays on the keep list: the canonical sample."""
    keep = sampling.base_sample(spark, sf_dir).select("essay_id")
    return ratings.ratings(spark, sf_dir).join(keep, "essay_id", "left_semi").select("essay_id", "trait", "rating_round", "r1", "r2")


def purity_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weight of each feedback: what of its mentions stays on its trait's area."""
    return ratings.purity(spark, sf_dir).select("essay_id", "trait", r6(1 - F.least(F.greatest(ratio(F.col("off_area_mentions"), F.col("total_mentions")), F.lit(0.0)), F.lit(1.0))).alias("weight"))


def essay_samples(spark: SparkSession, sf_dir: str, first: int = 200) -> DataFrame:
    """By kind of sample one essay: the first of each purpose, and of the first ``first`` essays with a text the one of median length."""
    e = table(spark, sf_dir, "essays").where("essay_id IS NOT NULL AND text IS NOT NULL").groupBy("essay_id").agg(F.max_by(F.struct("text", "prompt_id"), F.struct(F.char_length("text"), "text", "prompt_id")).alias("r")).select("essay_id", "r.*")
    p = table(spark, sf_dir, "prompts").where("purpose IS NOT NULL").groupBy(T.plain_id(F.col("prompt_id")).alias("_p")).agg(F.min("purpose").alias("purpose")).where("_p IS NOT NULL")
    own = e.withColumn("_p", T.plain_id(F.col("prompt_id"))).join(p, "_p").groupBy("purpose").agg(F.min("essay_id").alias("essay_id")).select(F.col("purpose").alias("sample"), "essay_id")
    head = e.select("essay_id", F.char_length("text").alias("n")).orderBy("essay_id").limit(first)
    k = F.row_number().over(ratings.W.orderBy("n", "essay_id"))  # at most ``first`` rows
    median = head.withColumn("k", k).withColumn("m", F.count("*").over(ratings.W.partitionBy())).where("k = floor(m / 2) + 1").select(F.lit("median length").alias("sample"), "essay_id")
    return own.unionByName(median).join(e.select("essay_id", F.char_length("text").alias("n_chars"), F.sha2("text", 256).alias("sha256")), "essay_id")


def essays_in_order(spark: SparkSession, sf_dir: str, n: int = 50) -> DataFrame:
    """The first ``n`` essays by id, for a dry run, with their texts' lengths."""
    return table(spark, sf_dir, "essays").where("essay_id IS NOT NULL").groupBy("essay_id").agg(F.max(F.char_length("text")).alias("n_chars")).orderBy("essay_id").limit(n)


def patched(c):
    """A text with the fixed corrections made in turn."""
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), PATCHES, c)


def assembled_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each prompt's template with its build-time markers filled, its digest, and whether only the marker of
    the essay is left."""
    p = table(spark, sf_dir, "prompts").where("prompt_id IS NOT NULL")
    text = T.filled(F.lit(TEMPLATE), {"PURPOSE": F.col("purpose"), "TYPE": F.col("type"), "GRADE": F.col("grade"), "LEVEL": F.col("level"), "TOPIC": F.col("topic"), "PROMPT": patched(F.col("prompt"))})
    rest = F.replace(text, F.lit("{{ESSAY_TEXT}}"), F.lit(""))
    return p.select("prompt_id", F.char_length(text).alias("n_chars"), F.sha2(text, 256).alias("sha256"), (~rest.contains("{{")).alias("ready"))


_FILLED = "replace(replace(replace(replace(replace(replace('" + TEMPLATE + "', '{{PURPOSE}}', coalesce(purpose, '')), '{{TYPE}}', coalesce(type, '')), '{{GRADE}}', coalesce(grade, '')), '{{LEVEL}}', coalesce(level, '')), '{{TOPIC}}', coalesce(topic, '')), '{{PROMPT}}', coalesce(replace(replace(replace(prompt, '  ', ' '), 'ㆍ', '·'), '...', '…'), ''))"


def rubric_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By record, question and trait: the levels that have a description, whether all five do, the rubric key's
    parts, and the question's purpose code: that of the first trait, in the fixed order, whose key can be read."""
    rubrics = essay_records.flat_table("p1_rubrics", spark, sf_dir)
    levels = essay_records.flat_table("p1_evaluations", spark, sf_dir).where("level BETWEEN 1 AND 5").where(F.trim("text") != "")
    held = levels.groupBy("record_id", "question_id", "trait").agg(F.array_join(F.array_sort(F.collect_set(F.col("level").cast("string"))), "|").alias("levels"))  # at most five
    key = ratings.rubric_key_parts(F.col("rubric_key"))
    order = F.coalesce(F.array_position(F.array(*map(F.lit, TRAITS)), F.col("trait")), F.lit(0))
    code = rubrics.where(key.isNotNull()).groupBy("record_id", "question_id").agg(F.min_by(key["purpose_code"], F.struct(order, "trait")).alias("purpose_code"))
    out = rubrics.join(held, ["record_id", "question_id", "trait"], "left").join(code, ["record_id", "question_id"], "left")
    return out.select("record_id", "question_id", "trait", "name", key["area"].alias("area"), key["detail"].alias("detail"), "levels", (F.coalesce("levels", F.lit("")) == "1|2|3|4|5").alias("complete"), "purpose_code")


def rubric_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By record and question the rubric as a Markdown table: traits in the fixed order, the highest level first."""
    e = essay_records.flat_table("p1_evaluations", spark, sf_dir).where("level BETWEEN 1 AND 5").where(F.trim("text") != "")
    row = F.concat(F.lit("| **"), F.col("level").cast("string"), F.lit("** | "), T.collapsed(patched(F.col("text"))), F.lit(" |"))
    rows = e.groupBy("record_id", "question_id", "trait").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("level")).alias("k"), row.alias("t")))), lambda x: x.t), "\n").alias("rows"))
    r = essay_records.flat_table("p1_rubrics", spark, sf_dir).join(rows, ["record_id", "question_id", "trait"])
    order = F.array_position(F.array(*map(F.lit, TRAITS)), F.col("trait"))
    block = F.concat(F.lit("### "), "trait", F.lit(" — "), F.coalesce("name", F.lit("")), F.lit("\n\n| score | description |\n|---|---|\n"), "rows")
    return r.groupBy("record_id", "question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("k"), block.alias("t")))), lambda x: x.t), "\n\n").alias("rubric"))  # as many as traits


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """essay_id and response: the scoring records as a model would send them, some fenced, some cut off."""
    s = annotations.score_records(spark, sf_dir)
    fenced = F.concat(F.lit("```json\n"), F.col("record"), F.lit("\n```"))
    return s.select("essay_id", F.when(F.col("essay_id") % 7 == 0, fenced).when(F.col("essay_id") % 11 == 0, F.expr("left(record, char_length(record) - 5)")).otherwise(F.col("record")).alias("response"))


def processed_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every response parsed, repaired and validated in one plan: essay_id, kind (valid, non_json or validator),
    violation, record of the valid and excerpt of the others."""
    plain = A.unfenced(F.col("response"))
    r = responses(spark, sf_dir).withColumn("repaired", F.when(A.variant(plain).isNull(), A.escape_quotes(plain)).otherwise(plain))
    v = A.variant(F.col("repaired"))
    r = r.withColumn("violation", F.when(v.isNull(), "not JSON").otherwise(A.score_violation(v)))
    kind = F.when(v.isNull(), "non_json").when(F.col("violation").isNotNull(), "validator").otherwise("valid")
    return r.select("essay_id", kind.alias("kind"), "violation", F.when(F.col("violation").isNull(), F.sha2("repaired", 256)).alias("record_sha256"), F.when(F.col("violation").isNotNull(), F.substring("response", 1, 200)).alias("excerpt"))


def response_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The error side of the responses by kind and violation."""
    return processed_responses(spark, sf_dir).where("kind <> 'valid'").groupBy("kind", "violation").agg(F.count("*").alias("n"), F.min("essay_id").alias("first_essay"))


def word_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the prompts that more than one subject claims, with the subjects."""
    w = table(spark, sf_dir, "prompts").select(F.explode(T.tokens(F.concat_ws(" ", "topic", "prompt"))).alias("keyword"), "subject")
    return owners(w, "keyword", "subject")


QUERIES = {
    "evidence_star": evidence_star,
    "code_pairs": code_pairs,
    "area_agreements": area_agreements,
    "round_agreement": round_agreement,
    "round_columns": round_columns,
    "robustness_wide": robustness_wide,
    "kept_scores": kept_scores,
    "purity_weights": purity_weights,
    "essay_samples": essay_samples,
    "essays_in_order": essays_in_order,
    "assembled_prompts": assembled_prompts,
    "rubric_blocks": rubric_blocks,
    "rubric_texts": rubric_texts,
    "processed_responses": processed_responses,
    "response_errors": response_errors,
    "word_owners": word_owners,
}

_CODE, _CR = decisions._CODE, decisions._CR
_LLM = f"SELECT essay_id, trait, {_CODE.format('(' + _CR.format('y_pred') + ')')} AS llm_code FROM oof WHERE cv_scheme = 'grade_stratified'"
_HUMAN = f"SELECT essay_id, trait, {_CODE.format('((r1 + r2) / 2.0)')} AS human_code FROM ratings WHERE rating_round = 1"
_IN_TRAITS = f"trait IN ({', '.join(repr(t) for t in TRAITS)})"
_OWN = "CASE trait " + " ".join(f"WHEN '{t}' THEN [{', '.join(repr(f) for f in AREA_FAMILIES[a][0])}]" for t, a in TRAIT_AREA.items()) + " END"
_TOP = ", ".join(attribution._top_sql(n, b) for n, b in VARIANTS)
_SIGNS = attribution.SQL["sign_consistency"]
_PLAIN = "regexp_replace(upper({0}), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"
_TEXTS = """e AS (SELECT essay_id, r.text AS text, r.prompt_id AS prompt_id FROM (SELECT essay_id, first({'text': text, 'prompt_id': prompt_id} ORDER BY length(text) DESC, text DESC, prompt_id DESC NULLS LAST) AS r FROM essays WHERE essay_id IS NOT NULL AND text IS NOT NULL GROUP BY essay_id))"""
SQL = {
    "evidence_star": f"""
WITH {PURITY}, {decisions.OOF}, base AS (SELECT *, {_FLAG} AS flag FROM ratings WHERE rating_round = 1 AND {_IN_TRAITS})
SELECT b.essay_id, b.trait, b.purpose, b.grade, b.prompt_id, b.r1 AS human_r1, b.r2 AS human_r2, (b.r1 + b.r2) / 2.0 AS human_mean,
 o.llm_score, t.top_families AS shap_top3, s.tau_mean_min, s.tau_unstable_any, round(p.ratio, 6) AS off_area_ratio, p.ratio >= 0.5 AS feedback_impure_50,
 f.qwk_below_0_70 AS rater_qwk_flag, f.icc_below_0_70 AS rater_icc_flag, l.llm_code, h.human_code, m.jaccard AS alignment_jaccard
FROM base b
LEFT JOIN (SELECT essay_id, trait, ({_CR.format('y_pred')})::INT AS llm_score FROM oof WHERE cv_scheme = 'grade_stratified') o ON o.essay_id = b.essay_id AND o.trait = b.trait
LEFT JOIN ({attribution.SQL['shap_top3']}) t ON t.trait = b.flag AND t.cv = 'O'
LEFT JOIN ({attribution.SQL['shap_stability_any']}) s ON s.trait = b.flag
LEFT JOIN pure p ON p.essay_id = b.essay_id AND p.trait = b.trait
LEFT JOIN ({ratings.SQL['rater_agreement']}) f ON f.purpose = b.purpose AND f.trait = b.trait
LEFT JOIN ({_LLM}) l ON l.essay_id = b.essay_id AND l.trait = b.trait
LEFT JOIN ({_HUMAN}) h ON h.essay_id = b.essay_id AND h.trait = b.trait
LEFT JOIN ({contrast.SQL['alignment_metric']}) m ON m.essay_id = b.essay_id - {FIRST_ESSAY} AND m.trait = b.flag""",
    "code_pairs": f"WITH {RATINGS}, {decisions.OOF} SELECT * FROM ({_LLM}) JOIN ({_HUMAN}) USING (essay_id, trait)",
    "area_agreements": f"""
WITH {decisions.EVIDENCE}, x AS (SELECT trait, llm_families AS f, {_OWN} AS own FROM coded WHERE len(llm_families) > 0),
y AS (SELECT trait, own, len(list_intersect(f, own)) AS b, len(list_distinct(list_concat(f, own))) AS u FROM x),
one AS (SELECT trait, count(*) AS n_named, round(avg(b / u::DOUBLE), 6) AS overlap_mean, round(quantile_cont(b / u::DOUBLE, 0.5), 6) AS overlap_median, round(avg((b = len(own))::INT), 6) AS covered_rate FROM y GROUP BY trait),
k AS (SELECT trait, round({decisions._na_kappa_sql('llm_code', 'human_code')}, 6) AS kappa FROM coded GROUP BY trait)
SELECT * FROM (SELECT unnest([{', '.join(repr(t) for t in TRAITS)}]) AS trait) LEFT JOIN one USING (trait) LEFT JOIN k USING (trait)""",
    "round_agreement": f"""
WITH {RATINGS}, s AS (SELECT essay_id, trait, rating_round, (r1 + r2) / 2.0 AS score FROM ratings WHERE r1 IS NOT NULL AND r2 IS NOT NULL),
j AS (SELECT a.trait, a.score AS m, b.score AS s, {_CR.format('a.score')} AS r1, {_CR.format('b.score')} AS r2 FROM s a JOIN s b ON a.essay_id = b.essay_id AND a.trait = b.trait AND a.rating_round = 1 AND b.rating_round = 2)
SELECT trait, count(*) AS n, round({decisions._Q}, 6) AS qwk, round(avg((r1 = r2)::INT), 6) AS exact, round(avg(s - m), 6) AS shift FROM j GROUP BY trait""",
    "round_columns": f"""
WITH {RATINGS} SELECT essay_id, trait, {', '.join(f'max((r1 + r2) / 2.0) FILTER (WHERE rating_round = {k}) AS round_{k}' for k in (1, 2, 3))} FROM ratings WHERE rating_round IN (1, 2, 3) GROUP BY essay_id, trait""",
    "robustness_wide": f"""
WITH {_TOP}, st AS ({attribution.SQL['shap_stability']}), sg AS ({_SIGNS}), sm AS (SELECT trait, round(avg(match_rate), 6) AS sign_match_mean FROM sg GROUP BY trait),
os AS ({decisions.SQL['oof_summary']}),
pf AS (SELECT flag AS trait, {', '.join(f'bool_or(coalesce(qwk_mean < {t}, false)) AS preflight_lt_{int(t * 100)}' for t in PREFLIGHT)} FROM (SELECT {_FLAG} AS flag, qwk_mean FROM os WHERE cv_scheme = 'grade_stratified') WHERE flag IS NOT NULL GROUP BY flag),
a AS (SELECT trait, tau_mean AS tau_mean_F, tau_min AS tau_min_F, unstable AS unstable_F FROM st WHERE cv = 'F'), b AS (SELECT trait, tau_mean AS tau_mean_O, tau_min AS tau_min_O, unstable AS unstable_O FROM st WHERE cv = 'O')
SELECT trait, tau_mean_F, tau_min_F, unstable_F, tau_mean_O, tau_min_O, unstable_O, {', '.join(f"array_to_string(top_{n}, '|') AS top3_{n}" for n, _ in VARIANTS)},
 {', '.join(f'round(len(list_intersect(top_primary, top_{n})) / len(list_distinct(list_concat(top_primary, top_{n})))::DOUBLE, 6) AS jaccard_{n}' for n, _ in VARIANTS[1:])}, sign_match_mean, {', '.join(f'preflight_lt_{int(t * 100)}' for t in PREFLIGHT)}
FROM a FULL JOIN b USING (trait) {' '.join(f'LEFT JOIN t{n} USING (trait)' for n, _ in VARIANTS)} LEFT JOIN sm USING (trait) LEFT JOIN pf USING (trait)""",
    "kept_scores": f"WITH {RATINGS} SELECT essay_id, trait, rating_round, r1, r2 FROM ratings WHERE essay_id IN (SELECT essay_id FROM ({sampling.SQL['base_sample']}))",
    "purity_weights": f"WITH {PURITY} SELECT essay_id, trait, round(1 - least(greatest(ratio, 0), 1), 6) AS weight FROM pure",
    "essay_samples": f"""
WITH {_TEXTS}, p AS (SELECT {_PLAIN.format('prompt_id')} AS p, min(purpose) AS purpose FROM prompts WHERE purpose IS NOT NULL GROUP BY 1),
o AS (SELECT purpose AS sample, min(essay_id) AS essay_id FROM e JOIN p ON p.p = {_PLAIN.format('e.prompt_id')} WHERE regexp_matches(p.p, '[1-9]') GROUP BY purpose),
h AS (SELECT essay_id, length(text) AS n FROM e ORDER BY essay_id LIMIT 200), k AS (SELECT essay_id, row_number() OVER (ORDER BY n, essay_id) AS k, count(*) OVER () AS m FROM h),
s AS (SELECT * FROM o UNION ALL SELECT 'median length', essay_id FROM k WHERE k = m // 2 + 1)
SELECT sample, essay_id, length(text) AS n_chars, sha256(text) AS sha256 FROM s JOIN e USING (essay_id)""",
    "essays_in_order": "SELECT essay_id, max(length(text)) AS n_chars FROM essays WHERE essay_id IS NOT NULL GROUP BY essay_id ORDER BY essay_id LIMIT 50",
    "assembled_prompts": f"WITH a AS (SELECT prompt_id, {_FILLED} AS t FROM prompts WHERE prompt_id IS NOT NULL) SELECT prompt_id, length(t) AS n_chars, sha256(t) AS sha256, NOT contains(replace(t, '{{{{ESSAY_TEXT}}}}', ''), '{{{{') AS ready FROM a",
    "word_owners": """
WITH w AS (SELECT DISTINCT unnest(list_transform(regexp_extract_all(concat_ws(' ', topic, prompt), '([0-9A-Za-z가-힣]+)'), lambda x: lower(x))) AS keyword, subject FROM prompts WHERE subject IS NOT NULL)
SELECT keyword, count(*) AS n_owners, string_agg(subject, '|' ORDER BY subject) AS owners FROM w GROUP BY keyword HAVING count(*) > 1""",
}
