"""The main contrast: overlap of attributed and named families, gates, and paired rank tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import stats, tails
from tessera.functions.sets import alignment_metric, family_order, normalize, pipe
from tessera.functions.vocab import FAMILIES
from tessera.operators.rank import top_k
from tessera.plans.attribution import _ORDER_SQL, SETS_SQL, _family_sql, family, shap_family_sets
from tessera.plans.ratings import r6
from tessera.session import table

TYPES = {"R": "surface", "A": "discourse", "N": "content"}
CONTRASTS = (("surface", "content"), ("surface", "discourse"), ("discourse", "content"))


def named_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The families a rationale names, in the fixed order, by essay and trait: lines of more than 25 stand for it."""
    t = table(spark, sf_dir, "lineitem").where("l_quantity > 25").select(F.col("l_orderkey").alias("essay_id"), F.col("l_returnflag").alias("trait"), family("l_partkey").alias("family")).distinct()
    return top_k(t, ["essay_id", "trait"], [family_order(F.col("family")), F.col("family")], "family", len(FAMILIES), "llm_families")


NAMED_SQL = f"named AS (SELECT essay_id, trait, list(family ORDER BY {_ORDER_SQL}) AS llm_families FROM (SELECT DISTINCT l_orderkey AS essay_id, l_returnflag AS trait, {_family_sql('l_partkey')} AS family FROM lineitem WHERE l_quantity > 25) GROUP BY ALL)"


def alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = shap_family_sets(spark, sf_dir).withColumn("shap_families", normalize(F.col("shap_families")))
    return alignment_metric(s, named_sets(spark, sf_dir), ["essay_id", "trait"], "shap_families", "llm_families")


ALIGN_SQL = f"""{SETS_SQL}, {NAMED_SQL}, j AS (SELECT essay_id, trait, shap_families, llm_families, len(list_intersect(shap_families, llm_families)) AS i, len(list_distinct(list_concat(shap_families, llm_families))) AS u FROM shap_sets JOIN named USING (essay_id, trait)),
align AS (SELECT *, CASE WHEN u > 0 THEN i / u::DOUBLE ELSE 0 END AS jaccard FROM j)"""


def alignment_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alignment metric of every essay and trait, sets as text."""
    a = alignment(spark, sf_dir)
    return a.withColumn("jaccard", r6(F.col("jaccard"))).withColumn("shap_families", pipe(F.col("shap_families"))).withColumn("llm_families", pipe(F.col("llm_families")))


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean overlap by essay, trait types in columns; essays that lack one are dropped."""
    a = alignment(spark, sf_dir).withColumn("type", F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv])[F.col("trait")])
    w = a.groupBy("essay_id").agg(*[F.avg(F.when(F.col("type") == t, F.col("jaccard"))).alias(t) for t in TYPES.values()])
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("essay_id"), F.col("o_orderstatus").alias("purpose"))
    return w.na.drop(subset=list(TYPES.values())).join(orders, "essay_id")


WIDE_SQL = f"""{ALIGN_SQL}, w0 AS (SELECT essay_id, avg(jaccard) FILTER (WHERE trait = 'R') AS surface, avg(jaccard) FILTER (WHERE trait = 'A') AS discourse, avg(jaccard) FILTER (WHERE trait = 'N') AS content FROM align GROUP BY essay_id),
wide AS (SELECT w0.*, o_orderstatus AS purpose FROM w0 JOIN orders ON o_orderkey = essay_id WHERE surface IS NOT NULL AND discourse IS NOT NULL AND content IS NOT NULL)"""


def wide_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide(spark, sf_dir).select("essay_id", "purpose", *[r6(F.col(t)).alias(t) for t in TYPES.values()])


def differences(w: DataFrame) -> DataFrame:
    """contrast, left, right and d of all paired contrasts, in long form."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f"{a}_vs_{b}").alias("contrast"), F.col(a).alias("left"), F.col(b).alias("right")) for a, b in CONTRASTS]))
    return w.select("essay_id", "purpose", pairs.alias("p")).select("essay_id", "purpose", "p.*", F.round(F.col("p.left") - F.col("p.right"), 9).alias("d"))


def _diff_sql(t: str = "wide") -> str:
    return "diff AS (" + " UNION ALL ".join(f"SELECT essay_id, purpose, '{a}_vs_{b}' AS contrast, {a} AS l, {b} AS r, round({a} - {b}, 9) AS d FROM {t}" for a, b in CONTRASTS) + ")"


def wilcoxon_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed-rank sums and rank-biserial r of each contrast under each treatment of zeros."""
    d = differences(wide(spark, sf_dir))
    parts = [stats.signed_ranks(d, "d", ["contrast"], z).withColumn("zero_method", F.lit(z)) for z in ("wilcox", "pratt", "zsplit")]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.withColumn("rank_biserial_r", r6(stats.rank_biserial(F.col("w_plus"), F.col("w_minus"))))


def _signed_sql(z: str) -> str:
    src = "SELECT * FROM diff WHERE d <> 0" if z == "wilcox" else "SELECT * FROM diff"
    zero = "r / 2" if z == "zsplit" else "0"
    tie = "t ** 3 - t" if z == "zsplit" else "CASE WHEN d <> 0 THEN t ** 3 - t ELSE 0 END"
    return f"""SELECT contrast, (SELECT count(*) FROM diff x WHERE x.contrast = r.contrast) AS n, sum((d <> 0)::INT)::BIGINT AS n_nonzero, sum(CASE WHEN d > 0 THEN r WHEN d = 0 THEN {zero} ELSE 0 END)::DOUBLE AS w_plus, sum(CASE WHEN d < 0 THEN r WHEN d = 0 THEN {zero} ELSE 0 END)::DOUBLE AS w_minus,
 sum(({tie}) / t)::DOUBLE AS tie_sum, (SELECT count(*) FROM diff x WHERE x.contrast = r.contrast AND x.d = 0) AS n_zero, '{z}' AS zero_method
 FROM (SELECT contrast, d, count(*) OVER (PARTITION BY contrast, abs(d)) AS t, rank() OVER (PARTITION BY contrast ORDER BY abs(d)) + (count(*) OVER (PARTITION BY contrast, abs(d)) - 1) / 2.0 AS r FROM ({src})) r GROUP BY contrast"""


def wilcoxon_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three contrasts' tests with p and Holm's thresholds: a report of three rows, made on the driver."""
    rows = []
    for r in stats.signed_ranks(differences(wide(spark, sf_dir)), "d", ["contrast"]).orderBy("contrast").collect():  # three rows
        one_sided = r["contrast"] == "surface_vs_content"
        p = tails.wilcoxon_p(r["n_nonzero"], r["w_plus"], r["w_minus"], r["tie_sum"], "greater" if one_sided else "two-sided")
        w = r["w_plus"] if one_sided else min(r["w_plus"], r["w_minus"])
        rows.append((r["contrast"], "greater" if one_sided else "two-sided", r["n"], float(w), p))
    df = spark.createDataFrame(rows, "contrast string, alternative string, n bigint, statistic double, p_value double")
    return stats.holm(df, "p_value", "contrast")


def friedman_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Friedman's test over the three types; with two degrees of freedom p is exp(-x / 2)."""
    w = wide(spark, sf_dir).select(*[F.round(t, 9).alias(t) for t in TYPES.values()], F.lit("all").alias("scope"))
    f = stats.friedman(w, list(TYPES.values()), ["scope"])
    return f.select("scope", "n", F.round("statistic", 4).alias("statistic"), F.lit(2).alias("dof"), F.round(F.exp(-F.col("statistic") / 2), 9).alias("p_value"))


def purpose_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By purpose: medians of surface and content, r of their difference, and whether both point one way."""
    w = wide(spark, sf_dir)
    d = differences(w).where("contrast = 'surface_vs_content'")
    s = stats.signed_ranks(d, "d", ["purpose"]).select("purpose", stats.rank_biserial(F.col("w_plus"), F.col("w_minus")).alias("r"))
    m = w.groupBy("purpose").agg(F.count("*").alias("n"), F.percentile("surface", F.lit(0.5)).alias("a"), F.percentile("content", F.lit(0.5)).alias("b"))
    j = m.join(s, "purpose")
    return j.select("purpose", "n", r6(F.col("a")).alias("median_surface"), r6(F.col("b")).alias("median_content"), r6(F.col("r")).alias("rank_biserial_r"), ((F.col("a") > F.col("b")) & (F.col("r") > 0)).alias("gate_pass"))


def strong_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conjunction behind the strong claim: p, effect size, direction of medians, and all gates."""
    t = wilcoxon_tests(spark, sf_dir).where("contrast = 'surface_vs_content'").select("p_value")
    d = differences(wide(spark, sf_dir)).where("contrast = 'surface_vs_content'")
    e = stats.signed_ranks(d, "d", ["contrast"]).select(stats.rank_biserial(F.col("w_plus"), F.col("w_minus")).alias("r"))
    m = d.agg(F.percentile("left", F.lit(0.5)).alias("a"), F.percentile("right", F.lit(0.5)).alias("b"))
    g = purpose_gate(spark, sf_dir).agg(F.coalesce(F.bool_and("gate_pass"), F.lit(False)).alias("gates"))
    one = m.withColumns({"p_value": t.scalar(), "r": e.scalar(), "gates": g.scalar()})
    ok = (F.col("p_value") < 0.05) & (F.col("r") >= 0.10) & (F.col("a") > F.col("b")) & F.col("gates")
    return one.select(r6(F.col("r")).alias("rank_biserial_r"), (F.col("a") > F.col("b")).alias("median_direction"), "gates", F.coalesce(ok, F.lit(False)).alias("strong_claim"))


def trait_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, moments and exact quantiles of the overlap by trait, with non-empty and zero shares."""
    j = F.col("jaccard")
    q = [r6(F.percentile(j, F.lit(p))).alias(f"q{int(p * 100)}") for p in (0.25, 0.5, 0.75, 0.9, 0.95)]
    return alignment(spark, sf_dir).groupBy("trait").agg(F.count("*").alias("n"), r6(F.avg(j)).alias("mean"), r6(F.stddev_samp(j)).alias("std"), *q, F.sum((j > 0).cast("bigint")).alias("n_positive"), r6(F.avg((j > 0).cast("double"))).alias("positive_rate"))


def paired_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positive, zero and negative differences by contrast, with shares."""
    d = F.col("d")
    n = [F.sum(c.cast("bigint")).alias(f"n_{k}") for k, c in (("positive", d > 0), ("zero", d == 0), ("negative", d < 0))]
    s = [F.round(100 * F.avg(c.cast("double")), 4).alias(f"pct_{k}") for k, c in (("positive", d > 0), ("zero", d == 0), ("negative", d < 0))]
    return differences(wide(spark, sf_dir)).groupBy("contrast").agg(F.count("*").alias("n"), *n, *s)


def empty_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first contrast with and without pairs in which both sides are 0."""
    d = differences(wide(spark, sf_dir)).where("contrast = 'surface_vs_content'")
    d = d.select("*", F.explode(F.when((F.col("left") == 0) & (F.col("right") == 0), F.array(F.lit("zero"))).otherwise(F.array(F.lit("zero"), F.lit("missing")))).alias("convention"))
    s = stats.signed_ranks(d, "d", ["convention"])
    m = d.groupBy("convention").agg(r6(F.percentile("left", F.lit(0.5))).alias("median_left"), r6(F.percentile("right", F.lit(0.5))).alias("median_right"))
    return s.select("convention", "n", "w_plus", r6(stats.rank_biserial(F.col("w_plus"), F.col("w_minus"))).alias("rank_biserial_r")).join(m, "convention")


def prevalence(rate, n_positive):
    """A rate's diagnosis."""
    return F.when(n_positive == 0, "DEGENERATE_ZERO").when(rate.isNull(), "EMPTY").when(rate < 0.20, "LOW_PREVALENCE").otherwise("INTERPRETABLE")


def metric_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By trait: share of cells that name any family, and its diagnosis; a trait without cells has 0."""
    cells = shap_family_sets(spark, sf_dir).select("essay_id", "trait").join(named_sets(spark, sf_dir), ["essay_id", "trait"], "left")
    g = cells.groupBy("trait").agg(F.count("*").alias("n_cells"), F.count("llm_families").alias("positive_cells"))
    dim = spark.createDataFrame([(t,) for t in TYPES], "trait string")
    g = dim.join(g, "trait", "left").select("trait", F.coalesce("n_cells", F.lit(0)).alias("n_cells"), F.coalesce("positive_cells", F.lit(0)).alias("positive_cells"))
    rate = F.when(F.col("n_cells") > 0, F.col("positive_cells") / F.col("n_cells")).otherwise(0.0)
    return g.select("*", r6(rate).alias("non_empty_rate"), (rate >= 0.80).alias("axis_f_pass"), prevalence(rate, F.col("positive_cells")).alias("prevalence"))


def family_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of all cells that contain each family, and whether it stays below one half."""
    n = named_sets(spark, sf_dir)
    total = n.agg(F.count("*").alias("n")).scalar()
    s = n.select(F.explode("llm_families").alias("family")).groupBy("family").agg(F.count("*").alias("n_cells")).withColumn("n", total)
    return s.select("family", "n_cells", r6(F.col("n_cells") / F.col("n")).alias("cell_share"), (F.col("n_cells") / F.col("n") < 0.5).alias("axis_g_pass"))


def jaccard_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median and population deviation of the overlap, and whether they discriminate."""
    a = alignment(spark, sf_dir).agg(F.percentile("jaccard", F.lit(0.5)).alias("m"), F.stddev_pop("jaccard").alias("s"))
    return a.select(r6(F.col("m")).alias("median_a"), r6(F.col("s")).alias("std_a"), ((F.col("m") >= 0.10) & (F.col("m") <= 0.70) & (F.col("s") > 0.05)).alias("axis_h_pass"))


QUERIES = {
    "named_family_sets": lambda s, d: named_sets(s, d).withColumn("llm_families", pipe(F.col("llm_families"))),
    "alignment_metric": alignment_table,
    "trait_type_wide": wide_table,
    "wilcoxon_sums": wilcoxon_sums,
    "wilcoxon_tests": wilcoxon_tests,
    "friedman_test": friedman_test,
    "purpose_gate": purpose_gate,
    "strong_claim": strong_claim,
    "trait_quantiles": trait_quantiles,
    "paired_counts": paired_counts,
    "empty_union": empty_union,
    "metric_gates": metric_gates,
    "family_share": family_share,
    "jaccard_gate": jaccard_gate,
}

_D = f"WITH {WIDE_SQL}, {_diff_sql()}"
_RB = "CASE WHEN w_plus + w_minus > 0 THEN (w_plus - w_minus) / (w_plus + w_minus) ELSE 0 END"
_SIGNED = "sum(CASE WHEN d > 0 THEN r ELSE 0 END)::DOUBLE AS w_plus, sum(CASE WHEN d < 0 THEN r ELSE 0 END)::DOUBLE AS w_minus"
SQL = {
    "named_family_sets": f"WITH {NAMED_SQL} SELECT essay_id, trait, array_to_string(llm_families, '|') AS llm_families FROM named",
    "alignment_metric": f"WITH {ALIGN_SQL} SELECT essay_id, trait, array_to_string(shap_families, '|') AS shap_families, array_to_string(llm_families, '|') AS llm_families, round(jaccard, 6) AS jaccard, len(shap_families) = 0 AS shap_families_empty, len(llm_families) = 0 AS llm_families_empty, u AS union_size, i AS intersection_size FROM align",
    "trait_type_wide": f"WITH {WIDE_SQL} SELECT essay_id, purpose, round(surface, 6) AS surface, round(discourse, 6) AS discourse, round(content, 6) AS content FROM wide",
    "wilcoxon_sums": f"{_D}, s AS ({' UNION ALL '.join(_signed_sql(z) for z in ('wilcox', 'pratt', 'zsplit'))}) SELECT *, round({_RB}, 6) AS rank_biserial_r FROM s",
    "friedman_test": f"""WITH {WIDE_SQL}, v AS (SELECT round(surface, 9) AS a, round(discourse, 9) AS b, round(content, 9) AS c FROM wide),
r AS (SELECT 1 + (b < a)::INT + (c < a)::INT + ((b = a)::INT + (c = a)::INT) / 2.0 AS ra, 1 + (a < b)::INT + (c < b)::INT + ((a = b)::INT + (c = b)::INT) / 2.0 AS rb, 1 + (a < c)::INT + (b < c)::INT + ((a = c)::INT + (b = c)::INT) / 2.0 AS rc, CASE WHEN a = b AND b = c THEN 24 WHEN a = b OR b = c OR a = c THEN 6 ELSE 0 END AS t FROM v),
g AS (SELECT count(*) AS n, sum(ra) AS x, sum(rb) AS y, sum(rc) AS z, sum(t) AS t FROM r), f AS (SELECT n, (12.0 / (n * 12) * (x * x + y * y + z * z) - 12 * n) / (1 - t / (n * 24.0)) AS s FROM g)
SELECT 'all' AS scope, n, round(s, 4) AS statistic, 2 AS dof, round(exp(-s / 2), 9) AS p_value FROM f WHERE n > 0""",
    "purpose_gate": f"""{_D}, k AS (SELECT purpose, d, rank() OVER (PARTITION BY purpose ORDER BY abs(d)) + (count(*) OVER (PARTITION BY purpose, abs(d)) - 1) / 2.0 AS r FROM diff WHERE contrast = 'surface_vs_content' AND d <> 0), s AS (SELECT purpose, {_SIGNED} FROM k GROUP BY purpose),
m AS (SELECT purpose, count(*) AS n, quantile_cont(surface, 0.5) AS a, quantile_cont(content, 0.5) AS b FROM wide GROUP BY purpose), pj AS (SELECT m.*, coalesce({_RB}, 0) AS r FROM m LEFT JOIN s USING (purpose))
SELECT purpose, n, round(a, 6) AS median_surface, round(b, 6) AS median_content, round(r, 6) AS rank_biserial_r, a > b AND r > 0 AS gate_pass FROM pj""",
    "trait_quantiles": f"""WITH {ALIGN_SQL} SELECT trait, count(*) AS n, round(avg(jaccard), 6) AS mean, round(stddev_samp(jaccard), 6) AS std, {', '.join(f'round(quantile_cont(jaccard, {p}), 6) AS q{int(p * 100)}' for p in (0.25, 0.5, 0.75, 0.9, 0.95))}, sum((jaccard > 0)::INT)::BIGINT AS n_positive, round(avg((jaccard > 0)::INT), 6) AS positive_rate FROM align GROUP BY trait""",
    "paired_counts": f"{_D} SELECT contrast, count(*) AS n, {', '.join(f'sum((d {o} 0)::INT)::BIGINT AS n_{k}, round(100 * avg((d {o} 0)::INT), 4) AS pct_{k}' for k, o in (('positive', '>'), ('zero', '='), ('negative', '<')))} FROM diff GROUP BY contrast",
    "empty_union": f"""{_D}, e AS (SELECT l, r AS rr, d, unnest(CASE WHEN l = 0 AND r = 0 THEN ['zero'] ELSE ['zero', 'missing'] END) AS convention FROM diff WHERE contrast = 'surface_vs_content'),
k AS (SELECT convention, d, rank() OVER (PARTITION BY convention ORDER BY abs(d)) + (count(*) OVER (PARTITION BY convention, abs(d)) - 1) / 2.0 AS r FROM e WHERE d <> 0), s AS (SELECT convention, {_SIGNED} FROM k GROUP BY convention)
SELECT convention, count(*) AS n, any_value(w_plus) AS w_plus, round(any_value({_RB}), 6) AS rank_biserial_r, round(quantile_cont(l, 0.5), 6) AS median_left, round(quantile_cont(rr, 0.5), 6) AS median_right FROM e JOIN s USING (convention) GROUP BY convention""",
    "metric_gates": f"""WITH {SETS_SQL}, {NAMED_SQL}, g AS (SELECT trait, count(*) AS n_cells, count(llm_families) AS positive_cells FROM shap_sets LEFT JOIN named USING (essay_id, trait) GROUP BY trait), d AS (SELECT unnest(['R', 'A', 'N']) AS trait), h AS (SELECT trait, coalesce(n_cells, 0) AS n_cells, coalesce(positive_cells, 0) AS positive_cells, CASE WHEN n_cells > 0 THEN positive_cells / n_cells::DOUBLE ELSE 0 END AS r FROM d LEFT JOIN g USING (trait))
SELECT trait, n_cells, positive_cells, round(r, 6) AS non_empty_rate, r >= 0.8 AS axis_f_pass, CASE WHEN positive_cells = 0 THEN 'DEGENERATE_ZERO' WHEN r < 0.2 THEN 'LOW_PREVALENCE' ELSE 'INTERPRETABLE' END AS prevalence FROM h""",
    "family_share": f"WITH {NAMED_SQL}, t AS (SELECT count(*) AS n FROM named), u AS (SELECT unnest(llm_families) AS family FROM named) SELECT family, count(*) AS n_cells, round(count(*) / any_value(n)::DOUBLE, 6) AS cell_share, count(*) / any_value(n)::DOUBLE < 0.5 AS axis_g_pass FROM u, t GROUP BY family",
    "jaccard_gate": f"WITH {ALIGN_SQL}, g AS (SELECT quantile_cont(jaccard, 0.5) AS m, stddev_pop(jaccard) AS s FROM align) SELECT round(m, 6) AS median_a, round(s, 6) AS std_a, m >= 0.1 AND m <= 0.7 AND s > 0.05 AS axis_h_pass FROM g",
}
