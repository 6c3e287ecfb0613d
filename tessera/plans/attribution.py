"""Attributions by feature family: global ranks, stability over folds, overlap and sign agreement.

The tables stand in for attributions: an order is an essay, a return flag a trait, the supplier
gives the family, the line status the validation scheme, the order's remainder the fold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import stats
from tessera.functions.sets import family_order, jaccard, pipe
from tessera.functions.vocab import FAMILIES
from tessera.operators.rank import rank_min, top_k
from tessera.plans.ratings import r6
from tessera.session import table

D = 4  # digits of the attributions that ranks and signs go by


def family(c: str):
    return F.element_at(F.array(*map(F.lit, FAMILIES)), (F.col(c) % len(FAMILIES) + 1).cast("int"))


def attributions(spark: SparkSession, sf_dir: str, base: float = 0.05) -> DataFrame:
    """essay_id, trait, family, cv, fold, shap: sums by family, rounded so that summing order can't flip ties."""
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_suppkey", "l_linestatus", (F.col("l_extendedprice") * (F.col("l_discount") - base)).alias("v"))
    g = t.groupBy(F.col("l_orderkey").alias("essay_id"), F.col("l_returnflag").alias("trait"), family("l_suppkey").alias("family"), F.col("l_linestatus").alias("cv"))
    return g.agg(F.round(F.sum("v"), D).alias("shap")).withColumn("fold", F.col("essay_id") % 5)


def _family_sql(c: str) -> str:
    return f"list_extract([{', '.join(repr(f) for f in FAMILIES)}], ({c} % {len(FAMILIES)} + 1)::INT)"


def _shap_sql(name: str = "shap", base: float = 0.05) -> str:
    return f"{name} AS (SELECT l_orderkey AS essay_id, l_returnflag AS trait, {_family_sql('l_suppkey')} AS family, l_linestatus AS cv, round(sum(l_extendedprice * (l_discount - {base})), {D}) AS shap, l_orderkey % 5 AS fold FROM lineitem GROUP BY ALL)"


_ORDER_SQL = "CASE family " + " ".join(f"WHEN '{f}' THEN {i}" for i, f in enumerate(FAMILIES)) + " END"


def global_shap(df: DataFrame, by: list[str]) -> DataFrame:
    """Mean absolute attribution by trait and family, with its rank within the trait."""
    g = df.groupBy(*by, "family").agg(F.round(F.avg(F.abs("shap")), 2).alias("mean_abs_shap"))
    return rank_min(g, by, F.col("mean_abs_shap"))


def shap_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return global_shap(attributions(spark, sf_dir), ["cv", "trait"])


def shap_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three families that lead each trait; ties go by the family's name."""
    g = shap_global(spark, sf_dir)
    return top_k(g, ["cv", "trait"], [F.col("rank"), F.col("family")], "family").select("cv", "trait", pipe(F.col("top")).alias("top_families"))


def shap_family_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three leading families of every essay and trait: by size, then the fixed order."""
    a = attributions(spark, sf_dir).groupBy("essay_id", "trait", "family").agg(F.round(F.sum("shap"), D).alias("shap"))
    t = top_k(a, ["essay_id", "trait"], [F.abs("shap").desc(), family_order(F.col("family")), F.col("family")], "family")
    return t.select("essay_id", "trait", pipe(F.col("top")).alias("shap_families"))


SETS_SQL = f"""{_shap_sql()}, cell AS (SELECT essay_id, trait, family, round(sum(shap), {D}) AS s FROM shap GROUP BY ALL), rk AS (SELECT *, row_number() OVER (PARTITION BY essay_id, trait ORDER BY abs(s) DESC, {_ORDER_SQL}, family) AS k FROM cell),
shap_sets AS (SELECT essay_id, trait, list(family ORDER BY k) AS shap_families FROM rk WHERE k <= 3 GROUP BY essay_id, trait)"""


def fold_ranks(df: DataFrame) -> DataFrame:
    """Ranks of all families by trait and fold; families that don't occur count as 0."""
    g = df.groupBy("cv", "trait", "fold", "family").agg(F.round(F.avg(F.abs("shap")), 2).alias("m"))
    cells = g.select("cv", "trait", "fold").distinct().select("*", F.explode(F.array(*map(F.lit, FAMILIES))).alias("family"))
    dense = cells.join(g, ["cv", "trait", "fold", "family"], "left").withColumn("m", F.coalesce("m", F.lit(0.0)))
    return rank_min(dense, ["cv", "trait", "fold"], F.col("m"))


def shap_fold_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold_ranks(attributions(spark, sf_dir)).select("cv", "trait", "fold", "family", "rank")


RANKS_SQL = f"""{_shap_sql()}, fm AS (SELECT cv, trait, fold, family, round(avg(abs(shap)), 2) AS m FROM shap GROUP BY ALL), fam AS (SELECT unnest([{', '.join(repr(f) for f in FAMILIES)}]) AS family), cells AS (SELECT DISTINCT cv, trait, fold FROM fm),
fr AS (SELECT cv, trait, fold, family, rank() OVER (PARTITION BY cv, trait, fold ORDER BY coalesce(m, 0) DESC) AS rank FROM (SELECT * FROM cells CROSS JOIN fam) LEFT JOIN fm USING (cv, trait, fold, family))"""


def shap_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kendall's tau-b between each two folds' ranks: mean, least and most by scheme and trait."""
    ranks = fold_ranks(attributions(spark, sf_dir))
    tau = stats.kendall_pairs(ranks, "fold", "family", "rank", ["cv", "trait"])
    t = F.col("tau")
    return tau.groupBy("cv", "trait").agg(F.count("*").alias("n_pairs"), r6(F.avg(t)).alias("tau_mean"), r6(F.min(t)).alias("tau_min"), r6(F.max(t)).alias("tau_max"), F.coalesce(F.avg(t) < 0.5, F.lit(False)).alias("unstable"))


def shap_stability_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By trait: the least mean tau over schemes, and whether any scheme is unstable."""
    return shap_stability(spark, sf_dir).groupBy("trait").agg(F.min("tau_mean").alias("tau_mean_min"), F.bool_or("unstable").alias("tau_unstable_any"))


TAU_SQL = f"""{RANKS_SQL}, pr AS (SELECT a.cv, a.trait, a.fold AS fa, b.fold AS fb, sum(sign(a.rank - c.rank) * sign(b.rank - d.rank)) AS c, sum(abs(sign(a.rank - c.rank))) AS x, sum(abs(sign(b.rank - d.rank))) AS y
 FROM fr a JOIN fr b ON a.cv = b.cv AND a.trait = b.trait AND a.family = b.family AND a.fold < b.fold JOIN fr c ON c.cv = a.cv AND c.trait = a.trait AND c.fold = a.fold AND c.family < a.family JOIN fr d ON d.cv = b.cv AND d.trait = b.trait AND d.fold = b.fold AND d.family = c.family GROUP BY ALL),
tau AS (SELECT cv, trait, CASE WHEN x > 0 AND y > 0 THEN c / sqrt(x * y) END AS tau FROM pr),
stab AS (SELECT cv, trait, count(*) AS n_pairs, round(avg(tau), 6) AS tau_mean, round(min(tau), 6) AS tau_min, round(max(tau), 6) AS tau_max, coalesce(avg(tau) < 0.5, false) AS unstable FROM tau GROUP BY cv, trait)"""


def shap_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of two variants' three leading families, by trait."""
    tops = []
    for name, base in (("a", 0.05), ("b", 0.04)):
        g = global_shap(attributions(spark, sf_dir, base), ["trait"])
        tops.append(top_k(g, ["trait"], [F.col("rank"), F.col("family")], "family", out=f"top_{name}"))
    j = tops[0].join(tops[1], "trait")
    both = F.array_sort(F.array_intersect("top_a", "top_b"))
    v = jaccard(F.col("top_a"), F.col("top_b"), None)
    return j.select("trait", pipe(F.col("top_a")).alias("top_a"), pipe(F.col("top_b")).alias("top_b"), pipe(both).alias("intersection"), r6(v).alias("jaccard"), F.coalesce(v < 0.5, F.lit(False)).alias("unstable"))


def _top_sql(name: str, base: float) -> str:
    return f"""{_shap_sql('s' + name, base)}, g{name} AS (SELECT trait, family, round(avg(abs(shap)), 2) AS m FROM s{name} GROUP BY ALL), r{name} AS (SELECT *, row_number() OVER (PARTITION BY trait ORDER BY m DESC, family) AS k FROM g{name}), t{name} AS (SELECT trait, list(family ORDER BY k) AS top_{name} FROM r{name} WHERE k <= 3 GROUP BY trait)"""


def discretize(c, floor: float = 1e-3):
    """The sign of an attribution; 0 within the noise floor."""
    return F.when(c > floor, 1).when(c < -floor, -1).otherwise(0)


def sign_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By trait and family: how often two variants' attributions have the same sign."""
    keys = ["essay_id", "trait", "family", "cv"]
    a, b = attributions(spark, sf_dir), attributions(spark, sf_dir, 0.04)
    j = a.select(*keys, discretize(F.col("shap")).alias("x")).join(b.select(*keys, discretize(F.col("shap")).alias("y")), keys)
    x, y = F.col("x"), F.col("y")
    share = lambda c: r6(F.avg(c.cast("double")))
    some = (x != 0) & (y != 0)
    return j.groupBy("trait", "family").agg(
        F.count("*").alias("n"),
        share(x == y).alias("match_rate"),
        share((x == 0) & (y == 0)).alias("both_zero_rate"),
        share((x == y) & some).alias("nonzero_match_rate"),
        share(x * y == -1).alias("opposite_rate"),
    )


def shap_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families in columns by essay and trait; absent ones are 0."""
    a = attributions(spark, sf_dir)
    return a.groupBy("essay_id", "trait").agg(*[F.round(F.coalesce(F.sum(F.when(F.col("family") == f, F.col("shap"))), F.lit(0.0)), D).alias(f) for f in FAMILIES])


def shap_melted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide table molten again, summed by trait and family."""
    m = shap_wide(spark, sf_dir).unpivot(["essay_id", "trait"], list(FAMILIES), "family", "shap")
    return m.groupBy("trait", "family").agg(F.count("*").alias("n"), F.sum((F.col("shap") != 0).cast("bigint")).alias("n_nonzero"), F.round(F.avg("shap"), 2).alias("mean_shap"))


QUERIES = {
    "shap_global": shap_global,
    "shap_top3": shap_top3,
    "shap_family_sets": shap_family_sets,
    "shap_fold_ranks": shap_fold_ranks,
    "shap_stability": shap_stability,
    "shap_stability_any": shap_stability_any,
    "shap_jaccard": shap_jaccard,
    "sign_consistency": sign_consistency,
    "shap_wide": shap_wide,
    "shap_melted": shap_melted,
}

_GLOBAL = f"{_shap_sql()}, g AS (SELECT cv, trait, family, round(avg(abs(shap)), 2) AS mean_abs_shap FROM shap GROUP BY ALL), gr AS (SELECT *, rank() OVER (PARTITION BY cv, trait ORDER BY mean_abs_shap DESC) AS rank FROM g)"
_SIGN = "CASE WHEN {0} > 0.001 THEN 1 WHEN {0} < -0.001 THEN -1 ELSE 0 END"
SQL = {
    "shap_global": f"WITH {_GLOBAL} SELECT * FROM gr",
    "shap_top3": f"WITH {_GLOBAL}, k AS (SELECT *, row_number() OVER (PARTITION BY cv, trait ORDER BY rank, family) AS k FROM gr) SELECT cv, trait, string_agg(family, '|' ORDER BY k) AS top_families FROM k WHERE k <= 3 GROUP BY cv, trait",
    "shap_family_sets": f"WITH {SETS_SQL} SELECT essay_id, trait, array_to_string(shap_families, '|') AS shap_families FROM shap_sets",
    "shap_fold_ranks": f"WITH {RANKS_SQL} SELECT * FROM fr",
    "shap_stability": f"WITH {TAU_SQL} SELECT * FROM stab",
    "shap_stability_any": f"WITH {TAU_SQL} SELECT trait, min(tau_mean) AS tau_mean_min, bool_or(unstable) AS tau_unstable_any FROM stab GROUP BY trait",
    "shap_jaccard": f"""WITH {_top_sql('a', 0.05)}, {_top_sql('b', 0.04)}, j AS (SELECT *, len(list_intersect(top_a, top_b)) / len(list_distinct(list_concat(top_a, top_b)))::DOUBLE AS v FROM ta JOIN tb USING (trait))
SELECT trait, array_to_string(top_a, '|') AS top_a, array_to_string(top_b, '|') AS top_b, array_to_string(list_sort(list_intersect(top_a, top_b)), '|') AS intersection, round(v, 6) AS jaccard, coalesce(v < 0.5, false) AS unstable FROM j""",
    "sign_consistency": f"""WITH {_shap_sql('sa')}, {_shap_sql('sb', 0.04)}, j AS (SELECT trait, family, {_SIGN.format('sa.shap')} AS x, {_SIGN.format('sb.shap')} AS y FROM sa JOIN sb USING (essay_id, trait, family, cv))
SELECT trait, family, count(*) AS n, round(avg((x = y)::INT), 6) AS match_rate, round(avg((x = 0 AND y = 0)::INT), 6) AS both_zero_rate, round(avg((x = y AND x <> 0 AND y <> 0)::INT), 6) AS nonzero_match_rate, round(avg((x * y = -1)::INT), 6) AS opposite_rate FROM j GROUP BY trait, family""",
    "shap_wide": f"WITH {_shap_sql()} SELECT essay_id, trait, {', '.join(f'''round(coalesce(sum(shap) FILTER (WHERE family = '{f}'), 0), 4) AS {f}''' for f in FAMILIES)} FROM shap GROUP BY essay_id, trait",
    "shap_melted": f"""WITH {_shap_sql()}, w AS (SELECT essay_id, trait, {', '.join(f'''round(coalesce(sum(shap) FILTER (WHERE family = '{f}'), 0), 4) AS {f}''' for f in FAMILIES)} FROM shap GROUP BY essay_id, trait),
m AS (UNPIVOT w ON {', '.join(FAMILIES)} INTO NAME family VALUE shap) SELECT trait, family, count(*) AS n, sum((shap <> 0)::INT)::BIGINT AS n_nonzero, round(avg(shap), 2) AS mean_shap FROM m GROUP BY trait, family""",
}
