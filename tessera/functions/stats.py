"""Agreement and association statistics as aggregates: one pass, partial sums before any shuffle.

Each expression goes into ``groupBy(...).agg(...)``.  Pairs with a NULL on either side are to be
filtered first; a statistic that isn't defined (no variation, no rows) is NULL.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.tails import chi2_sf
from tessera.functions.vocab import SCORE_MAX, SCORE_MIN


def clip_round(x: Column, low: int = SCORE_MIN, high: int = SCORE_MAX) -> Column:
    """The nearest score, halves to even, within the scale; NULL for NULL."""
    return F.when(x.isNotNull(), F.least(F.greatest(F.rint(x), F.lit(float(low))), F.lit(float(high))))


def qwk(x: Column, y: Column) -> Column:
    """Quadratic weighted kappa by distances of values."""
    d = F.var_pop(x) + F.var_pop(y) + (F.avg(x) - F.avg(y)) ** 2
    return F.when(d != 0, 1 - F.avg((x - y) ** 2) / d)


def linear_kappa(x: Column, y: Column, low: int = SCORE_MIN, high: int = SCORE_MAX) -> Column:
    """Linearly weighted kappa over the levels low..high, from the marginals' cumulative shares."""
    n = F.count("*")
    d = F.lit(0.0)
    for k in range(low, high):
        a, b = F.sum((x <= k).cast("double")) / n, F.sum((y <= k).cast("double")) / n
        d = d + a * (1 - b) + b * (1 - a)
    return F.when(d != 0, 1 - F.avg(F.abs(x - y)) / d)


def cohen_kappa(x: Column, y: Column, levels: list) -> Column:
    """Unweighted kappa over the given levels; NULL where only one occurs."""
    n = F.count("*")
    po = F.avg((x == y).cast("double"))
    pe = F.lit(0.0)
    for k in levels:
        pe = pe + F.sum((x == F.lit(k)).cast("double")) / n * (F.sum((y == F.lit(k)).cast("double")) / n)
    return F.when(F.abs(1 - pe) > 1e-12, (po - pe) / (1 - pe))


def icc21(x: Column, y: Column) -> Column:
    """ICC(2,1) of two raters: two-way random, absolute agreement, single rater."""
    n = F.count("*")
    mt, me, mc = 2 * F.var_samp((x + y) / 2), F.var_samp(x - y) / 2, n * F.avg(x - y) ** 2 / 2
    d = mt + me + 2 * (mc - me) / n
    return F.when(d != 0, (mt - me) / d)


def pearson(x: Column, y: Column) -> Column:
    """Pearson's r; NULL where either doesn't vary."""
    v = F.var_pop(x) * F.var_pop(y)  # not corr, which divides by zero here
    return F.when(v > 0, F.covar_pop(x, y) / F.sqrt(v))


def average_rank(df: DataFrame, value: str, by: list[str], out: str) -> DataFrame:
    """Adds the rank of ``value`` within ``by``; ties share their mean rank, NULLs have none.

    From counts by distinct value, so that only those are ordered in one task, not the rows.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    w = W.partitionBy(*by).orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow)
    ranks = counts.withColumn(out, F.sum("_n").over(w) - (F.col("_n") - 1) / 2).drop("_n")
    return df.join(ranks, [*by, value], "left")


def spearman(df: DataFrame, x: str, y: str, by: list[str], out: str = "spearman_r") -> DataFrame:
    """``by`` and Spearman's rho of two columns with average ranks.

    Works on counts of value pairs: all rows are reduced to those before anything is ranked.
    """
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by, x, y).agg(F.count("*").alias("n"))
    for c, r in ((x, "_rx"), (y, "_ry")):
        m = pairs.groupBy(*by, c).agg(F.sum("n").alias("_n"))
        w = W.partitionBy(*by).orderBy(c).rowsBetween(W.unboundedPreceding, W.currentRow)
        pairs = pairs.join(m.withColumn(r, F.sum("_n").over(w) - (F.col("_n") - 1) / 2).drop("_n"), [*by, c])
    n, a, b = F.sum("n"), F.sum(F.col("n") * F.col("_rx")), F.sum(F.col("n") * F.col("_ry"))
    aa, bb, ab = F.sum(F.col("n") * F.col("_rx") ** 2), F.sum(F.col("n") * F.col("_ry") ** 2), F.sum(F.col("n") * F.col("_rx") * F.col("_ry"))
    v = (n * aa - a * a) * (n * bb - b * b)
    return pairs.groupBy(*by).agg(F.when(v > 0, (n * ab - a * b) / F.sqrt(v)).alias(out))


def index_pairs(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """x and y replaced by their index among the labels that occur in either column.

    This is what weighted kappas use that are given no list of labels: a label that nobody used
    leaves no gap.
    """
    labels = df.select(*by, F.explode(F.array(x, y)).alias("_v")).where("_v IS NOT NULL").distinct()
    labels = labels.withColumn("_i", F.row_number().over(W.partitionBy(*by).orderBy("_v")))
    for c in (x, y):
        df = df.join(labels.select(*by, F.col("_v").alias(c), F.col("_i").alias(f"_{c}")), [*by, c]).drop(c).withColumnRenamed(f"_{c}", c)
    return df


def signed_ranks(df: DataFrame, d: str, by: list[str], zeros: str = "wilcox") -> DataFrame:
    """Sums of the signed-rank test over the differences ``d`` in each group.

    n (all pairs), n_nonzero, w_plus, w_minus, tie_sum (of t^3 - t), n_zero.  ``wilcox`` drops zero
    differences, ``pratt`` ranks them and then drops them, ``zsplit`` shares their ranks between
    both sides.  Ranked are the distinct absolute values with their counts.
    """
    v = df.where(F.col(d).isNotNull()).groupBy(*by, F.abs(d).alias("_a")).agg(F.count("*").alias("_n"), F.sum((F.col(d) > 0).cast("bigint")).alias("_p"), F.sum((F.col(d) < 0).cast("bigint")).alias("_m"))
    ranked = F.when((F.col("_a") == 0) & F.lit(zeros == "wilcox"), 0).otherwise(F.col("_n"))
    w = W.partitionBy(*by).orderBy("_a").rowsBetween(W.unboundedPreceding, W.currentRow)
    v = v.withColumn("_k", ranked).withColumn("_r", F.sum("_k").over(w) - (F.col("_n") - 1) / 2)
    zero = F.col("_a") == 0
    split = F.when(zero & F.lit(zeros == "zsplit"), F.col("_n") * F.col("_r") / 2).otherwise(F.lit(0.0))
    ties = F.when(zero & F.lit(zeros != "zsplit"), 0).otherwise(F.col("_n") ** 3 - F.col("_n"))
    return v.groupBy(*by).agg(
        F.sum("_n").alias("n"),
        F.sum(F.when(zero, 0).otherwise(F.col("_n"))).alias("n_nonzero"),
        F.sum(F.when(zero, split).otherwise(F.col("_p") * F.col("_r"))).alias("w_plus"),
        F.sum(F.when(zero, split).otherwise(F.col("_m") * F.col("_r"))).alias("w_minus"),
        F.sum(ties).alias("tie_sum"),
        F.sum(F.when(zero, F.col("_n")).otherwise(0)).alias("n_zero"),
    )


def rank_biserial(w_plus: Column, w_minus: Column) -> Column:
    """(W+ - W-) / (W+ + W-); 0 where no pair differs."""
    return F.when(w_plus + w_minus > 0, (w_plus - w_minus) / (w_plus + w_minus)).otherwise(F.lit(0.0))


def friedman_terms(columns: list[str]) -> list[Column]:
    """For each column its average rank within the row, and last the row's tie sum."""
    cs = [F.col(c) for c in columns]
    less = lambda a, b: (a < b).cast("double")
    ranks = [1 + sum((less(o, c) for o in cs if o is not c), F.lit(0.0)) + sum(((o == c).cast("double") / 2 for o in cs if o is not c), F.lit(0.0)) for c in cs]
    # t^3 - t over groups of equal values equals the sum over members of t^2 - 1
    size = [1 + sum(((o == c).cast("double") for o in cs if o is not c), F.lit(0.0)) for c in cs]
    return [*ranks, sum((t * t - 1 for t in size), F.lit(0.0))]


def friedman(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """``by``, n and the Friedman statistic over complete rows, corrected for ties."""
    k = len(columns)
    *ranks, ties = friedman_terms(columns)
    rows = df.select(*by, *[r.alias(f"_r{i}") for i, r in enumerate(ranks)], ties.alias("_t"))
    g = rows.groupBy(*by).agg(F.count("*").alias("n"), *[F.sum(f"_r{i}").alias(f"_r{i}") for i in range(k)], F.sum("_t").alias("_t"))
    n = F.col("n")
    top = F.lit(12.0) / (n * k * (k + 1)) * sum((F.col(f"_r{i}") ** 2 for i in range(k)), F.lit(0.0)) - 3 * n * (k + 1)
    c = 1 - F.col("_t") / (n * k * (k * k - 1))
    return g.select(*by, "n", F.when(c != 0, top / c).alias("statistic"))


def alpha_interval(df: DataFrame, value: str, item: list[str], by: list[str]) -> DataFrame:
    """``by`` and Krippendorff's alpha for interval data.

    The disagreement within items counts items with several ratings, the expected one all ratings,
    those of single-rated items included.  Both from sums and squares.
    """
    x = F.col(value).cast("double")
    g = df.where(F.col(value).isNotNull()).groupBy(*by, *item).agg(F.count("*").alias("_m"), F.sum(x).alias("_s"), F.sum(x * x).alias("_q"))
    several = F.col("_m") > 1
    g = g.groupBy(*by).agg(
        F.sum("_m").alias("_n"),
        F.sum("_s").alias("_s"),
        F.sum("_q").alias("_q"),
        F.sum(F.when(several, F.col("_m") * F.col("_q") - F.col("_s") ** 2)).alias("_d"),
        F.sum(F.when(several, F.col("_m") * (F.col("_m") - 1) / 2)).alias("_k"),
    )
    n = F.col("_n")
    do = F.col("_d") / F.col("_k")
    de = (n * F.col("_q") - F.col("_s") ** 2) / (n * (n - 1) / 2)
    return g.select(*by, n.alias("n_ratings"), F.when((n > 1) & (de > 0), 1 - do / de).alias("alpha"))


def chi_square(df: DataFrame, a: str, b: str, by: list[str], yates: bool = True) -> DataFrame:
    """``by``, statistic, dof and n of Pearson's test of independence; with one degree of freedom corrected
    for continuity, unless ``yates`` is off.  Without a degree of freedom the statistic is NULL."""
    cells = df.groupBy(*by, a, b).agg(F.count("*").alias("o"))
    rows, cols, n = cells.groupBy(*by, a).agg(F.sum("o").alias("r")), cells.groupBy(*by, b).agg(F.sum("o").alias("c")), cells.groupBy(*by).agg(F.sum("o").alias("n"))
    # sum of (O - E)^2 / E = n * (sum of O^2 / (r * c) - 1): empty cells need no row
    t = cells.join(rows, [*by, a]).join(cols, [*by, b]).groupBy(*by).agg(F.sum(F.col("o") * F.col("o") / (F.col("r") * F.col("c"))).alias("s"), F.count_distinct(a).alias("ka"), F.count_distinct(b).alias("kb"))
    out = t.join(n, by) if by else t.withColumn("n", n.scalar())
    dof, x = (F.col("ka") - 1) * (F.col("kb") - 1), F.col("n") * (F.col("s") - 1)
    if yates:  # of a table of two by two all cells are as far off: far^2 * sum of 1 / E
        inverse = [m.groupBy(*by).agg(F.sum(1 / F.col(c)).alias(f"_{c}")) for m, c in ((rows, "r"), (cols, "c"))]
        for m, c in zip(inverse, "rc"):
            out = out.join(m, by) if by else out.withColumn(f"_{c}", m.scalar())
        all_ = F.col("n") * F.col("_r") * F.col("_c")
        far = F.sqrt(F.greatest(x, F.lit(0.0)) / all_)
        x = F.when(dof == 1, (far - F.least(F.lit(0.5), far)) ** 2 * all_).otherwise(x)
    return out.select(*by, F.when(dof > 0, x).alias("statistic"), dof.alias("dof"), "n")


def chi_square_p(statistic: Column, dof: Column) -> Column:
    """p of Pearson's statistic, for the rows of a report; NULL without one."""

    @F.pandas_udf("double")
    def p(x: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) else chi2_sf(a, b) for a, b in zip(x, k)], dtype="float64")

    return p(statistic.cast("double"), dof.cast("double"))


def kendall_pairs(df: DataFrame, key: str, member: str, rank: str, by: list[str]) -> DataFrame:
    """tau-b of the rank vectors of each two keys in a group: ``by``, key_a, key_b, tau.

    Members are the fixed few that are ranked (families), so pairs of members are made of arrays
    within a row; of the keys (folds) each two are compared, which is the result itself.
    """
    v = df.groupBy(*by, key).agg(F.array_sort(F.collect_list(F.struct(member, rank))).alias("v"))  # as many as members
    a = v.select(*by, F.col(key).alias("key_a"), F.col(f"v.{rank}").alias("va"))
    b = v.select(*by, F.col(key).alias("key_b"), F.col(f"v.{rank}").alias("vb"))
    p = a.join(b, by).where("key_a < key_b")
    at = F.sequence(F.lit(0), F.size("va") - 1)
    both = F.flatten(F.transform(at, lambda i: F.transform(F.filter(at, lambda j: j > i), lambda j: F.struct(F.signum(F.get("va", i) - F.get("va", j)).alias("x"), F.signum(F.get("vb", i) - F.get("vb", j)).alias("y")))))
    p = p.withColumn("s", both)
    add = lambda f: F.aggregate("s", F.lit(0.0), lambda acc, s: acc + f(s))
    c, x, y = add(lambda s: s.x * s.y), add(lambda s: F.abs(s.x)), add(lambda s: F.abs(s.y))
    return p.select(*by, "key_a", "key_b", F.when((x > 0) & (y > 0), c / F.sqrt(x * y)).alias("tau"))


def holm(df: DataFrame, p: str, name: str, alpha: float = 0.05, step_down: bool = False) -> DataFrame:
    """Adds holm_rank, threshold and reject to a table of tests (one row each).

    Each p is judged against its own threshold; ``step_down`` stops at the first that isn't
    rejected, as the textbook procedure does.
    """
    w = W.orderBy(F.col(p).asc_nulls_last(), name)  # a report's rows, as many as hypotheses
    m = F.count("*").over(W.partitionBy())
    out = df.withColumn("holm_rank", F.row_number().over(w)).withColumn("threshold", F.lit(alpha) / (m - F.col("holm_rank") + 1))
    out = out.withColumn("reject", F.coalesce(F.col(p) < F.col("threshold"), F.lit(False)))
    return out.withColumn("reject", F.min("reject").over(w)) if step_down else out
