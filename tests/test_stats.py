from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import stats, tails

CASES = [
    [(1, 1)], [(1, 5)], [(3, 3)] * 5, [(1, 2), (2, 2), (5, 4), (3, 3), (4, 5)], [(1, 3), (3, 1), (5, 5), (5, 1)],
    *[[(random.Random(s).randrange(1, 6), random.Random(s * 7 + i).randrange(1, 6)) for i in range(40)] for s in range(3)],
]


def kappa(pairs, levels, weight):
    n = len(pairs)
    idx = {k: i for i, k in enumerate(levels)}
    o = np.zeros((len(levels),) * 2)
    for a, b in pairs:
        o[idx[a], idx[b]] += 1 / n
    w = np.array([[weight(i, j) for j in range(len(levels))] for i in range(len(levels))])
    e = np.outer(o.sum(1), o.sum(0))
    return None if abs((w * e).sum()) < 1e-12 else 1 - (w * o).sum() / (w * e).sum()


def frame(spark, pairs):
    return spark.createDataFrame([("g", a, b) for a, b in pairs], "g string, x int, y int")


def same(got, want):
    assert (got is None) == (want is None) and (got is None or got == pytest.approx(want, abs=1e-9))


@pytest.mark.parametrize("pairs", CASES)
def test_kappas(spark, pairs):
    df = frame(spark, pairs)
    x, y = F.col("x"), F.col("y")
    r = df.groupBy("g").agg(stats.qwk(x, y).alias("q"), stats.linear_kappa(x, y).alias("l"), stats.cohen_kappa(x, y, [1, 2, 3, 4, 5]).alias("c")).first()
    same(r.q, kappa(pairs, range(1, 6), lambda i, j: (i - j) ** 2))
    same(r.l, kappa(pairs, range(1, 6), lambda i, j: abs(i - j)))
    same(r.c, kappa(pairs, range(1, 6), lambda i, j: i != j))
    used = sorted({v for p in pairs for v in p})
    i = stats.index_pairs(df, "x", "y", ["g"]).groupBy("g").agg(stats.qwk(x, y).alias("q")).first()
    same(i.q, kappa(pairs, used, lambda i, j: (i - j) ** 2))


def ranks(v):
    return [sum(b < a for b in v) + (sum(b == a for b in v) + 1) / 2 for a in v]


@pytest.mark.parametrize("pairs", CASES)
def test_icc_and_rho(spark, pairs):
    r = frame(spark, pairs).groupBy("g").agg(stats.icc21(F.col("x"), F.col("y")).alias("i")).first()
    n = len(pairs)
    if n > 1:
        m = np.array(pairs, float)
        gm = m.mean()
        ms_t = 2 * ((m.mean(1) - gm) ** 2).sum() / (n - 1)
        ms_c = n * ((m.mean(0) - gm) ** 2).sum()
        ms_e = ((m - m.mean(1, keepdims=True) - m.mean(0) + gm) ** 2).sum() / (n - 1)
        d = ms_t + ms_e + 2 * (ms_c - ms_e) / n
        same(r.i, None if abs(d) < 1e-12 else (ms_t - ms_e) / d)
    s = stats.spearman(frame(spark, pairs), "x", "y", ["g"]).first()
    a, b = ranks([p[0] for p in pairs]), ranks([p[1] for p in pairs])
    same(s.spearman_r, None if len(set(a)) < 2 or len(set(b)) < 2 else float(np.corrcoef(a, b)[0, 1]))


def test_average_rank(spark):
    v = [3, 1, 3, None, 2, 1]
    got = stats.average_rank(spark.createDataFrame([("g", x) for x in v], "g string, v int"), "v", ["g"], "r").collect()
    want = dict(zip([x for x in v if x], ranks([x for x in v if x])))
    assert all(r.r == want.get(r.v) for r in got) and len(got) == 6


@pytest.mark.parametrize("zeros", ["wilcox", "pratt", "zsplit"])
def test_signed_ranks(spark, zeros):
    d = [0.0, 1.0, -1.0, 2.0, 0.0, 3.0, -2.0, 1.0]
    r = stats.signed_ranks(spark.createDataFrame([("g", x) for x in d], "g string, d double"), "d", ["g"], zeros).first()
    use = [x for x in d if x] if zeros == "wilcox" else d
    rk = ranks([abs(x) for x in use])
    half = sum(q for x, q in zip(use, rk) if x == 0) / 2 if zeros == "zsplit" else 0
    assert r.w_plus == sum(q for x, q in zip(use, rk) if x > 0) + half and r.w_minus == sum(q for x, q in zip(use, rk) if x < 0) + half
    assert (r.n, r.n_nonzero, r.n_zero) == (8, 6, 2)


def test_friedman(spark):
    rows = [(1, 2, 3), (2, 2, 1), (5, 5, 5), (3, 1, 2), (1, 1, 2)]
    got = stats.friedman(spark.createDataFrame([("g", *r) for r in rows], "g string, a int, b int, c int"), ["a", "b", "c"], ["g"]).first()
    rk = np.array([ranks(r) for r in rows])
    n, k = rk.shape
    ties = sum(t**3 - t for r in rows for t in [list(r).count(v) for v in set(r)])
    want = (12 / (n * k * (k + 1)) * (rk.sum(0) ** 2).sum() - 3 * n * (k + 1)) / (1 - ties / (n * k * (k * k - 1)))
    assert got.statistic == pytest.approx(want) and got.n == 5


def test_kendall(spark):
    r = random.Random(1)
    v = {f: [r.randrange(1, 6) for _ in range(8)] for f in range(3)}
    df = spark.createDataFrame([("g", f, m, x) for f, xs in v.items() for m, x in enumerate(xs)], "g string, fold int, fam int, rank int")
    got = {(x.key_a, x.key_b): x.tau for x in stats.kendall_pairs(df, "fold", "fam", "rank", ["g"]).collect()}
    for a, b in itertools.combinations(v, 2):
        s = [(np.sign(v[a][i] - v[a][j]), np.sign(v[b][i] - v[b][j])) for i, j in itertools.combinations(range(8), 2)]
        assert got[a, b] == pytest.approx(sum(x * y for x, y in s) / math.sqrt(sum(abs(x) for x, _ in s) * sum(abs(y) for _, y in s)))


def test_alpha_counts_single_ratings_as_expected(spark):
    items = [(1, 2), (3, 3), (5,), (2, 4, 4)]
    df = spark.createDataFrame([("g", i, v) for i, vs in enumerate(items) for v in vs], "g string, i int, v int")
    pairs = [(a - b) ** 2 for vs in items for a, b in itertools.combinations(vs, 2)]
    flat = [v for vs in items for v in vs]
    every = [(a - b) ** 2 for a, b in itertools.combinations(flat, 2)]
    assert stats.alpha_interval(df, "v", ["i"], ["g"]).first().alpha == pytest.approx(1 - np.mean(pairs) / np.mean(every))


def test_chi_square(spark):
    t = {("a", "x"): 10, ("a", "y"): 3, ("b", "x"): 2, ("b", "y"): 9, ("c", "x"): 5}
    df = spark.createDataFrame([("g", *k) for k, n in t.items() for _ in range(n)], "g string, a string, b string")
    got = stats.chi_square(df, "a", "b", ["g"]).first()
    o = np.array([[10, 3], [2, 9], [5, 0]], float)
    e = np.outer(o.sum(1), o.sum(0)) / o.sum()
    assert got.statistic == pytest.approx(((o - e) ** 2 / e).sum()) and (got.dof, got.n) == (2, 29)


def test_holm(spark):
    df = spark.createDataFrame([("a", 1.4e-68), ("b", 0.88), ("c", 0.04), ("d", None)], "t string, p double")
    got = {r.t: (r.holm_rank, r.threshold, r.reject) for r in stats.holm(df, "p", "t").collect()}
    assert got["a"] == (1, 0.05 / 4, True) and got["b"][2] is False and got["d"][2] is False
    two = spark.createDataFrame([("a", 0.03), ("b", 0.04)], "t string, p double")
    assert [r.reject for r in stats.holm(two, "p", "t").orderBy("t").collect()] == [False, True]
    assert [r.reject for r in stats.holm(two, "p", "t", step_down=True).orderBy("t").collect()] == [False, False]


def test_half_even_and_nulls(spark):
    df = spark.createDataFrame([(0.2,), (1.5,), (2.5,), (3.5,), (9.0,), (None,)], "x double")
    assert [r[0] for r in df.select(stats.clip_round(F.col("x"))).collect()] == [1, 2, 2, 4, 5, None]


def test_golden_values():
    total = 341 * 342 / 2
    assert (2 * 57750 - total) / total == pytest.approx(0.980758, abs=1e-6)
    total = 322 * 323 / 2
    assert abs((2 * 490.5 - total) / total) == pytest.approx(0.981136, abs=1e-6)
    assert tails.chi2_sf(334.859, 2) == pytest.approx(1.93327e-73, rel=1e-4)
    assert tails.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05) and tails.chi2_sf(0, 3) == 1
    assert tails.chi2_sf(18.307038053275146, 10) == pytest.approx(0.05)
    assert tails.wilcoxon_p(0, 0, 0, 0) is None and tails.wilcoxon_p(10, 27.5, 27.5, 0) == pytest.approx(1)


def test_nothing_gives_nothing(spark):
    e = spark.createDataFrame([], "g string, x int, y int")
    assert stats.spearman(e, "x", "y", ["g"]).collect() == stats.signed_ranks(e.withColumn("d", F.col("x").cast("double")), "d", ["g"]).collect() == []


def test_chi_square_is_corrected_with_one_degree_of_freedom(spark):
    rows = [("p", "x")] * 12 + [("p", "y")] * 5 + [("q", "x")] * 3 + [("q", "y")] * 9
    df = spark.createDataFrame(rows, "a string, b string")
    e = [17 * 15 / 29, 17 * 14 / 29, 12 * 15 / 29, 12 * 14 / 29]
    o = [12, 5, 3, 9]
    plain = sum((x - y) ** 2 / y for x, y in zip(o, e))
    got = [stats.chi_square(df, "a", "b", [], yates=y).first().statistic for y in (False, True)]
    assert got[0] == pytest.approx(plain) and got[1] == pytest.approx(sum((abs(x - y) - 0.5) ** 2 / y for x, y in zip(o, e)))
    p = df.limit(1).select(stats.chi_square_p(F.lit(3.841459), F.lit(1)), stats.chi_square_p(F.lit(None).cast("double"), F.lit(0))).first()
    assert p[0] == pytest.approx(0.05, abs=1e-6) and p[1] is None
