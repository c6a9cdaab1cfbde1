"""Likelihood-ratio tests and generalised linear models against plain optimisers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandtable.functions.numeric import digamma, trigamma
from strandtable.operators import matrix, statistics


@pytest.mark.parametrize("x", [1e-3, 0.4, 1.0, 7.3, 250.0, 1e8])
def test_polygamma(spark, x):
    got = spark.range(1).select(digamma(F.lit(x)).alias("d"), trigamma(F.lit(x)).alias("t")).first()
    h = x * 1e-4
    terms = np.arange(200_000) + x
    assert got.t == pytest.approx((1 / terms**2).sum() + 1 / (terms[-1] + 0.5), rel=1e-6)
    assert got.d == pytest.approx((math.lgamma(x + h) - math.lgamma(x - h)) / (2 * h), rel=1e-5, abs=1e-6)


def log_likelihood(y, mean, r):
    return sum(math.lgamma(a + r) - math.lgamma(r) - math.lgamma(a + 1) + (a * math.log(m / (r + m)) if a else 0.0) + r * math.log(r / (r + m)) for a, m in zip(y, mean, strict=True))


def best(f, lo, hi):
    """Maximum of a function of one variable by golden sections from the best of a grid."""
    grid = np.linspace(lo, hi, 200)
    k = int(np.argmax([f(x) for x in grid]))
    lo, hi = grid[max(k - 1, 0)], grid[min(k + 1, len(grid) - 1)]
    g = (math.sqrt(5) - 1) / 2
    for _ in range(80):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if f(a) > f(b) else (a, hi)
    return (lo + hi) / 2


def plain_test(y, s, g):
    levels = sorted(set(g))
    mean_at = lambda part, r: best(lambda b: log_likelihood([y[i] for i in part], [s[i] * math.exp(b) for i in part], r), -20, 10)
    parts = [[i for i in range(len(y)) if g[i] == x] for x in levels]

    def full(r):
        b = [mean_at(p, r) for p in parts]
        return b, sum(log_likelihood([y[i] for i in p], [s[i] * math.exp(x) for i in p], r) for p, x in zip(parts, b, strict=True))

    r = math.exp(best(lambda e: full(math.exp(e))[1], -6, 8))
    b, whole = full(r)
    one = mean_at(range(len(y)), r)
    return b, 1 / r, 2 * (whole - log_likelihood(y, [x * math.exp(one) for x in s], r))


def test_likelihood_ratio_of_features_by_plain_optimiser(spark):
    """Means, dispersion, statistic and p of overdispersed features at unequal size factors; two and three conditions."""
    rng = np.random.default_rng(2)
    base = rng.gamma(2.0, 60, size=40)
    depth = rng.uniform(0.6, 1.7, size=10)
    groups = ["A"] * 4 + ["B"] * 3 + ["C"] * 3
    counts = rng.negative_binomial(3, 3 / (3 + base[:, None] * depth[None, :]))
    counts[0, 4:7] *= 5
    counts[1, :4] = 0
    counts[2] = 0
    m = spark.createDataFrame([(i, j, float(counts[i, j])) for i in range(40) for j in range(10) if counts[i, j]] + [(2, 0, 0.0)], "feature int, sample int, value double")
    sheet = spark.createDataFrame(list(enumerate(groups)), "sample int, condition string")
    for levels in (["A", "B"], ["A", "B", "C"]):
        use = [j for j, c in enumerate(groups) if c in levels]
        got = {r.feature: r for r in statistics.nb_likelihood_ratio(m, sheet, levels).collect()}
        kept = m.join(sheet.where(F.col("condition").isin(levels)).select("sample"), "sample")
        factors = {r["sample"]: r.size_factor for r in matrix.size_factors(kept).collect()}
        assert 2 not in got and len(got) == 39
        for i in (0, 1, 5) if len(levels) == 2 else (0, 7):
            b, spread, lrt = plain_test([int(counts[i, j]) for j in use], [factors[j] for j in use], [groups[j] for j in use])
            p = math.erfc(math.sqrt(lrt / 2)) if len(levels) == 2 else math.exp(-lrt / 2)
            assert got[i].dispersion == pytest.approx(spread, rel=1e-3) and got[i].lrt == pytest.approx(lrt, rel=1e-4, abs=1e-6)
            assert got[i].pvalue == pytest.approx(p, rel=1e-3)
            if i != 1:
                assert got[i].log2FoldChange == pytest.approx((b[-1] - b[0]) / math.log(2), abs=1e-4)


def test_likelihood_ratio_without_overdispersion(spark):
    """Equal counts within groups: the dispersion goes to its least value and the test is Poisson's."""
    rows = [(f, j, v[j // 3]) for f, v in ((1, (20.0, 40.0)), (2, (30.0, 30.0)), (3, (40.0, 20.0))) for j in range(6)]
    sheet = spark.createDataFrame([(j, "ab"[j // 3]) for j in range(6)], "sample int, condition string")
    got = {r.feature: r for r in statistics.nb_likelihood_ratio(spark.createDataFrame(rows, "feature int, sample int, value double"), sheet, ["a", "b"]).collect()}
    want = 2 * 3 * (20 * math.log(20 / 30) + 40 * math.log(40 / 30))
    assert got[1].lrt == pytest.approx(want, rel=1e-3) and got[2].lrt == pytest.approx(0, abs=1e-9) and got[2].pvalue == 1.0
    assert got[1].log2FoldChange == pytest.approx(1.0) and got[3].log2FoldChange == pytest.approx(-1.0) and got[1].dispersion < 1e-5


def irls(y, groups, link, inverse, slope, variance, spread):
    """Coefficients, errors and p by reweighted least squares on dummy columns."""
    names = sorted(set(groups))
    x = np.array([[1.0, *[float(g == n) for n in names[1:]]] for g in groups])
    mean = np.full(len(y), y.mean())
    for _ in range(60):
        eta = link(mean)
        w = slope(mean) ** 2 / variance(mean)
        beta = np.linalg.solve(x.T @ (w[:, None] * x), x.T @ (w * (eta + (y - mean) / slope(mean))))
        mean = inverse(x @ beta)
    w = slope(mean) ** 2 / variance(mean)
    scale = ((y - mean) ** 2 / variance(mean)).sum() / (len(y) - len(names)) if spread else 1.0
    error = np.sqrt(np.diag(np.linalg.inv(x.T @ (w[:, None] * x))) * scale)
    return {n: (b, e, math.erfc(abs(b / e) / math.sqrt(2))) for n, b, e in zip(["Intercept", *names[1:]], beta, error, strict=True)}


def test_glm_of_many_responses_by_reweighted_least_squares(spark):
    """Four families and 300 levels, against fits on dummy columns."""
    rng = np.random.default_rng(12)
    few, many = [f"g{i % 3}" for i in range(240)], [f"h{i % 300:03d}" for i in range(240 * 5)]
    level = np.array([int(g[1]) for g in few])
    data = {"gaussian": rng.normal(level, 2), "poisson": rng.poisson(2 + level).astype(float), "binomial": (rng.random(240) < 0.3 + 0.15 * level).astype(float), "gamma": rng.gamma(3, 1 + level)}
    same = lambda m: np.ones_like(m)
    forms = {
        "gaussian": (lambda m: m, lambda e: e, same, same, True), "poisson": (np.log, np.exp, lambda m: m, lambda m: m, False),
        "binomial": (lambda m: np.log(m / (1 - m)), lambda e: 1 / (1 + np.exp(-e)), lambda m: m * (1 - m), lambda m: m * (1 - m), False), "gamma": (lambda m: 1 / m, lambda e: 1 / e, lambda m: -(m**2), lambda m: m**2, True),
    }
    for family, y in data.items():
        df = spark.createDataFrame([(g, float(v), 0.0) for g, v in zip(few, y, strict=True)] + [(None, 9.0, 0.0), ("g1", None, 0.0)], "g string, y double, nothing double")
        got = {r.level: r for r in statistics.fit_glm(df, ["y", "nothing"], "g", family).collect()}
        want = irls(y, few, *forms[family])
        assert set(got) == set(want) and {r.baseline for r in got.values()} == {"g0"}
        for n, (b, e, p) in want.items():
            assert (got[n].coefficient, got[n].error, got[n].pvalue) == (pytest.approx(b, rel=1e-6), pytest.approx(e, rel=1e-6), pytest.approx(p, rel=1e-4, abs=1e-9))
    y = rng.normal(size=len(many))
    got = {r.level: r for r in statistics.fit_glm(spark.createDataFrame(list(zip(many, map(float, y), strict=True)), "g string, y double"), ["y"], "g").collect()}
    want = irls(y, many, *forms["gaussian"])
    assert len(got) == 300 and all(got[n].pvalue == pytest.approx(p, rel=1e-4, abs=1e-9) for n, (_, _, p) in want.items())
