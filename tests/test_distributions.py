"""Distribution helpers and chart constants against published values."""

import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from procstats.functions import constants, dist
from procstats.functions.normal import norm_cdf, with_norm_ppf


@pytest.mark.parametrize("value,expected,tol", [
    (dist.t_ppf(0.975, 10), 2.228138852, 1e-7), (dist.t_ppf(0.995, 4), 4.604094871, 1e-7), (dist.chi2_ppf(0.95, 3), 7.814727903, 1e-7),
    (dist.chi2_ppf(0.05, 10), 3.940299136, 1e-7), (dist.f_ppf(0.95, 3, 12), 3.490294819, 1e-6), (dist.f_ppf(0.95, 5, 10), 3.325834530, 1e-6),
    (dist.binom_cdf(3, 10, 0.5), 0.171875, 1e-12), (dist.poisson_cdf(2, 3.0), 0.42319008112684, 1e-10),
    (dist.tukey_ppf(0.95, 3, 12), 3.773, 2e-3), (dist.tukey_ppf(0.95, 4, 20), 3.958, 2e-3), (dist.tukey_ppf(0.95, 5, 60), 3.977, 3e-3),
    (dist.t_sf2(5.0, 8), 0.001052826, 1e-8), (dist.dunnett_ppf(0.95, 3, 0.5, 20), 2.54, 6e-3), (dist.kolmogorov_sf(1.3581), 0.05, 1e-4),
    (dist.chi2_sf(4.0, 1), 0.04550026, 1e-7), (dist.gamma_cdf(2.5, 2.0), 1 - 3.5 * math.exp(-2.5), 1e-12),
])
def test_published(value, expected, tol):
    assert float(value) == pytest.approx(expected, abs=tol)


def test_exact_two_sided_binomial_matches_enumeration():
    for k, n, p in [(3, 10, 0.5), (0, 12, 0.2), (9, 10, 0.35), (5, 30, 0.3), (20, 30, 0.3), (30, 30, 0.9)]:
        pm = [math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(n + 1)]
        want = min(1.0, sum(v for v in pm if v <= pm[k] * (1 + 1e-9)))
        assert float(dist.binom_test_two_sided(k, n, p)) == pytest.approx(want, abs=1e-9)


def test_fisher():
    assert dist.fisher_two_sided(3, 1, 1, 3)[0] == pytest.approx(0.4857142857, abs=1e-9)
    assert dist.fisher_greater(3, 1, 1, 3)[0] == pytest.approx(0.2428571429, abs=1e-9)


def test_median_rank():
    def brute(n, conf):
        k = 0
        for i in range(1, n // 2 + 1):
            if 2 * float(dist.binom_cdf(i - 1, n, 0.5)) > 1 - conf:
                break
            k = i
        return max(k, 1)
    for n in (6, 10, 25, 60):
        assert float(dist.median_ci_rank(np.array([n]), np.array([0.95]))[0]) == brute(n, 0.95)


@pytest.mark.parametrize("n,d2,c4,a2,d4,b4", [(2, 1.128, 0.7979, 1.880, 3.267, 3.267), (5, 2.326, 0.9400, 0.577, 2.114, 2.089), (10, 3.078, 0.9727, 0.308, 1.777, 1.716)])
def test_chart_constants(n, d2, c4, a2, d4, b4):
    k = constants.chart_constants(n)
    assert k["d2"] == pytest.approx(d2, abs=1e-3) and k["c4"] == pytest.approx(c4, abs=1e-4)
    assert k["A2"] == pytest.approx(a2, abs=1e-3) and k["D4"] == pytest.approx(d4, abs=1e-3) and k["B4"] == pytest.approx(b4, abs=1e-3)


def test_normal_expressions(spark):
    nd = NormalDist()
    zs = [-8.0, -7.2, -3.3, -1.0, 0.0, 0.4, 2.2, 6.0]
    df = spark.createDataFrame([(z,) for z in zs], "z double").withColumn("p", norm_cdf(F.col("z")))
    for row in df.collect():
        assert row["p"] == pytest.approx(0.5 * math.erfc(-row["z"] / math.sqrt(2)), rel=1e-9)
    ps = [1e-12, 1e-4, 0.02, 0.3, 0.5, 0.77, 0.999, 1 - 1e-9]
    out = with_norm_ppf(spark.createDataFrame([(p,) for p in ps], "p double"), "z", F.col("p")).collect()
    for row in out:
        assert row["z"] == pytest.approx(nd.inv_cdf(row["p"]), abs=1e-9)


def test_apply_passes_nulls(spark):
    df = spark.createDataFrame([(1.0, 1.0), (None, 5.0)], "t double, d double").select(dist.apply(dist.t_sf2, F.col("t"), F.col("d")).alias("p"))
    a, b = (r["p"] for r in df.collect())
    assert a == pytest.approx(0.5, abs=1e-12) and b is None
