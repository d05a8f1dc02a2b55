"""Distributed operators against plain sequential loops on random series."""

import math
import random
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from procstats.operators import columns as K
from procstats.operators import control as S
from procstats.operators import describe as D
from procstats.operators import fitting as N
from procstats.operators import hypothesis as H
from procstats.operators import multivariate as M
from procstats.operators import rows as R
from procstats.operators import timeseries as T
from procstats.plans import ordering


def loop_rules(z, v):
    """Flag sets by sliding windows over a series without missing values."""
    n = len(z)
    flags = [set() for _ in range(n)]

    def windows(k, rule, ok):
        for i in range(n - k + 1):
            if ok(i, i + k):
                for j in range(i, i + k):
                    flags[j].add(rule)
    for i in range(n):
        if abs(z[i]) > 3:
            flags[i].add(1)
    windows(9, 2, lambda a, b: all(x > 0 for x in z[a:b]) or all(x < 0 for x in z[a:b]))
    windows(6, 3, lambda a, b: all(v[i] < v[i + 1] for i in range(a, b - 1)) or all(v[i] > v[i + 1] for i in range(a, b - 1)))
    windows(14, 4, lambda a, b: all((v[i + 1] - v[i]) * (v[i + 2] - v[i + 1]) < 0 for i in range(a, b - 2)))
    windows(15, 7, lambda a, b: all(abs(x) < 1 for x in z[a:b]))
    windows(8, 8, lambda a, b: all(abs(x) > 1 for x in z[a:b]))
    for k, need, lim, rule in ((3, 2, 2, 5), (5, 4, 1, 6)):
        for sign in (1, -1):
            for i in range(n - k + 1):
                hit = [j for j in range(i, i + k) if sign * z[j] > lim]
                if len(hit) >= need:
                    for j in hit:
                        flags[j].add(rule)
    return [sorted(f) for f in flags]


def test_run_rules(spark):
    rnd = random.Random(5)
    rows, want = [], {}
    for s in range(12):
        scale = rnd.choice([0.4, 1.0, 1.6])
        v, level = [], 0.0
        for i in range(150):
            level = 0.9 * level + rnd.gauss(0, 0.3)
            v.append(round(scale * rnd.gauss(0, 1) + level + (1.3 * (-1) ** i if s % 4 == 0 else 0), 1))
        want[s] = loop_rules(v, v)
        rows += [(s, i + 1, x, 0.0, 1.0) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "s int, point long, value double, cl double, sigma double").repartition(7)
    got = {s: {} for s in want}
    for r in S.run_rules(df, ["s"], rules=range(1, 9)).collect():
        got[r["s"]][r["point"]] = r["violations"]
    assert {s: [got[s][i + 1] for i in range(150)] for s in want} == want


@pytest.mark.parametrize("weight", [0.2, 0.9, 1.0, 0.01])
def test_ewma(values, weight):
    xs = list(np.random.default_rng(3).normal(10, 2, 700))
    out = S.ewma_chart(values(xs), "x", ["id"], weight=weight, mu=10.0, sigma=2.0).orderBy("point").collect()
    z = 10.0
    for x, r in zip(xs, out):
        z = weight * x + (1 - weight) * z
        assert r["value"] == pytest.approx(z, rel=1e-9)


def test_cusum(values):
    xs = list(np.random.default_rng(4).normal(0.2, 1, 500))
    out = S.cusum_chart(values(xs), "x", ["id"], target=0.0, sigma=1.0).orderBy("point").collect()
    up = dn = 0.0
    for x, r in zip(xs, out):
        up, dn = max(0.0, up + x - 0.5), max(0.0, dn - x - 0.5)
        assert r["value"] == pytest.approx(up, abs=1e-9) and r["value_low"] == pytest.approx(-dn, abs=1e-9)


def test_charts_do_not_depend_on_partitioning(values):
    xs = list(np.random.default_rng(8).normal(0, 1, 300))
    key = lambda df: sorted((r["panel"], r["point"], tuple(r["violations"])) for r in df.collect())
    a = S.individuals_chart(values(xs), "x", ["id"])
    b = S.individuals_chart(values(xs).repartition(9).orderBy(F.rand(3)), "x", ["id"])
    assert key(a) == key(b)


def test_lag_crosses_blocks(values):
    out = K.lag(values(range(200)), "x", 40, ["id"]).orderBy("id").collect()
    assert [r["x_lag40"] for r in out] == [None] * 40 + [float(i) for i in range(160)]


def test_sequence_and_quantiles(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice("aab"), rnd.randrange(30) / 4, i) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, x double, id long").repartition(5)
    numbered = ordering.sequence(df, ["g"], ["id"], "rn", "n").collect()
    for g in "ab":
        ids = sorted(r[2] for r in rows if r[0] == g)
        assert sorted((r["rn"], r["id"]) for r in numbered if r["g"] == g) == list(enumerate(ids, 1))
    q = {r["g"]: r for r in ordering.quantiles(df, "x", {"a6": (0.25, 6), "b7": (0.9, 7), "lo": (0.0, 6), "hi": (1.0, 7)}, ["g"]).collect()}
    for g in "ab":
        s = sorted(r[1] for r in rows if r[0] == g)
        h = (len(s) + 1) * 0.25
        k = math.floor(h)
        assert q[g]["a6"] == pytest.approx(s[k - 1] + (h - k) * (s[k] - s[k - 1])) and q[g]["b7"] == pytest.approx(np.quantile(s, 0.9))
        assert (q[g]["lo"], q[g]["hi"]) == (s[0], s[-1])


@pytest.mark.parametrize("limit", [100_000, 3])
def test_pairwise_medians(spark, groups, monkeypatch, limit):
    monkeypatch.setattr(H, "SUM_ROWS", limit)
    rng = np.random.default_rng(6)
    a, b = np.round(rng.gamma(2, 2, 41), 1), np.round(rng.gamma(2, 2.5, 36), 1)
    r = H.mann_whitney(groups({"a": a, "b": b}), "x", "g", ["a", "b"]).first()
    assert r["hodges_lehmann"] == pytest.approx(np.median([x - y for x in a for y in b]), abs=1e-9)
    x = a[a != 3.0] - 3.0
    w = H.wilcoxon_signed(groups({"a": a}), "x", 3.0).first()
    walsh = [(x[i] + x[j]) / 2 for i in range(len(x)) for j in range(i, len(x))]
    assert w["hodges_lehmann"] == pytest.approx(np.median(walsh) + 3, abs=1e-9)


def test_medians_of_sums_per_group(spark, monkeypatch):
    """Groups of any scale in one call: outliers, one value, sums that are all equal, an even gap, a NULL key, one side missing."""
    monkeypatch.setattr(H, "SUM_ROWS", 3)
    rng = np.random.default_rng(16)
    x = {"outlier": [1e20, *rng.normal(0, 1, 20)], "tiny": rng.normal(0, 1e-15, 15), "one": [0.1], "zero": np.arange(9) / 10,
         "gap": [0.0, 0.0, 5.0, 5.0], None: rng.integers(-4, 9, 30) / 8, "alone": [1.0], "wide": 10.0 ** rng.uniform(-12, 12, 25)}
    y = {"outlier": [-1e20, *rng.normal(3, 1, 17)], "tiny": rng.normal(0, 1e-15, 16), "one": [0.2], "zero": -np.arange(9) / 10,
         "gap": [0.0, 100.0], None: rng.integers(-4, 9, 21) / 8, "none": [2.0], "wide": -10.0 ** rng.uniform(-12, 12, 25)}
    table = lambda t: spark.createDataFrame([(k, float(v)) for k, vs in t.items() for v in vs], "g string, _x double").repartition(3)
    got = {r["g"]: r["median"] for r in H.median_of_sums(table(x), table(y), ["g"]).collect()}
    want = {k: np.median(np.add.outer(x[k], y[k])) for k in x.keys() & y.keys()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-12, abs=1e-27 if k == "tiny" else 1e-13) for k in want)
    got = {r["g"]: r["median"] for r in H.median_of_sums(table(x), table(x), ["g"], walsh=True).collect()}
    for k, v in x.items():
        assert got[k] == pytest.approx(np.median([(v[i] + v[j]) / 2 for i in range(len(v)) for j in range(i, len(v))]), rel=1e-12, abs=1e-27 if k == "tiny" else 1e-13)
    assert H.median_of_sums(table(x).where("false"), table(y), []).count() == 0


def test_kendall_and_spearman(spark):
    rng = np.random.default_rng(7)
    x, y = rng.integers(0, 12, 90), rng.integers(0, 9, 90)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    con = dis = tx = ty = 0
    for i in range(90):
        for j in range(i):
            a, b = x[i] - x[j], y[i] - y[j]
            con, dis, tx, ty = con + (a * b > 0), dis + (a * b < 0), tx + (a == 0), ty + (b == 0)
    n0 = 90 * 89 / 2
    k = M.kendall(df, "x", "y").first()
    assert (k["concordant"], k["discordant"]) == (con, dis) and k["tau"] == pytest.approx((con - dis) / math.sqrt((n0 - tx) * (n0 - ty)))
    rank = lambda v: np.array([(v < q).sum() + ((v == q).sum() + 1) / 2 for q in v])
    want = np.corrcoef(rank(x), rank(y))[0, 1]
    assert M.spearman(df, "x", "y").first()["r"] == pytest.approx(want)
    gaps = df.withColumn("x", F.when(F.rand(1) > 0, F.col("x")))
    assert M.correlation_matrix(gaps, ["x", "y"], "spearman").first()["r"] == pytest.approx(want)


def test_anderson_darling_ryan_joiner_shapiro(values):
    rng = np.random.default_rng(9)
    x = np.sort(np.round(rng.normal(5, 2, 60), 1))
    nd, n, m, s = NormalDist(), 60, x.mean(), x.std(ddof=1)
    p = np.array([nd.cdf((v - m) / s) for v in x])
    a2 = -n - np.sum((2 * np.arange(1, n + 1) - 1) * (np.log(p) + np.log(1 - p[::-1]))) / n
    assert N.anderson_darling(values(x), "x").first()["a2"] == pytest.approx(a2)
    b = np.array([nd.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    assert N.ryan_joiner(values(x), "x").first()["r"] == pytest.approx(np.corrcoef(x, b)[0, 1])
    u = 1 / math.sqrt(n)
    c = b / math.sqrt((b * b).sum())
    an = np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, c[-1]], u)
    an1 = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, c[-2]], u)
    phi = ((b * b).sum() - 2 * b[-1] ** 2 - 2 * b[-2] ** 2) / (1 - 2 * an**2 - 2 * an1**2)
    w = np.concatenate([[-an, -an1], b[2:-2] / math.sqrt(phi), [an1, an]])
    r = N.shapiro_wilk(values(x), "x").first()
    assert r["w"] == pytest.approx((w @ x) ** 2 / ((x - m) ** 2).sum()) and 0.05 < r["p_value"] <= 1


def test_normality_error_rate(spark):
    """About 5 % of normal samples are rejected by each test."""
    rng = np.random.default_rng(11)
    rows = [(s, float(x)) for s in range(400) for x in rng.normal(0, 1, 25)]
    df = spark.createDataFrame(rows, "s int, x double")
    for fn in (N.anderson_darling, N.shapiro_wilk, N.ryan_joiner):
        rate = fn(df, "x", ["s"]).agg(F.avg((F.col("p_value") < 0.05).cast("double"))).first()[0]
        assert 0.02 <= rate <= 0.09, fn.__name__


def test_parameter_recovery(values):
    rng = np.random.default_rng(12)
    w = N.fit(values(rng.weibull(1.8, 4000) * 50), "x", "weibull").first()
    assert w["p1"] == pytest.approx(1.8, rel=0.05) and w["p2"] == pytest.approx(50, rel=0.05)
    g = N.fit(values(rng.gamma(3.0, 2.0, 4000)), "x", "gamma").first()
    assert g["p1"] == pytest.approx(3, rel=0.1) and g["p1"] * g["p2"] == pytest.approx(6, rel=0.05)
    lam = N.box_cox_lambda(values(np.exp(rng.normal(1, 0.5, 1500))), "x").first()["lambda"]
    assert abs(lam) < 0.15
    best = N.identify_distribution(values(np.exp(rng.normal(1, 0.5, 800))), "x").first()
    assert best["family"] in ("lognormal", "gamma")


def test_johnson_normalises(values):
    rng = np.random.default_rng(13)
    fit = N.johnson(values(np.sinh(rng.normal(0, 1, 400)) * 3 + 10), "x").first()
    assert fit["p_value"] > 0.05


def test_smoothers(values):
    rng = np.random.default_rng(14)
    y = 50 + 0.3 * np.arange(150) + 5 * np.sin(np.arange(150) * 2 * np.pi / 7) + rng.normal(0, 1, 150)
    fit = lambda **k: [r["fitted"] for r in T.smooth(values(y), "x", ["id"], **k)["fitted"].orderBy("t").collect()]
    level, trend, want = y[0], y[1] - y[0], [y[0]]
    for v in y[1:]:
        f = level + trend
        want.append(f)
        new = 0.3 * v + 0.7 * f
        trend, level = 0.2 * (new - level) + 0.8 * trend, new
    assert fit(kind="holt", alpha=0.3, beta=0.2) == pytest.approx(want)
    for mult in (False, True):
        m1, m2 = y[:7].mean(), y[7:14].mean()
        seas = [v / m1 if mult else v - m1 for v in y[:7]]
        level, trend, want = m1, (m2 - m1) / 7, []
        for i, v in enumerate(y):
            s = seas[i % 7]
            want.append((level + trend) * s if mult else level + trend + s)
            new = 0.2 * (v / s if mult else v - s) + 0.8 * (level + trend)
            seas[i % 7] = 0.1 * (v / new if mult else v - new) + 0.9 * s
            trend, level = 0.1 * (new - level) + 0.9 * trend, new
        out = T.smooth(values(y), "x", ["id"], kind="holt-winters", period=7, horizon=1, multiplicative=mult)
        got = [r["fitted"] for r in out["fitted"].orderBy("t").collect()]
        assert got[:7] == [None] * 7 and got[7:] == pytest.approx(want[7:])
        s = seas[150 % 7]
        assert out["forecast"].first()["fit"] == pytest.approx((level + trend) * s if mult else level + trend + s)


def test_holt_search_finds_the_grid_minimum(values):
    rng = np.random.default_rng(15)
    y = np.cumsum(rng.normal(0.5, 1, 80)) + 20

    def msd(a, b):
        level, trend, e = y[0], y[1] - y[0], [0.0]
        for v in y[1:]:
            f = level + trend
            e.append(v - f)
            new = a * v + (1 - a) * f
            trend, level = b * (new - level) + (1 - b) * trend, new
        return np.mean(np.square(e))
    grid = [round(0.05 + 0.05 * i, 3) for i in range(19)]
    best = min(((msd(a, b), a, b) for a in grid for b in grid))
    r = T.smooth(values(y), "x", ["id"], kind="holt")["parameters"].first()
    assert (r["alpha"], r["beta"]) == (best[1], best[2])


def test_pacf_of_an_ar1(values):
    rng = np.random.default_rng(16)
    y = [0.0]
    for e in rng.normal(0, 1, 1500):
        y.append(0.7 * y[-1] + e)
    p = [r["pacf"] for r in T.pacf(values(y), "x", ["id"], 4).orderBy("lag").collect()]
    assert p[0] == pytest.approx(0.7, abs=0.08) and max(map(abs, p[1:])) < 0.1


def test_expand_ties_of_a_hot_value(spark, monkeypatch):
    monkeypatch.setattr(D, "TIE_PIECE", 10)
    df = spark.createDataFrame([(1.0,)] * 45 + [(2.0,)] * 3, "x double")
    out = D.ecdf(df, "x").orderBy("i").collect()
    assert [r["i"] for r in out] == list(range(1, 49)) and [r["x"] for r in out] == [1.0] * 45 + [2.0] * 3


def test_bootstrap_interval_is_close_to_theory(values):
    x = np.random.default_rng(17).normal(100, 10, 400)
    r = D.bootstrap_interval(values(x), "x", ["id"], replicates=500).first()
    half = 1.96 * x.std(ddof=1) / 20
    assert r["estimate"] == pytest.approx(x.mean()) and (r["upper"] - r["lower"]) / 2 == pytest.approx(half, rel=0.2)


def test_sampling(values):
    a = R.sample_rows(values(range(500)), 37, ["id"], 4).collect()
    b = R.sample_rows(values(range(500)).repartition(6), 37, ["id"], 4).collect()
    assert len(a) == 37 and a == b and [r["id"] for r in a] == sorted(r["id"] for r in a)


def test_broadcast_bound_falls_back(spark, values):
    spark.conf.set("spark.procstats.broadcastRows", "0")
    try:
        out = K.standardize(values([1, 2, 3, 4]).withColumn("g", F.lit("a")), "x", by=["g"])
        assert out.count() == 4
        assert K.average_rank(values([5, 5, 1]), "x").orderBy("id").select("rank").collect()[0][0] == 2.5
    finally:
        spark.conf.unset("spark.procstats.broadcastRows")


def test_pca_recovers_structure(spark):
    rng = np.random.default_rng(18)
    t = rng.normal(0, 1, 300)
    df = spark.createDataFrame([(i, float(a), float(2 * a + b), float(c)) for i, (a, b, c) in enumerate(zip(t, rng.normal(0, 0.1, 300), rng.normal(0, 1, 300)))],
                               "id long, a double, b double, c double")
    c = M.pca(df, ["a", "b", "c"])
    first = c.orderBy("component").first()
    assert first["pct"] > 60 and abs(first["loadings"][2]) < 0.2
    s = M.pca_scores(df, ["a", "b", "c"], c, ["id"])
    assert s.agg(F.var_samp("pc1")).first()[0] == pytest.approx(first["eigenvalue"], rel=1e-6)


def test_hot_group(spark):
    """One key holding most rows gives the same statistics as separate loops."""
    rng = np.random.default_rng(19)
    rows = [("hot" if i % 10 else f"k{i % 70}", i, float(v)) for i, v in enumerate(np.round(rng.exponential(5, 3000), 1))]
    df = spark.createDataFrame(rows, "g string, id long, x double")
    out = {r["g"]: r for r in D.describe(df, "x", ["g"], intervals=False).collect()}
    xs = np.sort([x for g, _, x in rows if g == "hot"])
    assert out["hot"]["n"] == len(xs) and out["hot"]["median"] == pytest.approx(np.median(xs))
    cut = int(len(xs) * 0.05)
    assert out["hot"]["trimmed_mean"] == pytest.approx(xs[cut:len(xs) - cut].mean())
    assert out["hot"]["mad"] == pytest.approx(1.4826 * np.median(np.abs(xs - np.median(xs))))


def test_bracketed_quantiles(spark, monkeypatch):
    """Large groups take the bracketing path, a hot value and a small group included."""
    rng = np.random.default_rng(20)
    xs = np.round(np.concatenate([rng.exponential(5, 6000), np.full(3000, 2.5)]), 3)
    df = spark.createDataFrame([("a", float(x)) for x in xs] + [("b", float(x)) for x in xs[:50]], "g string, x double").repartition(6)
    wanted = {"q1": (0.25, 6), "m": (0.5, 7), "q9": (0.95, 7), "lo": (0.0, 6), "hi": (1.0, 7)}
    found = ordering._bracketed_quantiles(df, "x", wanted, ["g"])
    assert found is not None
    plain = {r["g"]: r.asDict() for r in ordering.quantiles(df, "x", wanted, ["g"]).collect()}
    assert {r["g"]: r.asDict() for r in found.collect()} == plain
    assert plain["a"]["m"] == pytest.approx(np.median(xs)) and plain["a"]["n"] == 9000
    assert ordering._bracketed_quantiles(df.where("g = 'b'"), "x", wanted, ["g"]) is None
    monkeypatch.setattr(ordering, "DEFAULT_SKETCH_FROM", 10)
    assert {r["g"]: r.asDict() for r in ordering.quantiles(df, "x", wanted, ["g"]).collect()} == plain


def test_chi_square_with_empty_cells(spark):
    rnd = random.Random(21)
    rows = [(rnd.choice("abcdefgh"), rnd.choice("xyzw") if rnd.random() < 0.9 else "rare") for _ in range(60)]
    df = spark.createDataFrame(rows, "r string, c string")
    rl, cl = sorted({a for a, _ in rows}), sorted({b for _, b in rows})
    o = np.array([[sum(q == (a, b) for q in rows) for b in cl] for a in rl], float)
    e = o.sum(1, keepdims=True) * o.sum(0, keepdims=True) / o.sum()
    r = H.chi_square(df, "r", "c").first()
    assert r["chisq"] == pytest.approx(((o - e) ** 2 / e).sum()) and r["min_expected"] == pytest.approx(e.min())
    assert r["pct_small_expected"] == pytest.approx(100 * (e < 5).mean()) and r["df"] == (len(rl) - 1) * (len(cl) - 1)
    cells = H.chi_square_cells(df, "r", "c").collect()
    assert len(cells) == o.size and sum(c["contribution"] for c in cells) == pytest.approx(r["chisq"])


def test_multiplicative_seasons_per_group(spark):
    """Each series on its own, from any partitioning; a zero season or level makes fits and forecast NULL, short series are left out."""
    rng = np.random.default_rng(31)
    series = {"a": (20 + np.arange(40)) * (1 + 0.3 * np.sin(np.arange(40) * np.pi / 3)) + rng.normal(size=40), None: rng.gamma(9, 1, 25),
              "zero season": np.arange(24) % 6, "all zero": np.zeros(20), "short": np.ones(11)}
    df = spark.createDataFrame([(g, i, float(v)) for g, vs in series.items() for i, v in enumerate(vs)], "g string, i long, y double").repartition(5)
    got = T.smooth(df, "y", ["i"], ["g"], "holt-winters", 0.2, 0.1, 0.3, 6, 2, True)
    fits = {(r["g"], r["t"]): r["fitted"] for r in got["fitted"].collect()}
    ahead = {(r["g"], r["t"]): r["fit"] for r in got["forecast"].collect()}
    assert not any(g == "short" for g, _ in fits)
    for g in ("a", None):
        y = series[g]
        level = y[:6].mean()
        trend, s = (y[6:12].mean() - level) / 6, list(y[:6] / level)
        for t, v in enumerate(y):
            if t >= 6:
                assert fits[g, t + 1] == pytest.approx((level + trend) * s[t % 6], rel=1e-12)
            new = 0.2 * v / s[t % 6] + 0.8 * (level + trend)
            level, trend, s[t % 6] = new, 0.1 * (new - level) + 0.9 * trend, 0.3 * v / new + 0.7 * s[t % 6]
        assert ahead[g, len(y) + 1] == pytest.approx((level + trend) * s[len(y) % 6], rel=1e-12)
    assert all(v is None for (g, _), v in [*fits.items(), *ahead.items()] if g in ("zero season", "all zero"))
