"""Operators on small inputs with published or hand-computable answers."""

import math

import pytest
from pyspark.sql import functions as F

from procstats.operators import aggregate as A
from procstats.operators import anova as V
from procstats.operators import capability as C
from procstats.operators import columns as K
from procstats.operators import describe as D
from procstats.operators import experiments as X
from procstats.operators import hypothesis as H
from procstats.operators import process as P
from procstats.operators import regression as G
from procstats.operators import timeseries as T


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0].asDict()


def test_describe(values):
    r = one(D.describe(values([2, 4, 4, 4, 5, 5, 7, 9]), "x"))
    assert (r["mean"], r["median"], r["q1"], r["q3"]) == (5, 4.5, 4, 6.5)
    assert r["sd"] == pytest.approx(2.13809, abs=1e-5)
    assert r["ci_mean_low"] == pytest.approx(5 - 2.364624 * 2.13809 / math.sqrt(8), abs=1e-4)


def test_missing_values_do_not_count(values):
    r = one(D.describe(values([1, None, 3, float("nan"), 5]), "x", intervals=False))
    assert (r["n"], r["missing"], r["mean"]) == (3, 2, 3)


def test_t_tests(groups, values):
    r = one(H.t_test_two(groups({"a": range(27, 32), "b": range(22, 27)}), "x", "g", ["a", "b"], pooled=True))
    assert r["t"] == pytest.approx(5) and r["df"] == 8 and r["p_value"] == pytest.approx(0.001052826, abs=1e-8)
    r = one(H.t_test(values([5.1, 4.9, 5.6, 5.2, 5.0, 4.8, 5.3]), "x", 5.0))
    assert r["t"] == pytest.approx(1.264390846, abs=1e-8)


def test_equivalence(groups):
    r = one(H.equivalence_test(groups({"a": [10, 11, 9, 10, 10.5], "b": [10.1, 10.9, 9.2, 10.2, 10.4]}), "x", -2.0, 2.0, "g", ["a", "b"]))
    assert r["equivalent"] and r["p_value"] < 0.05


def test_kruskal(groups):
    g = groups({"1": [2.9, 3.0, 2.5, 2.6, 3.2], "2": [3.8, 2.7, 4.0, 2.4], "3": [2.8, 3.4, 3.7, 2.2, 2.0]})
    r = one(H.kruskal_wallis(g, "x", "g"))
    assert r["h"] == pytest.approx(0.7714, abs=1e-4) and r["p_value"] == pytest.approx(0.68, abs=5e-3)


def test_chi_square_and_fisher(spark):
    rows = [("a", "x")] * 20 + [("a", "y")] * 30 + [("b", "x")] * 30 + [("b", "y")] * 20
    df = spark.createDataFrame(rows, "r string, c string")
    r = one(H.chi_square(df, "r", "c"))
    assert r["chisq"] == pytest.approx(4) and r["p_value"] == pytest.approx(0.0455, abs=1e-4)
    assert one(H.chi_square(df, "r", "c", yates=True))["chisq"] == pytest.approx(3.24)
    small = spark.createDataFrame([("a", "x")] * 3 + [("a", "y")] + [("b", "x")] + [("b", "y")] * 3, "r string, c string")
    assert one(H.fisher_exact(small, F.col("r") == "a", F.col("c") == "x"))["p_value"] == pytest.approx(0.4857142857, abs=1e-9)


def test_one_way_and_tukey(groups):
    data = {"a": [18, 20, 19, 21, 17], "b": [25, 26, 24, 27, 23], "c": [30, 29, 31, 32, 28]}
    r = one(V.one_way(groups(data), "x", "g"))
    n = sum(map(len, data.values()))
    grand = sum(map(sum, data.values())) / n
    ssb = sum(len(v) * (sum(v) / len(v) - grand) ** 2 for v in data.values())
    ssw = sum((x - sum(v) / len(v)) ** 2 for v in data.values() for x in v)
    assert r["ss_between"] == pytest.approx(ssb) and r["f"] == pytest.approx((ssb / 2) / (ssw / 12))
    assert all(p["significant"] for p in V.multiple_comparisons(groups(data), "x", "g").collect())


def test_two_groups_all_methods_agree_in_sign(groups):
    g = groups({"a": [1, 2, 3, 4], "b": [2, 3, 4, 5.5], "c": [4, 5, 6, 7]})
    for m in V.METHODS:
        for p in V.multiple_comparisons(g, "x", "g", method=m).collect():
            assert 0 <= p["p_value"] <= 1 and p["ci_low"] < p["diff"] < p["ci_high"]
            assert p["significant"] == (p["p_value"] < 0.05)


def test_welch_equals_t_squared_for_two_groups(groups):
    g = groups({"a": [1, 2, 3, 4, 8], "b": [2, 3, 4, 5.5]})
    w, t = one(V.welch_anova(g, "x", "g")), one(H.t_test_two(g, "x", "g", ["a", "b"]))
    assert w["f"] == pytest.approx(t["t"] ** 2) and w["df2"] == pytest.approx(t["df"])


def test_two_way_table(spark):
    cells = {("1", "1"): [8, 6], ("1", "2"): [9, 11], ("2", "1"): [11, 13], ("2", "2"): [16, 14]}
    df = spark.createDataFrame([(a, b, float(y)) for (a, b), ys in cells.items() for y in ys], "a string, b string, y double")
    rows = {r["term"]: r for r in V.factorial_anova(df, "y", ["a", "b"]).anova().collect()}
    assert rows["a"]["ss_adj"] == pytest.approx(50) and rows["b"]["ss_adj"] == pytest.approx(18)
    assert rows["a*b"]["ss_adj"] == pytest.approx(0, abs=1e-9)


def test_simple_regression(spark):
    ys = [2.1, 3.9, 6.2, 7.8, 10.1, 12.2, 13.8, 16.1, 18.0, 20.1]
    df = spark.createDataFrame([(i, float(i), y) for i, y in enumerate(ys, 1)], "id long, x double, y double")
    m = G.linear_model(df, "y", ["x"])
    c = {r["term"]: r for r in m.coefficients().collect()}
    s = one(m.summary())
    assert c["x"]["coef"] == pytest.approx(2.0018, abs=1e-3) and s["r2"] > 0.999
    band = G.scatter_band(df, "x", "y").collect()
    assert len(band) == 80 and all(r["pi_low"] < r["ci_low"] < r["fit"] for r in band)


def test_aliased_column_gets_no_coefficient(spark):
    df = spark.createDataFrame([(float(i), float(2 * i + 1), float(i * i % 7)) for i in range(12)], "x double, z double, y double")
    c = {r["term"]: r for r in G.linear_model(df, "y", ["x", "z"]).coefficients().collect()}
    assert c["z"]["coef"] is None and c["x"]["coef"] is not None


def test_cubic_is_numerically_stable(spark):
    df = spark.createDataFrame([(float(x), 1 + 2 * x - 0.5 * x**2 + 0.01 * x**3) for x in range(100, 160)], "x double, y double")
    c = [r["coef"] for r in G.polynomial(df, "x", "y", 3).coefficients().orderBy("position").collect()]
    assert c == pytest.approx([1, 2, -0.5, 0.01], rel=2e-3)


def test_capability_ppm(spark):
    rows = [(i, x) for i, x in enumerate([9.0, 11.0] * 50)]
    g = spark.createDataFrame([(10.0, 1.0, 7.0, 13.0, 10.0), (11.0, 1.0, 7.0, 13.0, 10.0)], "mean double, s double, lsl double, usl double, target double")
    a, b = C.indices(g, "s", "p").orderBy("mean").collect()
    assert a["p_cp"] == a["p_cpk"] == pytest.approx(1) and a["p_ppm"] == pytest.approx(2699.796, abs=0.01)
    assert b["p_cpk"] == pytest.approx(2 / 3) and rows


def test_sigma_level(spark):
    g = spark.createDataFrame([(3.4,), (6209.7,)], "ppm double")
    s = [r["sigma_level"] for r in C.with_sigma_level(g, F.col("ppm")).orderBy("ppm").collect()]
    assert s == pytest.approx([6.0, 4.0], abs=2e-3)


def test_rolled_throughput(spark):
    df = spark.createDataFrame([(1, 0.98), (2, 0.97), (3, 0.99)], "step int, y double")
    r = P.rolled_throughput(df, ["step"], given="y").orderBy("step").collect()
    assert r[-1]["cumulative"] == pytest.approx(0.98 * 0.97 * 0.99)


def test_oee(spark):
    df = spark.createDataFrame([("m", 480.0, 60.0, 1.0, 380.0, 12.0)], "m string, p double, d double, i double, t double, r double")
    r = one(P.oee(df, ["m"], "p", "d", "i", "t", "r"))
    assert (r["availability"], r["performance"], r["quality"]) == pytest.approx((420 / 480, 380 / 420, 368 / 380))


def test_pareto(spark):
    rows = [(k, float(v)) for k, v in [("a", 50), ("b", 30), ("c", 15), ("d", 5)]]
    r = A.pareto(spark.createDataFrame(rows, "k string, w double"), "k", "w").orderBy("position").collect()
    assert [x["cum_pct"] for x in r] == pytest.approx([50, 80, 95, 100]) and [x["vital"] for x in r] == [True, True, False, False]


def test_fmea(spark):
    r = one(P.fmea(spark.createDataFrame([(1, 8, 4, 5)], "id int, s int, o int, d int"), "s", "o", "d", ["id"]))
    assert r["rpn"] == 160 and r["action_priority"] == "high" and r["risk"] == "medium"


def test_linear_trend(values):
    out = T.trend(values([100 + 2 * i for i in range(40)]), "x", ["id"], horizon=1)
    assert out["coefficients"].where("position = 1").first()["coef"] == pytest.approx(2)
    assert out["forecast"].first()["fit"] == pytest.approx(180)


def test_formulas_and_filter(spark):
    df = spark.createDataFrame([(1.0, "x"), (2.0, "x"), (3.0, "y"), (4.0, "y")], "a double, g string")
    df = K.derive(K.column_statistics(df, {"m": ("mean", "a")}), "centered", "a - m")
    assert sorted(r["centered"] for r in df.collect()) == [-1.5, -0.5, 0.5, 1.5]
    assert {r["g"]: r["m"] for r in A.aggregate(df, ["g"], [("mean", "a", "m")]).collect()} == {"x": 1.5, "y": 3.5}
    assert K.derive(df, "bad", "ln(a - 1)").where("bad is null").count() == 1


def test_proportions(spark):
    df = spark.createDataFrame([(i < 15,) for i in range(40)], "ok boolean")
    r = one(H.proportion_test(df, F.col("ok"), p0=0.5))
    assert r["exact_low"] < r["p_hat"] < r["exact_high"] and r["p_exact"] == pytest.approx(0.1538, abs=1e-3)


def test_factorial_effects_and_lenth(spark):
    rows = [(a, b, c, 10 + 3 * a - 2 * b + 0.5 * a * b) for a in (-1.0, 1.0) for b in (-1.0, 1.0) for c in (-1.0, 1.0)]
    df = spark.createDataFrame([(a * 5 + 20, b, c, y) for a, b, c, y in rows], "a double, b double, c double, y double")
    e = {r["term"]: r["effect"] for r in X.factorial_effects(X.factorial_model(df, "y", ["a", "b", "c"])).collect()}
    assert e["a"] == pytest.approx(6) and e["b"] == pytest.approx(-4) and e["a*b"] == pytest.approx(1) and e["c"] == pytest.approx(0, abs=1e-9)


def test_response_surface_optimum(spark):
    pts = [(a, b) for a in (-1.0, 0.0, 1.0) for b in (-1.0, 0.0, 1.0)] + [(0.0, 0.0)] * 3
    df = spark.createDataFrame([(a, b, 50 - 2 * (a - 0.4) ** 2 - 3 * (b + 0.2) ** 2) for a, b in pts], "a double, b double, y double")
    m = X.ResponseSurface(df, "y", ["a", "b"])
    s = m.stationary().first()
    assert s["nature"] == "maximum" and s["real"] == pytest.approx([0.4, -0.2], abs=1e-6) and s["predicted"] == pytest.approx(50)
    best = X.optimize([(m, {"goal": "max", "lower": 30.0, "target": 60.0})]).first()
    assert (best["a"], best["b"]) == pytest.approx((0.4, -0.2), abs=0.01)


def test_mixture(spark):
    pts = [(1, 0, 0), (0, 1, 0), (0, 0, 1), (.5, .5, 0), (.5, 0, .5), (0, .5, .5), (1 / 3, 1 / 3, 1 / 3)]
    df = spark.createDataFrame([(float(a), float(b), float(c), float(10 * a + 20 * b + 30 * c + 8 * a * b)) for a, b, c in pts], "a double, b double, c double, y double")
    c = {r["term"]: r["coef"] for r in X.mixture_model(df, ["a", "b", "c"], "y").coefficients().collect()}
    assert (c["a"], c["b"], c["c"], c["a*b"]) == pytest.approx((10, 20, 30, 8), abs=1e-6)
