"""Johnson values back in real units, logistic scores of new rows."""

import math

import pytest
from pyspark.sql import functions as F

from procstats.operators import fitting, regression

FITS = [("SL", 2.0, 1.0, 0.5, 0.25), ("SU", 10.0, 3.0, -0.2, 0.7), ("SB", -1.0, 4.0, 0.1, 1.5)]


def test_johnson_inverse_of_each_family(spark):
    fitted = spark.createDataFrame(FITS, "family string, a double, b double, mu double, sigma double").withColumn("g", F.col("family"))
    z = [-40.0, -2.0, 0.0, 1.0, 40.0, None, float("nan"), float("inf"), 1e6]
    rows = spark.createDataFrame([(f, v) for f, *_ in FITS for v in z], "g string, z double")
    out = {(r.g, r.z): r.x for r in fitting.johnson_inverse(rows, "z", fitted, ["g"]).collect() if r.z is None or r.z == r.z}
    raw = lambda f, v: {k: m + s * v for k, _, _, m, s in FITS}[f]
    for v in (-2.0, 0.0, 1.0):
        assert out["SL", v] == pytest.approx(2 + math.exp(raw("SL", v)))
        assert out["SU", v] == pytest.approx(10 + 3 * math.sinh(raw("SU", v)))
        assert out["SB", v] == pytest.approx(-1 + 4 / (1 + math.exp(-raw("SB", v))))
    assert -1 <= out["SB", -40.0] < out["SB", 40.0] <= 3 and out["SL", -40.0] >= 2 and out["SB", 1e6] == 3 and out["SU", 1e6] is None
    assert all(out[f, None] is None and out[f, float("inf")] is None for f, *_ in FITS)
    back = fitting.johnson_transform(spark.createDataFrame([(f, out[f, v], v) for f, *_ in FITS for v in (-2.0, 0.0, 1.0)], "g string, x double, v double"), "x", fitted, ["g"])
    assert all(r.z == pytest.approx(r.v, abs=1e-9) for r in back.collect())


def test_johnson_percentiles(spark):
    fitted = spark.createDataFrame([("SU", 10.0, 3.0, 0.0, 1.0)], "family string, a double, b double, mu double, sigma double")
    out = {r.probability: r.value for r in fitting.johnson_percentiles(fitted, [0.025, 0.5, 0.975]).collect()}
    assert out[0.5] == pytest.approx(10) and out[0.975] == pytest.approx(10 + 3 * math.sinh(1.959963984540054))
    assert out[0.025] + out[0.975] == pytest.approx(20)


def test_logistic_scores_of_new_rows(spark):
    rows = [(float(i % 10), "a" if i % 3 else "b", int((i * 7) % 10 < i % 10)) for i in range(300)]
    df = spark.createDataFrame(rows, "x double, g string, y int")
    m = regression.LogisticModel(df, F.col("y"), ["x", "g"], ["g"])
    beta = {r.term: r.coef for r in m.coefficients().collect()}
    new = spark.createDataFrame([(1, 2.5, "a"), (2, 2.5, "b"), (3, None, "a"), (4, 2.5, "new")], "id int, x double, g string")
    out = {r.id: r for r in m.predict(new, ["id"]).collect()}
    eta = beta["(intercept)"] + 2.5 * beta["x"]
    for i, sign in ((1, 1), (2, -1), (4, 0)):
        p = 1 / (1 + math.exp(-(eta + sign * beta["g[a]"])))
        assert out[i].probability == pytest.approx(p) and out[i].predicted == int(p >= 0.5)
    assert set(out) == {1, 2, 4}
    assert all(r.observed == pytest.approx(r.expected, abs=1e-6) for r in m.expected().collect())
    cells = df.groupBy("x", "g").agg(F.sum("y").alias("k"), F.count("y").alias("n"))
    trials = regression.LogisticModel(cells, F.col("k"), ["x", "g"], ["g"], trials="n")
    assert {r.term: r.coef for r in trials.coefficients().collect()} == pytest.approx(beta, abs=1e-6)
