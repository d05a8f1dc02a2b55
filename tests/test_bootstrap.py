"""Bootstrap over value frequencies: theory, the row form, and independence of partitioning."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from procstats.functions.numeric import ratio
from procstats.operators import describe as D


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(21)
    rows = [(i, "a", float(v)) for i, v in enumerate(1e6 + rng.normal(0, 10, 300))]
    rows += [(1000 + i, None, float(rng.integers(0, 4))) for i in range(500)]  # four values, each many times
    rows += [(2000, "a", None), (2001, "empty", None), (2002, "a", float("nan")), (2003, "one", 5.0)]
    return spark.createDataFrame(rows, "id long, g string, x double")


def test_bootstrap_of_frequencies(data):
    own = {g: np.array([r["x"] for r in data.collect() if r["g"] == g and r["x"] is not None and r["x"] == r["x"]]) for g in ("a", None)}
    for statistic, plain, se in (("mean", np.mean, lambda v: v.std() / np.sqrt(len(v))),
                                 ("sum", np.sum, lambda v: np.sqrt((v * v).sum())),
                                 ("sd", lambda v: v.std(ddof=1), lambda v: np.sqrt(((v - v.mean()) ** 4).mean() - v.var() ** 2) / (2 * v.std() * np.sqrt(len(v))))):
        got = {r["g"]: r for r in D.bootstrap_interval(data, "x", ["id"], ["g"], statistic, replicates=1500).collect()}
        assert set(got) == {"a", None, "one"}
        for g, v in own.items():
            assert got[g]["estimate"] == pytest.approx(plain(v), rel=1e-9)
            assert got[g]["se"] == pytest.approx(se(v), rel=0.12) and got[g]["replicates"] == 1500
            assert got[g]["lower"] < got[g]["estimate"] < got[g]["upper"]


def test_bootstrap_does_not_depend_on_partitions(data):
    one, two = (D.bootstrap_interval(data.repartition(n), "x", ["id"], ["g"], replicates=200).orderBy("g").collect() for n in (1, 6))
    for p, q in zip(one, two):
        assert p["g"] == q["g"] and np.allclose([p["lower"], p["upper"]], [q["lower"], q["upper"]], rtol=1e-12)


def test_bootstrap_of_any_aggregate(data):
    own = D.bootstrap_interval(data, "x", ["id"], ["g"], lambda x, w: ratio(F.sum(x * w), F.sum(w)), replicates=300).where("g = 'a'").first()
    short = D.bootstrap_interval(data, "x", ["id"], ["g"], replicates=300).where("g = 'a'").first()
    assert own["se"] == pytest.approx(short["se"], rel=0.25) and own["estimate"] == pytest.approx(short["estimate"])
    assert D.bootstrap_interval(data.limit(0), "x", ["id"], ["g"]).count() == 0
