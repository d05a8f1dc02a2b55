"""Block-wise cross moments against numpy, for few and many groups, far means and constant columns."""

import numpy as np
import pytest

from procstats.plans import gram


def check(spark, x, g, partitions=5):
    k = x.shape[1]
    names = [f"c{i}" for i in range(k)]
    rows = [(None if v is None else int(v), str(v), *map(float, r)) for v, r in zip(g, x)]
    df = spark.createDataFrame(rows, "g int, h string, " + ", ".join(f"{c} double" for c in names)).repartition(partitions)
    out = {r.g: r for r in gram.moments(df, names, ["g", "h"]).collect()}
    assert set(out) == set(g)
    for v in out:
        own = x[[w == v for w in g]]
        cov = np.cov(own, rowvar=False, bias=True).reshape(k, k)
        scale = np.sqrt(np.outer(np.diag(cov), np.diag(cov))) + 1e-300
        assert out[v].n == len(own) and np.allclose(out[v].means, own.mean(axis=0), rtol=1e-13)
        assert np.abs(gram.square(out[v].cov, k) - cov).max() <= 1e-9 * scale.max() + 1e-300
    whole = gram.moments(df, names).first()
    cov = np.cov(x, rowvar=False, bias=True)
    assert np.allclose(gram.square(whole["cov"], k), cov, rtol=1e-9, atol=1e-9 * np.abs(cov).max())


@pytest.mark.parametrize("groups", [1, 3, 200])
def test_moments_of_many_columns(spark, groups, monkeypatch):
    monkeypatch.setattr(gram, "HELD", 2000)
    rng = np.random.default_rng(groups)
    g = [None if v == 0 else int(v) for v in rng.integers(0, groups, 600)]
    x = rng.normal(size=(600, 9)) @ rng.normal(size=(9, 9))
    check(spark, x, g)


def test_far_means_keep_their_digits(spark):
    rng = np.random.default_rng(3)
    g = [int(v) for v in rng.integers(0, 2, 400)]
    x = rng.normal(size=(400, 8)) + np.array(g)[:, None] * 1e9
    names = [f"c{i}" for i in range(8)]
    df = spark.createDataFrame([(v, *map(float, r)) for v, r in zip(g, x)], "g int, " + ", ".join(f"{c} double" for c in names))
    for r in gram.moments(df, names, ["g"]).collect():
        own = x[np.array(g) == r.g]
        assert np.allclose(gram.square(r["cov"], 8), np.cov(own, rowvar=False, bias=True), atol=1e-5)


def test_constant_columns_have_no_variance(spark):
    names = [f"c{i}" for i in range(8)]
    df = spark.createDataFrame([tuple([0.1] + [float(i * j) for j in range(1, 8)]) for i in range(50)], ", ".join(f"{c} double" for c in names)).repartition(7)
    c = gram.square(gram.moments(df, names).first()["cov"], 8)
    assert (c[0] == 0).all() and c[1, 1] == pytest.approx(np.var(np.arange(50.0)))


def test_no_rows(spark):
    names = [f"c{i}" for i in range(8)]
    df = spark.createDataFrame([], "g int, " + ", ".join(f"{c} double" for c in names))
    assert gram.moments(df, names, ["g"]).count() == 0
