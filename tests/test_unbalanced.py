"""Variance components of unequal cells against expectations computed from projections."""

import numpy as np
import pytest

from procstats.operators import anova, gage


def table(rng, sizes):
    """Rows (a, b, x) of a table of cell sizes."""
    out = [(f"a{i}", f"b{j}", float(x)) for i, row in enumerate(sizes) for j, n in enumerate(row) for x in rng.normal(10 * i + 0.3 * j, 1, n)]
    return [(k, *r) for k, r in enumerate(out)]


def indicator(labels):
    levels = sorted(set(labels))
    return np.array([[float(x == v) for v in levels] for x in labels])


def project(z):
    return z @ np.linalg.pinv(z)


def by_projections(rows, nested=False, pooled=False):
    """Components from E(y' Q y) = sum of variances x trace(Q Z Z')."""
    a, b, y = [r[1] for r in rows], [r[2] for r in rows], np.array([r[3] for r in rows])
    za, zb, zc, one = indicator(a), indicator(b), indicator([x + y for x, y in zip(a, b)]), np.ones((len(y), 1))
    pa, pb, pc, p0, eye = project(za), project(zb), project(zc), project(one), np.eye(len(y))
    if nested:
        qs, zs = [pa - p0, pc - pa, eye - pc], [za, zc, eye]
    elif pooled:
        qs, zs = [pa - p0, pb - p0, pc - pa - pb + p0 + eye - pc], [za, zb, eye]
    else:
        qs, zs = [pa - p0, pb - p0, pc - pa - pb + p0, eye - pc], [za, zb, zc, eye]
    m = np.array([[np.trace(q @ z @ z.T) for z in zs] for q in qs])
    return np.linalg.solve(m, [y @ q @ y for q in qs])


SIZES = [[5, 2, 3], [1, 4, 2], [3, 3, 6], [2, 0, 4]]


@pytest.fixture(scope="module")
def rows():
    return table(np.random.default_rng(2), SIZES)


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "id long, a string, b string, x double")


def test_crossed_components_of_unequal_cells(df, rows):
    out = anova.variance_components(df, "x", "a", "b").first()
    expect = np.maximum(by_projections(rows), 0)
    assert [out.var_a, out.var_b, out.var_ab, out.var_error] == pytest.approx(expect, abs=1e-9)
    assert (out.balanced, out.a, out.b, out.cells, out.n, out.replicates) == (False, 4, 3, 11, 35, 6)
    assert out.df_ab == 5 and out.df_error == 24
    for k in ('a', 'b', 'ab'):
        f = getattr(out, 'f_' + k)
        assert f is None or 0 <= getattr(out, 'p_' + k) <= 1


def test_nested_components_of_unequal_cells(df, rows):
    out = anova.variance_components(df, "x", "a", "b", nested=True).first()
    assert [out.var_a, out.var_b, out.var_error] == pytest.approx(np.maximum(by_projections(rows, nested=True), 0), abs=1e-9)
    assert out.df_b == 11 - 4


def test_gage_of_unequal_cells(df, rows):
    for alpha, pooled in ((0.0, True), (1.1, False)):
        out = gage.gage_crossed(df, "x", "a", "b", alpha_pool=alpha).first()
        raw = by_projections(rows, pooled=pooled)
        assert out.pooled is pooled or pooled
        if out.pooled:
            assert [out.var_part, out.var_oper, out.var_repeat] == pytest.approx(np.maximum(by_projections(rows, pooled=True), 0), abs=1e-9)
        else:
            assert [out.var_part, out.var_oper, out.var_inter, out.var_repeat] == pytest.approx(np.maximum(raw, 0), abs=1e-9)


def test_equal_cells_are_the_classical_tests(spark):
    rows = table(np.random.default_rng(4), [[3] * 4] * 5)
    out = anova.variance_components(spark.createDataFrame(rows, "id long, a string, b string, x double"), "x", "a", "b").first()
    assert out.balanced and out.f_a == pytest.approx(out.ms_a / out.ms_ab) and out.f_b == pytest.approx(out.ms_b / out.ms_ab)
    assert out.f_ab == pytest.approx(out.ms_ab / out.ms_error) and out.df_den_a == pytest.approx(12) and out.df_den_ab == pytest.approx(40)
    assert out.var_a == pytest.approx((out.ms_a - out.ms_ab) / 12) and out.var_b == pytest.approx((out.ms_b - out.ms_ab) / 15)


def test_groups_without_replicates_or_levels(spark):
    rng = np.random.default_rng(5)
    rows = [(*r, "full") for r in table(rng, [[1] * 3] * 4)] + [(*r, "flat") for r in table(rng, [[4, 5, 6]])] + [(0, "a", "b", None, "none"), (0, "a", "b", 1.0, "one")]
    df = spark.createDataFrame(rows, "id long, a string, b string, x double, g string")
    out = {r.g: r for r in anova.variance_components(df, "x", "a", "b", ["g"]).collect()}
    full = out["full"]
    assert set(out) == {"full", "flat", "one"} and full.balanced and full.var_error == 0 and full.ms_error is None
    assert full.var_ab == pytest.approx(full.ms_ab) and full.f_a == pytest.approx(full.ms_a / full.ms_ab) and full.f_ab is None
    assert out["flat"].var_a is None and out["one"].var_total is None
    single = gage.gage_crossed(df, "x", "a", "b", ["g"]).where("g = 'full'").first()
    assert single.pooled and single.p_interaction is None and single.var_repeat == pytest.approx(full.ms_ab)
    assert single.var_part == pytest.approx(max(0, (full.ms_a - full.ms_ab) / 3))
