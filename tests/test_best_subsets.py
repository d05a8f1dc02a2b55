"""Best subsets by branch and bound against all subsets."""

import itertools
import time

import numpy as np

from procstats.operators import regression as G


def all_subsets(corr, groups):
    y, best = len(corr) - 1, {}
    for size in range(1, len(groups) + 1):
        for pick in itertools.combinations(range(len(groups)), size):
            cols = [c for t in pick for c in groups[t]]
            r = corr[cols, y]
            value = 1 - r @ np.linalg.lstsq(corr[np.ix_(cols, cols)], r, rcond=1e-10)[0]
            if size not in best or value < best[size] - 1e-12:
                best[size] = value
    return best


def error(corr, groups, pick):
    cols, y = [c for t in pick for c in groups[t]], len(corr) - 1
    return 1 - corr[cols, y] @ np.linalg.lstsq(corr[np.ix_(cols, cols)], corr[cols, y], rcond=1e-10)[0]


def test_same_as_all_subsets():
    rng = np.random.default_rng(31)
    for trial in range(40):
        p = int(rng.integers(1, 9))
        x = rng.normal(size=(60, p)) @ rng.normal(size=(p, p)) * (trial % 3 > 0) + rng.normal(size=(60, p))
        if trial % 5 == 4 and p > 2:
            x[:, 1] = x[:, 0] - 2 * x[:, 2]  # aliased columns
        y = x @ rng.normal(size=p) * (trial % 4 > 0) + rng.normal(size=60)
        corr = np.corrcoef(np.column_stack([x, y]), rowvar=False).reshape(p + 1, p + 1)
        groups = [[k] for k in range(p)] if trial % 2 or p < 3 else [[0, 1], *[[k] for k in range(2, p)]]
        got, want = G.smallest_errors(corr, groups), all_subsets(corr, groups)
        assert set(got) == set(want)
        assert all(len(pick) == size and abs(error(corr, groups, pick) - want[size]) < 1e-9 for size, pick in got.items())


def test_thirty_candidates():
    rng = np.random.default_rng(32)
    x = rng.normal(size=(2000, 30)) + rng.normal(size=(2000, 1))
    y = x[:, [3, 7, 11, 19, 28]] @ np.array([3, -2, 1.5, 1, -1]) + rng.normal(size=2000)
    start = time.time()
    got = G.smallest_errors(np.corrcoef(np.column_stack([x, y]), rowvar=False), [[k] for k in range(30)])
    assert got[5] == (3, 7, 11, 19, 28) and len(got) == 30
    assert time.time() - start < 120


def test_table(spark):
    rng = np.random.default_rng(33)
    x = rng.normal(size=(400, 14))
    y = x[:, 2] * 2 - x[:, 5] + rng.normal(size=400)
    names = [f"x{k}" for k in range(14)]
    df = spark.createDataFrame([(*map(float, r), float(v), "ab"[k % 2]) for k, (r, v) in enumerate(zip(x, y))], [*names, "y", "g"])
    rows = G.best_subsets(df, "y", names, by=["g"]).collect()
    assert len(rows) == 28 and {tuple(r["variables"]) for r in rows if r["size"] == 2} == {("x2", "x5")}
    few = names[:6]
    best = {r["size"]: r for r in G.best_subsets(df, "y", few).collect()}
    listed = G.best_subsets(df, "y", few, best_only=False).collect()
    assert len(listed) == 63
    assert all(abs(best[k]["r2"] - max(r["r2"] for r in listed if r["size"] == k)) < 1e-12 for k in range(1, 7))
