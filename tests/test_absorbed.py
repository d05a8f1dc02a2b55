"""Blocks eliminated from the equations of the treatments: against dense least squares."""

import numpy as np
import pytest

from procstats.operators import anova as V


def dense(rows, with_block, with_treatment):
    """(residual sum of squares, rank) by least squares on indicator columns."""
    y = np.array([r[2] for r in rows])
    blocks, treatments = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    cols = [np.ones(len(rows))]
    if with_block:
        cols += [np.array([r[0] == b for r in rows], float) for b in blocks]
    if with_treatment:
        cols += [np.array([r[1] == t for r in rows], float) for t in treatments]
    x = np.stack(cols, axis=1)
    fit, _, rank, _ = np.linalg.lstsq(x, y, rcond=None)
    return float(((y - x @ fit) ** 2).sum()), int(rank)


@pytest.mark.parametrize("connected", [True, False])
def test_absorbed_blocks(spark, connected):
    rng = np.random.default_rng(5)
    rows = []
    for b in range(400):  # more blocks than a design of columns takes
        allowed = "abcd" if connected else ("ab", "cd")[b % 2]
        for _ in range(rng.integers(1, 6)):
            t = str(rng.choice(list(allowed)))
            rows.append((f"b{b}", t, float(1e6 + 3 * b + "abcd".index(t) + rng.normal())))
    df = spark.createDataFrame([*rows, ("b1", "a", None), ("b1", "a", float("nan"))], "blk string, trt string, y double").repartition(5)
    got = {r["term"]: r for r in V.absorbed_anova(df, "y", "trt", "blk").collect()}
    full, rank = dense(rows, True, True)
    block_only, rank_b = dense(rows, True, False)
    trt_only, rank_t = dense(rows, False, True)
    total, _ = dense(rows, False, False)
    assert got["trt"]["df"] == rank - rank_b == (3 if connected else 2)
    assert got["trt"]["dfe"] == len(rows) - rank
    assert got["blk"]["df_adj"] == rank - rank_t
    assert np.isclose(got["trt"]["ss_adj"], block_only - full, rtol=1e-6)
    assert np.isclose(got["blk"]["ss_seq"], total - block_only, rtol=1e-9)
    assert np.isclose(got["blk"]["ss_adj"], trt_only - full, rtol=1e-9)
    assert np.isclose(got["trt"]["f_adj"], (block_only - full) / (rank - rank_b) / (full / (len(rows) - rank)), rtol=1e-6)
    means = {r["level"]: r for r in V.absorbed_means(df, "y", "trt", "blk").collect()}
    assert sum(r["n"] for r in means.values()) == len(rows)
    if connected:  # differences of adjusted means are near the planted ones
        assert all(abs(means[t]["adjusted"] - means["a"]["adjusted"] - i) < 0.3 for i, t in enumerate("abcd"))
    else:
        assert all(r["adjusted"] is None for r in means.values())


def test_absorbed_groups_and_empty(spark):
    rng = np.random.default_rng(6)
    rows = [(g, f"b{b}", t, float(b + rng.normal())) for g in ("x", None) for b in range(6) for t in "pq" + ("r" if g else "")]
    df = spark.createDataFrame(rows, "g string, blk string, trt string, y double")
    got = {(r["g"], r["term"]): r for r in V.absorbed_anova(df, "y", "trt", "blk", ["g"]).collect()}
    for g in ("x", None):
        own = [r[1:] for r in rows if r[0] == g]
        full, rank = dense(own, True, True)
        part, rank_b = dense(own, True, False)
        assert got[g, "trt"]["df"] == rank - rank_b and np.isclose(got[g, "trt"]["ss_adj"], part - full)
    assert V.absorbed_anova(df.limit(0), "y", "trt", "blk", ["g"]).count() == 0
