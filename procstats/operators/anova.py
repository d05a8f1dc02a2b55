"""Analysis of variance and multiple comparisons."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dist
from ..functions.numeric import finite, level, ratio
from ..plans import gram
from ..plans.gram import ALIAS_TOLERANCE
from ..plans.joining import attach
from ..plans.session import persist
from . import hypothesis as H
from .describe import _merge
from .regression import Model, linear_model


def one_way(df: DataFrame, value: str, group: str, by: Sequence[str] = ()) -> DataFrame:
    """Sums of squares, F, p, eta and omega squared."""
    s = H.one_way_sums(H.cell_statistics(df, value, group, by), by)
    k, n = F.col("k"), F.col("total_n")
    ssb, ssw = F.col("ss_between"), F.col("ss_within")
    s = s.withColumns({"df_between": (k - 1).cast("double"), "df_within": n - k})
    s = s.withColumns({"ms_between": ratio(ssb, F.col("df_between")), "ms_within": ratio(ssw, F.col("df_within"))})
    msw = F.col("ms_within")
    s = s.withColumns({
        "f": ratio(F.col("ms_between"), msw), "s_pooled": F.sqrt(msw), "eta_sq": ratio(ssb, ssb + ssw),
        "r2_adjusted": 1 - ratio(msw, (ssb + ssw) / (n - 1)),
        "omega_sq": ratio(ssb - F.col("df_between") * msw, ssb + ssw + msw)})
    return s.withColumn("p_value", dist.apply(dist.f_sf, F.col("f"), F.col("df_between"), F.col("df_within")))


def one_way_levels(df: DataFrame, value: str, group: str, by: Sequence[str] = (), conf: float = 0.95) -> DataFrame:
    """Per level: n, mean, sd with pooled and individual intervals."""
    cells = persist(H.cell_statistics(df, value, group, by))
    s = H.one_way_sums(cells, by)
    s = s.select(*by, F.sqrt(F.col("ss_within") / (F.col("total_n") - F.col("k"))).alias("_sp"), (F.col("total_n") - F.col("k")).alias("_df"))
    s = s.withColumn("_t", dist.apply(dist.t_ppf, F.lit((1 + conf) / 2), F.col("_df")))
    t = attach(cells, s, by).withColumn("sd", F.sqrt("var"))
    own = dist.apply(dist.t_ppf, F.lit((1 + conf) / 2), F.when(F.col("n") > 1, F.col("n") - 1))
    t = t.withColumn("_own", own)
    m, root = F.col("mean"), F.sqrt("n")
    return t.select(*by, "level", "n", "mean", "sd", (F.col("sd") / root).alias("se"),
                    (m - F.col("_t") * F.col("_sp") / root).alias("pooled_low"), (m + F.col("_t") * F.col("_sp") / root).alias("pooled_high"),
                    (m - F.col("_own") * F.col("sd") / root).alias("own_low"), (m + F.col("_own") * F.col("sd") / root).alias("own_high"))


def welch_anova(df: DataFrame, value: str, group: str, by: Sequence[str] = ()) -> DataFrame:
    """Unequal variances; df2 = (k^2 - 1) / (3 lambda)."""
    cells = persist(H.cell_statistics(df, value, group, by).withColumn("_w", F.col("n") / F.col("var")))
    w, m = F.col("_w"), F.col("mean")
    tot = cells.groupBy(*by).agg(F.sum(w).alias("_sw"), (F.sum(w * m) / F.sum(w)).alias("_mb"), F.count(F.lit(1)).cast("double").alias("_k"))
    t = attach(cells, tot, by)
    g = t.groupBy(*by).agg(F.first("_k").alias("_k"), F.sum(w * (m - F.col("_mb")) ** 2).alias("_num"),
                           F.sum((1 - w / F.col("_sw")) ** 2 / (F.col("n") - 1)).alias("_lam"))
    k, lam = F.col("_k"), F.col("_lam")
    f = (F.col("_num") / (k - 1)) / (1 + 2 * (k - 2) / (k * k - 1) * lam)
    out = g.select(*by, f.alias("f"), (k - 1).alias("df1"), ((k * k - 1) / (3 * lam)).alias("df2"))
    return out.withColumn("p_value", dist.apply(dist.f_sf, F.col("f"), F.col("df1"), F.col("df2")))


METHODS = ("tukey", "fisher", "bonferroni", "sidak", "games-howell", "dunnett")


def multiple_comparisons(df: DataFrame, value: str, group: str, by: Sequence[str] = (), method: str = "tukey",
                         control: str | None = None, conf: float = 0.95, max_levels: int = 200) -> DataFrame:
    """Pairwise differences of level means with simultaneous intervals.

    Pairs are formed among level summaries; their number is checked, because it
    grows with the square of the levels.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    cells = persist(H.cell_statistics(df, value, group, by))
    s = H.one_way_sums(cells, by).select(*by, "k", (F.col("total_n") - F.col("k")).alias("dfw"),
                                         (F.col("ss_within") / (F.col("total_n") - F.col("k"))).alias("msw"))
    s = persist(s)
    most = s.agg(F.max("k")).first()[0] or 0
    if most > max_levels and method != "dunnett":
        raise ValueError(f"{most} levels: name a control or fewer levels")
    right = cells.select(*[F.col(c).alias("_k_" + c) for c in by], *[F.col(c).alias("b_" + c) for c in ("level", "n", "mean", "var")])
    keys = [F.col(c).eqNullSafe(F.col("_k_" + c)) for c in by]
    left = cells.select(*by, *[F.col(c).alias("a_" + c) for c in ("level", "n", "mean", "var")])
    if method == "dunnett":
        first = cells.groupBy(*by).agg(F.min("level").alias("_ctl"))
        ctl = F.lit(str(control)) if control is not None else F.col("_ctl")
        left = attach(left, first, by)
        cond = (ctl == F.col("b_level")) & (F.col("a_level") != F.col("b_level"))
        if control is not None:
            right = right.where(F.col("b_level") == str(control))
    else:
        cond = F.col("a_level") < F.col("b_level")
    for kcond in keys:
        cond = cond & kcond
    t = left.join(right, cond).drop(*["_k_" + c for c in by], "_ctl")
    t = attach(t, s, by, ready=True)
    na, nb = F.col("a_n").cast("double"), F.col("b_n").cast("double")
    diff, k, dfw = F.col("a_mean") - F.col("b_mean"), F.col("k").cast("double"), F.col("dfw").cast("double")
    pairs = k * (k - 1) / 2
    alpha = 1 - conf
    if method == "games-howell":
        a, b = F.col("a_var") / na, F.col("b_var") / nb
        se, dof = F.sqrt(a + b), (a + b) ** 2 / (a * a / (na - 1) + b * b / (nb - 1))
    elif method == "tukey":
        se, dof = F.sqrt(F.col("msw") * 0.5 * (1 / na + 1 / nb)), dfw
    else:
        se, dof = F.sqrt(F.col("msw") * (1 / na + 1 / nb)), dfw
    t = t.withColumns({"diff": diff, "se": se, "df": dof.cast("double"), "_k": k, "_pairs": pairs})
    stat = F.abs("diff") / F.col("se")
    d, kk, m = F.col("df"), F.col("_k"), F.col("_pairs")
    two_sided = dist.apply(dist.t_sf2, stat, d)
    if method == "tukey":
        crit, p = dist.apply(dist.tukey_ppf, F.lit(conf), kk, d), dist.apply(dist.tukey_sf, stat, kk, d)
    elif method == "games-howell":
        crit = dist.apply(dist.tukey_ppf, F.lit(conf), kk, d) / 2**0.5
        p = dist.apply(dist.tukey_sf, stat * 2**0.5, kk, d)
    elif method == "bonferroni":
        crit, p = dist.apply(dist.t_ppf, 1 - alpha / (2 * m), d), F.least(F.lit(1.0), m * two_sided)
    elif method == "sidak":
        crit, p = dist.apply(dist.t_ppf, 1 - (1 - F.pow(F.lit(conf), 1 / m)) / 2, d), 1 - F.pow(1 - two_sided, m)
    elif method == "dunnett":
        crit = dist.apply(dist.dunnett_ppf, F.lit(conf), kk - 1, F.lit(0.5), d)
        p = dist.apply(dist.dunnett_sf, stat, kk - 1, F.lit(0.5), d)
    else:
        crit, p = dist.apply(dist.t_ppf, F.lit(1 - alpha / 2), d), two_sided
    t = t.withColumns({"_crit": crit, "p_value": p})
    half = F.col("_crit") * F.col("se")
    return t.select(*by, F.col("a_level").alias("level_a"), F.col("b_level").alias("level_b"), "diff", "se", "df",
                    (F.col("diff") / F.col("se")).alias("t"), (F.col("diff") - half).alias("ci_low"), (F.col("diff") + half).alias("ci_high"),
                    F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("p_value"))).alias("p_value"),
                    (F.abs("diff") > half).alias("significant"), F.lit(method).alias("method"))


def factorial_terms(factors: Sequence[str], covariates: Sequence[str] = (), interactions: bool | Sequence[str] = True) -> list[str]:
    """Main effects, covariates, all two-way interactions and the top order."""
    terms = [*factors, *covariates]
    if interactions is True:
        terms += ["*".join(p) for p in combinations(factors, 2)]
        if len(factors) >= 3:
            terms.append("*".join(factors))
    elif interactions:
        terms += list(interactions)
    return terms


def factorial_anova(df: DataFrame, y: str, factors: Sequence[str], covariates: Sequence[str] = (),
                    interactions: bool | Sequence[str] = True, by: Sequence[str] = ()) -> Model:
    """GLM with effect-coded factors; see `Model.anova` and `Model.ls_means`."""
    return linear_model(df, y, factorial_terms(factors, covariates, interactions), factors, by)


def blocked_anova(df: DataFrame, y: str, treatment: str, block: str, by: Sequence[str] = ()) -> Model:
    return linear_model(df, y, [block, treatment], [block, treatment], by)


def absorbed_sums(df: DataFrame, y: str, treatment: str, block: str, by: Sequence[str] = ()) -> DataFrame:
    """Per group: sums of squares and the treatments' equations that are left when the blocks are eliminated.

    A block keeps only its cells (counts and means of its treatments), so blocks may have any number of levels.
    `equations` has (i, j, v): for j >= 0 the upper triangle of diag(n_t) - sum of n_bt n_bu / n_b, for j = -1 the
    right-hand sides sum of n_bt (m_bt - m_b); i and j number the levels of `treatment`, at most `gram.MAX_LEVELS`.
    """
    by = list(by)
    number = {name: k for k, name in enumerate(gram.find_levels(df.where(finite(y).isNotNull()), treatment))}
    x = finite(y)
    rows = df.select(*by, level(treatment).alias("_t"), level(block).alias("_b"), x.alias("_y")).where("_y is not null")
    cells = persist(rows.groupBy(*by, "_b", "_t").agg(F.count(F.lit(1)).cast("double").alias("_n"), F.avg("_y").alias("_m"),
                                                      (F.var_pop("_y") * F.count(F.lit(1))).alias("_ss")))
    n, m = F.col("_n"), F.col("_m")
    mean = F.sum(n * m) / F.sum(n)
    tot = persist(cells.groupBy(*by).agg(F.sum(n).alias("n"), mean.alias("grand"), F.sum("_ss").alias("ss_cell")))
    near = attach(cells, tot.select(*by, "grand"), by, ready=True)
    apart = F.sum(n * (m - F.col("grand")) ** 2)
    treated = near.groupBy(*by, "_t").agg(F.sum(n).alias("_w"), mean.alias("_mean"), F.first("grand").alias("_g")).groupBy(*by).agg(
        F.sum(F.col("_w") * (F.col("_mean") - F.col("_g")) ** 2).alias("ss_treatment"), F.count(F.lit(1)).alias("treatments"),
        F.collect_list(F.struct(F.col("_t").alias("name"), F.col("_w").alias("n"), F.col("_mean").alias("mean"))).alias("levels"))
    blocks = cells.groupBy(*by, "_b").agg(F.sum(n).alias("_w"), mean.alias("_mean"), F.collect_list("_t").alias("_ts"),
                                          F.collect_list(n).alias("_ns"), F.collect_list(m).alias("_ms"))
    within = F.aggregate(F.arrays_zip("_ns", "_ms"), F.lit(0.0), lambda s, c: s + c["_ns"] * (c["_ms"] - F.col("_mean")) ** 2)
    blocked = blocks.groupBy(*by).agg(F.count(F.lit(1)).alias("blocks"), F.sum(within).alias("ss_within"))
    k, most = len(number), gram.HELD

    def reduce(batches):
        held: dict = {}
        for pdf in batches:
            keys = pdf[by].itertuples(index=False, name=None) if by else ((),) * len(pdf)
            for key, w, centre, ts, ns, ms in zip(keys, pdf["_w"], pdf["_mean"], pdf["_ts"], pdf["_ns"], pdf["_ms"]):
                key = tuple(None if isinstance(v, float) and np.isnan(v) else v for v in key)
                if key not in held:
                    if (len(held) + 1) * k * (k + 1) > most:
                        yield from passed(held)
                        held = {}
                    held[key] = np.zeros((k, k + 1))
                at = np.array([number[t] for t in ts])
                sums = held[key]
                sums[at, at] += ns
                sums[np.ix_(at, at)] -= np.outer(ns, ns) / w
                sums[at, k] += ns * (ms - centre)
        yield from passed(held)

    def passed(held):
        for key, sums in held.items():
            i, j = np.nonzero(sums)
            use = j >= i
            i, j = i[use], j[use]
            yield pd.DataFrame({**dict(zip(by, ([v] * len(i) for v in key))), "_i": i, "_j": np.where(j == k, -1, j), "_v": sums[i, j]})

    kinds = dict(df.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in by] + ["_i int", "_j int", "_v double"])
    parts = blocks.mapInPandas(reduce, schema).groupBy(*by, "_i", "_j").agg(F.sum("_v").alias("_v"))
    parts = parts.groupBy(*by).agg(F.collect_list(F.struct(F.col("_i").alias("i"), F.col("_j").alias("j"), F.col("_v").alias("v"))).alias("equations"))
    s = _merge(_merge(tot, near.groupBy(*by).agg(apart.alias("ss_cells")), by), treated, by)
    names = F.array(*[F.lit(name) for name in number])
    return _merge(_merge(s, blocked, by), parts, by).withColumn("names", names)


def solve_absorbed(r: dict) -> dict:
    """Adjusted sums of squares of one row of `absorbed_sums`, and the effects of the treatments.

    Effects have the weighted mean 0.  Treatments and blocks that are not all connected leave some
    contrasts without an estimate: the degrees of freedom fall and the effects are None.
    """
    k = len(r["names"])
    c, q = np.zeros((k, k)), np.zeros(k)
    for e in r["equations"]:
        i, j, v = e["i"], e["j"], e["v"]
        if j < 0:
            q[i] = v
        else:
            c[i, j] = c[j, i] = v
    counts = {e["name"]: e["n"] for e in r["levels"]}
    size = np.array([counts.get(name, 0.0) for name in r["names"]])
    scale = np.sqrt(np.where(size > 0, size, 1.0))
    values, vectors = np.linalg.eigh(c / np.outer(scale, scale))
    use = values > ALIAS_TOLERANCE
    rank = int(use.sum())
    turned = vectors[:, use].T @ (q / scale)
    adjusted = float((turned ** 2 / values[use]).sum())
    effects = (vectors[:, use] @ (turned / values[use])) / scale
    effects -= (effects * size).sum() / size.sum()
    connected = rank == int((size > 0).sum()) - 1
    ss_block = max(r["ss_cells"] - r["ss_within"], 0.0)
    return {"rank": rank, "ss_block": ss_block, "ss_treatment_adj": adjusted, "ss_block_adj": max(ss_block + adjusted - r["ss_treatment"], 0.0),
            "sse": max(r["ss_cell"] + r["ss_within"] - adjusted, 0.0), "dfe": float(r["n"] - r["blocks"] - rank),
            "df_block": float(r["blocks"] - 1), "df_block_adj": float(r["blocks"] - 1 + rank - (r["treatments"] - 1)),
            "effects": [{"level": name, "n": int(counts[name]), "mean": next(e["mean"] for e in r["levels"] if e["name"] == name),
                         "adjusted": float(r["grand"] + effects[i]) if connected else None} for i, name in enumerate(r["names"]) if name in counts]}


_ABSORBED = ("rank int, ss_block double, ss_treatment_adj double, ss_block_adj double, sse double, dfe double, df_block double, df_block_adj double, "
             "effects array<struct<level: string, n: bigint, mean: double, adjusted: double>>")


def absorbed_anova(df: DataFrame, y: str, treatment: str, block: str, by: Sequence[str] = ()) -> DataFrame:
    """Blocks and treatments (main effects) for any number of blocks, in the form of `Model.anova`.

    The blocks come first in the sequential sums.  Rows without a finite `y` are left out, NULL levels are
    one level, repeated rows count as often as they come, an empty table gives no rows.  `df` of the block's adjusted
    line counts what the treatments leave of it, so it is smaller where they are not connected.
    """
    s = gram.per_group(absorbed_sums(df, y, treatment, block, by).withColumn("ss_t", F.col("ss_treatment")),
                       lambda r: solve_absorbed(r) | {"ss_t": r["ss_t"]}, by, _ABSORBED + ", ss_t double")
    mse = ratio(F.col("sse"), F.col("dfe"))
    line = lambda at, term, d, seq, adj: F.struct(F.lit(at).alias("position"), F.lit(term).alias("term"), d.alias("df"),
                                                  F.col(seq).alias("ss_seq"), F.col(adj).alias("ss_adj"))
    lines = F.array(line(0, block, F.col("df_block"), "ss_block", "ss_block_adj"),
                    line(1, treatment, F.col("rank").cast("double"), "ss_treatment_adj", "ss_treatment_adj"))
    t = s.select(*by, "dfe", mse.alias("_mse"), "df_block_adj", F.explode(lines).alias("_l"))
    t = t.select(*by, "_l.position", "_l.term", "_l.df", "_l.ss_seq", "_l.ss_adj", "dfe", "_mse",
                 F.when(F.col("_l.position") == 0, F.col("df_block_adj")).otherwise(F.col("_l.df")).alias("df_adj"))
    t = t.withColumns({"f_seq": ratio(F.col("ss_seq"), F.col("df") * F.col("_mse")), "f_adj": ratio(F.col("ss_adj"), F.col("df_adj") * F.col("_mse"))})
    return t.withColumns({"p_seq": dist.apply(dist.f_sf, F.col("f_seq"), F.col("df"), F.col("dfe")),
                          "p_adj": dist.apply(dist.f_sf, F.col("f_adj"), F.col("df_adj"), F.col("dfe"))}).drop("_mse")


def absorbed_means(df: DataFrame, y: str, treatment: str, block: str, by: Sequence[str] = ()) -> DataFrame:
    """Means of the treatments, as they are and adjusted for any number of blocks (NULL where not connected)."""
    s = gram.per_group(absorbed_sums(df, y, treatment, block, by), solve_absorbed, by, _ABSORBED)
    return s.select(*by, F.explode("effects").alias("_e")).select(*by, "_e.level", "_e.n", "_e.mean", "_e.adjusted")


def latin_square_anova(df: DataFrame, y: str, treatment: str, row: str, column: str, by: Sequence[str] = ()) -> Model:
    return linear_model(df, y, [row, column, treatment], [row, column, treatment], by)


def split_plot_anova(df: DataFrame, y: str, hard: str, easy: str, whole_plot: str, by: Sequence[str] = ()) -> DataFrame:
    """Hard factor tested against whole plots within it, easy factor and interaction against the residual.

    `whole_plot` identifies the plots; they are nested in the levels of `hard`.
    """
    full = linear_model(df, y, [hard, easy, f"{hard}*{easy}"], [hard, easy], by)
    x = finite(y)
    rows = df.where(x.isNotNull()).withColumns({"_h": level(hard), "_w": level(whole_plot)})
    plots = rows.groupBy(*by, "_h", "_w").agg(F.count(x).alias("n"), F.avg(x).alias("m"))
    hards = plots.groupBy(*by, "_h").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("_hm"), F.count(F.lit(1)).alias("_k"))
    keys = [*by, "_h"]
    within = attach(plots, hards, keys)
    plot = within.groupBy(*by).agg(F.sum(F.col("n") * (F.col("m") - F.col("_hm")) ** 2).alias("_ssw"), F.count(F.lit(1)).alias("_plots"),
                                   F.count_distinct("_h").alias("_hards"))
    t = attach(full.table.select(*by, "sse", "dfe", "term_df", "ss_adj"), plot, by)
    df_plot = (F.col("_plots") - F.col("_hards")).cast("double")
    sub_ss, sub_df = F.col("sse") - F.col("_ssw"), F.col("dfe") - df_plot
    lines = F.array(
        *[F.struct(F.lit(name).alias("source"), F.get("term_df", F.lit(i)).alias("df"), F.get("ss_adj", F.lit(i)).alias("ss"),
                   F.lit("whole" if i == 0 else "sub").alias("stratum"))
          for i, name in enumerate([hard, easy, f"{hard}*{easy}"])],
        F.struct(F.lit("whole plot error").alias("source"), df_plot.alias("df"), F.col("_ssw").alias("ss"), F.lit(None).cast("string").alias("stratum")),
        F.struct(F.lit("sub plot error").alias("source"), sub_df.alias("df"), sub_ss.alias("ss"), F.lit(None).cast("string").alias("stratum")))
    t = t.select(*by, F.posexplode(lines).alias("position", "_l"), (F.col("_ssw") / df_plot).alias("_mw"), (sub_ss / sub_df).alias("_ms"),
                 df_plot.alias("_dw"), sub_df.alias("_ds"))
    whole = F.col("_l.stratum") == "whole"
    t = t.select(*by, "position", "_l.source", "_l.df", "_l.ss", (F.col("_l.ss") / F.col("_l.df")).alias("ms"), F.col("_l.stratum").alias("_st"),
                 F.when(whole, F.col("_mw")).otherwise(F.col("_ms")).alias("_den"), F.when(whole, F.col("_dw")).otherwise(F.col("_ds")).alias("_dd"))
    t = t.withColumn("f", F.when(F.col("_st").isNotNull(), ratio(F.col("ms"), F.col("_den"))))
    return t.withColumn("p_value", dist.apply(dist.f_sf, F.col("f"), F.col("df"), F.col("_dd"))).drop("_st", "_den", "_dd")


# ------------------------------------------------------ variance components

def _coefficients(r: dict, nested: bool, pooled: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(matrix, sums of squares, degrees of freedom): expected sums of squares are matrix x components.

    Sources and components are a, b, (ab,) error; Henderson's first method, from the cell sizes n_ij only.
    """
    n, a, b, c, k1, k2, k3, k4, k12 = (float(r[k]) for k in ("n", "a", "b", "cells", "k1", "k2", "k3", "k4", "k12"))
    if nested:
        return (np.array([[n - k1, k3 - k12, a - 1], [0, n - k3, c - a], [0, 0, n - c]]),
                np.array([r["ss_a"], r["ss_cells"] - r["ss_a"], r["ss_error"]]), np.array([a - 1, c - a, n - c]))
    m = np.array([[n - k1, k3 - k2, k3 - k12, a - 1], [k4 - k1, n - k2, k4 - k12, b - 1],
                  [k1 - k4, k2 - k3, n - k3 - k4 + k12, c - a - b + 1], [0, 0, 0, n - c]])
    ss = np.array([r["ss_a"], r["ss_b"], r["ss_cells"] - r["ss_a"] - r["ss_b"], r["ss_error"]])
    df = m[:, 3].copy()
    if pooled:  # no interaction: its sum of squares joins the error
        m = np.vstack([m[:2], m[2] + m[3]])[:, [0, 1, 3]]
        ss, df = np.append(ss[:2], ss[2] + ss[3]), np.append(df[:2], df[2] + df[3])
    return m, ss, df


def henderson(r: dict, nested: bool = False, pooled: bool = False) -> dict:
    """Components of variance of one group, with F ratios against mean squares of the same expectation.

    The denominator of a source is the combination of mean squares that expects what its own would without its
    component; its degrees of freedom are Satterthwaite's.  For equal cells these are the textbook tests.
    Without replicates the error is part of the last source.  What cannot be solved is NULL.
    """
    names = ["a", "b", "error"] if nested or pooled else ["a", "b", "ab", "error"]
    m, ss, df = _coefficients(r, nested, pooled)
    own = len(names)
    if df[-1] <= 0 and not pooled:
        own -= 1
        m, ss, df = m[:own, :own], ss[:own], df[:own]
    out: dict = {f"{what}_{k}": None for what in ("ss", "df", "ms", "f", "df_den", "raw") for k in ("a", "b", "ab", "error")}
    for k, s, d in zip(names, ss, df):
        out |= {f"ss_{k}": float(s), f"df_{k}": float(d), f"ms_{k}": float(s / d) if d > 0 else None}
    if own < len(names):
        out |= {"ss_error": 0.0, "df_error": 0.0, "raw_error": 0.0}
    scale = np.abs(m).max(initial=0.0)
    if not scale or np.linalg.matrix_rank(m / scale, tol=1e-12) < own:
        return out
    inverse = np.linalg.inv(m)
    raw = inverse @ ss
    for i, k in enumerate(names[:own]):
        out[f"raw_{k}"] = float(raw[i])
        target = m[i].copy()
        target[i] = 0
        parts = (target @ inverse) * ss
        if k == "error" or df[i] <= 0:
            continue
        parts = np.where(np.abs(parts) > 1e-12 * np.abs(parts).max(initial=0.0), parts, 0.0)
        total = parts.sum()
        spread = sum(p * p / d for p, d in zip(parts, df) if d > 0)
        if total > 0 and spread > 0:
            out |= {f"f_{k}": float(ss[i] / total), f"df_den_{k}": float(total * total / spread)}
    return out


_HENDERSON = ", ".join(f"{what}_{k} double" for what in ("ss", "df", "ms", "f", "df_den", "raw") for k in ("a", "b", "ab", "error"))


def two_way_sums(df: DataFrame, value: str, a: str, b: str, by: Sequence[str] = (), nested: bool = False) -> DataFrame:
    """Per group: sizes and centred sums of squares of the cells of two factors, from one pass over the rows."""
    x = finite(value)
    rows = df.select(*by, level(a).alias("_a"), level(b).alias("_b"), x.alias("_x")).where("_x is not null")
    cells = rows.groupBy(*by, "_a", "_b").agg(F.count(F.lit(1)).cast("double").alias("_n"), F.avg("_x").alias("_m"),
                                              (F.var_pop("_x") * F.count(F.lit(1))).alias("_ss"))
    cells = persist(cells)
    n, m = F.col("_n"), F.col("_m")
    mean = F.sum(n * m) / F.sum(n)
    tot = persist(cells.groupBy(*by).agg(F.sum(n).alias("n"), mean.alias("grand"), F.sum("_ss").alias("ss_error"), F.min("_n").alias("_n0"),
                                         F.max("_n").alias("_n1"), F.count(F.lit(1)).alias("cells"), (F.sum(n * n) / F.sum(n)).alias("k12")))
    g = F.col("grand")

    def margin(key: str, names: tuple[str, str, str]) -> DataFrame:
        own = cells.groupBy(*by, key).agg(F.sum(n).alias("_w"), mean.alias("_mean"), (F.sum(n * n) / F.sum(n)).alias("_q"), F.count(F.lit(1)).alias("_k"))
        own = attach(own, tot.select(*by, "grand", "n"), by, ready=True)
        w = F.col("_w")
        return own.groupBy(*by).agg(F.count(F.lit(1)).alias(key[1:]), (F.sum(w * w) / F.first("n")).alias(names[0]), F.sum("_q").alias(names[1]),
                                    F.sum(w * (F.col("_mean") - g) ** 2).alias(names[2]), F.min("_k").alias(key + "0"), F.max("_k").alias(key + "1"))

    between = attach(cells, tot.select(*by, "grand"), by, ready=True).groupBy(*by).agg(F.sum(n * (m - g) ** 2).alias("ss_cells"))
    s = _merge(_merge(_merge(tot, between, by), margin("_a", ("k1", "k3", "ss_a")), by), margin("_b", ("k2", "k4", "ss_b")), by)
    even = (F.col("_n0") == F.col("_n1")) & (F.col("_a0") == F.col("_a1"))
    balanced = even if nested else even & (F.col("cells") == F.col("a") * F.col("b"))
    levels_b = F.col("_a1") if nested else F.col("b")
    return s.withColumns({"balanced": balanced, "b": levels_b, "replicates": F.col("_n1").cast("bigint")}).drop("_n0", "_n1", "_a0", "_a1", "_b0", "_b1")


def solved_sums(s: DataFrame, by: Sequence[str], nested: bool = False, pooled: bool = False) -> DataFrame:
    """`two_way_sums` with the solution of `henderson` for every group, instead of the sizes and sums it came from."""
    carried = ["balanced", "a", "b", "cells", "replicates", "n", "grand"]
    kinds = dict(s.dtypes)
    fields = ", ".join(f"{c} {kinds[c]}" for c in carried) + ", " + _HENDERSON
    return gram.per_group(s, lambda r: {c: r[c] for c in carried} | henderson(r, nested, pooled), by, fields)


def variance_components(df: DataFrame, value: str, a: str, b: str, by: Sequence[str] = (), nested: bool = False) -> DataFrame:
    """Two-factor random model, crossed or nested (b inside a), one row per group.

    Cells may have any sizes and may be missing: expected sums of squares follow Henderson's first method, and the
    components are their solution, negative ones set to 0.  For equal cells these are the classical estimates.  `replicates`
    is the largest cell, `cells` the number of cells with values, and nested `b` the largest number of levels
    inside one a.  The interaction sum of squares of unequal cells can be negative.  F ratios have denominators
    of the same expectation (`df_den_*` is Satterthwaite's); they are NULL where none is positive.
    """
    s = solved_sums(two_way_sums(df, value, a, b, by, nested), by, nested).withColumn("n", F.col("n").cast("bigint"))
    zero = F.lit(0.0)
    s = s.withColumns({f"var_{k}": zero if nested and k == "ab" else F.greatest(zero, F.col(f"raw_{k}")) for k in ("a", "b", "ab", "error")})
    s = s.withColumn("var_error", F.coalesce("var_error", zero))
    s = s.withColumns({"var_a": F.when(F.col("raw_a").isNotNull(), F.col("var_a")), "var_b": F.when(F.col("raw_b").isNotNull(), F.col("var_b")),
                       **({} if nested else {"var_ab": F.when(F.col("raw_ab").isNotNull(), F.col("var_ab"))})})
    s = s.withColumn("var_total", F.col("var_a") + F.col("var_b") + F.col("var_ab") + F.col("var_error"))
    if nested:
        s = s.withColumns({"ss_ab": zero, "df_ab": zero})
    s = s.withColumns({f"p_{k}": dist.apply(dist.f_sf, F.col(f"f_{k}"), F.col(f"df_{k}"), F.col(f"df_den_{k}")) for k in ("a", "b", "ab")})
    numbers = [c for c in s.columns if c.split("_")[0] in ("ss", "df", "ms", "f", "var") and c not in ("f_error", "df_den_error")]
    return s.select(*by, "balanced", "a", "b", "cells", "replicates", "n", "grand", *sorted(numbers), "p_a", "p_b", "p_ab")
