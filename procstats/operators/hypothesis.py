"""Hypothesis tests: one distributed pass, then one row per group (or pair).

`alt` is two, less or greater.  Exact tails run as vectorised functions on the
aggregated rows only.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dist
from ..functions.normal import norm_cdf
from ..functions.numeric import finite, level, ratio
from ..plans.joining import attach, one_row
from ..plans.ordering import block_window, blocks, prefix, quantiles, sequence, value_order
from ..plans.session import persist
from .describe import _merge


SUM_BITS = 5  # each round of `median_of_sums` makes its grid so many bits finer
SUM_ROWS = 100_000  # pairs of values per group that are ordered at the end
MAX_SUM_BITS = 1000  # of the 1023 binary places doubles reach
EXACT_CELLS = 2.0 ** 47  # up to here, and one round finer, numbers of cells add without rounding


def p_from_t(t: Column, df: Column, alt: str) -> Column:
    if alt == "two":
        return dist.apply(dist.t_sf2, t, df)
    return dist.apply(dist.t_cdf, t if alt == "less" else -t, df)


def with_p_from_z(df: DataFrame, z: str, alt: str = "two", name: str = "p_value") -> DataFrame:
    tail = {"two": -F.abs(F.col(z)), "less": F.col(z), "greater": -F.col(z)}[alt]
    out = df.withColumn("_tail", tail)
    p = norm_cdf(F.col("_tail"))
    return out.withColumn(name, F.least(F.lit(1.0), 2 * p) if alt == "two" else p).drop("_tail")


def _z(conf: float) -> float:
    return float(dist.norm_ppf((1 + conf) / 2))


def _tail_probability(cdf: Column, alt: str) -> Column:
    return {"less": cdf, "greater": 1 - cdf,
            "two": F.least(F.lit(1.0), 2 * F.least(cdf, 1 - cdf))}[alt]


def _one_sample(df: DataFrame, value: str | Column, by: Sequence[str]) -> DataFrame:
    x = finite(value)
    return df.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"))


def _t_result(g: DataFrame, mu0: float, alt: str, conf: float) -> DataFrame:
    g = g.withColumns({"se": F.col("sd") / F.sqrt("n"), "df": (F.col("n") - 1).cast("double")})
    g = g.withColumn("t", ratio(F.col("mean") - mu0, F.col("se")))
    q = (1 + conf) / 2 if alt == "two" else conf
    half = dist.apply(dist.t_ppf, F.lit(q), F.col("df")) * F.col("se")
    g = g.withColumn("_half", half)
    low = F.col("mean") - F.col("_half") if alt != "less" else F.lit(None).cast("double")
    high = F.col("mean") + F.col("_half") if alt != "greater" else F.lit(None).cast("double")
    return g.withColumns({"p_value": p_from_t(F.col("t"), F.col("df"), alt), "ci_low": low, "ci_high": high,
                          "effect": ratio(F.col("mean") - mu0, F.col("sd"))}).drop("_half")


def t_test(df: DataFrame, value: str, mu0: float = 0.0, by: Sequence[str] = (), alt: str = "two",
           conf: float = 0.95) -> DataFrame:
    """One-sample t."""
    return _t_result(_one_sample(df, value, by), mu0, alt, conf)


def z_test(df: DataFrame, value: str, mu0: float, sigma: float, by: Sequence[str] = (), alt: str = "two",
           conf: float = 0.95) -> DataFrame:
    """One-sample z with known sigma."""
    g = _one_sample(df, value, by).drop("sd").withColumn("se", F.lit(float(sigma)) / F.sqrt("n"))
    g = g.withColumn("z", (F.col("mean") - mu0) / F.col("se"))
    g = g.withColumns({"ci_low": F.col("mean") - _z(conf) * F.col("se"), "ci_high": F.col("mean") + _z(conf) * F.col("se")})
    return with_p_from_z(g, "z", alt)


def t_test_paired(df: DataFrame, first: str, second: str, by: Sequence[str] = (), diff: float = 0.0, alt: str = "two",
                  conf: float = 0.95) -> DataFrame:
    """t on row differences of complete pairs."""
    x, y = finite(first), finite(second)
    g = _one_sample(df.withColumn("_d", x - y), "_d", by)
    sides = df.groupBy(*by).agg(F.avg(x).alias("mean1"), F.avg(y).alias("mean2"))
    return _merge(_t_result(g, diff, alt, conf), sides, by)


def two_samples(df: DataFrame, value: str, group: str, levels: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """n, mean, sd and variance of two named levels in one pass."""
    x, g = finite(value), level(group)
    aggs = []
    for i, name in enumerate(levels, 1):
        xi = F.when(g == str(name), x)
        aggs += [F.count(xi).alias(f"n{i}"), F.avg(xi).alias(f"mean{i}"), F.stddev_samp(xi).alias(f"sd{i}")]
    return df.where(g.isin([str(v) for v in levels])).groupBy(*by).agg(*aggs)


def _two_sample_t(g: DataFrame, pooled: bool) -> DataFrame:
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    v1, v2 = F.col("sd1") ** 2, F.col("sd2") ** 2
    sp2 = ((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)
    if pooled:
        se, dof = F.sqrt(sp2 * (1 / n1 + 1 / n2)), n1 + n2 - 2
    else:
        a, b = v1 / n1, v2 / n2
        se, dof = F.sqrt(a + b), (a + b) ** 2 / (a * a / (n1 - 1) + b * b / (n2 - 1))
    g = g.withColumns({"diff": F.col("mean1") - F.col("mean2"), "se": se, "df": dof})
    return g.withColumn("cohen_d", ratio(F.col("diff"), F.sqrt(sp2)))


def t_test_two(df: DataFrame, value: str, group: str, levels: Sequence[str], by: Sequence[str] = (),
               pooled: bool = False, diff: float = 0.0, alt: str = "two", conf: float = 0.95) -> DataFrame:
    """Two-sample t, Welch unless `pooled`."""
    g = _two_sample_t(two_samples(df, value, group, levels, by), pooled)
    g = g.withColumn("t", ratio(F.col("diff") - diff, F.col("se")))
    half = dist.apply(dist.t_ppf, F.lit((1 + conf) / 2), F.col("df"))
    g = g.withColumns({"_half": half, "p_value": p_from_t(F.col("t"), F.col("df"), alt)})
    return g.withColumns({"ci_low": F.col("diff") - F.col("_half") * F.col("se"),
                          "ci_high": F.col("diff") + F.col("_half") * F.col("se")}).drop("_half")


def equivalence_test(df: DataFrame, value: str, lower: float, upper: float, group: str | None = None,
                     levels: Sequence[str] = (), by: Sequence[str] = (), target: float = 0.0, pooled: bool = False,
                     alpha: float = 0.05) -> DataFrame:
    """TOST on one mean against a target or on two means."""
    if group:
        g = _two_sample_t(two_samples(df, value, group, levels, by), pooled)
    else:
        g = _one_sample(df, value, by).withColumns({
            "diff": F.col("mean") - target, "se": F.col("sd") / F.sqrt("n"), "df": (F.col("n") - 1).cast("double")})
    g = g.select(*by, "diff", "se", "df", ((F.col("diff") - lower) / F.col("se")).alias("t_lower"),
                 ((F.col("diff") - upper) / F.col("se")).alias("t_upper"))
    g = g.withColumns({"p_lower": p_from_t(F.col("t_lower"), F.col("df"), "greater"),
                       "p_upper": p_from_t(F.col("t_upper"), F.col("df"), "less"),
                       "_half": dist.apply(dist.t_ppf, F.lit(1 - alpha), F.col("df"))})
    g = g.withColumn("p_value", F.greatest("p_lower", "p_upper"))
    return g.withColumns({"ci_low": F.col("diff") - F.col("_half") * F.col("se"),
                          "ci_high": F.col("diff") + F.col("_half") * F.col("se"),
                          "equivalent": F.col("p_value") < alpha}).drop("_half")


# --------------------------------------------------------- proportions

def proportion_test(df: DataFrame, success: Column, by: Sequence[str] = (), p0: float = 0.5, alt: str = "two",
                    conf: float = 0.95) -> DataFrame:
    """One proportion: z, exact binomial p, Wilson and Clopper-Pearson intervals."""
    g = df.groupBy(*by).agg(F.count_if(success).alias("x"), F.count(F.lit(1)).alias("n"))
    n, zc = F.col("n").cast("double"), _z(conf)
    g = g.withColumn("p_hat", F.col("x") / n)
    ph = F.col("p_hat")
    g = g.withColumn("z", (ph - p0) / F.sqrt(p0 * (1 - p0) / n))
    den, mid = 1 + zc * zc / n, ph + zc * zc / (2 * n)
    half = zc * F.sqrt(ph * (1 - ph) / n + zc * zc / (4 * n * n))
    exact = {"two": lambda: dist.apply(dist.binom_test_two_sided, F.col("x"), F.col("n"), F.lit(p0)),
             "less": lambda: dist.apply(dist.binom_cdf, F.col("x"), F.col("n"), F.lit(p0)),
             "greater": lambda: 1 - dist.apply(dist.binom_cdf, F.col("x") - 1, F.col("n"), F.lit(p0))}[alt]()
    g = g.withColumns({"wilson_low": (mid - half) / den, "wilson_high": (mid + half) / den, "p_exact": exact,
                       "exact_low": dist.apply(dist.clopper_low, F.col("x"), F.col("n"), F.lit(conf)),
                       "exact_high": dist.apply(dist.clopper_high, F.col("x"), F.col("n"), F.lit(conf)),
                       "normal_ok": (n * p0 >= 5) & (n * (1 - p0) >= 5)})
    return with_p_from_z(g, "z", alt)


def _two_counts(df: DataFrame, success: Column, group: str, levels: Sequence[str], by: Sequence[str]) -> DataFrame:
    g = level(group)
    aggs = []
    for i, v in enumerate(levels, 1):
        aggs += [F.count_if((g == str(v)) & success).alias(f"x{i}"), F.count_if(g == str(v)).alias(f"n{i}")]
    return df.where(g.isin([str(v) for v in levels])).groupBy(*by).agg(*aggs)


def proportion_test_two(df: DataFrame, success: Column, group: str, levels: Sequence[str], by: Sequence[str] = (),
                        alt: str = "two", conf: float = 0.95) -> DataFrame:
    """Two proportions: pooled z, interval of the difference, Fisher p, relative risk, odds ratio."""
    g = _two_counts(df, success, group, levels, by)
    x1, n1, x2, n2 = (F.col(c).cast("double") for c in ("x1", "n1", "x2", "n2"))
    p1, p2, pp = x1 / n1, x2 / n2, (x1 + x2) / (n1 + n2)
    half = _z(conf) * F.sqrt(p1 * (1 - p1) / n1 + p2 * (1 - p2) / n2)
    g = g.withColumns({
        "p1": p1, "p2": p2, "diff": p1 - p2,
        "z": ratio(p1 - p2, F.sqrt(pp * (1 - pp) * (1 / n1 + 1 / n2))), "ci_low": p1 - p2 - half, "ci_high": p1 - p2 + half,
        "relative_risk": ratio(p1, p2), "odds_ratio": ratio(ratio(x1, n1 - x1), ratio(x2, n2 - x2)),
        "p_fisher": fisher_p(x1, n1 - x1, x2, n2 - x2, alt)})
    return with_p_from_z(g, "z", alt)


def fisher_p(a: Column, b: Column, c: Column, d: Column, alt: str = "two") -> Column:
    return dist.apply({"two": dist.fisher_two_sided, "less": dist.fisher_less, "greater": dist.fisher_greater}[alt], a, b, c, d)


def fisher_exact(df: DataFrame, first: Column, second: Column, by: Sequence[str] = (), alt: str = "two") -> DataFrame:
    """2x2 table of two conditions: counts, odds ratio and exact p."""
    g = df.groupBy(*by).agg(
        F.count_if(first & second).alias("a"), F.count_if(first & ~second).alias("b"),
        F.count_if(~first & second).alias("c"), F.count_if(~first & ~second).alias("d"))
    a, b, c, d = (F.col(k).cast("double") for k in "abcd")
    return g.withColumns({"odds_ratio": ratio(a * d, b * c), "p_value": fisher_p(a, b, c, d, alt)})


# ----------------------------------------------------------- variances

def variance_test(df: DataFrame, value: str, sigma0: float, by: Sequence[str] = (), alt: str = "two",
                  conf: float = 0.95) -> DataFrame:
    """Chi-square test of one variance with the interval of sd."""
    x = finite(value)
    g = df.groupBy(*by).agg(F.count(x).alias("n"), F.stddev_samp(x).alias("sd"), F.var_samp(x).alias("variance"))
    g = g.withColumns({"df": (F.col("n") - 1).cast("double"), "chisq": (F.col("n") - 1) * F.col("variance") / sigma0**2})
    g = g.withColumns({"_cdf": dist.apply(dist.chi2_cdf, F.col("chisq"), F.col("df")),
                       "_hi": dist.apply(dist.chi2_ppf, F.lit((1 + conf) / 2), F.col("df")),
                       "_lo": dist.apply(dist.chi2_ppf, F.lit((1 - conf) / 2), F.col("df"))})
    ss = F.col("df") * F.col("variance")
    return g.withColumns({"p_value": _tail_probability(F.col("_cdf"), alt), "ci_sd_low": F.sqrt(ss / F.col("_hi")),
                          "ci_sd_high": F.sqrt(ss / F.col("_lo"))}).drop("_cdf", "_hi", "_lo")


def variance_test_two(df: DataFrame, value: str, group: str, levels: Sequence[str], by: Sequence[str] = (),
                      alt: str = "two", conf: float = 0.95) -> DataFrame:
    """F ratio of two variances, its interval and the Brown-Forsythe statistic."""
    g = two_samples(df, value, group, levels, by)
    g = g.withColumns({"f": ratio(F.col("sd1") ** 2, F.col("sd2") ** 2), "df1": (F.col("n1") - 1).cast("double"),
                       "df2": (F.col("n2") - 1).cast("double")})
    a = (1 - conf) / 2
    g = g.withColumns({"_cdf": dist.apply(dist.f_cdf, F.col("f"), F.col("df1"), F.col("df2")),
                       "_hi": dist.apply(dist.f_ppf, F.lit(1 - a), F.col("df1"), F.col("df2")),
                       "_lo": dist.apply(dist.f_ppf, F.lit(a), F.col("df1"), F.col("df2"))})
    g = g.withColumns({"p_value": _tail_probability(F.col("_cdf"), alt), "ci_ratio_low": F.col("f") / F.col("_hi"),
                       "ci_ratio_high": F.col("f") / F.col("_lo")}).drop("_cdf", "_hi", "_lo")
    lev = levene(df.where(level(group).isin([str(v) for v in levels])), value, group, by)
    return _merge(g, lev.select(*by, F.col("w").alias("levene_w"), F.col("p_value").alias("levene_p")), by)


def one_way_sums(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """Between and within sums of squares from (n, mean, var) rows, one per level."""
    n, m = F.col("n").cast("double"), F.col("mean")
    within = F.coalesce(F.col("var"), F.lit(0.0)) * (n - 1)
    g = cells.where("n > 0").groupBy(*by).agg(
        F.count(F.lit(1)).alias("k"), F.sum(n).alias("total_n"), F.sum(n * m).alias("_s"), F.sum(n * m * m).alias("_q"),
        F.sum(within).alias("ss_within"), F.var_pop(m).alias("_vm"), F.min("n").alias("_n0"), F.max("n").alias("_n1"))
    # equal sizes use the stable variance of the means, unequal sizes centre first
    between = F.when(F.col("_n0") == F.col("_n1"), F.col("_vm") * F.col("total_n")).otherwise(
        F.col("_q") - F.col("_s") * F.col("_s") / F.col("total_n"))
    return g.withColumns({"grand_mean": F.col("_s") / F.col("total_n"), "ss_between": between}).drop(
        "_s", "_q", "_vm", "_n0", "_n1")


def cell_statistics(df: DataFrame, value: str, group: str, by: Sequence[str] = (), centre: bool = True) -> DataFrame:
    """One row per (by, level): n, mean, var."""
    x = finite(value)
    return df.groupBy(*by, level(group).alias("level")).agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.var_samp(x).alias("var")).where("n > 0")


def levene(df: DataFrame, value: str, group: str, by: Sequence[str] = (), use_mean: bool = False) -> DataFrame:
    """F on absolute deviations from the level median (or mean)."""
    rows = df.withColumn("_g", level(group))
    keys = [*by, "_g"]
    x = finite(value)
    if use_mean:
        centre = rows.groupBy(*keys).agg(F.avg(x).alias("_c"))
    else:
        centre = quantiles(rows, value, {"_c": (0.5, 7)}, keys).drop("n")
    dev = attach(rows.select(*keys, x.alias("_x")), centre, keys)
    dev = dev.withColumn("_d", F.abs(F.col("_x") - F.col("_c")))
    s = one_way_sums(cell_statistics(dev, "_d", "_g", by), by)
    k, n = F.col("k"), F.col("total_n")
    out = s.select(*by, ratio((n - k) * F.col("ss_between"), (k - 1) * F.col("ss_within")).alias("w"),
                   (k - 1).cast("double").alias("df1"), (n - k).alias("df2"))
    return out.withColumn("p_value", dist.apply(dist.f_sf, F.col("w"), F.col("df1"), F.col("df2")))


def bartlett(df: DataFrame, value: str, group: str, by: Sequence[str] = ()) -> DataFrame:
    """Homogeneity of variances under normality."""
    cells = cell_statistics(df, value, group, by)
    n1 = F.col("n").cast("double") - 1
    g = cells.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_k"), F.sum("n").alias("_n"), F.sum(n1 * F.col("var")).alias("_ss"),
        F.sum(n1 * F.ln("var")).alias("_log"), F.sum(1 / n1).alias("_inv"))
    k, nk = F.col("_k"), F.col("_n") - F.col("_k")
    sp = F.col("_ss") / nk
    t = (nk * F.ln(sp) - F.col("_log")) / (1 + (F.col("_inv") - 1 / nk) / (3 * (k - 1)))
    out = g.select(*by, t.alias("t"), (k - 1).cast("double").alias("df"), F.sqrt(sp).alias("sd_pooled"))
    return out.withColumn("p_value", dist.apply(dist.chi2_sf, F.col("t"), F.col("df")))


# ------------------------------------------------------------ rank tests

def _ranked_levels(df: DataFrame, value: str, group: str, by: Sequence[str]) -> DataFrame:
    """(by, level, value, count, rank, tie size): frequencies, not rows, carry the ranks."""
    rows = df.select(*by, level(group).alias("_g"), finite(value).alias("_x")).where("_x is not null")
    rows = rows.withColumn("_x", F.when(F.col("_x") == 0, F.lit(0.0)).otherwise(F.col("_x")))
    cells = persist(rows.groupBy(*by, "_g", "_x").agg(F.count(F.lit(1)).alias("_c")))
    order = value_order(cells, "_x", by, weight="_c")
    order = order.withColumn("_rank", F.col("below") + (F.col("freq") + 1) / 2)
    names = {k: "_k_" + k for k in by}
    cond = [F.col("_x") == F.col("_k_x")] + [F.col(k).eqNullSafe(F.col(v)) for k, v in names.items()]
    return cells.join(order.withColumnsRenamed({**names, "_x": "_k_x"}), cond).drop("_k_x", *names.values())


def _tie_term() -> Column:
    """Per-level rows of a tie share its t^3 - t in proportion to their count."""
    t, c = F.col("freq").cast("double"), F.col("_c").cast("double")
    return F.sum((t * t - 1) * c)


def mann_whitney(df: DataFrame, value: str, group: str, levels: Sequence[str], by: Sequence[str] = (),
                 alt: str = "two", estimate: bool = True) -> DataFrame:
    """Rank-sum test with tie and continuity corrections, medians and Hodges-Lehmann shift."""
    a, b = (str(v) for v in levels)
    both = df.where(level(group).isin([a, b]))
    r = _ranked_levels(both, value, group, by)
    c = F.col("_c").cast("double")
    g = r.groupBy(*by).agg(
        F.sum(F.when(F.col("_g") == a, c).otherwise(0.0)).alias("_n1"), F.sum(F.when(F.col("_g") == b, c).otherwise(0.0)).alias("_n2"),
        F.sum(F.when(F.col("_g") == a, c * F.col("_rank")).otherwise(0.0)).alias("w"), _tie_term().alias("_ties"))
    n1, n2 = F.col("_n1"), F.col("_n2")
    n = n1 + n2
    g = g.withColumn("u", F.col("w") - n1 * (n1 + 1) / 2)
    sig = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("_ties") / (n * (n - 1))))
    z = (F.col("u") - n1 * n2 / 2) / sig
    g = g.withColumns({"u2": n1 * n2 - F.col("u"), "_z": z, "_sig": sig})
    g = g.withColumn("z", F.col("_z") - F.signum("_z") * 0.5 / F.col("_sig"))
    g = with_p_from_z(g, "z", alt).select(*by, n1.cast("bigint").alias("n1"), n2.cast("bigint").alias("n2"),
                                          "w", "u", "u2", "z", "p_value")
    med = quantiles(both.withColumn("_g", level(group)), value, {"_m": (0.5, 7)}, [*by, "_g"])
    med = med.groupBy(*by).agg(F.max(F.when(F.col("_g") == a, F.col("_m"))).alias("median1"),
                               F.max(F.when(F.col("_g") == b, F.col("_m"))).alias("median2"))
    g = _merge(g, med, by)
    if estimate:
        x = both.where(level(group) == a).select(*by, finite(value).alias("_x"))
        y = both.where(level(group) == b).select(*by, (-finite(value)).alias("_x"))
        g = _merge(g, median_of_sums(x, y, by).withColumnRenamed("median", "hodges_lehmann"), by)
    return g


def median_of_sums(x: DataFrame, y: DataFrame, by: Sequence[str], walsh: bool = False) -> DataFrame:
    """Median of x_i + y_j over all pairs, exactly and without forming the pairs.

    Both samples are put on a grid whose cells, a power of two wide, get 2^SUM_BITS times
    finer every round.  Sums of cells lie on diagonals; pairs below and above the four diagonals
    around the middle order statistic are settled, and only cells on those four are joined for the
    next round.  A cell is one row, so no join key meets more than 2^SUM_BITS rows a side.  Once at
    most SUM_ROWS pairs of different values are left in each group, or they all have one sum, the values
    themselves are joined.  With `walsh` (y = x) the pairs are i <= j and the result is the
    median of the averages.
    """
    keys = [*by, "_all"]

    def frequencies(f):
        rows = f.where("_x is not null").withColumns({"_x": F.col("_x") + 0.0, "_all": F.lit(0)})
        return persist(rows.groupBy(*keys, "_x").agg(F.count(F.lit(1)).alias("_c")))

    fx = frequencies(x)
    fy = fx if walsh else frequencies(y)
    sizes = [f.groupBy(*keys).agg(F.sum("_c").alias("_n" + p), F.max(F.abs("_x")).alias("_h" + p)) for f, p in ((fx, "x"), (fy, "y"))]
    sides = attach(sizes[0], sizes[1], keys)
    # unordered pairs count twice: once in either order, equal positions once more
    twice = 2 if walsh else 1
    n = F.expr("_nx * (_nx + 1) div 2") if walsh else F.col("_nx") * F.col("_ny")
    size = F.greatest("_hx", "_hy")
    state = persist(sides.withColumn("_n", n).select(
        *keys, F.lit(0.0).alias("_k"), F.lit(0).cast("bigint").alias("_base"),
        F.expr(f"array_distinct(array({twice} * ((_n + 1) div 2), {twice} * (_n div 2 + 1)))").alias("_ts"),
        F.when(size > 0, F.ceil(F.log2(size)) + 1).otherwise(0).cast("int").alias("_e")))
    scale = persist(state.select(*keys, "_e"))
    fx = persist(attach(fx, scale, keys, ready=True))
    fy = fx if walsh else persist(attach(fy, scale, keys, ready=True))
    state = state.drop("_e")
    bits, settled = 0, []
    while True:
        bits += SUM_BITS
        cells = [f.groupBy(*keys, _cell(F.col("_x"), bits).alias("_i")).agg(
            F.sum("_c").alias("_c"), F.count(F.lit(1)).alias("_d"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
            .withColumn("_cell", _floor(F.col("_i") / 2 ** SUM_BITS)) for f in (fx, fy)]
        found = _sums_near(*cells, state, keys, walsh)
        # at most some 6 * 2^SUM_BITS sums of cells per group
        line = Window.partitionBy(*keys, "_k").orderBy("_i")
        upto, below, near = (line.rangeBetween(*f) for f in ((Window.unboundedPreceding, 0), (Window.unboundedPreceding, -3), (-2, 1)))
        spread = F.max("_hi").over(near) - F.min("_lo").over(near) > 1e-15 * F.max("_size").over(near)
        found = found.select(
            *keys, "_i", "_ts", "_w", (F.col("_base") + F.sum("_w").over(upto)).alias("_cum"),
            (F.col("_base") + F.coalesce(F.sum("_w").over(below), F.lit(0))).alias("_below"),
            (spread & (F.sum("_pairs").over(near) > SUM_ROWS) & (F.abs("_i") < EXACT_CELLS)).alias("_open"))
        state = persist(_reached(found).groupBy(*keys, F.col("_i").alias("_k")).agg(
            F.first("_below").alias("_base"), F.collect_set("_t").alias("_ts"), F.max("_open").alias("_open")))
        settled.append(state.where(~F.col("_open") | F.lit(bits > MAX_SUM_BITS)).withColumn("_b", F.lit(bits)))
        state = state.where(F.col("_open") & F.lit(bits <= MAX_SUM_BITS))
        if not state.limit(1).count():
            break
    state = persist(reduce(DataFrame.unionByName, settled))
    levels = persist(state.select(*keys, "_b").distinct())
    values = [attach(f, levels, keys, ready=True).select(
        *keys, "_b", F.col("_x").alias("_i"), "_c", F.lit(1).alias("_d"), F.col("_x").alias("_lo"), F.col("_x").alias("_hi"),
        _cell(F.col("_x"), F.col("_b")).alias("_cell")) for f in (fx, fy)]
    line = Window.partitionBy(*keys, "_b", "_k").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    found = _sums_near(*values, state, [*keys, "_b"], walsh).withColumn("_cum", F.col("_base") + F.sum("_w").over(line))
    return _reached(found).groupBy(*by).agg((F.avg("_i") / twice).alias("median")).where("median is not null")


def _floor(v: Column) -> Column:
    """floor as a double; from 2^52 on every double is whole."""
    return F.when(F.abs(v) < 2.0 ** 52, F.floor(v).cast("double")).otherwise(v)


def _cell(v: Column, bits: int | Column) -> Column:
    """Number of the cell of width 2^(_e - bits) that holds `v`; powers of two lose no digits."""
    half = (-F.col("_e") / 2).cast("int")
    return _floor(v * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), bits - F.col("_e") - half))


def _sums_near(x: DataFrame, y: DataFrame, state: DataFrame, keys: Sequence[str], walsh: bool) -> DataFrame:
    """Per group and `_k`: each sum `_i` with its weight, for pairs whose cells lie on the diagonals _k - 2 to _k + 1."""
    x = attach(x, state.select(*keys, "_k", "_base", "_ts"), keys)
    diagonals = F.array_distinct(F.array(*[F.col("_k") + o - F.col("_cell") for o in (-2, -1, 0, 1)]))
    other = y.select(*[F.col(c).alias("_o" + c) for c in [*keys, "_cell", "_i", "_c", "_d", "_lo", "_hi"]])
    cond = F.col("_other") == F.col("_o_cell")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col("_o" + k))
    off = F.col("_cell") + F.col("_o_cell") - F.col("_k")  # a difference of huge cells may have been rounded
    met = x.withColumn("_other", F.explode(diagonals)).join(other, cond).where(off.between(-2, 1))
    size = F.greatest(*[F.abs(F.col(c)) for c in ("_lo", "_hi", "_o_lo", "_o_hi")])
    pairs = met.select(*keys, "_k", "_base", "_ts", (F.col("_i") + F.col("_o_i")).alias("_i"), (F.col("_c") * F.col("_o_c")).alias("_w"),
                       (F.col("_d") * F.col("_o_d")).alias("_pairs"), (F.col("_lo") + F.col("_o_lo")).alias("_lo"),
                       (F.col("_hi") + F.col("_o_hi")).alias("_hi"), size.alias("_size"))
    if walsh:
        same = x.where((2 * F.col("_cell") - F.col("_k")).between(-2, 1))
        pairs = pairs.unionByName(same.select(
            *keys, "_k", "_base", "_ts", (2 * F.col("_i")).alias("_i"), F.col("_c").alias("_w"), F.col("_d").cast("bigint").alias("_pairs"),
            (2 * F.col("_lo")).alias("_lo"), (2 * F.col("_hi")).alias("_hi"), F.greatest(F.abs("_lo"), F.abs("_hi")).alias("_size")))
    return pairs.groupBy(*keys, "_k", "_i").agg(
        F.first("_base").alias("_base"), F.first("_ts").alias("_ts"), F.sum("_w").alias("_w"), F.sum("_pairs").alias("_pairs"),
        F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"), F.max("_size").alias("_size"))


def _reached(found: DataFrame) -> DataFrame:
    """Rows at which the running weight reaches one of the wanted positions, one per position."""
    passed = F.filter("_ts", lambda t: (t <= F.col("_cum")) & (t > F.col("_cum") - F.col("_w")))
    return found.withColumn("_t", F.explode(passed))


def wilcoxon_signed(df: DataFrame, value: str, mu0: float = 0.0, by: Sequence[str] = (), alt: str = "two",
                    estimate: bool = True) -> DataFrame:
    """Signed-rank test with tie correction and the Walsh-average estimate."""
    d = df.select(*by, (finite(value) - mu0).alias("_v")).where("_v is not null")
    nz = d.where("_v <> 0").select(*by, F.abs("_v").alias("_a"), F.when(F.col("_v") > 0, "up").otherwise("dn").alias("_sign"))
    r = _ranked_levels(nz, "_a", "_sign", by)
    c = F.col("_c").cast("double")
    g = r.groupBy(*by).agg(
        F.sum("_c").alias("n"), F.sum(F.when(F.col("_g") == "up", c * F.col("_rank")).otherwise(0.0)).alias("w"),
        F.sum(F.when(F.col("_g") == "dn", c * F.col("_rank")).otherwise(0.0)).alias("w_minus"), _tie_term().alias("_ties"))
    n = F.col("n").cast("double")
    sig = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("_ties") / 48)
    g = with_p_from_z(g.withColumn("z", (F.col("w") - n * (n + 1) / 4) / sig), "z", alt).drop("_ties")
    g = _merge(g, quantiles(df, value, {"median": (0.5, 7)}, by).drop("n"), by)
    if estimate:
        x = d.where("_v <> 0").select(*by, F.col("_v").alias("_x"))
        hl = median_of_sums(x, x, by, walsh=True)
        g = _merge(g, hl.withColumn("hodges_lehmann", F.col("median") + mu0).drop("median"), by)
    return g


def sign_test(df: DataFrame, value: str, mu0: float = 0.0, by: Sequence[str] = (), alt: str = "two") -> DataFrame:
    """Counts above and below, exact binomial p."""
    x = finite(value)
    g = df.groupBy(*by).agg(F.count_if(x > mu0).alias("above"), F.count_if(x < mu0).alias("below"), F.count_if(x == mu0).alias("ties"))
    g = g.withColumn("n", F.col("above") + F.col("below"))
    half = F.lit(0.5)
    p = {"two": lambda: F.least(F.lit(1.0), 2 * dist.apply(dist.binom_cdf, F.least("above", "below"), F.col("n"), half)),
         "less": lambda: dist.apply(dist.binom_cdf, F.col("above"), F.col("n"), half),
         "greater": lambda: 1 - dist.apply(dist.binom_cdf, F.col("above") - 1, F.col("n"), half)}[alt]()
    return _merge(g.withColumn("p_value", p), quantiles(df, value, {"median": (0.5, 7)}, by).drop("n"), by)


def kruskal_wallis(df: DataFrame, value: str, group: str, by: Sequence[str] = ()) -> DataFrame:
    """H, tie-adjusted H, df and p."""
    rows = persist(_kruskal_levels(df, value, group, by))
    n = F.col("total").cast("double")
    g = rows.groupBy(*by).agg(F.first("total").alias("total"), F.count(F.lit(1)).alias("k"),
                              F.sum(F.col("_r") * F.col("_r") / F.col("n")).alias("_h"), F.sum("_ties").alias("_ties"))
    h = 12 / (n * (n + 1)) * F.col("_h") - 3 * (n + 1)
    corr = 1 - F.col("_ties") / (n * n * n - n)
    g = g.withColumns({"h": h, "h_adjusted": F.when(corr > 0, h / corr).otherwise(h), "df": (F.col("k") - 1).cast("double")})
    return g.select(*by, F.col("total").alias("n"), "k", "h", "h_adjusted", "df",
                    dist.apply(dist.chi2_sf, F.col("h_adjusted"), F.col("df")).alias("p_value"))


def _kruskal_levels(df, value, group, by):
    r = _ranked_levels(df, value, group, by)
    c = F.col("_c").cast("double")
    g = r.groupBy(*by, F.col("_g").alias("level")).agg(
        F.sum("_c").alias("n"), F.sum(c * F.col("_rank")).alias("_r"), F.first(F.col("n")).alias("total"), _tie_term().alias("_ties"))
    return g


def kruskal_levels(df: DataFrame, value: str, group: str, by: Sequence[str] = ()) -> DataFrame:
    """Per level: n, median, mean rank and z against the overall mean rank."""
    g = _kruskal_levels(df, value, group, by)
    n, total = F.col("n").cast("double"), F.col("total").cast("double")
    g = g.withColumn("mean_rank", F.col("_r") / n)
    g = g.withColumn("z", (F.col("mean_rank") - (total + 1) / 2) / F.sqrt(total * (total + 1) / 12 * (1 / n - 1 / total)))
    med = quantiles(df.withColumn("level", level(group)), value, {"median": (0.5, 7)}, [*by, "level"]).drop("n")
    return _merge(g.drop("_r", "_ties", "total"), med, [*by, "level"])


def mood_median(df: DataFrame, value: str, group: str, by: Sequence[str] = ()) -> DataFrame:
    """Chi-square on above / not above the grand median."""
    t = mood_levels(df, value, group, by, quartiles=False)
    long = t.select(*by, "level", "grand_median", F.expr("stack(2, 'above', above, 'below_eq', below_eq) as (side, count)"))
    chi = _chi_square_from_cells(long, "level", "side", by)
    centre = t.groupBy(*by).agg(F.first("grand_median").alias("grand_median"))
    return _merge(chi.select(*by, "chisq", "df", "p_value"), centre, by)


def mood_levels(df: DataFrame, value: str, group: str, by: Sequence[str] = (), quartiles: bool = True) -> DataFrame:
    """Per level: n, above, not above, and the level's own quartiles."""
    med = quantiles(df, value, {"grand_median": (0.5, 7)}, by).drop("n")
    x = finite(value)
    rows = attach(df.withColumn("level", level(group)), med, by).where(x.isNotNull())
    t = rows.groupBy(*by, "level").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(x > F.col("grand_median")).alias("above"),
        F.count_if(x <= F.col("grand_median")).alias("below_eq"), F.first("grand_median").alias("grand_median"))
    if not quartiles:
        return t
    q = quantiles(df.withColumn("level", level(group)), value, {"median": (0.5, 7), "q1": (0.25, 6), "q3": (0.75, 6)}, [*by, "level"])
    return _merge(t, q.drop("n"), [*by, "level"])


def friedman(df: DataFrame, value: str, block: str, treatment: str) -> DataFrame:
    """Ranks within complete blocks, no tie correction.  Replicates are averaged first."""
    cells = df.groupBy(F.col(block).alias("block"), level(treatment).alias("treatment")).agg(F.avg(finite(value)).alias("x"))
    cells = persist(cells.where("x is not null"))
    k = cells.select("treatment").distinct().count()
    # a block holds one row per treatment, so its window is bounded by their number
    block_rows = Window.partitionBy("block")
    ranked = cells.withColumn("_k", F.count(F.lit(1)).over(block_rows)).where(F.col("_k") == k)
    ties = F.count(F.lit(1)).over(Window.partitionBy("block", "x"))
    ranked = ranked.withColumn("_rank", F.rank().over(block_rows.orderBy("x")) + (ties - 1) / 2)
    sums = ranked.groupBy("treatment").agg(F.sum("_rank").alias("sum_rank"), F.count(F.lit(1)).alias("b"))
    kk = F.lit(float(k))
    g = sums.agg(F.max("b").alias("b"), F.count(F.lit(1)).alias("k"),
                 F.sum((F.col("sum_rank") - F.col("b") * (kk + 1) / 2) ** 2).alias("_s"))
    g = g.select("b", "k", (12 * F.col("_s") / (F.col("b") * F.col("k") * (F.col("k") + 1))).alias("s"),
                 (F.col("k") - 1).cast("double").alias("df"))
    return g.withColumn("p_value", dist.apply(dist.chi2_sf, F.col("s"), F.col("df")))


def runs_test(df: DataFrame, value: str, order_by: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Runs above and below the median; values equal to it are dropped."""
    x = finite(value)
    rows = attach(df.select(*by, *order_by, x.alias("_x")).where("_x is not null"),
                  quantiles(df, value, {"_med": (0.5, 7)}, by).drop("n"), by)
    rows = rows.where("_x <> _med").withColumn("_up", (F.col("_x") > F.col("_med")).cast("int"))
    rows = blocks(sequence(rows.select(*by, *order_by, "_up"), by, order_by), before=1)
    rows = rows.withColumn("_prev", F.lag("_up").over(block_window(by))).where("_own")
    g = rows.groupBy(*by).agg(F.count_if(F.col("_prev").isNull() | (F.col("_prev") != F.col("_up"))).alias("runs"),
                              F.count_if(F.col("_up") == 1).alias("n1"), F.count_if(F.col("_up") == 0).alias("n2"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    g = g.withColumn("expected", 2 * n1 * n2 / n + 1)
    sig = F.sqrt(2 * n1 * n2 * (2 * n1 * n2 - n) / (n * n * (n - 1)))
    return with_p_from_z(g.withColumn("z", ratio(F.col("runs") - F.col("expected"), sig)), "z")


# ----------------------------------------------------- contingency tables

def chi_square_cells(df: DataFrame, row: str, column: str) -> DataFrame:
    """Observed, expected, contribution and standardised residual per cell, empty cells included."""
    cells = df.groupBy(level(row).alias("row_level"), level(column).alias("col_level")).agg(F.count(F.lit(1)).alias("count"))
    return _full_cells(cells, "row_level", "col_level", ())


def _full_cells(cells: DataFrame, row: str, column: str, by: Sequence[str]) -> DataFrame:
    cells = persist(cells)
    rows = cells.groupBy(*by, row).agg(F.sum("count").alias("_row"))
    cols = cells.groupBy(*by, column).agg(F.sum("count").alias("_col"))
    total = cells.groupBy(*by).agg(F.sum("count").alias("_all"))
    lists = cols.groupBy(*by).agg(F.collect_list(F.struct(column, "_col")).alias("_cols"))
    grid = attach(attach(rows, total, by), lists, by).withColumn("_c", F.explode("_cols"))
    grid = grid.select(*by, row, "_row", "_all", F.col(f"_c.{column}").alias(column), F.col("_c._col").alias("_col"))
    keys = [*by, row, column]
    names = {k: "_k_" + k for k in keys}
    cond = [F.col(k).eqNullSafe(F.col(v)) for k, v in names.items()]
    out = grid.join(cells.select(*keys, "count").withColumnsRenamed(names), cond, "left").drop(*names.values())
    out = out.withColumn("count", F.coalesce("count", F.lit(0).cast("bigint")))
    e = F.col("_row") * F.col("_col") / F.col("_all")
    return out.select(*keys, "count", e.alias("expected"), ((F.col("count") - e) ** 2 / e).alias("contribution"),
                      ((F.col("count") - e) / F.sqrt(e)).alias("residual"))


def _chi_square_from_cells(cells: DataFrame, row: str, column: str, by: Sequence[str], yates: bool = False) -> DataFrame:
    """Statistics from the observed cells and the margins; the empty cells of a
    large table are never listed (their contributions sum to N minus the
    observed expectations)."""
    cells = persist(cells)
    total = cells.groupBy(*by).agg(F.sum("count").cast("double").alias("_n"))
    rows = persist(cells.groupBy(*by, row).agg(F.sum("count").cast("double").alias("_row")))
    cols = persist(cells.groupBy(*by, column).agg(F.sum("count").cast("double").alias("_col")))
    t = attach(attach(attach(cells, rows, [*by, row], ready=True), cols, [*by, column], ready=True), total, by)
    o, e = F.col("count"), F.col("_row") * F.col("_col") / F.col("_n")
    g = t.groupBy(*by).agg(
        F.sum((o - e) ** 2 / e).alias("_seen"), F.sum(e).alias("_e"), F.max(F.abs(o - e)).alias("_dev"),
        F.sum(F.when(o > 0, 2 * o * F.ln(o / e)).otherwise(0.0)).alias("likelihood_ratio"), F.max("_n").cast("bigint").alias("n"))
    margin = lambda m, x, p: m.groupBy(*by).agg(F.count(F.lit(1)).alias(f"_{p}"), F.min(x).alias(f"_{p}0"), F.sum(1 / F.col(x)).alias(f"_{p}i"))
    g = _merge(_merge(_merge(g, margin(rows, "_row", "r"), by), margin(cols, "_col", "c"), by), _small_expected(rows, cols, total, by), by)
    chi = F.col("_seen") + F.col("n") - F.col("_e")
    if yates:
        corrected = F.greatest(F.lit(0.0), F.col("_dev") - 0.5) ** 2 * F.col("n") * F.col("_ri") * F.col("_ci")
        chi = F.when((F.col("_r") == 2) & (F.col("_c") == 2), corrected).otherwise(chi)
    g = g.withColumns({"chisq": chi, "df": ((F.col("_r") - 1) * (F.col("_c") - 1)).cast("double"),
                       "min_expected": F.col("_r0") * F.col("_c0") / F.col("n"),
                       "pct_small_expected": 100 * F.coalesce(F.col("_small"), F.lit(0.0)) / (F.col("_r") * F.col("_c"))})
    g = g.withColumns({
        "p_value": dist.apply(dist.chi2_sf, F.col("chisq"), F.col("df")),
        "p_likelihood_ratio": dist.apply(dist.chi2_sf, F.col("likelihood_ratio"), F.col("df")),
        "cramer_v": F.sqrt(ratio(F.col("chisq"), F.col("n") * F.least(F.col("_r") - 1, F.col("_c") - 1)))})
    return g.drop(*[c for c in g.columns if c.startswith("_") and c not in by])


def _small_expected(rows: DataFrame, cols: DataFrame, total: DataFrame, by: Sequence[str]) -> DataFrame:
    """Number of cells with expectation below 5, by one merged ordering of the margins."""
    limits = attach(rows, total, by).select(*by, (5 * F.col("_n") / F.col("_row")).alias("_p"), F.lit(0).alias("_o"),
                                            F.lit(1).alias("_ask"), F.lit(0).cast("bigint").alias("_have"))
    have = cols.select(*by, F.col("_col").alias("_p"), F.lit(1).alias("_o"), F.lit(0).alias("_ask"), F.lit(1).cast("bigint").alias("_have"))
    merged = prefix(limits.unionByName(have), by, ["_p", "_o"], {"_cum": "_have"})
    return merged.groupBy(*by).agg(F.sum(F.col("_ask") * F.col("_cum")).cast("double").alias("_small"))


def chi_square(df: DataFrame, row: str, column: str, by: Sequence[str] = (), yates: bool = False) -> DataFrame:
    """Association test: chi-square, likelihood ratio, Cramer's V."""
    cells = df.groupBy(*by, level(row).alias("row_level"), level(column).alias("col_level")).agg(F.count(F.lit(1)).alias("count"))
    return _chi_square_from_cells(cells, "row_level", "col_level", by, yates)


def chi_square_fit(df: DataFrame, column: str, expected: Mapping[str, float] | None = None) -> DataFrame:
    """Goodness of fit to given or equal level probabilities."""
    counts = persist(df.groupBy(level(column).alias("level")).agg(F.count(F.lit(1)).alias("count")))
    if expected:
        probs = df.sparkSession.createDataFrame([(str(k), float(v)) for k, v in expected.items()], "level string, _p double")
        counts = attach(probs, counts, ["level"], how="left").withColumn("count", F.coalesce("count", F.lit(0).cast("bigint")))
    else:
        counts = counts.withColumn("_p", F.lit(1.0))
    tot = one_row(counts.agg(F.sum("count").alias("n"), F.sum("_p").alias("_sp"), F.count(F.lit(1)).alias("_k")))
    rows = counts.withColumns(tot)
    e = F.col("n") * F.col("_p") / F.col("_sp")
    g = rows.groupBy("n").agg(F.sum((F.col("count") - e) ** 2 / e).alias("chisq"), (F.count(F.lit(1)) - 1).cast("double").alias("df"))
    return g.withColumn("p_value", dist.apply(dist.chi2_sf, F.col("chisq"), F.col("df")))


# ----------------------------------------------------------- Poisson rates

def poisson_test(df: DataFrame, count: Column, exposure: Column, rate0: float, by: Sequence[str] = (), alt: str = "two",
                 conf: float = 0.95) -> DataFrame:
    """One rate: exact p and chi-square interval.  `count` and `exposure` are summed per group."""
    g = df.groupBy(*by).agg(F.sum(count).cast("double").alias("count"), F.sum(exposure).cast("double").alias("exposure"))
    g = g.withColumns({"rate": F.col("count") / F.col("exposure"), "_mu": rate0 * F.col("exposure")})
    g = g.withColumns({"_le": dist.apply(dist.poisson_cdf, F.col("count"), F.col("_mu")),
                       "_lt": dist.apply(dist.poisson_cdf, F.col("count") - 1, F.col("_mu")),
                       "ci_low": dist.apply(dist.poisson_low, F.col("count"), F.lit(conf)) / F.col("exposure"),
                       "ci_high": dist.apply(dist.poisson_high, F.col("count"), F.lit(conf)) / F.col("exposure")})
    p = {"less": F.col("_le"), "greater": 1 - F.col("_lt"),
         "two": F.least(F.lit(1.0), 2 * F.least(F.col("_le"), 1 - F.col("_lt")))}[alt]
    return g.withColumn("p_value", p).drop("_mu", "_le", "_lt")


def poisson_test_two(df: DataFrame, count: Column, exposure: Column, group: str, levels: Sequence[str],
                     by: Sequence[str] = (), alt: str = "two", conf: float = 0.95) -> DataFrame:
    """Two rates: z, interval and the exact conditional binomial p."""
    g = level(group)
    aggs = []
    for i, v in enumerate(levels, 1):
        aggs += [F.sum(F.when(g == str(v), count)).cast("double").alias(f"c{i}"),
                 F.sum(F.when(g == str(v), exposure)).cast("double").alias(f"e{i}")]
    out = df.where(g.isin([str(v) for v in levels])).groupBy(*by).agg(*aggs)
    c1, e1, c2, e2 = (F.col(k) for k in ("c1", "e1", "c2", "e2"))
    se = F.sqrt(c1 / (e1 * e1) + c2 / (e2 * e2))
    out = out.withColumns({"rate1": c1 / e1, "rate2": c2 / e2, "diff": c1 / e1 - c2 / e2, "_se": se})
    share = e1 / (e1 + e2)
    exact = {"two": lambda: dist.apply(dist.binom_test_two_sided, c1, c1 + c2, share),
             "less": lambda: dist.apply(dist.binom_cdf, c1, c1 + c2, share),
             "greater": lambda: 1 - dist.apply(dist.binom_cdf, c1 - 1, c1 + c2, share)}[alt]()
    out = out.withColumns({"z": ratio(F.col("diff"), F.col("_se")), "p_exact": exact,
                           "ci_low": F.col("diff") - _z(conf) * F.col("_se"), "ci_high": F.col("diff") + _z(conf) * F.col("_se")})
    return with_p_from_z(out, "z", alt).drop("_se")


# ------------------------------------------------------------ distributions

def ks_two(df: DataFrame, value: str, group: str, levels: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Largest distance of the two empirical distributions at distinct values."""
    a, b = (str(v) for v in levels)
    rows = df.select(*by, level(group).alias("_g"), finite(value).alias("_x")).where(F.col("_g").isin([a, b]) & F.col("_x").isNotNull())
    cells = rows.groupBy(*by, "_x").agg(F.count_if(F.col("_g") == a).alias("_a"), F.count_if(F.col("_g") == b).alias("_b"))
    cum = prefix(cells, by, ["_x"], {"_ca": "_a", "_cb": "_b"}, {"n1": "_a", "n2": "_b"})
    gap = F.abs((F.col("_ca") + F.col("_a")) / F.col("n1") - (F.col("_cb") + F.col("_b")) / F.col("n2"))
    g = cum.groupBy(*by).agg(F.max("n1").alias("n1"), F.max("n2").alias("n2"), F.max(gap).alias("d"))
    ne = F.sqrt(F.col("n1") * F.col("n2") / (F.col("n1") + F.col("n2")))
    return g.withColumn("p_value", dist.apply(dist.kolmogorov_sf, (ne + 0.12 + 0.11 / ne) * F.col("d")))
