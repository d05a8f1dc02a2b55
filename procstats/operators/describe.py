"""Descriptive statistics and density estimates, grouped by any keys."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dist
from ..functions.numeric import finite, ratio
from ..plans.joining import attach, one_row
from ..plans.ordering import quantile_columns, quantiles, value_at, value_order
from ..plans.session import persist

QUARTILES = {"q1": (0.25, 6), "median": (0.5, 7), "q3": (0.75, 6)}
TIE_PIECE = 100_000


def _merge(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """Two one-row-per-group results side by side."""
    if not by:
        return left.withColumns(one_row(right))
    names = {k: "_k_" + k for k in by}
    cond = [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()]
    return left.join(right.withColumnsRenamed(names), cond, "left").drop(*names.values())


def skewness(x: Column) -> Column:
    """Sample-corrected skewness; NULL below three values."""
    n = F.count(x)
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def kurtosis(x: Column) -> Column:
    """Sample-corrected excess kurtosis; NULL below four values."""
    n = F.count(x)
    return F.when(n > 3, ratio(n - 1, (n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6))


def shape(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Skewness and kurtosis per group."""
    x = F.col("_value")
    return _values(df, value, by).groupBy(*by).agg(skewness(x).alias("skew"), kurtosis(x).alias("kurt"))


def _values(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """(by, _value): the finite value, computed below the aggregates.

    Inside central moments it would be repeated in every update, and generated code of over 8000 bytes a method is not compiled.
    """
    return df.select(*by, finite(value).alias("_value"))


def describe(df: DataFrame, value: str, by: Sequence[str] = (), conf: float = 0.95,
             intervals: bool = True) -> DataFrame:
    """Full descriptive summary per group."""
    x = F.col("_value")
    n = F.count(x)
    base = _values(df, value, by).groupBy(*by).agg(
        n.alias("n"), (F.count(F.lit(1)) - n).alias("missing"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"),
        (F.stddev_samp(x) / F.sqrt(n)).alias("se"), F.var_samp(x).alias("variance"),
        (100 * ratio(F.stddev_samp(x), F.avg(x))).alias("cv"), F.min(x).alias("min"), F.max(x).alias("max"),
        (F.max(x) - F.min(x)).alias("range"), skewness(x).alias("skewness"), kurtosis(x).alias("kurtosis"),
        F.sum(x).alias("sum"), F.sum(x * x).alias("sumsq"))
    ordered = persist(value_order(df, value, by))
    aggs, outs = quantile_columns(value, QUARTILES)
    count = F.col("n")
    cut = F.floor(count * 0.05)
    overlap = F.greatest(F.lit(0), F.least(F.col("below") + F.col("freq"), count - cut) - F.greatest(F.col("below"), cut))
    trimmed = F.when(F.max(count) >= 4, F.sum(F.col(value) * overlap) / F.sum(overlap))
    picked = ordered.groupBy(*by).agg(F.max("n").alias("n"), *aggs, trimmed.alias("trimmed_mean")).select(
        *by, *outs, "trimmed_mean")
    out = _merge(base, picked, by).withColumn("iqr", F.col("q3") - F.col("q1"))
    out = _merge(out, mad(df, value, by, ordered=ordered), by)
    if not intervals:
        return out
    out = _merge(out, median_interval(df, value, by, conf, ordered), by)
    t = dist.apply(dist.t_ppf, F.lit((1 + conf) / 2), F.col("n") - 1)
    hi = dist.apply(dist.chi2_ppf, F.lit((1 + conf) / 2), F.col("n") - 1)
    lo = dist.apply(dist.chi2_ppf, F.lit((1 - conf) / 2), F.col("n") - 1)
    out = out.withColumns({"_t": t, "_hi": hi, "_lo": lo})
    return out.withColumns({
        "ci_mean_low": F.col("mean") - F.col("_t") * F.col("se"), "ci_mean_high": F.col("mean") + F.col("_t") * F.col("se"),
        "ci_sd_low": F.col("sd") * F.sqrt((F.col("n") - 1) / F.col("_hi")),
        "ci_sd_high": F.col("sd") * F.sqrt((F.col("n") - 1) / F.col("_lo"))}).drop("_t", "_hi", "_lo")


def mad(df: DataFrame, value: str, by: Sequence[str] = (), scaled: bool = True,
        ordered: DataFrame | None = None) -> DataFrame:
    """Median absolute deviation (times 1.4826 when scaled)."""
    ordered = persist(value_order(df, value, by)) if ordered is None else ordered
    med = quantiles(df, value, {"_med": (0.5, 7)}, by, ordered=ordered).drop("n")
    dev = attach(ordered.select(*by, value, "freq"), med, by)
    dev = dev.select(*by, F.abs(F.col(value) - F.col("_med")).alias("_d"), "freq")
    out = quantiles(dev, "_d", {"mad": (0.5, 7)}, by, weight="freq").drop("n")
    return out.withColumn("mad", F.col("mad") * 1.4826) if scaled else out


def trimmed_mean(df: DataFrame, value: str, by: Sequence[str] = (), share: float = 0.05) -> DataFrame:
    """Mean after dropping floor(n * share) observations per tail."""
    n = F.col("n")
    cut = F.floor(n * share)
    overlap = F.greatest(F.lit(0), F.least(F.col("below") + F.col("freq"), n - cut) - F.greatest(F.col("below"), cut))
    return value_order(df, value, by).groupBy(*by).agg(
        F.max("n").alias("n"), (F.sum(F.col(value) * overlap) / F.sum(overlap)).alias("trimmed_mean"))


def means(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Geometric and harmonic mean, cv, standard error and range."""
    x = finite(value)
    positive, nonzero = F.min(x) > 0, F.count_if(x == 0) == 0
    log = F.when(x > 0, F.ln(x))
    return df.groupBy(*by).agg(
        F.when(positive, F.exp(F.avg(log))).alias("geometric_mean"),
        F.when(nonzero, ratio(F.count(x), F.sum(ratio(F.lit(1.0), x)))).alias("harmonic_mean"),
        (100 * ratio(F.stddev_samp(x), F.avg(x))).alias("cv"),
        (F.stddev_samp(x) / F.sqrt(F.count(x))).alias("se"), (F.max(x) - F.min(x)).alias("range"))


def mode(df: DataFrame, value: str, by: Sequence[str] = (), order_by: Sequence[str] = ()) -> DataFrame:
    """Most frequent value when it occurs more than once; ties: first in row order."""
    x = finite(value)
    first = F.min(F.struct(*order_by)) if order_by else F.min(x)
    freq = df.where(x.isNotNull()).groupBy(*by, x.alias("mode")).agg(F.count(F.lit(1)).alias("mode_count"), first.alias("_f"))
    best = freq.groupBy(*by).agg(F.min_by(F.struct("mode", "mode_count"), F.struct(-F.col("mode_count"), "_f")).alias("_b"))
    out = best.select(*by, "_b.*")
    return out.withColumn("mode", F.when(F.col("mode_count") > 1, F.col("mode")))


def median_interval(df: DataFrame, value: str, by: Sequence[str] = (), conf: float = 0.95,
                    ordered: DataFrame | None = None) -> DataFrame:
    """Order-statistic interval of the median; NULL below six values."""
    ordered = persist(value_order(df, value, by)) if ordered is None else ordered
    sizes = ordered.groupBy(*by).agg(F.max("n").alias("_n"))
    sizes = sizes.withColumn("_k", dist.apply(dist.median_ci_rank, F.col("_n"), F.lit(conf)))
    rows = attach(ordered, sizes, by)
    return rows.groupBy(*by).agg(value_at(F.col("_k"), value).alias("ci_median_low"),
                                 value_at(F.col("n") - F.col("_k") + 1, value).alias("ci_median_high"))


def tolerance_interval(df: DataFrame, value: str, by: Sequence[str] = (), coverage: float = 0.99,
                       conf: float = 0.95) -> DataFrame:
    """Normal two-sided (Howe) and one-sided tolerance limits, plus the data range."""
    x = finite(value)
    g = df.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"),
                            F.min(x).alias("np_lower"), F.max(x).alias("np_upper")).where("n >= 3")
    n = F.col("n").cast("double")
    z = float(dist.norm_ppf((1 + coverage) / 2))
    zp, zg = float(dist.norm_ppf(coverage)), float(dist.norm_ppf(conf))
    chi = dist.apply(dist.chi2_ppf, F.lit(1 - conf), n - 1)
    g = g.withColumn("_chi", chi)
    u = F.sqrt((n - 1) * (1 + 1 / n) * z * z / F.col("_chi"))
    w = F.sqrt(1 + (n - 3 - F.col("_chi")) / (2 * (n + 1) * (n + 1)))
    a = 1 - zg * zg / (2 * (n - 1))
    b = zp * zp - zg * zg / n
    g = g.withColumns({"k2": u * w, "k1": (zp + F.sqrt(F.greatest(F.lit(0.0), zp * zp - a * b))) / a}).drop("_chi")
    m, s = F.col("mean"), F.col("sd")
    return g.withColumns({"lower": m - F.col("k2") * s, "upper": m + F.col("k2") * s,
                          "lower_one_sided": m - F.col("k1") * s, "upper_one_sided": m + F.col("k1") * s})


#: Statistics of weighted sums: of weights, of weighted deviations from a centre, and of their squares.
WEIGHTED_STATISTICS: dict[str, Callable[[Column, Column, Column, Column], Column]] = {
    "mean": lambda c, w, d, q: c + ratio(d, w),
    "sum": lambda c, w, d, q: c * w + d,
    "sd": lambda c, w, d, q: F.sqrt(F.greatest(ratio(q - d * ratio(d, w), w - 1), F.lit(0.0))),
}
#: Weights that a task draws at a time, and sums that it keeps for the groups it has met.
DRAWN = 1_000_000
HELD = 4_000_000


def _replicate_sums(df: DataFrame, value: str, by: Sequence[str], replicates: int, seed: int) -> DataFrame:
    """(by, _rep, _c, _w, _d, _q): weighted sums of every replicate; replicate 0 is the data.

    A value that comes `freq` times gets a Poisson(freq) weight in each replicate, which is what `freq` rows with
    Poisson(1) weights add up to.  The draws of a value depend on the seed, its group and itself only, so neither
    partitioning nor a lost executor changes them.
    """
    by = list(by)
    x = finite(value)
    centre = df.groupBy(*by).agg(F.avg(x).alias("_c")).where("_c is not null")
    freq = df.where(x.isNotNull()).groupBy(*by, x.alias("_x")).agg(F.count(F.lit(1)).alias("_f"))
    rows = attach(freq, centre, by).withColumn("_id", F.xxhash64(F.lit(seed), *by, F.lit("|"), "_x"))
    size, piece, most = replicates + 1, max(1, DRAWN // (replicates + 1)), HELD

    def sums(batches):
        held: dict = {}
        for pdf in (whole.iloc[at:at + piece] for whole in batches for at in range(0, len(whole), piece)):
            weights = np.empty((len(pdf), size))
            weights[:, 0] = pdf["_f"]
            for k, (key, f) in enumerate(zip(pdf["_id"].tolist(), pdf["_f"].tolist())):
                weights[k, 1:] = np.random.Generator(np.random.Philox(key=key % (1 << 64))).poisson(f, size - 1)
            apart = (pdf["_x"] - pdf["_c"]).to_numpy(float)
            codes = pdf.groupby(by, dropna=False, sort=False).ngroup().to_numpy() if by else np.zeros(len(pdf), int)
            order = np.argsort(codes, kind="stable")
            starts = np.flatnonzero(np.r_[True, np.diff(codes[order]) != 0])
            w, d = weights[order], apart[order][:, None]
            got = np.stack([np.add.reduceat(w, starts, axis=0), np.add.reduceat(w * d, starts, axis=0), np.add.reduceat(w * d * d, starts, axis=0)], axis=1)
            for k, at in enumerate(order[starts]):
                row = pdf.iloc[at]
                key = (*[None if pd.isna(row[c]) else row[c] for c in by], float(row["_c"]))
                if key in held:
                    held[key] += got[k]
                    continue
                if (len(held) + 1) * 3 * size > most:
                    yield passed(held)
                    held = {}
                held[key] = got[k].copy()
        if held:
            yield passed(held)

    def passed(held):
        out = pd.DataFrame(list(held), columns=[*by, "_c"])
        for k, name in enumerate(("_w", "_d", "_q")):
            out[name] = [v[k].tolist() for v in held.values()]
        return out

    kinds = dict(df.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in by] + ["_c double", "_w array<double>", "_d array<double>", "_q array<double>"])
    parts = rows.mapInPandas(sums, schema).select(*by, "_c", F.posexplode(F.arrays_zip("_w", "_d", "_q")).alias("_rep", "_s"))
    return parts.groupBy(*by, "_c", "_rep").agg(*[F.sum(f"_s.{c}").alias(c) for c in ("_w", "_d", "_q")])


def bootstrap_interval(df: DataFrame, value: str, key: Sequence[str], by: Sequence[str] = (),
                       statistic: str | Callable[[Column, Column], Column] = "mean", replicates: int = 2000,
                       conf: float = 0.95, seed: int = 12345) -> DataFrame:
    """Percentile bootstrap interval.

    mean, sum and sd come from weighted sums over the frequencies of the values, so the rows are not copied.
    `statistic` may also be any aggregate of (value, weight): then every (row, replicate) gets an independent
    Poisson(1) weight derived from a hash of the row `key`, and a replicate is a weighted aggregate over all rows.
    """
    if isinstance(statistic, str):
        sums = _replicate_sums(df, value, by, replicates, seed)
        stats = sums.select(*by, "_rep", WEIGHTED_STATISTICS[statistic](*[F.col(c) for c in ("_c", "_w", "_d", "_q")]).alias("_s"))
    else:
        stats = _replicates_of_rows(df, value, key, by, statistic, replicates, seed)
    rep = F.when(F.col("_rep") > 0, finite("_s"))
    a = (1 - conf) / 2
    return stats.groupBy(*by).agg(
        F.max(F.when(F.col("_rep") == 0, F.col("_s"))).alias("estimate"),
        F.percentile(rep, F.lit(a)).alias("lower"), F.percentile(rep, F.lit(1 - a)).alias("upper"),
        F.stddev_samp(rep).alias("se"), F.count(rep).alias("replicates"))


def _replicates_of_rows(df: DataFrame, value: str, key: Sequence[str], by: Sequence[str],
                        statistic: Callable[[Column, Column], Column], replicates: int, seed: int) -> DataFrame:
    rows = df.select(*by, finite(value).alias("_x"), F.xxhash64(F.lit(seed), *key).alias("_id")).where("_x is not null")
    rows = rows.withColumn("_rep", F.explode(F.sequence(F.lit(0), F.lit(replicates))))
    u = (F.shiftrightunsigned(F.xxhash64("_id", "_rep"), 11).cast("double") + 0.5) / float(2**53)
    cdf, p, steps = 0.0, math.exp(-1), []
    for k in range(18):
        cdf += p
        p /= k + 1
        steps.append(F.when(u > cdf, 1).otherwise(0))
    weight = steps[0]
    for s in steps[1:]:
        weight = weight + s
    rows = rows.withColumn("_w", F.when(F.col("_rep") == 0, F.lit(1)).otherwise(weight).cast("double"))
    return rows.groupBy(*by, "_rep").agg(statistic(F.col("_x"), F.col("_w")).alias("_s"))


def _bin_rule(n: Column, rule: str) -> Column:
    return {
        "sturges": F.ceil(F.log2(n) + 1), "rice": F.ceil(2 * F.pow(n.cast("double"), F.lit(1 / 3))),
        "sqrt": F.ceil(F.sqrt(n)), "auto": F.greatest(F.lit(5), F.least(F.lit(30), F.ceil(F.sqrt(n)))),
    }[rule].cast("bigint")


def histogram(df: DataFrame, value: str, by: Sequence[str] = (), bins: int | None = None, rule: str = "auto",
              nice: bool = True, low: float | None = None, high: float | None = None) -> DataFrame:
    """Counts, density and % per class; empty classes are included."""
    x = finite(value)
    g = df.groupBy(*by).agg(F.count(x).alias("n"), F.min(x).alias("_lo"), F.max(x).alias("_hi")).where("n > 0")
    if low is not None:
        g = g.withColumn("_lo", F.lit(float(low)))
    if high is not None:
        g = g.withColumn("_hi", F.lit(float(high)))
    flat = F.col("_lo") == F.col("_hi")
    g = g.withColumns({"_lo": F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo")),
                       "_hi": F.when(flat, F.col("_hi") + 0.5).otherwise(F.col("_hi"))})
    g = g.withColumn("_k", F.lit(bins).cast("bigint") if bins else _bin_rule(F.col("n"), rule))
    g = g.withColumn("width", (F.col("_hi") - F.col("_lo")) / F.col("_k"))
    if nice:
        mag = F.pow(F.lit(10.0), F.floor(F.log10("width")))
        steps = F.coalesce(*[F.when(mag * c >= F.col("width"), mag * c) for c in (1.0, 2.0, 2.5, 5.0, 10.0)], F.col("width"))
        g = g.withColumn("width", steps)
        g = g.withColumns({"_lo": F.floor(F.col("_lo") / F.col("width")) * F.col("width"),
                           "_hi": F.ceil(F.col("_hi") / F.col("width")) * F.col("width")})
        g = g.withColumn("_k", F.greatest(F.lit(1), F.round((F.col("_hi") - F.col("_lo")) / F.col("width"))).cast("bigint"))
    g = persist(g)
    rows = attach(df.select(*by, x.alias("_x")).where("_x is not null"), g, by, ready=True)
    idx = F.greatest(F.lit(0), F.least(F.col("_k") - 1, F.floor((F.col("_x") - F.col("_lo")) / F.col("width"))))
    counts = rows.groupBy(*by, idx.alias("_i")).agg(F.count(F.lit(1)).alias("_c"))
    grid = g.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_k") - 1)))
    names = {k: "_k_" + k for k in by}
    cond = [F.col("bin") == F.col("_i")] + [F.col(k).eqNullSafe(F.col(v)) for k, v in names.items()]
    out = grid.join(counts.withColumnsRenamed(names), cond, "left")
    count = F.coalesce(F.col("_c"), F.lit(0).cast("bigint"))
    lo, w = F.col("_lo"), F.col("width")
    return out.select(*by, "bin", (lo + F.col("bin") * w).alias("low"), (lo + (F.col("bin") + 1) * w).alias("high"),
                      (lo + (F.col("bin") + 0.5) * w).alias("mid"), count.alias("count"),
                      (count / (F.col("n") * w)).alias("density"), (100 * count / F.col("n")).alias("pct"))


def kernel_density(df: DataFrame, value: str, by: Sequence[str] = (), points: int = 200,
                   bandwidth: float | None = None) -> DataFrame:
    """Gaussian kernel density on an even grid, Silverman's bandwidth by default.

    Each distinct value contributes its frequency; every task sums its part of
    the grid before the shuffle.
    """
    ordered = persist(value_order(df, value, by))
    aggs, outs = quantile_columns(value, {"_q1": (0.25, 6), "_q3": (0.75, 6)})
    x, f = F.col(value), F.col("freq")
    stats = ordered.groupBy(*by).agg(F.max("n").alias("n"), F.min(x).alias("_lo"), F.max(x).alias("_hi"), *aggs)
    stats = stats.select(*by, "n", "_lo", "_hi", *outs).where("n >= 2")
    spread = df.groupBy(*by).agg(F.stddev_samp(finite(value)).alias("_s"))
    stats = _merge(stats, spread, by)
    h = 0.9 * F.least(F.col("_s"), (F.col("_q3") - F.col("_q1")) / 1.349) * F.pow(F.col("n").cast("double"), F.lit(-0.2))
    fallback = F.when(F.col("_s") > 0, F.col("_s") / 3).otherwise(1.0)
    stats = stats.withColumn("_h", F.lit(float(bandwidth)) if bandwidth else F.when(h > 0, h).otherwise(fallback))
    stats = stats.select(*by, F.col("n").alias("_n"), "_h", (F.col("_lo") - 3 * F.col("_h")).alias("_a"),
                         (F.col("_hi") + 3 * F.col("_h")).alias("_b"))
    rows = attach(ordered.select(*by, value, "freq"), stats, by)
    rows = rows.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    at = F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("point") / (points - 1)
    z = (at - x) / F.col("_h")
    return rows.groupBy(*by, "point").agg(
        F.first(at).alias("x"),
        (F.sum(f * F.exp(-0.5 * z * z)) / F.first(F.col("_n") * F.col("_h") * math.sqrt(2 * math.pi))).alias("density"))


def expand_ties(ordered: DataFrame) -> DataFrame:
    """One row per observation again: `i` is the 1-based position of the sorted value.

    A value with very many copies is cut into pieces that are spread before
    they are expanded.
    """
    top = ordered.agg(F.max("freq")).first()[0] or 0
    if top > TIE_PIECE:
        pieces = ordered.withColumn("_p", F.explode(F.sequence(F.lit(0), F.floor((F.col("freq") - 1) / TIE_PIECE))))
        pieces = pieces.repartition(*[c for c in ordered.columns], "_p")
        start = F.col("_p") * TIE_PIECE + 1
        stop = F.least(F.col("freq"), (F.col("_p") + 1) * TIE_PIECE)
        out = pieces.withColumn("_j", F.explode(F.sequence(start, stop))).drop("_p")
    else:
        out = ordered.withColumn("_j", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("freq"))))
    return out.withColumn("i", F.col("below") + F.col("_j")).drop("_j")


def ecdf(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Sorted values with p = i / n, one row per observation."""
    rows = expand_ties(value_order(df, value, by))
    return rows.select(*by, F.col(value).alias("x"), "i", (F.col("i") / F.col("n")).alias("p"))


def box_summary(df: DataFrame, value: str, by: Sequence[str] = (), k: float = 1.5) -> DataFrame:
    """Type-6 quartiles, fences, whiskers, number of outliers and mean."""
    ordered = persist(value_order(df, value, by))
    q = quantiles(df, value, QUARTILES, by, ordered=ordered)
    q = q.withColumns({"lower_fence": F.col("q1") - k * (F.col("q3") - F.col("q1")),
                       "upper_fence": F.col("q3") + k * (F.col("q3") - F.col("q1"))})
    rows = attach(ordered.drop("n"), q, by)
    x = F.col(value)
    inside = (x >= F.col("lower_fence")) & (x <= F.col("upper_fence"))
    keep = [c for c in q.columns if c not in by]
    return rows.groupBy(*by).agg(
        *[F.first(c).alias(c) for c in keep],
        F.min(F.when(inside, x)).alias("whisker_low"), F.max(F.when(inside, x)).alias("whisker_high"),
        F.sum(F.when(inside, 0).otherwise(F.col("freq"))).cast("bigint").alias("outliers"),
        (F.sum(x * F.col("freq")) / F.sum("freq")).alias("mean"))


def interval_data(df: DataFrame, value: str, level: str, conf: float = 0.95) -> DataFrame:
    """n, mean, sd and t interval per level."""
    x = finite(value)
    g = df.groupBy(level).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"))
    half = dist.apply(dist.t_ppf, F.lit((1 + conf) / 2), F.col("n") - 1) * F.col("sd") / F.sqrt("n")
    g = g.withColumn("half_width", half)
    return g.withColumns({"low": F.col("mean") - F.col("half_width"), "high": F.col("mean") + F.col("half_width")})
