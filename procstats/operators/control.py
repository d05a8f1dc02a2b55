"""Control charts.  A series may be arbitrarily long: rows are numbered once, all
limits are aggregates, and every rule looks at a bounded number of neighbours."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dist
from ..functions.constants import by_size, c4_of, d2, d3
from ..functions.numeric import finite, level, ratio
from ..plans.joining import attach
from ..plans.ordering import block_window, blocks, quantiles, sequence
from ..plans.session import persist
from .describe import _merge

# Default run length (or sigma multiple) of the eight run rules; 5 and 6 are "2 of 3" and "4 of 5".
RULE_LENGTHS = {1: 3, 2: 9, 3: 6, 4: 14, 5: 3, 6: 5, 7: 15, 8: 8}
DEFAULT_RULES = (1, 2, 3, 5, 6)
MEDIAN_RANGE_FACTOR = 0.954
POINT_RANGE_FACTOR = 1.128


# ------------------------------------------------------------- subgroups

def subgroups(df: DataFrame, value: str, order_by: Sequence[str], by: Sequence[str] = (), size: int = 1,
              label: str | None = None) -> DataFrame:
    """One row per subgroup: `point` (1-based), label, n, mean, sd, min, max, range.

    By position (missing values keep their place, then drop out) or by a label
    column in first-seen order.
    """
    x = finite(value)
    if label is None and size == 1:
        rows = sequence(df.select(*by, *order_by, x.alias("mean")).where("mean is not null"), by, order_by, "point")
        return rows.select(*by, "point", F.col("point").cast("string").alias("label"), F.lit(1).cast("bigint").alias("n"),
                           "mean", F.lit(0.0).alias("sd"), F.col("mean").alias("min"), F.col("mean").alias("max"),
                           F.lit(0.0).alias("range"))
    if label is not None:
        rows = df.select(*by, level(label).alias("label"), F.struct(*order_by).alias("_at"), x.alias("_x"))
    else:
        rows = sequence(df.select(*by, *order_by, x.alias("_x")), by, order_by, "_rn")
        rows = rows.withColumn("_at", F.struct(F.floor((F.col("_rn") - 1) / size).alias("k"))).withColumn("label", F.lit(""))
    keys = [*by, "label"] if label is not None else [*by, "_at"]
    aggs = [F.count("_x").alias("n"), F.avg("_x").alias("mean"), F.coalesce(F.stddev_samp("_x"), F.lit(0.0)).alias("sd"),
            F.min("_x").alias("min"), F.max("_x").alias("max")]
    if label is not None:
        aggs.append(F.min("_at").alias("_at"))
    g = rows.groupBy(*keys).agg(*aggs).where("n > 0").withColumn("range", F.col("max") - F.col("min"))
    g = sequence(g, by, ["_at"], "point")
    if label is None:
        g = g.withColumn("label", F.col("point").cast("string"))
    return g.select(*by, "point", "label", "n", "mean", "sd", "min", "max", "range")


def with_stages(points: DataFrame, cuts: Sequence[int] = ()) -> DataFrame:
    """Stage id = number of cut positions (0-based) at or before the point."""
    stage = F.lit(0)
    for c in sorted(set(cuts)):
        if c > 0:
            stage = stage + F.when(F.col("point") > c, 1).otherwise(0)
    return points.withColumn("stage", stage)


def sigma_within(groups: DataFrame, method: str = "rbar", by: Sequence[str] = ()) -> DataFrame:
    """Within-subgroup sigma per key: rbar, sbar or pooled, with unequal-size variants."""
    if method not in ("rbar", "sbar", "pooled"):
        raise ValueError(f"{method} is not a subgroup estimate")
    n = F.col("n")
    multi = n > 1
    even = F.min("n") == F.max("n")
    if method == "rbar":
        per = F.when(multi, F.col("range") / by_size(d2, n))
        one = F.avg("range") / by_size(d2, F.max("n"))
        return groups.groupBy(*by).agg(F.when(even, one).otherwise(F.avg(per)).alias("sigma"))
    c = c4_of(n)
    if method == "sbar":
        uneven = ratio(F.sum(F.when(multi, c * F.col("sd"))), F.sum(F.when(multi, c * c)))
        return groups.groupBy(*by).agg(F.when(even, F.avg("sd") / c4_of(F.max("n"))).otherwise(uneven).alias("sigma"))
    g = groups.groupBy(*by).agg(F.sum(F.when(multi, (n - 1) * F.col("sd") ** 2)).alias("_ss"),
                                F.sum(F.when(multi, n - 1)).alias("_df"))
    return g.select(*by, (F.sqrt(F.col("_ss") / F.col("_df")) / dist.apply(dist.c4, F.col("_df") + 1)).alias("sigma"))


# --------------------------------------------------------------- run rules

def run_rules(points: DataFrame, by: Sequence[str] = (), rules: Sequence[int] = DEFAULT_RULES,
              lengths: Mapping[int, int] | None = None, value: str = "value", centre: str = "cl", sigma: str = "sigma",
              order: str = "point", name: str = "violations") -> DataFrame:
    """Array of the violated rule numbers for every point.

    All members of a pattern are flagged.  A point belongs to a pattern of k
    points exactly when one of the k windows that contain it is complete, so
    each rule needs k-1 neighbours on both sides and no running state; the
    series is processed in blocks with that many neighbour copies.
    """
    k = {**RULE_LENGTHS, **(lengths or {})}
    reach = max([k[r] - 1 if r in (2, 3, 4, 7, 8) else {5: 2, 6: 4}.get(r, 0) for r in rules] + [0])
    z = ratio(finite(value) - F.col(centre), F.col(sigma))
    rows = points.withColumn("_z", z).withColumn("_v", F.when(F.col("_z").isNotNull(), finite(value)))
    rows = blocks(rows, order, before=reach, after=reach)
    w = block_window(by, order)
    if {3, 4} & set(rules):
        rows = rows.withColumn("_d", F.col("_v") - F.lag("_v").over(w))
    if 4 in rules:
        rows = rows.withColumn("_alt", (F.col("_d") * F.lag("_d").over(w) < 0).cast("int"))
    zc = F.col("_z")

    def trailing(cond: Column, size: int) -> Column:
        return F.sum(F.when(cond, 1).otherwise(0)).over(w.rowsBetween(1 - size, 0))

    complete: dict[str, tuple[int, int, Column]] = {}
    if 2 in rules:
        complete["_c2"] = (2, k[2], (trailing(zc > 0, k[2]) == k[2]) | (trailing(zc < 0, k[2]) == k[2]))
    if 3 in rules:
        complete["_c3"] = (3, k[3], (trailing(F.col("_d") > 0, k[3] - 1) == k[3] - 1) | (trailing(F.col("_d") < 0, k[3] - 1) == k[3] - 1))
    if 4 in rules:
        complete["_c4"] = (4, k[4], trailing(F.col("_alt") == 1, k[4] - 2) == k[4] - 2)
    if 5 in rules:
        full = trailing(zc.isNotNull(), 3) == 3
        complete["_c5u"] = (5, 3, full & (trailing(zc > 2, 3) >= 2))
        complete["_c5d"] = (5, 3, full & (trailing(zc < -2, 3) >= 2))
    if 6 in rules:
        full = trailing(zc.isNotNull(), 5) == 5
        complete["_c6u"] = (6, 5, full & (trailing(zc > 1, 5) >= 4))
        complete["_c6d"] = (6, 5, full & (trailing(zc < -1, 5) >= 4))
    if 7 in rules:
        complete["_c7"] = (7, k[7], trailing(F.abs(zc) < 1, k[7]) == k[7])
    if 8 in rules:
        complete["_c8"] = (8, k[8], trailing(F.abs(zc) > 1, k[8]) == k[8])
    if complete:  # one projection, hence one window pass for all rules
        rows = rows.withColumns({c: F.when(cond, 1).otherwise(0) for c, (_, _, cond) in complete.items()})
    own = {"_c5u": zc > 2, "_c5d": zc < -2, "_c6u": zc > 1, "_c6d": zc < -1}
    hits: dict[int, Column] = {}
    for c, (rule, size, _) in complete.items():
        hit = F.max(c).over(w.rowsBetween(0, size - 1)) == 1
        hit = hit & own[c] if c in own else hit
        hits[rule] = hits[rule] | hit if rule in hits else hit
    if 1 in rules:
        hits[1] = F.abs(zc) > k[1]
    flags = F.array_compact(F.array(*[F.when(hits[r], r) for r in sorted(hits)])).cast("array<int>")
    rows = rows.withColumn(name, flags).where("_own")
    return rows.select(*points.columns, name)


def rule_one(points: DataFrame, value: str = "value", name: str = "violations") -> DataFrame:
    """Only rule 1, for range, S and moving-range panels: no window needed."""
    z = ratio(finite(value) - F.col("cl"), F.col("sigma"))
    return points.withColumn(name, F.array_compact(F.array(F.when(F.abs(z) > RULE_LENGTHS[1], 1))).cast("array<int>"))


def violation_summary(points: DataFrame, by: Sequence[str] = (), name: str = "violations") -> DataFrame:
    """Number of flagged points and their first and last position per rule."""
    rows = points.select(*by, "point", F.explode(name).alias("rule"))
    return rows.groupBy(*by, "rule").agg(F.count(F.lit(1)).alias("points"), F.min("point").alias("first_point"),
                                         F.max("point").alias("last_point"))


def violation_points(points: DataFrame, by: Sequence[str] = (), name: str = "violations") -> DataFrame:
    """The flagged points themselves, one row per (rule, point)."""
    return points.select(*by, F.explode(name).alias("rule"), "point", "label")


# ----------------------------------------------------------- variable charts

def _limits(rows: DataFrame, centre: Column, sigma: Column, floor: bool = False, mult: float = 3.0) -> DataFrame:
    low = centre - mult * sigma
    return rows.withColumns({"cl": centre, "sigma": sigma, "ucl": centre + mult * sigma,
                             "lcl": F.greatest(F.lit(0.0), low) if floor else low})


def subgroup_chart(df: DataFrame, value: str, order_by: Sequence[str], by: Sequence[str] = (), size: int = 5,
                   label: str | None = None, kind: str = "auto", stages: Sequence[int] = (), mu: float | None = None,
                   sigma: float | None = None, method: str | None = None, rules: Sequence[int] = DEFAULT_RULES,
                   lengths: Mapping[int, int] | None = None) -> DataFrame:
    """Xbar-R or Xbar-S chart: one row per subgroup and panel (`xbar` and `range` or `sd`).

    `auto` picks the S panel from a mean subgroup size of 9 on; size 1 is `individuals_chart`.
    """
    groups = persist(with_stages(subgroups(df, value, order_by, by, size, label), stages))
    if kind == "auto":
        mean_n = groups.agg(F.avg("n")).first()[0] or 0
        if mean_n <= 1.0001:
            return individuals_chart(df, value, order_by, by, stages=stages, mu=mu, sigma=sigma, rules=rules, lengths=lengths)
        kind = "xbar-s" if mean_n >= 9 else "xbar-r"
    keys = [*by, "stage"]
    centre = groups.groupBy(*keys).agg((F.sum(F.col("mean") * F.col("n")) / F.sum("n")).alias("_mu"))
    if mu is not None:
        centre = centre.withColumn("_mu", F.lit(float(mu)))
    if sigma is not None:
        stats = centre.withColumn("_sigma", F.lit(float(sigma)))
    else:
        est = sigma_within(groups, method or ("sbar" if kind == "xbar-s" else "rbar"), keys)
        stats = _merge(centre, est.withColumnRenamed("sigma", "_sigma"), keys)
    rows = attach(groups, stats, keys)
    base = [*by, "point", "label", "n", "stage"]
    s, n = F.col("_sigma"), F.col("n")
    first = _limits(rows.withColumn("value", F.col("mean")), F.col("_mu"), s / F.sqrt("n"))
    first = run_rules(first.select(*base, "value", "cl", "sigma", "ucl", "lcl"), keys, rules, lengths)
    if kind == "xbar-s":
        c = c4_of(n)
        second = _limits(rows.withColumn("value", F.col("sd")), c * s,
                         F.when(c.isNotNull(), s * F.sqrt(F.greatest(F.lit(0.0), 1 - c * c))), True)
    else:
        second = _limits(rows.withColumn("value", F.col("range")), by_size(d2, n) * s, by_size(d3, n) * s, True)
    second = rule_one(second.select(*base, "value", "cl", "sigma", "ucl", "lcl"))
    panel = "sd" if kind == "xbar-s" else "range"
    return first.withColumn("panel", F.lit("xbar")).unionByName(second.withColumn("panel", F.lit(panel)))


def moving_ranges(points: DataFrame, by: Sequence[str], length: int = 2, value: str = "value") -> DataFrame:
    """Adds `mr`: range of the last `length` points of the stage, NULL on its first point."""
    rows = blocks(points, "point", before=length - 1)
    w = block_window([*by, "stage"], "point")
    frame = w.rowsBetween(1 - length, 0)
    mr = F.when(F.lag(value).over(w).isNotNull(), F.max(value).over(frame) - F.min(value).over(frame))
    return rows.withColumn("mr", mr).where("_own").drop("_block", "_own")


def _individual_sigma(mr: DataFrame, keys: Sequence[str], length: int, method: str) -> DataFrame:
    if method == "mrbar":
        return mr.groupBy(*keys).agg((F.avg("mr") / d2(length)).alias("_sigma"))
    if method == "medianmr":
        med = quantiles(mr, "mr", {"_m": (0.5, 7)}, keys)
        return med.select(*keys, (F.col("_m") / MEDIAN_RANGE_FACTOR).alias("_sigma"))
    if method == "mssd":
        g = mr.groupBy(*keys).agg(F.sum(F.col("_step") ** 2).alias("_ss"), F.count(F.lit(1)).alias("_n"))
        c = dist.apply(dist.c4, 2 * (F.col("_n") - 1) / 3 + 1)
        return g.select(*keys, (F.sqrt(F.col("_ss") / (2 * (F.col("_n") - 1))) / c).alias("_sigma"))
    raise ValueError(f"unknown sigma method {method}")


def individuals_chart(df: DataFrame, value: str, order_by: Sequence[str], by: Sequence[str] = (), stages: Sequence[int] = (),
                      mr_length: int = 2, method: str = "mrbar", mu: float | None = None, sigma: float | None = None,
                      rules: Sequence[int] = DEFAULT_RULES, lengths: Mapping[int, int] | None = None) -> DataFrame:
    """I-MR chart: one row per point and panel (`individuals`, `moving_range`)."""
    points = with_stages(subgroups(df, value, order_by, by), stages).withColumn("value", F.col("mean"))
    return _individuals(points.select(*by, "point", "label", "n", "stage", "value"), by, mr_length, method, mu, sigma, rules, lengths)


def _individuals(points, by, mr_length, method, mu, sigma, rules, lengths):
    keys = [*by, "stage"]
    mr = moving_ranges(points, by, mr_length)
    if method == "mssd":
        steps = moving_ranges(points, by, 2).select(*by, "point", F.col("mr").alias("_step"))
        names = {k: "_k_" + k for k in [*by, "point"]}
        cond = [F.col(k).eqNullSafe(F.col(v)) for k, v in names.items()]
        mr = mr.join(steps.withColumnsRenamed(names), cond).drop(*names.values())
    mr = persist(mr)
    stats = mr.groupBy(*keys).agg(F.avg("value").alias("_mu"))
    if mu is not None:
        stats = stats.withColumn("_mu", F.lit(float(mu)))
    if sigma is not None:
        stats = stats.withColumn("_sigma", F.lit(float(sigma)))
    else:
        stats = _merge(stats, _individual_sigma(mr, keys, mr_length, method), keys)
    rows = attach(mr, stats, keys)
    base = [*by, "point", "label", "n", "stage"]
    cols = [*base, "value", "cl", "sigma", "ucl", "lcl"]
    s = F.col("_sigma")
    first = run_rules(_limits(rows, F.col("_mu"), s).select(*cols), keys, rules, lengths)
    second = _limits(rows.withColumn("value", F.col("mr")).withColumn("n", F.lit(mr_length).cast("bigint")),
                     d2(mr_length) * s, d3(mr_length) * s, True)
    return first.withColumn("panel", F.lit("individuals")).unionByName(
        rule_one(second.select(*cols)).withColumn("panel", F.lit("moving_range")))


def zmr_chart(df: DataFrame, value: str, product: str, order_by: Sequence[str], by: Sequence[str] = (),
              rules: Sequence[int] = DEFAULT_RULES) -> DataFrame:
    """Short-run chart: standardise by product, then I-MR with mean 0 and sigma 1.

    Products follow each other in first-seen order.
    """
    rows = df.select(*by, *order_by, level(product).alias("label"), finite(value).alias("_x")).where("_x is not null")
    keys = [*by, "label"]
    inner = sequence(rows, keys, order_by, "point").withColumn("stage", F.lit(0))
    mr = persist(moving_ranges(inner, keys, 2, "_x"))
    stats = mr.groupBy(*keys).agg(F.avg("_x").alias("_m"), F.avg("mr").alias("_mr"), F.stddev_samp("_x").alias("_sd"),
                                  F.min(F.struct(*order_by)).alias("_seen"))
    stats = stats.withColumn("_s", F.coalesce(F.col("_mr") / POINT_RANGE_FACTOR, F.col("_sd")))
    out = attach(mr.drop("mr"), stats, keys)
    out = out.select(*by, "label", "_seen", F.col("point").alias("_in"), ratio(F.col("_x") - F.col("_m"), F.col("_s")).alias("value"))
    out = sequence(out, by, ["_seen", "_in"], "point")
    out = out.select(*by, "point", "label", F.lit(1).cast("bigint").alias("n"), F.lit(0).alias("stage"), "value")
    return _individuals(out, by, 2, "mrbar", 0.0, 1.0, rules, None)


# ---------------------------------------------------------- attribute charts

def attribute_chart(df: DataFrame, count: str, size: str | None, order_by: Sequence[str], by: Sequence[str] = (),
                    kind: str = "p", target: float | None = None, rules: Sequence[int] = DEFAULT_RULES,
                    lengths: Mapping[int, int] | None = None) -> DataFrame:
    """p, np, c, u, p-laney and u-laney charts with per-point limits."""
    points = _attribute_points(df, count, size, order_by, by)
    if target is None:
        total = F.sum("_c") / (F.sum("_n") if kind != "c" else F.count(F.lit(1)))
        centre = points.groupBy(*by).agg(total.alias("_bar"))
    else:
        centre = points.groupBy(*by).agg(F.lit(float(target)).alias("_bar"))
    if kind.endswith("laney"):
        centre = _merge(centre, laney_sigma(points, centre, by, kind[0]), by)
    else:
        centre = centre.withColumn("sigma_z", F.lit(1.0))
    rows = attach(points, centre, by)
    n, bar = F.col("_n") if kind != "c" else F.lit(1.0), F.col("_bar")
    if kind[0] in ("p", "n"):
        sd = F.sqrt(bar * (1 - bar) / n) * F.col("sigma_z")
        scale, top = (n, n) if kind == "np" else (F.lit(1.0), F.lit(1.0))
        value = F.col("_c") / n * scale
        rows = rows.withColumns({"value": value, "cl": bar * scale, "sigma": sd * scale})
        ucl = F.least(top, F.col("cl") + 3 * F.col("sigma"))
    else:
        sd = F.sqrt(bar / n) * F.col("sigma_z")
        rows = rows.withColumns({"value": F.col("_c") / n, "cl": bar, "sigma": sd})
        ucl = F.col("cl") + 3 * F.col("sigma")
    rows = rows.withColumns({"ucl": ucl, "lcl": F.greatest(F.lit(0.0), F.col("cl") - 3 * F.col("sigma"))})
    cols = [*by, "point", "label", F.col("_n").alias("n") if kind != "c" else F.lit(1.0).alias("n")]
    return run_rules(rows.select(*cols, "value", "cl", "sigma", "ucl", "lcl"), by, rules, lengths)


def _attribute_points(df, count, size, order_by, by):
    n = F.col(size).cast("double") if size else F.lit(1.0)
    rows = df.select(*by, *order_by, F.col(count).cast("double").alias("_c"), n.alias("_n")).where("_c is not null")
    rows = sequence(rows, by, order_by, "point")
    return rows.withColumn("label", F.col("point").cast("string"))


def laney_sigma(points: DataFrame, centre: DataFrame, by: Sequence[str], kind: str) -> DataFrame:
    """Mean moving range of the standardised counts over 1.128."""
    rows = attach(points.select(*by, "point", "_c", "_n"), centre, by)
    bar, n = F.col("_bar"), F.col("_n")
    sd = F.sqrt(bar * (1 - bar) / n) if kind == "p" else F.sqrt(bar / n)
    rows = blocks(rows.withColumn("_z", (F.col("_c") / n - bar) / sd), "point", before=1)
    rows = rows.withColumn("_mr", F.abs(F.col("_z") - F.lag("_z").over(block_window(by, "point")))).where("_own")
    return rows.groupBy(*by).agg((F.avg("_mr") / POINT_RANGE_FACTOR).alias("sigma_z"))


def overdispersion_test(df: DataFrame, count: str, size: str | None, by: Sequence[str] = (), kind: str = "p",
                        target: float | None = None) -> DataFrame:
    """Chi-square ratio of observed to model variation."""
    n = F.col(size).cast("double") if size else F.lit(1.0)
    rows = df.select(*by, F.col(count).cast("double").alias("_c"), n.alias("_n")).where("_c is not null")
    bar = F.lit(float(target)) if target is not None else F.sum("_c") / (F.sum("_n") if kind != "c" else F.count(F.lit(1)))
    rows = attach(rows, rows.groupBy(*by).agg(bar.alias("_bar")), by)
    e = F.col("_bar") * F.col("_n")
    v = e * (1 - F.col("_bar")) if kind.startswith("p") else e
    ok = v > 0
    g = rows.groupBy(*by).agg(F.sum(F.when(ok, (F.col("_c") - e) ** 2 / v)).alias("chisq"), (F.count_if(ok) - 1).cast("double").alias("df"))
    g = g.withColumn("ratio", ratio(F.col("chisq"), F.col("df")))
    return g.withColumns({
        "verdict": F.when(F.col("ratio") > 1.5, "overdispersed").when(F.col("ratio") < 0.5, "underdispersed").otherwise("consistent"),
        "p_value": dist.apply(dist.chi2_sf, F.col("chisq"), F.col("df"))})


# ------------------------------------------------------ time-weighted charts

def _weighted_base(df, value, order_by, by, size, label, mu, sigma, method):
    """Subgroup means with centre and sigma attached (moving range when size is 1)."""
    groups = subgroups(df, value, order_by, by, size, label).withColumn("stage", F.lit(0))
    single = label is None and size == 1
    if single or method == "mr":
        groups = persist(moving_ranges(groups, by, 2, "mean"))
        stats = groups.groupBy(*by).agg(F.avg("mean").alias("_mu"), (F.avg("mr") / POINT_RANGE_FACTOR).alias("_sigma"))
    else:
        groups = persist(groups)
        stats = _merge(groups.groupBy(*by).agg(F.avg("mean").alias("_mu")),
                       sigma_within(groups, method or "rbar", by).withColumnRenamed("sigma", "_sigma"), by)
    if mu is not None:
        stats = stats.withColumn("_mu", F.lit(float(mu)))
    if sigma is not None:
        stats = stats.withColumn("_sigma", F.lit(float(sigma)))
    return attach(groups.select(*by, "point", "label", "n", "mean"), stats, by)


def _beyond(value: Column, limit: Column) -> Column:
    return F.array_compact(F.array(F.when(value > limit, 1))).cast("array<int>")


def ewma_chart(df: DataFrame, value: str, order_by: Sequence[str], by: Sequence[str] = (), size: int = 1,
               label: str | None = None, weight: float = 0.2, width: float = 3.0, mu: float | None = None,
               sigma: float | None = None, method: str | None = None) -> DataFrame:
    """EWMA with exact time-varying limits.

    z_i = w x_i + (1-w) z_(i-1) is a weighted running sum.  Inside a block of L
    rows it is one window with weights (1-w)^-j; across blocks the earlier
    memory has decayed by (1-w)^L < e^-600, so the previous block's last value
    is the exact carry in double precision.
    """
    if not 0 < weight <= 1:
        raise ValueError("weight must be in (0, 1]")
    rows = _weighted_base(df, value, order_by, by, size, label, mu, sigma, method)
    keep = 1 - weight
    if keep == 0:
        rows = rows.withColumn("value", F.col("mean"))
    else:
        span = max(1, int(600 / -math.log(keep)))
        rows = rows.withColumn("_block", F.floor((F.col("point") - 1) / span))
        rows = rows.withColumn("_pos", F.col("point") - F.col("_block") * span)
        w = block_window(by, "point").rowsBetween(Window.unboundedPreceding, 0)
        grow = F.pow(F.lit(keep), -F.col("_pos").cast("double"))
        decay = F.pow(F.lit(keep), F.col("_pos").cast("double"))
        rows = persist(rows.withColumn("_local", decay * F.sum(weight * (F.col("mean") - F.col("_mu")) * grow).over(w)))
        ends = rows.groupBy(*by, (F.col("_block") + 1).alias("_block")).agg(F.max_by("_local", "point").alias("_carry"))
        rows = attach(rows, ends, [*by, "_block"], how="left")
        rows = rows.withColumn("value", F.col("_mu") + F.col("_local") + decay * F.coalesce("_carry", F.lit(0.0)))
    sd = F.col("_sigma") / F.sqrt("n") * F.sqrt(weight / (2 - weight) * (1 - F.pow(F.lit(keep), 2.0 * F.col("point"))))
    rows = _limits(rows.withColumn("raw", F.col("mean")), F.col("_mu"), sd, mult=width)
    return rows.select(*by, "point", "label", "n", "raw", "value", "cl", "sigma", "ucl", "lcl",
                       _beyond(F.abs(F.col("value") - F.col("cl")), width * F.col("sigma")).alias("violations"))


def cusum_chart(df: DataFrame, value: str, order_by: Sequence[str], by: Sequence[str] = (), size: int = 1,
                label: str | None = None, target: float | None = None, sigma: float | None = None, h: float = 4.0,
                k: float = 0.5, method: str | None = None) -> DataFrame:
    """Two-sided tabular CUSUM in sigma units.

    max(0, C + d) accumulates as T - min(0, min T) with T the running sum of d:
    block sums and block minima give the carry, no sequential pass is needed.
    """
    rows = _weighted_base(df, value, order_by, by, size, label, target, sigma, method)
    z = ratio((F.col("mean") - F.col("_mu")) * F.sqrt("n"), F.col("_sigma"))
    rows = blocks(rows.withColumn("_z", z).withColumns({"_up": F.col("_z") - k, "_dn": -F.col("_z") - k}), "point")
    w = block_window(by, "point").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"_tu": F.sum("_up").over(w), "_td": F.sum("_dn").over(w)})
    rows = persist(rows.withColumns({"_mu_": F.min("_tu").over(w), "_md_": F.min("_td").over(w)}))
    ends = rows.groupBy(*by, "_block").agg(
        F.max_by("_tu", "point").alias("_su"), F.max_by("_td", "point").alias("_sd"),
        F.min("_tu").alias("_nu"), F.min("_td").alias("_nd"))
    order = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_block")
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumns({"_cu": F.coalesce(F.sum("_su").over(past), F.lit(0.0)), "_cd": F.coalesce(F.sum("_sd").over(past), F.lit(0.0))})
    ends = ends.withColumns({"_pu": F.coalesce(F.min(F.col("_cu") + F.col("_nu")).over(past), F.lit(0.0)),
                             "_pd": F.coalesce(F.min(F.col("_cd") + F.col("_nd")).over(past), F.lit(0.0))})
    rows = attach(rows, ends.select(*by, "_block", "_cu", "_cd", "_pu", "_pd"), [*by, "_block"])
    up = F.col("_cu") + F.col("_tu") - F.least(F.lit(0.0), F.col("_pu"), F.col("_cu") + F.col("_mu_"))
    dn = F.col("_cd") + F.col("_td") - F.least(F.lit(0.0), F.col("_pd"), F.col("_cd") + F.col("_md_"))
    rows = rows.withColumns({"value": up, "value_low": -dn})
    return rows.select(*by, "point", "label", "n", "value", "value_low", F.lit(float(h)).alias("ucl"), F.lit(-float(h)).alias("lcl"),
                       _beyond(F.greatest(F.col("value"), -F.col("value_low")), F.lit(float(h))).alias("violations"))


def moving_average_chart(df: DataFrame, value: str, order_by: Sequence[str], by: Sequence[str] = (), size: int = 1,
                         label: str | None = None, length: int = 3, mu: float | None = None,
                         sigma: float | None = None) -> DataFrame:
    """Moving average of the last `length` means; shorter windows at the start."""
    rows = _weighted_base(df, value, order_by, by, size, label, mu, sigma, "mr")
    rows = blocks(rows, "point", before=length - 1)
    frame = block_window(by, "point").rowsBetween(1 - length, 0)
    rows = rows.withColumns({"value": F.avg("mean").over(frame), "n": F.count("mean").over(frame)}).where("_own")
    rows = _limits(rows, F.col("_mu"), F.col("_sigma") / F.sqrt("n"))
    return rows.select(*by, "point", "label", "n", "value", "cl", "sigma", "ucl", "lcl",
                       _beyond(F.abs(F.col("value") - F.col("cl")), 3 * F.col("sigma")).alias("violations"))

