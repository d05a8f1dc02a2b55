"""Process capability against specification limits, per characteristic."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dist
from ..functions.constants import d2
from ..functions.normal import norm_cdf, with_norm_ppf
from ..functions.numeric import finite, ratio
from ..plans.joining import attach
from ..plans.ordering import prefix
from ..plans.session import persist
from . import control, describe, fitting
from .describe import _merge

# Lower edges of the grade bands of Cpk.
GRADES = [(2.0, "excellent"), (1.67, "good"), (1.33, "adequate"), (1.0, "marginal"), (0.67, "poor")]
SHIFT = 1.5


def with_sigma_level(df: DataFrame, ppm: Column, name: str = "sigma_level", shift: float = SHIFT) -> DataFrame:
    """Normal quantile of the yield plus the long-term shift."""
    p = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), ppm / 1e6))
    df = with_norm_ppf(df, name, p)
    return df.withColumn(name, -F.col(name) + shift)


def grade(cpk: Column) -> Column:
    out = F.when(cpk.isNull(), F.lit(None).cast("string"))
    for edge, name in GRADES:
        out = out.when(cpk >= edge, name)
    return out.otherwise("critical")


def with_specs(df: DataFrame, specs: DataFrame | None, by: Sequence[str], lsl: float | None, usl: float | None,
               target: float | None) -> DataFrame:
    """Limits from a table (by..., lsl, usl, target) or the same for all."""
    if specs is not None:
        return attach(df, specs.select(*by, "lsl", "usl", "target"), by, how="left")
    lit = lambda v: F.lit(None if v is None else float(v)).cast("double")
    return df.withColumns({"lsl": lit(lsl), "usl": lit(usl), "target": lit(target)})


def indices(g: DataFrame, sigma: str, prefix: str) -> DataFrame:
    """Cp family and tail rates from mean, a sigma column and the limits."""
    m, s, lsl, usl = F.col("mean"), F.col(sigma), F.col("lsl"), F.col("usl")
    cpu, cpl = ratio(usl - m, 3 * s), ratio(m - lsl, 3 * s)
    tau = F.sqrt(s * s + (m - F.col("target")) ** 2)
    g = g.withColumns({f"{prefix}_zl": ratio(lsl - m, s), f"{prefix}_zu": ratio(m - usl, s)})
    low, high = norm_cdf(F.col(f"{prefix}_zl")), norm_cdf(F.col(f"{prefix}_zu"))
    g = g.withColumns({
        f"{prefix}_cp": ratio(usl - lsl, 6 * s), f"{prefix}_cpu": cpu, f"{prefix}_cpl": cpl, f"{prefix}_cpk": F.least(cpu, cpl),
        f"{prefix}_cpm": ratio(usl - lsl, 6 * tau), f"{prefix}_ppm_below": F.coalesce(low, F.lit(0.0)) * 1e6,
        f"{prefix}_ppm_above": F.coalesce(high, F.lit(0.0)) * 1e6}).drop(f"{prefix}_zl", f"{prefix}_zu")
    p = F.greatest(F.lit(1e-15), F.least(F.lit(1.0), (F.col(f"{prefix}_ppm_below") + F.col(f"{prefix}_ppm_above")) / 1e6))
    g = g.withColumn(f"{prefix}_ppm", p * 1e6)
    g = with_norm_ppf(g, f"{prefix}_z_bench", F.least(F.col(f"{prefix}_ppm") / 1e6, F.lit(1 - 1e-15)))
    return g.withColumns({f"{prefix}_z_bench": -F.col(f"{prefix}_z_bench"), f"{prefix}_yield": 100 * (1 - F.col(f"{prefix}_ppm") / 1e6)})


def within_sigma(df: DataFrame, value: str, order_by: Sequence[str], by: Sequence[str] = (), size: int = 1,
                 label: str | None = None, method: str = "rbar") -> DataFrame:
    """Sigma within and its degrees of freedom: moving range, or the subgroups given by size or label."""
    groups = control.subgroups(df, value, order_by, by, size, label)
    if size == 1 and label is None:
        mr = control.moving_ranges(groups.withColumn("stage", F.lit(0)), by, 2, "mean")
        return mr.groupBy(*by).agg((F.avg("mr") / d2(2)).alias("sigma_within"), (F.count(F.lit(1)) - 1).cast("double").alias("df_within"))
    groups = persist(groups)
    est = control.sigma_within(groups, method, by).withColumnRenamed("sigma", "sigma_within")
    dof = groups.groupBy(*by).agg((F.count(F.lit(1)) * (size - 1) if label is None else F.sum(F.col("n") - 1)).cast("double").alias("df_within"))
    return _merge(est, dof, by)


def normal_capability(df: DataFrame, value: str, order_by: Sequence[str], by: Sequence[str] = (), lsl: float | None = None,
                      usl: float | None = None, target: float | None = None, specs: DataFrame | None = None, size: int = 1,
                      label: str | None = None, method: str = "rbar", conf: float = 0.95, normality: bool = True) -> DataFrame:
    """Within (cp..) and overall (pp..) indices, expected and observed PPM, intervals, sigma level and grade."""
    x = finite(value)
    rows = with_specs(df.select(*by, x.alias("_x")), specs, by, lsl, usl, target)
    g = rows.groupBy(*by).agg(
        F.count("_x").alias("n"), F.avg("_x").alias("mean"), F.stddev_samp("_x").alias("sd_overall"),
        F.count_if(F.col("_x") < F.col("lsl")).alias("observed_below"), F.count_if(F.col("_x") > F.col("usl")).alias("observed_above"),
        *[F.first(c).alias(c) for c in ("lsl", "usl", "target")])
    g = _merge(g, within_sigma(df, value, order_by, by, size, label, method), by)
    s = F.when(F.col("sigma_within") > 0, F.col("sigma_within")).otherwise(F.col("sd_overall"))
    g = persist(g.withColumn("sigma_within", s))
    g = persist(indices(g, "sigma_within", "within"))
    g = persist(indices(g, "sd_overall", "overall"))
    n = F.col("n").cast("double")
    z = float(dist.norm_ppf((1 + conf) / 2))
    g = g.withColumns({
        "observed_ppm": 1e6 * (F.col("observed_below") + F.col("observed_above")) / n,
        "k": 100 * F.abs(F.col("mean") - (F.col("lsl") + F.col("usl")) / 2) / ((F.col("usl") - F.col("lsl")) / 2),
        "_lo": dist.apply(dist.chi2_ppf, F.lit((1 - conf) / 2), F.col("df_within")),
        "_hi": dist.apply(dist.chi2_ppf, F.lit((1 + conf) / 2), F.col("df_within"))})
    se = lambda c: F.sqrt(1 / (9 * n) + F.col(c) ** 2 / (2 * (n - 1)))
    g = g.withColumns({
        "cp_low": F.col("within_cp") * F.sqrt(F.col("_lo") / F.col("df_within")), "cp_high": F.col("within_cp") * F.sqrt(F.col("_hi") / F.col("df_within")),
        "cpk_low": F.col("within_cpk") - z * se("within_cpk"), "cpk_high": F.col("within_cpk") + z * se("within_cpk"),
        "ppk_low": F.col("overall_cpk") - z * se("overall_cpk"), "ppk_high": F.col("overall_cpk") + z * se("overall_cpk"),
        "grade": grade(F.col("within_cpk")), "sigma_for_cp_133": (F.col("usl") - F.col("lsl")) / (6 * 1.33),
        "cpk_if_centered": F.col("within_cp")}).drop("_lo", "_hi")
    g = with_sigma_level(g, F.col("overall_ppm"))
    g = with_sigma_level(g, F.col("within_ppm"), "sigma_level_within")
    if normality:
        ad = fitting.anderson_darling(df, value, by)
        g = _merge(g, ad.select(*by, "a2", F.col("p_value").alias("a2_p")), by)
    return g


def non_normal_capability(df: DataFrame, value: str, by: Sequence[str] = (), lsl: float | None = None, usl: float | None = None,
                          specs: DataFrame | None = None, family: str = "weibull") -> DataFrame:
    """Pp/Ppk from the fitted .135, 50 and 99.865 percentiles and the fitted tail rates."""
    x = finite(value)
    g = persist(fitting.goodness_of_fit(df, value, family, by))
    g = with_specs(g, specs.withColumn("target", F.lit(None).cast("double")) if specs is not None else None, by, lsl, usl, None)
    for name, p in (("p00135", 0.00135), ("p50", 0.5), ("p99865", 0.99865)):
        g = fitting.with_quantile(g, name, family, F.lit(p))
    g = fitting.with_cdf(g, "_low", family, F.col("lsl"))
    g = fitting.with_cdf(g, "_up", family, F.col("usl"))
    ppu = ratio(F.col("usl") - F.col("p50"), F.col("p99865") - F.col("p50"))
    ppl = ratio(F.col("p50") - F.col("lsl"), F.col("p50") - F.col("p00135"))
    low = F.when(F.col("lsl").isNotNull(), F.col("_low")).otherwise(0.0)
    high = F.when(F.col("usl").isNotNull(), 1 - F.col("_up")).otherwise(0.0)
    g = g.withColumns({
        "pp": ratio(F.col("usl") - F.col("lsl"), F.col("p99865") - F.col("p00135")), "ppu": ppu, "ppl": ppl, "ppk": F.least(ppu, ppl),
        "ppm": 1e6 * F.greatest(F.lit(1e-15), F.least(F.lit(1.0), low + high))})
    g = with_norm_ppf(g, "z_bench", F.col("ppm") / 1e6)
    g = with_sigma_level(g.withColumns({"z_bench": -F.col("z_bench"), "yield": 100 * (1 - F.col("ppm") / 1e6)}), F.col("ppm")).drop("_low", "_up")
    rows = attach(df.select(*by, x.alias("_x")), g.select(*by, "lsl", "usl"), by)
    obs = rows.groupBy(*by).agg(F.count_if(F.col("_x") < F.col("lsl")).alias("observed_below"), F.count_if(F.col("_x") > F.col("usl")).alias("observed_above"))
    return _merge(g, obs, by)


def transformed_capability(df: DataFrame, value: str, order_by: Sequence[str], by: Sequence[str] = (), lsl: float | None = None,
                           usl: float | None = None, target: float | None = None, kind: str = "box-cox", size: int = 1,
                           conf: float = 0.95) -> DataFrame:
    """Box-Cox or Johnson transform of data and limits, then normal capability."""
    x = finite(value)
    limits = {"lsl": lsl, "usl": usl, "target": target}
    if kind == "box-cox":
        lam = persist(fitting.box_cox_lambda(df, value, by))
        rows = attach(df.select(*by, *order_by, x.alias("_v")), lam, by).withColumn("_z", fitting.box_cox(F.col("_v"), F.col("lambda")))
        side = lam.select(*by, *[(fitting.box_cox(F.lit(float(v)), F.col("lambda")) if v is not None else F.lit(None).cast("double")).alias(k)
                                 for k, v in limits.items()], "lambda")
        extra = ["lambda"]
    else:
        fit = persist(fitting.johnson(df, value, by))
        rows = fitting.johnson_transform(df.select(*by, *order_by, x.alias("_v")), "_v", fit, by, "_z")
        at = lambda v: (fitting.johnson_raw(F.col("family"), F.lit(float(v)), F.col("a"), F.col("b")) - F.col("mu")) / F.col("sigma")
        side = fit.select(*by, *[(at(v) if v is not None else F.lit(None).cast("double")).alias(k) for k, v in limits.items()], "family")
        extra = ["family"]
    side = persist(side)
    if by:
        g = normal_capability(rows, "_z", order_by, by, specs=side, size=size, conf=conf)
    else:
        r = side.first()
        g = normal_capability(rows, "_z", order_by, by, r["lsl"], r["usl"], r["target"], size=size, conf=conf)
    return _merge(g, side.select(*by, *extra), by)


def binomial_capability(df: DataFrame, defectives: str, size: str, by: Sequence[str] = (), conf: float = 0.95) -> DataFrame:
    """% defective with exact interval, PPM, z and sigma level."""
    g = df.groupBy(*by).agg(F.sum(defectives).cast("double").alias("defectives"), F.sum(size).cast("double").alias("inspected"))
    p = F.col("defectives") / F.col("inspected")
    g = g.withColumns({"p": p, "pct_defective": 100 * p, "ppm": 1e6 * p, "yield": 100 * (1 - p),
                       "ci_low": dist.apply(dist.clopper_low, F.col("defectives"), F.col("inspected"), F.lit(conf)),
                       "ci_high": dist.apply(dist.clopper_high, F.col("defectives"), F.col("inspected"), F.lit(conf))})
    g = with_sigma_level(g, F.col("ppm"))
    return g.withColumn("z_bench", F.col("sigma_level") - SHIFT)


def poisson_capability(df: DataFrame, defects: str, size: str, by: Sequence[str] = (), opportunities: float | None = None,
                       conf: float = 0.95) -> DataFrame:
    """Defects per unit with interval, DPMO, yield and sigma level."""
    g = df.groupBy(*by).agg(F.sum(defects).cast("double").alias("defects"), F.sum(size).cast("double").alias("units"))
    g = g.withColumn("dpu", F.col("defects") / F.col("units"))
    g = g.withColumns({
        "ci_low": dist.apply(dist.poisson_low, F.col("defects"), F.lit(conf)) / F.col("units"),
        "ci_high": dist.apply(dist.poisson_high, F.col("defects"), F.lit(conf)) / F.col("units"),
        "dpmo": F.col("dpu") / (opportunities or 1) * 1e6 if opportunities else F.lit(None).cast("double"),
        "yield": 100 * F.exp(-F.col("dpu"))})
    return with_sigma_level(g, (1 - F.exp(-F.col("dpu"))) * 1e6)


def cumulative_rate(df: DataFrame, count: str, size: str, order_by: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Rate per sample and running rate up to it."""
    rows = df.select(*by, *order_by, F.col(count).cast("double").alias("_c"), F.col(size).cast("double").alias("_n"))
    cum = prefix(rows, by, order_by, {"_bc": "_c", "_bn": "_n"})
    return cum.select(*by, *order_by, (F.col("_c") / F.col("_n")).alias("rate"),
                      ((F.col("_bc") + F.col("_c")) / (F.col("_bn") + F.col("_n"))).alias("cumulative_rate"))


def sixpack(df: DataFrame, value: str, order_by: Sequence[str], by: Sequence[str] = (), lsl: float | None = None,
            usl: float | None = None, target: float | None = None, size: int = 1, last: int = 25) -> dict[str, DataFrame]:
    """The six panels as tables: chart, last points, capability, probability plot, histogram, normality."""
    chart = (control.subgroup_chart(df, value, order_by, by, size, kind="xbar-s" if size >= 9 else "xbar-r") if size > 1
             else control.individuals_chart(df, value, order_by, by))
    chart = persist(chart)
    main = chart.where(F.col("panel").isin("xbar", "individuals"))
    top = main.groupBy(*by).agg(F.max("point").alias("_top"))
    recent = attach(main, top, by).where(F.col("point") > F.col("_top") - last).drop("_top")
    return {
        "chart": chart, "last_points": recent,
        "capability": normal_capability(df, value, order_by, by, lsl, usl, target, size=size),
        "probability_plot": fitting.probability_plot(df, value, by), "histogram": describe.histogram(df, value, by),
        "normality": fitting.anderson_darling(df, value, by)}

