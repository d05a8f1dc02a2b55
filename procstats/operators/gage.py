"""Measurement-system analysis."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dist
from ..functions.constants import by_size, d2, d3
from ..functions.numeric import finite, level, ratio
from ..plans.joining import attach
from ..plans.session import persist
from .anova import solved_sums, two_way_sums, variance_components
from .describe import _merge
from .hypothesis import p_from_t, with_p_from_z

# Strength-of-agreement bands of kappa (upper edges).
KAPPA_BANDS = [(0.0, "worse than chance"), (0.2, "slight"), (0.4, "weak"), (0.6, "moderate"), (0.8, "substantial"), (0.9, "strong")]


def _verdict(g: DataFrame) -> DataFrame:
    """Share of study variation (10 % / 30 %) and number of distinct categories (5)."""
    rr = F.col("pct_study_rr")
    return g.withColumns({
        "verdict": F.when(rr < 10, "acceptable").when(rr < 30, "marginal").otherwise("not acceptable"),
        "resolution": F.when(F.col("ndc") >= 5, "adequate").otherwise("insufficient")})


def _component_rows(g: DataFrame, by: Sequence[str], parts: dict[str, str], study: float, tolerance: float | None) -> DataFrame:
    """One row per variance component with its shares."""
    lines = F.array(*[F.struct(F.lit(name).alias("source"), F.col(c).alias("var_comp")) for name, c in parts.items()])
    t = g.select(*by, F.col("var_total").alias("_total"), F.posexplode(lines).alias("position", "_l"))
    v, s = F.col("_l.var_comp"), F.sqrt("_l.var_comp")
    return t.select(*by, "position", "_l.source", v.alias("var_comp"), (100 * ratio(v, F.col("_total"))).alias("pct_contribution"),
                    s.alias("sd"), (study * s).alias("study_var"), (100 * ratio(s, F.sqrt("_total"))).alias("pct_study_var"),
                    (100 * study * s / tolerance if tolerance else F.lit(None).cast("double")).alias("pct_tolerance"))


def gage_crossed(df: DataFrame, value: str, part: str, operator: str, by: Sequence[str] = (), tolerance: float | None = None,
                 study: float = 6.0, alpha_pool: float = 0.25, process_sd: float | None = None) -> DataFrame:
    """Crossed gage study by ANOVA, one row per group; cells may have any sizes.

    The interaction is pooled into repeatability when its p-value exceeds
    `alpha_pool`; without replicates it is the error term.  Components are those of `variance_components`, of the
    model without interaction where it is pooled.
    """
    sums = persist(two_way_sums(df, value, part, operator, by))
    full, pool = solved_sums(sums, by), solved_sums(sums, by, pooled=True)
    zero = F.lit(0.0)
    single = F.col("df_error") <= 0
    p = dist.apply(dist.f_sf, F.col("f_ab"), F.col("df_ab"), F.col("df_den_ab"))
    v = full.withColumn("_p", p).withColumns({"pooled": single | (F.coalesce(F.col("_p"), F.lit(1.0)) > alpha_pool), "p_interaction": F.when(~single, F.col("_p"))})
    v = _merge(v, pool.select(*by, *[F.col(f"raw_{k}").alias(f"_{k}") for k in ("a", "b", "error")]), by)
    which = lambda k: F.when(F.col("pooled"), F.col(f"_{k}")).otherwise(F.col(f"raw_{k}"))
    at_least = lambda c: F.when(c.isNotNull(), F.greatest(zero, c))
    g = v.withColumns({
        "n": F.col("n").cast("bigint"), "var_repeat": at_least(which("error")), "var_inter": F.when(F.col("pooled"), zero).otherwise(at_least(F.col("raw_ab"))),
        "var_part": at_least(which("a")), "var_oper": at_least(which("b"))})
    g = g.withColumn("var_repro", F.col("var_oper") + F.col("var_inter"))
    g = g.withColumn("var_gage", F.col("var_repeat") + F.col("var_repro"))
    if process_sd:
        g = g.withColumn("var_total", F.greatest(F.col("var_gage"), F.lit(float(process_sd) ** 2)))
        g = g.withColumn("var_part", F.greatest(zero, F.col("var_total") - F.col("var_gage")))
    else:
        g = g.withColumn("var_total", F.col("var_gage") + F.col("var_part"))
    g = g.withColumns({
        "pct_study_rr": 100 * F.sqrt(ratio(F.col("var_gage"), F.col("var_total"))), "pct_contribution_rr": 100 * ratio(F.col("var_gage"), F.col("var_total")),
        "pct_tolerance_rr": 100 * study * F.sqrt("var_gage") / tolerance if tolerance else F.lit(None).cast("double"),
        "ndc": F.floor(1.41 * ratio(F.sqrt("var_part"), F.sqrt("var_gage")))})
    keep = ["a", "b", "replicates", "n", "pooled", "p_interaction", "var_repeat", "var_repro", "var_oper", "var_inter", "var_gage", "var_part",
            "var_total", "pct_study_rr", "pct_contribution_rr", "pct_tolerance_rr", "ndc"]
    return _verdict(g.select(*by, *keep))


def gage_components(g: DataFrame, by: Sequence[str] = (), tolerance: float | None = None, study: float = 6.0) -> DataFrame:
    """Component table of `gage_crossed`."""
    return _component_rows(g, by, {
        "gage": "var_gage", "repeatability": "var_repeat", "reproducibility": "var_repro", "operator": "var_oper",
        "part*operator": "var_inter", "part": "var_part", "total": "var_total"}, study, tolerance)


def gage_nested(df: DataFrame, value: str, part: str, operator: str, by: Sequence[str] = (), tolerance: float | None = None,
                study: float = 6.0) -> DataFrame:
    """Nested study: parts inside operators, cells of any sizes; parts_per_operator and replicates are the largest."""
    v = variance_components(df, value, operator, part, by, nested=True)
    g = v.select(*by, F.col("a").alias("operators"), F.col("b").alias("parts_per_operator"), "replicates", F.col("var_error").alias("var_repeat"),
                 F.col("var_a").alias("var_oper"), F.col("var_b").alias("var_part"))
    g = g.withColumn("var_gage", F.col("var_repeat") + F.col("var_oper")).withColumn("var_total", F.col("var_gage") + F.col("var_part"))
    g = g.withColumns({
        "pct_study_rr": 100 * F.sqrt(ratio(F.col("var_gage"), F.col("var_total"))),
        "pct_tolerance_rr": 100 * study * F.sqrt("var_gage") / tolerance if tolerance else F.lit(None).cast("double"),
        "ndc": F.floor(1.41 * ratio(F.sqrt("var_part"), F.sqrt("var_gage")))})
    return _verdict(g)


def _cells(df: DataFrame, value: str, part: str, operator: str, by: Sequence[str]) -> DataFrame:
    x = finite(value)
    rows = df.select(*by, level(part).alias("part"), level(operator).alias("operator"), x.alias("_x")).where("_x is not null")
    return rows.groupBy(*by, "part", "operator").agg(F.count("_x").alias("n"), F.avg("_x").alias("mean"), (F.max("_x") - F.min("_x")).alias("range"))


def gage_xbar_r(df: DataFrame, value: str, part: str, operator: str, by: Sequence[str] = (), tolerance: float | None = None,
                study: float = 6.0) -> DataFrame:
    """Average-and-range method: EV, AV, PV, GRR, TV."""
    cells = persist(_cells(df, value, part, operator, by))
    weighted = F.sum(F.col("n") * F.col("mean")) / F.sum("n")
    ops = cells.groupBy(*by, "operator").agg(weighted.alias("m")).groupBy(*by).agg(
        (F.max("m") - F.min("m")).alias("_xd"), F.count(F.lit(1)).alias("operators"))
    parts = cells.groupBy(*by, "part").agg(weighted.alias("m")).groupBy(*by).agg(
        (F.max("m") - F.min("m")).alias("_rp"), F.count(F.lit(1)).alias("parts"))
    g = cells.groupBy(*by).agg(F.avg("range").alias("rbar"), F.max("n").alias("replicates"))
    g = _merge(_merge(g, ops, by), parts, by)
    r = F.col("replicates")
    ev = F.col("rbar") / by_size(d2, F.greatest(r, F.lit(2)))
    g = g.withColumns({"ev": ev, "pv": F.col("_rp") / by_size(d2, F.col("parts"))})
    raw = F.col("_xd") / by_size(d2, F.col("operators"))
    g = g.withColumn("av", F.sqrt(F.greatest(F.lit(0.0), raw * raw - F.col("ev") ** 2 / (F.col("parts") * r))))
    g = g.withColumn("rr", F.sqrt(F.col("ev") ** 2 + F.col("av") ** 2)).withColumn("tv", F.sqrt(F.col("rr") ** 2 + F.col("pv") ** 2))
    g = g.withColumns({f"pct_{c}": 100 * F.col(c) / F.col("tv") for c in ("ev", "av", "pv", "rr")})
    g = g.withColumns({"pct_tolerance_rr": 100 * study * F.col("rr") / tolerance if tolerance else F.lit(None).cast("double"),
                       "ndc": F.floor(1.41 * ratio(F.col("pv"), F.col("rr")))})
    return g.drop("_xd", "_rp")


def gage_run_chart(df: DataFrame, value: str, part: str, operator: str, order_by: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    x = finite(value)
    return df.where(x.isNotNull()).select(*by, *order_by, level(part).alias("part"), level(operator).alias("operator"), x.alias("value"))


def gage_charts(df: DataFrame, value: str, part: str, operator: str, by: Sequence[str] = ()) -> DataFrame:
    """Range and mean per part x operator cell with limits from the mean range."""
    cells = persist(_cells(df, value, part, operator, by))
    tot = cells.groupBy(*by).agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand"), F.avg("range").alias("rbar"), F.max("n").alias("_r"))
    t = attach(cells, tot, by)
    d, e, r = by_size(d2, F.col("_r")), by_size(d3, F.col("_r")), F.col("_r").cast("double")
    s = F.col("rbar") / d
    return t.withColumns({
        "range_ucl": F.col("rbar") * (1 + 3 * e / d), "range_lcl": F.greatest(F.lit(0.0), F.col("rbar") * (1 - 3 * e / d)),
        "mean_ucl": F.col("grand") + 3 * s / F.sqrt(r), "mean_lcl": F.col("grand") - 3 * s / F.sqrt(r)}).drop("_r")


def bias_linearity(df: DataFrame, reference: str, measured: str, by: Sequence[str] = (), tolerance: float | None = None,
                   process_var: float | None = None) -> DataFrame:
    """Mean bias with t test and the line of bias on reference."""
    r, m = finite(reference), finite(measured)
    rows = df.select(*by, r.alias("_r"), (m - r).alias("_b")).na.drop(subset=["_r", "_b"])
    x, y = F.col("_r"), F.col("_b")
    g = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(y).alias("mean_bias"), F.stddev_samp(y).alias("sd_bias"), F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.regr_sxx(y, x).alias("_sxx"), F.regr_syy(y, x).alias("_syy"),
        F.avg(x).alias("_mx"), (F.max(x) - F.min(x)).alias("_span"))
    n = F.col("n").cast("double")
    g = g.withColumns({"t": ratio(F.col("mean_bias"), F.col("sd_bias") / F.sqrt(n)), "df": n - 1,
                       "_s2": (F.col("_syy") - F.col("slope") ** 2 * F.col("_sxx")) / (n - 2)})
    g = g.withColumns({"t_slope": ratio(F.col("slope"), F.sqrt(F.col("_s2") / F.col("_sxx"))),
                       "t_intercept": ratio(F.col("intercept"), F.sqrt(F.col("_s2") * (1 / n + F.col("_mx") ** 2 / F.col("_sxx")))), "s": F.sqrt("_s2")})
    half = dist.apply(dist.t_ppf, F.lit(0.975), F.col("df")) * F.col("sd_bias") / F.sqrt(n)
    pct = lambda v: 100 * F.abs("mean_bias") / v if v else F.lit(None).cast("double")
    g = g.withColumns({
        "p_value": p_from_t(F.col("t"), F.col("df"), "two"), "p_slope": p_from_t(F.col("t_slope"), n - 2, "two"),
        "p_intercept": p_from_t(F.col("t_intercept"), n - 2, "two"), "_half": half, "pct_linearity": 100 * F.abs("slope"),
        "linearity": F.abs("slope") * F.col("_span"), "pct_bias": pct(process_var), "pct_bias_tolerance": pct(tolerance)})
    return g.withColumns({"ci_low": F.col("mean_bias") - F.col("_half"), "ci_high": F.col("mean_bias") + F.col("_half")}).drop(
        "_sxx", "_syy", "_mx", "_span", "_s2", "_half")


def bias_by_reference(df: DataFrame, reference: str, measured: str, by: Sequence[str] = ()) -> DataFrame:
    r, m = finite(reference), finite(measured)
    rows = df.select(*by, r.alias("reference"), (m - r).alias("_b")).na.drop(subset=["reference", "_b"])
    g = rows.groupBy(*by, "reference").agg(F.count(F.lit(1)).alias("n"), F.avg("_b").alias("mean_bias"),
                                           F.coalesce(F.stddev_samp("_b"), F.lit(0.0)).alias("sd"))
    se = F.col("sd") / F.sqrt("n")
    dof = F.when(F.col("n") > 1, F.col("n") - 1)
    g = g.withColumns({"t": F.when(F.col("n") > 1, ratio(F.col("mean_bias"), se)), "_q": dist.apply(dist.t_ppf, F.lit(0.975), dof)})
    half = F.coalesce(F.col("_q") * se, F.lit(0.0))
    return g.withColumns({"ci_low": F.col("mean_bias") - half, "ci_high": F.col("mean_bias") + half,
                          "p_value": p_from_t(F.col("t"), dof, "two")}).drop("_q")


# ----------------------------------------------------------- attribute studies

def _with_wilson(g: DataFrame, conf: float = 0.95) -> DataFrame:
    z = float(dist.norm_ppf((1 + conf) / 2))
    x, n = F.col("matched").cast("double"), F.nullif(F.col("inspected").cast("double"), F.lit(0.0))
    p = x / n
    den, mid = 1 + z * z / n, p + z * z / (2 * n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return g.withColumns({"pct": 100 * p, "ci_low": 100 * (mid - half) / den, "ci_high": 100 * (mid + half) / den})


def attribute_agreement(df: DataFrame, appraiser: str, item: str, rating: str, standard: str | None = None) -> DataFrame:
    """Agreement within appraisers, versus the standard, between appraisers and all versus standard.

    `standard` is a column with the item's true rating.
    """
    cells = df.select(level(appraiser).alias("appraiser"), level(item).alias("item"), level(rating).alias("_r"),
                      (F.col(standard).cast("string") if standard else F.lit(None).cast("string")).alias("_s"))
    per = persist(cells.groupBy("appraiser", "item").agg(F.min("_r").alias("_lo"), F.max("_r").alias("_hi"), F.max("_s").alias("_s"), F.count(F.lit(1)).alias("_k")))
    same = F.col("_lo") == F.col("_hi")
    hit = same & (F.col("_lo") == F.col("_s"))
    within = per.where("_k >= 2").groupBy("appraiser").agg(F.count(F.lit(1)).alias("inspected"), F.count_if(same).alias("matched"))
    everyone = per.groupBy("item").agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"), F.max("_s").alias("_s"))
    between = everyone.groupBy().agg(F.count(F.lit(1)).alias("inspected"), F.count_if(same).alias("matched"))
    out = within.withColumn("comparison", F.lit("within")).unionByName(
        between.withColumns({"appraiser": F.lit(None).cast("string"), "comparison": F.lit("between")}))
    if standard:
        known = per.where("_s is not null").groupBy("appraiser").agg(F.count(F.lit(1)).alias("inspected"), F.count_if(hit).alias("matched"))
        every = everyone.where("_s is not null").groupBy().agg(F.count(F.lit(1)).alias("inspected"), F.count_if(hit).alias("matched"))
        out = out.unionByName(known.withColumn("comparison", F.lit("standard"))).unionByName(
            every.withColumns({"appraiser": F.lit(None).cast("string"), "comparison": F.lit("all_standard")}))
    return _with_wilson(out.select("comparison", "appraiser", "inspected", "matched"))


def kappa_strength(k: Column) -> Column:
    out = F.when(k.isNull(), F.lit(None).cast("string"))
    for edge, name in KAPPA_BANDS:
        out = out.when(k < edge, name)
    return out.otherwise("almost perfect")


def cohen_kappa(df: DataFrame, first: str, second: str, by: Sequence[str] = ()) -> DataFrame:
    """Kappa of two ratings with se, z and strength."""
    rows = df.where(F.col(first).isNotNull() & F.col(second).isNotNull())
    cells = persist(rows.groupBy(*by, level(first).alias("_a"), level(second).alias("_b")).agg(F.count(F.lit(1)).alias("_c")))
    both = cells.select(*by, F.col("_a").alias("_l"), F.col("_c").alias("_r"), F.lit(0).cast("bigint").alias("_q")).unionByName(
        cells.select(*by, F.col("_b").alias("_l"), F.lit(0).cast("bigint").alias("_r"), F.col("_c").alias("_q")))
    margin = both.groupBy(*by, "_l").agg(F.sum("_r").cast("double").alias("_r"), F.sum("_q").cast("double").alias("_q"))
    chance = margin.groupBy(*by).agg(F.sum(F.col("_r") * F.col("_q")).alias("_e"))
    g = cells.groupBy(*by).agg(F.sum("_c").alias("n"), F.sum(F.when(F.col("_a") == F.col("_b"), F.col("_c")).otherwise(0)).alias("_o"))
    g = _merge(g, chance, by)
    n = F.col("n").cast("double")
    g = g.withColumns({"po": F.col("_o") / n, "pe": F.col("_e") / (n * n)})
    po, pe = F.col("po"), F.col("pe")
    g = g.withColumns({"kappa": ratio(po - pe, 1 - pe), "se": F.sqrt(ratio(po * (1 - po), n * (1 - pe) ** 2))})
    g = g.withColumn("z", ratio(F.col("kappa"), F.col("se"))).drop("_o", "_e")
    return with_p_from_z(g, "z", "greater").withColumn("strength", kappa_strength(F.col("kappa")))


def fleiss_kappa(df: DataFrame, item: str, rating: str, by: Sequence[str] = ()) -> DataFrame:
    """Kappa of many raters over the same items."""
    rows = df.where(F.col(rating).isNotNull())
    cells = persist(rows.groupBy(*by, F.col(item).alias("_i"), level(rating).alias("_r")).agg(F.count(F.lit(1)).cast("double").alias("_c")))
    items = cells.groupBy(*by, "_i").agg(F.sum("_c").alias("_n"), F.sum(F.col("_c") * (F.col("_c") - 1)).alias("_a")).where("_n > 1")
    items = persist(items)
    g = items.groupBy(*by).agg(F.count(F.lit(1)).alias("items"), F.avg("_n").alias("_nb"), F.avg(F.col("_a") / (F.col("_n") * (F.col("_n") - 1))).alias("_pb"))
    names = {k: "_k_" + k for k in [*by, "_i"]}
    cond = [F.col(k).eqNullSafe(F.col(v)) for k, v in names.items()]
    share = cells.join(items.select(*by, "_i", "_n").withColumnsRenamed(names), cond).groupBy(*by, "_r").agg(F.sum(F.col("_c") / F.col("_n")).alias("_w"))
    share = attach(share, g.select(*by, "items"), by).withColumn("_p", F.col("_w") / F.col("items"))
    pe = share.groupBy(*by).agg(F.sum(F.col("_p") ** 2).alias("_pe"), F.sum(F.col("_p") ** 3).alias("_p3"))
    g = _merge(g, pe, by)
    k, nb, pe1, p3 = F.col("items"), F.col("_nb"), F.col("_pe"), F.col("_p3")
    g = g.withColumns({
        "kappa": ratio(F.col("_pb") - pe1, 1 - pe1),
        "se": F.sqrt(2 / (k * nb * (nb - 1))) / (1 - pe1) * F.sqrt(pe1 - (2 * nb - 3) * pe1 * pe1 + 2 * (nb - 2) * p3)})
    g = g.withColumn("z", ratio(F.col("kappa"), F.col("se"))).drop("_nb", "_pb", "_pe", "_p3")
    return with_p_from_z(g, "z", "greater").withColumn("strength", kappa_strength(F.col("kappa")))


def attribute_kappas(df: DataFrame, appraiser: str, item: str, rating: str, standard: str | None = None) -> DataFrame:
    """Kappa of each appraiser against the standard (Cohen; n ratings) and between all ratings of an item (Fleiss; n items)."""
    rows = df.select(level(appraiser).alias("appraiser"), level(item).alias("_i"), F.col(rating).alias("_v"),
                     (F.col(standard) if standard else F.lit(None).cast("string")).alias("_s"))
    shown = ["comparison", "appraiser", "n", "kappa", "se", "z", "p_value", "strength"]
    between = fleiss_kappa(rows, "_i", "_v").withColumnRenamed("items", "n")
    out = between.withColumns({"comparison": F.lit("between"), "appraiser": F.lit(None).cast("string")}).select(*shown)
    if standard:
        each = cohen_kappa(rows, "_v", "_s", ["appraiser"]).withColumn("comparison", F.lit("standard"))
        out = out.unionByName(each.select(*shown))
    return out
