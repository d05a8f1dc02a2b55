"""Process and Lean tables as grouped jobs over event, log or ledger rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dist
from ..functions.numeric import finite, level, ratio
from ..plans.joining import attach
from ..plans.ordering import prefix
from .capability import with_sigma_level

# Action priority by (severity, occurrence, detection), first rule whose minima are all reached.
ACTION_PRIORITY = [
    (9, 4, 0, "high"), (9, 2, 5, "high"), (9, 2, 0, "medium"), (9, 0, 5, "medium"), (9, 0, 0, "low"),
    (7, 6, 0, "high"), (7, 4, 5, "high"), (7, 2, 0, "medium"), (7, 0, 6, "medium"), (7, 0, 0, "low"),
    (4, 8, 6, "high"), (4, 5, 0, "medium"), (4, 0, 7, "medium"), (4, 0, 0, "low"),
    (0, 9, 8, "medium"), (0, 0, 0, "low"),
]
# Cost kinds of the four quality-cost classes.
COST_CLASSES = {
    "internal": ["scrap", "rework", "downtime", "reinspection"],
    "external": ["warranty", "returns", "complaints", "penalties"],
    "appraisal": ["inspection", "testing", "audits"],
    "prevention": ["training", "planning", "maintenance"],
}


def _sum(c: str | Column) -> Column:
    return F.sum(finite(c))


def yield_from_dpu(dpu: Column) -> Column:
    return F.exp(-dpu)


def dpu_from_yield(y: Column) -> Column:
    return -F.ln(F.greatest(F.lit(1e-12), F.least(F.lit(1.0), y)))


def dpmo(df: DataFrame, defects: str, units: str, opportunities: float, by: Sequence[str] = ()) -> DataFrame:
    """Defects per unit, per opportunity and per million, yield and sigma level."""
    g = df.groupBy(*by).agg(_sum(defects).alias("defects"), _sum(units).alias("units"))
    g = g.withColumn("dpu", ratio(F.col("defects"), F.col("units")))
    g = g.withColumn("dpo", F.col("dpu") / opportunities)
    g = g.withColumns({"dpmo": 1e6 * F.col("dpo"), "yield": 100 * (1 - F.col("dpo"))})
    return with_sigma_level(g, F.col("dpmo"))


def rolled_throughput(df: DataFrame, order_by: Sequence[str], by: Sequence[str] = (), given: str | None = None,
                      units: str | None = None, defectives: str | None = None, defects: str | None = None) -> DataFrame:
    """Step yields (given, from defective units, or e^-dpu) and their running product."""
    if given:
        y = finite(given)
    elif defectives:
        y = 1 - ratio(finite(defectives), finite(units))
    else:
        y = F.exp(-ratio(finite(defects), finite(units)))
    rows = df.select(*by, *order_by, F.coalesce(y, F.lit(1.0)).alias("step_yield"))
    rows = rows.withColumn("_ln", F.ln(F.greatest(F.col("step_yield"), F.lit(1e-300))))
    cum = prefix(rows, by, order_by, {"_before": "_ln"})
    return cum.select(*by, *order_by, "step_yield", F.exp(F.col("_before") + F.col("_ln")).alias("cumulative"),
                      dpu_from_yield(F.col("step_yield")).alias("dpu"))


def rolled_throughput_total(steps: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """RTY, normalised yield, total dpu, hidden factory and sigma level per stream."""
    ln = F.ln(F.greatest(F.col("step_yield"), F.lit(1e-300)))
    g = steps.groupBy(*by).agg(F.count(F.lit(1)).alias("steps"), F.exp(F.sum(ln)).alias("rty"), F.exp(F.avg(ln)).alias("normalized_yield"))
    g = g.withColumns({"total_dpu": dpu_from_yield(F.col("rty")), "hidden_factory": 1 - F.col("rty")})
    return with_sigma_level(g, 1e6 * F.col("hidden_factory"))


def fmea(df: DataFrame, severity: str, occurrence: str, detection: str, order_by: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """RPN, criticality, action priority, risk band and cumulative % of RPN."""
    s, o, d = (F.coalesce(finite(c), F.lit(0.0)) for c in (severity, occurrence, detection))
    ap = F.lit(None).cast("string")
    for smin, omin, dmin, name in reversed(ACTION_PRIORITY):
        ap = F.when((s >= smin) & (o >= omin) & (d >= dmin), name).otherwise(ap)
    # a higher severity band never falls through to a lower one: each band ends with a rule of its own
    rows = df.withColumns({"rpn": s * o * d, "criticality": s * o, "action_priority": ap})
    rows = rows.withColumn("risk", F.when((F.col("rpn") >= 200) | (s >= 9), "high").when(F.col("rpn") >= 80, "medium").otherwise("low"))
    cum = prefix(rows, by, [F.col("rpn").desc(), *order_by], {"_before": "rpn"}, {"_total": "rpn"})
    return cum.withColumn("cum_pct", 100 * ratio(F.col("_before") + F.col("rpn"), F.col("_total"))).drop("_before", "_total")


def cost_of_quality(df: DataFrame, kind: str, amount: str, by: Sequence[str] = (), sales: DataFrame | None = None) -> DataFrame:
    """Ledger rows (kind of cost, amount) to the four classes, failure share and % of sales (table by..., sales)."""
    x = F.coalesce(finite(amount), F.lit(0.0))
    g = df.groupBy(*by).agg(*[F.sum(F.when(level(kind).isin(kinds), x).otherwise(0.0)).alias(c) for c, kinds in COST_CLASSES.items()])
    total = F.col("internal") + F.col("external") + F.col("appraisal") + F.col("prevention")
    g = g.withColumn("total", total)
    g = g.withColumn("failure_share", F.coalesce(100 * ratio(F.col("internal") + F.col("external"), F.col("total")), F.lit(0.0)))
    if sales is None:
        return g
    return attach(g, sales.select(*by, "sales"), by, how="left").withColumn("pct_of_sales", 100 * ratio(F.col("total"), F.col("sales")))


def oee(df: DataFrame, by: Sequence[str], planned: str, downtime: str, ideal_cycle: str, total: str, rejects: str,
        calendar: str | None = None) -> DataFrame:
    """Availability, performance, quality, OEE, TEEP and losses from a machine log."""
    ideal = finite(total) * finite(ideal_cycle)
    g = df.groupBy(*by).agg(
        _sum(planned).alias("planned"), F.coalesce(_sum(downtime), F.lit(0.0)).alias("downtime"), F.sum(ideal).alias("_ideal"),
        _sum(total).alias("total"), F.coalesce(_sum(rejects), F.lit(0.0)).alias("rejects"),
        F.sum(F.coalesce(finite(rejects), F.lit(0.0)) * finite(ideal_cycle)).alias("quality_loss"),
        *([_sum(calendar).alias("_calendar")] if calendar else []))
    g = g.withColumn("run_time", F.col("planned") - F.col("downtime"))
    g = g.withColumns({"availability": ratio(F.col("run_time"), F.col("planned")), "performance": ratio(F.col("_ideal"), F.col("run_time")),
                       "quality": ratio(F.col("total") - F.col("rejects"), F.col("total")), "performance_loss": F.col("run_time") - F.col("_ideal")})
    g = g.withColumn("oee", F.col("availability") * F.coalesce("performance", F.lit(0.0)) * F.coalesce("quality", F.lit(0.0)))
    if calendar:
        g = g.withColumn("teep", F.col("oee") * ratio(F.col("planned"), F.col("_calendar"))).drop("_calendar")
    return g.withColumn("band", F.when(F.col("oee") >= 0.85, "world class").when(F.col("oee") >= 0.6, "typical").otherwise("low")).drop("_ideal")


def takt(df: DataFrame, by: Sequence[str], minutes: str, breaks: str | None, demand: str, cycle: str | None = None) -> DataFrame:
    """Available time, takt, stations needed and their utilisation per line.

    Rows are shifts; the cycle time of a line is its largest.
    """
    g = df.groupBy(*by).agg((_sum(minutes) - (F.coalesce(_sum(breaks), F.lit(0.0)) if breaks else 0.0)).alias("available"), _sum(demand).alias("demand"),
                            *([F.max(finite(cycle)).alias("cycle")] if cycle else []))
    g = g.withColumn("takt_minutes", ratio(F.col("available"), F.col("demand"))).withColumn("takt_seconds", 60 * F.col("takt_minutes"))
    if not cycle:
        return g
    g = g.withColumn("stations", F.ceil(ratio(F.col("cycle"), F.col("takt_minutes"))))
    return g.withColumns({"utilization": 100 * ratio(F.col("cycle"), F.col("stations") * F.col("takt_minutes")),
                          "meets_demand": F.col("cycle") <= F.col("takt_minutes")})


def value_stream(df: DataFrame, by: Sequence[str], step: str, process: str, wait: str, value_added: Column) -> DataFrame:
    """VA, NVA, waiting and lead time, process-cycle efficiency and the bottleneck step."""
    p, w = F.coalesce(finite(process), F.lit(0.0)), F.coalesce(finite(wait), F.lit(0.0))
    g = df.groupBy(*by).agg(
        F.sum(F.when(value_added, p).otherwise(0.0)).alias("value_added"), F.sum(F.when(value_added, 0.0).otherwise(p)).alias("non_value_added"),
        F.sum(w).alias("wait"), F.min_by(F.col(step), F.struct(-p, F.col(step))).alias("bottleneck"), F.max(p).alias("bottleneck_time"))
    g = g.withColumn("lead_time", F.col("value_added") + F.col("non_value_added") + F.col("wait"))
    return g.withColumn("pce", F.coalesce(100 * ratio(F.col("value_added"), F.col("lead_time")), F.lit(0.0)))


def epei(df: DataFrame, by: Sequence[str], demand: str, cycle: str, changeover: str, available: float | str) -> DataFrame:
    """Run time, changeover time and the every-part-every interval per resource (rows are products)."""
    avail = F.lit(float(available)) if not isinstance(available, str) else F.max(finite(available))
    g = df.groupBy(*by).agg(F.sum(finite(demand) * finite(cycle)).alias("run_time"), F.coalesce(_sum(changeover), F.lit(0.0)).alias("changeover"),
                            avail.alias("available"))
    g = g.withColumn("free_time", F.col("available") - F.col("run_time"))
    g = g.withColumn("cycles", F.when(F.col("changeover") > 0, F.col("free_time") / F.col("changeover")))
    return g.withColumns({"epei": F.when(F.col("cycles") > 0, 1 / F.col("cycles")), "feasible": F.col("free_time") > 0})


def changeover(df: DataFrame, by: Sequence[str], minutes: str, external: Column, convertible: Column, reducible_to: str | None = None) -> DataFrame:
    """Internal, external, convertible and reducible minutes and the target changeover."""
    t = F.coalesce(finite(minutes), F.lit(0.0))
    less = F.coalesce(t - finite(reducible_to), F.lit(0.0)) if reducible_to else F.lit(0.0)
    g = df.groupBy(*by).agg(
        F.sum(F.when(external, 0.0).otherwise(t)).alias("internal"), F.sum(F.when(external, t).otherwise(0.0)).alias("external"),
        F.sum(F.when(convertible, t).otherwise(0.0)).alias("convertible"), F.sum(less).alias("reducible"))
    g = g.withColumn("target", F.greatest(F.lit(0.0), F.col("internal") - F.col("convertible") - F.col("reducible")))
    return g.withColumn("improvement_pct", F.coalesce(100 * ratio(F.col("internal") - F.col("target"), F.col("internal")), F.lit(0.0)))


def safety_stock(df: DataFrame, by: Sequence[str], demand: str, lead_time: float | str, sd_lead_time: float = 0.0,
                 service: float = 0.95, order_qty: float | None = None, order_cost: float | None = None, holding_cost: float | None = None,
                 periods_per_year: float = 365.0) -> DataFrame:
    """Safety stock, reorder point, cycle stock and EOQ per SKU from demand rows (one per period)."""
    x = finite(demand)
    aggs = [F.avg(x).alias("avg_demand"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("sd_demand")]
    if isinstance(lead_time, str):
        aggs += [F.avg(finite(lead_time)).alias("lead_time"), F.coalesce(F.stddev_samp(finite(lead_time)), F.lit(0.0)).alias("sd_lead")]
    g = df.groupBy(*by).agg(*aggs)
    if not isinstance(lead_time, str):
        g = g.withColumns({"lead_time": F.lit(float(lead_time)), "sd_lead": F.lit(float(sd_lead_time))})
    z = float(dist.norm_ppf(service))
    m, s, t, u = (F.col(c) for c in ("avg_demand", "sd_demand", "lead_time", "sd_lead"))
    g = g.withColumn("safety_stock", z * F.sqrt(t * s * s + m * m * u * u))
    g = g.withColumn("reorder_point", m * t + F.col("safety_stock"))
    if order_qty:
        g = g.withColumn("cycle_stock", F.lit(order_qty / 2))
    if order_cost and holding_cost:
        g = g.withColumn("eoq", F.sqrt(2 * m * periods_per_year * order_cost / holding_cost))
    return g
