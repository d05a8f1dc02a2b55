"""Capability and measurement systems (survey 2.12, 2.13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from procstats.functions.constants import d2, d3
from procstats.operators import capability as C
from procstats.operators import gage as M

from .common import phi, r, registry, table
from .models import CELL, operators

QUERIES, query = registry()


def items(s, d):
    return table(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate", "l_returnflag", "l_quantity", "l_extendedprice", "l_discount")


def events(s, d):
    return table(s, d, "events").select("event_id", "event_type", "user_id", "value", F.to_date("ts").alias("day"))


def spec_table(s):
    return s.createDataFrame([("A", 1.0, 50.0, 25.5), ("N", -20.0, 70.0, 25.0), ("R", 0.0, 60.0, 30.0)], "l_returnflag string, lsl double, usl double, target double")


CAP = f"""spec(g, lsl, usl, tg) AS (VALUES ('click', -50.0, 150.0, 40.0), ('error', -100.0, 200.0, 50.0), ('purchase', -50.0, 150.0, 50.0), ('signup', 0.0, 120.0, 50.0), ('view', -20.0, 180.0, 60.0)),
p AS (SELECT event_type g, value, abs(value - lag(value) OVER (PARTITION BY event_type ORDER BY event_id)) mr FROM events),
b AS (SELECT g, count(*)::DOUBLE n, avg(value) m, stddev_samp(value) so, avg(mr) / {d2(2)} sw, any_value(lsl)::DOUBLE lsl, any_value(usl)::DOUBLE usl, any_value(tg)::DOUBLE tg,
  count(*) FILTER (value < lsl) ob, count(*) FILTER (value > usl) oa FROM p JOIN spec USING (g) GROUP BY g),
z AS (SELECT *, (lsl - m) / sw z1, (m - usl) / sw z2, (lsl - m) / so z3, (m - usl) / so z4 FROM b),
c AS (SELECT *, {phi("z1")} a1, {phi("z2")} a2, {phi("z3")} a3, {phi("z4")} a4 FROM z)"""


def capability(s, d):
    specs = s.createDataFrame([("click", -50.0, 150.0, 40.0), ("error", -100.0, 200.0, 50.0), ("purchase", -50.0, 150.0, 50.0),
                               ("signup", 0.0, 120.0, 50.0), ("view", -20.0, 180.0, 60.0)], "event_type string, lsl double, usl double, target double")
    return C.normal_capability(events(s, d), "value", ["event_id"], ["event_type"], specs=specs)


@query("normal_capability", f"""
WITH {CAP}
SELECT g AS event_type, n::BIGINT AS n, {r("m")} AS mean, {r("so")} AS sd_overall, {r("sw")} AS sigma_within, ob AS observed_below, oa AS observed_above,
  {r("(usl - lsl) / (6 * sw)")} AS within_cp, {r("(usl - m) / (3 * sw)")} AS within_cpu, {r("(m - lsl) / (3 * sw)")} AS within_cpl,
  {r("least((usl - m) / (3 * sw), (m - lsl) / (3 * sw))")} AS within_cpk, {r("(usl - lsl) / (6 * sqrt(sw * sw + pow(m - tg, 2)))")} AS within_cpm,
  {r("(usl - lsl) / (6 * so)")} AS overall_cp, {r("least((usl - m) / (3 * so), (m - lsl) / (3 * so))")} AS overall_cpk,
  {r("1e6 * (a1 + a2)", 3)} AS within_ppm, {r("1e6 * (a3 + a4)", 3)} AS overall_ppm, {r("100 * (1 - a3 - a4)")} AS overall_yield,
  {r("1e6 * (ob + oa) / n", 3)} AS observed_ppm, {r("100 * abs(m - (lsl + usl) / 2) / ((usl - lsl) / 2)")} AS k,
  CASE WHEN least((usl - m) / (3 * sw), (m - lsl) / (3 * sw)) < 0.67 THEN 'critical' WHEN least((usl - m) / (3 * sw), (m - lsl) / (3 * sw)) < 1 THEN 'poor'
       WHEN least((usl - m) / (3 * sw), (m - lsl) / (3 * sw)) < 1.33 THEN 'marginal' ELSE 'adequate' END AS grade FROM c""",
       within_ppm=3, overall_ppm=3, observed_ppm=3)
def _(s, d):
    return capability(s, d).select("event_type", "n", "mean", "sd_overall", "sigma_within", "observed_below", "observed_above", "within_cp", "within_cpu", "within_cpl",
                                   "within_cpk", "within_cpm", "overall_cp", "overall_cpk", "within_ppm", "overall_ppm", "overall_yield", "observed_ppm", "k", "grade")


@query("normal_capability_full")
def _(s, d):
    return capability(s, d)


@query("normal_capability_subgroups")
def _(s, d):
    return C.normal_capability(events(s, d), "value", ["event_id"], ["event_type"], -50.0, 150.0, 40.0, size=5)


@query("normal_capability_by_label")
def _(s, d):
    e = events(s, d).withColumn("lot", F.col("user_id") % 30)
    return C.normal_capability(e, "value", ["event_id"], ["event_type"], -50.0, 150.0, 40.0, label="lot", method="pooled", normality=False)


@query("capability_spec_table", f"""
WITH spec(g, lsl, usl) AS (VALUES ('A', 1.0, 50.0), ('N', -20.0, 70.0), ('R', 0.0, 60.0))
SELECT g AS l_returnflag, count(*) AS n, {r("avg(l_quantity)")} AS mean, {r("stddev_samp(l_quantity)")} AS sd_overall,
 {r("(any_value(usl) - any_value(lsl)) / (6 * stddev_samp(l_quantity))")} AS overall_cp,
 {r("least(any_value(usl) - avg(l_quantity), avg(l_quantity) - any_value(lsl)) / (3 * stddev_samp(l_quantity))")} AS overall_cpk FROM lineitem JOIN spec ON g = l_returnflag GROUP BY g""")
def _(s, d):
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    return C.normal_capability(items(s, d), "l_quantity", order, ["l_returnflag"], specs=spec_table(s), normality=False).select(
        "l_returnflag", "n", "mean", "sd_overall", "overall_cp", "overall_cpk")


@query("non_normal_capability")
def _(s, d):
    return C.non_normal_capability(events(s, d), "value", ["event_type"], 0.1, 250.0, family="weibull")


@query("box_cox_capability")
def _(s, d):
    return C.transformed_capability(events(s, d), "value", ["event_id"], ["event_type"], 0.05, 400.0, 40.0)


@query("johnson_capability")
def _(s, d):
    return C.transformed_capability(events(s, d), "value", ["event_id"], ["event_type"], 0.05, 400.0, 40.0, kind="johnson")


def daily(s, d):
    return events(s, d).groupBy("day").agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.count(F.lit(1)).alias("total"))


@query("binomial_capability", f"""
SELECT count(*) FILTER (event_type = 'error')::DOUBLE AS defectives, count(*)::DOUBLE AS inspected, {r("count(*) FILTER (event_type = 'error') / count(*)")} AS p,
 {r("100.0 * count(*) FILTER (event_type = 'error') / count(*)")} AS pct_defective, {r("1e6 * count(*) FILTER (event_type = 'error') / count(*)", 3)} AS ppm,
 {r("100.0 - 100.0 * count(*) FILTER (event_type = 'error') / count(*)")} AS yield FROM events""", ppm=3)
def _(s, d):
    return C.binomial_capability(daily(s, d), "errors", "total").drop("ci_low", "ci_high", "sigma_level", "z_bench")


@query("binomial_capability_levels")
def _(s, d):
    return C.binomial_capability(daily(s, d), "errors", "total")


@query("poisson_capability", f"""
WITH g AS (SELECT count(*) FILTER (event_type = 'error')::DOUBLE c, count(*)::DOUBLE n FROM events)
SELECT c AS defects, n AS units, {r("c / n")} AS dpu, {r("c / n / 4 * 1e6", 3)} AS dpmo, {r("100 * exp(-c / n)")} AS yield FROM g""", dpmo=3)
def _(s, d):
    return C.poisson_capability(daily(s, d), "errors", "total", opportunities=4).drop("ci_low", "ci_high", "sigma_level")


@query("cumulative_rate", f"""
WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) FILTER (event_type = 'error')::DOUBLE c, count(*)::DOUBLE n FROM events GROUP BY 1)
SELECT day, {r("c / n")} AS rate, {r("sum(c) OVER (ORDER BY day) / sum(n) OVER (ORDER BY day)")} AS cumulative_rate FROM d""")
def _(s, d):
    return C.cumulative_rate(daily(s, d), "errors", "total", ["day"])


@query("sixpack_last_points", f"""
WITH p AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS point, count(*) OVER (PARTITION BY event_type) AS n, value FROM events)
SELECT event_type, point, {r("value")} AS value FROM p WHERE point > n - 25""")
def _(s, d):
    return C.sixpack(events(s, d), "value", ["event_id"], ["event_type"], -50.0, 150.0)["last_points"].select("event_type", "point", "value")


#: Components of the gage study with the interaction pooled and not pooled.
POOL = f"""WITH {CELL}, f AS (SELECT *, q AS rep, greatest(0, qb) AS ope, 0.0 AS inter, greatest(0, qa) AS par FROM vc)"""
OPEN = f"""WITH {CELL}, f AS (SELECT *, e AS rep, greatest(0, sb) AS ope, greatest(0, sab) AS inter, greatest(0, sa) AS par FROM vc)"""


@query("gage_crossed_inputs", f"""{POOL}
SELECT a::BIGINT AS a, b::BIGINT AS b, r::BIGINT AS replicates, nt::BIGINT AS n, {r("rep", 4)} AS var_repeat, {r("ope")} AS var_oper,
 {r("par")} AS var_part, {r("100 * (rep + ope) / (rep + ope + par)", 4)} AS pct_contribution_rr FROM f""", var_repeat=4, pct_contribution_rr=4)
def _(s, d):
    return M.gage_crossed(operators(s, d), "value", "event_type", "operator", alpha_pool=0.0).select(
        "a", "b", "replicates", "n", "var_repeat", "var_oper", "var_part", "pct_contribution_rr")


def _gage_sql(with_name: str) -> str:
    g, t = "(rep + ope + inter)", "(rep + ope + inter + par)"
    return f"""{with_name}
SELECT a::BIGINT AS a, b::BIGINT AS b, r::BIGINT AS replicates, nt::BIGINT AS n, {r("rep", 4)} AS var_repeat, {r("ope + inter")} AS var_repro, {r("ope")} AS var_oper,
 {r("inter")} AS var_inter, {r(g, 4)} AS var_gage, {r("par")} AS var_part, {r(t, 4)} AS var_total, {r(f"100 * sqrt({g} / {t})", 4)} AS pct_study_rr,
 {r(f"100 * {g} / {t}", 4)} AS pct_contribution_rr, {r(f"100 * 6 * sqrt({g}) / 400", 4)} AS pct_tolerance_rr, floor(1.41 * sqrt(par / {g}))::BIGINT AS ndc,
 CASE WHEN 100 * sqrt({g} / {t}) < 10 THEN 'acceptable' WHEN 100 * sqrt({g} / {t}) < 30 THEN 'marginal' ELSE 'not acceptable' END AS verdict,
 CASE WHEN floor(1.41 * sqrt(par / {g})) >= 5 THEN 'adequate' ELSE 'insufficient' END AS resolution FROM f"""


ROUNDED = dict.fromkeys(("var_repeat", "var_gage", "var_total", "pct_study_rr", "pct_contribution_rr", "pct_tolerance_rr"), 4)


@query("gage_crossed")
def _(s, d):
    return M.gage_crossed(operators(s, d), "value", "event_type", "operator", tolerance=400.0)


@query("gage_crossed_pooled", _gage_sql(POOL), **ROUNDED)
def _(s, d):
    return M.gage_crossed(operators(s, d), "value", "event_type", "operator", tolerance=400.0, alpha_pool=0.0).drop("pooled", "p_interaction")


@query("gage_crossed_with_interaction", _gage_sql(OPEN), **ROUNDED)
def _(s, d):
    return M.gage_crossed(operators(s, d), "value", "event_type", "operator", tolerance=400.0, alpha_pool=1.0).drop("pooled", "p_interaction")


@query("gage_components")
def _(s, d):
    return M.gage_components(M.gage_crossed(operators(s, d), "value", "event_type", "operator", tolerance=400.0), tolerance=400.0)


@query("gage_components_pooled", f"""{POOL}, l AS (SELECT unnest(range(7)) AS position, unnest(['gage', 'repeatability', 'reproducibility', 'operator', 'part*operator', 'part', 'total']) AS source,
 unnest([rep + ope, rep, ope, ope, 0, par, rep + ope + par]) AS v, rep + ope + par AS t FROM f)
SELECT position::INT AS position, source, {r("v", 4)} AS var_comp, {r("100 * v / t", 4)} AS pct_contribution, {r("sqrt(v)", 4)} AS sd, {r("6 * sqrt(v)", 4)} AS study_var,
 {r("100 * sqrt(v / t)", 4)} AS pct_study_var, {r("100 * 6 * sqrt(v) / 400", 4)} AS pct_tolerance FROM l""", var_comp=4, pct_contribution=4, sd=4, study_var=4, pct_study_var=4, pct_tolerance=4)
def _(s, d):
    return M.gage_components(M.gage_crossed(operators(s, d), "value", "event_type", "operator", tolerance=400.0, alpha_pool=0.0), tolerance=400.0)


@query("gage_nested", f"""
WITH {CELL}, w AS (SELECT *, (ssc - ssb - (c - b) * e) / (nt - k4) AS sn FROM eq)
SELECT b::BIGINT AS operators, pb::BIGINT AS parts_per_operator, r::BIGINT AS replicates, {r("e", 5)} AS var_repeat,
 {r("greatest(0, (ssb - (b - 1) * e - (k4 - k12) * sn) / (nt - k2))")} AS var_oper, {r("greatest(0, sn)")} AS var_part FROM w""", var_repeat=5)
def _(s, d):
    return M.gage_nested(operators(s, d), "value", "event_type", "operator").select(
        "operators", "parts_per_operator", "replicates", "var_repeat", "var_oper", "var_part")


#: Expected range of n normals by the trapezoid rule, independent of the operator's constants.
GRID = """grid AS (SELECT sum(f) OVER (ORDER BY x) * 0.005 - f * 0.0025 + 0.005 * 0.005 / 12 * x * f AS c FROM
  (SELECT x, exp(-x * x / 2) / sqrt(2 * pi()) AS f FROM (SELECT -9 + i * 0.005 AS x FROM range(3601) t(i))))"""


def d2_sql(n: str) -> str:
    return f"(SELECT sum(1 - pow(c, {n}) - pow(greatest(0, 1 - c), {n})) * 0.005 FROM grid)"


def d3_sql(n: str) -> str:
    """Standard deviation of the range: the mean square is twice a double integral over x < y, here summed on the grid."""
    reach = f"1 - pow(v.c, {n}) - pow(greatest(0, 1 - u.c), {n}) + pow(greatest(0, v.c - u.c), {n})"
    return f"(SELECT sqrt(2 * sum(({reach}) * CASE WHEN u.c = v.c THEN 0.5 ELSE 1 END) * 0.000025 - pow({d2_sql(n)}, 2)) FROM grid u JOIN grid v ON u.c <= v.c)"


@query("gage_xbar_r", f"""
WITH {GRID}, x AS (SELECT event_type p, user_id % 3 AS o, value FROM events),
c AS (SELECT p, o, count(*)::DOUBLE n, avg(value) m, max(value) - min(value) rg FROM x GROUP BY 1, 2),
o AS (SELECT max(m) - min(m) xd, count(*) k FROM (SELECT o, sum(n * m) / sum(n) m FROM c GROUP BY 1)),
p AS (SELECT max(m) - min(m) rp, count(*) k FROM (SELECT p, sum(n * m) / sum(n) m FROM c GROUP BY 1)),
z AS (SELECT max(n) AS r FROM c), k AS (SELECT r, {d2_sql("r")} AS dr, {d2_sql("3")} AS d3o, {d2_sql("5")} AS d5p FROM z),
e AS (SELECT avg(rg) rb, avg(rg) / dr ev, xd / d3o ar, rp / d5p pv, r FROM c, o, p, k GROUP BY xd, rp, dr, d3o, d5p, r),
f AS (SELECT *, sqrt(greatest(0, ar * ar - ev * ev / (5 * r))) av FROM e)
SELECT {r("rb")} AS rbar, {r("ev")} AS ev, {r("av")} AS av, {r("pv")} AS pv, {r("sqrt(ev * ev + av * av)")} AS rr, {r("sqrt(ev * ev + av * av + pv * pv)")} AS tv,
 floor(1.41 * pv / sqrt(ev * ev + av * av))::BIGINT AS ndc FROM f""")
def _(s, d):
    e = events(s, d).withColumn("operator", (F.col("user_id") % 3).cast("string"))
    return M.gage_xbar_r(e, "value", "event_type", "operator").select("rbar", "ev", "av", "pv", "rr", "tv", "ndc")


@query("gage_run_chart", "SELECT event_id, event_type AS part, (user_id % 3)::VARCHAR AS operator, value FROM events")
def _(s, d):
    e = events(s, d).withColumn("operator", F.col("user_id") % 3)
    return M.gage_run_chart(e, "value", "event_type", "operator", ["event_id"])


@query("gage_charts", f"""
WITH {GRID}, x AS (SELECT event_type p, (user_id % 3)::VARCHAR AS o, value FROM events),
c AS (SELECT p, o, count(*) n, avg(value) m, max(value) - min(value) rg FROM x GROUP BY 1, 2),
z AS (SELECT sum(n * m) / sum(n) g, avg(rg) rb, max(n) r FROM c), t AS (SELECT *, {d2_sql("r")} AS dr, {d3_sql("r")} AS er FROM z)
SELECT p AS part, o AS operator, n, {r("m")} AS mean, {r("rg")} AS range, {r("g")} AS grand, {r("rb")} AS rbar,
 {r("g + 3 * rb / dr / sqrt(r)")} AS mean_ucl, {r("g - 3 * rb / dr / sqrt(r)")} AS mean_lcl,
 {r("rb * (1 + 3 * er / dr)", 2)} AS range_ucl, {r("greatest(0, rb * (1 - 3 * er / dr))", 2)} AS range_lcl FROM c, t""", range_ucl=2, range_lcl=2)
def _(s, d):
    e = events(s, d).withColumn("operator", (F.col("user_id") % 3).cast("string"))
    return M.gage_charts(e, "value", "event_type", "operator")


@query("bias_linearity", f"""
WITH b AS (SELECT l_returnflag g, l_quantity x, l_quantity * l_discount - 1 AS y FROM lineitem)
SELECT g AS l_returnflag, count(*) AS n, {r("avg(y)")} AS mean_bias, {r("stddev_samp(y)")} AS sd_bias, {r("regr_slope(y, x)")} AS slope, {r("regr_intercept(y, x)")} AS intercept,
 {r("regr_r2(y, x)")} AS r2, {r("avg(y) / (stddev_samp(y) / sqrt(count(*)))", 4)} AS t, {r("abs(regr_slope(y, x)) * (max(x) - min(x))")} AS linearity FROM b GROUP BY g""", t=4)
def _(s, d):
    df = items(s, d).withColumn("m", F.col("l_quantity") * (1 + F.col("l_discount")) - 1)
    return M.bias_linearity(df, "l_quantity", "m", ["l_returnflag"]).select("l_returnflag", "n", "mean_bias", "sd_bias", "slope", "intercept", "r2", "t", "linearity")


@query("bias_by_reference", f"""
WITH b AS (SELECT l_quantity x, l_quantity * l_discount - 1 AS y FROM lineitem)
SELECT x AS reference, count(*) AS n, {r("avg(y)")} AS mean_bias, {r("coalesce(stddev_samp(y), 0)")} AS sd FROM b GROUP BY x""")
def _(s, d):
    df = items(s, d).withColumn("m", F.col("l_quantity") * (1 + F.col("l_discount")) - 1)
    return M.bias_by_reference(df, "l_quantity", "m").select("reference", "n", "mean_bias", "sd")




@query("attribute_agreement", f"""
WITH x AS (SELECT (user_id % 4)::VARCHAR a, ((event_id // 40) % 90)::VARCHAR i, (value > 60)::VARCHAR v FROM events),
s AS (SELECT i, CASE WHEN i::INT % 2 = 0 THEN 'true' ELSE 'false' END AS st FROM (SELECT DISTINCT i FROM x)),
p AS (SELECT a, x.i, min(v) lo, max(v) hi, count(*) k, any_value(st) st FROM x JOIN s USING (i) GROUP BY a, x.i),
e AS (SELECT i, min(lo) lo, max(hi) hi, any_value(st) st FROM p GROUP BY i),
u AS (SELECT 'within' c, a, count(*) n, count(*) FILTER (lo = hi) m FROM p WHERE k >= 2 GROUP BY a
 UNION ALL SELECT 'standard', a, count(*), count(*) FILTER (lo = hi AND lo = st) FROM p GROUP BY a
 UNION ALL SELECT 'between', NULL, count(*), count(*) FILTER (lo = hi) FROM e
 UNION ALL SELECT 'all_standard', NULL, count(*), count(*) FILTER (lo = hi AND lo = st) FROM e)
SELECT c AS comparison, a AS appraiser, n AS inspected, m AS matched, {r("100.0 * m / n")} AS pct,
 {r("100 * (m / n + 3.8414588206941254 / (2 * n) - 1.9599639845400545 * sqrt(m / n * (1 - m / n) / n + 3.8414588206941254 / (4 * n * n))) / (1 + 3.8414588206941254 / n)")} AS ci_low,
 {r("100 * (m / n + 3.8414588206941254 / (2 * n) + 1.9599639845400545 * sqrt(m / n * (1 - m / n) / n + 3.8414588206941254 / (4 * n * n))) / (1 + 3.8414588206941254 / n)")} AS ci_high FROM u""")
def _(s, d):
    e = events(s, d).select((F.col("user_id") % 4).alias("a"), (F.floor(F.col("event_id") / 40) % 90).alias("i"), (F.col("value") > 60).cast("string").alias("v"))
    e = e.withColumn("st", F.when(F.col("i") % 2 == 0, "true").otherwise("false"))
    return M.attribute_agreement(e, "a", "i", "v", "st")


@query("cohen_kappa", f"""
WITH c AS (SELECT quality a, toxic b, count(*)::DOUBLE c FROM labels GROUP BY 1, 2), n AS (SELECT sum(c) n FROM c),
p AS (SELECT any_value(n) n, sum(c) FILTER (a = b) / any_value(n) po, ((sum(c) FILTER (a = 0)) * (sum(c) FILTER (b = 0)) + (sum(c) FILTER (a = 1)) * (sum(c) FILTER (b = 1))) / pow(any_value(n), 2) pe FROM c, n)
SELECT n::BIGINT AS n, {r("po")} AS po, {r("pe")} AS pe, {r("(po - pe) / (1 - pe)")} AS kappa, {r("sqrt(po * (1 - po) / (n * pow(1 - pe, 2)))")} AS se,
 {r("((po - pe) / (1 - pe)) / sqrt(po * (1 - po) / (n * pow(1 - pe, 2)))")} AS z FROM p""")
def _(s, d):
    return M.cohen_kappa(table(s, d, "labels"), "quality", "toxic").drop("p_value", "strength")


@query("fleiss_kappa", f"""
WITH c AS (SELECT user_id i, event_type r, count(*)::DOUBLE c FROM events GROUP BY 1, 2),
t AS (SELECT i, sum(c) n, sum(c * (c - 1)) a FROM c GROUP BY i HAVING sum(c) > 1),
g AS (SELECT count(*) k, avg(n) nb, avg(a / (n * (n - 1))) pb FROM t),
s AS (SELECT r, sum(c / n) / any_value(k) p FROM c JOIN t USING (i), g GROUP BY r), e AS (SELECT sum(p * p) pe, sum(p * p * p) p3 FROM s),
f AS (SELECT *, (pb - pe) / (1 - pe) kp, sqrt(2 / (k * nb * (nb - 1))) / (1 - pe) * sqrt(pe - (2 * nb - 3) * pe * pe + 2 * (nb - 2) * p3) se FROM g, e)
SELECT k AS items, {r("kp")} AS kappa, {r("se")} AS se, {r("kp / se")} AS z FROM f""")
def _(s, d):
    return M.fleiss_kappa(events(s, d), "user_id", "event_type").drop("p_value", "strength")


@query("attribute_kappas", f"""
WITH x AS (SELECT (user_id % 4)::VARCHAR a, (event_id // 40) % 90 i, value > 60 v, ((event_id // 40) % 90) % 2 = 0 st FROM events),
n AS (SELECT a, count(*)::DOUBLE n, count(*) FILTER (v = st) / count(*)::DOUBLE po,
  (count(*) FILTER (v)::DOUBLE * count(*) FILTER (st) + count(*) FILTER (NOT v)::DOUBLE * count(*) FILTER (NOT st)) / pow(count(*), 2) pe FROM x WHERE v IS NOT NULL GROUP BY a),
k AS (SELECT a, n, (po - pe) / (1 - pe) kp, sqrt(po * (1 - po) / (n * pow(1 - pe, 2))) se FROM n),
c AS (SELECT i, v, count(*)::DOUBLE c FROM x WHERE v IS NOT NULL GROUP BY 1, 2),
t AS (SELECT i, sum(c) n, sum(c * (c - 1)) q FROM c GROUP BY i HAVING sum(c) > 1),
g AS (SELECT count(*) k, avg(n) nb, avg(q / (n * (n - 1))) pb FROM t),
s AS (SELECT v, sum(c / n) / any_value(k) p FROM c JOIN t USING (i), g GROUP BY v), e AS (SELECT sum(p * p) pe, sum(p * p * p) p3 FROM s),
f AS (SELECT k, (pb - pe) / (1 - pe) kp, sqrt(2 / (k * nb * (nb - 1))) / (1 - pe) * sqrt(pe - (2 * nb - 3) * pe * pe + 2 * (nb - 2) * p3) se FROM g, e)
SELECT 'standard' AS comparison, a AS appraiser, n::BIGINT AS n, {r("kp")} AS kappa, {r("se")} AS se, {r("kp / se")} AS z FROM k
UNION ALL SELECT 'between', NULL, k, {r("kp")}, {r("se")}, {r("kp / se")} FROM f""")
def _(s, d):
    e = events(s, d).select((F.col("user_id") % 4).alias("a"), (F.floor(F.col("event_id") / 40) % 90).alias("i"), (F.col("value") > 60).cast("string").alias("v"))
    e = e.withColumn("st", F.when(F.col("i") % 2 == 0, "true").otherwise("false"))
    return M.attribute_kappas(e, "a", "i", "v", "st").drop("p_value", "strength")
