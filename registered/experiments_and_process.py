"""Experiment analysis and process tables (survey 2.15)."""

from __future__ import annotations

from pyspark.sql import functions as F

from procstats.operators import experiments as X
from procstats.operators import process as P

from .common import r, registry, table
from .models import gs

QUERIES, query = registry()
FS = ["a", "b", "c"]


def runs(s, d):
    """Two-level factors cut from numeric columns, the response is the price."""
    return table(s, d, "lineitem").select(
        "l_returnflag", "l_linestatus", F.when(F.col("l_discount") >= 0.05, 10.0).otherwise(5.0).alias("a"),
        F.when(F.col("l_tax") >= 0.04, 80.0).otherwise(40.0).alias("b"), F.when(F.col("l_quantity") > 25, 3.0).otherwise(1.0).alias("c"),
        "l_quantity", "l_discount", "l_tax", F.col("l_extendedprice").alias("y"))


CODED = """x AS (SELECT l_returnflag k0, CASE WHEN l_discount >= 0.05 THEN 1.0 ELSE -1.0 END a, CASE WHEN l_tax >= 0.04 THEN 1.0 ELSE -1.0 END b,
 CASE WHEN l_quantity > 25 THEN 1.0 ELSE -1.0 END c, l_quantity, l_discount, l_tax, l_extendedprice y FROM lineitem)"""


@query("factorial_effects", f"""
WITH {CODED}, w AS (SELECT k0, a, b, c, a * b AS ab, a * c AS ac, b * c AS bc, y FROM x), {gs("w", "y", ["a", "b", "c", "ab", "ac", "bc"], "k0")}
SELECT k AS l_returnflag, unnest(['a', 'b', 'c', 'a*b', 'a*c', 'b*c']) AS term, unnest([1, 1, 1, 2, 2, 2]) AS "order",
 unnest([{", ".join(r(f"2 * b{i}", 3) for i in range(1, 7))}]) AS effect FROM fit""", effect=3)
def _(s, d):
    return X.factorial_effects(X.factorial_model(runs(s, d), "y", FS, ["l_returnflag"])).select("l_returnflag", "term", "order", "effect")


@query("factorial_effects_blocked")
def _(s, d):
    return X.factorial_effects(X.factorial_model(runs(s, d), "y", FS, ["l_returnflag"], 3, "l_linestatus"), "l_linestatus")


@query("lenth", f"""
WITH e AS (SELECT l_returnflag g, p_size, avg(l_extendedprice) - 75000 AS e FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
m AS (SELECT g, count(*) m, 1.5 * median(abs(e)) s0 FROM e GROUP BY 1)
SELECT g AS l_returnflag, any_value(m) AS m, {r("1.5 * median(abs(e)) FILTER (abs(e) < 2.5 * s0)", 3)} AS pse, floor(any_value(m) / 3)::BIGINT AS d FROM e JOIN m USING (g) GROUP BY g""", pse=3)
def _(s, d):
    j = table(s, d, "lineitem").select("l_partkey", "l_returnflag", "l_extendedprice").join(
        table(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size"), "l_partkey")
    e = j.groupBy("l_returnflag", "p_size").agg((F.avg("l_extendedprice") - 75000).alias("effect"))
    return X.lenth(e, "effect", ["l_returnflag"]).select("l_returnflag", "m", "pse", "d")


@query("main_effect_means", f"""
SELECT 'l_returnflag' AS factor, l_returnflag AS level, count(*) AS n, {r("avg(l_extendedprice)", 3)} AS mean, {r("stddev_samp(l_extendedprice) / sqrt(count(*))", 3)} AS se FROM lineitem GROUP BY 2
UNION ALL SELECT 'l_linestatus', l_linestatus, count(*), {r("avg(l_extendedprice)", 3)}, {r("stddev_samp(l_extendedprice) / sqrt(count(*))", 3)} FROM lineitem GROUP BY 2""", digits=3)
def _(s, d):
    return X.main_effect_means(runs(s, d), "y", ["l_returnflag", "l_linestatus"])


@query("interaction_means", f"""
SELECT 'l_returnflag' AS factor_a, 'l_linestatus' AS factor_b, l_returnflag AS level_a, l_linestatus AS level_b, count(*) AS n, {r("avg(l_extendedprice)", 3)} AS mean FROM lineitem GROUP BY 3, 4""", digits=3)
def _(s, d):
    return X.interaction_means(runs(s, d), "y", ["l_returnflag", "l_linestatus"])


@query("curvature_test", f"""
WITH g AS (SELECT l_returnflag, count(*) FILTER (l_discount <> 0.05)::DOUBLE nf, count(*) FILTER (l_discount = 0.05)::DOUBLE nc, avg(l_extendedprice) FILTER (l_discount <> 0.05) mf,
 avg(l_extendedprice) FILTER (l_discount = 0.05) mc, var_samp(l_extendedprice) FILTER (l_discount <> 0.05) vf, var_samp(l_extendedprice) FILTER (l_discount = 0.05) vc FROM lineitem GROUP BY 1),
s AS (SELECT *, sqrt(((nf - 1) * vf + (nc - 1) * vc) / (nf + nc - 2) * (1 / nf + 1 / nc)) se FROM g)
SELECT l_returnflag, nf::BIGINT AS n_factorial, nc::BIGINT AS n_center, {r("mf", 3)} AS mean_factorial, {r("mc", 3)} AS mean_center, {r("mf - mc", 3)} AS diff, nf + nc - 2 AS df, {r("se", 3)} AS se,
 {r("(mf - mc) / se", 5)} AS t FROM s""", digits=3, t=5)
def _(s, d):
    return X.curvature_test(runs(s, d), "y", F.col("l_discount") == 0.05, ["l_returnflag"]).drop("p_value")


@query("pure_error_lack_of_fit", f"""
WITH {CODED}, {gs("x", "y", ["a", "b", "c"], "k0")},
p AS (SELECT k0, sum(ss) pss, sum(n - 1)::DOUBLE pdf FROM (SELECT k0, count(*) n, var_pop(y) * count(*) ss FROM x GROUP BY k0, a, b, c) GROUP BY 1)
SELECT k AS l_returnflag, dfe - pdf AS lof_df, pdf AS pure_df, {r("((sse - pss) / (dfe - pdf)) / (pss / pdf)", 5)} AS f FROM fit JOIN p ON k = k0""", digits=5)
def _(s, d):
    df = runs(s, d)
    m = X.factorial_model(df, "y", FS, ["l_returnflag"], order=1)
    return X.pure_error(df, "y", FS, m, ["l_returnflag"]).select("l_returnflag", "lof_df", "pure_df", "f")


RSM = """h AS (SELECT l_returnflag k0, (min(l_quantity) + max(l_quantity)) / 2 qm, (min(l_discount) + max(l_discount)) / 2 dm FROM lineitem GROUP BY 1),
hq AS (SELECT k0, arg_min(d, [-c, d]) qh FROM (SELECT k0, round(abs(l_quantity - qm), 6) d, count(*)::DOUBLE c FROM lineitem JOIN h ON k0 = l_returnflag GROUP BY 1, 2) WHERE d > 1e-9 GROUP BY 1),
hd AS (SELECT k0, arg_min(d, [-c, d]) dh FROM (SELECT k0, round(abs(l_discount - dm), 6) d, count(*)::DOUBLE c FROM lineitem JOIN h ON k0 = l_returnflag GROUP BY 1, 2) WHERE d > 1e-9 GROUP BY 1),
q AS (SELECT k0, (l_quantity - qm) / qh u, (l_discount - dm) / dh v, l_extendedprice y FROM lineitem JOIN h ON k0 = l_returnflag JOIN hq USING (k0) JOIN hd USING (k0)),
w AS (SELECT k0, u, v, u * v AS uv, u * u AS uu, v * v AS vv, y FROM q)"""


def surface(s, d):
    return X.ResponseSurface(table(s, d, "lineitem").select("l_returnflag", "l_quantity", "l_discount", "l_extendedprice"), "l_extendedprice", ["l_quantity", "l_discount"], ["l_returnflag"])


@query("response_surface_fit", f"""
WITH {RSM}, {gs("w", "y", ["u", "v", "uv", "uu", "vv"], "k0")}
SELECT k AS l_returnflag, unnest(['(intercept)', 'l_quantity', 'l_discount', 'l_quantity*l_discount', 'l_quantity^2', 'l_discount^2']) AS term,
 unnest([{", ".join(r(f"b{i}", 4) for i in range(6))}]) AS coef FROM fit""", digits=4)
def _(s, d):
    return surface(s, d).coefficients().select("l_returnflag", "term", "coef")


@query("response_surface_stationary")
def _(s, d):
    return surface(s, d).stationary()


@query("surface_grid", f"""
WITH {RSM}, {gs("w", "y", ["u", "v", "uv", "uu", "vv"], "k0")},
g AS (SELECT -1 + 2 * i / 19 AS u, -1 + 2 * j / 19 AS v FROM range(20) a(i), range(20) b(j))
SELECT k AS l_returnflag, {r("u")} AS l_quantity, {r("v")} AS l_discount, {r("b0 + b1 * u + b2 * v + b3 * u * v + b4 * u * u + b5 * v * v", 3)} AS fit FROM fit, g""", fit=3)
def _(s, d):
    return surface(s, d).grid("l_quantity", "l_discount", 20)


@query("desirability", f"""
SELECT o_orderkey, {r("CASE WHEN o_totalprice <= 50000 THEN 0 WHEN o_totalprice >= 400000 THEN 1 ELSE pow((o_totalprice - 50000) / 350000, 2) END", 9)} AS d_max,
 {r("CASE WHEN o_totalprice >= 400000 THEN 0 WHEN o_totalprice <= 50000 THEN 1 ELSE (400000 - o_totalprice) / 350000 END", 9)} AS d_min,
 {r("CASE WHEN o_totalprice < 50000 OR o_totalprice > 400000 THEN 0 WHEN o_totalprice <= 200000 THEN (o_totalprice - 50000) / 150000 ELSE (400000 - o_totalprice) / 200000 END", 9)} AS d_target FROM orders""", digits=9)
def _(s, d):
    y = F.col("o_totalprice")
    return table(s, d, "orders").select("o_orderkey", X.desirability(y, "max", 50000, 400000, None, 2.0).alias("d_max"),
                                        X.desirability(y, "min", None, 50000, 400000).alias("d_min"), X.desirability(y, "target", 50000, 200000, 400000).alias("d_target"))


@query("optimize_settings")
def _(s, d):
    df = table(s, d, "lineitem").select("l_quantity", "l_discount", "l_extendedprice", "l_tax")
    m1 = X.ResponseSurface(df, "l_extendedprice", ["l_quantity", "l_discount"])
    m2 = X.ResponseSurface(df, "l_tax", ["l_quantity", "l_discount"])
    return X.optimize([(m1, {"goal": "max", "lower": 0.0, "target": 150000.0, "importance": 2.0}), (m2, {"goal": "target", "lower": 0.0, "target": 0.04, "upper": 0.08})])




def blend(s, d):
    return table(s, d, "lineitem").select("l_returnflag", F.col("l_quantity") / 50, (F.col("l_discount") * 10).alias("d"), (F.col("l_tax") * 12).alias("t"), "l_extendedprice").toDF(
        "l_returnflag", "q", "d", "t", "y")


@query("mixture_coefficients", f"""
WITH m AS (SELECT l_quantity / 50 q, l_discount * 10 d, l_tax * 12 t, l_extendedprice y FROM lineitem),
s AS (SELECT q / (q + d + t) a, d / (q + d + t) b, y FROM m), {gs("s", "y", ["a", "b"])}
SELECT unnest(['q', 'd', 't']) AS term, unnest([{r("b0 + b1", 3)}, {r("b0 + b2", 3)}, {r("b0", 3)}]) AS coef FROM fit""", digits=3)
def _(s, d):
    return X.mixture_model(blend(s, d), ["q", "d", "t"], "y", 1).coefficients().select("term", "coef")


@query("mixture_quadratic")
def _(s, d):
    return X.mixture_model(blend(s, d), ["q", "d", "t"], "y", 2, ["l_returnflag"]).coefficients()


@query("mixture_trace")
def _(s, d):
    return X.mixture_trace(X.mixture_model(blend(s, d), ["q", "d", "t"], "y", 2), ["q", "d", "t"])


@query("mixture_grid")
def _(s, d):
    return X.mixture_grid(X.mixture_model(blend(s, d), ["q", "d", "t"], "y", 2), ["q", "d", "t"], 20)


@query("signal_to_noise", f"""
SELECT event_type, (user_id % 3)::VARCHAR AS op, count(*) AS n, {r("avg(value)")} AS mean, {r("-10 * log10(avg(value * value))")} AS sn FROM events GROUP BY 1, 2""")
def _(s, d):
    e = table(s, d, "events").withColumn("op", F.col("user_id") % 3)
    return X.signal_to_noise(e, "value", ["event_type", "op"])


@query("signal_to_noise_levels", f"""
WITH g AS (SELECT event_type a, (user_id % 3)::VARCHAR b, -10 * log10(avg(1 / (value * value))) sn FROM events GROUP BY 1, 2),
l AS (SELECT 'event_type' factor, a lv, avg(sn) m FROM g GROUP BY a UNION ALL SELECT 'op', b, avg(sn) FROM g GROUP BY b),
t AS (SELECT factor, max(m) - min(m) dl FROM l GROUP BY 1)
SELECT factor, lv AS level, {r("m")} AS mean_sn, {r("dl")} AS delta, (CASE WHEN dl = (SELECT max(dl) FROM t) THEN 1 ELSE 2 END)::INTEGER AS rank FROM l JOIN t USING (factor)""")
def _(s, d):
    e = table(s, d, "events").withColumn("op", F.col("user_id") % 3)
    return X.signal_to_noise_levels(X.signal_to_noise(e, "value", ["event_type", "op"], "larger"), ["event_type", "op"])


@query("coded_units", f"""
WITH g AS (SELECT (min(l_quantity) + max(l_quantity)) / 2 m, (max(l_quantity) - min(l_quantity)) / 2 h FROM lineitem)
SELECT l_orderkey, l_partkey, l_linenumber, {r("(l_quantity - m) / h")} AS l_quantity, {r("m + (l_quantity - m) / h * h", 4)} AS back FROM lineitem, g""", back=4)
def _(s, d):
    df = table(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    ranges = X.factor_ranges(df, ["l_quantity"])
    coded = X.real_to_coded(df, ["l_quantity"], ranges)
    back = X.coded_to_real(coded.withColumn("z", F.col("l_quantity")), ["l_quantity"], ranges)
    return back.select("l_orderkey", "l_partkey", "l_linenumber", F.col("z").alias("l_quantity"), F.col("l_quantity").alias("back"))


@query("corner_means", f"""
WITH {CODED} SELECT k0 AS l_returnflag, a::INTEGER AS a, b::INTEGER AS b, c::INTEGER AS c, {r("avg(y)", 3)} AS mean, count(*) AS n FROM x GROUP BY 1, 2, 3, 4""", mean=3)
def _(s, d):
    df = runs(s, d)
    return X.corner_means(X.real_to_coded(df, FS, X.factor_ranges(df, FS)), "y", FS, ["l_returnflag"])


# ------------------------------------------------------------------- process

@query("dpmo", f"""
WITH g AS (SELECT l_returnflag, sum((l_discount > 0.08)::INT)::DOUBLE d, sum(l_quantity) u FROM lineitem GROUP BY 1)
SELECT l_returnflag, d AS defects, u AS units, {r("d / u", 8)} AS dpu, {r("d / u / 4", 8)} AS dpo, {r("1e6 * d / u / 4", 3)} AS dpmo, {r("100 * (1 - d / u / 4)")} AS yield FROM g""", dpu=8, dpo=8, dpmo=3)
def _(s, d):
    df = table(s, d, "lineitem").select("l_returnflag", (F.col("l_discount") > 0.08).cast("int").alias("bad"), "l_quantity")
    return P.dpmo(df, "bad", "l_quantity", 4, ["l_returnflag"]).drop("sigma_level")


def steps(s, d):
    return table(s, d, "orders").groupBy("o_orderpriority", F.year("o_orderdate").alias("step")).agg(
        F.count(F.lit(1)).alias("units"), F.count_if(F.col("o_orderstatus") == "P").alias("bad"))


@query("rolled_throughput", f"""
WITH g AS (SELECT o_orderpriority, year(o_orderdate)::INTEGER AS step, 1 - count(*) FILTER (o_orderstatus = 'P') / count(*) AS y FROM orders GROUP BY 1, 2)
SELECT o_orderpriority, step, {r("y")} AS step_yield, {r("exp(sum(ln(y)) OVER (PARTITION BY o_orderpriority ORDER BY step))")} AS cumulative, {r("-ln(y)")} AS dpu FROM g""")
def _(s, d):
    return P.rolled_throughput(steps(s, d), ["step"], ["o_orderpriority"], units="units", defectives="bad")


@query("rolled_throughput_total", f"""
WITH g AS (SELECT o_orderpriority, year(o_orderdate) AS step, exp(-(count(*) FILTER (o_orderstatus = 'P') / count(*))) AS y FROM orders GROUP BY 1, 2)
SELECT o_orderpriority, count(*) AS steps, {r("exp(sum(ln(y)))")} AS rty, {r("exp(avg(ln(y)))")} AS normalized_yield, {r("-sum(ln(y))")} AS total_dpu, {r("1 - exp(sum(ln(y)))")} AS hidden_factory FROM g GROUP BY 1""")
def _(s, d):
    t = P.rolled_throughput(steps(s, d), ["step"], ["o_orderpriority"], units="units", defects="bad")
    return P.rolled_throughput_total(t, ["o_orderpriority"]).drop("sigma_level")


@query("fmea", f"""
WITH f AS (SELECT p_partkey, p_size % 10 + 1 AS s, p_partkey % 10 + 1 AS o, (p_partkey // 7) % 10 + 1 AS d FROM part), g AS (SELECT *, (s * o * d)::DOUBLE rpn FROM f)
SELECT p_partkey, s, o, d, rpn, (s * o)::DOUBLE AS criticality,
 CASE WHEN s >= 9 THEN CASE WHEN o >= 4 OR (o >= 2 AND d >= 5) THEN 'high' WHEN o >= 2 OR d >= 5 THEN 'medium' ELSE 'low' END
      WHEN s >= 7 THEN CASE WHEN o >= 6 OR (o >= 4 AND d >= 5) THEN 'high' WHEN o >= 2 OR d >= 6 THEN 'medium' ELSE 'low' END
      WHEN s >= 4 THEN CASE WHEN o >= 8 AND d >= 6 THEN 'high' WHEN o >= 5 OR d >= 7 THEN 'medium' ELSE 'low' END
      ELSE CASE WHEN o >= 9 AND d >= 8 THEN 'medium' ELSE 'low' END END AS action_priority,
 CASE WHEN rpn >= 200 OR s >= 9 THEN 'high' WHEN rpn >= 80 THEN 'medium' ELSE 'low' END AS risk,
 {r("100 * sum(rpn) OVER (ORDER BY rpn DESC, p_partkey) / sum(rpn) OVER ()")} AS cum_pct FROM g""")
def _(s, d):
    p = table(s, d, "part").select("p_partkey", (F.col("p_size") % 10 + 1).alias("s"), (F.col("p_partkey") % 10 + 1).alias("o"),
                                   (F.floor(F.col("p_partkey") / 7) % 10 + 1).alias("d"))
    return P.fmea(p, "s", "o", "d", ["p_partkey"])


@query("cost_of_quality", f"""
WITH l AS (SELECT o_orderpriority g, ['scrap', 'rework', 'warranty', 'returns', 'inspection', 'training', 'other'][o_orderkey % 7 + 1] k, o_totalprice x FROM orders),
c AS (SELECT g, sum(x) FILTER (k IN ('scrap', 'rework')) i, sum(x) FILTER (k IN ('warranty', 'returns')) e, sum(x) FILTER (k = 'inspection') a, sum(x) FILTER (k = 'training') p, sum(x) s FROM l GROUP BY 1)
SELECT g AS o_orderpriority, {r("i", 2)} AS internal, {r("e", 2)} AS external, {r("a", 2)} AS appraisal, {r("p", 2)} AS prevention, {r("i + e + a + p", 2)} AS total,
 {r("100 * (i + e) / (i + e + a + p)")} AS failure_share, {r("s", 2)} AS sales, {r("100 * (i + e + a + p) / s")} AS pct_of_sales FROM c""", digits=2, failure_share=6, pct_of_sales=6)
def _(s, d):
    kinds = F.array(*[F.lit(k) for k in ("scrap", "rework", "warranty", "returns", "inspection", "training", "other")])
    o = table(s, d, "orders").withColumn("kind", F.get(kinds, (F.col("o_orderkey") % 7).cast("int")))
    sales = o.groupBy("o_orderpriority").agg(F.sum("o_totalprice").alias("sales"))
    return P.cost_of_quality(o, "kind", "o_totalprice", ["o_orderpriority"], sales)


@query("oee", f"""
WITH g AS (SELECT event_type, count(*) * 60.0 pl, sum(CASE WHEN value > 100 THEN 20.0 ELSE 0 END) dn, sum(floor(value)) tt, sum(CASE WHEN value > 80 THEN 1.0 ELSE 0 END) rj FROM events GROUP BY 1)
SELECT event_type, pl::DOUBLE AS planned, dn::DOUBLE AS downtime, tt::DOUBLE AS total, rj::DOUBLE AS rejects, {r("rj * 0.5")} AS quality_loss, (pl - dn)::DOUBLE AS run_time, {r("(pl - dn) / pl")} AS availability,
 {r("tt * 0.5 / (pl - dn)")} AS performance, {r("(tt - rj) / tt")} AS quality, {r("pl - dn - tt * 0.5")} AS performance_loss,
 {r("(pl - dn) / pl * (tt * 0.5 / (pl - dn)) * ((tt - rj) / tt)")} AS oee, 'low' AS band FROM g""")
def _(s, d):
    v = F.col("value")
    log = table(s, d, "events").select("event_type", F.lit(60.0).alias("planned"), F.when(v > 100, 20.0).otherwise(0.0).alias("down"), F.lit(0.5).alias("ideal"),
                                       F.floor(v).alias("made"), F.when(v > 80, 1).otherwise(0).alias("bad"))
    return P.oee(log, ["event_type"], "planned", "down", "ideal", "made", "bad")


@query("takt_time", f"""
WITH g AS (SELECT l_returnflag, count(*) * 450.0 av, sum(l_quantity) * 10 dm, max(l_tax) * 100 cy FROM lineitem GROUP BY 1)
SELECT l_returnflag, av::DOUBLE AS available, dm AS demand, {r("cy")} AS cycle, {r("av / dm")} AS takt_minutes, {r("60 * av / dm")} AS takt_seconds, ceil(cy / (av / dm))::BIGINT AS stations,
 {r("100 * cy / (ceil(cy / (av / dm)) * av / dm)")} AS utilization, cy <= av / dm AS meets_demand FROM g""")
def _(s, d):
    df = table(s, d, "lineitem").select("l_returnflag", F.lit(480.0).alias("m"), F.lit(30.0).alias("b"), (F.col("l_quantity") * 10).alias("q"), (F.col("l_tax") * 100).alias("cy"))
    return P.takt(df, ["l_returnflag"], "m", "b", "q", "cy")


@query("value_stream", f"""
WITH g AS (SELECT user_id, event_type st, sum(value) p, count(*)::DOUBLE w FROM events GROUP BY 1, 2),
b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(p, 6) DESC, st) rn FROM g)
SELECT user_id, {r("coalesce(sum(p) FILTER (st IN ('purchase', 'signup')), 0)", 4)} AS value_added, {r("coalesce(sum(p) FILTER (st NOT IN ('purchase', 'signup')), 0)", 4)} AS non_value_added, sum(w) AS wait,
 max(st) FILTER (rn = 1) AS bottleneck, {r("max(p)", 4)} AS bottleneck_time, {r("sum(p) + sum(w)", 4)} AS lead_time, {r("100 * coalesce(sum(p) FILTER (st IN ('purchase', 'signup')), 0) / (sum(p) + sum(w))", 4)} AS pce FROM b GROUP BY 1""", digits=4)
def _(s, d):
    g = table(s, d, "events").groupBy("user_id", "event_type").agg(F.round(F.sum("value"), 6).alias("p"), F.count(F.lit(1)).cast("double").alias("w"))
    return P.value_stream(g, ["user_id"], "event_type", "p", "w", F.col("event_type").isin("purchase", "signup"))


@query("every_part_every_interval", f"""
WITH g AS (SELECT l_suppkey, l_partkey, sum(l_quantity) q FROM lineitem GROUP BY 1, 2), t AS (SELECT l_suppkey, sum(q * 0.2) rn, count(*) * 15.0 ch FROM g GROUP BY 1)
SELECT l_suppkey, {r("rn")} AS run_time, ch::DOUBLE AS changeover, 10000.0::DOUBLE AS available, {r("10000 - rn")} AS free_time, {r("(10000 - rn) / ch")} AS cycles,
 CASE WHEN 10000 - rn > 0 THEN {r("ch / (10000 - rn)")} END AS epei, 10000 - rn > 0 AS feasible FROM t""")
def _(s, d):
    g = table(s, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("q"))
    g = g.withColumns({"cycle": F.lit(0.2), "setup": F.lit(15.0)})
    return P.epei(g, ["l_suppkey"], "q", "cycle", "setup", 10000.0)


@query("changeover", f"""
WITH g AS (SELECT user_id, sum(CASE WHEN event_type = 'view' THEN 0 ELSE value END) i, sum(CASE WHEN event_type = 'view' THEN value ELSE 0 END) x, sum(CASE WHEN event_type = 'click' THEN value ELSE 0 END) c,
 sum(CASE WHEN event_type = 'error' THEN value - value / 2 ELSE 0 END) rd FROM events GROUP BY 1)
SELECT user_id, {r("i", 4)} AS internal, {r("x", 4)} AS external, {r("c", 4)} AS convertible, {r("rd", 4)} AS reducible, {r("greatest(0, i - c - rd)", 4)} AS target,
 {r("coalesce(100 * (i - greatest(0, i - c - rd)) / nullif(i, 0), 0)", 4)} AS improvement_pct FROM g""", digits=4)
def _(s, d):
    e = table(s, d, "events").withColumn("to", F.when(F.col("event_type") == "error", F.col("value") / 2))
    return P.changeover(e, ["user_id"], "value", F.col("event_type") == "view", F.col("event_type") == "click", "to")


@query("safety_stock", f"""
WITH g AS (SELECT l_partkey, CAST(l_shipdate AS DATE) dy, sum(l_quantity) q FROM lineitem GROUP BY 1, 2), t AS (SELECT l_partkey, avg(q) m, coalesce(stddev_samp(q), 0) s FROM g GROUP BY 1),
z AS (SELECT *, 1.6448536269514729 * sqrt(4 * s * s + m * m * 0.25) ss FROM t)
SELECT l_partkey, {r("m")} AS avg_demand, {r("s")} AS sd_demand, 4.0::DOUBLE AS lead_time, 0.5::DOUBLE AS sd_lead, {r("ss")} AS safety_stock, {r("m * 4 + ss")} AS reorder_point,
 {r("sqrt(2 * m * 365 * 50 / 3)")} AS eoq FROM z""")
def _(s, d):
    g = table(s, d, "lineitem").groupBy("l_partkey", F.to_date("l_shipdate").alias("day")).agg(F.sum("l_quantity").alias("q"))
    return P.safety_stock(g, ["l_partkey"], "q", 4.0, 0.5, order_cost=50.0, holding_cost=3.0)
