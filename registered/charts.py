"""Control charts (survey 2.11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from procstats.functions.constants import c4, d2, d3
from procstats.operators import control as S

from .common import r, registry, table

QUERIES, query = registry()
D2, D3 = d2(2), d3(2)


def events(s, d):
    return table(s, d, "events").select("event_id", "event_type", "value", "user_id", F.to_date("ts").alias("day"))


def rules_sql(src: str, key: str, which=(1, 2, 3, 5, 6)) -> str:
    """CTEs that add `violations` to the points of `src` (columns key, stage, point, value, z)."""
    w = f"PARTITION BY {key}, stage ORDER BY point"

    def tr(cond, k):
        return f"sum(CASE WHEN {cond} THEN 1 ELSE 0 END) OVER ({w} ROWS {k - 1} PRECEDING)"

    comp = {
        "c2": (2, 9, f"({tr('z > 0', 9)} = 9 OR {tr('z < 0', 9)} = 9)", "true"),
        "c3": (3, 6, f"({tr('dv > 0', 5)} = 5 OR {tr('dv < 0', 5)} = 5)", "true"),
        "c4": (4, 14, f"{tr('alt', 12)} = 12", "true"),
        "c5u": (5, 3, f"({tr('z IS NOT NULL', 3)} = 3 AND {tr('z > 2', 3)} >= 2)", "z > 2"),
        "c5d": (5, 3, f"({tr('z IS NOT NULL', 3)} = 3 AND {tr('z < -2', 3)} >= 2)", "z < -2"),
        "c6u": (6, 5, f"({tr('z IS NOT NULL', 5)} = 5 AND {tr('z > 1', 5)} >= 4)", "z > 1"),
        "c6d": (6, 5, f"({tr('z IS NOT NULL', 5)} = 5 AND {tr('z < -1', 5)} >= 4)", "z < -1"),
        "c7": (7, 15, f"{tr('abs(z) < 1', 15)} = 15", "true"),
        "c8": (8, 8, f"{tr('abs(z) > 1', 8)} = 8", "true"),
    }
    comp = {c: v for c, v in comp.items() if v[0] in which}
    flags = {1: "abs(z) > 3"}
    for c, (rule, k, _, own) in comp.items():
        hit = f"(max({c}::INT) OVER ({w} ROWS BETWEEN CURRENT ROW AND {k - 1} FOLLOWING) = 1 AND {own})"
        flags[rule] = f"{flags[rule]} OR {hit}" if rule in flags else hit
    lst = ", ".join(f"CASE WHEN {flags[k]} THEN {k} END" for k in sorted(flags))
    return f"""
r1 AS (SELECT *, value - lag(value) OVER ({w}) AS dv FROM {src}),
r2 AS (SELECT *, dv * lag(dv) OVER ({w}) < 0 AS alt FROM r1),
r3 AS (SELECT *, {", ".join(f"{v[2]} AS {c}" for c, v in comp.items())} FROM r2),
r4 AS (SELECT *, list_filter([{lst}], lambda x: x IS NOT NULL) AS violations FROM r3)"""


IMR = f"""p AS (SELECT event_type, row_number() OVER w AS point, 0 AS stage, value, abs(value - lag(value) OVER w) AS mr FROM events
              WINDOW w AS (PARTITION BY event_type ORDER BY event_id)),
s AS (SELECT event_type, avg(value) mu, avg(mr) / {D2} sg FROM p GROUP BY 1),
q AS (SELECT p.*, mu, sg, (value - mu) / sg AS z FROM p JOIN s USING (event_type))"""


@query("individuals_chart", f"""
WITH {IMR}, {rules_sql("q", "event_type")}
SELECT event_type, point, point::VARCHAR AS label, 1::BIGINT AS n, stage, {r("value")} AS value, {r("mu")} AS cl, {r("sg")} AS sigma,
       {r("mu + 3 * sg")} AS ucl, {r("mu - 3 * sg")} AS lcl, violations, 'individuals' AS panel FROM r4
UNION ALL
SELECT event_type, point, point::VARCHAR, 2, stage, {r("mr")}, {r(f"{D2} * sg")}, {r(f"{D3} * sg")}, {r(f"({D2} + 3 * {D3}) * sg")},
       {r(f"greatest(0, ({D2} - 3 * {D3}) * sg)")}, CASE WHEN abs(mr - {D2} * sg) / ({D3} * sg) > 3 THEN [1] ELSE [] END, 'moving_range' FROM q""")
def _(s, d):
    return S.individuals_chart(events(s, d), "value", ["event_id"], ["event_type"])


@query("run_rules_all", f"""
WITH {IMR}, {rules_sql("q", "event_type", (1, 2, 3, 4, 5, 6, 7, 8))}
SELECT event_type, point, violations FROM r4""")
def _(s, d):
    c = S.individuals_chart(events(s, d), "value", ["event_id"], ["event_type"], rules=range(1, 9))
    return c.where("panel = 'individuals'").select("event_type", "point", "violations")


@query("individuals_chart_staged", f"""
WITH p AS (SELECT event_type, row_number() OVER w AS point, ((row_number() OVER w > 200)::INT + (row_number() OVER w > 900)::INT) AS stage, value FROM events
           WINDOW w AS (PARTITION BY event_type ORDER BY event_id)),
m AS (SELECT *, abs(value - lag(value) OVER (PARTITION BY event_type, stage ORDER BY point)) AS mr FROM p),
s AS (SELECT event_type, stage, avg(value) mu, median(mr) / 0.954 sg FROM m GROUP BY 1, 2),
q AS (SELECT p.*, mu, sg, (value - mu) / sg AS z FROM p JOIN s USING (event_type, stage)), {rules_sql("q", "event_type")}
SELECT event_type, point, stage, {r("value")} AS value, {r("mu")} AS cl, {r("sg")} AS sigma, violations FROM r4""")
def _(s, d):
    c = S.individuals_chart(events(s, d), "value", ["event_id"], ["event_type"], stages=[200, 900], method="medianmr")
    return c.where("panel = 'individuals'").select("event_type", "point", "stage", "value", "cl", "sigma", "violations")


@query("individuals_chart_mssd")
def _(s, d):
    return S.individuals_chart(events(s, d), "value", ["event_id"], ["event_type"], method="mssd", mr_length=3)


def xbar_sql(size, panel, est, cl, sd):
    return f"""
WITH n AS (SELECT event_type, value, floor((row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) / {size})::BIGINT + 1 AS point FROM events),
g AS (SELECT event_type, point, 0 AS stage, count(*) n, avg(value) AS value, max(value) - min(value) rg, coalesce(stddev_samp(value), 0) sd FROM n GROUP BY 1, 2),
s AS (SELECT event_type, sum(value * n) / sum(n) mu, {est} sg FROM g GROUP BY 1),
q AS (SELECT g.*, mu, sg, (value - mu) / (sg / sqrt(n)) AS z FROM g JOIN s USING (event_type)), {rules_sql("q", "event_type")}
SELECT event_type, point, point::VARCHAR AS label, n, stage, {r("value")} AS value, {r("mu")} AS cl, {r("sg / sqrt(n)")} AS sigma,
       {r("mu + 3 * sg / sqrt(n)")} AS ucl, {r("mu - 3 * sg / sqrt(n)")} AS lcl, violations, 'xbar' AS panel FROM r4
UNION ALL
SELECT event_type, point, point::VARCHAR, n, stage, {r("rg" if panel == "range" else "sd")}, {r(cl + " * sg")}, {r(sd + " * sg")}, {r(f"({cl} + 3 * {sd}) * sg")},
       {r(f"greatest(0, ({cl} - 3 * {sd}) * sg)")},
       CASE WHEN abs({"rg" if panel == "range" else "sd"} - {cl} * sg) > 3 * {sd} * sg THEN [1] ELSE [] END, '{panel}' FROM q"""


def lookup(fn, size):
    return "(CASE n " + " ".join(f"WHEN {k} THEN {fn(k)}" for k in range(2, size + 1)) + " END)"


def uneven(num, den):
    return f"CASE WHEN min(n) = max(n) THEN {num} ELSE {den} END"


@query("xbar_r_chart", xbar_sql(
    5, "range", uneven(f"avg(rg) / {d2(5)}", f"avg(CASE WHEN n > 1 THEN rg / {lookup(d2, 5)} END)"), lookup(d2, 5), lookup(d3, 5)))
def _(s, d):
    return S.subgroup_chart(events(s, d), "value", ["event_id"], ["event_type"], size=5)


def s_spread(n):
    return (1 - c4(n) ** 2) ** 0.5


@query("xbar_s_chart", xbar_sql(
    10, "sd", uneven(f"avg(sd) / {c4(10)}", f"sum(CASE WHEN n > 1 THEN {lookup(c4, 10)} * sd END) / sum(CASE WHEN n > 1 THEN {lookup(c4, 10)} * {lookup(c4, 10)} END)"),
    lookup(c4, 10), lookup(s_spread, 10)))
def _(s, d):
    return S.subgroup_chart(events(s, d), "value", ["event_id"], ["event_type"], size=10)


@query("subgroups_by_label", f"""
WITH g AS (SELECT event_type, 'u' || (user_id % 7) AS label, count(*) n, avg(value) m, coalesce(stddev_samp(value), 0) sd, min(value) lo, max(value) hi,
  min(event_id) f FROM events GROUP BY 1, 2)
SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY f) AS point, label, n, {r("m")} AS mean, {r("sd")} AS sd, lo AS min, hi AS max,
  {r("hi - lo")} AS range FROM g""")
def _(s, d):
    e = events(s, d).withColumn("lot", F.concat(F.lit("u"), F.col("user_id") % 7))
    return S.subgroups(e, "value", ["event_id"], ["event_type"], label="lot")


@query("sigma_within", f"""
WITH n AS (SELECT event_type, value, floor((row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) / 4) AS k FROM events),
g AS (SELECT event_type, k, count(*) n, max(value) - min(value) rg, coalesce(stddev_samp(value), 0) sd FROM n GROUP BY 1, 2)
SELECT event_type, {r(uneven(f"avg(rg) / {d2(4)}", f"avg(CASE WHEN n > 1 THEN rg / {lookup(d2, 4)} END)"))} AS rbar,
 {r(uneven(f"avg(sd) / {c4(4)}", f"sum(CASE WHEN n > 1 THEN {lookup(c4, 4)} * sd END) / sum(CASE WHEN n > 1 THEN {lookup(c4, 4)} * {lookup(c4, 4)} END)"))} AS sbar
FROM g GROUP BY 1""")
def _(s, d):
    g = S.subgroups(events(s, d), "value", ["event_id"], ["event_type"], size=4)
    a = S.sigma_within(g, "rbar", ["event_type"]).withColumnRenamed("sigma", "rbar")
    return a.join(S.sigma_within(g, "sbar", ["event_type"]).withColumnRenamed("sigma", "sbar"), "event_type")


@query("sigma_within_pooled")
def _(s, d):
    return S.sigma_within(S.subgroups(events(s, d), "value", ["event_id"], ["event_type"], size=4), "pooled", ["event_type"])


def daily(s, d):
    return (events(s, d).groupBy("day").agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.count(F.lit(1)).alias("total"),
                                            F.sum("value").alias("exposure")))


DAILY = """d AS (SELECT CAST(ts AS DATE) AS day, count(*) FILTER (event_type = 'error')::DOUBLE c, count(*)::DOUBLE n FROM events GROUP BY 1),
t AS (SELECT row_number() OVER (ORDER BY day) AS point, 0 AS stage, 0 AS k, c, n, sum(c) OVER () / sum(n) OVER () p, avg(c) OVER () cb FROM d)"""


def attribute_sql(extra, value, cl, sd, ucl, n="n"):
    return f"""
WITH {DAILY}{extra}, q AS (SELECT *, {value} AS value, {cl} AS cl, {sd} AS sg, ({value} - {cl}) / ({sd}) AS z FROM {"l" if extra else "t"}),
{rules_sql("q", "k")}
SELECT point, point::VARCHAR AS label, {n} AS n, {r("value")} AS value, {r("cl")} AS cl, {r("sg")} AS sigma, {r(ucl)} AS ucl,
       {r("greatest(0, cl - 3 * sg)")} AS lcl, violations FROM r4"""


LANEY_P = """, zz AS (SELECT *, (c / n - p) / sqrt(p * (1 - p) / n) zv FROM t),
lz AS (SELECT avg(abs(zv - pz)) / 1.128 szz FROM (SELECT zv, lag(zv) OVER (ORDER BY point) pz FROM zz)), l AS (SELECT * FROM t, lz)"""
LANEY_U = LANEY_P.replace("sqrt(p * (1 - p) / n)", "sqrt(p / n)")

for kind, sql in {
    "p": attribute_sql("", "c / n", "p", "sqrt(p * (1 - p) / n)", "least(1, cl + 3 * sg)"),
    "np": attribute_sql("", "c", "p * n", "sqrt(p * (1 - p) / n) * n", "least(n, cl + 3 * sg)"),
    "c": attribute_sql("", "c", "cb", "sqrt(cb)", "cl + 3 * sg", "1.0::DOUBLE"),
    "u": attribute_sql("", "c / n", "p", "sqrt(p / n)", "cl + 3 * sg"),
    "p-laney": attribute_sql(LANEY_P, "c / n", "p", "sqrt(p * (1 - p) / n) * szz", "least(1, cl + 3 * sg)"),
    "u-laney": attribute_sql(LANEY_U, "c / n", "p", "sqrt(p / n) * szz", "cl + 3 * sg"),
}.items():
    @query(f"attribute_chart_{kind.replace('-', '_')}", sql)
    def _(s, d, kind=kind):
        return S.attribute_chart(daily(s, d), "errors", "total", ["day"], kind=kind)


@query("overdispersion_test", f"""
WITH {DAILY}
SELECT {r("sum(pow(c - p * n, 2) / (n * p * (1 - p)))")} AS chisq, (count(*) - 1)::DOUBLE AS df,
       {r("sum(pow(c - p * n, 2) / (n * p * (1 - p))) / (count(*) - 1)")} AS ratio,
       CASE WHEN sum(pow(c - p * n, 2) / (n * p * (1 - p))) / (count(*) - 1) > 1.5 THEN 'overdispersed'
            WHEN sum(pow(c - p * n, 2) / (n * p * (1 - p))) / (count(*) - 1) < 0.5 THEN 'underdispersed' ELSE 'consistent' END AS verdict FROM t""")
def _(s, d):
    return S.overdispersion_test(daily(s, d), "errors", "total").drop("p_value")


POINTS = """p AS (SELECT event_type, row_number() OVER w AS point, value, abs(value - lag(value) OVER w) AS mr FROM events
              WINDOW w AS (PARTITION BY event_type ORDER BY event_id)),
s AS (SELECT event_type, avg(value) mu, avg(mr) / 1.128 sg FROM p GROUP BY 1)"""


@query("ewma_chart", f"""
WITH RECURSIVE {POINTS}, b AS (SELECT p.*, mu, sg FROM p JOIN s USING (event_type)),
e AS (SELECT event_type, point, value, mu, sg, 0.2 * value + 0.8 * mu AS z FROM b WHERE point = 1
      UNION ALL SELECT b.event_type, b.point, b.value, b.mu, b.sg, 0.2 * b.value + 0.8 * e.z FROM b JOIN e ON b.event_type = e.event_type AND b.point = e.point + 1),
f AS (SELECT *, sg * sqrt(0.2 / 1.8 * (1 - pow(0.8, 2.0 * point))) sd FROM e)
SELECT event_type, point, point::VARCHAR AS label, 1::BIGINT AS n, {r("value")} AS raw, {r("z")} AS value, {r("mu")} AS cl, {r("sd")} AS sigma,
       {r("mu + 3 * sd")} AS ucl, {r("mu - 3 * sd")} AS lcl, CASE WHEN abs(z - mu) > 3 * sd THEN [1] ELSE [] END AS violations FROM f""")
def _(s, d):
    return S.ewma_chart(events(s, d), "value", ["event_id"], ["event_type"])


@query("cusum_chart", f"""
WITH {POINTS}, z AS (SELECT p.*, (value - mu) / sg AS z FROM p JOIN s USING (event_type)),
t AS (SELECT *, sum(z - 0.5) OVER w tu, sum(-z - 0.5) OVER w td FROM z WINDOW w AS (PARTITION BY event_type ORDER BY point)),
c AS (SELECT *, tu - least(0, min(tu) OVER w) cu, td - least(0, min(td) OVER w) cd FROM t WINDOW w AS (PARTITION BY event_type ORDER BY point))
SELECT event_type, point, point::VARCHAR AS label, 1::BIGINT AS n, {r("cu")} AS value, {r("-cd")} AS value_low, 4.0::DOUBLE AS ucl, -4.0::DOUBLE AS lcl,
       CASE WHEN cu > 4 OR cd > 4 THEN [1] ELSE [] END AS violations FROM c""")
def _(s, d):
    return S.cusum_chart(events(s, d), "value", ["event_id"], ["event_type"])


@query("moving_average_chart", f"""
WITH {POINTS}, m AS (SELECT p.*, mu, sg, avg(value) OVER w ma, count(*) OVER w k FROM p JOIN s USING (event_type)
  WINDOW w AS (PARTITION BY event_type ORDER BY point ROWS 2 PRECEDING))
SELECT event_type, point, point::VARCHAR AS label, k AS n, {r("ma")} AS value, {r("mu")} AS cl, {r("sg / sqrt(k)")} AS sigma,
       {r("mu + 3 * sg / sqrt(k)")} AS ucl, {r("mu - 3 * sg / sqrt(k)")} AS lcl, CASE WHEN abs(ma - mu) > 3 * sg / sqrt(k) THEN [1] ELSE [] END AS violations FROM m""")
def _(s, d):
    return S.moving_average_chart(events(s, d), "value", ["event_id"], ["event_type"])


@query("zmr_chart", f"""
WITH {POINTS}, f AS (SELECT event_type, min(event_id) seen FROM events GROUP BY 1),
z AS (SELECT event_type, 0 AS k, 0 AS stage, row_number() OVER (ORDER BY seen, point) AS point, (value - mu) / sg AS value FROM p JOIN s USING (event_type) JOIN f USING (event_type)),
q AS (SELECT *, value AS z FROM z), {rules_sql("q", "k")}
SELECT point, event_type AS label, {r("value")} AS value, violations FROM r4""")
def _(s, d):
    c = S.zmr_chart(events(s, d), "value", "event_type", ["event_id"])
    return c.where("panel = 'individuals'").select("point", "label", "value", "violations")


@query("violation_summary", f"""
WITH {IMR}, {rules_sql("q", "event_type")}, u AS (SELECT event_type, point, unnest(violations) AS rule FROM r4)
SELECT event_type, rule, count(*) AS points, min(point) AS first_point, max(point) AS last_point FROM u GROUP BY 1, 2""")
def _(s, d):
    c = S.individuals_chart(events(s, d), "value", ["event_id"], ["event_type"])
    return S.violation_summary(c.where("panel = 'individuals'"), ["event_type"])


@query("violation_points", f"""
WITH {IMR}, {rules_sql("q", "event_type")}
SELECT event_type, unnest(violations) AS rule, point, point::VARCHAR AS label FROM r4""")
def _(s, d):
    c = S.individuals_chart(events(s, d), "value", ["event_id"], ["event_type"])
    return S.violation_points(c.where("panel = 'individuals'"), ["event_type"])
