"""Descriptives, density, outliers, normality, fits (survey 2.5, 2.6)."""

from __future__ import annotations

from procstats.operators import describe as D
from procstats.operators import fitting as N

from .common import phi, q6, r, registry, table

QUERIES, query = registry()


def events(s, d):
    return table(s, d, "events").select("event_id", "event_type", "value")


def items(s, d):
    return table(s, d, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice")


TRIM = """(list_sum(list_sort(list(value))[floor(count(*) * 0.05)::BIGINT + 1 : count(*) - floor(count(*) * 0.05)::BIGINT])
 / (count(*) - 2 * floor(count(*) * 0.05)))"""


@query("describe", f"""
WITH m AS (SELECT event_type, 1.4826 * median(abs(value - med)) AS mad FROM
           (SELECT *, median(value) OVER (PARTITION BY event_type) AS med FROM events) GROUP BY 1)
SELECT event_type, count(value) AS n, count(*) - count(value) AS missing, {r("avg(value)")} AS mean, {r("stddev_samp(value)")} AS sd,
       {r("stddev_samp(value) / sqrt(count(value))")} AS se, {r("var_samp(value)", 4)} AS variance,
       {r("100 * stddev_samp(value) / avg(value)")} AS cv, min(value) AS min, max(value) AS max, {r("max(value) - min(value)")} AS range,
       {r("skewness(value)")} AS skewness, {r("kurtosis(value)")} AS kurtosis, {r("sum(value)", 4)} AS sum, {r("sum(value * value)", 2)} AS sumsq,
       {r(q6("value", 0.25))} AS q1, {r("median(value)")} AS median, {r(q6("value", 0.75))} AS q3, {r(TRIM)} AS trimmed_mean,
       {r(q6("value", 0.75) + " - " + q6("value", 0.25))} AS iqr, {r("max(mad)")} AS mad
FROM events JOIN m USING (event_type) GROUP BY event_type""", variance=4, sum=4, sumsq=2)
def _(s, d):
    return D.describe(events(s, d), "value", ["event_type"], intervals=False)


@query("describe_intervals")
def _(s, d):
    return D.describe(events(s, d), "value", ["event_type"])


@query("skewness_kurtosis", f"""
SELECT l_returnflag, {r("skewness(l_extendedprice)")} AS skew, {r("kurtosis(l_extendedprice)")} AS kurt FROM lineitem GROUP BY 1""")
def _(s, d):
    return D.shape(items(s, d), "l_extendedprice", ["l_returnflag"])


@query("trimmed_mean", f"""
SELECT event_type, count(*) AS n, {r(TRIM)} AS trimmed_mean FROM events GROUP BY 1""")
def _(s, d):
    return D.trimmed_mean(events(s, d), "value", ["event_type"])


@query("median_absolute_deviation", f"""
SELECT l_returnflag, {r("1.4826 * median(abs(l_extendedprice - med))")} AS mad FROM
(SELECT *, median(l_extendedprice) OVER (PARTITION BY l_returnflag) AS med FROM lineitem) GROUP BY 1""")
def _(s, d):
    return D.mad(items(s, d), "l_extendedprice", ["l_returnflag"])


@query("other_means", f"""
SELECT event_type, {r("exp(avg(ln(value)))")} AS geometric_mean, {r("count(*) / sum(1 / value)")} AS harmonic_mean,
       {r("100 * stddev_samp(value) / avg(value)")} AS cv, {r("stddev_samp(value) / sqrt(count(*))")} AS se,
       {r("max(value) - min(value)")} AS range FROM events GROUP BY 1""")
def _(s, d):
    return D.means(events(s, d), "value", ["event_type"])


@query("mode", """
WITH f AS (SELECT event_type, value, count(*) c, min(event_id) first_id FROM events GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY c DESC, first_id) rn FROM f)
SELECT event_type, CASE WHEN c > 1 THEN round(value, 6) + 0.0 END AS mode, c AS mode_count FROM k WHERE rn = 1""")
def _(s, d):
    return D.mode(events(s, d), "value", ["event_type"], ["event_id"])


@query("median_interval")
def _(s, d):
    return D.median_interval(events(s, d), "value", ["event_type"])


@query("tolerance_interval")
def _(s, d):
    return D.tolerance_interval(items(s, d), "l_quantity", ["l_returnflag"])


@query("tolerance_interval_inputs", f"""
SELECT l_returnflag, count(*) AS n, {r("avg(l_quantity)")} AS mean, {r("stddev_samp(l_quantity)")} AS sd,
       min(l_quantity) AS np_lower, max(l_quantity) AS np_upper FROM lineitem GROUP BY 1""")
def _(s, d):
    return D.tolerance_interval(items(s, d), "l_quantity", ["l_returnflag"]).select(
        "l_returnflag", "n", "mean", "sd", "np_lower", "np_upper")


@query("bootstrap_interval")
def _(s, d):
    return D.bootstrap_interval(events(s, d), "value", ["event_id"], ["event_type"])


@query("histogram", f"""
WITH g AS (SELECT event_type, count(*) n, min(value) lo, max(value) hi FROM events GROUP BY 1),
k AS (SELECT *, greatest(5, least(30, ceil(sqrt(n)))) k FROM g),
w AS (SELECT *, (hi - lo) / k w0, pow(10, floor(log10((hi - lo) / k))) mag FROM k),
v AS (SELECT *, CASE WHEN mag >= w0 THEN mag WHEN 2 * mag >= w0 THEN 2 * mag WHEN 2.5 * mag >= w0 THEN 2.5 * mag
                     WHEN 5 * mag >= w0 THEN 5 * mag ELSE 10 * mag END w FROM w),
u AS (SELECT event_type, n, w, floor(lo / w) * w lo, round((ceil(hi / w) * w - floor(lo / w) * w) / w)::BIGINT k FROM v),
c AS (SELECT e.event_type, greatest(0, least(k - 1, floor((value - lo) / w)))::BIGINT i, count(*) c
      FROM events e JOIN u USING (event_type) GROUP BY 1, 2),
b AS (SELECT *, unnest(range(k)) AS bin FROM u)
SELECT b.event_type, bin, {r("lo + bin * w")} AS low, {r("lo + (bin + 1) * w")} AS high, {r("lo + (bin + 0.5) * w")} AS mid,
       coalesce(c, 0) AS count, {r("coalesce(c, 0) / (n * w)")} AS density, {r("100.0 * coalesce(c, 0) / n")} AS pct
FROM b LEFT JOIN c ON b.event_type = c.event_type AND bin = i""")
def _(s, d):
    return D.histogram(events(s, d), "value", ["event_type"])


@query("kernel_density", f"""
WITH g AS (SELECT event_type, count(*) n, min(value) lo, max(value) hi, stddev_samp(value) s,
                  {q6("value", 0.75)} - {q6("value", 0.25)} iq FROM events GROUP BY 1),
h AS (SELECT *, 0.9 * least(s, iq / 1.349) * pow(n, -0.2) h FROM g),
p AS (SELECT event_type, n, h, unnest(range(200)) AS point, lo - 3 * h a, hi + 3 * h b FROM h),
x AS (SELECT *, a + (b - a) * point / 199 AS x FROM p)
SELECT event_type, point::INTEGER AS point, {r("x")} AS x,
       {r("sum(exp(-0.5 * pow((x - value) / h, 2))) / (n * h * sqrt(2 * pi()))", 9)} AS density
FROM x JOIN events USING (event_type) GROUP BY event_type, point, x, n, h""", density=9)
def _(s, d):
    return D.kernel_density(events(s, d), "value", ["event_type"])


@query("ecdf", f"""
SELECT event_type, value AS x, row_number() OVER w AS i, {r("row_number() OVER w / count(*) OVER (PARTITION BY event_type)")} AS p
FROM events WINDOW w AS (PARTITION BY event_type ORDER BY value)""")
def _(s, d):
    return D.ecdf(events(s, d), "value", ["event_type"])


@query("box_summary", f"""
WITH q AS (SELECT event_type, {q6("value", 0.25)} q1, median(value) md, {q6("value", 0.75)} q3 FROM events GROUP BY 1),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) lf, q3 + 1.5 * (q3 - q1) uf FROM q)
SELECT event_type, count(*) AS n, {r("q1")} AS q1, {r("md")} AS median, {r("q3")} AS q3, {r("lf")} AS lower_fence, {r("uf")} AS upper_fence,
       min(value) FILTER (value BETWEEN lf AND uf) AS whisker_low, max(value) FILTER (value BETWEEN lf AND uf) AS whisker_high,
       count(*) FILTER (value NOT BETWEEN lf AND uf) AS outliers, {r("avg(value)")} AS mean
FROM events JOIN f USING (event_type) GROUP BY event_type, q1, md, q3, lf, uf""")
def _(s, d):
    return D.box_summary(events(s, d), "value", ["event_type"])


@query("interval_data", f"""
SELECT event_type, count(value) AS n, {r("avg(value)")} AS mean, {r("stddev_samp(value)")} AS sd FROM events GROUP BY 1""")
def _(s, d):
    return D.interval_data(events(s, d), "value", "event_type").select("event_type", "n", "mean", "sd")


@query("grubbs", f"""
WITH s AS (SELECT event_type, count(*) n, avg(value) m, stddev_samp(value) sd FROM events GROUP BY 1)
SELECT event_type, n, {r("max(abs(value - m) / sd)")} AS g, arg_max(value, abs(value - m)) AS value
FROM events JOIN s USING (event_type) GROUP BY event_type, n""")
def _(s, d):
    return N.grubbs(events(s, d), "value", ["event_type"]).select("event_type", "n", "g", "value")


@query("iqr_outliers", f"""
WITH q AS (SELECT event_type, {q6("value", 0.25)} q1, {q6("value", 0.75)} q3 FROM events GROUP BY 1)
SELECT event_id, event_type, value, {r("q1 - 1.5 * (q3 - q1)")} AS lower, {r("q3 + 1.5 * (q3 - q1)")} AS upper
FROM events JOIN q USING (event_type) WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)""")
def _(s, d):
    return N.iqr_outliers(events(s, d), "value", ["event_type"])


@query("anderson_darling", f"""
WITH s AS (SELECT event_type, count(*) n, avg(value) m, stddev_samp(value) sd FROM events GROUP BY 1),
z AS (SELECT event_type, n, m, sd, (value - m) / sd AS z, row_number() OVER (PARTITION BY event_type ORDER BY value) i FROM events JOIN s USING (event_type)),
p AS (SELECT *, least(1 - 1e-14, greatest(1e-14, {phi("z")})) AS p FROM z),
a AS (SELECT event_type, n, m, sd, -n - sum((2 * i - 1) * ln(p) + (2 * (n - i) + 1) * ln(1 - p)) / n AS a2 FROM p GROUP BY event_type, n, m, sd)
SELECT event_type, n, {r("m")} AS mean, {r("sd")} AS sd, {r("a2", 4)} AS a2, {r("a2 * (1 + 0.75 / n + 2.25 / (n * n))", 4)} AS a2_adjusted FROM a""",
       a2=4, a2_adjusted=4)
def _(s, d):
    return N.anderson_darling(events(s, d), "value", ["event_type"]).drop("p_value")


@query("shapiro_wilk")
def _(s, d):
    return N.shapiro_wilk(events(s, d), "value", ["event_type"])


@query("ryan_joiner")
def _(s, d):
    return N.ryan_joiner(events(s, d), "value", ["event_type"])


@query("probability_plot")
def _(s, d):
    return N.probability_plot(events(s, d), "value", ["event_type"], "weibull")


@query("probability_plot_line")
def _(s, d):
    return N.probability_plot_line(events(s, d), "value", ["event_type"])


@query("identify_distribution")
def _(s, d):
    return N.identify_distribution(events(s, d), "value", ["event_type"])


@query("fit_closed_form", f"""
SELECT event_type, count(*) AS n, {r("avg(ln(value))")} AS p1, {r("stddev_samp(ln(value))")} AS p2, 'lognormal' AS family FROM events GROUP BY 1
UNION ALL SELECT event_type, count(*), {r("avg(value)")}, {r("stddev_samp(value) * sqrt(3) / pi()")}, 'logistic' FROM events GROUP BY 1
UNION ALL SELECT event_type, count(*), {r("avg(value)")}, NULL, 'exponential' FROM events GROUP BY 1
UNION ALL SELECT event_type, count(*), {r("avg(value)")}, {r("stddev_samp(value)")}, 'normal' FROM events GROUP BY 1""")
def _(s, d):
    out = None
    for family in ("lognormal", "logistic", "exponential", "normal"):
        one = N.fit(events(s, d), "value", family, ["event_type"])
        out = one if out is None else out.unionByName(one)
    return out


@query("box_cox_lambda", """
WITH g AS (SELECT event_type, avg(ln(value)) lm FROM events GROUP BY 1),
u AS (SELECT event_type, exp(ln(value) - lm) u FROM events JOIN g USING (event_type)),
c AS (SELECT event_type, l, var_pop(CASE WHEN l = 0 THEN ln(u) ELSE (pow(u, l) - 1) / l END) v
      FROM u, (SELECT (i - 500) / 100 AS l FROM range(1001) t(i)) GROUP BY 1, 2),
b AS (SELECT event_type, arg_min(l, v) l0 FROM c GROUP BY 1),
f AS (SELECT event_type, l, var_pop(CASE WHEN l = 0 THEN ln(u) ELSE (pow(u, l) - 1) / l END) v
      FROM u JOIN (SELECT event_type, round(l0 + (i - 100) / 10000, 6) AS l FROM b, range(201) t(i)) USING (event_type) GROUP BY 1, 2)
SELECT event_type, round(arg_min(l, v), 6) + 0.0 AS lambda FROM f GROUP BY 1""")
def _(s, d):
    return N.box_cox_lambda(events(s, d), "value", ["event_type"])


@query("box_cox_apply", f"""
SELECT event_id, {r("(pow(value, 0.25) - 1) / 0.25")} AS y, {r("value")} AS back, {r("ln(value)")} AS y0 FROM events""")
def _(s, d):
    from pyspark.sql import functions as F
    y = N.box_cox(F.col("value"), 0.25)
    return events(s, d).select("event_id", y.alias("y"), N.box_cox_inverse(y, 0.25).alias("back"), N.box_cox(F.col("value"), 0.0).alias("y0"))


@query("yeo_johnson_lambda", """
WITH x AS (SELECT event_type, value - 20 AS x FROM events),
c AS (SELECT event_type, l, count(*) n, sum(sign(x) * ln(1 + abs(x))) j,
        var_pop(CASE WHEN x >= 0 THEN CASE WHEN abs(l) < 1e-9 THEN ln(1 + x) ELSE (pow(x + 1, l) - 1) / l END
                     ELSE CASE WHEN abs(l - 2) < 1e-9 THEN -ln(1 - x) ELSE -(pow(1 - x, 2 - l) - 1) / (2 - l) END END) v
      FROM x, (SELECT round((i - 250) / 50, 6) AS l FROM range(501) t(i)) GROUP BY 1, 2)
SELECT event_type, arg_max(l, -0.5 * n * ln(v) + (l - 1) * j) + 0.0 AS lambda FROM c GROUP BY 1""")
def _(s, d):
    from pyspark.sql import functions as F
    df = events(s, d).select("event_type", (F.col("value") - 20).alias("x"))
    return N.yeo_johnson_lambda(df, "x", ["event_type"])


@query("yeo_johnson_apply", f"""
SELECT event_id, {r("CASE WHEN value >= 50 THEN (pow(value - 49, 0.5) - 1) / 0.5 ELSE -(pow(51 - value, 1.5) - 1) / 1.5 END")} AS y FROM events""")
def _(s, d):
    from pyspark.sql import functions as F
    return events(s, d).select("event_id", N.yeo_johnson(F.col("value") - 50, 0.5).alias("y"))


@query("johnson")
def _(s, d):
    return N.johnson(events(s, d), "value", ["event_type"])


@query("johnson_round_trip", f"""SELECT event_id, event_type, {r("value")} AS back FROM events""")
def _(s, d):
    e = events(s, d).select("event_id", "event_type", "value")
    fitted = N.persist(N.johnson(e, "value", ["event_type"]))
    z = N.johnson_transform(e, "value", fitted, ["event_type"])
    return N.johnson_inverse(z, "z", fitted, ["event_type"], "back").select("event_id", "event_type", "back")


@query("johnson_percentiles")
def _(s, d):
    fitted = N.persist(N.johnson(events(s, d), "value", ["event_type"]))
    return N.johnson_percentiles(fitted, [0.00135, 0.5, 0.99865], ["event_type"])


