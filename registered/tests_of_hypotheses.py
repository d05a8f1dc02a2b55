"""Hypothesis tests (survey 2.7): statistics against SQL; p-values are tested in tests/."""

from __future__ import annotations

from pyspark.sql import functions as F

from procstats.operators import hypothesis as H

from .common import q6, r, registry, table

QUERIES, query = registry()


def items(s, d):
    return table(s, d, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount", "l_tax")


def events(s, d):
    return table(s, d, "events").select("event_id", "event_type", "user_id", "value", F.to_date("ts").alias("day"))


def orders(s, d):
    return table(s, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice")


@query("t_test_one", f"""
SELECT event_type, count(*) AS n, {r("avg(value)")} AS mean, {r("stddev_samp(value)")} AS sd, {r("stddev_samp(value) / sqrt(count(*))")} AS se,
       (count(*) - 1)::DOUBLE AS df, {r("(avg(value) - 50) / (stddev_samp(value) / sqrt(count(*)))")} AS t,
       {r("(avg(value) - 50) / stddev_samp(value)")} AS effect FROM events GROUP BY 1""")
def _(s, d):
    return H.t_test(events(s, d), "value", 50.0, ["event_type"]).drop("p_value", "ci_low", "ci_high")


@query("z_test_one", f"""
SELECT event_type, count(*) AS n, {r("avg(value)")} AS mean, {r("50 / sqrt(count(*))")} AS se, {r("(avg(value) - 50) / (50 / sqrt(count(*)))")} AS z,
       {r("avg(value) - 1.9599639845400545 * 50 / sqrt(count(*))")} AS ci_low, {r("avg(value) + 1.9599639845400545 * 50 / sqrt(count(*))")} AS ci_high
FROM events GROUP BY 1""")
def _(s, d):
    return H.z_test(events(s, d), "value", 50.0, 50.0, ["event_type"]).drop("p_value")


TWO = """WITH g AS (SELECT l_linestatus, count(*) FILTER (l_returnflag = 'A') n1, avg(l_extendedprice) FILTER (l_returnflag = 'A') m1,
 stddev_samp(l_extendedprice) FILTER (l_returnflag = 'A') s1, count(*) FILTER (l_returnflag = 'R') n2,
 avg(l_extendedprice) FILTER (l_returnflag = 'R') m2, stddev_samp(l_extendedprice) FILTER (l_returnflag = 'R') s2 FROM lineitem GROUP BY 1),
w AS (SELECT *, sqrt(s1 * s1 / n1 + s2 * s2 / n2) se, pow(s1 * s1 / n1 + s2 * s2 / n2, 2) /
      (pow(s1 * s1 / n1, 2) / (n1 - 1) + pow(s2 * s2 / n2, 2) / (n2 - 1)) df,
      sqrt(((n1 - 1) * s1 * s1 + (n2 - 1) * s2 * s2) / (n1 + n2 - 2)) sp FROM g)"""


@query("t_test_two", f"""{TWO}
SELECT l_linestatus, n1, n2, {r("m1", 4)} AS mean1, {r("m2", 4)} AS mean2, {r("s1", 4)} AS sd1, {r("s2", 4)} AS sd2, {r("m1 - m2", 4)} AS diff,
       {r("se", 4)} AS se, {r("df", 4)} AS df, {r("(m1 - m2) / sp", 4)} AS cohen_d, {r("(m1 - m2) / se", 4)} AS t FROM w""", digits=4)
def _(s, d):
    return H.t_test_two(items(s, d), "l_extendedprice", "l_returnflag", ["A", "R"], ["l_linestatus"]).drop("p_value", "ci_low", "ci_high")


@query("t_test_two_pooled", f"""{TWO}
SELECT l_linestatus, n1, n2, {r("sp * sqrt(1.0 / n1 + 1.0 / n2)", 4)} AS se, (n1 + n2 - 2)::DOUBLE AS df,
       {r("(m1 - m2) / (sp * sqrt(1.0 / n1 + 1.0 / n2))", 4)} AS t FROM w""", digits=4)
def _(s, d):
    return H.t_test_two(items(s, d), "l_extendedprice", "l_returnflag", ["A", "R"], ["l_linestatus"], pooled=True).select(
        "l_linestatus", "n1", "n2", "se", "df", "t")


@query("equivalence_test", f"""{TWO}
SELECT l_linestatus, {r("m1 - m2", 4)} AS diff, {r("se", 4)} AS se, {r("df", 4)} AS df, {r("(m1 - m2 + 500) / se", 4)} AS t_lower,
       {r("(m1 - m2 - 500) / se", 4)} AS t_upper FROM w""", digits=4)
def _(s, d):
    return H.equivalence_test(items(s, d), "l_extendedprice", -500.0, 500.0, "l_returnflag", ["A", "R"], ["l_linestatus"]).select(
        "l_linestatus", "diff", "se", "df", "t_lower", "t_upper")


def daily_pairs(s, d):
    e = events(s, d)
    return e.groupBy("day").agg(F.avg(F.when(F.col("event_type") == "click", F.col("value"))).alias("click"),
                                F.avg(F.when(F.col("event_type") == "view", F.col("value"))).alias("view"))


@query("t_test_paired", f"""
WITH p AS (SELECT CAST(ts AS DATE) AS day, avg(value) FILTER (event_type = 'click') c, avg(value) FILTER (event_type = 'view') v FROM events GROUP BY 1)
SELECT count(c - v) AS n, {r("avg(c - v)")} AS mean, {r("stddev_samp(c - v)")} AS sd, {r("stddev_samp(c - v) / sqrt(count(c - v))")} AS se,
       (count(c - v) - 1)::DOUBLE AS df, {r("avg(c - v) / (stddev_samp(c - v) / sqrt(count(c - v)))")} AS t,
       {r("avg(c - v) / stddev_samp(c - v)")} AS effect, {r("avg(c)")} AS mean1, {r("avg(v)")} AS mean2 FROM p""")
def _(s, d):
    return H.t_test_paired(daily_pairs(s, d), "click", "view").drop("p_value", "ci_low", "ci_high")


@query("proportion_test", f"""
WITH g AS (SELECT event_type, count(*) FILTER (value > 50)::DOUBLE x, count(*)::DOUBLE n, 1.9599639845400545 z FROM events GROUP BY 1),
p AS (SELECT *, x / n AS p FROM g)
SELECT event_type, x::BIGINT AS x, n::BIGINT AS n, {r("p")} AS p_hat, {r("(p - 0.35) / sqrt(0.35 * 0.65 / n)")} AS z,
       {r("(p + z*z/(2*n) - z * sqrt(p * (1 - p) / n + z*z/(4*n*n))) / (1 + z*z/n)")} AS wilson_low,
       {r("(p + z*z/(2*n) + z * sqrt(p * (1 - p) / n + z*z/(4*n*n))) / (1 + z*z/n)")} AS wilson_high, true AS normal_ok FROM p""")
def _(s, d):
    return H.proportion_test(events(s, d), F.col("value") > 50, ["event_type"], 0.35).drop("p_value", "p_exact", "exact_low", "exact_high")


@query("proportion_test_two", f"""
WITH g AS (SELECT l_linestatus, count(*) FILTER (l_returnflag = 'A' AND l_discount > 0.05)::DOUBLE x1, count(*) FILTER (l_returnflag = 'A')::DOUBLE n1,
  count(*) FILTER (l_returnflag = 'N' AND l_discount > 0.05)::DOUBLE x2, count(*) FILTER (l_returnflag = 'N')::DOUBLE n2 FROM lineitem GROUP BY 1),
p AS (SELECT *, x1 / n1 p1, x2 / n2 p2, (x1 + x2) / (n1 + n2) pp FROM g)
SELECT l_linestatus, x1::BIGINT AS x1, n1::BIGINT AS n1, x2::BIGINT AS x2, n2::BIGINT AS n2, {r("p1")} AS p1, {r("p2")} AS p2, {r("p1 - p2")} AS diff,
       {r("(p1 - p2) / sqrt(pp * (1 - pp) * (1 / n1 + 1 / n2))")} AS z,
       {r("p1 - p2 - 1.9599639845400545 * sqrt(p1 * (1 - p1) / n1 + p2 * (1 - p2) / n2)")} AS ci_low,
       {r("p1 - p2 + 1.9599639845400545 * sqrt(p1 * (1 - p1) / n1 + p2 * (1 - p2) / n2)")} AS ci_high,
       {r("p1 / p2")} AS relative_risk, {r("(x1 / (n1 - x1)) / (x2 / (n2 - x2))")} AS odds_ratio FROM p""")
def _(s, d):
    return H.proportion_test_two(items(s, d), F.col("l_discount") > 0.05, "l_returnflag", ["A", "N"], ["l_linestatus"]).drop("p_value", "p_fisher")


@query("variance_test", f"""
SELECT l_returnflag, count(*) AS n, {r("stddev_samp(l_quantity)")} AS sd, {r("var_samp(l_quantity)")} AS variance, (count(*) - 1)::DOUBLE AS df,
       {r("(count(*) - 1) * var_samp(l_quantity) / 196", 4)} AS chisq FROM lineitem GROUP BY 1""", chisq=4)
def _(s, d):
    return H.variance_test(items(s, d), "l_quantity", 14.0, ["l_returnflag"]).drop("p_value", "ci_sd_low", "ci_sd_high")


LEVENE = """m AS (SELECT *, median({x}) OVER (PARTITION BY {g}) AS md FROM {t}),
z AS (SELECT {g} AS g, abs({x} - md) AS z FROM m),
c AS (SELECT g, count(*) n, avg(z) zb, var_samp(z) * (count(*) - 1) w FROM z GROUP BY 1),
l AS (SELECT sum(n) n, count(*) k, sum(w) sw, sum(n * zb * zb) - sum(n * zb) * sum(n * zb) / sum(n) sb FROM c)"""


@query("variance_test_two", f"""
WITH t0 AS (SELECT * FROM lineitem WHERE l_returnflag IN ('A', 'R')), {LEVENE.format(x="l_extendedprice", g="l_returnflag", t="t0")},
g AS (SELECT count(*) FILTER (l_returnflag = 'A') n1, count(*) FILTER (l_returnflag = 'R') n2,
  avg(l_extendedprice) FILTER (l_returnflag = 'A') m1, avg(l_extendedprice) FILTER (l_returnflag = 'R') m2,
  stddev_samp(l_extendedprice) FILTER (l_returnflag = 'A') s1, stddev_samp(l_extendedprice) FILTER (l_returnflag = 'R') s2 FROM t0)
SELECT n1, n2, {r("m1", 4)} AS mean1, {r("m2", 4)} AS mean2, {r("s1", 4)} AS sd1, {r("s2", 4)} AS sd2, {r("s1 * s1 / (s2 * s2)", 4)} AS f,
       (n1 - 1)::DOUBLE AS df1, (n2 - 1)::DOUBLE AS df2, {r("(n - k) * sb / ((k - 1) * sw)", 4)} AS levene_w FROM g, l""", digits=4)
def _(s, d):
    return H.variance_test_two(items(s, d), "l_extendedprice", "l_returnflag", ["A", "R"]).drop(
        "p_value", "ci_ratio_low", "ci_ratio_high", "levene_p")


@query("levene", f"""
WITH {LEVENE.format(x="o_totalprice", g="o_orderpriority", t="orders")}
SELECT {r("(n - k) * sb / ((k - 1) * sw)")} AS w, (k - 1)::DOUBLE AS df1, (n - k)::DOUBLE AS df2 FROM l""")
def _(s, d):
    return H.levene(orders(s, d), "o_totalprice", "o_orderpriority").drop("p_value")


@query("bartlett", f"""
WITH c AS (SELECT o_orderpriority, count(*) n, var_samp(o_totalprice) v FROM orders GROUP BY 1),
g AS (SELECT count(*) k, sum(n) n, sum((n - 1) * v) ss, sum((n - 1) * ln(v)) lg, sum(1.0 / (n - 1)) iv FROM c)
SELECT {r("((n - k) * ln(ss / (n - k)) - lg) / (1 + (iv - 1.0 / (n - k)) / (3 * (k - 1)))")} AS t, (k - 1)::DOUBLE AS df,
       {r("sqrt(ss / (n - k))")} AS sd_pooled FROM g""")
def _(s, d):
    return H.bartlett(orders(s, d), "o_totalprice", "o_orderpriority").drop("p_value")


@query("mann_whitney", f"""
WITH x AS (SELECT event_type g, value FROM events WHERE event_type IN ('click', 'view')),
k AS (SELECT *, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2 AS rk FROM x),
t AS (SELECT sum(c * c * c - c)::DOUBLE ties FROM (SELECT count(*)::DOUBLE c FROM x GROUP BY value)),
g AS (SELECT count(*) FILTER (g = 'click')::DOUBLE n1, count(*) FILTER (g = 'view')::DOUBLE n2, sum(rk) FILTER (g = 'click') w,
        median(value) FILTER (g = 'click') m1, median(value) FILTER (g = 'view') m2 FROM k),
u AS (SELECT *, w - n1 * (n1 + 1) / 2 u, sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1)))) sg FROM g, t),
h AS (SELECT median(a.value - b.value) hl FROM x a, x b WHERE a.g = 'click' AND b.g = 'view')
SELECT n1::BIGINT AS n1, n2::BIGINT AS n2, {r("w")} AS w, {r("u")} AS u, {r("n1 * n2 - u")} AS u2,
       {r("(u - n1 * n2 / 2) / sg - sign((u - n1 * n2 / 2) / sg) * 0.5 / sg")} AS z, {r("m1")} AS median1, {r("m2")} AS median2,
       {r("hl")} AS hodges_lehmann FROM u, h""")
def _(s, d):
    return H.mann_whitney(events(s, d), "value", "event_type", ["click", "view"]).drop("p_value")


@query("wilcoxon_signed", f"""
WITH x AS (SELECT c_mktsegment g, c_acctbal - 4000 AS d FROM customer WHERE c_acctbal <> 4000),
k AS (SELECT *, rank() OVER (PARTITION BY g ORDER BY abs(d)) + (count(*) OVER (PARTITION BY g, abs(d)) - 1) / 2 AS rk FROM x),
t AS (SELECT g, sum(c * c * c - c)::DOUBLE ties FROM (SELECT g, count(*)::DOUBLE c FROM x GROUP BY g, abs(d)) GROUP BY g),
w AS (SELECT g, count(*)::DOUBLE n, coalesce(sum(rk) FILTER (d > 0), 0) w, coalesce(sum(rk) FILTER (d < 0), 0) wm, any_value(ties) ties
      FROM k JOIN t USING (g) GROUP BY g),
i AS (SELECT *, row_number() OVER () id FROM x),
h AS (SELECT a.g, median((a.d + b.d) / 2) + 4000 hl FROM i a JOIN i b ON a.g = b.g AND a.id <= b.id GROUP BY a.g),
m AS (SELECT c_mktsegment g, median(c_acctbal) md FROM customer GROUP BY 1)
SELECT g AS c_mktsegment, n::BIGINT AS n, {r("w")} AS w, {r("wm")} AS w_minus,
       {r("(w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)")} AS z, {r("md")} AS median, {r("hl", 4)} AS hodges_lehmann
FROM w JOIN h USING (g) JOIN m USING (g)""", hodges_lehmann=4)
def _(s, d):
    return H.wilcoxon_signed(table(s, d, "customer"), "c_acctbal", 4000.0, ["c_mktsegment"]).drop("p_value")


@query("sign_test", f"""
SELECT event_type, count(*) FILTER (value > 35) AS above, count(*) FILTER (value < 35) AS below, count(*) FILTER (value = 35) AS ties,
       count(*) FILTER (value <> 35) AS n, {r("median(value)")} AS median FROM events GROUP BY 1""")
def _(s, d):
    return H.sign_test(events(s, d), "value", 35.0, ["event_type"]).drop("p_value")


KRUSKAL = """k AS (SELECT l_linestatus b, l_returnflag g, l_quantity v, rank() OVER (PARTITION BY l_linestatus ORDER BY l_quantity) +
  (count(*) OVER (PARTITION BY l_linestatus, l_quantity) - 1) / 2 AS rk FROM lineitem),
c AS (SELECT b, g, count(*)::DOUBLE n, sum(rk) rs, median(v) md FROM k GROUP BY 1, 2),
t AS (SELECT l_linestatus b, sum(c * c * c - c) ties, sum(c) n FROM (SELECT l_linestatus, count(*)::DOUBLE c FROM lineitem GROUP BY l_linestatus, l_quantity) GROUP BY 1),
h AS (SELECT b, any_value(t.n) n, count(*) k, 12 / (any_value(t.n) * (any_value(t.n) + 1)) * sum(rs * rs / c.n) - 3 * (any_value(t.n) + 1) h,
        1 - any_value(ties) / (pow(any_value(t.n), 3) - any_value(t.n)) corr FROM c JOIN t USING (b) GROUP BY b)"""


@query("kruskal_wallis", f"""
WITH {KRUSKAL}
SELECT b AS l_linestatus, n::BIGINT AS n, k, {r("h", 4)} AS h, {r("h / corr", 4)} AS h_adjusted, (k - 1)::DOUBLE AS df FROM h""", digits=4)
def _(s, d):
    return H.kruskal_wallis(items(s, d), "l_quantity", "l_returnflag", ["l_linestatus"]).drop("p_value")


@query("kruskal_wallis_levels", f"""
WITH {KRUSKAL}
SELECT c.b AS l_linestatus, g AS level, c.n::BIGINT AS n, {r("rs / c.n")} AS mean_rank, {r("md")} AS median,
  {r("(rs / c.n - (t.n + 1) / 2) / sqrt(t.n * (t.n + 1) / 12 * (1 / c.n - 1 / t.n))")} AS z FROM c JOIN t USING (b)""")
def _(s, d):
    return H.kruskal_levels(items(s, d), "l_quantity", "l_returnflag", ["l_linestatus"])


MOOD = """m AS (SELECT median(o_totalprice) md FROM orders),
c AS (SELECT o_orderpriority g, count(*) n, count(*) FILTER (o_totalprice > md) a, median(o_totalprice) gm, {q1} q1, {q3} q3, any_value(md) md
      FROM orders, m GROUP BY 1)""".format(q1=q6("o_totalprice", 0.25), q3=q6("o_totalprice", 0.75))


@query("mood_median", f"""
WITH {MOOD}, t AS (SELECT sum(n) n, sum(a) a, count(*) k FROM c),
e AS (SELECT c.a o1, c.n - c.a o2, c.n * t.a / t.n e1, c.n * (t.n - t.a) / t.n e2, k, md FROM c, t)
SELECT {r("sum(pow(o1 - e1, 2) / e1 + pow(o2 - e2, 2) / e2)")} AS chisq, (any_value(k) - 1)::DOUBLE AS df, {r("any_value(md)")} AS grand_median FROM e""")
def _(s, d):
    return H.mood_median(orders(s, d), "o_totalprice", "o_orderpriority").drop("p_value")


@query("mood_median_levels", f"""
WITH {MOOD}
SELECT g AS level, n, a AS above, n - a AS below_eq, {r("md")} AS grand_median, {r("gm")} AS median, {r("q1")} AS q1, {r("q3")} AS q3 FROM c""")
def _(s, d):
    return H.mood_levels(orders(s, d), "o_totalprice", "o_orderpriority")


@query("friedman", f"""
WITH c AS (SELECT user_id b, event_type t, avg(value) x FROM events GROUP BY 1, 2),
f AS (SELECT *, count(*) OVER (PARTITION BY b) kb, (SELECT count(DISTINCT event_type) FROM events) k FROM c),
k AS (SELECT *, rank() OVER (PARTITION BY b ORDER BY x) + (count(*) OVER (PARTITION BY b, x) - 1) / 2 rk FROM f WHERE kb = k),
s AS (SELECT t, sum(rk) s, count(*) b, any_value(k) k FROM k GROUP BY t)
SELECT any_value(b) AS b, any_value(k) AS k, {r("12 * sum(pow(s - b * (k + 1) / 2, 2)) / (any_value(b) * any_value(k) * (any_value(k) + 1))")} AS s,
       (any_value(k) - 1)::DOUBLE AS df FROM s""")
def _(s, d):
    return H.friedman(events(s, d), "value", "user_id", "event_type").drop("p_value")


@query("runs_test", f"""
WITH m AS (SELECT event_type, median(value) md FROM events GROUP BY 1),
x AS (SELECT event_type, event_id, value > md AS up FROM events JOIN m USING (event_type) WHERE value <> md),
l AS (SELECT *, lag(up) OVER (PARTITION BY event_type ORDER BY event_id) p FROM x),
g AS (SELECT event_type, count(*) FILTER (p IS NULL OR p <> up) runs, count(*) FILTER (up)::DOUBLE n1, count(*) FILTER (NOT up)::DOUBLE n2 FROM l GROUP BY 1)
SELECT event_type, runs, n1::BIGINT AS n1, n2::BIGINT AS n2, {r("2 * n1 * n2 / (n1 + n2) + 1")} AS expected,
  {r("(runs - (2 * n1 * n2 / (n1 + n2) + 1)) / sqrt(2 * n1 * n2 * (2 * n1 * n2 - n1 - n2) / (pow(n1 + n2, 2) * (n1 + n2 - 1)))")} AS z FROM g""")
def _(s, d):
    return H.runs_test(events(s, d), "value", ["event_id"], ["event_type"]).drop("p_value")


CELLS = """o AS (SELECT source a, lang b, count(*)::DOUBLE o FROM documents GROUP BY 1, 2),
ra AS (SELECT a, sum(o) ra FROM o GROUP BY 1), cb AS (SELECT b, sum(o) cb FROM o GROUP BY 1), n AS (SELECT sum(o) n FROM o),
f AS (SELECT ra.a, cb.b, coalesce(o, 0) o, ra * cb / n e, n FROM ra, cb, n LEFT JOIN o ON o.a = ra.a AND o.b = cb.b)"""


@query("chi_square", f"""
WITH {CELLS}
SELECT {r("sum(CASE WHEN o > 0 THEN 2 * o * ln(o / e) ELSE 0 END)")} AS likelihood_ratio, sum(o)::BIGINT AS n, {r("min(e)")} AS min_expected,
  {r("sum(pow(o - e, 2) / e)")} AS chisq, ((count(DISTINCT a) - 1) * (count(DISTINCT b) - 1))::DOUBLE AS df,
  {r("sqrt(sum(pow(o - e, 2) / e) / (sum(o) * least(count(DISTINCT a) - 1, count(DISTINCT b) - 1)))")} AS cramer_v,
  {r("100 * avg((e < 5)::INT)")} AS pct_small_expected FROM f""")
def _(s, d):
    return H.chi_square(table(s, d, "documents").select("source", "lang"), "source", "lang").drop("p_value", "p_likelihood_ratio")


@query("chi_square_cells", f"""
WITH {CELLS}
SELECT a AS row_level, b AS col_level, o::BIGINT AS count, {r("e")} AS expected, {r("pow(o - e, 2) / e")} AS contribution,
       {r("(o - e) / sqrt(e)")} AS residual FROM f""")
def _(s, d):
    return H.chi_square_cells(table(s, d, "documents").select("source", "lang"), "source", "lang")


@query("chi_square_fit", f"""
WITH o AS (SELECT event_type, count(*)::DOUBLE o FROM events GROUP BY 1), n AS (SELECT sum(o) n, count(*) k FROM o)
SELECT any_value(n)::BIGINT AS n, {r("sum(pow(o - n / k, 2) / (n / k))")} AS chisq, (any_value(k) - 1)::DOUBLE AS df FROM o, n""")
def _(s, d):
    return H.chi_square_fit(events(s, d), "event_type").drop("p_value")


@query("fisher_exact", f"""
WITH g AS (SELECT source, count(*) FILTER (lang = 'en' AND n_chars > 1000) a, count(*) FILTER (lang = 'en' AND n_chars <= 1000) b,
  count(*) FILTER (lang <> 'en' AND n_chars > 1000) c, count(*) FILTER (lang <> 'en' AND n_chars <= 1000) d FROM documents GROUP BY 1)
SELECT source, a, b, c, d, {r("(a * d)::DOUBLE / nullif(b * c, 0)")} AS odds_ratio FROM g""")
def _(s, d):
    return H.fisher_exact(table(s, d, "documents").select("source", "lang", "n_chars"), F.col("lang") == "en", F.col("n_chars") > 1000, ["source"]).drop("p_value")


@query("poisson_test", f"""
WITH g AS (SELECT event_type, count(*)::DOUBLE c, (count(DISTINCT CAST(ts AS DATE)))::DOUBLE e FROM events GROUP BY 1)
SELECT event_type, c AS count, e AS exposure, {r("c / e")} AS rate FROM g""")
def _(s, d):
    per_day = events(s, d).groupBy("event_type", "day").agg(F.count(F.lit(1)).alias("k"))
    return H.poisson_test(per_day, F.col("k"), F.lit(1), 65.0, ["event_type"]).select("event_type", "count", "exposure", "rate")


@query("poisson_test_two", f"""
WITH g AS (SELECT count(*) FILTER (event_type = 'error')::DOUBLE c1, count(DISTINCT CAST(ts AS DATE)) FILTER (event_type = 'error')::DOUBLE e1,
  count(*) FILTER (event_type = 'signup')::DOUBLE c2, count(DISTINCT CAST(ts AS DATE)) FILTER (event_type = 'signup')::DOUBLE e2 FROM events),
s AS (SELECT *, sqrt(c1 / (e1 * e1) + c2 / (e2 * e2)) se FROM g)
SELECT c1, e1, c2, e2, {r("c1 / e1")} AS rate1, {r("c2 / e2")} AS rate2, {r("c1 / e1 - c2 / e2")} AS diff, {r("(c1 / e1 - c2 / e2) / se")} AS z,
  {r("c1 / e1 - c2 / e2 - 1.9599639845400545 * se")} AS ci_low, {r("c1 / e1 - c2 / e2 + 1.9599639845400545 * se")} AS ci_high FROM s""")
def _(s, d):
    per_day = events(s, d).groupBy("event_type", "day").agg(F.count(F.lit(1)).alias("k"))
    return H.poisson_test_two(per_day, F.col("k"), F.lit(1), "event_type", ["error", "signup"]).drop("p_value", "p_exact")


@query("kolmogorov_smirnov", f"""
WITH c AS (SELECT l_linestatus b, l_quantity x, count(*) FILTER (l_returnflag = 'A') a, count(*) FILTER (l_returnflag = 'N') n
           FROM lineitem WHERE l_returnflag IN ('A', 'N') GROUP BY 1, 2),
f AS (SELECT b, sum(a) OVER w / sum(a) OVER (PARTITION BY b) fa, sum(n) OVER w / sum(n) OVER (PARTITION BY b) fn, sum(a) OVER (PARTITION BY b) na,
      sum(n) OVER (PARTITION BY b) nn FROM c WINDOW w AS (PARTITION BY b ORDER BY x))
SELECT b AS l_linestatus, max(na)::BIGINT AS n1, max(nn)::BIGINT AS n2, {r("max(abs(fa - fn))")} AS d FROM f GROUP BY 1""")
def _(s, d):
    return H.ks_two(items(s, d), "l_quantity", "l_returnflag", ["A", "N"], ["l_linestatus"]).drop("p_value")


@query("exact_p_values")
def _(s, d):
    return H.proportion_test(events(s, d), F.col("value") > 50, ["event_type"], 0.35).select(
        "event_type", "p_exact", "exact_low", "exact_high", "p_value")
