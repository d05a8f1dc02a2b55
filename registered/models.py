"""ANOVA, regression and logistic models (survey 2.8, 2.9)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import functions as F

from procstats.operators import anova as V
from procstats.operators import regression as G

from .common import r, registry, table

QUERIES, query = registry()
XS = ["l_quantity", "l_discount", "l_tax"]


def items(s, d):
    return table(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_extendedprice", *XS)


def orders(s, d):
    return table(s, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice")


def events(s, d):
    return table(s, d, "events").select("event_id", "event_type", "user_id", "value")


ONE_WAY = """c AS (SELECT o_orderpriority AS level, count(*)::DOUBLE n, avg(o_totalprice) m, var_samp(o_totalprice) v FROM orders GROUP BY 1),
g AS (SELECT count(*) k, sum(n) nt, sum(n * m) / sum(n) gm, sum((n - 1) * v) ssw FROM c),
o AS (SELECT any_value(k) k, any_value(nt) nt, any_value(gm) gm, any_value(ssw) ssw, sum(n * pow(m - gm, 2)) ssb FROM c, g)"""


@query("one_way_anova", f"""
WITH {ONE_WAY}
SELECT k, nt AS total_n, {r("ssw", 0)} AS ss_within, {r("gm", 4)} AS grand_mean, {r("ssb", 0)} AS ss_between, (k - 1)::DOUBLE AS df_between, nt - k AS df_within,
 {r("ssb / (k - 1)", 0)} AS ms_between, {r("ssw / (nt - k)", 0)} AS ms_within, {r("(ssb / (k - 1)) / (ssw / (nt - k))")} AS f, {r("sqrt(ssw / (nt - k))", 4)} AS s_pooled,
 {r("ssb / (ssb + ssw)")} AS eta_sq, {r("1 - (ssw / (nt - k)) / ((ssb + ssw) / (nt - 1))")} AS r2_adjusted,
 {r("(ssb - (k - 1) * ssw / (nt - k)) / (ssb + ssw + ssw / (nt - k))")} AS omega_sq FROM o""",
       ss_within=0, ss_between=0, ms_between=0, ms_within=0, grand_mean=4, s_pooled=4)
def _(s, d):
    return V.one_way(orders(s, d), "o_totalprice", "o_orderpriority").drop("p_value")


@query("one_way_levels", f"""
WITH {ONE_WAY}
SELECT level, n::BIGINT AS n, {r("m", 4)} AS mean, {r("sqrt(v)", 4)} AS sd, {r("sqrt(v / n)", 4)} AS se FROM c""", digits=4)
def _(s, d):
    return V.one_way_levels(orders(s, d), "o_totalprice", "o_orderpriority").select("level", "n", "mean", "sd", "se")


@query("welch_anova", f"""
WITH c AS (SELECT l_linestatus b, l_returnflag, count(*)::DOUBLE n, avg(l_extendedprice) m, var_samp(l_extendedprice) v FROM lineitem GROUP BY 1, 2),
w AS (SELECT *, n / v w, sum(n / v) OVER (PARTITION BY b) sw, sum(n * m / v) OVER (PARTITION BY b) / sum(n / v) OVER (PARTITION BY b) mb, count(*) OVER (PARTITION BY b)::DOUBLE k FROM c),
g AS (SELECT b, any_value(k) k, sum(w * pow(m - mb, 2)) num, sum(pow(1 - w / sw, 2) / (n - 1)) lam FROM w GROUP BY b)
SELECT b AS l_linestatus, {r("(num / (k - 1)) / (1 + 2 * (k - 2) / (k * k - 1) * lam)", 5)} AS f, k - 1 AS df1, {r("(k * k - 1) / (3 * lam)", 3)} AS df2 FROM g""", f=5, df2=3)
def _(s, d):
    return V.welch_anova(items(s, d), "l_extendedprice", "l_returnflag", ["l_linestatus"]).drop("p_value")


PAIRS = f"""WITH {ONE_WAY}, p AS (SELECT a.level AS la, b.level AS lb, a.m - b.m AS diff, a.n na, b.n nb, a.v va, b.v vb, ssw / (nt - k) msw, nt - k dfw FROM c a, c b, o WHERE a.level < b.level)"""

for method, se, dof in [
    ("tukey", "sqrt(msw * 0.5 * (1 / na + 1 / nb))", "dfw"), ("fisher", "sqrt(msw * (1 / na + 1 / nb))", "dfw"),
    ("bonferroni", "sqrt(msw * (1 / na + 1 / nb))", "dfw"), ("sidak", "sqrt(msw * (1 / na + 1 / nb))", "dfw"),
    ("games-howell", "sqrt(va / na + vb / nb)", "pow(va / na + vb / nb, 2) / (pow(va / na, 2) / (na - 1) + pow(vb / nb, 2) / (nb - 1))"),
]:
    @query(f"comparisons_{method.replace('-', '_')}", f"""{PAIRS}
SELECT la AS level_a, lb AS level_b, {r("diff", 4)} AS diff, {r(se, 4)} AS se, {r(dof, 4)} AS df, {r(f"diff / {se}", 4)} AS t, '{method}' AS method FROM p""", digits=4)
    def _(s, d, method=method):
        return V.multiple_comparisons(orders(s, d), "o_totalprice", "o_orderpriority", method=method).drop("ci_low", "ci_high", "p_value", "significant")


@query("comparisons_dunnett", f"""
WITH {ONE_WAY}
SELECT a.level AS level_a, b.level AS level_b, {r("a.m - b.m", 4)} AS diff, {r("sqrt(ssw / (nt - k) * (1 / a.n + 1 / b.n))", 4)} AS se, nt - k AS df,
 {r("(a.m - b.m) / sqrt(ssw / (nt - k) * (1 / a.n + 1 / b.n))", 4)} AS t, 'dunnett' AS method FROM c a, c b, o WHERE b.level = '3-MEDIUM' AND a.level <> b.level""", digits=4)
def _(s, d):
    return V.multiple_comparisons(orders(s, d), "o_totalprice", "o_orderpriority", method="dunnett", control="3-MEDIUM").drop(
        "ci_low", "ci_high", "p_value", "significant")


def gs(src: str, y: str, xs: list[str], by: str = "1") -> str:
    """Successive orthogonalisation of y on xs in SQL: coefficients b1.., sequential SS s1.., sse."""
    k = len(xs)
    part = f"OVER (PARTITION BY {by})"
    ctes = [f"z0 AS (SELECT {by} AS k, count(*) {part} AS n, {y} - avg({y}) {part} AS y, avg({y}) {part} AS ym, "
            + ", ".join(f"{x} - avg({x}) {part} AS z{i}, avg({x}) {part} AS m{i}" for i, x in enumerate(xs, 1)) + f" FROM {src})"]
    for i in range(1, k):
        later = ", ".join(f"z{j} - z{i} * c{i}_{j} AS z{j}" for j in range(i + 1, k + 1))
        coef = ", ".join(f"sum(z{i} * z{j}) OVER (PARTITION BY k) / sum(z{i} * z{i}) OVER (PARTITION BY k) AS c{i}_{j}" for j in range(i + 1, k + 1))
        ctes.append(f"w{i} AS (SELECT *, {coef} FROM z{i - 1})")
        ctes.append(f"z{i} AS (SELECT * REPLACE ({later}) FROM w{i})")
    agg = ["k", "any_value(n)::DOUBLE n", "any_value(ym) ym", "sum(y * y) sst"]
    agg += [f"any_value(m{i}) m{i}, sum(y * z{i}) / sum(z{i} * z{i}) g{i}, pow(sum(y * z{i}), 2) / sum(z{i} * z{i}) s{i}, sum(z{i} * z{i}) q{i}" for i in range(1, k + 1)]
    agg += [f"any_value(c{i}_{j}) c{i}_{j}" for i in range(1, k) for j in range(i + 1, k + 1)]
    ctes.append(f"f0 AS (SELECT {', '.join(agg)} FROM z{k - 1} GROUP BY k)")
    prev = "f0"
    for i in range(k, 0, -1):
        expr = f"g{i}" + "".join(f" - c{i}_{j} * b{j}" for j in range(i + 1, k + 1))
        ctes.append(f"f{k - i + 1} AS (SELECT *, {expr} AS b{i} FROM {prev})")
        prev = f"f{k - i + 1}"
    sse = "sst" + "".join(f" - s{i}" for i in range(1, k + 1))
    b0 = "ym" + "".join(f" - b{i} * m{i}" for i in range(1, k + 1))
    ctes.append(f"fit AS (SELECT *, {sse} AS sse, {b0} AS b0, n - {k + 1} AS dfe FROM {prev})")
    return ",\n".join(ctes)


OLS = gs("lineitem", "l_extendedprice", XS, "l_returnflag")


def ols(s, d):
    return G.linear_model(items(s, d), "l_extendedprice", XS, by=["l_returnflag"])


@query("design_columns", f"""
SELECT l_orderkey, l_partkey, l_linenumber, l_suppkey, l_quantity, CASE l_returnflag WHEN 'A' THEN 1.0 WHEN 'R' THEN -1.0 ELSE 0.0 END::DOUBLE AS "l_returnflag[A]",
  CASE l_returnflag WHEN 'N' THEN 1.0 WHEN 'R' THEN -1.0 ELSE 0.0 END::DOUBLE AS "l_returnflag[N]", {r("pow(l_discount, 2)")} AS "l_discount^2",
  {r("l_quantity * l_tax")} AS "l_quantity*l_tax" FROM lineitem""")
def _(s, d):
    df = items(s, d).withColumn("q", F.col("l_quantity"))
    return G.design_columns(df, ["l_returnflag", "l_discount^2", "l_quantity*l_tax"], ["l_returnflag"],
                            keep=["l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", "l_quantity"])


@query("ols_coefficients", f"""
WITH {OLS}
SELECT k AS l_returnflag, unnest(['(intercept)', 'l_quantity', 'l_discount', 'l_tax']) AS term,
       unnest([{r("b0", 4)}, {r("b1", 4)}, {r("b2", 4)}, {r("b3", 4)}]) AS coef FROM fit""", digits=4)
def _(s, d):
    return ols(s, d).coefficients().select("l_returnflag", "term", "coef")


@query("ols_last_standard_error", f"""
WITH {OLS} SELECT k AS l_returnflag, {r("sqrt(sse / dfe / q3)", 4)} AS se, {r("b3 / sqrt(sse / dfe / q3)")} AS t FROM fit""", se=4)
def _(s, d):
    return ols(s, d).coefficients().where("term = 'l_tax'").select("l_returnflag", "se", "t")


@query("ols_summary", f"""
WITH {OLS}
SELECT k AS l_returnflag, n, {r("sse / sst", 8)} AS unexplained, {r("1 - sse / sst", 8)} AS r2, {r("1 - sse / sst * (n - 1) / dfe", 8)} AS r2_adjusted, {r("sqrt(sse / dfe)", 4)} AS s,
  {r("((sst - sse) / 3) / (sse / dfe)", 4)} AS f, {r("n * ln(sse / n) + 8", 4)} AS aic, {r("n * ln(sse / n) + 4 * ln(n)", 4)} AS bic,
  {r("n * ln(sse / n) + 8 + 40 / (n - 5)", 4)} AS aicc, dfe FROM fit""", digits=4, r2=8, r2_adjusted=8, unexplained=8)
def _(s, d):
    t = ols(s, d).summary()
    return t.select("l_returnflag", "n", (F.col("sse") / F.col("sst")).alias("unexplained"), "r2", "r2_adjusted", "s", "f", "aic", "bic", "aicc", "dfe")


@query("glm_type_one", f"""
WITH {OLS}
SELECT k AS l_returnflag, unnest({XS}) AS term, 1.0::DOUBLE AS df, unnest([{r("s1 / sst", 9)}, {r("s2 / sst", 9)}, {r("s3 / sst", 9)}]) AS share,
  unnest([{r("s1 / (sse / dfe)", 4)}, {r("s2 / (sse / dfe)", 4)}, {r("s3 / (sse / dfe)", 4)}]) AS f_seq FROM fit""", digits=4, share=9)
def _(s, d):
    m = ols(s, d)
    a = m.anova().join(m.table.select("l_returnflag", "sst"), "l_returnflag")
    return a.select("l_returnflag", "term", "df", (F.col("ss_seq") / F.col("sst")).alias("share"), "f_seq")


@query("glm_type_three", f"""
WITH {gs("lineitem", "l_extendedprice", ["l_discount", "l_tax", "l_quantity"], "l_returnflag")}
SELECT k AS l_returnflag, 'l_quantity' AS term, {r("s3 / (sse / dfe)", 4)} AS f_adj FROM fit""", digits=4)
def _(s, d):
    return ols(s, d).anova().where("term = 'l_quantity'").select("l_returnflag", "term", "f_adj")


@query("glm_p_values")
def _(s, d):
    return G.linear_model(items(s, d), "l_extendedprice", ["l_returnflag", "l_quantity", "l_returnflag*l_quantity"], ["l_returnflag"]).anova()


@query("residual_diagnostics", f"""
WITH {gs("orders", "o_totalprice", ["o_custkey"])},
e AS (SELECT o_orderkey, o_totalprice AS observed, b0 + b1 * o_custkey AS fitted, o_totalprice - b0 - b1 * o_custkey AS e, 1 / n + pow(o_custkey - m1, 2) / q1 AS h, sse, dfe FROM orders, fit),
z AS (SELECT *, e / sqrt(sse / dfe * (1 - h)) sr FROM e)
SELECT o_orderkey, {r("observed", 3)} AS observed, {r("fitted", 3)} AS fitted, {r("e", 3)} AS residual, {r("h", 8)} AS leverage, {r("sr", 6)} AS standardized,
  {r("e / sqrt((sse - e * e / (1 - h)) / (dfe - 1) * (1 - h))", 6)} AS studentized, {r("sr * sr * h / (2 * (1 - h))", 8)} AS cook FROM z""", digits=6, observed=3, fitted=3, residual=3, leverage=8, cook=8)
def _(s, d):
    return G.linear_model(table(s, d, "orders"), "o_totalprice", ["o_custkey"]).diagnostics(["o_orderkey"])


@query("press_and_durbin_watson", f"""
WITH {gs("orders", "o_totalprice", ["o_custkey"])},
e AS (SELECT o_orderkey, o_totalprice - b0 - b1 * o_custkey AS e, 1 / n + pow(o_custkey - m1, 2) / q1 AS h, sst FROM orders, fit),
l AS (SELECT *, e - lag(e) OVER (ORDER BY o_orderkey) AS d FROM e)
SELECT {r("sum(pow(e / (1 - h), 2)) / any_value(sst)", 8)} AS press_share, {r("1 - sum(pow(e / (1 - h), 2)) / any_value(sst)", 8)} AS r2_press, {r("sum(d * d) / sum(e * e)")} AS durbin_watson FROM l""", press_share=8, r2_press=8)
def _(s, d):
    m = G.linear_model(table(s, d, "orders"), "o_totalprice", ["o_custkey"])
    p = m.press()
    from procstats.plans.joining import one_row
    return p.select((1 - F.col("r2_press")).alias("press_share"), "r2_press").withColumns(one_row(m.durbin_watson(["o_orderkey"])))


@query("prediction", f"""
WITH {gs("orders", "o_totalprice", ["o_custkey"])}
SELECT c_custkey AS o_custkey, {r("b0 + b1 * c_custkey", 3)} AS fit, {r("sqrt(sse / dfe * (1 / n + pow(c_custkey - m1, 2) / q1))", 3)} AS se_fit,
  {r("sqrt(sse / dfe * (1 + 1 / n + pow(c_custkey - m1, 2) / q1))", 3)} AS se_pred FROM customer, fit""", digits=3)
def _(s, d):
    m = G.linear_model(table(s, d, "orders"), "o_totalprice", ["o_custkey"])
    new = table(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"))
    return m.predict(new, keep=["o_custkey"]).select("o_custkey", "fit", "se_fit", "se_pred")


@query("prediction_intervals")
def _(s, d):
    m = G.linear_model(table(s, d, "orders"), "o_totalprice", ["o_custkey"])
    return m.predict(table(s, d, "customer").select(F.col("c_custkey").alias("o_custkey")), keep=["o_custkey"])


@query("vif", f"""
WITH c AS (SELECT corr(l_quantity, l_extendedprice) a, corr(l_quantity, l_discount) b, corr(l_extendedprice, l_discount) c FROM lineitem),
d AS (SELECT *, 1 + 2 * a * b * c - a * a - b * b - c * c AS det FROM c)
SELECT 'l_quantity' AS term, {r("(1 - c * c) / det")} AS vif FROM d UNION ALL SELECT 'l_extendedprice', {r("(1 - b * b) / det")} FROM d
UNION ALL SELECT 'l_discount', {r("(1 - a * a) / det")} FROM d""")
def _(s, d):
    return G.linear_model(items(s, d), "l_tax", ["l_quantity", "l_extendedprice", "l_discount"]).vif()


@query("ls_means", f"""
WITH c AS (SELECT l_returnflag g, count(*)::DOUBLE n, avg(l_extendedprice) m, avg(l_quantity) q FROM lineitem GROUP BY 1),
w AS (SELECT sum((l_quantity - q) * (l_extendedprice - m)) / sum(pow(l_quantity - q, 2)) b FROM lineitem JOIN c ON g = l_returnflag),
a AS (SELECT avg(l_quantity) gq FROM lineitem)
SELECT g AS level, {r("m - b * (q - gq)", 3)} AS mean FROM c, w, a""", digits=3)
def _(s, d):
    return V.factorial_anova(items(s, d), "l_extendedprice", ["l_returnflag"], ["l_quantity"], False).ls_means("l_returnflag").select("level", "mean")


@query("factorial_anova", f"""
WITH b AS (SELECT l_linestatus::VARCHAR a, l_quantity q, l_extendedprice y FROM lineitem),
x AS (SELECT CASE a WHEN 'F' THEN 1.0 ELSE -1.0 END x1, CASE WHEN l_tax >= 0.04 THEN -1.0 ELSE 1.0 END x2, y FROM (SELECT *, l_linestatus a, l_extendedprice y FROM lineitem)),
p AS (SELECT x1, x2, x1 * x2 AS x3, y FROM x), {gs("p", "y", ["x1", "x2", "x3"])}
SELECT unnest(['l_linestatus', 'band', 'l_linestatus*band']) AS term, unnest([{r("s1 / (sse / dfe)", 4)}, {r("s2 / (sse / dfe)", 4)}, {r("s3 / (sse / dfe)", 4)}]) AS f_seq FROM fit""", digits=4)
def _(s, d):
    df = items(s, d).withColumn("band", F.when(F.col("l_tax") >= 0.04, "wide").otherwise("narrow"))
    return V.factorial_anova(df, "l_extendedprice", ["l_linestatus", "band"]).anova().select("term", "f_seq")


@query("blocked_anova", f"""
WITH c AS (SELECT l_returnflag t, l_linestatus b, l_extendedprice y FROM lineitem),
x AS (SELECT CASE b WHEN 'F' THEN 1.0 ELSE -1.0 END x1, CASE t WHEN 'A' THEN 1.0 WHEN 'R' THEN -1.0 ELSE 0.0 END x2, CASE t WHEN 'N' THEN 1.0 WHEN 'R' THEN -1.0 ELSE 0.0 END x3, y FROM c),
{gs("x", "y", ["x1", "x2", "x3"])}
SELECT unnest(['l_linestatus', 'l_returnflag']) AS term, unnest([{r("s1 / (sse / dfe)", 4)}, {r("((s2 + s3) / 2) / (sse / dfe)", 4)}]) AS f_seq FROM fit""", digits=4)
def _(s, d):
    return V.blocked_anova(items(s, d), "l_extendedprice", "l_returnflag", "l_linestatus").anova().select("term", "f_seq")


#: Parts as blocks, return flags as treatments: the blocks are eliminated from the equations of A and N (R is the rest).
ABSORBED = """k AS (SELECT l_partkey b, l_returnflag t, l_extendedprice y FROM lineitem),
p AS (SELECT b, count(*)::DOUBLE w, avg(y) mb, count(*) FILTER (t = 'A')::DOUBLE na, count(*) FILTER (t = 'N')::DOUBLE nn FROM k GROUP BY b),
d AS (SELECT k.*, p.mb, y - p.mb AS u FROM k JOIN p USING (b)),
z AS (SELECT avg(y) g, count(*)::DOUBLE n, sum(u * u) s, sum(u) FILTER (t = 'A') qa, sum(u) FILTER (t = 'N') qn,
  count(*) FILTER (t = 'A')::DOUBLE ta, count(*) FILTER (t = 'N')::DOUBLE tn, count(*) FILTER (t = 'R')::DOUBLE tr FROM d),
h AS (SELECT count(*)::DOUBLE nb, any_value(ta) - sum(na * na / w) caa, -sum(na * nn / w) can, any_value(tn) - sum(nn * nn / w) cnn,
  sum(w * pow(mb - g, 2)) ss_b, any_value(qa) qa, any_value(qn) qn, any_value(n) n, any_value(s) s, any_value(g) g,
  any_value(ta) ta, any_value(tn) tn, any_value(tr) tr FROM p, z),
f AS (SELECT *, (qa * cnn - qn * can) / (caa * cnn - can * can) ea, (qn * caa - qa * can) / (caa * cnn - can * can) en FROM h),
e AS (SELECT *, ea * qa + en * qn AS ss_t, s - ea * qa - en * qn AS sse, n - nb - 2 AS dfe, (ea * ta + en * tn) / n AS shift FROM f),
m AS (SELECT t, count(*) n, avg(y) m, any_value(g) g, count(*) * pow(avg(y) - any_value(g), 2) s FROM k, (SELECT g FROM z) GROUP BY t)"""


@query("absorbed_anova", f"""
WITH {ABSORBED}, o AS (SELECT sum(s) raw FROM m)
SELECT unnest(['l_partkey', 'l_returnflag']) AS term, unnest([nb - 1, 2.0]) AS df, dfe,
 unnest([{r("ss_b / (nb - 1) / (sse / dfe)", 6)}, {r("ss_t / 2 / (sse / dfe)", 6)}]) AS f_seq,
 unnest([{r("(ss_b + ss_t - raw) / (nb - 1) / (sse / dfe)", 6)}, {r("ss_t / 2 / (sse / dfe)", 6)}]) AS f_adj FROM e, o""", digits=6)
def _(s, d):
    return V.absorbed_anova(items(s, d), "l_extendedprice", "l_returnflag", "l_partkey").select("term", "df", "dfe", "f_seq", "f_adj")


@query("absorbed_means", f"""
WITH {ABSORBED}
SELECT m.t AS level, m.n::BIGINT AS n, {r("m.m", 4)} AS mean, {r("m.g - shift + CASE m.t WHEN 'A' THEN ea WHEN 'N' THEN en ELSE 0.0 END", 4)} AS adjusted FROM m, e""", digits=4)
def _(s, d):
    return V.absorbed_means(items(s, d), "l_extendedprice", "l_returnflag", "l_partkey")


@query("latin_square_anova")
def _(s, d):
    df = items(s, d).withColumns({"r": F.col("l_linenumber").cast("string"), "c": (F.col("l_suppkey") % 4).cast("string")})
    return V.latin_square_anova(df, "l_extendedprice", "l_returnflag", "r", "c").anova()


@query("split_plot_anova")
def _(s, d):
    df = items(s, d).withColumn("plot", F.col("l_suppkey") % 10)
    return V.split_plot_anova(df, "l_extendedprice", "l_returnflag", "l_linestatus", "plot")


def det3(*rows: Sequence[str]) -> str:
    """Determinant of three rows of SQL expressions."""
    (a, b, c), (d, e, f), (g, h, i) = [[f"({x})" for x in r] for r in rows]
    return f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"


def solve3(rows: Sequence[Sequence[str]], right: Sequence[str], k: int) -> str:
    """Unknown k of three equations, by Cramer's rule."""
    return f"{det3(*[[x if j == k else m for j, m in enumerate(row)] for row, x in zip(rows, right)])} / {det3(*rows)}"


FULL = [["nt - k1", "k3 - k2", "k3 - k12"], ["k4 - k1", "nt - k2", "k4 - k12"], ["k1 - k4", "k2 - k3", "nt - k3 - k4 + k12"]]
LEFT = ["ssa - (a - 1) * e", "ssb - (b - 1) * e", "ssab - (c - a - b + 1) * e"]
POOLED = [["nt - k1", "k3 - k2", "a - 1"], ["k4 - k1", "nt - k2", "b - 1"], ["k1 - k4", "k2 - k3", "nt - a - b + 1"]]
#: Henderson's equations of all event type x operator cells, as they are; sa, sb, sab and e solve the full model, qa, qb and q the one without interaction.
CELL = f"""cell AS (SELECT event_type p, (user_id % 3)::VARCHAR o, count(value)::DOUBLE n, avg(value) m, var_pop(value) * count(value) ss FROM events WHERE isfinite(value) GROUP BY 1, 2),
z AS (SELECT sum(n) nt, sum(n * m) / sum(n) gm, count(*)::DOUBLE c, sum(n * n) / sum(n) k12, sum(ss) sse, max(n) r FROM cell),
u AS (SELECT sum(n * pow(m - gm, 2)) ssc FROM cell, z),
mp AS (SELECT p, sum(n) n, sum(n * m) / sum(n) m, sum(n * n) / sum(n) q, count(*) k FROM cell GROUP BY 1),
mo AS (SELECT o, sum(n) n, sum(n * m) / sum(n) m, sum(n * n) / sum(n) q, count(*) k FROM cell GROUP BY 1),
tp AS (SELECT count(*)::DOUBLE a, sum(n * n) / any_value(nt) k1, sum(q) k3, sum(n * pow(m - gm, 2)) ssa, max(k) bp FROM mp, z),
t2 AS (SELECT count(*)::DOUBLE b, sum(n * n) / any_value(nt) k2, sum(q) k4, sum(n * pow(m - gm, 2)) ssb, max(k) pb FROM mo, z),
eq AS (SELECT *, ssc - ssa - ssb AS ssab, sse / (nt - c) AS e FROM z, u, tp, t2),
vc AS (SELECT *, {solve3(FULL, LEFT, 0)} AS sa, {solve3(FULL, LEFT, 1)} AS sb, {solve3(FULL, LEFT, 2)} AS sab,
 {", ".join(f"{solve3(POOLED, ['ssa', 'ssb', 'ssab + sse'], k)} AS {name}" for k, name in enumerate(("qa", "qb", "q")))} FROM eq)"""


def operators(s, d):
    return events(s, d).withColumn("operator", (F.col("user_id") % 3).cast("string"))


@query("variance_components", f"""
WITH {CELL}
SELECT a::BIGINT AS a, b::BIGINT AS b, r::BIGINT AS replicates, nt::BIGINT AS n, {r("gm")} AS grand, {r("ssa", 4)} AS ss_a, {r("ssb", 4)} AS ss_b, {r("ssab", 4)} AS ss_ab, {r("sse", 3)} AS ss_error,
  {r("ssa / ((k3 - k2) * sb + (k3 - k12) * sab + (a - 1) * e)")} AS f_a, {r("ssb / ((k4 - k1) * sa + (k4 - k12) * sab + (b - 1) * e)")} AS f_b,
  {r("ssab / ((k1 - k4) * sa + (k2 - k3) * sb + (c - a - b + 1) * e)")} AS f_ab, {r("greatest(0, sa)")} AS var_a, {r("greatest(0, sb)")} AS var_b,
  {r("greatest(0, sab)")} AS var_ab, {r("e", 5)} AS var_error FROM vc""", ss_a=4, ss_b=4, ss_ab=4, ss_error=3, var_error=5)
def _(s, d):
    return V.variance_components(operators(s, d), "value", "event_type", "operator").select(
        "a", "b", "replicates", "n", "grand", "ss_a", "ss_b", "ss_ab", "ss_error", "f_a", "f_b", "f_ab", "var_a", "var_b", "var_ab", "var_error")


@query("variance_components_nested", f"""
WITH {CELL}, w AS (SELECT *, (ssc - ssa - (c - a) * e) / (nt - k3) AS sn FROM eq)
SELECT (SELECT min(n) = max(n) FROM cell) AS balanced, {r("ssa", 4)} AS ss_a, {r("ssc - ssa", 4)} AS ss_b, {r("ssa / ((k3 - k12) * sn + (a - 1) * e)")} AS f_a,
  {r("(ssc - ssa) / (c - a) / e")} AS f_b, {r("greatest(0, (ssa - (a - 1) * e - (k3 - k12) * sn) / (nt - k1))")} AS var_a, {r("greatest(0, sn)")} AS var_b FROM w""", ss_a=4, ss_b=4)
def _(s, d):
    return V.variance_components(operators(s, d), "value", "event_type", "operator", nested=True).select(
        "balanced", "ss_a", "ss_b", "f_a", "f_b", "var_a", "var_b")


@query("polynomial_fit", f"""
WITH x AS (SELECT l_returnflag, l_quantity x, l_quantity * l_quantity x2, pow(l_quantity, 3) x3, l_extendedprice y FROM lineitem),
{gs("x", "y", ["x", "x2", "x3"], "l_returnflag")}
SELECT k AS l_returnflag, unnest(['(intercept)', 'l_quantity', 'l_quantity^2', 'l_quantity^3']) AS term, unnest([{r("b0", 2)}, {r("b1", 3)}, {r("b2", 4)}, {r("b3", 5)}]) AS coef FROM fit""")
def _(s, d):
    c = G.polynomial(items(s, d), "l_quantity", "l_extendedprice", 3, ["l_returnflag"]).coefficients()
    digits = F.when(F.col("position") == 0, F.round("coef", 2)).when(F.col("position") == 1, F.round("coef", 3)).when(
        F.col("position") == 2, F.round("coef", 4)).otherwise(F.round("coef", 5))
    return c.select("l_returnflag", "term", digits.alias("coef"))


@query("lack_of_fit", f"""
WITH {gs("lineitem", "l_extendedprice", ["l_quantity"], "l_returnflag")},
p AS (SELECT l_returnflag k, sum(ss) pss, sum(n - 1)::DOUBLE pdf FROM (SELECT l_returnflag, count(*) n, var_pop(l_extendedprice) * count(*) ss FROM lineitem GROUP BY l_returnflag, l_quantity) GROUP BY 1)
SELECT k AS l_returnflag, dfe - pdf AS lof_df, pdf AS pure_df, {r("((sse - pss) / (dfe - pdf)) / (pss / pdf)", 5)} AS f FROM fit JOIN p USING (k)""", digits=5)
def _(s, d):
    df = items(s, d)
    m = G.linear_model(df, "l_extendedprice", ["l_quantity"], by=["l_returnflag"])
    return G.lack_of_fit(df, ["l_quantity"], "l_extendedprice", m, ["l_returnflag"]).select("l_returnflag", "lof_df", "pure_df", "f")


@query("stepwise")
def _(s, d):
    return G.stepwise(items(s, d), "l_extendedprice", ["l_quantity", "l_discount", "l_tax", "l_returnflag"], ["l_returnflag"])


@query("best_subsets")
def _(s, d):
    return G.best_subsets(items(s, d), "l_extendedprice", ["l_quantity", "l_discount", "l_tax", "l_linenumber"])


@query("best_subsets_of_many")
def _(s, d):
    base = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]
    terms = [*base, *[f"{v}^2" for v in base], *[f"{v}*{w}" for i, v in enumerate(base) for w in base[i + 1:]]]
    return G.best_subsets(items(s, d), "l_extendedprice", terms)


@query("best_subsets_of_one", f"""
WITH c AS (SELECT unnest(['l_quantity', 'l_discount', 'l_tax']) AS v, unnest([pow(corr(l_quantity, l_extendedprice), 2), pow(corr(l_discount, l_extendedprice), 2), pow(corr(l_tax, l_extendedprice), 2)]) r2 FROM lineitem)
SELECT 1 AS size, [arg_max(v, r2)] AS variables, {r("max(r2)", 8)} AS r2 FROM c""", r2=8)
def _(s, d):
    return G.best_subsets(items(s, d), "l_extendedprice", XS).where("size = 1").select("size", "variables", "r2")


def logistic(s, d):
    df = items(s, d).withColumn("returned", G.success_flag("l_returnflag", "R"))
    return G.LogisticModel(df, F.col("returned"), ["l_quantity", "l_discount", "l_linestatus"], ["l_linestatus"])


@query("logistic_coefficients")
def _(s, d):
    return logistic(s, d).coefficients()


MET = """SELECT 0 AS position, '(intercept)' AS term, sum({y})::DOUBLE AS s FROM {t} UNION ALL SELECT 1, 'l_quantity', sum({y} * l_quantity) FROM {t}
UNION ALL SELECT 2, 'l_discount', sum({y} * l_discount) FROM {t} UNION ALL SELECT 3, 'l_linestatus[F]', sum({y} * CASE WHEN l_linestatus = 'F' THEN 1 ELSE -1 END) FROM {t}"""


#: The fit is the one of the largest likelihood exactly if the predicted sums are the observed ones.
@query("logistic_expected", f"""SELECT position, term, {r("s", 3)} AS observed, {r("s", 3)} AS expected FROM ({MET.format(y="(l_returnflag = 'R')::INT", t="lineitem")})""", observed=3, expected=3)
def _(s, d):
    return logistic(s, d).expected()


def logistic_by_cell(s, d):
    cells = items(s, d).groupBy("l_quantity", "l_discount", "l_linestatus").agg(F.count_if(F.col("l_returnflag") == "R").alias("events"), F.count(F.lit(1)).alias("cases"))
    return G.LogisticModel(cells, F.col("events"), ["l_quantity", "l_discount", "l_linestatus"], ["l_linestatus"], trials="cases")


@query("logistic_trials_expected", f"""SELECT position, term, {r("s", 3)} AS observed, {r("s", 3)} AS expected FROM ({MET.format(y="(l_returnflag = 'R')::INT", t="lineitem")})""", observed=3, expected=3)
def _(s, d):
    return logistic_by_cell(s, d).expected()


@query("logistic_trials_coefficients")
def _(s, d):
    return logistic_by_cell(s, d).coefficients()


@query("logistic_predict")
def _(s, d):
    new = items(s, d).withColumn("l_quantity", F.col("l_quantity") + 1)
    return logistic(s, d).predict(new, ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"])


@query("logistic_summary")
def _(s, d):
    return logistic(s, d).summary()


@query("logistic_concordance")
def _(s, d):
    return logistic(s, d).concordance()


@query("concordance_of_a_score", f"""
WITH e AS (SELECT l_linestatus b, l_quantity x, count(*) FILTER (l_returnflag = 'R')::DOUBLE e, count(*) FILTER (l_returnflag <> 'R')::DOUBLE z FROM lineitem GROUP BY 1, 2),
p AS (SELECT a.b, sum(a.e * c.z) pairs, sum(CASE WHEN a.x > c.x THEN a.e * c.z ELSE 0 END) con, sum(CASE WHEN a.x < c.x THEN a.e * c.z ELSE 0 END) dis FROM e a JOIN e c ON a.b = c.b GROUP BY 1)
SELECT b AS l_linestatus, pairs::BIGINT AS pairs, {r("100 * con / pairs")} AS concordant, {r("100 * dis / pairs")} AS discordant, {r("(con - dis) / pairs")} AS somers_d FROM p""")
def _(s, d):
    return G.concordance(items(s, d), "l_quantity", F.col("l_returnflag") == "R", ["l_linestatus"])


@query("scatter_fit", f"""
SELECT l_returnflag, count(*) AS n, {r("corr(l_quantity, l_extendedprice)")} AS r, {r("regr_r2(l_extendedprice, l_quantity)")} AS r2,
 {r("regr_slope(l_extendedprice, l_quantity)", 4)} AS slope, {r("regr_intercept(l_extendedprice, l_quantity)", 4)} AS intercept FROM lineitem GROUP BY 1""", slope=4, intercept=4)
def _(s, d):
    return G.scatter_fit(items(s, d), "l_quantity", "l_extendedprice", ["l_returnflag"])


@query("scatter_band")
def _(s, d):
    return G.scatter_band(items(s, d), "l_quantity", "l_extendedprice", ["l_returnflag"])


@query("residual_plot_data")
def _(s, d):
    return G.residual_plot_data(G.linear_model(table(s, d, "orders"), "o_totalprice", ["o_custkey"]), ["o_orderkey"])
