"""Correlation, multivariate methods and time series (survey 2.10, 2.14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from procstats.operators import multivariate as M
from procstats.operators import timeseries as T

from .common import r, registry, table

QUERIES, query = registry()
XS = ["l_quantity", "l_extendedprice", "l_discount"]
KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate"]


def items(s, d):
    return table(s, d, "lineitem").select(*KEY, "l_returnflag", "l_linestatus", "l_tax", *XS)


def daily(s, d):
    e = table(s, d, "events").select("event_type", F.to_date("ts").alias("day"), "value")
    return e.groupBy("event_type", "day").agg(F.sum("value").alias("total"))


SERIES = """d AS (SELECT event_type k, CAST(ts AS DATE) AS day, sum(value) y FROM events GROUP BY 1, 2),
s AS (SELECT k, y, row_number() OVER (PARTITION BY k ORDER BY day) AS t, count(*) OVER (PARTITION BY k) AS n FROM d)"""


@query("correlation_pearson", f"""
SELECT unnest(['l_quantity', 'l_quantity', 'l_extendedprice']) AS x, unnest(['l_extendedprice', 'l_discount', 'l_discount']) AS y, count(*) AS n,
 unnest([{r("corr(l_quantity, l_extendedprice)")}, {r("corr(l_quantity, l_discount)")}, {r("corr(l_extendedprice, l_discount)")}]) AS r FROM lineitem""")
def _(s, d):
    return M.correlation_matrix(items(s, d), XS).select("x", "y", "n", "r")


@query("correlation_spearman", f"""
WITH k AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 a, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2 b,
 rank() OVER (ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_discount) - 1) / 2 c FROM lineitem)
SELECT unnest(['l_quantity', 'l_quantity', 'l_extendedprice']) AS x, unnest(['l_extendedprice', 'l_discount', 'l_discount']) AS y, count(*) AS n,
 unnest([{r("corr(a, b)")}, {r("corr(a, c)")}, {r("corr(b, c)")}]) AS r FROM k""")
def _(s, d):
    return M.correlation_matrix(items(s, d), XS, "spearman").select("x", "y", "n", "r")


@query("kendall_tau", f"""
WITH e AS (SELECT value x, user_id y, count(*)::DOUBLE c FROM events GROUP BY 1, 2),
p AS (SELECT sum(CASE WHEN (a.x - b.x) * (a.y - b.y) > 0 THEN a.c * b.c ELSE 0 END) / 2 con, sum(CASE WHEN (a.x - b.x) * (a.y - b.y) < 0 THEN a.c * b.c ELSE 0 END) / 2 dis FROM e a, e b),
t AS (SELECT (SELECT sum(c * (c - 1) / 2) FROM (SELECT sum(c) c FROM e GROUP BY x)) tx, (SELECT sum(c * (c - 1) / 2) FROM (SELECT sum(c) c FROM e GROUP BY y)) ty, (SELECT sum(c) FROM e) n)
SELECT n::BIGINT AS n, con AS concordant, dis AS discordant, {r("(con - dis) / sqrt((n * (n - 1) / 2 - tx) * (n * (n - 1) / 2 - ty))")} AS tau FROM p, t""")
def _(s, d):
    return M.kendall(table(s, d, "events").select("value", "user_id"), "value", "user_id")


@query("correlation_p_values")
def _(s, d):
    return M.correlation_matrix(items(s, d), XS)


@query("pca_two_variables", f"""
WITH c AS (SELECT l_returnflag, corr(l_quantity, l_extendedprice) rr FROM lineitem GROUP BY 1)
SELECT l_returnflag, 1 AS component, {r("1 + abs(rr)")} AS eigenvalue, {r("50 * (1 + abs(rr))")} AS pct FROM c
UNION ALL SELECT l_returnflag, 2, {r("1 - abs(rr)")}, {r("50 * (1 - abs(rr))")} FROM c""")
def _(s, d):
    return M.pca(items(s, d), ["l_quantity", "l_extendedprice"], ["l_returnflag"]).select("l_returnflag", "component", "eigenvalue", "pct")


WIDE = 64
DIMENSIONS = [f"e{i}" for i in range(WIDE)]


def vectors(s, d, k=6):
    return table(s, d, "embeddings").select("vec_id", "label", *[F.get("embedding", F.lit(i)).cast("double").alias(f"e{i}") for i in range(k)])


@query("pca")
def _(s, d):
    return M.pca(vectors(s, d, WIDE), DIMENSIONS, correlation=False)


#: Covariances of all pairs of dimensions: their sum of squares is that of the eigenvalues, the trace their sum.
@query("pca_spectrum", f"""
WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
c AS (SELECT a.i, b.i AS j, covar_samp(a.v, b.v) AS c FROM x a JOIN x b USING (vec_id) GROUP BY ALL)
SELECT 64 AS components, {r("sum(c) FILTER (i = j)", 8)} AS total, {r("sum(c * c)", 8)} AS squares FROM c""", total=8, squares=8)
def _(s, d):
    e = F.col("eigenvalue")
    return M.pca(vectors(s, d, WIDE), DIMENSIONS, correlation=False).agg(F.max("component").cast("int").alias("components"), F.sum(e).alias("total"), F.sum(e * e).alias("squares"))


@query("pca_scores")
def _(s, d):
    v, cols = vectors(s, d), DIMENSIONS[:6]
    return M.pca_scores(v, cols, M.pca(v, cols), ["vec_id"], count=3)


@query("k_means_fit")
def _(s, d):
    return M.k_means(vectors(s, d), DIMENSIONS[:6], 4, ["vec_id"])["fit"]


@query("k_means_total_ss", f"""
SELECT count(*) AS n, {r("2.0 * (count(*) - 1)", 5)} AS total_ss FROM lineitem""", total_ss=5)
def _(s, d):
    return M.k_means(items(s, d), ["l_quantity", "l_extendedprice"], 3, KEY)["fit"].select("n", "total_ss")


@query("silhouette")
def _(s, d):
    z = M.k_means(vectors(s, d), DIMENSIONS[:6], 4, ["vec_id"])["standardized"]
    return M.silhouette(z, [f"_z{i}" for i in range(6)])


@query("silhouette_of_labels", f"""
WITH v AS (SELECT vec_id, label, embedding[1:6]::DOUBLE[] e FROM embeddings),
p AS (SELECT x.vec_id, x.label, y.label l2, sum(pow(list_distance(x.e, y.e), 2)) sd, count(*) k FROM v x, v y GROUP BY ALL),
q AS (SELECT vec_id, label, max(CASE WHEN label = l2 THEN sd / (k - 1) END) a, min(CASE WHEN label <> l2 THEN sd / k END) b FROM p GROUP BY 1, 2),
s AS (SELECT label, (b - a) / greatest(a, b) s FROM q)
SELECT label::VARCHAR AS cluster, count(*) AS n, {r("avg(s)")} AS silhouette FROM s GROUP BY label UNION ALL SELECT 'all', count(*), {r("avg(s)")} FROM s""")
def _(s, d):
    return M.silhouette(vectors(s, d), DIMENSIONS[:6], "label")


@query("mahalanobis", f"""
WITH g AS (SELECT l_returnflag g, avg(l_quantity) mx, avg(l_extendedprice) my, var_samp(l_quantity) a, var_samp(l_extendedprice) c, covar_samp(l_quantity, l_extendedprice) b FROM lineitem GROUP BY 1)
SELECT l_returnflag, l_orderkey, l_partkey, l_suppkey, l_linenumber,
 {r("(c * pow(l_quantity - mx, 2) - 2 * b * (l_quantity - mx) * (l_extendedprice - my) + a * pow(l_extendedprice - my, 2)) / (a * c - b * b)")} AS d2 FROM lineitem JOIN g ON g = l_returnflag""")
def _(s, d):
    return M.mahalanobis(items(s, d), ["l_quantity", "l_extendedprice"], KEY[:4], ["l_returnflag"]).drop("cutoff", "outlier")


T2 = """e AS (SELECT event_type g, value x, json_extract(props, '$.k')::DOUBLE y, row_number() OVER (PARTITION BY event_type ORDER BY event_id) rn FROM events)"""


def two_measures(s, d):
    return table(s, d, "events").select("event_id", "event_type", "value", F.get_json_object("props", "$.k").cast("double").alias("k"))


@query("hotelling_t2_individuals", f"""
WITH {T2}, m AS (SELECT g, avg(x) mx, avg(y) my, var_samp(x) a, var_samp(y) c, covar_samp(x, y) b FROM e GROUP BY 1)
SELECT g AS event_type, rn AS point, {r("(c * pow(x - mx, 2) - 2 * b * (x - mx) * (y - my) + a * pow(y - my, 2)) / (a * c - b * b)")} AS t2 FROM e JOIN m USING (g)""")
def _(s, d):
    return M.hotelling_t2(two_measures(s, d), ["value", "k"], ["event_id"], ["event_type"]).drop("ucl")


@query("hotelling_t2_subgroups", f"""
WITH {T2}, q AS (SELECT g, floor((rn - 1) / 5)::BIGINT + 1 AS p, avg(x) x, avg(y) y, var_samp(x) vx, var_samp(y) vy, covar_samp(x, y) vxy FROM e GROUP BY 1, 2 HAVING count(*) = 5),
m AS (SELECT g, avg(x) mx, avg(y) my, avg(vx) a, avg(vy) c, avg(vxy) b FROM q GROUP BY 1)
SELECT g AS event_type, p AS point, {r("5 * (c * pow(x - mx, 2) - 2 * b * (x - mx) * (y - my) + a * pow(y - my, 2)) / (a * c - b * b)")} AS t2,
 {r("vx * vy - vxy * vxy", 1)} AS generalized_variance FROM q JOIN m USING (g)""", generalized_variance=1)
def _(s, d):
    return M.hotelling_t2(two_measures(s, d), ["value", "k"], ["event_id"], ["event_type"], size=5).drop("ucl")


@query("hotelling_t2_limits")
def _(s, d):
    return M.hotelling_t2(two_measures(s, d), ["value", "k"], ["event_id"], ["event_type"], size=5)


@query("discriminant", f"""
WITH e AS (SELECT label::VARCHAR g, embedding[1]::DOUBLE x, embedding[2]::DOUBLE y FROM embeddings),
m AS (SELECT g, count(*)::DOUBLE n, avg(x) mx, avg(y) my, var_pop(x) * count(*) a, var_pop(y) * count(*) c, covar_pop(x, y) * count(*) b FROM e GROUP BY 1),
w AS (SELECT sum(a) / (sum(n) - count(*)) a, sum(c) / (sum(n) - count(*)) c, sum(b) / (sum(n) - count(*)) b, sum(n) nt FROM m),
l AS (SELECT g, (c * mx - b * my) / (a * c - b * b) wx, (a * my - b * mx) / (a * c - b * b) wy, mx, my, n / nt pr FROM (SELECT m.g, m.n, m.mx, m.my, w.* FROM m, w)),
s AS (SELECT e.g actual, l.g predicted, row_number() OVER (PARTITION BY e.x, e.y, e.g ORDER BY e.x * wx + e.y * wy - 0.5 * (mx * wx + my * wy) + ln(pr) DESC, l.g DESC) rk FROM e, l)
SELECT actual, predicted, count(*) AS count FROM s WHERE rk = 1 GROUP BY 1, 2""")
def _(s, d):
    return M.lda(vectors(s, d, 2), "label", ["e0", "e1"])["confusion"]


@query("discriminant_accuracy")
def _(s, d):
    return M.lda(vectors(s, d), "label", DIMENSIONS[:6])["accuracy"]


# ------------------------------------------------------------- time series

@query("accuracy_measures", f"""
WITH {SERIES}, f AS (SELECT k, y, avg(y) OVER (PARTITION BY k ORDER BY t ROWS 2 PRECEDING) f, t FROM s)
SELECT k AS event_type, count(*) AS n, {r("avg(abs(y - f))", 4)} AS mad, {r("avg(pow(y - f, 2))", 3)} AS msd, {r("sqrt(avg(pow(y - f, 2)))", 4)} AS rmse, {r("100 * avg(abs((y - f) / y))")} AS mape
FROM f WHERE t >= 3 GROUP BY k""", mad=4, msd=3, rmse=4)
def _(s, d):
    return T.accuracy(T.moving_average(daily(s, d), "total", ["day"], 3, ["event_type"]), "y", "ma", ["event_type"])


@query("trend_linear", f"""
WITH {SERIES} SELECT k AS event_type, 0 AS position, {r("regr_intercept(y, t)", 4)} AS coef FROM s GROUP BY k UNION ALL SELECT k, 1, {r("regr_slope(y, t)", 4)} FROM s GROUP BY k""", coef=4)
def _(s, d):
    return T.trend(daily(s, d), "total", ["day"], ["event_type"])["coefficients"].select("event_type", "position", "coef")


@query("trend_exponential", f"""
WITH {SERIES}, c AS (SELECT k, regr_intercept(ln(y), t) a, regr_slope(ln(y), t) b, max(n) n FROM s GROUP BY k)
SELECT k AS event_type, n + h AS t, {r("exp(a + b * (n + h))", 4)} AS fit FROM c, range(1, 6) q(h)""", fit=4)
def _(s, d):
    return T.trend(daily(s, d), "total", ["day"], ["event_type"], "exponential", 5)["forecast"].select("event_type", "t", "fit")


@query("trend_quadratic_forecast")
def _(s, d):
    return T.trend(daily(s, d), "total", ["day"], ["event_type"], "quadratic", 5)["forecast"]


@query("moving_average_trailing", f"""
WITH {SERIES} SELECT k AS event_type, t, {r("y", 4)} AS y, n, CASE WHEN t >= 4 THEN {r("avg(y) OVER (PARTITION BY k ORDER BY t ROWS 3 PRECEDING)", 4)} END AS ma FROM s""", digits=4)
def _(s, d):
    return T.moving_average(daily(s, d), "total", ["day"], 4, ["event_type"])


@query("moving_average_centered", f"""
WITH {SERIES} SELECT k AS event_type, t, {r("y", 4)} AS y, n, CASE WHEN t > 3 AND t + 3 <= n THEN {r("avg(y) OVER (PARTITION BY k ORDER BY t ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)", 4)} END AS ma FROM s""", digits=4)
def _(s, d):
    return T.moving_average(daily(s, d), "total", ["day"], 7, ["event_type"], centered=True)


SES = f"""{SERIES}, e AS (SELECT k, t, y, n, y AS f, y AS l FROM s WHERE t = 1
 UNION ALL SELECT s.k, s.t, s.y, s.n, e.l, 0.3 * s.y + 0.7 * e.l FROM s JOIN e ON s.k = e.k AND s.t = e.t + 1)"""


@query("single_smoothing", f"""
WITH RECURSIVE {SES} SELECT k AS event_type, t, {r("y", 4)} AS y, {r("f", 4)} AS fitted FROM e""", digits=4)
def _(s, d):
    return T.smooth(daily(s, d), "total", ["day"], ["event_type"], "ses", alpha=0.3)["fitted"]


@query("single_smoothing_search", f"""
WITH RECURSIVE {SERIES}, g AS (SELECT round(0.05 + i * 0.01, 3) AS a FROM range(91) q(i)),
e AS (SELECT k, a, t, y, y AS f, y AS l FROM s, g WHERE t = 1 UNION ALL SELECT s.k, e.a, s.t, s.y, e.l, e.a * s.y + (1 - e.a) * e.l FROM s JOIN e ON s.k = e.k AND s.t = e.t + 1),
m AS (SELECT k, a, avg(pow(y - f, 2)) msd FROM e GROUP BY 1, 2)
SELECT k AS event_type, arg_min(a, msd)::DOUBLE AS alpha FROM m GROUP BY k""")
def _(s, d):
    return T.smooth(daily(s, d), "total", ["day"], ["event_type"], "ses")["parameters"].select("event_type", "alpha")


@query("single_smoothing_forecast")
def _(s, d):
    return T.smooth(daily(s, d), "total", ["day"], ["event_type"], "ses", horizon=6)["forecast"]


@query("holt", f"""
WITH RECURSIVE {SERIES}, e AS (SELECT s.k, s.t, s.y, s.y AS f, s.y AS l, z.y - s.y AS b FROM s JOIN s z ON s.k = z.k AND z.t = 2 WHERE s.t = 1
 UNION ALL SELECT s.k, s.t, s.y, e.l + e.b, 0.4 * s.y + 0.6 * (e.l + e.b), 0.2 * (0.4 * s.y + 0.6 * (e.l + e.b) - e.l) + 0.8 * e.b FROM s JOIN e ON s.k = e.k AND s.t = e.t + 1)
SELECT k AS event_type, t, {r("y", 4)} AS y, {r("f", 4)} AS fitted FROM e""", digits=4)
def _(s, d):
    return T.smooth(daily(s, d), "total", ["day"], ["event_type"], "holt", alpha=0.4, beta=0.2)["fitted"]


@query("holt_search")
def _(s, d):
    return T.smooth(daily(s, d), "total", ["day"], ["event_type"], "holt", horizon=6)["forecast"]


@query("holt_winters_additive")
def _(s, d):
    return T.smooth(daily(s, d), "total", ["day"], ["event_type"], "holt-winters", period=7, horizon=7)["forecast"]


@query("holt_winters_multiplicative")
def _(s, d):
    return T.smooth(daily(s, d), "total", ["day"], ["event_type"], "holt-winters", period=7, horizon=7, multiplicative=True)["forecast"]


@query("decomposition", f"""
WITH {SERIES}, m AS (SELECT *, (t - 1) % 7 AS se, CASE WHEN t > 3 AND t + 3 <= n THEN avg(y) OVER (PARTITION BY k ORDER BY t ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) END ma FROM s),
i AS (SELECT k, se, coalesce(avg(y - ma), 0) s FROM m GROUP BY 1, 2), j AS (SELECT k, se, s - avg(s) OVER (PARTITION BY k) s FROM i),
a AS (SELECT m.*, j.s, y - j.s adj FROM m JOIN j ON m.k = j.k AND m.se = j.se), l AS (SELECT k, regr_slope(adj, t) b, regr_intercept(adj, t) a FROM a GROUP BY k)
SELECT a.k AS event_type, t, {r("y", 4)} AS y, {r("ma", 4)} AS ma, {r("y - ma", 4)} AS detrended, se AS season, {r("s", 4)} AS seasonal, {r("adj", 4)} AS adjusted,
 {r("l.a + b * t", 4)} AS trend, {r("l.a + b * t + s", 4)} AS fitted, {r("y - (l.a + b * t + s)", 4)} AS residual FROM a JOIN l USING (k)""", digits=4)
def _(s, d):
    return T.decompose(daily(s, d), "total", ["day"], 7, ["event_type"])


@query("decomposition_multiplicative_even", f"""
WITH {SERIES}, m0 AS (SELECT *, (t - 1) % 4 AS se, CASE WHEN t > 2 AND t + 1 <= n THEN avg(y) OVER (PARTITION BY k ORDER BY t ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) END m1 FROM s),
m AS (SELECT *, (m1 + lead(m1) OVER (PARTITION BY k ORDER BY t)) / 2 ma FROM m0),
i AS (SELECT k, se, coalesce(avg(y / ma), 1) s FROM m GROUP BY 1, 2), j AS (SELECT k, se, s / avg(s) OVER (PARTITION BY k) s FROM i)
SELECT m.k AS event_type, t, {r("ma", 6)} AS ma, {r("j.s")} AS seasonal, {r("y / j.s", 6)} AS adjusted FROM m JOIN j ON m.k = j.k AND m.se = j.se""")
def _(s, d):
    return T.decompose(daily(s, d), "total", ["day"], 4, ["event_type"], True).select("event_type", "t", "ma", "seasonal", "adjusted")


@query("differencing", f"""
WITH {SERIES}, a AS (SELECT *, y - lag(y) OVER w d FROM s WINDOW w AS (PARTITION BY k ORDER BY t)), b AS (SELECT *, d - lag(d, 7) OVER (PARTITION BY k ORDER BY t) e FROM a)
SELECT k AS event_type, t, {r("e", 4)} AS difference FROM b WHERE t > 8""", digits=4)
def _(s, d):
    return T.difference(daily(s, d), "total", ["day"], ["event_type"], 1, 7)


@query("autocorrelation", f"""
WITH x AS (SELECT event_type k, row_number() OVER (PARTITION BY event_type ORDER BY event_id) t, value - avg(value) OVER (PARTITION BY event_type) c, count(*) OVER (PARTITION BY event_type) n FROM events),
z AS (SELECT k, sum(c * c) d0 FROM x GROUP BY k)
SELECT a.k AS event_type, (b.t - a.t)::INTEGER AS lag, {r("sum(a.c * b.c) / any_value(d0)")} AS r, {r("1 / sqrt(any_value(a.n))")} AS se, {r("-1.96 / sqrt(any_value(a.n))")} AS lower, {r("1.96 / sqrt(any_value(a.n))")} AS upper
FROM x a JOIN x b ON a.k = b.k AND b.t BETWEEN a.t + 1 AND a.t + 20 JOIN z ON z.k = a.k GROUP BY 1, 2""")
def _(s, d):
    return T.acf(table(s, d, "events").select("event_id", "event_type", "value"), "value", ["event_id"], 20, ["event_type"])


@query("partial_autocorrelation")
def _(s, d):
    return T.pacf(table(s, d, "events").select("event_id", "event_type", "value"), "value", ["event_id"], 20, ["event_type"])


@query("auto_forecast")
def _(s, d):
    return T.auto_forecast(daily(s, d), "total", ["day"], ["event_type"], 6, 7)["ranking"]
