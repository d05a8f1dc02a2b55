"""Columns, rows and aggregation (survey 2.1-2.4)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from procstats.operators import aggregate as A
from procstats.operators import columns as C
from procstats.operators import rows as R
from procstats.plans.session import checkpoint_folder
from procstats.sources import readers, writers

from .common import q6, q7, r, registry, table

QUERIES, query = registry()


@query("locale_numeric_cast", """
SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE round(value, 2) + 0.0 END AS parsed
FROM events""")
def _(s, d):
    text = F.when(F.col("event_id") % 7 == 0, F.lit("n/a")).otherwise(
        F.replace(F.format_number("value", 2), F.lit(","), F.lit("")))
    italian = F.when(F.col("event_id") % 7 == 0, text).otherwise(
        F.replace(F.replace(F.replace(F.format_number("value", 2), F.lit(","), F.lit("#")), F.lit("."), F.lit(",")),
                  F.lit("#"), F.lit(".")))
    return table(s, d, "events").select("event_id", C.to_number(italian).alias("parsed"))


TYPED = ["o_orderkey", "o_orderpriority", "o_orderdate", "o_totalprice", "o_orderstatus"]


@query("type_inference", " UNION ALL ".join(f"""
SELECT '{c}' AS "column", CASE WHEN count(n) >= 0.85 * count(v) THEN 'num'
       WHEN count(*) FILTER (n IS NULL AND regexp_matches(v, '^[0-9]{{1,4}}[-/][0-9]{{1,2}}[-/][0-9]{{1,4}}')) >= 0.8 * count(v) THEN 'date' ELSE 'cat' END AS type
FROM (SELECT v, try_cast(v AS DOUBLE) AS n FROM (SELECT nullif(trim({c}::VARCHAR), '') AS v FROM orders))""" for c in TYPED))
def _(s, d):
    o = table(s, d, "orders")
    return readers.infer_types(o.select(*[F.col(c).cast("string") for c in TYPED]))


@query("derived_column", f"""
SELECT l_orderkey, l_linenumber, l_quantity,
       {r("l_extendedprice * (1 - l_discount) * (1 + l_tax)", 7)} AS charge,
       CASE WHEN l_quantity > 25 THEN 'high' ELSE 'low' END AS band,
       {r("ln(l_extendedprice / l_quantity) + sqrt(l_quantity) - l_quantity % 7 + pow(l_quantity, 2)", 7)} AS mixed,
       CASE WHEN l_discount = 0 THEN NULL ELSE {r("l_tax / l_discount", 7)} END AS tax_ratio,
       (l_quantity >= 10 AND NOT (l_tax = 0) OR l_discount <> 0.05) AS flag
FROM lineitem""", digits=7)
def _(s, d):
    df = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    df = C.derive(df, "charge", "l_extendedprice * (1 - l_discount) * (1 + l_tax)")
    df = C.derive(df, "band", "if(l_quantity > 25, 'high', 'low')")
    df = C.derive(df, "mixed", "ln(l_extendedprice / l_quantity) + sqrt(l_quantity) - l_quantity % 7 + pow(l_quantity, 2)")
    df = C.derive(df, "tax_ratio", "try_divide(l_tax, l_discount)")
    df = C.derive(df, "flag", "(l_quantity >= 10 and not (l_tax = 0) or l_discount <> 0.05)")
    return df.select("l_orderkey", "l_linenumber", "l_quantity", "charge", "band", "mixed", "tax_ratio", "flag")


@query("math_scalars", f"""
SELECT event_id, {r("abs(value - 10)")} AS f_abs, {r("sqrt(value)")} AS f_sqrt, {r("ln(value)")} AS f_ln,
       {r("log10(value)")} AS f_log10, {r("exp(-value)")} AS f_exp, {r("pow(value, 0.5)")} AS f_pow,
       round(value, 1) + 0.0 AS f_round, floor(value)::BIGINT AS f_floor, ceil(value)::BIGINT AS f_ceil,
       {r("sign(value - 10)")} AS f_sign, {r("sin(value)")} AS f_sin, {r("cos(value)")} AS f_cos,
       {r("tan(value / 1000)")} AS f_tan, {r("pi() * value")} AS f_pi
FROM events""")
def _(s, d):
    df = table(s, d, "events").select("event_id", "value")
    for name, e in {
        "f_abs": "abs(value - 10)", "f_sqrt": "sqrt(value)", "f_ln": "ln(value)", "f_log10": "log10(value)",
        "f_exp": "exp(-value)", "f_pow": "pow(value, 0.5)", "f_round": "round(value, 1)", "f_floor": "floor(value)",
        "f_ceil": "ceil(value)", "f_sign": "sign(value - 10)", "f_sin": "sin(value)", "f_cos": "cos(value)",
        "f_tan": "tan(value / 1000)", "f_pi": "pi() * value"}.items():
        df = C.derive(df, name, e)
    return df.drop("value")


@query("row_position", """
SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS "row",
       count(*) OVER (PARTITION BY event_type) AS n_rows FROM events""")
def _(s, d):
    return C.row_position(table(s, d, "events").select("event_id", "event_type"), ["event_id"], ["event_type"])


@query("column_statistics", f"""
SELECT event_id, {r("value - avg(value) OVER ()")} AS centered, {r("stddev_samp(value) OVER ()")} AS sd_value,
       {r("sum(value) OVER ()", 4)} AS sum_value, {r("median(value) OVER ()")} AS med,
       min(value) OVER () AS lo, max(value) OVER () AS hi, count(value) OVER () AS k FROM events""", sum_value=4)
def _(s, d):
    df = C.column_statistics(table(s, d, "events").select("event_id", "value"), {
        "m": ("mean", "value"), "sd_value": ("sd", "value"), "sum_value": ("sum", "value"),
        "med": ("median", "value"), "lo": ("min", "value"), "hi": ("max", "value"), "k": ("count", "value")})
    return C.derive(df, "centered", "value - m").drop("value", "m")


@query("lag_and_difference", f"""
SELECT event_id, event_type, lag(value, 2) OVER w AS value_lag2, {r("value - lag(value, 1) OVER w")} AS d1_value
FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id)""")
def _(s, d):
    df = table(s, d, "events").select("event_id", "event_type", "value")
    lagged = C.lag(df, "value", 2, ["event_id"], ["event_type"])
    return C.difference(lagged, "value", 1, ["event_id"], ["event_type"]).drop("value")


@query("standardize", f"""
SELECT o_orderkey, {r("round((o_totalprice - avg(o_totalprice) OVER w) / stddev_samp(o_totalprice) OVER w, 8)", 8)} AS z_o_totalprice
FROM orders WINDOW w AS (PARTITION BY o_orderpriority)""", digits=8)
def _(s, d):
    df = table(s, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return C.standardize(df, "o_totalprice", by=["o_orderpriority"]).select("o_orderkey", "z_o_totalprice")


@query("bin_equal_width", """
WITH s AS (SELECT min(value) lo, (max(value) - min(value)) / 7 w FROM events),
b AS (SELECT event_id, least(6, floor((value - lo) / w))::BIGINT i, lo, w FROM events, s)
SELECT event_id, printf('%.3f - %.3f', lo + i * w, lo + (i + 1) * w) AS value_class FROM b""")
def _(s, d):
    return C.bin_equal(table(s, d, "events").select("event_id", "value"), "value", 7).drop("value")


@query("bin_quantile", f"""
WITH s AS (SELECT {q7("value", 0.25)} a, {q7("value", 0.5)} b, {q7("value", 0.75)} c FROM events)
SELECT event_id, CASE WHEN value <= a THEN 'Q1' WHEN value <= b THEN 'Q2' WHEN value <= c THEN 'Q3' ELSE 'Q4' END AS value_class
FROM events, s""")
def _(s, d):
    return C.bin_quantile(table(s, d, "events").select("event_id", "value"), "value", 4).drop("value")


@query("recode", """
SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'top' WHEN '5-LOW' THEN 'bottom' ELSE o_orderpriority END AS band
FROM orders""")
def _(s, d):
    return C.recode(table(s, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority",
                    {"1-URGENT": "top", "5-LOW": "bottom"}, "band").drop("o_orderpriority")


@query("recode_by_table", """
SELECT c_custkey, coalesce(r_name, c_nationkey::VARCHAR) AS nation
FROM customer LEFT JOIN region ON c_nationkey = r_regionkey""")
def _(s, d):
    # five of the keys have a name here; the others stay as they are
    names = table(s, d, "region").select(F.col("r_regionkey").alias("value"), F.col("r_name").alias("label"))
    return C.recode(table(s, d, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", names, "nation").drop("c_nationkey")


@query("average_rank", """
SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag,
       rank() OVER w + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2 AS "rank",
       count(*) OVER (PARTITION BY l_returnflag, l_quantity) AS tie_size
FROM lineitem WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_quantity)""")
def _(s, d):
    df = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_quantity")
    return C.average_rank(df, "l_quantity", ["l_returnflag"]).drop("l_quantity")


@query("rename_retype_drop", """
SELECT p_partkey AS key, p_size::VARCHAR AS size, p_retailprice::VARCHAR IS NOT NULL AS has_price,
       p_size::DOUBLE AS size_2 FROM part""")
def _(s, d):
    df = table(s, d, "part").select("p_partkey", F.col("p_size").alias("size"), F.col("p_size").cast("string").alias("p_size"),
                                    F.col("p_retailprice").isNotNull().alias("has_price"), "p_brand")
    df = C.retype(df, {"size": "cat", "p_size": "num"})
    return C.drop_columns(C.rename(df, {"p_partkey": "key", "p_size": "size"}), ["p_brand"])


@query("normal_columns")
def _(s, d):
    df = table(s, d, "events").select("event_id", ((F.col("value") - 50) / 50).alias("z"), (F.col("value") / 1000).alias("p"))
    return C.normal_scores(df, "z", "p")


@query("random_columns")
def _(s, d):
    return C.random_columns(table(s, d, "events").select("event_id"), "u", "g")


@query("filter_rows", """
SELECT event_id, event_type, value FROM events
WHERE value > 50 AND event_type <> 'view' OR (value < 1 AND NOT event_type = 'error')""")
def _(s, d):
    return R.filter_rows(table(s, d, "events").select("event_id", "event_type", "value"),
                         "value > 50 and event_type <> 'view' or (value < 1 and not event_type = 'error')")


@query("slicers", """
SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem
WHERE l_returnflag IN ('A', 'R') AND l_linestatus IN ('F') AND l_quantity BETWEEN 10 AND 20 AND l_discount >= 0.03""")
def _(s, d):
    return R.slice_rows(table(s, d, "lineitem"), {"l_returnflag": ["A", "R"], "l_linestatus": ["F"]},
                        {"l_quantity": (10, 20), "l_discount": (0.03, None)}).select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")


@query("sort_rows", """
SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey""")
def _(s, d):
    return R.sort_rows(table(s, d, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority"),
                       "o_totalprice", ["o_orderkey"], descending=True)


@query("distinct_levels", "SELECT DISTINCT coalesce(nullif(p_size::VARCHAR, ''), '(empty)') AS level FROM part")
def _(s, d):
    return R.levels(table(s, d, "part"), "p_size")


@query("keep_rows_by_id", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49)")
def _(s, d):
    ids = table(s, d, "lineitem").where("l_quantity >= 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return R.keep_rows(table(s, d, "orders").select("o_orderkey", "o_totalprice"), ids, ["o_orderkey"])


@query("remove_rows_by_id", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49)")
def _(s, d):
    ids = table(s, d, "lineitem").where("l_quantity >= 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return R.remove_rows(table(s, d, "orders").select("o_orderkey", "o_totalprice"), ids, ["o_orderkey"])


@query("append_rows", """
SELECT c_custkey AS key, c_acctbal AS balance, c_mktsegment AS segment FROM customer
UNION ALL SELECT s_suppkey, s_acctbal, NULL FROM supplier""")
def _(s, d):
    a = table(s, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    b = table(s, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance"))
    return R.append_rows(a, b)


@query("sample_rows")
def _(s, d):
    return R.sample_rows(table(s, d, "orders").select("o_orderkey", "o_totalprice"), 100, ["o_orderkey"])


@query("drop_duplicate_rows", """
SELECT min(event_id) AS event_id, user_id, event_type, CAST(ts AS DATE) AS day FROM events GROUP BY user_id, event_type, day""")
def _(s, d):
    df = table(s, d, "events").select("event_id", "user_id", "event_type", F.to_date("ts").alias("day"))
    return R.drop_duplicate_rows(df, ["event_id"])


@query("drop_empty_rows", """
SELECT doc_id, CASE WHEN lang = 'en' THEN lang END AS a, CASE WHEN n_chars > 500 THEN n_chars END AS b
FROM documents WHERE lang = 'en' OR n_chars > 500""")
def _(s, d):
    df = table(s, d, "documents").select("doc_id", F.when(F.col("lang") == "en", F.col("lang")).alias("a"),
                                         F.when(F.col("n_chars") > 500, F.col("n_chars")).alias("b"))
    return R.drop_empty_rows(df, ["a", "b"])


@query("complete_cases", """
SELECT event_id, nullif(value, 10.0) AS x, round(value / (user_id % 5), 6) AS y
FROM events WHERE value <> 10.0 AND user_id % 5 > 0""")
def _(s, d):
    df = table(s, d, "events").select("event_id", F.nullif(F.col("value"), F.lit(10.0)).alias("x"),
                                      F.expr("try_divide(value, user_id % 5)").alias("y"))
    return R.complete_cases(df, ["x", "y"])


@query("stack", """
SELECT l_orderkey, l_partkey, l_linenumber, unnest(['l_quantity', 'l_discount', 'l_tax']) AS measure,
       unnest([l_quantity, l_discount, l_tax]) AS value FROM lineitem""")
def _(s, d):
    df = table(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")
    return R.stack(df, ["l_quantity", "l_discount", "l_tax"], "value", "measure")


@query("unstack", """
WITH x AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) rn FROM events)
SELECT rn AS "row", max(value) FILTER (event_type = 'click') AS value_click, max(value) FILTER (event_type = 'error') AS value_error,
       max(value) FILTER (event_type = 'purchase') AS value_purchase, max(value) FILTER (event_type = 'signup') AS value_signup,
       max(value) FILTER (event_type = 'view') AS value_view
FROM x GROUP BY rn""")
def _(s, d):
    return R.unstack(table(s, d, "events"), "value", "event_type", ["event_id"])


@query("aggregate", f"""
SELECT event_type, count(*) AS rows_n, {r("sum(value)", 4)} AS total, {r("avg(value)")} AS mean_v, {r(q7("value", 0.5))} AS median_v,
       min(value) AS lo, max(value) AS hi, {r("stddev_samp(value)")} AS sd_v, {r("var_samp(value)", 4)} AS var_v,
       {r("100 * stddev_samp(value) / avg(value)")} AS cv_v, {r("max(value) - min(value)")} AS range_v,
       {r(q6("value", 0.25))} AS p25_v, {r(q6("value", 0.75))} AS p75_v, {r("sum(value * value)", 2)} AS sumsq_v,
       count(DISTINCT user_id) AS users, arg_min(value, event_id) AS first_v, arg_max(value, event_id) AS last_v, count(*) AS n
FROM events GROUP BY event_type""", total=4, var_v=4, sumsq_v=2)
def _(s, d):
    v = "value"
    return A.aggregate(table(s, d, "events"), ["event_type"], [
        ("count", None, "rows_n"), ("sum", v, "total"), ("mean", v, "mean_v"), ("median", v, "median_v"), ("min", v, "lo"),
        ("max", v, "hi"), ("sd", v, "sd_v"), ("var", v, "var_v"), ("cv", v, "cv_v"), ("range", v, "range_v"),
        ("p25", v, "p25_v"), ("p75", v, "p75_v"), ("sumsq", v, "sumsq_v"), ("distinct", "user_id", "users"),
        ("first", v, "first_v"), ("last", v, "last_v")], order_by=["event_id"])


@query("aggregate_sorted_top", f"""
SELECT l_partkey::VARCHAR AS l_partkey, l_returnflag, {r("sum(l_extendedprice)", 2)} AS revenue, count(*) AS n
FROM lineitem GROUP BY ALL ORDER BY sum(l_extendedprice) DESC, 1, 2 LIMIT 25""", revenue=2)
def _(s, d):
    return A.aggregate(table(s, d, "lineitem"), ["l_partkey", "l_returnflag"], [("sum", "l_extendedprice", "revenue")],
                       sort_by="revenue", descending=True, top=25)


@query("quantiles", f"""
SELECT l_returnflag, {r(q6("l_extendedprice", 0.1))} AS p10_t6, {r(q6("l_extendedprice", 0.25))} AS q1, {r(q7("l_extendedprice", 0.5))} AS med,
       {r(q6("l_extendedprice", 0.75))} AS q3, {r(q7("l_extendedprice", 0.9))} AS p90_t7, count(*) AS n
FROM lineitem GROUP BY l_returnflag""")
def _(s, d):
    from procstats.plans.ordering import quantiles
    return quantiles(table(s, d, "lineitem"), "l_extendedprice", {
        "p10_t6": (0.1, 6), "q1": (0.25, 6), "med": (0.5, 7), "q3": (0.75, 6), "p90_t7": (0.9, 7)}, ["l_returnflag"])


@query("chart_aggregate", f"""
SELECT o_orderpriority, o_orderstatus, {r("median(o_totalprice)")} AS value, count(*) AS n FROM orders GROUP BY ALL""")
def _(s, d):
    return A.chart_aggregate(table(s, d, "orders"), ["o_orderpriority", "o_orderstatus"], "o_totalprice", "median")


@query("top_categories", f"""
WITH g AS (SELECT p_brand, l_returnflag, sum(l_quantity) AS value, count(*) AS n
           FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
t AS (SELECT p_brand, sum(value) AS total FROM g GROUP BY p_brand ORDER BY total DESC, p_brand LIMIT 5)
SELECT g.*, total FROM g JOIN t USING (p_brand)""")
def _(s, d):
    j = table(s, d, "lineitem").select("l_partkey", "l_returnflag", "l_quantity").join(
        table(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    return A.top_categories(j, "p_brand", "l_quantity", "sum", 5, "l_returnflag")


@query("top_with_other", f"""
WITH g AS (SELECT l_suppkey::VARCHAR AS label, sum(l_quantity) AS value FROM lineitem GROUP BY 1),
k AS (SELECT *, row_number() OVER (ORDER BY value DESC, label) rn, count(*) OVER () n FROM g)
SELECT CASE WHEN rn < 8 THEN label ELSE 'Other (' || (n - 7) || ')' END AS label, sum(value) AS value FROM k GROUP BY 1""")
def _(s, d):
    return A.top_with_other(table(s, d, "lineitem"), "l_suppkey", "l_quantity", "sum", 8)


@query("heat_matrix", f"""
SELECT lang, {", ".join(f"{r(f'avg(n_chars) FILTER (source = {chr(39)}src{i}{chr(39)})')} AS src{i}" for i in range(20))} FROM documents GROUP BY lang""")
def _(s, d):
    return A.heat_matrix(table(s, d, "documents"), "source", "lang", "n_chars", "mean", [f"src{i}" for i in range(20)])


@query("kpi", f"""
SELECT {r("sum(value)", 4)} AS value, count(*) AS n,
       (SELECT list(value ORDER BY event_id) FROM (SELECT * FROM events ORDER BY event_id DESC LIMIT 40)) AS spark FROM events""", value=4)
def _(s, d):
    return A.kpi(table(s, d, "events"), "value", "sum", ["event_id"])


@query("frequency_table", f"""
WITH c AS (SELECT coalesce(nullif(source, ''), '(empty)') AS level, count(*) AS count FROM documents GROUP BY 1)
SELECT level, count, {r("100.0 * count / sum(count) OVER ()")} AS pct,
       {r("100.0 * sum(count) OVER (ORDER BY count DESC, level) / sum(count) OVER ()")} AS cum_pct FROM c""")
def _(s, d):
    return A.frequency(table(s, d, "documents"), "source")


@query("profile", f"""
SELECT 'o_totalprice' AS "column", 'num' AS "type", count(o_totalprice) AS n, count(*) - count(o_totalprice) AS missing,
       {r("avg(o_totalprice)", 4)} AS mean, {r("stddev_samp(o_totalprice)", 4)} AS sd, min(o_totalprice) AS min, max(o_totalprice) AS max,
       NULL::BIGINT AS levels FROM orders
UNION ALL SELECT 'o_custkey', 'num', count(o_custkey), 0, {r("avg(o_custkey)", 4)}, {r("stddev_samp(o_custkey)", 4)}, min(o_custkey), max(o_custkey), NULL FROM orders
UNION ALL SELECT 'o_orderstatus', 'cat', count(o_orderstatus), 0, NULL, NULL, NULL, NULL, count(DISTINCT o_orderstatus) FROM orders
UNION ALL SELECT 'o_orderdate', 'date', count(o_orderdate), 0, NULL, NULL, NULL, NULL, count(DISTINCT o_orderdate) FROM orders""", digits=4)
def _(s, d):
    return A.profile(table(s, d, "orders").select("o_totalprice", "o_custkey", "o_orderstatus", "o_orderdate"))


@query("crosstab", """
SELECT o_orderpriority AS row_level, o_orderstatus AS col_level, count(*) AS count FROM orders GROUP BY ALL""")
def _(s, d):
    return A.crosstab(table(s, d, "orders"), "o_orderpriority", "o_orderstatus")


@query("pareto", f"""
WITH g AS (SELECT p_type || ' ' || p_size AS label, sum(l_extendedprice) AS value
           FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
k AS (SELECT *, row_number() OVER (ORDER BY value DESC, label) rn, count(*) OVER () n, sum(value) OVER () total FROM g),
m AS (SELECT least(rn, 12) AS position, CASE WHEN rn < 12 OR n <= 12 THEN label ELSE 'Other (' || (n - 11) || ' items)' END AS label,
             sum(value) AS value, max(total) AS total FROM k GROUP BY 1, 2),
c AS (SELECT *, sum(value) OVER (ORDER BY position) AS cum FROM m)
SELECT position, label, {r("value", 2)} AS value, {r("100 * value / total")} AS pct, {r("100 * cum / total")} AS cum_pct,
       100 * (cum - value) / total < 80 AS vital FROM c""", value=2)
def _(s, d):
    j = table(s, d, "lineitem").select("l_partkey", "l_extendedprice").join(
        table(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.concat_ws(" ", "p_type", "p_size").alias("kind")), "l_partkey")
    return A.pareto(j, "kind", "l_extendedprice")


def scratch(s, kind):
    return f"{checkpoint_folder(s)}/{kind}-{uuid.uuid4().hex}"


@query("delimited_round_trip", """
SELECT o_orderkey::DOUBLE AS o_orderkey, o_orderpriority, round(o_totalprice, 2) + 0.0 AS o_totalprice FROM orders""", digits=2)
def _(s, d):
    path = scratch(s, "csv")
    writers.write_csv(table(s, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), path, ";")
    return readers.read_delimited(s, path, ";", True)


@query("json_round_trip", "SELECT event_id, event_type, value FROM events")
def _(s, d):
    path = scratch(s, "json")
    writers.write_json(table(s, d, "events").select("event_id", "event_type", "value"), path)
    return s.read.schema("event_id bigint, event_type string, value double").json(path)


@query("result_export", "SELECT event_type AS kind, round(max(value), 6)::VARCHAR AS largest FROM events GROUP BY 1")
def _(s, d):
    path = scratch(s, "export")
    top = A.aggregate(table(s, d, "events"), ["event_type"], [("max", "value", "hi")])
    writers.export_result(top, path, {"event_type": "kind", "hi": "largest"})
    return s.read.csv(path, header=True)
