"""Grouping, chart aggregations, frequency tables and Pareto analysis."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import finite, level, ratio
from ..plans.joining import one_row
from ..plans.ordering import prefix, quantiles
from ..plans.session import persist

# name -> (p, quantile type)
QUANTILE_AGGREGATES = {"median": (0.5, 7), "p25": (0.25, 6), "p75": (0.75, 6)}
NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def _plain(agg: str, column: str | None, order_by: Sequence[str], finite_distinct: bool) -> Column:
    if agg == "count":
        return F.count(F.lit(1))
    if agg == "distinct":
        if finite_distinct:
            return F.count_distinct(finite(column))
        return F.count_distinct(F.coalesce(F.col(column).cast("string"), F.lit("null")))
    if agg in ("first", "last"):
        if not order_by:
            raise ValueError(f"{agg} needs order_by")
        return (F.min_by if agg == "first" else F.max_by)(F.col(column), F.struct(*order_by))
    x = finite(column)
    return {
        "sum": lambda: F.sum(x), "mean": lambda: F.avg(x), "min": lambda: F.min(x), "max": lambda: F.max(x),
        "sd": lambda: F.stddev_samp(x), "var": lambda: F.var_samp(x),
        "cv": lambda: 100 * ratio(F.stddev_samp(x), F.avg(x)),
        "range": lambda: F.max(x) - F.min(x), "sumsq": lambda: F.sum(x * x),
    }[agg]()


def aggregate(df: DataFrame, by: Sequence[str] = (), measures: Sequence[tuple[str, str | None, str]] = (),
              order_by: Sequence[str] = (), sort_by: str | None = None, descending: bool = False,
              top: int | None = None, finite_distinct: bool = False) -> DataFrame:
    """Group and aggregate.

    `measures` = [(aggregate, column, alias)] with count, sum, mean, median,
    min, max, sd, var, cv, range, p25, p75, sumsq, distinct, first, last.
    NULL and '' keys are one level; `n` is the row count of each group.
    """
    keyed = df.withColumns({c: level(c) for c in by}) if by else df
    plain = [(a, c, s) for a, c, s in measures if a not in QUANTILE_AGGREGATES]
    out = keyed.groupBy(*by).agg(*[_plain(a, c, order_by, finite_distinct).alias(s) for a, c, s in plain],
                                 F.count(F.lit(1)).alias("n"))
    for column in dict.fromkeys(c for a, c, _ in measures if a in QUANTILE_AGGREGATES):
        wanted = {s: QUANTILE_AGGREGATES[a] for a, c, s in measures if c == column and a in QUANTILE_AGGREGATES}
        q = quantiles(keyed, column, wanted, by).drop("n")
        out = out.join(q, list(by), "left") if by else out.withColumns(one_row(q))
    out = out.select(*by, *[s for _, _, s in measures], "n")
    if sort_by:
        key = F.col(sort_by)
        out = out.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_last(), *by)
    return out.limit(top) if top else out


def chart_aggregate(df: DataFrame, by: Sequence[str], measure: str | None = None, agg: str = "mean") -> DataFrame:
    """One- or two-dimensional chart data: keys, `value` and `n`."""
    agg = agg if measure else "count"
    return aggregate(df, by, [(agg, measure, "value")], finite_distinct=True)


def top_categories(df: DataFrame, x: str, measure: str | None, agg: str, top: int,
                   series: str | None = None, descending: bool = True) -> DataFrame:
    """Chart rows of the N categories with the largest total over the series."""
    rows = chart_aggregate(df, [x] + ([series] if series else []), measure, agg)
    total = F.sum(F.coalesce(F.col("value").cast("double"), F.lit(0.0)))
    best = rows.groupBy(x).agg(total.alias("total"))
    best = best.orderBy(F.col("total").desc() if descending else F.col("total").asc(), x).limit(top)
    return rows.join(best, x)


def top_with_other(df: DataFrame, category: str, measure: str | None, agg: str, top: int) -> DataFrame:
    """First N-1 categories by value; the remainder is summed into one 'Other' row."""
    rows = chart_aggregate(df, [category], measure, agg)
    value = F.coalesce(F.col("value").cast("double"), F.lit(0.0))
    rows = persist(rows.select(F.col(category).alias("label"), value.alias("value")))
    head = rows.orderBy(F.col("value").desc(), "label").limit(top)
    size = rows.agg(F.count(F.lit(1)).alias("_k"))
    kept = head.withColumns(one_row(size)).withColumn("_rn", F.row_number().over(
        Window.partitionBy("_k").orderBy(F.col("value").desc(), "label")))
    kept = kept.where((F.col("_k") <= top) | (F.col("_rn") < top)).select("label", "value")
    rest = (rows.join(kept.select("label"), "label", "left_anti")
            .agg(F.sum("value").alias("value"), F.count(F.lit(1)).alias("_c")).where("_c > 0")
            .select(F.format_string("Other (%d)", F.col("_c")).alias("label"), "value"))
    return kept.unionByName(rest)


def heat_matrix(df: DataFrame, x: str, y: str, measure: str | None, agg: str, columns: Sequence[str] | None = None,
                max_columns: int = 500) -> DataFrame:
    """One row per level of y, one column per level of x."""
    cells = chart_aggregate(df, [x, y], measure, agg)
    if columns is None:
        found = cells.select(x).distinct().limit(max_columns + 1).collect()
        if len(found) > max_columns:
            raise ValueError(f"more than {max_columns} columns: name the ones to keep")
        columns = sorted(r[0] for r in found)
    return cells.groupBy(y).pivot(x, list(columns)).agg(F.first("value"))


def kpi(df: DataFrame, measure: str | None, agg: str, order_by: Sequence[str], tail: int = 40) -> DataFrame:
    """One aggregate, the row count and the last `tail` values in row order."""
    value = aggregate(df, [], [(agg if measure else "count", measure, "value")])
    if not measure:
        return value
    last = (df.where(finite(measure).isNotNull()).select(*order_by, finite(measure).alias("_x"))
            .orderBy(*[F.col(c).desc() for c in order_by]).limit(tail))
    spark_line = last.agg(F.transform(F.array_sort(F.collect_list(F.struct(*order_by, "_x"))),
                                      lambda s: s["_x"]).alias("spark"))
    return value.withColumns(one_row(spark_line))


def frequency(df: DataFrame, column: str) -> DataFrame:
    """Count, % and cumulative % per level, most frequent first."""
    counts = df.groupBy(level(column).alias("level")).agg(F.count(F.lit(1)).alias("count"))
    return _cumulate(counts, "count", "level")


def _cumulate(rows: DataFrame, value: str, label: str) -> DataFrame:
    """pct and cum_pct in descending order of value.

    Levels are few next to rows, but may still be many: the running sum is a
    range-partitioned prefix, not one window.
    """
    out = prefix(rows, [], [F.col(value).desc(), F.col(label)], {"_before": value}, {"_total": value})
    return (out.withColumn("pct", 100 * F.col(value) / F.col("_total"))
            .withColumn("cum_pct", 100 * (F.col("_before") + F.col(value)) / F.col("_total"))
            .drop("_before", "_total"))


def profile(df: DataFrame) -> DataFrame:
    """Per column: type, n, missing, mean, sd, min, max or number of levels."""
    aggs, parts = [F.count(F.lit(1)).alias("_rows")], []
    for i, f in enumerate(df.schema.fields):
        c = F.col("`" + f.name + "`")
        if isinstance(f.dataType, NUMERIC):
            x = finite(c)
            aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), F.stddev_samp(x).alias(f"s{i}"),
                     F.min(x).alias(f"a{i}"), F.max(x).alias(f"b{i}")]
            stats = (F.col(f"m{i}"), F.col(f"s{i}"), F.col(f"a{i}"), F.col(f"b{i}"), F.lit(None).cast("bigint"))
            kind = "num"
        else:
            text = F.nullif(c.cast("string"), F.lit(""))
            aggs += [F.count(text).alias(f"n{i}"), F.count_distinct(level(c)).alias(f"l{i}")]
            null = F.lit(None).cast("double")
            stats = (null, null, null, null, F.col(f"l{i}"))
            kind = "date" if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)) else "cat"
        names = ("mean", "sd", "min", "max", "levels")
        parts.append(F.struct(
            F.lit(f.name).alias("column"), F.lit(kind).alias("type"), F.col(f"n{i}").alias("n"),
            (F.col("_rows") - F.col(f"n{i}")).alias("missing"), *[s.alias(n) for s, n in zip(stats, names)]))
    return df.agg(*aggs).select(F.explode(F.array(*parts)).alias("_p")).select("_p.*")


def crosstab(df: DataFrame, row: str, column: str) -> DataFrame:
    """Counts per (row level, column level), long form."""
    return (df.groupBy(level(row).alias("row_level"), level(column).alias("col_level"))
            .agg(F.count(F.lit(1)).alias("count")))


def pareto(df: DataFrame, category: str, weight: str | None = None, max_categories: int = 12) -> DataFrame:
    """Descending categories with %, cumulative % and the vital-few flag.

    Beyond `max_categories` the tail is merged into one row.
    """
    w = finite(weight) if weight else F.lit(1.0)
    items = (df.groupBy(level(category).alias("label")).agg(F.sum(w).alias("value"))
             .where(F.col("value") > 0))
    items = persist(items)
    head = items.orderBy(F.col("value").desc(), "label").limit(max_categories)
    totals = items.agg(F.sum("value").alias("_total"), F.count(F.lit(1)).alias("_k"))
    order = Window.partitionBy("_k").orderBy(F.col("value").desc(), "label")
    ranked = head.withColumns(one_row(totals)).withColumn("position", F.row_number().over(order))
    keep = (F.col("_k") <= max_categories) | (F.col("position") < max_categories)
    run = F.sum("value").over(order.rowsBetween(Window.unboundedPreceding, 0))
    kept = ranked.withColumn("_cum", run)
    # the last kept slot becomes the merged tail: what the head before it leaves over
    before = F.coalesce(F.lag("_cum").over(order), F.lit(0.0))
    rows = kept.withColumn("_before", before).select(
        "position", "_total",
        F.when(keep, F.col("label")).otherwise(
            F.format_string("Other (%d items)", F.col("_k") - max_categories + 1)).alias("label"),
        F.when(keep, F.col("value")).otherwise(F.col("_total") - F.col("_before")).alias("value"), "_before")
    return rows.select(
        F.col("position").cast("bigint").alias("position"), "label", "value",
        (100 * F.col("value") / F.col("_total")).alias("pct"),
        (100 * (F.col("_before") + F.col("value")) / F.col("_total")).alias("cum_pct"),
        (100 * F.col("_before") / F.col("_total") < 80).alias("vital"))
