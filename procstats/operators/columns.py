"""Derived columns: formulas, whole-column statistics, bins, lags, ranks, recoding."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.normal import norm_cdf, with_norm_ppf
from ..functions.numeric import finite, ratio, to_number
from ..plans.joining import attach
from ..plans.ordering import block_window, blocks, quantiles, ranks, sequence


def derive(df: DataFrame, name: str, formula: str | Column) -> DataFrame:
    """Add a formula column (Spark SQL text).  Non-finite numbers become NULL."""
    out = df.withColumn(name, F.expr(formula) if isinstance(formula, str) else formula)
    if isinstance(out.schema[name].dataType, (T.DoubleType, T.FloatType)):
        out = out.withColumn(name, finite(name))
    return out


def row_position(df: DataFrame, order_by: Sequence[str], by: Sequence[str] = (),
                 name: str = "row", total: str = "n_rows") -> DataFrame:
    """ROW() and N(): 1-based position and row count, numbered range by range."""
    return sequence(df, by, order_by, name, total)


def column_statistics(df: DataFrame, stats: Mapping[str, tuple[str, str]], by: Sequence[str] = ()) -> DataFrame:
    """Attach MEAN/SD/SUM/MEDIAN/MIN/MAX/COUNT of a column to every row.

    `stats` = {new column: (statistic, column)}.
    """
    simple = {"mean": F.avg, "sd": F.stddev_samp, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count}
    aggs = [simple[s](finite(c)).alias(a) for a, (s, c) in stats.items() if s != "median"]
    out = attach(df, df.groupBy(*by).agg(*aggs), by) if aggs else df
    for a, (s, c) in stats.items():
        if s == "median":
            out = attach(out, quantiles(df, c, {a: (0.5, 7)}, by).drop("n"), by, how="left")
    return out


def lag(df: DataFrame, column: str, k: int, order_by: Sequence[str], by: Sequence[str] = (),
        name: str | None = None) -> DataFrame:
    """Value k rows earlier in the series."""
    rows = blocks(sequence(df, by, order_by, "_rn"), "_rn", before=k)
    rows = rows.withColumn(name or f"{column}_lag{k}", F.lag(column, k).over(block_window(by, "_rn")))
    return rows.where("_own").drop("_rn", "_block", "_own")


def difference(df: DataFrame, column: str, k: int, order_by: Sequence[str], by: Sequence[str] = (),
               name: str | None = None) -> DataFrame:
    """Value minus the value k rows earlier."""
    name = name or f"d{k}_{column}"
    out = lag(df, column, k, order_by, by, "_lagged")
    return out.withColumn(name, finite(column) - finite("_lagged")).drop("_lagged")


def normal_scores(df: DataFrame, z: str | None = None, p: str | None = None) -> DataFrame:
    """NORMSDIST of column `z` and/or NORMSINV of column `p`."""
    if z:
        df = df.withColumn("_z", finite(z)).withColumn(f"normsdist_{z}", norm_cdf(F.col("_z"))).drop("_z")
    if p:
        df = with_norm_ppf(df, f"normsinv_{p}", finite(p))
    return df


def random_columns(df: DataFrame, uniform: str | None = None, normal: str | None = None,
                   seed: int = 20250917) -> DataFrame:
    if uniform:
        df = df.withColumn(uniform, F.rand(seed))
    if normal:
        df = df.withColumn(normal, F.randn(seed))
    return df


def standardize(df: DataFrame, column: str, name: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(x - mean) / sd rounded to 8 digits; missing stays missing."""
    x = finite(column)
    stats = df.groupBy(*by).agg(F.avg(x).alias("_m"), F.stddev_samp(x).alias("_s"))
    out = attach(df, stats, by)
    return out.withColumn(name or f"z_{column}", F.round(ratio(x - F.col("_m"), F.col("_s")), 8)).drop("_m", "_s")


def bin_equal(df: DataFrame, column: str, k: int, name: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """k equal-width classes labelled 'lo - hi'; the last class is closed."""
    x = finite(column)
    out = attach(df, df.groupBy(*by).agg(F.min(x).alias("_lo"), F.max(x).alias("_hi")), by)
    w = (F.col("_hi") - F.col("_lo")) / k
    idx = F.least(F.lit(k - 1), F.coalesce(F.floor(ratio(x - F.col("_lo"), w)), F.lit(0)))
    label = F.format_string("%.3f - %.3f", F.col("_lo") + idx * w, F.col("_lo") + (idx + 1) * w)
    return out.withColumn(name or f"{column}_class", F.when(x.isNotNull(), label)).drop("_lo", "_hi")


def bin_quantile(df: DataFrame, column: str, k: int, name: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """k classes Q1..Qk cut at the type-7 quantiles i/k."""
    x = finite(column)
    cuts = quantiles(df, column, {f"_q{i}": (i / k, 7) for i in range(1, k)}, by).drop("n")
    out = attach(df, cuts, by, how="left")
    label = F.lit(f"Q{k}")
    for i in range(k - 1, 0, -1):
        label = F.when(x <= F.col(f"_q{i}"), f"Q{i}").otherwise(label)
    return (out.withColumn(name or f"{column}_class", F.when(x.isNotNull(), label))
            .drop(*[f"_q{i}" for i in range(1, k)]))


def recode(df: DataFrame, column: str, mapping: Mapping[str, str] | DataFrame, name: str | None = None) -> DataFrame:
    """Replace category values; unmapped values pass through.

    A mapping table has columns (value, label) and is joined.
    """
    name = name or column
    text = F.col(column).cast("string")
    if isinstance(mapping, DataFrame):
        side = mapping.select(F.col("value").cast("string").alias("_v"), F.col("label").alias("_label"))
        out = attach(df.withColumn("_v", text), side, ["_v"], how="left")
        return out.withColumn(name, F.coalesce("_label", "_v")).drop("_v", "_label")
    pairs = F.create_map(*[F.lit(v) for kv in mapping.items() for v in kv])
    return df.withColumn(name, F.coalesce(F.element_at(pairs, text), text))


def average_rank(df: DataFrame, column: str, by: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """Mean rank over ties and tie-group size for every row."""
    table = ranks(df, column, by, "_rank").select(*by, F.col(column).alias("_x"), "_rank", F.col("freq").alias("tie_size"))
    x = F.when(finite(column) == 0, F.lit(0.0)).otherwise(finite(column))
    out = attach(df.withColumn("_x", x), table, [*by, "_x"], how="left")
    return out.withColumnRenamed("_rank", name).drop("_x")


def retype(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Switch columns to 'num', 'cat' or 'date'; unparsable cells become NULL."""
    for c, kind in types.items():
        if kind == "num":
            df = df.withColumn(c, to_number(c))
        elif kind == "date":
            df = df.withColumn(c, F.try_to_timestamp(F.col(c).cast("string")))
        else:
            df = df.withColumn(c, F.col(c).cast("string"))
    return df


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename columns; a taken name gets the suffix _2, _3, ..."""
    taken = [c for c in df.columns if c not in names]
    for old, new in names.items():
        df = df.withColumnRenamed(old, unique_name(new, taken))
        taken.append(unique_name(new, taken))
    return df


def unique_name(name: str, taken: Sequence[str]) -> str:
    out, k = name, 2
    while out in taken:
        out, k = f"{name}_{k}", k + 1
    return out


def drop_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*columns)
