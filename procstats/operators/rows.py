"""Row operators: filters, slicers, sorting, sampling, duplicates, stacking."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import finite, level
from ..plans.joining import attach
from ..plans.ordering import sequence


def filter_rows(df: DataFrame, condition: str | Column) -> DataFrame:
    """SQL three-valued logic: a missing operand drops the row."""
    return df.where(F.expr(condition) if isinstance(condition, str) else condition)


def slice_rows(df: DataFrame, values: Mapping[str, Sequence[str]] | None = None,
               ranges: Mapping[str, tuple[float | None, float | None]] | None = None) -> DataFrame:
    """Value lists per category and min/max per number, all ANDed."""
    for c, keep in (values or {}).items():
        df = df.where(level(c).isin(list(keep)))
    for c, (lo, hi) in (ranges or {}).items():
        if lo is not None:
            df = df.where(F.col(c) >= lo)
        if hi is not None:
            df = df.where(F.col(c) <= hi)
    return df


def sort_rows(df: DataFrame, column: str, order_by: Sequence[str], descending: bool = False) -> DataFrame:
    """Missing last in both directions; ties keep the `order_by` order."""
    key = F.col(column).desc_nulls_last() if descending else F.col(column).asc_nulls_last()
    return df.orderBy(key, *order_by)


def levels(df: DataFrame, column: str) -> DataFrame:
    """Distinct levels in numeric-aware order."""
    distinct = df.select(level(column).alias("level")).distinct()
    return distinct.orderBy(F.col("level").try_cast("double").asc_nulls_last(), "level")


def keep_rows(df: DataFrame, ids: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.join(ids.select(*key), list(key), "left_semi")


def remove_rows(df: DataFrame, ids: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.join(ids.select(*key), list(key), "left_anti")


def append_rows(df: DataFrame, more: DataFrame) -> DataFrame:
    """Columns are matched by name; absent ones are NULL."""
    return df.unionByName(more, allowMissingColumns=True)


def sample_rows(df: DataFrame, k: int, order_by: Sequence[str], seed: int = 1) -> DataFrame:
    """Exactly k rows without replacement, back in the original order.

    The draw key is a hash of the row key and the seed, so a retried task
    draws the same rows; `limit` keeps at most k rows per task.
    """
    draw = F.xxhash64(F.lit(seed), *order_by)
    return df.withColumn("_draw", draw).orderBy("_draw", *order_by).limit(k).drop("_draw").orderBy(*order_by)


def drop_duplicate_rows(df: DataFrame, order_by: Sequence[str], key: Sequence[str] | None = None) -> DataFrame:
    """Keep the first row (in `order_by`) of every set of rows equal on `key`.

    Partial aggregation keeps one candidate per key and task, so a key with
    many copies never meets in one task.
    """
    key = list(key) if key is not None else [c for c in df.columns if c not in order_by]
    order = F.struct(*order_by)
    rest = [c for c in df.columns if c not in key]
    first = df.groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("_row"))
    return first.select(*key, "_row.*").select(*df.columns)


def drop_empty_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Remove rows whose cells (blank counts as missing) are all missing."""
    cells = [F.nullif(F.trim(F.col(c).cast("string")), F.lit("")).isNotNull() for c in columns or df.columns]
    keep = cells[0]
    for c in cells[1:]:
        keep = keep | c
    return df.where(keep)


def complete_cases(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows that are finite in every chosen column."""
    for c in columns:
        df = df.where(finite(c).isNotNull())
    return df


def stack(df: DataFrame, columns: Sequence[str], value_name: str = "value", group_name: str = "group") -> DataFrame:
    """Wide to long; the other columns are carried."""
    ids = [c for c in df.columns if c not in columns]
    return df.unpivot(ids, list(columns), group_name, value_name)


def unstack(df: DataFrame, value: str, group: str, order_by: Sequence[str],
            group_levels: Sequence[str] | None = None, max_levels: int = 1000) -> DataFrame:
    """Long to wide by position: the i-th finite value of each level lands on row i."""
    x = df.select(level(group).alias("_g"), finite(value).alias("_v"), *[F.col(c).alias(f"_o_{c}") for c in order_by])
    x = sequence(x.where(F.col("_v").isNotNull()), ["_g"], [f"_o_{c}" for c in order_by], "row")
    if group_levels is None:
        found = x.select("_g").distinct().limit(max_levels + 1).collect()
        if len(found) > max_levels:
            raise ValueError(f"more than {max_levels} levels: name the ones to keep")
        group_levels = sorted(r["_g"] for r in found)
    wide = x.groupBy("row").agg(*[
        F.max(F.when(F.col("_g") == g, F.col("_v"))).alias(f"{value}_{g}") for g in group_levels])
    return wide


def attach_standard(df: DataFrame, standard: DataFrame, key: Sequence[str]) -> DataFrame:
    """Look a per-item value up (left join, broadcast only when small)."""
    return attach(df, standard, key, how="left")
