"""Ordered work without one task per series.

A window partitioned by a series key alone would send a whole series, however
long, to one task.  Here a series is cut into bounded pieces first:

* `prefix` / `sequence`: range-partition on (keys, order), number the rows
  inside each range, add the totals of the earlier ranges.
* `blocks`: cut a numbered series into equal blocks; each block also receives
  copies of the few neighbouring rows a bounded frame needs.
* `value_order`: compress equal values to frequencies, then prefix them, which
  gives ranks, quantiles and empirical distribution functions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import finite
from .joining import attach
from .session import BLOCK_ROWS, SKETCH_FROM, persist, setting

DEFAULT_BLOCK_ROWS = 131_072
DEFAULT_SKETCH_FROM = 5_000_000  # below this many rows one full ordering is cheaper than two scans
SKETCH_ACCURACY = 2000  # rank error of a sketch quantile: at most n / 2000
SKETCH_MARGIN = 0.002  # half width of the bracket around a quantile
SKETCH_ROWS = 4000  # from here on the bracket is wider than the error plus the neighbouring ranks
SLOT_BITS = 33  # monotonically_increasing_id keeps the partition above these bits


def _ranges(df: DataFrame, by: Sequence[str], order_by: Sequence[str | Column]) -> DataFrame:
    """Rows in range partitions; `_at` = partition and position in it.

    The number of ranges is the session's shuffle partitions; adaptive execution
    may merge neighbouring ranges of a small table, which keeps their order.
    """
    keys = [F.col(c) for c in by] + [F.col(c) if isinstance(c, str) else c for c in order_by]
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return persist(ranged.withColumn("_at", F.monotonically_increasing_id()))


def _slot() -> Column:
    return F.shiftright(F.col("_at"), SLOT_BITS)


def sequence(df: DataFrame, by: Sequence[str], order_by: Sequence[str | Column],
             name: str = "rn", total: str | None = None) -> DataFrame:
    """1-based position of each row inside its `by` group."""
    by = list(by)
    ranged = _ranges(df, by, order_by).withColumn("_slot", _slot())
    heads = ranged.groupBy(*by, "_slot").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    group = Window.partitionBy(*(by or [F.lit(0)]))
    before = group.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select(
        *by, "_slot", "_first",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_base"),
        *([F.sum("_rows").over(group).alias(total)] if total else []),
    )
    out = attach(ranged, heads, [*by, "_slot"])
    out = out.withColumn(name, F.col("_at") - F.col("_first") + F.col("_base") + 1)
    return out.drop("_at", "_slot", "_first", "_base")


def prefix(df: DataFrame, by: Sequence[str], order_by: Sequence[str | Column],
           sums: Mapping[str, str], totals: Mapping[str, str] | None = None) -> DataFrame:
    """Running sums.  `sums` = {new column: summed column}, exclusive of the row itself;
    `totals` = {new column: summed column} over the whole group."""
    by = list(by)
    totals = dict(totals or {})
    ranged = _ranges(df, by, order_by).withColumn("_slot", _slot())
    cols = sorted(set(sums.values()) | set(totals.values()))
    heads = ranged.groupBy(*by, "_slot").agg(*[F.sum(c).alias("_s_" + c) for c in cols])
    group = Window.partitionBy(*(by or [F.lit(0)]))
    before = group.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select(
        *by, "_slot",
        *[F.sum("_s_" + c).over(before).alias("_b_" + c) for c in set(sums.values())],
        *[F.sum("_s_" + c).over(group).alias(t) for t, c in totals.items()],
    )
    out = attach(ranged, heads, [*by, "_slot"])
    local = Window.partitionBy(*by, "_slot").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    for new, c in sums.items():
        zero = F.lit(0).cast(df.schema[c].dataType)
        out = out.withColumn(new, F.coalesce(F.sum(c).over(local), zero) + F.coalesce(F.col("_b_" + c), zero))
    return out.drop("_at", "_slot", *["_b_" + c for c in set(sums.values())])


def block_size(df: DataFrame, least: int = 1) -> int:
    return max(setting(df.sparkSession, BLOCK_ROWS, DEFAULT_BLOCK_ROWS), least)


def blocks(numbered: DataFrame, rn: str = "rn", before: int = 0, after: int = 0,
           size: int | None = None) -> DataFrame:
    """Assign numbered rows to blocks of `size` rows.

    A row also goes to the next block when it is one of the last `before` rows
    of its own, and to the previous one when it is one of the first `after`.
    Adds `_block` and `_own` (False for the neighbour copies).
    """
    size = block_size(numbered, max(before, after, 1)) if size is None else size
    pos = F.col(rn) - 1
    home = F.floor(pos / size)
    at = pos - home * size
    if not before and not after:
        return numbered.withColumn("_block", home).withColumn("_own", F.lit(True))
    targets = F.array_compact(F.array(
        home,
        F.when(at >= size - before, home + 1) if before else F.lit(None).cast("bigint"),
        F.when((at < after) & (home > 0), home - 1) if after else F.lit(None).cast("bigint"),
    ))
    return (
        numbered.withColumn("_home", home)
        .withColumn("_block", F.explode(targets))
        .withColumn("_own", F.col("_block") == F.col("_home"))
        .drop("_home")
    )


def block_window(by: Sequence[str], rn: str = "rn"):
    return Window.partitionBy(*by, "_block").orderBy(rn)


def value_order(df: DataFrame, value: str, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """One row per distinct finite value: `freq`, `below` (observations smaller), `n`."""
    by = list(by)
    x = df.select(*by, finite(value).alias(value), *([weight] if weight else [])).where(F.col(value).isNotNull())
    x = x.withColumn(value, F.when(F.col(value) == 0, F.lit(0.0)).otherwise(F.col(value)))
    freq = x.groupBy(*by, value).agg(
        (F.sum(weight) if weight else F.count(F.lit(1))).cast("bigint").alias("freq"))
    return prefix(freq, by, [value], {"below": "freq"}, {"n": "freq"})


def value_at(rank: Column, value: str) -> Column:
    """Aggregate over `value_order` rows: the value at a 1-based rank."""
    return F.max(F.when((F.col("below") < rank) & (rank <= F.col("below") + F.col("freq")), F.col(value)))


def quantile_bounds(p: float, kind: int, n: Column) -> tuple[Column, Column, Column]:
    """Lower rank, upper rank and weight of a type-6 or type-7 quantile."""
    h = (n + 1) * F.lit(float(p)) if kind == 6 else (n - 1) * F.lit(float(p)) + 1
    h = F.greatest(F.lit(1.0), F.least(h, n.cast("double")))
    low = F.floor(h)
    return low, F.least(low + 1, n), h - low


def quantile_columns(value: str, wanted: Mapping[str, tuple[float, int]]) -> tuple[list[Column], list[Column]]:
    """Aggregates over `value_order` rows, then the columns that interpolate them."""
    n = F.col("n")
    aggs, outs = [], []
    for name, (p, kind) in wanted.items():
        low, high, w = quantile_bounds(p, kind, n)
        aggs += [value_at(low, value).alias(f"_{name}_l"), value_at(high, value).alias(f"_{name}_h")]
        w_out = quantile_bounds(p, kind, F.col("n"))[2]
        outs.append((F.col(f"_{name}_l") + w_out * (F.col(f"_{name}_h") - F.col(f"_{name}_l"))).alias(name))
    return aggs, outs


def quantiles(df: DataFrame, value: str, wanted: Mapping[str, tuple[float, int]], by: Sequence[str] = (),
              weight: str | None = None, ordered: DataFrame | None = None) -> DataFrame:
    """Exact grouped quantiles: `wanted` = {column: (p, type 6 or 7)}; also returns `n`."""
    if ordered is None and weight is None and df.count() >= setting(df.sparkSession, SKETCH_FROM, DEFAULT_SKETCH_FROM):
        found = _bracketed_quantiles(df, value, wanted, by)
        if found is not None:
            return found
    ordered = value_order(df, value, by, weight) if ordered is None else ordered
    aggs, outs = quantile_columns(value, wanted)
    picked = ordered.groupBy(*by).agg(F.max("n").alias("n"), *aggs)
    return picked.select(*by, "n", *outs)


def _bracketed_quantiles(df: DataFrame, value: str, wanted: Mapping[str, tuple[float, int]],
                         by: Sequence[str]) -> DataFrame | None:
    """Exact quantiles of large groups without ordering the table.

    A mergeable sketch brackets every quantile; a second pass counts the rows
    below each bracket and keeps only the values inside it (about 0.4 % of the
    rows), which are then ordered exactly.  None when most rows are in small
    groups, or when a bracket missed its rank: the caller orders all values.
    """
    by = list(by)
    x = df.select(*by, finite(value).alias("_x")).where("_x is not null")
    x = x.withColumn("_x", F.when(F.col("_x") == 0, F.lit(0.0)).otherwise(F.col("_x")))
    edges = [min(1.0, max(0.0, p + d)) for p, _ in wanted.values() for d in (-SKETCH_MARGIN, SKETCH_MARGIN)]
    sketch = persist(x.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.percentile_approx("_x", F.array(*[F.lit(e) for e in edges]), SKETCH_ACCURACY).alias("_q")))
    sizes = sketch.agg(F.sum("n").alias("all"), F.sum(F.when(F.col("n") >= SKETCH_ROWS, F.col("n"))).alias("large")).first()
    if not sizes["all"] or (sizes["large"] or 0) < sizes["all"] / 2:
        return None
    rows = attach(x, sketch.withColumn("_q", F.when(F.col("n") >= SKETCH_ROWS, F.col("_q"))), by, ready=True)
    v = F.col("_x")
    marks = []
    for k in range(len(wanted)):
        lo, hi = F.get("_q", F.lit(2 * k)), F.get("_q", F.lit(2 * k + 1))
        inside = (lo.isNull() | (v >= lo)) & (hi.isNull() | (v <= hi))
        below = F.struct(F.lit(k).alias("k"), F.lit(None).cast("double").alias("v"))
        marks.append(F.when(v < lo, below).when(inside, F.struct(F.lit(k).alias("k"), v.alias("v"))))
    rows = rows.select(*by, F.explode(F.array_compact(F.array(*marks))).alias("_m")).select(*by, "_m.k", "_m.v")
    # everything below a bracket falls into one NULL cell, which sorts first
    cells = rows.groupBy(*by, "k", "v").agg(F.count(F.lit(1)).alias("freq"))
    order = attach(prefix(cells, [*by, "k"], ["v"], {"below": "freq"}), sketch.select(*by, "n"), by)
    aggs, outs = [], []
    for k, (name, (p, kind)) in enumerate(wanted.items()):
        low, high, w = quantile_bounds(p, kind, F.col("n"))
        here = (F.col("k") == k) & F.col("v").isNotNull()
        for side, rank in (("l", low), ("h", high)):
            hit = here & (F.col("below") < rank) & (rank <= F.col("below") + F.col("freq"))
            aggs.append(F.max(F.when(hit, F.col("v"))).alias(f"_{name}_{side}"))
        outs.append((F.col(f"_{name}_l") + w * (F.col(f"_{name}_h") - F.col(f"_{name}_l"))).alias(name))
    picked = persist(order.groupBy(*by).agg(F.max("n").alias("n"), *aggs).select(*by, "n", *outs))
    missed = [F.col(name).isNull() for name in wanted]
    any_missed = missed[0]
    for m in missed[1:]:
        any_missed = any_missed | m
    return None if picked.where(any_missed).limit(1).count() else picked


def ranks(df: DataFrame, value: str, by: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """Distinct values with their average rank `name` and tie size `freq`."""
    order = value_order(df, value, by)
    return order.withColumn(name, F.col("below") + (F.col("freq") + 1) / 2)
