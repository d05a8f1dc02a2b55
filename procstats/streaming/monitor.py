"""Phase-II monitoring: points of a running stream against limits frozen from a batch chart.

Every tumbling window is one subgroup.  Windows close at the watermark, so the
state is bounded by the open windows per series; later rows are dropped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import by_size, d2, d3
from ..functions.numeric import finite, ratio
from ..operators import control


def freeze_limits(df: DataFrame, value: str, order_by: Sequence[str], by: Sequence[str], size: int = 5) -> DataFrame:
    """Centre and within sigma per series from history (by..., center, sigma_within)."""
    groups = control.subgroups(df, value, order_by, by, size)
    centre = groups.groupBy(*by).agg((F.sum(F.col("mean") * F.col("n")) / F.sum("n")).alias("center"))
    sigma = control.sigma_within(groups, "rbar", by).withColumnRenamed("sigma", "sigma_within")
    return centre.join(sigma, list(by))


def _windows(stream: DataFrame, time: str, window: str, delay: str, by: Sequence[str]):
    return stream.withWatermark(time, delay).groupBy(F.window(time, window).alias("window"), *by)


def _flag(value: Column, centre: Column, sigma: Column) -> Column:
    return F.array_compact(F.array(F.when(F.abs(ratio(value - centre, sigma)) > 3, 1))).cast("array<int>")


def xbar_stream(stream: DataFrame, value: str, time: str, limits: DataFrame, by: Sequence[str], window: str = "1 hour",
                delay: str = "10 minutes") -> DataFrame:
    """Mean and range of every closed window with frozen limits."""
    x = finite(value)
    g = _windows(stream.where(x.isNotNull()), time, window, delay, by).agg(
        F.count(x).alias("n"), F.avg(x).alias("value"), (F.max(x) - F.min(x)).alias("range"))
    g = g.join(limits, list(by))
    se = F.col("sigma_within") / F.sqrt("n")
    r, spread = by_size(d2, F.col("n")) * F.col("sigma_within"), by_size(d3, F.col("n")) * F.col("sigma_within")
    return g.select(*by, F.col("window.start").alias("start"), "n", "value", F.col("center").alias("cl"), (F.col("center") + 3 * se).alias("ucl"),
                    (F.col("center") - 3 * se).alias("lcl"), "range", (r + 3 * spread).alias("range_ucl"),
                    _flag(F.col("value"), F.col("center"), se).alias("violations"))


def proportion_stream(stream: DataFrame, defect: Column, time: str, target: float, by: Sequence[str] = (), window: str = "1 day",
                      delay: str = "1 hour") -> DataFrame:
    """p-chart points of every closed window against a frozen proportion."""
    g = _windows(stream, time, window, delay, by).agg(F.count(F.lit(1)).alias("n"), F.count_if(defect).alias("count"))
    sd = F.sqrt(F.lit(target * (1 - target)) / F.col("n"))
    p = F.col("count") / F.col("n")
    return g.select(*by, F.col("window.start").alias("start"), "n", "count", p.alias("value"), F.lit(target).alias("cl"),
                    F.least(F.lit(1.0), target + 3 * sd).alias("ucl"), F.greatest(F.lit(0.0), target - 3 * sd).alias("lcl"),
                    _flag(p, F.lit(target), sd).alias("violations"))


def rate_stream(stream: DataFrame, count: str, time: str, target: float, by: Sequence[str] = (), window: str = "1 day",
                delay: str = "1 hour") -> DataFrame:
    """u-chart points of every closed window against a frozen rate (units = rows)."""
    g = _windows(stream, time, window, delay, by).agg(F.count(F.lit(1)).alias("n"), F.sum(count).cast("double").alias("count"))
    sd = F.sqrt(F.lit(target) / F.col("n"))
    u = F.col("count") / F.col("n")
    return g.select(*by, F.col("window.start").alias("start"), "n", "count", u.alias("value"), F.lit(target).alias("cl"),
                    (target + 3 * sd).alias("ucl"), F.greatest(F.lit(0.0), target - 3 * sd).alias("lcl"), _flag(u, F.lit(target), sd).alias("violations"))
