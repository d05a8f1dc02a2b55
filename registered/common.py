"""Helpers of the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tidy(df: DataFrame, digits: int = 6, **own: int) -> DataFrame:
    """Round doubles so that summation order cannot change the comparison."""
    cols: list[Column] = []
    for f in df.schema.fields:
        c = F.col("`" + f.name + "`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), own.get(f.name, digits)) + 0.0
        cols.append(c.alias(f.name))
    return df.select(*cols)


def r(expr: str, digits: int = 6) -> str:
    """The same rounding in SQL."""
    return f"round(({expr})::DOUBLE, {digits}) + 0.0"



def q6(x: str, p: float) -> str:
    """Type-6 quantile of an aggregated column in DuckDB SQL."""
    s, n = f"list_sort(list({x}))", f"count({x})"
    h = f"greatest(1.0, least(({n} + 1) * {p}, {n}))"
    return (f"({s}[floor({h})::BIGINT] + ({h} - floor({h})) * "
            f"({s}[least(floor({h})::BIGINT + 1, {n})] - {s}[floor({h})::BIGINT]))")


def q7(x: str, p: float) -> str:
    return f"quantile_cont({x}, {p})"


def registry():
    """A dictionary of queries and the decorator that fills it."""
    found: dict = {}

    def query(name: str, sql: str | None = None, **digits: int):
        def add(fn):
            found[name] = (lambda spark, folder: tidy(fn(spark, folder), **digits), sql)
            return fn
        return add

    return found, query


def phi(z: str) -> str:
    """Normal cdf of a plain SQL column (Hart's approximation, fixed values)."""
    num = ("((((((3.52624965998911e-2*abs({z})+0.700383064443688)*abs({z})+6.37396220353165)*abs({z})+33.912866078383)*abs({z})"
           "+112.079291497871)*abs({z})+221.213596169931)*abs({z})+220.206867912376)")
    den = ("(((((((8.83883476483184e-2*abs({z})+1.75566716318264)*abs({z})+16.064177579207)*abs({z})+86.7807322029461)*abs({z})"
           "+296.564248779674)*abs({z})+637.333633378831)*abs({z})+793.826512519948)*abs({z})+440.413735824752)")
    frac = "(abs({z})+1.0/(abs({z})+2.0/(abs({z})+3.0/(abs({z})+4.0/(abs({z})+0.65)))))"
    tail = (f"(CASE WHEN abs({{z}})<7.07106781186547 THEN exp(-{{z}}*{{z}}/2)*{num}/{den} WHEN abs({{z}})<=37 "
            f"THEN exp(-{{z}}*{{z}}/2)/{frac}/sqrt(2*pi()) ELSE 0.0 END)")
    return f"(CASE WHEN {{z}}>0 THEN 1-{tail} ELSE {tail} END)".replace("{z}", z)
