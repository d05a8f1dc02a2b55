"""Joining per-group results back to rows, with a checked broadcast."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .session import BROADCAST_ROWS, persist, setting

DEFAULT_BROADCAST_ROWS = 500_000


def attach(big: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "inner",
           ready: bool = False) -> DataFrame:
    """Join `small` (one row per key) to `big` on NULL-safe keys.

    `small` is materialised once and counted.  Up to the row bound it is
    broadcast, so `big` is not shuffled; beyond the bound the join is left to
    Spark (sort-merge, with adaptive skew splitting).
    """
    if not keys:
        return big.withColumns(one_row(small))
    if not ready:
        small = persist(small)
    limit = setting(big.sparkSession, BROADCAST_ROWS, DEFAULT_BROADCAST_ROWS)
    fits = small.limit(limit + 1).count() <= limit
    side = small.select(*[F.col(k).alias("_r_" + k) for k in keys],
                        *[c for c in small.columns if c not in keys])
    if fits:
        side = F.broadcast(side)
    cond = reduce(and_, [F.col(k).eqNullSafe(F.col("_r_" + k)) for k in keys])
    return big.join(side, cond, how).drop(*["_r_" + k for k in keys])


def one_row(totals: DataFrame) -> dict[str, Column]:
    """The columns of a one-row aggregate as typed literals."""
    row = totals.first()
    return {f.name: _literal(None if row is None else row[f.name], f.dataType) for f in totals.schema.fields}


def _literal(value, kind: T.DataType) -> Column:
    if value is not None and isinstance(kind, T.ArrayType):
        return F.array(*[_literal(v, kind.elementType) for v in value]).cast(kind)
    if value is not None and isinstance(kind, T.StructType):
        return F.struct(*[_literal(value[f.name], f.dataType).alias(f.name) for f in kind.fields])
    return F.lit(value).cast(kind)
