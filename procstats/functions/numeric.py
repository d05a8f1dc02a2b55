"""Column-level helpers shared by every operator."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EMPTY_LEVEL = "(empty)"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: str | Column) -> Column:
    """NULL for NaN and infinities, the value otherwise."""
    c = col(c).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def level(c: str | Column) -> Column:
    """Group key: NULL and '' share one level."""
    text = col(c).cast("string")
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(EMPTY_LEVEL))


def to_number(c: str | Column) -> Column:
    """Locale-aware numeric cast: '2,5' -> 2.5, '1.234,5' -> 1234.5, junk -> NULL.

    With a comma present the dots are thousands separators.
    """
    text = F.trim(col(c).cast("string"))
    plain = F.when(
        F.contains(text, F.lit(",")),
        F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit(","), F.lit(".")),
    ).otherwise(text)
    numeric = F.when(F.rlike(plain, F.lit(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")), plain)
    return finite(numeric.try_cast("double"))


def ratio(a: Column, b: Column) -> Column:
    """a / b with NULL for a zero denominator (ANSI mode raises otherwise)."""
    return a / F.nullif(b.cast("double"), F.lit(0.0))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
