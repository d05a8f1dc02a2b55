"""Sinks: delimited text, JSON, and chosen columns of a result."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, delimiter: str = ",", mode: str = "error") -> None:
    """Minimal quoting, doubled quotes, NULL as an empty field; one file per partition."""
    df.write.mode(mode).csv(path, sep=delimiter, header=True, quote='"', escape='"', nullValue="", emptyValue="")


def write_json(df: DataFrame, path: str, mode: str = "error") -> None:
    """One object per row."""
    df.write.mode(mode).json(path, ignoreNullFields=False)


def export_result(df: DataFrame, path: str, columns: Sequence[str] | Mapping[str, str], delimiter: str = ",",
                  mode: str = "error") -> None:
    """Chosen columns, optionally renamed ({column: title}); arrays become text."""
    titles = columns if isinstance(columns, Mapping) else {c: c for c in columns}
    arrays = {c for c, t in df.dtypes if t.startswith("array")}
    cells = [(F.concat_ws(" ", F.col(c).cast("array<string>")) if c in arrays else F.col(c)).alias(t)
             for c, t in titles.items()]
    write_csv(df.select(*cells), path, delimiter, mode)
