"""Readers: delimited text, JSON in three shapes, records, type inference."""

from __future__ import annotations

import statistics
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import to_number
from ..operators.columns import unique_name

SEPARATORS = ["\t", ";", ",", "|"]
SNIFF_LINES = 12


def sniff_separator(lines: Sequence[str]) -> str:
    """Separator with the most, and most regular, fields per line."""
    best, best_score = ",", float("-inf")
    for sep in SEPARATORS:
        widths = [_fields(line, sep) for line in lines if line.strip()]
        if not widths or statistics.mean(widths) < 2:
            continue
        score = statistics.mean(widths) - 2 * statistics.pvariance(widths)
        if score > best_score:
            best, best_score = sep, score
    return best


def _fields(line: str, sep: str) -> int:
    return "".join(line.split('"')[::2]).count(sep) + 1


def _is_number(text: str | None) -> bool:
    try:
        float((text or "").strip().replace(",", "."))
        return True
    except ValueError:
        return False


def read_delimited(spark: SparkSession, path: str, delimiter: str | None = None, header: bool | None = None,
                   infer: bool = True, multi_line: bool = False) -> DataFrame:
    """CSV/TSV/TXT with quotes, doubled quotes, newlines inside quotes and a BOM.

    The separator and the header are guessed from the first lines when not given.
    One large file is split over many tasks; files with newlines inside quotes need
    `multi_line`, which gives a file to one task.
    """
    if delimiter is None or header is None:
        first = [r[0].lstrip("﻿") for r in spark.read.text(path).limit(SNIFF_LINES).collect()]
        delimiter = delimiter or sniff_separator(first)
        if header is None and first:
            cells = [c.strip().strip('"') for c in first[0].split(delimiter)]
            header = sum(map(_is_number, cells)) < len(cells) / 2
    df = spark.read.csv(path, sep=delimiter, header=bool(header), quote='"', escape='"', multiLine=multi_line,
                        ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, encoding="UTF-8")
    names: list[str] = []
    for i, c in enumerate(df.columns):
        clean = c.lstrip("﻿").strip() if header else f"C{i + 1}"
        names.append(unique_name(clean, names))
    df = df.toDF(*names)
    df = df.where(F.coalesce(*[F.nullif(F.col(f"`{c}`"), F.lit("")) for c in names]).isNotNull())
    return apply_types(df, infer_types(df)) if infer else df


def read_json(spark: SparkSession, path: str, shape: str = "records") -> DataFrame:
    """JSON as `records` (array or lines of objects), `columns`
    ({columns: [{name, values}]}) or `arrays` ({name: [values]})."""
    if shape == "records":
        # lines of objects are split over tasks; one array over many lines cannot be
        first = spark.read.text(path).where(F.trim("value") != "").first()
        lines = first is not None and first[0].strip().startswith("{") and first[0].strip().endswith("}")
        return spark.read.json(path, multiLine=not lines)
    raw = spark.read.json(path, multiLine=True)
    if shape == "columns":
        cells = raw.select(F.posexplode("columns").alias("_k", "_c")).select(
            F.col("_c.name").alias("_name"), F.posexplode(F.col("_c.values").cast("array<string>")).alias("_i", "_v"))
        names = [r[0] for r in raw.select(F.explode("columns.name")).collect()]
        wide = cells.groupBy("_i").agg(*[F.max(F.when(F.col("_name") == n, F.col("_v"))).alias(n) for n in names])
        df = wide.orderBy("_i").drop("_i")
        return apply_types(df, infer_types(df))
    zipped = raw.select(F.explode(F.arrays_zip(*[F.col(f"`{c}`") for c in raw.columns])).alias("_r"))
    return zipped.select("_r.*")


def from_records(spark: SparkSession, records: Sequence[Mapping], names: Sequence[str] | None = None) -> DataFrame:
    """Schema = union of the keys over all records; an absent key is NULL."""
    keys = list(names or dict.fromkeys(k for r in records for k in r))
    unique: list[str] = []
    for k in keys:
        unique.append(unique_name(str(k), unique))
    rows = [tuple(r.get(k) for k in keys) for r in records]
    text = [tuple(None if v is None else str(v) for v in row) for row in rows]
    df = spark.createDataFrame(text, ", ".join(f"`{c}` string" for c in unique))
    return apply_types(df, infer_types(df))


def infer_types(df: DataFrame) -> DataFrame:
    """`num`, `date` or `cat` per text column from all its non-empty values, in one pass for all columns."""
    aggs = []
    for i, c in enumerate(df.columns):
        text = F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit(""))
        numeric = to_number(text).isNotNull()
        dated = ~numeric & F.rlike(text, F.lit(r"^\d{1,4}[-/]\d{1,2}[-/]\d{1,4}"))
        some = F.count(text)
        kind = F.when(F.count_if(numeric) >= 0.85 * some, "num").when(F.count_if(dated) >= 0.80 * some, "date").otherwise("cat")
        aggs.append(F.struct(F.lit(c).alias("column"), F.when(some > 0, kind).otherwise("cat").alias("type")).alias(f"_{i}"))
    found = df.agg(*aggs)
    return found.select(F.explode(F.array(*[f"_{i}" for i in range(len(aggs))])).alias("r")).select("r.column", "r.type")


def apply_types(df: DataFrame, types: DataFrame) -> DataFrame:
    """Cast the columns that were inferred numeric; where that loses a text, the texts stay beside it as <column>_text."""
    names = [r["column"] for r in types.where(F.col("type") == "num").collect()]
    if not names:
        return df
    cells = {c: F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")) for c in names}
    lost = df.agg(*[F.count_if(x.isNotNull() & to_number(x).isNull()).alias(f"_{i}") for i, x in enumerate(cells.values())]).first()
    out = []
    for c in df.columns:
        if c not in cells:
            out.append(F.col(f"`{c}`"))
            continue
        out.append(to_number(f"`{c}`").alias(c))
        if lost[names.index(c)]:
            out.append(F.col(f"`{c}`").alias(unique_name(f"{c}_text", df.columns)))
    return df.select(*out)
