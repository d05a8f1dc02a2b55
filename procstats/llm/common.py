"""Small helpers of the training-data operators."""

from __future__ import annotations

import sys
import uuid

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.session import checkpoint_folder

WORD = r"[^\x20\x09-\x0D]+"
NO_ID = 2 ** 63 - 1
BASE = 0x9E3779B97F4A7C15 | 5
INVERSE = pow(BASE, -1, 2 ** 64)


def stored(df: DataFrame) -> DataFrame:
    """Write `df` as a table in the shared checkpoint folder and read it back: lineage ends there."""
    path = f"{checkpoint_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_key() -> tuple[Column, Column]:
    """(doc_id, h): the id and a hash of the text name a row; NULL ids become the largest long, so that they sort last."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), F.xxhash64(F.coalesce("text", F.lit("")))


def rows_of(df: DataFrame) -> DataFrame:
    """(doc_id, h, text) of a table of documents; NULL texts are empty."""
    doc_id, h = row_key()
    return df.select(doc_id.alias("doc_id"), h.alias("h"), F.coalesce("text", F.lit("")).alias("text"))


def given_id(name: str = "doc_id"):
    """The id as it was given."""
    return F.when(F.col(name) != NO_ID, F.col(name))


def same_columns(out: DataFrame, like: DataFrame) -> DataFrame:
    return out.select(*[F.col(f"`{c}`") for c in like.columns])


def mix(x: np.ndarray) -> np.ndarray:
    """Bit mixer of unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Polynomial hashes of all spans of a sequence of 64-bit symbols."""

    def __init__(self, symbols: np.ndarray, seed: int = 0):
        n = len(symbols)
        up = np.full(n + 1, (BASE + 2 * seed) & (2 ** 64 - 1) | 1, np.uint64)
        up[0] = 1
        down = np.full(n + 1, pow(int(up[-1]), -1, 2 ** 64) if n else 1, np.uint64)
        down[0] = 1
        self.down = np.multiply.accumulate(down)
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum(symbols * np.multiply.accumulate(up)[:n], out=self.total[1:])

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.total[end] - self.total[start]) * self.down[start])

    def windows(self, size: int) -> np.ndarray:
        m = max(0, len(self.total) - size)
        return mix((self.total[size:size + m] - self.total[:m]) * self.down[:m])


def first_of_each(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of equal keys: where the first is, and how many rows there are (0 for the later ones)."""
    n = len(keys[0])
    order = np.lexsort(keys[::-1])
    new = np.ones(n, bool)
    if n:
        new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    starts = np.flatnonzero(new)
    count = np.zeros(n, np.int64)
    count[order[starts]] = np.diff(np.append(starts, n))
    return count > 0, count


def union_of(intervals: np.ndarray, n: int) -> np.ndarray:
    """Marks of the positions below n that the half-open intervals (rows of from, to) cover."""
    step = np.zeros(n + 1, np.int32)
    if len(intervals):
        np.add.at(step, intervals[:, 0], 1)
        np.add.at(step, intervals[:, 1], -1)
    return np.cumsum(step[:n]) > 0


cloudpickle.register_pickle_by_value(sys.modules[__name__])
