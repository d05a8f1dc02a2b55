"""Whitened vectors: block matrices for the scatter and for the projection, a small eigenproblem between them."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, cloudpickle
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Rows and columns of a block: 2 MB at 64 dimensions.
ROWS, COLS = 4096, 1024
COMPONENTS = 32
GRID, SHIFT = 64, 1_000_000
#: Entries whose grid value is not below this have no exact integer among doubles; they count as non-finite.
LARGEST = 2 ** 52
#: Eigenvalues below this share of the largest one are rounding of zero.
ZERO = 1e-12
_OUT = "{key} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"


def on_grid(df: DataFrame, vector: str, key: str) -> DataFrame:
    """(key, x): the usable vectors as integers floor(64 c) + 1000000, all of the most frequent length (the longest of several)."""
    entry = f"cast(c as double) * {GRID}"
    usable = F.expr(f"`{vector}` IS NOT NULL AND size(`{vector}`) > 0 AND forall(`{vector}`, c -> coalesce(NOT isnan(c) AND abs({entry}) < {LARGEST}, false))")
    x = F.expr(f"transform(`{vector}`, c -> floor({entry}) + {SHIFT}L)")
    kept = df.where(usable).select(F.col(f"`{key}`").alias(key), x.alias("x"))
    sizes = kept.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return kept.where(F.size("x") == F.lit(sizes["d"] if sizes else 0))


def numbered(df: DataFrame) -> DataFrame:
    """`df`, written, with `row`: 0, 1, 2, ... without gaps."""
    own = stored(df.withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", 33)
    first, before = [], 0
    for p, count in sorted(own.groupBy(part).count().collect()):  # a row per written partition
        first.append((p, before))
        before += count
    offsets = df.sparkSession.createDataFrame(first, "_q long, _before long")
    own = own.join(F.broadcast(offsets), part == F.col("_q"))
    return own.withColumn("row", F.col("_before") + F.col("_m").bitwiseAND(F.lit(2 ** 33 - 1))).drop("_m", "_q", "_before")


def centred(rows: DataFrame, sums: list[int], n: int) -> DataFrame:
    """`rows` with `deviation`, the exact sum of (n x - S) ** 2 (NULL beyond a long), and `c`, the doubles (n x - S) / n, instead of x."""
    names = [c for c in rows.columns if c != "x"]
    top = 2 ** 63 - 1

    def run(batches):
        for b in batches:
            x = b.column(b.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, len(sums))
            far = n * (int(np.abs(x).max(initial=0)) + 1) + max(map(abs, sums))
            # Python's integers where those of the machine could overflow
            kind = np.int64 if far < top else object
            d = x.astype(kind) * n - np.array(sums, kind)
            most = max(int(d.max(initial=0)), -int(d.min(initial=0)))
            square = d.astype(np.int64 if most * most * len(sums) < top else object)
            deviation = pa.array([v if v <= top else None for v in (square * square).sum(axis=1).tolist()], pa.int64())
            c = np.array(d / n, np.float64)
            values = pa.ListArray.from_arrays(pa.array(np.arange(0, c.size + 1, len(sums), dtype=np.int32)), pa.array(c.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], deviation, values], names=[*names, "deviation", "c"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "x")
    return rows.select(*[F.col(f"`{c}`") for c in names], "x").mapInArrow(run, f"{fields}, deviation long, c array<double>")


def blocks(rows: DataFrame, n: int, d: int) -> BlockMatrix:
    """The vectors `c` at their `row` as distributed blocks."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select("row", array_to_vector("c").alias("c")), "c")
    return IndexedRowMatrix(vectors, n, d).toBlockMatrix(ROWS, min(COLS, d))


def product(left: BlockMatrix, right: BlockMatrix, parts: int) -> np.ndarray:
    """left x right, a small matrix, with the long dimension between them dealt out to `parts` tasks."""
    made = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, parts)
    return BlockMatrix(made, left.rowsPerBlock, right.colsPerBlock).toLocalMatrix().toArray()


def local(spark, m: np.ndarray) -> BlockMatrix:
    """A small matrix as blocks."""
    at = [(i, j) for i in range(0, m.shape[0], COLS) for j in range(0, m.shape[1], COLS)]
    cut = [((i // COLS, j // COLS), m[i:i + COLS, j:j + COLS]) for i, j in at]
    made = [(k, DenseMatrix(x.shape[0], x.shape[1], np.asfortranarray(x).ravel(order="F"))) for k, x in cut]
    return BlockMatrix(spark.sparkContext.parallelize(made, 1), min(COLS, m.shape[0]), min(COLS, m.shape[1]), *m.shape)


def whiten(df: DataFrame, vector: str = "embedding", key: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """A row for each usable vector and component: key, component, n, deviation, whitened, explained, identity_error.

    Vectors that are NULL, empty, hold NULL, non-finite or huge entries (64 |c| >= 2 ** 52), or have another length
    than most are left out.  All others are the fit list: x = floor(64 c) + 1000000, centred by exact integer sums;
    scatter = transpose x matrix as block matrices, divided by n; its unit eigenvectors, largest eigenvalue first, each with its
    largest entry positive, divided by the root of their eigenvalue, are the whitening matrix that the blocks are multiplied
    by.  identity_error is the largest entry of |covariance of the whitened components - identity|.  Directions without
    variance (eigenvalue below 1e-12 of the largest) have `whitened` NULL, explained 0 and no part in identity_error; if
    there is no variance at all, explained and identity_error are NULL.  Keys are carried through as they are, NULL and repeated
    ones included; other columns are not read.  An empty table gives no rows.

    The driver holds d x d numbers and the coordinates of the blocks.  The long dimension of the scatter is dealt out
    to as many tasks as there are shuffle partitions.
    """
    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()
    schema = _OUT.format(key=f"`{key}`", kind=kind)
    rows = numbered(on_grid(df, vector, key))
    sums = rows.select(F.posexplode("x")).groupBy("pos").agg(F.sum(F.col("col").cast("decimal(20,0)")).alias("s"), F.count(F.lit(1)).alias("n")).collect()
    if not sums:
        return spark.createDataFrame([], schema)
    n, total = sums[0]["n"], [int(r["s"]) for r in sorted(sums, key=lambda r: r["pos"])]
    d, k = len(total), min(components, len(total))
    rows = stored(centred(rows, total, n))
    matrix = blocks(rows, n, d).persist(StorageLevel.MEMORY_AND_DISK)
    parts = max(1, min(-(-n // ROWS), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    covariance = product(matrix.transpose(), matrix, parts) / n
    e, v = np.linalg.eigh((covariance + covariance.T) / 2)
    e, v = np.maximum(e[::-1], 0), v[:, ::-1]
    v = v * np.where(v[np.abs(v).argmax(axis=0), np.arange(d)] < 0, -1, 1)
    live = int((e[:k] > ZERO * e[0]).sum())
    trace = float(np.trace(covariance))
    whole = rows.drop("c")
    if live:
        projected = matrix.multiply(local(spark, v[:, :live] / np.sqrt(e[:live])))
        lines = callMLlibFunc("getIndexedRows", projected.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
        white = stored(lines.select(F.col("index").alias("row"), vector_to_array("vector").alias("w")))
        again = blocks(white.select("row", F.col("w").alias("c")), n, live)
        mean = np.array(white.agg(*[F.avg(F.col("w")[i]) for i in range(live)]).first(), float)
        error = float(np.abs(product(again.transpose(), again, parts) / n - np.outer(mean, mean) - np.eye(live)).max())
        matrix.blocks.unpersist()
        whole = whole.join(white, "row")
    else:
        error = None
        whole = whole.withColumn("w", F.array().cast("array<double>"))
    share = [float(x) / trace if i < live else 0.0 for i, x in enumerate(e[:k])] if trace else [None] * k
    each = F.array(*[F.struct(F.lit(i + 1).alias("component"), F.lit(share[i]).cast("double").alias("explained")) for i in range(k)])
    return whole.withColumn("c", F.explode(each)).select(
        F.col(f"`{key}`").alias(key), "c.component", F.lit(n).cast("long").alias("n"), "deviation",
        F.expr("try_element_at(w, c.component)").alias("whitened"), "c.explained", F.lit(error).cast("double").alias("identity_error"))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
