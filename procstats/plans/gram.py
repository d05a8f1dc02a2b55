"""Linear models from one pass: cross moments are aggregated, p x p algebra follows per group.

`moments` reduces the table to one row per group (count, means, covariances).
`fit` solves every group's normal equations, including the sequential and the
adjusted sum of squares of each term, without touching the data again.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import finite, level

MAX_LEVELS = 200
ALIAS_TOLERANCE = 1e-10


@dataclass
class Design:
    """Generated numeric columns `_x0.._xk` and the terms they belong to."""

    names: list[str] = field(default_factory=list)
    exprs: list[Column] = field(default_factory=list)
    terms: list[tuple[str, list[int]]] = field(default_factory=list)
    levels: dict[str, list[str]] = field(default_factory=dict)
    variables: list[tuple[str, ...]] = field(default_factory=list)
    numeric: list[str] = field(default_factory=list)
    intercept: bool = True

    @property
    def columns(self) -> list[str]:
        return [f"_x{i}" for i in range(len(self.names))]


def level_sort_key(text: str):
    try:
        return (0, float(text), text)
    except ValueError:
        return (1, 0.0, text)


def find_levels(df: DataFrame, column: str, limit: int = MAX_LEVELS) -> list[str]:
    """Distinct levels of a factor in numeric-aware order; refuses unbounded ones."""
    found = df.select(level(column).alias("v")).distinct().limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"{column} has more than {limit} levels")
    return sorted((r["v"] for r in found), key=level_sort_key)


def design(df: DataFrame, terms: Sequence[str], categorical: Sequence[str] = (), intercept: bool = True,
           centre: dict[str, float] | None = None) -> Design:
    """Terms A, A*B, A^2; factors are effect coded (last level = -1)."""
    out = Design(intercept=intercept)
    base: dict[str, list[tuple[str, Column]]] = {}

    def columns_of(v: str) -> list[tuple[str, Column]]:
        if v in base:
            return base[v]
        if v in categorical:
            lv = find_levels(df, v)
            out.levels[v] = lv
            g = level(v)
            base[v] = [(f"{v}[{name}]", F.when(g == name, 1.0).when(g == lv[-1], -1.0).otherwise(0.0)) for name in lv[:-1]]
        else:
            x = F.col(v).cast("double")
            out.numeric.append(v)
            base[v] = [(v, x - centre[v] if centre and v in centre else x)]
        return base[v]

    for term in terms:
        label = term.replace(" ", "")
        if "^" in label:
            v, power = label.split("^")
            parts = [(f"{n}^{power}", e ** int(power)) for n, e in columns_of(v)]
            variables: tuple[str, ...] = (v,) * int(power)
        else:
            variables = tuple(label.split("*"))
            parts = [("", F.lit(1.0))]
            for v in variables:
                parts = [(f"{a}*{n}" if a else n, e if not a else x * e) for a, x in parts for n, e in columns_of(v)]
        start = len(out.names)
        out.names += [n for n, _ in parts]
        out.exprs += [e for _, e in parts]
        out.terms.append((label, list(range(start, start + len(parts)))))
        out.variables.append(variables)
    return out


def design_rows(df: DataFrame, dm: Design, y: str | Column | None, by: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    """Complete rows with the design columns (and `_y`).

    Completeness is tested on the source variables: testing the generated
    products would evaluate every one of them twice.
    """
    keep = [c for c in keep if c not in by]
    if y is not None:
        df = df.withColumn("_y", finite(y))
    used = [finite(v).isNotNull() for v in dm.numeric] + ([F.col("_y").isNotNull()] if y is not None else [])
    for cond in used:
        df = df.where(cond)
    cols = [e.cast("double").alias(c) for c, e in zip(dm.columns, dm.exprs)]
    return df.select(*by, *keep, *cols, *(["_y"] if y is not None else []))


#: Up to this many columns Spark's own aggregates are the lighter way; the number of pairs grows with the square.
NARROW = 6
#: Numbers that a task keeps for the groups it has met before it passes them on.
HELD = 4_000_000
MERGERS = 32


def moments(rows: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """One row per group: n, means and the upper triangle of the covariance matrix.

    Each Arrow block of rows becomes one centred cross product per group, and blocks are merged by the
    pairwise rule, so groups far from each other lose no digits; the rows themselves are neither
    copied nor shuffled.  Rows must have no NULLs in `columns`.  A column is constant in a group if its least value is its greatest.
    """
    columns, by = list(columns), list(by)
    if len(columns) > NARROW:
        return _block_moments(rows, columns, by)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    fixed = {c: F.min(c) == F.max(c) for c in columns}
    covs = [F.when(fixed[a] | fixed[b], 0.0).otherwise(F.var_pop(a) if a == b else F.covar_pop(a, b)) for a, b in pairs]
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.array(*[F.avg(c) for c in columns]).alias("means"), F.array(*covs).alias("cov"))


class Parts:
    """Partial moments of rows of groups: n, least, greatest, mean (k columns each) and centred products (upper triangle)."""

    def __init__(self, n, low, high, mean, products):
        self.n, self.low, self.high, self.mean, self.products = n, low, high, mean, products

    @staticmethod
    def of(x: np.ndarray, starts: np.ndarray) -> Parts:
        """From rows sorted by group; `starts` is where each group begins."""
        k, edges = x.shape[1], np.append(starts, len(x))
        n = np.diff(edges).astype(float)
        mean = np.add.reduceat(x, starts, axis=0) / n[:, None]
        c = x - np.repeat(mean, np.diff(edges), axis=0)
        shift = np.add.reduceat(c, starts, axis=0) / n[:, None]  # what rounding of the mean has left
        i, j = np.triu_indices(k)
        if len(starts) * 8 <= len(x):  # long groups: one matrix product each
            products = np.array([(c[p:q].T @ c[p:q])[i, j] for p, q in zip(edges[:-1], edges[1:])])
        else:
            products = np.stack([np.add.reduceat(c[:, p] * c[:, q], starts) for p, q in zip(i, j)], axis=1)
        products = products - n[:, None] * shift[:, i] * shift[:, j]
        return Parts(n, np.minimum.reduceat(x, starts, axis=0), np.maximum.reduceat(x, starts, axis=0), mean + shift, products)

    def merged(self, starts: np.ndarray) -> Parts:
        """Neighbouring parts of one group put together."""
        sizes = np.diff(np.append(starts, len(self.n)))
        n = np.add.reduceat(self.n, starts)
        first = np.repeat(self.mean[starts], sizes, axis=0)
        mean = self.mean[starts] + np.add.reduceat((self.mean - first) * self.n[:, None], starts, axis=0) / n[:, None]
        apart = self.mean - np.repeat(mean, sizes, axis=0)
        i, j = np.triu_indices(self.mean.shape[1])
        products = np.add.reduceat(self.products + self.n[:, None] * apart[:, i] * apart[:, j], starts, axis=0)
        return Parts(n, np.minimum.reduceat(self.low, starts, axis=0), np.maximum.reduceat(self.high, starts, axis=0), mean, products)

    def take(self, which) -> Parts:
        return Parts(*[v[which] for v in self.arrays()])

    def arrays(self) -> list[np.ndarray]:
        return [self.n, self.low, self.high, self.mean, self.products]

    @staticmethod
    def joined(parts: Sequence[Parts]) -> Parts:
        return Parts(*[np.concatenate(v) for v in zip(*[p.arrays() for p in parts])])

    def columns(self) -> list[pa.Array]:
        lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, v.shape[1], dtype=np.int32)), pa.array(v.ravel())) for v in self.arrays()[1:]]
        return [pa.array(self.n), *lists]

    @staticmethod
    def read(columns: Sequence[pa.Array]) -> Parts:
        n = columns[0].to_numpy(zero_copy_only=False)
        return Parts(n, *[c.flatten().to_numpy(zero_copy_only=False).reshape(len(n), -1) for c in columns[1:]])


_PART = ["_n", "_low", "_high", "_mean", "_products"]
_PART_FIELDS = "_n double, " + ", ".join(f"{c} array<double>" for c in _PART[1:])


def _codes(batch: pa.RecordBatch, by: Sequence[str]) -> np.ndarray:
    """A number per row that rows of one group share."""
    if not by:
        return np.zeros(batch.num_rows, np.int64)
    return batch.select(list(by)).to_pandas().groupby(list(by), dropna=False, sort=False).ngroup().to_numpy()


def _in_runs(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts) that sort rows by code."""
    order = np.argsort(codes, kind="stable")
    return order, np.flatnonzero(np.append(True, np.diff(codes[order]) != 0))


def _put_together(held: list[pa.RecordBatch], by: Sequence[str]) -> pa.RecordBatch:
    """Batches of partial moments as one with a row per group."""
    whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    order, starts = _in_runs(_codes(whole, by))
    parts = Parts.read([whole.column(c) for c in _PART]).take(order).merged(starts)
    keys = whole.select(list(by)).take(pa.array(order[starts])).columns if by else []
    return pa.RecordBatch.from_arrays([*keys, *parts.columns()], names=[*by, *_PART])


def _block_moments(rows: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    k = len(columns)
    room = max(1, HELD // (3 * k + k * (k + 1) // 2))
    fields = "".join(f"`{c}` {dict(rows.dtypes)[c]}, " for c in by) + _PART_FIELDS

    def reduce(batches):
        """Partial moments, merged while the groups are few enough to be kept."""
        held = None
        for b in batches:
            held = _put_together([held, b] if held is not None else [b], by)
            if held.num_rows > room:
                yield held
                held = None
        if held is not None:
            yield held

    def blocks(batches):
        for b in batches:
            if b.num_rows:
                order, starts = _in_runs(_codes(b, by))
                x = np.column_stack([b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in columns])[order]
                keys = b.select(by).take(pa.array(order[starts])).columns if by else []
                yield pa.RecordBatch.from_arrays([*keys, *Parts.of(x, starts).columns()], names=[*by, *_PART])

    i, j = np.triu_indices(k)

    def whole_groups(table: pa.Table) -> pa.Table:
        b = _put_together(table.to_batches(), by)
        parts = Parts.read([b.column(c) for c in _PART])
        fixed = parts.low == parts.high
        cov = np.where(fixed[:, i] | fixed[:, j], 0.0, parts.products / parts.n[:, None])
        lists = Parts(parts.n, parts.low, parts.high, parts.mean, cov).columns()
        return pa.Table.from_arrays([*[b.column(c) for c in by], pa.array(parts.n.astype(np.int64)), lists[3], lists[4]], names=[*by, "n", "means", "cov"])

    src = rows.select(*[F.col(f"`{c}`") for c in by], *[F.col(f"`{c}`").cast("double").alias(c) for c in columns])
    parts = src.mapInArrow(lambda batches: reduce(blocks(batches)), fields)
    # a group's parts meet in two steps, so that not all tasks report to one
    some = parts.withColumn("_at", F.spark_partition_id() % MERGERS).repartition(*[F.col(f"`{c}`") for c in by], "_at").drop("_at").mapInArrow(reduce, fields)
    key = F.xxhash64(*[F.col(f"`{c}`") for c in by]) if by else F.lit(0)
    done = "".join(f"`{c}` {dict(rows.dtypes)[c]}, " for c in by) + "n bigint, means array<double>, cov array<double>"
    return some.groupBy(key.alias("_key")).applyInArrow(whole_groups, done)


def square(flat, k: int) -> np.ndarray:
    out = np.zeros((k, k))
    out[np.triu_indices(k)] = np.asarray(flat, float)
    return out + np.triu(out, 1).T


def solve(n: float, means, cov, terms, intercept: bool = True) -> dict:
    """Least squares from moments; the last variable is the response."""
    k = len(means)
    p = k - 1
    m, c = np.asarray(means, float), square(cov, k)
    if not intercept:
        c = c + np.outer(m, m)
    scale = np.sqrt(np.maximum(np.diag(c), 0))
    scale = np.where(scale > 0, scale, 1.0)
    a = c / np.outer(scale, scale)
    used = np.zeros(p, bool)
    y2 = n * scale[p] ** 2
    seq = []
    for _, cols in terms:
        before = a[p, p]
        for j in cols:
            pivot = a[j, j]
            if pivot <= ALIAS_TOLERANCE or n - used.sum() - intercept < 1:
                continue
            used[j] = True
            row = a[j] / pivot
            col = a[:, j].copy()
            a = a - np.outer(col, row)
            a[j, :] = row
            a[:, j] = -col / pivot
            a[j, j] = 1 / pivot
        seq.append(max(0.0, (before - a[p, p])) * y2)
    sse = max(0.0, a[p, p]) * y2
    sst = c[p, p] * n
    rank = int(used.sum()) + int(intercept)
    dfe = n - rank
    u = np.where(used)[0]
    inv = np.full((p, p), np.nan)
    beta = np.full(p, np.nan)
    inv[np.ix_(u, u)] = a[np.ix_(u, u)] / np.outer(scale[u], scale[u]) / n
    beta[u] = a[u, p] * scale[p] / scale[u]
    full = np.nan_to_num(inv)
    coef = beta
    if intercept:
        b0 = m[p] - np.nansum(beta * m[:p])
        coef = np.concatenate([[b0], beta])
        edge = -full @ m[:p]
        full = np.block([[np.array([[1 / n + m[:p] @ full[:, :] @ m[:p]]]), edge[None, :]], [edge[:, None], full]])
    mse = sse / dfe if dfe > 0 else np.nan
    se = np.sqrt(np.maximum(np.diag(full), 0) * mse)
    se = np.where(np.isnan(coef), np.nan, se)
    adj, dfs = [], []
    for _, cols in terms:
        t = [j for j in cols if used[j]]
        dfs.append(float(len(t)))
        adj.append(float(beta[t] @ np.linalg.solve(inv[np.ix_(t, t)], beta[t])) if t else 0.0)
    return {"n": float(n), "p": p + int(intercept), "rank": rank, "sse": sse, "sst": sst, "dfe": float(dfe),
            "coef": coef, "se": se, "inv": full.ravel(), "means": m, "term_df": dfs, "ss_seq": seq, "ss_adj": adj}


FIT_FIELDS = ("n double, p int, rank int, sse double, sst double, dfe double, coef array<double>, se array<double>, "
              "inv array<double>, means array<double>, term_df array<double>, ss_seq array<double>, ss_adj array<double>")


def per_group(rows: DataFrame, fn, by: Sequence[str], fields: str) -> DataFrame:
    """Apply `fn(row) -> dict or list of dicts` to rows that are already one per group."""
    keys = list(by)
    schema = ", ".join([f"`{k}` {dict(rows.dtypes)[k]}" for k in keys] + [fields])
    names = keys + [f.strip().split(" ")[0].strip("`") for f in _split(fields)]

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                found = fn(row)
                for r in found if isinstance(found, list) else [found]:
                    out.append([row[k] for k in keys] + [r[c] for c in names[len(keys):]])
            yield pd.DataFrame(out, columns=names)

    return rows.mapInPandas(run, schema)


def _split(fields: str) -> list[str]:
    out, depth, cur = [], 0, ""
    for ch in fields:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            out.append(cur)
            cur = ""
        else:
            cur += ch
    return [*out, cur]


def fit(df: DataFrame, y: str | Column, dm: Design, by: Sequence[str] = ()) -> DataFrame:
    """Fitted model, one row per group (see FIT_FIELDS)."""
    rows = design_rows(df, dm, y, by)
    g = moments(rows, [*dm.columns, "_y"], by).where("n > 0")
    terms, intercept = dm.terms, dm.intercept
    return per_group(g, lambda r: solve(r["n"], r["means"], r["cov"], terms, intercept), by, FIT_FIELDS)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
