"""Correlation and multivariate methods from cross moments."""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dist
from ..functions.numeric import finite, level, ratio
from ..plans import gram
from ..plans.joining import attach, one_row
from ..plans.ordering import prefix, sequence, value_order
from ..plans.session import persist
from .hypothesis import p_from_t


#: Numbers that a summary of clusters or classes may have before it travels to the tasks (128 MB), and that a block of distances may have.
SUMMARY, BLOCK = 1 << 24, 1 << 22


def _vector(columns: Sequence[str]) -> Column:
    return F.array(*[F.col(f"`{c}`") for c in columns])


def _dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)


def _against(rows: DataFrame, columns: Sequence[str], summary: list, fn, added: str, kinds: Sequence) -> DataFrame:
    """`rows` with the columns `added`: `fn(x, row numbers)` gets blocks of rows as a matrix and gives those columns.

    `summary`, what fn holds, is one entry per cluster or class; its size is checked.
    """
    if len(summary) * len(columns) > SUMMARY:
        raise ValueError(f"{len(summary)} clusters of {len(columns)} columns are over {SUMMARY} numbers")
    keep = list(rows.columns)
    step = max(1, BLOCK // max(1, len(summary)))
    names = [a.strip().split(" ")[0] for a in added.split(",")]

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, step):
                part = b.slice(at, step)
                x = part.column(part.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, len(columns))
                found = fn(x, part)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *[pa.array(v, k) for v, k in zip(found, kinds)]], names=[*keep, *names])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.withColumn("_vector", _vector(columns)).mapInArrow(run, f"{fields}, {added}")


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows and centres."""
    middle = centres.mean(axis=0)
    x, c = x - middle, centres - middle
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ c.T + (c * c).sum(axis=1), 0)


def _pairs(columns: Sequence[str]):
    return [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]


def correlation_matrix(df: DataFrame, columns: Sequence[str], method: str = "pearson") -> DataFrame:
    """Pairwise r with its own complete n, t and p, one row per pair."""
    if method == "kendall":
        out = None
        for a, b in _pairs(columns):
            one = kendall(df, a, b).select(F.lit(a).alias("x"), F.lit(b).alias("y"), "n", F.col("tau").alias("r"))
            out = one if out is None else out.unionByName(one)
        return _with_p(out)
    if method == "spearman":
        whole = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(finite(c)).alias(c) for c in columns]).first()
        if all(whole[c] == whole["n"] for c in columns):
            return _with_p(_spearman_complete(df, columns, whole["n"]))
        out = None
        for a, b in _pairs(columns):
            one = spearman(df, a, b).select(F.lit(a).alias("x"), F.lit(b).alias("y"), "n", "r")
            out = one if out is None else out.unionByName(one)
        return _with_p(out)
    aggs, lines = [], []
    for i, (a, b) in enumerate(_pairs(columns)):
        x, y = finite(a), finite(b)
        ok = x.isNotNull() & y.isNotNull()
        aggs += [F.count_if(ok).alias(f"n{i}"), F.corr(F.when(ok, x), F.when(ok, y)).alias(f"r{i}")]
        lines.append(F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"n{i}").alias("n"), F.col(f"r{i}").alias("r")))
    return _with_p(df.agg(*aggs).select(F.explode(F.array(*lines)).alias("_l")).select("_l.*"))


def _with_p(t: DataFrame) -> DataFrame:
    n, r = F.col("n"), F.col("r")
    t = t.withColumn("t", F.when((n >= 3) & (F.abs(r) < 1), r * F.sqrt((n - 2) / (1 - r * r))))
    return t.withColumn("p_value", F.when(F.abs(r) >= 1, 0.0).otherwise(p_from_t(F.col("t"), n - 2, "two")))


def _spearman_complete(df: DataFrame, columns: Sequence[str], n: int) -> DataFrame:
    """Nothing missing: one ordering of (column, value) ranks all columns for all pairs.

    Each column's ranks are joined to the rows as they are, one row each, so few values cost no shuffle and no rows are put together again.
    """
    source = persist(df.select(*[F.when(finite(c) == 0, F.lit(0.0)).otherwise(finite(c)).alias(f"_v{i}") for i, c in enumerate(columns)]))
    long = source.select(F.posexplode(F.array(*source.columns)).alias("_i", "_v"))
    centred = F.col("below") + (F.col("freq") + 1) / 2 - (n + 1) / 2
    order = persist(value_order(long, "_v", ["_i"]).select("_i", "_v", centred.alias("_r")))
    rows = source
    for i in range(len(columns)):
        ranks = order.where(F.col("_i") == i).select(F.col("_v").alias(f"_v{i}"), F.col("_r").alias(f"_r{i}"))
        rows = attach(rows, ranks, [f"_v{i}"], ready=True).drop(f"_v{i}")
    at = {c: F.col(f"_r{i}") for i, c in enumerate(columns)}
    pairs = _pairs(columns)
    sums = rows.agg(*[F.sum(at[a] * at[b]).alias(f"p{i}") for i, (a, b) in enumerate(pairs)], *[F.sum(at[c] * at[c]).alias(f"s_{c}") for c in columns])
    lines = [F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.lit(n).cast("bigint").alias("n"),
                      ratio(F.col(f"p{i}"), F.sqrt(F.col(f"s_{a}") * F.col(f"s_{b}"))).alias("r")) for i, (a, b) in enumerate(pairs)]
    return sums.select(F.explode(F.array(*lines)).alias("_l")).select("_l.*")


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Correlation of average ranks over complete pairs, on (x, y) frequencies."""
    rows = df.select(finite(x).alias("_x"), finite(y).alias("_y")).na.drop()
    cells = persist(rows.groupBy("_x", "_y").agg(F.count(F.lit(1)).alias("_c")))
    for c in ("_x", "_y"):
        order = value_order(cells, c, weight="_c")
        order = order.select(F.col(c).alias("_k"), (F.col("below") + (F.col("freq") + 1) / 2).alias("_r" + c), F.col("n").alias("_n"))
        cells = cells.join(order if c == "_x" else order.drop("_n"), F.col(c) == F.col("_k")).drop("_k")
    # ranks have mean (n + 1) / 2, so the centred sums are exact
    f, m = F.col("_c").cast("double"), (F.col("_n") + 1) / 2
    a, b = F.col("_r_x") - m, F.col("_r_y") - m
    return cells.agg(F.sum("_c").alias("n"), ratio(F.sum(f * a * b), F.sqrt(F.sum(f * a * a) * F.sum(f * b * b))).alias("r"))


def kendall(df: DataFrame, x: str, y: str) -> DataFrame:
    """Tau-b without forming pairs.

    Two observations with different y separate at the highest bit in which
    their y ranks differ.  For every bit and every group of equal higher bits,
    running counts in x order give the concordant and discordant pairs, so the
    work is n log n and is spread over (bit, group, x).
    """
    rows = df.select(finite(x).alias("_x"), finite(y).alias("_y")).na.drop()
    cells = persist(rows.groupBy("_x", "_y").agg(F.count(F.lit(1)).alias("_c")))
    order = persist(sequence(cells.select("_y").distinct(), [], ["_y"], "_code").select(F.col("_y").alias("_k"), (F.col("_code") - 1).alias("_code")))
    top = order.agg(F.max("_code")).first()[0] or 0
    bits = max(1, int(top).bit_length())
    coded = cells.join(order, F.col("_y") == F.col("_k")).select("_x", "_code", "_c")
    levels = coded.withColumn("_bit", F.explode(F.sequence(F.lit(0), F.lit(bits - 1))))
    one = F.expr("shiftright(_code, _bit)") % 2 == 1
    g = levels.groupBy("_bit", F.expr("shiftright(_code, _bit + 1)").alias("_group"), "_x").agg(
        F.sum(F.when(one, 0).otherwise(F.col("_c"))).alias("_z"), F.sum(F.when(one, F.col("_c")).otherwise(0)).alias("_o"))
    cum = prefix(g, ["_bit", "_group"], ["_x"], {"_bz": "_z", "_bo": "_o"})
    d = lambda c: F.col(c).cast("double")
    cd = cum.agg(F.sum(d("_o") * d("_bz")).alias("_con"), F.sum(d("_z") * d("_bo")).alias("_dis"))
    tie = lambda c: cells.groupBy(c).agg(F.sum("_c").cast("double").alias("_t")).agg(F.sum(F.col("_t") * (F.col("_t") - 1) / 2).alias("_tie" + c), F.sum("_t").alias("_n" + c))
    t = tie("_x").withColumns(one_row(tie("_y"))).withColumns(one_row(cd))
    n0 = F.col("_n_x") * (F.col("_n_x") - 1) / 2
    return t.select(F.col("_n_x").cast("bigint").alias("n"), F.col("_con").alias("concordant"), F.col("_dis").alias("discordant"),
                    ratio(F.col("_con") - F.col("_dis"), F.sqrt((n0 - F.col("_tie_x")) * (n0 - F.col("_tie_y")))).alias("tau"))


# ------------------------------------------------------------------- PCA

def _complete(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    rows = df.select(*keep, *[finite(c).alias(c) for c in columns if c not in keep])
    return rows.na.drop(subset=list(columns))


def pca(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), correlation: bool = True) -> DataFrame:
    """Eigenvalues, proportions and loadings, one row per component.

    Each loading vector is signed so that its largest entry is positive.
    """
    g = gram.moments(_complete(df, columns, by), columns, by)
    k, names = len(columns), list(columns)

    def one(row):
        c = gram.square(row["cov"], k) * row["n"] / (row["n"] - 1)
        sd = np.sqrt(np.diag(c)) if correlation else np.ones(k)
        val, vec = np.linalg.eigh(c / np.outer(sd, sd))
        order = np.argsort(-val)
        val, vec = np.maximum(val[order], 0), vec[:, order]
        out, cum = [], 0.0
        for j in range(k):
            v = vec[:, j] * np.sign(vec[np.argmax(np.abs(vec[:, j])), j])
            share = 100 * val[j] / val.sum()
            cum += share
            out.append({"component": j + 1, "eigenvalue": float(val[j]), "pct": float(share), "cum_pct": float(cum),
                        "keep": bool(val[j] > 1) if correlation else bool(val[j] > val.mean()), "variables": names,
                        "loadings": v, "center": np.asarray(row["means"], float), "scale": sd})
        return out

    return gram.per_group(g, one, by, "component int, eigenvalue double, pct double, cum_pct double, keep boolean, variables array<string>, "
                                      "loadings array<double>, center array<double>, scale array<double>")


def pca_scores(df: DataFrame, columns: Sequence[str], components: DataFrame, key: Sequence[str], by: Sequence[str] = (),
               count: int | None = None) -> DataFrame:
    """Component scores as column expressions of the complete rows."""
    wide = components.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("component", "loadings"))).alias("_v"),
                                       F.first("center").alias("_c"), F.first("scale").alias("_s"))
    rows = attach(_complete(df, columns, [*key, *[b for b in by if b not in key]]), wide, by)
    z = F.zip_with(F.zip_with(_vector(columns), F.col("_c"), lambda x, c: x - c), F.col("_s"), lambda x, s: x / s)
    k = len(columns) if count is None else count
    rows = rows.withColumn("_z", z)
    scores = [_dot(F.col("_z"), F.get("_v", F.lit(j))["loadings"]).alias(f"pc{j + 1}") for j in range(k)]
    return rows.select(*key, *scores)


# --------------------------------------------------------------- k-means

def k_means(df: DataFrame, columns: Sequence[str], k: int, key: Sequence[str], seed: int = 17, standardize: bool = True,
            max_iter: int = 300) -> dict[str, DataFrame]:
    """Spark ML k-means: labelled rows, cluster sizes and centres, within/between sums of squares."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    rows = _complete(df, columns, key)
    stats = rows.agg(*[f(c).alias(f"{p}{i}") for i, c in enumerate(columns) for p, f in (("m", F.avg), ("s", F.stddev_samp))]).first()
    zs = []
    for i, c in enumerate(columns):
        m, s = (stats[f"m{i}"], stats[f"s{i}"] or 1.0) if standardize else (0.0, 1.0)
        zs.append(((F.col(c) - m) / s).alias(f"_z{i}"))
    rows = persist(rows.select(*key, *columns, *zs))
    z = [f"_z{i}" for i in range(len(columns))]
    data = VectorAssembler(inputCols=z, outputCol="_f").transform(rows)
    model = KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="_f", predictionCol="_p").fit(data)
    labelled = model.transform(data).drop("_f").withColumn("cluster", F.col("_p") + 1).drop("_p")
    centres = np.array(model.clusterCenters())

    def distance(x, part):
        own = part.column(part.schema.get_field_index("cluster")).to_numpy() - 1
        return [((x - centres[own]) ** 2).sum(axis=1)]

    labelled = persist(_against(labelled, z, list(centres), distance, "_d2 double", [pa.float64()]))
    d2 = F.col("_d2")
    sizes = labelled.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum(d2).alias("within_ss"), *[F.avg(c).alias(c) for c in columns])
    total = sum((F.var_pop(c) for c in z[1:]), F.var_pop(z[0])) * F.count(F.lit(1))
    fit = labelled.agg(F.count(F.lit(1)).alias("n"), total.alias("total_ss"), F.sum(d2).alias("within_ss"))
    fit = fit.withColumns({"between_ss": F.col("total_ss") - F.col("within_ss"), "r2": 1 - ratio(F.col("within_ss"), F.col("total_ss"))})
    return {"rows": labelled.drop(*z, "_d2"), "clusters": sizes, "fit": fit, "standardized": labelled.select(*key, *z, "cluster")}


def silhouette(standardized: DataFrame, columns: Sequence[str], cluster: str = "cluster") -> DataFrame:
    """Mean silhouette (squared Euclidean) per cluster and overall, linear in the rows.

    The mean squared distance to a cluster is |x - c|^2 plus the cluster's own
    mean squared spread, so cluster summaries replace the pairs.
    """
    z = list(columns)
    cl = standardized.groupBy(cluster).agg(F.count(F.lit(1)).alias("_n"), F.array(*[F.avg(c) for c in z]).alias("_c"),
                                           sum((F.var_pop(c) for c in z[1:]), F.var_pop(z[0])).alias("_v"))
    found = cl.select(F.col(cluster).cast("string").alias("_id"), "_n", "_c", "_v").collect()
    number = {r["_id"]: i for i, r in enumerate(found)}
    centres, spread = np.array([r["_c"] for r in found], float), np.array([r["_v"] for r in found], float)
    n = np.array([r["_n"] for r in found], float)

    def score(x, part):
        own = np.array([number[v] for v in part.column(part.schema.get_field_index("_own")).to_pylist()], np.int64)
        d = _squares(x, centres) + spread
        at = np.arange(len(x))
        a = d[at, own] * n[own] / np.maximum(1, n[own] - 1)
        d[at, own] = np.inf
        b = d.min(axis=1)
        most = np.maximum(a, b)
        s = np.where(most > 0, (b - a) / np.where(most > 0, most, 1), np.nan)
        return [np.where(n[own] > 1, np.where(np.isinf(b), np.nan, s), 0.0)]

    rows = _against(standardized.select(cluster, *z, F.col(cluster).cast("string").alias("_own")), z, found, score, "_s double", [pa.float64()])
    rows = rows.withColumn("_s", finite("_s"))
    per = rows.groupBy(F.col(cluster).cast("string").alias("cluster")).agg(F.count(F.lit(1)).alias("n"), F.avg("_s").alias("silhouette"))
    return per.unionByName(rows.agg(F.lit("all").alias("cluster"), F.count(F.lit(1)).alias("n"), F.avg("_s").alias("silhouette")))


# ----------------------------------------------------- distances and charts

def _inverse(g: DataFrame, by: Sequence[str], k: int) -> DataFrame:
    """Sample covariance inverse per group."""
    def one(row):
        c = gram.square(row["cov"], k) * row["n"] / (row["n"] - 1)
        return {"n": float(row["n"]), "means": np.asarray(row["means"], float), "inv": np.linalg.pinv(c).ravel(), "det": float(np.linalg.det(c))}

    return gram.per_group(g, one, by, "n double, means array<double>, inv array<double>, det double")


def _quadratic(xs: list, k: int):
    dev = [x - F.get("_means", F.lit(i)) for i, x in enumerate(xs)]
    terms = [dev[i] * dev[j] * F.get("_inv", F.lit(i * k + j)) * (1.0 if i == j else 2.0) for i in range(k) for j in range(i, k)]
    return sum(terms[1:], terms[0])


def mahalanobis(df: DataFrame, columns: Sequence[str], key: Sequence[str], by: Sequence[str] = (), conf: float = 0.975) -> DataFrame:
    """Squared distance of every complete row, chi-square cutoff and outlier flag."""
    k = len(columns)
    rows = _complete(df, columns, [*by, *[c for c in key if c not in by]])
    inv = _inverse(gram.moments(rows, columns, by), by, k)
    side = inv.select(*by, F.col("means").alias("_means"), F.col("inv").alias("_inv"))
    cut = float(dist.chi2_ppf(conf, k))
    out = attach(rows, side, by).withColumn("d2", _quadratic([F.col(c) for c in columns], k))
    return out.select(*by, *[c for c in key if c not in by], "d2", F.lit(cut).alias("cutoff"), (F.col("d2") > cut).alias("outlier"))


def hotelling_t2(df: DataFrame, columns: Sequence[str], order_by: Sequence[str], by: Sequence[str] = (), size: int = 1,
                 alpha: float = 0.0027) -> DataFrame:
    """T2 chart: individuals against the beta limit, or subgroups of `size` against the F limit."""
    p = len(columns)
    rows = sequence(_complete(df, columns, [*by, *order_by]), by, order_by, "_rn")
    if size == 1:
        inv = _inverse(gram.moments(rows, columns, by), by, p)
        side = inv.select(*by, F.col("means").alias("_means"), F.col("inv").alias("_inv"), F.col("n").alias("_m"))
        m = F.col("_m")
        side = side.withColumn("ucl", (m - 1) ** 2 / m * dist.apply(dist.beta_ppf, F.lit(1 - alpha), F.lit(p / 2), (m - p - 1) / 2))
        out = attach(rows, side, by)
        return out.select(*by, F.col("_rn").alias("point"), _quadratic([F.col(c) for c in columns], p).alias("t2"), "ucl")
    groups = gram.moments(rows.withColumn("point", F.floor((F.col("_rn") - 1) / size) + 1), columns, [*by, "point"]).where(F.col("n") == size)

    groups = persist(groups)
    tri = p * (p + 1) // 2
    f = size / (size - 1.0)
    pool = groups.groupBy(*by).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.array(*[F.avg(F.get("means", F.lit(i))) for i in range(p)]).alias("means"),
        F.array(*[F.avg(F.get("cov", F.lit(i))) * f for i in range(tri)]).alias("cov"))

    def solve(row):
        s = gram.square(row["cov"], p)
        return {"m": float(row["n"]), "means": np.asarray(row["means"], float), "inv": np.linalg.pinv(s).ravel()}

    side = gram.per_group(pool, solve, by, "m double, means array<double>, inv array<double>")
    side = side.select(*by, F.col("m").alias("_m"), F.col("means").alias("_means"), F.col("inv").alias("_inv"))
    m, n = F.col("_m"), float(size)
    d2 = m * n - m - p + 1
    ucl = p * (m - 1) * (n - 1) / d2 * dist.apply(dist.f_ppf, F.lit(1 - alpha), F.lit(float(p)), d2)
    side = side.withColumn("ucl", ucl)

    def det(row):
        return {"point": int(row["point"]), "generalized_variance": float(np.linalg.det(gram.square(row["cov"], p) * f))}

    out = attach(groups, side, by)
    t2 = size * _quadratic([F.get("means", F.lit(i)) for i in range(p)], p)
    out = out.select(*by, "point", t2.alias("t2"), "ucl")
    gv = gram.per_group(groups.select(*by, "point", "cov"), det, by, "point bigint, generalized_variance double")
    names = {k: "_k_" + k for k in [*by, "point"]}
    cond = [F.col(k).eqNullSafe(F.col(v)) for k, v in names.items()]
    return out.join(gv.withColumnsRenamed(names), cond).drop(*names.values())


# ---------------------------------------------------------- discriminant

def lda_fit(df: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """Linear score per class: constant and weights from pooled covariance and class shares."""
    k = len(columns)
    rows = _complete(df.withColumn("_g", level(group)), columns, ["_g"])
    g = gram.moments(rows, columns, ["_g"])
    tri = k * (k + 1) // 2
    tot = g.agg(F.sum("n").cast("double").alias("_n"), F.count(F.lit(1)).cast("double").alias("_k"),
                F.array(*[F.sum(F.col("n") * F.get("cov", F.lit(i))) for i in range(tri)]).alias("_w"))
    g = attach(g, tot, [])

    def one(row):
        s = gram.square(row["_w"], k) / (row["_n"] - row["_k"])
        m = np.asarray(row["means"], float)
        w = np.linalg.pinv(s) @ m
        prior = row["n"] / row["_n"]
        return {"n": int(row["n"]), "prior": float(prior), "constant": float(-0.5 * m @ w + np.log(prior)), "weights": w, "means": m}

    out = gram.per_group(g, one, ["_g"], "n bigint, prior double, constant double, weights array<double>, means array<double>")
    return out.withColumnRenamed("_g", "class")


def lda_classify(df: DataFrame, model: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Class with the largest linear score; ties go to the last class name."""
    classes = sorted(model.collect(), key=lambda r: r["class"], reverse=True)
    weights, constant = np.array([r["weights"] for r in classes], float), np.array([r["constant"] for r in classes], float)
    names = [r["class"] for r in classes]

    def best(x, part):
        return [[names[i] for i in (x @ weights.T + constant).argmax(axis=1)]]

    return _against(_complete(df, columns, keep), columns, classes, best, "predicted string", [pa.string()])


def lda(df: DataFrame, group: str, columns: Sequence[str]) -> dict[str, DataFrame]:
    """Confusion table and apparent (resubstitution) accuracy of the training rows."""
    model = persist(lda_fit(df, group, columns))
    rows = lda_classify(df.withColumn("_actual", level(group)), model, columns, ["_actual"])
    table = persist(rows.groupBy(F.col("_actual").alias("actual"), "predicted").agg(F.count(F.lit(1)).alias("count")))
    hit = F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("count")).otherwise(0))
    return {"model": model, "confusion": table, "accuracy": table.agg(F.sum("count").alias("n"), (100 * hit / F.sum("count")).alias("accuracy"))}


cloudpickle.register_pickle_by_value(sys.modules[__name__])
