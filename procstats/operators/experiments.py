"""Analysis of designed experiments, many experiments at once through `by`."""

from __future__ import annotations

import itertools
import sys
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dist
from ..functions.numeric import finite, level, ratio
from ..plans import gram
from ..plans.joining import attach
from ..plans.session import persist
from .hypothesis import p_from_t
from .regression import Model, lack_of_fit, linear_model


# ----------------------------------------------------------------- coding

def factor_ranges(df: DataFrame, factors: Sequence[str], by: Sequence[str] = (), axial: bool = False) -> DataFrame:
    """mid and half range per factor (columns `<factor>_mid`, `<factor>_half`).

    With `axial` the half range is the most frequent distance from the middle,
    so that star points may lie beyond +-1.
    """
    aggs = []
    for f in factors:
        lo, hi = F.min(finite(f)), F.max(finite(f))
        aggs += [((lo + hi) / 2).alias(f"{f}_mid"), ((hi - lo) / 2).alias(f"{f}_half")]
    out = df.groupBy(*by).agg(*aggs)
    if not axial:
        return out
    out = persist(out)
    for f in factors:
        rows = attach(df.select(*by, finite(f).alias("_v")), out.select(*by, F.col(f"{f}_mid").alias("_m")), by)
        d = rows.select(*by, F.round(F.abs(F.col("_v") - F.col("_m")), 6).alias("_d")).where(F.col("_d") > 1e-9)
        d = d.groupBy(*by, "_d").agg(F.count(F.lit(1)).alias("_c"))
        best = d.groupBy(*by).agg(F.min_by(F.struct("_d", "_c"), F.struct(-F.col("_c"), "_d")).alias("_b"))
        best = best.select(*by, F.when(F.col("_b._c") > 1, F.col("_b._d")).alias("_axial"))
        out = attach(out, best, by, how="left").withColumn(f"{f}_half", F.coalesce("_axial", f"{f}_half")).drop("_axial")
    return out


def real_to_coded(df: DataFrame, factors: Sequence[str], ranges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(x - mid) / half, rounded to 6 digits; 0 for a constant factor."""
    out = attach(df, ranges, by)
    for f in factors:
        z = F.round(ratio(finite(f) - F.col(f"{f}_mid"), F.col(f"{f}_half")), 6)
        out = out.withColumn(f, F.when(F.col(f"{f}_half") == 0, 0.0).otherwise(z))
    return out.drop(*[f"{f}_{s}" for f in factors for s in ("mid", "half")])


def coded_to_real(df: DataFrame, factors: Sequence[str], ranges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    out = attach(df, ranges, by)
    for f in factors:
        out = out.withColumn(f, F.round(F.col(f"{f}_mid") + finite(f) * F.col(f"{f}_half"), 6))
    return out.drop(*[f"{f}_{s}" for f in factors for s in ("mid", "half")])


def _coded(df: DataFrame, factors: Sequence[str], ranges: DataFrame, by: Sequence[str]) -> DataFrame:
    out = attach(df, ranges, by)
    for f in factors:
        out = out.withColumn(f, F.when(F.col(f"{f}_half") == 0, 0.0).otherwise((F.col(f).cast("double") - F.col(f"{f}_mid")) / F.col(f"{f}_half")))
    return out.drop(*[f"{f}_{s}" for f in factors for s in ("mid", "half")])


# -------------------------------------------------------------- factorials

def factorial_terms(factors: Sequence[str], order: int, runs: int) -> list[str]:
    """Products up to `order` (3 at most), as many as leave the intercept a run; main effects always stay."""
    terms = ["*".join(c) for k in range(1, min(order, 3) + 1) for c in itertools.combinations(factors, k)]
    return terms[:max(len(factors), runs - 1)]


def factorial_model(df: DataFrame, response: str, factors: Sequence[str], by: Sequence[str] = (), order: int = 2,
                    block: str | None = None) -> Model:
    """Least squares on +-1 coded factors (block effect coded)."""
    runs = df.where(finite(response).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("c")).agg(F.min("c")).first()[0] or 0
    work = _coded(df, factors, factor_ranges(df, factors, by), by)
    terms = factorial_terms(factors, order, runs)
    return linear_model(work, response, terms + ([block] if block else []), [block] if block else [], by)


def factorial_effects(model: Model, block: str | None = None, alpha: float = 0.05) -> DataFrame:
    """Effect (twice the coefficient), t, p and the Lenth pseudo-t per term."""
    c = model.coefficients().where("position > 0").drop("position")
    if block:
        c = c.where(~F.col("term").startswith(block + "["))
    e = c.withColumns({"effect": 2 * F.col("coef"), "order": F.size(F.split("term", r"\*"))})
    e = persist(e)
    out = attach(e, lenth(e, "effect", model.by, alpha), model.by)
    return out.withColumns({"t_lenth": ratio(F.col("effect"), F.col("pse")), "significant_lenth": F.abs("effect") > F.col("me")}).select(
        *model.by, "term", "order", "coef", "effect", "se", "t", "p_value", "t_lenth", "significant_lenth")


def lenth(effects: DataFrame, effect: str, by: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    """Pseudo standard error and margins; effect lists are short, so medians are plain aggregates."""
    a = F.abs(finite(effect))
    first = effects.groupBy(*by).agg(F.count(a).alias("m"), (1.5 * F.percentile(a, F.lit(0.5))).alias("_s0"), F.percentile(a, F.lit(0.5)).alias("_med"))
    rows = attach(effects, first, by)
    small = F.when(a < 2.5 * F.col("_s0"), a)
    g = rows.groupBy(*by).agg(F.first("m").alias("m"), (1.5 * F.coalesce(F.percentile(small, F.lit(0.5)), F.first("_med"))).alias("pse"))
    g = g.withColumn("d", F.floor(F.col("m") / 3))
    gamma = (1 + F.pow(F.lit(1 - alpha), 1 / F.col("m"))) / 2
    g = g.withColumns({"_t": dist.apply(dist.t_ppf, F.lit(1 - alpha / 2), F.when(F.col("d") > 0, F.col("d"))),
                       "_g": dist.apply(dist.t_ppf, gamma, F.when(F.col("d") > 0, F.col("d")))})
    return g.select(*by, "m", "pse", "d", (F.col("_t") * F.col("pse")).alias("me"), (F.col("_g") * F.col("pse")).alias("sme"))


def main_effect_means(df: DataFrame, response: str, factors: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """mean, n and se per factor level, all factors in one pass."""
    y = finite(response)
    rows = df.where(y.isNotNull()).select(*by, y.alias("_y"), F.explode(F.array(*[
        F.struct(F.lit(f).alias("factor"), level(f).alias("level")) for f in factors])).alias("_f"))
    return rows.groupBy(*by, F.col("_f.factor").alias("factor"), F.col("_f.level").alias("level")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("_y").alias("mean"), (F.stddev_samp("_y") / F.sqrt(F.count(F.lit(1)))).alias("se"))


def interaction_means(df: DataFrame, response: str, factors: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """mean and n per pair of factor levels, all pairs of factors in one pass."""
    y = finite(response)
    pairs = F.array(*[F.struct(F.lit(a).alias("factor_a"), F.lit(b).alias("factor_b"), level(a).alias("level_a"), level(b).alias("level_b"))
                      for a, b in itertools.combinations(factors, 2)])
    rows = df.where(y.isNotNull()).select(*by, y.alias("_y"), F.explode(pairs).alias("_p")).select(*by, "_y", "_p.*")
    return rows.groupBy(*by, "factor_a", "factor_b", "level_a", "level_b").agg(F.count(F.lit(1)).alias("n"), F.avg("_y").alias("mean"))


def curvature_test(df: DataFrame, response: str, centre: Column, by: Sequence[str] = ()) -> DataFrame:
    """Factorial against centre points."""
    y = finite(response)
    f, c = F.when(~centre, y), F.when(centre, y)
    g = df.groupBy(*by).agg(F.count(f).alias("n_factorial"), F.count(c).alias("n_center"), F.avg(f).alias("mean_factorial"), F.avg(c).alias("mean_center"),
                            F.var_samp(f).alias("_vf"), F.var_samp(c).alias("_vc")).where("n_factorial >= 2 and n_center >= 2")
    nf, nc = F.col("n_factorial").cast("double"), F.col("n_center").cast("double")
    g = g.withColumns({"diff": F.col("mean_factorial") - F.col("mean_center"), "df": nf + nc - 2})
    sp = ((nf - 1) * F.col("_vf") + (nc - 1) * F.col("_vc")) / F.col("df")
    g = g.withColumn("se", F.sqrt(sp * (1 / nf + 1 / nc))).withColumn("t", ratio(F.col("diff"), F.col("se"))).drop("_vf", "_vc")
    return g.withColumn("p_value", p_from_t(F.col("t"), F.col("df"), "two"))


def pure_error(df: DataFrame, response: str, factors: Sequence[str], model: Model, by: Sequence[str] = ()) -> DataFrame:
    """Lack of fit against replicates of the full factor combination."""
    return lack_of_fit(df, factors, response, model, by)


def corner_means(df: DataFrame, response: str, factors: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Mean response per sign combination of up to three coded factors."""
    if len(factors) > 3:
        raise ValueError("at most three factors")
    y = finite(response)
    signs = [F.when(finite(f) > 0, 1).otherwise(-1).alias(f) for f in factors]
    return df.where(y.isNotNull()).groupBy(*by, *signs).agg(F.avg(y).alias("mean"), F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------- response surface

class ResponseSurface(Model):
    """Full quadratic in coded factors with its stationary point."""

    def __init__(self, df: DataFrame, response: str, factors: Sequence[str], by: Sequence[str] = (), coded_input: bool = False,
                 drop_terms: Sequence[str] = ()):
        self.factors, self.response = list(factors), response
        if coded_input:
            ones = df.groupBy(*by).agg(*[F.lit(v).alias(f"{f}_{s}") for f in factors for s, v in (("mid", 0.0), ("half", 1.0))])
            self.ranges = persist(ones)
        else:
            self.ranges = persist(factor_ranges(df, factors, by, axial=True))
        terms = [*factors, *["*".join(p) for p in itertools.combinations(factors, 2)], *[f"{f}^2" for f in factors]]
        work = _coded(df, factors, self.ranges, by)
        super().__init__(work, response, gram.design(work, [t for t in terms if t not in drop_terms]), by)

    def stationary(self) -> DataFrame:
        """Stationary point (coded and real), eigenvalues, nature and predicted value per group."""
        fs, names, k = self.factors, self.names, len(self.factors)
        side = attach(self.table.select(*self.by, "coef"), self.ranges, self.by)

        def one(row):
            b, q = np.zeros(k), np.zeros((k, k))
            coef = np.nan_to_num(np.asarray(row["coef"], float))
            for name, c in zip(names, coef):
                if name.endswith("^2"):
                    i = fs.index(name[:-2])
                    q[i, i] = c
                elif "*" in name:
                    i, j = (fs.index(v) for v in name.split("*"))
                    q[i, j] = q[j, i] = c / 2
                elif name in fs:
                    b[fs.index(name)] = c
            eig = np.linalg.eigvalsh(q)
            xs = -0.5 * np.linalg.pinv(q) @ b
            nature = "maximum" if (eig < -1e-10).all() else "minimum" if (eig > 1e-10).all() else "saddle"
            real = [float(row[f"{f}_mid"] + x * row[f"{f}_half"]) for f, x in zip(fs, xs)]
            return {"coded": xs, "real": real, "eigenvalues": eig, "nature": nature, "predicted": float(coef[0] + b @ xs + xs @ q @ xs)}

        return gram.per_group(side, one, self.by, "coded array<double>, real array<double>, eigenvalues array<double>, nature string, predicted double")

    def grid(self, x: str, y: str, n: int = 40, hold: Mapping[str, float] | None = None) -> DataFrame:
        """n x n predictions over two coded factors in [-1, 1]; the others held."""
        hold = hold or {}
        cells = self.table.select(*self.by).withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(n * n - 1))))
        at = lambda v: -1 + 2 * v / (n - 1)
        cols = {f: F.lit(float(hold.get(f, 0.0))) for f in self.factors}
        cols[x], cols[y] = at(F.col("_i") % n), at(F.floor(F.col("_i") / n))
        return self.predict(cells.withColumns(cols), keep=self.factors).select(*self.by, *self.factors, "fit")


def desirability(y: Column, goal: str, lower: float | None = None, target: float | None = None, upper: float | None = None,
                 weight: float = 1.0) -> Column:
    """Derringer-Suich desirability of a predicted response."""
    rise = lambda: F.pow((y - lower) / (target - lower), F.lit(float(weight)))
    fall = lambda: F.pow((upper - y) / (upper - target), F.lit(float(weight)))
    if goal == "max":
        return F.when(y <= lower, 0.0).when(y >= target, 1.0).otherwise(rise())
    if goal == "min":
        return F.when(y >= upper, 0.0).when(y <= target, 1.0).otherwise(fall())
    return F.when((y < lower) | (y > upper), 0.0).when(y <= target, rise()).otherwise(fall())


def composite(parts: Sequence[tuple[Column, float]]) -> Column:
    """Importance-weighted geometric mean of desirabilities."""
    total = sum(w for _, w in parts)
    logs = [w * F.ln(F.greatest(d, F.lit(1e-12))) for d, w in parts]
    return F.exp(sum(logs[1:], logs[0]) / total)


def optimize(goals: Sequence[tuple[ResponseSurface, dict]], bounds: Mapping[str, tuple[float, float]] | None = None,
             steps: int = 11, rounds: int = 5) -> DataFrame:
    """Best coded settings over a grid of `steps` points a factor, refined around the best point each round.

    `goals` = [(model, {goal, lower, target, upper, weight, importance})].
    """
    factors = goals[0][0].factors
    bounds = {f: (bounds or {}).get(f, (-1.0, 1.0)) for f in factors}
    spark = goals[0][0].table.sparkSession
    box, best = dict(bounds), None
    for _ in range(rounds):
        grid = spark.range(1).drop("id")
        for f in factors:
            lo, hi = box[f]
            grid = grid.withColumn(f, F.explode(F.array(*[F.lit(float(x)) for x in np.linspace(lo, hi, steps)])))
        best = _scored(grid, goals, factors)
        if best is None:
            break
        row = best.orderBy(F.col("composite").desc(), *factors).first()
        box = {f: (max(bounds[f][0], row[f] - (box[f][1] - box[f][0]) / (steps - 1)), min(bounds[f][1], row[f] + (box[f][1] - box[f][0]) / (steps - 1)))
               for f in factors}
    return best.orderBy(F.col("composite").desc(), *factors).limit(1)


def _scored(grid: DataFrame, goals, factors: Sequence[str]) -> DataFrame:
    out, parts = grid, []
    for i, (model, spec) in enumerate(goals):
        row = model.table.select("coef").first()
        x = [F.lit(1.0)]
        for name in model.design.names:
            if name.endswith("^2"):
                x.append(F.col(name[:-2]) ** 2)
            else:
                cols = [F.col(v) for v in name.split("*")]
                x.append(cols[0] if len(cols) == 1 else cols[0] * cols[1])
        terms = [xi * float(c) for xi, c in zip(x, row["coef"]) if c == c]
        out = out.withColumn(f"y{i + 1}", sum(terms[1:], terms[0]))
        args = {a: spec.get(a) for a in ("lower", "target", "upper")}
        out = out.withColumn(f"d{i + 1}", desirability(F.col(f"y{i + 1}"), spec["goal"], weight=spec.get("weight", 1.0), **args))
        parts.append((F.col(f"d{i + 1}"), float(spec.get("importance", 1.0))))
    return out.withColumn("composite", composite(parts)).drop("id")


# ------------------------------------------------------------------ mixtures

def _shares(df: DataFrame, components: Sequence[str]) -> DataFrame:
    """Components scaled to sum to 1.

    Each step is the output of a generator of one row: filters on the shares would otherwise be pushed below it with all the shares'
    expressions copied into them, and generated code of over 8000 bytes a method is not compiled.
    """
    def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
        return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in columns], F.inline(F.array(F.struct(*[e.alias(c) for c, e in columns.items()]))))

    order, total = df.columns, F.col("_total")
    df = once(df, {c: finite(c) for c in components})
    df = df.withColumn("_total", sum((F.col(c) for c in components[1:]), F.col(components[0])))
    return once(df, {c: F.when(total > 0, F.col(c) / total).otherwise(F.col(c)) for c in components}).select(*[F.col(f"`{c}`") for c in order])


def mixture_model(df: DataFrame, components: Sequence[str], response: str, degree: int = 2, by: Sequence[str] = ()) -> Model:
    """Scheffe polynomial of degree 1-3 on components scaled to sum to 1."""
    terms = ["*".join(c) for k in range(1, min(degree, 3) + 1) for c in itertools.combinations(components, k)]
    return linear_model(_shares(df, components), response, terms, by=by, intercept=False)


def mixture_trace(model: Model, components: Sequence[str], steps: int = 21) -> DataFrame:
    """Predicted response along each component's axis through the centroid."""
    q = len(components)
    out = None
    for c in components:
        rows = model.table.select(*model.by).withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
        rows = rows.withColumn("x", F.col("_i") / (steps - 1))
        rows = rows.withColumns({k: F.col("x") if k == c else (1 - F.col("x")) / (q - 1) for k in components})
        one = model.predict(rows, keep=["x"]).select(*model.by, F.lit(c).alias("component"), "x", "fit")
        out = one if out is None else out.unionByName(one)
    return out


def mixture_grid(model: Model, components: Sequence[str], n: int = 40) -> DataFrame:
    """Predictions on a triangular grid of three components."""
    a, b, c = components
    rows = model.table.select(*model.by).withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(n))))
    rows = rows.withColumn("_j", F.explode(F.sequence(F.lit(0), n - F.col("_i"))))
    rows = rows.withColumns({a: F.col("_i") / n, b: F.col("_j") / n}).withColumn(c, 1 - F.col(a) - F.col(b))
    return model.predict(rows, keep=list(components)).select(*model.by, *components, "fit")


# ------------------------------------------------------------------- Taguchi

def signal_to_noise(df: DataFrame, response: str, factors: Sequence[str], kind: str = "smaller", by: Sequence[str] = ()) -> DataFrame:
    """S/N ratio per factor combination."""
    y = finite(response)
    sn = {"smaller": lambda: -10 * F.log10(F.avg(y * y)), "larger": lambda: -10 * F.log10(F.avg(ratio(F.lit(1.0), y * y))),
          "nominal": lambda: 10 * F.log10(ratio(F.avg(y) ** 2, F.var_samp(y)))}[kind]()
    return df.where(y.isNotNull()).groupBy(*by, *[level(f).alias(f) for f in factors]).agg(
        F.count(F.lit(1)).alias("n"), F.avg(y).alias("mean"), sn.alias("sn"))


def signal_to_noise_levels(sn: DataFrame, factors: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Mean S/N per factor level, with each factor's delta and rank."""
    rows = sn.where("sn is not null").unpivot([*by, "sn"], list(factors), "factor", "level")
    means = rows.groupBy(*by, "factor", "level").agg(F.avg("sn").alias("mean_sn"))
    delta = means.groupBy(*by, "factor").agg((F.max("mean_sn") - F.min("mean_sn")).alias("delta"))
    order = Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.col("delta").desc(), "factor")
    delta = delta.withColumn("rank", F.row_number().over(order))
    return attach(means, delta, [*by, "factor"])



cloudpickle.register_pickle_by_value(sys.modules[__name__])
