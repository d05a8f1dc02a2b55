"""Least squares, general linear models, selection and logistic regression."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dist
from ..functions.normal import norm_cdf, with_norm_ppf
from ..functions.numeric import finite, level, ratio
from ..plans import gram
from ..plans.joining import attach
from ..plans.ordering import block_window, blocks, prefix, sequence
from ..plans.session import persist


class Model:
    """A fitted linear model: a Spark table with one row per group, plus its design."""

    def __init__(self, df: DataFrame, y: str | Column, dm: gram.Design, by: Sequence[str] = ()):
        self.source, self.y, self.design, self.by = df, y, dm, list(by)
        self.table = persist(gram.fit(df, y, dm, by))

    @property
    def names(self) -> list[str]:
        return (["(intercept)"] if self.design.intercept else []) + self.design.names

    def summary(self) -> DataFrame:
        """R2, adjusted R2, s, model F, AIC, BIC, AICc."""
        one = int(self.design.intercept)
        n, p, sse = F.col("n"), F.col("p"), F.col("sse")
        t = self.table.select(*self.by, n, p, "rank", "sse", "sst", "dfe", (F.col("rank") - one).cast("double").alias("dfm"))
        t = t.withColumns({"mse": ratio(sse, F.col("dfe")), "r2": 1 - ratio(sse, F.col("sst"))})
        like = n * F.ln(sse / n)
        t = t.withColumns({
            "r2_adjusted": 1 - (1 - F.col("r2")) * ratio(n - one, F.col("dfe")), "s": F.sqrt("mse"),
            "f": ratio(F.col("sst") - sse, F.col("dfm") * F.col("mse")),
            "aic": like + 2 * p, "bic": like + p * F.ln(n),
            "aicc": like + 2 * p + 2 * p * (p + 1) / F.greatest(F.lit(1.0), n - p - 1)})
        return t.withColumn("p_value", dist.apply(dist.f_sf, F.col("f"), F.col("dfm"), F.col("dfe")))

    def coefficients(self, conf: float = 0.95) -> DataFrame:
        names = F.array(*[F.lit(n) for n in self.names])
        t = self.table.select(*self.by, "dfe", F.posexplode(F.arrays_zip(names.alias("term"), F.col("coef"), F.col("se"))).alias("position", "_c"))
        t = t.select(*self.by, "dfe", F.col("position"), F.col("_c.term").alias("term"), finite("_c.coef").alias("coef"), finite("_c.se").alias("se"))
        t = t.withColumn("t", ratio(F.col("coef"), F.col("se")))
        t = t.withColumns({"p_value": dist.apply(dist.t_sf2, F.col("t"), F.col("dfe")),
                           "_q": dist.apply(dist.t_ppf, F.lit((1 + conf) / 2), F.col("dfe"))})
        return t.withColumns({"ci_low": F.col("coef") - F.col("_q") * F.col("se"),
                              "ci_high": F.col("coef") + F.col("_q") * F.col("se")}).drop("_q", "dfe")

    def anova(self) -> DataFrame:
        """Sequential (type I) and adjusted (type III) sum of squares per term."""
        labels = F.array(*[F.lit(t) for t, _ in self.design.terms])
        t = self.table.select(*self.by, "dfe", ratio(F.col("sse"), F.col("dfe")).alias("_mse"), F.posexplode(F.arrays_zip(
            labels.alias("term"), F.col("term_df"), F.col("ss_seq"), F.col("ss_adj"))).alias("position", "_c"))
        t = t.select(*self.by, "position", F.col("_c.term").alias("term"), F.col("_c.term_df").alias("df"), F.col("_c.ss_seq").alias("ss_seq"),
                     F.col("_c.ss_adj").alias("ss_adj"), "dfe", "_mse")
        t = t.withColumns({"f_seq": ratio(F.col("ss_seq"), F.col("df") * F.col("_mse")),
                           "f_adj": ratio(F.col("ss_adj"), F.col("df") * F.col("_mse"))})
        return t.withColumns({"p_seq": dist.apply(dist.f_sf, F.col("f_seq"), F.col("df"), F.col("dfe")),
                              "p_adj": dist.apply(dist.f_sf, F.col("f_adj"), F.col("df"), F.col("dfe"))}).drop("_mse")

    # scoring -----------------------------------------------------------

    def _row(self) -> list[Column]:
        return ([F.lit(1.0)] if self.design.intercept else []) + [F.col(c) for c in self.design.columns]

    def _with_fit(self, rows: DataFrame) -> DataFrame:
        side = self.table.select(*self.by, "coef", "inv", "sse", "dfe", F.col("n").alias("_n"), F.col("sst").alias("_sst"))
        rows = attach(rows, side, self.by)
        xs = self._row()
        k = len(xs)
        coef = lambda i: F.coalesce(F.nanvl(F.get("coef", F.lit(i)), F.lit(0.0)), F.lit(0.0))
        fitted = sum((x * coef(i) for i, x in enumerate(xs[1:], 1)), xs[0] * coef(0))
        terms = [xs[i] * xs[j] * F.get("inv", F.lit(i * k + j)) * (1.0 if i == j else 2.0) for i in range(k) for j in range(i, k)]
        return rows.withColumns({"fitted": fitted, "leverage": sum(terms[1:], terms[0]), "_mse": F.col("sse") / F.col("dfe")})

    def diagnostics(self, keep: Sequence[str] = ()) -> DataFrame:
        """Fitted, residual, leverage, standardised and studentised residual, Cook's distance."""
        rows = self._with_fit(gram.design_rows(self.source, self.design, self.y, self.by, keep))
        e, h, k = F.col("residual"), F.col("leverage"), len(self._row())
        rows = rows.withColumn("residual", F.col("_y") - F.col("fitted"))
        room = F.greatest(F.lit(1e-12), 1 - h)
        s2 = F.when(F.col("dfe") > 1, (F.col("sse") - e * e / (1 - h)) / (F.col("dfe") - 1))
        rows = rows.withColumn("standardized", ratio(e, F.sqrt(F.col("_mse") * room)))
        rows = rows.withColumns({
            "studentized": ratio(e, F.sqrt(F.greatest(F.lit(1e-300), s2 * (1 - h)))),
            "cook": F.col("standardized") ** 2 * h / (k * room)})
        out = [*self.by, *[c for c in keep if c not in self.by]]
        return rows.select(*out, F.col("_y").alias("observed"), "fitted", "residual", "leverage", "standardized", "studentized", "cook")

    def press(self) -> DataFrame:
        """Prediction sum of squares and its R2 (one more pass)."""
        d = self.diagnostics()
        p = d.groupBy(*self.by).agg(F.sum((F.col("residual") / (1 - F.col("leverage"))) ** 2).alias("press"))
        out = attach(self.table.select(*self.by, "sst"), p, self.by)
        return out.select(*self.by, "press", (1 - ratio(F.col("press"), F.col("sst"))).alias("r2_press"))

    def durbin_watson(self, order_by: Sequence[str]) -> DataFrame:
        d = sequence(self.diagnostics(order_by).select(*self.by, *order_by, "residual"), self.by, order_by)
        d = blocks(d, before=1)
        step = F.col("residual") - F.lag("residual").over(block_window(self.by))
        d = d.withColumn("_s", step * step).where("_own")
        return d.groupBy(*self.by).agg((F.sum("_s") / F.sum(F.col("residual") ** 2)).alias("durbin_watson"))

    def predict(self, new: DataFrame, conf: float = 0.95, keep: Sequence[str] = ()) -> DataFrame:
        """Fit with confidence and prediction interval for new rows."""
        rows = self._with_fit(gram.design_rows(new, self.design, None, self.by, keep))
        t = dist.apply(dist.t_ppf, F.lit((1 + conf) / 2), F.col("dfe"))
        side = self.table.select(*self.by, "dfe").withColumn("_t", t).select(*self.by, "_t")
        rows = attach(rows, side, self.by)
        q = F.greatest(F.lit(0.0), F.col("leverage"))
        rows = rows.withColumns({"se_fit": F.sqrt(F.col("_mse") * q), "se_pred": F.sqrt(F.col("_mse") * (1 + q))})
        m, tc = F.col("fitted"), F.col("_t")
        return rows.select(
            *self.by, *[c for c in keep if c not in self.by], m.alias("fit"), "se_fit", "se_pred",
            (m - tc * F.col("se_fit")).alias("ci_low"), (m + tc * F.col("se_fit")).alias("ci_high"),
            (m - tc * F.col("se_pred")).alias("pi_low"), (m + tc * F.col("se_pred")).alias("pi_high"))

    def ls_means(self, factor: str, conf: float = 0.95) -> DataFrame:
        """Marginal means of a factor: other factors averaged, covariates at their mean."""
        dm, lv = self.design, self.design.levels[factor]
        out = None
        for i, name in enumerate(lv):
            row: list[Column] = [F.lit(1.0)] if dm.intercept else []
            for (_, cols), variables in zip(dm.terms, dm.variables):
                for j, c in enumerate(cols):
                    if variables == (factor,):
                        row.append(F.lit(1.0 if j == i else (-1.0 if i == len(lv) - 1 else 0.0)))
                    elif len(variables) == 1 and variables[0] not in dm.levels:
                        row.append(F.get("means", F.lit(c)))
                    else:
                        row.append(F.lit(0.0))
            k = len(row)
            coef = lambda q: F.nanvl(F.get("coef", F.lit(q)), F.lit(0.0))
            mean = sum((x * coef(q) for q, x in enumerate(row[1:], 1)), row[0] * coef(0))
            quad = [row[a] * row[b] * F.get("inv", F.lit(a * k + b)) for a in range(k) for b in range(k)]
            one = self.table.select(*self.by, "dfe", F.lit(name).alias("level"), mean.alias("mean"),
                                    F.sqrt(sum(quad[1:], quad[0]) * F.col("sse") / F.col("dfe")).alias("se"))
            out = one if out is None else out.unionByName(one)
        half = dist.apply(dist.t_ppf, F.lit((1 + conf) / 2), F.col("dfe"))
        out = out.withColumn("_t", half)
        return out.withColumns({"ci_low": F.col("mean") - F.col("_t") * F.col("se"),
                                "ci_high": F.col("mean") + F.col("_t") * F.col("se")}).drop("_t", "dfe")

    def vif(self) -> DataFrame:
        """Variance inflation of every design column, from the same cross moments."""
        names = self.design.names
        rows = gram.design_rows(self.source, self.design, self.y, self.by)
        g = gram.moments(rows, self.design.columns, self.by)

        def one(r):
            k = len(names)
            c = gram.square(r["cov"], k)
            d = np.sqrt(np.diag(c))
            inv = np.linalg.pinv(c / np.outer(d, d))
            return [{"term": names[i], "vif": float(inv[i, i])} for i in range(k)]

        return gram.per_group(g, one, self.by, "term string, vif double")


def linear_model(df: DataFrame, y: str, terms: Sequence[str], categorical: Sequence[str] = (), by: Sequence[str] = (),
                 intercept: bool = True) -> Model:
    """General linear model: terms A, A*B, A^2; factors effect coded."""
    return Model(df, y, gram.design(df, terms, categorical, intercept), by)


def design_columns(df: DataFrame, terms: Sequence[str], categorical: Sequence[str] = (), keep: Sequence[str] = (),
                   centre: bool = False) -> DataFrame:
    """The generated design columns of the complete rows, under their term names."""
    means = None
    if centre:
        numeric = sorted({v for t in terms for v in t.replace("^", "*").split("*") if v in df.columns and v not in categorical})
        row = df.agg(*[F.avg(finite(v)).alias(v) for v in numeric]).first()
        means = {v: row[v] for v in numeric}
    dm = gram.design(df, terms, categorical, centre=means)
    rows = gram.design_rows(df, dm, None, keep)
    return rows.withColumnsRenamed(dict(zip(dm.columns, dm.names)))


def polynomial(df: DataFrame, x: str, y: str, degree: int, by: Sequence[str] = ()) -> Model:
    return linear_model(df, y, [x] + [f"{x}^{d}" for d in range(2, degree + 1)], by=by)


def lack_of_fit(df: DataFrame, x: Sequence[str], y: str, model: Model, by: Sequence[str] = ()) -> DataFrame:
    """Lack-of-fit F from the pure error of replicated predictor values (8 digits)."""
    rows = df.select(*by, *[F.round(finite(c), 8).alias(f"_g{i}") for i, c in enumerate(x)], finite(y).alias("_y")).na.drop()
    cells = rows.groupBy(*by, *[f"_g{i}" for i in range(len(x))]).agg(F.count(F.lit(1)).alias("_n"), F.var_pop("_y").alias("_v"))
    pure = cells.groupBy(*by).agg(F.sum(F.col("_n") * F.col("_v")).alias("pure_ss"), F.sum(F.col("_n") - 1).cast("double").alias("pure_df"))
    t = attach(model.table.select(*by, "sse", "dfe"), pure, by)
    t = t.withColumns({"lof_ss": F.col("sse") - F.col("pure_ss"), "lof_df": F.col("dfe") - F.col("pure_df")})
    t = t.where("pure_df > 0 and lof_df > 0").select(*by, "lof_ss", "lof_df", "pure_ss", "pure_df")
    t = t.withColumn("f", ratio(F.col("lof_ss") / F.col("lof_df"), F.col("pure_ss") / F.col("pure_df")))
    return t.withColumn("p_value", dist.apply(dist.f_sf, F.col("f"), F.col("lof_df"), F.col("pure_df")))


def scatter_fit(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Complete pairs, r, R2 and the simple line."""
    a, b = finite(x), finite(y)
    ok = a.isNotNull() & b.isNotNull()
    return df.groupBy(*by).agg(
        F.count_if(ok).alias("n"), F.corr(a, b).alias("r"), F.regr_r2(b, a).alias("r2"),
        F.regr_slope(b, a).alias("slope"), F.regr_intercept(b, a).alias("intercept"))


def scatter_band(df: DataFrame, x: str, y: str, by: Sequence[str] = (), points: int = 80, conf: float = 0.95) -> DataFrame:
    """Fitted line with confidence and prediction band on an even grid."""
    model = polynomial(df, x, y, 1, by)
    a = finite(x)
    g = df.where(finite(y).isNotNull()).groupBy(*by).agg(F.min(a).alias("_lo"), F.max(a).alias("_hi"))
    g = g.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    g = g.withColumn(x, F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("point") / (points - 1))
    return model.predict(g.select(*by, "point", x), conf, keep=["point", x])


def residual_plot_data(model: Model, order_by: Sequence[str]) -> DataFrame:
    """Residual against fitted and row order, with its normal score."""
    d = sequence(model.diagnostics(order_by), model.by, order_by, "row_order")
    d = sequence(d, model.by, ["residual", "row_order"], "_i", "_n")
    return with_norm_ppf(d, "normal_score", (F.col("_i") - 0.375) / (F.col("_n") + 0.25)).drop("_i", "_n")


# --------------------------------------------------------------- selection

def _subset(g: dict, columns: Sequence[int], terms) -> dict:
    """Solve a sub-model from the full cross moments."""
    k = len(g["means"])
    c = gram.square(g["cov"], k)
    idx = [*columns, k - 1]
    sub = c[np.ix_(idx, idx)]
    place = {col: i for i, col in enumerate(columns)}
    t = [(name, [place[col] for col in cols]) for name, cols in terms]
    return gram.solve(g["n"], np.asarray(g["means"])[idx], sub[np.triu_indices(len(idx))], t)


def _chosen(terms, names):
    picked = [(n, dict(terms)[n]) for n in names]
    return [c for _, cols in picked for c in cols], picked


def stepwise(df: DataFrame, y: str, candidates: Sequence[str], categorical: Sequence[str] = (), by: Sequence[str] = (),
             alpha_in: float = 0.15, alpha_out: float = 0.15, direction: str = "both", max_steps: int = 60) -> DataFrame:
    """Forward/backward selection on adjusted p-values.

    One pass collects the cross moments of all candidates; every step is a
    solve on the small matrix.
    """
    dm = gram.design(df, candidates, categorical)
    g = gram.moments(gram.design_rows(df, dm, y, by), [*dm.columns, "_y"], by)
    terms, names = dm.terms, [t for t, _ in dm.terms]

    def p_values(row, inside):
        cols, picked = _chosen(terms, inside)
        s = _subset(row, cols, picked)
        mse = s["sse"] / s["dfe"] if s["dfe"] > 0 else np.nan
        f = [a / d / mse if d and mse > 0 else np.nan for a, d in zip(s["ss_adj"], s["term_df"])]
        p = [float(dist.f_sf(v, d, s["dfe"])) if np.isfinite(v) else 1.0 for v, d in zip(f, s["term_df"])]
        r2 = 1 - (s["sse"] / s["dfe"]) / (s["sst"] / (s["n"] - 1))
        return p, float(r2)

    def run(row):
        inside = list(names) if direction == "backward" else []
        out = []
        for _ in range(max_steps):
            changed = False
            if direction != "backward":
                trials = [(p_values(row, inside + [c]), c) for c in names if c not in inside]
                if trials:
                    (p, r2), c = min(((t[0][0][-1], t[0][1]), t[1]) for t in trials)
                    if p < alpha_in:
                        inside.append(c)
                        out.append({"step": len(out) + 1, "action": "added", "variable": c, "p": p, "r2_adjusted": r2})
                        changed = True
            if direction != "forward" and len(inside) > 1:
                p, _ = p_values(row, inside)
                worst = int(np.argmax(p))
                if p[worst] > alpha_out:
                    out.append({"step": len(out) + 1, "action": "removed", "variable": inside.pop(worst), "p": p[worst], "r2_adjusted": None})
                    changed = True
            if not changed:
                break
        return out + [{"step": len(out) + 1 + i, "action": "final", "variable": v, "p": None, "r2_adjusted": None} for i, v in enumerate(inside)]

    return gram.per_group(g, run, by, "step int, action string, variable string, p double, r2_adjusted double")


def smallest_errors(corr: np.ndarray, groups: Sequence[Sequence[int]]) -> dict[int, tuple[int, ...]]:
    """Per size the set of terms (groups of columns) with the least residual sum of squares, by branch and bound.

    `corr` is a correlation matrix whose last variable is the response.  Terms are dropped one after the other from the full
    set; no subset of a set fits better than the set itself, so a branch ends where every size that it can still reach
    has a set that fits as well.  The term that is missed most is dropped first, which gives the widest branches
    the highest bounds.  Of sets that fit equally well one is returned.
    """
    y = len(corr) - 1
    every = [c for cols in groups for c in cols]
    regular = not every or np.linalg.eigvalsh(corr[np.ix_(every, every)])[0] > 1e-8
    best: dict[int, tuple[float, tuple[int, ...]]] = {}

    def error(kept: Sequence[int]) -> float:
        cols = [c for t in kept for c in groups[t]]
        r = corr[cols, y]
        return float(1 - r @ np.linalg.lstsq(corr[np.ix_(cols, cols)], r, rcond=1e-10)[0]) if cols else 1.0

    def note(value: float, kept: Sequence[int]) -> None:
        if kept and (len(kept) not in best or value < best[len(kept)][0]):
            best[len(kept)] = (value, tuple(sorted(kept)))

    def without(kept: Sequence[int], own: float, drops: Sequence[int]) -> list[float]:
        """Errors of `kept` without each of `drops`."""
        if not regular:
            return [error([t for t in kept if t != d]) for d in drops]
        cols = [c for t in kept for c in groups[t]]
        inverse = np.linalg.inv(corr[np.ix_(cols, cols)])
        coef, place = inverse @ corr[cols, y], {c: i for i, c in enumerate(cols)}
        out = []
        for d in drops:
            at = [place[c] for c in groups[d]]
            if len(at) == 1:
                out.append(own + coef[at[0]] ** 2 / inverse[at[0], at[0]])
            else:
                out.append(own + float(coef[at] @ np.linalg.solve(inverse[np.ix_(at, at)], coef[at])))
        return out

    def branch(kept: list[int], own: float, drops: list[int]) -> None:
        missed = sorted(zip(without(kept, own, drops), drops), reverse=True)
        for k in range(len(missed) - 1, -1, -1):  # narrow branches first: they find good sets soon
            value, drop = missed[k]
            rest = [t for t in kept if t != drop]
            note(value, rest)
            later = [d for _, d in missed[k + 1:]]
            fewest = max(len(rest) - len(later), 1)
            if later and fewest < len(rest) and (fewest not in best or best[fewest][0] > value):
                branch(rest, value, later)

    terms = list(range(len(groups)))
    chosen: list[int] = []  # forward selection gives the first bounds
    for _ in terms:
        value, t = min((error([*chosen, t]), t) for t in terms if t not in chosen)
        chosen.append(t)
        note(value, chosen)
    if terms:
        branch(terms, error(terms), terms)
    return {size: kept for size, (_, kept) in sorted(best.items())}


def best_subsets(df: DataFrame, y: str, candidates: Sequence[str], categorical: Sequence[str] = (), by: Sequence[str] = (),
                 best_only: bool = True) -> DataFrame:
    """The subset of each size with the highest R2, with adjusted R2, Cp, AICc, BIC; all subsets without `best_only`.

    One pass collects the cross moments.  The best subsets are found exactly for any number of candidates; the time of a group
    depends on how different the candidates are (30 take seconds where some matter more than others).  All subsets
    of p candidates are 2^p rows, so they are listed for up to 12.
    """
    if not best_only and len(candidates) > 12:
        raise ValueError("all subsets are listed for at most 12 candidates")
    dm = gram.design(df, candidates, categorical)
    g = gram.moments(gram.design_rows(df, dm, y, by), [*dm.columns, "_y"], by)
    terms, names = dm.terms, [t for t, _ in dm.terms]
    square = gram.square

    def picks(row):
        if not best_only:
            return [pick for size in range(1, len(names) + 1) for pick in itertools.combinations(names, size)]
        c = square(row["cov"], len(row["means"]))
        scale = np.sqrt(np.where(np.diag(c) > 0, np.diag(c), 1.0))
        found = smallest_errors(c / np.outer(scale, scale), [cols for _, cols in terms])
        return [tuple(names[t] for t in kept) for kept in found.values()]

    def run(row):
        full = _subset(row, *_chosen(terms, names))
        mse = full["sse"] / full["dfe"]
        out = []
        for pick in picks(row):
            size, s = len(pick), _subset(row, *_chosen(terms, pick))
            n, p = s["n"], s["p"]
            like = n * np.log(s["sse"] / n)
            out.append({
                "size": size, "variables": list(pick), "r2": 1 - s["sse"] / s["sst"],
                "r2_adjusted": 1 - (s["sse"] / s["dfe"]) / (s["sst"] / (n - 1)), "s": float(np.sqrt(s["sse"] / s["dfe"])),
                "cp": s["sse"] / mse - (n - 2 * (size + 1)), "bic": like + p * np.log(n),
                "aicc": like + 2 * p + 2 * p * (p + 1) / max(1.0, n - p - 1)})
        return out

    return gram.per_group(g, run, by, "size int, variables array<string>, r2 double, r2_adjusted double, s double, cp double, bic double, aicc double")


# ---------------------------------------------------------------- logistic

class LogisticModel:
    """Binary logistic regression by Spark ML's iteratively reweighted least squares."""

    def __init__(self, df: DataFrame, y: Column, terms: Sequence[str], categorical: Sequence[str] = (), trials: str | None = None):
        from pyspark.ml.feature import VectorAssembler
        from pyspark.ml.regression import GeneralizedLinearRegression

        self.design = gram.design(df, terms, categorical)
        keep = [trials] if trials else []
        label = finite(y.cast("double") / F.col(trials) if trials else y.cast("double"))
        rows = gram.design_rows(df.withColumn("_label", label), self.design, "_label", (), keep)
        rows = persist(rows)
        data = VectorAssembler(inputCols=self.design.columns, outputCol="features").transform(rows)
        glr = GeneralizedLinearRegression(family="binomial", link="logit", labelCol="_y", featuresCol="features",
                                          maxIter=60, tol=1e-10, solver="irls")
        if trials:
            glr = glr.setWeightCol(trials)
        self.fit = glr.fit(data)
        self.rows, self.trials, self.data = rows, trials, data
        self.spark = df.sparkSession

    def coefficients(self) -> DataFrame:
        s = self.fit.summary
        beta = [self.fit.intercept, *self.fit.coefficients]
        se = s.coefficientStandardErrors
        se = [se[-1], *se[:-1]]
        rows = [(i, n, float(b), float(e)) for i, (n, b, e) in enumerate(zip(["(intercept)", *self.design.names], beta, se))]
        t = self.spark.createDataFrame(rows, "position int, term string, coef double, se double")
        t = t.withColumn("z", ratio(F.col("coef"), F.col("se"))).withColumn("_a", -F.abs("z"))
        return t.withColumns({"p_value": 2 * norm_cdf(F.col("_a")), "odds_ratio": F.exp("coef")}).drop("_a")

    def summary(self) -> DataFrame:
        s = self.fit.summary
        p = len(self.design.names) + 1
        n = self.rows.count()
        t = self.spark.createDataFrame([(n, p, float(s.deviance), float(s.nullDeviance))], "n bigint, p int, deviance double, null_deviance double")
        t = t.withColumns({"g": F.col("null_deviance") - F.col("deviance"), "df": (F.col("p") - 1).cast("double"),
                           "r2_mcfadden": 1 - F.col("deviance") / F.col("null_deviance"),
                           "aic": F.col("deviance") + 2 * F.col("p"), "bic": F.col("deviance") + F.col("p") * F.ln("n")})
        return t.withColumn("p_value", dist.apply(dist.chi2_sf, F.col("g"), F.col("df")))

    def _probability(self) -> Column:
        beta = [float(self.fit.intercept), *map(float, self.fit.coefficients)]
        eta = sum((F.col(c) * b for c, b in zip(self.design.columns, beta[1:])), F.lit(beta[0]))
        return 1 / (1 + F.exp(-eta))

    def scores(self) -> DataFrame:
        """Predicted probability next to the 0/1 outcome (the observed share, with `trials`), in the JVM."""
        more = [F.col(self.trials).alias("trials")] if self.trials else []
        return self.rows.select(F.col("_y").alias("outcome"), self._probability().alias("probability"), *more)

    def predict(self, new: DataFrame, keep: Sequence[str] = (), threshold: float = 0.5) -> DataFrame:
        """(keep, probability, predicted) for new rows; predicted is 1 from `threshold` on.

        Rows with a missing covariate have no row in the result.  A level that the fit has not met is coded 0 in
        all columns of its factor, the middle of the known levels.
        """
        rows = gram.design_rows(new, self.design, None, (), keep).withColumn("probability", self._probability())
        return rows.select(*keep, "probability", (F.col("probability") >= threshold).cast("int").alias("predicted"))

    def expected(self) -> DataFrame:
        """(position, term, observed, expected): sums of each design column over events seen and predicted, equal at the maximum of the likelihood."""
        weight = F.col(self.trials).cast("double") if self.trials else F.lit(1.0)
        columns = [F.lit(1.0), *[F.col(c) for c in self.design.columns]]
        rows = self.rows.withColumn("_p", self._probability())
        sums = rows.agg(*[F.sum(x * weight * F.col(v)).alias(f"{v}{i}") for i, x in enumerate(columns) for v in ("_y", "_p")])
        lines = [F.struct(F.lit(i).alias("position"), F.lit(name).alias("term"), F.col(f"_y{i}").alias("observed"), F.col(f"_p{i}").alias("expected"))
                 for i, name in enumerate(["(intercept)", *self.design.names])]
        return sums.select(F.explode(F.array(*lines)).alias("_l")).select("_l.*")

    def concordance(self) -> DataFrame:
        return concordance(self.scores(), "probability", F.col("outcome") == 1)


def concordance(df: DataFrame, score: str, event: Column, by: Sequence[str] = ()) -> DataFrame:
    """% concordant and discordant pairs and Somers' D from running counts over distinct scores."""
    cells = df.where(finite(score).isNotNull()).groupBy(*by, finite(score).alias("_s")).agg(
        F.count_if(event).alias("_e"), F.count_if(~event).alias("_z"))
    cum = prefix(cells, by, ["_s"], {"_below": "_z"}, {"_ne": "_e", "_nz": "_z"})
    e, z, below, nz = (F.col(c).cast("double") for c in ("_e", "_z", "_below", "_nz"))
    g = cum.groupBy(*by).agg(F.sum(e * below).alias("_c"), F.sum(e * (nz - below - z)).alias("_d"),
                             (F.max("_ne").cast("double") * F.max("_nz")).alias("pairs"))
    return g.select(*by, F.col("pairs").cast("bigint").alias("pairs"), (100 * ratio(F.col("_c"), F.col("pairs"))).alias("concordant"),
                    (100 * ratio(F.col("_d"), F.col("pairs"))).alias("discordant"),
                    ratio(F.col("_c") - F.col("_d"), F.col("pairs")).alias("somers_d"))


def success_flag(column: str, success: str | None = None) -> Column:
    """0/1 outcome: a named level, a positive number, or a yes-like word."""
    c = level(column)
    if success is not None:
        return (c == success).cast("double")
    return F.coalesce((c.try_cast("double") > 0), F.lower(c).isin("true", "yes", "y", "si", "sì", "vero")).cast("double")
