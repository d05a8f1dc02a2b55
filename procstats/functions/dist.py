"""Distribution functions applied to *aggregated* rows through Arrow UDFs.

Spark SQL has no incomplete beta/gamma functions.  Everything here is numpy,
vectorised over a batch; operators call it only on rows that are already one
per group, so the Python cost does not grow with the table.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F


def _each(fn, *arrays):
    """Scalar function over broadcast arrays; repeated arguments are computed once."""
    arrays = np.broadcast_arrays(*(np.asarray(a, float) for a in arrays))
    seen: dict = {}
    flat = []
    for args in zip(*(a.ravel() for a in arrays)):
        if args not in seen:
            seen[args] = fn(*args)
        flat.append(seen[args])
    return np.array(flat, float).reshape(arrays[0].shape)


def _lgamma(x):
    return _each(math.lgamma, x)


def _erfc(x):
    return _each(math.erfc, x)


def norm_cdf(z):
    return 0.5 * _erfc(-np.asarray(z, float) / math.sqrt(2))


def norm_ppf(p):
    return bisect(norm_cdf, p, -40.0, 40.0)


def bisect(cdf, p, lo, hi, steps=200):
    """Solve cdf(x) = p for an increasing cdf, element by element."""
    p = np.asarray(p, float)
    lo, hi = np.full(p.shape, float(lo)), np.full(p.shape, float(hi))
    for _ in range(steps):
        mid = 0.5 * (lo + hi)
        below = cdf(mid) < p
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    return 0.5 * (lo + hi)


def beta_cdf(x, a, b):
    """Regularised incomplete beta by the continued fraction (modified Lentz)."""
    x, a, b = np.broadcast_arrays(*(np.asarray(v, float) for v in (x, a, b)))
    x = np.clip(x, 0.0, 1.0)
    swap = x > (a + 1) / (a + b + 2)
    xx, aa, bb = np.where(swap, 1 - x, x), np.where(swap, b, a), np.where(swap, a, b)
    with np.errstate(all="ignore"):
        front = np.exp(
            _lgamma(aa + bb) - _lgamma(aa) - _lgamma(bb) + aa * np.log(xx) + bb * np.log1p(-xx)
        ) / aa
        tiny = 1e-300
        c = np.ones_like(xx)
        d = 1 - (aa + bb) * xx / (aa + 1)
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        h = d.copy()
        for m in range(1, 2000):
            for num in (
                m * (bb - m) * xx / ((aa + 2 * m - 1) * (aa + 2 * m)),
                -(aa + m) * (aa + bb + m) * xx / ((aa + 2 * m) * (aa + 2 * m + 1)),
            ):
                d = 1 + num * d
                d = 1 / np.where(np.abs(d) < tiny, tiny, d)
                c = 1 + num / c
                c = np.where(np.abs(c) < tiny, tiny, c)
                h = h * d * c
            if np.nanmax(np.abs(d * c - 1), initial=0.0) < 1e-16:
                break
        val = np.where(xx <= 0, 0.0, front * h)
    return np.where(swap, 1 - val, val)


def beta_ppf(p, a, b):
    return bisect(lambda x: beta_cdf(x, a, b), p, 0.0, 1.0)


def gamma_cdf(x, a):
    """Regularised lower incomplete gamma."""
    return _gamma_pair(x, a)[0]


def gamma_sf(x, a):
    return _gamma_pair(x, a)[1]


def _gamma_pair(x, a):
    x, a = np.broadcast_arrays(np.asarray(x, float), np.asarray(a, float))
    x = np.maximum(x, 0.0)
    with np.errstate(all="ignore"):
        front = np.exp(a * np.log(x) - x - _lgamma(a))
        term = 1 / a
        total = term.copy() if isinstance(term, np.ndarray) else np.asarray(term)
        ap = a.copy()
        small = x < a + 1
        for _ in range(100000):
            ap = ap + 1
            term = term * x / ap
            total = np.where(small, total + term, total)
            if not np.any(small & (np.abs(term) > np.abs(total) * 1e-17)):
                break
        low_series = front * total
        tiny = 1e-300
        b = x + 1 - a
        c = np.full(x.shape, 1 / tiny)
        d = 1 / np.where(np.abs(b) < tiny, tiny, b)
        h = d.copy()
        for i in range(1, 100000):
            an = -i * (i - a)
            b = b + 2
            d = an * d + b
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = b + an / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            step = d * c
            h = h * step
            if not np.any(~small & (np.abs(step - 1) > 1e-16)):
                break
        up_fraction = front * h
    low = np.where(x <= 0, 0.0, np.where(small, low_series, 1 - up_fraction))
    up = np.where(x <= 0, 1.0, np.where(small, 1 - low_series, up_fraction))
    return low, up


def t_cdf(t, df):
    t, df = np.broadcast_arrays(np.asarray(t, float), np.asarray(df, float))
    tail = 0.5 * beta_cdf(df / (df + t * t), df / 2, 0.5)
    return np.where(t > 0, 1 - tail, tail)


def t_sf2(t, df):
    """Two-sided p-value."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    return beta_cdf(df / (df + t * t), df / 2, 0.5)


def t_ppf(p, df):
    return bisect(lambda x: t_cdf(x, df), p, -1e7, 1e7)


def chi2_cdf(x, df):
    return gamma_cdf(np.asarray(x, float) / 2, np.asarray(df, float) / 2)


def chi2_sf(x, df):
    return gamma_sf(np.asarray(x, float) / 2, np.asarray(df, float) / 2)


def chi2_ppf(p, df):
    df = np.asarray(df, float)
    return bisect(lambda x: chi2_cdf(x, df), p, 0.0, np.nanmax(df, initial=1.0) * 20 + 2000)


def f_cdf(x, d1, d2):
    x, d1, d2 = (np.asarray(v, float) for v in (x, d1, d2))
    x = np.maximum(x, 0)
    return beta_cdf(d1 * x / (d1 * x + d2), d1 / 2, d2 / 2)


def f_sf(x, d1, d2):
    x, d1, d2 = (np.asarray(v, float) for v in (x, d1, d2))
    x = np.maximum(x, 0)
    return beta_cdf(d2 / (d1 * x + d2), d2 / 2, d1 / 2)


def f_ppf(p, d1, d2):
    u = beta_ppf(p, np.asarray(d1, float) / 2, np.asarray(d2, float) / 2)
    return np.asarray(d2, float) * u / (np.asarray(d1, float) * (1 - u))


def binom_cdf(k, n, p):
    """P(X <= k)."""
    k, n, p = np.broadcast_arrays(*(np.asarray(v, float) for v in (k, n, p)))
    k = np.floor(k)
    inner = (k >= 0) & (k < n)
    out = beta_cdf(1 - p, np.where(inner, n - k, 1.0), np.where(inner, k + 1, 1.0))
    return np.where(k < 0, 0.0, np.where(k >= n, 1.0, out))


def binom_pmf(k, n, p):
    k, n, p = (np.asarray(v, float) for v in (k, n, p))
    with np.errstate(all="ignore"):
        a = np.where(k > 0, k * np.log(p), 0.0)
        b = np.where(n - k > 0, (n - k) * np.log1p(-p), 0.0)
        return np.exp(_lgamma(n + 1) - _lgamma(k + 1) - _lgamma(n - k + 1) + a + b)


def poisson_cdf(k, mu):
    k = np.floor(np.asarray(k, float))
    return np.where(k < 0, 0.0, gamma_sf(mu, np.maximum(k, 0) + 1))


def binom_test_two_sided(k, n, p):
    """Total probability of the outcomes at most as likely as k.

    The mass function falls on both sides of its mode, so the far tail starts
    at a point found by bisection and both tails are beta functions.
    """
    k, n, p = (np.array(v, float) for v in np.broadcast_arrays(k, n, p))
    with np.errstate(all="ignore"):
        limit = binom_pmf(k, n, p) * (1 + 1e-9)
        top = np.floor((n + 1) * p)
        low_side = k <= top
        # low side observed: smallest j > mode with pmf <= limit; high side: largest j < mode
        lo, hi = np.where(low_side, top, -1.0), np.where(low_side, n + 1, top)
        for _ in range(64):
            mid = np.floor((lo + hi) / 2)
            inside = (mid >= 0) & (mid <= n)
            small = np.where(inside, binom_pmf(np.clip(mid, 0, n), n, p) <= limit, True)
            open_ = hi - lo > 1
            go = small == low_side
            hi = np.where(open_ & go, mid, hi)
            lo = np.where(open_ & ~go, mid, lo)
        far = np.where(low_side, hi, lo)
        near = np.where(low_side, binom_cdf(k, n, p), 1 - binom_cdf(k - 1, n, p))
        other = np.where(low_side, 1 - binom_cdf(far - 1, n, p), binom_cdf(far, n, p))
    return np.where(k == top, 1.0, np.minimum(1.0, near + other))


def clopper_low(k, n, conf):
    k, n = np.asarray(k, float), np.asarray(n, float)
    ok = k > 0
    return np.where(ok, beta_ppf((1 - np.asarray(conf, float)) / 2, np.where(ok, k, 1), n - k + 1), 0.0)


def clopper_high(k, n, conf):
    k, n = np.asarray(k, float), np.asarray(n, float)
    ok = k < n
    return np.where(ok, beta_ppf((1 + np.asarray(conf, float)) / 2, k + 1, np.where(ok, n - k, 1)), 1.0)


def poisson_low(k, conf):
    k = np.asarray(k, float)
    ok = k > 0
    return np.where(ok, chi2_ppf((1 - np.asarray(conf, float)) / 2, np.where(ok, 2 * k, 2)) / 2, 0.0)


def poisson_high(k, conf):
    return chi2_ppf((1 + np.asarray(conf, float)) / 2, 2 * np.asarray(k, float) + 2) / 2


def _fisher(a, b, c, d, keep):
    """Sum hypergeometric probabilities; terms beyond 40 standard deviations are below 1e-300."""
    out = []
    for a0, b0, c0, d0 in zip(*(np.atleast_1d(np.asarray(v, float)) for v in (a, b, c, d))):
        r1, c1, n = a0 + b0, a0 + c0, a0 + b0 + c0 + d0
        centre = r1 * c1 / n if n else 0.0
        reach = 40 * math.sqrt(max(centre * (n - r1) * (n - c1) / max(n * n, 1), 1)) + 50
        k = np.arange(max(0, r1 + c1 - n, min(a0, math.floor(centre - reach))),
                      min(r1, c1, max(a0, math.ceil(centre + reach))) + 1)
        lp = (
            math.lgamma(r1 + 1) + math.lgamma(n - r1 + 1) + math.lgamma(c1 + 1)
            + math.lgamma(n - c1 + 1) - math.lgamma(n + 1)
            - _lgamma(k + 1) - _lgamma(r1 - k + 1) - _lgamma(c1 - k + 1) - _lgamma(n - r1 - c1 + k + 1)
        )
        pr = np.exp(lp)
        out.append(min(1.0, pr[keep(k, pr, a0)].sum()))
    return np.array(out)


def fisher_two_sided(a, b, c, d):
    """Tables at most as likely as the observed one."""
    return _fisher(a, b, c, d, lambda k, pr, a0: pr <= pr[int(a0 - k[0])] * (1 + 1e-9))


def fisher_less(a, b, c, d):
    return _fisher(a, b, c, d, lambda k, pr, a0: k <= a0)


def fisher_greater(a, b, c, d):
    return _fisher(a, b, c, d, lambda k, pr, a0: k >= a0)


def kolmogorov_sf(x):
    x = np.asarray(x, float)
    j = np.arange(1, 101)[:, None]
    series = 2 * np.sum((-1.0) ** (j - 1) * np.exp(-2 * j * j * np.atleast_1d(x)[None, :] ** 2), axis=0)
    return np.where(np.atleast_1d(x) < 0.2, 1.0, np.clip(series, 0, 1)).reshape(x.shape)


def _chi_scale_nodes(df, n=64):
    """Nodes and weights for s = sqrt(chi2_df / df)."""
    if not np.isfinite(df) or df > 5000:
        return np.array([1.0]), np.array([1.0])
    sd = 1 / math.sqrt(2 * df)
    lo, hi = max(1e-9, 1 - 9 * sd), 1 + 9 * sd + (3 if df < 5 else 0)
    x, w = np.polynomial.legendre.leggauss(n)
    s = 0.5 * (hi - lo) * x + 0.5 * (hi + lo)
    logf = (df / 2) * math.log(df / 2) + math.log(2) - math.lgamma(df / 2) + (df - 1) * np.log(s) - df * s * s / 2
    return s, 0.5 * (hi - lo) * w * np.exp(logf)


def _ptukey_one(q, k, df):
    if not q > 0:
        return 0.0
    s, ws = _chi_scale_nodes(df)
    z, wz = np.polynomial.legendre.leggauss(96)
    z, wz = 9 * z, 9 * wz * np.exp(-0.5 * (9 * z) ** 2) / math.sqrt(2 * math.pi)
    inner = norm_cdf(z)[None, :] - norm_cdf(z[None, :] - (q * s)[:, None])
    h = k * np.sum(wz[None, :] * np.clip(inner, 0, 1) ** (k - 1), axis=1)
    return float(min(1.0, np.sum(ws * h) / ws.sum() if len(ws) > 1 else h[0]))


def tukey_cdf(q, k, df):
    return _each(_ptukey_one, q, k, df)


def tukey_sf(q, k, df):
    return 1 - tukey_cdf(q, k, df)


def _qtukey_one(p, k, df):
    lo, hi = 0.0, 200.0
    for _ in range(60):
        mid = 0.5 * (lo + hi)
        if _ptukey_one(mid, k, df) < p:
            lo = mid
        else:
            hi = mid
    return 0.5 * (lo + hi)


def tukey_ppf(p, k, df):
    return _each(_qtukey_one, p, k, df)


def _pdunnett_one(c, m, rho, df):
    """P(max |T_i| <= c) for m comparisons sharing a control, equal correlation rho."""
    if not c > 0:
        return 0.0
    s, ws = _chi_scale_nodes(df)
    z, wz = np.polynomial.legendre.leggauss(96)
    z, wz = 9 * z, 9 * wz * np.exp(-0.5 * (9 * z) ** 2) / math.sqrt(2 * math.pi)
    lam, den = math.sqrt(rho), math.sqrt(1 - rho)
    up = norm_cdf((lam * z[None, :] + (c * s)[:, None]) / den)
    dn = norm_cdf((lam * z[None, :] - (c * s)[:, None]) / den)
    h = np.sum(wz[None, :] * np.clip(up - dn, 0, 1) ** m, axis=1)
    return float(min(1.0, np.sum(ws * h) / ws.sum() if len(ws) > 1 else h[0]))


def dunnett_sf(c, m, rho, df):
    return 1 - _each(_pdunnett_one, c, m, rho, df)


def _qdunnett_one(p, m, rho, df):
    lo, hi = 0.0, 100.0
    for _ in range(60):
        mid = 0.5 * (lo + hi)
        if _pdunnett_one(mid, m, rho, df) < p:
            lo = mid
        else:
            hi = mid
    return 0.5 * (lo + hi)


def dunnett_ppf(p, m, rho, df):
    return _each(_qdunnett_one, p, m, rho, df)


def c4(n):
    """E[s]/sigma for any, also fractional, n."""
    n = np.asarray(n, float)
    return np.sqrt(2 / (n - 1)) * np.exp(_lgamma(n / 2) - _lgamma((n - 1) / 2))


def median_ci_rank(n, conf):
    """Largest k whose two order statistics k and n-k+1 keep the coverage; NaN below 6."""
    n = np.asarray(n, float)
    alpha = 1 - np.asarray(conf, float)
    lo, hi = np.zeros(n.shape), np.floor(n / 2)
    for _ in range(64):
        mid = np.ceil((lo + hi) / 2)
        ok = 2 * binom_cdf(mid - 1, n, 0.5) <= alpha
        lo, hi = np.where(ok, mid, lo), np.where(ok, hi, np.maximum(mid - 1, lo))
    return np.where(n < 6, np.nan, np.maximum(lo, 1))


def apply(fn, *cols: Column | float) -> Column:
    """Run a vectorised function of this module over double columns; NULL in, NULL out."""

    @F.pandas_udf("double")
    def run(*series: pd.Series) -> pd.Series:
        arrays = [s.to_numpy(dtype=float, na_value=np.nan) for s in series]
        bad = np.zeros(len(arrays[0]), bool)
        for a in arrays:
            bad |= np.isnan(a)
        out = np.full(len(arrays[0]), np.nan)
        if (~bad).any():
            out[~bad] = fn(*(a[~bad] for a in arrays))
        return pd.Series(out).where(np.isfinite(out), None).astype("Float64")

    args = [(c if isinstance(c, Column) else F.lit(float(c))).cast("double") for c in cols]
    return run(*args)


# Workers need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
