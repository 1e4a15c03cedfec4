"""Statistics of evaluation tables, as native columns."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

PSEUDOCOUNT = 1e-6


def ratio(a: Column, b: Column) -> Column:
    """a / b, or 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / F.nullif(b, F.lit(0)))


def precision(tp: Column, fp: Column) -> Column:
    return ratio(tp, tp + fp)


def recall(tp: Column, fn: Column) -> Column:
    return ratio(tp, tp + fn)


def f1(p: Column, r: Column) -> Column:
    return ratio(2 * p * r, p + r)


def cv_filled(area: Column) -> Column:
    """Aggregate: percent of the population deviation over the mean, missing cells as 0, with a pseudocount."""
    x = F.coalesce(area, F.lit(0.0))
    return F.stddev_pop(x) * 100 / (F.avg(x) + PSEUDOCOUNT)


def cv_present(area: Column) -> Column:
    """Aggregate: the same over present cells alone; 0 for a single cell or a mean of 0."""
    return F.when((F.count(area) > 1) & (F.avg(area) != 0), F.stddev_pop(area) * 100 / F.nullif(F.avg(area), F.lit(0.0))).otherwise(F.lit(0.0))


def zero_policy(area: Column, policy: str) -> Column:
    """``zero``: missing is 0; ``missing``: 0 is missing; ``keep``: as it is."""
    if policy not in ("zero", "missing", "keep"):
        raise ValueError(f"policy is zero, missing or keep, not {policy}")
    return {"zero": F.coalesce(area, F.lit(0.0)), "missing": F.nullif(area, F.lit(0.0)), "keep": area}[policy]


def finite(value: Column) -> Column:
    """Infinities and NaN as null."""
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def number(text: Column, default: float | None = None, strict: bool = False) -> Column:
    """A text as a number; what is none becomes ``default`` (null without one), or an error if ``strict``."""
    if strict:
        return text.cast("string").cast("double")
    return F.coalesce(text.cast("string").try_cast("double"), F.lit(default).cast("double"))


def welch_t(ma: Column, va: Column, na: Column, mb: Column, vb: Column, nb: Column) -> Column:
    return F.try_divide(ma - mb, F.sqrt(va / na + vb / nb))


def welch_df(va: Column, na: Column, vb: Column, nb: Column) -> Column:
    a, b = va / na, vb / nb
    return F.try_divide((a + b) * (a + b), a * a / (na - 1) + b * b / (nb - 1))


def _continued(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Lentz's continued fraction of the incomplete beta function, for a whole batch until its last value has settled."""
    away = lambda v: np.where(np.abs(v) > 1e-300, v, 1e-300)
    c, d = np.ones_like(x), 1 / away(1 - (a + b) * x / (a + 1))
    h = d.copy()
    for m in range(1, 400):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / away(1 + top * d)
            c = away(1 + top / c)
            h = h * d * c
        if (np.abs(d * c - 1) < 1e-15).all():
            break
    return h


def chi_square_probabilities(x: pd.Series, df: pd.Series) -> pd.Series:
    """P of a chi-square of at least ``x``, for a whole batch: the regularised upper incomplete gamma function at (df / 2, x / 2), by its series below a + 1 and a continued
    fraction above. Null for no degrees of freedom or no number."""
    x, v = x.to_numpy(float) / 2, df.to_numpy(float) / 2
    out = np.full(len(x), np.nan)
    at = np.flatnonzero(np.isfinite(x) & np.isfinite(v) & (v > 0))
    out[at] = 1.0
    at = at[x[at] > 0]
    a, z = v[at], x[at]
    front = np.exp(a * np.log(z) - z - np.vectorize(math.lgamma, otypes=[float])(a)) if len(at) else z
    low = z < a + 1
    term = total = 1 / a
    for k in range(1, 10_000):
        term = term * np.where(low, z, 0) / (a + k)
        total = total + term
        if not (term > total * 1e-17).any():
            break
    away = lambda y: np.where(np.abs(y) > 1e-300, y, 1e-300)
    b = np.where(low, a + 1, z) + 1 - a
    c, d = np.full_like(b, 1e300), 1 / away(b)
    h = d.copy()
    for k in range(1, 10_000):
        b = b + 2
        d = 1 / away(b - k * (k - a) * d)
        c = away(b - k * (k - a) / c)
        h = h * d * c
        if (np.abs(d * c - 1) < 1e-15).all():
            break
    out[at] = np.where(low, 1 - front * total, front * h)
    return pd.Series(out).astype("Float64").where(~np.isnan(out), pd.NA)


def t_probabilities(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p of Student's t, for a whole batch: the regularised incomplete beta function at df / (df + t²)."""
    t, v = t.to_numpy(float), df.to_numpy(float)
    out = np.full(len(t), np.nan)
    at = np.flatnonzero(np.isfinite(t) & np.isfinite(v) & (v > 0))
    a, b, x = v[at] / 2, np.full(len(at), 0.5), v[at] / (v[at] + t[at] ** 2)
    inside = (x > 0) & (x < 1)
    out[at] = x >= 1
    at, a, b, x = at[inside], a[inside], b[inside], x[inside]
    log_gamma = np.vectorize(math.lgamma, otypes=[float])
    front = np.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * np.log(x) + b * np.log1p(-x)) if len(at) else x
    low = x < (a + 1) / (a + b + 2)
    p, q = np.where(low, a, b), np.where(low, b, a)
    part = front * _continued(p, q, np.where(low, x, 1 - x)) / p
    out[at] = np.where(low, part, 1 - part)
    return pd.Series(out).astype("Float64").where(~np.isnan(out), pd.NA)
