"""Student's t and the normal quantile, which Spark lacks: vectorised numpy behind pandas UDFs."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_log_gamma = np.vectorize(math.lgamma, otypes=[float])


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function by its continued fraction (modified Lentz)."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    flip = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    tiny = 1e-300
    c, d = np.ones_like(y), 1 - (p + q) * y / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 300):
        for top in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + top / np.where(np.abs(c) < tiny, tiny, c)
            step = c * d
            h = h * step
        if np.all((np.abs(step - 1) < 1e-14) | np.isnan(step)):
            break
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(_log_gamma(p + q) - _log_gamma(p) - _log_gamma(q) + p * np.log(y) + q * np.log1p(-y)) / p
    value = np.where(y <= 0, 0.0, np.minimum(front * h, 1.0))
    return np.where(flip, 1 - value, value)


def t_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(|T| >= |t|); 0 for an infinite t, NaN where t or df is missing or df isn't positive."""
    t, df = np.broadcast_arrays(np.asarray(t, float), np.asarray(df, float))
    valid = ~np.isnan(t) & (df > 0)
    d, v = np.where(valid, df, 1.0), np.where(valid & np.isfinite(t), t, 0.0)
    return np.where(valid, np.where(np.isinf(t), 0.0, incomplete_beta(d / 2, 0.5, d / (d + v * v))), np.nan)


def normal_quantile(p: np.ndarray) -> np.ndarray:
    """The inverse of the normal distribution function: a rational start (Acklam), then two Newton-Halley steps."""
    p = np.asarray(p, float)
    # Acklam's coefficients.
    a = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
    b = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
    c = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
    d = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
    tail = np.minimum(p, 1 - p)
    with np.errstate(divide="ignore", invalid="ignore"):
        q = np.sqrt(-2 * np.log(tail))
        outer = np.polyval(c, q) / np.polyval(d, q) * np.where(p < 0.5, 1, -1)
        r = (p - 0.5) ** 2
        inner = np.polyval(a, r) * (p - 0.5) / np.polyval(b, r)
        x = np.where(tail < 0.02425, outer, inner)
        for _ in range(2):
            e = 0.5 * np.vectorize(math.erfc, otypes=[float])(-x / math.sqrt(2)) - p
            u = e * math.sqrt(2 * math.pi) * np.exp(x * x / 2)
            x = x - u / (1 + x * u / 2)
    return np.where((p > 0) & (p < 1), x, np.where(p == 0, -np.inf, np.where(p == 1, np.inf, np.nan)))


def _nulls(x: np.ndarray) -> pd.Series:
    return pd.Series([None if np.isnan(v) else float(v) for v in x], dtype=object)


@F.pandas_udf(T.DoubleType())
def _t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    return _nulls(t_two_sided(t.to_numpy(float), df.to_numpy(float)))


@F.pandas_udf(T.DoubleType())
def _normal_quantile(p: pd.Series) -> pd.Series:
    return _nulls(normal_quantile(p.to_numpy(float)))


def p_of_t(t: Column, df: Column) -> Column:
    """Two-sided p of Student's t; NULL where t or df is, or where df isn't positive."""
    return _t_two_sided(t.cast("double"), df.cast("double"))


def quantile_of_normal(p: Column) -> Column:
    return _normal_quantile(p.cast("double"))


def t_of_rho(rho: Column, df: Column) -> Column:
    """t of a correlation with df degrees of freedom; infinite at |rho| of 1 or more."""
    return F.when(F.abs(rho) >= 1, F.lit(float("inf"))).otherwise(F.abs(rho) * F.sqrt(F.try_divide(F.greatest(df, F.lit(0.0)), 1 - rho * rho)))


def p_spatial(rho: Column, n_eff: Column) -> Column:
    """df = n_eff - 2, NULL at 2; 0 at |rho| of 1 or more."""
    df = n_eff - 2
    return F.when(F.abs(rho) >= 1, F.lit(0.0)).otherwise(p_of_t(t_of_rho(rho, df), F.when(df > 0, df)))


def p_screening(rho: Column, n_eff: Column) -> Column:
    """df = n_eff - 2, 1 at least."""
    return p_of_t(t_of_rho(rho, n_eff - 2), F.greatest(n_eff - 2, F.lit(1.0)))


def p_mechanism(rho: Column, n_eff: Column) -> Column:
    """1 if n_eff is 2 or less, 0 at |rho| of 1 or more."""
    return F.when(F.abs(rho) >= 1, F.lit(0.0)).when(n_eff <= 2, F.lit(1.0)).otherwise(p_of_t(t_of_rho(rho, n_eff - 2), F.when(n_eff > 2, n_eff - 2)))
