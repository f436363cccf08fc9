"""Distribution functions.

``with_normal_quantile`` uses Column expressions because it meets many rows. The others are NumPy helpers for
rows that are already aggregated, one per test.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# tasks get these helpers by value: executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Wichura (1988), algorithm AS 241, PPND16; lowest power first.
CENTRE_TOP = (
    3.3871328727963666080e0,
    1.3314166789178437745e2,
    1.9715909503065514427e3,
    1.3731693765509461125e4,
    4.5921953931549871457e4,
    6.7265770927008700853e4,
    3.3430575583588128105e4,
    2.5090809287301226727e3,
)
CENTRE_BOTTOM = (
    1.0,
    4.2313330701600911252e1,
    6.8718700749205790830e2,
    5.3941960214247511077e3,
    2.1213794301586595867e4,
    3.9307895800092710610e4,
    2.8729085735721942674e4,
    5.2264952788528545610e3,
)
MIDDLE_TOP = (
    1.42343711074968357734e0,
    4.63033784615654529590e0,
    5.76949722146069140550e0,
    3.64784832476320460504e0,
    1.27045825245236838258e0,
    2.41780725177450611770e-1,
    2.27238449892691845833e-2,
    7.74545014278341407640e-4,
)
MIDDLE_BOTTOM = (
    1.0,
    2.05319162663775882187e0,
    1.67638483018380384940e0,
    6.89767334985100004550e-1,
    1.48103976427480074590e-1,
    1.51986665636164571966e-2,
    5.47593808499534494600e-4,
    1.05075007164441684324e-9,
)
FAR_TOP = (
    6.65790464350110377720e0,
    5.46378491116411436990e0,
    1.78482653991729133580e0,
    2.96560571828504891230e-1,
    2.65321895265761230930e-2,
    1.24266094738807843860e-3,
    2.71155556874348757815e-5,
    2.01033439929228813265e-7,
)
FAR_BOTTOM = (
    1.0,
    5.99832206555887937690e-1,
    1.36929880922735805310e-1,
    1.48753612908506148525e-2,
    7.86869131145613259100e-4,
    1.84631831751005468180e-5,
    1.42151175831644588870e-7,
    2.04426310338993978564e-15,
)


def polynomial(coefficients, x: str) -> Column:
    """Horner's rule over a SQL expression ``x``; one parsed text instead of many Column calls."""
    text = f"{coefficients[-1]!r}D"
    for c in reversed(coefficients[:-1]):
        text = f"({text} * ({x}) + {c!r}D)"
    return F.expr(text)


def with_normal_quantile(df: DataFrame, p: Column, name: str) -> DataFrame:
    """Add the inverse of the standard normal distribution function at ``p``, for 0 < p < 1.

    Built in steps, so that each intermediate value is a column and is computed once.
    """
    steps = df.withColumn("_p", p).withColumns(
        {
            "_q": F.col("_p") - 0.5,
            "_near": 0.180625 - (F.col("_p") - 0.5) * (F.col("_p") - 0.5),
            "_tail": F.sqrt(-F.log(F.least(F.col("_p"), 1 - F.col("_p")))),
        }
    )
    q, tail = F.col("_q"), F.col("_tail")
    centre = q * polynomial(CENTRE_TOP, "_near") / polynomial(CENTRE_BOTTOM, "_near")
    steps = steps.withColumns({"_t": F.when(tail <= 5.0, tail - 1.6).otherwise(tail - 5.0)})
    middle = polynomial(MIDDLE_TOP, "_t") / polynomial(MIDDLE_BOTTOM, "_t")
    far = polynomial(FAR_TOP, "_t") / polynomial(FAR_BOTTOM, "_t")
    value = (
        F.when(F.abs(q) <= 0.425, centre)
        .when(tail <= 5.0, F.signum(q) * middle)
        .otherwise(F.signum(q) * far)
    )
    return steps.withColumn(name, value).drop("_p", "_q", "_near", "_tail", "_t")


_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(24)
# panels of a tail, in units of the distance over which the integrand falls by a factor of e
_PANELS = np.array([0.0, 1, 2, 4, 8, 16, 32, 64, 128])


def _tail_integral(log_ratio, start: np.ndarray, unit: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Integral of exp(log_ratio(u)) from ``start`` to ``end``, element by element.

    ``log_ratio`` is 0 at ``start`` and falls from there; ``unit`` is about the distance in which it falls by 1. Gauss
    quadrature on panels of growing width, so the number of steps depends on no argument.
    """
    marks = np.minimum(start[:, None] + unit[:, None] * _PANELS, end[:, None])
    marks = np.column_stack([marks, end])
    half = np.diff(marks, axis=1) / 2
    points = marks[:, :-1, None] + half[:, :, None] * (1 + _NODES)
    return (np.exp(log_ratio(points)) * _WEIGHTS * half[:, :, None]).sum(axis=(1, 2))


def normal_upper(z: np.ndarray) -> np.ndarray:
    """P(Z > z); NaN stays NaN."""
    size = np.abs(z)
    # density at z times the integral of exp(-z u - u^2 / 2)
    rest = _tail_integral(
        lambda u: -size[:, None, None] * u - u * u / 2, np.zeros_like(size), 1 / (size + 1), np.full_like(size, 40.0)
    )
    upper = np.exp(-size * size / 2) / math.sqrt(2 * math.pi) * rest
    return np.where(z < 0, 1 - upper, upper)


def _cosine_tail(start: np.ndarray, power: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Integral of cos^power from the angle with tangent ``start`` to pi / 2: (logarithm of the first value, rest)."""
    square = start * start
    angle = np.arctan(start)

    def log_ratio(points: np.ndarray) -> np.ndarray:
        # by tangents, as cosines near 1 have no digits left; a panel may end at pi / 2
        t = np.tan(np.minimum(points, np.pi / 2 - 1e-15))
        first = square[:, None, None]
        return -0.5 * power[:, None, None] * np.log1p((t * t - first) / (1 + first))

    unit = 1 / (power * start + np.sqrt(power + 1))
    return -0.5 * power * np.log1p(square), _tail_integral(log_ratio, angle, unit, np.full_like(angle, np.pi / 2))


def _student_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    """The tail of the density over its half, both as integrals of a power of the cosine; one way for any df >= 1."""
    t, df = np.abs(t.to_numpy(float)), df.to_numpy(float)
    known = np.isfinite(t) & np.isfinite(df) & (df >= 1)
    out = np.full(len(t), np.nan)
    power = df[known] - 1
    log_first, rest = _cosine_tail(t[known] / np.sqrt(df[known]), power)
    _, half = _cosine_tail(np.zeros(len(power)), power)
    out[known] = np.minimum(np.exp(log_first) * rest / half, 1.0)
    return pd.Series(out)


def _chi_square_upper(x: pd.Series, df: pd.Series) -> pd.Series:
    """The finite sum that the upper tail is for a whole number of degrees of freedom; NaN for others."""
    x, df = x.to_numpy(float), df.to_numpy(float)
    known = np.isfinite(x) & np.isfinite(df) & (df >= 1) & (df == np.floor(df))
    value, whole = np.maximum(x[known], 0.0), df[known].astype(int)
    odd = whole % 2 == 1
    total = np.where(odd, 2 * normal_upper(np.sqrt(value)), np.exp(-value / 2))
    # the terms exp(-x / 2) (x / 2)^k / gamma(k + 1), for k = 1, 2, ... or 1/2, 3/2, ...
    log_half = np.log(np.maximum(value / 2, 1e-300))
    for step in range(1, int(whole.max(initial=1)) // 2 + 1):
        k = np.where(odd, step - 0.5, float(step))
        log_gamma = np.where(odd, math.lgamma(step + 0.5), math.lgamma(step + 1.0))
        total += np.where(2 * k <= whole - 1, np.exp(k * log_half - value / 2 - log_gamma), 0.0)
    out = np.full(len(x), np.nan)
    out[known] = np.minimum(total, 1.0)
    return pd.Series(out)


def _normal_upper(z: pd.Series) -> pd.Series:
    return pd.Series(normal_upper(z.to_numpy(float)))


def student_two_sided(t: Column, df: Column) -> Column:
    """Two-sided p-value of Student's t; NULL where an input is NULL."""
    udf = F.pandas_udf(_student_two_sided, T.DoubleType())
    return F.nanvl(udf(t, df), F.lit(None).cast("double"))


def chi_square_upper(x: Column, df: Column) -> Column:
    udf = F.pandas_udf(_chi_square_upper, T.DoubleType())
    return F.nanvl(udf(x, df), F.lit(None).cast("double"))


def normal_upper_tail(z: Column) -> Column:
    udf = F.pandas_udf(_normal_upper, T.DoubleType())
    return F.nanvl(udf(z), F.lit(None).cast("double"))
