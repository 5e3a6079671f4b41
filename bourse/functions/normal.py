"""The standard normal distribution as column expressions, so ranks stay inside the JVM."""

import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tasks get these functions by value, so they need no copy of the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Hart's rational approximation of the normal tail.
TAIL_TOP = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871,
            221.213596169931, 220.206867912376)
TAIL_BOTTOM = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674,
               637.333633378831, 793.826512519948, 440.413735824752)
# Acklam's rational approximation of the inverse.
CENTRE_TOP = (-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02, 1.383577518672690e+02,
              -3.066479806614716e+01, 2.506628277459239e+00)
CENTRE_BOTTOM = (-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02, 6.680131188771972e+01,
                 -1.328068155288572e+01, 1.0)
EDGE_TOP = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00, -2.549732539343734e+00,
            4.374664141464968e+00, 2.938163982698783e+00)
EDGE_BOTTOM = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00, 3.754408661907416e+00, 1.0)
EDGE = 0.02425


def _poly(x: Column, factors) -> Column:
    out = F.lit(factors[0])
    for f in factors[1:]:
        out = out * x + F.lit(f)
    return out


def cdf(x: Column) -> Column:
    a = F.abs(x)
    near = _poly(a, TAIL_TOP) / _poly(a, TAIL_BOTTOM)
    far = 1 / ((a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 0.65))))) * 2.506628274631)
    tail = F.exp(-a * a / 2) * F.when(a < 7.07106781186547, near).otherwise(far)
    return F.when(x > 0, 1 - tail).otherwise(tail)


def cdf_array(x: np.ndarray) -> np.ndarray:
    """The same approximation over whole arrays."""
    a = np.abs(x)
    near = np.polyval(TAIL_TOP, a) / np.polyval(TAIL_BOTTOM, a)
    with np.errstate(divide="ignore", over="ignore"):
        far = 1 / ((a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 0.65))))) * 2.506628274631)
    tail = np.exp(-a * a / 2) * np.where(a < 7.07106781186547, near, far)
    return np.where(x > 0, 1 - tail, tail)


def erf(x: Column) -> Column:
    return 2 * cdf(x * F.lit(2.0**0.5)) - 1


def with_inverse(df: DataFrame, p: str, out: str) -> DataFrame:
    """Add the quantile of column p in (0, 1), NULL outside.

    One column per step keeps each expression small; the last step is a correction that brings the
    approximation to double precision.
    """
    prob = F.col(p)
    df = df.withColumns({"_q": prob - 0.5, "_low": F.sqrt(-2 * F.log(F.least(prob, 1 - prob)))})
    q, low = F.col("_q"), F.col("_low")
    centre = q * _poly(q * q, CENTRE_TOP) / _poly(q * q, CENTRE_BOTTOM)
    edge = _poly(low, EDGE_TOP) / _poly(low, EDGE_BOTTOM)
    df = df.withColumn("_first", F.when(prob < EDGE, edge).when(prob > 1 - EDGE, -edge).otherwise(centre))
    first = F.col("_first")
    df = df.withColumn("_err", (cdf(first) - prob) * F.lit(2.506628274631000502) * F.exp(first * first / 2))
    fixed = first - F.col("_err") / (1 + first * F.col("_err") / 2)
    return df.withColumn(out, F.when((prob > 0) & (prob < 1), fixed)).drop("_q", "_low", "_first", "_err")
