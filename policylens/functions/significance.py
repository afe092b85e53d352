"""p-values of the drift tests."""

import math

import numpy as np
from pyspark.sql import functions as F

SERIES_TERMS = 100
SERIES_START = 0.2
QUADRATURE_FROM = 100
NODES = 40


def kolmogorov_p(z):
    """Two-sided p-value of sqrt(n1 n2 / (n1 + n2)) * D by Kolmogorov's series."""
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(SERIES_TERMS)),
        F.lit(0.0),
        lambda total, k: total + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * z * z),
    )
    return (
        F.when(z.isNull(), None)
        .when(z < SERIES_START, 1.0)
        .otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2.0 * series)))
    )


def _integral(density, low, high):
    """Gauss-Legendre sum of `density`, a function of a column, from `low` to `high`."""
    nodes = F.array(*[
        F.struct(F.lit(float(x)).alias("x"), F.lit(float(w)).alias("w")) for x, w in zip(*np.polynomial.legendre.leggauss(NODES))])
    half = (high - low) / 2.0
    return half * F.aggregate(
        nodes, F.lit(0.0), lambda total, node: total + node["w"] * density(low + half * (node["x"] + 1.0)))


def _few_degrees(dof, z):
    """The tail as a sum of floor(dof / 2) terms, to which an odd number of degrees adds that of the normal distribution.

    Terms are carried as logarithms, so that a statistic far out gives 0.
    """
    root, odd = F.sqrt(z), dof % 2 == 1
    terms = F.least(F.floor(dof / 2), F.lit(QUADRATURE_FROM)).cast("int")
    shift = F.when(odd, 0.5).otherwise(0.0)
    first = F.when(odd, F.log(root) - F.lit(math.log(math.sqrt(math.pi) / 2))).otherwise(0.0) - z
    summed = F.aggregate(
        F.sequence(F.lit(1), F.greatest(terms, F.lit(1))),
        F.struct(first.alias("term"), F.lit(0.0).alias("total")),
        lambda sofar, i: F.struct(
            (sofar["term"] + F.log(z) - F.log(i + shift)).alias("term"),
            (sofar["total"] + F.when(i <= terms, F.exp(sofar["term"])).otherwise(0.0)).alias("total")),
        lambda sofar: sofar["total"])
    normal = F.lit(2 / math.sqrt(math.pi)) * F.exp(-z) * _integral(
        lambda t: F.exp(-t * (t + 2.0 * root)), F.lit(0.0), F.least(F.lit(6.0), 20.0 / root))
    return summed + F.when(odd, normal).otherwise(0.0)


def _many_degrees(dof, z):
    """The tail by quadrature around the peak of the integrand, so the work does not follow the degrees."""
    peak = dof / 2.0 - 1.0
    root = F.sqrt(peak)
    above = z > peak
    end = F.when(above, F.greatest(peak + 11.5 * root, z + 6.0 * root)).otherwise(
        F.greatest(F.lit(0.0), F.least(peak - 7.5 * root, z - 5.0 * root)))
    mass = _integral(lambda t: F.exp(peak * F.log1p((t - peak) / peak) - (t - peak)), z, end)
    # Stirling's series of the gamma function, at 100 and above.
    scale = F.exp(-0.5 * F.log(2 * math.pi * peak) - 1.0 / (12.0 * peak) + 1.0 / (360.0 * peak * peak * peak))
    return F.when(above, mass * scale).otherwise(1.0 + mass * scale)


def chi_square_p(x, dof):
    """P(chi-square with `dof` degrees > x), the upper regularised gamma function at (dof / 2, x / 2).

    Null where `x` is missing or `dof` is below 1, and 1 where `x` is not above 0.
    """
    x, dof = (F.col(c) if isinstance(c, str) else c for c in (x, dof))
    z = x / 2.0
    tail = F.when(dof / 2.0 >= QUADRATURE_FROM, _many_degrees(dof, z)).otherwise(_few_degrees(dof, z))
    return (
        F.when(x.isNull() | F.isnan(x) | dof.isNull() | (dof < 1), None)
        .when(x <= 0, 1.0)
        .otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), tail)))
    )
