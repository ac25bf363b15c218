"""Normal distribution as Column expressions."""
from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# Abramowitz & Stegun 7.1.26 (erf) and 26.2.23 (inverse normal) coefficients.
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
ERF_P = 0.3275911
PPF_C = (2.515517, 0.802853, 0.010328)
PPF_D = (1.432788, 0.189269, 0.001308)
EULER_MASCHERONI = 0.5772156649


def erf(x: Column) -> Column:
    ax = F.abs(x)
    t = 1.0 / (1.0 + ERF_P * ax)
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + a) * t
    return F.signum(x) * (1.0 - poly * F.exp(-ax * ax))


def norm_cdf(x: Column) -> Column:
    """Standard normal distribution function, error below 1.5e-7."""
    return 0.5 * (1.0 + erf(x / math.sqrt(2.0)))


def norm_cdf_unscaled(x: Column) -> Column:
    """The significance report's variant: the erf polynomial applied to x itself, not x / sqrt 2."""
    ax = F.abs(x)
    t = 1.0 / (1.0 + ERF_P * ax)
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + a) * t
    sign = F.when(x >= 0, 1.0).otherwise(-1.0)
    return 0.5 * (1.0 + sign * (1.0 - poly * F.exp(-ax * ax)))


def let(x: Column, fn) -> Column:
    """fn(x) with x evaluated once; for formulas on result tables that would otherwise repeat long expressions."""
    return F.get(F.transform(F.array(x), fn), F.lit(0))


def norm_ppf(p: Column, eps: float = 1e-12) -> Column:
    """Inverse normal distribution function by the rational approximation, symmetric around 1/2."""
    def inner(p):
        def z(t):
            num = PPF_C[0] + PPF_C[1] * t + PPF_C[2] * t * t
            return t - num / (1.0 + PPF_D[0] * t + PPF_D[1] * t * t + PPF_D[2] * t * t * t)
        v = let(F.sqrt(-2.0 * F.ln(F.least(p, 1.0 - p))), z)
        return F.when(p < 0.5, -1.0).otherwise(1.0) * v
    return let(F.least(F.greatest(p, F.lit(eps)), F.lit(1.0 - eps)), inner)


# Acklam's rational coefficients for the inverse normal (relative error below 1.2e-9).
ACKLAM_A = (-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02, 1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00)
ACKLAM_B = (-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02, 6.680131188771972e+01, -1.328068155288572e+01)
ACKLAM_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00, -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00)
ACKLAM_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00, 3.754408661907416e+00)
ACKLAM_LOW = 0.02425


def _poly(coef, x: Column) -> Column:
    out = F.lit(coef[0])
    for c in coef[1:]:
        out = out * x + c
    return out


def norm_ppf_precise(p: Column) -> Column:
    """Inverse normal for statistics that were defined with an exact quantile."""
    def inner(p):
        centre = let(p - 0.5, lambda q: _poly(ACKLAM_A, q * q) * q / _poly((*ACKLAM_B, 1.0), q * q))
        tail = let(F.sqrt(-2.0 * F.ln(F.least(p, 1.0 - p))), lambda t: _poly(ACKLAM_C, t) / _poly((*ACKLAM_D, 1.0), t))
        return F.when(p < ACKLAM_LOW, tail).when(p > 1.0 - ACKLAM_LOW, -tail).otherwise(centre)
    return let(F.least(F.greatest(p, F.lit(1e-300)), F.lit(1.0 - 1e-16)), inner)
