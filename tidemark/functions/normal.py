"""Normal distribution as columns and as plain functions, by fixed approximations that keep results comparable."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Five-term tail polynomial of the normal distribution function (Abramowitz and Stegun).
TAIL_T = 0.2316419
TAIL = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
DENSITY = 0.3989422804014327

# Rational approximation of the normal quantile (Acklam).
CENTRE_NUMERATOR = (-3.969683028665376e1, 2.209460984245205e2, -2.759285104469687e2, 1.383577518672690e2, -3.066479806614716e1, 2.506628277459239)
CENTRE_DENOMINATOR = (-5.447609879822406e1, 1.615858368580409e2, -1.556989798598866e2, 6.680131188771972e1, -1.328068155288572e1)
TAIL_NUMERATOR = (-7.784894002430293e-3, -3.223964580411365e-1, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
TAIL_DENOMINATOR = (7.784695709041462e-3, 3.224671290700398e-1, 2.445134137142996, 3.754408661907416)
LOW = 0.02425

EULER_MASCHERONI = 0.5772156649015329


def cdf(z: Column) -> Column:
    """Probability below z."""
    t = 1 / (1 + TAIL_T * F.abs(z))
    total = F.lit(0.0)
    for c in reversed(TAIL):
        total = t * (F.lit(c) + total)
    p = DENSITY * F.exp(-z * z / 2) * total
    return F.when(z >= 0, 1 - p).otherwise(p)


def cdf_sql(z: str) -> str:
    t = f"(1 / (1 + {TAIL_T}::DOUBLE * abs({z})))"
    total = "0::DOUBLE"
    for c in reversed(TAIL):
        total = f"{t} * ({c}::DOUBLE + {total})"
    p = f"({DENSITY}::DOUBLE * exp(-({z}) * ({z}) / 2) * ({total}))"
    return f"CASE WHEN ({z}) >= 0 THEN 1 - {p} ELSE {p} END"


def quantile(p: float) -> float:
    if p <= 0:
        return -math.inf
    if p >= 1:
        return math.inf
    if p > 1 - LOW:
        return -quantile(1 - p)
    poly = lambda cs, x: sum(c * x**k for k, c in enumerate(reversed(cs)))
    if p < LOW:
        q = math.sqrt(-2 * math.log(p))
        return poly(TAIL_NUMERATOR, q) / poly((*TAIL_DENOMINATOR, 1.0), q)
    q = p - 0.5
    return poly(CENTRE_NUMERATOR, q * q) * q / poly((*CENTRE_DENOMINATOR, 1.0), q * q)


def expected_max_sharpe(variance: float, trials: float) -> float:
    """What the best of so many worthless trials shows by chance."""
    if trials <= 1:
        return 0.0
    a, b = quantile(1 - 1 / trials), quantile(1 - 1 / (trials * math.e))
    return math.sqrt(max(variance, 0)) * ((1 - EULER_MASCHERONI) * a + EULER_MASCHERONI * b)
