"""Quantization, robust scale and score expressions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

LIMITS = {8: 127, 16: 32767}
SMALLEST_SCALE = 1e-6


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f(x)`` with ``x`` worked out once."""
    return F.transform(F.array(x), f)[0]


def quantized(value: Column, scale: Column, bits: int = 8) -> Column:
    """Nearest step, halves away from zero, clamped to the range of ``bits``."""
    top = LIMITS[bits]
    return F.least(F.greatest(F.round(value / scale.cast("double")), F.lit(float(-top - 1))), F.lit(float(top))).cast("int")


def dequantized(step: Column, scale: Column) -> Column:
    return step * scale.cast("double")


def adaptive_scale(largest: Column, bits: int = 8) -> Column:
    """The scale at which ``largest`` is the last step, as FLOAT; what vanishes as FLOAT gets a floor instead."""
    step = (largest / LIMITS[bits]).cast("float")
    return F.when(step > 0, step).otherwise(F.lit(SMALLEST_SCALE).cast("float"))


def shrinkage_weight(kappa: float, sigma: Column, n: Column) -> Column:
    """L1 weight kappa * sigma * sqrt(2 ln n) for a solve over ``n`` series."""
    return kappa * sigma * F.sqrt(2 * F.log(n.cast("double")))


def soft_threshold(x: Column, t: Column) -> Column:
    return F.signum(x) * F.greatest(F.abs(x) - t, F.lit(0.0)) + 0.0  # no negative zero


def interval_score(y: Column, lo: Column, hi: Column, mad: Column, floor: float = 1e-9) -> Column:
    """How far y is outside its band (negative: inside), in units of the running MAD."""
    return F.greatest(lo - y, y - hi) / F.greatest(mad, F.lit(floor))


def pareto_quantile(p: Column, xi: float, sigma: float, threshold: float = 0.0) -> Column:
    """Quantile function of the generalized Pareto distribution."""
    if abs(xi) < 1e-12:
        return threshold - sigma * F.log1p(-p)
    return threshold + sigma / xi * (F.pow(1 - p, F.lit(-xi)) - 1)


def gate(c: float, n: Column, sigma: Column) -> Column:
    """Residual gate c * sqrt(n) * sigma."""
    return c * F.sqrt(n) * sigma


def merged_trust(support: Column, active: Column, emitters: Column, snr: float) -> Column:
    """full if support/active * emitters * snr^2 reaches 3, else partial."""
    return F.when(F.coalesce(support / F.nullif(active, F.lit(0)), F.lit(0.0)) * emitters * snr * snr >= 3.0, "full").otherwise("partial")


def hour_of_week_profile(hour: Column) -> Column:
    """Relative load by hour of the week: a daily wave, weekends lower."""
    day = F.floor(hour / 24) % 7
    return (1 + 0.3 * F.sin(2 * 3.141592653589793 * (hour % 24 - 8) / 24)) * F.when(day >= 5, 0.7).otherwise(1.0)


def median_abs_deviation(values: str) -> Column:
    """sigma from the median absolute deviation of an array column."""
    med = array_median(F.col(values))
    return array_median(F.transform(values, lambda v: F.abs(v - med))) / 0.6745


def array_median(values: Column) -> Column:
    """Median of an array, the mean of the middle two of an even number; null for an empty array."""
    s = F.sort_array(values)
    n = F.size(values)
    return F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)


def _beta_share(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_share(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    total = d
    for k in range(1, 300):
        for term in (k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k)), -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1))):
            d, c = 1 / (1 + term * d), 1 + term / c
            total *= c * d
    return front * total


def t_quantile(p: float, freedom: int) -> float:
    """Quantile of Student's t, by halving intervals of its distribution function."""
    if p < 0.5:
        return -t_quantile(1 - p, freedom)
    low, high = 0.0, 1.0
    below = lambda t: 1 - 0.5 * _beta_share(freedom / 2, 0.5, freedom / (freedom + t * t))
    while below(high) < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return (low + high) / 2
