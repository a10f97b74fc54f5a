"""Closed-form statistics as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import ColumnOrName, col, ratio

# Fixed values. Abramowitz & Stegun 26.2.17, as used for the rank test.
CDF_SCALE = 0.2316419
CDF_DENSITY = 0.3989423
CDF_COEFFICIENTS = (0.3193815, -0.3565638, 1.781478, -1.821256, 1.330274)

# Fixed values. Abramowitz & Stegun 7.1.26, as used for the proportion test.
ERF_SCALE = 0.3275911
ERF_COEFFICIENTS = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def _horner(x: Column, coefficients: tuple[float, ...]) -> Column:
    """c0 + x*(c1 + x*(c2 + ...))"""
    acc = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        acc = F.lit(c) + x * acc
    return acc


def normal_cdf_five_term(z: ColumnOrName) -> Column:
    """Standard normal CDF by the five-coefficient polynomial."""
    z = col(z).cast("double")
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(CDF_SCALE) * F.abs(z))
    upper = F.lit(CDF_DENSITY) * F.exp(-z * z / 2) * t * _horner(t, CDF_COEFFICIENTS)
    return F.when(z > 0, F.lit(1.0) - upper).otherwise(upper)


def erf(x: ColumnOrName) -> Column:
    x = col(x).cast("double")
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(ERF_SCALE) * F.abs(x))
    return F.signum(x) * (F.lit(1.0) - t * _horner(t, ERF_COEFFICIENTS) * F.exp(-x * x))


def normal_cdf_erf(z: ColumnOrName) -> Column:
    """Standard normal CDF through `erf`."""
    return F.lit(0.5) * (F.lit(1.0) + erf(col(z) / F.lit(math.sqrt(2.0))))


def effect_label(r: ColumnOrName) -> Column:
    """Rank-biserial size in words."""
    size = F.abs(col(r))
    return (
        F.when(size < 0.1, "negligible").when(size < 0.3, "small").when(size < 0.5, "medium")
        .when(size.isNotNull(), "large")
    )


def direction(before: ColumnOrName, after: ColumnOrName) -> Column:
    before, after = col(before), col(after)
    return F.when(after > before, "up").when(after < before, "down").otherwise("flat")


def wilson_bounds(successes: ColumnOrName, total: ColumnOrName, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson score interval clamped to [0, 1]; null bounds without observations."""
    n = col(total).cast("double")
    p = ratio(successes, total)
    inv = ratio(F.lit(1.0), n)
    z2 = z * z
    denominator = F.lit(1.0) + F.lit(z2) * inv
    centre = (p + F.lit(z2) * inv / 2) / denominator
    half = F.lit(z) * F.sqrt(p * (F.lit(1.0) - p) * inv + F.lit(z2) * inv * inv / 4) / denominator
    low = F.when(p.isNotNull(), F.greatest(F.lit(0.0), centre - half))
    high = F.when(p.isNotNull(), F.least(F.lit(1.0), centre + half))
    return low, high


def two_proportion_test(
    successes_1: ColumnOrName,
    total_1: ColumnOrName,
    successes_2: ColumnOrName,
    total_2: ColumnOrName,
    min_count: int = 30,
    alpha: float = 0.05,
) -> dict[str, Column]:
    """Pooled two-proportion z-test as named columns.

    `skipped` is true when either side has fewer than `min_count` observations; then only the raw rates
    are given. A zero standard error means no signal: z 0, p 1, flat.
    """
    s1, n1, s2, n2 = (col(c).cast("double") for c in (successes_1, total_1, successes_2, total_2))
    skipped = (F.coalesce(n1, F.lit(0.0)) < max(min_count, 1)) | (F.coalesce(n2, F.lit(0.0)) < max(min_count, 1))
    rate_1, rate_2 = ratio(s1, n1), ratio(s2, n2)
    pooled = ratio(s1 + s2, n1 + n2)
    se = F.sqrt(pooled * (F.lit(1.0) - pooled) * (ratio(F.lit(1.0), n1) + ratio(F.lit(1.0), n2)))
    z = F.when(se > 0, F.try_divide(rate_2 - rate_1, se)).otherwise(F.lit(0.0))
    p_value = F.when(se > 0, F.lit(2.0) * (F.lit(1.0) - normal_cdf_erf(F.abs(z)))).otherwise(F.lit(1.0))
    low, high = wilson_bounds(s2, n2)
    tested = ~skipped
    return {
        "skipped": skipped,
        "rate_1": rate_1,
        "rate_2": rate_2,
        "z": F.when(tested, z),
        "p_value": F.when(tested, p_value),
        "significant": F.when(tested, p_value < alpha),
        "direction": F.when(tested, F.when(se > 0, direction(rate_1, rate_2)).otherwise("flat")),
        "ci_low": F.when(tested, low),
        "ci_high": F.when(tested, high),
    }
