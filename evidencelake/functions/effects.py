"""Effect sizes, their variances and conversions, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.959964
OR_TO_D = 1.8142
LEAST_RATIO = 1e-10


def cohens_d(mean1: Column, sd1: Column, n1: Column, mean2: Column, sd2: Column, n2: Column) -> Column:
    """Difference of means over the pooled standard deviation; 0 where that is 0."""
    pooled = F.sqrt(((n1 - 1) * sd1 * sd1 + (n2 - 1) * sd2 * sd2) / F.greatest(n1 + n2 - 2, F.lit(1)))
    return F.when(pooled == 0, F.lit(0.0)).otherwise((mean1 - mean2) / pooled)


def glass_delta(mean_treated: Column, sd_treated: Column, mean_control: Column) -> Column:
    """Difference of means over the standard deviation given for the treated; 0 where that is 0."""
    return F.when(sd_treated == 0, F.lit(0.0)).otherwise((mean_treated - mean_control) / sd_treated)


def mean_difference(mean_treated: Column, mean_control: Column) -> Column:
    return mean_treated - mean_control


def number_needed_to_treat(risk_reduction: Column) -> Column:
    return F.when(risk_reduction == 0, F.lit(float("inf"))).otherwise(1.0 / F.abs(risk_reduction))


def hedges_g(d: Column, n1: Column, n2: Column) -> Column:
    n = n1 + n2
    return F.when(n <= 3, d).otherwise(d * (1.0 - 3.0 / (4.0 * n - 9.0)))


def odds_ratio(a: Column, b: Column, c: Column, d: Column) -> Column:
    """A half is always added to every cell."""
    return ((a + 0.5) * (d + 0.5)) / ((b + 0.5) * (c + 0.5))


def risk_ratio(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Null where an arm is empty or the comparison arm has no event."""
    return F.try_divide(F.try_divide(a, a + b), F.try_divide(c, c + d))


def log_ratio(ratio: Column) -> Column:
    return F.log(F.greatest(ratio, F.lit(LEAST_RATIO)))


def variance_d(n1: Column, n2: Column, d: Column) -> Column:
    n = n1 + n2
    return F.when(n < 4, F.lit(float("inf"))).otherwise(n / (n1 * n2) + d * d / (2.0 * (n - 2)))


def variance_log_or(a: Column, b: Column, c: Column, d: Column) -> Column:
    return 1.0 / (a + 0.5) + 1.0 / (b + 0.5) + 1.0 / (c + 0.5) + 1.0 / (d + 0.5)


def variance_log_rr(a: Column, b: Column, c: Column, d: Column) -> Column:
    return 1.0 / (a + 0.5) - 1.0 / (a + b + 1.0) + 1.0 / (c + 0.5) - 1.0 / (c + d + 1.0)


def standard_error(variance: Column) -> Column:
    return F.sqrt(F.greatest(variance, F.lit(0.0)))


def interval(effect: Column, se: Column, z: float = Z95) -> tuple[Column, Column]:
    return effect - z * se, effect + z * se


def or_to_d(ratio: Column) -> Column:
    return log_ratio(ratio) / OR_TO_D


def d_to_or(d: Column) -> Column:
    return F.exp(d * OR_TO_D)


def variance_from_interval(low: Column, high: Column) -> Column:
    se = (high - low) / (2 * 1.96)
    return se * se


def i_squared_words(i2: Column) -> Column:
    return F.when(i2 < 25, "low heterogeneity").when(i2 < 50, "moderate heterogeneity").otherwise("substantial heterogeneity")
