"""Confidence and the one-sided Wilson bound as column arithmetic."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, functions as F


def probability_confidence(p: Column) -> Column:
    """G6 without a threshold."""
    return F.greatest(p, 1.0 - p)


def predicted_label(p: Column, threshold: float | Column) -> Column:
    return F.when(p >= threshold, 1).otherwise(0)


def threshold_confidence(p: Column, threshold: float | Column) -> Column:
    """G6 under a threshold: probability of the predicted label."""
    return F.when(p >= threshold, p).otherwise(1.0 - p)


def normal_quantile(confidence: float) -> float:
    if not 0.0 < confidence < 1.0:
        raise ValueError("confidence must be between 0 and 1")
    return NormalDist().inv_cdf(confidence)


def wilson_upper(errors: Column, total: Column, confidence: float = 0.95) -> Column:
    """Upper bound of an error rate; 1 when nothing was counted.

    Counts outside ``0 <= errors <= total`` raise when the row is evaluated.
    """
    z = normal_quantile(confidence)
    n = total.cast("double")
    rate = errors / n
    spread = F.sqrt((rate * (1.0 - rate) + F.lit(z * z) / (4.0 * n)) / n)
    bound = (rate + F.lit(z * z) / (2.0 * n) + z * spread) / (1.0 + F.lit(z * z) / n)
    checked = F.when(
        (errors < 0) | (errors > total),
        F.raise_error(F.lit("errors must be between 0 and total")).cast("double"),
    ).otherwise(F.least(F.lit(1.0), bound))
    return F.when(total <= 0, F.lit(1.0)).otherwise(checked)


def risk_acceptable(
    errors: Column, total: Column, maximum_risk: float, confidence: float = 0.95
) -> Column:
    """G8."""
    if not 0.0 <= maximum_risk <= 1.0:
        raise ValueError("maximum_risk must be between 0 and 1")
    return wilson_upper(errors, total, confidence) <= maximum_risk


def blend(source_p: Column, target_p: Column, source_weight: float | Column) -> Column:
    """F8 on one row."""
    if isinstance(source_weight, (int, float)):
        if not 0.0 <= source_weight <= 1.0:
            raise ValueError("source_weight must be between 0 and 1")
        source_weight = F.lit(float(source_weight))
    return source_weight * source_p + (1.0 - source_weight) * target_p
