"""Scalar numeric functions as column expressions; nothing reads a clock."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Half-lives in days by time horizon.
HALF_LIFE_DAYS = {"immediate": 1.0, "days": 7.0, "weeks": 28.0, "months": 120.0, "long_term": 365.0, "uncertain": 30.0}


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.least(c, F.lit(high)), F.lit(low))


def mapped(c: Column, values: dict, default=None) -> Column:
    """values[c], else the default; one literal map, so no branch per key."""
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), c), F.lit(default))


def confidence(*shares: Column) -> Column:
    """1 - entropy / ln(classes), clamped; a share of zero adds nothing."""
    entropy = sum((F.when(p > 0, p * F.ln(p)).otherwise(0.0) for p in shares), F.lit(0.0))
    return clamp(1 + entropy / math.log(len(shares)))


def polarity(positive: Column, negative: Column) -> Column:
    return clamp(positive - negative, -1.0, 1.0)


def seconds_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / 1e6


def age_hours(as_of: Column, at: Column) -> Column:
    return F.greatest(seconds_between(as_of, at) / 3600, F.lit(0.0))


def half_life_weight(age: Column, half_life: Column | float) -> Column:
    half = F.lit(half_life) if isinstance(half_life, (int, float)) else half_life
    return F.exp(-math.log(2) * age / half)


def horizon_decay(age_days: Column, horizon: Column) -> Column:
    return F.pow(F.lit(0.5), age_days / mapped(horizon, HALF_LIFE_DAYS, 30.0))


def floor_days_apart(a: Column, b: Column) -> Column:
    """|floor(days from b to a)|: the floor comes first, so twelve hours earlier is a
    day apart and twelve hours later none."""
    return F.abs(F.floor(seconds_between(a, b) / 86400))


def simple_return(now: Column, base: Column) -> Column:
    return F.try_divide(now, base) - 1


def valid_probabilities(positive: Column, negative: Column, neutral: Column) -> Column:
    """Each finite and in 0..1; their sum within .02 of 1, or at most 1.02 when the
    neutral one is missing."""

    def ok(p: Column) -> Column:
        return p.isNotNull() & ~F.isnan(p) & p.between(0.0, 1.0)

    whole = ok(neutral) & (F.abs(positive + negative + neutral - 1) <= 0.02)
    return F.coalesce(ok(positive) & ok(negative) & (whole | (neutral.isNull() & (positive + negative <= 1.02))), F.lit(False))


def impact_label(magnitude: Column) -> Column:
    return F.when(magnitude >= 0.80, "High").when(magnitude >= 0.55, "Medium").otherwise("Low")


def risk_band(index: Column) -> Column:
    return F.when(index >= 70, "Severe").when(index >= 50, "Elevated").when(index >= 30, "Moderate").otherwise("Watch")


def relevance_band(relevance: Column) -> Column:
    return F.when(relevance >= 0.85, 2).when(relevance >= 0.70, 1).otherwise(0)


def argmax_label(positive: Column, negative: Column, neutral: Column) -> Column:
    return F.when((positive >= negative) & (positive >= neutral), "positive").when(negative >= neutral, "negative").otherwise("neutral")


def softmax(logits: Column) -> Column:
    """The softmax of an array column, shifted by its largest entry."""
    top = F.array_max(logits)
    shifted = F.transform(logits, lambda x: F.exp(x - top))
    return F.transform(shifted, lambda x: x / F.aggregate(shifted, F.lit(0.0), lambda a, b: a + b))
