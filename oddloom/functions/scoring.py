"""Reliability score of an opportunity."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import constants as C

NEUTRAL = 0.85


def freshness_score(detected_at: Column, now: Column) -> Column:
    """Full up to 15 s, half at 60 s, then a fast fall to 0."""
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(detected_at.cast("timestamp"))) / F.lit(1e6)
    return (
        F.when(age <= 15, F.lit(1.0))
        .when(age <= 60, 1.0 - 0.5 * (age - 15) / 45)
        .otherwise(F.greatest(F.lit(0.0), 0.5 - (age - 60) / 120))
    )


def _mean(values: Column) -> Column:
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v), F.size(values))


def confidence_score(confidences: Column) -> Column:
    """Mean confidence of the legs, neutral when unknown."""
    return F.when(
        confidences.isNull() | (F.size(confidences) == 0), F.lit(NEUTRAL)
    ).otherwise(_mean(confidences))


def stability_score(bookmakers: Column, stability: Column) -> Column:
    """Mean stability of the legs' bookmakers; unknown ones neutral."""
    known = F.transform(bookmakers, lambda b: F.coalesce(F.try_element_at(stability, b), F.lit(NEUTRAL)))
    return F.when(
        stability.isNull() | (F.size(bookmakers) == 0), F.lit(NEUTRAL)
    ).otherwise(_mean(known))


def volatility_score(volatility: Column) -> Column:
    """1 minus the normalised deviation, never negative."""
    return F.greatest(F.lit(0.0), 1.0 - F.least(F.coalesce(volatility, F.lit(0.0)), F.lit(1.0)))


def plausibility(market_type: Column, roi: Column) -> Column:
    """Returns too good to be true lower or void the score."""
    return (
        F.when(market_type.isin(C.MAJOR_MARKETS) & (roi > 25.0), F.lit(0.0))
        .when(roi > 40.0, F.lit(0.15))
        .otherwise(F.lit(1.0))
    )


def combine_scores(fresh: Column, confidence: Column, stable: Column, calm: Column, plausible: Column) -> Column:
    """Weighted quality times plausibility, 0..100, half-even."""
    quality = fresh * 0.30 + confidence * 0.35 + stable * 0.20 + calm * 0.15
    bounded = F.greatest(F.lit(0.0), F.least(F.lit(1.0), quality * plausible))
    return F.bround(bounded * 100, 0).cast("int")
