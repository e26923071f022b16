"""Scores and rates as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(x: Column) -> Column:
    """The logistic function in the form that doesn't overflow on either side."""
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def confidence_of(logit: Column) -> Column:
    return clamp(sigmoid(logit))


def fuzzy_confidence(score: Column, threshold: float) -> Column:
    """0.85 at the threshold to 0.95 at 100."""
    return F.round(0.85 + 0.10 * (score - threshold) / max(1.0, 100 - threshold), 3)


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance as a share of the longer text, in lower case; 0 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest > 0, F.levenshtein(F.lower(a), F.lower(b)) / longest).otherwise(F.lit(0.0))


def percent(part: Column, total: Column, digits: int = 1) -> Column:
    return F.when(total > 0, F.round(100.0 * part / total, digits)).otherwise(F.lit(0.0))


def recall_at(retrieved: Column, relevant: Column, k: int) -> Column:
    """The share of relevant ids among the first k; 0 without relevant ids or for k below 1."""
    if k < 1:
        return F.lit(0.0)
    n = F.size(F.array_distinct(relevant))
    return F.when(n > 0, F.size(F.array_intersect(F.slice(retrieved, 1, k), relevant)) / n).otherwise(F.lit(0.0))


def reciprocal_rank(retrieved: Column, relevant: Column) -> Column:
    """1 over the place of the first relevant id, 0 if there is none."""
    places = F.filter(F.transform(retrieved, lambda x, i: F.when(F.array_contains(relevant, x), i + 1)), lambda p: p.isNotNull())
    return F.coalesce(1.0 / F.array_min(places), F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    """The inner product of two arrays in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
