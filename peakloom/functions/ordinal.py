"""Soft labels over the bins of an ordered scale."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from peakloom.functions.peaks import let


def centers(low: float, high: float, bins: int) -> Column:
    width = (high - low) / bins
    return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda k: low + (k + 0.5) * width)


def soft_labels(x: Column, low: float, high: float, bins: int, sigma: float) -> Column:
    """Weights that sum to one, falling off as a normal curve around x, which is clipped to the scale."""
    at = F.greatest(F.lit(low), F.least(F.lit(high), x))
    raw = F.transform(centers(low, high, bins), lambda c: F.exp(-(c - at) * (c - at) / (2 * sigma * sigma)))
    return let(raw, lambda w: let(F.aggregate(w, F.lit(0.0), lambda a, v: a + v), lambda s: F.transform(w, lambda v: v / s)))


def expectation(weights: Column, low: float, high: float, bins: int) -> Column:
    return F.aggregate(F.zip_with(weights, centers(low, high, bins), lambda w, c: w * c), F.lit(0.0), lambda a, v: a + v)


def deviation(weights: Column, low: float, high: float, bins: int) -> Column:
    mean = expectation(weights, low, high, bins)
    square = F.aggregate(F.zip_with(weights, centers(low, high, bins), lambda w, c: w * c * c), F.lit(0.0), lambda a, v: a + v)
    return F.sqrt(F.greatest(F.lit(0.0), square - mean * mean))


def mode(weights: Column, low: float, high: float, bins: int) -> Column:
    """The centre of the heaviest bin, moved towards its neighbours by a parabola through the three."""
    width = (high - low) / bins
    k = F.array_position(weights, F.array_max(weights)).cast("int") - 1
    a, b, c = (F.coalesce(F.get(weights, k + i), F.lit(0.0)) for i in (-1, 0, 1))
    move = F.coalesce(F.try_divide(0.5 * (a - c), a - 2 * b + c), F.lit(0.0))
    return low + (k + 0.5 + F.when((k == 0) | (k == bins - 1), 0.0).otherwise(move)) * width


def cross_entropy(target: Column, logits: Column) -> Column:
    """Of target weights against softmax(logits)."""
    top = F.array_max(logits)
    log_sum = top + F.log(F.aggregate(F.transform(logits, lambda v: F.exp(v - top)), F.lit(0.0), lambda a, v: a + v))
    return F.aggregate(F.zip_with(target, logits, lambda t, v: t * (log_sum - v)), F.lit(0.0), lambda a, v: a + v)
