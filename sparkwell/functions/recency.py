"""Dates in metadata and scores weighted by age."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the date formats that are tried in turn
FORMATS = ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "MM/dd/yyyy", "MMM d, yyyy")


def node_time(value: Column, first_format: str | None = None) -> Column:
    """Timestamp of a date string or unix seconds; null if none of the formats fits."""
    tried = [F.try_to_timestamp(value, F.lit(f)) for f in ([first_format] if first_format else []) + list(FORMATS)]
    return F.coalesce(*tried, F.timestamp_seconds(value.try_cast("double")))


def age_seconds(time: Column, now: Column) -> Column:
    return now.cast("timestamp").cast("double") - time.cast("timestamp").cast("double")


def linear(score: Column, age: Column, most: float | None) -> Column:
    return score if not most else score * F.greatest(F.lit(0.0), F.lit(1.0) - age / F.lit(float(most)))


def exponential(score: Column, age: Column, rate: float, most: float | None = None) -> Column:
    """rate ** (1 + ceil(age / half)); half is a day, or half the greatest age."""
    half = float(most) / 2 if most else 86_400.0
    return score * F.pow(F.lit(float(rate)), F.lit(1) + F.ceil(F.greatest(age, F.lit(0.0)) / F.lit(half)))


def step(score: Column, age: Column, recent: float, recent_weight: float, old_weight: float) -> Column:
    return score * F.when(age <= recent, float(recent_weight)).otherwise(float(old_weight))
