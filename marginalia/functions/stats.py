"""Quantiles by their different definitions, ranks and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nearest_rank(column: str, q: float) -> Column:
    """The value at rank ceil(n q)."""
    return F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {column})")


def quantile_rounded(column: str, q: float) -> Column:
    """The value at index round((n - 1) q), from 0; halves round up."""
    return F.expr(f"element_at(array_sort(collect_list({column})), cast(floor((count({column}) - 1) * {q} + 0.5) AS int) + 1)")


def quantile_floored(column: str, q: float) -> Column:
    """The value at index floor((n - 1) q), from 0."""
    return F.expr(f"element_at(array_sort(collect_list({column})), cast(floor((count({column}) - 1) * {q}) AS int) + 1)")


def reciprocal_rank(rank: Column, weight: Column | float = 1.0, k: float = 60.0) -> Column:
    """A list's share in a fused score; ranks start at 0."""
    return (F.lit(weight) if isinstance(weight, float) else weight) / (F.lit(k) + rank + 1)


def recency_factor(age_days: Column, half_life_days: float) -> Column:
    """From 1 for new to one half for old."""
    return F.lit(0.5) + F.lit(0.5) * F.pow(F.lit(2.0), -F.greatest(age_days, F.lit(0.0)) / half_life_days)


def discounted_gain(rank: Column) -> Column:
    """Gain of a relevant result at a rank from 1."""
    return F.lit(1.0) / F.log2(rank + 1)
