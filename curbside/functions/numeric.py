"""Null-safe arithmetic and aggregate expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def or_zero(c: Column | str) -> Column:
    """A missing amount counts as zero."""
    return F.coalesce(col(c), F.lit(0.0))


def safe_ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """Division that gives null for a zero denominator (ANSI mode would raise)."""
    return col(numerator) / F.nullif(col(denominator), F.lit(0))


def row_count() -> Column:
    return F.count(F.lit(1))


def sum_or_zero(c: Column | str) -> Column:
    """Sum that is 0 rather than null when nothing was added."""
    return F.coalesce(F.sum(col(c)), F.lit(0))


def rate(flag: Column | str) -> Column:
    """Share of true among the non-null values of a boolean."""
    return F.avg(col(flag).cast("double"))


def weighted_mean(value: Column | str, weight: Column | str) -> Column:
    return safe_ratio(F.sum(col(value) * col(weight)), F.sum(col(weight)))


def ratio_of_sums(numerator: Column | str, denominator: Column | str) -> Column:
    return safe_ratio(F.sum(col(numerator)), F.sum(col(denominator)))


def row_max(columns: Sequence[Column]) -> Column:
    """Largest value across columns, ignoring nulls; one column is itself."""
    return columns[0] if len(columns) == 1 else F.greatest(*columns)


def row_min(columns: Sequence[Column]) -> Column:
    return columns[0] if len(columns) == 1 else F.least(*columns)
