"""Pivots with explicit values, ordered picks and shares."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curbside.functions.numeric import safe_ratio

DIRECTIONS = ("pickup", "dropoff", "transfer", "internal")


def pivot_values(
    df: DataFrame, index: Sequence[str], column: str, values: Sequence[str], measure: Column
) -> DataFrame:
    """One column per listed value. The list is explicit, so the schema is stable,
    a value that never occurs gives a null column, and no extra job is needed."""
    return df.groupBy(*index).pivot(column, list(values)).agg(measure)


def pivot_many(
    df: DataFrame,
    index: Sequence[str],
    column: str,
    values: Sequence[str],
    measures: Sequence[str],
) -> DataFrame:
    """Pivot several measures at once; columns are named ``measure_value``."""
    wide = (
        df.groupBy(*index)
        .pivot(column, list(values))
        .agg(*[F.first(m, ignorenulls=True).alias(m) for m in measures])
    )
    return wide.withColumnsRenamed({f"{v}_{m}": f"{m}_{v}" for v in values for m in measures})


def with_share(df: DataFrame, measure: str, keys: Sequence[str], name: str = "share") -> DataFrame:
    """Share of the partition total, on an already aggregated frame."""
    total = F.sum(measure).over(W.partitionBy(*keys))
    return df.withColumn(name, safe_ratio(measure, total))


def with_total_share(df: DataFrame, measure: str, name: str) -> DataFrame:
    """Share of the grand total; the total is a one-row scalar subquery."""
    total = df.agg(F.sum(measure)).scalar()
    return df.withColumn(name, safe_ratio(measure, total))


def first_by(df: DataFrame, order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first n rows in an explicit total order (Spark runs this as a top-k)."""
    return df.orderBy(*order).limit(n)
