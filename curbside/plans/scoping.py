"""Scope derived from the data: who trades, and where pickups are dispatched."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbside.functions.calendar import months_before
from curbside.functions.numeric import safe_ratio
from curbside.operators.shape import pivot_values, with_total_share
from curbside.scope import DEFAULT_SCOPE, Scope


def platform_census(coverage: DataFrame) -> DataFrame:
    """Every licensee ever seen, with lifetime trips, share and months active."""
    census = coverage.groupBy("platform").agg(
        F.sum("trips").alias("trips"),
        F.min("month").alias("first_month"),
        F.max("month").alias("last_month"),
        F.count_distinct("month").alias("months_active"),
    )
    return with_total_share(census, "trips", "lifetime_share").orderBy(
        F.desc("trips"), "platform"
    )


def recent_months(df: DataFrame, window: int | None) -> DataFrame:
    """Rows of the last ``window`` months, ending at the newest month in the frame.

    The cutoff is a one-row scalar subquery. The newest month always passes for a
    positive window; a window of zero or less keeps nothing, and ``None`` everything.
    """
    if window is None:
        return df
    cutoff = df.agg(F.max("month").alias("m")).select(months_before("m", window)).scalar()
    return df.where(F.col("month") > cutoff)


def recent_or_all(df: DataFrame, window: int) -> DataFrame:
    """Recent rows, or all rows where the window holds none."""
    newest = df.agg(F.max("month").alias("m"))
    cutoff = newest.select(months_before("m", window)).scalar()
    # The window is empty exactly when the newest month itself is outside it.
    return df.where((F.col("month") > cutoff) | (newest.select("m").scalar() <= cutoff))


def active_platforms(
    coverage: DataFrame,
    window: int | None = None,
    min_share: float | None = None,
    scope: Scope = DEFAULT_SCOPE,
) -> DataFrame:
    """Platforms with a meaningful share of recent trips, largest first."""
    window = scope.active_window_months if window is None else window
    min_share = scope.min_platform_share if min_share is None else min_share
    recent = (
        recent_or_all(coverage, window).groupBy("platform").agg(F.sum("trips").alias("trips"))
    )
    return (
        with_total_share(recent, "trips", "share")
        .where(F.col("share") >= min_share)
        .orderBy(F.desc("trips"), "platform")
    )


def max_active(scope: Scope = DEFAULT_SCOPE) -> int | None:
    """Shares sum to one, so at most 1/min_share platforms can be active."""
    return math.ceil(1 / scope.min_platform_share) if scope.min_platform_share > 0 else None


def direction_ratio(kpis: DataFrame, scope: Scope = DEFAULT_SCOPE) -> DataFrame:
    """Pickups against dropoffs per airport; no dropoff gives a null ratio."""
    market = kpis.where(~F.col("direction").isin(*scope.non_market_directions))
    return (
        pivot_values(market, ["airport"], "direction", ["pickup", "dropoff"], F.sum("trips"))
        .fillna(0, ["pickup", "dropoff"])
        .withColumn("pickups_per_dropoff", safe_ratio("pickup", "dropoff"))
    )


def dispatch_airports(
    kpis: DataFrame, min_ratio: float | None = None, scope: Scope = DEFAULT_SCOPE
) -> DataFrame:
    """Airports that take dispatched pickups, alphabetically."""
    min_ratio = scope.min_dispatch_ratio if min_ratio is None else min_ratio
    return (
        direction_ratio(kpis, scope)
        .where(F.col("pickups_per_dropoff") >= min_ratio)
        .select("airport")
        .orderBy("airport")
    )


def direction_ratio_review(kpis: DataFrame, scope: Scope = DEFAULT_SCOPE) -> DataFrame:
    """The ratio table with a mark on airports below the dispatch threshold."""
    ratio = F.col("pickups_per_dropoff")
    return (
        direction_ratio(kpis, scope)
        .withColumn("mark", F.when(ratio < scope.min_dispatch_ratio, "behind").otherwise("lead"))
        .withColumn("pickups_per_dropoff", F.round(ratio, 6))
        .orderBy(F.desc_nulls_last("pickups_per_dropoff"))
    )


def names(listed: DataFrame, column: str, *order: str, most: int = 10_000) -> list[str]:
    """A short name list on the driver in a stated order (that of the frame where none is given),
    for use as column names of a pivot.

    Raises:
        ValueError: more names than a pivot may have columns.
    """
    by = [F.expr(o.removesuffix(" desc")).desc() if o.endswith(" desc") else F.col(o) for o in order]
    ordered = listed.orderBy(*by) if by else listed
    found = [r[0] for r in ordered.select(column).limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} distinct {column} values cannot become columns")
    return found


def largest_two(census: DataFrame, live: DataFrame) -> DataFrame:
    """The two largest live platforms over the whole archive."""
    return (
        census.join(live.select("platform"), "platform", "left_semi")
        .orderBy(F.desc("trips"), "platform")
        .limit(2)
    )
