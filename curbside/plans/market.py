"""Volume, season, recovery, concentration, leadership and reporting coverage.

Inputs are the aggregate tables: rows are bounded by months, airports and
platforms, so the windows here are small whatever the trip volume.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curbside.functions.calendar import by_year, month_label, months_between_starts, naive
from curbside.functions.numeric import row_count, safe_ratio
from curbside.operators.shape import first_by, with_share
from curbside.scope import DEFAULT_SCOPE, Scope


def month_totals(share: DataFrame) -> DataFrame:
    return share.groupBy("month").agg(F.sum("trips").alias("trips"))


def monthly_volume(share: DataFrame, scope: Scope = DEFAULT_SCOPE) -> DataFrame:
    """Trips per month with thin months and the censored tail flagged.

    A month is thin below a fraction of the median month. The tail is censored
    from the first month after which everything is thin, that is, after the last
    month that is not thin; a thin month inside the series is not censored.
    """
    totals = month_totals(share)
    middle = totals.agg(F.median("trips")).scalar()
    flagged = totals.withColumn("thin", F.col("trips") < scope.censoring_fraction * middle)
    last_full = flagged.where(~F.col("thin")).agg(F.max("month")).scalar()
    return flagged.withColumn(
        "censored", F.coalesce(F.col("month") > last_full, F.lit(True))
    ).orderBy("month")


def volume_summary(volume: DataFrame) -> DataFrame:
    """Span, median month, length of the censored tail and last reliable month."""
    return volume.agg(
        F.min("month").alias("first_month"),
        F.max("month").alias("last_month"),
        row_count().alias("months"),
        F.median("trips").alias("median_trips"),
        F.count_if("censored").alias("censored_months"),
        F.max(F.when(~F.col("censored"), F.col("month"))).alias("reliable_end"),
    )


def trough(volume: DataFrame) -> DataFrame:
    """The emptiest month (the earliest of equals) against the median month."""
    middle = volume.agg(F.median("trips")).scalar()
    return first_by(volume, [F.asc("trips"), F.asc("month")]).select(
        "month", "trips", safe_ratio("trips", middle).alias("share_of_median")
    )


def seasonality(share: DataFrame, scope: Scope = DEFAULT_SCOPE) -> DataFrame:
    """Mean month total per calendar month, from the season start."""
    recent = share.where(F.col("month") >= naive(scope.season_from))
    return (
        month_totals(recent)
        .groupBy(F.month("month").alias("month_number"))
        .agg(F.avg("trips").alias("mean_trips"), F.min("month").alias("any_month"))
        .select("month_number", "mean_trips", month_label("any_month").alias("calendar_month"))
        .orderBy("month_number")
    )


def season_extremes(season: DataFrame) -> DataFrame:
    """Quietest and busiest calendar month (earliest of equals) and the swing."""

    def extreme(order: list, prefix: str) -> DataFrame:
        return first_by(season, order).select(
            F.col("calendar_month").alias(f"{prefix}_month"),
            F.col("mean_trips").alias(f"{prefix}_trips"),
        )

    quiet = extreme([F.asc("mean_trips"), F.asc("month_number")], "quiet")
    busy = extreme([F.desc("mean_trips"), F.asc("month_number")], "busy")
    return quiet.withColumns(
        {
            "busy_month": busy.select("busy_month").scalar(),
            "busy_trips": busy.select("busy_trips").scalar(),
        }
    ).withColumn("swing", safe_ratio("busy_trips", "quiet_trips") - 1)


def recovery(share: DataFrame, scope: Scope = DEFAULT_SCOPE) -> DataFrame:
    """First month after the baseline with at least its trips, and the gap.

    Without a baseline month, or without a recovery, the answer columns are null.
    """
    totals = month_totals(share)
    start = naive(scope.recovery_baseline_month)
    baseline = totals.agg(F.max(F.when(F.col("month") == start, F.col("trips")))).scalar()
    reached = (F.col("month") > start) & (F.col("trips") >= baseline)
    return totals.agg(
        F.max(F.when(F.col("month") == start, F.col("trips"))).alias("baseline_trips"),
        F.min(F.when(reached, F.col("month"))).alias("recovery_month"),
    ).select(
        start.alias("baseline_month"),
        "baseline_trips",
        "recovery_month",
        months_between_starts(start, F.col("recovery_month")).alias("gap_months"),
    )


def exits(census: DataFrame) -> DataFrame:
    """Platforms whose last month precedes the end of the archive."""
    end = census.agg(F.max("last_month")).scalar()
    return census.where(F.col("last_month") < end)


def dormant(census: DataFrame, live: DataFrame) -> DataFrame:
    """Licensees that are not live: very small or closed."""
    return census.join(live.select("platform"), "platform", "left_anti").select(
        "platform", "trips", "last_month", "months_active", "lifetime_share"
    )


def share_of_all(share: DataFrame) -> DataFrame:
    """Each licensee's share of all airport trips of the month."""
    totals = share.groupBy("month", "platform").agg(F.sum("trips").alias("trips"))
    return with_share(totals, "trips", ["month"])


def concentration(share: DataFrame) -> DataFrame:
    """Herfindahl-Hirschman index: summed squared percentage shares."""
    return (
        share.groupBy("month", "airport")
        .agg((F.sum(F.pow("share", F.lit(2))) * 10_000).alias("hhi"))
        .orderBy("month", "airport")
    )


def airports_seen(share: DataFrame) -> DataFrame:
    return share.select("airport").distinct().orderBy("airport")


def yearly_share(share: DataFrame) -> DataFrame:
    totals = by_year(share).groupBy("year", "airport", "platform").agg(
        F.sum("trips").alias("trips")
    )
    return with_share(totals, "trips", ["year", "airport"]).orderBy("year", "airport", "platform")


def leadership(share_year: DataFrame) -> DataFrame:
    """Leader, runner-up gap and handovers per airport and year.

    Equal shares are ordered by platform name. The handover test looks at the
    previous year present in the data.
    """
    place = F.row_number().over(
        W.partitionBy("airport", "year").orderBy(F.desc("share"), "platform")
    )
    at = lambda k, c: F.max(F.when(F.col("place") == k, F.col(c)))
    previous = F.lag("leader").over(W.partitionBy("airport").orderBy("year"))
    return (
        share_year.withColumn("place", place)
        .where(F.col("place") <= 2)
        .groupBy("airport", "year")
        .agg(
            at(1, "platform").alias("leader"),
            at(1, "share").alias("leader_share"),
            at(2, "share").alias("runner_up_share"),
        )
        .withColumns(
            {
                "gap": F.col("leader_share") - F.coalesce("runner_up_share", F.lit(0.0)),
                "changed_hands": F.coalesce(F.col("leader") != previous, F.lit(False)),
            }
        )
    )


def leadership_view(leaders: DataFrame) -> DataFrame:
    rounded = {c: F.round(c, 3) for c in ("leader_share", "runner_up_share", "gap")}
    return leaders.withColumns(rounded).orderBy("airport", "year")


def handovers(leaders: DataFrame) -> DataFrame:
    return leaders.where("changed_hands")


def current_leaders(leaders: DataFrame) -> DataFrame:
    return leaders.where(F.col("year") == leaders.agg(F.max("year")).scalar())


def coverage_starts(coverage: DataFrame, scope: Scope = DEFAULT_SCOPE) -> DataFrame:
    """First month each platform reported on-scene times above the threshold;
    null for a platform that never did."""
    above = F.col("on_scene_coverage") > scope.coverage_threshold
    return coverage.groupBy("platform").agg(
        F.min(F.when(above, F.col("month"))).alias("first_month")
    )


def comparable_from(coverage: DataFrame, scope: Scope = DEFAULT_SCOPE) -> DataFrame:
    """The month from which curb waits compare: the latest coverage start.
    Platforms that never report do not hold it back; null if none does."""
    return coverage_starts(coverage, scope).agg(F.max("first_month").alias("comparable_from"))


def last_to_report(coverage: DataFrame, scope: Scope = DEFAULT_SCOPE) -> DataFrame:
    starts = coverage_starts(coverage, scope)
    return starts.where(F.col("first_month") == comparable_from(coverage, scope).scalar())
