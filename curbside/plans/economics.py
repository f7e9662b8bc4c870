"""Fares, driver earnings, waits and incentives over the aggregate tables.

Medians here are medians of monthly values, at most one row per month, airport,
platform and direction, so the built-in median is bounded.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curbside.functions.calendar import by_year, naive
from curbside.functions.numeric import ratio_of_sums, row_count, safe_ratio, sum_or_zero, weighted_mean
from curbside.operators.bounded import keep_listed
from curbside.operators.shape import pivot_many, pivot_values, with_share
from curbside.plans.market import comparable_from
from curbside.plans.scoping import max_active
from curbside.scope import DEFAULT_SCOPE, Scope

# Labels of the two indexed measures.
FARE_LABEL = "Median rider fare"
GROSS_LABEL = "Median driver gross"


def _live(df: DataFrame, live: DataFrame, scope: Scope) -> DataFrame:
    return keep_listed(df, live, "platform", max_active(scope))


def _at(df: DataFrame, airports: DataFrame, scope: Scope) -> DataFrame:
    return keep_listed(df, airports, "airport", len(scope.airports))


def pickup_rows(
    kpis: DataFrame, live: DataFrame, airports: DataFrame, scope: Scope = DEFAULT_SCOPE
) -> DataFrame:
    """Pickups of live platforms at dispatch airports."""
    return _at(_live(kpis.where(F.col("direction") == "pickup"), live, scope), airports, scope)


def yearly_economics(pickups: DataFrame) -> DataFrame:
    return (
        by_year(pickups)
        .groupBy("year", "airport", "platform")
        .agg(
            F.median("med_driver_share").alias("payout_share"),
            F.median("med_gross_per_engaged_hour").alias("gross_per_hour"),
            F.median("med_fare").alias("median_fare"),
        )
        .orderBy("year", "airport", "platform")
    )


def fare_earnings(pickups: DataFrame) -> DataFrame:
    """One point per month, airport and platform with known hourly earnings."""
    return pickups.where(F.col("med_gross_per_engaged_hour").isNotNull()).select(
        "month", "airport", "platform", "trips", "med_fare", "med_gross_per_engaged_hour"
    )


def box_filter(
    points: DataFrame,
    x_range: tuple[float, float],
    y_range: tuple[float, float],
    x: str = "med_fare",
    y: str = "med_gross_per_engaged_hour",
) -> DataFrame:
    """Points inside a closed rectangle."""
    return points.where(F.col(x).between(*x_range) & F.col(y).between(*y_range))


def trips_in_box(
    points: DataFrame, x_range: tuple[float, float], y_range: tuple[float, float]
) -> DataFrame:
    """Trips per platform inside the rectangle, largest first."""
    return (
        box_filter(points, x_range, y_range)
        .groupBy("platform")
        .agg(F.sum("trips").alias("trips"))
        .orderBy(F.desc("trips"), "platform")
    )


def trailing_points(
    points: DataFrame, month: datetime, trail: int | None = None, scope: Scope = DEFAULT_SCOPE
) -> DataFrame:
    """Points of one month and the ``trail`` observed months before it, with a
    weight that fades with age. Months are counted as they occur in the data and
    the trail stops at the first one."""
    trail = scope.trail_months if trail is None else trail
    month = naive(month)
    seen = points.where(F.col("month") <= month).select("month").distinct()
    start = seen.orderBy(F.desc("month")).limit(trail + 1).agg(F.min("month")).scalar()
    age_days = (month - F.col("month")).cast("interval day").cast("bigint")
    return points.where(F.col("month").between(start, month)).withColumn(
        "weight", 1.0 - age_days / F.lit(31.0 * trail)
    )


def axis_bounds(points: DataFrame) -> DataFrame:
    """Fixed axis ends for the point chart: 5% beyond the data."""
    ends = []
    for c in ("med_fare", "med_gross_per_engaged_hour"):
        ends += [(F.min(c) * 0.95).alias(f"{c}_low"), (F.max(c) * 1.05).alias(f"{c}_high")]
    return points.agg(*ends)


def direction_economics(
    kpis: DataFrame, live: DataFrame, airports: DataFrame, scope: Scope = DEFAULT_SCOPE
) -> DataFrame:
    """Pickup against dropoff at each dispatch airport."""
    market = kpis.where(~F.col("direction").isin(*scope.non_market_directions))
    return (
        _at(_live(market, live, scope), airports, scope)
        .groupBy("airport", "direction")
        .agg(
            F.sum("trips").alias("trips"),
            F.median("med_fare").alias("median_fare"),
            F.median("med_driver_share").alias("payout_share"),
            F.median("med_engaged_s").alias("engaged_s"),
            F.avg("mean_tip").alias("mean_tip"),
            F.avg("incentive_rate").alias("binding_rate"),
        )
        .withColumns(
            {
                "tip_rate": safe_ratio("mean_tip", "median_fare"),
                "engaged_min": F.col("engaged_s") / 60,
            }
        )
    )


def direction_economics_view(economics: DataFrame) -> DataFrame:
    places = {
        "median_fare": 2, "payout_share": 3, "engaged_min": 1, "mean_tip": 2, "tip_rate": 4,
        "binding_rate": 4,
    }
    return economics.select(
        "airport", "direction", "trips", *[F.round(c, n).alias(c) for c, n in places.items()]
    ).orderBy("airport", "direction")


def direction_differences(economics: DataFrame) -> DataFrame:
    """Pickup minus dropoff: minutes held, payout share, and both tip rates."""
    wide = pivot_many(
        economics, ["airport"], "direction", ("pickup", "dropoff"),
        ("payout_share", "engaged_min", "tip_rate"),
    )
    minus = lambda m: F.col(f"{m}_pickup") - F.col(f"{m}_dropoff")
    return wide.withColumns(
        {
            "engaged_min_difference": minus("engaged_min"),
            "payout_points_difference": 100 * minus("payout_share"),
        }
    )


def same_airport_trips(kpis: DataFrame) -> DataFrame:
    """Internal trips per airport, or transfers where nothing is labelled internal."""
    label = F.col("direction")
    has_internal = kpis.agg(F.coalesce(F.max(label == "internal"), F.lit(False))).scalar()
    wanted = F.when(has_internal, "internal").otherwise("transfer")
    return (
        kpis.where(label == wanted)
        .groupBy("airport")
        .agg(
            F.max("direction").alias("label"),
            F.sum("trips").alias("trips"),
            F.median("med_miles").alias("median_miles"),
            F.median("med_fare").alias("median_fare"),
        )
        .orderBy(F.desc("trips"), "airport")
    )


def effective_speed(pickups: DataFrame) -> DataFrame:
    """Miles per engaged hour by year and airport, from the two medians."""
    hours = F.median("med_engaged_s") / 3600
    return (
        by_year(pickups)
        .groupBy("year", "airport")
        .agg(safe_ratio(F.median("med_miles"), hours).alias("mph"))
        .orderBy("year", "airport")
    )


def speed_by_airport(speed: DataFrame, airports: list[str]) -> DataFrame:
    return pivot_values(speed, ["year"], "airport", airports, F.first("mph")).orderBy("year")


def speed_change(speed: DataFrame) -> DataFrame:
    """First year, last year, change, second year and fastest year per airport.

    First, second and last are years of the whole table, so an airport without a
    value in one of them has nulls.
    """
    years = speed.select("year").distinct()
    first = years.agg(F.min("year")).scalar()
    last = years.agg(F.max("year")).scalar()
    second = years.where(F.col("year") > first).agg(F.min("year")).scalar()
    on = lambda y: F.max(F.when(F.col("year") == y, F.col("mph")))
    change = F.col("last_mph") / F.nullif(F.col("first_mph"), F.lit(0.0)) - 1
    return (
        speed.groupBy("airport")
        .agg(
            on(first).alias("first_mph"),
            on(second).alias("second_mph"),
            on(last).alias("last_mph"),
            # The largest speed, the earlier year of equals.
            F.max(F.struct("mph", (-F.col("year")).alias("neg_year"))).alias("best"),
        )
        .select(
            "airport",
            F.lit(first).alias("first_year"),
            "first_mph",
            F.lit(second).alias("second_year"),
            "second_mph",
            F.lit(last).alias("last_year"),
            "last_mph",
            change.alias("change"),
            F.when(change < 0, "slower").otherwise("faster").alias("word"),
            (-F.col("best.neg_year")).alias("peak_year"),
            F.col("best.mph").alias("peak_mph"),
        )
    )


def yearly_money(pickups: DataFrame) -> DataFrame:
    return (
        by_year(pickups)
        .groupBy("year")
        .agg(
            F.median("med_fare").alias("median_fare"),
            F.median("med_driver_gross").alias("median_gross"),
        )
        .orderBy("year")
    )


def indexed_money(money: DataFrame) -> DataFrame:
    """Fare and driver gross in long form, first year = 100."""
    base = F.first("dollars").over(W.partitionBy("measure").orderBy("year"))
    return (
        money.withColumnsRenamed({"median_fare": FARE_LABEL, "median_gross": GROSS_LABEL})
        .unpivot(["year"], [FARE_LABEL, GROSS_LABEL], "measure", "dollars")
        .withColumn("index", safe_ratio(100 * F.col("dollars"), base))
        .orderBy("year", "measure")
    )


def money_change(money: DataFrame) -> DataFrame:
    """First and last year of fare and gross with the relative change. The year is
    the unique key of the table, so the picks are determinate."""
    first = lambda c: F.min_by(c, "year")
    last = lambda c: F.max_by(c, "year")
    return money.agg(
        F.min("year").alias("first_year"),
        F.max("year").alias("last_year"),
        *[
            e
            for c, short in (("median_fare", "fare"), ("median_gross", "gross"))
            for e in (
                first(c).alias(f"first_{short}"),
                last(c).alias(f"last_{short}"),
                (safe_ratio(last(c), first(c)) - 1).alias(f"{short}_change"),
            )
        ],
    )


def hour_shape(hourly: DataFrame) -> DataFrame:
    """Each hour's share of the airport's day, all platforms."""
    totals = hourly.groupBy("airport", "hour").agg(F.sum("trips").alias("trips"))
    return with_share(totals, "trips", ["airport"]).orderBy("airport", "hour")


def pool_request_rate(
    kpis: DataFrame, live: DataFrame, scope: Scope = DEFAULT_SCOPE
) -> DataFrame:
    """Shared-ride requests as a trip-weighted share, by month and platform."""
    return (
        _live(kpis, live, scope)
        .groupBy("month", "platform")
        .agg(weighted_mean("pool_request_rate", "trips").alias("pool_request_rate"))
        .orderBy("month", "platform")
    )


def binding_rate(
    incentive: DataFrame, live: DataFrame, scope: Scope = DEFAULT_SCOPE
) -> DataFrame:
    """Pickups paid above the rider total over all pickups, by month and platform."""
    return (
        _live(incentive.where(F.col("direction") == "pickup"), live, scope)
        .groupBy("month", "platform")
        .agg(ratio_of_sums("incentive_trips", "trips").alias("binding_rate"))
        .orderBy("month", "platform")
    )


def curb_wait(
    pickups: DataFrame, coverage: DataFrame, scope: Scope = DEFAULT_SCOPE
) -> DataFrame:
    """Median curb wait over comparable months; a median on an exact minute is
    marked, as it suggests the platform rounds."""
    start = comparable_from(coverage, scope).scalar()
    rounded = F.col("median_wait_s") % 60 == 0
    return (
        pickups.where(
            (F.col("month") >= start) & (F.col("curb_wait_coverage") > scope.min_curb_coverage)
        )
        .groupBy("airport", "platform")
        .agg(F.median("med_curb_wait_s").alias("median_wait_s"), row_count().alias("months"))
        .withColumn("mark", F.when(rounded, "worst").otherwise(""))
        .orderBy("airport", "platform")
    )


def rounding_suspect(wait: DataFrame) -> DataFrame:
    suspects = F.count_if(F.col("mark") == "worst")
    return wait.agg(
        suspects.alias("pairs_on_exact_minute"),
        row_count().alias("pairs"),
        (suspects > 0).alias("rounding_suspect"),
    )


def incentive_by_airport(
    incentive: DataFrame, live: DataFrame, scope: Scope = DEFAULT_SCOPE
) -> DataFrame:
    """How often and by how much pay tops the rider total, per airport and platform."""
    return (
        _live(incentive.where(F.col("direction") == "pickup"), live, scope)
        .groupBy("airport", "platform")
        .agg(
            F.sum("incentive_trips").alias("topped_up"),
            F.sum("trips").alias("trips"),
            sum_or_zero("total_topup").alias("total_topup"),
            F.median("med_topup").alias("median_topup"),
        )
        .withColumns(
            {
                "rate": safe_ratio("topped_up", "trips"),
                "topup_per_trip": safe_ratio("total_topup", "trips"),
            }
        )
        .orderBy("airport", "platform")
    )


def incentive_view(
    by_airport: DataFrame, airports: DataFrame, scope: Scope = DEFAULT_SCOPE
) -> DataFrame:
    return _at(by_airport, airports, scope).select(
        "airport",
        "platform",
        "trips",
        F.round("rate", 4).alias("rate"),
        F.round("median_topup", 2).alias("median_topup"),
        F.round("topup_per_trip", 3).alias("topup_per_trip"),
    )


def latest_year_summary(
    economics: DataFrame, share_year: DataFrame, by_airport: DataFrame
) -> DataFrame:
    """Every live platform in the latest year: share, payout, earnings, binding rate."""
    latest = economics.agg(F.max("year")).scalar()
    shares = share_year.where(F.col("year") == latest).select("airport", "platform", "share")
    rates = by_airport.select("airport", "platform", "rate")
    return (
        economics.where(F.col("year") == latest)
        .join(shares, ["airport", "platform"], "left")
        .join(rates, ["airport", "platform"], "left")
        .select(
            "airport",
            "platform",
            F.round("share", 3).alias("share_of_airport"),
            F.round("payout_share", 3).alias("payout_share"),
            F.round("gross_per_hour", 2).alias("gross_per_hour"),
            F.round("rate", 4).alias("min_pay_binding_rate"),
        )
        .orderBy("airport", F.desc_nulls_last("share_of_airport"), "platform")
    )
