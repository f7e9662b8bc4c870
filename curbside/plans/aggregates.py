"""The six aggregate tables over trip-level rows."""

from __future__ import annotations

from collections.abc import Callable, Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbside.functions.calendar import month_start
from curbside.functions.numeric import rate, ratio_of_sums, row_count, safe_ratio
from curbside.operators.bounded import settled
from curbside.operators.medians import grouped
from curbside.operators.shape import with_share
from curbside.scope import AGGREGATE_TABLES

# Tables that come from the same scans.
SHARED_SCANS = (
    ("market_share", "coverage_timeline", "data_quality"),
    ("monthly_kpis", "incentive_breakdown"),
    ("hourly_profile",),
)
CELL = ["month", "airport", "platform", "direction"]

# Columns of trips that the six tables need; ``trip.ratio_columns`` gives the ratios back.
TRIP_COLUMNS = [
    "pickup_datetime", "airport", "platform", "direction", "is_valid", "has_on_scene",
    "pool_requested", "pool_matched", "likely_incentive", "base_passenger_fare", "trip_miles", "tips",
    "driver_gross", "rider_total_ex_tip", "secs_engaged", "secs_request_to_scene", "secs_scene_to_pickup",
]

KPI_MEDIANS = {
    "med_fare": "base_passenger_fare",
    "med_driver_gross": "driver_gross",
    "med_driver_share": "driver_share",
    "med_fare_per_mile": "fare_per_mile",
    "med_gross_per_engaged_hour": "driver_gross_per_engaged_hour",
    "med_engaged_s": "secs_engaged",
    "med_curb_wait_s": "secs_scene_to_pickup",
    "med_miles": "trip_miles",
}
HOURLY_MEDIANS = {
    "med_fare": "base_passenger_fare",
    "med_gross_per_engaged_hour": "driver_gross_per_engaged_hour",
    "med_driver_share": "driver_share",
    "med_curb_wait_s": "secs_scene_to_pickup",
}
KPI_COLUMNS = [
    *CELL, "trips", "med_fare", "med_driver_gross", "med_driver_share", "med_fare_per_mile",
    "med_gross_per_engaged_hour", "med_engaged_s", "med_curb_wait_s", "curb_wait_coverage",
    "med_miles", "pool_request_rate", "pool_match_rate", "incentive_rate", "mean_tip",
]
INCENTIVE_COLUMNS = [
    *CELL, "trips", "incentive_trips", "incentive_rate", "med_topup", "total_topup",
    "med_share_when_incentivised", "topup_per_trip",
]
HOURLY_COLUMNS = [
    "airport", "platform", "hour", "trips", "med_fare", "med_gross_per_engaged_hour",
    "med_driver_share", "incentive_rate", "med_curb_wait_s", "curb_wait_coverage",
    "share_of_day",
]


def with_month(trips: DataFrame) -> DataFrame:
    return trips.withColumn("month", month_start("pickup_datetime"))


def _scoped(trips: DataFrame, valid_only: bool, direction: str = "") -> DataFrame:
    """Keep rows proven valid (an unknown verdict is dropped) in one direction."""
    if valid_only:
        trips = trips.where("is_valid")
    return trips.where(F.col("direction") == direction) if direction else trips


def _columns(names: dict[str, str]) -> dict[str, Column]:
    return {alias: F.col(c) for alias, c in names.items()}


def _kpi_aggregates() -> list[Column]:
    return [
        row_count().alias("trips"),
        rate("has_on_scene").alias("curb_wait_coverage"),
        rate("pool_requested").alias("pool_request_rate"),
        safe_ratio(
            F.count_if("pool_matched"), F.count_if("pool_requested")
        ).alias("pool_match_rate"),
        rate("likely_incentive").alias("incentive_rate"),
        F.avg("tips").alias("mean_tip"),
    ]


def _topup() -> Column:
    """Driver gross above the rider total, on trips flagged as topped up."""
    return F.when(F.col("likely_incentive"), F.col("driver_gross") - F.col("rider_total_ex_tip"))


def _incentive_aggregates() -> list[Column]:
    return [
        F.count_if("likely_incentive").alias("incentive_trips"),
        F.coalesce(F.sum(_topup()), F.lit(0.0)).alias("total_topup"),
    ]


def _incentive_medians() -> dict[str, Column]:
    return {
        "med_topup": _topup(),
        "med_share_when_incentivised": F.when(F.col("likely_incentive"), F.col("driver_share")),
    }


def incentive_from_panel(cells: DataFrame) -> DataFrame:
    return cells.withColumn("topup_per_trip", F.col("total_topup") / F.col("trips")).select(
        *INCENTIVE_COLUMNS
    )


def coverage_timeline(trips: DataFrame) -> DataFrame:
    """Trips and the share with an on-scene time, by month and platform."""
    return (
        with_month(trips)
        .groupBy("month", "platform")
        .agg(row_count().alias("trips"), rate("has_on_scene").alias("on_scene_coverage"))
    )


def market_share(trips: DataFrame) -> DataFrame:
    """Trips and share of the airport's month, for every licensee."""
    counts = (
        with_month(trips).groupBy("month", "airport", "platform").agg(row_count().alias("trips"))
    )
    return with_share(counts, "trips", ["month", "airport"])


def hourly_profile(
    trips: DataFrame,
    direction: str = "pickup",
    valid_only: bool = True,
    *,
    group_rows: int | None = None,
) -> DataFrame:
    """Trips and economics by airport, platform and hour of day."""
    hours = grouped(
        _scoped(trips, valid_only, direction).withColumn("hour", F.hour("pickup_datetime")),
        ["airport", "platform", "hour"],
        [
            row_count().alias("trips"),
            rate("likely_incentive").alias("incentive_rate"),
            rate("has_on_scene").alias("curb_wait_coverage"),
        ],
        _columns(HOURLY_MEDIANS),
        group_rows=group_rows,
    )
    return with_share(hours, "trips", ["airport", "platform"], "share_of_day").select(
        *HOURLY_COLUMNS
    )


def incentive_breakdown(
    trips: DataFrame, valid_only: bool = True, *, group_rows: int | None = None
) -> DataFrame:
    """Where driver pay exceeds everything the rider paid."""
    return incentive_from_panel(
        grouped(
            with_month(_scoped(trips, valid_only)),
            CELL,
            [
                row_count().alias("trips"),
                rate("likely_incentive").alias("incentive_rate"),
                *_incentive_aggregates(),
            ],
            _incentive_medians(),
            group_rows=group_rows,
        )
    )


def monthly_kpis(
    trips: DataFrame, valid_only: bool = True, *, group_rows: int | None = None
) -> DataFrame:
    """The core panel: month, airport, platform, direction."""
    return grouped(
        with_month(_scoped(trips, valid_only)),
        CELL,
        _kpi_aggregates(),
        _columns(KPI_MEDIANS),
        group_rows=group_rows,
    ).select(*KPI_COLUMNS)


def data_quality(trips: DataFrame) -> DataFrame:
    """Row faults and reporting rates per platform."""
    return trips.groupBy("platform").agg(
        row_count().alias("trips"),
        rate("has_on_scene").alias("on_scene_coverage"),
        *[F.count_if(test).alias(name) for name, test in _faults().items()],
        rate("likely_incentive").alias("incentive_rate"),
    )


def _faults() -> dict[str, Column]:
    """Null operands make a test null, and count_if skips it."""
    return {
        "invalid_rows": ~F.col("is_valid"),
        "neg_to_scene": F.col("secs_request_to_scene") < 0,
        "neg_curb_wait": F.col("secs_scene_to_pickup") < 0,
        "nonpos_fare": F.col("base_passenger_fare") <= 0,
        "nonpos_miles": F.col("trip_miles") <= 0,
    }


# --- all six from shared scans --------------------------------------------------


def count_cube(trips: DataFrame) -> DataFrame:
    """Every additive count at the finest grain any table needs.

    Counts merge exactly, so three tables are rollups of this;
    it has at most months x airports x platforms x directions x hours rows.
    """
    valid = F.col("is_valid")
    return (
        with_month(trips)
        .withColumn("hour", F.hour("pickup_datetime"))
        .groupBy(*CELL, "hour")
        .agg(
            row_count().alias("n"),
            F.count_if(valid).alias("n_valid"),
            F.count_if("has_on_scene").alias("n_on_scene"),
            F.count("likely_incentive").alias("n_incentive_known"),
            F.count_if("likely_incentive").alias("n_incentive"),
            *[F.count_if(test).alias(name) for name, test in _faults().items()],
        )
    )


def coverage_from_cube(cube: DataFrame) -> DataFrame:
    return cube.groupBy("month", "platform").agg(
        F.sum("n").alias("trips"), ratio_of_sums("n_on_scene", "n").alias("on_scene_coverage")
    )


def share_from_cube(cube: DataFrame) -> DataFrame:
    counts = cube.groupBy("month", "airport", "platform").agg(F.sum("n").alias("trips"))
    return with_share(counts, "trips", ["month", "airport"])


def quality_from_cube(cube: DataFrame) -> DataFrame:
    return cube.groupBy("platform").agg(
        F.sum("n").alias("trips"),
        ratio_of_sums("n_on_scene", "n").alias("on_scene_coverage"),
        *[F.sum(name).alias(name) for name in _faults()],
        # Trips with an unknown flag are in neither part of the rate.
        ratio_of_sums("n_incentive", "n_incentive_known").alias("incentive_rate"),
    )


def cell_panel(trips: DataFrame, group_rows: int | None) -> DataFrame:
    """KPIs and incentive measures share their key and filter: one group-by."""
    return grouped(
        with_month(_scoped(trips, True)),
        CELL,
        [*_kpi_aggregates(), *_incentive_aggregates()],
        {**_columns(KPI_MEDIANS), **_incentive_medians()},
        group_rows=group_rows,
    )


def all_tables(
    trips: DataFrame,
    keep: Callable[[DataFrame], DataFrame] = settled,
    group_rows: int | None = None,
    names: Collection[str] = AGGREGATE_TABLES,
) -> dict[str, DataFrame]:
    """All six tables from five scans of the trips, whatever the size of a group: one for the
    count cube, two for the cell panel and two for the hourly profile. Of some ``names``, only
    the scans that they need.

    ``keep`` makes an intermediate durable (by default a reliable checkpoint). Only
    the count cube and the cell panel pass through it, both aggregate-sized.
    """
    cubed, celled, _ = (not set(names).isdisjoint(scan) for scan in SHARED_SCANS)
    tables = {}
    if cubed:
        cube = keep(count_cube(trips))
        tables["market_share"] = share_from_cube(cube)
        tables["coverage_timeline"] = coverage_from_cube(cube)
        tables["data_quality"] = quality_from_cube(cube)
    if celled:
        panel = keep(cell_panel(trips, group_rows))
        tables["monthly_kpis"] = panel.select(*KPI_COLUMNS)
        tables["incentive_breakdown"] = incentive_from_panel(panel)
    if "hourly_profile" in names:
        tables["hourly_profile"] = hourly_profile(trips, group_rows=group_rows)
    return {name: tables[name] for name in AGGREGATE_TABLES if name in names}
