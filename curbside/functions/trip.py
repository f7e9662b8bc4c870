"""Trip-level expressions: labels, money, validity."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from curbside.functions.numeric import col, or_zero, safe_ratio
from curbside.schema import RIDER_CHARGES
from curbside.scope import DEFAULT_SCOPE, Scope


def lookup(c: Column | str, labels: Mapping) -> Column:
    """Literal-map lookup; a key without a label gives null."""
    if not labels:
        return F.lit(None).cast("string")
    return F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])[col(c)]


def airport_of(zone: Column | str, scope: Scope = DEFAULT_SCOPE) -> Column:
    """Airport code of a zone, null off-airport."""
    return lookup(col(zone).cast("bigint"), scope.airports)


def platform_of(licence: Column | str, scope: Scope = DEFAULT_SCOPE) -> Column:
    """Platform label of a licence; an unknown licence keeps its raw code."""
    return F.coalesce(lookup(licence, scope.platforms), col(licence))


def touches_airport(scope: Scope = DEFAULT_SCOPE) -> Column:
    """Either end of the trip is an airport zone. Plain IN lists, so it is pushed
    into the parquet scan."""
    zones = sorted(scope.airports)
    return F.col("PULocationID").isin(zones) | F.col("DOLocationID").isin(zones)


def direction_of(pickup_airport: Column | str, dropoff_airport: Column | str) -> Column:
    pu, do = col(pickup_airport), col(dropoff_airport)
    return (
        F.when(pu == do, "internal")
        .when(pu.isNotNull() & do.isNotNull(), "transfer")
        .when(pu.isNotNull(), "pickup")
        .otherwise("dropoff")
    )


def rider_total() -> Column:
    """Everything the rider paid except the tip; a missing charge is zero."""
    return reduce(add, [or_zero(c) for c in RIDER_CHARGES])


def driver_gross() -> Column:
    """Driver pay plus tip; unknown pay stays unknown."""
    return F.col("driver_pay") + or_zero("tips")


def ratio_columns() -> dict[str, Column]:
    """The three ratios, given ``driver_gross`` and ``rider_total_ex_tip``."""
    return {
        "driver_share": safe_ratio("driver_gross", "rider_total_ex_tip"),
        "fare_per_mile": safe_ratio("base_passenger_fare", "trip_miles"),
        "driver_gross_per_engaged_hour": safe_ratio(
            "driver_gross", F.col("secs_engaged") / F.lit(3600.0)
        ),
    }


def flag(c: Column | str) -> Column:
    """'Y' is true, any other text false, null stays null."""
    return col(c) == "Y"


def is_valid(scope: Scope = DEFAULT_SCOPE) -> Column:
    """Positive fare and distance, long enough, and no negative wait. A missing
    wait is fine; a missing fare makes the verdict unknown (null)."""

    def wait_ok(c: str) -> Column:
        return F.col(c).isNull() | (F.col(c) >= 0)

    return (
        (F.col("base_passenger_fare") > 0)
        & (F.col("trip_miles") > 0)
        & (F.col("secs_engaged") > scope.min_valid_engaged_s)
        & wait_ok("secs_request_to_scene")
        & wait_ok("secs_scene_to_pickup")
    )
