"""Explicit schemas for the raw input, the stored slices and the aggregates.

Raw monthly files drift: integer and float widths change, the unit of timestamps
differs, and one fee column is absent from older files. An explicit read schema
absorbs most of that in one scan; what it cannot (``sources.layouts``) is read as
stored and cast. ``mergeSchema``, which rejects INT against BIGINT, is never used.
"""

from __future__ import annotations

from pyspark.sql import types as T

# Raw trip columns.
_RAW_TYPES: dict[str, T.DataType] = {
    "hvfhs_license_num": T.StringType(),
    "request_datetime": T.TimestampNTZType(),
    "on_scene_datetime": T.TimestampNTZType(),
    "pickup_datetime": T.TimestampNTZType(),
    "dropoff_datetime": T.TimestampNTZType(),
    "PULocationID": T.LongType(),
    "DOLocationID": T.LongType(),
    "trip_miles": T.DoubleType(),
    "trip_time": T.LongType(),
    "base_passenger_fare": T.DoubleType(),
    "tolls": T.DoubleType(),
    "bcf": T.DoubleType(),
    "sales_tax": T.DoubleType(),
    "congestion_surcharge": T.DoubleType(),
    "airport_fee": T.DoubleType(),
    "tips": T.DoubleType(),
    "driver_pay": T.DoubleType(),
    "shared_request_flag": T.StringType(),
    "shared_match_flag": T.StringType(),
    "wav_request_flag": T.StringType(),
    "wav_match_flag": T.StringType(),
}
OPTIONAL_TYPES: dict[str, T.DataType] = {"cbd_congestion_fee": T.DoubleType()}

RAW_SCHEMA = T.StructType(
    [T.StructField(n, t) for n, t in {**_RAW_TYPES, **OPTIONAL_TYPES}.items()]
)

# What the rider pays besides the tip, in summation order.
RIDER_CHARGES = (
    "base_passenger_fare",
    "tolls",
    "bcf",
    "sales_tax",
    "congestion_surcharge",
    "airport_fee",
    "cbd_congestion_fee",
)
# Columns kept as 32-bit floats in storage.
FLOAT_COLUMNS = (
    "trip_miles",
    "base_passenger_fare",
    "tolls",
    "bcf",
    "sales_tax",
    "congestion_surcharge",
    "airport_fee",
    "tips",
    "driver_pay",
    "cbd_congestion_fee",
)
SMALLINT_COLUMNS = ("PULocationID", "DOLocationID")
INT_COLUMNS = ("trip_time", "secs_request_to_scene", "secs_scene_to_pickup", "secs_engaged")
LABEL_COLUMNS = ("platform", "airport", "direction")
FLAG_COLUMNS = (
    "has_on_scene",
    "pool_requested",
    "pool_matched",
    "likely_incentive",
    "is_valid",
)
# Columns the reader can do without or compute again.
DROP_ON_WRITE = (
    "hvfhs_license_num",
    "pu_airport",
    "do_airport",
    "on_scene_datetime",
    "request_datetime",
    "dropoff_datetime",
    "shared_request_flag",
    "shared_match_flag",
    "wav_request_flag",
    "wav_match_flag",
    "rider_total_ex_tip",
    "driver_gross",
    "driver_share",
    "fare_per_mile",
    "driver_gross_per_engaged_hour",
)

SLICE_SCHEMA = T.StructType(
    [T.StructField("pickup_datetime", T.TimestampNTZType())]
    + [T.StructField(c, T.ShortType()) for c in SMALLINT_COLUMNS]
    + [T.StructField(c, T.IntegerType()) for c in INT_COLUMNS]
    + [T.StructField(c, T.FloatType()) for c in FLOAT_COLUMNS]
    + [T.StructField(c, T.StringType()) for c in LABEL_COLUMNS]
    + [T.StructField(c, T.BooleanType()) for c in FLAG_COLUMNS]
)

# The archive is read with wide types (the parquet reader upcasts), plus the two
# directory partition columns.
_WIDE = {T.ShortType(): T.LongType(), T.IntegerType(): T.LongType(), T.FloatType(): T.DoubleType()}
ARCHIVE_SCHEMA = T.StructType(
    [T.StructField(f.name, _WIDE.get(f.dataType, f.dataType)) for f in SLICE_SCHEMA]
    + [T.StructField("year", T.IntegerType()), T.StructField("month", T.IntegerType())]
)


def _table(**columns: str) -> str:
    return ", ".join(f"{n} {t}" for n, t in columns.items())


def _doubles(*names: str) -> dict[str, str]:
    return dict.fromkeys(names, "double")


# As DDL text: a StructType could only be parsed with a running session.
TABLE_SCHEMAS: dict[str, str] = {
    "monthly_kpis": _table(
        month="timestamp_ntz", airport="string", platform="string", direction="string",
        trips="bigint",
        **_doubles(
            "med_fare", "med_driver_gross", "med_driver_share", "med_fare_per_mile",
            "med_gross_per_engaged_hour", "med_engaged_s", "med_curb_wait_s",
            "curb_wait_coverage", "med_miles", "pool_request_rate", "pool_match_rate",
            "incentive_rate", "mean_tip",
        ),
    ),
    "market_share": _table(
        month="timestamp_ntz", airport="string", platform="string",
        trips="bigint", share="double",
    ),
    "hourly_profile": _table(
        airport="string", platform="string", hour="int", trips="bigint",
        **_doubles(
            "med_fare", "med_gross_per_engaged_hour", "med_driver_share", "incentive_rate",
            "med_curb_wait_s", "curb_wait_coverage", "share_of_day",
        ),
    ),
    "incentive_breakdown": _table(
        month="timestamp_ntz", airport="string", platform="string", direction="string",
        trips="bigint", incentive_trips="bigint",
        **_doubles(
            "incentive_rate", "med_topup", "total_topup", "med_share_when_incentivised",
            "topup_per_trip",
        ),
    ),
    "coverage_timeline": _table(
        month="timestamp_ntz", platform="string", trips="bigint", on_scene_coverage="double"
    ),
    "data_quality": _table(
        platform="string", trips="bigint", on_scene_coverage="double", invalid_rows="bigint",
        neg_to_scene="bigint", neg_curb_wait="bigint", nonpos_fare="bigint",
        nonpos_miles="bigint", incentive_rate="double",
    ),
}
