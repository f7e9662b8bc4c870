"""Hand-written raw trips."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession

from curbside.schema import RAW_SCHEMA

PICKUP = datetime(2024, 5, 10, 12, 0, 0)
BASE = {
    "hvfhs_license_num": "HV0003",
    "request_datetime": PICKUP - timedelta(seconds=600),
    "on_scene_datetime": PICKUP - timedelta(seconds=30),
    "pickup_datetime": PICKUP,
    "dropoff_datetime": PICKUP + timedelta(seconds=1800),
    "PULocationID": 132,
    "DOLocationID": 50,
    "trip_miles": 10.0,
    "trip_time": 1800,
    "base_passenger_fare": 50.0,
    "tolls": 1.0,
    "bcf": 1.0,
    "sales_tax": 1.0,
    "congestion_surcharge": 1.0,
    "airport_fee": 1.0,
    "tips": 5.0,
    "driver_pay": 40.0,
    "shared_request_flag": "N",
    "shared_match_flag": "N",
    "wav_request_flag": "N",
    "wav_match_flag": "N",
    "cbd_congestion_fee": None,
}


def raw_trips(spark: SparkSession, *changes: dict) -> DataFrame:
    rows = [tuple({**BASE, **c}[f.name] for f in RAW_SCHEMA) for c in changes]
    return spark.createDataFrame(rows, RAW_SCHEMA)
