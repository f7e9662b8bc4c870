from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curbside import schema as S
from curbside.functions.calendar import elapsed_seconds, iso_weekday, month_start
from curbside.plans import aggregates
from curbside.scope import Scope
from curbside.sources.trips import add_ratios, derive_trips, normalise_raw, read_raw, slim_for_storage
from tests.frames import PICKUP, raw_trips


def derived(spark, *changes, scope=Scope()):
    return [r.asDict() for r in derive_trips(raw_trips(spark, *changes), scope).collect()]


def test_shape(spark):
    trips = derive_trips(raw_trips(spark, {}))
    assert len(trips.columns) == 40
    assert len(slim_for_storage(trips).columns) == 25
    assert len(add_ratios(slim_for_storage(trips)).columns) == 30


def test_only_airport_trips_and_unknown_licence(spark):
    rows = derived(
        spark,
        {"PULocationID": 2, "DOLocationID": 3},
        {"PULocationID": 2, "DOLocationID": 1, "hvfhs_license_num": "HV0099"},
    )
    assert [(r["platform"], r["airport"], r["direction"]) for r in rows] == [
        ("HV0099", "EWR", "dropoff")
    ]


@pytest.mark.parametrize(
    ("pu", "do", "direction", "airport"),
    [
        (132, 50, "pickup", "JFK"),
        (50, 138, "dropoff", "LGA"),
        (132, 138, "transfer", "JFK"),
        (138, 138, "internal", "LGA"),
    ],
)
def test_direction(spark, pu, do, direction, airport):
    (row,) = derived(spark, {"PULocationID": pu, "DOLocationID": do})
    assert (row["direction"], row["airport"]) == (direction, airport)


def test_zero_denominators_give_null(spark):
    zero = dict.fromkeys(S.RIDER_CHARGES, 0.0)
    rows = derived(
        spark,
        {"trip_miles": 0.0},
        {"trip_miles": -0.0},
        {**zero, "base_passenger_fare": -0.0},
        {"dropoff_datetime": PICKUP - timedelta(seconds=600)},
    )
    assert rows[0]["fare_per_mile"] is None
    assert rows[1]["fare_per_mile"] is None
    assert rows[2]["driver_share"] is None
    assert rows[2]["likely_incentive"] is None
    assert rows[3]["driver_gross_per_engaged_hour"] is None


def test_missing_amounts(spark):
    nothing = dict.fromkeys(S.RIDER_CHARGES)
    all_null, no_pay, no_tip = derived(spark, nothing, {"driver_pay": None}, {"tips": None})
    assert all_null["rider_total_ex_tip"] == 0.0
    assert no_pay["driver_gross"] is None
    assert no_pay["likely_incentive"] is None
    assert no_tip["driver_gross"] == 40.0


@pytest.mark.parametrize(
    ("change", "valid"),
    [
        ({}, True),
        ({"on_scene_datetime": None}, True),
        ({"on_scene_datetime": PICKUP + timedelta(seconds=1)}, False),
        ({"on_scene_datetime": PICKUP}, True),
        ({"on_scene_datetime": PICKUP - timedelta(seconds=601)}, False),
        ({"dropoff_datetime": PICKUP - timedelta(seconds=540)}, False),  # 60 s engaged
        ({"dropoff_datetime": PICKUP - timedelta(seconds=539)}, True),  # 61 s
        ({"base_passenger_fare": 0.0}, False),
        ({"base_passenger_fare": None}, None),
        ({"base_passenger_fare": None, "trip_miles": 0.0}, False),
    ],
)
def test_validity(spark, change, valid):
    (row,) = derived(spark, change)
    assert row["is_valid"] is valid


def test_share_of_exactly_one_is_not_an_incentive(spark):
    at, above = derived(spark, {"driver_pay": 50.0}, {"driver_pay": 50.01})
    assert at["driver_share"] == 1.0
    assert at["likely_incentive"] is False
    assert above["likely_incentive"] is True


def test_flags_keep_null(spark):
    yes, no, unknown = derived(
        spark, *[{"shared_request_flag": f} for f in ("Y", "N", None)]
    )
    assert [r["pool_requested"] for r in (yes, no, unknown)] == [True, False, None]


def test_elapsed_seconds_truncate_and_ignore_the_time_zone(spark):
    pairs = [
        (datetime(2024, 1, 1, 0, 0, 1, 800000), datetime(2024, 1, 1), -1),
        (datetime(2024, 1, 1), datetime(2024, 1, 1, 0, 0, 0, 900000), 0),
        # These wall-clock times do not exist in New York.
        (datetime(2024, 3, 10, 2, 30), datetime(2024, 3, 10, 3, 30), 3600),
        (datetime(2024, 11, 3, 0, 30), datetime(2024, 11, 3, 3, 30), 10800),
    ]
    df = spark.createDataFrame([p[:2] for p in pairs], "a timestamp_ntz, b timestamp_ntz")
    assert [r[0] for r in df.select(elapsed_seconds("a", "b")).collect()] == [p[2] for p in pairs]


def test_calendar_parts(spark):
    df = spark.createDataFrame([(datetime(2024, 3, 10, 2, 30),)], "t timestamp_ntz")
    row = df.select(month_start("t").alias("m"), iso_weekday("t").alias("d"), F.hour("t")).first()
    assert tuple(row) == (datetime(2024, 3, 1), 7, 2)
    assert dict(df.select(month_start("t").alias("m")).dtypes)["m"] == "timestamp_ntz"


def test_storage_round_trip(spark):
    trips = derive_trips(raw_trips(spark, {}, {"tips": None, "tolls": None}))
    back = add_ratios(slim_for_storage(trips))
    for a, b in zip(trips.collect(), back.collect()):
        for c in ("driver_gross", "rider_total_ex_tip", "driver_share", "fare_per_mile"):
            assert b[c] == pytest.approx(a[c], rel=1e-6)
    assert add_ratios(trips) is trips


def test_read_absorbs_schema_drift(spark, tmp_path):
    raw = raw_trips(spark, {})
    raw.write.parquet(str(tmp_path / "a.parquet"))
    old = raw.drop("cbd_congestion_fee").withColumns(
        {
            "PULocationID": F.col("PULocationID").cast("int"),
            "trip_time": F.col("trip_time").cast("int"),
            "tips": F.col("tips").cast("float"),
        }
    )
    spark.conf.set("spark.sql.parquet.outputTimestampType", "TIMESTAMP_MILLIS")
    try:
        old.write.parquet(str(tmp_path / "b.parquet"))
    finally:
        spark.conf.unset("spark.sql.parquet.outputTimestampType")
    both = read_raw(spark, [str(tmp_path / "a.parquet"), str(tmp_path / "b.parquet")])
    assert both.schema == T.StructType([T.StructField(f.name, f.dataType) for f in S.RAW_SCHEMA])
    assert both.distinct().count() == 1
    assert normalise_raw(old).schema.names == S.RAW_SCHEMA.names


def test_scan_is_pruned_and_filtered(spark, tmp_path):
    path = str(tmp_path / "raw.parquet")
    raw_trips(spark, {}).write.parquet(path)
    df = aggregates.market_share(derive_trips(read_raw(spark, path)))
    plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")
    scan = next(line for line in plan.splitlines() if "FileScan parquet" in line)
    columns = scan.split("parquet [")[1].split("]")[0].split(",")
    assert {c.split("#")[0] for c in columns} == {
        "hvfhs_license_num", "pickup_datetime", "PULocationID", "DOLocationID",
    }
    assert "Or(In(PULocationID" in scan


def test_incentive_sums_are_zero_not_null(spark):
    trips = derive_trips(raw_trips(spark, {}, {}))
    (row,) = aggregates.incentive_breakdown(trips).collect()
    assert (row.trips, row.incentive_trips, row.total_topup, row.topup_per_trip) == (2, 0, 0, 0)
    assert row.med_topup is None
    assert row.med_share_when_incentivised is None


def test_unknown_validity_is_neither_kept_nor_counted_invalid(spark):
    trips = derive_trips(
        raw_trips(spark, {}, {"base_passenger_fare": None}, {"base_passenger_fare": 0.0})
    )
    (row,) = aggregates.data_quality(trips).collect()
    assert (row.trips, row.invalid_rows, row.nonpos_fare) == (3, 1, 1)
    assert aggregates.monthly_kpis(trips).first().trips == 1
    assert aggregates.monthly_kpis(trips, valid_only=False).first().trips == 3


def test_shared_passes_equal_the_direct_tables(spark):
    changes = [
        {
            "PULocationID": (132, 138, 50)[i % 3],
            "DOLocationID": (138, 132, 1)[i % 2],
            "hvfhs_license_num": ("HV0003", "HV0005")[i % 2],
            "driver_pay": 20.0 + 7 * (i % 11),
            "pickup_datetime": PICKUP + timedelta(hours=5 * i),
            "on_scene_datetime": None if i % 5 == 0 else PICKUP,
            "shared_request_flag": "Y" if i % 4 == 0 else "N",
            "dropoff_datetime": PICKUP + timedelta(hours=5 * i, seconds=900 + i),
        }
        for i in range(300)
    ]
    trips = derive_trips(raw_trips(spark, *changes))
    direct = {
        "monthly_kpis": aggregates.monthly_kpis, "market_share": aggregates.market_share,
        "hourly_profile": aggregates.hourly_profile,
        "incentive_breakdown": aggregates.incentive_breakdown,
        "coverage_timeline": aggregates.coverage_timeline,
        "data_quality": aggregates.data_quality,
    }
    for name, shared in aggregates.all_tables(trips).items():
        expected = sorted(map(repr, _rounded(direct[name](trips))))
        assert sorted(map(repr, _rounded(shared))) == expected, name


def _rounded(df):
    for row in df.select(*sorted(df.columns)).collect():
        yield [round(v, 9) if isinstance(v, float) else v for v in row]
