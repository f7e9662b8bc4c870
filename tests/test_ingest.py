from __future__ import annotations

from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import curbside
from curbside.functions import calendar
from curbside.plans import ingest
from curbside.schema import RAW_SCHEMA
from curbside.sources.files import archived_months, raw_path
from curbside.sources.tables import read_table, write_tables
from curbside.sources.trips import load_all, load_recent, read_month, scan_airport_trips
from tests.frames import BASE, raw_trips


def land(spark, folder, ym, n=3, **changes):
    start = datetime(ym[0], ym[1], 2, 9)
    rows = [
        {
            "request_datetime": start + timedelta(hours=i) - timedelta(minutes=5),
            "on_scene_datetime": start + timedelta(hours=i) - timedelta(seconds=20),
            "pickup_datetime": start + timedelta(hours=i),
            "dropoff_datetime": start + timedelta(hours=i, minutes=30),
            "PULocationID": (138, 132)[i % 2],
            **changes,
        }
        for i in range(n)
    ]
    raw_trips(spark, *rows).write.mode("overwrite").parquet(raw_path(str(folder), ym))


@pytest.fixture
def folders(tmp_path):
    return tmp_path / "raw", str(tmp_path / "archive")


def test_build_resumes_and_reports(spark, folders):
    raw, archive = folders
    for ym in ((2024, 11), (2024, 12), (2025, 2)):
        land(spark, raw, ym)
    first = curbside.build_archive(spark, str(raw), archive, start=(2024, 11))
    assert first.built == [(2024, 11), (2024, 12), (2025, 2)]
    assert first.missing == [(2025, 1)]
    land(spark, raw, (2025, 1), n=5)
    second = curbside.build_archive(spark, str(raw), archive, start=(2024, 11))
    assert second.built == [(2025, 1)]
    assert second.present == first.built
    assert second.available == [(2024, 11), (2024, 12), (2025, 1), (2025, 2)]
    again = curbside.build_archive(spark, str(raw), archive, start=(2024, 11))
    assert again.built == [] and again.missing == []
    assert load_all(spark, archive).count() == 14
    assert load_all(spark, archive, (2024, 12), (2025, 1)).count() == 8
    assert read_month(spark, archive, 2025, 1).count() == 5


def test_a_month_without_airport_trips_is_reported_empty(spark, folders):
    raw, archive = folders
    land(spark, raw, (2024, 11))
    land(spark, raw, (2024, 12), PULocationID=2, DOLocationID=3)
    report = curbside.build_archive(spark, str(raw), archive, start=(2024, 11))
    assert report.built == [(2024, 11)] and report.empty == [(2024, 12)]


def test_reports_carry_the_rows_read_and_kept(spark, folders):
    raw, archive = folders
    land(spark, raw, (2024, 11), n=4)
    land(spark, raw, (2024, 12), PULocationID=2, DOLocationID=3)
    Path(raw_path(str(raw), (2025, 1))).write_bytes(b"PAR1 this is not parquet PAR1")
    report = curbside.build_archive(spark, str(raw), archive, start=(2024, 11))
    assert report.read == {(2024, 11): 4, (2024, 12): 3}
    assert report.kept == {(2024, 11): 4, (2024, 12): 0}
    assert load_all(spark, archive).count() == 4


def test_recent_trips_scan_only_slices_that_reach_the_window(spark, folders):
    raw, archive = folders
    for ym in ((2024, 9), (2024, 10), (2024, 11), (2024, 12)):
        land(spark, raw, ym)
    # A stray pickup of December in the slice of September.
    land(spark, raw, (2024, 9), pickup_datetime=datetime(2024, 12, 31, 23, 0))
    curbside.build_archive(spark, str(raw), archive, start=(2024, 9))
    for window, n in ((1, 6), (2, 9), (4, 12), (40, 12), (0, 0), (-1, 0)):
        found = load_recent(spark, archive, window)
        months = [(r.y, r.m) for r in found.select(F.year("pickup_datetime").alias("y"), F.month("pickup_datetime").alias("m")).collect()]  # noqa: E501
        assert len(months) == n, window
        assert all(12 - m < window for _, m in months)
    plan = load_recent(spark, archive, 1)._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "PartitionFilters" in line)
    pruned, pushed = scan.split("PartitionFilters: ")[1].split("PushedFilters: ")
    assert "202409" in pruned and "202412" in pruned and "202410" not in pruned
    assert "GreaterThanOrEqual(pickup_datetime" in pushed


def test_overwrite_replaces_only_that_month(spark, folders):
    raw, archive = folders
    for ym in ((2024, 11), (2024, 12)):
        land(spark, raw, ym)
    curbside.build_archive(spark, str(raw), archive, start=(2024, 11))
    land(spark, raw, (2024, 12), n=7)
    path = curbside.build_month(spark, str(raw), archive, 2024, 12)
    assert path.endswith("year=2024/month=12")
    assert read_month(spark, archive, 2024, 12).count() == 3
    curbside.build_month(spark, str(raw), archive, 2024, 12, overwrite=True)
    assert read_month(spark, archive, 2024, 12).count() == 7
    assert read_month(spark, archive, 2024, 11).count() == 3


def test_overwrite_with_an_empty_month_drops_the_old_slice(spark, folders):
    raw, archive = folders
    for ym in ((2024, 11), (2024, 12)):
        land(spark, raw, ym)
    curbside.build_archive(spark, str(raw), archive, start=(2024, 11))
    land(spark, raw, (2024, 12), PULocationID=2, DOLocationID=3)
    report = curbside.build_archive(spark, str(raw), archive, start=(2024, 11), overwrite=True)
    assert report.built == [(2024, 11)] and report.empty == [(2024, 12)]
    assert load_all(spark, archive).count() == 3
    with pytest.raises(FileNotFoundError):
        read_month(spark, archive, 2024, 12)
    land(spark, raw, (2024, 11), PULocationID=2, DOLocationID=3)
    curbside.build_month(spark, str(raw), archive, 2024, 11, overwrite=True)
    assert archived_months(spark, archive) == []


def test_an_error_that_is_no_bad_file_is_raised(spark, folders):
    raw, archive = folders
    land(spark, raw, (2024, 11))
    Path(archive).write_text("a file where the archive should be")
    with pytest.raises(Exception, match="(?i)archive|parent|director|mkdirs"):
        curbside.build_archive(spark, str(raw), archive, start=(2024, 11))


def test_a_stray_pickup_stays_in_the_month_of_its_file(spark, folders):
    raw, archive = folders
    land(spark, raw, (2024, 11))
    land(spark, raw, (2024, 12), pickup_datetime=datetime(2024, 11, 30, 23, 59))
    curbside.build_archive(spark, str(raw), archive, start=(2024, 11))
    assert read_month(spark, archive, 2024, 11).count() == 3
    assert read_month(spark, archive, 2024, 12).count() == 3


def test_one_corrupt_month_does_not_stop_the_rest(spark, folders):
    raw, archive = folders
    for ym in ((2024, 9), (2024, 10), (2024, 12)):
        land(spark, raw, ym)
    Path(raw_path(str(raw), (2024, 11))).write_bytes(b"PAR1 this is not parquet PAR1")
    report = curbside.build_archive(spark, str(raw), archive, start=(2024, 9))
    assert report.built == [(2024, 9), (2024, 10), (2024, 12)]
    assert list(report.failed) == [(2024, 11)]
    assert archived_months(spark, archive) == report.built


def test_slices_are_sorted_and_narrow(spark, folders):
    raw, archive = folders
    land(spark, raw, (2024, 11), n=20)
    curbside.build_archive(spark, str(raw), archive, start=(2024, 11))
    (part,) = Path(archive, "year=2024", "month=11").glob("*.parquet")
    df = spark.read.parquet(str(part))
    keys = [tuple(r) for r in df.select("airport", "pickup_datetime").collect()]
    assert keys == sorted(keys) and {k[0] for k in keys} == {"JFK", "LGA"}
    types = dict(df.dtypes)
    assert (types["PULocationID"], types["secs_engaged"], types["tips"]) == (
        "smallint", "int", "float",
    )
    assert len(types) == 25
    wide = dict(load_all(spark, archive).dtypes)
    assert (wide["secs_engaged"], wide["tips"], len(wide)) == ("bigint", "double", 30)


def test_a_large_month_becomes_many_sorted_files(spark, folders):
    """One month with nearly all rows is split by size, not written by one task."""
    raw, archive = folders
    land(spark, raw, (2024, 12), n=5)
    month = F.expr("timestamp_ntz'2024-11-01' + make_dt_interval(0, 0, 0, id * 6)")
    big = spark.range(400_000).select(
        *[F.lit(v).cast(RAW_SCHEMA[c].dataType).alias(c) for c, v in BASE.items()
          if not c.endswith("_datetime") and c not in ("tips", "tolls", "bcf")],
        *[month.alias(c) for c in BASE if c.endswith("_datetime")],
        *[F.rand(seed).alias(c) for seed, c in enumerate(("tips", "tolls", "bcf"))],
    )
    big.write.parquet(raw_path(str(raw), (2024, 11)))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "512KB")
    try:
        curbside.build_archive(spark, str(raw), archive, start=(2024, 11))
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    parts = list(Path(archive, "year=2024", "month=11").glob("*.parquet"))
    assert len(parts) > 3
    for part in parts:
        rows = spark.read.parquet(str(part)).select("airport", "pickup_datetime").collect()
        keys = [tuple(r) for r in rows]
        assert keys == sorted(keys) and len(keys) < 200_000
    assert read_month(spark, archive, 2024, 11).count() == 400_000


def test_missing_month_and_table(spark, folders, tmp_path):
    raw, archive = folders
    with pytest.raises(FileNotFoundError):
        read_month(spark, archive, 2024, 1)
    with pytest.raises(FileNotFoundError):
        curbside.build_month(spark, str(raw), archive, 2024, 1)
    with pytest.raises(FileNotFoundError):
        read_table(spark, str(tmp_path), "monthly_kpis")


@pytest.mark.parametrize("fmt", ["parquet", "json"])
def test_export_round_trip(spark, tmp_path, fmt):
    path = raw_path(str(tmp_path), (2024, 11))
    land(spark, tmp_path, (2024, 11), n=9)
    trips = scan_airport_trips(spark, path)
    written = curbside.export_aggregates(trips, str(tmp_path / "out"), fmt)
    assert sorted(written) == sorted(curbside.scope.AGGREGATE_TABLES)
    for name in written:
        table = read_table(spark, str(tmp_path / "out"), name, fmt)
        assert table.count() > 0, name
    share = read_table(spark, str(tmp_path / "out"), "market_share", fmt)
    assert share.agg(F.sum("trips")).first()[0] == 9


def test_export_rejects_bad_input(spark, tmp_path):
    with pytest.raises(ValueError, match="cannot write"):
        curbside.export_aggregates(raw_trips(spark, {}), str(tmp_path), "csv")
    with pytest.raises(ValueError, match="not the six tables"):
        write_tables({"monthly_kpis": raw_trips(spark, {})}, str(tmp_path))


def test_months_and_labels():
    assert curbside.months((2023, 11), (2024, 2)) == [(2023, 11), (2023, 12), (2024, 1), (2024, 2)]
    assert curbside.months((2024, 2), (2024, 1)) == []
    assert curbside.month_add((2024, 1), -1) == (2023, 12)
    assert curbside.parse_ym("2025-01") == curbside.parse_ym(" 2025-1 ") == (2025, 1)
    for bad in ("2025-13", "2018-05", "abc", "2025", "2025-01-01", ""):
        with pytest.raises(ValueError):
            curbside.parse_ym(bad)


def test_label_column_agrees_with_the_scalar_rule(spark):
    labels = ["2025-01", " 2025-1 ", "2025-13", "2018-05", "abc", "2025", "2025-01-01", "", "2101-01",
              "99999999999999999999-01", "2025-" + "9" * 60, "-2025-01", "2025--1"]
    df = spark.createDataFrame([(x,) for x in labels], "label string")
    for row in calendar.parse_month_labels(df, "label").collect():
        try:
            expected = curbside.parse_ym(row.label)
        except ValueError as exc:
            assert row.year is None and row.month is None
            assert str(exc).startswith(row.error)
        else:
            assert (row.year, row.month, row.error) == (*expected, None)


def test_month_spine(spark):
    bounds = spark.createDataFrame(
        [(datetime(2023, 12, 5), datetime(2024, 2, 1)), (datetime(2024, 2, 1), datetime(2024, 1, 1)),
         (None, datetime(2024, 1, 1))],
        "a timestamp_ntz, b timestamp_ntz",
    )
    spine = calendar.month_spine(bounds, "a", "b")
    assert [r.month for r in spine.orderBy("month").collect()] == [
        datetime(2023, 12, 1), datetime(2024, 1, 1), datetime(2024, 2, 1),
    ]
    present = spark.createDataFrame([(datetime(2024, 1, 1),)], "month timestamp_ntz")
    assert ingest.months_to_build(spine, present).count() == 2
