"""Raw files of other writers: time units, number widths, null-typed columns."""

from __future__ import annotations

from datetime import datetime
from decimal import Decimal
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from curbside.plans import quality
from curbside.plans.ingest import build_archive
from curbside.schema import RAW_SCHEMA
from curbside.sources.files import raw_path
from curbside.sources import footers
from curbside.sources.layouts import by_layout
from curbside.sources.trips import load_all, read_raw
from tests.frames import BASE
from tests.test_ingest import land

TIMES = [c for c in BASE if c.endswith("_datetime")]
EXACT = datetime(2024, 3, 10, 2, 30, 0, 123000)  # an hour that New York skips


def write(path, unit="us", **types):
    """One trip as another writer would store it."""
    values = {**BASE, **dict.fromkeys(TIMES, EXACT)}
    arrays = {}
    for name, value in values.items():
        if name in types:
            kind = types[name]
            arrays[name] = pa.array([None if pa.types.is_null(kind) else value], kind)
        elif name in TIMES:
            arrays[name] = pa.array([value], pa.timestamp(unit))
        else:
            arrays[name] = pa.array([value], pa.float64() if value is None else None)
    pq.write_table(pa.table(arrays), path, version="2.6")


@pytest.mark.parametrize("unit", ["ms", "us", "ns"])
def test_time_units(spark, tmp_path, unit):
    path = str(tmp_path / "a.parquet")
    write(path, unit)
    df = read_raw(spark, path)
    assert df.schema == RAW_SCHEMA
    row = df.first()
    assert [row[c] for c in TIMES] == [EXACT] * 4
    assert row.tips == 5.0 and row.PULocationID == 132


def test_nanoseconds_before_the_epoch_and_nulls(spark, tmp_path):
    path = str(tmp_path / "a.parquet")
    ns = [-1, -1000, 1_999, None]
    arrays = {c: pa.array(ns, pa.timestamp("ns")) for c in TIMES}
    pq.write_table(pa.table(arrays), path, version="2.6")
    got = [r.pickup_datetime for r in read_raw(spark, path).select("pickup_datetime").collect()]
    one_before = datetime(1969, 12, 31, 23, 59, 59, 999999)
    assert got == [one_before, one_before, datetime(1970, 1, 1, 0, 0, 0, 1), None]


def test_widths_and_null_types(spark, tmp_path):
    path = str(tmp_path / "a.parquet")
    write(
        path, "ns", tips=pa.int64(), tolls=pa.int32(), bcf=pa.float32(), airport_fee=pa.null(),
        PULocationID=pa.float64(), DOLocationID=pa.int32(), cbd_congestion_fee=pa.null(),
    )
    df = read_raw(spark, path)
    assert df.schema == RAW_SCHEMA
    row = df.first()
    assert (row.tips, row.tolls, row.bcf, row.airport_fee) == (5.0, 1.0, 1.0, None)
    assert (row.PULocationID, row.DOLocationID, row.cbd_congestion_fee) == (132, 50, None)


def test_decimal_money_and_missing_whole_numbers(spark, tmp_path):
    path = str(tmp_path / "a.parquet")
    pq.write_table(
        pa.table(
            {
                "tips": pa.array([Decimal("5.25"), None], pa.decimal128(12, 2)),
                "PULocationID": pa.array([132.0, float("nan")]),
            }
        ),
        path,
    )
    got = [(r.tips, r.PULocationID) for r in read_raw(spark, path).collect()]
    assert got == [(5.25, 132), (None, None)]


def test_mixed_layouts_are_one_scan_each(spark, tmp_path):
    paths = [str(tmp_path / f"{i}.parquet") for i in range(4)]
    for path, unit in zip(paths, ("ms", "us", "ns", "ns"), strict=True):
        write(path, unit)
    groups, broken = by_layout(spark, paths)
    assert broken == {} and sorted(map(len, groups.values())) == [2, 2]
    assert [r.pickup_datetime for r in read_raw(spark, paths).collect()] == [EXACT] * 4


def test_a_text_time_is_named(spark, tmp_path):
    path = str(tmp_path / "a.parquet")
    pq.write_table(pa.table({"pickup_datetime": ["soon"]}), path)
    with pytest.raises(ValueError, match="pickup_datetime is string"):
        read_raw(spark, path)


def test_archive_of_mixed_files(spark, tmp_path):
    raw, archive = tmp_path / "raw", str(tmp_path / "archive")
    land(spark, raw, (2024, 11))
    write(raw_path(str(raw), (2024, 12)), "ns", tips=pa.int64())
    pq.write_table(pa.table({"tips": ["much"]}), raw_path(str(raw), (2025, 1)))
    report = build_archive(spark, str(raw), archive, start=(2024, 11))
    assert report.built == [(2024, 11), (2024, 12)]
    assert list(report.failed) == [(2025, 1)] and "tips" in report.failed[2025, 1]
    assert load_all(spark, archive).count() == 4


def month_of_parts(raw, ym, *writers):
    """A month as a folder of part files, each of another writer."""
    folder = Path(raw_path(str(raw), ym))
    folder.mkdir(parents=True)
    for i, writer in enumerate(writers):
        write(str(folder / f"part-{i}.parquet"), **writer)
    return folder


MIXED = ({}, {"trip_miles": pa.int64()}, {"unit": "ns", "DOLocationID": pa.float64()}, {"unit": "ms"})


def test_part_files_of_a_month_may_differ(spark, tmp_path):
    raw, archive = tmp_path / "raw", str(tmp_path / "archive")
    land(spark, raw, (2024, 11))
    month_of_parts(raw, (2024, 12), *MIXED)
    land(spark, raw, (2025, 1))
    report = build_archive(spark, str(raw), archive, start=(2024, 11))
    assert report.built == [(2024, 11), (2024, 12), (2025, 1)] and report.failed == {}
    assert load_all(spark, archive, (2024, 12), (2024, 12)).count() == len(MIXED)
    rows = read_raw(spark, raw_path(str(raw), (2024, 12))).collect()
    assert {(r.pickup_datetime, r.trip_miles, r.DOLocationID) for r in rows} == {(EXACT, 10.0, 50)}


def test_a_bad_part_file_stops_its_month_only(spark, tmp_path):
    raw, archive = tmp_path / "raw", str(tmp_path / "archive")
    for m in (1, 3):
        land(spark, raw, (2020, m))
    folder = month_of_parts(raw, (2020, 2), *MIXED)
    (folder / "part-9.parquet").write_bytes(b"PAR1 this is not parquet PAR1")
    cut = month_of_parts(raw, (2020, 4), {}, {})
    whole = (cut / "part-1.parquet").read_bytes()
    (cut / "part-1.parquet").write_bytes(whole[: len(whole) // 2])
    month_of_parts(raw, (2020, 5), {})
    pq.write_table(pa.table({"tips": ["much"]}), str(Path(raw_path(str(raw), (2020, 5))) / "part-7.parquet"))
    Path(raw_path(str(raw), (2020, 6))).mkdir()
    report = build_archive(spark, str(raw), archive, start=(2020, 1))
    assert report.built == [(2020, 1), (2020, 3)]
    assert list(report.failed) == [(2020, 2), (2020, 4), (2020, 5), (2020, 6)]
    assert "part-9" in report.failed[2020, 2] and "part-1" in report.failed[2020, 4]
    assert "column tips is string" in report.failed[2020, 5]
    months = {r.month.month: tuple(r)[1:] for r in quality.stored_months(spark, str(raw)).collect()}
    assert months[2] == (4, 1, 4) and months[4] == (1, 1, 1) and months[1][1:] == (0, 3)


def test_jobs_do_not_grow_with_the_months(spark, tmp_path):
    found = []
    for n in (2, 7):
        raw = tmp_path / f"raw{n}"
        paths = [str(month_of_parts(raw, (2021, m + 1), *MIXED)) for m in range(n)]
        spark.sparkContext.setJobGroup(f"footers-{n}", "")
        groups, broken = by_layout(spark, paths)
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(f"footers-{n}")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert broken == {} and sum(map(len, groups.values())) == 4 * n
        found.append(len(jobs))
    assert found[0] == found[1]


def test_footers_by_arrow_and_by_hadoop_agree(spark, tmp_path):
    folder = month_of_parts(tmp_path, (2021, 1), *MIXED, {"tips": pa.int32()})
    spark.conf.set("spark.sql.legacy.parquet.nanosAsLong", "true")
    arrow = footers.footers(spark, [str(folder)]).collect()
    assert len(arrow) == 5 and {r.path for r in arrow} == {str(folder)}
    hadoop = {r[0]: r[1:3] for r in footers._by_hadoop(spark, [r.file for r in arrow])}
    assert hadoop == {r.file: (r.rows, r.columns) for r in arrow}
    bad = tmp_path / "bad.parquet"
    bad.write_bytes(b"PAR1 no PAR1")
    (row,) = footers._by_hadoop(spark, [f"file:{bad}"])
    assert row[1] is None and "RuntimeException" in row[5]


def test_span_and_counts_come_from_footers(spark, tmp_path):
    folder = tmp_path / "times"
    folder.mkdir()
    times = [datetime(1969, 12, 31, 23, 59, 59, 5), datetime(2021, 3, 14, 2, 30), None]
    for i, unit in enumerate(("ms", "us", "us")):
        column = pa.array([times[i], times[1]], pa.timestamp(unit))
        pq.write_table(pa.table({"t": column}), folder / f"{i}.parquet", write_statistics=i != 1)
    pq.write_table(pa.table({"t": pa.array([], pa.timestamp("us"))}), folder / "none.parquet")
    pq.write_table(pa.table({"t": pa.array([None], pa.timestamp("us"))}), folder / "null.parquet")
    got = footers.time_span(spark, [str(folder)], "t").first()
    assert tuple(got) == (datetime(1969, 12, 31, 23, 59, 59), datetime(2021, 3, 14, 2, 30))
    (row,) = footers.rows_by_path(spark, [str(folder)]).collect()
    assert (row.files, row.faulty, row.rows) == (5, 0, 7)
    assert footers.footers(spark, []).count() == 0
