from __future__ import annotations

import shutil
from pathlib import Path

import pytest

from curbside.sources.trips import load_all, read_month
from curbside.streaming.ingest import watch_raw
from tests.frames import raw_trips
from tests.test_ingest import land


def test_arrivals_are_built_once_and_late_files_extend_their_month(spark, tmp_path):
    raw, archive = tmp_path / "raw", str(tmp_path / "archive")
    reports = []

    def run():
        watch_raw(
            spark, str(raw), archive, str(tmp_path / "checkpoint"), on_report=reports.append
        ).awaitTermination()

    land(spark, raw, (2024, 11))
    land(spark, raw, (2024, 12))
    run()
    assert [r.built for r in reports] == [[(2024, 11), (2024, 12)]]
    run()
    assert len(reports) == 1  # nothing new
    raw_trips(spark, {}, {}).write.mode("append").parquet(
        str(raw / "fhvhv_tripdata_2024-12.parquet")
    )
    run()
    assert reports[-1].built == [(2024, 12)]
    assert read_month(spark, archive, 2024, 12).count() == 5
    assert load_all(spark, archive).count() == 8


def test_a_failed_month_is_retried_and_unlabelled_files_are_left(spark, tmp_path):
    raw, archive = tmp_path / "raw", str(tmp_path / "archive")
    reports = []

    def run():
        watch_raw(
            spark, str(raw), archive, str(tmp_path / "checkpoint"), on_report=reports.append
        ).awaitTermination()

    land(spark, raw, (2024, 11))
    raw_trips(spark, {}).write.parquet(str(raw / "fhvhv_tripdata_latest.parquet"))
    run()
    assert [r.built for r in reports] == [[(2024, 11)]]
    land(spark, raw, (2024, 12))
    bad = raw / "fhvhv_tripdata_2024-12.parquet"
    spark.createDataFrame([("much",)], "tips string").write.mode("overwrite").parquet(str(bad))
    with pytest.raises(Exception, match="months not built"):
        run()
    assert list(reports[-1].failed) == [(2024, 12)]
    good = tmp_path / "good"
    land(spark, good, (2024, 12), n=4)
    for part in bad.glob("*.parquet"):  # repaired in place
        source = max(Path(good, bad.name).glob("*.parquet"), key=lambda p: p.stat().st_size)
        shutil.copy(source, part)
    for crc in bad.glob(".*.crc"):
        crc.unlink()
    run()
    assert reports[-1].failed == {} and reports[-1].built == [(2024, 12)]
