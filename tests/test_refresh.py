from __future__ import annotations

from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from curbside.plans import refresh
from curbside.plans.ingest import build_archive
from curbside.plans.refresh import refresh_aggregates
from curbside.scope import AGGREGATE_TABLES
from curbside.sources.tables import read_table
from curbside.sources.trips import load_all
from curbside.study import export_aggregates
from tests.frames import BASE, raw_trips
from tests.test_ingest import land


@pytest.fixture
def folders(tmp_path):
    return tmp_path / "raw", str(tmp_path / "archive"), str(tmp_path / "tables")


def varied(spark, raw, ym, n=60, seed=0, fare=30.0):
    """A month of trips that differ in platform, hour and money."""
    start = datetime(ym[0], ym[1], 3, 0)
    rows = []
    for i in range(n):
        k = (i * 7 + seed) % 23
        pickup = start.replace(day=1 + i % 27, hour=k, minute=i % 60)
        rows.append(
            {
                "pickup_datetime": pickup,
                "request_datetime": pickup.replace(minute=0),
                "on_scene_datetime": None if k == 4 else pickup,
                "dropoff_datetime": pickup.replace(hour=k + 0, minute=59, second=59),
                "hvfhs_license_num": ("HV0003", "HV0005")[i % 3 == 0],
                "base_passenger_fare": fare + k * 1.37 + i * 0.11,
                "driver_pay": 20.0 + (i % 11) * 6,
                "PULocationID": (132, 138, 50)[i % 3],
                "DOLocationID": (50, 50, 132)[i % 3],
            }
        )
    from curbside.sources.files import raw_path

    raw_trips(spark, *rows).write.mode("overwrite").parquet(raw_path(str(raw), ym))


def equal_to_export(spark, archive, base):
    whole = f"{base}-whole"
    export_aggregates(load_all(spark, archive), whole)
    for name in AGGREGATE_TABLES:
        mine, full = read_table(spark, base, name), read_table(spark, whole, name)
        keys = [c for c, t in full.dtypes if t != "double"]
        rounded = [F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in full.dtypes]
        a, b = (sorted(map(str, df.select(rounded).collect())) for df in (mine, full))
        assert a == b, (name, keys)
    return True


def test_refreshes_equal_full_exports(spark, folders):
    raw, archive, base = folders
    for i, ym in enumerate(((2024, 9), (2024, 10), (2024, 11))):
        varied(spark, raw, ym, seed=i)
    build_archive(spark, str(raw), archive, start=(2024, 9))
    first = refresh_aggregates(spark, archive, base)
    assert first.changed == first.read == first.months == [(2024, 9), (2024, 10), (2024, 11)]
    assert first.rebracketed and equal_to_export(spark, archive, base)

    again = refresh_aggregates(spark, archive, base)
    assert again == refresh.Refreshed()

    varied(spark, raw, (2024, 12), seed=5)
    build_archive(spark, str(raw), archive, start=(2024, 9))
    added = refresh_aggregates(spark, archive, base)
    assert added.changed == added.read == added.months == [(2024, 12)]
    assert equal_to_export(spark, archive, base)

    varied(spark, raw, (2024, 10), n=31, seed=9)
    build_archive(spark, str(raw), archive, start=(2024, 10), end=(2024, 10), overwrite=True)
    rewritten = refresh_aggregates(spark, archive, base)
    assert rewritten.changed == rewritten.read == rewritten.months == [(2024, 10)]
    assert equal_to_export(spark, archive, base)

    land(spark, raw, (2024, 9), PULocationID=2, DOLocationID=3)
    build_archive(spark, str(raw), archive, start=(2024, 9), end=(2024, 9), overwrite=True)
    removed = refresh_aggregates(spark, archive, base)
    assert removed.changed == removed.months == [(2024, 9)] and removed.read == []
    assert equal_to_export(spark, archive, base)


def test_strays_and_drift(spark, folders):
    raw, archive, base = folders
    varied(spark, raw, (2024, 9))
    varied(spark, raw, (2024, 10), seed=3)
    build_archive(spark, str(raw), archive, start=(2024, 9))
    refresh_aggregates(spark, archive, base)
    # A slice whose only pickups lie in another month: that month's own slice is read with it.
    land(spark, raw, (2024, 11), pickup_datetime=datetime(2024, 10, 31, 23, 59))
    build_archive(spark, str(raw), archive, start=(2024, 9))
    stray = refresh_aggregates(spark, archive, base)
    assert stray.changed == [(2024, 11)] and stray.months == [(2024, 10)]
    assert stray.read == [(2024, 10), (2024, 11)] and equal_to_export(spark, archive, base)
    # Many trips at other prices move the middle out of the stored brackets.
    varied(spark, raw, (2024, 12), n=400, seed=2, fare=900.0)
    build_archive(spark, str(raw), archive, start=(2024, 9))
    drift = refresh_aggregates(spark, archive, base)
    assert drift.rebracketed and drift.months == [(2024, 12)] and equal_to_export(spark, archive, base)


def test_an_interrupted_refresh_is_done_again(spark, folders, monkeypatch):
    raw, archive, base = folders
    varied(spark, raw, (2024, 9))
    build_archive(spark, str(raw), archive, start=(2024, 9))
    refresh_aggregates(spark, archive, base)
    varied(spark, raw, (2024, 10), seed=3)
    build_archive(spark, str(raw), archive, start=(2024, 9))

    def lost(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(refresh, "_write_manifest", lost)
        with pytest.raises(RuntimeError, match="lost"):
            refresh_aggregates(spark, archive, base)
    assert refresh_aggregates(spark, archive, base).changed == [(2024, 10)]
    assert equal_to_export(spark, archive, base)
    assert Path(base, "_state", "manifest", "_SUCCESS").exists() and BASE


def test_an_unreadable_slice_is_named(spark, folders):
    raw, archive, base = folders
    varied(spark, raw, (2024, 9))
    build_archive(spark, str(raw), archive, start=(2024, 9))
    (Path(archive) / "year=2024" / "month=9" / "part-x.parquet").write_bytes(b"no parquet")
    with pytest.raises(ValueError, match="no readable range"):
        refresh_aggregates(spark, archive, base)
