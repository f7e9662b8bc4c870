"""Rules that hold for any data, on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from curbside.plans import market, quality
from curbside.plans.aggregates import TRIP_COLUMNS, all_tables
from curbside.registry import SCOPE, Source, neat, source
from curbside.scope import AGGREGATE_TABLES
from curbside.sources.files import raw_months, raw_path
from curbside.sources.landing import METHOD_LIMIT
from curbside.sources.trips import read_raw
from curbside.study import ExportingStudy


@pytest.fixture(scope="module")
def src(spark):
    return source(spark, "/root/testdata/sf0.001")


@pytest.mark.parametrize(
    ("table", "keys", "share"),
    [("market_share", ["month", "airport"], "share"),
     ("hourly_profile", ["airport", "platform"], "share_of_day")],
)
def test_shares_sum_to_one(src, table, keys, share):
    sums = src.study.tables[table].groupBy(*keys).agg(F.sum(share).alias("s"))
    assert sums.where(F.abs(F.col("s") - 1) > 1e-9).count() == 0


def test_concentration_is_bounded(src):
    hhi = market.concentration(src.study.share)
    assert hhi.where((F.col("hhi") <= 0) | (F.col("hhi") > 10_000 + 1e-6)).count() == 0


def test_censored_months_are_a_suffix(src):
    flags = [r.censored for r in market.monthly_volume(src.study.share, SCOPE).collect()]
    assert flags == sorted(flags)


def test_every_trip_has_one_airport_and_direction(src):
    trips = src.trips
    total = trips.count()
    assert trips.where(F.col("airport").isNull() | F.col("direction").isNull()).count() == 0
    wide = quality.trips_by_direction(trips).fillna(0)
    columns = ("pickup", "dropoff", "transfer", "internal")
    assert sum(sum(r[c] for c in columns) for r in wide.collect()) == total
    assert src.study.share.agg(F.sum("trips")).first()[0] == total


def test_cleaning_only_removes(src):
    steps = quality.funnel(src.trips, src.study.live, src.study.airports, SCOPE).collect()
    rows = [r.rows for r in steps]
    assert rows == sorted(rows, reverse=True) and rows[-1] > 0
    naive = quality.airport_platform_summary(src.trips)
    clean = quality.airport_platform_summary(quality.clean_trips(src.trips, src.study.live, SCOPE))
    effect = quality.cleaning_effect(naive, clean)
    assert effect.where("trips_delta > 0").count() == 0


def test_unknown_licence_is_kept(src):
    assert "HV0006" in [r.platform for r in src.study.census.collect()]


def test_dispatch_excludes_the_one_way_airport(src):
    assert src.study.airport_names == ["JFK", "LGA"]


def test_a_table_is_exported_with_those_of_its_scans_only(spark, src, tmp_path):
    base = tmp_path / "tables"
    study = ExportingStudy(spark, str(base), src.trips, SCOPE)
    study.quality.collect(), study.share.collect()
    assert {p.name for p in base.iterdir()} == {"coverage_timeline", "data_quality", "market_share"}
    assert study.incentive.count() == study.kpis.count()
    assert {p.name for p in base.iterdir()} == set(AGGREGATE_TABLES) - {"hourly_profile"}
    whole = all_tables(src.trips)
    assert list(study.tables) == list(whole)
    for name in ("coverage_timeline", "data_quality", "market_share"):
        assert sorted(map(str, study.table(name).collect())) == sorted(map(str, whole[name].collect()))


def test_a_study_lands_only_the_columns_of_its_tables(spark, src):
    limit = spark.conf.get(METHOD_LIMIT)
    fresh = Source(spark, "/root/testdata/sf0.001")
    tables = fresh.study.tables
    assert not Path(fresh.folder, "raw").exists()  # no raw file is written that nothing reads
    assert spark.read.parquet(f"{fresh.folder}/narrow").columns == TRIP_COLUMNS
    assert spark.conf.get(METHOD_LIMIT) == limit
    for name, whole in all_tables(src.trips).items():
        assert sorted(map(str, neat(tables[name]).collect())) == sorted(map(str, neat(whole).collect()))
    other = Source(spark, "/root/testdata/sf0.001")
    assert other.raw.count() and other.study.quality.count()
    assert not Path(other.folder, "narrow").exists()  # raw files that are there already are scanned


def test_monthly_files_are_dealt_before_trips_are_computed(spark, src):
    fresh = Source(spark, "/root/testdata/sf0.001")
    months = read_raw(spark, [raw_path(fresh.monthly, ym) for ym in raw_months(spark, fresh.monthly)])
    assert not Path(fresh.folder, "raw").exists()  # nothing is landed that is not read
    assert months.exceptAll(src.raw).isEmpty() and src.raw.exceptAll(months).isEmpty()
    plan = fresh.raw_by_month._jdf.queryExecution().optimizedPlan().toString()
    dealt = plan[plan.index("RebalancePartitions") :]
    assert "l_shipdate" in dealt and "base_passenger_fare" not in dealt
    assert not fresh.refreshed.startswith(f"{fresh.folder}/built")
    assert not Path(fresh.folder, "built").exists()  # a refresh builds its own archive only
