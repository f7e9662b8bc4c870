from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from curbside.plans import economics, market, quality, scoping
from curbside.scope import Scope


def month(i):
    return datetime(2020 + (i // 12), i % 12 + 1, 1)


def share_table(spark, trips, airport="JFK", platform="Uber"):
    rows = [(month(i), airport, platform, n, 1.0) for i, n in enumerate(trips)]
    return spark.createDataFrame(
        rows, "month timestamp_ntz, airport string, platform string, trips long, share double"
    )


def flags(spark, trips):
    rows = market.monthly_volume(share_table(spark, trips)).collect()
    return [r.thin for r in rows], [r.censored for r in rows]


def test_a_thin_month_inside_the_series_is_not_censored(spark):
    thin, censored = flags(spark, [100, 10, 100, 100, 30, 20])
    assert thin == [False, True, False, False, True, True]
    assert censored == [False, False, False, False, True, True]


def test_no_thin_month(spark):
    assert flags(spark, [100, 90, 80])[1] == [False] * 3


def test_everything_thin_is_all_censored(spark):
    scope = Scope(censoring_fraction=10.0)
    rows = market.monthly_volume(share_table(spark, [5, 6, 7]), scope).collect()
    assert [r.censored for r in rows] == [True] * 3
    summary = market.volume_summary(market.monthly_volume(share_table(spark, [5, 6, 7]), scope))
    assert summary.first().reliable_end is None


def test_trough_takes_the_earliest_of_equals(spark):
    row = market.trough(market.monthly_volume(share_table(spark, [9, 3, 7, 3]))).first()
    assert (row.month, row.trips, row.share_of_median) == (month(1), 3, 0.6)


@pytest.mark.parametrize(
    ("trips", "baseline", "recovered", "gap"),
    [
        ([50, 100, 20, 60, 100, 130], 100, month(4), 3),
        ([50, 100, 20, 60], 100, None, None),
        ([50], None, None, None),
    ],
)
def test_recovery(spark, trips, baseline, recovered, gap):
    scope = Scope(recovery_baseline_month=month(1))
    row = market.recovery(share_table(spark, trips), scope).first()
    assert (row.baseline_trips, row.recovery_month, row.gap_months) == (baseline, recovered, gap)


def year_share(spark, *rows):
    return spark.createDataFrame(rows, "year int, airport string, platform string, share double")


def test_leadership_ties_gaps_and_handovers(spark):
    rows = market.leadership(
        year_share(
            spark,
            (2020, "JFK", "Uber", 1.0),
            (2021, "JFK", "Uber", 0.5), (2021, "JFK", "Lyft", 0.5),
            (2022, "JFK", "Uber", 0.6), (2022, "JFK", "Lyft", 0.3), (2022, "JFK", "Via", 0.1),
            (2022, "LGA", "Lyft", 0.9), (2022, "LGA", "Uber", 0.1),
        )
    ).orderBy("airport", "year").collect()
    assert [(r.airport, r.year, r.leader, r.changed_hands) for r in rows] == [
        ("JFK", 2020, "Uber", False), ("JFK", 2021, "Lyft", True), ("JFK", 2022, "Uber", True),
        ("LGA", 2022, "Lyft", False),
    ]
    assert rows[0].runner_up_share is None and rows[0].gap == 1.0
    assert rows[2].gap == pytest.approx(0.3)


def coverage_table(spark, *rows):
    return spark.createDataFrame(
        rows, "month timestamp_ntz, platform string, trips long, on_scene_coverage double"
    )


def test_active_platforms_window_and_fallback(spark):
    cov = coverage_table(
        spark,
        *[(month(i), "Uber", 900, 1.0) for i in range(24)],
        *[(month(i), "Via", 100, 1.0) for i in range(6)],
        (month(23), "Tiny", 1, 1.0),
    )
    assert scoping.names(scoping.active_platforms(cov), "platform") == ["Uber"]
    assert scoping.names(scoping.active_platforms(cov, window=0), "platform") == ["Uber", "Via"]
    assert scoping.names(scoping.active_platforms(cov, min_share=0.0), "platform") == [
        "Uber", "Tiny",
    ]
    census = {r.platform: r for r in scoping.platform_census(cov).collect()}
    assert census["Via"].months_active == 6 and census["Via"].last_month == month(5)
    assert sum(r.lifetime_share for r in census.values()) == pytest.approx(1.0)


def test_window_is_n_months_including_the_last(spark):
    kept = scoping.recent_months(share_table(spark, [1] * 24), 10)
    assert kept.count() == 10
    assert kept.agg(F.min("month")).first()[0] == month(14)
    assert scoping.recent_months(share_table(spark, [1]), 10).count() == 1
    assert scoping.recent_months(share_table(spark, [1] * 24), None).count() == 24


def test_coverage_start_ignores_platforms_that_never_report(spark):
    cov = coverage_table(
        spark,
        (month(0), "Uber", 1, 0.9), (month(0), "Lyft", 1, 0.1), (month(1), "Lyft", 1, 0.5),
        (month(2), "Lyft", 1, 0.51), (month(2), "Via", 1, 0.0),
    )
    starts = {r.platform: r.first_month for r in market.coverage_starts(cov).collect()}
    assert starts == {"Uber": month(0), "Lyft": month(2), "Via": None}
    assert market.comparable_from(cov).first()[0] == month(2)
    none = coverage_table(spark, (month(0), "Via", 1, 0.0))
    assert market.comparable_from(none).first()[0] is None
    assert market.last_to_report(none).count() == 0


def kpi_directions(spark, *rows):
    return spark.createDataFrame(rows, "airport string, direction string, trips long")


def test_dispatch_ratio_edges(spark):
    kpis = kpi_directions(
        spark,
        ("JFK", "pickup", 50), ("JFK", "dropoff", 100), ("JFK", "transfer", 999),
        ("EWR", "dropoff", 100), ("LGA", "pickup", 10), ("X", "pickup", 5), ("X", "dropoff", 100),
    )
    ratio = {r.airport: r.pickups_per_dropoff for r in scoping.direction_ratio(kpis).collect()}
    assert ratio == {"JFK": 0.5, "EWR": 0.0, "LGA": None, "X": 0.05}
    assert scoping.names(scoping.dispatch_airports(kpis), "airport") == ["JFK", "X"]


def test_concentration_bounds(spark):
    table = spark.createDataFrame(
        [(month(0), "JFK", 0.5), (month(0), "JFK", 0.5), (month(1), "JFK", 1.0)],
        "month timestamp_ntz, airport string, share double",
    )
    assert [r.hhi for r in market.concentration(table).collect()] == [5000.0, 10000.0]


def test_describe_keeps_order_and_survives_no_rows(spark):
    df = spark.createDataFrame([(1, 2.0), (3, None)], "b long, a double")
    rows = quality.describe(df, ["a", "b"]).collect()
    assert [(r.column, r.dtype, r.nulls, r.null_pct, r.p50) for r in rows] == [
        ("a", "double", 1, 0.5, 2.0), ("b", "bigint", 0, 0.0, 2.0),
    ]
    empty = quality.describe(df.limit(0), ["a"]).first()
    assert (empty.nulls, empty.null_pct, empty.min, empty.p50) == (0, 0.0, None, None)


def test_trailing_points_stop_at_the_first_month(spark):
    pts = share_table(spark, [1] * 5).drop("share")
    near = economics.trailing_points(pts, month(1), 12)
    assert {r.month for r in near.collect()} == {month(0), month(1)}
    two = economics.trailing_points(pts, month(4), 2)
    weights = {r.month: r.weight for r in two.collect()}
    assert set(weights) == {month(2), month(3), month(4)} and weights[month(4)] == 1.0
