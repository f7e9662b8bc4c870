from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from curbside.functions.text import format_difference, format_metric
from curbside.plans import scorecard
from curbside.scope import METRICS

COLUMNS = [m.name for m in METRICS if m.name != "trips"]


def kpis(spark, *rows):
    """(month index, airport, platform, trips, value of every other measurement)"""
    data = [
        (datetime(2024, 1 + m, 1), a, p, "pickup", t, *[v] * len(COLUMNS)) for m, a, p, t, v in rows
    ]
    schema = "month timestamp_ntz, airport string, platform string, direction string, trips long, "
    return spark.createDataFrame(data, schema + ", ".join(f"{c} double" for c in COLUMNS))


def by_metric(df):
    return {(r.airport, r.metric): r for r in df.collect()}


def test_no_platform_is_an_error(spark):
    with pytest.raises(ValueError, match="no platform"):
        scorecard.compare_platforms(kpis(spark, (0, "JFK", "A", 1, 1.0)), [], ["JFK"])


def test_trips_are_summed_and_the_rest_are_medians(spark):
    table = kpis(spark, (0, "JFK", "A", 5, 1.0), (1, "JFK", "A", 7, 2.0), (2, "JFK", "A", 1, 9.0))
    out = by_metric(scorecard.compare_platforms(table, ["A"], ["JFK"], None))
    assert out["JFK", "trips"].A == 13.0
    assert out["JFK", "med_fare"].A == 2.0
    assert "difference" not in out["JFK", "trips"].asDict()
    recent = by_metric(scorecard.compare_platforms(table, ["A"], ["JFK"], 1))
    assert recent["JFK", "trips"].A == 1.0


def test_two_platforms_and_an_absent_one(spark):
    table = kpis(spark, (0, "JFK", "A", 5, 1.0), (0, "JFK", "B", 7, 3.0), (0, "LGA", "A", 5, 1.0))
    out = by_metric(scorecard.compare_platforms(table, ["A", "B"], ["JFK", "LGA"]))
    assert out["JFK", "med_fare"].difference == 2.0
    assert out["LGA", "med_fare"].B is None and out["LGA", "med_fare"].difference is None
    three = scorecard.compare_platforms(table, ["A", "B", "C"], ["JFK"])
    assert "C" in three.columns and "difference" not in three.columns
    assert three.where(F.col("C").isNotNull()).count() == 0


def test_rows_follow_metric_order(spark):
    table = kpis(spark, (0, "JFK", "A", 5, 1.0))
    rows = scorecard.compare_platforms(table, ["A"], ["JFK"]).collect()
    assert [r.metric for r in rows] == [m.name for m in METRICS]


def test_target_ties_and_sides(spark):
    table = kpis(spark, (0, "JFK", "A", 5, 2.0), (0, "JFK", "B", 5, 2.0))
    names = ["A", "B"]
    board = by_metric(scorecard.benchmark(scorecard.compare_platforms(table, names, ["JFK"]), names))
    assert board["JFK", "mean_tip"].target_platform == "B"  # last of equals
    assert board["JFK", "med_fare"].target is None
    assert board["JFK", "med_fare"].target_platform is None
    matrix = scorecard.compare_platforms(table, names, ["JFK"], None)
    won = by_metric(scorecard.lifetime_winners(matrix, names))
    assert won["JFK", "mean_tip"].winner == "A"  # first of equals
    assert won["JFK", "med_fare"].winner == ""
    led = by_metric(scorecard.head_to_head(matrix, names))
    assert led["JFK", "mean_tip"].leader == "A" and led["JFK", "med_fare"].leader == ""


def test_low_side_and_missing_values(spark):
    table = kpis(spark, (0, "JFK", "A", 5, 30.0), (0, "JFK", "B", 9, 20.0), (0, "LGA", "A", 1, 1.0))
    names = ["A", "B"]
    matrix = scorecard.compare_platforms(table, names, ["JFK", "LGA"])
    led = by_metric(scorecard.head_to_head(matrix, names))
    assert led["JFK", "med_curb_wait_s"].leader == "B"
    assert led["LGA", "med_curb_wait_s"].leader is None
    gaps = by_metric(scorecard.target_gaps(scorecard.benchmark(matrix, names), "B"))
    assert gaps["JFK", "med_curb_wait_s"].mark == "lead"
    assert gaps["JFK", "mean_tip"].gap == 10.0
    assert gaps["JFK", "mean_tip"].mark == "worst"
    assert gaps["LGA", "mean_tip"].gap is None and gaps["LGA", "mean_tip"].mark is None


def test_single_value_lookup(spark):
    table = kpis(spark, (0, "JFK", "A", 5, 30.0))
    board = scorecard.benchmark(scorecard.compare_platforms(table, ["A"], ["JFK"]), ["A"])
    value = lambda a, m: scorecard.metric_value(board, "A", a, m).first()[0]
    assert value("JFK", "med_fare") == "$30.00"
    assert value("LGA", "med_fare") == "not reported"


def test_unmapped_metric_is_an_error(spark):
    long = spark.createDataFrame([("nonsense", 1.0)], "metric string, value double")
    with pytest.raises(Exception, match="unmapped metric"):
        scorecard.describe_metrics(long).collect()


VALUES = [
    (1234.5, "count", "1,234", "+1,234"), (1234567.891, "money", "$1,234,567.89", "+$1,234,567.89"),
    (0.125, "percent", "12.5%", "+12.5 pp"), (12.3456, "percent", "1234.6%", "+1234.6 pp"),
    (90.0, "minutes", "1.5", "+1.5"), (2.25, "number", "2.2", "+2.2"),
    (-3.0, "money", "$-3.00", "-$3.00"), (0.0, "number", "0.0", "-0.0"),
    (None, "money", "not reported", "not comparable"),
]


@pytest.mark.parametrize(("value", "kind", "metric", "difference"), VALUES)
def test_formats(spark, value, kind, metric, difference):
    df = spark.createDataFrame([(value, kind)], "v double, k string")
    assert tuple(df.select(format_metric("v", "k"), format_difference("v", "k")).first()) == (
        metric, difference,
    )
