from __future__ import annotations

import random
import statistics

import pytest
from pyspark.sql import functions as F

from curbside.operators import medians
from curbside.operators.medians import grouped


def brute(rows, value):
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r[value])
    out = {}
    for k, vs in groups.items():
        known = sorted(v for v in vs if v is not None)
        out[k] = statistics.median(known) if known else None
    return out


def skewed(n, seed):
    """One key holds most rows; values repeat, spread over magnitudes, or are null."""
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        key = "hot" if rng.random() < 0.7 else rng.choice(["a", "b", "c", None])
        x = rng.choice([rng.uniform(0, 1), 10 ** rng.uniform(-6, 9), 5.0, -3.25, None])
        y = rng.choice([1.0, 1.0 + 2**-52, 2.0])
        rows.append((key, x, y, None))
    return rows


@pytest.mark.parametrize(
    ("limit", "buckets"), [(5, 1024), (200, 8), (700, 1024), (10_000, 1024)]
)
def test_exact_at_any_group_size(spark, monkeypatch, limit, buckets):
    monkeypatch.setattr(medians, "BUCKETS", buckets)
    rows = skewed(6500, seed=limit)
    df = spark.createDataFrame(rows, "k string, x double, y double, z double")
    result = grouped(
        df,
        ["k"],
        [F.count(F.lit(1)).alias("n"), F.sum("y").alias("total")],
        {"mx": F.col("x"), "my": F.col("y"), "mz": F.col("z")},
        group_rows=limit,
    )
    assert set(result.columns) == {"k", "n", "total", "mx", "my", "mz"}
    got = {r.k: r for r in result.collect()}
    for name, i in (("mx", 1), ("my", 2), ("mz", 3)):
        expected = brute(rows, i)
        assert set(got) == set(expected)
        for k, v in expected.items():
            assert got[k][name] == (None if v is None else pytest.approx(v, rel=1e-15)), (k, name)
    assert sum(r.n for r in got.values()) == len(rows)


def no_bracket(monkeypatch):
    monkeypatch.setattr(medians, "_reached", lambda v: F.lit(None).cast("array<double>"))


@pytest.mark.parametrize("partitions", [1, 7])
def test_a_sketch_holds_every_value_up_to_its_size(spark, partitions):
    """One scan is enough for such groups, and exact whatever their size and merges."""
    rng = random.Random(partitions)
    sizes = [1, 2, 3, 4, 5, 99, 500, 1000, medians.SKETCH - 1, medians.SKETCH]
    rows = [(str(n), rng.choice([rng.uniform(-1, 1), 10 ** rng.uniform(-6, 9)]), 0.0, None) for n in sizes for _ in range(n)]  # noqa: E501
    rng.shuffle(rows)
    df, read = counting(spark, rows, "k string, x double, y double, z double")
    got = {r.k: r.m for r in grouped(df.repartition(partitions), ["k"], [], {"m": F.col("x")}).collect()}
    assert got == {k: pytest.approx(v, rel=1e-15) for k, v in brute(rows, 1).items()}
    assert read.value == len(rows)


def counting(spark, rows, schema):
    """A frame and the number of rows read from it so far."""
    read = spark.sparkContext.accumulator(0)

    def seen(row):
        read.add(1)
        return row

    return spark.createDataFrame(spark.sparkContext.parallelize(rows, 4).map(seen), schema), read


@pytest.mark.parametrize("limit", [5, 10_000])
def test_rows_of_large_groups_are_scanned_twice(spark, limit):
    rows = skewed(9000, seed=7)
    df, read = counting(spark, rows, "k string, x double, y double, z double")
    measures = {"mx": F.col("x"), "my": F.col("y"), "mz": F.col("z")}
    got = {r.k: r.mx for r in grouped(df, ["k"], [], measures, group_rows=limit).collect()}
    assert got == {k: pytest.approx(v, rel=1e-15) for k, v in brute(rows, 1).items()}
    assert read.value == 2 * len(rows)


def test_keyless_rows_are_scanned_twice(spark):
    rows = [(float(i % 977),) for i in range(2 * medians.SKETCH)]
    df, read = counting(spark, rows, "x double")
    assert grouped(df, [], [], {"m": F.col("x")}).first().m == statistics.median(r[0] for r in rows)
    assert read.value == 2 * len(rows)


@pytest.mark.parametrize("bracket", [(1e12, 2e12), (-5.0, -4.0), (None, None)])
def test_a_wrong_sketch_changes_nothing(spark, monkeypatch, bracket):
    wrong = F.array(*[F.lit(x).cast("double") for x in (bracket[0], None, None, bracket[1])])
    monkeypatch.setattr(medians, "_reached", lambda v: wrong)
    rows = skewed(1200, seed=11)
    df = spark.createDataFrame(rows, "k string, x double, y double, z double")
    for limit in (7, 5000):
        measures = {"mx": F.col("x"), "mz": F.col("z")}
        got = {r.k: r.mx for r in grouped(df, ["k"], [], measures, group_rows=limit).collect()}
        assert got == {k: pytest.approx(v, rel=1e-15) for k, v in brute(rows, 1).items()}


def test_whole_frame(spark):
    values = [float(v) for v in range(1001)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for limit in (10, 10_000):
        row = grouped(df, [], [F.count(F.lit(1)).alias("n")], {"m": F.col("x")}, group_rows=limit)
        assert tuple(row.select("n", "m").first()) == (1001, 500.0)


def test_all_values_equal(spark):
    df = spark.range(500).select(F.lit("k").alias("k"), F.lit(7.5).alias("x"))
    assert grouped(df, ["k"], [], {"m": F.col("x")}, group_rows=10).first().m == 7.5


def test_empty_frame(spark):
    df = spark.createDataFrame([], "k string, x double")
    assert grouped(df, ["k"], [], {"m": F.col("x")}).count() == 0
    assert grouped(df, [], [F.count(F.lit(1)).alias("n")], {"m": F.col("x")}).first().m is None


@pytest.mark.parametrize(
    "odd",
    [
        [float("inf")],
        [float("-inf"), float("inf")],
        [float("nan")],
        [float("nan"), float("inf"), float("-inf")],
        [-1.7e308, 1.7e308],
        [5e-324, 1e-323, -5e-324],
        [float("inf")] * 40,
    ],
)
def test_any_double_ends_and_equals_the_small_path(spark, odd):
    values = [float(i) for i in range(50)] + odd
    df = spark.createDataFrame([("k", v) for v in values], "key string, x double")
    medians_of = {"m": F.col("x")}
    found = [
        grouped(df, ["key"], [F.count("*").alias("n")], medians_of, group_rows=limit).first().m
        for limit in (1000, 10)
    ]
    assert str(found[0]) == str(found[1])


@pytest.mark.parametrize("tail", [[], [1e300, -1e300], [1e-300, 5e-324], [float("inf"), 0.0]])
def test_outliers_add_no_rounds(spark, monkeypatch, tail):
    """Also where the sketch gives no bracket at all."""
    no_bracket(monkeypatch)
    rounds = []
    narrow = medians._narrow
    monkeypatch.setattr(medians, "_narrow", lambda *a: rounds.append(1) or narrow(*a))
    rng = random.Random(3)
    values = [rng.uniform(1, 1.001) for _ in range(3000)] + tail
    df = spark.createDataFrame([("k", v) for v in values], "key string, x double")
    found = grouped(df, ["key"], [], {"m": F.col("x")}, group_rows=10).first().m
    assert found == pytest.approx(statistics.median(values), rel=1e-15)
    assert len(rounds) <= 2


def test_close_doubles_end_within_six_rounds(spark, monkeypatch):
    no_bracket(monkeypatch)
    rounds = []
    narrow = medians._narrow
    monkeypatch.setattr(medians, "_narrow", lambda *a: rounds.append(1) or narrow(*a))
    close = [1.0, 1.0 + 2**-52, 1.0 + 2**-51] * 20
    values = [-1e308, 1e308, 1.5, 1.0 + 2**-20, 1.0 + 2**-40] + close
    df = spark.createDataFrame([("k", v) for v in values], "key string, x double")
    found = grouped(df, ["key"], [], {"m": F.col("x")}, group_rows=5).first().m
    assert found == statistics.median(values)
    assert len(rounds) <= 6
