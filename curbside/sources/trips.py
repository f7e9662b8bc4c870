"""From raw monthly files to enriched airport trips, and to stored slices."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curbside import schema as S
from curbside.functions import trip as X
from curbside.functions.calendar import elapsed_seconds, month_add, naive
from curbside.scope import DEFAULT_SCOPE, Scope, YearMonth
from curbside.sources.files import archived_months
from curbside.sources.footers import footers, time_span
from curbside.sources.layouts import by_layout, read_groups

EPOCH = datetime(1970, 1, 1)
ZSTD_LEVEL = 9
# A row group of about a quarter million 25-column rows.
ROW_GROUP_BYTES = 32 * 1024 * 1024


def read_raw(
    spark: SparkSession, paths: str | Sequence[str], **more: Column
) -> DataFrame:
    """Raw trips of any number of months, under one explicit schema; ``more`` are columns
    over the files' metadata.

    One scan for all files that the schema can read, and one for each other layout.

    Raises:
        ValueError: a path holds no readable trip files, or one that cannot be read.
    """
    groups, broken = by_layout(spark, [paths] if isinstance(paths, str) else list(paths))
    for path, reason in broken.items():
        raise ValueError(f"{path}: {reason}")
    return read_groups(spark, groups, **more)


def normalise_raw(df: DataFrame) -> DataFrame:
    """Select the raw columns from any frame, typed; absent ones become nulls."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in S.RAW_SCHEMA
        ]
    )


def derive_trips(raw: DataFrame, scope: Scope = DEFAULT_SCOPE) -> DataFrame:
    """Keep trips that touch an airport and add the 18 derived columns.

    Narrow throughout: a filter and projections, no shuffle.
    """
    return (
        raw.where(X.touches_airport(scope))
        .withColumns(
            {
                "platform": X.platform_of("hvfhs_license_num", scope),
                "pu_airport": X.airport_of("PULocationID", scope),
                "do_airport": X.airport_of("DOLocationID", scope),
                "secs_request_to_scene": elapsed_seconds("request_datetime", "on_scene_datetime"),
                "secs_scene_to_pickup": elapsed_seconds("on_scene_datetime", "pickup_datetime"),
                "secs_engaged": elapsed_seconds("request_datetime", "dropoff_datetime"),
                "has_on_scene": F.col("on_scene_datetime").isNotNull(),
                "rider_total_ex_tip": X.rider_total(),
            }
        )
        .withColumns(
            {
                "direction": X.direction_of("pu_airport", "do_airport"),
                "airport": F.coalesce("pu_airport", "do_airport"),
                "driver_gross": X.driver_gross(),
            }
        )
        .withColumns(
            {
                **X.ratio_columns(),
                "pool_requested": X.flag("shared_request_flag"),
                "pool_matched": X.flag("shared_match_flag"),
            }
        )
        .withColumns(
            {
                "likely_incentive": F.col("driver_share")
                > F.lit(float(scope.incentive_share_threshold)),
                "is_valid": X.is_valid(scope),
            }
        )
    )


def scan_airport_trips(
    spark: SparkSession, paths: str | Sequence[str], scope: Scope = DEFAULT_SCOPE
) -> DataFrame:
    """Airport trips of raw monthly files, enriched. Lazy."""
    return derive_trips(read_raw(spark, paths), scope)


def slim_for_storage(trips: DataFrame) -> DataFrame:
    """Drop what can be recomputed and narrow what is left."""
    have = set(trips.columns)
    narrow = {
        **dict.fromkeys(S.SMALLINT_COLUMNS, "smallint"),
        **dict.fromkeys(S.INT_COLUMNS, "int"),
        **dict.fromkeys(S.FLOAT_COLUMNS, "float"),
    }
    return trips.drop(*S.DROP_ON_WRITE).withColumns(
        {c: F.col(c).cast(t) for c, t in narrow.items() if c in have}
    )


def add_ratios(trips: DataFrame) -> DataFrame:
    """Inverse of the drop above for the five money columns; a frame that still
    has them is returned unchanged."""
    if "driver_share" in trips.columns:
        return trips
    return trips.withColumns(
        {"driver_gross": X.driver_gross(), "rider_total_ex_tip": X.rider_total()}
    ).withColumns(X.ratio_columns())


def write_slim(trips: DataFrame, archive: str, dealt: bool = False) -> str:
    """Write slices to ``archive/year=/month=``, replacing only those months.

    ``trips`` carries integer ``year`` and ``month``: the month of the source file.
    The rebalance hint groups rows by month but lets adaptive execution split a
    large month over many tasks and pack small months together, so neither one huge
    month nor many tiny files results. Rows that are ``dealt`` by month already are
    not shuffled. Rows are sorted by airport and time inside
    each file, which compresses better and gives tight row-group statistics. The
    commit protocol publishes whole partitions, so an interrupted run leaves none
    half written.
    """
    slim = slim_for_storage(trips)
    (
        (slim if dealt else slim.hint("rebalance", "year", "month"))
        .sortWithinPartitions("year", "month", "airport", "pickup_datetime")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .option("parquet.compression.codec.zstd.level", ZSTD_LEVEL)
        .option("parquet.block.size", ROW_GROUP_BYTES)
        .partitionBy("year", "month")
        .parquet(archive)
    )
    return archive


def read_slices(
    spark: SparkSession, archive: str, only: Sequence[YearMonth] | None = None
) -> DataFrame:
    """The archive with ratios recomputed and the slice of each trip; ``only`` prunes partitions."""
    # "month" as a partition number would collide with the month-start column of
    # the aggregates, so the partition columns are prefixed on read.
    df = add_ratios(
        spark.read.schema(S.ARCHIVE_SCHEMA)
        .parquet(archive)
        .withColumnsRenamed({"year": "slice_year", "month": "slice_month"})
    )
    if only is None:
        return df
    return df.where((F.col("slice_year") * 100 + F.col("slice_month")).isin([y * 100 + m for y, m in only]))


def load_all(
    spark: SparkSession,
    archive: str,
    start: YearMonth | None = None,
    end: YearMonth | None = None,
) -> DataFrame:
    """The archive with ratios recomputed; a month range prunes partitions."""
    df = read_slices(spark, archive)
    index = F.col("slice_year") * 12 + F.col("slice_month")
    if start is not None:
        df = df.where(index >= start[0] * 12 + start[1])
    if end is not None:
        df = df.where(index <= end[0] * 12 + end[1])
    return df.drop("slice_year", "slice_month")


def load_recent(spark: SparkSession, archive: str, window: int) -> DataFrame:
    """Trips of the last ``window`` months, ending at the newest month with a pickup.

    Footers tell the newest pickup and which slices reach into the window, stray pickups
    included, so only those partitions are scanned; within them the pickup time is compared, which
    is pushed into the scan. A window of zero or less keeps nothing.
    """
    place = r"year=(\d+)/month=(\d+)/[^/]*$"
    highest = F.col("highest")["pickup_datetime"]
    # One row for each slice. A file that does not tell its range may hold anything.
    slices = (
        footers(spark, [archive])
        .select(
            *[F.regexp_extract("file", place, i).cast("int").alias(c) for i, c in ((1, "year"), (2, "month"))],
            highest.alias("highest"),
            (highest.isNull() & (F.col("rows") > 0)).alias("silent"),
        )
        .groupBy("year", "month")
        .agg(F.max("highest").alias("highest"), F.max("silent").alias("silent"))
        .collect()
    )
    if any(s.silent for s in slices):
        newest = time_span(spark, [archive], "pickup_datetime").first()["last"]
    else:
        known = [s.highest for s in slices if s.highest is not None]
        newest = EPOCH + timedelta(microseconds=max(known)) if known else None
    if newest is None or window <= 0:
        return load_all(spark, archive).limit(0)
    start = datetime(*month_add((newest.year, newest.month), 1 - window), 1)
    reaching = [
        (s.year, s.month)
        for s in slices
        if s.silent or (s.highest is not None and EPOCH + timedelta(microseconds=s.highest) >= start)
    ]
    return (
        read_slices(spark, archive, reaching)
        .where(F.col("pickup_datetime") >= naive(start))
        .drop("slice_year", "slice_month")
    )


def read_month(spark: SparkSession, archive: str, year: int, month: int) -> DataFrame:
    """One month at trip level, by partition pruning.

    Raises:
        FileNotFoundError: that month has not been built.
    """
    if (year, month) not in archived_months(spark, archive):
        raise FileNotFoundError(f"{archive}: month {year}-{month:02d} not found, build it first")
    return (
        read_slices(spark, archive)
        .where((F.col("slice_year") == year) & (F.col("slice_month") == month))
        .drop("slice_year", "slice_month")
    )
