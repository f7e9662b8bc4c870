"""Keep the six aggregate tables up to date with an archive, reading only what has changed.

Beside the tables lies their state: a manifest of the slices that they were made from, the count
cube and the cell panel by month of pickup, and for the hourly profile its brackets and the counts
of each month (``operators.median_state``). A refresh compares the manifest with the footers of
the archive, recomputes the state of the months that changed slices reach into, and rolls the
state up into the tables, which are of aggregate size.

A month's rows may come from several slices, as pickups stray; footers tell which slices reach
into it. The manifest is written last, so an interrupted refresh is simply done again.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curbside.functions.calendar import months
from curbside.functions.numeric import safe_ratio
from curbside.operators import median_state
from curbside.operators.shape import with_share
from curbside.plans import aggregates as A
from curbside.scope import YearMonth
from curbside.sources.files import delete, exists
from curbside.sources.footers import footers
from curbside.sources.tables import write_tables
from curbside.sources.trips import EPOCH, read_slices

HOURLY = ["airport", "platform", "hour"]
HOURLY_FLAGS = ("incentives", "incentives_known", "on_scene")


@dataclass
class Refreshed:
    """What a refresh did."""

    changed: list[YearMonth] = field(default_factory=list)  # slices added, rewritten or removed
    read: list[YearMonth] = field(default_factory=list)  # slices read for them
    months: list[YearMonth] = field(default_factory=list)  # months of pickup computed anew
    rebracketed: bool = False  # hourly brackets were made anew from all slices


@dataclass(frozen=True)
class Slice:
    digest: int
    lowest: datetime
    highest: datetime

    @property
    def months(self) -> list[YearMonth]:
        """Months of pickup that its trips can lie in."""
        return months((self.lowest.year, self.lowest.month), (self.highest.year, self.highest.month))


def slices(spark: SparkSession, archive: str) -> dict[YearMonth, Slice]:
    """Slices with trips, from footers; one row each reaches the driver.

    Raises:
        ValueError: a slice file cannot be read or does not tell its range.
    """
    place = r"year=(\d+)/month=(\d+)/[^/]*$"
    column = "pickup_datetime"
    files = footers(spark, [archive]).where("error is not null or rows > 0")
    rows = (
        files.select(
            *[F.regexp_extract("file", place, i).cast("int").alias(c) for i, c in ((1, "year"), (2, "month"))],
            F.struct("file", "rows").alias("file"),
            F.col("lowest")[column].alias("lowest"),
            F.col("highest")[column].alias("highest"),
        )
        .groupBy("year", "month")
        .agg(
            F.xxhash64(F.sort_array(F.collect_list("file"))).alias("digest"),
            F.min("lowest").alias("lowest"),
            F.max("highest").alias("highest"),
            F.max(F.col("highest").isNull()).alias("silent"),
        )
        .collect()
    )
    if any(r.silent for r in rows):
        raise ValueError(f"{archive}: a slice file has no readable range of {column}")
    at = lambda micros: EPOCH + timedelta(microseconds=micros)
    return {(r.year, r.month): Slice(r.digest, at(r.lowest), at(r.highest)) for r in rows}


def _manifest(spark: SparkSession, path: str) -> dict[YearMonth, Slice]:
    if not exists(spark, f"{path}/_SUCCESS"):
        return {}
    rows = spark.read.parquet(path).collect()
    at = lambda micros: EPOCH + timedelta(microseconds=micros)
    return {(r.year, r.month): Slice(r.digest, at(r.lowest), at(r.highest)) for r in rows}


def _write_manifest(spark: SparkSession, path: str, now: dict[YearMonth, Slice]) -> None:
    micros = lambda t: (t - EPOCH) // timedelta(microseconds=1)
    rows = [(*ym, s.digest, micros(s.lowest), micros(s.highest)) for ym, s in sorted(now.items())]
    schema = "year int, month int, digest long, lowest long, highest long"
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(path)


def refresh_aggregates(spark: SparkSession, archive: str, base: str) -> Refreshed:
    """Bring the six tables in ``base`` up to date with the archive; equal to a full export."""
    state = f"{base}/_state"
    now, before = slices(spark, archive), _manifest(spark, f"{state}/manifest")
    report = Refreshed()
    report.changed = sorted(ym for ym in now.keys() | before.keys() if now.get(ym) != before.get(ym))
    if not report.changed:
        return report
    if not before:
        delete(spark, state)
    touched = {m for ym in report.changed for s in (now.get(ym), before.get(ym)) if s for m in s.months}
    report.months = sorted(touched)
    report.read = sorted(ym for ym, s in now.items() if touched.intersection(s.months))
    trips = _of_months(read_slices(spark, archive, report.read), report.months)
    _replace_months(spark, A.count_cube(trips), f"{state}/cube", report.months)
    _replace_months(spark, A.cell_panel(trips, None), f"{state}/panel", report.months)
    hourly = None
    if before:
        _replace_months(spark, _hour_counts(trips, _kept(spark, state)), f"{state}/hours", report.months)
        hourly = _hourly(spark, state)
    if hourly is None:
        report.rebracketed = True
        everything = read_slices(spark, archive, sorted(now))
        median_state.brackets(_pickups(everything), HOURLY, _measures()).write.mode("overwrite").parquet(
            f"{state}/brackets"
        )
        delete(spark, f"{state}/hours")
        _replace_months(spark, _hour_counts(everything, _kept(spark, state)), f"{state}/hours", [])
        hourly = _hourly(spark, state)
    cube, panel = _read(spark, f"{state}/cube"), _read(spark, f"{state}/panel")
    write_tables(
        {
            "monthly_kpis": panel.select(*A.KPI_COLUMNS),
            "market_share": A.share_from_cube(cube),
            "hourly_profile": hourly,
            "incentive_breakdown": A.incentive_from_panel(panel),
            "coverage_timeline": A.coverage_from_cube(cube),
            "data_quality": A.quality_from_cube(cube),
        },
        base,
    )
    _write_manifest(spark, f"{state}/manifest", now)
    return report


def _label() -> Column:
    return F.year("month") * 100 + F.month("month")


def _of_months(trips: DataFrame, kept: list[YearMonth]) -> DataFrame:
    """Trips picked up in some months."""
    label = F.year("pickup_datetime") * 100 + F.month("pickup_datetime")
    return trips.where(label.isin([y * 100 + m for y, m in kept]))


def _replace_months(spark: SparkSession, part: DataFrame, path: str, replaced: list[YearMonth]) -> None:
    """Write a part of the state by month of pickup, in place of what some months had."""
    for y, m in replaced:
        delete(spark, f"{path}/m={y * 100 + m}")
    (
        part.withColumn("m", _label())
        .hint("rebalance", "m")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("m")
        .parquet(path)
    )


def _read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("m")


def _pickups(trips: DataFrame) -> DataFrame:
    """Rows of the hourly profile."""
    valid = trips.where(F.col("is_valid") & (F.col("direction") == "pickup"))
    return A.with_month(valid).withColumn("hour", F.hour("pickup_datetime"))


def _measures() -> dict[str, Column]:
    return {alias: F.col(c) for alias, c in A.HOURLY_MEDIANS.items()}


def _kept(spark: SparkSession, state: str) -> DataFrame:
    return spark.read.parquet(f"{state}/brackets")


def _hour_counts(trips: DataFrame, kept: DataFrame) -> DataFrame:
    flags = {
        "incentives": F.col("likely_incentive"),
        "incentives_known": F.col("likely_incentive").isNotNull(),
        "on_scene": F.col("has_on_scene"),
    }
    return median_state.part_counts(_pickups(trips), HOURLY, _measures(), kept, flags, ["month"])


def _hourly(spark: SparkSession, state: str) -> DataFrame | None:
    """The hourly profile from the counts of all months; None where a bracket no longer holds."""
    counts = spark.read.parquet(f"{state}/hours").drop("m", "month")
    names = list(A.HOURLY_MEDIANS)
    hours, holds = median_state.merged(counts, HOURLY, names, _kept(spark, state), list(HOURLY_FLAGS))
    if not holds:
        return None
    rated = hours.withColumns(
        {
            "incentive_rate": safe_ratio("incentives", "incentives_known"),
            "curb_wait_coverage": safe_ratio("on_scene", "trips"),
        }
    )
    return with_share(rated, "trips", ["airport", "platform"], "share_of_day").select(*A.HOURLY_COLUMNS)
