"""Incremental archive build: plan the missing months, build them in one job.

A month is one raw file; the archive is partitioned by the month of that file, so
the set of partition folders is the record of what is done and a rerun resumes.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curbside.functions.calendar import months
from curbside.scope import DEFAULT_SCOPE, Scope, YearMonth
from curbside.sources.files import (
    RAW_LABEL,
    archived_months,
    drop_slice,
    exists,
    raw_months,
    raw_path,
    slice_files,
    slice_path,
)
from curbside.sources.footers import rows_by_path
from curbside.sources.layouts import Groups, by_layout, examined, read_groups
from curbside.sources.trips import derive_trips, normalise_raw, write_slim

log = logging.getLogger(__name__)


@dataclass
class BuildReport:
    """Outcome of a build run, one entry per planned month."""

    present: list[YearMonth] = field(default_factory=list)
    built: list[YearMonth] = field(default_factory=list)
    empty: list[YearMonth] = field(default_factory=list)  # built, but no airport trip
    missing: list[YearMonth] = field(default_factory=list)
    failed: dict[YearMonth, str] = field(default_factory=dict)
    # Rows of the raw files of each month, and of its slice, from footers: no scan counts them.
    read: dict[YearMonth, int] = field(default_factory=dict)
    kept: dict[YearMonth, int] = field(default_factory=dict)

    @property
    def available(self) -> list[YearMonth]:
        """Slices that exist after the run."""
        return sorted([*self.present, *self.built])


def latest_available_month(spark: SparkSession, raw_dir: str) -> YearMonth | None:
    """Newest month that has landed."""
    landed = raw_months(spark, raw_dir)
    return landed[-1] if landed else None


def months_to_build(planned: DataFrame, present: DataFrame) -> DataFrame:
    """The to-do list as a relation: planned months without a slice."""
    return planned.join(present.select("month").distinct(), "month", "left_anti")


def _replace(
    spark: SparkSession, groups: Groups, archive: str, todo: list[YearMonth], scope: Scope
) -> None:
    """Write the slices of these months from their raw files, in one job.

    A dynamic overwrite keeps the partition of a month that gets no row, so such a month's
    old slice is dropped after the write.
    """
    before = {ym: slice_files(spark, archive, ym) for ym in todo}
    label = F.regexp_extract(F.col("_metadata.file_path"), RAW_LABEL, 1)
    raw = read_groups(
        spark,
        groups,
        year=F.substring(label, 1, 4).cast("int"),
        month=F.substring(label, 6, 2).cast("int"),
    )
    write_slim(derive_trips(raw, scope), archive)
    for ym, files in before.items():
        if files and slice_files(spark, archive, ym) == files:
            drop_slice(spark, archive, ym)


def build_month(
    spark: SparkSession,
    raw_dir: str,
    archive: str,
    year: int,
    month: int,
    overwrite: bool = False,
    scope: Scope = DEFAULT_SCOPE,
) -> str:
    """Build one month unless it is present; returns its partition path.

    Raises:
        FileNotFoundError: the raw month has not landed.
        ValueError: it holds no readable trip files.
    """
    ym = (year, month)
    if overwrite or ym not in archived_months(spark, archive):
        path = raw_path(raw_dir, ym)
        if not exists(spark, path):
            raise FileNotFoundError(f"{path} not found")
        groups, broken = by_layout(spark, [path])
        if broken:
            raise ValueError(f"{path}: {broken[path]}")
        _replace(spark, groups, archive, [ym], scope)
    return slice_path(archive, ym)


def build_archive(
    spark: SparkSession,
    raw_dir: str,
    archive: str,
    start: YearMonth | None = None,
    end: YearMonth | None = None,
    overwrite: bool = False,
    scope: Scope = DEFAULT_SCOPE,
) -> BuildReport:
    """Build every month between two bounds that is not in the archive.

    Months whose files cannot be read as trips are reported and skipped; all other
    pending months run as one distributed job. Any other error is raised.
    """
    end = end or latest_available_month(spark, raw_dir)
    plan = months(start or scope.archive_start, end) if end else []
    report = BuildReport()
    done = set() if overwrite else set(archived_months(spark, archive))
    landed = set(raw_months(spark, raw_dir))
    report.present = [ym for ym in plan if ym in done]
    report.missing = [ym for ym in plan if ym not in done and ym not in landed]
    for ym in report.missing:
        log.warning("skip %d-%02d: no raw file", *ym)
    todo = [ym for ym in plan if ym not in done and ym in landed]
    build_months(spark, raw_dir, archive, todo, scope, report)
    return report


def build_months(
    spark: SparkSession,
    raw_dir: str,
    archive: str,
    todo: list[YearMonth],
    scope: Scope,
    report: BuildReport,
) -> None:
    """Build exactly these months, setting unreadable ones apart.

    A month without airport trips leaves no slice (and is tried again next time).
    """
    paths = {ym: raw_path(raw_dir, ym) for ym in todo}
    groups, broken, rows = examined(spark, list(paths.values()))
    report.read.update({ym: rows[path] for ym, path in paths.items() if path in rows})
    for ym, path in paths.items():
        if path in broken:
            log.warning("failed %d-%02d: %s", *ym, broken[path])
            report.failed[ym] = broken[path]
    good = [ym for ym in todo if ym not in report.failed]
    if not good:
        return
    _replace(spark, groups, archive, good, scope)
    written = set(archived_months(spark, archive))
    report.built.extend(sorted(ym for ym in good if ym in written))
    report.empty.extend(sorted(ym for ym in good if ym not in written))
    slices = {slice_path(archive, ym): ym for ym in good if ym in written}
    kept = rows_by_path(spark, list(slices)).collect()
    report.kept.update(dict.fromkeys(report.empty, 0) | {slices[r.path]: r.rows for r in kept})


def stamp_by_pickup(raw: DataFrame) -> DataFrame:
    """Slice month from the pickup time, for raw rows that are not monthly files."""
    return normalise_raw(raw).withColumns(
        {"year": F.year("pickup_datetime"), "month": F.month("pickup_datetime")}
    )
