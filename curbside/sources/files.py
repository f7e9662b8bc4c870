"""Existence checks through Hadoop's FileSystem, so any Spark storage works."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

from curbside.scope import YearMonth

# Fixed value: the month label in the path of a raw file.
RAW_LABEL = r"fhvhv_tripdata_(\d{4}-\d{2})\.parquet"


def _glob(spark: SparkSession, pattern: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [str(s.getPath().toString()) for s in fs.globStatus(path) or []]


def exists(spark: SparkSession, path: str) -> bool:
    return bool(_glob(spark, path))


def raw_path(raw_dir: str, ym: YearMonth) -> str:
    """One raw month: a parquet file, or a folder of part files of that name."""
    return f"{raw_dir}/fhvhv_tripdata_{ym[0]:04d}-{ym[1]:02d}.parquet"


def raw_months(spark: SparkSession, raw_dir: str) -> list[YearMonth]:
    """Months that have landed in the raw folder."""
    found = _glob(spark, f"{raw_dir}/fhvhv_tripdata_*.parquet")
    labels = (re.search(r"_(\d{4})-(\d{2})\.parquet$", f) for f in found)
    return sorted((int(m[1]), int(m[2])) for m in labels if m)


def publish_months(spark: SparkSession, staging: str, label: str, raw_dir: str) -> None:
    """Give the partitions of a written table the paths of raw months."""
    for source in _glob(spark, f"{staging}/{label}=*"):
        month = re.search(r"=(\d{4})-(\d{2})$", source)
        if month:
            path = spark._jvm.org.apache.hadoop.fs.Path
            target = raw_path(raw_dir, (int(month[1]), int(month[2])))
            fs = path(source).getFileSystem(spark._jsc.hadoopConfiguration())
            if not fs.rename(path(source), path(target)):
                raise OSError(f"cannot publish {target}")


def slice_path(archive: str, ym: YearMonth) -> str:
    """The folder of one month of the archive."""
    return f"{archive}/year={ym[0]}/month={ym[1]}"


def slice_files(spark: SparkSession, archive: str, ym: YearMonth) -> set[str]:
    """Files of one month of the archive; none if it has no slice."""
    return set(_glob(spark, f"{slice_path(archive, ym)}/*.parquet"))


def drop_slice(spark: SparkSession, archive: str, ym: YearMonth) -> None:
    delete(spark, slice_path(archive, ym))


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder, if it is there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def archived_months(spark: SparkSession, archive: str) -> list[YearMonth]:
    """Months present in the archive, from its partition folders."""
    found = _glob(spark, f"{archive}/year=*/month=*")
    labels = (re.search(r"year=(\d+)/month=(\d+)$", f) for f in found)
    return sorted((int(m[1]), int(m[2])) for m in labels if m)
