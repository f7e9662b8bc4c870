"""Land a computed trip relation as raw files, once per session and source.

Analyses start from files, as they would on real monthly deliveries. The folder is
the shared one the session names (``spark.checkpoint.dir``), keyed by application,
so it outlives executors and is never shared between runs.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from curbside.operators.bounded import shared_folder
from curbside.sources.files import publish_months

ROW_GROUP_BYTES = 8 * 1024 * 1024
METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"
#: Bytes of the largest method that the JVM compiles; it interprets a larger one row by row.
METHOD_BYTES = 8000


def session_folder(spark: SparkSession, source: str) -> str:
    """A new folder for each landing, so that none writes over files still being read."""
    key = hashlib.sha1(source.encode()).hexdigest()[:12]
    app = spark.sparkContext.applicationId
    return f"{shared_folder(spark)}/curbside/{app}/{key}-{uuid.uuid4().hex[:8]}"


@contextmanager
def compiled(spark: SparkSession) -> Iterator[None]:
    """Within, a stage whose generated method is too large for the JVM to compile runs operator by
    operator. The session's own limit holds again afterwards."""
    before = spark.conf.get(METHOD_LIMIT)
    spark.conf.set(METHOD_LIMIT, str(min(int(before), METHOD_BYTES)))
    try:
        yield
    finally:
        spark.conf.set(METHOD_LIMIT, before)


def land(trips: DataFrame, folder: str, name: str = "raw") -> str:
    """Written as the source is partitioned, without a shuffle; row groups are small enough
    that even a single landed file is scanned by many tasks."""
    path = f"{folder}/{name}"
    trips.write.mode("overwrite").option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    return path


def land_by_month(parts: list[DataFrame], staging: str, folder: str, label: str) -> str:
    """One folder of part files per month in ``folder``, named as raw months are. ``label``
    holds YYYY-MM; one job for each of ``parts``, which are dealt by month already, writes its
    files of all months."""
    for trips in parts:
        trips.write.mode("append").partitionBy(label).parquet(staging)
    publish_months(parts[0].sparkSession, staging, label, folder)
    return folder
