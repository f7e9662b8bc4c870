"""File-arrival ingest: rebuild the months whose raw files have changed.

The stream only detects arrivals (it reads file paths, no trip columns) and its
checkpoint remembers which files were seen. Each micro-batch rebuilds the touched
months from all their raw files with the batch writer, which replaces whole month
partitions. A repeated or late batch therefore gives the same archive: late files
extend their month, and a replay duplicates nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from curbside.plans.ingest import RAW_LABEL, BuildReport, build_months
from curbside.schema import RAW_SCHEMA
from curbside.scope import DEFAULT_SCOPE, Scope


def watch_raw(
    spark: SparkSession,
    raw_dir: str,
    archive: str,
    checkpoint: str,
    scope: Scope = DEFAULT_SCOPE,
    on_report=None,
) -> StreamingQuery:
    """Process everything that has landed since the last run, then stop.

    ``on_report`` receives a :class:`BuildReport` per micro-batch. Where months fail, the others
    are built first; the batch then fails and is tried again by the next run.
    """
    arrivals = (
        spark.readStream.schema(RAW_SCHEMA)
        .parquet(f"{raw_dir}/fhvhv_tripdata_*.parquet")
        .select(F.regexp_extract(F.col("_metadata.file_path"), RAW_LABEL, 1).alias("label"))
        .filter("label <> ''")  # a file without a month in its name belongs to none
    )

    def rebuild(batch: DataFrame, _batch_id: int) -> None:
        labels = sorted(r.label for r in batch.distinct().collect())  # one row per month
        touched = [(int(x[:4]), int(x[5:7])) for x in labels]
        report = BuildReport()
        build_months(spark, raw_dir, archive, touched, scope, report)
        if on_report is not None:
            on_report(report)
        if report.failed:
            raise RuntimeError(f"months not built: {sorted(report.failed)}")

    return (
        arrivals.writeStream.foreachBatch(rebuild)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
