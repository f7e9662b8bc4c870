"""Joins against small derived lists, broadcast only when the size is proven.

A scope list (live platforms, dispatch airports) filters trip-level rows, so it
should be broadcast, but a hint must never outgrow an executor. Each caller passes
the largest number of rows the list can have. Within ``BROADCAST_ROWS`` the hint is
set; above it, or with no known bound, the join is left to the optimizer's own size
statistics and adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000


def small_side(df: DataFrame, max_rows: int | None) -> DataFrame:
    return F.broadcast(df) if max_rows is not None and max_rows <= BROADCAST_ROWS else df


def keep_listed(
    df: DataFrame, listed: DataFrame, on: str, max_rows: int | None = None
) -> DataFrame:
    """Semi-join: rows whose ``on`` value is in the list."""
    joined = df.join(small_side(listed.select(on), max_rows), on, "left_semi")
    return joined.select(*df.columns)


def join_groups(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    max_rows: int | None = None,
    how: str = "inner",
) -> DataFrame:
    """Join on grouping keys, null-safe (a null group matches itself), keeping the
    left key columns."""
    right = small_side(right.withColumnsRenamed({k: f"__{k}" for k in keys}), max_rows)
    condition = F.lit(True)
    for k in keys:
        condition = condition & left[k].eqNullSafe(right[f"__{k}"])
    return left.join(right, condition, how).drop(*[f"__{k}" for k in keys])


def settled(df: DataFrame) -> DataFrame:
    """Compute a small intermediate once and cut its lineage, in the reliable
    checkpoint folder (survives the loss of executors)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The shared folder of this session: ``spark.checkpoint.dir``. There is no fallback: a
    machine-local folder would be lost with the machine."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return configured


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
