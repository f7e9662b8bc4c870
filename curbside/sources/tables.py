"""The six aggregate tables as files."""

from __future__ import annotations

from collections.abc import Collection, Mapping

from pyspark.sql import DataFrame, SparkSession

from curbside.schema import TABLE_SCHEMAS
from curbside.scope import AGGREGATE_TABLES
from curbside.sources.files import exists
from curbside.sources.trips import ZSTD_LEVEL

FORMATS = ("parquet", "json")


def check_format(fmt: str) -> None:
    if fmt not in FORMATS:
        raise ValueError(f"cannot write {fmt!r}, only {' and '.join(FORMATS)}")


def write_tables(
    tables: Mapping[str, DataFrame],
    base: str,
    fmt: str = "parquet",
    names: Collection[str] = AGGREGATE_TABLES,
) -> dict[str, str]:
    """Write the tables; name to path. JSON is one record per line.

    Raises:
        ValueError: unknown format, or the names are not those expected, by default the six tables.
    """
    check_format(fmt)
    missing, extra = set(names) - set(tables), set(tables) - set(names)
    if missing or extra:
        which = "the six tables" if len(names) == len(AGGREGATE_TABLES) else ", ".join(names)
        raise ValueError(f"not {which}: missing {missing}, unknown {extra}")
    written = {}
    for name, df in tables.items():
        path = f"{base}/{name}"
        # Rebalance packs a few thousand aggregate rows into one file, and would
        # split them again if there were more.
        writer = df.hint("rebalance").sortWithinPartitions(*_keys(df)).write.mode("overwrite")
        if fmt == "parquet":
            writer = writer.option("compression", "zstd").option(
                "parquet.compression.codec.zstd.level", ZSTD_LEVEL
            )
        else:
            writer = writer.option("ignoreNullFields", "false")
        writer.format(fmt).save(path)
        written[name] = path
    return written


def _keys(df: DataFrame) -> list[str]:
    return [c for c in ("month", "airport", "platform", "direction", "hour") if c in df.columns]


def read_table(spark: SparkSession, base: str, name: str, fmt: str = "parquet") -> DataFrame:
    """One aggregate table.

    Raises:
        FileNotFoundError: the tables have not been exported to ``base``.
    """
    path = f"{base}/{name}"
    if not exists(spark, path):
        raise FileNotFoundError(f"{path} not found, export the aggregates first")
    return spark.read.schema(TABLE_SCHEMAS[name]).format(fmt).load(path)
