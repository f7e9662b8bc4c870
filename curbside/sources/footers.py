"""Parquet footers as a table: one row a file with its column types, row count, time ranges or the
reason why it cannot be read.

One distributed job reads the footers of any number of files and no column data. Tasks open a file
through Arrow where Arrow knows its file system; files of other stores are left to the driver,
which reads their footers through Hadoop in one call for ``AT_ONCE`` files.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: ``columns``: Spark's type for each flat column. ``lowest`` and ``highest``: microseconds of the
#: time columns, absent where a row group has values without statistics.
FOOTER = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("file", T.StringType()),
        T.StructField("rows", T.LongType()),
        T.StructField("columns", T.MapType(T.StringType(), T.StringType())),
        T.StructField("lowest", T.MapType(T.StringType(), T.LongType())),
        T.StructField("highest", T.MapType(T.StringType(), T.LongType())),
        T.StructField("error", T.StringType()),
        T.StructField("unreached", T.BooleanType()),
    ]
)
#: Footers that the driver reads at a time.
AT_ONCE = 16
#: Schemes that differ between Hadoop and Arrow.
ARROW_SCHEMES = {"s3a": "s3", "s3n": "s3"}
#: Microseconds in a stored unit of time, or stored units in a microsecond.
UNITS = {"milliseconds": (1000, 1), "microseconds": (1, 1), "nanoseconds": (1, 1000)}

_PHYSICAL = {
    "BOOLEAN": "boolean", "INT32": "int", "INT64": "bigint", "INT96": "timestamp", "FLOAT": "float",
    "DOUBLE": "double", "BYTE_ARRAY": "binary", "FIXED_LEN_BYTE_ARRAY": "binary",
}
_SIGNED = {8: "tinyint", 16: "smallint", 32: "int", 64: "bigint"}
_UNSIGNED = {8: "smallint", 16: "int", 32: "bigint", 64: "decimal(20,0)"}


def stored_type(physical: str, logical: dict) -> str:
    """Spark's type of a column; nanosecond times are read as whole numbers."""
    kind = logical.get("Type")
    if kind == "Timestamp":
        if logical["timeUnit"] == "nanoseconds":
            return "bigint"
        return "timestamp" if logical["isAdjustedToUTC"] else "timestamp_ntz"
    if kind == "Decimal":
        return f"decimal({logical['precision']},{logical['scale']})"
    if kind == "Int":
        return (_SIGNED if logical["isSigned"] else _UNSIGNED)[logical["bitWidth"]]
    named = {"String": "string", "Enum": "string", "JSON": "string", "Date": "date", "Time": "time", "Null": "void"}
    return named.get(kind, _PHYSICAL[physical])


def _open(file: str) -> pa.NativeFile | None:
    """The file through Arrow; None where Arrow has no such file system."""
    scheme, colon, rest = file.partition(":")
    if not colon or scheme == "file":
        return pa.fs.LocalFileSystem().open_input_file("/" + (rest if colon else file).lstrip("/"))
    try:
        system, path = pa.fs.FileSystem.from_uri(f"{ARROW_SCHEMES.get(scheme, scheme)}:{rest}")
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return None
    return system.open_input_file(path)


def _described(meta: pq.FileMetaData) -> dict:
    columns: dict[str, str] = {}
    lowest: dict[str, int] = {}
    highest: dict[str, int] = {}
    for i in range(meta.num_columns):
        column = meta.schema.column(i)
        name = column.path.partition(".")[0]
        if column.path != name or column.max_repetition_level:
            columns[name] = "nested"
            continue
        logical = json.loads(column.logical_type.to_json())
        columns[name] = stored_type(column.physical_type, logical)
        if logical.get("Type") == "Timestamp":
            ends = _ends(meta, i)
            if ends:
                times, parts = UNITS[logical["timeUnit"]]
                lowest[name], highest[name] = (e * times // parts for e in ends)
    return {"rows": meta.num_rows, "columns": columns, "lowest": lowest, "highest": highest}


def _ends(meta: pq.FileMetaData, column: int) -> tuple[int, int] | None:
    """Stored minimum and maximum; None if there is no value or if a row group does not tell."""
    found = []
    for group in range(meta.num_row_groups):
        chunk = meta.row_group(group).column(column)
        stats = chunk.statistics
        if stats is not None and stats.has_min_max:
            found.append((stats.min_raw, stats.max_raw))
        elif chunk.num_values and not (stats is not None and stats.null_count == chunk.num_values):
            return None
    return (min(f[0] for f in found), max(f[1] for f in found)) if found else None


def _footer(file: str) -> dict:
    """One row of the table, without its path. An input or output error is raised, so that the task
    is tried again; a file that is no readable parquet file is described."""
    row = dict.fromkeys(FOOTER.names) | {"file": file, "unreached": False}
    try:
        opened = _open(file)
        if opened is None:
            return row | {"unreached": True}
        with opened:
            return row | _described(pq.ParquetFile(opened).metadata)
    except pa.ArrowException as exc:
        return row | {"error": _one_line(exc)}
    except OSError as exc:
        if exc.errno is not None:
            raise
        return row | {"error": _one_line(exc)}


def _one_line(exc: Exception | str) -> str:
    return " ".join(str(exc).split())


def footers(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Footers of all files under some paths; ``path`` is the given path of each file.

    Raises:
        AnalysisException: a path does not exist.
    """
    if not paths:
        return spark.createDataFrame([], FOOTER).drop("unreached")
    roots = {_qualified(spark, p): p for p in paths}
    arrow = to_arrow_schema(FOOTER)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_footer(f) | {"path": _root(f, roots)} for f in batch["path"].to_pylist()]
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    # Only names and sizes are read of the files here.
    files = spark.read.format("binaryFile").load(list(paths)).select("path")
    found = files.mapInArrow(read, FOOTER)
    if all(r.startswith(("file:", "/")) for r in roots):
        return found.drop("unreached")
    others = [r.file for r in found.where("unreached").select("file").collect()]
    if others:
        rows = [(_root(r[0], roots), *r) for r in _by_hadoop(spark, others)]
        found = found.where(~F.col("unreached")).unionAll(spark.createDataFrame(rows, FOOTER))
    return found.drop("unreached")


def _qualified(spark: SparkSession, path: str) -> str:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()


def _root(file: str, roots: dict[str, str]) -> str | None:
    """The given path that a file is, or lies under."""
    at = file
    while at not in roots and "/" in at:
        at = at.rpartition("/")[0]
    return roots.get(at)


def _by_hadoop(spark: SparkSession, files: list[str]) -> Iterator[tuple]:
    """Rows of files that only Hadoop reaches, read by threads of the driver. They hold no ranges."""
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    parquet = jvm.org.apache.spark.sql.execution.datasources.parquet
    every_group = jvm.org.apache.parquet.format.converter.ParquetMetadataConverter.NO_FILTER
    convert = parquet.ParquetToSparkSchemaConverter(spark._jsparkSession.sessionState().conf())

    def read(file: str) -> tuple:
        path = jvm.org.apache.hadoop.fs.Path(file)
        try:
            opened = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(path, conf)
            meta = parquet.ParquetFooterReader.readFooter(opened, every_group)
            schema = json.loads(convert.convert(meta.getFileMetaData().getSchema()).json())
        except Py4JJavaError as exc:
            said = exc.java_exception.toString()
            # A fault of the file, not of the store.
            if not said.startswith("java.lang.RuntimeException") and "arquet" not in said:
                raise
            return file, None, None, None, None, _one_line(said), False
        rows = sum(group.getRowCount() for group in meta.getBlocks())
        columns = {f.name: f.dataType.simpleString() for f in T.StructType.fromJson(schema)}
        return file, rows, columns, {}, {}, None, False

    with ThreadPoolExecutor(AT_ONCE) as threads:
        yield from threads.map(read, files)


def rows_by_path(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Files and rows of each path, counted from footers alone. A file that cannot be read counts
    as faulty and adds no rows."""
    return footers(spark, paths).groupBy("path").agg(
        F.count("rows").alias("files"),
        F.count("error").alias("faulty"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
    )


def time_span(spark: SparkSession, paths: Sequence[str], column: str) -> DataFrame:
    """One row: first and last value of a time column over all files, from their footers. Only
    files whose footers do not tell are read, and only that column of them.

    Raises:
        ValueError: a file cannot be read.
    """
    found = footers(spark, paths)
    known = found.agg(
        F.min(F.col("lowest")[column]).alias("first"),
        F.max(F.col("highest")[column]).alias("last"),
        F.min("error").alias("error"),
        F.collect_list(F.when(_silent(column), F.col("file"))).alias("silent"),
    ).first()
    if known.error:
        raise ValueError(known.error)
    ends = spark.createDataFrame([(known["first"], known["last"])], "a long, b long")
    ends = ends.select(_time("a").alias("first"), _time("b").alias("last"))
    if known.silent:
        read = spark.read.schema(f"`{column}` timestamp_ntz").parquet(*known.silent)
        ends = ends.unionAll(read.agg(F.min(column), F.max(column)))
    return ends.agg(F.min("first").alias("first"), F.max("last").alias("last"))


def _silent(column: str) -> Column:
    """The file has the column and rows, but no range."""
    has = F.array_contains(F.map_keys("columns"), column) & (F.col("rows") > 0)
    return has & F.col("lowest")[column].isNull()


def _time(micros: str) -> Column:
    return F.expr(f"timestamp_ntz'1970-01-01 00:00:00' + interval '0.000001' second * `{micros}`")
