"""Raw files by the column types they store.

The explicit schema reads most widths and both millisecond and microsecond times. It
cannot read nanosecond times, 64-bit integers or decimals as money, or floats as whole
numbers; files that hold those are read as stored and cast. The footer of every file tells
its layout, so the part files of one month may differ, and a file that cannot be read
stops only its own month.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curbside.schema import RAW_SCHEMA
from curbside.sources.footers import footers

#: Columns to read as stored, as (name, type) in the order of the schema; the empty layout is the
#: explicit schema itself.
Layout = tuple[tuple[str, str], ...]
Groups = dict[Layout, list[str]]

_AS_IT_IS = {
    "timestamp_ntz": ("timestamp_ntz", "timestamp", "void"),
    "double": ("double", "float", "int", "smallint", "tinyint", "void"),
    "bigint": ("bigint", "int", "smallint", "tinyint", "void"),
    "string": ("string", "binary", "void"),
}
_AS_STORED = {
    "timestamp_ntz": ("bigint",),
    "double": ("bigint", "decimal"),
    "bigint": ("double", "float", "decimal"),
    "string": (),
}


class Examined(NamedTuple):
    """Paths by layout, paths that cannot be read whole with the reason, and the rows of the others."""

    groups: Groups
    broken: dict[str, str]
    rows: dict[str, int]


def by_layout(spark: SparkSession, paths: Sequence[str]) -> tuple[Groups, dict[str, str]]:
    """Paths by layout, and the paths that cannot be read whole with the reason."""
    return examined(spark, paths)[:2]


def examined(spark: SparkSession, paths: Sequence[str]) -> Examined:
    """What the footers of all files under some paths tell.

    One job reads all footers and groups them by path. A path whose files share a layout stands for
    them; of one with several layouts, the files are listed.
    """
    own, wrong = F.col("layout.own"), F.coalesce("error", "layout.wrong")
    found = footers(spark, paths).withColumn("layout", _layout(F.col("columns")))
    named = F.concat_ws(": ", F.element_at(F.split("file", "/"), -1), wrong)
    layouts = found.groupBy("path", own.alias("own")).agg(
        F.min(F.when(wrong.isNotNull(), named)).alias("wrong"),
        F.sum("rows").alias("rows"),
        F.collect_list("file").alias("files"),
    )
    # One row for each path and layout; files are named only where a path has several.
    several = F.size("layouts") > 1
    rows = (
        layouts.groupBy("path")
        .agg(
            F.min("wrong").alias("wrong"),
            F.sum("rows").alias("rows"),
            F.collect_list(F.struct("own", "files")).alias("layouts"),
        )
        .select(
            "path",
            "wrong",
            "rows",
            F.transform(
                "layouts",
                lambda x: F.struct(x["own"].alias("own"), F.when(several, x["files"]).alias("files")),
            ).alias("layouts"),
        )
        .collect()
    )
    groups: Groups = {}
    broken = {p: "holds no parquet file" for p in set(paths) - {r.path for r in rows}}
    for row in sorted(rows, key=lambda r: r.path):
        if row.wrong:
            broken[row.path] = row.wrong
            continue
        for layout in row.layouts:
            own = tuple((f.name, f.type) for f in layout.own)
            groups.setdefault(own, []).extend(sorted(layout.files or [row.path]))
    return Examined(groups, broken, {r.path: r.rows for r in rows if not r.wrong})


def _layout(columns: Column) -> Column:
    """Columns of a file to read as stored, and the first one that no cast can read."""
    own, wrong = [], []
    for f in RAW_SCHEMA:
        wanted = f.dataType.simpleString()
        found = F.try_element_at(columns, F.lit(f.name))
        kind = F.regexp_replace(found, r"\(.*", "")
        as_it_is = found.isNull() | found.isin(*_AS_IT_IS[wanted])
        as_stored = kind.isin(*_AS_STORED[wanted]) if _AS_STORED[wanted] else F.lit(False)
        own.append(
            F.when(~as_it_is & as_stored, F.struct(F.lit(f.name).alias("name"), found.alias("type")))
        )
        text = F.concat(F.lit(f"column {f.name} is "), found, F.lit(f", not {wanted}"))
        wrong.append(F.when(~as_it_is & ~as_stored, text))
    return F.struct(F.array_compact(F.array(*own)).alias("own"), F.coalesce(*wrong).alias("wrong"))


def read_groups(spark: SparkSession, groups: Groups, **more: Column) -> DataFrame:
    """Rows of all groups under the explicit schema, with columns ``more`` of the files."""
    return reduce(
        DataFrame.unionAll,
        [_read(spark, dict(layout), paths, more) for layout, paths in sorted(groups.items())],
    )


def _read(
    spark: SparkSession, own: dict[str, str], paths: list[str], more: dict[str, Column]
) -> DataFrame:
    if any(own.get(f.name) == "bigint" for f in RAW_SCHEMA if f.dataType == T.TimestampNTZType()):
        # Without this, Spark refuses files with nanosecond times. No other file is affected, and
        # it must still hold when the frame is computed.
        spark.conf.set("spark.sql.legacy.parquet.nanosAsLong", "true")
    schema = ", ".join(f"`{f.name}` {own.get(f.name, f.dataType.simpleString())}" for f in RAW_SCHEMA)
    raw = spark.read.schema(schema).parquet(*paths)
    return raw.select(
        *[_cast(f).alias(f.name) if f.name in own else F.col(f.name) for f in RAW_SCHEMA],
        *[c.alias(name) for name, c in more.items()],
    )


def _cast(field: T.StructField) -> Column:
    c = F.col(field.name)
    if isinstance(field.dataType, T.TimestampNTZType):
        micros = f"(`{field.name}` - pmod(`{field.name}`, 1000)) div 1000"
        return F.expr(f"timestamp_ntz'1970-01-01 00:00:00' + interval '0.000001' second * ({micros})")
    # A float that is no whole number in range (NaN) becomes null.
    return c.try_cast(field.dataType)
