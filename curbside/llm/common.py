"""Helpers shared by the corpus operators: intermediate tables, word splitting, row checks."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Words of the decontamination and near-duplicate contracts, on bytes that
#: were lower-cased for A-Z only. Every byte of a non-ASCII character belongs to a word.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that the session names in spark.checkpoint.dir."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    return f"{folder.rstrip('/')}/corpus-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder: computed once, lineage cut, safe
    against the loss of executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def plain_words(text: str | None) -> list[bytes]:
    """Words of a text as lower-case UTF-8 bytes; none for null."""
    return WORD.findall(utf8(text).lower()) if text else []


def utf8(text: str | None) -> bytes:
    """UTF-8 bytes of a text; a null is empty."""
    return text.encode("utf-8", "surrogatepass") if text else b""


def text_bytes(df: DataFrame, text: str) -> int:
    """UTF-8 bytes of a text column, counted over all rows."""
    return df.agg(F.sum(F.octet_length(text))).first()[0] or 0


def split_runs(sizes: np.ndarray) -> np.ndarray:
    """0..n-1 within each of consecutive runs of the given sizes."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - sizes, sizes)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every input bit over the output."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def map_batches(df: DataFrame, schema: T.StructType | str, make: Callable) -> DataFrame:
    """``make`` turns each Arrow batch into a dict of column values (Arrow arrays, numpy arrays
    or lists), or into several such dicts in turn. Integers with nulls stay integers."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = make(batch)
            for columns in [made] if isinstance(made, dict) else made:
                arrays = [
                    v if isinstance(v := columns[f.name], (pa.Array, pa.ChunkedArray)) else pa.array(v, type=f.type)  # noqa: E501
                    for f in arrow
                ]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return df.mapInArrow(run, schema)


def transposed(rows: list[tuple], names: list[str]) -> dict[str, list]:
    """Rows as named columns; no rows give empty columns."""
    return {n: [r[i] for r in rows] for i, n in enumerate(names)}
