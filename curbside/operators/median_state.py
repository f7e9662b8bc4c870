"""Exact medians kept up to date: a part of the rows that is new or changed is read, the others are
not.

The state is a table of brackets, one for each group and measure, and for each part of the rows
(say, a month) the counts that the brackets ask for: values below, and value by value those inside.
Counts of parts add up, so the middle ranks of all rows are found in the sum as long as they lie
inside the bracket. Where they have drifted out, or where a new group has no bracket, new brackets
must be made from all rows; :func:`merged` says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbside.operators import medians as M
from curbside.operators.bounded import join_groups, settled

#: Share of a group's rows that a stored bracket reaches to either side of the middle.
REACH = 0.05


def held(df: DataFrame, measures: dict[str, Column]) -> DataFrame:
    return df.withColumns({f"__v{i}": c.cast("double") for i, c in enumerate(measures.values())})


def brackets(df: DataFrame, keys: list[str], measures: dict[str, Column]) -> DataFrame:
    """Brackets of all groups, from one scan."""
    names = [f"__v{i}" for i in range(len(measures))]
    sketches = held(df, measures).groupBy(*keys).agg(*[M.sketched(v).alias(f"{v}_sketch") for v in names])
    at = sketches.select(*keys, *[M._reached(v, REACH).alias(v) for v in names])
    ends = [F.get(v, F.lit(i)).alias(f"{v}_{end}") for v in names for end, i in (("a", 0), ("b", 3))]
    return at.select(*keys, *ends)


def part_counts(
    df: DataFrame,
    keys: list[str],
    measures: dict[str, Column],
    kept: DataFrame,
    flags: dict[str, Column],
    parts: list[str],
) -> DataFrame:
    """Counts of parts of the rows (of each value of the columns ``parts``) for the stored
    brackets, from one scan; ``flags`` are row tests that are counted with it."""
    rows = held(df, measures)
    known = {f"n_{i}": F.col(f"__v{i}").isNotNull() for i in range(len(measures))}
    names = [f"__v{i}" for i in range(len(measures))]
    return M.inside_brackets(rows, kept, keys, names, None, {**known, **flags}, parts)


def merged(
    counts: DataFrame, keys: list[str], names: list[str], kept: DataFrame, flags: list[str]
) -> tuple[DataFrame, bool]:
    """Rows, flag counts and medians of each group from the counts of all parts, and whether every
    bracket still holds its middle ranks."""
    by = [*keys, "__m"]
    numbers = [f"{c}_{i}" for i in range(len(names)) for c in ("below", "n")]
    totals = settled(
        counts.where("__m < 0")
        .groupBy(*keys)
        .agg(F.sum("c").alias("trips"), *[F.sum(c).alias(c) for c in (*numbers, *flags)])
    )
    inside = counts.groupBy(*by, "__v").agg(F.sum("c").alias("c"))
    ends = M.melted(kept, keys, names, {"a": "__v{}_a", "b": "__v{}_b"})
    sums = M.melted(totals, keys, names, {"n": "n_{}", "below": "below_{}"})
    measures, table = M.picked(inside, join_groups(sums, ends, by, how="left"), by)
    measures = settled(measures)
    if not measures.where(~F.col("caught")).isEmpty():
        return totals, False
    largest = measures.agg(F.max("different")).first()[0] or 0
    ranges = measures.select(
        *by, "n", F.col("a").alias("lo"), F.col("b").alias("hi"), "below", F.col("different").alias("inside")
    )
    found = M.pivoted(M.narrowed(table, ranges, by, M.GROUP_VALUES, largest), keys, names)
    return join_groups(totals, found, keys, how="left").drop(*numbers), True
