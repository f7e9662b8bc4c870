"""Group-by with exact medians that stay exact and bounded at any group size.

Spark's ``median()`` keeps a map of every distinct value of a group in one task. At
trip scale that is neither fast (maps are serialised entry by entry) nor safe (one
platform at one airport may hold a third of a trillion trips). :func:`grouped` needs one
scan of the rows, and one more of those of large groups:

1. The first scan gives all ordinary aggregates and, for each measure, its count, its ends and
   a mergeable quantile sketch. A sketch of up to ``SKETCH`` values holds them all, so a median
   of so many is exact already. Of more, it gives a bracket around the middle.
2. A second scan counts the values below the bracket and, value by value, those inside it; both
   combine on the map side. Only this small table is kept.
3. The middle ranks are picked from it. A bracket of more than ``GROUP_VALUES`` different
   values is narrowed first, round by round, without another scan of the rows.

A bracket is an estimate, so the counts decide: where the middle ranks are not inside it, or
where a value is NaN (which sketches leave out), the range from end to end is narrowed
instead, over the rows: each round counts the rows of the current range in buckets, first by
magnitude and then in ``BUCKETS`` equal widths, and keeps the bucket that holds the middle
rank; six rounds at most, whatever the values. No group is gathered, so a hot one is spread
over all tasks, and no row is dropped or sampled.

Ordinary aggregates (counts, sums, means) combine map-side and need no such care.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curbside.functions.numeric import row_count
from curbside.operators.bounded import join_groups, settled

# Different values of one group and measure that one task may rank.
GROUP_VALUES = 1_000_000
BUCKETS = 1024
# Buckets of a range cut by magnitude, for each factor of two.
OCTAVE = 128
# Values up to which a sketch is exact, and the share of a group's rows that its bracket reaches to either side of
# the middle: more than ten times the error that the sketch states for its size.
SKETCH = 4096
REACH = 0.01


def grouped(
    df: DataFrame,
    keys: list[str],
    aggregates: list[Column],
    medians: dict[str, Column],
    *,
    group_rows: int | None = None,
) -> DataFrame:
    """``groupBy(keys)`` giving ``aggregates`` and the exact median of each row
    expression in ``medians``.

    Args:
        group_rows: different values of a bracket that one task may rank, by default
            ``GROUP_VALUES``.
    """
    group_rows = GROUP_VALUES if group_rows is None else group_rows
    held = {f"__v{i}": c.cast("double") for i, c in enumerate(medians.values())}
    rows = df.withColumns(held)
    groups = settled(
        rows.groupBy(*keys)
        .agg(*aggregates, *[c for v in held for c in _ends(v)])
        .withColumns({f"{v}_at": _reached(v) for v in held})
        .withColumns({f"{v}_mid": _exact(v) for v in held})
        .withColumns({f"{v}_open": F.expr(f"{v}_n > 0 and {v}_mid is null") for v in held})
        .drop(*[f"{v}_sketch" for v in held])
    )
    names = dict(zip(held, medians, strict=True))
    rest = [f"{v}_{e}" for v in held for e in ("n", "lo", "hi", "at", "mid", "open")]
    done = groups.withColumns({name: F.col(f"{v}_mid") for v, name in names.items()})
    still_open = " or ".join([f"{v}_open" for v in held]) or "false"
    n_large = groups.where(still_open).count()
    if not n_large:
        return done.drop(*rest)
    # Measures of these groups that are known already have nothing left to count.
    large = groups.where(still_open).selectExpr(
        *[f"`{k}`" for k in keys],
        *[
            x
            for v in held
            for x in (
                f"if({v}_open, {v}_n, 0) as {v}_n",
                f"if({v}_open, get({v}_at, 0), null) as {v}_a",
                f"if({v}_open, get({v}_at, 3), null) as {v}_b",
                f"{v}_lo",
                f"{v}_hi",
            )
        ],
    )
    inside = settled(inside_brackets(rows, large, keys, list(held), n_large, how="inner"))
    found = _ranked(rows, inside, large, keys, list(held), group_rows, n_large)
    found = found.withColumnsRenamed({v: f"{v}_found" for v in held})
    if keys:
        both = join_groups(done, found, keys, n_large, "left")
    else:
        one = found.first() or dict.fromkeys(found.columns)
        both = done.withColumns({c: F.lit(one[c]).cast("double") for c in found.columns})
    answers = {name: F.coalesce(f"{v}_found", f"{v}_mid") for v, name in names.items()}
    return both.withColumns(answers).drop(*rest, *[f"{v}_found" for v in held])


def sketched(v: str) -> Column:
    """Sketch of a measure, without NaN."""
    return F.expr(f"kll_sketch_agg_double(nanvl({v}, cast(null as double)), {SKETCH})")


def _ends(v: str) -> list[Column]:
    """Count, ends and sketch of a measure."""
    return [
        F.expr(f"count({v}) as {v}_n"),
        F.expr(f"min({v}) as {v}_lo"),
        F.expr(f"max({v}) as {v}_hi"),
        sketched(v).alias(f"{v}_sketch"),
    ]


def _reached(v: str, reach: float = REACH) -> Column:
    """Values at the start of the bracket, the two sides of the middle (a millionth apart, less
    than a rank of an exact sketch) and the end of the bracket; null where the sketch is empty."""
    ranks = ", ".join(f"{0.5 + d}D" for d in (-reach, 0.0, 1e-6, reach))
    return F.expr(
        f"if(kll_sketch_get_n_double({v}_sketch) > 0, "
        f"kll_sketch_get_quantile_double({v}_sketch, array({ranks})), null)"
    )


def _exact(v: str) -> Column:
    """The median, where the sketch holds every value."""
    low, high = f"get({v}_at, 1)", f"get({v}_at, 2)"
    return F.expr(
        f"if(kll_sketch_get_n_double({v}_sketch) = {v}_n and {v}_n <= {SKETCH}, "
        f"if({low} = {high}, {low}, 0.5D * {low} + 0.5D * {high}), null)"
    )


def inside_brackets(
    rows: DataFrame,
    brackets: DataFrame,
    keys: list[str],
    held: list[str],
    n_groups: int | None,
    flags: dict[str, Column] | None = None,
    parts: list[str] | None = None,
    how: str = "left",
) -> DataFrame:
    """Counts of the values inside each bracket (``__m``: measure, ``__v``: value, ``c``) and, in
    one row a group without a measure, of its rows, of the values below each bracket
    (``below_0``, ...) and of the rows with each flag. A group without brackets has nothing inside
    or below (``how`` left) or is left out (inner). Rows of different ``parts`` (columns) are counted
    apart."""
    flags, parts = flags or {}, parts or []
    ends = [f"{v}_{end}" for v in held for end in ("a", "b")]
    rows = rows.select(*parts, *keys, *held, *[c.alias(name) for name, c in flags.items()])
    if keys:
        marked = join_groups(rows, brackets.select(*keys, *ends), keys, n_groups, how)
    else:
        one = brackets.first() or dict.fromkeys(ends)
        marked = rows.withColumns({e: F.lit(one[e]).cast("double") for e in ends})
    cells = ["struct(-1 as __m, cast(null as double) as __v)"] + [
        f"if({v} between {v}_a and {v}_b, struct({i} as __m, {v} as __v), null)" for i, v in enumerate(held)
    ]
    below = {f"below_{i}": f"{v} < {v}_a as below_{i}" for i, v in enumerate(held)}
    by = [f"`{c}`" for c in (*parts, *keys)]
    one_each = marked.selectExpr(
        *by, *below.values(), *flags, f"inline(array_compact(array({', '.join(cells)})))"
    )
    return one_each.groupBy(*parts, *keys, "__m", "__v").agg(
        row_count().alias("c"), *[F.expr(f"count_if({b} and __m < 0) as {b}") for b in (*below, *flags)]
    )


def melted(groups: DataFrame, keys: list[str], names: list[str], columns: dict[str, str]) -> DataFrame:
    """One row for each group and measure ``__m``; ``columns`` gives the source of each column,
    with the measure's number for ``{}``."""
    rows = [
        f"struct({i} as __m, " + ", ".join(f"{source.format(i)} as {c}" for c, source in columns.items()) + ")"
        for i in range(len(names))
    ]
    return groups.selectExpr(*[f"`{k}`" for k in keys], f"inline(array({', '.join(rows)}))")


def picked(
    inside: DataFrame, measures: DataFrame, by: list[str], most: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Measures (``n``, ``a``, ``b``, ``below``) with their counts inside the bracket and whether
    it caught the middle ranks, and the table of values inside; there are at most ``most``."""
    table = inside.where("__m >= 0").select(*by, "__v", "c")
    counted = table.groupBy(*by).agg(F.sum("c").alias("inside"), row_count().alias("different"))
    found = join_groups(measures, counted, by, most, "left").fillna(0, ["inside", "different"])
    k1, k2 = _middle_ranks()
    caught = (F.col("below") < k1) & (k2 <= F.col("below") + F.col("inside"))
    return found.where(F.col("n") > 0).withColumn("caught", caught), table


def pivoted(found: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Answers of each group and measure as one column a measure."""
    by = keys or ["__one"]
    wide = found if keys else found.withColumn("__one", F.lit(1))
    return (
        wide.groupBy(*by)
        .pivot("__m", list(range(len(names))))
        .agg(F.first("answer"))
        .withColumnsRenamed({str(i): name for i, name in enumerate(names)})
        .drop("__one")
    )


def _ranked(
    rows: DataFrame,
    inside: DataFrame,
    groups: DataFrame,
    keys: list[str],
    names: list[str],
    group_rows: int,
    n_groups: int,
) -> DataFrame:
    """Medians of all groups; see the module text."""
    by = [*keys, "__m"]
    below = melted(inside.where("__m < 0"), keys, names, {"below": "below_{}"})
    ends = {"n": "__v{}_n", "least": "__v{}_lo", "most": "__v{}_hi", "a": "__v{}_a", "b": "__v{}_b"}
    most = n_groups * len(names)
    measures, table = picked(inside, join_groups(melted(groups, keys, names, ends), below, by, most), by, most)
    caught = F.col("caught")
    ranges = settled(
        measures.select(
            *by, "n", "caught",
            F.when(caught, F.col("a")).otherwise(F.col("least")).alias("lo"),
            F.when(caught, F.col("b")).otherwise(F.col("most")).alias("hi"),
            F.when(caught, F.col("below")).otherwise(F.lit(0)).alias("below"),
            F.when(caught, F.col("different")).otherwise(F.col("n")).alias("inside"),
        )
    )
    largest = dict(map(tuple, ranges.groupBy("caught").agg(F.max("inside")).collect()))
    caught = ranges.where("caught").drop("caught")
    found = narrowed(table, caught, by, group_rows, largest.get(True, 0), most)
    if False in largest:
        values = melted(rows, keys, names, {"__v": "__v{}"}).withColumn("c", F.lit(1).cast("bigint"))
        missed = ranges.where("not caught").drop("caught")
        found = found.unionByName(narrowed(values, missed, by, group_rows, largest[False], most))
    return pivoted(found, keys, names)


def narrowed(
    values: DataFrame,
    ranges: DataFrame,
    by: list[str],
    group_rows: int,
    largest: int,
    most: int | None = None,
) -> DataFrame:
    """Medians by narrowing ranges over weighted values (``__v``, ``c``) of each group and measure;
    ``largest`` is the most values that a range holds, ``most`` bounds the number of ranges."""
    if largest <= group_rows:
        return _pick(_within(values, ranges, by, most), by)
    same = F.when(F.col("lo").eqNullSafe(F.col("hi")), F.col("lo"))
    ranges = ranges.withColumn("answer", same)
    while True:
        wide = (F.col("inside") > group_rows) & F.col("answer").isNull()
        todo = ranges.where(wide)
        if todo.isEmpty():
            break
        narrowed = _narrow(_within(values, todo, by, most), by)
        ranges = settled(ranges.where(~wide).unionByName(narrowed))
    found = ranges.where(F.col("answer").isNotNull()).select(*by, "answer")
    rest = ranges.where(F.col("answer").isNull())
    return found.unionByName(_pick(_within(values, rest, by, most), by))


def _within(values: DataFrame, ranges: DataFrame, by: list[str], most: int | None) -> DataFrame:
    """The values that fall into their group's open range."""
    todo = ranges.select(*by, "n", "lo", "hi", "below")
    return join_groups(values, todo, by, most).where(F.col("__v").between(F.col("lo"), F.col("hi")))


def _middle_ranks() -> tuple[Column, Column]:
    n = F.col("n")
    return F.floor((n + 1) / 2), F.floor((n + 2) / 2)


def _counted(rows: DataFrame, by: list[str], cell: str, order: str) -> DataFrame:
    """Counts per cell with the number of values before each cell."""
    cells = rows.groupBy(*by, cell).agg(
        F.sum("c").alias("c"),
        row_count().alias("different"),
        F.min("__v").alias("first_v"),
        F.max("__v").alias("last_v"),
        F.max("n").alias("n"),
        F.max("below").alias("below"),
    )
    running = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return cells.withColumn("upto", F.col("below") + F.sum("c").over(running)).withColumn(
        "before", F.col("upto") - F.col("c")
    )


def _holds(rank: Column) -> Column:
    return (F.col("before") < rank) & (rank <= F.col("upto"))


def _bucket() -> Column:
    """Bucket of a value in its range, in value order.

    A range of one sign within a factor of two is cut into equal widths. Any other is cut by
    magnitude, each octave into ``OCTAVE`` parts, with buckets of their own for zero, the
    infinities and NaN (which sorts last); what it keeps is narrow. So however far outliers
    reach, one round by magnitude and then at most five by width separate any two doubles. The
    ends of a range never share a bucket, so every round splits it.
    """
    v, lo, hi = F.col("__v"), F.col("lo"), F.col("hi")
    infinite = F.lit(float("inf"))
    narrow = ((lo > 0) & (hi <= 2 * lo) & (hi < infinite)) | (
        (hi < 0) & (lo >= 2 * hi) & (lo > -infinite)
    )
    position = F.floor((v - lo) / F.nullif(hi - lo, F.lit(0.0)) * BUCKETS)
    by_width = F.least(F.coalesce(position, F.lit(0)), F.lit(BUCKETS - 1))
    magnitude = F.floor(F.log2(F.abs(v)) * OCTAVE) + F.lit(1100 * OCTAVE)
    return (
        F.when(narrow, by_width)
        .when(F.isnan(v), F.lit(3000 * OCTAVE))
        .when(v == infinite, F.lit(2500 * OCTAVE))
        .when(v == -infinite, F.lit(-2500 * OCTAVE))
        .when(v == 0, F.lit(0))
        .otherwise(F.when(v > 0, magnitude).otherwise(-magnitude))
    )


def _narrow(rows: DataFrame, by: list[str]) -> DataFrame:
    """Replace each range by the bucket that holds its middle ranks."""
    k1, k2 = _middle_ranks()
    bucket = _bucket()
    cells = _counted(rows.withColumn("bucket", bucket), by, "bucket", "bucket")
    low, high = F.when(_holds(k1), F.col("last_v")), F.when(_holds(k2), F.col("first_v"))
    return (
        cells.where(_holds(k1) | _holds(k2))
        .groupBy(*by)
        .agg(
            F.max("n").alias("n"),
            F.min("first_v").alias("lo"),
            F.max("last_v").alias("hi"),
            F.min("before").alias("below"),
            F.sum("different").alias("inside"),
            row_count().alias("cells"),
            F.max(low).alias("k1_last"),
            F.max(high).alias("k2_first"),
        )
        # Two cells: the middle ranks sit on either side of the cell border.
        .withColumn(
            "answer",
            F.when(F.col("cells") == 2, _mean("k1_last", "k2_first")).when(
                F.col("lo") == F.col("hi"), F.col("lo")
            ),
        )
        .select(*by, "n", "lo", "hi", "below", "inside", "answer")
    )


def _pick(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rank the few values left in each range and average the middle pair."""
    k1, k2 = _middle_ranks()
    return (
        _counted(rows, by, "__v", "__v")
        .groupBy(*by)
        .agg(
            F.max(F.when(_holds(k1), F.col("last_v"))).alias("low"),
            F.max(F.when(_holds(k2), F.col("last_v"))).alias("high"),
        )
        .select(*by, _mean("low", "high").alias("answer"))
    )


def _mean(low: str, high: str) -> Column:
    return F.when(F.col(low) == F.col(high), F.col(low)).otherwise(
        0.5 * F.col(low) + 0.5 * F.col(high)
    )
