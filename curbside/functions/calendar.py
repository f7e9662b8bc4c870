"""Calendar expressions on naive (time-zone free) timestamps, and month arithmetic.

Trip times are local wall-clock values, so nothing here may pass through a zoned
TIMESTAMP: elapsed time is an interval subtraction and months are cut from the
date. Both are independent of the session time zone.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbside.functions.numeric import col
from curbside.scope import YearMonth

# Accepted years of a month label.
FIRST_YEAR = 2019
LAST_YEAR = 2100


def naive(moment: datetime) -> Column:
    """A naive timestamp literal. Through text, as a datetime literal would be read
    in the driver's zone and shown in the session's."""
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


def elapsed_seconds(start: Column | str, end: Column | str) -> Column:
    """Whole seconds from start to end, truncated toward zero."""
    return (col(end) - col(start)).cast("interval second").cast("bigint")


def month_start(c: Column | str) -> Column:
    return F.trunc(col(c).cast("date"), "month").cast("timestamp_ntz")


def months_before(c: Column | str, n: int) -> Column:
    """The same naive timestamp n months earlier."""
    return col(c) - F.make_ym_interval(F.lit(0), F.lit(n))


def months_between_starts(earlier: Column, later: Column) -> Column:
    """Whole calendar months between two month starts."""
    return (F.year(later) - F.year(earlier)) * 12 + (F.month(later) - F.month(earlier))


def iso_weekday(c: Column | str) -> Column:
    """Monday = 1 ... Sunday = 7."""
    return F.weekday(col(c)) + 1


def month_label(c: Column | str) -> Column:
    """Jan .. Dec."""
    return F.date_format(col(c).cast("date"), "MMM")


def by_year(df: DataFrame, month_col: str = "month") -> DataFrame:
    """Add the calendar year of a month column."""
    return df.withColumn("year", F.year(month_col))


def month_add(ym: YearMonth, n: int) -> YearMonth:
    years, month0 = divmod(ym[0] * 12 + ym[1] - 1 + n, 12)
    return years, month0 + 1


def months(start: YearMonth, end: YearMonth) -> list[YearMonth]:
    """Every month from start to end inclusive; an inverted range is empty."""
    span = (end[0] - start[0]) * 12 + end[1] - start[1]
    return [month_add(start, i) for i in range(span + 1)]


def parse_ym(text: str) -> YearMonth:
    """Parse one YYYY-MM parameter.

    Raises:
        ValueError: the text is not a plausible year and month.
    """
    shown = text.strip()
    year_text, _, month_text = shown.partition("-")
    try:
        year, month = int(year_text), int(month_text)
        if "-" in month_text:
            raise ValueError
    except ValueError:
        raise ValueError(f"not YYYY-MM: {shown!r}") from None
    if month not in range(1, 13):
        raise ValueError(f"month out of range: {shown!r}")
    if year not in range(FIRST_YEAR, LAST_YEAR + 1):
        raise ValueError(f"year out of range: {shown!r}")
    return year, month


def parse_month_labels(df: DataFrame, label: str) -> DataFrame:
    """The same rule for a whole column: adds ``year``, ``month`` and ``error``.

    ``error`` is null for a good label; a bad one has null year and month.
    """
    text = F.trim(F.col(label))
    shape = r"^\+?(\d+)\s*-\s*\+?(\d+)$"
    shaped = text.rlike(shape)
    # Numbers without leading zeros; one of more digits than a year is in no range, however long.
    digits = [
        F.regexp_replace(F.when(shaped, F.regexp_extract(text, shape, g)), r"^0+(?=\d)", "")
        for g in (1, 2)
    ]
    number = [F.when(F.length(d) <= 9, d).try_cast("int") for d in digits]
    month_ok = F.coalesce(number[1].between(1, 12), F.lit(False))
    year_ok = F.coalesce(number[0].between(FIRST_YEAR, LAST_YEAR), F.lit(False))
    error = (
        F.when(~F.coalesce(shaped, F.lit(False)), "not YYYY-MM")
        .when(~month_ok, "month out of range")
        .when(~year_ok, "year out of range")
    )
    return df.withColumns(
        {
            "year": F.when(error.isNull(), number[0]).cast("int"),
            "month": F.when(error.isNull(), number[1]).cast("int"),
            "error": error,
        }
    )


def month_spine(bounds: DataFrame, start: str, end: str) -> DataFrame:
    """Month starts between two columns of ``bounds``, inclusive.

    An inverted or null range gives no row; ``sequence`` alone would raise.
    """
    step = F.make_ym_interval(F.lit(0), F.lit(1))
    return bounds.where(F.col(start) <= F.col(end)).select(
        F.explode(F.sequence(month_start(start), month_start(end), step)).alias("month")
    )
