"""Display formatting of measurements as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from curbside.functions.numeric import col


def _plain(value: Column, places: int) -> Column:
    """Fixed decimals without thousands separators, rounded half to even."""
    return F.replace(F.format_number(value, places), F.lit(","), F.lit(""))


def format_metric(value: Column | str, kind: Column | str) -> Column:
    """One measurement as text; a missing value is "not reported"."""
    v, k = col(value).cast("double"), col(kind)
    return (
        F.when(v.isNull(), "not reported")
        .when(k == "count", F.format_number(v, 0))
        .when(k == "money", F.concat(F.lit("$"), F.format_number(v, 2)))
        .when(k == "percent", F.concat(_plain(v * 100, 1), F.lit("%")))
        .when(k == "minutes", _plain(v / 60, 1))
        .otherwise(F.format_number(v, 1))
    )


def format_difference(value: Column | str, kind: Column | str) -> Column:
    """A signed difference as text; shares differ in percentage points. Only a
    positive difference carries a plus, so an exact zero prints a minus."""
    v, k = col(value).cast("double"), col(kind)
    size = F.abs(v)
    body = F.when(k == "percent", F.concat(_plain(size * 100, 1), F.lit(" pp"))).otherwise(
        format_metric(size, k)
    )
    sign = F.when(v > 0, "+").otherwise("-")
    return F.when(v.isNull(), "not comparable").otherwise(F.concat(sign, body))
