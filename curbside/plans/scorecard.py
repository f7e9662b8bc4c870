"""Platform against platform: the measurement matrix, targets and gaps.

Platform names become column names, so they are driver-side lists here (a handful,
see ``scoping.names``); everything else stays a DataFrame.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curbside.functions.calendar import by_year
from curbside.functions.numeric import row_max, row_min, safe_ratio
from curbside.functions.text import format_difference, format_metric
from curbside.operators.bounded import keep_listed
from curbside.operators.shape import first_by, pivot_values, with_share
from curbside.plans.scoping import recent_months
from curbside.scope import DEFAULT_SCOPE, Scope


def metric_dimension(df: DataFrame, scope: Scope = DEFAULT_SCOPE) -> DataFrame:
    """The measurements as a relation: metric, order, label, kind, better side."""
    return df.sparkSession.createDataFrame(
        [(m.name, i, m.label, m.kind, m.better) for i, m in enumerate(scope.metrics)],
        "metric string, metric_order int, label string, kind string, better string",
    )


def describe_metrics(long: DataFrame, scope: Scope = DEFAULT_SCOPE) -> DataFrame:
    """Attach label, kind, better side and order; an unknown metric is an error."""
    known = F.broadcast(metric_dimension(long, scope))  # len(scope.metrics) rows
    unknown = F.raise_error(F.concat(F.lit("unmapped metric: "), F.col("metric")))
    kind = F.when(F.col("kind").isNull(), unknown).otherwise(F.col("kind"))
    return long.join(known, "metric", "left").select(
        *long.columns, "metric_order", "label", kind.alias("kind"), "better"
    )


def compare_platforms(
    kpis: DataFrame,
    platforms: Sequence[str],
    airports: DataFrame | Sequence[str],
    window: int | None = DEFAULT_SCOPE.recent_window_months,
    scope: Scope = DEFAULT_SCOPE,
) -> DataFrame:
    """Airport x measurement rows with one column per platform.

    Trips are summed over the window; every other measurement is the median of its
    monthly values. Two platforms also give ``difference`` (second minus first).
    ``window`` None covers the whole archive.

    Raises:
        ValueError: no platform was given.
    """
    platforms = list(platforms)
    if not platforms:
        raise ValueError("no platform given")
    rows = recent_months(kpis, window).where(
        (F.col("direction") == "pickup") & F.col("platform").isin(*platforms)
    )
    rows = (
        keep_listed(rows, airports, "airport", len(scope.airports))
        if isinstance(airports, DataFrame)
        else rows.where(F.col("airport").isin(*airports))
    )
    measured = [m.name for m in scope.metrics]
    totals = rows.groupBy("airport", "platform").agg(
        *[
            (F.sum(m) if m == "trips" else F.median(m)).cast("double").alias(m)
            for m in measured
        ]
    )
    long = totals.unpivot(["airport", "platform"], measured, "metric", "value")
    wide = pivot_values(long, ["airport", "metric"], "platform", platforms, F.first("value"))
    wide = describe_metrics(wide, scope)
    if len(platforms) == 2:
        wide = wide.withColumn("difference", F.col(platforms[1]) - F.col(platforms[0]))
    return wide.orderBy("airport", "metric_order").drop("metric_order")


def _best(platforms: Sequence[str]) -> Column:
    columns = [F.col(p) for p in platforms]
    better = F.col("better")
    return F.when(better == "high", row_max(columns)).when(better == "low", row_min(columns))


def _first_holder(platforms: Sequence[str], best: Column) -> Column:
    """The earliest platform of the sequence whose value is the best."""
    return F.coalesce(*[F.when(F.col(p) == best, p) for p in platforms], F.lit(None))


def benchmark(comparison: DataFrame, platforms: Sequence[str]) -> DataFrame:
    """Best value per measurement and who holds it; none without a better side.
    Of equal values the platform listed last holds the target."""
    return comparison.withColumn("target", _best(platforms)).withColumn(
        "target_platform", _first_holder(list(reversed(platforms)), F.col("target"))
    )


def lifetime_winners(lifetime: DataFrame, platforms: Sequence[str]) -> DataFrame:
    """Whole-archive matrix with the best platform per row, the first of equals;
    empty where the measurement has no better side."""
    return lifetime.withColumn(
        "winner", F.coalesce(_first_holder(platforms, _best(platforms)), F.lit(""))
    )


def head_to_head(scorecard: DataFrame, duo: Sequence[str]) -> DataFrame:
    """Two-platform scorecard with the leader of each row, the first of equals.
    No better side gives an empty leader, and an unknown value none at all."""
    a, b = F.col(duo[0]), F.col(duo[1])
    first_leads = F.when(F.col("better") == "high", a >= b).otherwise(a <= b)
    leader = F.when(F.col("better") == "", "").otherwise(
        F.when(first_leads, duo[0]).when(~first_leads, duo[1])
    )
    return scorecard.withColumn("leader", leader)


def formatted(scorecard: DataFrame, platforms: Sequence[str]) -> DataFrame:
    """The scorecard as display text."""
    shown = [format_metric(p, "kind").alias(p) for p in platforms]
    if "difference" in scorecard.columns:
        shown.append(format_difference("difference", "kind").alias("difference"))
    kept = [c for c in ("winner", "leader") if c in scorecard.columns]
    return scorecard.select("airport", "label", *shown, *kept)


def duo_payout(
    kpis: DataFrame, duo: Sequence[str], airports: DataFrame, scope: Scope = DEFAULT_SCOPE
) -> DataFrame:
    rows = kpis.where((F.col("direction") == "pickup") & F.col("platform").isin(*duo))
    return (
        by_year(keep_listed(rows, airports, "airport", len(scope.airports)))
        .groupBy("year", "platform")
        .agg(F.median("med_driver_share").alias("payout_share"))
        .orderBy("year", "platform")
    )


def duo_share(
    share: DataFrame, duo: Sequence[str], airports: DataFrame, scope: Scope = DEFAULT_SCOPE
) -> DataFrame:
    """Yearly share at dispatch airports. The denominator is every licensee, so the
    share is computed before the two platforms are selected."""
    totals = (
        by_year(keep_listed(share, airports, "airport", len(scope.airports)))
        .groupBy("year", "platform")
        .agg(F.sum("trips").alias("trips"))
    )
    return (
        with_share(totals, "trips", ["year"])
        .where(F.col("platform").isin(*duo))
        .orderBy("year", "platform")
    )


def duo_result(payout: DataFrame, shares: DataFrame, duo: Sequence[str]) -> DataFrame:
    """One row: when the second platform's payout first exceeded the first's, the
    latest payout of both, and the second's share at first and last year."""
    a, b = duo
    pay = pivot_values(payout, ["year"], "platform", duo, F.first("payout_share"))
    sh = pivot_values(shares, ["year"], "platform", duo, F.first("share"))
    ends = sh.agg(
        F.min("year").alias("first_year"),
        F.min_by(b, "year").alias("share_start"),
        F.max("year").alias("last_year"),
        F.max_by(b, "year").alias("share_end"),
    )
    latest = pay.agg(F.max_by(a, "year").alias("a"), F.max_by(b, "year").alias("b"))
    return ends.withColumns(
        {
            "first_platform": F.lit(a),
            "second_platform": F.lit(b),
            "payout_lead_from": pay.agg(
                F.min(F.when(F.col(b) > F.col(a), F.col("year")))
            ).scalar(),
            "latest_first_payout": latest.select("a").scalar(),
            "latest_second_payout": latest.select("b").scalar(),
        }
    )


def focus_hours(
    hourly: DataFrame, focus: str, airports: DataFrame, scope: Scope = DEFAULT_SCOPE
) -> DataFrame:
    rows = hourly.where(F.col("platform") == focus)
    return (
        keep_listed(rows, airports, "airport", len(scope.airports))
        .select("airport", "hour", "trips", "share_of_day", "incentive_rate")
        .orderBy("airport", "hour")
    )


def target_gaps(scoreboard: DataFrame, focus: str, scope: Scope = DEFAULT_SCOPE) -> DataFrame:
    """Signed gap of one platform to each target, and a mark per row: lead at the
    target, worst at the airport's largest relative gap, else behind. A gap that
    cannot be computed has no mark."""
    target, value = F.col("target"), F.col(focus)
    gap, relative = F.col("gap"), F.col("relative")
    widest = F.max("relative").over(W.partitionBy("airport"))
    return (
        scoreboard.where(F.col("better") != "")
        .withColumn("gap", F.when(F.col("better") == "high", target - value).otherwise(value - target))
        .withColumn("relative", safe_ratio(F.abs(gap), F.abs(target)))
        .withColumn(
            "mark",
            F.when(F.abs(gap) < scope.zero_gap, "lead")
            .when(relative == widest, "worst")
            .when(gap.isNotNull(), "behind"),
        )
        .select(
            "airport",
            "metric",
            "label",
            "kind",
            value.alias("value"),
            "target",
            F.coalesce("target_platform", F.lit("")).alias("held_by"),
            "gap",
            "relative",
            "mark",
        )
    )


def formatted_targets(gaps: DataFrame) -> DataFrame:
    return gaps.select(
        "airport",
        "label",
        *[format_metric(c, "kind").alias(c) for c in ("value", "target", "gap")],
        "held_by",
        "mark",
    )


def night_share(hours: DataFrame, scope: Scope = DEFAULT_SCOPE) -> DataFrame:
    return (
        hours.where(F.col("hour").isin(*scope.night_hours))
        .groupBy("airport")
        .agg(F.sum("share_of_day").alias("night"))
        .orderBy("airport")
    )


def peak_binding_hour(hours: DataFrame) -> DataFrame:
    """Airport and hour with the highest binding rate, the first of equals."""
    return first_by(hours, [F.desc_nulls_last("incentive_rate"), F.asc("airport"), F.asc("hour")])


def metric_value(scoreboard: DataFrame, focus: str, airport: str, metric: str) -> DataFrame:
    """One formatted measurement; "not reported" where the row does not exist."""
    hit = scoreboard.where((F.col("airport") == airport) & (F.col("metric") == metric))
    text = F.max(format_metric(focus, "kind"))
    return hit.agg(F.coalesce(text, F.lit("not reported")).alias("value"))
