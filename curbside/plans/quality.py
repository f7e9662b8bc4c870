"""Profiling, cleaning and the effect of cleaning."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curbside.functions.calendar import iso_weekday
from curbside.functions.numeric import rate, row_count, safe_ratio
from curbside.operators.bounded import keep_listed, small_side
from curbside.operators.medians import grouped
from curbside.operators.shape import DIRECTIONS, pivot_values
from curbside.plans.scoping import max_active
from curbside.scope import AGGREGATE_TABLES, DEFAULT_SCOPE, Scope
from curbside.sources.files import RAW_LABEL, raw_months, raw_path
from curbside.sources.footers import footers, rows_by_path, time_span

# Columns profiled in the raw month.
PROFILE_COLUMNS = (
    "base_passenger_fare", "driver_pay", "tips", "trip_miles", "secs_engaged",
    "secs_request_to_scene", "secs_scene_to_pickup", "driver_share",
    "driver_gross_per_engaged_hour",
)
# Columns of the exploration frame.
EXPLORE_COLUMNS = (
    "airport", "platform", "direction", "pickup_datetime", "base_passenger_fare",
    "driver_pay", "tips", "trip_miles", "secs_engaged", "secs_scene_to_pickup",
    "driver_share", "driver_gross_per_engaged_hour", "likely_incentive",
)
# Columns of the analysis panel.
PANEL_COLUMNS = (
    "month", "airport", "platform", "direction", "trips", "med_fare", "med_driver_gross",
    "med_driver_share", "med_fare_per_mile", "med_gross_per_engaged_hour", "med_miles",
    "med_engaged_s", "mean_tip", "incentive_rate", "pool_request_rate",
)
# The three steps of the cleaning funnel.
FUNNEL_STEPS = ("raw", "valid + live platforms + no transfers", "pickups at dispatch airports")
FAULTS = ("neg_to_scene", "neg_curb_wait", "nonpos_fare", "nonpos_miles")


def describe(df: DataFrame, cols: list[str], *, group_rows: int | None = None) -> DataFrame:
    """Profile numeric columns: dtype, nulls, null share, min, median, max, in the
    caller's order.

    All statistics of all columns come from one aggregate over the frame (medians
    through the size-checked operator); only its single row is unpivoted.
    """
    types = dict(df.dtypes)
    stats = [row_count().alias("rows")]
    for i, c in enumerate(cols):
        v = F.col(c).cast("double")
        stats += [
            F.count_if(v.isNull()).alias(f"nulls_{i}"),
            F.min(v).alias(f"min_{i}"),
            F.max(v).alias(f"max_{i}"),
        ]
    one = grouped(
        df, [], stats, {f"p50_{i}": F.col(c).cast("double") for i, c in enumerate(cols)},
        group_rows=group_rows,
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("rank"),
                F.lit(c).alias("column"),
                F.lit(types[c]).alias("dtype"),
                F.col(f"nulls_{i}").alias("nulls"),
                (F.col(f"nulls_{i}") / F.greatest("rows", F.lit(1))).alias("null_pct"),
                *[F.col(f"{s}_{i}").alias(s) for s in ("min", "p50", "max")],
            )
            for i, c in enumerate(cols)
        ]
    )
    return one.select(F.inline(rows)).orderBy("rank").drop("rank")


def numeric_histogram(
    df: DataFrame, cols: list[str], bins: int = 10
) -> DataFrame:
    """Equal-width bucket counts between each column's own minimum and maximum."""
    ends = df.agg(*[f(c).cast("double").alias(f"{f.__name__}_{c}") for c in cols for f in (F.min, F.max)])
    low = {c: ends.select(f"min_{c}").scalar() for c in cols}
    high = {c: ends.select(f"max_{c}").scalar() for c in cols}

    def bucket(c: str) -> Column:
        width = F.nullif(high[c] - low[c], F.lit(0.0))
        position = F.floor((F.col(c).cast("double") - low[c]) / width * bins)
        return F.least(F.coalesce(position, F.lit(0)), F.lit(bins - 1)).cast("int")

    cells = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.when(F.col(c).isNotNull(), bucket(c)).alias("bin"))
            for c in cols
        ]
    )
    return df.select(F.inline(cells)).groupBy("column", "bin").agg(row_count().alias("rows"))


def airport_platform_summary(trips: DataFrame, *, group_rows: int | None = None) -> DataFrame:
    """Trips and three medians by airport and platform."""
    return grouped(
        trips,
        ["airport", "platform"],
        [row_count().alias("trips")],
        {
            "med_driver_share": F.col("driver_share"),
            "med_gross_per_hr": F.col("driver_gross_per_engaged_hour"),
            "med_curb_wait_s": F.col("secs_scene_to_pickup"),
        },
        group_rows=group_rows,
    )


def trips_by_direction(trips: DataFrame) -> DataFrame:
    """Trips per airport with one column per direction."""
    return pivot_values(trips, ["airport"], "direction", DIRECTIONS, row_count())


def invalid_by_platform(trips: DataFrame) -> DataFrame:
    """Invalid rows per platform, largest platform first, worst rate marked."""
    rates = trips.groupBy("platform").agg(
        row_count().alias("trips"), F.count_if(~F.col("is_valid")).alias("invalid")
    ).withColumn("invalid_rate", F.col("invalid") / F.col("trips"))
    worst = rates.agg(F.max("invalid_rate")).scalar()
    return rates.withColumn(
        "mark", F.when(F.col("invalid_rate") == worst, "worst").otherwise("")
    ).orderBy(F.desc("trips"), "platform")


def on_scene_by_platform(trips: DataFrame, scope: Scope = DEFAULT_SCOPE) -> DataFrame:
    """On-scene coverage per platform, best first, marked against the threshold."""
    return (
        trips.groupBy("platform")
        .agg(row_count().alias("trips"), rate("has_on_scene").alias("coverage"))
        .withColumn("mark", _coverage_mark("coverage", scope))
        .orderBy(F.desc("coverage"), "platform")
    )


def _coverage_mark(c: str, scope: Scope) -> Column:
    return F.when(F.col(c) < scope.coverage_threshold, "behind").otherwise("lead")


def quality_view(quality: DataFrame) -> DataFrame:
    """The data_quality table with rounded rates, largest platform first."""
    return (
        quality.withColumn("invalid_rate", F.round(F.col("invalid_rows") / F.col("trips"), 4))
        .select(
            "platform",
            "trips",
            F.round("on_scene_coverage", 4).alias("on_scene_coverage"),
            "invalid_rate",
            *FAULTS,
            F.round("incentive_rate", 4).alias("incentive_rate"),
        )
        .orderBy(F.desc("trips"), "platform")
    )


def quality_review(quality: DataFrame, scope: Scope = DEFAULT_SCOPE) -> DataFrame:
    """Quality view with one mark column per reviewed measurement."""
    view = quality_view(quality)
    worst = view.agg(F.max("invalid_rate")).scalar()
    return view.withColumns(
        {
            **{f"{c}_mark": F.when(F.col(c) > 0, "behind").otherwise("") for c in FAULTS},
            "invalid_rate_mark": F.when(F.col("invalid_rate") == worst, "worst").otherwise(""),
            "on_scene_coverage_mark": _coverage_mark("on_scene_coverage", scope),
        }
    )


def quality_of(quality: DataFrame, platforms: DataFrame) -> DataFrame:
    """Quality view of some platforms, as data sources."""
    return keep_listed(quality_view(quality), platforms, "platform").drop("incentive_rate")


def census_review(census: DataFrame, live: DataFrame) -> DataFrame:
    """The census with live platforms marked."""
    listed = live.select("platform", F.lit("lead").alias("mark"))
    return census.join(listed, "platform", "left").select(
        "platform",
        "trips",
        "first_month",
        "last_month",
        "months_active",
        F.round("lifetime_share", 5).alias("lifetime_share"),
        F.coalesce("mark", F.lit("")).alias("mark"),
    )


def clean_trips(trips: DataFrame, live: DataFrame, scope: Scope = DEFAULT_SCOPE) -> DataFrame:
    """Valid trips of live platforms in a market direction."""
    return keep_listed(
        trips.where(F.col("is_valid") & ~F.col("direction").isin(*scope.non_market_directions)),
        live,
        "platform",
        max_active(scope),
    )


def clean_pickups(clean: DataFrame, airports: DataFrame, scope: Scope = DEFAULT_SCOPE) -> DataFrame:
    return keep_listed(
        clean.where(F.col("direction") == "pickup"), airports, "airport", len(scope.airports)
    )


def funnel(
    trips: DataFrame, live: DataFrame, airports: DataFrame, scope: Scope = DEFAULT_SCOPE
) -> DataFrame:
    """Rows left after each cleaning step, counted in one pass over the trips.

    Trips are first counted per (platform, airport, direction, validity), so the
    list joins run on that small table instead of on trips.
    """
    cells = trips.groupBy("platform", "airport", "direction", "is_valid").agg(
        row_count().alias("n")
    )
    in_list = lambda listed, c, flag: listed.select(c, F.lit(True).alias(flag))
    marked = cells.join(in_list(live, "platform", "is_live"), "platform", "left").join(
        in_list(airports, "airport", "dispatched"), "airport", "left"
    )
    kept = (
        F.col("is_valid")
        & F.col("is_live").isNotNull()
        & ~F.col("direction").isin(*scope.non_market_directions)
    )
    picked = kept & (F.col("direction") == "pickup") & F.col("dispatched").isNotNull()
    zero = F.lit(0).cast("bigint")
    sums = marked.agg(
        *[
            F.coalesce(F.sum(F.when(test, F.col("n"))), zero).alias(name)
            for test, name in ((F.lit(True), "s0"), (kept, "s1"), (picked, "s2"))
        ]
    )
    steps = F.array(
        *[
            F.struct(
                F.lit(step).alias("step"),
                F.col(f"s{i}").alias("rows"),
                safe_ratio(f"s{i}", "s0").alias("share_of_raw"),
            )
            for i, step in enumerate(FUNNEL_STEPS)
        ]
    )
    return sums.select(F.inline(steps))


def cleaning_effect(naive: DataFrame, cleaned: DataFrame) -> DataFrame:
    """Summary before and after cleaning, with signed differences."""
    after = cleaned.select(
        "airport",
        "platform",
        F.col("trips").alias("trips_clean"),
        F.col("med_gross_per_hr").alias("med_gross_per_hr_clean"),
    )
    return _effect(naive.join(after, ["airport", "platform"], "inner"))


def _effect(both: DataFrame) -> DataFrame:
    """Figures before and after with their differences."""
    return both.select(
        "airport",
        "platform",
        "trips",
        "trips_clean",
        (F.col("trips_clean") - F.col("trips")).alias("trips_delta"),
        "med_gross_per_hr",
        "med_gross_per_hr_clean",
        (F.col("med_gross_per_hr_clean") - F.col("med_gross_per_hr")).alias("gross_per_hr_delta"),
    ).orderBy("airport", "platform")


def effect_of_cleaning(
    trips: DataFrame, live: DataFrame, scope: Scope = DEFAULT_SCOPE, *, group_rows: int | None = None
) -> DataFrame:
    """:func:`cleaning_effect` of :func:`clean_trips`, from one group-by instead of two: a trip
    that cleaning drops counts for the figures before it only."""
    listed = small_side(live.select("platform", F.lit(True).alias("__live")), max_active(scope))
    market = ~F.col("direction").isin(*scope.non_market_directions)
    kept = F.coalesce(F.col("is_valid") & market & F.col("__live"), F.lit(False))
    per_hour = F.col("driver_gross_per_engaged_hour")
    both = grouped(
        trips.join(listed, "platform", "left"),
        ["airport", "platform"],
        [row_count().alias("trips"), F.count_if(kept).alias("trips_clean")],
        {"med_gross_per_hr": per_hour, "med_gross_per_hr_clean": F.when(kept, per_hour)},
        group_rows=group_rows,
    ).where("trips_clean > 0 and airport is not null")
    return _effect(both)


def exploration_frame(clean: DataFrame) -> DataFrame:
    return clean.select(
        *EXPLORE_COLUMNS,
        F.hour("pickup_datetime").alias("hour"),
        iso_weekday("pickup_datetime").alias("weekday"),
    )


def hourly_incentive(explore: DataFrame) -> DataFrame:
    """Share of pickups paid above the rider total, by airport and hour."""
    return (
        explore.where(F.col("direction") == "pickup")
        .groupBy("airport", "hour")
        .agg(row_count().alias("trips"), rate("likely_incentive").alias("incentive_rate"))
        .orderBy("airport", "hour")
    )


def analysis_panel(kpis: DataFrame, live: DataFrame, scope: Scope = DEFAULT_SCOPE) -> DataFrame:
    """KPI rows of live platforms in market directions, 15 columns."""
    return keep_listed(
        kpis.where(~F.col("direction").isin(*scope.non_market_directions)),
        live,
        "platform",
        max_active(scope),
    ).select(*PANEL_COLUMNS)


def pickup_span(trips: DataFrame) -> DataFrame:
    return trips.agg(
        F.min("pickup_datetime").alias("first_pickup"), F.max("pickup_datetime").alias("last_pickup")
    )


def headline(
    tables: dict[str, DataFrame], census: DataFrame, live: DataFrame, airports: DataFrame
) -> DataFrame:
    """One row: size of the study. Each figure is a one-row scalar subquery."""
    count = lambda df: df.agg(row_count()).scalar()
    rows = reduce(lambda a, b: a + b, [count(df) for df in tables.values()])
    names = airports.agg(F.concat_ws(", ", F.sort_array(F.collect_list("airport")))).scalar()
    return tables["market_share"].agg(
        F.sum("trips").alias("trips"),
        F.count_distinct("month").alias("months"),
        F.min("month").alias("first_month"),
        F.max("month").alias("last_month"),
    ).withColumns(
        {
            "airports": tables["monthly_kpis"].agg(F.count_distinct("airport")).scalar(),
            "dispatch_airports": names,
            "licensees": count(census),
            "live_platforms": count(live),
            "aggregate_rows": rows,
            "tables": F.lit(len(tables)),
        }
    )


def table_inventory(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows and columns of each aggregate table."""
    parts = [
        df.agg(row_count().alias("rows")).select(
            F.lit(name).alias("table"), "rows", F.lit(len(df.columns)).alias("cols")
        )
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def stored_inventory(spark: SparkSession, base: str, names: Sequence[str] = AGGREGATE_TABLES) -> DataFrame:
    """:func:`table_inventory` of exported Parquet tables, from their footers alone."""
    found = footers(spark, [f"{base}/{name}" for name in names])
    return found.groupBy(F.element_at(F.split("path", "/"), -1).alias("table")).agg(
        F.sum("rows").alias("rows"), F.max(F.size("columns")).alias("cols")
    )


def stored_span(spark: SparkSession, archive: str) -> DataFrame:
    """:func:`pickup_span` of an archive, from the footers of its slices."""
    return time_span(spark, [archive], "pickup_datetime").select(
        F.col("first").alias("first_pickup"), F.col("last").alias("last_pickup")
    )


def stored_months(spark: SparkSession, raw_dir: str) -> DataFrame:
    """Files and rows of each raw month, and files that cannot be read, from footers alone."""
    months = raw_months(spark, raw_dir)
    found = rows_by_path(spark, [raw_path(raw_dir, ym) for ym in months])
    label = F.regexp_extract("path", RAW_LABEL, 1)
    return found.select(
        F.to_timestamp_ntz(F.concat(label, F.lit("-01"))).alias("month"), "files", "faulty", "rows"
    )
