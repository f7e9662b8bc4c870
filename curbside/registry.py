"""Named queries over a trip relation computed from the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import cached_property, lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curbside.functions import calendar, text, trip
from curbside.operators.medians import grouped
from curbside.plans import aggregates, economics, ingest, market, quality, refresh, scorecard, scoping
from curbside.scope import AGGREGATE_TABLES, Scope
from curbside.sources.files import archived_months, raw_months, raw_path
from curbside.sources.landing import compiled, land, land_by_month, session_folder
from curbside.sources.tables import read_table, write_tables
from curbside.sources.trips import (
    add_ratios,
    derive_trips,
    load_all,
    load_recent,
    normalise_raw,
    read_month,
    read_raw,
    slim_for_storage,
    write_slim,
)
from curbside.study import ExportingStudy, Study
from curbside.trip_relation import RAW_TRIPS_SQL

# Columns of lineitem that a trip is computed from.
LINEITEM_COLUMNS = (
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_shipdate",
)
# The computed trips run from 1995 to 2001, so the calendar parameters differ from
# the default study; every other constant is the default.
SCOPE = Scope(
    archive_start=(1995, 1),
    sample_month=(2000, 6),
    season_from=datetime(1998, 1, 1),
    recovery_baseline_month=datetime(1996, 2, 1),
)
# Digits kept of doubles: finer than any exact decimal in the data, but fewer where
# many doubles are added up or values are large.
DIGITS = 11
OTHER_DIGITS = {
    "med_fare_per_mile": 12,
    "total_topup": 4, "topup_per_trip": 4, "hhi": 6, "mean_tip": 10,
    "med_gross_per_engaged_hour": 9, "gross_per_hour": 9, "med_gross_per_hr": 9,
    "med_gross_per_hr_clean": 9, "gross_per_hr_delta": 9,
}
BOX = ((15.0, 40.0), (20.0, 60.0))
FRAME_MONTH = datetime(2000, 6, 1)


class Source:
    """Raw trips landed from one table folder, and everything built on them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.folder = session_folder(spark, sf_dir)

    @cached_property
    def raw(self) -> DataFrame:
        lineitem = self.spark.read.parquet(f"{self.sf_dir}/lineitem.parquet")
        raw_dir = land(self.spark.sql(RAW_TRIPS_SQL, lineitem=lineitem), self.folder)
        return read_raw(self.spark, raw_dir)

    @cached_property
    def raw_by_month(self) -> DataFrame:
        """Raw trips as they are computed, with their month in ``label``, dealt by month: what is
        dealt are the few columns that trips are computed from. A trip is picked up on its ship
        date."""
        lineitem = self.spark.read.parquet(f"{self.sf_dir}/lineitem.parquet")
        narrow = lineitem.select(*LINEITEM_COLUMNS).withColumn("shipped", F.trunc("l_shipdate", "month"))
        dealt = self.spark.sql(RAW_TRIPS_SQL, lineitem=narrow.hint("rebalance", "shipped").drop("shipped"))
        return normalise_raw(dealt).withColumn("label", F.date_format("pickup_datetime", "yyyy-MM"))

    @property
    def trips(self) -> DataFrame:
        return derive_trips(self.raw, SCOPE)

    @cached_property
    def narrow(self) -> DataFrame:
        """Airport trips with the columns of the six tables, computed and landed once: the scans
        that follow read no other column and compute no trip again."""
        lineitem = self.spark.read.parquet(f"{self.sf_dir}/lineitem.parquet")
        raw = normalise_raw(self.spark.sql(RAW_TRIPS_SQL, lineitem=lineitem))
        trips = derive_trips(raw, SCOPE).select(*aggregates.TRIP_COLUMNS)
        with compiled(self.spark):
            landed = land(trips, self.folder, "narrow")
        return self.spark.read.schema(trips.schema).parquet(landed).withColumns(trip.ratio_columns())

    @property
    def tabled(self) -> DataFrame:
        """The trips of a study: raw files that are landed already, or else narrow trips."""
        return self.trips if "raw" in self.__dict__ else self.narrow

    @property
    def study(self) -> Study:
        return _study(self)

    @property
    def archive(self) -> str:
        return _archive(self)

    @property
    def large_groups(self) -> Study:
        """The six tables of an export that narrows every bracket."""
        return _large_groups(self)

    @property
    def refreshed(self) -> str:
        """The six tables of an archive that grew between two refreshes."""
        return _refreshed(self)

    @property
    def mixed(self) -> str:
        """Monthly raw files whose part files differ in layout within a month."""
        return _mixed(self)

    @property
    def monthly(self) -> str:
        """Monthly raw files, those of odd years in another layout."""
        return _monthly(self)

    @property
    def built(self) -> str:
        """The archive that the build makes of monthly raw files."""
        return _built(self)

    @property
    def built_study(self) -> Study:
        return _built_study(self)


@lru_cache(maxsize=8)
def source(spark: SparkSession, sf_dir: str) -> Source:
    return Source(spark, sf_dir)


@lru_cache(maxsize=8)
def _study(src: Source) -> Study:
    return ExportingStudy(src.spark, f"{src.folder}/tables", src.tabled, SCOPE)


@lru_cache(maxsize=8)
def _archive(src: Source) -> str:
    stamped = derive_trips(ingest.stamp_by_pickup(src.raw_by_month), SCOPE)
    return write_slim(stamped, f"{src.folder}/archive", dealt=True)


@lru_cache(maxsize=8)
def _large_groups(src: Source) -> Study:
    return ExportingStudy(src.spark, f"{src.folder}/tables-large-groups", src.tabled, SCOPE, group_rows=3)


@lru_cache(maxsize=8)
def _refreshed(src: Source) -> str:
    raw, archive, base = src.monthly, f"{src.folder}/built-again", f"{src.folder}/tables-refreshed"
    start, middle = SCOPE.archive_start, SCOPE.sample_month
    ingest.build_archive(src.spark, raw, archive, start=start, end=middle, scope=SCOPE)
    refresh.refresh_aggregates(src.spark, archive, base)
    ingest.build_archive(src.spark, raw, archive, start=start, scope=SCOPE)
    second = refresh.refresh_aggregates(src.spark, archive, base)
    if not second.read or min(second.read) <= middle:
        raise RuntimeError(f"refresh read more than the new months: {second}")
    return base


def _other_layout(raw: DataFrame) -> DataFrame:
    """Raw trips as another writer stores them."""
    return raw.withColumns(
        {
            "PULocationID": F.col("PULocationID").cast("double"),
            "DOLocationID": F.col("DOLocationID").cast("int"),
            "trip_time": F.col("trip_time").cast("decimal(12,0)"),
        }
    )


@lru_cache(maxsize=8)
def _mixed(src: Source) -> str:
    raw = src.raw_by_month
    odd = F.hour("pickup_datetime") % 2 == 1
    folder = f"{src.folder}/mixed"
    parts = [raw.where(~odd), _other_layout(raw.where(odd))]
    return land_by_month(parts, f"{folder}/staged", folder, "label")


@lru_cache(maxsize=8)
def _monthly(src: Source) -> str:
    """Land the trips as monthly files, those of odd years in another layout (as from a
    publisher who changed writers)."""
    raw = src.raw_by_month
    odd = F.year("pickup_datetime") % 2 == 1
    folder = f"{src.folder}/monthly"
    land_by_month([raw.where(~odd)], f"{folder}/even", folder, "label")
    land_by_month([_other_layout(raw.where(odd))], f"{folder}/odd", folder, "label")
    return folder


@lru_cache(maxsize=8)
def _built(src: Source) -> str:
    """Build the archive of monthly files in two runs, the second of which resumes."""
    folder, archive = src.monthly, f"{src.folder}/built"
    first = ingest.build_archive(
        src.spark, folder, archive, start=SCOPE.archive_start, end=SCOPE.sample_month, scope=SCOPE
    )
    rest = ingest.build_archive(src.spark, folder, archive, start=SCOPE.archive_start, scope=SCOPE)
    if first.failed or rest.failed or rest.present != sorted(first.built):
        raise RuntimeError(f"build did not resume: {first}, {rest}")
    return archive


@lru_cache(maxsize=8)
def _built_study(src: Source) -> Study:
    return ExportingStudy(src.spark, f"{src.folder}/built-tables", load_all(src.spark, src.built), SCOPE)


def neat(df: DataFrame) -> DataFrame:
    """Round doubles, so that engines that add in different orders agree."""
    return df.select(
        *[
            F.round(c, OTHER_DIGITS.get(c, DIGITS)).alias(c) if t == "double" else F.col(c)
            for c, t in df.dtypes
        ]
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[Source], DataFrame]) -> Callable[[Source], DataFrame]:
    QUERIES[fn.__name__] = lambda spark, sf_dir: neat(fn(source(spark, sf_dir)))
    return fn


def row_query(fn: Callable[[Source], DataFrame]) -> Callable[[Source], DataFrame]:
    """A query without sums or averages: values are exact, so they are not rounded."""
    QUERIES[fn.__name__] = lambda spark, sf_dir: fn(source(spark, sf_dir))
    return fn


# --- scans, storage, ingest (S) ------------------------------------------------


@row_query
def s1_airport_trips(s: Source) -> DataFrame:
    """Scan, filter and derive: every column of every airport trip."""
    return s.trips


@query
def s2_tolerant_projection(s: Source) -> DataFrame:
    """The same scan over rows that lack the optional fee column."""
    trips = derive_trips(normalise_raw(s.raw.drop("cbd_congestion_fee")), SCOPE)
    return grouped(
        trips,
        ["platform"],
        [F.count(F.lit(1)).alias("trips"), F.count("cbd_congestion_fee").alias("fees")],
        {"med_rider_total": F.col("rider_total_ex_tip")},
    )


@row_query
def s2_mixed_part_files(s: Source) -> DataFrame:
    """Every month in two layouts, file by file."""
    paths = [raw_path(s.mixed, ym) for ym in raw_months(s.spark, s.mixed)]
    return derive_trips(read_raw(s.spark, paths), SCOPE)


@row_query
def s4_slim_slices(s: Source) -> DataFrame:
    return slim_for_storage(s.trips)


@row_query
def s5_restored_ratios(s: Source) -> DataFrame:
    """Slim, then recompute the five dropped money columns from 32-bit storage."""
    return add_ratios(slim_for_storage(s.trips).transform(_widen)).select(
        "pickup_datetime", "airport", "driver_gross", "rider_total_ex_tip", "driver_share",
        "fare_per_mile", "driver_gross_per_engaged_hour",
    )


def _widen(slices: DataFrame) -> DataFrame:
    wide = {"float": "double", "int": "bigint", "smallint": "bigint"}
    return slices.withColumns({c: F.col(c).cast(wide[t]) for c, t in slices.dtypes if t in wide})


@row_query
def s7_archive(s: Source) -> DataFrame:
    """Write partitioned slices, read them all back with wide types and ratios."""
    return load_all(s.spark, s.archive)


@row_query
def s8_read_month(s: Source) -> DataFrame:
    return read_month(s.spark, s.archive, *SCOPE.sample_month)


@query
def s9_read_table(s: Source) -> DataFrame:
    s.study.table("coverage_timeline")  # exported by now
    return read_table(s.spark, s.study.base, "coverage_timeline")


@query
def s10_json_export(s: Source) -> DataFrame:
    base = f"{s.folder}/json"
    write_tables(s.study.tables, base, "json")
    return read_table(s.spark, base, "market_share", "json")


@row_query
def s12_built_archive(s: Source) -> DataFrame:
    """Monthly raw files in mixed layouts, built into the archive and read back."""
    return load_all(s.spark, s.built)


@query
def s13_archive_months(s: Source) -> DataFrame:
    """Months present after a resumed build, with their row counts, from the slices."""
    df = s.spark.read.parquet(s.built)
    return df.groupBy("year", "month").agg(F.count(F.lit(1)).alias("trips"))


@query
def s13_archive_monthly_kpis(s: Source) -> DataFrame:
    """Raw months, slices, six tables: the KPIs at the end of the whole path."""
    return s.built_study.kpis


@query
def s13_archive_market_share(s: Source) -> DataFrame:
    return s.built_study.share


@row_query
def s16_month_rows(s: Source) -> DataFrame:
    """Rows of each raw month, from footers; no column is read."""
    return quality.stored_months(s.spark, s.mixed).select("month", "rows", "faulty")


@query
def s14_months_to_build(s: Source) -> DataFrame:
    """Planned months from a year before the data to a year after, less those present."""
    present = s.raw.select(calendar.month_start("pickup_datetime").alias("month"))
    year = F.expr("interval 1 year")
    bounds = present.agg(
        (F.min("month") - year).alias("first"), (F.max("month") + year).alias("last")
    )
    return ingest.months_to_build(calendar.month_spine(bounds, "first", "last"), present)


@query
def s15_month_labels(s: Source) -> DataFrame:
    """Label check over labels made from the data, good and damaged."""
    month = s.raw.select(F.date_format("pickup_datetime", "yyyy-MM").alias("m")).distinct()
    spoiled = [
        F.col("m"),
        F.concat(F.lit(" 20"), F.substring("m", 3, 5), F.lit(" ")),
        F.concat(F.lit("20"), F.substring("m", 3, 3), F.lit("13")),
        F.replace("m", F.lit("-"), F.lit("/")),
        F.substring("m", 1, 4),
        F.concat(F.col("m"), F.lit("-01")),
        F.concat(F.lit("20"), F.substring("m", 3, 3), F.substring("m", 7, 1)),
    ]
    labels = month.select(F.explode(F.array(*spoiled)).alias("label"))
    return calendar.parse_month_labels(labels, "label")


# --- the six aggregates (G) ----------------------------------------------------


@query
def g1_coverage_timeline(s: Source) -> DataFrame:
    return aggregates.coverage_timeline(s.trips)


@query
def g2_hourly_profile(s: Source) -> DataFrame:
    return aggregates.hourly_profile(s.trips)


@query
def g2_hourly_profile_large_groups(s: Source) -> DataFrame:
    """The same table with every group above 100 trips ranked by narrowing."""
    return aggregates.hourly_profile(s.trips, group_rows=100)


@query
def g2_hourly_profile_all_directions(s: Source) -> DataFrame:
    return aggregates.hourly_profile(s.trips, direction="", valid_only=False)


@query
def g3_incentive_breakdown(s: Source) -> DataFrame:
    return aggregates.incentive_breakdown(s.trips)


@query
def g3_incentive_breakdown_large_groups(s: Source) -> DataFrame:
    """The same table with every group above 30 trips ranked by narrowing."""
    return aggregates.incentive_breakdown(s.trips, group_rows=30)


@query
def g4_monthly_kpis(s: Source) -> DataFrame:
    return aggregates.monthly_kpis(s.trips)


@query
def g4_monthly_kpis_large_groups(s: Source) -> DataFrame:
    """The same table with every group above 30 trips ranked by narrowing."""
    return aggregates.monthly_kpis(s.trips, group_rows=30)


@query
def g5_data_quality(s: Source) -> DataFrame:
    return aggregates.data_quality(s.trips)


@query
def g6_market_share(s: Source) -> DataFrame:
    return aggregates.market_share(s.trips)


def _exported(name: str) -> None:
    QUERIES[f"s11_shared_scan_{name}"] = lambda spark, sf_dir: neat(
        source(spark, sf_dir).study.table(name)
    )


for _name in AGGREGATE_TABLES:
    _exported(_name)


def _exported_with_large_groups(name: str) -> None:
    """The same export where every bracket of over 3 values counts as too large to rank."""
    QUERIES[f"s11_large_groups_{name}"] = lambda spark, sf_dir: neat(
        source(spark, sf_dir).large_groups.table(name)
    )


for _name in AGGREGATE_TABLES:
    _exported_with_large_groups(_name)


def _refreshed_table(name: str) -> None:
    """The tables after a refresh that read only the months added since the first one."""
    QUERIES[f"s11_refreshed_{name}"] = lambda spark, sf_dir: neat(
        read_table(spark, source(spark, sf_dir).refreshed, name)
    )


for _name in AGGREGATE_TABLES:
    _refreshed_table(_name)


# --- expressions and predicates (P, F) -----------------------------------------


@query
def p14_calendar_parts(s: Source) -> DataFrame:
    """Trips by year, calendar month, weekday and hour."""
    t = s.trips
    return t.groupBy(
        F.year("pickup_datetime").alias("year"),
        F.month("pickup_datetime").alias("month_number"),
        calendar.month_label("pickup_datetime").alias("calendar_month"),
        calendar.iso_weekday("pickup_datetime").alias("weekday"),
        F.hour("pickup_datetime").alias("hour"),
    ).agg(F.count(F.lit(1)).alias("trips"))


@query
def p27_formatted_kpis(s: Source) -> DataFrame:
    """Every KPI cell as text, each in its metric's kind."""
    long = s.study.kpis.withColumn("trips", F.col("trips").cast("double")).unpivot(
        aggregates.CELL, [m.name for m in SCOPE.metrics], "metric", "value"
    )
    return scorecard.describe_metrics(long, SCOPE).select(
        *aggregates.CELL, "metric", text.format_metric("value", "kind").alias("shown")
    )


@query
def p28_formatted_differences(s: Source) -> DataFrame:
    """Month-on-month changes of each KPI as signed text."""
    long = s.study.kpis.withColumn("trips", F.col("trips").cast("double")).unpivot(
        aggregates.CELL, [m.name for m in SCOPE.metrics], "metric", "value"
    )
    before = F.lag("value").over(
        W.partitionBy("airport", "platform", "direction", "metric").orderBy("month")
    )
    return scorecard.describe_metrics(
        long.withColumn("change", F.col("value") - before), SCOPE
    ).select(*aggregates.CELL, "metric", text.format_difference("change", "kind").alias("shown"))


@query
def f1_airport_filter(s: Source) -> DataFrame:
    """Raw rows against rows that touch an airport, by licence."""
    return s.raw.groupBy("hvfhs_license_num").agg(
        F.count(F.lit(1)).alias("raw_trips"),
        F.count_if(trip.touches_airport(SCOPE)).alias("airport_trips"),
    )


@query
def f4_clean_trips(s: Source) -> DataFrame:
    clean = quality.clean_trips(s.trips, s.study.live, SCOPE)
    return clean.groupBy("platform", "airport", "direction").agg(F.count(F.lit(1)).alias("trips"))


@row_query
def f5_clean_pickups(s: Source) -> DataFrame:
    clean = quality.clean_trips(s.trips, s.study.live, SCOPE)
    return quality.clean_pickups(clean, s.study.airports, SCOPE).select(
        "pickup_datetime", "airport", "platform", "base_passenger_fare", "driver_share"
    )


@row_query
def f7_recent_trips(s: Source) -> DataFrame:
    """Trips of the last months; only slices that reach into them are scanned."""
    return load_recent(s.spark, s.archive, SCOPE.recent_window_months)


@query
def f7_recent_months(s: Source) -> DataFrame:
    """KPI rows of the scorecard window."""
    return scoping.recent_months(s.study.kpis, SCOPE.recent_window_months).select(
        *aggregates.CELL, "trips"
    )


@query
def f12_pickup_rows(s: Source) -> DataFrame:
    return s.study.pickups


# --- quality and cleaning (Q1-Q15, Q53-Q55) ------------------------------------


@query
def q1_describe(s: Source) -> DataFrame:
    return quality.describe(s.trips, list(quality.PROFILE_COLUMNS))


@query
def q1_describe_large_groups(s: Source) -> DataFrame:
    return quality.describe(s.trips, list(quality.PROFILE_COLUMNS), group_rows=500)


@query
def q2_naive_summary(s: Source) -> DataFrame:
    return quality.airport_platform_summary(s.trips)


@query
def q3_trips_by_direction(s: Source) -> DataFrame:
    return quality.trips_by_direction(s.trips)


@query
def q4_invalid_by_platform(s: Source) -> DataFrame:
    return quality.invalid_by_platform(s.trips)


@query
def q5_on_scene_by_platform(s: Source) -> DataFrame:
    return quality.on_scene_by_platform(s.trips, SCOPE)


@query
def q6_quality_view(s: Source) -> DataFrame:
    return quality.quality_view(s.study.quality)


@query
def q6_quality_of_duo(s: Source) -> DataFrame:
    duo = scoping.largest_two(s.study.census, s.study.live)
    return quality.quality_of(s.study.quality, duo)


@query
def q7_platform_census(s: Source) -> DataFrame:
    return s.study.census


@query
def q8_active_platforms(s: Source) -> DataFrame:
    return s.study.live


@query
def q8_active_platforms_empty_window(s: Source) -> DataFrame:
    """A window that holds no month falls back to the whole archive."""
    return scoping.active_platforms(s.study.coverage, window=0, scope=SCOPE)


@query
def q9_direction_ratio(s: Source) -> DataFrame:
    return scoping.direction_ratio_review(s.study.kpis, SCOPE)


@query
def q9_dispatch_airports(s: Source) -> DataFrame:
    return s.study.airports


@query
def q10_cleaned_summary(s: Source) -> DataFrame:
    return quality.airport_platform_summary(quality.clean_trips(s.trips, s.study.live, SCOPE))


@query
def q10_cleaning_effect(s: Source) -> DataFrame:
    return quality.effect_of_cleaning(s.trips, s.study.live, SCOPE)


@query
def q10_cleaning_effect_of_summaries(s: Source) -> DataFrame:
    """The same from two summaries."""
    naive = quality.airport_platform_summary(s.trips)
    clean = quality.clean_trips(s.trips, s.study.live, SCOPE)
    return quality.cleaning_effect(naive, quality.airport_platform_summary(clean))


@query
def q11_funnel(s: Source) -> DataFrame:
    return quality.funnel(s.trips, s.study.live, s.study.airports, SCOPE)


@row_query
def q12_exploration_frame(s: Source) -> DataFrame:
    return quality.exploration_frame(quality.clean_trips(s.trips, s.study.live, SCOPE))


@query
def q13_hourly_incentive(s: Source) -> DataFrame:
    return quality.hourly_incentive(
        quality.exploration_frame(quality.clean_trips(s.trips, s.study.live, SCOPE))
    )


@query
def q14_analysis_panel(s: Source) -> DataFrame:
    return quality.analysis_panel(s.study.kpis, s.study.live, SCOPE)


@query
def q15_panel_profile(s: Source) -> DataFrame:
    return quality.describe(
        quality.analysis_panel(s.study.kpis, s.study.live, SCOPE),
        list(quality.PANEL_COLUMNS[4:]),
    )


@query
def q15_panel_histogram(s: Source) -> DataFrame:
    return quality.numeric_histogram(
        quality.analysis_panel(s.study.kpis, s.study.live, SCOPE),
        list(quality.PANEL_COLUMNS[4:]),
    )


@query
def q53_headline(s: Source) -> DataFrame:
    st = s.study
    return quality.headline(st.tables, st.census, st.live, st.airports)


@query
def q53_table_inventory(s: Source) -> DataFrame:
    return quality.table_inventory(s.study.tables)


@row_query
def q53_stored_inventory(s: Source) -> DataFrame:
    """The same from the footers of the exported tables."""
    return quality.stored_inventory(s.spark, s.study.base, list(s.study.tables))


@row_query
def q54_stored_span(s: Source) -> DataFrame:
    """The span of the archive, from the footers of its slices."""
    return quality.stored_span(s.spark, s.archive)


@query
def q54_pickup_span(s: Source) -> DataFrame:
    return quality.pickup_span(s.trips)


@query
def q55_quality_review(s: Source) -> DataFrame:
    return quality.quality_review(s.study.quality, SCOPE)


@query
def q55_census_review(s: Source) -> DataFrame:
    return quality.census_review(s.study.census, s.study.live)


# --- market (Q16-Q27) ----------------------------------------------------------


@query
def q16_monthly_volume(s: Source) -> DataFrame:
    return market.monthly_volume(s.study.share, SCOPE)


@query
def q16_volume_summary(s: Source) -> DataFrame:
    return market.volume_summary(market.monthly_volume(s.study.share, SCOPE))


@query
def q17_trough(s: Source) -> DataFrame:
    return market.trough(market.monthly_volume(s.study.share, SCOPE))


@query
def q18_seasonality(s: Source) -> DataFrame:
    return market.seasonality(s.study.share, SCOPE)


@query
def q19_season_extremes(s: Source) -> DataFrame:
    return market.season_extremes(market.seasonality(s.study.share, SCOPE))


@query
def q20_recovery(s: Source) -> DataFrame:
    return market.recovery(s.study.share, SCOPE)


@query
def q21_exits(s: Source) -> DataFrame:
    return market.exits(s.study.census)


@query
def q21_dormant(s: Source) -> DataFrame:
    return market.dormant(s.study.census, s.study.live)


@query
def q22_share_of_all(s: Source) -> DataFrame:
    return market.share_of_all(s.study.share)


@query
def q23_concentration(s: Source) -> DataFrame:
    return market.concentration(s.study.share)


@query
def q23_airports_seen(s: Source) -> DataFrame:
    return market.airports_seen(s.study.share)


@query
def q24_yearly_share(s: Source) -> DataFrame:
    return s.study.share_year


@query
def q25_leadership(s: Source) -> DataFrame:
    return market.leadership(s.study.share_year)


@query
def q25_leadership_view(s: Source) -> DataFrame:
    return market.leadership_view(market.leadership(s.study.share_year))


@query
def q26_handovers(s: Source) -> DataFrame:
    return market.handovers(market.leadership(s.study.share_year))


@query
def q26_current_leaders(s: Source) -> DataFrame:
    return market.current_leaders(market.leadership(s.study.share_year))


@query
def q27_coverage_starts(s: Source) -> DataFrame:
    return market.coverage_starts(s.study.coverage, SCOPE)


@query
def q27_comparable_from(s: Source) -> DataFrame:
    return market.comparable_from(s.study.coverage, SCOPE)


@query
def q27_last_to_report(s: Source) -> DataFrame:
    return market.last_to_report(s.study.coverage, SCOPE)


# --- economics (Q28-Q42) -------------------------------------------------------


@query
def q28_yearly_economics(s: Source) -> DataFrame:
    return economics.yearly_economics(s.study.pickups)


@query
def q29_fare_earnings(s: Source) -> DataFrame:
    return economics.fare_earnings(s.study.pickups)


@query
def q29_trips_in_box(s: Source) -> DataFrame:
    return economics.trips_in_box(economics.fare_earnings(s.study.pickups), *BOX)


@query
def q30_trailing_points(s: Source) -> DataFrame:
    points = economics.fare_earnings(s.study.pickups)
    return economics.trailing_points(points, FRAME_MONTH, scope=SCOPE)


@query
def q30_axis_bounds(s: Source) -> DataFrame:
    return economics.axis_bounds(economics.fare_earnings(s.study.pickups))


def _direction(s: Source) -> DataFrame:
    return economics.direction_economics(s.study.kpis, s.study.live, s.study.airports, SCOPE)


@query
def q31_direction_economics(s: Source) -> DataFrame:
    return _direction(s)


@query
def q31_direction_economics_view(s: Source) -> DataFrame:
    return economics.direction_economics_view(_direction(s))


@query
def q32_direction_differences(s: Source) -> DataFrame:
    return economics.direction_differences(_direction(s))


@query
def q33_same_airport_trips(s: Source) -> DataFrame:
    return economics.same_airport_trips(s.study.kpis)


@query
def q33_same_airport_trips_fallback(s: Source) -> DataFrame:
    """An export without the internal label falls back to transfers."""
    return economics.same_airport_trips(s.study.kpis.where(F.col("direction") != "internal"))


@query
def q34_effective_speed(s: Source) -> DataFrame:
    return economics.effective_speed(s.study.pickups)


@query
def q34_speed_by_airport(s: Source) -> DataFrame:
    return economics.speed_by_airport(
        economics.effective_speed(s.study.pickups), sorted(SCOPE.airports.values())
    )


@query
def q34_speed_change(s: Source) -> DataFrame:
    return economics.speed_change(economics.effective_speed(s.study.pickups))


@query
def q35_indexed_money(s: Source) -> DataFrame:
    return economics.indexed_money(economics.yearly_money(s.study.pickups))


@query
def q36_money_change(s: Source) -> DataFrame:
    return economics.money_change(economics.yearly_money(s.study.pickups))


@query
def q37_hour_shape(s: Source) -> DataFrame:
    return economics.hour_shape(s.study.hourly)


@query
def q38_pool_request_rate(s: Source) -> DataFrame:
    return economics.pool_request_rate(s.study.kpis, s.study.live, SCOPE)


@query
def q39_binding_rate(s: Source) -> DataFrame:
    return economics.binding_rate(s.study.incentive, s.study.live, SCOPE)


@query
def q40_curb_wait(s: Source) -> DataFrame:
    return economics.curb_wait(s.study.pickups, s.study.coverage, SCOPE)


@query
def q40_rounding_suspect(s: Source) -> DataFrame:
    return economics.rounding_suspect(
        economics.curb_wait(s.study.pickups, s.study.coverage, SCOPE)
    )


@query
def q41_incentive_by_airport(s: Source) -> DataFrame:
    return economics.incentive_by_airport(s.study.incentive, s.study.live, SCOPE)


@query
def q41_incentive_view(s: Source) -> DataFrame:
    by_airport = economics.incentive_by_airport(s.study.incentive, s.study.live, SCOPE)
    return economics.incentive_view(by_airport, s.study.airports, SCOPE)


@query
def q42_latest_year_summary(s: Source) -> DataFrame:
    return economics.latest_year_summary(
        economics.yearly_economics(s.study.pickups),
        s.study.share_year,
        economics.incentive_by_airport(s.study.incentive, s.study.live, SCOPE),
    )


# --- scorecard (Q43-Q52) -------------------------------------------------------


def _live_comparison(s: Source) -> DataFrame:
    st = s.study
    return scorecard.compare_platforms(
        st.kpis, st.live_names, st.airports, SCOPE.recent_window_months, SCOPE
    )


def _scoreboard(s: Source) -> DataFrame:
    return scorecard.benchmark(_live_comparison(s), s.study.live_names)


def _lifetime(s: Source) -> DataFrame:
    st = s.study
    matrix = scorecard.compare_platforms(st.kpis, st.census_names, st.airports, None, SCOPE)
    return scorecard.lifetime_winners(matrix, st.census_names)


def _head_to_head(s: Source) -> DataFrame:
    st = s.study
    card = scorecard.compare_platforms(
        st.kpis, st.duo, st.airports, SCOPE.recent_window_months, SCOPE
    )
    return scorecard.head_to_head(card, st.duo)


@query
def q43_compare_platforms(s: Source) -> DataFrame:
    return _live_comparison(s)


@query
def q43_compare_one_platform(s: Source) -> DataFrame:
    return scorecard.compare_platforms(
        s.study.kpis, ["Uber"], sorted(SCOPE.airports.values()), None, SCOPE
    )


@query
def q44_benchmark(s: Source) -> DataFrame:
    return _scoreboard(s)


@query
def q45_lifetime_matrix(s: Source) -> DataFrame:
    return _lifetime(s)


@query
def q46_duo(s: Source) -> DataFrame:
    return scoping.largest_two(s.study.census, s.study.live)


@query
def q46_head_to_head(s: Source) -> DataFrame:
    return _head_to_head(s)


@query
def q47_formatted_scorecard(s: Source) -> DataFrame:
    return scorecard.formatted(_head_to_head(s), s.study.duo)


@query
def q47_formatted_lifetime(s: Source) -> DataFrame:
    return scorecard.formatted(_lifetime(s), s.study.census_names)


@query
def q48_duo_payout(s: Source) -> DataFrame:
    return scorecard.duo_payout(s.study.kpis, s.study.duo, s.study.airports, SCOPE)


@query
def q48_duo_share(s: Source) -> DataFrame:
    return scorecard.duo_share(s.study.share, s.study.duo, s.study.airports, SCOPE)


@query
def q49_duo_result(s: Source) -> DataFrame:
    st = s.study
    return scorecard.duo_result(
        scorecard.duo_payout(st.kpis, st.duo, st.airports, SCOPE),
        scorecard.duo_share(st.share, st.duo, st.airports, SCOPE),
        st.duo,
    )


def _hours(s: Source) -> DataFrame:
    return scorecard.focus_hours(s.study.hourly, s.study.live_names[0], s.study.airports, SCOPE)


@query
def q50_focus_hours(s: Source) -> DataFrame:
    return _hours(s)


@query
def q51_target_gaps(s: Source) -> DataFrame:
    return scorecard.target_gaps(_scoreboard(s), s.study.live_names[0], SCOPE)


@query
def q51_target_gaps_second(s: Source) -> DataFrame:
    """The same targets for the runner-up."""
    return scorecard.target_gaps(_scoreboard(s), s.study.live_names[1], SCOPE)


@query
def q51_formatted_targets(s: Source) -> DataFrame:
    return scorecard.formatted_targets(
        scorecard.target_gaps(_scoreboard(s), s.study.live_names[0], SCOPE)
    )


@query
def q52_night_share(s: Source) -> DataFrame:
    return scorecard.night_share(_hours(s), SCOPE)


@query
def q52_peak_binding_hour(s: Source) -> DataFrame:
    return scorecard.peak_binding_hour(_hours(s))


@query
def q52_metric_value(s: Source) -> DataFrame:
    return scorecard.metric_value(_scoreboard(s), s.study.live_names[0], "JFK", "med_fare")
