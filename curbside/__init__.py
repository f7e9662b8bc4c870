"""Airport trip market analysis on Spark."""

from curbside.functions.calendar import by_year, month_add, months, parse_ym
from curbside.functions.text import format_difference, format_metric
from curbside.plans.aggregates import (
    coverage_timeline,
    data_quality,
    hourly_profile,
    incentive_breakdown,
    market_share,
    monthly_kpis,
)
from curbside.plans.ingest import build_archive, build_month
from curbside.plans.market import leadership
from curbside.plans.quality import describe
from curbside.plans.refresh import refresh_aggregates
from curbside.plans.scorecard import benchmark, compare_platforms
from curbside.plans.scoping import active_platforms, dispatch_airports, platform_census
from curbside.scope import DEFAULT_SCOPE, METRICS, Scope
from curbside.sources.tables import read_table
from curbside.sources.trips import (
    add_ratios,
    load_all,
    read_month,
    scan_airport_trips,
    slim_for_storage,
    write_slim,
)
from curbside.study import Study, export_aggregates

__all__ = [
    "DEFAULT_SCOPE", "METRICS", "Scope", "Study", "active_platforms", "add_ratios", "benchmark",
    "build_archive", "build_month", "by_year", "compare_platforms", "coverage_timeline",
    "data_quality", "describe", "dispatch_airports", "export_aggregates", "format_difference",
    "format_metric", "hourly_profile", "incentive_breakdown", "leadership", "load_all",
    "market_share", "month_add", "monthly_kpis", "months", "parse_ym", "platform_census",
    "read_month", "read_table", "refresh_aggregates", "scan_airport_trips", "slim_for_storage", "write_slim",
]
