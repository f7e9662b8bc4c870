"""Parameters of a market study: zones, licences, thresholds and windows.

Everything the analyses treat as a constant lives on :class:`Scope`, so a study
of other airports or another period is a different ``Scope`` and no code change.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import datetime
from typing import NamedTuple

YearMonth = tuple[int, int]


class Metric(NamedTuple):
    """One row of the scorecard: a monthly_kpis column and how to read it."""

    name: str
    label: str
    kind: str  # count | money | percent | minutes | number
    better: str  # high | low | "" (no better side)


# Scorecard measurements in display order.
METRICS: tuple[Metric, ...] = (
    Metric("trips", "Airport pickups", "count", "high"),
    Metric("med_fare", "Median rider fare", "money", ""),
    Metric("med_driver_gross", "Median driver gross", "money", "high"),
    Metric("med_driver_share", "Driver gross / rider payment", "percent", "high"),
    Metric("med_gross_per_engaged_hour", "Driver gross per engaged hour", "money", "high"),
    Metric("med_fare_per_mile", "Rider fare per mile", "money", ""),
    Metric("med_miles", "Median trip distance (miles)", "number", ""),
    Metric("med_engaged_s", "Median engaged time (minutes)", "minutes", ""),
    Metric("med_curb_wait_s", "Median curb wait (seconds)", "number", "low"),
    Metric("mean_tip", "Mean tip", "money", "high"),
    Metric("incentive_rate", "Minimum-pay binding rate", "percent", ""),
    Metric("pool_request_rate", "Shared-ride request rate", "percent", ""),
)

# Names of the six aggregate tables.
AGGREGATE_TABLES: tuple[str, ...] = (
    "monthly_kpis",
    "market_share",
    "hourly_profile",
    "incentive_breakdown",
    "coverage_timeline",
    "data_quality",
)


@dataclass(frozen=True)
class Scope:
    """All tunable constants, with the default study's values."""

    # Taxi zone -> airport code, licence number -> platform label.
    airports: Mapping[int, str] = field(
        default_factory=lambda: {132: "JFK", 138: "LGA", 1: "EWR"}
    )
    platforms: Mapping[str, str] = field(
        default_factory=lambda: {
            "HV0002": "Juno",
            "HV0003": "Uber",
            "HV0004": "Via",
            "HV0005": "Lyft",
        }
    )
    archive_start: YearMonth = (2019, 2)
    sample_month: YearMonth = (2025, 1)
    min_platform_share: float = 0.005
    active_window_months: int = 12
    min_dispatch_ratio: float = 0.05
    recent_window_months: int = 10
    trail_months: int = 12
    coverage_threshold: float = 0.5
    censoring_fraction: float = 0.5
    min_valid_engaged_s: int = 60
    incentive_share_threshold: float = 1.0
    non_market_directions: tuple[str, ...] = ("transfer", "internal")
    season_from: datetime = datetime(2022, 1, 1)
    recovery_baseline_month: datetime = datetime(2020, 2, 1)
    min_curb_coverage: float = 0.8
    night_hours: tuple[int, ...] = (0, 1, 2, 3, 4)
    zero_gap: float = 1e-9
    metrics: tuple[Metric, ...] = METRICS


DEFAULT_SCOPE = Scope()
