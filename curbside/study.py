"""One study: a trip relation, its six aggregate tables, and the derived scope."""

from __future__ import annotations

from collections.abc import Collection
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from curbside.operators.bounded import settled
from curbside.plans import aggregates, economics, market, scoping
from curbside.scope import AGGREGATE_TABLES, DEFAULT_SCOPE, Scope
from curbside.sources.tables import check_format, read_table, write_tables

#: Order of platform names; the sort columns are resolved when a session runs.
BY_TRIPS = ("trips desc", "platform")


def export_aggregates(
    trips: DataFrame,
    base: str,
    fmt: str = "parquet",
    group_rows: int | None = None,
    names: Collection[str] = AGGREGATE_TABLES,
) -> dict[str, str]:
    """Compute the tables (by default all six) from shared passes and write them; name to path."""
    check_format(fmt)  # before any work
    return write_tables(aggregates.all_tables(trips, group_rows=group_rows, names=names), base, fmt, names)


class Study:
    """Lazily wires aggregate tables to the derived scope lists.

    The scope lists are derived once and settled, as nearly every analysis joins
    them. Everything is a DataFrame except the name lists, which become columns.
    """

    def __init__(self, spark: SparkSession, base: str, scope: Scope = DEFAULT_SCOPE):
        self.spark, self.base, self.scope = spark, base, scope
        self._found: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        """One aggregate table."""
        if name not in self._found:
            self._found[name] = read_table(self.spark, self.base, name)
        return self._found[name]

    @property
    def tables(self) -> dict[str, DataFrame]:
        return {name: self.table(name) for name in AGGREGATE_TABLES}

    kpis = property(lambda self: self.table("monthly_kpis"))
    share = property(lambda self: self.table("market_share"))
    hourly = property(lambda self: self.table("hourly_profile"))
    incentive = property(lambda self: self.table("incentive_breakdown"))
    coverage = property(lambda self: self.table("coverage_timeline"))
    quality = property(lambda self: self.table("data_quality"))

    @cached_property
    def census(self) -> DataFrame:
        return settled(scoping.platform_census(self.coverage))

    @cached_property
    def live(self) -> DataFrame:
        return settled(scoping.active_platforms(self.coverage, scope=self.scope))

    @cached_property
    def airports(self) -> DataFrame:
        return settled(scoping.dispatch_airports(self.kpis, scope=self.scope))

    @cached_property
    def pickups(self) -> DataFrame:
        return economics.pickup_rows(self.kpis, self.live, self.airports, self.scope)

    @cached_property
    def share_year(self) -> DataFrame:
        return market.yearly_share(self.share)

    @cached_property
    def live_names(self) -> list[str]:
        return scoping.names(self.live, "platform", *BY_TRIPS)

    @cached_property
    def census_names(self) -> list[str]:
        return scoping.names(self.census, "platform", *BY_TRIPS)

    @cached_property
    def airport_names(self) -> list[str]:
        return scoping.names(self.airports, "airport", "airport")

    @cached_property
    def duo(self) -> list[str]:
        return scoping.names(scoping.largest_two(self.census, self.live), "platform", *BY_TRIPS)


class ExportingStudy(Study):
    """A study of a trip relation: a table is exported to ``base`` when it is first asked for,
    with those that come from the same scans."""

    def __init__(
        self,
        spark: SparkSession,
        base: str,
        trips: DataFrame,
        scope: Scope = DEFAULT_SCOPE,
        group_rows: int | None = None,
    ):
        super().__init__(spark, base, scope)
        self.trips, self.group_rows = trips, group_rows

    def table(self, name: str) -> DataFrame:
        if name not in self._found:
            (names,) = [scan for scan in aggregates.SHARED_SCANS if name in scan]
            export_aggregates(self.trips, self.base, group_rows=self.group_rows, names=names)
            self._found.update({n: read_table(self.spark, self.base, n) for n in names})
        return self._found[name]
