"""One DuckDB statement per registered query."""

from __future__ import annotations

from oracle.relations import difference_text, gaps, metric_text, statement

# Digits kept of doubles. Eleven is finer than any exact decimal the test rows give,
# so rounding never meets a tie; sums of many doubles and large values keep fewer.
DIGITS = 11
OTHER_DIGITS = {
    "med_fare_per_mile": 12,
    "total_topup": 4, "topup_per_trip": 4, "hhi": 6, "mean_tip": 10,
    "med_gross_per_engaged_hour": 9, "gross_per_hour": 9, "med_gross_per_hr": 9,
    "med_gross_per_hr_clean": 9, "gross_per_hr_delta": 9,
}


def _neat(body: str, doubles: str = "") -> str:
    """Round the named double columns of a statement."""
    parts = [f"round({c}, {OTHER_DIGITS.get(c, DIGITS)}) as {c}" for c in doubles.split()]
    if not parts:
        return statement(body)
    return statement(f"select * replace ({', '.join(parts)}) from ({body}) neat")


MONEY = (
    "trip_miles base_passenger_fare tolls bcf sales_tax congestion_surcharge airport_fee tips "
    "driver_pay cbd_congestion_fee"
)
RATIOS = (
    "driver_gross rider_total_ex_tip driver_share fare_per_mile driver_gross_per_engaged_hour"
)
KPI = (
    "med_fare med_driver_gross med_driver_share med_fare_per_mile med_gross_per_engaged_hour "
    "med_engaged_s med_curb_wait_s curb_wait_coverage med_miles pool_request_rate "
    "pool_match_rate incentive_rate mean_tip"
)
PANEL = (
    "med_fare med_driver_gross med_driver_share med_fare_per_mile med_gross_per_engaged_hour "
    "med_miles med_engaged_s mean_tip incentive_rate pool_request_rate"
)
HOURLY = (
    "med_fare med_gross_per_engaged_hour med_driver_share incentive_rate med_curb_wait_s "
    "curb_wait_coverage"
)
INCENTIVE = "incentive_rate med_topup med_share_when_incentivised topup_per_trip"
SUMMARY = """select airport, platform, count(*) as trips,
    median(driver_share) as med_driver_share,
    median(driver_gross_per_engaged_hour) as med_gross_per_hr,
    median(secs_scene_to_pickup) as med_curb_wait_s"""
SUMMARY_DOUBLES = "med_driver_share med_gross_per_hr med_curb_wait_s"
SLICE = f"""pickup_datetime, PULocationID, DOLocationID, trip_time, secs_request_to_scene,
    secs_scene_to_pickup, secs_engaged, {MONEY.replace(' ', ', ')}, platform, airport, direction,
    has_on_scene, pool_requested, pool_matched, likely_incentive, is_valid"""
RESTORED = f"{SLICE}, {RATIOS.replace(' ', ', ')}"


def _profile(relation: str, columns: list[tuple[str, str]]) -> str:
    return " union all ".join(
        f"""select '{c}' as "column", '{t}' as dtype,
          (count(*) - count({c}))::bigint as nulls,
          (count(*) - count({c})) / greatest(count(*), 1) as null_pct,
          min({c})::double as min, median({c})::double as p50, max({c})::double as max
        from {relation}"""
        for c, t in columns
    )


PROFILE = [
    ("base_passenger_fare", "double"), ("driver_pay", "double"), ("tips", "double"),
    ("trip_miles", "double"), ("secs_engaged", "bigint"), ("secs_request_to_scene", "bigint"),
    ("secs_scene_to_pickup", "bigint"), ("driver_share", "double"),
    ("driver_gross_per_engaged_hour", "double"),
]
PANEL_ROWS = """(select * from kpis where direction in ('pickup', 'dropoff')
    and platform in (select platform from live)) p"""
PANEL_TYPES = [("trips", "bigint")] + [(c, "double") for c in PANEL.split()]
PROFILE_DOUBLES = "null_pct min p50 max"


def _histogram(column: str) -> str:
    return f"""select '{column}' as "column",
        case when {column} is not null then least(coalesce(floor(({column}::double - lo)
          / nullif(hi - lo, 0) * 10), 0), 9)::int end as bin, count(*) as rows
      from {PANEL_ROWS}, (select min({column})::double as lo, max({column})::double as hi
        from {PANEL_ROWS}) ends group by all"""


QUALITY_VIEW = """select platform, trips, round(on_scene_coverage, 4) as on_scene_coverage,
    round(invalid_rows / trips, 4) as invalid_rate, neg_to_scene, neg_curb_wait, nonpos_fare,
    nonpos_miles, round(incentive_rate, 4) as incentive_rate from quality"""
LABELS = """select unnest([m, ' 20' || substr(m, 3, 5) || ' ', '20' || substr(m, 3, 3) || '13',
    replace(m, '-', '/'), substr(m, 1, 4), m || '-01',
    '20' || substr(m, 3, 3) || substr(m, 7, 1)]) as label
  from (select distinct strftime(pickup_datetime, '%Y-%m') as m from raw) x"""
TABLES = {
    "monthly_kpis": ("kpis", KPI),
    "market_share": ("share", "share"),
    "hourly_profile": ("hourly", f"{HOURLY} share_of_day"),
    "incentive_breakdown": ("incentive", f"{INCENTIVE} total_topup"),
    "coverage_timeline": ("coverage", "on_scene_coverage"),
    "data_quality": ("quality", "on_scene_coverage incentive_rate"),
}


def _table(name: str) -> str:
    relation, doubles = TABLES[name]
    return _neat(f"select * from {relation}", doubles)


_ROWS = " + ".join(f"(select count(*) from {r})" for r, _ in TABLES.values())

STATEMENTS: dict[str, str] = {
    "s1_airport_trips": statement("select * exclude (month, hour) from trips"),
    "s2_tolerant_projection": _neat(
        """select platform, count(*) as trips, 0::bigint as fees,
             median(ifnull(base_passenger_fare, 0) + ifnull(tolls, 0) + ifnull(bcf, 0)
               + ifnull(sales_tax, 0) + ifnull(congestion_surcharge, 0)
               + ifnull(airport_fee, 0)) as med_rider_total
           from trips group by platform""",
        "med_rider_total",
    ),
    "s2_mixed_part_files": statement("select * exclude (month, hour) from trips"),
    "s4_slim_slices": statement(
        "select " + SLICE.replace("PULocationID, DOLocationID", "PULocationID::smallint as PULocationID, DOLocationID::smallint as DOLocationID")
        .replace("trip_time,", "trip_time::int as trip_time,")
        .replace("secs_request_to_scene,", "secs_request_to_scene::int as secs_request_to_scene,")
        .replace("secs_scene_to_pickup,", "secs_scene_to_pickup::int as secs_scene_to_pickup,")
        .replace("secs_engaged,", "secs_engaged::int as secs_engaged,")
        .replace(MONEY.replace(" ", ", "), ", ".join(f"{c}::real as {c}" for c in MONEY.split()))
        + " from trips"
    ),
    "s5_restored_ratios": statement(
        f"select pickup_datetime, airport, {RATIOS.replace(' ', ', ')} from restored"
    ),
    "s7_archive": statement(f"select {RESTORED} from restored"),
    "s8_read_month": statement(
        f"""select {RESTORED} from restored
            where pickup_datetime >= timestamp '2000-06-01'
              and pickup_datetime < timestamp '2000-07-01'"""
    ),
    "s9_read_table": _table("coverage_timeline"),
    "s10_json_export": _table("market_share"),
    "s12_built_archive": statement(f"select {RESTORED} from restored"),
    "s13_archive_monthly_kpis": _neat("select * from archive_kpis", KPI),
    "s13_archive_market_share": _table("market_share"),
    "s13_archive_months": statement(
        """select year(pickup_datetime)::int as year, month(pickup_datetime)::int as month,
             count(*) as trips from trips group by all"""
    ),
    "s16_month_rows": statement(
        """select date_trunc('month', pickup_datetime)::timestamp as month, count(*)::bigint as rows,
             0::bigint as faulty from raw group by all"""
    ),
    "s14_months_to_build": statement(
        """select month::timestamp as month from (
             select unnest(generate_series(date_trunc('month', min(pickup_datetime))::timestamp
               - interval 1 year, date_trunc('month', max(pickup_datetime))::timestamp
               + interval 1 year, interval 1 month)) as month from raw) spine
           where month not in (select date_trunc('month', pickup_datetime)::timestamp from raw)"""
    ),
    "s15_month_labels": statement(
        f"""select label, case when error is null then y end as year,
             case when error is null then m end as month, error
           from (select *, case when y is null then 'not YYYY-MM'
                   when m not between 1 and 12 then 'month out of range'
                   when y not between 2019 and 2100 then 'year out of range' end as error
                 from (select label,
                   case when regexp_full_match(trim(label), '[0-9]+-[0-9]+')
                     then split_part(trim(label), '-', 1)::int end as y,
                   case when regexp_full_match(trim(label), '[0-9]+-[0-9]+')
                     then split_part(trim(label), '-', 2)::int end as m
                   from ({LABELS}) l) p) q"""
    ),
    "g1_coverage_timeline": _table("coverage_timeline"),
    "g2_hourly_profile": _table("hourly_profile"),
    "g2_hourly_profile_all_directions": _neat(
        """select *, trips / sum(trips) over (partition by airport, platform) as share_of_day
           from (select airport, platform, hour, count(*) as trips,
                   median(base_passenger_fare) as med_fare,
                   median(driver_gross_per_engaged_hour) as med_gross_per_engaged_hour,
                   median(driver_share) as med_driver_share,
                   avg(likely_incentive::int) as incentive_rate,
                   median(secs_scene_to_pickup) as med_curb_wait_s,
                   avg(has_on_scene::int) as curb_wait_coverage
                 from trips group by all) x""",
        f"{HOURLY} share_of_day",
    ),
    "g2_hourly_profile_large_groups": _table("hourly_profile"),
    "g3_incentive_breakdown": _table("incentive_breakdown"),
    "g3_incentive_breakdown_large_groups": _table("incentive_breakdown"),
    "g4_monthly_kpis": _table("monthly_kpis"),
    "g4_monthly_kpis_large_groups": _table("monthly_kpis"),
    "g5_data_quality": _table("data_quality"),
    "g6_market_share": _table("market_share"),
    **{f"s11_shared_scan_{name}": _table(name) for name in TABLES},
    **{f"s11_large_groups_{name}": _table(name) for name in TABLES},
    **{
        f"s11_refreshed_{name}": _neat(
            f"select * from {'archive_' if relation in ('kpis', 'hourly', 'incentive') else ''}{relation}",
            doubles,
        )
        for name, (relation, doubles) in TABLES.items()
    },
    "p14_calendar_parts": statement(
        """select year(pickup_datetime)::int as year, month(pickup_datetime)::int as month_number,
             strftime(pickup_datetime, '%b') as calendar_month,
             isodow(pickup_datetime)::int as weekday, hour, count(*) as trips
           from trips group by all"""
    ),
    "p27_formatted_kpis": statement(
        f"""select month, airport, platform, direction, metric, {metric_text('value')} as shown
            from kpi_long join metrics using (metric)"""
    ),
    "p28_formatted_differences": statement(
        f"""select month, airport, platform, direction, metric,
              {difference_text('change')} as shown
            from (select *, value - lag(value) over (
                    partition by airport, platform, direction, metric order by month) as change
                  from kpi_long) c join metrics using (metric)"""
    ),
    "f1_airport_filter": statement(
        """select hvfhs_license_num, count(*) as raw_trips,
             count(*) filter (where PULocationID in (132, 138, 1) or DOLocationID in (132, 138, 1))
               as airport_trips
           from raw group by all"""
    ),
    "f4_clean_trips": statement(
        "select platform, airport, direction, count(*) as trips from clean group by all"
    ),
    "f5_clean_pickups": statement(
        """select pickup_datetime, airport, platform, base_passenger_fare, driver_share from clean
           where direction = 'pickup' and airport in (select airport from dispatch)"""
    ),
    "f7_recent_trips": statement(
        f"""select {RESTORED} from restored
            where pickup_datetime >= (select date_trunc('month', max(pickup_datetime))::timestamp
              from restored) - interval 9 month"""
    ),
    "f7_recent_months": statement(
        """select month, airport, platform, direction, trips from kpis
           where month > (select max(month) from kpis) - interval 10 month"""
    ),
    "f12_pickup_rows": _neat("select * from pickups", KPI),
    "q1_describe": _neat(_profile("trips", PROFILE), PROFILE_DOUBLES),
    "q1_describe_large_groups": _neat(_profile("trips", PROFILE), PROFILE_DOUBLES),
    "q2_naive_summary": _neat(f"{SUMMARY} from trips group by all", SUMMARY_DOUBLES),
    "q3_trips_by_direction": statement(
        "select airport, "
        + ", ".join(
            f"nullif(count(*) filter (where direction = '{d}'), 0) as {d}"
            for d in ("pickup", "dropoff", "transfer", "internal")
        )
        + " from trips group by airport"
    ),
    "q4_invalid_by_platform": _neat(
        """select *, case when invalid_rate = max(invalid_rate) over () then 'worst' else '' end
             as mark
           from (select platform, count(*) as trips, count(*) filter (where not is_valid)
                   as invalid, count(*) filter (where not is_valid) / count(*) as invalid_rate
                 from trips group by platform) x""",
        "invalid_rate",
    ),
    "q5_on_scene_by_platform": _neat(
        """select *, case when coverage < 0.5e0 then 'behind' else 'lead' end as mark
           from (select platform, count(*) as trips, avg(has_on_scene::int) as coverage
                 from trips group by platform) x""",
        "coverage",
    ),
    "q6_quality_view": statement(QUALITY_VIEW),
    "q6_quality_of_duo": statement(
        f"""select * exclude (incentive_rate) from ({QUALITY_VIEW}) v where platform in (
              select platform from census where platform in (select platform from live)
              order by trips desc limit 2)"""
    ),
    "q7_platform_census": _neat("select * from census", "lifetime_share"),
    "q8_active_platforms": _neat("select * from live", "share"),
    "q8_active_platforms_empty_window": _neat(
        """select * from (select platform, sum(trips)::bigint as trips,
             sum(trips) / (select sum(trips) from coverage) as share
           from coverage group by platform) x where share >= 0.005""",
        "share",
    ),
    "q9_direction_ratio": statement(
        """select airport, pickup, dropoff, round(pickups_per_dropoff, 6) as pickups_per_dropoff,
             case when pickups_per_dropoff < 0.05 then 'behind' else 'lead' end as mark
           from direction_ratio"""
    ),
    "q9_dispatch_airports": statement("select airport from dispatch"),
    "q10_cleaned_summary": _neat(f"{SUMMARY} from clean group by all", SUMMARY_DOUBLES),
    "q10_cleaning_effect": (EFFECT := _neat(
        f"""select n.airport, n.platform, n.trips, c.trips as trips_clean,
              c.trips - n.trips as trips_delta, n.med_gross_per_hr,
              c.med_gross_per_hr as med_gross_per_hr_clean,
              c.med_gross_per_hr - n.med_gross_per_hr as gross_per_hr_delta
            from ({SUMMARY} from trips group by all) n
            join ({SUMMARY} from clean group by all) c using (airport, platform)""",
        "med_gross_per_hr med_gross_per_hr_clean gross_per_hr_delta",
    )),
    "q10_cleaning_effect_of_summaries": EFFECT,
    "q11_funnel": _neat(
        """select step, rows, rows / nullif((select count(*) from trips), 0) as share_of_raw from (
             select 'raw' as step, count(*) as rows from trips
             union all select 'valid + live platforms + no transfers', count(*) from clean
             union all select 'pickups at dispatch airports', count(*) from clean
               where direction = 'pickup' and airport in (select airport from dispatch)) x""",
        "share_of_raw",
    ),
    "q12_exploration_frame": statement(
        """select airport, platform, direction, pickup_datetime, base_passenger_fare, driver_pay,
             tips, trip_miles, secs_engaged, secs_scene_to_pickup, driver_share,
             driver_gross_per_engaged_hour, likely_incentive, hour,
             isodow(pickup_datetime)::int as weekday
           from clean"""
    ),
    "q13_hourly_incentive": _neat(
        """select airport, hour, count(*) as trips, avg(likely_incentive::int) as incentive_rate
           from clean where direction = 'pickup' group by all""",
        "incentive_rate",
    ),
    "q14_analysis_panel": _neat(
        f"""select month, airport, platform, direction, trips, {PANEL.replace(' ', ', ')}
            from {PANEL_ROWS}""",
        PANEL,
    ),
    "q15_panel_profile": _neat(_profile(PANEL_ROWS, PANEL_TYPES), PROFILE_DOUBLES),
    "q15_panel_histogram": statement(
        " union all ".join(f"select * from ({_histogram(c)}) x" for c, _ in PANEL_TYPES)
    ),
    "q53_headline": statement(
        f"""select sum(trips)::bigint as trips, count(distinct month) as months,
              min(month) as first_month, max(month) as last_month,
              (select count(distinct airport) from kpis) as airports,
              (select string_agg(airport, ', ' order by airport) from dispatch)
                as dispatch_airports,
              (select count(*) from census) as licensees,
              (select count(*) from live) as live_platforms,
              {_ROWS} as aggregate_rows, 6::int as tables
            from share"""
    ),
    "q53_table_inventory": (INVENTORY := statement(
        " union all ".join(
            f"""select '{name}' as "table", count(*) as rows, {cols}::int as cols
            from {TABLES[name][0]}"""
            for name, cols in (
                ("monthly_kpis", 18), ("market_share", 5), ("hourly_profile", 11),
                ("incentive_breakdown", 11), ("coverage_timeline", 4), ("data_quality", 9),
            )
        )
    )),
    "q53_stored_inventory": INVENTORY,
    "q54_pickup_span": (SPAN := statement(
        """select min(pickup_datetime) as first_pickup, max(pickup_datetime) as last_pickup
           from trips"""
    )),
    "q54_stored_span": SPAN,
    "q55_quality_review": statement(
        "select *, "
        + ", ".join(
            f"case when {c} > 0 then 'behind' else '' end as {c}_mark"
            for c in ("neg_to_scene", "neg_curb_wait", "nonpos_fare", "nonpos_miles")
        )
        + f""", case when invalid_rate = max(invalid_rate) over () then 'worst' else '' end
              as invalid_rate_mark,
            case when on_scene_coverage < 0.5e0 then 'behind' else 'lead' end
              as on_scene_coverage_mark
            from ({QUALITY_VIEW}) v"""
    ),
    "q55_census_review": statement(
        """select platform, trips, first_month, last_month, months_active,
             round(lifetime_share, 5) as lifetime_share,
             case when platform in (select platform from live) then 'lead' else '' end as mark
           from census"""
    ),
    "q16_monthly_volume": statement("select * from volume"),
    "q16_volume_summary": _neat(
        """select min(month) as first_month, max(month) as last_month, count(*) as months,
             median(trips) as median_trips, count(*) filter (where censored) as censored_months,
             max(month) filter (where not censored) as reliable_end
           from volume""",
        "median_trips",
    ),
    "q17_trough": _neat(
        """select month, trips, trips / (select median(trips) from volume) as share_of_median
           from volume order by trips, month limit 1""",
        "share_of_median",
    ),
    "q18_seasonality": _neat("select * from season", "mean_trips"),
    "q19_season_extremes": _neat(
        """select q.calendar_month as quiet_month, q.mean_trips as quiet_trips,
             b.calendar_month as busy_month, b.mean_trips as busy_trips,
             b.mean_trips / nullif(q.mean_trips, 0) - 1 as swing
           from (select * from season order by mean_trips, month_number limit 1) q,
                (select * from season order by mean_trips desc, month_number limit 1) b""",
        "quiet_trips busy_trips swing",
    ),
    "q20_recovery": statement(
        """select timestamp '1996-02-01' as baseline_month, baseline_trips, recovery_month,
             date_diff('month', timestamp '1996-02-01', recovery_month)::int as gap_months
           from (select max(b.trips) as baseline_trips, min(t.month) filter (
                   where t.month > timestamp '1996-02-01' and t.trips >= b.trips) as recovery_month
                 from month_totals t, (select trips from month_totals
                   where month = timestamp '1996-02-01') b) x"""
    ),
    "q21_exits": _neat(
        "select * from census where last_month < (select max(last_month) from census)",
        "lifetime_share",
    ),
    "q21_dormant": _neat(
        """select platform, trips, last_month, months_active, lifetime_share from census
           where platform not in (select platform from live)""",
        "lifetime_share",
    ),
    "q22_share_of_all": _neat(
        """select *, trips / sum(trips) over (partition by month) as share
           from (select month, platform, sum(trips)::bigint as trips from share group by all) x""",
        "share",
    ),
    "q23_concentration": _neat(
        "select month, airport, sum(share ** 2) * 10000 as hhi from share group by all", "hhi"
    ),
    "q23_airports_seen": statement("select distinct airport from share"),
    "q24_yearly_share": _neat("select * from share_year", "share"),
    "q25_leadership": _neat("select * from leaders", "leader_share runner_up_share gap"),
    "q25_leadership_view": statement(
        """select airport, year, leader, round(leader_share, 3) as leader_share,
             round(runner_up_share, 3) as runner_up_share, round(gap, 3) as gap, changed_hands
           from leaders"""
    ),
    "q26_handovers": _neat(
        "select * from leaders where changed_hands", "leader_share runner_up_share gap"
    ),
    "q26_current_leaders": _neat(
        "select * from leaders where year = (select max(year) from leaders)",
        "leader_share runner_up_share gap",
    ),
    "q27_coverage_starts": statement("select * from starts"),
    "q27_comparable_from": statement("select max(first_month) as comparable_from from starts"),
    "q27_last_to_report": statement(
        "select * from starts where first_month = (select max(first_month) from starts)"
    ),
    "q28_yearly_economics": _neat(
        "select * from econ_year", "payout_share gross_per_hour median_fare"
    ),
    "q29_fare_earnings": _neat("select * from points", "med_fare med_gross_per_engaged_hour"),
    "q29_trips_in_box": statement(
        """select platform, sum(trips)::bigint as trips from points
           where med_fare between 15 and 40 and med_gross_per_engaged_hour between 20 and 60
           group by platform"""
    ),
    "q30_trailing_points": _neat(
        """select *, 1.0e0 - date_diff('day', month, timestamp '2000-06-01') / (31.0e0 * 12)
             as weight
           from points where month <= timestamp '2000-06-01' and month >= (
             select min(month) from (select distinct month from points
               where month <= timestamp '2000-06-01' order by month desc limit 13) m)""",
        "med_fare med_gross_per_engaged_hour weight",
    ),
    "q30_axis_bounds": _neat(
        """select min(med_fare) * 0.95e0 as med_fare_low, max(med_fare) * 1.05e0 as med_fare_high,
             min(med_gross_per_engaged_hour) * 0.95e0 as med_gross_per_engaged_hour_low,
             max(med_gross_per_engaged_hour) * 1.05e0 as med_gross_per_engaged_hour_high
           from points""",
        "med_fare_low med_fare_high med_gross_per_engaged_hour_low "
        "med_gross_per_engaged_hour_high",
    ),
    "q31_direction_economics": _neat(
        "select * from direction_econ",
        "median_fare payout_share engaged_s mean_tip binding_rate tip_rate engaged_min",
    ),
    "q31_direction_economics_view": statement(
        """select airport, direction, trips, round(median_fare, 2) as median_fare,
             round(payout_share, 3) as payout_share, round(engaged_min, 1) as engaged_min,
             round(mean_tip, 2) as mean_tip, round(tip_rate, 4) as tip_rate,
             round(binding_rate, 4) as binding_rate
           from direction_econ"""
    ),
    "q32_direction_differences": _neat(
        """select airport, p.payout_share as payout_share_pickup,
             d.payout_share as payout_share_dropoff, p.engaged_min as engaged_min_pickup,
             d.engaged_min as engaged_min_dropoff, p.tip_rate as tip_rate_pickup,
             d.tip_rate as tip_rate_dropoff,
             p.engaged_min - d.engaged_min as engaged_min_difference,
             100 * (p.payout_share - d.payout_share) as payout_points_difference
           from (select * from direction_econ where direction = 'pickup') p
           full join (select * from direction_econ where direction = 'dropoff') d using (airport)""",
        "payout_share_pickup payout_share_dropoff engaged_min_pickup engaged_min_dropoff "
        "tip_rate_pickup tip_rate_dropoff engaged_min_difference payout_points_difference",
    ),
    "q33_same_airport_trips": _neat(
        """select airport, direction as label, sum(trips)::bigint as trips,
             median(med_miles) as median_miles, median(med_fare) as median_fare
           from kpis where direction = case when exists (
               select 1 from kpis where direction = 'internal') then 'internal' else 'transfer' end
           group by all""",
        "median_miles median_fare",
    ),
    "q33_same_airport_trips_fallback": _neat(
        """select airport, 'transfer' as label, sum(trips)::bigint as trips,
             median(med_miles) as median_miles, median(med_fare) as median_fare
           from kpis where direction = 'transfer' group by all""",
        "median_miles median_fare",
    ),
    "q34_effective_speed": _neat("select * from speed", "mph"),
    "q34_speed_by_airport": _neat(
        """select year, max(mph) filter (where airport = 'EWR') as "EWR",
             max(mph) filter (where airport = 'JFK') as "JFK",
             max(mph) filter (where airport = 'LGA') as "LGA"
           from speed group by year""",
        '"EWR" "JFK" "LGA"',
    ),
    "q34_speed_change": _neat(
        """select airport, first_year, first_mph, second_year, second_mph, last_year, last_mph,
             last_mph / nullif(first_mph, 0) - 1 as change,
             case when last_mph / nullif(first_mph, 0) - 1 < 0 then 'slower' else 'faster' end
               as word, peak_year, peak_mph
           from (select airport, any_value(y.first_year) as first_year,
                   max(mph) filter (where year = y.first_year) as first_mph,
                   any_value(y.second_year) as second_year,
                   max(mph) filter (where year = y.second_year) as second_mph,
                   any_value(y.last_year) as last_year,
                   max(mph) filter (where year = y.last_year) as last_mph,
                   first(year order by mph desc nulls last, year) as peak_year,
                   max(mph) as peak_mph
                 from speed, (select min(year) as first_year, max(year) as last_year,
                   (select min(year) from speed where year > (select min(year) from speed))
                     as second_year from speed) y
                 group by airport) x""",
        "first_mph second_mph last_mph change peak_mph",
    ),
    "q35_indexed_money": _neat(
        """select year, measure, dollars, 100 * dollars / nullif(first(dollars) over (
               partition by measure order by year), 0) as "index"
           from (select year, 'Median rider fare' as measure, fare as dollars from money
                 union all select year, 'Median driver gross', gross from money) x""",
        'dollars "index"',
    ),
    "q36_money_change": _neat(
        """select min(year) as first_year, max(year) as last_year,
             min_by(fare, year) as first_fare, max_by(fare, year) as last_fare,
             max_by(fare, year) / nullif(min_by(fare, year), 0) - 1 as fare_change,
             min_by(gross, year) as first_gross, max_by(gross, year) as last_gross,
             max_by(gross, year) / nullif(min_by(gross, year), 0) - 1 as gross_change
           from money""",
        "first_fare last_fare fare_change first_gross last_gross gross_change",
    ),
    "q37_hour_shape": _neat(
        """select *, trips / sum(trips) over (partition by airport) as share
           from (select airport, hour, sum(trips)::bigint as trips from hourly group by all) x""",
        "share",
    ),
    "q38_pool_request_rate": _neat(
        """select month, platform, sum(pool_request_rate * trips) / nullif(sum(trips), 0)
             as pool_request_rate
           from kpis where platform in (select platform from live) group by month, platform""",
        "pool_request_rate",
    ),
    "q39_binding_rate": _neat(
        """select month, platform, sum(incentive_trips) / nullif(sum(trips), 0) as binding_rate
           from incentive where direction = 'pickup' and platform in (select platform from live)
           group by month, platform""",
        "binding_rate",
    ),
    "q40_curb_wait": _neat(
        """select *, case when median_wait_s % 60 = 0 then 'worst' else '' end as mark
           from wait""",
        "median_wait_s",
    ),
    "q40_rounding_suspect": statement(
        """select count(*) filter (where median_wait_s % 60 = 0) as pairs_on_exact_minute,
             count(*) as pairs, count(*) filter (where median_wait_s % 60 = 0) > 0
               as rounding_suspect
           from wait"""
    ),
    "q41_incentive_by_airport": _neat(
        "select * from inc_airport", "median_topup rate topup_per_trip total_topup"
    ),
    "q41_incentive_view": statement(
        """select airport, platform, trips, round(rate, 4) as rate,
             round(median_topup, 2) as median_topup, round(topup_per_trip, 3) as topup_per_trip
           from inc_airport where airport in (select airport from dispatch)"""
    ),
    "q42_latest_year_summary": statement(
        """select e.airport, e.platform, round(s.share, 3) as share_of_airport,
             round(e.payout_share, 3) as payout_share,
             round(e.gross_per_hour, 2) as gross_per_hour, round(i.rate, 4) as min_pay_binding_rate
           from econ_year e
           left join share_year s on s.airport = e.airport and s.platform = e.platform
             and s.year = e.year
           left join inc_airport i on i.airport = e.airport and i.platform = e.platform
           where e.year = (select max(year) from econ_year)"""
    ),
    "q43_compare_platforms": _neat("select * from comparison", '"Uber" "Lyft" difference'),
    "q43_compare_one_platform": _neat(
        """select airport, metric, value as "Uber", label, kind, better
           from score_lifetime join metrics using (metric) where platform = 'Uber'""",
        '"Uber"',
    ),
    "q44_benchmark": _neat("select * from scoreboard", '"Uber" "Lyft" difference target'),
    "q45_lifetime_matrix": _neat(
        "select * exclude (best) from lifetime", '"Uber" "Lyft" "Via" "Juno" "HV0006"'
    ),
    "q46_duo": _neat(
        """select * from census where platform in (select platform from live)
           order by trips desc, platform limit 2""",
        "lifetime_share",
    ),
    "q46_head_to_head": _neat("select * from head", '"Uber" "Lyft" difference'),
    "q47_formatted_scorecard": statement(
        f"""select airport, label, {metric_text('"Uber"')} as "Uber",
              {metric_text('"Lyft"')} as "Lyft", {difference_text('difference')} as difference,
              leader from head"""
    ),
    "q47_formatted_lifetime": statement(
        "select airport, label, "
        + ", ".join(
            f"""{metric_text(f'"{p}"')} as "{p}" """
            for p in ("Uber", "Lyft", "Via", "Juno", "HV0006")
        )
        + ", winner from lifetime"
    ),
    "q48_duo_payout": _neat("select * from payout", "payout_share"),
    "q48_duo_share": _neat(
        "select * from all_share where platform in ('Uber', 'Lyft')", "share"
    ),
    "q49_duo_result": _neat(
        """select min(s.year) as first_year, min_by(s.share, s.year) as share_start,
             max(s.year) as last_year, max_by(s.share, s.year) as share_end,
             'Uber' as first_platform, 'Lyft' as second_platform,
             (select min(l.year) from (select * from payout where platform = 'Lyft') l
              join (select * from payout where platform = 'Uber') u using (year)
              where l.payout_share > u.payout_share) as payout_lead_from,
             (select max_by(payout_share, year) from payout where platform = 'Uber')
               as latest_first_payout,
             (select max_by(payout_share, year) from payout where platform = 'Lyft')
               as latest_second_payout
           from all_share s where s.platform = 'Lyft'""",
        "share_start share_end latest_first_payout latest_second_payout",
    ),
    "q50_focus_hours": _neat("select * from focus", "share_of_day incentive_rate"),
    "q51_target_gaps": _neat(gaps("Uber"), "value target gap relative"),
    "q51_target_gaps_second": _neat(gaps("Lyft"), "value target gap relative"),
    "q51_formatted_targets": statement(
        f"""select airport, label, {metric_text('value')} as value,
              {metric_text('target')} as target, {metric_text('gap')} as gap, held_by, mark
            from ({gaps('Uber')}) g"""
    ),
    "q52_night_share": _neat(
        """select airport, sum(share_of_day) as night from focus where hour in (0, 1, 2, 3, 4)
           group by airport""",
        "night",
    ),
    "q52_peak_binding_hour": _neat(
        """select * from focus order by incentive_rate desc nulls last, airport, hour limit 1""",
        "share_of_day incentive_rate",
    ),
    "q52_metric_value": statement(
        f"""select ifnull(max({metric_text('"Uber"')}), 'not reported') as value
            from scoreboard where airport = 'JFK' and metric = 'med_fare'"""
    ),
}
