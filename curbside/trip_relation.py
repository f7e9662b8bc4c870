"""A trip relation computed from ``lineitem``.

The test tables hold no trips, so this portable statement makes one: the same text
runs in Spark and in DuckDB and gives the same rows. ``{lineitem}`` is the table.
"""

RAW_TRIPS_SQL = """
select
  hvfhs_license_num,
  pickup_datetime - (cast(l_quantity as bigint) * 20 + 60) * interval '1' second
    as request_datetime,
  case when hvfhs_license_num = 'HV0005' and l_shipdate < timestamp '2000-03-01 00:00:00' then null
       when hvfhs_license_num = 'HV0005' then pickup_datetime - (k % 3) * interval '60' second
       else pickup_datetime - ((k % 240) - 4) * interval '1' second end as on_scene_datetime,
  pickup_datetime,
  pickup_datetime + (cast(l_quantity as bigint) * 60 + k % 600) * interval '1' second
    as dropoff_datetime,
  cast(case when k % 20 < 7 then 132 when k % 20 < 11 then 138 when k % 400 = 11 then 1
            else 2 + k % 100 end as bigint) as PULocationID,
  cast(case when (k % 1000 - k % 20) / 20 < 4 then 132
            when (k % 1000 - k % 20) / 20 < 8 then 138
            when (k % 1000 - k % 20) / 20 < 20 then 1
            else 140 + k % 100 end as bigint) as DOLocationID,
  case when k % 97 = 0 then 0.0e0 else l_quantity / 2.5e0 end as trip_miles,
  cast(l_quantity as bigint) * 60 + k % 600 as trip_time,
  case when k % 89 = 0 then 0.0e0 when k % 83 = 0 then null else l_extendedprice / 1.0e3 end
    as base_passenger_fare,
  case when k % 3 = 0 then null else l_tax * 1.0e2 end as tolls,
  l_extendedprice * 3.0e-5 as bcf,
  l_extendedprice * 8.875e-5 as sales_tax,
  case when k % 5 = 0 then null else 2.75e0 end as congestion_surcharge,
  2.5e0 as airport_fee,
  case when k % 7 = 0 then null else l_discount * 5.0e1 end as tips,
  case when k % 101 = 0 then null
       else l_extendedprice * (6.0e-4 + case when k % 11 = 0 then 7.0e-4 else 0.0e0 end) end
    as driver_pay,
  case when k % 13 = 0 then 'Y' else 'N' end as shared_request_flag,
  case when k % 39 = 0 then 'Y' else 'N' end as shared_match_flag,
  'N' as wav_request_flag,
  'N' as wav_match_flag,
  case when l_shipdate < timestamp '2001-01-01 00:00:00' then null
       when k % 4 = 0 then 1.5e0 else 0.0e0 end as cbd_congestion_fee
from (
  select *,
    case when l_suppkey % 50 = 0 and k % 8 = 0 then 'HV0006'
         when l_suppkey % 10 in (0, 1, 2) and k % 20 in (7, 8, 9, 10)
              and l_shipdate < timestamp '1997-01-01 00:00:00' then 'HV0005'
         when l_suppkey % 10 = 8 and l_shipdate < timestamp '1998-01-01 00:00:00' then 'HV0002'
         when l_suppkey % 10 = 9 and l_shipdate < timestamp '1999-01-01 00:00:00' then 'HV0004'
         when l_suppkey % 10 in (5, 6, 7) then 'HV0005'
         else 'HV0003' end as hvfhs_license_num,
    l_shipdate + (k % 86400) * interval '1' second as pickup_datetime
  from (
    select *, l_partkey * 7 + l_linenumber * 13 + l_suppkey * 31 + l_orderkey * 17 as k
    from {lineitem}
  ) keyed
) licensed
"""
