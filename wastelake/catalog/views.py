"""The table views once more as plain SQL, so a second engine can check every query."""

from __future__ import annotations

import re


def u(ns: str, key: str) -> str:
    return f"(('0x' || substr(md5('42:{ns}:' || ({key})::varchar), 1, 13))::bigint / 4503599627370496.0::double)"


def lat(ns: str, key: str) -> str:
    return f"(54.55::double + 0.30::double * {u(ns, key)})"


def lon(ns: str, key: str) -> str:
    return f"(24.98::double + 0.54::double * {u(ns, key)})"


LON_SCALE = "(cos(radians(54.7::double)) * 111320.0::double)"

VIEWS: dict[str, str] = {
    "bins": f"""
        select c_custkey as id, site_id,
          case when c_custkey % 23 <> 0 then c_custkey + 100000 end as external_id,
          'INV-' || c_custkey::varchar as inventory_number,
          case when c_mktsegment in ('BUILDING','MACHINERY') then 'Mixed municipal waste'
               when c_mktsegment = 'AUTOMOBILE' then 'Paper/plastic waste'
               when c_mktsegment = 'FURNITURE' then 'Glass waste' else 'Food/organic waste' end as waste_type,
          case when c_acctbal < -900 then null when c_acctbal < -800 then 'nan'::double
               else round(greatest(c_acctbal, 0.0::double) / 2000, 2) end as capacity_m3,
          {lat('lat', 'site_id')} as latitude, {lon('lon', 'site_id')} as longitude,
          case when c_custkey % 19 = 0 then null when c_custkey % 7 = 1 then '  ' || n_name || '   sen. '
               when c_custkey % 7 = 2 then n_name else n_name || ' sen.' end as sub_district,
          case when c_custkey % 13 = 0 then '' when c_custkey % 13 = 1 then 'Kaunas' else 'Vilniaus m.' end as city,
          case when c_custkey % 37 <> 0 then ' Gatvė  ' || (site_id % 97)::varchar end as street,
          case when c_custkey % 37 <> 0 then site_id::varchar || 'A' end as house_number,
          case when c_custkey % 5 <> 0 then 'LT-' || (10000 + site_id % 900)::varchar end as postal_code,
          case when c_custkey % 40 = 4 then ' Individualios   valdos' when c_custkey % 8 = 0 then null
               when c_custkey % 8 = 1 then 'Daugiabučiai namai' when c_custkey % 8 = 2 then 'Dvibučiai'
               when c_custkey % 8 = 3 then 'Sodų bendrijos' when c_custkey % 8 = 4 then 'Komercinė paskirtis'
               when c_custkey % 8 = 5 then 'Viešosios įstaigos' when c_custkey % 8 = 6 then 'Sodų/garažų bendrijos'
               else '' end as object_group,
          case when c_nationkey % 5 <> 4 then 'carrier_' || (c_nationkey % 5)::varchar end as waste_carrier,
          case when c_custkey % 9 <> 0 then (c_custkey % 5)::integer end as client_count
        from (select *, c_custkey // 3 as site_id from customer) c
        left join nation on n_nationkey = case when c_custkey % 11 = 0 then c_nationkey else ((c_custkey // 3) * 7) % 25 end""",
    "sites": f"""
        select id, 'Gatvė ' || (id % 97)::varchar || '_' || id::varchar || '%' as address,
          {lat('lat', 'id')} as latitude, {lon('lon', 'id')} as longitude
        from (select distinct c_custkey // 3 as id from customer)""",
    "ev": """
        select event_id, user_id, event_type, ts + interval 152 day as ets,
          json_extract_string(props, '$.k')::integer as k from events""",
    "visits": """
        select event_id as id, user_id as bin_id, ets as date, event_type <> 'error' as was_serviced,
          case when event_type = 'error' and k % 3 = 1 then ''
               when event_type = 'error' and k % 3 = 2 then 'reason_' || (k % 5)::varchar end as non_serviced_reason,
          case when k % 7 < 5 then k % 7 end as fill_level
        from ev where event_type in ('view','purchase','error')""",
    "requests": """
        select event_id as id, user_id as bin_id, ets as "timestamp" from ev where event_type in ('click','signup')""",
    "schedule": """
        select bin_id * 100 + date_diff('day', date '2024-06-01', d) as id, bin_id, d as date from (
          select bin_id, d from (select distinct o_custkey as bin_id from orders where o_custkey % 6 <> 5) o,
            (select unnest(generate_series(date '2024-06-01', date '2024-07-31', interval 1 day))::date as d) s
          where (date_diff('day', date '1970-01-01', d) + 719163) % ([7,14,21,28,1])[(bin_id % 6 + 1)::integer]
              = (bin_id * 5) % ([7,14,21,28,1])[(bin_id % 6 + 1)::integer]
          union all
          select distinct o_custkey, date '2024-06-01' + (o_orderkey % 61)::integer from orders where o_custkey % 6 = 5)""",
    "bin_population": f"""
        select c_custkey as bin_id, case when c_custkey % 4 <> 0 then (c_custkey % 200)::integer end as population_cell_id,
          round(100 * {u('rf', 'c_custkey')}, 6) as resident_factor from customer where c_custkey % 29 <> 0""",
    "bin_days": """
        select g.bin_id, g.date, g.collection_status, g.fill_level, g.reports, b.site_id, b.waste_type, b.capacity_m3,
          b.sub_district, b.object_group, p.population_cell_id, p.resident_factor,
          isodow(g.date)::integer as day_of_week, week(g.date)::integer as week_of_year, month(g.date)::integer as month,
          (month(g.date) % 12 // 3 + 1)::integer as season
        from (
          select q.bin_id, q.date, coalesce(d.reports, 0)::bigint as reports,
            case d.et when 'purchase' then 'collected' when 'signup' then 'retry_collected' when 'click' then 'failed'
              when 'error' then 'missed' else 'none' end as collection_status,
            case when d.et in ('purchase','signup') then d.k % 5 end as fill_level
          from (select bin_id, unnest(generate_series(date '2024-06-01', date '2024-06-30', interval 1 day))::date as date
                from (select distinct user_id as bin_id from ev)) q
          left join (select user_id as bin_id, ets::date as date, arg_min(event_type, {'a': ets, 'b': event_id}) as et,
                       arg_min(k, {'a': ets, 'b': event_id}) as k,
                       count(*) filter (where event_type in ('click','signup')) as reports
                     from ev group by 1, 2) d on d.bin_id = q.bin_id and d.date = q.date) g
        join bins b on b.id = g.bin_id left join bin_population p on p.bin_id = g.bin_id""",
    "cells": f"""
        select p_partkey as id, p_size, case when p_size < 11 then '<11' when p_size % 13 <> 0 then (p_size * 4)::varchar end as density_text,
          10000.0::double * (1 + p_size % 3) as area_m2, clon, clat, half,
          clon - half as x0, clon + half as x1, clat - half as y0, clat + half as y1,
          p_partkey % 5 = 0 as holed,
          clon - half * 0.4::double as hx0, clon + half * 0.4::double as hx1, clat - half * 0.4::double as hy0, clat + half * 0.4::double as hy1
        from (select *, {lat('plat', 'p_partkey')} as clat, {lon('plon', 'p_partkey')} as clon,
                0.002::double + 0.0001::double * p_size as half from part)""",
    "residents": """
        select *, case when density_text = '<11' then null else density_text::integer end as density_per_ha,
          coalesce(density_text = '<11', false) as suppressed,
          coalesce(case when density_text = '<11' then 5.0::double else density_text::double end, 0.0::double) * (area_m2 / 10000) as residents
        from cells""",
    "districts": """
        select n_nationkey::bigint + 1 as id, n_name as name, 24.98::double + 0.108::double * (n_nationkey % 5) as x0,
          24.98::double + 0.108::double * (n_nationkey % 5 + 1) as x1, 54.55::double + 0.06::double * (n_nationkey // 5) as y0,
          54.55::double + 0.06::double * (n_nationkey // 5 + 1) as y1 from nation""",
    "zones": """
        select r_regionkey::bigint + 1 as id, r_name as name, (r_regionkey + 100)::integer as zone_number,
          24.98::double + 0.1::double * r_regionkey as x0, 24.98::double + 0.1::double * (r_regionkey + 1) as x1,
          54.55::double as y0, 54.85::double as y1 from region""",
    "landfills": f"""
        select r_regionkey::bigint as id, 'Facility ' || r_name as name, 'Operator ' || (r_regionkey % 2)::varchar as operator,
          case when r_regionkey <> 4 then {lat('flat', 'r_regionkey')} end as latitude,
          case when r_regionkey <> 4 then {lon('flon', 'r_regionkey')} end as longitude,
          ['mixed', 'stream_' || r_regionkey::varchar] as waste_streams from region""",
    "trucks": """
        select s_suppkey as id, 'Truck ' || s_suppkey::varchar || '%' as name,
          case s_suppkey % 3 when 0 then 10.0::double when 1 then 16.0::double else 20.0::double end as max_volume_m3,
          'carrier_' || (s_nationkey % 4)::varchar as waste_carrier,
          case when s_suppkey % 6 <> 5 then s_suppkey % 6 end as landfill_id,
          s_acctbal > 0 as available, s_suppkey % 17 = 0 as deleted from supplier""",
    "predictions": f"""
        select c_custkey as bin_id, floor(5 * {u('level', 'c_custkey')})::integer as predicted_fill
        from customer where c_custkey % 50 <> 0""",
    "scores": f"""
        select row_id, bin_id, site_id, date, waste_type, capacity_range, input_quality_flag, fill_level,
          [u0 / tot, u1 / tot, u2 / tot, u3 / tot, u4 / tot] as probabilities
        from (select *, u0 + u1 + u2 + u3 + u4 as tot from (
          select row_id, bin_id, site_id, date, waste_type, capacity_range, input_quality_flag, fill_level,
            {', '.join(f"{u(f'p{i}', 'row_id')} + case when fill_level = {i} then 0.6::double else 0.0::double end as u{i}" for i in range(5))}
          from (select o_orderkey as row_id, o_custkey as bin_id, o_custkey // 3 as site_id,
                  date '2024-06-01' + (o_orderkey % 30)::integer as date, o_orderpriority as waste_type, o_orderstatus as capacity_range,
                  case when o_orderkey % 3 = 0 then 'complete' else 'no_historical_labels' end as input_quality_flag,
                  floor(5 * {u('y', 'o_orderkey')})::integer as fill_level from orders)))""",
    "aliases": """
        select n_name || ' sen.' as input, n_name as canonical from nation where n_nationkey < 20""",
    "holidays": """
        select make_date(y, m, d) as date from (select unnest([2023, 2024, 2025]) as y),
          (select unnest([1,2,3,5,6,7,8,11,11,12,12,12]) as m, unnest([1,16,11,1,24,6,15,1,2,24,25,26]) as d)
        union select unnest([date '2023-04-09', date '2023-04-10', date '2024-03-31', date '2024-04-01', date '2025-04-20', date '2025-04-21',
          date '2023-05-07', date '2024-05-05', date '2025-05-04', date '2023-06-04', date '2024-06-02', date '2025-06-01'])""",
}


def sql(body: str, **extra: str) -> str:
    """Prefix a query with the views it names (and the views those name)."""
    known = {**VIEWS, **extra}
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in known:
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit_dep(name)

    def visit_dep(name: str) -> None:
        text = known[name]
        for other in known:
            if other != name and other not in needed and re.search(rf"\b{other}\b", text):
                visit_dep(other)
        if name not in needed:
            needed.append(name)

    visit(body)
    if not needed:
        return body.strip()
    body = body.strip()
    ctes = ",\n".join(f"{n} as ({known[n].strip()})" for n in needed)
    own = {n for n in needed if re.search(rf"\bunion all\b.*\bfrom {n}\b", known[n], re.S)}  # a view that goes on from its own rows
    start = "with recursive" if own else "with"
    return f"{start} {ctes},\n{body[5:]}" if body.startswith("with ") else f"{start} {ctes}\n{body}"
