"""Area questions."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from wastelake.catalog.book import Book
from wastelake.catalog.geography import COVERED, HAV
from wastelake.operators import allocation as AL, area as O
from wastelake.plans.context import ALL_HISTORY, Area, Period, page
from wastelake.sources import tables as S

BOOK = Book()
AREA = Area((25.05, 54.60, 25.40, 54.80), datetime(2024, 6, 25, 12))
HISTORY = ALL_HISTORY
JUNE = Period("explicit", date(2024, 6, 1), date(2024, 6, 20))
PLAN = Period("explicit", date(2024, 6, 1), date(2024, 8, 1))
BOX = "latitude between 54.60 and 54.80 and longitude between 25.05 and 25.40"
CAP = """count(*) as bins, count(kc) as known_capacity_bins, round(sum(kc), 6) as total_known_capacity_m3, round(avg(kc), 6) as mean_known_capacity_m3,
    count(*) filter (where capacity_m3 is null) as missing_capacity_bins, count(*) filter (where capacity_m3 is not null and kc is null) as invalid_capacity_bins"""
SVC = """count(*) as attempts, count(*) filter (where was_serviced) as successes, count(*) filter (where not was_serviced) as failures,
    count(*) filter (where was_serviced) as success_numerator, count(*) as success_denominator,
    round(count(*) filter (where was_serviced)::double / nullif(count(*), 0), 6) as success_rate, max(date) as latest_attempt,
    max(date) filter (where was_serviced) as latest_success, count(distinct bin_id) as bins_with_attempts"""
FILL = """count(*) as attempts, count(fill_level) as observed, count(*) filter (where fill_level is null) as missing, round(avg(fill_level), 6) as ordinal_category_mean,
    """ + ", ".join(f"count(*) filter (where fill_level = {k}) as category_{k}" for k in range(5))
SYN = "count(*) as synthetic_rows, count(distinct bin_id) as distinct_bins, " + ", ".join(
    f'count(*) filter (where collection_status = \'{s}\') as "{s}"' for s in ("none", "collected", "retry_collected", "failed", "missed")
)
NOW = "timestamp '2024-06-25 12:00:00'"
RECENT_V = f"date >= timestamp '2024-05-27' and date < {NOW}"
RECENT_R = f"\"timestamp\" >= timestamp '2024-05-27' and \"timestamp\" < {NOW}"
V = {
    "kbins": "select *, case when not isnan(capacity_m3) and not isinf(capacity_m3) then capacity_m3 end as kc from bins",
    "abins": f"select * from kbins where {BOX}",
    "av": "select v.*, b.waste_type, b.waste_carrier, b.object_group, b.site_id from visits v join abins b on b.id = v.bin_id",
    "ar": "select v.*, b.waste_type, b.waste_carrier, b.object_group, b.site_id from requests v join abins b on b.id = v.bin_id",
    "ad": "select d.* from bin_days d join abins b on b.id = d.bin_id",
    "fills": """select b.id as bin_id, b.site_id, b.waste_carrier, b.capacity_m3, b.waste_type, p.predicted_fill, p.predicted_fill > 2 as due,
        case when isnan(b.capacity_m3) then null else b.capacity_m3 end as cap,
        (case p.predicted_fill when 0 then 0.2 when 1 then 0.5 when 2 then 0.8 when 3 then 1.0 else 1.5 end)::double as share
      from predictions p join bins b on b.id = p.bin_id""",
    "stops": """select date '2024-07-01' as date, waste_carrier, site_id, coalesce('c:' || waste_carrier, 'n') || '/' || site_id::varchar as stop_id,
        sum(coalesce(cap, 0)) as overall_volume_m3, sum(coalesce(cap, 0) * share) as overall_predicted_fill_m3, count(*) as n_bins
      from fills group by waste_carrier, site_id having bool_or(due)""",
    "stop_bins": "select s.stop_id, f.bin_id, f.predicted_fill, f.due from fills f join stops s on s.site_id = f.site_id and s.waste_carrier is not distinct from f.waste_carrier",
}


def plan_tables(spark, sf):
    from wastelake.operators import planning as P

    fills = P.due_bins(S.predictions(spark, sf), S.bins(spark, sf))
    stops = P.collection_stops(fills, date(2024, 7, 1))
    return P.stop_bins(fills, stops), stops


@BOOK.add("service_summary", f"select waste_type as \"group\", {SVC}, (select count(*) from abins) as eligible_bins from av where {RECENT_V} group by 1", **V)
def _(spark, sf):
    return O.service_summary(S.visits(spark, sf), S.bins(spark, sf), AREA, "waste_type")


@BOOK.add("area_overview", f"""
    with c as (select {CAP}, count(distinct site_id) as represented_sites from abins), s as (select {SVC} from av where {RECENT_V})
    select 'registry' as section, unnest(['bins','known_capacity_bins','total_known_capacity_m3','mean_known_capacity_m3','missing_capacity_bins','invalid_capacity_bins','represented_sites']) as metric,
      unnest([bins::double, known_capacity_bins, total_known_capacity_m3, mean_known_capacity_m3, missing_capacity_bins, invalid_capacity_bins, represented_sites]) as value from c
    union all select 'registry', 'location_sites', count(*) from sites where {BOX}
    union all select 'waste_type', waste_type, count(*) from abins group by 2
    union all select 'recent_service', unnest(['attempts','successes','failures','success_rate','bins_with_attempts']), unnest([attempts::double, successes, failures, success_rate, bins_with_attempts]) from s
    union all select 'recent_requests', unnest(['submissions','reporting_bins']), unnest([count(*)::double, count(distinct bin_id)]) from ar where {RECENT_R}
    """ + "".join(
    f" union all select 'coverage_{n}', unnest(['rows','bins']), unnest([count(*)::double, count(distinct bin_id)]) from {t} where bin_id in (select id from abins)"
    for n, t in (("visits", "visits"), ("requests", "requests"), ("schedule", "schedule"), ("bin_days", "bin_days"), ("population", "bin_population"))
), **V)
def _(spark, sf):
    g = lambda f: f(spark, sf)
    return O.area_overview(g(S.bins), g(S.sites), g(S.visits), g(S.requests), g(S.schedule), g(S.bin_days), g(S.bin_population), AREA)


@BOOK.add("dataset_coverage", """
    select 'visits' as dataset, count(*) as rows, count(distinct bin_id) as bins, min(date)::date as earliest, max(date)::date as latest from visits where bin_id in (select id from abins)
    union all select 'requests', count(*), count(distinct bin_id), min("timestamp")::date, max("timestamp")::date from requests where bin_id in (select id from abins)
    union all select 'population', count(*), count(distinct bin_id), null, null from bin_population where bin_id in (select id from abins)""", **V)
def _(spark, sf):
    return O.coverage({"visits": (S.visits(spark, sf), "date"), "requests": (S.requests(spark, sf), "timestamp"), "population": (S.bin_population(spark, sf), None)}, S.bins(spark, sf), AREA)


@BOOK.add("bin_summary", f"select object_group as \"group\", {CAP} from abins group by 1", **V)
def _(spark, sf):
    return O.bin_summary(S.bins(spark, sf), AREA, "object_group")


@BOOK.add("bin_detail", f"""
    select id, site_id, waste_type, case when capacity_m3 is null then 'missing' when kc is null then 'invalid_source_value' else 'known' end as capacity_quality,
      (select count(*) from visits where bin_id = 7) as visits_rows, (select count(*) from requests where bin_id = 7) as requests_rows, (select count(*) from schedule where bin_id = 7) as schedule_rows
    from kbins where id = 7 and latitude between 50 and 60""", **V)
def _(spark, sf):
    wide = Area((20.0, 50.0, 30.0, 60.0), AREA.as_of)
    ev = {"visits": S.visits(spark, sf), "requests": S.requests(spark, sf), "schedule": S.schedule(spark, sf)}
    return O.bin_detail(S.bins(spark, sf), wide, 7, ev).select("id", "site_id", "waste_type", "capacity_quality", "visits_rows", "requests_rows", "schedule_rows")


@BOOK.add("bins_by_ids", "select w.id, b.id is not null as found, b.waste_type from (select unnest([1,2,3,40,41,42,1000000]) as id) w left join abins b on b.id = w.id", **V)
def _(spark, sf):
    return O.bins_by_ids(S.bins(spark, sf), AREA, [1, 2, 3, 40, 41, 42, 1000000, 3]).select("id", "found", "waste_type")


LATEST = f"""select b.id, l.latest_attempt, l.latest_success, l.latest_attempt is null as unknown_history from abins b left join
    (select bin_id, max(date) as latest_attempt, max(date) filter (where was_serviced) as latest_success from visits where date < {NOW} group by 1) l on l.bin_id = b.id"""


@BOOK.add("bin_list", f"select * from ({LATEST}) where latest_success < timestamp '2024-06-24' or latest_success is null", **V)
def _(spark, sf):
    rows = O.bin_list(S.bins(spark, sf), S.visits(spark, sf), AREA, "not_serviced_since", date(2024, 6, 24))
    return rows.select("id", "latest_attempt", "latest_success", "unknown_history")


@BOOK.add("bin_list_recent", f"select * from ({LATEST}) where latest_success is not null order by latest_success desc nulls last, id limit 50", **V)
def _(spark, sf):
    rows = O.bin_list(S.bins(spark, sf), S.visits(spark, sf), AREA, "recently_serviced")
    return page(rows, *O.bin_list_order("recently_serviced")).select("id", "latest_attempt", "latest_success", "unknown_history")


@BOOK.add("site_detail", "select s.id, address, (select count(*) from bins where site_id = 5 and latitude between 50 and 60) as selected_member_bins, (select count(*) from bins where site_id = 5) as whole_site_bins from sites s where id = 5")
def _(spark, sf):
    wide = Area((20.0, 50.0, 30.0, 60.0), AREA.as_of)
    return O.site_detail(S.sites(spark, sf), S.bins(spark, sf), wide, 5).select("id", "address", "selected_member_bins", "whole_site_bins")


@BOOK.add("site_list", f"select id, address from sites where {BOX}")
def _(spark, sf):
    return O.site_list(S.sites(spark, sf), AREA).select("id", "address")


@BOOK.add("site_summary", f"select site_id, waste_carrier as \"group\", {CAP} from abins group by 1, 2", **V)
def _(spark, sf):
    return O.site_summary(S.bins(spark, sf), AREA, "waste_carrier")


@BOOK.add("service_history", f"select id, bin_id, date, was_serviced, non_serviced_reason, fill_level from av where date < {NOW}", **V)
def _(spark, sf):
    return O.service_history(S.visits(spark, sf), S.bins(spark, sf), AREA, period=HISTORY)


@BOOK.add("failure_reasons", f"select waste_carrier as \"group\", non_serviced_reason as reason, count(*) as failed_attempts from av where not was_serviced and {RECENT_V} group by 1, 2", **V)
def _(spark, sf):
    return O.failure_reasons(S.visits(spark, sf), S.bins(spark, sf), AREA, "waste_carrier")


@BOOK.add("fill_summary", f"select object_group as \"group\", {FILL} from av where {RECENT_V} group by 1", **V)
def _(spark, sf):
    return O.fill_summary(S.visits(spark, sf), S.bins(spark, sf), AREA, "object_group")


@BOOK.add("failed_attempts", f"select id, bin_id, date, was_serviced, non_serviced_reason, fill_level from av where not was_serviced and date >= timestamp '2024-06-01' and date < timestamp '2024-06-20'", **V)
def _(spark, sf):
    return O.failed_attempts(S.visits(spark, sf), S.bins(spark, sf), AREA, JUNE)


@BOOK.add("request_summary", f"select waste_type as \"group\", count(*) as submissions, count(distinct bin_id) as reporting_bins, (select count(*) from abins) as eligible_bins from ar where {RECENT_R} group by 1", **V)
def _(spark, sf):
    return O.request_summary(S.requests(spark, sf), S.bins(spark, sf), AREA, "waste_type")


@BOOK.add("request_events", f"select id, bin_id, \"timestamp\" from ar where {RECENT_R}", **V)
def _(spark, sf):
    return O.request_events(S.requests(spark, sf), S.bins(spark, sf), AREA)


SINCE = f"""
    select b.id as bin_id, s.at as latest_successful_service, s.at is not null as baseline_known,
      case when s.at is not null then (select count(*) from requests r where r.bin_id = b.id and r."timestamp" > s.at and r."timestamp" < {NOW}) end as submissions_since_success,
      (select count(*) from requests r where r.bin_id = b.id and r."timestamp" < {NOW}) as total_submissions
    from abins b left join (select bin_id, max(date) as at from visits where was_serviced and date < {NOW} group by 1) s on s.bin_id = b.id""".replace("s.at", "s.okat").replace("as at", "as okat")


@BOOK.add("requests_since_success", SINCE, **V)
def _(spark, sf):
    return O.requests_since_success(S.requests(spark, sf), S.visits(spark, sf), S.bins(spark, sf), AREA)


@BOOK.add("service_trend", f"select date_trunc('week', date)::date as bucket_start, {SVC} from av where {RECENT_V} group by 1", **V)
def _(spark, sf):
    return O.service_trend(S.visits(spark, sf), S.bins(spark, sf), AREA, "week")


@BOOK.add("fill_trend", f"select date_trunc('day', date)::date as bucket_start, {FILL} from av where {RECENT_V} group by 1", **V)
def _(spark, sf):
    return O.service_trend(S.visits(spark, sf), S.bins(spark, sf), AREA, "day", "fill")


@BOOK.add("request_trend", f"select date_trunc('day', \"timestamp\")::date as bucket_start, count(*) as submissions, count(distinct bin_id) as reporting_bins from ar where {RECENT_R} group by 1", **V)
def _(spark, sf):
    return O.request_trend(S.requests(spark, sf), S.bins(spark, sf), AREA)


@BOOK.add("synthetic_trend", f"select date_trunc('month', date)::date as bucket_start, {SYN} from ad where date < date '2024-06-26' group by 1", **V)
def _(spark, sf):
    return O.synthetic_trend(S.bin_days(spark, sf), S.bins(spark, sf), AREA, "month", HISTORY)


ACT = f"""select b.id as bin_id, b.site_id, b.waste_type, b.waste_carrier, coalesce(attempts, 0) as attempts, coalesce(successes, 0) as successes, coalesce(failures, 0) as failures,
      coalesce(submissions, 0) as submissions, latest_success, attempts is null as missing_period_history
    from abins b left join (select bin_id, count(*) as attempts, count(*) filter (where was_serviced) as successes, count(*) filter (where not was_serviced) as failures,
      max(date) filter (where was_serviced) as latest_success from visits where {RECENT_V} group by 1) h on h.bin_id = b.id
    left join (select bin_id, count(*) as submissions from requests where {RECENT_R} group by 1) r on r.bin_id = b.id"""


@BOOK.add("activity_ranking", f"select * from ({ACT}) order by submissions desc, successes, bin_id limit 100", **V)
def _(spark, sf):
    rows = O.activity_by_bin(S.visits(spark, sf), S.requests(spark, sf), S.bins(spark, sf), AREA)
    return page(rows, *O.ranking_order(), limit=100)


@BOOK.add("site_activity", f"select site_id, count(*) as selected_bins, sum(attempts)::bigint as attempts, sum(successes)::bigint as successes, sum(failures)::bigint as failures, sum(submissions)::bigint as submissions from ({ACT}) group by 1", **V)
def _(spark, sf):
    return O.site_activity(S.visits(spark, sf), S.requests(spark, sf), S.bins(spark, sf), AREA)


@BOOK.add("schedule_summary", "select count(*) as planned_dates, count(distinct bin_id) as scheduled_bins, min(date) as earliest, max(date) as latest from schedule where bin_id in (select id from abins) and date >= date '2024-06-01' and date < date '2024-08-01'", **V)
def _(spark, sf):
    return O.schedule_summary(S.schedule(spark, sf), S.bins(spark, sf), AREA, PLAN)


@BOOK.add("schedule_list", "select id, bin_id, date from schedule where bin_id in (select id from abins) and date >= date '2024-06-01' and date < date '2024-08-01'", **V)
def _(spark, sf):
    return O.schedule_list(S.schedule(spark, sf), S.bins(spark, sf), AREA, PLAN)


@BOOK.add("synthetic_summary", f"select waste_type as \"group\", {SYN} from ad where date >= date '2024-05-27' and date < date '2024-06-26' group by 1", **V)
def _(spark, sf):
    return O.synthetic_summary(S.bin_days(spark, sf), S.bins(spark, sf), AREA, "waste_type")


@BOOK.add("plan_list", """
    select b.stop_id, b.bin_id, b.predicted_fill, b.due, case when not isnan(a.capacity_m3) then a.capacity_m3 end as current_capacity_m3, a.capacity_m3 is null or isnan(a.capacity_m3) as capacity_unknown, s.date, s.waste_carrier, round(s.overall_volume_m3, 6) as whole_stop_snapshot_volume_m3,
      round(s.overall_predicted_fill_m3, 6) as whole_stop_predicted_fill_m3 from stop_bins b join abins a on a.id = b.bin_id join stops s on s.stop_id = b.stop_id""", **V)
def _(spark, sf):
    stop_bins, stops = plan_tables(spark, sf)
    rows = O.plan_list(stop_bins, stops, S.bins(spark, sf), AREA, PLAN)
    c = F.col("current_capacity_m3")
    return rows.withColumns({"capacity_unknown": c.isNull() | F.isnan(c), "current_capacity_m3": F.when(~F.isnan(c), c)})


@BOOK.add("plan_summary", f"""
    select "group", sum(n)::bigint as selected_entries, count(*) as represented_stops, round(sum(cap), 6) as selected_current_capacity_m3, {', '.join(f'sum(c{k})::bigint as predicted_category_{k}' for k in range(5))},
      round(sum(vol), 6) as whole_stop_snapshot_volume_m3, round(sum(fil), 6) as whole_stop_predicted_fill_m3 from (
      select s.waste_carrier as "group", s.stop_id, count(*) as n, sum(a.kc) as cap, {', '.join(f'count(*) filter (where b.predicted_fill = {k}) as c{k}' for k in range(5))},
        max(s.overall_volume_m3) as vol, max(s.overall_predicted_fill_m3) as fil
      from stop_bins b join abins a on a.id = b.bin_id join stops s on s.stop_id = b.stop_id group by 1, 2) group by 1""", **V)
def _(spark, sf):
    stop_bins, stops = plan_tables(spark, sf)
    return O.plan_summary(stop_bins, stops, S.bins(spark, sf), AREA, "waste_carrier", PLAN)


@BOOK.add("facility_detail", "select id, name, operator, round(latitude, 6) as latitude, round(longitude, 6) as longitude from landfills where id = 2")
def _(spark, sf):
    return O.facility_detail(S.landfills(spark, sf), 2).select("id", "name", "operator", "latitude", "longitude")


@BOOK.add("facility_list", "select id, name from landfills where latitude between 54.5 and 54.9 and longitude between 24.9 and 25.6")
def _(spark, sf):
    return O.facility_list(S.landfills(spark, sf), Area((24.9, 54.5, 25.6, 54.9), AREA.as_of)).select("id", "name")


@BOOK.add("nearest_facilities", f"select id, name, round({HAV.format(r='6371008.8', a='54.7::double', b='latitude', c='25.225::double', d='longitude')}, 3) as distance_metres from landfills where latitude is not null order by 3, id limit 3", digits=3)
def _(spark, sf):
    return O.nearest_facilities(S.landfills(spark, sf), 54.7, 25.225, 3).select("id", "name", "distance_metres")


@BOOK.add("fleet_summary", """select count(*) as stored_trucks, count(*) filter (where not deleted) as active, count(*) filter (where not deleted and available) as available,
    count(*) filter (where deleted) as retired, sum(max_volume_m3) filter (where not deleted and available) as available_volume_m3 from trucks where waste_carrier = 'carrier_2'""")
def _(spark, sf):
    return O.fleet_summary(S.trucks(spark, sf), "carrier_2")


@BOOK.add("compare_area_global", f"""
    select scope, waste_type as "group", count(*) as bins, round(sum(kc), 6) as total_known_capacity_m3, coalesce(sum(attempts), 0)::bigint as attempts, coalesce(sum(successes), 0)::bigint as successes,
      coalesce(sum(submissions), 0)::bigint as submissions, round(coalesce(sum(successes), 0)::double / nullif(coalesce(sum(attempts), 0), 0), 6) as success_rate, round(coalesce(sum(submissions), 0)::double / count(*), 6) as submissions_per_bin
    from (select 'global' as scope, * from kbins union all select 'area', * from abins) b
    left join (select bin_id, count(*) as attempts, count(*) filter (where was_serviced) as successes from visits where {RECENT_V} group by 1) h on h.bin_id = b.id
    left join (select bin_id, count(*) as submissions from requests where {RECENT_R} group by 1) r on r.bin_id = b.id group by 1, 2""", **V)
def _(spark, sf):
    return O.compare_area_global(S.visits(spark, sf), S.requests(spark, sf), S.bins(spark, sf), AREA, "waste_type")


TILE = "b.longitude between d.x0 and d.x1 and b.latitude between d.y0 and d.y1"
MEM = {"mem": f"select b.id, min(d.id) as polygon_id, count(d.id) as matches from abins b, districts d where {TILE} group by 1"}


@BOOK.add("geographic_context", """
    select d.id, d.name, (select count(*) from mem where polygon_id = d.id) as selected_bin_count, (select count(*) from abins) as selected_bins,
      (select count(*) from abins where id not in (select id from mem)) as unmatched_bins, (select count(*) from mem where matches > 1) as ambiguous_bins, 0 as invalid_polygons
    from districts d where x0 <= 25.40 and x1 >= 25.05 and y0 <= 54.80 and y1 >= 54.60""", **V, **MEM)
def _(spark, sf):
    return O.geographic_context(S.bins(spark, sf), S.districts(spark, sf), AREA)


@BOOK.add("geographic_summary", f"""
    with m as (select b.id, min(d.id) as polygon_id from bins b join districts d on {TILE} group by 1), w as (select b.* from bins b join m on m.id = b.id and m.polygon_id = 8)
    select part, count(*) as bins, coalesce(sum(attempts), 0)::bigint as attempts, coalesce(sum(successes), 0)::bigint as successes, coalesce(sum(submissions), 0)::bigint as submissions, count(submissions) as reporting_bins,
      round(coalesce(sum(successes), 0)::double / nullif(coalesce(sum(attempts), 0), 0), 6) as success_rate
    from (select 'whole_geography' as part, * from w union all select 'selected_intersection', * from w where {BOX}) b
    left join (select bin_id, count(*) as attempts, count(*) filter (where was_serviced) as successes from visits where date < {NOW} group by 1) h on h.bin_id = b.id
    left join (select bin_id, count(*) as submissions from requests where "timestamp" < {NOW} group by 1) r on r.bin_id = b.id group by 1""", **V)
def _(spark, sf):
    return O.geographic_summary(S.bins(spark, sf), S.districts(spark, sf), S.visits(spark, sf), S.requests(spark, sf), AREA, 8, HISTORY)


POP = {
    "near": "select * from residents where x0 <= 25.40 and x1 >= 25.05 and y0 <= 54.80 and y1 >= 54.60",
    "won": f"select b.id, min(c.id) as polygon_id, count(*) as matches from abins b, near c where {COVERED} group by 1",
    "plist": """select b.id, b.site_id, b.waste_type, p.population_cell_id as stored_population_cell_id, p.resident_factor, w.polygon_id as current_population_cell_id, c.density_per_ha,
        case when c.id is null then 'unavailable' when c.suppressed then 'suppressed (assumed density)' when c.density_per_ha is null then 'unavailable' when c.density_per_ha < 11 then '<11'
          when c.density_per_ha < 50 then '11–49' when c.density_per_ha < 100 then '50–99' when c.density_per_ha < 200 then '100–199' else '200+' end as density_band, c.suppressed,
        case when c.density_text is not null then round(c.residents, 6) end as full_source_polygon_residents, coalesce(w.matches, 0) > 1 as ambiguous_membership
      from abins b left join won w on w.id = b.id left join bin_population p on p.bin_id = b.id left join near c on c.id = w.polygon_id""",
}


@BOOK.add("population_list", "select * from plist", **V, **POP)
def _(spark, sf):
    return O.population_list(S.bins(spark, sf), AL.parse_density(S.cells(spark, sf)), S.bin_population(spark, sf), AREA)


@BOOK.add("population_summary", """
    select density_band as "group", sum(n)::bigint as selected_bins, count(current_population_cell_id) as unique_source_polygons, round(sum(res), 6) as full_source_polygon_residents,
      round(sum(alloc), 6) as stored_allocation, sum(miss)::bigint as missing_allocation_bins, sum(amb)::bigint as ambiguous_bins from (
      select density_band, current_population_cell_id, count(*) as n, max(full_source_polygon_residents) as res, sum(resident_factor) as alloc,
        count(*) filter (where resident_factor is null) as miss, count(*) filter (where ambiguous_membership) as amb from plist group by 1, 2) group by 1""", **V, **POP)
def _(spark, sf):
    return O.population_summary(S.bins(spark, sf), AL.parse_density(S.cells(spark, sf)), S.bin_population(spark, sf), AREA, "density_band")
