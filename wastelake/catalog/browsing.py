"""Registry browsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from wastelake.catalog import planning as CP
from wastelake.catalog.book import Book
from wastelake.operators import browsing as O, filters as FI, planning as P
from wastelake.plans.context import page_with_total
from wastelake.sources import tables as S

BOOK = Book()


@BOOK.add("site_page", """
    select s.id, address, (select count(*) from bins b where b.site_id = s.id) as bin_count, (select count(*) from sites where address ilike '%vė 1%') as total, (select count(*) from sites where address ilike '%vė 1%') > 60 as has_more
    from sites s where address ilike '%vė 1%' order by id limit 50 offset 10""")
def _(spark, sf):
    rows = O.sites_with_counts(FI.sites_matching(S.sites(spark, sf), "vė 1"), S.bins(spark, sf))
    return page_with_total(rows.select("id", "address", "bin_count"), F.col("id"), limit=50, offset=10)


@BOOK.add("sites_with_counts", "select s.id, (select count(*) from bins b where b.site_id = s.id) as bin_count from sites s")
def _(spark, sf):
    return O.sites_with_counts(S.sites(spark, sf), S.bins(spark, sf)).select("id", "bin_count")


@BOOK.add("site_stats", """
    select 'total_sites' as metric, null as key, count(*)::double as value from sites union all select 'total_bins', null, count(*) from bins
    union all select 'total_capacity_m3', null, round(sum(capacity_m3), 6) from bins where not isnan(capacity_m3) union all select 'bins_by_waste_type', waste_type, count(*) from bins group by 2""")
def _(spark, sf):
    return O.site_stats(S.sites(spark, sf), S.bins(spark, sf))


@BOOK.add("site_profile", """
    select s.id, s.address, f.sub_district, f.street, f.house_number, f.postal_code, coalesce(n, 0) as bin_count, round(cap, 6) as total_capacity_m3, groups as object_groups, carriers as waste_carriers from sites s
    left join (select site_id, min(id) as first_id, count(*) as n, sum(case when not isnan(capacity_m3) then capacity_m3 end) as cap, coalesce(string_agg(distinct object_group, ';' order by object_group), '') as groups,
      coalesce(string_agg(distinct waste_carrier, ';' order by waste_carrier), '') as carriers from bins group by 1) b on b.site_id = s.id left join bins f on f.id = b.first_id""")
def _(spark, sf):
    rows = O.site_profiles(S.sites(spark, sf), S.bins(spark, sf))
    return rows.withColumns({c: F.array_join(c, ";") for c in ("object_groups", "waste_carriers")})


@BOOK.add("site_bins_page", "select id, inventory_number, waste_type, (select count(*) from bins where site_id = 12) as total, false as has_more from bins where site_id = 12 order by id limit 50")
def _(spark, sf):
    return page_with_total(O.bins_of_site(S.bins(spark, sf), 12).drop("capacity_m3"), F.col("id"), limit=50)


@BOOK.add("bin_latest_service", """
    select b.id, inventory_number, waste_type, v.date as latest_at, v.was_serviced as latest_was_serviced from bins b
    left join (select * from (select *, row_number() over (partition by bin_id order by date desc, id desc) as rn from visits) where rn = 1) v on v.bin_id = b.id""")
def _(spark, sf):
    return O.latest_service(S.bins(spark, sf), S.visits(spark, sf))


@BOOK.add("bin_history_page", """
    select id, date, was_serviced, non_serviced_reason, fill_level, (select count(*) from visits where bin_id = 9) as total,
      (select round_even(100.0::double * count(*) filter (where was_serviced) / count(*), 1) from visits where bin_id = 9) as successful_percentage,
      (select round_even(100.0::double - round_even(100.0::double * count(*) filter (where was_serviced) / count(*), 1), 1) from visits where bin_id = 9) as unsuccessful_percentage
    from visits where bin_id = 9 order by date desc, id desc limit 20 offset 5""")
def _(spark, sf):
    from wastelake.plans.context import page

    return page(O.bin_history(S.visits(spark, sf), 9), F.desc("date"), F.desc("id"), limit=20, offset=5)


@BOOK.add("service_percentages", """
    select bin_id, count(*) as total, round_even(100.0::double * count(*) filter (where was_serviced) / count(*), 1) as successful_percentage,
      round_even(100.0::double - round_even(100.0::double * count(*) filter (where was_serviced) / count(*), 1), 1) as unsuccessful_percentage from visits group by 1""")
def _(spark, sf):
    return O.service_percentages(S.visits(spark, sf))


@BOOK.add("fleet_page", "select id, name, max_volume_m3, waste_carrier, (select count(*) from trucks where not deleted and available) as total, (select count(*) from trucks where not deleted and available) > 25 as has_more from trucks where not deleted and available order by id limit 20 offset 5")
def _(spark, sf):
    rows = FI.trucks_matching(S.trucks(spark, sf), available=True).select("id", "name", "max_volume_m3", "waste_carrier")
    return page_with_total(rows, F.col("id"), limit=20, offset=5)


@BOOK.add("fleet_stats", "select count(*) as total, count(*) filter (where available) as available_count, round(avg(max_volume_m3), 6) as average_max_volume_m3 from trucks where not deleted")
def _(spark, sf):
    return O.fleet_stats(S.trucks(spark, sf))


@BOOK.add("landfill_list", "select id, name, operator, array_to_string(waste_streams, ';') as waste_streams from landfills")
def _(spark, sf):
    return O.landfill_list(S.landfills(spark, sf)).select("id", "name", "operator", F.array_join("waste_streams", ";").alias("waste_streams"))


@BOOK.add("route_truck_counts", "select truck_id, count(*) as stop_count, sum(n)::bigint as bin_count from tours t join (select waste_carrier, site_id, count(*) as n from fills group by 1, 2) f on f.site_id = t.site_id and f.waste_carrier = t.plan_id group by 1", **CP.V)
def _(spark, sf):
    f = CP.fills(spark, sf).select(F.col("waste_carrier").alias("plan_id"), "site_id", "bin_id")
    return O.route_truck_counts(CP.tours(spark, sf), f)


@BOOK.add("carrier_bins_at_stops", "select b.id as bin_id, b.site_id, b.waste_carrier, b.waste_type, t.truck_id from tours t join bins b on b.site_id = t.site_id and b.waste_carrier = t.plan_id", **CP.V)
def _(spark, sf):
    return O.carrier_bins_at_stops(CP.tours(spark, sf), S.bins(spark, sf))


@BOOK.add("planned_bins_missing", "select stop_id, bin_id from stop_bins where bin_id % 21 = 0", **CP.V)
def _(spark, sf):
    f = CP.fills(spark, sf)
    members = P.stop_bins(f, P.collection_stops(f, CP.DAY)).select("stop_id", "bin_id")
    return O.planned_bins_missing(members, S.bins(spark, sf).where(F.col("id") % 21 != 0))
