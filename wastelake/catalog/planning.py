"""Planning operators."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from wastelake.catalog.area import V as AREA_VIEWS
from wastelake.catalog.book import Book
from wastelake.catalog.geography import HAV
from wastelake.operators import planning as O
from wastelake.session import materialize
from wastelake.sources import tables as S

BOOK = Book()
DAY = date(2024, 7, 1)
V = {
    **{k: AREA_VIEWS[k] for k in ("fills", "stops", "stop_bins")},
    "fleet": """select t.id as truck_id, t.waste_carrier as plan_id, t.max_volume_m3, l.latitude as depot_lat, l.longitude as depot_lon from trucks t join landfills l on l.id = t.landfill_id
        where available and not deleted and l.latitude is not null and max_volume_m3 > 0""",
    "jobs": """select s.waste_carrier as plan_id, s.site_id, x.latitude, x.longitude, s.overall_predicted_fill_m3 as load_m3, ceil(round_even(s.overall_predicted_fill_m3 * 1000, 6))::bigint as load_l
        from stops s join sites x on x.id = s.site_id where s.waste_carrier in (select plan_id from fleet)""",
    # a fixed assignment that both engines can derive: stops in site order, forty per trip, trips dealt to trucks
    "dealt": """select j.*, (rn - 1) // 40 as trip_no, (rn - 1) % 40 + 1 as seq from (select *, row_number() over (partition by plan_id order by site_id) as rn from jobs) j""",
    "tours": """select d.plan_id, t.truck_id, d.trip_no + 1 as trip, d.seq, d.site_id, d.latitude, d.longitude, d.load_l, t.depot_lat, t.depot_lon from dealt d
        join (select *, row_number() over (partition by plan_id order by truck_id) - 1 as k, count(*) over (partition by plan_id) as n from fleet) t on t.plan_id = d.plan_id and t.k = d.trip_no % t.n""",
    "hops": """select *, coalesce(lag(latitude) over w, depot_lat) as flat, coalesce(lag(longitude) over w, depot_lon) as flon, lead(seq) over w is null as is_last from tours
        window w as (partition by plan_id, truck_id, trip order by seq)""",
    "dists": f"""select *, round_even({HAV.format(r='6371000', a='flat', b='latitude', c='flon', d='longitude')} * 1.3::double, 0)::bigint as d1,
        case when is_last then round_even({HAV.format(r='6371000', a='latitude', b='depot_lat', c='longitude', d='depot_lon')} * 1.3::double, 0)::bigint end as d2 from hops""",
    "trips": """select plan_id, truck_id, trip, (sum(d1) + sum(d2))::bigint as distance_m,
        (sum(round_even(d1 / (30.0::double / 3.6::double), 0) + 300) + sum(round_even(d2 / (30.0::double / 3.6::double), 0) + 900))::bigint as duration_s, sum(load_l)::bigint / 1000 as load_m3, count(*) as stops
        from dists group by 1, 2, 3""",
    "figs": """select plan_id, round(sum(m) / 1000, 6) as distance_km, sum(trips)::bigint as trips, count(*) as trucks_used, round(sum(greatest(0, s - 28800)) / 60, 6) as overtime_min, sum(stops)::bigint as stops_served
        from (select plan_id, truck_id, sum(distance_m)::bigint as m, count(*) as trips, sum(duration_s)::bigint as s, sum(stops)::bigint as stops from trips group by 1, 2) group by 1""",
}


def fills(spark, sf):
    return O.due_bins(S.predictions(spark, sf), S.bins(spark, sf))


def stops(spark, sf):
    return O.collection_stops(fills(spark, sf), DAY)


def fleet(spark, sf):
    return O.eligible_trucks(S.trucks(spark, sf), S.landfills(spark, sf)).select(
        F.col("id").alias("truck_id"), F.col("waste_carrier").alias("plan_id"), "max_volume_m3", "depot_lat", "depot_lon"
    )


def jobs(spark, sf):
    """Stops of carriers that have a fleet, with place and load."""
    place = S.sites(spark, sf).select(F.col("id").alias("site_id"), "latitude", "longitude")
    own = fleet(spark, sf).select("plan_id").distinct()
    rows = stops(spark, sf).select(F.col("waste_carrier").alias("plan_id"), "site_id", F.col("overall_predicted_fill_m3").alias("load_m3"))
    return rows.join(own, "plan_id", "left_semi").join(place, "site_id").withColumn("load_l", O.litres_up(F.col("load_m3")))


def tours(spark, sf):
    """Stops dealt to trucks in site order: a plan whose figures both engines can check."""
    from pyspark.sql import Window as W

    j = jobs(spark, sf)
    ranked = O.ranked_in_blocks(j, "plan_id", "site_id", "rn").withColumn("rn", F.col("rn") - 1)
    dealt = ranked.withColumns({"trip_no": F.floor(F.col("rn") / 40), "seq": F.col("rn") % 40 + 1})
    t = fleet(spark, sf)
    w = W.partitionBy("plan_id")
    t = t.withColumns({"k": F.row_number().over(w.orderBy("truck_id")) - 1, "n_trucks": F.count("*").over(w)}).withColumnRenamed("plan_id", "fleet_plan")
    joined = dealt.join(t, (F.col("plan_id") == F.col("fleet_plan")) & (F.col("trip_no") % F.col("n_trucks") == F.col("k")))
    return joined.select("plan_id", "truck_id", (F.col("trip_no") + 1).alias("trip"), "seq", "site_id", "latitude", "longitude", "load_l", "depot_lat", "depot_lon")


@BOOK.add("due_bins", "select bin_id, site_id, predicted_fill, due from fills", **V)
def _(spark, sf):
    return fills(spark, sf).select("bin_id", "site_id", "predicted_fill", "due")


@BOOK.add("collection_stops", "select date, waste_carrier, site_id, stop_id, round(overall_volume_m3, 6) as overall_volume_m3, round(overall_predicted_fill_m3, 6) as overall_predicted_fill_m3, n_bins from stops", **V)
def _(spark, sf):
    return stops(spark, sf)


@BOOK.add("stop_bins", "select stop_id, bin_id, predicted_fill, due from stop_bins", **V)
def _(spark, sf):
    f = fills(spark, sf)
    return O.stop_bins(f, O.collection_stops(f, DAY))


@BOOK.add("plan_counts", """
    select 'evaluated' as metric, null as key, count(*) as value from fills union all select 'due', null, count(*) from fills where due
    union all select 'without_capacity', null, count(*) from stop_bins b join bins x on x.id = b.bin_id where x.capacity_m3 is null
    union all select 'stops', waste_carrier, count(*) from stops group by 2""", **V)
def _(spark, sf):
    f = fills(spark, sf)
    return O.plan_counts(f, O.collection_stops(f, DAY))


@BOOK.add("plan_nested", """
    select c as waste_carrier, stop_id, string_agg(bin_id::varchar || ':' || predicted_fill::varchar || ':' || due::varchar, ',' order by bin_id) as bins
    from (select unnest(['carrier_0', 'carrier_1', null, 'carrier_9']) as c) a left join (select s.waste_carrier, b.* from stop_bins b join stops s on s.stop_id = b.stop_id) x on x.waste_carrier is not distinct from c
    group by 1, 2""", **V)
def _(spark, sf):
    f = fills(spark, sf)
    st = O.collection_stops(f, DAY)
    rows = O.plan_nested(st, O.stop_bins(f, st), S.bins(spark, sf), ["carrier_0", "carrier_1", None, "carrier_9"])
    text = F.array_join(F.transform("bins", lambda b: F.concat_ws(":", b["bin_id"].cast("string"), b["predicted_fill"].cast("string"), b["due"].cast("string"))), ",")
    return rows.select("waste_carrier", "stop_id", text.alias("bins"))


@BOOK.add("fleet_size", "select waste_carrier, count(*) as stops, round(sum(overall_predicted_fill_m3), 6) as load_m3, greatest(1, ceil(1.2::double * sum(overall_predicted_fill_m3) / (46.0::double / 3 * (480.0::double / 90.0))))::bigint as trucks from stops where waste_carrier is not null group by 1", **V)
def _(spark, sf):
    return O.fleet_size(stops(spark, sf), 46.0 / 3, 480.0, 90.0)


@BOOK.add("fleet_round_robin_cap", "select id, waste_carrier, rn as round from (select *, row_number() over (partition by waste_carrier order by id) as rn from trucks where not deleted)")
def _(spark, sf):
    return O.fleet_round_robin(S.trucks(spark, sf).where(~F.col("deleted"))).select("id", "waste_carrier", "round")


@BOOK.add("eligible_trucks", "select truck_id as id, plan_id as waste_carrier, max_volume_m3, round(depot_lat, 6) as depot_lat from fleet", **V)
def _(spark, sf):
    return O.eligible_trucks(S.trucks(spark, sf), S.landfills(spark, sf)).select("id", "waste_carrier", "max_volume_m3", "depot_lat")


@BOOK.add("excluded_trucks", "select waste_carrier, count(*) as candidates, count(*) filter (where id not in (select truck_id from fleet)) as excluded from trucks where available and not deleted group by 1", **V)
def _(spark, sf):
    return O.excluded_trucks(S.trucks(spark, sf), S.landfills(spark, sf))


@BOOK.add("stop_loads_checked", """
    select waste_carrier, site_id, count(*) as bins, case when not bool_or(bad) then round(sum(capacity_m3 * share), 6) end as load_m3,
      case when bool_or(bad) then 'missing_capacity' when waste_carrier is null or waste_carrier not in (select plan_id from fleet) then 'no_fleet' end as reason
    from (select *, capacity_m3 is null or isnan(capacity_m3) or capacity_m3 <= 0 as bad from fills where due) group by 1, 2""", **V)
def _(spark, sf):
    return O.stop_loads_checked(fills(spark, sf), O.eligible_trucks(S.trucks(spark, sf), S.landfills(spark, sf)))


@BOOK.add("litre_rounding", """
    select id, ceil(round_even(c, 6))::bigint as up, floor(round_even(c, 6))::bigint as down from (select id, case when not isnan(capacity_m3) then capacity_m3 * 0.333::double * 1000 end as c from bins)""")
def _(spark, sf):
    c = F.col("capacity_m3") * 0.333
    return S.bins(spark, sf).select("id", O.litres_up(c).alias("up"), O.litres_down(c).alias("down"))


@BOOK.add("oversize_stops", """
    select s.waste_carrier, s.site_id, ceil(round_even(overall_predicted_fill_m3 * 4 * 1000, 6))::bigint as load_l, largest_l from stops s
    join (select plan_id, max(floor(round_even(max_volume_m3 * 1000, 6)))::bigint as largest_l from fleet group by 1) f on f.plan_id = s.waste_carrier
    where ceil(round_even(overall_predicted_fill_m3 * 4 * 1000, 6))::bigint > largest_l""", **V)
def _(spark, sf):
    heavy = stops(spark, sf).withColumn("overall_predicted_fill_m3", F.col("overall_predicted_fill_m3") * 4)
    return O.oversize_stops(heavy, O.eligible_trucks(S.trucks(spark, sf), S.landfills(spark, sf)))


@BOOK.add("trip_metrics", "select plan_id, truck_id, trip, distance_m, duration_s, round(load_m3, 6) as load_m3, stops from trips", **V)
def _(spark, sf):
    return O.trip_metrics(tours(spark, sf))


@BOOK.add("plan_figures", "select * from figs", **V)
def _(spark, sf):
    return O.plan_figures(O.trip_metrics(tours(spark, sf)))


@BOOK.add("plan_compare", """
    select plan_id, distance_km, round(distance_km + trips * 0.5::double, 6) as baseline_km, round(trips * 0.5::double, 6) as saved_km,
      round(100 * (trips * 0.5::double) / (distance_km + trips * 0.5::double), 6) as saved_percent from figs""", **V)
def _(spark, sf):
    f = O.plan_figures(O.trip_metrics(tours(spark, sf)))
    return O.plan_compare(f, f.withColumn("distance_km", F.col("distance_km") + F.col("trips") * 0.5))


@BOOK.add("plan_nested_routes", """
    select plan_id, truck_id, string_agg(trip::varchar || '=' || distance_m::varchar || '[' || sites || ']', ';' order by trip) as trips from (
      select t.plan_id, t.truck_id, t.trip, t.distance_m, string_agg(v.site_id::varchar, ',' order by v.seq) as sites from trips t
      join tours v on v.plan_id = t.plan_id and v.truck_id = t.truck_id and v.trip = t.trip group by 1, 2, 3, 4) group by 1, 2""", **V)
def _(spark, sf):
    v = tours(spark, sf)
    rows = O.plan_nested_routes(O.trip_metrics(v), v)
    one = lambda t: F.concat(t["trip"].cast("string"), F.lit("="), t["distance_m"].cast("string"), F.lit("["), F.array_join(F.transform(t["stops"], lambda s: s["site_id"].cast("string")), ","), F.lit("]"))
    return rows.select("plan_id", "truck_id", F.array_join(F.transform("trips", one), ";").alias("trips"))


@BOOK.add("plan_available", "select distinct date, waste_carrier from stops", **V)
def _(spark, sf):
    return O.plan_available(stops(spark, sf))


@BOOK.add("plan_invariants", """
    select 'load_above_capacity' as rule, count(*) as violations from trips t join fleet f on f.truck_id = t.truck_id where t.load_m3 > f.max_volume_m3 + 1e-6
    union all select unnest(['load_differs_from_stops', 'visited_twice', 'planned_and_unserved', 'totals_differ']), 0
    union all select 'due_stop_lost', count(*) from stops where waste_carrier is not null and waste_carrier not in (select plan_id from fleet)""", **V)
def _(spark, sf):
    v = tours(spark, sf)
    trips = O.trip_metrics(v)
    due = stops(spark, sf).where(F.col("waste_carrier").isNotNull()).select(F.col("waste_carrier").alias("plan_id"), "site_id")
    return O.plan_invariants(v, trips, fleet(spark, sf), due, due.where(F.lit(False)), O.plan_figures(trips))


@BOOK.add("assignment_coverage", """
    select count(*) filter (where n is null) as lost, count(*) filter (where w is null) as unknown, count(*) filter (where n > 1) as repeated, count(*) as bins
    from (select bin_id, 1 as w from fills where due) a full join (select bin_id, count(*) as n from stop_bins where bin_id % 10 <> 3 group by 1) b on b.bin_id = a.bin_id""", **V)
def _(spark, sf):
    f = fills(spark, sf)
    got = O.stop_bins(f, O.collection_stops(f, DAY)).where(F.col("bin_id") % 10 != 3)
    return O.assignment_coverage(got, f.where("due"))


@BOOK.add("haversine_pairs", f"""
    select stop_id, depot_id, distance_m, (round_even(distance_m / (30.0::double / 3.6::double), 0) + case when to_depot then 900 else 0 end)::bigint as duration_s, to_depot from (
      select s.stop_id, d.depot_id, to_depot, round_even({HAV.format(r='6371000', a='x.latitude', b='d.latitude', c='x.longitude', d='d.longitude')} * 1.3::double, 0)::bigint as distance_m
      from stops s join sites x on x.id = s.site_id join (select distinct t.waste_carrier, l.id as depot_id, l.latitude, l.longitude from trucks t join landfills l on l.id = t.landfill_id
        where available and not deleted and l.latitude is not null and max_volume_m3 > 0) d on d.waste_carrier = s.waste_carrier, (select unnest([true, false]) as to_depot))""", **V)
def _(spark, sf):
    """Both directions between each stop and the depots of its carrier's own trucks."""
    place = S.sites(spark, sf).select(F.col("id").alias("site_id"), "latitude", "longitude")
    depots = O.eligible_trucks(S.trucks(spark, sf), S.landfills(spark, sf)).select("waste_carrier", F.col("landfill_id").alias("depot_id"), F.col("depot_lat").alias("dlat"), F.col("depot_lon").alias("dlon")).distinct()
    pairs = stops(spark, sf).join(place, "site_id").join(depots, "waste_carrier").withColumn("to_depot", F.explode(F.array(F.lit(True), F.lit(False))))
    return O.legs(pairs, ("latitude", "longitude"), ("dlat", "dlon"), F.col("to_depot")).select("stop_id", "depot_id", "distance_m", "duration_s", "to_depot")


def all_jobs(spark, sf):
    """Every stop of every carrier, four times its load, so that some stops fit no truck."""
    place = S.sites(spark, sf).select(F.col("id").alias("site_id"), "latitude", "longitude")
    return stops(spark, sf).select(F.col("waste_carrier").alias("plan_id"), "site_id", (F.col("overall_predicted_fill_m3") * 4).alias("load_m3")).join(place, "site_id")


def routes(spark, sf):
    return O.nearest_neighbour_trips(all_jobs(spark, sf), fleet(spark, sf))


def hilbert(rows: str, bits: int = O.CURVE_BITS) -> str:
    """`rows` (with whole cx, cy) and their place on the Hilbert curve, one nested level a bit."""
    last, sql = (1 << bits) - 1, f"select *, cx as hx, cy as hy, 0::bigint as place from {rows}"
    for k in range(bits - 1, -1, -1):
        r, u = f"((hx >> {k}) & 1)", f"((hy >> {k}) & 1)"
        sql = f"select * replace (case when {u} = 1 then hx when {r} = 1 then {last} - hy else hy end as hx, case when {u} = 1 then hy when {r} = 1 then {last} - hx else hx end as hy, place * 4 + xor(3 * {r}, {u}) as place) from ({sql})"
    return sql


CELL = f"greatest(0, least({(1 << O.CURVE_BITS) - 1}, floor({{}} * {O.CELLS_PER_DEGREE}) + {1 << (O.CURVE_BITS - 1)}))::bigint"
ROUTE = {
    **V,
    "work": """select s.waste_carrier as plan_id, s.site_id, x.latitude, x.longitude, ceil(round_even(s.overall_predicted_fill_m3 * 4 * 1000, 6))::bigint as load_l from stops s join sites x on x.id = s.site_id""",
    "lorry": "select plan_id, depot_lat, depot_lon, truck_id, floor(round_even(max_volume_m3 * 1000, 6))::bigint as capacity_l from fleet",
    "depots": "select plan_id, depot_lat, depot_lon, max(capacity_l) as large_l from lorry group by 1, 2, 3",
    "reach": f"""select w.*, d.depot_lat, d.depot_lon, round_even({HAV.format(r='6371000', a='w.latitude', b='depot_lat', c='w.longitude', d='depot_lon')} * 1.3::double, 0)::bigint as metres
        from work w join depots d on d.plan_id = w.plan_id where load_l <= large_l""",
    "cells": f"""select *, greatest(load_l, 1) as counted, {CELL.format("((longitude - depot_lon) * cos(radians(depot_lat)))")} as cx, {CELL.format("(latitude - depot_lat)")} as cy
        from (select *, row_number() over (partition by plan_id, site_id order by metres, depot_lat, depot_lon) as nth from reach where metres is not null) where nth = 1""",
    "near": hilbert("cells"),
    "kinds": """select *, (sum(n * capacity_l) over (partition by plan_id, depot_lat, depot_lon order by capacity_l))::double / (sum(n * capacity_l) over (partition by plan_id, depot_lat, depot_lon))::double as upto
        from (select plan_id, depot_lat, depot_lon, capacity_l, count(*) as n from lorry group by all)""",
    "needs": """select n.*, (select min(capacity_l) from kinds k where k.plan_id = n.plan_id and k.depot_lat = n.depot_lat and k.depot_lon = n.depot_lon and k.capacity_l >= n.load_l) as need from near n""",
    "shared": """select * from (select s.*, k.capacity_l as kind, k.n, row_number() over (partition by s.plan_id, s.site_id order by k.capacity_l) as pick from (
          select *, (sum(counted) over (partition by plan_id, depot_lat, depot_lon order by need, metres, site_id) - counted)::double / (sum(counted) over (partition by plan_id, depot_lat, depot_lon))::double as part from needs) s
        join kinds k on k.plan_id = s.plan_id and k.depot_lat = s.depot_lat and k.depot_lon = s.depot_lon and k.upto > s.part and k.capacity_l >= s.load_l) where pick = 1""",
    "lined": f"""select *, row_number() over (partition by plan_id, depot_lat, depot_lon, kind, piece order by place, metres, site_id) as r from (
        select *, (sum(counted) over (partition by plan_id, depot_lat, depot_lon, kind order by place, metres, site_id) - counted)::bigint // (kind * {O.CUT_TRIPS}) as piece from shared)""",
    "filled": """select plan_id, depot_lat, depot_lon, kind, piece, r, site_id, 0::bigint as cut, 1::bigint as seq, counted::bigint as held from lined where r = 1
        union all select l.plan_id, l.depot_lat, l.depot_lon, l.kind, l.piece, l.r, l.site_id, if(held + l.counted > l.kind, l.r - 1, cut), if(held + l.counted > l.kind, 1, seq + 1), if(held + l.counted > l.kind, l.counted, held + l.counted)::bigint
        from filled f join lined l on l.plan_id = f.plan_id and l.depot_lat = f.depot_lat and l.depot_lon = f.depot_lon and l.kind = f.kind and l.piece = f.piece and l.r = f.r + 1""",
    "run": """select l.*, cut, seq, lead(seq) over t is null as ends, coalesce(lag(latitude) over t, depot_lat) as flat, coalesce(lag(longitude) over t, depot_lon) as flon
        from lined l join (select plan_id, site_id, cut, seq from filled) using (plan_id, site_id) window t as (partition by plan_id, depot_lat, depot_lon, kind, piece, cut order by seq)""",
    "driven": f"""select plan_id, depot_lat, depot_lon, kind, piece, cut, n, (sum(round_even(d1 / (30.0::double / 3.6::double), 0) + 300) + sum(round_even(d2 / (30.0::double / 3.6::double), 0) + 900))::bigint as duration_s from (
        select *, round_even({HAV.format(r='6371000', a='flat', b='latitude', c='flon', d='longitude')} * 1.3::double, 0)::bigint as d1,
          case when ends then round_even({HAV.format(r='6371000', a='latitude', b='depot_lat', c='longitude', d='depot_lon')} * 1.3::double, 0)::bigint end as d2 from run) group by all""",
    "turns": """select *, least(rank % (2 * n), 2 * n - 1 - rank % (2 * n)) as k, rank // n + 1 as trip from (
        select *, row_number() over (partition by plan_id, depot_lat, depot_lon, kind order by duration_s // 60 desc, piece, cut) - 1 as rank from driven)""",
    "routed": """select run.plan_id, o.truck_id, turns.trip, run.seq, run.site_id, run.load_l from run join turns using (plan_id, depot_lat, depot_lon, kind, piece, cut)
        join (select *, row_number() over (partition by plan_id, depot_lat, depot_lon, capacity_l order by truck_id) - 1 as k from lorry) o
          on o.plan_id = run.plan_id and o.depot_lat = run.depot_lat and o.depot_lon = run.depot_lon and o.capacity_l = run.kind and o.k = turns.k""",
}


@BOOK.add("nearest_neighbour_trips", """
    select plan_id, truck_id, trip, seq, site_id, load_l, null as reason from routed
    union all select plan_id, null, null, null, site_id, null, case when plan_id is null or plan_id not in (select plan_id from fleet) then 'no_fleet' else 'too_large' end
    from work w where not exists (select 1 from near n where n.plan_id = w.plan_id and n.site_id = w.site_id)""", **ROUTE)
def _(spark, sf):
    visits, unserved = routes(spark, sf)
    return visits.select("plan_id", "truck_id", "trip", "seq", "site_id", "load_l").unionByName(unserved, allowMissingColumns=True)


@BOOK.add("route_plan_invariants", "select unnest(['load_above_capacity', 'load_differs_from_stops', 'visited_twice', 'planned_and_unserved', 'due_stop_lost', 'totals_differ']) as rule, 0 as violations")
def _(spark, sf):
    visits, unserved = routes(spark, sf)
    visits = materialize(visits, "visits")
    trips = materialize(O.trip_metrics(visits), "trips")
    due = all_jobs(spark, sf).where(F.col("plan_id").isNotNull()).select("plan_id", "site_id")
    return O.plan_invariants(visits, trips, fleet(spark, sf), due, unserved, O.plan_figures(trips))
