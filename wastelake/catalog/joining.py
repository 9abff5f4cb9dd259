"""Logical joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from wastelake.catalog import planning as CP
from wastelake.catalog.book import Book
from wastelake.operators import joins as O, planning as P
from wastelake.sources import tables as S

BOOK = Book()


@BOOK.add("join_inner_fk", "select v.id, v.bin_id, v.date, b.waste_type, b.waste_carrier from visits v join bins b on b.id = v.bin_id")
def _(spark, sf):
    return O.inner_by_bin(S.visits(spark, sf).select("id", "bin_id", "date"), S.bins(spark, sf))


@BOOK.add("join_left_latest", "select b.id, max(v.date) as latest_attempt, max(v.date) filter (where v.was_serviced) as latest_success from bins b left join visits v on v.bin_id = b.id group by 1")
def _(spark, sf):
    v = S.visits(spark, sf).groupBy(F.col("bin_id").alias("id")).agg(F.max("date").alias("latest_attempt"), F.max(F.when(F.col("was_serviced"), F.col("date"))).alias("latest_success"))
    return S.bins(spark, sf).select("id").join(v, "id", "left")


@BOOK.add("join_left_preagg", "select id, (select count(*) from visits where bin_id = b.id) as attempts, (select count(*) from requests where bin_id = b.id) as submissions from bins b")
def _(spark, sf):
    return O.left_pre_aggregated(S.bins(spark, sf).select("id"), attempts=S.visits(spark, sf), submissions=S.requests(spark, sf))


@BOOK.add("join_null_safe", "select b.id, b.waste_carrier, s.stop_id from bins b join stops s on s.site_id = b.site_id and s.waste_carrier is not distinct from b.waste_carrier", **CP.V)
def _(spark, sf):
    return O.null_safe(S.bins(spark, sf).select("id", "site_id", "waste_carrier"), CP.stops(spark, sf).select("site_id", "waste_carrier", "stop_id"), "waste_carrier", ["site_id"]).drop("site_id")


@BOOK.add("join_semi_exists", "select stop_id, n_bins from stops s where exists (select 1 from stop_bins b where b.stop_id = s.stop_id and b.due)", **CP.V)
def _(spark, sf):
    f = CP.fills(spark, sf)
    st = P.collection_stops(f, CP.DAY)
    return P.stops_with_due(st, P.stop_bins(f, st)).select("stop_id", "n_bins")


@BOOK.add("join_anti_not_exists", "select id, sub_district from bins b where sub_district is not null and not exists (select 1 from bin_population p where p.bin_id = b.id)")
def _(spark, sf):
    known = S.bin_population(spark, sf).select(F.col("bin_id").alias("id"))
    return S.bins(spark, sf).where(F.col("sub_district").isNotNull()).join(known, "id", "left_anti").select("id", "sub_district")


@BOOK.add("join_left_landfill", "select t.id, t.landfill_id, l.name as landfill_name, round(l.latitude, 6) as depot_lat from trucks t left join landfills l on l.id = t.landfill_id")
def _(spark, sf):
    return P.trucks_with_landfill(S.trucks(spark, sf), S.landfills(spark, sf)).select("id", "landfill_id", "landfill_name", "depot_lat")


@BOOK.add("join_theta_since", """
    select v.bin_id, v.okat, (select count(*) from requests r where r.bin_id = v.bin_id and r."timestamp" > v.okat) as later from (select bin_id, max(date) as okat from visits where was_serviced group by 1) v""")
def _(spark, sf):
    base = S.visits(spark, sf).where("was_serviced").groupBy("bin_id").agg(F.max("date").alias("okat"))
    hits = S.requests(spark, sf).join(base, "bin_id").groupBy("bin_id").agg(F.count_if(F.col("timestamp") > F.col("okat")).alias("later"))
    return base.join(hits, "bin_id", "left").withColumn("later", F.coalesce("later", F.lit(0)))


@BOOK.add("join_asof_prior", "select bin_id, date, last_value(fill_level ignore nulls) over (partition by bin_id order by date rows between unbounded preceding and 1 preceding) as prior_level from bin_days")
def _(spark, sf):
    return O.asof_prior(S.bin_days(spark, sf).select("bin_id", "date", "fill_level"), "bin_id", "date", "fill_level", "prior_level").drop("fill_level")


@BOOK.add("join_asof_next_day", "select b.id as bin_id, h.last_date, h.last_status from bins b left join (select bin_id, max(date) as last_date, arg_max(collection_status, date) as last_status from bin_days where date <= date '2024-06-20' group by 1) h on h.bin_id = b.id")
def _(spark, sf):
    days = S.bin_days(spark, sf).where(F.col("date") <= "2024-06-20")
    last = days.groupBy("bin_id").agg(F.max(F.struct("date", "collection_status")).alias("s"))
    return S.bins(spark, sf).select(F.col("id").alias("bin_id")).join(last, "bin_id", "left").select("bin_id", F.col("s.date").alias("last_date"), F.col("s.collection_status").alias("last_status"))


@BOOK.add("join_many_to_one_checked", "select s.row_id, g.med from scores s left join (select case when waste_type = '5-LOW' then 'retired' else waste_type end as waste_type, quantile_cont(fill_level, 0.5) as med from scores group by 1) g on g.waste_type = s.waste_type")
def _(spark, sf):
    s = S.scores(spark, sf)
    renamed = F.when(F.col("waste_type") == "5-LOW", "retired").otherwise(F.col("waste_type"))
    per = s.withColumn("waste_type", renamed).groupBy("waste_type", "fill_level").agg(F.count("*").alias("n"))
    med = per.groupBy("waste_type").agg(F.percentile("fill_level", 0.5, F.col("n")).alias("med"))
    return O.many_to_one(s.select("row_id", "waste_type"), med, ["waste_type"]).select("row_id", "med")


@BOOK.add("join_cross_grid", "select c.id, k.waste_type from cells c, (select unnest(['Mixed municipal waste','Paper/plastic waste','Glass waste']) as waste_type) k")
def _(spark, sf):
    return O.grid(S.cells(spark, sf).select("id"), ["Mixed municipal waste", "Paper/plastic waste", "Glass waste"], "waste_type")


@BOOK.add("join_point_in_polygon", "select s.id, min(d.id) as polygon_id from sites s join districts d on s.longitude >= d.x0 and s.longitude < d.x1 and s.latitude >= d.y0 and s.latitude < d.y1 group by 1")
def _(spark, sf):
    from wastelake.operators.spatial import membership

    return membership(S.sites(spark, sf), S.districts(spark, sf)).select("id", "polygon_id")


@BOOK.add("join_nearest", """
    select s.id as source_id, arg_min(l.id, {'d': sqrt(pow(l.longitude * (cos(radians(54.7::double)) * 111320.0::double) - s.longitude * (cos(radians(54.7::double)) * 111320.0::double), 2) + pow((l.latitude - s.latitude) * 111320.0::double, 2)), 'i': l.id}) as point_id
    from sites s, landfills l where l.latitude is not null group by 1""")
def _(spark, sf):
    from wastelake.functions import geo as G
    from wastelake.operators.spatial import nearest_point

    place = lambda df, name: df.select(F.col("id").alias(name), F.lit("all").alias("kind"), G.project_x(F.col("longitude")).alias("x"), G.project_y(F.col("latitude")).alias("y"))
    near = nearest_point(place(S.sites(spark, sf), "source_id"), place(S.landfills(spark, sf).where(F.col("latitude").isNotNull()), "point_id"))
    return near.select("source_id", "point_id")
