"""Filters, predicates and projections."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from wastelake.catalog.book import Book
from wastelake.functions import bands as B
from wastelake.operators import filters as O
from wastelake.plans.context import Area, Period, in_area, in_period, in_scope
from wastelake.sources import tables as S

BOOK = Book()
AREA = Area((25.05, 54.60, 25.40, 54.80), datetime(2024, 6, 25, 12))
IN_AREA = "latitude between 54.60 and 54.80 and longitude between 25.05 and 25.40"


@BOOK.add("filter_bbox", f"select id, latitude, longitude from (select id, round(latitude, 6) as latitude, round(longitude, 6) as longitude from bins where {IN_AREA})")
def _(spark, sf):
    return in_area(S.bins(spark, sf), AREA).select("id", "latitude", "longitude")


@BOOK.add("filter_valid_coords", "select id, name from landfills where latitude is not null and longitude is not null and latitude between -90 and 90 and longitude between -180 and 180")
def _(spark, sf):
    return O.valid_coordinates(S.landfills(spark, sf)).select("id", "name")


@BOOK.add("filter_eligible", """
    select id, waste_type, city from bins where waste_type in ('Mixed municipal waste','Paper/plastic waste','Glass waste')
      and lower(regexp_replace(trim(coalesce(object_group, '')), '\\s+', ' ', 'g')) <> 'individualios valdos'
      and (coalesce(city, '') = '' or lower(city) like '%vilniaus%')
      and latitude between 54.60 and 54.80 and longitude between 25.05 and 25.40""")
def _(spark, sf):
    return O.eligible(S.bins(spark, sf), AREA.bbox).select("id", "waste_type", "city")


@BOOK.add("filter_scope", f"""
    select 'area' as scope, count(*) as bins from bins where {IN_AREA}
    union all select 'global', count(*) from bins where latitude between -90 and 90 and longitude between -180 and 180
    union all select 'selection', count(*) from bins where {IN_AREA} and id in (select bin_id from predictions where predicted_fill > 2)""")
def _(spark, sf):
    bins = S.bins(spark, sf)
    picked = S.predictions(spark, sf).where(F.col("predicted_fill") > 2)
    parts = [("area", in_scope(bins, AREA)), ("global", in_scope(bins, AREA, "global")), ("selection", in_scope(bins, AREA, selection=picked))]
    counts = [df.agg(F.count("*").alias("bins")).select(F.lit(n).alias("scope"), "bins") for n, df in parts]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@BOOK.add("filter_period", """
    select 'recent' as period, count(*) as attempts, min(date) as first_at, max(date) as last_at from visits where date >= timestamp '2024-05-27' and date < timestamp '2024-06-25 12:00:00'
    union all select 'explicit', count(*), min(date), max(date) from visits where date >= timestamp '2024-06-10' and date < timestamp '2024-06-20'
    union all select 'all_history', count(*), min(date), max(date) from visits where date < timestamp '2024-06-25 12:00:00'""")
def _(spark, sf):
    visits = S.visits(spark, sf)
    periods = {"recent": Period(), "explicit": Period("explicit", date(2024, 6, 10), date(2024, 6, 20)), "all_history": Period("all_history")}
    frames = [
        visits.where(in_period(F.col("date"), AREA, p)).agg(F.count("*").alias("attempts"), F.min("date").alias("first_at"), F.max("date").alias("last_at")).select(F.lit(n).alias("period"), "*")
        for n, p in periods.items()
    ]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@BOOK.add("filter_ilike_escaped", r"select id, address from sites where address ilike '%vė 1\_1%' escape '\'")
def _(spark, sf):
    return O.sites_matching(S.sites(spark, sf), "  VĖ 1_1 ").select("id", "address")


@BOOK.add("filter_optional", r"""
    select id, name, max_volume_m3, waste_carrier from trucks
    where not deleted and available and max_volume_m3 >= 10 and max_volume_m3 <= 16 and waste_carrier = 'carrier_1' and name ilike '%1%' """)
def _(spark, sf):
    rows = O.trucks_matching(S.trucks(spark, sf), name="1", available=True, minimum=10.0, maximum=16.0, waste_carrier="carrier_1")
    return rows.select("id", "name", "max_volume_m3", "waste_carrier")


@BOOK.add("project_known_capacity", """
    select id, case when not isnan(capacity_m3) and not isinf(capacity_m3) then capacity_m3 end as known_capacity_m3,
      case when capacity_m3 is null then 'missing' when isnan(capacity_m3) or isinf(capacity_m3) then 'invalid_source_value' else 'known' end as capacity_quality from bins""")
def _(spark, sf):
    return O.with_bands(S.bins(spark, sf)).select("id", "known_capacity_m3", "capacity_quality")


@BOOK.add("project_capacity_band", """
    select id, case when capacity_m3 is null or isnan(capacity_m3) then 'missing' when capacity_m3 <= 0 then 'invalid' when capacity_m3 <= 0.24 then 'small'
      when capacity_m3 <= 1.1 then 'medium' when capacity_m3 <= 3 then 'large' when capacity_m3 <= 5 then 'very_large' else 'extra_large' end as capacity_range from bins""")
def _(spark, sf):
    return O.with_bands(S.bins(spark, sf)).select("id", "capacity_range")


@BOOK.add("project_qr_band", """
    select case when n is null then 'missing' when n <= 0 then 'zero' when n <= 1 then 'one' when n <= 5 then '2-5' when n <= 20 then '6-20'
      when n <= 100 then '21-100' else '101+' end as qr_range, count(*) as bins
    from bins left join (select bin_id, count(*) as n from requests group by 1) on bin_id = id group by 1""")
def _(spark, sf):
    n = S.requests(spark, sf).groupBy(F.col("bin_id").alias("id")).agg(F.count("*").alias("n"))
    joined = S.bins(spark, sf).join(n, "id", "left")
    return joined.groupBy(B.qr_band(F.col("n")).alias("qr_range")).agg(F.count("*").alias("bins"))


@BOOK.add("project_density_band", """
    select id, case when suppressed then 'suppressed (assumed density)' when density_per_ha is null then 'unavailable' when density_per_ha < 11 then '<11'
      when density_per_ha < 50 then '11–49' when density_per_ha < 100 then '50–99' when density_per_ha < 200 then '100–199' else '200+' end as band from residents""")
def _(spark, sf):
    from wastelake.operators.allocation import parse_density

    return parse_density(S.cells(spark, sf)).select("id", B.density_band(F.col("density_per_ha"), F.col("suppressed")).alias("band"))


@BOOK.add("project_bin_category", """
    select case waste_type when 'Mixed municipal waste' then 'mixed' when 'Paper/plastic waste' then 'paper_plastic' when 'Glass waste' then 'glass' else 'other' end as category,
      count(*) as bins from bins group by 1""")
def _(spark, sf):
    return O.with_bands(S.bins(spark, sf)).groupBy("category").agg(F.count("*").alias("bins"))


@BOOK.add("project_fill_class", """
    select l_quantity * 2.4 as pct, case when l_quantity * 2.4 > 100 then 4 when l_quantity * 2.4 >= 80 then 3 when l_quantity * 2.4 >= 50 then 2
      when l_quantity * 2.4 >= 20 then 1 else 0 end as fill_class, count(*) as n from (select l_quantity::double as l_quantity from lineitem) group by 1, 2""", digits=4)
def _(spark, sf):
    pct = F.col("l_quantity") * F.lit(2.4)
    return S.table(spark, sf, "lineitem").groupBy(pct.alias("pct"), B.fill_class(pct).alias("fill_class")).agg(F.count("*").alias("n"))


BOOK.oracles["project_fill_class"] = BOOK.oracles["project_fill_class"].replace("select l_quantity * 2.4 as pct", "select round(l_quantity * 2.4, 4) as pct")


@BOOK.add("project_fill_share", """
    select bin_id, predicted_fill, (case predicted_fill when 0 then 0.2 when 1 then 0.5 when 2 then 0.8 when 3 then 1.0 else 1.5 end)::double as share from predictions""")
def _(spark, sf):
    return S.predictions(spark, sf).select("bin_id", "predicted_fill", B.fill_share(F.col("predicted_fill")).alias("share"))
