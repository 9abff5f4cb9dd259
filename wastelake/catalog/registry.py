"""Registry conformance."""

from __future__ import annotations

from pyspark.sql import functions as F

from wastelake.catalog.book import Book
from wastelake.functions import text as T
from wastelake.operators import registry as O
from wastelake.sources import tables as S

BOOK = Book()

V = {
    "canon": """select b.*, a.canonical as canonical_district from bins b left join
        (select input as k, canonical from aliases union select canonical, canonical from aliases) a
        on a.k = trim(regexp_replace(b.sub_district, '\\s+', ' ', 'g'))""",
    "bad_sites": "select site_id from canon group by 1 having count(distinct canonical_district) > 1",
    "reasoned": """select c.*, p.resident_factor, list_filter([
        case when coalesce(trim(regexp_replace(object_group, '\\s+', ' ', 'g')), '') not in ('Daugiabučiai namai','Dvibučiai','Daugiabučių/garažų bendrijos','Sodų bendrijos',
          'Sodų/garažų bendrijos','Viešosios vietos','Garažų bendrijos','Viešosios įstaigos','Juridiniai asmenys','Komercinė paskirtis') then 'missing_or_unsupported_object_group' end,
        case when waste_type not in ('Mixed municipal waste','Paper/plastic waste','Glass waste','Food/organic waste','Textiles') then 'unknown_waste_stream' end,
        case when capacity_m3 is null or isnan(capacity_m3) or capacity_m3 <= 0 then 'non_positive_or_non_finite_capacity' end,
        case when object_group in ('Daugiabučiai namai','Dvibučiai','Daugiabučių/garažų bendrijos','Sodų bendrijos','Sodų/garažų bendrijos')
          and (p.resident_factor is null or p.resident_factor < 0) then 'invalid_residential_exposure' end,
        case when canonical_district is null then 'unresolved_district' end,
        case when c.site_id in (select site_id from bad_sites) then 'contradictory_site_districts' end], lambda x : x is not null) as reasons
      from canon c left join bin_population p on p.bin_id = c.id""",
}
RESIDENTIAL = "object_group in ('Daugiabučiai namai','Dvibučiai','Daugiabučių/garažų bendrijos','Sodų bendrijos','Sodų/garažų bendrijos')"


@BOOK.add("normalize_address", "select id, lower(trim(regexp_replace(address, '\\s+', ' ', 'g'))) as normalized from sites")
def _(spark, sf):
    return S.sites(spark, sf).select("id", T.normalize_address(F.col("address")).alias("normalized"))


SITE_KEY = """
  select *, case when a <> '' then 'address:' || lower(a) else 'unknown:' || external_id::varchar end as site_key,
    case when a <> '' then a else 'Unknown address (' || external_id::varchar || ')' end as site_address
  from (select *, trim(regexp_replace(coalesce(trim(street), '') || ' ' || coalesce(trim(house_number), ''), '\\s+', ' ', 'g')) as a from bins)"""


@BOOK.add("site_identity", "select id, site_key, site_address from keyed", keyed=SITE_KEY)
def _(spark, sf):
    return O.site_identity(S.bins(spark, sf)).select("id", "site_key", "site_address")


@BOOK.add("build_sites", """
    select site_key, min(site_address) as address, round(avg(latitude), 6) as latitude, round(avg(longitude), 6) as longitude, count(*) as bins
    from keyed group by site_key""", keyed=SITE_KEY)
def _(spark, sf):
    return O.build_sites(O.site_identity(S.bins(spark, sf)))


@BOOK.add("resolve_conflicts", """
    select l_orderkey as id, l_suppkey as tile_x, l_partkey as tile_y, l_linenumber as num, l_returnflag as flag from (
      select *, row_number() over (partition by l_orderkey order by l_suppkey, l_partkey,
        '{"tile_x":' || l_suppkey || ',"tile_y":' || l_partkey || ',"num":' || l_linenumber || ',"flag":"' || l_returnflag || '"}') as rn from lineitem) where rn = 1""")
def _(spark, sf):
    obs = S.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("tile_x"), F.col("l_partkey").alias("tile_y"),
        F.col("l_linenumber").alias("num"), F.col("l_returnflag").alias("flag"),
    )
    return O.resolve_conflicts(obs, "id", ["tile_x", "tile_y"])


@BOOK.add("merge_registry", """
    select coalesce(n.external_id, o.external_id) as external_id, case when n.external_id is not null then n.waste_type else o.waste_type end as waste_type,
      case when n.external_id is not null then n.city else o.city end as city
    from (select external_id, waste_type, city from bins where external_id is not null and id % 3 <> 0) o
    full join (select external_id, upper(waste_type) as waste_type, null as city from bins where external_id is not null and (id % 2 = 0 or id % 3 = 0)) n on n.external_id = o.external_id""")
def _(spark, sf):
    bins = S.bins(spark, sf).where(F.col("external_id").isNotNull())
    old = bins.where(F.col("id") % 3 != 0).select("external_id", "waste_type", "city")
    new = bins.where((F.col("id") % 2 == 0) | (F.col("id") % 3 == 0)).select("external_id", F.upper("waste_type").alias("waste_type"), F.lit(None).cast("string").alias("city"))
    return O.merge_by_key(old, new, ["external_id"])


@BOOK.add("merge_history", """
    select bin_id, date, was_serviced, case when max(age) = 1 then max(case when age = 1 then reason end) else max(reason) end as non_serviced_reason from (
      select bin_id, date_trunc('hour', date) as date, was_serviced, non_serviced_reason as reason, 0 as age from visits where id % 3 <> 0
      union all select bin_id, date_trunc('hour', date), was_serviced, 'new_' || (id % 4)::varchar, 1 from visits where id % 2 = 0 or id % 3 = 0) group by 1, 2, 3""")
def _(spark, sf):
    hourly = S.visits(spark, sf).withColumn("date", F.date_trunc("hour", F.col("date")).cast("timestamp_ntz"))
    new = hourly.where((F.col("id") % 2 == 0) | (F.col("id") % 3 == 0)).withColumn("non_serviced_reason", F.concat(F.lit("new_"), (F.col("id") % 4).cast("string")))
    return O.merge_history(hourly.where(F.col("id") % 3 != 0), new)


@BOOK.add("drop_stale_in_bbox", """
    select id, site_id from bins where not (latitude between 54.60 and 54.80 and longitude between 25.05 and 25.40 and external_id is not null and external_id % 3 = 0)""")
def _(spark, sf):
    bins = S.bins(spark, sf)
    seen = bins.where(F.col("external_id") % 3 != 0).select("external_id")
    return O.drop_stale(bins, seen, (25.05, 54.60, 25.40, 54.80)).select("id", "site_id")


@BOOK.add("canonical_district", "select id, sub_district, coalesce(canonical_district, '__AMBIGUOUS__') as canonical_district from canon", **V)
def _(spark, sf):
    named = O.canonical_districts(S.bins(spark, sf), S.district_aliases(spark, sf))
    return named.select("id", "sub_district", F.coalesce("canonical_district", F.lit("__AMBIGUOUS__")).alias("canonical_district"))


@BOOK.add("contradictory_sites", """
    select id, site_id, case when site_id in (select site_id from bad_sites) or canonical_district is null then '__AMBIGUOUS__' else canonical_district end as sub_district from canon""", **V)
def _(spark, sf):
    return O.ambiguous_districts(S.bins(spark, sf), S.district_aliases(spark, sf)).select("id", "site_id", "sub_district")


def reasoned(spark, sf):
    bins = O.population_join(S.bins(spark, sf), S.bin_population(spark, sf))
    return O.exclusion_reasons(bins, S.district_aliases(spark, sf))


@BOOK.add("exclusion_reasons", "select id, array_to_string(reasons, ';') as reasons from reasoned", **V)
def _(spark, sf):
    return reasoned(spark, sf).select("id", F.array_join("reasons", ";").alias("reasons"))


@BOOK.add("quality_flag", """
    select id, case when len(r) = 0 then 'complete' when len(r) > 1 then 'multiple_issues:' || array_to_string(r, '|') else r[1] end as input_quality_flag from (
      select id, list_filter([case when qr is null then 'missing_qr_history' end, case when object_group is null then 'missing_object_group' end,
        case when sub_district is null then 'ambiguous_district' end, case when capacity_m3 is null or isnan(capacity_m3) or capacity_m3 <= 0 then 'invalid_capacity' end,
        case when visits is null then 'no_daily_history' end, case when coalesce(labels, 0) = 0 then 'no_historical_labels' end], lambda x : x is not null) as r
      from bins left join (select bin_id, count(*) as qr from requests group by 1) q on q.bin_id = id
      left join (select bin_id, count(*) as visits, count(fill_level) as labels from visits group by 1) v on v.bin_id = id)""")
def _(spark, sf):
    q = S.requests(spark, sf).groupBy(F.col("bin_id").alias("id")).agg(F.count("*").alias("qr_alerts"))
    v = S.visits(spark, sf).groupBy(F.col("bin_id").alias("id")).agg(F.count("*").alias("visits"), F.count("fill_level").alias("labels"))
    rows = S.bins(spark, sf).join(q, "id", "left").join(v, "id", "left")
    rows = rows.withColumns({"has_daily_history": F.col("visits").isNotNull(), "history_label_count": F.coalesce("labels", F.lit(0))})
    return O.quality_flag(rows).select("id", "input_quality_flag")


@BOOK.add("clean_non_finite", """
    select id, case when not isnan(capacity_m3) and capacity_m3 > 0 then capacity_m3 end as capacity_m3, client_count,
      coalesce(nullif(trim(object_group), ''), '__MISSING__') as object_group, coalesce(sub_district, '__MISSING__') as sub_district from bins""")
def _(spark, sf):
    out = O.clean_non_finite(S.bins(spark, sf), ["capacity_m3", "client_count"], ["object_group", "sub_district"])
    return out.select("id", "capacity_m3", "client_count", "object_group", "sub_district")


@BOOK.add("latest_event_per_day", """
    select bin_id, date::date as day, count(*) as attempts, max(id) filter (where rn = 1) as id, max(date) as date, bool_or(was_serviced) filter (where rn = 1) as was_serviced,
      max(fill_level) filter (where rn = 1) as fill_level, max(non_serviced_reason) filter (where rn = 1) as non_serviced_reason
    from (select *, row_number() over (partition by bin_id, date::date order by date desc, id desc) as rn from visits) group by 1, 2""")
def _(spark, sf):
    return O.latest_event_per_day(S.visits(spark, sf))


@BOOK.add("referential_audit", """
    with b as (select id from bins where id % 7 <> 0 union all select id from bins where id % 100 = 1), o as (select * from visits where bin_id not in (select id from b))
    select 'orphan_rows' as rule, count(*) as value from o union all select 'orphan_keys', count(distinct bin_id) from o
    union all select 'duplicate_parents', count(*) from (select id from b group by 1 having count(*) > 1)""")
def _(spark, sf):
    bins = S.bins(spark, sf)
    parents = bins.where(F.col("id") % 7 != 0).unionByName(bins.where(F.col("id") % 100 == 1))
    return O.referential_audit(S.visits(spark, sf), parents, "bin_id", "id")


@BOOK.add("population_join", "select id, population_cell_id, resident_factor from bins left join bin_population on bin_id = id")
def _(spark, sf):
    return O.population_join(S.bins(spark, sf), S.bin_population(spark, sf)).select("id", "population_cell_id", "resident_factor")


@BOOK.add("shared_exposure", f"""
    select id, round(case when {RESIDENTIAL} then resident_factor else 100 * capacity_m3 / sum(case when not {RESIDENTIAL} then capacity_m3 end) over (partition by site_id, waste_type) end, 6) as exposure
    from reasoned where len(reasons) = 0""", **V)
def _(spark, sf):
    return O.shared_exposure(reasoned(spark, sf)).select("id", "exposure")


@BOOK.add("exposure_pools", f"""
    select site_id, waste_type, count(*) filter (where len(reasons) = 0 and not {RESIDENTIAL}) as members,
      round(sum(capacity_m3) filter (where len(reasons) = 0 and not {RESIDENTIAL}), 6) as pool_capacity_m3, count(*) filter (where len(reasons) > 0) as excluded_bins, 100.0::double as total_users
    from reasoned group by 1, 2 having count(*) filter (where len(reasons) = 0 and not {RESIDENTIAL}) > 0""", **V)
def _(spark, sf):
    return O.exposure_pools(reasoned(spark, sf))
