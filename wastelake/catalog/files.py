"""Sources, parsing, sinks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from wastelake.catalog import calendar as CC
from wastelake.catalog.book import Book, tidy
from wastelake.session import fresh_path
from wastelake.sources import files as O, sinks as K, tables as S

BOOK = Book()
CSV_COLUMNS = ["id", "site_id", "waste_type", "sub_district", "object_group", "city", "waste_carrier", "client_count"]
CSV_SCHEMA = "id long, site_id long, waste_type string, sub_district string, object_group string, city string, waste_carrier string, client_count int"


def exported(spark, sf):
    path = fresh_path(spark, "bins-csv")
    K.write_csv(S.bins(spark, sf).select(*CSV_COLUMNS), path)
    return path


@BOOK.add("scan_csv_null_token", f"select {', '.join(CSV_COLUMNS)} from bins")
def _(spark, sf):
    df = O.read_csv(spark, exported(spark, sf), CSV_SCHEMA)
    # leading and trailing spaces survive, '' and NULL stay distinct
    return df


@BOOK.add("scan_csv_blank_null", "select id, nullif(object_group, '') as object_group, nullif(city, '') as city from bins")
def _(spark, sf):
    return O.read_csv(spark, exported(spark, sf), CSV_SCHEMA, blank_is_null=True).select("id", "object_group", "city")


@BOOK.add("scan_typed_daily", "select bin_id, date, collection_status, fill_level, qr_alerts, collections_last_28d, season from enr", **CC.V)
def _(spark, sf):
    days = CC.enriched(spark, sf)
    path = fresh_path(spark, "daily-csv")
    names = [p.split()[0] for p in O.DAILY_SCHEMA.split(", ")]
    K.write_csv(days.select(*names), path)
    return O.read_daily(spark, path).select("bin_id", "date", "collection_status", "fill_level", "qr_alerts", "collections_last_28d", "season")


@BOOK.add("scan_latest_export", "select id, 'v10' as version from sites where id % 3 = 0")
def _(spark, sf):
    root = fresh_path(spark, "exports")
    sites = S.sites(spark, sf)
    for v, keep in ((9, 2), (10, 3)):
        K.write_csv(sites.where(F.col("id") % keep == 0).select("id", F.lit(f"v{v}").alias("version")), f"{root}/sites_{v}.csv")
    return O.read_csv(spark, O.latest_export(spark, root, "sites"), "id long, version string")


def cell_features(spark, sf):
    return K.polygon_features(S.cells(spark, sf), ["density_text", "area_m2"])


@BOOK.add("scan_geojson_features", """
    select case when id % 10 <> 6 then id end as id, case when id % 10 <> 6 then density_text end as density_text, case when id % 10 > 6 or id % 10 < 6 and id % 10 <> 5 and id % 10 <> 4 then case when holed then 2 else 1 end end::integer as rings,
      case when id % 10 not in (4, 5, 6) then round(x0, 6) end as first_lon, case when id % 10 not in (4, 5, 6) then round(y0, 6) end as first_lat,
      case id % 10 when 4 then 'missing_geometry' when 5 then 'missing_geometry' when 6 then 'corrupt_record' end as error, count(*) as rows from cells group by all""")
def _(spark, sf):
    path, broken = fresh_path(spark, "cells-geojson"), fresh_path(spark, "cells-broken")
    K.write_geojson(cell_features(spark, sf), path)
    line, kind = F.col("value"), F.get_json_object("value", "$.id").cast("long") % 10
    cut = F.when(kind == 6, F.substring(line, 1, 40)).when(kind.isin(4, 5), F.regexp_replace(line, r'"geometry":\{.*\},"properties"', '"geometry":null,"properties"')).otherwise(line)
    spark.read.text(path).select(cut.alias("value")).write.text(broken)
    props = StructType([StructField("density_text", StringType())])
    rows = O.read_geojson(spark, broken, props)
    first = F.try_element_at(F.try_element_at("rings", F.lit(1)), F.lit(1))
    out = rows.select("id", "density_text", F.when(F.col("rings").isNotNull(), F.size("rings")).alias("rings"), first[0].alias("first_lon"), first[1].alias("first_lat"), "error")
    return tidy(out).groupBy(*out.columns).agg(F.count("*").alias("rows"))


def history_payloads(spark, sf):
    """Per bin and day one JSON page; some entries get offsets, odd tokens or repeats."""
    v = S.visits(spark, sf)
    n = F.col("id") % 20
    stamp = F.date_format(F.date_trunc("minute", F.col("date").cast("timestamp")), "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(n == 3, F.concat(stamp, F.lit("+03:00"))).when(n == 4, F.lit("yesterday")).when(n == 5, F.lit(None).cast("string")).otherwise(stamp)
    status = F.when(n == 6, "maybe").when(n == 7, F.when(F.col("was_serviced"), "TRUE").otherwise("False")).when(n == 8, F.when(F.col("was_serviced"), "1").otherwise("0")).otherwise(F.col("was_serviced").cast("string"))
    copies = F.explode(F.when(n == 9, F.array(F.lit(None).cast("string"), F.lit("second"))).otherwise(F.array(F.col("non_serviced_reason"))))
    item = F.struct("id", text.alias("service_date"), status.alias("is_serviced"), F.col("reason").alias("non_serviced_reason"))
    rows = v.withColumn("reason", copies)
    pages = rows.groupBy("bin_id", F.dayofmonth("date").alias("page")).agg(F.sort_array(F.collect_list(item)).alias("data"))
    return pages.select("bin_id", "page", F.to_json(F.struct("data")).alias("payload"))


@BOOK.add("parse_history_json", """
    with r as (select *, date_trunc('minute', date) as at_minute, id % 20 as n from visits where id % 20 not in (3, 4, 5, 6)),
      x as (select bin_id, at_minute, was_serviced, case when n = 9 then 'second' else non_serviced_reason end as reason, extract(day from date) as page, id from r)
    select bin_id, at_minute as date, was_serviced, arg_min(struct_pack(v := reason), struct_pack(a := coalesce(reason, '') = '', b := page, c := id)).v as non_serviced_reason from x group by 1, 2, 3""")
def _(spark, sf):
    return O.dedup_history(O.parse_history(history_payloads(spark, sf)))


@BOOK.add("parse_history_errors", """
    select case id % 20 when 3 then 'offset_timestamp' when 4 then 'bad_timestamp' when 5 then 'missing_timestamp' else 'bad_status' end as error, count(*) as entries from visits where id % 20 in (3, 4, 5, 6) group by 1""")
def _(spark, sf):
    return O.parse_history(history_payloads(spark, sf)).where(F.col("error").isNotNull()).groupBy("error").agg(F.count("*").alias("entries"))


@BOOK.add("parse_schedule_json", """
    select bin_id, case when bin_id % 10 not in (3, 4) then string_agg(distinct date::varchar, ',' order by date::varchar) end as dates, case when bin_id % 10 in (3, 4) then 'bad_date' end as error from schedule group by 1""")
def _(spark, sf):
    s = S.schedule(spark, sf).groupBy("bin_id").agg(F.sort_array(F.collect_list(F.col("date").cast("string"))).alias("schedule"))
    extra = F.when(F.col("bin_id") % 10 == 3, F.array(F.lit("2024-13-01"))).when(F.col("bin_id") % 10 == 4, F.array(F.lit("1 June"))).otherwise(F.slice("schedule", 1, 1))
    payloads = s.select("bin_id", F.to_json(F.struct(F.concat("schedule", extra).alias("schedule"))).alias("payload"))
    return O.parse_schedule(payloads).select("bin_id", F.array_join(F.transform("dates", lambda d: d.cast("string")), ",").alias("dates"), "error")


def records(spark, sf):
    b = S.bins(spark, sf)
    i = F.col("id")
    volume = F.when(i % 9 == 1, "about two").when(i % 9 == 2, "NaN").when(i % 9 == 3, F.lit(None).cast("string")).otherwise((i % 70 / 10).cast("string"))
    addresses = F.when(i % 6 == 1, "{}").when(i % 6 == 2, "[]").when(i % 6 == 3, F.lit(None).cast("string")).otherwise('["a","b"]')
    ident = F.when(i % 11 == 1, "x7").when(i % 11 == 2, "0").otherwise((i + 1).cast("string"))
    body = F.struct(ident.alias("id"), F.when(i % 13 != 1, F.col("waste_type")).alias("dumpster_type"), volume.alias("volume"), addresses.alias("client_addresses"), F.col("street"), F.col("house_number"), F.col("object_group"), F.col("city"))
    return b.select("id", F.to_json(body).alias("payload"), "latitude", "longitude")


RAW = """select id, case when id % 11 in (1, 2) then null else id + 1 end as ext, case when id % 13 <> 1 then waste_type end as wt,
    case when id % 9 in (1, 2, 3) then null else round((id % 70)::double / 10, 6) end as cap, case when id % 6 in (1, 3) then null when id % 6 = 2 then 0 else 2 end as cc from bins"""


@BOOK.add("map_bin_record", "select ext as external_id, wt as waste_type, cap as capacity_m3, cc::integer as client_count from (" + RAW + ") where ext is not null and wt is not null")
def _(spark, sf):
    return O.map_bins(records(spark, sf)).where(F.col("error").isNull()).select("external_id", "waste_type", "capacity_m3", "client_count")


@BOOK.add("map_bin_rejects", "select case when ext is null then 'bad_identity' else 'missing_waste_type' end as error, count(*) as records from (" + RAW + ") where ext is null or wt is null group by 1")
def _(spark, sf):
    return O.map_bins(records(spark, sf)).where(F.col("error").isNotNull()).groupBy("error").agg(F.count("*").alias("records"))


@BOOK.add("json_list_count", "select doc_kind, n, count(*) as rows from (select id % 4 as doc_kind, case id % 4 when 0 then 3 when 1 then 0 end::integer as n from visits) group by 1, 2")
def _(spark, sf):
    k = F.col("id") % 4
    text = F.when(k == 0, F.to_json(F.array("id", "bin_id", F.lit(1)))).when(k == 1, "[]").when(k == 2, '{"a": 1}').otherwise("not json")
    rows = S.visits(spark, sf).select(k.alias("doc_kind"), O.json_list_count(text).alias("n"))
    return rows.groupBy("doc_kind", "n").agg(F.count("*").alias("rows"))


@BOOK.add("bool_token_parse", "select token, case lower(token) when 'true' then true when '1' then true when 'false' then false when '0' then false end as value, count(*) as n from (select ['True','FALSE','1','0','yes',''][(id % 6 + 1)::integer] as token from visits) group by 1, 2")
def _(spark, sf):
    token = F.element_at(F.array(*[F.lit(t) for t in ("True", "FALSE", "1", "0", "yes", "")]), (F.col("id") % 6 + 1).cast("int"))
    rows = S.visits(spark, sf).select(token.alias("token"))
    return rows.select("token", O.parse_bool(F.col("token")).alias("value")).groupBy("token", "value").agg(F.count("*").alias("n"))


@BOOK.add("sink_parquet", "select bin_id, predicted_fill from predictions")
def _(spark, sf):
    path = fresh_path(spark, "predictions")
    K.write_parquet(S.predictions(spark, sf), path)
    return spark.read.parquet(path)


@BOOK.add("sink_csv", "select bin_id, predicted_fill from predictions")
def _(spark, sf):
    path = fresh_path(spark, "predictions-csv")
    K.write_csv(S.predictions(spark, sf), path)
    return O.read_csv(spark, path, "bin_id long, predicted_fill int")


@BOOK.add("sink_geojson_rows", """
    select 'bins' as layer, id, waste_type as label, round(longitude, 6) as x from bins union all select 'landfills', id, name, round(longitude, 6) from landfills where latitude is not null
    union all select 'districts', id, name, round(x0, 6) from districts union all select 'zones', id, name, round(x0, 6) from zones""")
def _(spark, sf):
    point = "struct<id:long,geometry:struct<coordinates:array<double>>,properties:map<string,string>>"
    shape = "struct<id:long,geometry:struct<coordinates:array<array<array<double>>>>,properties:map<string,string>>"

    def back(name, features, kind, label, x):
        path = fresh_path(spark, f"{name}-geojson")
        K.write_geojson(features, path)
        f = spark.read.text(path).select(F.from_json("value", kind).alias("f"))
        return f.select(F.lit(name).alias("layer"), "f.id", F.col("f.properties")[label].alias("label"), x.alias("x"))

    px, sx = F.col("f.geometry.coordinates")[0], F.col("f.geometry.coordinates")[0][0][0]
    parts = [
        back("bins", K.point_features(S.bins(spark, sf).withColumn("capacity_m3", F.nanvl("capacity_m3", F.lit(None).cast("double"))), ["inventory_number", "waste_type", "capacity_m3"]), point, "waste_type", px),
        back("landfills", K.point_features(S.landfills(spark, sf), ["name", "operator"]), point, "name", px),
        back("districts", K.polygon_features(S.districts(spark, sf), ["name"]), shape, "name", sx),
        back("zones", K.polygon_features(S.zones(spark, sf), ["name", "zone_number"]), shape, "name", sx),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@BOOK.add("replace_partition", "select bin_id, date, case when date = date '2024-06-10' then 'replaced' else collection_status end as collection_status from bin_days where date <> date '2024-06-10' or bin_id % 2 = 0")
def _(spark, sf):
    path = fresh_path(spark, "days")
    days = S.bin_days(spark, sf).select("bin_id", "date", "collection_status")
    K.replace_partitions(days, path, ["date"])
    K.replace_partitions(days.where((F.col("date") == "2024-06-10") & (F.col("bin_id") % 2 == 0)).withColumn("collection_status", F.lit("replaced")), path, ["date"])
    return spark.read.schema("bin_id long, collection_status string, date date").parquet(path).select("bin_id", "date", "collection_status")


@BOOK.add("replace_table_cascade", "select 'visits' as \"table\", count(*) as rows from visits where bin_id % 3 <> 0 union all select 'requests', count(*) from requests where bin_id % 3 <> 0 union all select 'bin_population', 0")
def _(spark, sf):
    parents = S.bins(spark, sf).where(F.col("id") % 3 != 0)
    tables = K.cascade(parents, "id", {"visits": (S.visits(spark, sf), "bin_id"), "requests": (S.requests(spark, sf), "bin_id")}, {"bin_population": None}, {"bin_population": S.bin_population(spark, sf)})
    counts = [df.agg(F.count("*").alias("rows")).select(F.lit(n).alias("table"), "rows") for n, df in tables.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@BOOK.add("merge_changed_revision", """
    select id, case when id % 4 = 1 then 1 when id % 4 = 0 then 3 when id % 4 = 2 then 2 else 1 end as revision,
      case when id % 4 = 1 then 'old' when id % 4 = 0 then 'new' when id % 4 = 2 then 'new' else 'old' end as payload,
      case id % 4 when 0 then 'updated' when 1 then 'unchanged' when 2 then 'inserted' else 'kept' end as action from bins""")
def _(spark, sf):
    i = F.col("id")
    b = S.bins(spark, sf).select("id")
    stored = b.where(i % 4 != 2).select("id", F.lit(1).alias("revision"), F.lit("old").alias("payload"))
    incoming = b.where(i % 4 != 3).select("id", F.when(i % 4 == 0, 3).when(i % 4 == 1, 1).otherwise(2).alias("revision"), F.lit("new").alias("payload"))
    return K.merge_changed(stored, incoming)


LANES = " || '-' || ".join(f"sum(('0x' || substr(d, {8 * i + 1}, 8))::bigint)" for i in range(K.LANES))
DIGESTS = """select l_returnflag, sha256('{"l_orderkey":' || l_orderkey || ',"l_partkey":' || l_partkey || ',"l_linenumber":' || l_linenumber || ',"l_returnflag":"' || l_returnflag || '"}') as d from lineitem"""


@BOOK.add("dataset_fingerprint", f"select count(*) as rows, {LANES} as identity from ({DIGESTS})")
def _(spark, sf):
    """The whole table from the fingerprints of its partitions."""
    return K.identity(K.merged(K.fingerprint(S.table(spark, sf, "lineitem"), ["l_orderkey", "l_partkey", "l_linenumber", "l_returnflag"], by=["l_returnflag"])))


@BOOK.add("partition_fingerprints", f"select l_returnflag, count(*) as rows, {LANES} as identity from ({DIGESTS}) group by 1")
def _(spark, sf):
    return K.identity(K.fingerprint(S.table(spark, sf, "lineitem"), ["l_orderkey", "l_partkey", "l_linenumber", "l_returnflag"], by=["l_returnflag"]))
