"""Views that read the shared test tables as waste-collection tables.

Every view is a pure function of the parquet tables, so its rows grow with them. A
production session passes its own DataFrames with the same columns to the operators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wastelake.functions import dates as D, hashing as H
from wastelake.session import materialize

SHIFT_DAYS = 152  # moves the event month onto the 30 days of June 2024
BBOX = (24.98, 54.55, 25.52, 54.85)
AS_OF = "2024-06-25 12:00:00"
TODAY = "2024-06-30"


SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, "
        "l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A parquet table under its declared schema; nothing is inferred."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf}/{name}.parquet")


def lon_of(namespace: str, *keys: Column) -> Column:
    return F.lit(24.98) + F.lit(0.54) * H.uniform(namespace, *keys)


def lat_of(namespace: str, *keys: Column) -> Column:
    return F.lit(54.55) + F.lit(0.30) * H.uniform(namespace, *keys)


def bins(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    cid = F.col("c_custkey")
    site = F.expr("c_custkey div 3")
    seg = F.col("c_mktsegment")
    bal = F.col("c_acctbal")
    based = c.withColumn("site_id", site).withColumn(
        "nk",
        F.when(cid % 11 == 0, F.col("c_nationkey").cast("bigint")).otherwise((F.col("site_id") * 7) % 25),
    )
    joined = based.join(n, F.col("nk") == F.col("n_nationkey").cast("bigint"), "left")
    name = F.col("n_name")
    return joined.select(
        cid.alias("id"),
        "site_id",
        F.when(cid % 23 != 0, cid + 100000).alias("external_id"),
        F.concat(F.lit("INV-"), cid.cast("string")).alias("inventory_number"),
        F.when(seg.isin("BUILDING", "MACHINERY"), "Mixed municipal waste")
        .when(seg == "AUTOMOBILE", "Paper/plastic waste")
        .when(seg == "FURNITURE", "Glass waste")
        .otherwise("Food/organic waste")
        .alias("waste_type"),
        F.when(bal < -900, F.lit(None).cast("double"))
        .when(bal < -800, F.lit(float("nan")))
        .otherwise(F.round(F.greatest(bal, F.lit(0.0)) / 2000, 2))
        .alias("capacity_m3"),
        lat_of("lat", F.col("site_id")).alias("latitude"),
        lon_of("lon", F.col("site_id")).alias("longitude"),
        F.when(cid % 19 == 0, F.lit(None).cast("string"))
        .when(cid % 7 == 1, F.concat(F.lit("  "), name, F.lit("   sen. ")))
        .when(cid % 7 == 2, name)
        .otherwise(F.concat(name, F.lit(" sen.")))
        .alias("sub_district"),
        F.when(cid % 13 == 0, "").when(cid % 13 == 1, "Kaunas").otherwise("Vilniaus m.").alias("city"),
        F.when(cid % 37 != 0, F.concat(F.lit(" Gatvė  "), (F.col("site_id") % 97).cast("string"))).alias("street"),
        F.when(cid % 37 != 0, F.concat(F.col("site_id").cast("string"), F.lit("A"))).alias("house_number"),
        F.when(cid % 5 != 0, F.concat(F.lit("LT-"), (10000 + F.col("site_id") % 900).cast("string"))).alias("postal_code"),
        F.when(cid % 40 == 4, " Individualios   valdos")
        .when(cid % 8 == 0, F.lit(None).cast("string"))
        .when(cid % 8 == 1, "Daugiabučiai namai")
        .when(cid % 8 == 2, "Dvibučiai")
        .when(cid % 8 == 3, "Sodų bendrijos")
        .when(cid % 8 == 4, "Komercinė paskirtis")
        .when(cid % 8 == 5, "Viešosios įstaigos")
        .when(cid % 8 == 6, "Sodų/garažų bendrijos")
        .otherwise("")
        .alias("object_group"),
        F.when(F.col("c_nationkey") % 5 != 4, F.concat(F.lit("carrier_"), (F.col("c_nationkey") % 5).cast("string"))).alias("waste_carrier"),
        F.when(cid % 9 != 0, (cid % 5).cast("int")).alias("client_count"),
    )


def sites(spark: SparkSession, sf: str) -> DataFrame:
    """One address per started group of three bins; the last sites of the table stay empty."""
    s = table(spark, sf, "customer").select(F.expr("c_custkey div 3").alias("id")).distinct()
    return s.select(
        "id",
        F.concat(F.lit("Gatvė "), (F.col("id") % 97).cast("string"), F.lit("_"), F.col("id").cast("string"), F.lit("%")).alias("address"),
        lat_of("lat", F.col("id")).alias("latitude"),
        lon_of("lon", F.col("id")).alias("longitude"),
    )


def _event_time() -> Column:
    return (F.col("ts") + F.expr(f"interval {SHIFT_DAYS} days")).cast("timestamp_ntz")


def _event_k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def visits(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").where(F.col("event_type").isin("view", "purchase", "error"))
    k, failed = _event_k(), F.col("event_type") == "error"
    return e.select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("bin_id"),
        _event_time().alias("date"),
        (~failed).alias("was_serviced"),
        F.when(failed & (k % 3 == 1), "")
        .when(failed & (k % 3 == 2), F.concat(F.lit("reason_"), (k % 5).cast("string")))
        .alias("non_serviced_reason"),
        F.when(k % 7 < 5, k % 7).alias("fill_level"),
    )


def requests(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").where(F.col("event_type").isin("click", "signup"))
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("bin_id"), _event_time().alias("timestamp"))


def schedule(spark: SparkSession, sf: str) -> DataFrame:
    """Planned dates: regular cycles of 7, 14, 21, 28 and 1 days, and one irregular sixth."""
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey")
    cust = F.col("bin_id")
    regular = (
        o.where(F.col("o_custkey") % 6 != 5)
        .select(F.col("o_custkey").alias("bin_id"))
        .distinct()
        .withColumn("cycle", F.element_at(F.array(*[F.lit(c) for c in (7, 14, 21, 28, 1)]), (cust % 6 + 1).cast("int")))
        .withColumn("date", F.explode(F.expr("sequence(date'2024-06-01', date'2024-07-31', interval 1 day)")))
        .where(D.ordinal(F.col("date")) % F.col("cycle") == (cust * 5) % F.col("cycle"))
        .select("bin_id", "date")
    )
    irregular = (
        o.where(F.col("o_custkey") % 6 == 5)
        .select(F.col("o_custkey").alias("bin_id"), F.date_add(F.lit("2024-06-01").cast("date"), (F.col("o_orderkey") % 61).cast("int")).alias("date"))
        .distinct()
    )
    both = regular.unionByName(irregular)
    return both.select((F.col("bin_id") * 100 + F.datediff("date", F.lit("2024-06-01").cast("date"))).alias("id"), "bin_id", "date")


def bin_population(spark: SparkSession, sf: str) -> DataFrame:
    cid = F.col("c_custkey")
    return table(spark, sf, "customer").where(cid % 29 != 0).select(
        cid.alias("bin_id"),
        F.when(cid % 4 != 0, (cid % 200).cast("int")).alias("population_cell_id"),
        F.round(100 * H.uniform("rf", cid), 6).alias("resident_factor"),
    )


def bin_days(spark: SparkSession, sf: str) -> DataFrame:
    """Gap-free bin and day rows of the bins with events: 17 base columns, labels and reports."""
    e = table(spark, sf, "events").select(
        F.col("user_id").alias("bin_id"), "event_id", "event_type", _event_k().alias("k"), _event_time().alias("at")
    ).withColumn("date", F.col("at").cast("date"))
    daily = e.groupBy("bin_id", "date").agg(
        F.min_by(F.struct("event_type", "k"), F.struct("at", "event_id")).alias("first"),
        F.count_if(F.col("event_type").isin("click", "signup")).alias("reports"),
    )
    span = "sequence(date'2024-06-01', date'2024-06-30', interval 1 day)"
    grid = e.select("bin_id").distinct().select("bin_id", F.explode(F.expr(span)).alias("date"))
    kind = F.col("first.event_type")
    status = (
        F.when(kind == "purchase", "collected")
        .when(kind == "signup", "retry_collected")
        .when(kind == "click", "failed")
        .when(kind == "error", "missed")
        .otherwise("none")
    )
    rows = grid.join(daily, ["bin_id", "date"], "left").select(
        "bin_id",
        "date",
        status.alias("collection_status"),
        F.when(status.isin("collected", "retry_collected"), F.col("first.k") % 5).alias("fill_level"),
        F.coalesce("reports", F.lit(0)).alias("reports"),
    )
    b = bins(spark, sf).select(F.col("id").alias("bin_id"), "site_id", "waste_type", "capacity_m3", "sub_district", "object_group")
    return D.with_calendar(
        rows.join(b, "bin_id").join(bin_population(spark, sf), "bin_id", "left")
    )


def cells(spark: SparkSession, sf: str) -> DataFrame:
    """Population squares; every fifth has a hole. Squares overlap on purpose.

    They are written, as a polygon file would hold them: rings that stay an expression are worked out anew at every mention.
    """
    p = F.col("p_partkey")
    half = F.lit(0.002) + F.lit(0.0001) * F.col("p_size")
    base = table(spark, sf, "part").select(
        p.alias("id"), "p_size", lat_of("plat", p).alias("clat"), lon_of("plon", p).alias("clon"), half.alias("half")
    )

    def square(k: float) -> Column:
        x0, x1 = F.col("clon") - F.col("half") * k, F.col("clon") + F.col("half") * k
        y0, y1 = F.col("clat") - F.col("half") * k, F.col("clat") + F.col("half") * k
        return F.array(F.array(x0, y0), F.array(x1, y0), F.array(x1, y1), F.array(x0, y1), F.array(x0, y0))

    squares = base.select(
        "id",
        F.when(F.col("p_size") < 11, "<11").when(F.col("p_size") % 13 != 0, (F.col("p_size") * 4).cast("string")).alias("density_text"),
        (10000.0 * (1 + F.col("p_size") % 3)).alias("area_m2"),
        F.when(F.col("id") % 5 == 0, F.array(square(1.0), square(0.4))).otherwise(F.array(square(1.0))).alias("rings"),
    )
    return materialize(squares, "cells")


def _tile(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.array(F.array(F.array(x0, y0), F.array(x1, y0), F.array(x1, y1), F.array(x0, y1), F.array(x0, y0)))


def districts(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("n_nationkey").cast("bigint")
    i, j = k % 5, F.floor(k / 5)
    return table(spark, sf, "nation").select(
        (k + 1).alias("id"),
        F.col("n_name").alias("name"),
        _tile(24.98 + 0.108 * i, 54.55 + 0.06 * j, 24.98 + 0.108 * (i + 1), 54.55 + 0.06 * (j + 1)).alias("rings"),
    )


def zones(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("r_regionkey").cast("bigint")
    return table(spark, sf, "region").select(
        (k + 1).alias("id"),
        F.col("r_name").alias("name"),
        (k + 100).cast("int").alias("zone_number"),
        _tile(24.98 + 0.1 * k, F.lit(54.55), 24.98 + 0.1 * (k + 1), F.lit(54.85)).alias("rings"),
    )


def landfills(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("r_regionkey").cast("bigint")
    return table(spark, sf, "region").select(
        k.alias("id"),
        F.concat(F.lit("Facility "), F.col("r_name")).alias("name"),
        F.concat(F.lit("Operator "), (k % 2).cast("string")).alias("operator"),
        F.when(k != 4, lat_of("flat", k)).alias("latitude"),
        F.when(k != 4, lon_of("flon", k)).alias("longitude"),
        F.array(F.lit("mixed"), F.concat(F.lit("stream_"), k.cast("string"))).alias("waste_streams"),
    )


def trucks(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(
        k.alias("id"),
        F.concat(F.lit("Truck "), k.cast("string"), F.lit("%")).alias("name"),
        F.when(k % 3 == 0, 10.0).when(k % 3 == 1, 16.0).otherwise(20.0).alias("max_volume_m3"),
        F.concat(F.lit("carrier_"), (F.col("s_nationkey") % 4).cast("string")).alias("waste_carrier"),
        F.when(k % 6 != 5, k % 6).alias("landfill_id"),
        (F.col("s_acctbal") > 0).alias("available"),
        (k % 17 == 0).alias("deleted"),
    )


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    cid = F.col("c_custkey")
    return table(spark, sf, "customer").where(cid % 50 != 0).select(
        cid.alias("bin_id"), F.floor(5 * H.uniform("level", cid)).cast("int").alias("predicted_fill")
    )


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """Deterministic five-class scores with a true class, one row per order."""
    k = F.col("o_orderkey")
    y = F.floor(5 * H.uniform("y", k)).cast("int")
    base = table(spark, sf, "orders").select(
        k.alias("row_id"),
        F.col("o_custkey").alias("bin_id"),
        F.expr("o_custkey div 3").alias("site_id"),
        F.date_add(F.lit("2024-06-01").cast("date"), (k % 30).cast("int")).alias("date"),
        F.col("o_orderpriority").alias("waste_type"),
        F.col("o_orderstatus").alias("capacity_range"),
        F.when(k % 3 == 0, "complete").otherwise("no_historical_labels").alias("input_quality_flag"),
        y.alias("fill_level"),
        *[(H.uniform(f"p{i}", k) + F.when(y == i, 0.6).otherwise(0.0)).alias(f"u{i}") for i in range(5)],
    )
    total = sum((F.col(f"u{i}") for i in range(1, 5)), F.col("u0"))
    return base.withColumn("probabilities", F.array(*[F.col(f"u{i}") / total for i in range(5)])).drop(
        *[f"u{i}" for i in range(5)]
    )


def district_aliases(spark: SparkSession, sf: str) -> DataFrame:
    """Raw district text to canonical name; the last five names have no accepted alias."""
    n = table(spark, sf, "nation").where(F.col("n_nationkey") < 20)
    return n.select(F.concat("n_name", F.lit(" sen.")).alias("input"), F.col("n_name").alias("canonical"))
