"""File sources: CSV exports, GeoJSON and JSON payloads; bad rows go to an error column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType


DAILY_SCHEMA = (
    "bin_id long, date date, day_of_week int, week_of_year int, month int, season int, site_id long, waste_type string, capacity_m3 double, "
    "sub_district string, object_group string, population_cell_id int, resident_factor double, collection_status string, "
    "holidays_since_last_collection int, collections_last_28d int, missed_collections_28d int, fill_level int, qr_alerts int"
)


def read_csv(spark: SparkSession, path: str | list[str], schema: str | StructType, blank_is_null: bool = False) -> DataFrame:
    """Header CSV with an exact header and the token NULL for missing values."""
    df = (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", False)
        .option("nullValue", "NULL")
        .option("mode", "FAILFAST")
        .option("dateFormat", "yyyy-MM-dd")
        .csv(path)
    )
    if not blank_is_null:
        return df
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    return df.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in texts})


def read_daily(spark: SparkSession, path: str) -> DataFrame:
    """The 19-column daily table; any malformed row fails the read."""
    return read_csv(spark, path, DAILY_SCHEMA)


def latest_export(spark: SparkSession, folder: str, table: str) -> str:
    """Path of `<table>_<digits>.csv` with the greatest number.

    Only file names are listed (the content column is pruned); one path per export returns.
    """
    names = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(folder).select("path")
    version = F.regexp_extract("path", rf"/{table}_(\d+)\.csv", 1)
    exports = names.select(version.alias("v"), F.regexp_extract("path", rf"^(.*/{table}_\d+\.csv)", 1).alias("p")).where(F.col("v") != "")
    top = exports.agg(F.max_by("p", F.col("v").cast("decimal(38,0)")).alias("p")).first()["p"]
    if top is None:
        raise ValueError(f"no export of {table} below {folder}")
    return top


RING = ArrayType(ArrayType(ArrayType(DoubleType())))


def feature_schema(properties: StructType) -> StructType:
    return StructType(
        [
            StructField("type", StringType()),
            StructField("id", LongType()),
            StructField("properties", properties),
            StructField("geometry", StructType([StructField("type", StringType()), StructField("coordinates", RING)])),
        ]
    )


CORRUPT = "_corrupt"


def read_geojson(spark: SparkSession, path: str, properties: StructType, lines: bool = True) -> DataFrame:
    """Features, one per row, with the reason in `error` where a row is no polygon with rings.

    `lines` expects one feature per line, which splits over tasks. A line that is no JSON is a row too.
    """
    schema = feature_schema(properties)
    broken = StructField(CORRUPT, StringType())
    if lines:
        rows = spark.read.schema(StructType([*schema.fields, broken])).option("columnNameOfCorruptRecord", CORRUPT).json(path)
    else:
        whole = StructType([StructField("type", StringType()), StructField("features", ArrayType(schema)), broken])
        docs = spark.read.schema(whole).option("multiLine", True).option("columnNameOfCorruptRecord", CORRUPT).json(path)
        rows = docs.select(F.explode_outer("features").alias("f"), CORRUPT).select("f.*", CORRUPT)
    shape, rings = F.col("geometry.type"), F.col("geometry.coordinates")
    error = (
        F.when(F.col(CORRUPT).isNotNull(), "corrupt_record")
        .when(shape.isNull(), "missing_geometry")
        .when(shape != "Polygon", "not_a_polygon")
        .when(F.coalesce(F.size(rings), F.lit(0)) < 1, "missing_rings")
    )
    return rows.select("id", "properties.*", rings.alias("rings"), error.alias("error"))


# --- payloads ----------------------------------------------------------------------

def parse_bool(text: Column) -> Column:
    """true and false in any case, 1 and 0; anything else is NULL."""
    t = F.lower(text)
    return F.when(t.isin("true", "1"), True).when(t.isin("false", "0"), False)


def json_list_count(text: Column) -> Column:
    """Length of a JSON list; NULL for anything that is not a list."""
    return F.when(F.ltrim(text).startswith("["), F.json_array_length(text))


ATTEMPT = "struct<service_date:string,is_serviced:string,non_serviced_reason:string>"


def parse_history(payloads: DataFrame) -> DataFrame:
    """Attempts of JSON pages (bin_id, page, payload); every entry is a row, a bad one with an error code.

    Entries are read one by one, so a bad entry spoils no other. A page that is no JSON object or has no list
    under `data` is one row without index and the error bad_page or missing_data; an empty list has no entries.
    """
    page_ok = F.coalesce(F.json_object_keys("payload").isNotNull(), F.lit(False))
    listed = F.get_json_object("payload", "$.data")
    entries = F.from_json(F.when(F.ltrim(listed).startswith("["), listed), "array<string>")
    lost = F.when(~page_ok, "bad_page").when(entries.isNull(), "missing_data")
    pages = payloads.select("bin_id", "page", lost.alias("lost"), entries.alias("entries")).where("lost is not null or size(entries) > 0")
    rows = pages.select("bin_id", "page", "lost", F.posexplode_outer("entries").alias("index", "entry"))
    rows = rows.withColumns({"item": F.from_json("entry", ATTEMPT), "raw_reason": F.get_json_object("entry", "$.non_serviced_reason")})
    is_object = F.coalesce(F.ltrim("entry").startswith("{"), F.lit(False))
    reason_is_text = F.col("raw_reason").isNull() | F.coalesce(F.col("entry").rlike(r'"non_serviced_reason"\s*:\s*"'), F.lit(False))
    stamp = F.col("item.service_date")
    offset = stamp.rlike(r"[T ].*(Z|[+-]\d{2}:?\d{2})$")
    when = F.when(~offset, stamp).try_cast("timestamp_ntz")
    ok = parse_bool(F.col("item.is_serviced"))
    error = (
        F.when(F.col("lost").isNotNull(), F.col("lost")).when(~is_object, "bad_entry").when(~reason_is_text, "bad_reason")
        .when(stamp.isNull(), "missing_timestamp").when(offset, "offset_timestamp").when(when.isNull(), "bad_timestamp").when(ok.isNull(), "bad_status")
    )
    return rows.select("bin_id", "page", "index", when.alias("date"), ok.alias("was_serviced"), F.col("item.non_serviced_reason").alias("non_serviced_reason"), error.alias("error"))


def dedup_history(attempts: DataFrame) -> DataFrame:
    """One valid attempt per bin, time and status; an entry with a reason wins, then the earlier one."""
    good = attempts.where(F.col("error").isNull())
    blank = F.coalesce(F.col("non_serviced_reason"), F.lit("")) == ""
    rank = F.struct(blank, "page", "index")
    return good.groupBy("bin_id", "date", "was_serviced").agg(F.min_by(F.struct("non_serviced_reason"), rank).alias("k")).select(
        "bin_id", "date", "was_serviced", "k.non_serviced_reason"
    )


def parse_schedule(payloads: DataFrame) -> DataFrame:
    """Sorted distinct planned dates per payload, or an error when any entry is not an ISO date."""
    items = F.from_json("payload", "struct<schedule:array<string>>")["schedule"]
    dates = F.transform(items, lambda s: F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), s).try_cast("date"))
    bad = F.exists(dates, lambda d: d.isNull())
    return payloads.select(
        "bin_id",
        F.when(~bad, F.array_sort(F.array_distinct(dates))).alias("dates"),
        F.when(items.isNull(), "missing_schedule").when(bad, "bad_date").alias("error"),
    )


BIN_RECORD = "struct<id:string,dumpster_type:string,volume:string,client_addresses:string,street:string,house_number:string,object_group:string,city:string>"


def map_bins(records: DataFrame) -> DataFrame:
    """Raw JSON records (payload, latitude, longitude) to registry rows, rejects marked by error."""
    r = F.from_json("payload", BIN_RECORD)
    number = r["volume"].rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$")
    whole = r["id"].rlike(r"^\d+$")
    identity = F.when(whole, r["id"]).try_cast("bigint")
    rows = records.select(
        identity.alias("external_id"), r["dumpster_type"].alias("waste_type"), F.when(number, r["volume"]).try_cast("double").alias("capacity_m3"),
        json_list_count(r["client_addresses"]).alias("client_count"), r["street"].alias("street"), r["house_number"].alias("house_number"),
        r["object_group"].alias("object_group"), r["city"].alias("city"), "latitude", "longitude",
    )
    error = F.when(F.coalesce("external_id", F.lit(0)) <= 0, "bad_identity").when(F.coalesce("waste_type", F.lit("")) == "", "missing_waste_type")
    return rows.withColumn("error", error)


def checked_density(rows: DataFrame) -> DataFrame:
    """Only usable population polygons; see allocation.parse_density for the codes."""
    return rows.where(F.col("error").isNull())


