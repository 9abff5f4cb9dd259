"""Registry pages and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wastelake.functions import bands as B


def sites_with_counts(sites: DataFrame, bins: DataFrame) -> DataFrame:
    """Sites with their number of bins; empty sites keep 0."""
    n = bins.groupBy(F.col("site_id").alias("id")).agg(F.count("*").alias("bin_count"))
    return sites.join(n, "id", "left").withColumn("bin_count", F.coalesce("bin_count", F.lit(0)))


def site_stats(sites: DataFrame, bins: DataFrame) -> DataFrame:
    """Sites, bins and capacity in total and bins by waste type, as (metric, key, value)."""
    total = bins.agg(F.count("*").alias("total_bins"), F.sum(B.known_capacity(F.col("capacity_m3"))).alias("total_capacity_m3"))
    n = sites.agg(F.count("*").cast("double").alias("value")).select(F.lit("total_sites").alias("metric"), F.lit(None).cast("string").alias("key"), "value")
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(None).cast("string").alias("key"), F.col(m).cast("double").alias("value")) for m in ("total_bins", "total_capacity_m3")]))
    kinds = bins.groupBy("waste_type").agg(F.count("*").cast("double").alias("value")).select(F.lit("bins_by_waste_type").alias("metric"), F.col("waste_type").alias("key"), "value")
    return n.unionByName(total.select(pairs.alias("p")).select("p.*")).unionByName(kinds)


def site_profiles(sites: DataFrame, bins: DataFrame) -> DataFrame:
    """Per site the address fields of its lowest bin, counts, and distinct groups and carriers.

    Groups and carriers are small vocabularies, so their sorted sets stay short on any site.
    """
    agg = bins.groupBy(F.col("site_id").alias("id")).agg(
        F.min_by(F.struct("sub_district", "street", "house_number", "postal_code"), "id").alias("first"),
        F.count("*").alias("bin_count"),
        F.sum(B.known_capacity(F.col("capacity_m3"))).alias("total_capacity_m3"),
        F.sort_array(F.collect_set("object_group")).alias("object_groups"),
        F.sort_array(F.collect_set("waste_carrier")).alias("waste_carriers"),
    )
    rows = sites.select("id", "address", "latitude", "longitude").join(agg, "id", "left")
    return rows.select("id", "address", "first.*", F.coalesce("bin_count", F.lit(0)).alias("bin_count"), "total_capacity_m3", "object_groups", "waste_carriers")


def bins_of_site(bins: DataFrame, site_id: int) -> DataFrame:
    return bins.where(F.col("site_id") == site_id).select("id", "inventory_number", "waste_type", "capacity_m3")


def latest_service(bins: DataFrame, visits: DataFrame) -> DataFrame:
    """Every bin with its last attempt (latest time, then highest id)."""
    last = visits.groupBy(F.col("bin_id").alias("id")).agg(F.max(F.struct("date", F.col("id").alias("visit_id"), "was_serviced")).alias("s"))
    return bins.join(last, "id", "left").select("id", "inventory_number", "waste_type", F.col("s.date").alias("latest_at"), F.col("s.was_serviced").alias("latest_was_serviced"))


def service_percentages(visits: DataFrame) -> DataFrame:
    """Attempts per bin with the success percentage to one decimal (half to even) and its complement."""
    ok = F.count_if("was_serviced")
    per = visits.groupBy("bin_id").agg(F.count("*").alias("total"), F.bround(100.0 * ok / F.count("was_serviced"), 1).alias("successful_percentage"))
    return per.withColumn("unsuccessful_percentage", F.bround(100.0 - F.col("successful_percentage"), 1))


def bin_history(visits: DataFrame, bin_id: int) -> DataFrame:
    """Attempts of a bin with the whole bin's percentages on every row."""
    own = visits.where(F.col("bin_id") == bin_id)
    return own.join(service_percentages(own), "bin_id").select("id", "date", "was_serviced", "non_serviced_reason", "fill_level", "total", "successful_percentage", "unsuccessful_percentage")


def fleet_stats(trucks: DataFrame) -> DataFrame:
    return trucks.where(~F.col("deleted")).agg(
        F.count("*").alias("total"), F.count_if("available").alias("available_count"), F.avg("max_volume_m3").alias("average_max_volume_m3")
    )


def landfill_list(landfills: DataFrame) -> DataFrame:
    return landfills.orderBy("id")


def route_truck_counts(visits: DataFrame, members: DataFrame) -> DataFrame:
    """Stops and bins per truck of a plan; members: (plan_id, site_id, bin_id)."""
    n = members.groupBy("plan_id", "site_id").agg(F.count("*").alias("n"))
    return visits.join(n, ["plan_id", "site_id"], "left").groupBy("truck_id").agg(F.count("*").alias("stop_count"), F.coalesce(F.sum("n"), F.lit(0)).alias("bin_count"))


def carrier_bins_at_stops(visits: DataFrame, bins: DataFrame) -> DataFrame:
    """All bins of the plan's carrier at its planned sites."""
    at = visits.select(F.col("plan_id").alias("waste_carrier"), "site_id", "truck_id")
    return bins.select(F.col("id").alias("bin_id"), "site_id", "waste_carrier", "waste_type").join(at, ["waste_carrier", "site_id"])


def planned_bins_missing(members: DataFrame, bins: DataFrame) -> DataFrame:
    """Planned bins that are no longer in the registry."""
    return members.join(bins.select(F.col("id").alias("bin_id")), "bin_id", "left_anti")
