"""Filters and projections that combine column functions into table rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wastelake.functions import bands as B, geo as G, text as T


def valid_coordinates(df: DataFrame) -> DataFrame:
    return df.where(G.valid_coords(F.col("latitude"), F.col("longitude")))


def eligible(bins: DataFrame, bbox, city_token: str = "vilniaus") -> DataFrame:
    """Public collection bins: known streams, no private-estate group, city blank or matching."""
    group = T.normalize_address(F.coalesce("object_group", F.lit("")))
    city = F.lower(F.coalesce("city", F.lit("")))
    return bins.where(
        F.col("waste_type").isin(*B.WASTE_TYPES)
        & (group != B.EXCLUDED_GROUP)
        & ((city == "") | city.contains(city_token))
        & G.in_bbox(F.col("latitude"), F.col("longitude"), bbox)
    )


def trucks_matching(
    trucks: DataFrame,
    name: str | None = None,
    available: bool | None = None,
    minimum: float | None = None,
    maximum: float | None = None,
    waste_carrier: str | None = None,
) -> DataFrame:
    """Fleet filter; every argument is optional, retired trucks never match."""
    rows = trucks.where(~F.col("deleted"))
    if name and name.strip():
        rows = rows.where(T.contains_ignore_case(F.col("name"), name))
    if available is not None:
        rows = rows.where(F.col("available") == available)
    if minimum is not None:
        rows = rows.where(F.col("max_volume_m3") >= minimum)
    if maximum is not None:
        rows = rows.where(F.col("max_volume_m3") <= maximum)
    if waste_carrier and waste_carrier.strip():
        rows = rows.where(F.col("waste_carrier") == waste_carrier.strip())
    return rows


def sites_matching(sites: DataFrame, address: str | None = None) -> DataFrame:
    return sites.where(T.contains_ignore_case(F.col("address"), address))


def with_bands(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "known_capacity_m3": B.known_capacity(F.col("capacity_m3")),
            "capacity_quality": B.capacity_quality(F.col("capacity_m3")),
            "capacity_range": B.capacity_band(F.col("capacity_m3")),
            "category": B.bin_category(F.col("waste_type")),
        }
    )
