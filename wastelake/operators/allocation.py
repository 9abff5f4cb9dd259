"""Residents of population polygons to the nearest collection points."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wastelake.functions import bands as B, geo as G
from wastelake.operators import spatial as SP
from wastelake.operators.quantiles import exact_quantiles

SUPPRESSED_DENSITY = 5.0
MAX_SUPPRESSED_DENSITY = 10.0
SUPPRESSED_TEXT = "<11"


def parse_density(cells: DataFrame, suppressed_density: float = SUPPRESSED_DENSITY) -> DataFrame:
    """Density text to numbers: suppressed, known, unknown; anything else is an error code."""
    if not 0 <= suppressed_density <= MAX_SUPPRESSED_DENSITY:
        raise ValueError("suppressed density must be between 0 and 10 residents per hectare")
    raw = F.col("density_text")
    digits = raw.rlike("^[0-9]+$")
    suppressed = F.coalesce(raw == SUPPRESSED_TEXT, F.lit(False))
    per_ha = F.when(suppressed, F.lit(float(suppressed_density))).when(digits, raw.cast("double")).otherwise(F.lit(0.0))
    bad_area = F.col("area_m2").isNull() | (F.col("area_m2") < 0)
    return cells.withColumns(
        {
            "density_per_ha": F.when(digits, raw.cast("int")),
            "suppressed": suppressed,
            "area_ha": F.col("area_m2") / 10000,
            "residents": per_ha * (F.col("area_m2") / 10000),
            "population_known": F.coalesce(digits, F.lit(False)) | suppressed,
            "error": F.when(raw.isNotNull() & ~suppressed & ~digits, "bad_density").when(bad_area, "bad_area"),
        }
    )


def residential(bins: DataFrame) -> DataFrame:
    return bins.where(
        F.col("object_group").isin(*B.RESIDENTIAL_GROUPS) & B.is_finite(F.col("capacity_m3")) & (F.col("capacity_m3") > 0)
    )


def collection_points(bins: DataFrame) -> DataFrame:
    """Residential bins of one stream at one position act as one point, named by its lowest bin."""
    grouped = residential(bins).groupBy("waste_type", "latitude", "longitude").agg(
        F.sum("capacity_m3").alias("capacity_m3"),
        F.min("id").alias("point_id"),
        F.count("*").alias("bin_count"),
    )
    return grouped.withColumns({"x": G.project_x(F.col("longitude")), "y": G.project_y(F.col("latitude"))})


def serving_points(cells: DataFrame, points: DataFrame, waste_types=B.ALL_WASTE_TYPES) -> DataFrame:
    """Nearest point per populated polygon and stream: cell_id, waste_type, point_id, distance, residents."""
    sources = SP.with_centroid(cells.where(F.col("residents") > 0)).select(
        F.col("id").alias("source_id"),
        "residents",
        G.project_x(F.col("centroid_lon")).alias("x"),
        G.project_y(F.col("centroid_lat")).alias("y"),
        F.explode(F.array(*[F.lit(w) for w in waste_types])).alias("kind"),
    )
    near = SP.nearest_point(sources, points.select("point_id", F.col("waste_type").alias("kind"), "x", "y"))
    residents = cells.select(F.col("id").alias("source_id"), "residents")
    return near.join(residents, "source_id").select(
        F.col("source_id").alias("cell_id"), F.col("kind").alias("waste_type"), "point_id", "distance_m", "residents"
    )


def point_residents(points: DataFrame, serving: DataFrame) -> DataFrame:
    """Collection points with the residents they serve (0 when nobody is nearest)."""
    sums = serving.groupBy("waste_type", "point_id").agg(F.sum("residents").alias("point_residents"))
    return points.join(sums, ["waste_type", "point_id"], "left").withColumn(
        "point_residents", F.coalesce("point_residents", F.lit(0.0))
    )


def resident_factors(bins: DataFrame, points: DataFrame, cells: DataFrame) -> DataFrame:
    """Per bin: its share of the point's residents by capacity (0 otherwise) and its containing cell."""
    member = residential(bins).join(
        points.select("waste_type", "latitude", "longitude", F.col("capacity_m3").alias("point_capacity_m3"), "point_residents", "point_id"),
        ["waste_type", "latitude", "longitude"],
    )
    factor = member.select("id", "point_id", (F.col("point_residents") * F.col("capacity_m3") / F.col("point_capacity_m3")).alias("factor"))
    inside = SP.membership(bins, cells)
    return (
        bins.select("id", "waste_type")
        .join(factor, "id", "left")
        .join(inside.select("id", F.col("polygon_id").alias("population_cell_id")), "id", "left")
        .select(F.col("id").alias("bin_id"), "waste_type", "point_id", "population_cell_id", F.coalesce("factor", F.lit(0.0)).alias("resident_factor"))
    )


def allocation_stats(cells: DataFrame, points: DataFrame, serving: DataFrame, factors: DataFrame) -> DataFrame:
    """Per stream: bins, points, allocated and left-over residents, distance and factor quantiles."""
    total = cells.agg(F.sum("residents").alias("total_residents"))
    head = points.groupBy("waste_type").agg(F.sum("bin_count").alias("residential_bins"), F.count("*").alias("points"))
    served = serving.groupBy("waste_type").agg(F.sum("residents").alias("allocated"), F.count("*").alias("areas"))
    dist = exact_quantiles(serving, ["waste_type"], "distance_m", {"distance_p50": 0.5, "distance_p90": 0.9})
    own = factors.where(F.col("point_id").isNotNull())
    fact = exact_quantiles(own, ["waste_type"], "resident_factor", {"factor_p50": 0.5, "factor_p90": 0.9, "factor_p99": 0.99, "factor_max": 1.0})
    out = head.join(served, "waste_type", "left").join(dist, "waste_type", "left").join(fact, "waste_type", "left")
    return (
        out.withColumn("allocated", F.coalesce("allocated", F.lit(0.0)))
        .join(total, F.lit(True))  # one-row frame
        .withColumn("unallocated", F.col("total_residents") - F.col("allocated"))
        .drop("total_residents")
    )


def allocation_conservation(cells: DataFrame, factors: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Sum of the factors of a stream equals the residents of all polygons."""
    total = cells.agg(F.sum("residents").alias("residents"))
    sums = factors.where(F.col("point_id").isNotNull()).groupBy("waste_type").agg(F.sum("resident_factor").alias("allocated"))
    return sums.join(total, F.lit(True)).withColumn(
        "conserved", F.abs(F.col("allocated") - F.col("residents")) <= tolerance * F.greatest(F.col("residents"), F.lit(1.0))
    )
