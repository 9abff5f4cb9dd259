"""Sinks and table replacement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wastelake.functions import geo as G, hashing as H


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("compression", "zstd").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Header CSV; NULL for missing values, spaces at the ends of texts kept."""
    options = {"header": True, "nullValue": "NULL", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.options(**options).csv(path)


def point_features(rows: DataFrame, properties: list[str]) -> DataFrame:
    """One GeoJSON point Feature per row; rows without usable coordinates are left out."""
    kept = rows.where(G.valid_coords(F.col("latitude"), F.col("longitude")))
    geometry = F.struct(F.lit("Point").alias("type"), F.array("longitude", "latitude").alias("coordinates"))
    return kept.select("id", _feature(geometry, properties).alias("feature"))


def polygon_features(rows: DataFrame, properties: list[str]) -> DataFrame:
    geometry = F.struct(F.lit("Polygon").alias("type"), F.col("rings").alias("coordinates"))
    return rows.select("id", _feature(geometry, properties).alias("feature"))


def _feature(geometry: Column, properties: list[str]) -> Column:
    body = F.struct(F.lit("Feature").alias("type"), F.col("id"), geometry.alias("geometry"), F.struct(*properties).alias("properties"))
    return F.to_json(body, {"ignoreNullFields": "false"})


def write_geojson(features: DataFrame, path: str) -> None:
    """One feature per line, so the file is written and read in parallel."""
    features.select("feature").write.text(path)


def replace_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Replace exactly the partitions present in `df`, keep all others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def cascade(parents: DataFrame, parent_key: str, children: dict[str, tuple[DataFrame, str]], derived: dict[str, DataFrame | None], schemas: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Tables after replacing the parents: orphans leave the children, derived tables without new input become empty."""
    keys = parents.select(parent_key)
    out = {name: df.join(keys.withColumnRenamed(parent_key, key), key, "left_semi") for name, (df, key) in children.items()}
    for name, df in derived.items():
        out[name] = df if df is not None else schemas[name].limit(0)
    return out


def merge_changed(stored: DataFrame, incoming: DataFrame, key: str = "id", revision: str = "revision") -> DataFrame:
    """Upsert by key only where the revision differs; every row says what happened to it."""
    columns = [c for c in stored.columns if c != key]
    old = stored.select(key, F.struct(*columns).alias("old"))
    new = incoming.select(key, F.struct(*columns).alias("new"))
    both = old.join(new, key, "full")
    action = (
        F.when(F.col("new").isNull(), "kept").when(F.col("old").isNull(), "inserted")
        .when(F.col(f"new.{revision}").eqNullSafe(F.col(f"old.{revision}")), "unchanged").otherwise("updated")
    )
    row = F.when(action.isin("inserted", "updated"), F.col("new")).otherwise(F.col("old"))
    return both.select(key, row.alias("row"), action.alias("action")).select(key, "row.*", "action")


#: A row's digest is cut into lanes of 32 bits; a lane's sum over 2^90 rows still fits its decimal.
LANES, LANE_TYPE = 8, "decimal(38,0)"


def fingerprint(df: DataFrame, columns: list[str], by: list[str] = []) -> DataFrame:
    """Order-free identity of a table, or of each of its partitions: rows, and the sums of the lanes of all row digests.

    Sums of 256-bit digests in lanes count each row as often as it occurs: two equal rows do not cancel. They add up, so
    that `merged` fingerprints of partitions are the fingerprint of the table, and a change costs its partition only.
    """
    digest = F.sha2(H.row_json(*[F.col(c) for c in columns]), 256)
    lanes = [F.conv(F.substring("digest", 8 * i + 1, 8), 16, 10).cast("bigint").cast(LANE_TYPE).alias(f"l{i}") for i in range(LANES)]
    rows = df.select(*by, digest.alias("digest")).select(*by, *lanes)
    return rows.groupBy(*by).agg(F.count("*").alias("rows"), *[_total(f"l{i}") for i in range(LANES)])


def _total(lane: str) -> Column:
    return F.coalesce(F.sum(lane), F.lit(0)).cast(LANE_TYPE).alias(lane)


def merged(fingerprints: DataFrame) -> DataFrame:
    """The fingerprint of all parts together."""
    return fingerprints.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), *[_total(f"l{i}") for i in range(LANES)])


def identity(fingerprints: DataFrame) -> DataFrame:
    """rows and the lanes as one text, to store and to compare."""
    rest = [c for c in fingerprints.columns if not c.startswith("l") or c[1:] not in map(str, range(LANES))]
    return fingerprints.select(*rest, F.concat_ws("-", *[F.col(f"l{i}").cast("string") for i in range(LANES)]).alias("identity"))
