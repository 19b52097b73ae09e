"""Writers: clustered layers, feature collections, reports and audit rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import relational as R

# fixed values: bookkeeping columns dropped from source exports
DROPPED = ("objectid_1", "shape_leng", "shape_length", "shape_area", "shape__length", "shape__area", "globalid")


def lower_case(df: DataFrame) -> DataFrame:
    out = df.toDF(*[c.lower() for c in df.columns])
    return out.drop(*[c for c in DROPPED if c in out.columns])


def write_layer(df: DataFrame, path: str, cell: float = 0.5) -> None:
    """Parquet clustered by grid cell, so box statistics prune row groups."""
    cx, cy = F.floor(F.col("x0") / cell), F.floor(F.col("y0") / cell)
    lower_case(df).repartitionByRange(cx, cy).sortWithinPartitions("x0", "y0").write.mode("overwrite").parquet(path)


def registry_row(df: DataFrame, name: str, source_url: str) -> DataFrame:
    """Registry entry of a layer: box, row count and time."""
    return df.agg(
        F.struct(F.min("x0").alias("minx"), F.min("y0").alias("miny"), F.max("x1").alias("maxx"), F.max("y1").alias("maxy")).alias("bbox"),
        F.count(F.lit(1)).alias("row_count"),
    ).select(F.lit(name).alias("name"), F.lit(source_url).alias("source_url"), "bbox", "row_count", F.current_timestamp().alias("updated_at"))


def upsert_registry(registry: DataFrame, entry: DataFrame) -> DataFrame:
    return R.upsert_latest(registry, entry, ["name"], "updated_at")


def geojson_feature(geometry_type: str, coordinates: Column, properties: list[str]) -> Column:
    """One GeoJSON feature as text."""
    return F.to_json(
        F.struct(
            F.lit("Feature").alias("type"),
            F.struct(F.lit(geometry_type).alias("type"), coordinates.alias("coordinates")).alias("geometry"),
            F.struct(*properties).alias("properties"),
        )
    )


def point_features(df: DataFrame, properties: list[str]) -> DataFrame:
    return df.select(geojson_feature("Point", F.array("lng", "lat"), properties).alias("value"))


def polygon_features(df: DataFrame, properties: list[str]) -> DataFrame:
    coords = F.transform("rings", lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"])))
    return df.select(geojson_feature("Polygon", coords, properties).alias("value"))


def write_features(features: DataFrame, path: str) -> None:
    """One feature per line, so writing stays parallel."""
    features.write.mode("overwrite").text(path)


def properties_json(df: DataFrame, drop: tuple[str, ...] = ("rings", "paths", "lng", "lat")) -> Column:
    return F.to_json(F.struct(*[c for c in df.columns if c not in drop]))


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def append_audit(df: DataFrame, existing: DataFrame | None, path: str, key: str = "execution_id") -> None:
    """Append rows whose key is not yet stored."""
    fresh = R.append_new(df.limit(0) if existing is None else existing, df, key)
    fresh.write.mode("append").parquet(path)
