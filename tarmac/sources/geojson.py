"""Zone and point layers as GeoJSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _feature(geometry: Column, properties: Sequence[str]) -> Column:
    return F.to_json(
        F.struct(
            F.lit("Feature").alias("type"),
            F.struct(*properties).alias("properties"),
            geometry.alias("geometry"),
        )
    )


def point_features(df: DataFrame, x: str, y: str, properties: Sequence[str]) -> DataFrame:
    """One GeoJSON feature per row; each line is a document of its own, so a layer of
    any size can be written and read in parallel."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array(x, y).alias("coordinates"))
    return df.select(_feature(geometry, properties).alias("feature"))


def polygon_features(zones: DataFrame, properties: Sequence[str], ring: str = "ring") -> DataFrame:
    """Rings are closed on the way out, as the format asks."""
    pairs = F.transform(ring, lambda p: F.array(p["x"], p["y"]))
    closed = F.concat(pairs, F.slice(pairs, 1, 1))
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(closed).alias("coordinates"))
    return zones.select(_feature(geometry, properties).alias("feature"))


def area_features(zones: DataFrame, properties: Sequence[str], area: str = "area") -> DataFrame:
    """Areas of several polygons, each an outer ring and its holes, as MultiPolygons."""

    def closed(ring: Column) -> Column:
        pairs = F.transform(ring, lambda p: F.array(p["x"], p["y"]))
        return F.concat(pairs, F.slice(pairs, 1, 1))

    coordinates = F.transform(area, lambda polygon: F.transform(polygon, closed))
    geometry = F.struct(F.lit("MultiPolygon").alias("type"), coordinates.alias("coordinates"))
    return zones.select(_feature(geometry, properties).alias("feature"))


def write_features(features: DataFrame, path: str) -> None:
    """Newline-delimited features."""
    features.write.mode("overwrite").text(path)


_DEPTH = {"Point": 1, "LineString": 2, "Polygon": 3, "MultiPolygon": 4}
_AREAS = ("Polygon", "Area")


def _nested(depth: int) -> T.DataType:
    return T.ArrayType(_nested(depth - 1)) if depth else T.DoubleType()


def _layer_schema(kind: str, properties: T.StructType) -> T.StructType:
    # the nesting of areas depends on the feature, so their positions are read as text first
    coordinates = T.StringType() if kind in _AREAS else _nested(_DEPTH[kind])
    geometry = T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", coordinates)])
    return T.StructType([T.StructField("properties", properties), T.StructField("geometry", geometry)])


def parse_features(features: DataFrame, kind: str, properties: T.StructType, column: str = "feature") -> DataFrame:
    """Features as columns: properties plus ``x, y`` for points, ``line`` for lines.

    ``Polygon`` layers give ``rings`` (outer ring and holes); ``Area`` layers may mix
    Polygons and MultiPolygons and give ``area`` (polygons of rings).
    """
    f = F.from_json(column, _layer_schema(kind, properties))
    return _shape(features.select(f.alias("f")), kind)


def read_collection(spark: SparkSession, path: str, kind: str, properties: T.StructType) -> DataFrame:
    """A FeatureCollection document (one per file)."""
    schema = T.StructType([T.StructField("features", T.ArrayType(_layer_schema(kind, properties)))])
    documents = spark.read.schema(schema).option("multiLine", True).json(path)
    return _shape(documents.select(F.explode("features").alias("f")), kind)


def _shape(df: DataFrame, kind: str) -> DataFrame:
    at = F.col("f.geometry.coordinates")
    point = lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))
    if kind == "Point":
        return df.select("f.properties.*", at[0].alias("x"), at[1].alias("y"))
    if kind == "LineString":
        return df.select("f.properties.*", F.transform(at, point).alias("line"))
    # the last position of a ring repeats the first
    opened = lambda ring: F.transform(F.slice(ring, 1, F.size(ring) - 1), point)
    rings = lambda polygon: F.transform(polygon, opened)
    one = F.from_json(at, _nested(_DEPTH["Polygon"]))
    if kind == "Polygon":
        return df.select("f.properties.*", rings(one).alias("rings"))
    several = F.from_json(at, _nested(_DEPTH["MultiPolygon"]))
    polygons = F.when(F.col("f.geometry.type") == "MultiPolygon", several).otherwise(F.array(one))
    return df.select("f.properties.*", F.transform(polygons, rings).alias("area"))
