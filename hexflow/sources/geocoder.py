"""Geocoder answers: parsing of GeoJSON feature collections (the request itself is the caller's)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "features array<struct<bbox: array<double>, geometry: struct<coordinates: array<double>>, properties: struct<display_name: string>>>"


def places(answers: DataFrame, json_col: str = "answer") -> DataFrame:
    """One row per place, ``name, lng, lat``: the middle of the bbox, or else the point."""
    f = F.explode(F.from_json(json_col, SCHEMA)["features"]).alias("f")
    box, point = F.col("f.bbox"), F.col("f.geometry.coordinates")
    middle = lambda i, j: F.when(F.size(box) == 4, (F.get(box, i) + F.get(box, j)) / 2).otherwise(F.get(point, i))
    out = answers.select(f).select(F.col("f.properties.display_name").alias("name"), middle(0, 2).alias("lng"), F.when(F.size(box) == 4, (F.get(box, 1) + F.get(box, 3)) / 2).otherwise(F.get(point, 1)).alias("lat"))
    return out.where("lng is not null and lat is not null")
