"""GeoJSON sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hexflow.functions import grid


def hexagon(q, r, spacing: float = 1.0) -> Column:
    """Closed ring of a cell as nested arrays of coordinates."""
    ring = F.transform(grid.boundary(q, r, spacing), lambda p: F.array(p["x"], p["y"]))
    return F.array(F.concat(ring, F.slice(ring, 1, 1)))


def cell_features(rows: DataFrame) -> DataFrame:
    """``feature``: a polygon feature as JSON for each row of cell_id, q, r, score, affordance, friction."""
    properties = F.struct(F.col("cell_id").alias("h3"), F.col("score").alias("desireScore"), "affordance", "friction")
    geometry = F.struct(F.lit("Polygon").alias("type"), hexagon("q", "r").alias("coordinates"))
    return rows.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties"))).alias("feature"))


def pin_features(nodes: DataFrame) -> DataFrame:
    """``feature``: a point feature as JSON for each node with q and r."""
    x, y = grid.centre("q", "r")
    geometry = F.struct(F.lit("Point").alias("type"), F.array(x, y).alias("coordinates"))
    return nodes.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct("type", "weight").alias("properties"))).alias("feature"))


def write(features: DataFrame, path: str) -> None:
    """Newline-delimited features, one part a task; readers take the folder as a collection."""
    features.select(F.col("feature").alias("value")).write.mode("overwrite").text(path)
