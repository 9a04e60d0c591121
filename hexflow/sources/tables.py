"""The canonical tables, read from Parquet, and the projection of the star schema onto them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hexflow.functions import geometry
from hexflow.functions.classify import LAYERS
from hexflow.schema import conform


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scan_features(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Features with a geometry in the layers that matter, optionally within plain bbox columns x0, y0, x1, y1."""
    out = spark.read.parquet(path).where(F.col("source_layer").isin(LAYERS) & F.col("rings").isNotNull())
    if box and "x0" in out.columns:  # four plain columns reach the scan
        out = out.where((F.col("x0") <= box[2]) & (F.col("x1") >= box[0]) & (F.col("y0") <= box[3]) & (F.col("y1") >= box[1]))
    return out


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, size = F.col("p_partkey"), F.col("p_size") % 10
    friction = F.when(size < 5, 1.0).when(size < 7, 2.5).when(size < 9, 4.0).otherwise(999999.0)
    out = table(spark, sf_dir, "part").select(p.alias("cell_id"), (p % 50).alias("q"), F.floor(p / 50.0).alias("r"), p.alias("ord"), friction.alias("friction"))
    return conform(out, "cells")


def feature_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    layer = F.when(F.col("l_linenumber") == 7, "1").when(F.col("l_linenumber") == 6, "-1").otherwise("0")
    friction = F.when(F.col("l_orderkey") % 100 == 0, 999999.0).when(F.col("l_quantity") <= 10, 1.0).when(F.col("l_quantity") <= 25, 2.5).otherwise(4.0)
    out = table(spark, sf_dir, "lineitem")
    return conform(out.select(F.col("l_partkey").alias("cell_id"), layer.alias("layer"), friction.alias("friction")), "feature_hits")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "part").agg(F.count("*").alias("n"))
    k = F.col("n_nationkey")
    kind = F.when(k % 3 == 0, "origin").when(k % 3 == 1, "destination").otherwise("dual")
    out = table(spark, sf_dir, "nation").crossJoin(F.broadcast(n))  # one row
    return conform(out.select(k.alias("node_ord"), (k * F.floor(F.col("n") / 25.0) + 3).alias("cell_id"), kind.alias("type"), (1 + (k * 7) % 10).alias("weight")), "nodes")


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    cls = F.when(F.col("o_orderstatus") == "F", "PAVEMENT").when(F.col("o_orderstatus") == "O", "HEAVY_GRASS").otherwise("IMPASSABLE")
    out = table(spark, sf_dir, "orders")
    row = F.floor(o / 500.0)
    return conform(out.select(o.alias("edit_id"), o.alias("draw_order"), cls.alias("surface_class"), (c % 46).alias("q0"), (c % 46 + 4).alias("q1"), row.alias("r0"), (row + 2).alias("r1")), "edits")


def edit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every edit as a paint event, in the order of the orders' numbers, and later a remove event for each barrier."""
    from hexflow.streaming.edits import EVENTS

    e = edits(spark, sf_dir)
    barrier = F.when(F.col("surface_class") == "IMPASSABLE", F.array(F.lit("paint"), F.lit("remove"))).otherwise(F.array(F.lit("paint")))
    out = e.withColumn("event", F.explode(barrier)).withColumn("seq", F.col("edit_id") + F.when(F.col("event") == "remove", F.lit(1 << 40)).otherwise(F.lit(0)))
    return out.select(*[x.split()[0] for x in EVENTS.split(", ")])


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "part").agg(F.count("*").alias("n"))
    out = table(spark, sf_dir, "events").crossJoin(F.broadcast(n))  # one row
    cell = (F.col("user_id") * 131 + F.col("event_id")) % F.col("n")
    return out.select("user_id", "ts", F.col("event_id").alias("step"), cell.alias("cell_id"), F.col("event_type").alias("kind"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature properties that reach every branch of the classifier."""
    p, size = F.col("p_partkey"), F.col("p_size")

    def pick(key, values, otherwise=None):
        out = F.lit(otherwise).cast("string")
        for i, v in reversed(list(enumerate(values))):
            out = F.when(key == i, v).otherwise(out)
        return out

    source = pick(p % 9, ["transportation", "landcover", "landuse", "building", "water", "waterway", "park", "transportation"], "aeroway")
    cls = pick(F.floor(p / 9.0) % 12, ["path", "primary", "tertiary", "track", "rail", "pier", "ferry", "grass", "wetland", "residential", "military"], "pitch")
    return table(spark, sf_dir, "part").select(
        p.alias("feature_id"), source.alias("source_layer"), cls.alias("class"),
        pick(size % 8, ["footway", "cycleway", "steps", "forest", "park", "orchard", "swamp"]).alias("subclass"),
        pick(size % 5, ["asphalt", "gravel", "lava"]).alias("surface"), pick(p % 13, ["bridge", "tunnel", "ford"]).alias("brunnel"),
        F.when(p % 29 == 0, "no").alias("foot"), F.when(p % 31 == 0, "private").alias("access"), F.when(p % 37 == 0, "true").alias("indoor"),
        pick(p % 17, ["1", "-1", "x"]).alias("layer"),
    )


def map_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features with a geometry each: roads and waterways are lines to a cell far off, the others rectangles.

    Every third rectangle has a hole, and every fourth feature that is no line a second part, as a row of its own.
    """
    p, size, half = F.col("p_partkey"), F.col("p_size"), 0.8660254037844386
    at = table(spark, sf_dir, "part").select(p.alias("feature_id"), (p % 50).alias("q"), F.floor(p / 50.0).alias("r"), size.alias("size"))
    n = at.agg(F.count("*").alias("n"))
    at = at.crossJoin(F.broadcast(n)).withColumn("to", (F.col("feature_id") * 37) % F.col("n") + 1)  # one row
    centre = lambda q, r: (q + r / 2.0, r * half)
    ends = zip(("x", "y", "x1", "y1"), (*centre(F.col("q"), F.col("r")), *centre(F.col("to") % 50, F.floor(F.col("to") / 50.0))), strict=True)
    at = at.select("feature_id", *(c.alias(k) for k, c in ends), (F.col("size") % 7 + 1.3).alias("w"), (F.col("size") % 5 + 1.1).alias("h"))
    x, y, x1, y1, w, h = (F.col(c) for c in ("x", "y", "x1", "y1", "w", "h"))
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    box = lambda part, by: geometry.rectangle(x - w * by + part * 10, y - h * by + part * 6, x + w * by + part * 10, y + h * by + part * 6)
    filled = lambda part: F.when(F.col("feature_id") % 3 == 0, F.concat(box(part, 1.0), box(part, 0.4))).otherwise(box(part, 1.0))
    line = F.array(F.array(point(x, y), point(x1, y1)))
    is_line = F.col("source_layer").isin("transportation", "waterway")
    known = features(spark, sf_dir).join(at, "feature_id")
    parts = F.when(is_line, F.array(line)).when(F.col("feature_id") % 4 == 0, F.array(filled(0), filled(1))).otherwise(F.array(filled(0)))
    out = known.withColumn("geom_type", F.when(is_line, "LineString").otherwise("Polygon")).withColumn("rings", F.explode(parts))
    return conform(out, "features")


def edit_polygons(edits: DataFrame) -> DataFrame:
    """The painted rectangles as polygons on the plane of cell centres (spacing 1)."""
    half = 0.8660254037844386
    x0, x1 = F.col("q0") + F.col("r0") / 2.0 - 0.25, F.col("q1") + F.col("r1") / 2.0 + 0.25
    y0, y1 = F.col("r0") * half - 0.1, F.col("r1") * half + 0.1
    return edits.select("edit_id", "draw_order", "surface_class", geometry.rectangle(x0, y0, x1, y1).alias("rings"))
