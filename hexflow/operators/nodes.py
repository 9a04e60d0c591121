"""Nodes that a person places, and what they allow."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hexflow.functions import geometry
from hexflow.functions.classify import classify, friction_of
from hexflow.params import IMPASSABLE
from hexflow.sources.shared import written


def clamp_weight(weight: Column) -> Column:
    return F.when(weight.isNotNull(), F.greatest(F.lit(1), F.least(F.lit(10), F.floor(weight + 0.5))).cast("int"))


def insert(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """The nodes and those of the new ones whose cell is free; of several on one cell the first by node_ord."""
    first = new.groupBy("cell_id").agg(F.min_by(F.struct("node_ord", "type", "weight"), "node_ord").alias("n")).select("n.node_ord", "cell_id", "n.type", clamp_weight(F.col("n.weight")).alias("weight"))
    return nodes.unionByName(first.join(nodes.select("cell_id"), "cell_id", "left_anti"))


def relocate(nodes: DataFrame, moves: DataFrame) -> DataFrame:
    """Nodes after moves (cell_id, to_cell); a move onto an occupied cell stays undone."""
    taken = nodes.select(F.col("cell_id").alias("to_cell"), F.lit(True).alias("_taken"))
    one = moves.groupBy("cell_id").agg(F.min("to_cell").alias("to_cell"))
    one = one.groupBy("to_cell").agg(F.min("cell_id").alias("cell_id"))  # two nodes can't end on one cell
    free = one.join(taken, "to_cell", "left").where("_taken is null").select("cell_id", "to_cell")
    return nodes.join(free, "cell_id", "left").withColumn("cell_id", F.coalesce("to_cell", "cell_id")).select(*nodes.columns)


def update(nodes: DataFrame, changes: DataFrame) -> DataFrame:
    """Nodes after changes (cell_id, type, weight; null: as before); a weight of 0 deletes."""
    own = changes.select("cell_id", F.col("type").alias("_t"), F.col("weight").alias("_w"))
    out = nodes.join(own, "cell_id", "left").where("_w is null or _w > 0")
    return out.withColumn("type", F.coalesce("_t", "type")).withColumn("weight", F.coalesce(clamp_weight(F.col("_w")), "weight")).select(*nodes.columns)


def counts(nodes: DataFrame) -> DataFrame:
    """``n_origins, n_destinations``: a dual node counts as both."""
    return nodes.agg(F.count_if(F.col("type").isin("origin", "dual")).alias("n_origins"), F.count_if(F.col("type").isin("destination", "dual")).alias("n_destinations"))


def readiness(nodes: DataFrame) -> DataFrame:
    """``n_active, has_build_inputs, is_ready``."""
    active = nodes.where("weight > 0")
    o, d = F.max(F.col("type").isin("origin", "dual").cast("int")) == 1, F.max(F.col("type").isin("destination", "dual").cast("int")) == 1
    ready = F.coalesce(o & d, F.lit(False))
    return active.agg(F.count("*").alias("n_active"), ((F.count("*") >= 2) & ready).alias("has_build_inputs"), ready.alias("is_ready"))


def placement(hits: DataFrame) -> DataFrame:
    """``place_id, accessible`` from features at places: the worst tier of each layer; the ground decides, else the easiest layer.

    A place without features of the five layers that count is accessible.
    """
    places = hits.select("place_id").distinct()
    known = classify(hits.where(F.col("source_layer").isin("transportation", "building", "water", "landcover", "landuse")))
    layers = known.groupBy("place_id", "vlayer").agg(F.max(friction_of(F.col("cost"))).alias("f"))
    cost = layers.groupBy("place_id").agg(F.coalesce(F.max(F.when(F.col("vlayer") == "0", F.col("f"))), F.min("f")).alias("f"))
    return places.join(cost, "place_id", "left").select("place_id", F.coalesce(F.col("f") < IMPASSABLE, F.lit(True)).alias("accessible"))


#: Length of the tiles that points and polygons meet in; points or polygons of one task.
TILE, LOT = 16.0, 4096


def pick_polygon(points: DataFrame, polygons: DataFrame) -> DataFrame:
    """``point_id, edit_id`` of the topmost polygon (edit_id, draw_order, rings) over each point (point_id, x, y).

    Polygons are dealt to tiles by their bbox, so a point meets those of its own tile, in one task: from the top down, only points that no
    polygon holds yet are tested, and of polygons with the same rings only the topmost.  A crowded tile is several tasks.  A polygon with a null coordinate holds no point.
    """
    tile = lambda c: F.floor(c / TILE).cast("long")
    at = points.where("x is not null and y is not null").select("point_id", "x", "y", tile(F.col("x")).alias("tx"), tile(F.col("y")).alias("ty"))
    fine = ~F.exists(F.flatten("rings"), lambda p: p["x"].isNull() | p["y"].isNull())
    flat = F.flatten(F.transform(F.flatten("rings"), lambda p: F.array(p["x"], p["y"])))
    sizes = F.transform("rings", lambda g: F.size(g))
    known = written(polygons.where(fine).select("edit_id", "draw_order", flat.alias("flat"), sizes.alias("sizes"), geometry.bbox(F.col("rings")).alias("b")))  # a box is worked out once
    area = at.agg(F.min("tx").alias("tx0"), F.max("tx").alias("tx1"), F.min("ty").alias("ty0"), F.max("ty").alias("ty1"))
    boxed = known.where("b.x0 is not null").crossJoin(F.broadcast(area))  # one row
    span = lambda a: F.sequence(F.greatest(tile(F.col(f"b.{a}0")), F.col(f"t{a}0")), F.least(tile(F.col(f"b.{a}1")), F.col(f"t{a}1")))
    meets = [(tile(F.col(f"b.{a}0")) <= F.col(f"t{a}1")) & (tile(F.col(f"b.{a}1")) >= F.col(f"t{a}0")) for a in "xy"]
    places = boxed.where(meets[0] & meets[1]).select("edit_id", "draw_order", "flat", "sizes", span("x").alias("_xs"), span("y").alias("_ys"))
    each = lambda df: df.withColumn("tx", F.explode("_xs")).withColumn("ty", F.explode("_ys")).drop("_xs", "_ys")

    lots = lambda df, name: df.groupBy("tx", "ty").agg(F.ceil(F.count("*") / LOT).cast("int").alias(name))
    crowded = lots(at, "np").join(lots(each(places.select("_xs", "_ys")), "ns"), ["tx", "ty"]).where("np > 1 or ns > 1")
    crowded = F.broadcast(written(crowded))  # a tile has more than LOT rows to be here
    one = lambda n: F.coalesce(n, F.lit(1))
    own = lambda key, n: F.pmod(F.xxhash64(key), one(F.col(n))).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), one(F.col(n)) - 1))
    left = at.join(crowded, ["tx", "ty"], "left").withColumn("_p", own("point_id", "np")).withColumn("_s", every("ns"))
    right = each(places).join(crowded, ["tx", "ty"], "left").withColumn("_s", own("edit_id", "ns")).withColumn("_p", every("np"))
    keys = ["tx", "ty", "_p", "_s"]
    types = {f.name: f.dataType.simpleString() for df in (points, polygons) for f in df.schema.fields}
    out = left.select(*keys, "point_id", "x", "y").groupBy(*keys).cogroup(right.select(*keys, "edit_id", "draw_order", "flat", "sizes").groupBy(*keys))
    hit = out.applyInPandas(_topmost, ", ".join(f"{c} {types[c]}" for c in ("point_id", "edit_id", "draw_order")))
    return hit.groupBy("point_id").agg(F.max_by("edit_id", F.struct("draw_order", "edit_id")).alias("edit_id"))


def _topmost(points: pd.DataFrame, polygons: pd.DataFrame) -> pd.DataFrame:
    """The topmost polygon of each point that one holds."""
    polygons = polygons.sort_values(["draw_order", "edit_id"], ascending=False, na_position="last")
    x, y = points.x.to_numpy(dtype=float), points.y.to_numpy(dtype=float)
    free, found, seen = np.arange(len(points)), np.full(len(points), -1), set()
    for k, (flat, sizes) in enumerate(zip(polygons.flat, polygons.sizes, strict=True)):
        shape = (flat.tobytes(), sizes.tobytes())
        if shape in seen:
            continue
        seen.add(shape)
        low, high = flat[1::2].min(), flat[1::2].max()
        near = free[(y[free] >= low) & (y[free] <= high)]
        if len(near):
            found[near[_within(x[near], y[near], flat, sizes)]] = k
            free = free[found[free] < 0]
            if not len(free):
                break
    got = np.flatnonzero(found >= 0)
    top = polygons.iloc[found[got]]
    return pd.DataFrame({"point_id": points.point_id.to_numpy()[got], "edit_id": top.edit_id.to_numpy(), "draw_order": top.draw_order.to_numpy()})


def _within(x: np.ndarray, y: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``geometry.in_polygon`` for many points: within the outer ring and in no hole."""
    inside, start = np.zeros(len(x), dtype=bool), 0
    for i, n in enumerate(sizes):
        ax, ay = flat[2 * start : 2 * (start + n)].reshape(n, 2).T
        start += n
        if n > 2:
            bx, by = np.roll(ax, 1), np.roll(ay, 1)
            rise = np.where(by == ay, 1.0, by - ay)
            crosses = ((ay > y[:, None]) != (by > y[:, None])) & (x[:, None] < (bx - ax) * (y[:, None] - ay) / rise + ax)
            odd = crosses.sum(axis=1) % 2 == 1
            inside = odd if i == 0 else inside & ~odd
    return inside


def pin_hit(clicks: DataFrame, nodes: DataFrame, pad: float = 0.0) -> DataFrame:
    """``click_id, node_ord``: the nearest active node whose pin (7 + 2.5 weight + pad) covers the click; clicks and nodes have x, y."""
    reach = 7 + 2.5 * 10 + pad  # no pin is larger
    tile = lambda c: F.floor(F.col(c) / reach).cast("long")
    around = lambda c: F.explode(F.sequence(tile(c) - 1, tile(c) + 1))
    pins = nodes.where("weight > 0").select("node_ord", "weight", F.col("x").alias("nx"), F.col("y").alias("ny"), around("x").alias("tx"), tile("y").alias("t")).select("*", F.explode(F.sequence(F.col("t") - 1, F.col("t") + 1)).alias("ty"))
    at = clicks.select("click_id", "x", "y", tile("x").alias("tx"), tile("y").alias("ty"))
    d = F.hypot(F.col("x") - F.col("nx"), F.col("y") - F.col("ny"))
    near = at.join(pins, ["tx", "ty"]).withColumn("d", d).where(F.col("d") <= 7 + 2.5 * F.col("weight") + pad)
    return near.groupBy("click_id").agg(F.min_by("node_ord", F.struct("d", "node_ord")).alias("node_ord"))


def bounds(points: DataFrame) -> DataFrame:
    """``x0, y0, x1, y1`` of the finite points (x, y)."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return points.where(finite("x") & finite("y")).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
