"""Plane geometry on nested arrays of points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def bbox(rings: Column) -> Column:
    """Struct x0, y0, x1, y1 of all points of nested rings or lines."""
    points = F.flatten(rings)
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def intersects(a: Column, b: Column) -> Column:
    """Closed boxes overlap."""
    return (a["x0"] <= b["x1"]) & (a["x1"] >= b["x0"]) & (a["y0"] <= b["y1"]) & (a["y1"] >= b["y0"])


def extends_beyond(a: Column, b: Column) -> Column:
    """Some side of a lies outside b."""
    return (a["x0"] < b["x0"]) | (a["x1"] > b["x1"]) | (a["y0"] < b["y0"]) | (a["y1"] > b["y1"])


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd rule with half-open edges; a ring may repeat its first point."""
    return let(ring, lambda r: _in_ring(x, y, r))


def _in_ring(x: Column, y: Column, ring: Column) -> Column:
    n = F.size(ring)

    def flip(inside: Column, i: Column) -> Column:
        a, b = F.element_at(ring, i), F.element_at(ring, F.when(i == 1, n).otherwise(i - 1))
        # an edge that is level never passes the first test, so the quotient below is defined where it counts
        rise = F.when(b["y"] == a["y"], F.lit(1.0)).otherwise(b["y"] - a["y"])
        crosses = ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / rise + a["x"])
        return F.when(crosses, ~inside).otherwise(inside)

    return F.when(n > 2, F.aggregate(F.sequence(F.lit(1), n), F.lit(False), flip)).otherwise(False)


def in_polygon(x: Column, y: Column, rings: Column) -> Column:
    """Within the outer ring and in no hole."""
    holes = F.when(F.size(rings) > 1, F.exists(F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(1))), lambda h: in_ring(x, y, h))).otherwise(False)
    return in_ring(x, y, F.element_at(rings, 1)) & ~holes


def rectangle(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """One closed ring as nested arrays."""
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(F.array(corner(x0, y0), corner(x1, y0), corner(x1, y1), corner(x0, y1), corner(x0, y0)))


def clip_ring(ring: Column, box: tuple[float, float, float, float]) -> Column:
    """The ring within a box, one side of the box after the other; empty when nothing is left."""
    x0, y0, x1, y1 = box
    for axis, bound, above in (("x", x0, True), ("x", x1, False), ("y", y0, True), ("y", y1, False)):
        ring = _clip_side(ring, axis, bound, above)
    return let(ring, lambda r: F.when(F.size(r) > 2, r).otherwise(F.slice(r, 1, 0)))


def _clip_side(ring: Column, axis: str, bound: float, above: bool) -> Column:
    return let(ring, lambda r: _clipped(r, axis, bound, above))


def _clipped(ring: Column, axis: str, bound: float, above: bool) -> Column:
    inside = (lambda p: p[axis] >= bound) if above else (lambda p: p[axis] <= bound)
    n = F.size(ring)

    def part(p: Column, i: Column) -> Column:
        before = F.element_at(ring, F.when(i == 0, n).otherwise(i))
        gap = F.when(p[axis] == before[axis], F.lit(1.0)).otherwise(p[axis] - before[axis])
        t = (bound - before[axis]) / gap
        cut = F.struct((before["x"] + t * (p["x"] - before["x"])).alias("x"), (before["y"] + t * (p["y"] - before["y"])).alias("y"))
        none = F.filter(F.array(p), lambda z: F.lit(False))
        return F.when(inside(p), F.when(inside(before), F.array(p)).otherwise(F.array(cut, p))).otherwise(F.when(inside(before), F.array(cut)).otherwise(none))

    return F.when(n > 0, F.flatten(F.transform(ring, part))).otherwise(ring)


def clip_range(a: Column, b: Column, box: tuple[float, float, float, float]) -> Column:
    """The part of a segment within a box as a struct (low, high) of shares of the way, or null."""
    x0, y0, x1, y1 = box
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    low, high, missed = F.lit(0.0), F.lit(1.0), F.lit(False)
    for p, q in ((-dx, a["x"] - x0), (dx, x1 - a["x"]), (-dy, a["y"] - y0), (dy, y1 - a["y"])):
        t = q / F.when(p == 0, F.lit(1.0)).otherwise(p)
        missed = missed | ((p == 0) & (q < 0))
        low, high = F.greatest(low, F.when(p < 0, t)), F.least(high, F.when(p > 0, t))  # nulls don't count
    return F.when(~missed & (low <= high), F.struct(low.alias("low"), high.alias("high")))


def clip_segment(a: Column, b: Column, box: tuple[float, float, float, float]) -> Column:
    """The part of a segment within a box as a struct (a, b), or null."""
    at = lambda t: F.struct((a["x"] + t * (b["x"] - a["x"])).alias("x"), (a["y"] + t * (b["y"] - a["y"])).alias("y"))
    return let(clip_range(a, b, box), lambda t: F.when(t.isNotNull(), F.struct(at(t["low"]).alias("a"), at(t["high"]).alias("b"))))
