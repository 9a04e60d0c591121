"""Colours of the flow and friction meshes as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The five stops of the flow ramp, and the friction colours by exact tier value.
STOPS = {"red": [235, 198, 156, 129, 77], "green": [210, 153, 95, 15, 0], "blue": [236, 201, 160, 124, 73]}


def flow_ratio(score: Column, peak: Column) -> Column:
    top = F.log1p(peak.cast("double"))
    return F.when(top > 0, F.least(F.lit(1.0), F.log1p(score.cast("double")) / top)).otherwise(0.0)


def ramp(ratio: Column) -> dict[str, Column]:
    """Piecewise-linear red, green, blue and alpha, truncated to integers."""
    at = ratio * 4
    i = F.floor(at).cast("int")
    out = {}
    for name, stops in STOPS.items():
        table = F.array(*map(F.lit, stops))
        a, b = F.element_at(table, i + 1), F.element_at(table, F.least(i + 2, F.lit(5)))
        out[name] = (a + (b - a) * (at - i)).cast("int")
    return out | {"alpha": (140 + 115 * ratio).cast("int")}


def friction_colour(friction: Column) -> Column:
    """Red, green, blue, alpha by exact tier value."""
    rgba = lambda *v: F.array(*map(F.lit, v))
    return F.when(friction >= 999999.0, rgba(231, 76, 60, 160)).when(friction == 4.0, rgba(39, 174, 96, 120)).when(friction == 2.5, rgba(166, 216, 84, 90)).otherwise(rgba(0, 150, 255, 25))
