"""The axial hexagon grid in closed form: no lookups, no UDFs."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Axial offsets of a cell's six neighbours.
NEIGHBOURS = [(1, 0), (1, -1), (0, -1), (-1, 0), (-1, 1), (0, 1)]
#: Pushes path points off the edges between cells, alike in every engine.
NUDGE_Q, NUDGE_R = 1e-6, 2e-6


def disk_offsets(k: int) -> list[tuple[int, int]]:
    """The 1 + 3k(k + 1) offsets within k steps."""
    return [(q, r) for q in range(-k, k + 1) for r in range(max(-k, -q - k), min(k, -q + k) + 1)]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def cell_code(q, r) -> Column:
    """One long for a cell, ascending by (q, r)."""
    return F.shiftleft(_c(q).cast("long") + (1 << 30), 31).bitwiseOR(_c(r).cast("long") + (1 << 30))


def decode(code) -> tuple[Column, Column]:
    code = _c(code)
    return ((F.shiftright(code, 31) - (1 << 30)).cast("int"), (code.bitwiseAND((1 << 31) - 1) - (1 << 30)).cast("int"))


def grid_distance(q0, r0, q1, r1) -> Column:
    dq, dr = _c(q1) - _c(q0), _c(r1) - _c(r0)
    return ((F.abs(dq) + F.abs(dr) + F.abs(dq + dr)) / 2).cast("int")


def offsets(pairs: list[tuple[int, int]]) -> Column:
    """The offsets as an array of structs (dq, dr), to explode."""
    return F.array(*[F.struct(F.lit(q).alias("dq"), F.lit(r).alias("dr")) for q, r in pairs])


def centre(q, r, spacing: float = 1.0) -> tuple[Column, Column]:
    return (F.lit(spacing) * (_c(q) + _c(r) / 2.0), F.lit(spacing * math.sqrt(3) / 2) * _c(r))


def boundary(q, r, spacing: float = 1.0) -> Column:
    """Six corners as an array of structs (x, y), from the east-north-east one on."""
    x, y = centre(q, r, spacing)
    size = spacing / math.sqrt(3)
    angle = lambda i: F.radians(60.0 * i + 30.0)
    return F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.struct((x + size * F.cos(angle(i))).alias("x"), (y + size * F.sin(angle(i))).alias("y")))


def cube_round(q: Column, r: Column) -> tuple[Column, Column]:
    """The cell that holds fractional axial coordinates."""
    s = -q - r
    fq, fr, fs = (F.floor(x + 0.5).cast("double") for x in (q, r, s))
    dq, dr, ds = F.abs(fq - q), F.abs(fr - r), F.abs(fs - s)
    q_worst, r_worst = (dq > dr) & (dq > ds), dr > ds
    return (F.when(q_worst, -fr - fs).otherwise(fq).cast("int"), F.when(~q_worst & r_worst, -fq - fs).otherwise(fr).cast("int"))


def line_ends(q0, r0, q1, r1) -> dict[str, Column]:
    """A line from its smaller end, so that it has the same cells both ways: that end, the way to the other, its length."""
    q0, r0, q1, r1 = map(_c, (q0, r0, q1, r1))
    forward = (q0 < q1) | ((q0 == q1) & (r0 <= r1))
    pick = lambda a, b: F.when(forward, a).otherwise(b)
    aq, ar, bq, br = pick(q0, q1), pick(r0, r1), pick(q1, q0), pick(r1, r0)
    return {"_q": aq, "_r": ar, "_dq": bq - aq, "_dr": br - ar, "_n": grid_distance(q0, r0, q1, r1)}


def along(i: Column, q: Column, r: Column, dq: Column, dr: Column, n: Column) -> tuple[Column, Column]:
    """The point i of n steps along a line, nudged off the cells' edges."""
    t = i.cast("double") / F.greatest(F.lit(1), n).cast("double")
    return q + dq * t + NUDGE_Q, r + dr * t + NUDGE_R


def path_cell(i: Column, q0, r0, q1, r1) -> tuple[Column, Column]:
    """The cell of the straight line i steps from its smaller end."""
    return cube_round(*along(i, *line_ends(q0, r0, q1, r1).values()))


def grid_path(q0, r0, q1, r1) -> Column:
    """The cells of the straight line as an array of structs (q, r); the way back is the exact reverse."""
    q0, r0, q1, r1 = map(_c, (q0, r0, q1, r1))
    path = F.transform(F.sequence(F.lit(0), grid_distance(q0, r0, q1, r1)), lambda i: F.struct(*(c.alias(n) for c, n in zip(path_cell(i, q0, r0, q1, r1), ("q", "r"), strict=True))))
    return F.when((q0 < q1) | ((q0 == q1) & (r0 <= r1)), path).otherwise(F.reverse(path))


def path_cells(q0: int, r0: int, q1: int, r1: int) -> list[tuple[int, int]]:
    """The same line for the walking kernel."""
    turned = (q0, r0) > (q1, r1)
    (aq, ar), (bq, br) = ((q1, r1), (q0, r0)) if turned else ((q0, r0), (q1, r1))
    n = (abs(bq - aq) + abs(br - ar) + abs(bq - aq + br - ar)) // 2
    out = []
    for i in range(n + 1):
        t = i / n if n else 0.0
        q, r = aq + (bq - aq) * t + NUDGE_Q, ar + (br - ar) * t + NUDGE_R
        s = -q - r
        fq, fr, fs = (math.floor(x + 0.5) for x in (q, r, s))
        dq, dr, ds = abs(fq - q), abs(fr - r), abs(fs - s)
        if dq > dr and dq > ds:
            fq = -fr - fs
        elif dr > ds:
            fr = -fq - fs
        out.append((fq, fr))
    return out[::-1] if turned else out


def bearing(dq, dr) -> Column:
    """Degrees clockwise from north to a cell at this offset."""
    x, y = centre(dq, dr)
    return F.pmod(F.degrees(F.atan2(x, y)), F.lit(360.0))


def round_half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def spherical_bearing(lat0, lng0, lat1, lng1) -> Column:
    """Initial great-circle bearing in degrees."""
    a, b, d = F.radians(_c(lat0)), F.radians(_c(lat1)), F.radians(_c(lng1) - _c(lng0))
    return F.pmod(F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d))), F.lit(360.0))


def angle_diff(a, b) -> Column:
    """Between 0 and 180."""
    return F.abs(F.pmod(_c(a) - _c(b) + 540.0, F.lit(360.0)) - 180.0)
