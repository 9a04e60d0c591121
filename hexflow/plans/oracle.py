"""DuckDB SQL for the catalogue's queries, over the same Parquet tables."""

from __future__ import annotations

import re

from hexflow.functions import classify as C
from hexflow.functions.grid import disk_offsets
from hexflow.plans.catalogue import AOI

def _crossings(ring) -> str:
    """How often a level ray from (x, y) crosses the ring, half-open."""
    parts = []
    for (ax, ay), (bx, by) in zip(ring, [ring[-1], *ring[:-1]], strict=True):
        if ay != by:
            parts.append(f"CASE WHEN ({ay} > y) <> ({by} > y) AND x < ({bx} - {ax}) * (y - {ay}) / ({by} - {ay})::DOUBLE + {ax} THEN 1 ELSE 0 END")
    return f"(({' + '.join(parts)}) % 2 = 1)"


_CTE = {
    "cells": """SELECT p_partkey AS cell_id, CAST(p_partkey % 50 AS INT) AS q, CAST(FLOOR(p_partkey / 50.0) AS INT) AS r, CAST(p_partkey AS INT) AS ord,
        CAST(CASE WHEN p_size % 10 < 5 THEN 1.0 WHEN p_size % 10 < 7 THEN 2.5 WHEN p_size % 10 < 9 THEN 4.0 ELSE 999999.0 END AS DOUBLE) AS friction FROM part""",
    "hits": """SELECT l_partkey AS cell_id, CASE l_linenumber WHEN 7 THEN '1' WHEN 6 THEN '-1' ELSE '0' END AS layer,
        CAST(CASE WHEN l_orderkey % 100 = 0 THEN 999999.0 WHEN l_quantity <= 10 THEN 1.0 WHEN l_quantity <= 25 THEN 2.5 ELSE 4.0 END AS DOUBLE) AS friction
        FROM lineitem""",
    "layers": "SELECT cell_id, layer, CASE WHEN max(friction) >= 999999.0 THEN 999999.0 ELSE min(friction) END AS friction FROM hits GROUP BY cell_id, layer",
    "ground": "SELECT c.cell_id, coalesce(l.friction, 1.0) AS friction FROM cells c LEFT JOIN layers l ON l.cell_id = c.cell_id AND l.layer = '0'",
    "nodes": """SELECT n.n_nationkey AS node_ord, CAST(n.n_nationkey * FLOOR(c.n / 25.0) + 3 AS BIGINT) AS cell_id,
        CASE n.n_nationkey % 3 WHEN 0 THEN 'origin' WHEN 1 THEN 'destination' ELSE 'dual' END AS type, CAST(1 + (n.n_nationkey * 7) % 10 AS INT) AS weight
        FROM nation n CROSS JOIN (SELECT COUNT(*) AS n FROM part) c""",
    "edits": """SELECT o_orderkey AS edit_id, o_orderkey AS draw_order, CASE o_orderstatus WHEN 'F' THEN 'PAVEMENT' WHEN 'O' THEN 'HEAVY_GRASS' ELSE 'IMPASSABLE' END AS surface_class,
        CAST(o_custkey % 46 AS INT) AS q0, CAST(o_custkey % 46 + 4 AS INT) AS q1, CAST(FLOOR(o_orderkey / 500.0) AS INT) AS r0, CAST(FLOOR(o_orderkey / 500.0) + 2 AS INT) AS r1
        FROM orders""",
    "boxes": """SELECT edit_id, draw_order, q0 + r0 / 2.0::DOUBLE - 0.25::DOUBLE AS x0, q1 + r1 / 2.0::DOUBLE + 0.25::DOUBLE AS x1, r0 * 0.8660254037844386::DOUBLE - 0.1::DOUBLE AS y0, r1 * 0.8660254037844386::DOUBLE + 0.1::DOUBLE AS y1 FROM edits""",
    "traces": """SELECT e.user_id, e.ts, e.event_id AS step, (e.user_id * 131 + e.event_id) % c.n AS cell_id, e.event_type AS kind FROM events e CROSS JOIN (SELECT COUNT(*) AS n FROM part) c""",
    "desire": "SELECT cell_id, count(*) AS score FROM traces GROUP BY cell_id",
    "features": """SELECT p_partkey AS feature_id,
        CASE p_partkey % 9 WHEN 0 THEN 'transportation' WHEN 1 THEN 'landcover' WHEN 2 THEN 'landuse' WHEN 3 THEN 'building' WHEN 4 THEN 'water' WHEN 5 THEN 'waterway' WHEN 6 THEN 'park' WHEN 7 THEN 'transportation' ELSE 'aeroway' END AS source_layer,
        CASE CAST(FLOOR(p_partkey / 9.0) AS INT) % 12 WHEN 0 THEN 'path' WHEN 1 THEN 'primary' WHEN 2 THEN 'tertiary' WHEN 3 THEN 'track' WHEN 4 THEN 'rail' WHEN 5 THEN 'pier' WHEN 6 THEN 'ferry' WHEN 7 THEN 'grass' WHEN 8 THEN 'wetland' WHEN 9 THEN 'residential' WHEN 10 THEN 'military' ELSE 'pitch' END AS class,
        CASE p_size % 8 WHEN 0 THEN 'footway' WHEN 1 THEN 'cycleway' WHEN 2 THEN 'steps' WHEN 3 THEN 'forest' WHEN 4 THEN 'park' WHEN 5 THEN 'orchard' WHEN 6 THEN 'swamp' ELSE NULL END AS subclass,
        CASE p_size % 5 WHEN 0 THEN 'asphalt' WHEN 1 THEN 'gravel' WHEN 2 THEN 'lava' ELSE NULL END AS surface,
        CASE p_partkey % 13 WHEN 0 THEN 'bridge' WHEN 1 THEN 'tunnel' WHEN 2 THEN 'ford' ELSE NULL END AS brunnel,
        CASE WHEN p_partkey % 29 = 0 THEN 'no' END AS foot, CASE WHEN p_partkey % 31 = 0 THEN 'private' END AS access, CASE WHEN p_partkey % 37 = 0 THEN 'true' END AS indoor,
        CASE p_partkey % 17 WHEN 0 THEN '1' WHEN 1 THEN '-1' WHEN 2 THEN 'x' ELSE NULL END AS layer FROM part""",
    "offs": "SELECT * FROM (VALUES (1, 0), (1, -1), (0, -1), (-1, 0), (-1, 1), (0, 1)) AS t(dq, dr)",
    "disk2": f"SELECT *, CAST((abs(dq) + abs(dr) + abs(dq + dr)) / 2 AS INT) AS d FROM (VALUES {', '.join(map(str, disk_offsets(2)))}) AS t(dq, dr)",
    "edges": "SELECT a.cell_id AS src, b.cell_id AS dst, a.q AS q0, a.r AS r0, b.q AS q1, b.r AS r1, a.friction AS f0, b.friction AS f1, b.ord AS dst_ord FROM cells a CROSS JOIN offs o JOIN cells b ON b.q = a.q + o.dq AND b.r = a.r + o.dr",
    "adj": "SELECT src, dst, CAST(floor(8 * f1 + 0.5) AS INT) AS w8 FROM edges WHERE f0 < 999999 AND f1 < 999999",
    "hops": """SELECT step, kind, prev, t.cell_id, a.q AS q0, a.r AS r0, b.q AS q1, b.r AS r1
        FROM (SELECT step, kind, cell_id, lag(cell_id) OVER (PARTITION BY user_id ORDER BY ts, step) AS prev FROM traces) t JOIN cells a ON a.cell_id = prev JOIN cells b ON b.cell_id = t.cell_id""",
    "dests": "SELECT DISTINCT n.cell_id AS dest FROM nodes n WHERE type IN ('destination', 'dual')",
    "g": """SELECT d.dest, d.dest AS cell_id, CAST(0 AS BIGINT) AS dist8 FROM dests d JOIN cells c ON c.cell_id = d.dest WHERE c.friction < 999999
        UNION SELECT g.dest, a.dst, min(g.dist8 + a.w8) FROM g JOIN adj a ON a.src = g.cell_id LEFT JOIN recurring.g k ON k.dest = g.dest AND k.cell_id = a.dst
        WHERE k.dist8 IS NULL OR g.dist8 + a.w8 < k.dist8 GROUP BY g.dest, a.dst""",
    "od": """SELECT o.cell_id AS origin, d.cell_id AS dest, CAST((abs(dc.q - oc.q) + abs(dc.r - oc.r) + abs(dc.q - oc.q + dc.r - oc.r)) / 2 AS INT) AS grid_dist
        FROM nodes o JOIN cells oc USING (cell_id), nodes d JOIN cells dc USING (cell_id) WHERE o.type IN ('origin', 'dual') AND d.type IN ('destination', 'dual') AND o.cell_id <> d.cell_id""",
    "pairs": """SELECT o.cell_id AS origin, d.cell_id AS dest, d.node_ord AS dest_ord, d.weight, o.weight AS origin_weight, g.dist8
        FROM g JOIN nodes o ON o.cell_id = g.cell_id AND o.type IN ('origin', 'dual') JOIN cells oc ON oc.cell_id = o.cell_id AND oc.friction < 999999
        JOIN nodes d ON d.cell_id = g.dest AND d.type IN ('destination', 'dual') WHERE o.cell_id <> d.cell_id""",
    "quota": """SELECT *, greatest(1, CAST(floor(origin_weight * 100 + 0.5) AS INT)) AS total_volume,
        CAST(weight AS DOUBLE) / CAST(sum(weight) OVER (PARTITION BY origin) AS DOUBLE) * greatest(1, CAST(floor(origin_weight * 100 + 0.5) AS INT)) AS quota FROM pairs""",
    "plan": """SELECT origin, dest, weight, total_volume, CAST(floor(quota) + CASE WHEN row_number() OVER (PARTITION BY origin ORDER BY quota - floor(quota) DESC, weight DESC, dest_ord)
        <= total_volume - sum(floor(quota)) OVER (PARTITION BY origin) THEN 1 ELSE 0 END AS INT) AS assigned FROM quota""",
    "bear": "SELECT step, prev, cell_id, (degrees(atan2((q1 - q0) + (r1 - r0) / 2.0, 0.8660254037844386::DOUBLE * (r1 - r0))) + 360.0) % 360.0 AS bearing FROM hops",
    "vis": """SELECT src, dst, min(hops) AS hops FROM (SELECT src, dst, 1 AS hops FROM adj UNION ALL SELECT a.src, b.dst, 2 FROM adj a JOIN adj b ON a.dst = b.src WHERE a.src <> b.dst) GROUP BY src, dst""",
    "visb": """SELECT src, dst, hops, b.ord AS dst_ord, CAST(floor((degrees(atan2((b.q - a.q) + (b.r - a.r) / 2.0, 0.8660254037844386::DOUBLE * (b.r - a.r))) + 360.0) % 360.0 + 0.5) AS INT) AS bearing
        FROM vis JOIN cells a ON a.cell_id = src JOIN cells b ON b.cell_id = dst""",
    "flood": """SELECT cell_id AS src, cell_id AS dst, 0 AS hops FROM cells WHERE friction < 999999
        UNION SELECT v.src, a.dst, min(v.hops) + 1 FROM flood v JOIN adj a ON a.src = v.dst LEFT JOIN recurring.flood k ON k.src = v.src AND k.dst = a.dst WHERE k.hops IS NULL AND v.hops < 15 GROUP BY v.src, a.dst""",
    "inside": f"SELECT cell_id, q, r, friction FROM (SELECT *, q + r / 2.0::DOUBLE AS x, r * sqrt(3.0::DOUBLE) / 2 AS y FROM cells) WHERE {_crossings(AOI[0])} AND NOT {_crossings(AOI[1])}",
    "flood_in": """SELECT cell_id AS src, cell_id AS dst, 0 AS hops FROM inside WHERE friction < 999999
        UNION SELECT v.src, a.dst, min(v.hops) + 1 FROM flood_in v JOIN (SELECT * FROM adj WHERE src IN (SELECT cell_id FROM inside) AND dst IN (SELECT cell_id FROM inside)) a ON a.src = v.dst
        LEFT JOIN recurring.flood_in k ON k.src = v.src AND k.dst = a.dst WHERE k.hops IS NULL AND v.hops < 15 GROUP BY v.src, a.dst""",
    "clear": "SELECT step, bool_and(coalesce(c.friction < 999999, false)) AS clear FROM path p LEFT JOIN cells c ON c.q = p.q AND c.r = p.r GROUP BY step",
    "steps": "SELECT h.*, k.clear, f.hops AS n FROM hops h JOIN clear k USING (step) LEFT JOIN flood f ON f.src = h.prev AND f.dst = h.cell_id",
    "detour": """SELECT step, 0 AS i, prev AS here, cell_id AS goal, n FROM steps WHERE NOT clear AND n > 0
        UNION ALL SELECT d.step, d.i + 1, arg_min(a.dst, c.ord), any_value(d.goal), any_value(d.n) FROM detour d JOIN adj a ON a.src = d.here JOIN flood f ON f.src = a.dst AND f.dst = d.goal AND f.hops = d.n - d.i - 1 JOIN cells c ON c.cell_id = a.dst
        WHERE d.i < d.n GROUP BY d.step, d.i""",
    "shapes": """SELECT f.*, k, x - w * by_ + k * 10 AS x0, x + w * by_ + k * 10 AS x1, y - h * by_ + k * 6 AS y0, y + h * by_ + k * 6 AS y1, by_ < 1 AS hole FROM (SELECT p_partkey AS feature_id, CAST(p_size % 7 + 1.3::DOUBLE AS DOUBLE) AS w, CAST(p_size % 5 + 1.1::DOUBLE AS DOUBLE) AS h,
        p_partkey % 50 + floor(p_partkey / 50.0) / 2.0::DOUBLE AS x, floor(p_partkey / 50.0) * 0.8660254037844386::DOUBLE AS y FROM part) f, (VALUES (0), (1)) a(k), (VALUES (1.0::DOUBLE), (0.4::DOUBLE)) b(by_) WHERE (k = 0 OR feature_id % 4 = 0) AND (by_ = 1 OR feature_id % 3 = 0)""",
    "ways": """SELECT a.feature_id AS step, 'way' AS kind, a.q AS q0, a.r AS r0, CAST(a.to_ % 50 AS INT) AS q1, CAST(floor(a.to_ / 50.0) AS INT) AS r1 FROM
        (SELECT p_partkey AS feature_id, CAST(p_partkey % 50 AS INT) AS q, CAST(floor(p_partkey / 50.0) AS INT) AS r, (p_partkey * 37) % (SELECT count(*) FROM part) + 1 AS to_ FROM part) a""",
    "halo": """SELECT c.cell_id, least(999998.0, c.friction + w * 3.0) AS friction, w FROM (SELECT cell_id, sum(CASE d WHEN 1 THEN exp(-0.5::DOUBLE * (1 / 1.5::DOUBLE) ** 2) ELSE exp(-0.5::DOUBLE * (2 / 1.5::DOUBLE) ** 2) END) AS w
        FROM (SELECT s, cell_id, min(d) AS d FROM (SELECT src AS s, dst AS cell_id, 1 AS d FROM edges WHERE f0 >= 999999 UNION ALL SELECT a.src, b.dst, 2 FROM edges a JOIN edges b ON a.dst = b.src WHERE a.f0 >= 999999 AND a.src <> b.dst) GROUP BY s, cell_id) GROUP BY cell_id) h
        JOIN cells c ON c.cell_id = h.cell_id WHERE c.friction < 999999""",
    "lerp": """SELECT step, kind, q0, r0, q1, r1, i, n, CASE WHEN n = 0 THEN 0.0::DOUBLE ELSE i::DOUBLE / n::DOUBLE END AS t,
        CASE WHEN (q0, r0) <= (q1, r1) THEN q0 ELSE q1 END AS aq, CASE WHEN (q0, r0) <= (q1, r1) THEN r0 ELSE r1 END AS ar,
        CASE WHEN (q0, r0) <= (q1, r1) THEN q1 ELSE q0 END AS bq, CASE WHEN (q0, r0) <= (q1, r1) THEN r1 ELSE r0 END AS br
        FROM (SELECT *, unnest(range(0, n + 1)) AS i FROM (SELECT *, CAST((abs(q1 - q0) + abs(r1 - r0) + abs(q1 - q0 + r1 - r0)) / 2 AS INT) AS n FROM hops))""",
    "frac": "SELECT step, kind, aq + (bq - aq) * t + 0.000001::DOUBLE AS fq, ar + (br - ar) * t + 0.000002::DOUBLE AS fr FROM lerp",
    "cube": "SELECT *, -fq - fr AS fs, floor(fq + 0.5) AS iq, floor(fr + 0.5) AS ir, floor(-fq - fr + 0.5) AS is_ FROM frac",
    "path": """SELECT DISTINCT step, kind, CAST(CASE WHEN abs(iq - fq) > abs(ir - fr) AND abs(iq - fq) > abs(is_ - fs) THEN -ir - is_ ELSE iq END AS INT) AS q,
        CAST(CASE WHEN NOT (abs(iq - fq) > abs(ir - fr) AND abs(iq - fq) > abs(is_ - fs)) AND abs(ir - fr) > abs(is_ - fs) THEN -iq - is_ ELSE ir END AS INT) AS r FROM cube""",
    "corridor": "SELECT DISTINCT c.cell_id, c.q, c.r FROM path p JOIN cells c ON c.q = p.q AND c.r = p.r WHERE kind = 'purchase'",
    "wide": """SELECT c.cell_id, greatest(1.0, c.friction - w * 1.5) AS friction, w FROM (SELECT s.q + o.dq AS q, s.r + o.dr AS r, sum(exp(-0.5::DOUBLE)) AS w FROM corridor s, offs o GROUP BY 1, 2) x
        JOIN cells c ON c.q = x.q AND c.r = x.r WHERE NOT EXISTS (SELECT 1 FROM layers l WHERE l.cell_id = c.cell_id AND l.friction >= 4.0)""",
    "agents": """SELECT concat_ws(':', t.cell_id, g.dest, t.step) AS agent, t.cell_id AS curr, g.dest, (t.step * 7) % 360 AS heading, g.dist8 / 8.0::DOUBLE AS g_curr
        FROM traces t JOIN g ON g.cell_id = t.cell_id AND g.dist8 > 0""",
    "cand": """SELECT a.*, v.dst, v.dst_ord, abs((((v.bearing - a.heading + 540.0::DOUBLE) % 360.0) + 360.0) % 360.0 - 180.0) AS angle, c.friction, coalesce(d.score, 0) AS footprints, g.dist8 / 8.0::DOUBLE AS g,
        CASE WHEN c.friction < 1.75 THEN 1.0 WHEN c.friction < 3.25 THEN 0.6 ELSE 0.3 END::DOUBLE AS affordance
        FROM agents a JOIN visb v ON v.src = a.curr JOIN cells c ON c.cell_id = v.dst LEFT JOIN desire d ON d.cell_id = v.dst JOIN g ON g.dest = a.dest AND g.cell_id = v.dst""",
    "cone": "SELECT * FROM (SELECT *, max(CASE WHEN angle <= 60 THEN 1 ELSE 0 END) OVER (PARTITION BY agent) AS any_in FROM cand) WHERE any_in = 0 OR angle <= 60",
    "sc": "SELECT *, affordance + 0.05::DOUBLE * ln(1 + footprints) - 4 * (friction + g - g_curr) - 0.6::DOUBLE * angle / 180.0 AS score FROM cone",
    "soft": "SELECT *, sum(p) OVER (PARTITION BY agent ORDER BY dst_ord) AS cum, sum(p) OVER (PARTITION BY agent) AS total FROM (SELECT *, exp((score - max(score) OVER (PARTITION BY agent)) / 0.5::DOUBLE) AS p FROM sc)",
    "unif": """SELECT agent, ((h * 1664525 + 1013904223) & 4294967295) / 4294967296.0::DOUBLE AS uniform FROM (SELECT agent,
        list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(agent || ':' || curr, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295) AS h FROM (SELECT DISTINCT agent, curr FROM agents))""",
    "state": "SELECT *, CASE WHEN friction >= 999999 THEN 0.0 WHEN friction < 1.75 THEN 1.0 WHEN friction < 3.25 THEN 0.6 ELSE 0.3 END::DOUBLE AS affordance FROM cells",
    "ratio": "SELECT cell_id, score, least(1.0, ln(1 + score) / (SELECT ln(1 + max(score)) FROM desire)) AS ratio FROM desire",
    "export": "SELECT c.cell_id, d.score, c.affordance, c.friction FROM desire d JOIN state c USING (cell_id) WHERE d.score <> 0",
}
_KEYED = {"after_g": "(dest, cell_id, dist8) USING KEY (dest, cell_id)", "g": "(dest, cell_id, dist8) USING KEY (dest, cell_id)", "flood": "(src, dst, hops) USING KEY (src, dst)", "flood_in": "(src, dst, hops) USING KEY (src, dst)"}
_RECURSIVE = {*_KEYED, "detour"}
# what agents see at the default depth
_CTE["visb15"] = _CTE["visb"].replace("FROM vis ", "FROM (SELECT * FROM flood WHERE hops > 0) vis ")
_CTE["cand15"] = _CTE["cand"].replace("visb v", "visb15 v")
_CTE["cone15"] = _CTE["cone"].replace("FROM cand", "FROM cand15")
_CTE["sc15"] = _CTE["sc"].replace("FROM cone", "FROM cand15").replace("SELECT *,", "SELECT agent, curr, dst, dst_ord, angle <= 60 AS inside,")
# the cells once the painted barriers are gone, and their fields
_CTE["after"] = """SELECT c.cell_id, c.q, c.r, c.ord, coalesce(CASE arg_max(e.surface_class, e.draw_order) WHEN 'PAVEMENT' THEN 1.0 WHEN 'HEAVY_GRASS' THEN 4.0 END::DOUBLE, any_value(c.friction)) AS friction
    FROM cells c LEFT JOIN (SELECT * FROM edits WHERE surface_class <> 'IMPASSABLE') e ON c.q BETWEEN e.q0 AND e.q1 AND c.r BETWEEN e.r0 AND e.r1 GROUP BY ALL"""
_CTE["after_edges"] = re.sub(r"(FROM|JOIN) cells", r"\1 after", _CTE["edges"])
_CTE["after_adj"] = _CTE["adj"].replace("FROM edges", "FROM after_edges")
_CTE["after_g"] = re.sub(r"\bg\b(?=[. ]|$)", "after_g", _CTE["g"]).replace("JOIN cells", "JOIN after").replace("JOIN adj", "JOIN after_adj")
# the cells of the features' lines, by the same steps as those of the hops
for _name, _from, _to in (("lerp", "hops", "ways"), ("frac", "lerp", "ways_lerp"), ("cube", "frac", "ways_frac"), ("path", "cube", "ways_cube")):
    _CTE[f"ways_{_name}"] = _CTE[_name].replace(f"FROM {_from}", f"FROM {_to}")
_NEEDS = {k: [n for n in _CTE if n != k and re.search(rf"\b(?:FROM|JOIN|,)\s+{n}\b", v)] for k, v in _CTE.items()}


def _with(*names: str, body: str) -> str:
    """The body after the CTEs that it needs, in order."""
    need: list[str] = []

    def add(n: str) -> None:
        for m in _NEEDS[n]:
            if m not in need:
                add(m)
        if n not in need:
            need.append(n)

    for n in names:
        add(n)
    parts = [f"{n}{_KEYED.get(n, '')} AS ({_CTE[n]})" for n in need]
    return f"WITH {'RECURSIVE ' if any(n in _RECURSIVE for n in need) else ''}{', '.join(parts)} {body}"


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _modulated(cost: str) -> str:
    soft = {"PAVEMENT": "LIGHT_PARK", "LIGHT_PARK": "HEAVY_GRASS"}.get(cost, cost)
    hard = "PAVEMENT" if cost == "LIGHT_PARK" else cost
    return f"CASE WHEN coalesce(surface, '') IN {_in(C.SURFACE_PAVED)} THEN '{hard}' WHEN coalesce(surface, '') IN {_in(C.SURFACE_SOFT)} THEN '{soft}' ELSE '{cost}' END"


_BARRED = "(coalesce(foot, '') IN ('no', 'private') OR coalesce(access, '') IN ('no', 'private'))"
_COST = f"""CASE WHEN coalesce(indoor, '') IN ('1', 'true') THEN 'IMPASSABLE'
 WHEN source_layer = 'transportation' THEN CASE WHEN {_BARRED} OR contains(class, '_construction') OR class IN ('ferry', 'aerialway') THEN 'IMPASSABLE' WHEN class = 'pier' THEN {_modulated('PAVEMENT')}
  WHEN class = 'path' THEN CASE WHEN subclass IN {_in(C.PATH_LIGHT)} THEN {_modulated('LIGHT_PARK')} WHEN subclass = 'steps' THEN {_modulated('HEAVY_GRASS')} ELSE {_modulated('PAVEMENT')} END
  WHEN coalesce(brunnel, '') = 'ford' THEN {_modulated('HEAVY_GRASS')} WHEN class IN {_in(C.ROAD_BARRED)} THEN 'IMPASSABLE' WHEN class IN {_in(C.ROAD_PAVED)} THEN {_modulated('PAVEMENT')}
  WHEN class = 'track' THEN {_modulated('LIGHT_PARK')} WHEN class IN {_in(C.RAIL_CLASSES)} OR coalesce(subclass, '') IN {_in(C.RAIL_SUBCLASSES)} THEN 'IMPASSABLE' ELSE {_modulated('PAVEMENT')} END
 WHEN source_layer = 'landcover' THEN CASE WHEN {_BARRED} OR class IN {_in(C.COVER_BARRED)} OR coalesce(subclass, '') IN {_in(C.COVER_SUB_BARRED)} THEN 'IMPASSABLE' WHEN subclass IN {_in(C.COVER_SUB_HEAVY)} THEN 'HEAVY_GRASS'
  WHEN subclass IN {_in(C.COVER_SUB_LIGHT)} THEN 'LIGHT_PARK' WHEN subclass IN {_in(C.COVER_SUB_FARMED)} OR class IN {_in(C.COVER_HEAVY)} THEN 'HEAVY_GRASS' WHEN class = 'grass' THEN 'LIGHT_PARK' ELSE 'PAVEMENT' END
 WHEN source_layer = 'landuse' THEN CASE WHEN {_BARRED} OR class IN {_in(C.USE_BARRED)} THEN 'IMPASSABLE' WHEN class IN {_in(C.USE_LIGHT)} THEN 'LIGHT_PARK' ELSE 'PAVEMENT' END
 WHEN source_layer IN ('building', 'water', 'aeroway') THEN 'IMPASSABLE' WHEN source_layer = 'waterway' THEN CASE WHEN brunnel = 'tunnel' THEN NULL ELSE 'IMPASSABLE' END WHEN source_layer = 'park' THEN 'LIGHT_PARK' ELSE 'PAVEMENT' END"""
_LAYER0 = "coalesce(CAST(try_cast(regexp_extract(coalesce(layer, ''), '^\\s*([+-]?[0-9]+)', 1) AS BIGINT) AS VARCHAR), '0')"
_LAYER = f"CASE WHEN source_layer = 'transportation' AND {_LAYER0} = '0' AND brunnel = 'bridge' THEN '1' WHEN source_layer = 'transportation' AND {_LAYER0} = '0' AND brunnel = 'tunnel' THEN '-1' ELSE {_LAYER0} END"
_FRICTION = "CASE {} WHEN 'PAVEMENT' THEN 1.0 WHEN 'LIGHT_PARK' THEN 2.5 WHEN 'HEAVY_GRASS' THEN 4.0 WHEN 'IMPASSABLE' THEN 999999.0 END::DOUBLE"
_TIER = "CASE WHEN friction >= 999999 THEN 'impassable' WHEN friction < 1.75 THEN 'pavement' WHEN friction < 3.25 THEN 'light_park' ELSE 'heavy_grass' END"
_AFF = "CASE WHEN {0} >= 999999 THEN 0.0 WHEN {0} < 1.75 THEN 1.0 WHEN {0} < 3.25 THEN 0.6 ELSE 0.3 END::DOUBLE"


_STOP = "CAST(trunc(list_extract([{0}], i + 1) + (list_extract([{0}], least(i + 2, 5)) - list_extract([{0}], i + 1)) * (pos - i)) AS INT)"
_IN_BOX = "x0 <= x AND x < x1 AND y0 <= y AND y < y1"

ORACLE_SQL = {
    "tier_histogram": _with("ground", body=f"SELECT {_TIER} AS tier, {_AFF.format('friction')} AS affordance, count(*) AS n FROM ground GROUP BY 1, 2"),
    "layer_merge": _with("layers", body="SELECT cell_id, layer, friction FROM layers"),
    "ground_friction": _with("ground", body="SELECT cell_id, friction FROM ground"),
    "classify_features": _with("features", body=f"SELECT feature_id, cost, layer, {_FRICTION.format('cost')} AS friction FROM (SELECT feature_id, {_COST} AS cost, {_LAYER} AS layer FROM features) WHERE cost IS NOT NULL"),
    "vertical_layer": _with("features", body=f"SELECT feature_id, {_LAYER} AS vlayer FROM features"),
    "aoi_cells": _with("cells", body=f"SELECT cell_id, q, r FROM (SELECT *, q + r / 2.0::DOUBLE AS x, r * sqrt(3.0::DOUBLE) / 2 AS y FROM cells) WHERE {_crossings(AOI[0])} AND NOT {_crossings(AOI[1])}"),
    "polygon_raster": _with("boxes", body="""SELECT edit_id, CAST(q AS INT) AS q, CAST(r AS INT) AS r FROM (SELECT *, unnest(range(CAST(floor(x0 - r / 2.0) AS INT) - 1, CAST(ceil(x1 - r / 2.0) AS INT) + 2)) AS q FROM
        (SELECT *, unnest(range(CAST(floor(y0 / 0.9) AS INT) - 2, CAST(ceil(y1 / 0.8) AS INT) + 2)) AS r FROM boxes)) WHERE q + r / 2.0::DOUBLE >= x0 AND q + r / 2.0::DOUBLE < x1 AND r * 0.8660254037844386::DOUBLE >= y0 AND r * 0.8660254037844386::DOUBLE < y1"""),
    "fast_scan_area": _with("features", "inside", "shapes", "ways_path", body=f"""SELECT cell_id, vlayer AS layer, CASE WHEN max(f) >= 999999.0 THEN 999999.0 ELSE min(f) END AS friction, bool_or(bool_or(lined)) OVER (PARTITION BY cell_id) AS corridor FROM
        (SELECT feature_id, vlayer, {_FRICTION.format('cost')} AS f, source_layer IN ('transportation', 'waterway') AS is_line FROM (SELECT *, {_COST} AS cost, {_LAYER} AS vlayer FROM features WHERE source_layer IN {_in(C.LAYERS)}) WHERE cost IS NOT NULL) k
        JOIN (SELECT s.feature_id, i.cell_id, false AS lined FROM shapes s JOIN (SELECT *, q + r / 2.0::DOUBLE AS x, 0.8660254037844386::DOUBLE * r AS y FROM inside) i ON s.x0 <= i.x AND i.x < s.x1 AND s.y0 <= i.y AND i.y < s.y1 WHERE NOT s.hole AND NOT EXISTS
              (SELECT 1 FROM shapes h WHERE h.hole AND h.feature_id = s.feature_id AND h.k = s.k AND h.x0 <= i.x AND i.x < h.x1 AND h.y0 <= i.y AND i.y < h.y1)
              UNION ALL SELECT p.step, i.cell_id, true FROM ways_path p JOIN inside i ON i.q = p.q AND i.r = p.r) c ON c.feature_id = k.feature_id AND c.lined = k.is_line GROUP BY cell_id, vlayer"""),
    "line_raster": _with("path", body="SELECT q, r, count(*) AS n FROM path GROUP BY q, r"),
    "grid_distance": _with("hops", body="SELECT step, CAST((abs(q1 - q0) + abs(r1 - r0) + abs(q1 - q0 + r1 - r0)) / 2 AS INT) AS dist FROM hops"),
    "grid_disk": _with("cells", "disk2", body="SELECT a.cell_id, count(*) AS n FROM cells a, disk2 o JOIN cells b ON b.q = a.q + o.dq AND b.r = a.r + o.dr GROUP BY 1"),
    "bbox_filter": _with("boxes", body="SELECT edit_id, round(x0, 6) AS x0, round(y0, 6) AS y0, round(x1, 6) AS x1, round(y1, 6) AS y1, x0 < 5 OR x1 > 40 OR y0 < 0 OR y1 > 20 AS beyond FROM boxes WHERE x0 <= 40 AND x1 >= 5 AND y0 <= 20 AND y1 >= 0"),
    "adjacency": _with("adj", body="SELECT src, dst, w8 FROM adj"),
    "degree_histogram": _with("edges", body="SELECT degree, count(*) AS n FROM (SELECT c.cell_id, count(e.src) AS degree FROM cells c LEFT JOIN edges e ON e.src = c.cell_id GROUP BY 1) GROUP BY 1"),
    "barrier_halo": _with("halo", body="SELECT cell_id, round(friction, 6) AS friction, round(w, 6) AS w FROM halo"),
    "corridor_widen": _with("wide", body="SELECT cell_id, round(friction, 6) AS friction, round(w, 6) AS w FROM wide"),
    "cell_assembly": _with("halo", "wide", body=f"""SELECT cell_id, round(f, 6) AS friction, round(CASE WHEN wp IS NULL THEN b ELSE least(1.0, b + least(1 - b, 0.3::DOUBLE * wp)) END, 6) AS affordance FROM
        (SELECT *, CASE WHEN wb IS NULL THEN a ELSE greatest(0.0, a - least(a, 0.4::DOUBLE * wb)) END AS b FROM (SELECT *, {_AFF.format('f')} AS a FROM
        (SELECT c.cell_id, coalesce(p.friction, h.friction, c.friction, 1.0) AS f, h.w AS wb, p.w AS wp FROM cells c LEFT JOIN halo h USING (cell_id) LEFT JOIN wide p ON p.cell_id = c.cell_id)))"""),
    "surface_edits_effective": _with("cells", "edits", body=f"""SELECT cell_id, f AS friction, {_AFF.format('f')} AS affordance FROM (SELECT c.cell_id, coalesce({_FRICTION.format('arg_max(e.surface_class, e.draw_order)')}, any_value(c.friction)) AS f
        FROM cells c LEFT JOIN edits e ON c.q BETWEEN e.q0 AND e.q1 AND c.r BETWEEN e.r0 AND e.r1 GROUP BY c.cell_id)"""),
    "edit_events": _with("cells", "edits", body="""SELECT cell_id, arg_max(edit_id, draw_order) AS edit_id, arg_max(surface_class, draw_order) AS surface_class FROM cells c
        JOIN (SELECT * FROM edits WHERE surface_class <> 'IMPASSABLE') e ON c.q BETWEEN e.q0 AND e.q1 AND c.r BETWEEN e.r0 AND e.r1 GROUP BY cell_id"""),
    "features_in_box": _with("features", "shapes", "ways", body=f"""SELECT feature_id, source_layer, round(x0, 6) AS x0, round(y0, 6) AS y0, round(x1, 6) AS x1, round(y1, 6) AS y1 FROM features f JOIN
        (SELECT feature_id, x0, y0, x1, y1, false AS is_line FROM shapes WHERE NOT hole UNION ALL SELECT step, least(q0 + r0 / 2.0::DOUBLE, q1 + r1 / 2.0::DOUBLE), least(r0, r1) * 0.8660254037844386::DOUBLE,
         greatest(q0 + r0 / 2.0::DOUBLE, q1 + r1 / 2.0::DOUBLE), greatest(r0, r1) * 0.8660254037844386::DOUBLE, true FROM ways) s USING (feature_id)
        WHERE is_line = (source_layer IN ('transportation', 'waterway')) AND source_layer IN {_in(C.LAYERS)} AND x0 <= 40 AND x1 >= 5 AND y0 <= 20 AND y1 >= 0"""),
    "gradient_field": _with("g", body="SELECT dest, cell_id, CAST(dist8 AS INT) AS dist8 FROM g"),
    "gradient_reach": _with("g", body="SELECT dest, count(*) AS reached, CAST(max(dist8) AS INT) AS max_dist8, CAST(sum(dist8) AS BIGINT) AS sum_dist8 FROM g GROUP BY dest"),
    "field_repair": _with("after_g", body="SELECT dest, cell_id, CAST(dist8 AS INT) AS dist8 FROM after_g"),
    "unreachable_dests": _with("g", body="SELECT dest FROM dests WHERE dest NOT IN (SELECT dest FROM g GROUP BY dest HAVING count(*) > 1)"),
    "initial_heading": _with("g", "edges", body="""SELECT dest, cell_id, CAST(floor((degrees(atan2((q1 - q0) + (r1 - r0) / 2.0, 0.8660254037844386::DOUBLE * (r1 - r0))) + 360.0) % 360.0 + 0.5) AS INT) AS heading FROM
        (SELECT g.dest, g.cell_id, e.*, row_number() OVER (PARTITION BY g.dest, g.cell_id ORDER BY n.dist8, e.dst_ord) AS k FROM g JOIN edges e ON e.src = g.cell_id AND f0 < 999999 AND f1 < 999999 JOIN g n ON n.dest = g.dest AND n.cell_id = e.dst WHERE n.dist8 < g.dist8) WHERE k = 1"""),
    "visibility_k2": _with("visb", body="SELECT src, dst, hops, bearing FROM visb"),
    "visibility_k15": _with("flood", "cells", body="""SELECT src, dst, hops, CAST(floor((degrees(atan2((b.q - a.q) + (b.r - a.r) / 2.0, 0.8660254037844386::DOUBLE * (b.r - a.r))) + 360.0) % 360.0 + 0.5) AS INT) AS bearing
        FROM flood JOIN cells a ON a.cell_id = src JOIN cells b ON b.cell_id = dst WHERE hops > 0"""),
    "line_of_sight": _with("hops", "clear", "inside", "flood_in", body="""SELECT step, prev AS src, h.cell_id AS dst, CASE WHEN i.cell_id IS NULL THEN clear ELSE f.hops IS NOT NULL END AS visible FROM hops h JOIN clear USING (step)
        LEFT JOIN inside i ON i.cell_id = h.prev LEFT JOIN flood_in f ON f.src = h.prev AND f.dst = h.cell_id AND f.hops > 0"""),
    "step_lines": _with("steps", "detour", "lerp", "cube", body="""SELECT step, CASE WHEN clear THEN 'straight' WHEN n > 0 THEN 'detour' ELSE 'stay' END AS how, CASE WHEN clear THEN s.n_cells WHEN n > 0 THEN d.n_cells ELSE 1 END AS n_cells,
        CASE WHEN clear THEN s.way WHEN n > 0 THEN d.way ELSE q0 || ':' || r0 END AS way FROM steps
        LEFT JOIN (SELECT step, count(*) AS n_cells, CASE WHEN any_value(aq = q0 AND ar = r0) THEN string_agg(w, ' ' ORDER BY i) ELSE string_agg(w, ' ' ORDER BY i DESC) END AS way FROM
            (SELECT step, q0, r0, aq, ar, i, CAST(CASE WHEN abs(iq - fq) > abs(ir - fr) AND abs(iq - fq) > abs(is_ - fs) THEN -ir - is_ ELSE iq END AS INT) || ':' || CAST(CASE WHEN NOT (abs(iq - fq) > abs(ir - fr) AND abs(iq - fq) > abs(is_ - fs)) AND abs(ir - fr) > abs(is_ - fs) THEN -iq - is_ ELSE ir END AS INT) AS w
             FROM (SELECT *, -fq - fr AS fs, floor(fq + 0.5) AS iq, floor(fr + 0.5) AS ir, floor(-fq - fr + 0.5) AS is_ FROM (SELECT *, aq + (bq - aq) * t + 0.000001::DOUBLE AS fq, ar + (br - ar) * t + 0.000002::DOUBLE AS fr FROM lerp))) GROUP BY step) s USING (step)
        LEFT JOIN (SELECT step, count(*) AS n_cells, string_agg(q || ':' || r, ' ' ORDER BY i) AS way FROM detour JOIN cells c ON c.cell_id = here GROUP BY step) d USING (step)"""),
    "bearing_pairs": _with("bear", body="SELECT step, round(bearing, 6) AS bearing FROM bear WHERE prev <> cell_id"),
    "angle_diff": _with("bear", body="SELECT step, round(abs((bearing - step % 360 + 540.0) % 360.0 - 180.0), 6) AS diff FROM bear WHERE prev <> cell_id"),
    "od_matrix": _with("od", body="SELECT origin, dest, grid_dist FROM od"),
    "reachable_od": _with("pairs", body="SELECT origin, dest, weight, CAST(dist8 AS INT) AS dist8 FROM pairs"),
    "apportionment": _with("plan", body="SELECT origin, dest, weight, total_volume, assigned FROM plan"),
    "wave_split": _with("plan", body="SELECT wave, origin, dest, agents FROM (SELECT CAST(w AS INT) AS wave, origin, dest, CAST(assigned // 3 + CASE WHEN w < assigned % 3 THEN 1 ELSE 0 END AS INT) AS agents FROM plan, range(3) t(w)) WHERE agents > 0"),
    "wave_count": _with("plan", body="""SELECT unit, CAST(CASE WHEN n <= 1 THEN 1 ELSE greatest(1, least(16, ceil(n / least(n, greatest(1, floor(400 / unit + 0.5)))))) END AS INT) AS waves
        FROM (SELECT max(assigned) AS n FROM plan), (VALUES (25.0::DOUBLE), (50.0::DOUBLE), (100.0::DOUBLE), (250.0::DOUBLE), (500.0::DOUBLE)) t(unit)"""),
    "max_ticks": _with("od", body="SELECT origin, dest, CAST(least(5000, greatest(64, 8 * grid_dist + 32), 2 * ceil(sqrt((SELECT count(*) FROM cells) * pi()))) AS INT) AS ticks FROM od"),
    "best_step_t0": _with("sc", body="SELECT agent, arg_max(dst, row(round(score, 9), -dst)) AS next, round(max(round(score, 9)), 6) AS score FROM sc GROUP BY agent"),
    "best_step_k15": _with("sc15", body="SELECT agent, coalesce(arg_max(dst, row(round(score, 9), -dst)) FILTER (inside), arg_max(dst, row(round(score, 9), -dst))) AS next FROM sc15 GROUP BY agent"),
    "softmax_step": _with("soft", "unif", body="SELECT agent, coalesce(arg_min(dst, dst_ord) FILTER (uniform * total <= cum), arg_max(dst, dst_ord)) AS next, round(max(uniform), 6) AS uniform FROM soft JOIN unif USING (agent) GROUP BY agent"),
    "rule_steps": _with("cone15", body="SELECT agent, arg_min(dst, row(g, dst)) AS basic, arg_min(dst, row(friction + g, dst)) AS path FROM cone15 GROUP BY agent"),
    "desire_counts": _with("desire", body="SELECT cell_id, score FROM desire"),
    "contrib_by_dest": _with("traces", body="SELECT kind, cell_id, count(*) AS n FROM traces GROUP BY kind, cell_id"),
    "desire_grouping_sets": _with("traces", body="SELECT kind, cell_id, count(*) AS n FROM traces GROUP BY GROUPING SETS ((cell_id), (kind, cell_id))"),
    "wear_update": _with("state", "desire", body="""SELECT cell_id, round(CASE WHEN friction IN (1.0, 999999.0) OR score IS NULL THEN affordance ELSE least(0.85::DOUBLE, affordance + score * 0.005::DOUBLE / (100.0::DOUBLE * CASE WHEN friction = 4.0 THEN 1.5 ELSE 0.8 END)) END, 9) AS affordance
        FROM state LEFT JOIN desire USING (cell_id)"""),
    "decay_update": _with("state", body="SELECT cell_id, round(CASE WHEN friction IN (1.0, 999999.0) THEN affordance ELSE greatest(0.1::DOUBLE, affordance * exp(-0.001::DOUBLE * CASE WHEN friction = 4.0 THEN 0.5 ELSE 1.5 END)) END, 6) AS affordance FROM state"),
    "flow_ratio": _with("ratio", body="SELECT cell_id, score, round(ratio, 6) AS ratio FROM ratio"),
    "colour_ramp": _with("ratio", body=f"""SELECT cell_id, {_STOP.format('235, 198, 156, 129, 77')} AS red, {_STOP.format('210, 153, 95, 15, 0')} AS green, {_STOP.format('236, 201, 160, 124, 73')} AS blue, CAST(trunc(140 + 115 * ratio) AS INT) AS alpha
        FROM (SELECT *, CAST(floor(pos) AS INT) AS i FROM (SELECT *, ratio * 4 AS pos FROM (SELECT cell_id, round(ratio, 9) AS ratio FROM ratio)))"""),
    "friction_colours": _with("cells", body="""SELECT cell_id, CASE WHEN friction >= 999999 THEN 231 WHEN friction = 4.0 THEN 39 WHEN friction = 2.5 THEN 166 ELSE 0 END AS red, CASE WHEN friction >= 999999 THEN 76 WHEN friction = 4.0 THEN 174 WHEN friction = 2.5 THEN 216 ELSE 150 END AS green,
        CASE WHEN friction >= 999999 THEN 60 WHEN friction = 4.0 THEN 96 WHEN friction = 2.5 THEN 84 ELSE 255 END AS blue, CASE WHEN friction >= 999999 THEN 160 WHEN friction = 4.0 THEN 120 WHEN friction = 2.5 THEN 90 ELSE 25 END AS alpha FROM cells"""),
    "peak_flow": _with("desire", body="SELECT coalesce(max(score), 1) AS peak, coalesce(max(score), 1) AS readout FROM desire"),
    "geojson_rows": _with("export", body="SELECT cell_id, score, affordance, friction FROM export"),
    "geojson_round_trip": _with("export", "cells", body="SELECT e.cell_id, q, r, score, affordance, e.friction FROM export e JOIN cells c USING (cell_id)"),
    "tooltips": _with("export", body="SELECT cell_id, score AS flow, printf('%.2f', affordance) AS affordance, CASE WHEN friction >= 999999 THEN 'Impassable' WHEN friction < 1.75 THEN 'Pavement' WHEN friction < 3.25 THEN 'Light park' ELSE 'Heavy grass' END AS type, friction FROM export"),
    "hex_boundary": _with("cells", body="SELECT cell_id, CAST(i AS INT) AS corner, round(q + r / 2.0::DOUBLE + cos(radians(60.0 * i + 30.0)) / sqrt(3.0::DOUBLE), 6) + 0.0::DOUBLE AS x, round(r * sqrt(3.0::DOUBLE) / 2 + sin(radians(60.0 * i + 30.0)) / sqrt(3.0::DOUBLE), 6) + 0.0::DOUBLE AS y FROM cells, range(6) t(i)"),
    "node_readiness": _with("nodes", body="SELECT count(*) AS n_active, count(*) >= 2 AND bool_or(type <> 'destination') AND bool_or(type <> 'origin') AS has_build_inputs, bool_or(type <> 'destination') AND bool_or(type <> 'origin') AS is_ready FROM nodes WHERE weight > 0"),
    "node_counts": _with("nodes", body="SELECT count(*) FILTER (type <> 'destination') AS n_origins, count(*) FILTER (type <> 'origin') AS n_destinations FROM nodes"),
    "placement_check": _with("features", body=f"""SELECT place_id, coalesce(coalesce(max(f) FILTER (vlayer = '0'), min(f)) < 999999, true) AS accessible FROM (SELECT DISTINCT CAST(floor(feature_id / 3.0) AS BIGINT) AS place_id FROM features) LEFT JOIN
        (SELECT CAST(floor(feature_id / 3.0) AS BIGINT) AS place_id, vlayer, max({_FRICTION.format('cost')}) AS f FROM (SELECT *, {_COST} AS cost, {_LAYER} AS vlayer FROM features WHERE source_layer IN ('transportation', 'building', 'water', 'landcover', 'landuse')) WHERE cost IS NOT NULL GROUP BY 1, 2)
        USING (place_id) GROUP BY place_id"""),
    "pick_polygon": _with("cells", "boxes", body=f"SELECT point_id, arg_max(edit_id, draw_order) AS edit_id FROM (SELECT cell_id AS point_id, q + r / 2.0::DOUBLE AS x, r * sqrt(3.0::DOUBLE) / 2 AS y FROM cells) p JOIN boxes b ON {_IN_BOX} GROUP BY point_id"),
    "aoi_circle": _with("nodes", "cells", body="""SELECT CAST(i AS INT) AS corner, round(mx + rad * cos((i % 32) * (2 * pi() / 32)), 6) AS x, round(my + rad * sin((i % 32) * (2 * pi() / 32)), 6) AS y FROM
        (SELECT mx, my, max(sqrt((x - mx) ** 2 + (y - my) ** 2)) + 128.0 AS rad FROM p, (SELECT avg(x) AS mx, avg(y) AS my FROM p) GROUP BY 1, 2), range(33) t(i)""").replace(" SELECT CAST(i", ", p AS (SELECT c.q + c.r / 2.0::DOUBLE AS x, c.r * sqrt(3.0::DOUBLE) / 2 AS y FROM nodes n JOIN cells c USING (cell_id)) SELECT CAST(i", 1),
    "mdd": _with("g", "traces", body="""SELECT dest, round(avg(abs(d - least_)), 6) AS mdd FROM (SELECT dest, walk_id, dist8 / 8.0::DOUBLE AS d, min(dist8 / 8.0::DOUBLE) OVER (PARTITION BY dest, walk_id) AS least_
        FROM (SELECT n.dest, t.user_id AS walk_id, t.cell_id FROM traces t JOIN (SELECT dest, row_number() OVER (ORDER BY dest) - 1 AS k FROM dests) n ON n.k = t.user_id % 16) s JOIN g USING (dest, cell_id)) GROUP BY dest"""),
    "sum_of_paths": _with("desire", body="SELECT CAST(threshold AS INT) AS threshold, count(*) FILTER (score > threshold) AS n_cells FROM desire, (VALUES (0), (1), (2), (5), (10)) t(threshold) GROUP BY 1"),
    "accuracy_k": _with("traces", "cells", "disk2", body="""SELECT count(*) AS n_steps, count(n.cell_id) AS n_near, round(count(n.cell_id) / greatest(count(*), 1), 6) AS accuracy FROM (SELECT cell_id FROM traces WHERE kind <> 'purchase') s LEFT JOIN
        (SELECT DISTINCT b.cell_id FROM (SELECT DISTINCT cell_id FROM traces WHERE kind = 'purchase') t JOIN cells a USING (cell_id), disk2 o JOIN cells b ON b.q = a.q + o.dq AND b.r = a.r + o.dr) n USING (cell_id)"""),
    "latency_percentiles": "SELECT event_type, count(*) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, max(value) AS max FROM events GROUP BY event_type",
    "trace_windows": _with("traces", body="SELECT CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS start, kind, count(*) AS n FROM traces GROUP BY 1, 2"),
}
