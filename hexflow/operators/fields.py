"""Shortest-path fields by levels: within tiles of the grid, within squares of tiles, of squares, and so on.

The area is cut into square tiles of the axial grid.  Each tile's own task finds the distances between its border cells, those
with a passable neighbour in another tile, over paths that stay inside.  ``GROUP`` by ``GROUP`` tiles make a square, whose border cells'
distances follow from the tiles' matrices, and squares make larger ones, while none has more than ``BORDER`` border cells.  A
destination's field climbs to the border of its squares, spreads between the largest ones in rounds, and comes down again level
by level, each square in its own task; at last each tile fills in its inner cells from its border.  A long, narrow area is one square in the
end and needs no round; a wide one has as many as a path crosses squares of squares.  Nothing of the area passes
through the driver, and a task holds one square of nodes for ``BLOCK`` destinations.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexflow.functions import grid
from hexflow.params import IMPASSABLE, WEIGHT_SCALE
from hexflow.sources.shared import Steps

#: Cells along a tile's edge, nodes along a square's, destinations of a task, border cells of the largest square.
SIDE, GROUP, BLOCK, BORDER = 32, 4, 256, 640
FAR = np.int64(1) << 60
TILE = ["tq", "tr"]


def weight8(friction="friction"):
    return F.floor(WEIGHT_SCALE * F.col(friction) + 0.5).cast("int")


def tiled(cells: DataFrame, side: int) -> DataFrame:
    """The passable cells with their tile and their place in it."""
    out = cells.where(F.col("friction") < IMPASSABLE).select("cell_id", "q", "r", weight8().alias("w8"))
    place = (F.pmod("q", F.lit(side)) * side + F.pmod("r", F.lit(side))).cast("int")
    return out.withColumns({"tq": F.floor(F.col("q") / side).cast("int"), "tr": F.floor(F.col("r") / side).cast("int"), "at": place})


def crossings(tiled_cells: DataFrame, side: int) -> DataFrame:
    """Steps from one tile into another: tq, tr, at, tq2, tr2, at2 and what entering there costs.  Only cells on tiles' edges are joined."""
    edge = lambda c: F.pmod(c, F.lit(side)).isin(0, side - 1)
    rim = tiled_cells.where(edge("q") | edge("r"))
    step = F.explode(grid.offsets(grid.NEIGHBOURS)).alias("o")
    out = rim.select(*TILE, "at", "q", "r", step).select(*TILE, "at", (F.col("q") + F.col("o.dq")).alias("q"), (F.col("r") + F.col("o.dr")).alias("r"))
    into = rim.select("q", "r", F.col("tq").alias("tq2"), F.col("tr").alias("tr2"), F.col("at").alias("at2"), F.col("w8").alias("w2"))
    outside = (F.floor(F.col("q") / side) != F.col("tq")) | (F.floor(F.col("r") / side) != F.col("tr"))
    return out.where(outside).join(into, ["q", "r"]).drop("q", "r")


def frame(at: np.ndarray, w8: np.ndarray, side: int) -> np.ndarray:
    """A tile's weights as an array with a rim around, FAR where no passable cell is."""
    w = np.full((side + 2, side + 2), FAR)
    w[at // side + 1, at % side + 1] = w8
    return w


def relax(w: np.ndarray, dist: np.ndarray) -> np.ndarray:
    """Distances (fields, side + 2, side + 2) once no step within the tile shortens any: entering a cell costs its weight."""
    own = w[1:-1, 1:-1]
    inner = dist[:, 1:-1, 1:-1]
    live = np.arange(len(dist))
    side = own.shape[0]
    while len(live):
        d = dist[live]
        near = d[:, 2:, 1:-1].copy()
        for dq, dr in grid.NEIGHBOURS[1:]:
            np.minimum(near, d[:, 1 + dq : 1 + dq + side, 1 + dr : 1 + dr + side], out=near)
        near += own
        better = near < d[:, 1:-1, 1:-1]
        moved = better.any(axis=(1, 2))
        live = live[moved]
        inner[live] = np.where(better[moved], near[moved], d[moved][:, 1:-1, 1:-1])
    return dist


def plans(tiled_cells: DataFrame, side: int) -> DataFrame:
    """A row a tile: its cells (at, w8, ids), its border's codes, the matrix of distances between border cells, and the steps out of it (x_...)."""
    cells = tiled_cells.groupBy(*TILE).agg(F.sort_array(F.collect_list(F.struct("at", "w8", "cell_id"))).alias("c"))  # side squared at most
    cell = lambda at, tq, tr: code_of((F.col(tq) * side + F.floor(F.col(at) / side)).cast("long"), (F.col(tr) * side + F.col(at) % side).cast("long"))
    step = F.struct(cell("at", "tq", "tr").alias("x_from"), cell("at2", "tq2", "tr2").alias("x_to"), F.col("w2").cast("long").alias("x_w"))
    cross = crossings(tiled_cells, side).groupBy(*TILE).agg(F.sort_array(F.collect_list(step)).alias("x"))
    names = {"at": "c.at", "w8": "c.w8", "ids": "c.cell_id", "x_from": "x.x_from", "x_to": "x.x_to", "x_w": "x.x_w"}
    rows = cells.join(cross, TILE, "left").select(*TILE, *[F.coalesce(F.col(c), F.array()).alias(n) for n, c in names.items()])

    def matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in range(len(batch)):
                row = batch.iloc[k : k + 1].copy()
                codes = np.unique(np.asarray(row.x_from.iloc[0], dtype=np.int64))
                q, r = (codes >> 31) - (1 << 30) - row.tq.iloc[0] * side + 1, (codes & ((1 << 31) - 1)) - (1 << 30) - row.tr.iloc[0] * side + 1
                dist = np.full((len(codes), side + 2, side + 2), FAR)
                dist[np.arange(len(codes)), q, r] = 0
                relax(frame(row["at"].iloc[0], row.w8.iloc[0], side), dist)
                row["border"] = [codes]
                row["matrix"] = [np.minimum(dist[:, q, r], FAR).tobytes()]
                yield row

    types = "tq int, tr int, at array<int>, w8 array<int>, ids array<long>, x_from array<long>, x_to array<long>, x_w array<long>"
    return rows.mapInPandas(matrices, f"{types}, border array<long>, matrix binary")


class Node:
    """A tile, or a square of nodes, within a task: its border cells' codes, the distances between them, and the steps out of it."""

    def __init__(self, row):
        self.border = np.asarray(row.border)
        n = len(self.border)
        self.matrix = np.frombuffer(row.matrix, dtype=np.int64).reshape(n, n)
        self.x_from, self.x_to, self.x_w = np.asarray(row.x_from, dtype=np.int64), np.asarray(row.x_to, dtype=np.int64), np.asarray(row.x_w, dtype=np.int64)

    def slots(self, codes) -> np.ndarray:
        return np.searchsorted(self.border, codes)


def code_of(q, r):
    """One long for a cell; works on columns and on arrays."""
    return (q + (1 << 30)) * (1 << 31) + (r + (1 << 30))


def places_of(codes: np.ndarray, unit: int) -> tuple[np.ndarray, np.ndarray]:
    """The squares of ``unit`` cells that hold the cells."""
    codes = np.asarray(codes, dtype=np.int64)
    return ((codes >> 31) - (1 << 30)) // unit, ((codes & ((1 << 31) - 1)) - (1 << 30)) // unit


def at_rest(nodes: dict[tuple[int, int], Node], unit: int, fields: dict, pending: dict) -> dict:
    """The nodes' border distances (fields, border) once none of what is ``pending`` shortens any; which ones changed comes back."""
    links = {}
    for t, x in nodes.items():
        to = list(zip(*(p.tolist() for p in places_of(x.x_to, unit)), strict=True))
        own = links[t] = []
        for other in sorted({o for o in to if o in nodes}):
            k = np.flatnonzero([o == other for o in to])
            own.append((other, x.slots(x.x_from[k]), nodes[other].slots(x.x_to[k]), x.x_w[k]))
    changed = {t: np.zeros(f.shape, dtype=bool) for t, f in fields.items()}
    while pending:
        t = next(iter(pending))
        came, own, node = pending.pop(t), fields[t], nodes[t]
        better = came < own
        if not better.any():
            continue
        came = np.where(better, came, FAR)
        new = own.copy()
        for s in np.flatnonzero(better.any(axis=0)):
            np.minimum(new, came[:, s, None] + node.matrix[s], out=new)
        less = new < own
        fields[t] = new
        changed[t] |= less
        for other, start, end, w in links[t]:
            sent = np.where(less[:, start], new[:, start] + w, FAR)
            if (sent < FAR).any():
                into = pending.setdefault(other, np.full_like(fields[other], FAR))
                np.minimum.at(into.T, end, sent.T)
    return changed


def _nodes(right: pd.DataFrame) -> dict[tuple[int, int], Node]:
    return {(r.nq, r.nr): Node(r) for r in right.itertuples()}


def _dealt(nodes: dict, unit: int, rows, dests: np.ndarray) -> dict:
    """Distances of some cells (dest, codes, dist) as what is pending at the nodes that hold them."""
    pending: dict = {}
    for r in rows:
        codes, dist = np.asarray(r.codes, dtype=np.int64), np.asarray(r.dist, dtype=np.int64)
        nq, nr = places_of(codes, unit)
        for t in sorted(set(zip(nq.tolist(), nr.tolist(), strict=True))):
            own = (nq == t[0]) & (nr == t[1])
            into = pending.setdefault(t, np.full((len(dests), len(nodes[t].border)), FAR))
            np.minimum.at(into[np.searchsorted(dests, r.dest)], nodes[t].slots(codes[own]), dist[own])
    return pending


def squared(pdf: pd.DataFrame, unit: int, factor: int) -> pd.DataFrame:
    """Nodes (a square of them) as one node: its border cells are those with steps out of the square."""
    nodes = _nodes(pdf)
    up = (pdf.nq.iloc[0] // factor, pdf.nr.iloc[0] // factor)
    x = [np.concatenate([getattr(n, c) for n in nodes.values()]) for c in ("x_from", "x_to", "x_w")]
    out = np.logical_or(*(p != u for p, u in zip(places_of(x[1], unit * factor), up, strict=True))) if len(x[1]) else np.zeros(0, dtype=bool)
    x = [c[out] for c in x]
    border = np.unique(x[0])
    fields = {t: np.full((len(border), len(n.border)), FAR) for t, n in nodes.items()}
    nq, nr = places_of(border, unit)
    pending: dict = {}
    for i, t in enumerate(zip(nq.tolist(), nr.tolist(), strict=True)):
        pending.setdefault(t, np.full_like(fields[t], FAR))[i, nodes[t].slots(border[i])] = 0
    at_rest(nodes, unit, fields, pending)
    matrix = np.full((len(border), len(border)), FAR)
    for t in set(zip(nq.tolist(), nr.tolist(), strict=True)):
        own = (nq == t[0]) & (nr == t[1])
        matrix[:, own] = fields[t][:, nodes[t].slots(border[own])]
    return pd.DataFrame({"nq": [up[0]], "nr": [up[1]], "border": [border], "matrix": [matrix.tobytes()], "x_from": [x[0]], "x_to": [x[1]], "x_w": [x[2]]})


def raised(left: pd.DataFrame, right: pd.DataFrame, unit: int, factor: int) -> pd.DataFrame:
    """What destinations are from the border of their node, as what they are from the border of the square around."""
    names = ["nq", "nr", "dest", "codes", "dist"]
    nodes, dests = _nodes(right), np.unique(left.dest)
    if not nodes or not len(dests):
        return pd.DataFrame(columns=names)
    up = (right.nq.iloc[0] // factor, right.nr.iloc[0] // factor)
    fields = {t: np.full((len(dests), len(n.border)), FAR) for t, n in nodes.items()}
    at_rest(nodes, unit, fields, _dealt(nodes, unit, left.itertuples(), dests))
    codes, dist = [], []
    for t, n in nodes.items():
        x = np.unique(n.x_from[np.logical_or(*(p != u for p, u in zip(places_of(n.x_to, unit * factor), up, strict=True)))]) if len(n.x_to) else n.x_from
        codes.append(x)
        dist.append(fields[t][:, n.slots(x)])
    codes, dist = np.concatenate(codes), np.concatenate(dist, axis=1)
    return pd.DataFrame([(*up, d, codes[dist[i] < FAR], dist[i][dist[i] < FAR]) for i, d in enumerate(dests)], columns=names)


def lowered(left: pd.DataFrame, right: pd.DataFrame, unit: int) -> pd.DataFrame:
    """From the right distances on a square's border, and those of its own destinations within it, the right ones on its nodes' borders."""
    names = ["nq", "nr", "dest", "codes", "dist"]
    nodes, dests = _nodes(right), np.unique(left.dest)
    if not nodes or not len(dests):
        return pd.DataFrame(columns=names)
    fields = {t: np.full((len(dests), len(n.border)), FAR) for t, n in nodes.items()}
    at_rest(nodes, unit, fields, _dealt(nodes, unit, left.itertuples(), dests))
    out = []
    for t, f in fields.items():
        for i in np.flatnonzero((f < FAR).any(axis=1)):
            k = f[i] < FAR
            out.append((*t, dests[i], nodes[t].border[k], f[i][k]))
    return pd.DataFrame(out, columns=names)


def settle(left: pd.DataFrame, right: pd.DataFrame, unit: int) -> pd.DataFrame:
    """One round in one group of nodes: borders at rest again, and what goes to nodes of other groups.

    ``left`` has arrivals (a code and its distance) and the borders so far (``held``); ``right`` the group's nodes.
    """
    names = ["nq", "nr", "dest", "codes", "dist", "s_code", "s_dist"]
    nodes, dests = _nodes(right), np.unique(left.dest)
    if not nodes or not len(dests):
        return pd.DataFrame(columns=names)
    fields = {t: np.full((len(dests), len(x.border)), FAR) for t, x in nodes.items()}
    for r in left[left.held].itertuples():
        x = nodes[r.nq, r.nr]
        fields[r.nq, r.nr][np.searchsorted(dests, r.dest), x.slots(np.asarray(r.codes))] = np.asarray(r.dist)
    changed = at_rest(nodes, unit, fields, _dealt(nodes, unit, left[~left.held].itertuples(), dests))
    out = []
    for t, c in changed.items():
        x = nodes[t]
        leaves = np.array([o not in nodes for o in zip(*(p.tolist() for p in places_of(x.x_to, unit)), strict=True)], dtype=bool)
        slots = x.slots(x.x_from)
        for i in np.flatnonzero(c.any(axis=1)):
            k, known = np.flatnonzero(leaves & c[i, slots]), fields[t][i] < FAR
            out.append((*t, dests[i], x.border[known], fields[t][i][known], x.x_to[k], fields[t][i, slots[k]] + x.x_w[k]))
    return pd.DataFrame(out, columns=names)


def _window(rows: pd.DataFrame, dests: np.ndarray, tile, side: int) -> np.ndarray:
    """Distances of a tile's cells with what is known on its border and at destinations inside."""
    dist = np.full((len(dests), side + 2, side + 2), FAR)
    for r in rows.itertuples():
        own = dist[np.searchsorted(dests, r.dest)]
        if r.codes is not None:
            codes = np.asarray(r.codes, dtype=np.int64)
            own[(codes >> 31) - (1 << 30) - tile.tq * side + 1, (codes & ((1 << 31) - 1)) - (1 << 30) - tile.tr * side + 1] = r.dist
        else:
            own[int(r.at) // side + 1, int(r.at) % side + 1] = 0
    return dist


def gradient(cells: DataFrame, dests: DataFrame, side: int = SIDE, group: int = GROUP, at: DataFrame | None = None) -> DataFrame:
    """``dest, cell_id, dist8`` of the cells that reach each passable destination (column ``dest``): in eighths, what the cells after the destination cost.

    The result is a written table.  Null or repeated destinations, and those outside the area, count once or not at all.  With ``at`` (cell_id),
    only these cells' distances: the field climbs and spreads over the whole area, but comes down to the squares and tiles that hold them alone.
    """
    spark = cells.sparkSession
    steps = Steps(spark)
    inside = steps.keep(tiled(cells, side))
    tiles = steps.keep(plans(inside, side))
    n = dests.select("dest").distinct().count()
    block = F.pmod(F.xxhash64("dest"), F.lit(-(-n // BLOCK) or 1)).cast("int").alias("block")
    starts = steps.keep(dests.select("dest").distinct().join(inside.select(F.col("cell_id").alias("dest"), *TILE, "at"), "dest").withColumn("block", block))
    known = "nq int, nr int, dest long, codes array<long>, dist array<long>"
    only = None if at is None else at.select("cell_id").distinct()
    asked_tiles = None if at is None else steps.keep(inside.join(only, "cell_id", "left_semi").select(*TILE).distinct())

    def asked(rows: DataFrame, q: str, r: str, by: int) -> DataFrame:
        """The rows of squares of ``by`` by ``by`` tiles that hold a cell of ``at``."""
        if asked_tiles is None:
            return rows
        return rows.join(asked_tiles.select(*[F.floor(F.col(c) / by).cast("int").alias(n) for c, n in zip(TILE, (q, r), strict=True)]).distinct(), [q, r], "left_semi")

    def leave(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """From destinations to the border of their tile."""
        tile, d = next(right.itertuples()), np.unique(left.dest)
        dist = relax(frame(tile.at, tile.w8, side), _window(left.assign(codes=None), d, tile, side))
        codes = np.asarray(tile.border, dtype=np.int64)
        q, r = (codes >> 31) - (1 << 30) - tile.tq * side, (codes & ((1 << 31) - 1)) - (1 << 30) - tile.tr * side
        reached = dist[:, q + 1, r + 1]
        return pd.DataFrame([(tile.tq, tile.tr, x, codes[reached[i] < FAR], reached[i][reached[i] < FAR]) for i, x in enumerate(d)], columns=["nq", "nr", "dest", "codes", "dist"])

    with_block = lambda keys: tiles.join(keys.select(*TILE, F.col("block").alias("block")).distinct(), TILE)
    own = steps.keep(starts.groupBy(*TILE, "block").cogroup(with_block(starts).groupBy(*TILE, "block")).applyInPandas(leave, known))
    square = lambda by: [F.floor(F.col(c) / by).cast("int").alias(f"g{c[1]}") for c in ("nq", "nr")]
    grouped = ("gq", "gr", "block")

    def within(level: DataFrame, rows: DataFrame, by: int, kernel, types: str) -> DataFrame:
        """A step in each square of nodes, for a block of destinations; ``rows`` have gq, gr and block."""
        wanted = rows.select("gq", "gr", F.col("block").alias("block")).distinct()
        return rows.groupBy(*grouped).cogroup(level.select(*square(by), "*").join(wanted, ["gq", "gr"]).groupBy(*grouped)).applyInPandas(kernel, types)

    levels, owns, unit = [tiles.select(F.col("tq").alias("nq"), F.col("tr").alias("nr"), "border", "matrix", "x_from", "x_to", "x_w")], [own], side
    while group > 1:
        last = levels[-1]
        out = F.size(F.array_distinct(F.transform(F.filter(F.arrays_zip("x_from", "x_to"), lambda x: (_place(x["x_to"], unit * group)[0] != F.col("gq")) | (_place(x["x_to"], unit * group)[1] != F.col("gr"))), lambda x: x["x_from"])))
        wide = last.select(*square(group), "*").select("gq", "gr", out.alias("n")).groupBy("gq", "gr").agg(F.sum("n").alias("n"), F.count("*").alias("k")).agg(F.max("n"), F.max("k")).first()
        if (wide[1] or 1) == 1 or wide[0] > BORDER:  # nothing to put together, or too much
            break
        levels.append(steps.keep(last.groupBy(*square(group)).applyInPandas((lambda u: lambda pdf: squared(pdf, u, group))(unit), "nq int, nr int, border array<long>, matrix binary, x_from array<long>, x_to array<long>, x_w array<long>")))
        owns.append(steps.keep(within(last, owns[-1].select(*square(group), block, "dest", "codes", "dist"), group, partial(raised, unit=unit, factor=group), known)))
        unit *= group

    # between the nodes of the last level: rounds, as far as there are steps between them
    level, rounds = levels[-1], []
    inbox, state = owns[-1].where(F.size("codes") > 0), owns[-1].limit(0)
    held = lambda df, flag: df.select(*square(group), block, "nq", "nr", "dest", "codes", "dist", F.lit(flag).alias("held"))
    while not inbox.isEmpty():
        came = held(inbox, False)
        left = came if not rounds else came.union(held(state, True).join(came.select("gq", "gr", "dest").distinct(), ["gq", "gr", "dest"], "left_semi").select(*came.columns))
        moved = within(level, left, group, partial(settle, unit=unit), f"{known}, s_code array<long>, s_dist array<long>")
        rounds.append(steps.keep(moved.withColumn("round", F.lit(len(rounds)))))
        sent = rounds[-1].select("dest", F.explode(F.arrays_zip("s_code", "s_dist")).alias("s")).groupBy("dest", F.col("s.s_code").alias("c")).agg(F.min("s.s_dist").alias("d"))
        at = _place(F.col("c"), unit)
        inbox = sent.groupBy(at[0].cast("int").alias("nq"), at[1].cast("int").alias("nr"), "dest").agg(F.collect_list("c").alias("codes"), F.collect_list("d").alias("dist"))
        inbox = inbox.select("nq", "nr", "dest", F.col("codes"), F.col("dist"))
        state = steps.together(rounds).groupBy("nq", "nr", "dest").agg(F.max_by(F.struct("codes", "dist"), "round").alias("s")).select("nq", "nr", "dest", "s.codes", "s.dist")

    # and back down to the tiles
    for k in range(len(levels) - 2, -1, -1):
        unit //= group
        parts = state.select(F.col("nq").alias("gq"), F.col("nr").alias("gr"), block, "dest", "codes", "dist").union(owns[k].select(*square(group), block, "dest", "codes", "dist"))
        state = steps.keep(within(levels[k], asked(parts, "gq", "gr", group * unit // side), group, partial(lowered, unit=unit), known))

    def fill(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        tile, d = next(right.itertuples()), np.unique(left.dest)
        at = np.asarray(tile.at)
        dist = relax(frame(at, tile.w8, side), _window(left, d, tile, side))[:, at // side + 1, at % side + 1]
        i, k = np.nonzero(dist < FAR)
        return pd.DataFrame({"dest": d[i], "cell_id": np.asarray(tile.ids)[k], "dist8": dist[i, k]})

    none = F.lit(None).cast("array<long>")
    rows = starts.select(*TILE, "block", "dest", "at", none.alias("codes"), none.alias("dist"))
    rows = rows.union(state.select(F.col("nq").alias("tq"), F.col("nr").alias("tr"), block, "dest", F.lit(None).cast("int").alias("at"), "codes", "dist"))
    rows = asked(rows, *TILE, 1)
    filled = rows.groupBy(*TILE, "block").cogroup(with_block(rows).groupBy(*TILE, "block")).applyInPandas(fill, "dest long, cell_id long, dist8 int")
    out = Steps(spark).keep(filled if only is None else filled.join(only, "cell_id", "left_semi").select("dest", "cell_id", "dist8"))
    steps.drop_all()
    return out


def _place(code, unit: int):
    """The square of ``unit`` cells that holds a cell, by its code."""
    q, r = F.shiftright(code, 31) - (1 << 30), code.bitwiseAND((1 << 31) - 1) - (1 << 30)
    return F.floor(q / unit), F.floor(r / unit)
