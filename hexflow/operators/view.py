"""Which cells are in view: floods in packed bits within tiles, and straight lines of sight as joins."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexflow.functions import grid
from hexflow.params import IMPASSABLE
from hexflow.sources.shared import Steps, written

#: Cells along a tile's edge: a task floods from side squared sources at once, a bit each.
SIDE = 32
#: First and last steps of the pieces that lines are judged by.
PIECES = ((0, 7), (8, 31), (32, 127), (128, None))
#: Cells along the squares that lines look passable cells up in: a long has a bit for each.
BITS = 8


def flood(cells: DataFrame, depth: int, side: int = SIDE, sources: DataFrame | None = None) -> DataFrame:
    """``src, dst, dst_ord, hops, dq, dr``: passable cells within ``depth`` steps over passable cells, at their first step.

    The grid is cut into tiles, and each tile's task also gets the cells within ``depth`` around it, so a cell is sent
    to a few tiles and no pairs are exchanged.  A cell of the window holds a bit for each source of the tile; a step
    shifts the newest bits to the six neighbours, all sources at once.  With ``sources`` (cell_id), only what these see.
    """
    reach = lambda c: F.explode(F.sequence(F.floor((F.col(c) - depth) / side).cast("int"), F.floor((F.col(c) + depth) / side).cast("int")))
    near = cells.where(F.col("friction") < IMPASSABLE).select("cell_id", "q", "r", "ord")
    if sources is None:
        near = near.withColumn("asked", F.lit(True))
    else:
        near = near.join(sources.select("cell_id").distinct().withColumn("asked", F.lit(True)), "cell_id", "left").withColumn("asked", F.coalesce("asked", F.lit(False)))
    near = near.withColumn("tq", reach("q")).withColumn("tr", reach("r"))

    def seen(pdf: pd.DataFrame) -> pd.DataFrame:
        wide, rim = side + 2 * depth + 2, depth + 1
        q, r = (pdf[a].to_numpy() - t * side for a, t in (("q", pdf.tq.iloc[0]), ("r", pdf.tr.iloc[0])))
        cell = np.full((wide, wide), -1)
        cell[q + rim, r + rim] = np.arange(len(pdf))
        source = np.flatnonzero((q >= 0) & (q < side) & (r >= 0) & (r < side) & pdf.asked.to_numpy())
        if not len(source):
            return pd.DataFrame(columns=["src", "dst", "dst_ord", "hops", "dq", "dr"])
        words = -(-max(len(source), 1) // 64)
        front = np.zeros((wide, wide, words), dtype=np.uint64)
        bit = np.arange(len(source))
        front[q[source] + rim, r[source] + rim, bit // 64] = np.uint64(1) << (bit % 64).astype(np.uint64)
        reached, found = front.copy(), []
        for hop in range(1, depth + 1):
            new = np.zeros_like(front)
            for dq, dr in grid.NEIGHBOURS:
                new[1:-1, 1:-1] |= front[1 + dq : wide - 1 + dq, 1 + dr : wide - 1 + dr]
            new &= ~reached
            new[cell < 0] = 0
            at = cell[new.any(axis=2)]
            i, s = np.nonzero(np.unpackbits(new[q[at] + rim, r[at] + rim].view(np.uint8), axis=1, bitorder="little")[:, : len(source)]) if len(at) else (np.zeros(0, int), np.zeros(0, int))
            found.append((source[s], at[i], np.full(len(i), hop)))
            reached |= new
            front = new
        a, b, hops = (np.concatenate(x) for x in zip(*found, strict=True))
        ids, order = pdf.cell_id.to_numpy(), pdf["ord"].to_numpy()
        return pd.DataFrame({"src": ids[a], "dst": ids[b], "dst_ord": order[b], "hops": hops, "dq": q[b] - q[a], "dr": r[b] - r[a]})

    return near.groupBy("tq", "tr").applyInPandas(seen, "src long, dst long, dst_ord int, hops int, dq int, dr int")


def visibility(cells: DataFrame, depth: int) -> DataFrame:
    """``src, dst, dst_ord, hops, bearing``: what each passable cell sees within ``depth`` steps."""
    deg = grid.round_half_up(grid.bearing(F.col("dq"), F.col("dr")))
    return flood(cells, depth).select("src", "dst", "dst_ord", "hops", deg.cast("int").alias("bearing"))


def visibility_lists(visible: DataFrame) -> DataFrame:
    """``src`` with its visible cells as an array in the order of dst_ord."""
    return visible.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("dst_ord", "dst", "bearing"))).alias("visible"))


def clear_lines(pairs: DataFrame, cells: DataFrame) -> DataFrame:
    """The pairs (q0, r0, q1, r1 and any other columns) with ``clear``: every cell of the straight line, its ends too, is passable.

    A line's cells are the same both ways, so each distinct pair of ends is judged once, whatever the number of rows.
    A null end has no line and null comes out; a cell outside the area bars the line.  Lines are judged piece by piece (``PIECES``),
    and of a line that a piece bars no further step is made.  Passable cells are looked up as the bits of their square, a row a square.
    """
    from hexflow.operators.raster import segment_cells

    ends = ["q0", "r0", "q1", "r1"]
    forward = (F.col("q0") < F.col("q1")) | ((F.col("q0") == F.col("q1")) & (F.col("r0") <= F.col("r1")))
    turned = [F.when(forward, F.col(a)).otherwise(F.col(b)).alias(f"_{n}") for n, a, b in zip(ends, ("q0", "r0", "q1", "r1"), ("q1", "r1", "q0", "r0"), strict=True)]
    keys = [f"_{n}" for n in ends]
    tables = Steps(pairs.sparkSession)
    own = pairs.where(" and ".join(f"{c} is not null" for c in ends)).select(*turned).distinct()
    left = tables.keep(own.select(*[F.col(k).alias(n) for k, n in zip(keys, ends, strict=True)]))
    square = {f"_s{c}": F.floor(F.col(c) / BITS).cast("int") for c in ("q", "r")}
    at = (F.pmod("q", F.lit(BITS)) * BITS + F.pmod("r", F.lit(BITS))).cast("int")
    passable = cells.where(F.col("friction") < IMPASSABLE).withColumns(square).groupBy(*square)
    open_ = tables.keep(passable.agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), at)).alias("_open")))
    parts = []
    for piece in PIECES:
        line = segment_cells(left, ends, steps=piece)
        own = F.coalesce(F.getbit("_open", at) == 1, F.lit(False))
        judged = tables.keep(line.withColumns(square).join(open_, list(square), "left").groupBy(*ends).agg(F.every(own).alias("clear")))
        done = F.lit(True) if piece[1] is None else grid.grid_distance(*ends) <= piece[1]
        parts.append(judged.where(~F.col("clear") | done))
        left = judged.where(F.col("clear") & ~done).select(*ends)
    judged = reduce(DataFrame.union, parts)
    judged = judged.select(*[F.col(n).alias(k) for k, n in zip(keys, ends, strict=True)], "clear")
    return pairs.select("*", *turned).join(judged, keys, "left").drop(*keys)


def in_view(pairs: DataFrame, visible: DataFrame, viewed: DataFrame, cells: DataFrame) -> DataFrame:
    """The pairs (src, dst, q0, r0, q1, r1, others) with ``visible``: looked up where src has a view, else by the straight line.

    A cell of ``viewed`` has a view, though it may be empty; for any other the line through ``cells`` decides.
    """
    has_view = viewed.select(F.col("cell_id").alias("src"), F.lit(True).alias("_has")).distinct()
    hit = visible.select("src", "dst").distinct().withColumn("_hit", F.lit(True))
    out = clear_lines(pairs, cells).join(has_view, "src", "left").join(hit, ["src", "dst"], "left")
    return out.withColumn("visible", F.when(F.col("_has"), F.coalesce("_hit", F.lit(False))).otherwise(F.col("clear"))).drop("_has", "_hit", "clear")


def step_lines(pairs: DataFrame, visible: DataFrame, cells: DataFrame) -> DataFrame:
    """The pairs (src, dst, q0, r0, q1, r1, others) with ``way``, the cells walked as (q, r), and ``how``: straight, detour or stay.

    The straight line, if it is clear.  Else the shortest way over passable cells, of several the one whose cells come first
    by ord, step by step; beyond the depth of ``visible`` (src, dst, dst_ord, hops, dq, dr; of both ends of every pair within it) there is none, and src alone is left.

    Both ends' floods meet on the cells of the shortest ways: those whose steps from src and to dst add up to the
    whole.  They are few, since a cell further off than the steps that are left is dropped before the join; a fold
    over them by step and ord picks the way.
    """
    judged = written(clear_lines(pairs, cells))
    asked = judged.where(~F.col("clear")).select("src", "dst", "q0", "r0", "q1", "r1").distinct()
    whole = asked.join(visible.select("src", "dst", F.col("dst_ord").alias("o1"), F.col("hops").alias("n")), ["src", "dst"])
    first = visible.select("src", F.col("dst").alias("mid"), F.col("dst_ord").alias("o"), F.col("hops").alias("h"), "dq", "dr")
    rest = visible.select(F.col("dst").alias("mid"), F.col("src").alias("dst"), F.col("hops").alias("left"))  # as far there as back
    q, r = F.col("q0") + F.col("dq"), F.col("r0") + F.col("dr")
    mids = whole.join(first, "src").where(F.col("h") < F.col("n")).withColumns({"q": q, "r": r}).where(grid.grid_distance("q", "r", "q1", "r1") <= F.col("n") - F.col("h"))
    mids = mids.join(rest, ["mid", "dst"]).where(F.col("h") + F.col("left") == F.col("n"))
    each = mids.select("src", "dst", "q0", "r0", F.struct("h", "o", "q", "r").alias("c")).unionByName(whole.select("src", "dst", "q0", "r0", F.struct(F.col("n").alias("h"), F.col("o1").alias("o"), F.col("q1").alias("q"), F.col("r1").alias("r")).alias("c")))
    place = lambda q, r: F.struct(q.cast("int").alias("q"), r.cast("int").alias("r"))
    start = F.array(place(F.col("q0"), F.col("r0")))

    def take(way, c):
        last = F.element_at(way, -1)
        follows = (F.size(way) == c["h"]) & (grid.grid_distance(last["q"], last["r"], c["q"], c["r"]) == 1)
        return F.when(follows, F.concat(way, F.array(place(c["q"], c["r"])))).otherwise(way)

    found = each.groupBy("src", "dst", "q0", "r0").agg(F.sort_array(F.collect_list("c")).alias("_c"))  # what lies on the shortest ways of one pair
    found = found.select("src", "dst", F.aggregate("_c", start, take).alias("_way"))
    out = judged.join(found, ["src", "dst"], "left")
    straight = grid.grid_path("q0", "r0", "q1", "r1")
    how = F.when(F.col("clear"), "straight").when(F.col("_way").isNotNull(), "detour").when(F.col("clear").isNotNull(), "stay")
    return out.withColumn("how", how).withColumn("way", F.when(F.col("clear"), straight).when(F.col("clear").isNotNull(), F.coalesce("_way", start))).drop("_way", "clear")
