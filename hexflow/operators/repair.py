"""Shortest-path fields after an edit: only what the edit reaches is settled again.

Where cells became harder or closed, a distance is lost if every neighbour that it was reached from is lost too or can't be entered
for the old price any more; this spreads along the old shortest ways and no further.  Then lost cells, and those around
cells that became easier, take their distances anew from what is left.  Both go tile by tile: a task holds one tile, with a
rim of its neighbours' cells, for ``BLOCK`` destinations, and what changes on a tile's edge is sent to the tiles that have it
in their rim.  Rounds follow the number of tiles that the edit's effect crosses; tiles that it doesn't reach are not
worked on.  An edit whose effect goes further than ``ROUNDS`` tiles, or one that changes a large share of many tiles, leaves little to keep: those
destinations' fields are worked out anew, by levels (``operators.fields``), which needs no round a tile.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexflow.functions import grid
from hexflow.operators.fields import FAR, TILE, gradient, relax, weight8
from hexflow.params import IMPASSABLE
from hexflow.sources.shared import Steps

SIDE, BLOCK = 64, 64
#: Rounds of one spread; the share of changed tiles, of so many at least, beyond which nothing is repaired.
ROUNDS, SHARE, MANY = 12, 0.25, 32
STATE = "tq int, tr int, dest long, at array<int>, dist array<long>, lost array<int>"
SENT = "s_tq array<int>, s_tr array<int>, s_at array<int>, s_dist array<long>"
#: The tiles around one.
AROUND = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]


def _windowed(cells: DataFrame, side: int) -> DataFrame:
    """Each cell in its own tile, and in the tiles that have it in their rim: tq, tr and its place ``at`` in the window."""
    span = lambda c: F.explode(F.sequence(F.floor((F.col(c) - 1) / side).cast("int"), F.floor((F.col(c) + 1) / side).cast("int")))
    out = cells.withColumn("tq", span("q")).withColumn("tr", span("r"))
    return out.withColumn("at", ((F.col("q") - F.col("tq") * side + 1) * (side + 2) + F.col("r") - F.col("tr") * side + 1).cast("int"))


def _prices(before: DataFrame, after: DataFrame) -> DataFrame:
    """What entering each cell cost (w0) and costs (w1), FAR where it is closed."""
    price = lambda df, name: df.where(F.col("friction") < IMPASSABLE).select("cell_id", "q", "r", weight8().cast("long").alias(name))
    return price(before, "w0").join(price(after, "w1"), ["cell_id", "q", "r"], "full").na.fill(int(FAR), ["w0", "w1"])


def _weights(both: DataFrame, side: int) -> DataFrame:
    """A row a tile: its window's cells (at, ids) with what entering cost (w0) and costs (w1), and whether any of its own became harder or easier."""
    own = (F.floor(F.col("q") / side) == F.col("tq")) & (F.floor(F.col("r") / side) == F.col("tr"))
    rows = _windowed(both, side).groupBy(*TILE).agg(
        F.sort_array(F.collect_list(F.struct("at", "w0", "w1", "cell_id"))).alias("c"),  # (side + 2) squared at most
        F.max(own & (F.col("w1") > F.col("w0"))).alias("harder"), F.max(own & (F.col("w1") < F.col("w0"))).alias("easier"),
    )
    return rows.select(*TILE, "harder", "easier", F.col("c.at").alias("at"), F.col("c.w0").alias("w0"), F.col("c.w1").alias("w1"), F.col("c.cell_id").alias("ids"))


class Window:
    """A tile and its rim in a task, for some destinations."""

    def __init__(self, left: pd.DataFrame, right: pd.DataFrame, side: int):
        row, wide = next(right.itertuples()), side + 2
        at = np.asarray(row.at)
        self.tile, self.side = (row.tq, row.tr), side
        self.dests = np.unique(left.dest)
        self.w0, self.w1 = (np.full((wide, wide), FAR) for _ in range(2))
        self.w0.flat[at], self.w1.flat[at] = row.w0, row.w1
        self.own = np.zeros((wide, wide), dtype=bool)
        self.own[1:-1, 1:-1] = True
        self.dist = np.full((len(self.dests), wide, wide), FAR)
        self.lost = np.zeros(self.dist.shape, dtype=bool)
        self.goal = np.zeros(self.dist.shape, dtype=bool)
        place = dict(zip(np.asarray(row.ids).tolist(), at.tolist(), strict=True))
        for k, d in enumerate(self.dests.tolist()):
            if d in place:
                self.goal[k].flat[place[d]] = True
        for r in left[left.kind == 0].itertuples():
            k = np.searchsorted(self.dests, r.dest)
            if r.at is not None:
                self.dist[k].flat[np.asarray(r.at)] = r.dist
            if r.lost is not None:
                self.lost[k].flat[np.asarray(r.lost)] = True

    def rim(self, left: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Arrivals: destination, place in the window, distance."""
        came = left[left.kind == 1]
        at = np.array([a[0] for a in came["at"]], dtype=np.int64)
        return np.searchsorted(self.dests, came.dest), at, np.array([d[0] for d in came.dist], dtype=np.int64)

    def neighbours(self, cells: np.ndarray):
        """The inner cells' neighbours' values, one direction after the other."""
        n = self.side
        for dq, dr in grid.NEIGHBOURS:
            yield cells[:, 1 + dq : 1 + dq + n, 1 + dr : 1 + dr + n]

    def rows(self, which: np.ndarray, news: np.ndarray, values: np.ndarray) -> pd.DataFrame:
        """The state of some destinations, and their news (a mask of own cells) for the tiles around."""
        out, wide, n = [], self.side + 2, self.side
        for k in np.flatnonzero(which):
            at, lost = np.flatnonzero(self.dist[k] < FAR), np.flatnonzero(self.lost[k])
            sent: list[list] = [[], [], [], []]
            i, j = np.nonzero(news[k])
            for a, b in AROUND:
                i2, j2 = i - a * n, j - b * n
                seen = (i2 >= 0) & (i2 <= n + 1) & (j2 >= 0) & (j2 <= n + 1)
                for s, v in zip(sent, (np.full(seen.sum(), self.tile[0] + a), np.full(seen.sum(), self.tile[1] + b), (i2 * wide + j2)[seen], values[k][i, j][seen]), strict=True):
                    s.extend(v.tolist())
            out.append((*self.tile, self.dests[k], at, self.dist[k].flat[at], lost, *sent))
        return pd.DataFrame(out, columns=["tq", "tr", "dest", "at", "dist", "lost", "s_tq", "s_tr", "s_at", "s_dist"])


def _loosened(w: Window, left: pd.DataFrame) -> pd.DataFrame:
    """Distances that no neighbour supports any more."""
    k, at, _ = w.rim(left)
    before = w.lost.copy()
    w.lost.reshape(len(w.dests), -1)[k, at] = True
    there = w.own & (w.dist < FAR) & ~w.goal
    w.lost |= there & (w.w1 > w.w0)
    inner = w.lost[:, 1:-1, 1:-1]
    while True:
        held = np.zeros(inner.shape, dtype=bool)
        for d, lost in zip(w.neighbours(w.dist), w.neighbours(w.lost), strict=True):
            held |= ~lost & (d + w.w0[1:-1, 1:-1] == w.dist[:, 1:-1, 1:-1])
        new = there[:, 1:-1, 1:-1] & ~inner & ~held
        if not new.any():
            break
        inner |= new
    news = w.lost & ~before
    return w.rows(news.any(axis=(1, 2)), news & w.own, w.dist)


def _settled(w: Window, left: pd.DataFrame) -> pd.DataFrame:
    """Distances from what is left, or has arrived."""
    k, at, dist = w.rim(left)
    w.dist[w.lost] = FAR
    started = w.lost.any(axis=(1, 2))
    w.lost[:] = False
    np.minimum.at(w.dist.reshape(len(w.dests), -1), (k, at), dist)
    known = w.dist.copy()
    relax(w.w1, w.dist)
    news = w.dist < known
    arrived = np.zeros(len(w.dests), dtype=bool)
    arrived[k] = True
    return w.rows(started | arrived | news.any(axis=(1, 2)), news & w.own, w.dist)


def repair(gradients: DataFrame, dests: DataFrame, before: DataFrame, after: DataFrame, side: int = SIDE) -> DataFrame:
    """``dest, cell_id, dist8`` for the cells ``after`` an edit, from the fields of those ``before`` it.

    ``gradients`` are right for ``before``.  Destinations that lack a field get one by ``gradient``, those now closed lose theirs.  Cells
    may also come or go; a cell keeps its id and place.  Entering any cell must cost something (friction of 1/16 or more).  The
    result is a written table.
    """
    spark = gradients.sparkSession
    steps = Steps(spark)
    open_ = after.where(F.col("friction") < IMPASSABLE).select(F.col("cell_id").alias("dest"))
    wanted = dests.select("dest").distinct().join(open_, "dest", "left_semi")
    had = gradients.select("dest").distinct()
    prices = steps.keep(_prices(before, after))
    tile = [F.floor(F.col(c) / side) for c in ("q", "r")]
    changed, n_tiles = prices.groupBy(*tile).agg(F.max(F.col("w0") != F.col("w1")).alias("c")).agg(F.count_if("c"), F.count("*")).first()
    if n_tiles >= MANY and changed > SHARE * n_tiles:
        steps.drop_all()
        return gradient(after, wanted)
    tiles = steps.keep(_weights(prices, side))
    places = _windowed(before.where(F.col("friction") < IMPASSABLE).select("cell_id", "q", "r"), side).select("cell_id", *TILE, "at")
    old = gradients.join(wanted, "dest", "left_semi").join(places, "cell_id").groupBy(*TILE, "dest").agg(F.sort_array(F.collect_list(F.struct("at", "dist8"))).alias("c"))
    none = F.array().cast("array<int>")
    packed = steps.keep(old.select(*TILE, "dest", F.col("c.at").alias("at"), F.col("c.dist8").cast("array<long>").alias("dist"), none.alias("lost"), *[F.array().cast(t).alias(n) for n, t in (x.split() for x in SENT.split(", "))], F.lit(-1).alias("round")))
    tables = [packed]
    blocks = max(1, -(-wanted.count() // BLOCK))
    block = F.pmod(F.xxhash64("dest"), F.lit(blocks)).alias("block")

    def round_(active: DataFrame, arrivals: DataFrame | None, kernel) -> DataFrame:
        """The states of the active (tile, destination)s after one round; what is sent is in the last columns."""
        latest = steps.together(tables).join(active, [*TILE, "dest"], "left_semi").groupBy(*TILE, "dest").agg(F.max_by(F.struct("at", "dist", "lost"), "round").alias("s"))
        left = active.join(latest, [*TILE, "dest"], "left").select(*TILE, "dest", F.lit(0).alias("kind"), "s.at", "s.dist", "s.lost")
        if arrivals is not None:
            left = left.union(arrivals.select(*TILE, "dest", F.lit(1), F.array("at"), F.array("dist"), none))
        left = left.withColumn("block", block)
        right = tiles.join(active.select(*TILE, block).distinct(), TILE)

        def work(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if not len(a) or not len(b):
                return pd.DataFrame(columns=["tq", "tr", "dest", "at", "dist", "lost", "s_tq", "s_tr", "s_at", "s_dist"])
            return kernel(Window(a, b, side), a)

        moved = left.groupBy(*TILE, "block").cogroup(right.groupBy(*TILE, "block")).applyInPandas(work, f"{STATE}, {SENT}")
        tables.append(steps.keep(moved.withColumn("round", F.lit(len(tables)))))
        return tables[-1]

    def news(done: DataFrame) -> DataFrame:
        sent = done.select("dest", F.explode(F.arrays_zip("s_tq", "s_tr", "s_at", "s_dist")).alias("s"))
        sent = sent.groupBy(F.col("s.s_tq").alias("tq"), F.col("s.s_tr").alias("tr"), "dest", F.col("s.s_at").alias("at")).agg(F.min("s.s_dist").alias("dist"))
        return steps.keep(sent.join(tiles.select(*TILE), TILE, "left_semi"))

    def spread(active: DataFrame, kernel) -> DataFrame:
        """The destinations that are not through after all rounds."""
        arrivals = None
        for _ in range(ROUNDS):
            if active.isEmpty():
                break
            arrivals = news(round_(active, arrivals, kernel))
            active = arrivals.select(*TILE, "dest").distinct()
        return steps.keep(active.select("dest").distinct())

    known = packed.select(*TILE, "dest")
    late = spread(known.join(tiles.where("harder").select(*TILE), TILE, "left_semi"), _loosened)
    touched = known.join(tiles.where("easier").select(*TILE), TILE, "left_semi")
    if len(tables) > 1:
        touched = touched.union(steps.together(tables[1:]).select(*TILE, "dest")).distinct()
    late = late.union(spread(steps.keep(touched.join(late, "dest", "left_anti").select(*TILE, "dest")), _settled))

    def emitted(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame(columns=["dest", "cell_id", "dist8"])
        w = Window(a.assign(kind=0), b, side)
        row = next(b.itertuples())
        at = np.asarray(row.at)
        at, ids = at[w.own.flat[at]], np.asarray(row.ids)[w.own.flat[at]]
        dist = w.dist.reshape(len(w.dests), -1)[:, at]
        i, k = np.nonzero(dist < FAR)
        return pd.DataFrame({"dest": w.dests[i], "cell_id": ids[k], "dist8": dist[i, k]})

    final = steps.together(tables).join(late, "dest", "left_anti").groupBy(*TILE, "dest").agg(F.max_by(F.struct("at", "dist", "lost"), "round").alias("s")).select(*TILE, "dest", "s.at", "s.dist", "s.lost", block)
    right = tiles.join(final.select(*TILE, F.col("block").alias("block")).distinct(), TILE)
    kept = final.groupBy(*TILE, "block").cogroup(right.groupBy(*TILE, "block")).applyInPandas(emitted, "dest long, cell_id long, dist8 int")
    out = Steps(spark).keep(kept.union(gradient(after, wanted.join(had.join(late, "dest", "left_anti"), "dest", "left_anti"))))
    steps.drop_all()
    return out
