"""Painted surfaces as a stream: paint and remove events, and each cell's surface as it stands.

An event carries the whole polygon, as the drawing tool hands it over for both; its cells are spread out first, so state is
kept by cell and a large surface is many keys.  A cell's state is its edits, each with the number of its last event; an
event older than what is known of its edit changes nothing, so the order of arrival doesn't matter.  A removed edit stays
as a mark for the same reason.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: seq, event, edit_id, draw_order, surface_class, and the painted rectangle.
EVENTS = "seq long, event string, edit_id long, draw_order long, surface_class string, q0 int, q1 int, r0 int, r1 int"
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def event_cells(events: DataFrame, cells: DataFrame) -> DataFrame:
    """A row for each event and cell of the area that it covers."""
    rows = events.where("q0 <= q1 and r0 <= r1").select("seq", "event", "edit_id", "draw_order", "surface_class", "r0", "r1", F.explode(F.sequence("q0", "q1")).alias("q"))
    rows = rows.select("seq", "event", "edit_id", "draw_order", "surface_class", "q", F.explode(F.sequence("r0", "r1")).alias("r"))
    return rows.join(cells.select("cell_id", "q", "r"), ["q", "r"]).select("cell_id", "seq", "event", "edit_id", "draw_order", "surface_class")


class CellSurface(StatefulProcessor):
    """Keeps a cell's edits and tells which is on top."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.edits = handle.getMapState("edits", "edit_id long", "seq long, removed boolean, draw_order long, surface_class string")
        self.shown = handle.getValueState("shown", "edit_id long, surface_class string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        moved = False
        for batch in rows:
            for r in batch.itertuples():
                known = self.edits.getValue((r.edit_id,)) if self.edits.containsKey((r.edit_id,)) else None
                if known is None or known[0] < r.seq:
                    self.edits.updateValue((r.edit_id,), (r.seq, r.event == "remove", r.draw_order, r.surface_class))
                    moved = True
        if not moved:
            return
        top = max(((v[2], k[0], v[3]) for k, v in self.edits.iterator() if not v[1]), default=(None, None, None), key=lambda t: (t[0], t[1]))
        now = (top[1], top[2])
        was = self.shown.get() if self.shown.exists() else (None, None)
        if now != tuple(was):
            self.shown.update(now)
            yield pd.DataFrame({"cell_id": [key[0]], "edit_id": pd.array([now[0]], "Int64"), "surface_class": [now[1]]})


def live_surfaces(events: DataFrame, cells: DataFrame) -> DataFrame:
    """``cell_id, edit_id, surface_class`` of each cell whose surface changes; nulls where the last edit is gone and the ground shows again.

    ``events`` is a stream of EVENTS; the session needs the settings in STATE_STORE.
    """
    rows = event_cells(events, cells).groupBy("cell_id")
    return rows.transformWithStateInPandas(statefulProcessor=CellSurface(), outputStructType="cell_id long, edit_id long, surface_class string", outputMode="Update", timeMode="None")


def surfaces(events: DataFrame, cells: DataFrame) -> DataFrame:
    """The same for a table of events: each cell's surface after all of them, without the cells whose ground shows.

    Of an edit's events over one rectangle only the last counts, so they are one row before cells are made.  An edit of one rectangle is
    gone or stands as a whole; those that stand go by where they begin, so a task finds the top of most of its cells before anything is
    exchanged.  An edit whose events differ in their rectangles is followed cell by cell.
    """
    rectangle = ["edit_id", "q0", "q1", "r0", "r1"]
    last = events.where("q0 <= q1 and r0 <= r1").repartition("edit_id").groupBy(*rectangle).agg(F.max("seq").alias("seq"), F.max_by(F.struct("event", "draw_order", "surface_class"), "seq").alias("e"))
    last = last.select(*rectangle, "seq", "e.*", F.count("*").over(Window.partitionBy("edit_id")).alias("_n"))
    top = F.max_by(F.struct("draw_order", "edit_id", "surface_class"), F.struct("draw_order", "edit_id")).alias("t")
    parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = [F.floor(F.col("q0") / NEAR), F.floor(F.col("r0") / NEAR), F.pmod(F.xxhash64("edit_id"), F.lit(8))]  # a crowded place is eight tasks
    whole = last.where("_n = 1 and event <> 'remove'").repartition(parts, *near)
    whole = whole.select("draw_order", "edit_id", "surface_class", "r0", "r1", F.explode(F.sequence("q0", "q1")).alias("q"))
    whole = whole.select("draw_order", "edit_id", "surface_class", "q", F.explode(F.sequence("r0", "r1")).alias("r"))
    whole = whole.groupBy("q", "r").agg(top).join(cells.select("cell_id", "q", "r"), ["q", "r"]).select("cell_id", "t.*")
    each = event_cells(last.where("_n > 1"), cells).groupBy("cell_id", "edit_id").agg(F.max_by(F.struct("event", "draw_order", "surface_class"), "seq").alias("e"))
    each = each.where("e.event <> 'remove'").select("cell_id", "e.draw_order", "edit_id", "e.surface_class")
    return whole.unionByName(each).groupBy("cell_id").agg(top).select("cell_id", "t.edit_id", "t.surface_class")


#: Cells along the squares that edits are dealt by.
NEAR = 64
