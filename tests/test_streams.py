"""Streams equal their batch queries."""

import random

import pytest

from hexflow.functions import grid
from hexflow.streaming import edits as live


@pytest.fixture
def rocks(spark):
    for k, v in live.STATE_STORE.items():
        spark.conf.set(k, v)
    yield spark
    for k in live.STATE_STORE:
        spark.conf.unset(k)


def test_painted_and_removed_surfaces_on_a_stream(rocks, tmp_path):
    spark, r = rocks, random.Random(1)
    cells = spark.createDataFrame([(7 * i, q, k) for i, (q, k) in enumerate(grid.disk_offsets(5))], "cell_id long, q int, r int")
    events, seq = [], 0
    for e in range(30):
        q, k = r.randint(-5, 3), r.randint(-5, 3)
        box = (q, q + r.randint(0, 4), k, k + r.randint(0, 4))
        events.append((seq, "paint", e, r.randint(0, 9), r.choice(("PAVEMENT", "HEAVY_GRASS", "IMPASSABLE")), *box))
        seq += 1
        if r.random() < 0.5:
            events.append((seq, "remove", e, 0, None, *box))
            seq += 1
            if r.random() < 0.4:
                events.append((seq, "paint", e, r.randint(0, 9), "LIGHT_PARK", *box))
                seq += 1
    want = {x.cell_id: (x.edit_id, x.surface_class) for x in live.surfaces(spark.createDataFrame(events, live.EVENTS), cells).collect()}
    # plain replay, event by event
    at = {(q, k): 7 * i for i, (q, k) in enumerate(grid.disk_offsets(5))}
    stack = {}
    for _, event, e, order, cls, q0, q1, r0, r1 in events:
        for q in range(q0, q1 + 1):
            for k in range(r0, r1 + 1):
                if (q, k) in at:
                    own = stack.setdefault(at[q, k], {})
                    own.pop(e, None)
                    if event == "paint":
                        own[e] = (order, e, cls)
    assert want == {c: max(own.values())[1:] for c, own in stack.items() if own} and len(want) > 30
    r.shuffle(events)  # late and out of order
    for b in range(4):
        spark.createDataFrame(events[b::4] + events[:3], live.EVENTS).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(live.EVENTS).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    now, batches = {}, []

    def apply(df, n):
        batches.append(n)
        for x in df.collect():
            now[x.cell_id] = (x.edit_id, x.surface_class)

    query = live.live_surfaces(stream, cells).writeStream.outputMode("update").foreachBatch(apply).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert not query.isActive and query.exception() is None and len(batches) >= 4
    assert {c: v for c, v in now.items() if v[0] is not None} == want
    assert any(v == (None, None) for v in now.values())


def test_the_top_of_a_cell_is_found_before_cells_are_joined(spark):
    """Edits of one rectangle, removed and not, one whose rectangles differ, and ties of draw_order."""
    from hexflow.streaming.edits import EVENTS, surfaces

    rows = [(1, "paint", 1, 1, "A", 0, 3, 0, 3), (2, "paint", 2, 2, "B", 1, 2, 1, 2), (3, "remove", 2, 2, "B", 1, 2, 1, 2)]
    rows += [(4, "paint", 3, 5, "C", 0, 1, 0, 0), (5, "remove", 3, 5, "C", 1, 1, 0, 0), (6, "paint", 4, 1, "D", 3, 3, 3, 3), (7, "paint", 5, 9, "E", 3, 2, 0, 0)]
    cells = spark.createDataFrame([(q * 10 + r, q, r) for q in range(4) for r in range(4)], "cell_id long, q int, r int")
    out = surfaces(spark.createDataFrame(rows, EVENTS), cells)
    want = {q * 10 + r: (1, "A") for q in range(4) for r in range(4)} | {0: (3, "C"), 33: (4, "D")}
    assert {x.cell_id: (x.edit_id, x.surface_class) for x in out.collect()} == want
    assert "Aggregate(key=[q#" in out._jdf.queryExecution().executedPlan().toString()
