"""Distributed fields, floods, lines of sight and detours on small areas against plain searches."""

import heapq
import math
import os
import random
from collections import deque

import pytest

from hexflow.functions import grid
from hexflow.operators import fields, graph, plan, view
from hexflow.params import IMPASSABLE
from hexflow.plans import catalogue
from hexflow.sources import tables

SCHEMA = "cell_id long, q int, r int, ord int, friction double"


def area(seed, wide=23, high=17, holes=0.25, at=(-9, -6)):
    """Cells with gaps and barriers, ids and ord unrelated to the place."""
    r = random.Random(seed)
    places = [(q + at[0], k + at[1]) for q in range(wide) for k in range(high) if r.random() > 0.05]
    order = list(range(len(places)))
    r.shuffle(order)
    return [(7 * i + 3, q, k, order[i], IMPASSABLE if r.random() < holes else r.choice((1.0, 2.5, 4.0, 1.3))) for i, (q, k) in enumerate(places)]


def neighbours(rows):
    open_ = {(q, r): (i, o, f) for i, q, r, o, f in rows if f < IMPASSABLE}
    return {i: [open_[q + dq, r + dr] for dq, dr in grid.NEIGHBOURS if (q + dq, r + dr) in open_] for (q, r), (i, _, _) in open_.items()}


def dijkstra(near, dest):
    best, heap, done = {dest: 0}, [(0, dest)], {}
    while heap:
        d, u = heapq.heappop(heap)
        if u in done:
            continue
        done[u] = d
        for v, _, f in near[u]:
            new = d + int(8 * f + 0.5)
            if new < best.get(v, 1 << 60):
                best[v] = new
                heapq.heappush(heap, (new, v))
    return done


def breadth(near, src, depth):
    hops, queue = {src: 0}, deque([src])
    while queue:
        u = queue.popleft()
        if hops[u] < depth:
            for v, *_ in near[u]:
                if v not in hops:
                    hops[v] = hops[u] + 1
                    queue.append(v)
    return {v: h for v, h in hops.items() if h}


@pytest.mark.parametrize(("side", "group", "block", "holes"), [(4, 1, 256, 0.25), (5, 2, 3, 0.35), (3, 3, 1, 0.1), (32, 4, 256, 0.25)])
def test_fields_equal_a_plain_search(spark, monkeypatch, side, group, block, holes):
    monkeypatch.setattr(fields, "BLOCK", block)
    rows = area(side, holes=holes)
    near = neighbours(rows)
    dests = random.Random(2).sample([r[0] for r in rows], 9) + [rows[0][0]] * 2 + [-1]
    got = fields.gradient(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(d,) for d in dests] + [(None,)], "dest long"), side, group)
    want = {(d, c, n) for d in dests if d in near for c, n in dijkstra(near, d).items()}
    rows_ = [tuple(r) for r in got.collect()]
    assert set(rows_) == want and len(rows_) == len(want)


@pytest.mark.parametrize(("side", "group"), [(5, 2), (32, 4)])
def test_fields_at_some_cells_are_those_of_the_whole(spark, side, group):
    rows = area(side)
    near = neighbours(rows)
    r = random.Random(3)
    dests, asked = (r.sample([x[0] for x in rows], n) for n in (6, 7))
    table = lambda ids, c: spark.createDataFrame([(i,) for i in ids], f"{c} long")
    got = fields.gradient(spark.createDataFrame(rows, SCHEMA), table(dests, "dest"), side, group, at=table([*asked, asked[0], -1, None], "cell_id"))
    want = sorted((d, c, n) for d in dests if d in near for c, n in dijkstra(near, d).items() if c in asked)
    assert sorted(tuple(x) for x in got.collect()) == want


def test_pairs_take_the_fields_at_origins_alone(spark, monkeypatch):
    """Pairs need a distance an origin and destination: no field of the whole area is written for them."""
    sf, taken, whole = "/root/testdata/sf0.001", [], graph.gradient
    monkeypatch.setattr(graph, "gradient", lambda *a, **k: taken.append(whole(*a, **k)) or taken[-1])
    found = catalogue.reachable_od(spark, sf).count()
    n = tables.nodes(spark, sf)
    assert found and taken[0].count() <= plan.origins(n).count() * plan.destinations(n).count()


@pytest.mark.parametrize("side", [3, 32])
def test_headings_equal_a_plain_look_around(spark, side):
    """Ties go to the first by ord; and no row stands for a pair of neighbours: the only join is with the cells."""
    rows = area(side + 1)
    near, at = neighbours(rows), {i: (q, r) for i, q, r, _, _ in rows}
    dests = random.Random(4).sample([x[0] for x in rows], 6)
    cells = spark.createDataFrame(rows, SCHEMA)
    got = graph.initial_heading(fields.gradient(cells, spark.createDataFrame([(d,) for d in dests], "dest long")), cells, side)
    want = set()
    for d in dests:
        dist = dijkstra(near, d) if d in near else {}
        for c, own in dist.items():
            step = min(((dist[v], o, v) for v, o, _ in near[c]), default=(own, 0, 0))
            if step[0] < own:
                x, y = at[step[2]][0] - at[c][0], at[step[2]][1] - at[c][1]
                want.add((d, c, int(math.degrees(math.atan2(x + y / 2, y * math.sqrt(3) / 2)) % 360 + 0.5)))
    found = [tuple(x) for x in got.collect()]
    assert set(found) == want and len(found) == len(want)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_a_long_way_round_takes_rounds_by_groups_not_cells(spark):
    """A corridor that winds through every tile: hundreds of cells, few rounds."""
    rows, n = [], 0
    for q in range(24):
        for r in range(24):
            wall = q % 2 and not (r == 23 and q % 4 == 1 or r == 0 and q % 4 == 3)
            rows.append((n, q, r, n, IMPASSABLE if wall else 1.0))
            n += 1
    cells = spark.createDataFrame(rows, SCHEMA)
    kept = []
    keep = fields.Steps.keep
    fields.Steps.keep = lambda self, df: kept.append(0) or keep(self, df)
    try:
        got = {(r.cell_id, r.dist8) for r in fields.gradient(cells, spark.createDataFrame([(0,)], "dest long"), 6, 4).collect()}
    finally:
        fields.Steps.keep = keep
    want = dijkstra(neighbours(rows), 0)
    assert got == set(want.items()) and max(want.values()) > 8 * 250 and len(kept) < 10


def test_tables_follow_the_levels_of_a_long_area(spark, monkeypatch):
    """150 tiles in a row: four levels up and down, no round from group to group."""
    rows = [(3 * r + q, q, r, 3 * r + q, 1.0 if q or r % 7 else 2.5) for r in range(600) for q in range(3)]
    kept = []
    keep = fields.Steps.keep
    monkeypatch.setattr(fields.Steps, "keep", lambda self, df: kept.append(0) or keep(self, df))
    dests = spark.createDataFrame([(0,), (901,)], "dest long")
    got = {tuple(r) for r in fields.gradient(spark.createDataFrame(rows, SCHEMA), dests, 4, 4).collect()}
    near = neighbours(rows)
    assert got == {(d, c, x) for d in (0, 901) for c, x in dijkstra(near, d).items()} and len(kept) < 24


def test_counts_of_lines_and_judging_by_pieces(spark, monkeypatch):
    from hexflow.operators import raster

    r = random.Random(5)
    ends = [tuple(r.randint(-60, 60) for _ in range(4)) for _ in range(300)] + [(1, 2, 1, 2), (-7, -9, 50, 3)] * 2
    df = spark.createDataFrame(ends, "q0 int, r0 int, q1 int, r1 int")
    want = {(x.q, x.r): x["count"] for x in raster.segment_cells(df, []).groupBy("q", "r").count().collect()}
    monkeypatch.setattr(raster, "STEPS", 500)
    assert {(x.q, x.r): x.n for x in raster.segment_counts(df).collect()} == want
    rows = area(11, 121, 121, 0.03, (-60, -60))
    open_ = {(q, k) for _, q, k, _, f in rows if f < IMPASSABLE}
    asked, cells = [], raster.segment_cells
    monkeypatch.setattr(raster, "segment_cells", lambda s, *a, **k: asked.append(s.count()) or cells(s, *a, **k))
    got = {(x.q0, x.r0, x.q1, x.r1): x.clear for x in view.clear_lines(df, spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {e: all(c in open_ for c in grid.path_cells(*e)) for e in ends} and True in got.values()
    assert len(asked) == 4 and asked[0] > asked[1] > 4 * asked[2]  # barred lines are not followed


def test_fields_of_nothing(spark):
    cells = spark.createDataFrame(area(1), SCHEMA)
    none = spark.createDataFrame([], "dest long")
    assert fields.gradient(cells, none).count() == 0
    assert fields.gradient(cells.limit(0), spark.createDataFrame([(1,)], "dest long")).count() == 0
    alone = spark.createDataFrame([(1, 0, 0, 0, 1.0), (2, 5, 5, 1, 1.0)], SCHEMA)
    assert [tuple(r) for r in fields.gradient(alone, spark.createDataFrame([(1,)], "dest long"), 4).collect()] == [(1, 1, 0)]


def test_steps_are_deleted(spark):
    place = fields.Steps(spark).place.rsplit("/", 1)[0].removeprefix("file:")
    before = set(os.listdir(place))
    fields.gradient(spark.createDataFrame(area(3), SCHEMA), spark.createDataFrame([(10,), (17,)], "dest long"), 4, 2)
    new = set(os.listdir(place)) - before
    assert sum(bool(os.listdir(f"{place}/{x}")) for x in new) == 1  # the result


def test_rounds_of_joins_agree(spark):
    cells = spark.createDataFrame(area(5), SCHEMA)
    dests = spark.createDataFrame([(10,), (17,)], "dest long")
    plain = graph.gradient_rounds(graph.passable_adjacency(cells), dests.join(cells.where("friction < 999999").selectExpr("cell_id as dest"), "dest", "left_semi"))
    assert sorted(map(tuple, plain.select("dest", "cell_id", "dist8").collect())) == sorted(map(tuple, fields.gradient(cells, dests, 5).collect()))


@pytest.mark.parametrize(("depth", "side"), [(1, 32), (4, 3), (15, 7), (6, 64)])
def test_floods_equal_a_plain_search(spark, depth, side):
    rows = area(depth)
    near, order, at = neighbours(rows), {r[0]: r[3] for r in rows}, {r[0]: r[1:3] for r in rows}
    got = view.flood(spark.createDataFrame(rows, SCHEMA), depth, side).collect()
    want = {(a, b, order[b], h, at[b][0] - at[a][0], at[b][1] - at[a][1]) for a in near for b, h in breadth(near, a, depth).items()}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def pairs_of(spark, rows, n=300, seed=4):
    r = random.Random(seed)
    some = [(k, a[0], b[0], a[1], a[2], b[1], b[2]) for k in range(n) for a, b in [(r.choice(rows), r.choice(rows))]]
    return some, spark.createDataFrame([*some, (n, 1, 2, None, 0, 0, 0)], "k long, src long, dst long, q0 int, r0 int, q1 int, r1 int")


def test_clear_lines_and_views_equal_plain_ones(spark):
    rows = area(8, holes=0.15)
    cells = spark.createDataFrame(rows, SCHEMA)
    open_ = {(q, r) for _, q, r, _, f in rows if f < IMPASSABLE}
    some, pairs = pairs_of(spark, rows)
    clear = {k: all(c in open_ for c in grid.path_cells(*ends)) for k, _, _, *ends in some}
    assert {r.k: r.clear for r in view.clear_lines(pairs, cells).collect()} == clear | {len(some): None}
    inner = [x for x in rows if x[1] < 3]
    near = neighbours(inner)
    viewed = spark.createDataFrame(inner, SCHEMA)
    got = {r.k: r.visible for r in view.in_view(pairs, view.flood(viewed, 5), viewed, cells).collect()}
    ids = {x[0] for x in inner}
    want = {k: (a in near and b in breadth(near, a, 5)) if a in ids else clear[k] for k, a, b, *_ in some}
    assert {k: v for k, v in got.items() if k < len(some)} == want and len(set(want.values())) == 2


def test_detours_are_the_first_shortest_ways(spark):
    rows = area(9, holes=0.3)
    cells, near = spark.createDataFrame(rows, SCHEMA), neighbours(rows)
    at, depth = {r[0]: r[1:3] for r in rows}, 7
    open_ = {at[i] for i in near}
    some, pairs = pairs_of(spark, rows, 500)
    got = {r.k: (r.how, [tuple(c) for c in r.way] if r.way else None) for r in view.step_lines(pairs, view.flood(cells, depth), cells).collect()}
    hows = set()
    for k, a, b, *ends in some:
        line = grid.path_cells(*ends)
        if all(c in open_ for c in line):
            want = ("straight", line)
        else:
            want = ("stay", [at[a]])
            if a in near and b in near and a != b:
                # breadth first with neighbours in order: the first way found is the one
                queue, came = deque([a]), {a: None}
                while queue and b not in came:
                    u = queue.popleft()
                    for v, *_ in sorted(near[u], key=lambda x: x[1]):
                        if v not in came:
                            came[v] = u
                            queue.append(v)
                if b in came:
                    way = [b]
                    while way[-1] != a:
                        way.append(came[way[-1]])
                    if len(way) - 1 <= depth:
                        want = ("detour", [at[i] for i in way[::-1]])
        assert got[k] == want
        hows.add(want[0])
    assert hows == {"straight", "detour", "stay"} and got[len(some)] == (None, None)
