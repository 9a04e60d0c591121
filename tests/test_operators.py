"""Operators on small grids: invariants and worked cases."""

import json
import math
import random

import plain_walk
import pytest
from pyspark.sql import functions as F

from hexflow.functions import classify as C
from hexflow.functions import geometry, grid, hashing
from hexflow.operators import edits, friction, graph, nodes, plan, raster, report, step, view, walk, wear
from hexflow.params import IMPASSABLE, SimulationParams
from hexflow.plans import catalogue
from hexflow.sources import geocoder, geojson, tables
from hexflow.streaming.traces import sessions, windowed_counts


def disk_cells(spark, k, barred=()):
    rows = [(i, q, r, i, IMPASSABLE if i in barred else 1.0) for i, (q, r) in enumerate(grid.disk_offsets(k))]
    return spark.createDataFrame(rows, "cell_id long, q int, r int, ord int, friction double")


def test_params_clamp_and_round():
    p = SimulationParams().updated(vision_depth=17, temperature=9, field_of_view=float("nan"), emergent_wear=0)
    assert (p.vision_depth, p.temperature, p.field_of_view, p.emergent_wear) == (15, 2, 120, False)


def test_grid_closed_forms(spark):
    assert all(len(grid.disk_offsets(k)) == 1 + 3 * k * (k + 1) for k in range(16))
    r = random.Random(1)
    rows = [tuple(r.randint(-9, 9) for _ in range(4)) for _ in range(60)]
    df = spark.createDataFrame(rows, "a int, b int, c int, d int")
    got = df.select("a", "b", "c", "d", grid.grid_path("a", "b", "c", "d").alias("p"), grid.grid_path("c", "d", "a", "b").alias("back"), grid.grid_distance("a", "b", "c", "d").alias("n"), *[x.alias(n) for n, x in zip("qr", grid.decode(grid.cell_code("a", "b")), strict=True)]).collect()
    for x in got:
        path = [(p.q, p.r) for p in x.p]
        assert path == [(p.q, p.r) for p in x.back][::-1] == grid.path_cells(x.a, x.b, x.c, x.d)
        assert len(path) == x.n + 1 and path[0] == (x.a, x.b) and path[-1] == (x.c, x.d) and (x.q, x.r) == (x.a, x.b)
        assert all((q1 - q0, r1 - r0) in grid.NEIGHBOURS for (q0, r0), (q1, r1) in zip(path, path[1:], strict=False))


def test_hash_vectors(spark):
    got = spark.sql("select explode(array('a', 'foobar', '12:34:0:56')) s").select(hashing.fnv1a(F.col("s")).alias("h"), hashing.first_uniform(hashing.fnv1a(F.col("s"))).alias("u"), "s").collect()
    assert [r.h for r in got] == [3826002220, 3214735720, 2197610650]
    assert [r.u for r in got] == [hashing.draw(r.s) for r in got]


CASES = [
    ({"source_layer": "transportation", "class": "path", "subclass": "steps"}, ("HEAVY_GRASS", "0")),
    ({"source_layer": "transportation", "class": "path", "subclass": "cycleway", "surface": "asphalt"}, ("PAVEMENT", "0")),
    ({"source_layer": "transportation", "class": "track", "surface": "gravel", "brunnel": "bridge"}, ("HEAVY_GRASS", "1")),
    ({"source_layer": "transportation", "class": "motorway", "surface": "paved", "brunnel": "tunnel"}, ("IMPASSABLE", "-1")),
    ({"source_layer": "transportation", "class": "minor_construction"}, ("IMPASSABLE", "0")),
    ({"source_layer": "transportation", "class": "minor", "brunnel": "ford"}, ("HEAVY_GRASS", "0")),
    ({"source_layer": "transportation", "class": "service", "access": "private"}, ("IMPASSABLE", "0")),
    ({"source_layer": "transportation", "class": "path", "layer": " 2nd", "brunnel": "bridge"}, ("PAVEMENT", "2")),
    ({"source_layer": "landcover", "class": "grass", "subclass": "marsh"}, ("IMPASSABLE", "0")),
    ({"source_layer": "landcover", "class": "farmland"}, ("HEAVY_GRASS", "0")),
    ({"source_layer": "landuse", "class": "zoo", "layer": "x", "brunnel": "bridge"}, ("LIGHT_PARK", "0")),
    ({"source_layer": "building", "indoor": "true", "layer": "-1"}, ("IMPASSABLE", "-1")),
    ({"source_layer": "waterway", "class": "river"}, ("IMPASSABLE", "0")),
    ({"source_layer": "waterway", "class": "river", "brunnel": "tunnel"}, None),
    ({"source_layer": "park"}, ("LIGHT_PARK", "0")),
    ({"source_layer": "elsewhere"}, ("PAVEMENT", "0")),
]


def test_classification_cases(spark):
    df = spark.createDataFrame([(i, *(c.get(p) for p in C.PROPS)) for i, (c, _) in enumerate(CASES)], "feature_id int, " + ", ".join(f"`{p}` string" for p in C.PROPS))
    got = {r.feature_id: (r.cost, r.vlayer) for r in C.classify(df).collect()}
    assert got == {i: want for i, (_, want) in enumerate(CASES) if want}


def test_clipping_equals_membership(spark):
    box = (0.0, 0.0, 10.0, 10.0)
    ring = [(-5.0, 5.0), (5.0, -5.0), (15.0, 5.0), (5.0, 15.0)]
    df = spark.createDataFrame([([{"x": x, "y": y} for x, y in ring],)], "ring array<struct<x: double, y: double>>").withColumn("cut", geometry.clip_ring(F.col("ring"), box))
    points = spark.createDataFrame([(x + 0.3, y + 0.2) for x in range(-6, 16) for y in range(-6, 16)], "x double, y double")
    both = points.crossJoin(df).select("x", "y", geometry.in_ring(F.col("x"), F.col("y"), F.col("ring")).alias("a"), geometry.in_ring(F.col("x"), F.col("y"), F.col("cut")).alias("b")).collect()
    for r in both:
        if 0 < r.x < 10 and 0 < r.y < 10:
            assert r.a == r.b
        else:
            assert not r.b
    line = spark.sql("select named_struct('x', -5d, 'y', 5d) a, named_struct('x', 15d, 'y', 5d) b, named_struct('x', -5d, 'y', 50d) c")
    got = line.select(geometry.clip_segment(F.col("a"), F.col("b"), box).alias("s"), geometry.clip_segment(F.col("a"), F.col("c"), box).alias("t")).first()
    assert (got.s.a.x, got.s.b.x) == (0.0, 10.0) and got.t is None


def test_fast_scan_merges_in_any_order(spark):
    cells = raster.aoi_cells(spark, [[(-3, -3), (6, -3), (6, 6), (-3, 6)]])
    assert [r.ord for r in cells.orderBy("cell_id").collect()] == list(range(cells.count()))
    square = [[{"x": 0.0, "y": 0.0}, {"x": 3.0, "y": 0.0}, {"x": 3.0, "y": 3.0}, {"x": 0.0, "y": 3.0}]]
    line = [[{"x": -2.0, "y": 5.0}, {"x": 5.0, "y": 5.0}]]
    props = {"park": "park", "foot": "transportation", "water": "water"}
    rows = [(1, "park", "", "Polygon", square), (2, "transportation", "path", "Polygon", square), (3, "waterway", "river", "LineString", line)]
    schema = "feature_id long, source_layer string, class string, geom_type string, rings array<array<struct<x: double, y: double>>>"
    assert props

    def run(order):
        f = spark.createDataFrame(order, schema).select("*", *[F.lit(None).cast("string").alias(c) for c in C.PROPS if c not in ("source_layer", "class")])
        hits, corridor = raster.fast_scan(f, cells)
        return sorted(map(tuple, friction.merge_layers(hits).collect())), sorted(r.cell_id for r in corridor.collect())

    merged, corridor = run(rows)
    assert (merged, corridor) == run(rows[::-1])
    assert {f for *_, f in merged} == {1.0, IMPASSABLE} and len(corridor) == 8


def test_two_barriers_are_twice_one(spark):
    one = {r.cell_id: r.w for r in friction.barrier_halo(disk_cells(spark, 2, {9})).collect()}
    cells = grid.disk_offsets(2)
    centre = cells.index((0, 0))
    assert centre == 9 and one[cells.index((1, 0))] == pytest.approx(0.800737, abs=1e-6) and one[cells.index((2, 0))] == pytest.approx(0.411112, abs=1e-6)
    both = {r.cell_id: r.w for r in friction.barrier_halo(disk_cells(spark, 2, {cells.index((1, 0)), cells.index((-1, 0))})).collect()}
    assert both[centre] == pytest.approx(2 * 0.800737, abs=1e-5)


def test_edits_last_wins_and_are_removable(spark):
    cells = disk_cells(spark, 1)
    painted = spark.createDataFrame([(1, 1, 1, "IMPASSABLE"), (1, 2, 2, "no such class"), (2, 1, 1, "HEAVY_GRASS")], "cell_id long, edit_id long, draw_order long, surface_class string")
    got = {r.cell_id: (r.friction, r.affordance) for r in edits.apply_edits(cells, painted).collect()}
    assert got[1] == (1.0, 1.0) and got[2] == (4.0, 0.3) and got[3] == (1.0, 1.0)
    left = edits.remove_edits(painted, spark.createDataFrame([(2,)], "edit_id long"))
    assert {r.cell_id: r.friction for r in edits.apply_edits(cells, left).collect()}[1] == IMPASSABLE


def test_gradient_rounds_equal_the_kernel(spark):
    r = random.Random(3)
    rows = [(i, q, s, i, r.choice([1.0, 1.0, 2.5, 4.0, IMPASSABLE])) for i, (q, s) in enumerate(grid.disk_offsets(4))]
    cells = spark.createDataFrame(rows, "cell_id long, q int, r int, ord int, friction double")
    open_ = [i for i, *_, f in rows if f < IMPASSABLE]
    dests = spark.createDataFrame([(open_[0],), (open_[9],), (next(i for i, *_, f in rows if f == IMPASSABLE),)], "dest long")
    kernel = graph.gradient(cells, dests)
    assert sorted(map(tuple, kernel.collect())) == sorted(map(tuple, graph.gradient_rounds(graph.passable_adjacency(cells), dests.limit(2)).select("dest", "cell_id", "dist8").collect()))
    g = {(x.dest, x.cell_id): x.dist8 for x in kernel.collect()}
    for e in graph.passable_adjacency(cells).collect():
        for d in open_[:1]:
            if (d, e.src) in g:
                assert g[d, e.dst] <= g[d, e.src] + e.w8
    assert len(graph.unreachable(dests, kernel).collect()) == 1
    assert graph.visibility_lists(graph.visibility(cells, 1)).count() <= len(open_)


def plan_nodes(spark):
    return spark.createDataFrame([(0, 1, "origin", 3), (1, 30, "destination", 2), (2, 50, "dual", 7), (3, 17, "destination", 1)], "node_ord int, cell_id long, type string, weight int")


def test_plan_invariants(spark):
    cells, n = disk_cells(spark, 4, {10, 11, 12}), plan_nodes(spark)
    g = graph.gradient(cells, plan.destinations(n).select(F.col("cell_id").alias("dest")))
    p = plan.check_plan(plan.apportion(plan.reachable_od(n, cells, g), 25), g).persist()
    for r in p.groupBy("origin").agg(F.sum("assigned").alias("n"), F.max("total_volume").alias("v")).collect():
        assert r.n == r.v
    assert p.where("origin = dest").count() == 0
    waves = plan.wave_split(p, 4)
    assert sorted(map(tuple, waves.groupBy("origin", "dest").agg(F.sum("agents")).collect())) == sorted((r.origin, r.dest, r.assigned) for r in p.where("assigned > 0").collect())
    assert [plan.wave_count(1), plan.wave_count(100), plan.wave_count(10**6)] == [1, 16, 16] and plan.wave_count(8, 100) == 2
    with pytest.raises(ValueError, match="no path"):
        plan.check_plan(p, g.limit(0))


@pytest.mark.parametrize("temperature", [0, 0.5])
def test_walk_invariants(spark, temperature):
    barred = {10, 11, 12, 40}
    cells, n = friction.initial_affordance(disk_cells(spark, 4, barred)), plan_nodes(spark)
    p = SimulationParams(vision_depth=2, agents_per_weight_unit=4, temperature=temperature)
    runs = []
    for parts in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        runs.append(sorted(map(tuple, walk.simulate(cells.repartition(int(parts)), n, p, waves=3).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert runs[0] == runs[1] and runs[0]
    assert not {c for _, c, _ in runs[0]} & barred
    contrib = spark.createDataFrame(runs[0], "dest long, cell_id long, n long")
    assert walk.desire(contrib).agg(F.sum("score")).first()[0] == sum(k for *_, k in runs[0])
    visits = {(d, c): k for d, c, k in runs[0]}
    assert all(visits.get((d, 1), 0) >= 1 for d in (30, 50))


def test_both_rules_go_through_the_views_once_and_fields_are_not_broadcast(spark, monkeypatch):
    d = "/root/testdata/sf0.001"
    g = tables.table(spark, d, "part").select(F.lit(3).cast("long").alias("dest"), F.col("p_partkey").alias("cell_id"), F.lit(8).alias("dist8"))
    plan_of = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(catalogue, "gradients", lambda *_: g)
    assert plan_of(catalogue.rule_steps(spark, d)).count("FlatMapGroupsInPandas") == 1
    agents = plan_of(catalogue._agents(spark, d, g))
    assert agents.count("SortMergeJoin") == 1 and agents.count("HashedRelationBroadcastMode") == 0, agents


def test_hops_and_lines_do_not_broadcast_the_cells(spark, monkeypatch):
    """Hops meet cells by sorted joins, and lines look them up as squares of bits."""
    plan_of = lambda df: df._jdf.queryExecution().executedPlan().toString()
    d = "/root/testdata/sf0.001"
    text = plan_of(catalogue._hops(spark, d))
    assert text.count("SortMergeJoin") == 2 and text.count("BroadcastExchange") == 1, text  # the number of parts, one row
    kept, keep = [], view.Steps.keep
    monkeypatch.setattr(view.Steps, "keep", lambda self, df: kept.append(keep(self, df)) or kept[-1])
    rows = [(100 * q + r, q - 20, r - 20, 100 * q + r, IMPASSABLE if q == r == 22 else 1.0) for q in range(40) for r in range(40)]
    cells = spark.createDataFrame(rows, "cell_id long, q int, r int, ord int, friction double")
    pairs = spark.createDataFrame([(-20, -20, 19, -20), (-1, 2, 7, 2), (2, 2, 2, 2), (-9, -8, -16, -1), (0, 0, 20, 0)], "q0 int, r0 int, q1 int, r1 int")
    assert [x.clear for x in sorted(view.clear_lines(pairs, cells).collect(), key=lambda x: (x.q0, x.r0))] == [True, True, False, False, False]
    squares = [t for t in kept if "_open" in t.columns]
    assert [t.count() for t in squares] == [36]


def test_views_are_not_broadcast(spark):
    """A table that a flood gives looks as small as the cells it came from."""
    d = "/root/testdata/sf0.001"
    cells = tables.cells(spark, d)
    state = catalogue._trodden(spark, d).select("cell_id", "friction", "affordance", "footprints")
    g = tables.table(spark, d, "part").select(F.lit(3).cast("long").alias("dest"), F.col("p_partkey").alias("cell_id"), F.lit(8).alias("dist8"))
    agents = g.select(F.lit("a").alias("agent"), F.col("cell_id").alias("curr"), "dest", F.lit(0).alias("heading"))
    text = step.candidates(agents, graph.visibility(cells, 2), state, g)._jdf.queryExecution().executedPlan().toString()
    lines = text.split("\n")
    at = next(i for i, x in enumerate(lines) if "FlatMapGroupsInPandas" in x)
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    above = [x for i, x in enumerate(lines[:at]) if depth(x) < min(depth(y) for y in lines[i + 1 : at + 1])]
    assert len(above) > 5 and not any("BroadcastExchange" in x for x in above), text


def test_kernel_step_equals_the_declarative_step(spark):
    cells = friction.initial_affordance(disk_cells(spark, 3, {5, 6})).withColumn("footprints", F.col("cell_id") % 3)
    g = graph.gradient(cells, spark.createDataFrame([(30,)], "dest long"))
    ground = walk.Ground.of(cells.toPandas())
    import numpy as np

    known = {r.cell_id: r.dist8 / 8 for r in g.collect()}
    far = np.array([known.get(i, np.inf) for i in ground.ids.tolist()])

    marks = ground.ids % 3
    agents = spark.createDataFrame([(f"1:30:{i}", i, 30, 45) for i in range(7, 30)], "agent string, curr long, dest long, heading int")
    for t in (0, 0.5):
        p = SimulationParams(vision_depth=2, temperature=t)
        cands = step.candidates(agents, graph.visibility(cells, 2), cells, g)
        got = {r.agent: r.next for r in (step.best_step if t == 0 else step.softmax_step)(cands, p).collect()}
        for i in range(7, 30):
            at = int(np.searchsorted(ground.ids, i))
            chosen = walk.choose(ground, p, np.array([at]), walk.seeds([f"1:30:{i}"]), np.array([45.0]), far, 0.05 * np.log1p(marks))
            assert ground.ids[chosen[0]] == got[f"1:30:{i}"]
    alone = step.fallback_step(agents, cells, g)
    assert {r.agent: r.next for r in alone.collect()} == {f"1:30:{i}": int(ground.ids[walk.fallback(ground, int(np.searchsorted(ground.ids, i)), far)]) for i in range(7, 30)}


@pytest.mark.parametrize(("temperature", "side"), [(0, 6), (0.5, 6), (0.5, 64)])
def test_steps_by_tiles_equal_the_declarative_steps(spark, monkeypatch, temperature, side):
    monkeypatch.setattr(walk, "AGENTS_PER_STEP", 20)
    p = SimulationParams(vision_depth=5, temperature=temperature)
    rows = random_ground(5, 2)
    cells = spark.createDataFrame(rows, "cell_id long, q int, r int, ord int, friction double, affordance double").withColumn("footprints", F.col("ord") % 7)
    open_ = [x[0] for x in rows if x[4] < IMPASSABLE]
    g = graph.gradient(cells, spark.createDataFrame([(open_[3],), (open_[-5],)], "dest long"))
    r = random.Random(1)
    agents = [(f"a{i}", r.choice(open_), r.choice((open_[3], open_[-5])), r.randrange(360)) for i in range(150)] + [("gone", -5, open_[3], 0)]
    df = spark.createDataFrame(agents, "agent string, curr long, dest long, heading int")
    cands = step.candidates(df, graph.visibility(cells, 5), cells, g)
    want = {x.agent: x.next for x in (step.softmax_step if temperature else step.best_step)(cands, p).collect()}
    got = {x.agent: x.next for x in walk.next_steps(df, cells, g, p, side=side, digits=9).collect()}
    assert {a: n for a, n in got.items() if a in want} == want and len(want) > 100 and "gone" not in got


def random_ground(seed, barred):
    r = random.Random(seed)
    rows = [(100 + 7 * i, q, s, r.randrange(10**6), r.choice([1.0, 1.0, 2.5, 4.0] + [IMPASSABLE] * barred)) for i, (q, s) in enumerate(grid.disk_offsets(8))]
    return [(*x[:3], k, x[4], {1.0: 1.0, 2.5: 0.6, 4.0: 0.3}.get(x[4], 0.0)) for x in rows for k in [sorted(y[3] for y in rows).index(x[3])]]


@pytest.mark.parametrize("p", [SimulationParams(vision_depth=4, temperature=0), SimulationParams(vision_depth=15), SimulationParams(vision_depth=3, field_of_view=60, temperature=0.25, wave_in_seed=True)])
def test_walk_equals_the_plain_replay(spark, p):
    import dataclasses

    p = dataclasses.replace(p, agents_per_weight_unit=3)
    for seed, barred, side in ((1, 0, walk.SIDE), (2, 2, 9)):  # one tile, and many
        rows = random_ground(seed, barred)
        cells = spark.createDataFrame(rows, "cell_id long, q int, r int, ord int, friction double, affordance double").repartition(5)
        g = plain_walk.Ground.of(cells.toPandas())
        reached = [c for c, f in zip(g.ids.tolist(), g.distances(int(g.ids[len(g.ids) // 2])), strict=True) if f < float("inf")]
        picked = [(k, reached[k * len(reached) // 6], kind, 1 + k) for k, kind in enumerate(["origin", "destination", "dual", "origin", "destination", "dual"])]
        n = spark.createDataFrame(picked, "node_ord int, cell_id long, type string, weight int")
        fields = graph.gradient(cells, plan.destinations(n).select(F.col("cell_id").alias("dest")))
        pairs = plan.apportion(plan.reachable_od(n, cells, fields), p.agents_per_weight_unit).join(plan.od_matrix(n, cells), ["origin", "dest"])
        known = [tuple(x) for x in pairs.select("origin", "dest", "assigned", "grid_dist", plan.max_ticks(F.col("grid_dist"), F.lit(len(rows)))).collect()]
        got = {(x.dest, x.cell_id): x.n for x in walk.simulate(cells, n, p, waves=2, side=side).collect()}
        assert got == plain_walk.simulate(cells.toPandas(), known, p, 2) and len(got) > 20


def test_percentiles_of_a_long_tail(spark):
    r = random.Random(2)
    rows = [("a", r.paretovariate(0.4)) for _ in range(3000)] + [("b", float(r.randrange(3))) for _ in range(500)] + [("c", 5.0), ("d", None), ("a", 1e300)]
    got = {x.event_type: tuple(x)[1:] for x in report.latencies(spark.createDataFrame(rows, "event_type string, value double").repartition(4)).collect()}
    for k in "abc":
        own = sorted(v for kind, v in rows if kind == k)
        assert got[k] == (len(own), *[own[math.ceil(len(own) * s) - 1] for s in (0.5, 0.95, 0.99)], own[-1])
    assert set(got) == {"a", "b", "c"}


def test_wear_and_decay_bounds(spark):
    rows = [(1, 1.0, 1.0), (2, 2.5, 0.9), (3, 4.0, 0.3), (4, IMPASSABLE, 0.0), (5, 2.4, 0.02)]
    cells = spark.createDataFrame(rows, "cell_id long, friction double, affordance double")
    desire = spark.createDataFrame([(i, 1000) for i in range(1, 6)], "cell_id long, score long")
    worn = {r.cell_id: r.affordance for r in wear.wear(cells, desire).collect()}
    assert worn[1] == 1.0 and worn[4] == 0.0 and worn[2] == 0.85 and worn[3] == pytest.approx(0.3 + 5 / 150)
    rested = {r.cell_id: r.affordance for r in wear.decay(cells).collect()}
    assert rested[1] == 1.0 and rested[5] == 0.1 and rested[3] == pytest.approx(0.3 * math.exp(-0.0005))


def test_node_edits(spark):
    n = plan_nodes(spark)
    new = spark.createDataFrame([(9, 1, "dual", 4.0), (10, 2, "dual", 99.0), (11, 2, "origin", 1.0)], "node_ord int, cell_id long, type string, weight double")
    got = {r.cell_id: (r.node_ord, r.weight) for r in nodes.insert(n, new).collect()}
    assert got[1] == (0, 3) and got[2] == (10, 10)
    moved = nodes.relocate(n, spark.createDataFrame([(1, 30), (17, 18)], "cell_id long, to_cell long"))
    assert sorted(r.cell_id for r in moved.collect()) == [1, 18, 30, 50]
    changed = nodes.update(n, spark.createDataFrame([(1, "dual", None), (30, None, 0)], "cell_id long, type string, weight int"))
    assert sorted((r.cell_id, r.type, r.weight) for r in changed.collect()) == [(1, "dual", 3), (17, "destination", 1), (50, "dual", 7)]
    pins = n.withColumns({"x": F.col("cell_id").cast("double"), "y": F.lit(0.0)})
    clicks = spark.createDataFrame([(1, 2.0, 0.0), (2, 500.0, 0.0)], "click_id int, x double, y double")
    assert [tuple(r) for r in nodes.pin_hit(clicks, pins).collect()] == [(1, 0)]


@pytest.mark.parametrize("lot", [4096, 7])
def test_topmost_polygons_equal_a_test_of_every_pair(spark, monkeypatch, lot):
    """Triangles with holes, the same rings at several heights, equal and missing heights, and points far from all; crowded tiles in several tasks."""
    from hexflow.functions import geometry

    monkeypatch.setattr(nodes, "LOT", lot)
    r = random.Random(6)
    corner = lambda x, y, by: {"x": x + r.uniform(-by, by), "y": y + r.uniform(-by, by)}
    shapes = [[[corner(x, y, 9) for _ in range(3)], [corner(x, y, 2) for _ in range(4)], [corner(x, y, 1) for _ in range(2)]][: r.choice((1, 2, 3))] for x, y in [(r.uniform(-20, 20), r.uniform(-20, 20)) for _ in range(40)]]
    shapes += [[[{"x": 0.0, "y": 0.0}, {"x": 30.0, "y": None}, {"x": 8.0, "y": 30.0}, {"x": -9.0, "y": 9.0}]], [], None, [[]]]
    rows = [(i, r.choice((None, *range(8))), r.choice(shapes)) for i in range(150)] + [(200 + i, 9, s) for i, s in enumerate(shapes[-4:])]
    polygons = spark.createDataFrame(rows, "edit_id long, draw_order long, rings array<array<struct<x: double, y: double>>>")
    at = [(i, r.uniform(-25, 25), r.uniform(-25, 25)) for i in range(400)] + [(500, None, 1.0), (501, 1e6, 1e6), (3, 0.0, 0.0)]
    points = spark.createDataFrame(at, "point_id long, x double, y double")
    every = points.crossJoin(polygons.where("size(rings) > 0 and not exists(flatten(rings), p -> p.y is null)")).where(geometry.in_polygon(F.col("x"), F.col("y"), F.col("rings")))
    want = every.groupBy("point_id").agg(F.max_by("edit_id", F.struct("draw_order", "edit_id")).alias("edit_id"))
    got = nodes.pick_polygon(points, polygons)
    found = sorted(tuple(x) for x in got.collect())
    assert len(found) > 100 and found == sorted(tuple(x) for x in want.collect())
    assert "aggregate(" not in got._jdf.queryExecution().optimizedPlan().toString()  # no pair is tested by an interpreted fold


def test_exports(spark, tmp_path):
    rows = spark.createDataFrame([(5, 0, 0, 3, 0.5, 1.0)], "cell_id long, q int, r int, score long, affordance double, friction double")
    f = json.loads(geojson.cell_features(rows).first().feature)
    ring = f["geometry"]["coordinates"][0]
    assert len(ring) == 7 and ring[0] == ring[-1] and f["properties"] == {"h3": 5, "desireScore": 3, "affordance": 0.5, "friction": 1.0}
    geojson.write(geojson.cell_features(rows), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 1
    answer = spark.createDataFrame([('{"features": [{"bbox": [1, 2, 3, 6], "geometry": {"coordinates": [9, 9]}, "properties": {"display_name": "a"}}, {"geometry": {"coordinates": [7, 8]}, "properties": {"display_name": "b"}}]}',)], "answer string")
    assert [tuple(r) for r in geocoder.places(answer).collect()] == [("a", 2.0, 4.0), ("b", 7.0, 8.0)]
    merged = report.merge_desire(*(spark.createDataFrame(x, "cell_id string, score long") for x in ([("x", 1), ("y", 2)], [("y", 3), ("z", 4)])))
    assert {r.cell_id: r.score for r in merged.collect()} == {"x": 1, "y": 5, "z": 4}


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i % 5, f"2024-01-01 {i % 24:02d}:15:00", i, i, "a" if i % 2 else "b") for i in range(200)]
    traces = spark.createDataFrame(rows, "user_id long, ts string, step long, cell_id long, kind string").withColumn("ts", F.to_timestamp("ts"))
    traces.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(traces.schema).parquet(str(tmp_path / "in"))
    q = windowed_counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    assert q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, windowed_counts(traces).collect()))
    assert sessions(traces).agg(F.sum("n")).first()[0] == 200


def test_mapping_and_run(spark):
    from hexflow.plans import mapping, simulation

    cells = raster.aoi_cells(spark, [[(-4, -4), (5, -4), (5, 5), (-4, 5)]])
    rows = [(1, "waterway", "river", "LineString", [[{"x": -4.0, "y": 2.0}, {"x": 1.0, "y": 2.0}]]), (2, "transportation", "path", "LineString", [[{"x": -4.0, "y": -2.0}, {"x": 4.0, "y": -2.0}]])]
    f = spark.createDataFrame(rows, "feature_id long, source_layer string, class string, geom_type string, rings array<array<struct<x: double, y: double>>>").select("*", *[F.lit(None).cast("string").alias(c) for c in C.PROPS if c not in ("source_layer", "class")])
    state = mapping.build(f, cells).state.persist()
    assert state.count() == cells.count() and state.where("friction >= 999999").count() > 0 and state.where("friction < 1").count() == 0
    ids = [r.cell_id for r in state.where("friction < 999999").orderBy("ord").collect()]
    n = spark.createDataFrame([(0, ids[0], "origin", 1), (1, ids[-1], "destination", 1)], "node_ord int, cell_id long, type string, weight int")
    run = simulation.run(state, n, SimulationParams(vision_depth=2, agents_per_weight_unit=5), waves=2)
    assert run.desire.agg(F.sum("score")).first()[0] == run.contrib.agg(F.sum("n")).first()[0] > 0
    assert run.peak().first().peak >= 1 and run.unreachable.count() == 0 and run.cells.count() == state.count()


def _inside(x, y, ring):
    flips = 0
    for (ax, ay), (bx, by) in zip(ring, [ring[-1], *ring[:-1]], strict=True):
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            flips += 1
    return len(ring) > 2 and flips % 2 == 1


def _shapes(seed, n=40):
    """Stars that cross themselves, with holes that overlap each other or stick out."""
    r = random.Random(seed)
    star = lambda x, y, s: [(x + r.uniform(-s, s), y + r.uniform(-s, s)) for _ in range(r.randint(3, 9))]
    out = []
    for i in range(n):
        x, y = r.uniform(-15, 15), r.uniform(-15, 15)
        out.append((i, [star(x, y, 6)] + [star(x + r.uniform(-3, 3), y, 3) for _ in range(r.choice((0, 0, 1, 3)))]))
    s = math.sqrt(3) / 2
    # corners on centres, level edges on rows, a repeated first point
    out.append((n, [[(0.0, 0.0), (4.0, 0.0), (4.0 + 1.5, 3 * s), (1.5, 3 * s), (0.0, 0.0)], [(2.0, s), (3.0, s), (2.5, 2 * s)]]))
    return out


def _polygons(spark, shapes):
    schema = "id int, rings array<array<struct<x: double, y: double>>>"
    return spark.createDataFrame([(i, rings and [[p and {"x": p[0], "y": p[1]} for p in ring] for ring in rings]) for i, rings in shapes], schema)


@pytest.mark.parametrize("box", [None, (-6.0, -4.2, 7.5, 9.1)])
def test_scanlines_equal_a_point_test_a_cell(spark, box):
    shapes = _shapes(3)
    twice = [*shapes, shapes[0], (99, [[(0.0, 0.0), (1.0, 1.0)]]), (98, []), (97, None), (96, [[(0.0, 0.0), (9.0, None), (0.0, 9.0)]])]
    got = sorted(tuple(r) for r in raster.polygon_cells(_polygons(spark, twice), ["id"], box=box).select("id", "q", "r").collect())
    want = []
    for i, rings in [*shapes, shapes[0]]:
        for q in range(-60, 60):
            for r in range(-40, 40):
                x, y = q + r / 2.0, math.sqrt(3) / 2 * r
                if (box is None or box[0] <= x <= box[2] and box[1] <= y <= box[3]) and _inside(x, y, rings[0]) and not any(_inside(x, y, h) for h in rings[1:]):
                    want.append((i, q, r))
    assert got == sorted(want) and len(want) > 150


def test_boxed_lines_have_the_same_cells_within(spark):
    r = random.Random(6)
    ends = [(i, *(r.randint(-40, 40) for _ in range(4))) for i in range(80)]
    df, box = spark.createDataFrame(ends, "id int, q0 int, r0 int, q1 int, r1 int"), (-9.0, -5.0, 6.0, 12.0)
    held = lambda q, r: box[0] <= q + r / 2 <= box[2] and box[1] <= math.sqrt(3) / 2 * r <= box[3]
    whole = {tuple(x) for x in raster.segment_cells(df, ["id"]).collect()}
    boxed = [tuple(x) for x in raster.segment_cells(df, ["id"], box=box).collect()]
    assert whole == {(i, *c) for i, *e in ends for c in grid.path_cells(*e)}
    assert {x for x in boxed if held(*x[1:])} == {x for x in whole if held(*x[1:])} and set(boxed) < whole


def test_fast_scan_by_hand(spark):
    """Holes, parts, lines that leave the area, several layers; the same whatever the area cuts off."""
    square = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]
    shapes = [
        (1, "park", None, "Polygon", [square(-30, -30, 60), square(0.6, 0.6, 3.0)]),
        (2, "building", None, "Polygon", [square(-2.2, -2.2, 2.0)]),
        (2, "building", None, "Polygon", [square(3.1, -2.2, 2.0)]),
        (3, "transportation", "path", "LineString", [[(-50.0, 0.0), (50.0, 0.0)]]),
        (4, "ocean", None, "Polygon", [square(-30, -30, 60)]),
        (5, "water", None, "Polygon", None),
    ]
    rows = [(i, s, c, None, None, None, None, None, None, None, g, rings and [[{"x": float(x), "y": float(y)} for x, y in ring] for ring in rings]) for i, s, c, g, rings in shapes]
    from hexflow.schema import TABLES

    features = spark.createDataFrame(rows, TABLES["features"])
    cells = disk_cells(spark, 6)
    hits, corridor = raster.fast_scan(features, cells)
    at = {i: (q + r / 2, math.sqrt(3) / 2 * r) for i, (q, r) in enumerate(grid.disk_offsets(6))}
    inside = lambda i, x, y, s: _inside(*at[i], square(x, y, s))
    want = sorted(
        [(i, "0", 2.5) for i in at if not inside(i, 0.6, 0.6, 3.0)]
        + [(i, "0", IMPASSABLE) for i in at if inside(i, -2.2, -2.2, 2.0) or inside(i, 3.1, -2.2, 2.0)]
        + [(i, "0", 1.0) for i in at if abs(at[i][1]) < 0.1]
    )
    assert sorted(tuple(r) for r in hits.collect()) == want
    assert {r.cell_id for r in corridor.collect()} == {i for i in at if abs(at[i][1]) < 0.1}
    none, ways = raster.fast_scan(features, cells.limit(0))
    assert none.count() == ways.count() == 0
