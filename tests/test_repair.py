"""Repaired fields equal those computed anew."""

import random

import pytest
from test_fields import SCHEMA, area

from hexflow.operators import fields, repair
from hexflow.params import IMPASSABLE


def anew(spark, rows, dests):
    return sorted(map(tuple, fields.gradient(spark.createDataFrame(rows, SCHEMA), dests).collect()))


def check(spark, rows, after, goals, side):
    dests = spark.createDataFrame([(d,) for d in goals], "dest long")
    before, changed = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(after, SCHEMA)
    got = repair.repair(fields.gradient(before, dests), dests, before, changed, side)
    assert sorted(map(tuple, got.collect())) == anew(spark, after, dests)


@pytest.mark.parametrize(("seed", "side", "share"), [(1, 8, 0.03), (2, 6, 0.3), (4, 64, 0.1)])
def test_painted_and_removed_surfaces(spark, seed, side, share):
    """Cells made harder, easier, closed and opened at once; goals among them."""
    rows, r = area(seed), random.Random(seed)
    after = [(*x[:4], r.choice((1.0, 2.5, 4.0, IMPASSABLE)) if r.random() < share else x[4]) for x in rows]
    goals = r.sample([x[0] for x in rows], 12)
    check(spark, rows, after, goals, side)


@pytest.mark.parametrize("new", [IMPASSABLE, 4.0])
def test_one_wall_or_a_gap_in_it(spark, new):
    rows = [(20 * q + r, q, r, 20 * q + r, 2.5) for q in range(20) for r in range(20)]
    after = [(*x[:4], new if x[1] == 9 and x[2] != 3 else x[4]) for x in rows]
    check(spark, rows, after, [0, 399, 187], 8)
    check(spark, after, rows, [0, 399, 187], 8)


def test_cells_that_come_and_go_and_goals_that_open_and_close(spark):
    rows = area(6)
    after = [(*x[:4], IMPASSABLE if x[0] == rows[4][0] else 1.0) for x in rows if x[1] != -3] + [(9000 + i, 20 + i, 3, 9000 + i, 1.0) for i in range(6)]
    check(spark, rows, after, [rows[4][0], rows[30][0], rows[-2][0], 9003, *[x[0] for x in rows if x[4] == IMPASSABLE][:3]], 9)


def test_nothing_changed_and_nothing_there(spark):
    rows = area(7)
    check(spark, rows, rows, [rows[0][0], rows[50][0]], 16)
    check(spark, rows, [], [rows[0][0]], 16)
    check(spark, [], rows, [rows[0][0], rows[1][0]], 16)
    check(spark, rows, rows, [], 16)


@pytest.mark.parametrize("rounds", [0, 2])
def test_an_edit_that_reaches_far_takes_no_more_rounds(spark, monkeypatch, rounds):
    """A strip of 40 tiles: its first cells become harder or a gap opens, and every distance from its start changes."""
    from hexflow.sources.shared import Steps

    monkeypatch.setattr(repair, "ROUNDS", rounds)
    rows = [(3 * r + q, q, r, 3 * r + q, 1.0) for q in range(3) for r in range(160)]
    after = [(*x[:4], 4.0 if x[2] == 2 else 2.5 if x[2] == 70 else x[4]) for x in rows]
    kept, keep = [], Steps.keep
    monkeypatch.setattr(Steps, "keep", lambda self, df: kept.append(df.columns) or keep(self, df))
    check(spark, rows, after, [0, 239, 479], 4)
    assert sum("s_tq" in c and "round" in c for c in kept) <= 1 + 2 * rounds


def test_an_edit_of_most_tiles_takes_no_round(spark, monkeypatch):
    monkeypatch.setattr(repair, "_weights", lambda *_: pytest.fail("tiles are repaired one by one"))
    rows = [(3 * r + q, q, r, 3 * r + q, 1.0) for q in range(3) for r in range(160)]
    check(spark, rows, [(*x[:4], 2.5 if x[2] % 8 == 0 else x[4]) for x in rows], [0, 239, 479], 4)
