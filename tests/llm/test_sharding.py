import zlib
from collections import Counter, defaultdict

import pytest

from hexflow.llm import sharding

SCHEMA = "doc_id long, text string, size string, shard int"


def cut(spark, rows, n=4, parts=3, **kw):
    df = spark.createDataFrame([(i, t, "s", -1) for i, t in rows], SCHEMA).repartition(parts)
    return sharding.shard(df, n, **kw).collect()


def check(rows, got, n, share=None):
    """Whole, gapless, with right sizes; bytes as near as the largest row and the tolerance allow."""
    size = lambda t: len((t or "").encode()) + 16
    assert Counter((r.id, r.size, r.text_crc32) for r in got) == Counter((i, size(t), zlib.crc32((t or "").encode())) for i, t in rows)
    slots, filled = defaultdict(list), Counter()
    for r in got:
        slots[r.shard].append(r.slot)
        filled[r.shard] += r.size
    assert set(slots) <= set(range(n))
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    total = sum(size(t) for _, t in rows)
    most = max(size(t) for _, t in rows) + 2 * sharding.TOLERANCE * total / n
    assert all(abs(filled[s] - total / n) <= most for s in range(n))




@pytest.mark.parametrize("n", [1, 2, 7, 40])
def test_bytes_are_even_and_slots_gapless(spark, n):
    rows = [(i, "word é " * (i * 7919 % 97)) for i in range(3000)]
    check(rows, cut(spark, rows, n), n)


def test_rounds_reach_the_nearest_cut_by_brute_force(spark, monkeypatch):
    """With no tolerance every splitter is the row boundary nearest its target, whatever the number of probes."""
    monkeypatch.setattr(sharding, "PROBES", 64)
    rows = [(i, "x" * (i * 31 % 53)) for i in range(400)] + [(1000 + i, "same text") for i in range(300)] + [(5, "again")] * 50
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sized = sharding.Tables(spark).keep(sharding.sized(df, "doc_id", "text", False))
    local = sorted((r["_h"], r["_d"], r["_row"], r["size"]) for r in sized.collect())
    total, n = sum(r[3] for r in local), 9
    sums, edges = 0, []
    for r in local:
        edges.append((sums, r[:3]))
        sums += r[3]
    edges.append((sums, None))
    for k, place in enumerate(sharding.splitters(sized, n, total, 0.0), 1):
        below = sum(r[3] for r in local if r[:3] < place)
        assert abs(below - total * k / n) == min(abs(b - total * k / n) for b, _ in edges)


def test_hot_groups_are_split_and_others_stay_together(spark):
    rows = [(i, "a hot text") for i in range(2000)] + [(10_000 + i, f"text {i // 2}") for i in range(4000)]
    got = cut(spark, rows, 8, keep=True)
    check(rows, got, 8)
    at = defaultdict(set)
    for r in got:
        at[r.doc.text].add(r.shard)
    assert len(at["a hot text"]) >= 3
    assert sum(len(s) > 1 for s in at.values()) <= 7


def test_repeated_rows_nulls_and_clashing_columns(spark):
    rows = [(7, "once more")] * 900 + [(None, None)] * 300 + [(8, ""), (9, None), (None, "text")]
    got = cut(spark, rows, 4, keep=True)
    check(rows, got, 4)
    assert got[0].doc.size == "s" and got[0].doc.shard == -1
    assert len({r.shard for r in got if r.id == 7}) > 1


def test_one_row_outweighs_the_others(spark):
    rows = [(0, "z" * 200_000)] + [(i, "q") for i in range(1, 30)]
    got = cut(spark, rows, 5)
    check(rows, got, 5)
    assert len(got) == 30


def test_the_same_whatever_the_partitions(spark):
    rows = [(i, f"text {i % 211}") for i in range(1500)]
    one, five = ({r.id: r.shard for r in cut(spark, rows, 6, parts=p)} for p in (1, 5))
    assert one == five


def test_pieces_hold_a_bounded_number_of_rows(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PIECE", 10)
    rows = [(i, "t" * (i % 5)) for i in range(700)]
    check(rows, cut(spark, rows, 3), 3)


def test_empty_table(spark):
    assert cut(spark, [], 4) == []


def test_no_python_in_the_plan(spark):
    plan = sharding.op12_histogram_sort(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_query_on_given_tables(spark):
    df = sharding.op12_histogram_sort(spark, "/root/testdata/sf0.01")
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    got = df.withColumnRenamed("doc_id", "id").collect()
    check(rows, got, 40)
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
