import numpy as np
import pytest

from hexflow.llm import ann

SCHEMA = "vec_id long, embedding array<float>, score double"


def brute(rows, k, is_query):
    fine = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows if i is not None and v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in fine:
        if is_query(i):
            s = sorted(((-float(ann.inner(v[None], w[None])[0]), j) for j, w in fine if j != i))[:k]
            out.setdefault(i, [(j, -x) for x, j in s])
    return out


def search(spark, rows, k=5, parts=3):
    df = spark.createDataFrame([(i, v, 0.0) for i, v in rows], SCHEMA).repartition(parts)
    out = {}
    for r in sorted(ann.search(df, lambda i: i % 20 == 0, k=k).collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_one_list_is_exact_with_ties_and_odd_rows(spark):
    r = np.random.default_rng(1)
    rows = [(i, r.normal(size=8).astype(np.float32).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[20][1]) for i in range(40)] + [(2000 + i, rows[20][1]) for i in range(3)]
    odd = [(400, None), (420, [0.0] * 8), (440, [float("nan")] * 8), (460, [1.0]), (480, [None] + [1.0] * 7), (500, [float("inf")] * 8), (None, [1.0] * 8), (520, [])]
    got, want = search(spark, rows + odd), brute(rows, 5, lambda i: i % 20 == 0)
    assert got.keys() == want.keys()
    for q, own in want.items():
        assert [j for j, _ in got[q]] == [j for j, _ in own] and [s for _, s in got[q]] == pytest.approx([s for _, s in own], rel=1e-12)


def test_recall_over_many_lists_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "PER_LIST", 60)
    monkeypatch.setattr(ann, "BLOCK", 50)
    r = np.random.default_rng(2)
    rows = [(i, (r.normal(size=8) * r.uniform(0.5, 2)).astype(np.float32).tolist()) for i in range(1500)]
    got, want = search(spark, rows), brute(rows, 5, lambda i: i % 20 == 0)
    hit = sum(len({j for j, _ in got[q]} & {j for j, _ in own}) for q, own in want.items())
    assert hit >= 0.9 * sum(map(len, want.values()))
    assert all(np.isclose(s, ann.inner(np.array([rows[q][1]], np.float32).astype(float), np.array([rows[j][1]], np.float32).astype(float))[0]) for q in got for j, s in got[q])


def test_few_and_no_vectors(spark):
    assert search(spark, [(0, [1.0] * 8), (1, [2.0] * 8)]) == {0: [(1, 16.0)]}
    assert search(spark, [(0, [1.0] * 8)]) == {} and search(spark, [(0, None)]) == {}


@pytest.mark.parametrize("spread", [0.0, 6.0])
def test_recall_with_a_sample_far_below_the_rows(spark, monkeypatch, spread):
    for name, value in (("SAMPLE", 150), ("PER_LIST", 60), ("BLOCK", 50), ("TOGETHER", 4)):
        monkeypatch.setattr(ann, name, value, raising=False)
    r = np.random.default_rng(3)
    middle = r.normal(size=(12, 8)) * spread
    rows = [(i, (middle[i % 12] + r.normal(size=8)).astype(np.float32).tolist()) for i in range(3000)]
    got, want = search(spark, rows), brute(rows, 5, lambda i: i % 20 == 0)
    hit = sum(len({j for j, _ in got[q]} & {j for j, _ in own}) for q, own in want.items())
    assert hit >= 0.9 * sum(map(len, want.values()))
    assert all(len(own) == 5 for own in got.values())


def test_few_candidates_in_the_probed_lists(spark, monkeypatch):
    monkeypatch.setattr(ann, "PER_LIST", 2)
    monkeypatch.setattr(ann, "RECALL", 0.0)
    r = np.random.default_rng(4)
    got = search(spark, [(i, r.normal(size=8).astype(np.float32).tolist()) for i in range(60)])
    assert all(len(own) == 5 for own in got.values()) and len(got) == 3


def test_only_probed_lists_give_neighbours(spark, monkeypatch):
    fit, made = ann.fit, []

    def one_probe(*args):
        made.append(fit(*args))
        made[0].probes = 1
        return made[0]

    monkeypatch.setattr(ann, "fit", one_probe)
    monkeypatch.setattr(ann, "PER_LIST", 60)
    r = np.random.default_rng(5)
    rows = [(i, r.normal(size=8).astype(np.float32).tolist()) for i in range(600)]
    got, v = search(spark, rows), np.array([v for _, v in rows])
    home, asked = (made[0].nearest(made[0].place(v, query=q), 1)[:, 0] for q in (False, True))
    assert len(got) == 30 and all(home[j] == asked[q] for q, own in got.items() for j, _ in own)
