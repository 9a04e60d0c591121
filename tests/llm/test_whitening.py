import numpy as np
import pytest

from hexflow.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, x string, id int, whitened int"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], SCHEMA).repartition(parts)


def brute(rows):
    """The contract on lists: per row its deviation and centred x, and the eigenvalues with their vectors."""
    x = {i: [int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for i, v in rows}
    listed = sorted(set(map(tuple, x.values())))
    n, sums = len(listed), [sum(c) for c in zip(*listed, strict=True)]
    centred = np.array([[(n * c - s) / n for c, s in zip(v, sums, strict=True)] for v in listed])
    e, w = np.linalg.eigh(centred.T @ centred / n)
    dev = {i: sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for i, v in x.items()}
    off = {i: np.array([(n * c - s) / n for c, s in zip(v, sums, strict=True)]) for i, v in x.items()}
    return n, dev, off, e[::-1], w[:, ::-1], centred


def agree(got, model, rows, k):
    n, dev, off, e, w, _ = brute(rows)
    assert model.n == n and model.components.shape[1] == k
    assert model.explained == pytest.approx(e[:k] / e.sum(), rel=1e-9)
    signs = np.sign((model.components * w[:, :k]).sum(axis=0))
    for r in got:
        assert r.deviation == dev[r.id]
        assert np.array(r.whitened) * signs == pytest.approx(off[r.id] @ w[:, :k] / np.sqrt(e[:k]), rel=1e-6, abs=1e-8)


def vectors(n, d=9, seed=0):
    r = np.random.default_rng(seed)
    mix = r.normal(size=(d, d)) * np.geomspace(3, 0.2, d)
    return [(i, (r.normal(size=d) @ mix).astype(np.float32).tolist()) for i in range(n)]


def test_equals_brute_force_and_repeats_are_fitted_once(spark):
    rows = vectors(400)
    rows += [(1000 + i, rows[7][1]) for i in range(500)] + [(7, rows[7][1])]
    df, model = whitening.whiten(frame(spark, rows), 4)
    got = df.collect()
    assert len(got) == len(rows)
    agree(got, model, dict(rows).items(), 4)
    assert model.identity_error < 1e-9


def test_covariance_of_the_list_is_the_identity(spark):
    rows = vectors(300, seed=3)
    df, model = whitening.whiten(frame(spark, rows))
    z = np.array([r.whitened for r in df.collect()])
    *_, centred = brute(rows)
    own = centred @ (model.components / np.sqrt(model.values))
    assert np.abs(own.T @ own / model.n - np.eye(9)).max() < 1e-9 and z.shape == (300, 9)


def test_odd_rows_take_no_part(spark):
    rows = vectors(60, seed=1)
    odd = [(100, None), (101, []), (102, [1.0, None] + [0.0] * 7), (103, [float("nan")] * 9), (104, [float("-inf")] + [0.0] * 8), (105, [1.0] * 8)]
    df, model = whitening.whiten(frame(spark, rows + odd + [(None, rows[0][1])]), 3)
    got = df.collect()
    assert sum(r.id is None for r in got) == 1 and {r.id for r in got} - {None} == {i for i, _ in rows}
    agree([r for r in got if r.id is not None], model, rows, 3)


def test_constant_dimensions_and_few_vectors_give_fewer_components(spark):
    rows = [(i, [float(i), 2.0 * i, 5.0]) for i in range(10)]
    df, model = whitening.whiten(frame(spark, rows), 3)
    agree(df.collect(), model, rows, 1)
    two = [(1, [0.0, 1.0, 0.5, 0.25]), (2, [1.0, 0.0, 0.5, 0.25])]
    df, model = whitening.whiten(frame(spark, two))
    agree(df.collect(), model, two, 1)


def test_one_vector_and_empty_table(spark):
    df, model = whitening.whiten(frame(spark, [(i, [0.5, 1.5]) for i in range(20)]))
    assert model.n == 1 and [(r.deviation, r.whitened) for r in df.collect()] == [(0, [])] * 20
    df, model = whitening.whiten(frame(spark, []))
    assert model.n == 0 and df.collect() == []


def test_huge_entries_give_no_wrong_deviation(spark):
    rows = [(0, [3e38, 0.0]), (1, [-3e38, 1.0]), (2, [0.0, 0.5])]
    df, model = whitening.whiten(frame(spark, rows))
    got = {r.id: r.deviation for r in df.collect()}
    assert got[0] is None and got[1] is None and got[2] is not None


def test_query_on_given_tables(spark):
    got = whitening.op11_row_matrix(spark, "/root/testdata/sf0.001").toPandas()
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    n, dev, off, e, w, _ = brute(rows)
    assert len(got) == 16 * len(rows) and set(got.component) == set(range(1, 17)) and set(got.n) == {n}
    assert all(got.deviation == got.vec_id.map(dev)) and got.identity_error.max() < 1e-4
    assert got.groupby("component").explained.first().to_numpy() == pytest.approx(e[:16] / e.sum(), rel=1e-9)
    for c, own in got.groupby("component"):
        want = np.array([off[i] @ w[:, c - 1] / np.sqrt(e[c - 1]) for i in own.vec_id])
        z = own.whitened.to_numpy()
        assert z * np.sign(z @ want) == pytest.approx(want, rel=1e-5, abs=1e-7)
