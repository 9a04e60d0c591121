"""Embedding whitening over exact integers, with MLlib's RowMatrix.

Entries become integers, x = floor(64 c) + 1,000,000, and the model is fitted on each distinct x vector once.
Sums over that list are exact integers, so rows are centred without error but the last rounding: what is left
of S after whole multiples of n is divided by n.  ``RowMatrix.computeGramianMatrix`` of the centred rows over n is the covariance;
its eigenvectors come from a local ``eigh`` (the matrix is dimensions squared, whatever the number of rows), and
``mapInPandas`` projects every row on them, with means and components broadcast (dimensions x components numbers).
How far the whitened list's own covariance is from the identity is measured by a second Gramian, not assumed.

Defined results: rows whose vector is null, empty or holds a null or non-finite entry take no part, nor do
those whose length is not the most frequent one (the smallest of these, if several); entries beyond ``MOST`` count as that.
Rows that repeat a vector are whitened each and fitted once; ids may be null or repeat.  A component needs more than
``LEAST`` of the largest eigenvalue, below which doubles can't tell it from nought: constant dimensions and too few
vectors give fewer components, a single distinct vector or an empty table none.  A deviation that no long holds is null.  Columns of the
input besides id and vector don't matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexflow.llm.shared import Tables

SCALE, SHIFT = 64, 1_000_000
#: Largest size of a scaled entry; least part of the largest eigenvalue that is told from nought; components of the query.
MOST, LEAST, COMPONENTS = 1 << 40, 1e-10, 16
#: Rows that are multiplied at once.
BLOCK = 4096


@dataclass
class Whitening:
    """Vectors in the fit list, their exact sums, and the components by falling eigenvalue (a column each)."""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float

    @property
    def explained(self) -> np.ndarray:
        return self.values / self.trace if len(self.values) else self.values

    def centre(self) -> tuple[np.ndarray, np.ndarray]:
        """The means as whole numbers, and what the sums have beyond n times these."""
        return _centre(self.n, self.sums)


def _centre(n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    whole = [s // n for s in sums]
    return np.array(whole, dtype=np.int64), np.array([s - n * w for s, w in zip(sums, whole, strict=True)], dtype=np.int64)


def integers(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, x``: the rows that take part, their entries as integers."""
    fine = F.forall(vector_col, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)))  # NaN is above infinity
    given = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where((F.size("v") > 0) & fine)
    lengths = given.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    scaled = lambda c: F.greatest(F.lit(-float(MOST)), F.least(F.lit(float(MOST)), c.cast("double") * SCALE))
    return given.where(F.size("v") == (lengths.d if lengths else 0)).select("id", F.transform("v", lambda c: F.floor(scaled(c)) + F.lit(SHIFT).cast("long")).alias("x"))


def _sums(listed: DataFrame) -> tuple[int, list[int]]:
    """How many vectors, and the exact sum of each dimension; every task sends one row of partial sums."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total = 0, None
        for b in batches:
            for a in range(0, len(b), BLOCK):
                part = np.vstack(b.x.iloc[a : a + BLOCK].to_numpy()).sum(axis=0).tolist()  # BLOCK * MOST fits a long
                total = part if total is None else [p + q for p, q in zip(total, part, strict=True)]
            n += len(b)
        if n:
            yield pd.DataFrame({"part": [[str(v) for v in [n, *total]]]})

    parts = listed.mapInPandas(partial, "part array<string>").select(F.posexplode("part").alias("i", "s"))
    rows = parts.groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()  # one row a dimension
    n, *sums = [int(r.s) for r in sorted(rows, key=lambda r: r.i)] or [0]
    return n, sums


def fit(x: DataFrame, components: int | None = None) -> Whitening:
    """The whitening of the distinct vectors of ``x``; by default, all components that can be told from nought."""
    tables = Tables(x.sparkSession)
    listed = tables.keep(x.select("x").distinct())
    try:
        return _fitted(listed, components)
    finally:
        tables.drop(listed)


def _fitted(listed: DataFrame, components: int | None) -> Whitening:
    n, sums = _sums(listed)
    d = len(sums)
    if n < 2:
        return Whitening(n, sums, np.zeros(0), np.zeros((d, 0)), 0.0, 0.0)
    whole, rest = _centre(n, sums)
    mean, left = F.lit(whole.tolist()), F.lit((rest / n).tolist())
    # x less the whole part of its mean is an exact integer; only taking off the rest rounds
    centred = F.zip_with(F.zip_with("x", mean, lambda a, b: (a - b).cast("double")), left, lambda a, b: a - b)
    rows = MLUtils.convertVectorColumnsFromML(listed.select(array_to_vector(centred).alias("row")), "row")
    matrix = RowMatrix(rows, n, d)
    values, vectors = np.linalg.eigh(matrix.computeGramianMatrix().toArray() / n)
    values, vectors, trace = values[::-1], vectors[:, ::-1], float(values.sum())
    k = int((values > LEAST * values[0]).sum()) if values[0] > 0 else 0
    k = k if components is None else min(k, components)
    values, vectors = values[:k], vectors[:, :k]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(k)])
    out = Whitening(n, sums, values, vectors, trace, 0.0)
    if k:
        after = matrix.multiply(DenseMatrix(d, k, (vectors / np.sqrt(values)).ravel(order="F"))).computeGramianMatrix().toArray() / n
        out.identity_error = float(np.abs(after - np.eye(k)).max())
    return out


def apply(x: DataFrame, model: Whitening) -> DataFrame:
    """``id, deviation, whitened``: the exact square of n times a row's distance from the mean, and its whitened vector."""
    if not model.n:
        return x.select("id", F.lit(None).cast("long").alias("deviation"), F.array().cast("array<double>").alias("whitened"))
    shared = x.sparkSession.sparkContext.broadcast(model)

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        whole, rest = m.centre()
        weights = m.components / np.sqrt(m.values)
        for batch in batches:
            for a in range(0, len(batch), BLOCK):
                b = batch.iloc[a : a + BLOCK]
                if len(b):
                    off = np.vstack(b.x.to_numpy()) - whole
                    fits = ((off * float(m.n) - rest) ** 2).sum(axis=1) < 9e18
                    exact = off * np.where(fits, m.n, 0)[:, None] - rest
                    deviation = pd.array((exact * exact).sum(axis=1), dtype="Int64")
                    deviation[~fits] = pd.NA
                    yield pd.DataFrame({"id": b.id.to_numpy(), "deviation": deviation, "whitened": list((off - rest / m.n) @ weights)})

    return x.mapInPandas(project, f"id {x.schema['id'].dataType.simpleString()}, deviation long, whitened array<double>")


def whiten(vectors: DataFrame, components: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, Whitening]:
    """The whitened rows and the model they come from."""
    x = integers(vectors, id_col, vector_col)
    model = fit(x, components)
    return apply(x, model), model


def op11_row_matrix(spark, sf_dir: str) -> DataFrame:
    rows, model = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), COMPONENTS)
    explained = F.element_at(F.lit(model.explained.tolist()).cast("array<double>"), F.col("component"))
    each = rows.select("id", "deviation", F.posexplode("whitened").alias("i", "whitened")).withColumn("component", F.col("i") + 1)
    return each.select(F.col("id").alias("vec_id"), "component", F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(model.identity_error).alias("identity_error"))
