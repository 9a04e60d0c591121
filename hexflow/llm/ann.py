"""Approximate nearest neighbours by inner product, with an adaptive dimension scan.

Inner products become distances by one more coordinate that fills every vector up to the
largest norm.  A random rotation then spreads each difference evenly over the dimensions, so the
distance over the first d dimensions estimates the whole.  Vectors lie in lists by their
nearest of the centres fitted on a bounded sample; a query probes its nearest lists, as many as held
``RECALL`` of the exact neighbours of ``CALIBRATED`` sample vectors.  Within a list, vectors are scanned in
column blocks, and after each block a hypothesis test abandons the candidates whose partial
distance already speaks, at ``EPSILON`` standard errors, against their reaching the query's k-th
distance, which sinks from list to list of those that a task scans one after the other.  While many pairs live, a block is one matrix product for all queries of the list; then
pairs go on one by one.  The survivors' scores are exact inner products of the original
vectors in double precision.

``TOGETHER`` lists make a shard.  Lists are cut into blocks of ``BLOCK`` vectors by a hash of the id, and each probing
query goes to every block of its shards: no list is too large for a task and none is capped.  Equal
vectors of a hot group are dealt over the blocks too.  Centres and rotation are of fixed size
(``CENTRES_MAX`` at most) and are broadcast; vectors and queries are shuffled.

Defined results: vectors that are null, empty, zero, or hold a null or non-finite component, and those whose
length is not the most frequent one (the smallest of these, if several), take no part; nor do rows without an
id.  Rows that repeat an id are candidates each, and share one ranking as queries; a query's own id never is a
candidate.  Ties go to the
smaller id.  A query whose lists may hold fewer than k candidates probes further ones; a query without candidates gives no row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Sample for the centres, vectors a centre on average, most centres; what the number of probes is calibrated on.
SAMPLE, PER_LIST, CENTRES_MAX, CALIBRATED, RECALL = 20_000, 1_000, 4096, 200, 0.97
BLOCK, TOGETHER, COLUMNS, EPSILON, SPARSE = 2_000, 8, 16, 2.5, 0.25


@dataclass
class Index:
    """The largest norm, the rotation (dimensions + 1 squared), the centres in rotated space, and how the lists are probed.

    ``sizes`` has the sample's vectors in each list; ``most`` is how often an id occurs among them.
    """

    top: float
    rotation: np.ndarray
    centres: np.ndarray
    probes: int
    sizes: np.ndarray
    most: int

    def place(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """Vectors in rotated space; queries have 0 for the filling coordinate."""
        fill = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, self.top**2 - (x * x).sum(axis=1)))
        return (np.hstack([x, fill[:, None]]) @ self.rotation).astype(np.float32)

    def nearest(self, y: np.ndarray, k: int) -> np.ndarray:
        d = (self.centres**2).sum(axis=1) - 2 * y @ self.centres.T
        return np.argsort(d, axis=1, kind="stable")[:, :k]

    def probed(self, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and lists to probe: ``probes`` a row, more where these hold fewer than k others of the sample."""
        rows, lists = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a in range(0, len(y), 1024):
            near = self.nearest(y[a : a + 1024], len(self.centres))
            n = np.maximum(self.probes, 1 + (np.cumsum(self.sizes[near], axis=1) < k + self.most).sum(axis=1))
            i, j = np.nonzero(np.arange(near.shape[1]) < n[:, None])
            rows.append(i + a)
            lists.append(near[i, j])
        return np.concatenate(rows), np.concatenate(lists)


def _ids(column) -> np.ndarray:
    ids = column.to_pylist()
    return np.array(ids, dtype=np.int64 if all(isinstance(i, int) for i in ids) else object)


def matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """``id`` and ``v`` of the vectors that take part, and their length."""
    given = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where("id is not null and v is not null and size(v) > 0")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))) & F.exists("v", lambda x: x != 0)
    given = given.where(fine)
    sizes = given.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return (given.where(F.size("v") == sizes.n), sizes.n) if sizes else (given, 0)


def fit(given: DataFrame, dim: int, k_nearest: int = 20, seed: int = 0) -> Index:
    """Rotation, and k-means centres of at most SAMPLE vectors; the number of lists follows the number of rows."""
    rows, top = given.agg(F.count("*"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))))).first()
    table = given.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("id", "v").toArrow()
    sample = matrix(table.column("v"))
    r = np.random.default_rng(seed)
    rotation = np.linalg.qr(r.normal(size=(dim + 1, dim + 1)))[0]
    index = Index(top, rotation, np.zeros((0, dim + 1), np.float32), 0, np.zeros(0, np.int64), 0)
    y = np.unique(index.place(sample), axis=0)
    k = int(min(CENTRES_MAX, len(y), max(1, rows // PER_LIST)))
    centres = y[r.permutation(len(y))[:k]]
    for _ in range(8):
        near = ((centres**2).sum(axis=1) - 2 * y @ centres.T).argmin(axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, near, y)
        n = np.bincount(near, minlength=k)[:, None]
        centres = np.where(n > 0, total / np.maximum(n, 1), centres).astype(np.float32)
    index.centres = centres
    home = index.nearest(index.place(sample), 1)[:, 0]
    index.sizes, index.most = np.bincount(home, minlength=k), int(np.unique(_ids(table.column("id")), return_counts=True)[1].max())
    # the lists that hold the exact neighbours of some of the sample, in the order in which they would be probed
    some = r.permutation(len(sample))[:CALIBRATED]
    products = sample[some] @ sample.T
    products[np.arange(len(some)), some] = -np.inf
    best = np.argsort(-products, axis=1)[:, :k_nearest]
    order = np.argsort(index.nearest(index.place(sample[some], query=True), k), axis=1)
    turns = np.take_along_axis(order, home[best], axis=1)
    index.probes = int(np.quantile(turns, RECALL)) + 1 if turns.size else k
    return index


def scan(queries: np.ndarray, vectors: np.ndarray, own: np.ndarray, reach: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, vector) of rotated queries and a list's vectors that the tests leave.

    ``own`` marks pairs of one id, ``reach`` has a distance that each query's k nearest do not exceed.
    """
    n, dim = vectors.shape
    # the k-th distance to a first handful bounds what can still be among the k nearest
    first = min(n, max(4 * k, 128))
    head = _squares(queries, vectors[:first])
    head[own[:, :first]] = np.inf
    bound = np.partition(head, min(k, first) - 1, axis=1)[:, min(k, first) - 1]
    bound = np.minimum(reach, bound) if first >= k else reach
    alive, part, pairs = ~own, np.zeros((len(queries), n), np.float32), None
    for a in range(0, dim, COLUMNS):
        b = min(dim, a + COLUMNS)
        # under the rotation, part * dim / b estimates the distance; the test's error falls with the columns read
        limit = bound * (b / dim) * (1 + EPSILON / np.sqrt(b)) ** 2 if b < dim else bound * (1 + 1e-4) + 1e-5
        if pairs is None:
            part += _squares(queries[:, a:b], vectors[:, a:b])
            alive &= part <= limit[:, None]
            if alive.mean() < SPARSE:
                pairs = np.nonzero(alive)
                part = part[pairs]
        else:
            i, j = pairs
            part = part + ((queries[i, a:b] - vectors[j, a:b]) ** 2).sum(axis=1)
            keep = part <= limit[i]
            pairs, part = (i[keep], j[keep]), part[keep]
    if pairs is None:
        pairs = np.nonzero(alive)
        part = part[pairs]
    # a pair beyond its query's k-th distance of those left is not among the k nearest either
    i, j = pairs
    order = np.lexsort((part, i))
    i, j, part = i[order], j[order], part[order]
    start = np.searchsorted(i, np.arange(len(queries)))
    last = np.minimum(start + k - 1, np.searchsorted(i, np.arange(len(queries)), "right") - 1)
    far = np.where(last >= start, part[np.clip(last, 0, max(0, len(part) - 1))] if len(part) else 0, 0)
    keep = part <= far[i] * (1 + 1e-4) + 1e-5
    return i[keep], j[keep]


def _squares(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.maximum((q * q).sum(axis=1)[:, None] + (x * x).sum(axis=1)[None, :] - 2 * (q @ x.T), 0)


def inner(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row by row inner products, added up in the order of the components."""
    total = np.zeros(len(x))
    for j in range(x.shape[1]):
        total += q[:, j] * x[:, j]
    return total


def search(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 0) -> DataFrame:
    """``query_id, rank, id, score``: the k nearest found of each query row, against all rows."""
    given, dim = usable(vectors, id_col, vector_col)
    kind = given.schema["id"].dataType.simpleString()
    if not dim:
        return given.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), "id", F.lit(0.0).alias("score")).limit(0)
    shared = given.sparkSession.sparkContext.broadcast(fit(given, dim, k, seed))

    def listed(batches):
        for batch in batches:
            y = shared.value.place(matrix(batch.column("v")))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(shared.value.nearest(y, 1)[:, 0].astype(np.int64))], names=["id", "v", "list"])

    def probed(batches):
        for batch in batches:
            rows, lists = shared.value.probed(shared.value.place(matrix(batch.column("v")), query=True), k)
            order = np.lexsort((lists % shards, rows))  # one row for all lists of a shard
            rows, lists = rows[order], lists[order]
            cut = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]) | (lists[1:] % shards != lists[:-1] % shards)])) if len(rows) else rows
            own = pa.ListArray.from_arrays(pa.array(np.append(cut, len(lists)).astype(np.int32)), pa.array(lists))
            at = pa.array(rows[cut])
            yield pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("v").take(at), own, pa.array(lists[cut] % shards)], names=["id", "v", "lists", "shard"])

    vector = given.schema["v"].dataType.simpleString()
    shards = -(-len(shared.value.centres) // TOGETHER)
    lists = given.mapInArrow(listed, f"id {kind}, v {vector}, list long").withColumn("shard", F.col("list") % shards)
    blocks = lists.groupBy("shard", "list").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))  # one short row a centre
    stored = lists.join(F.broadcast(blocks), ["shard", "list"]).select("shard", F.pmod(F.xxhash64("id", "v"), F.col("blocks")).alias("block"), "list", "id", "v")
    asked = given.where(is_query(F.col("id"))).mapInArrow(probed, f"id {kind}, v {vector}, lists array<long>, shard long")
    asked = asked.join(F.broadcast(blocks.groupBy("shard").agg(F.max("blocks").alias("blocks"))), "shard")
    asked = asked.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "id", "v", "lists")

    def within(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "id", "score"]
        types = [left.schema.field("id").type, right.schema.field("id").type, pa.float64()]
        if not len(left) or not len(right):
            return pa.table([pa.array([], t) for t in types], names=names)
        index, q, x = shared.value, matrix(left.column("v")), matrix(right.column("v"))
        qid, xid = _ids(left.column("id")), _ids(right.column("id"))
        rotated_q, rotated_x = index.place(q, query=True), index.place(x)
        asks, home = left.column("lists").combine_chunks(), right.column("list").to_numpy()
        asking, wanted = np.repeat(np.arange(len(q)), asks.value_lengths().to_numpy()), asks.flatten().to_numpy()
        held = np.full((len(q), k), -np.inf)  # each query's best scores so far
        found_q, found_x, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for each in np.unique(home).tolist():
            here, of = np.flatnonzero(home == each), asking[wanted == each]
            for a in range(0, len(of), 256):
                m = of[a : a + 256]
                least = held[m].min(axis=1)
                reach = (q[m] * q[m]).sum(axis=1) + index.top**2 - 2 * least
                i, j = scan(rotated_q[m], rotated_x[here], qid[m, None] == xid[None, here], reach, k)
                s = inner(q[m[i]], x[here[j]])
                order = np.lexsort((xid[here[j]], -s, i))
                i, j, s = i[order], j[order], s[order]
                turn = np.arange(len(i)) - np.searchsorted(i, i)
                best = (turn < k) & (s >= least[i])
                i, j, s, turn = i[best], j[best], s[best], turn[best]
                new = np.full((len(m), k), -np.inf)
                new[i, turn] = s
                held[m] = np.partition(np.hstack([held[m], new]), k, axis=1)[:, k:]
                found_q.append(m[i])
                found_x.append(here[j])
                scores.append(s)
        i, j, s = (np.concatenate(r) for r in (found_q, found_x, scores))
        order = np.lexsort((xid[j], -s, i))
        i, j, s = i[order], j[order], s[order]
        best = np.arange(len(i)) - np.searchsorted(i, i) < k
        rows_q, rows_x = pa.array(i[best]), pa.array(j[best])
        return pa.table([left.column("id").take(rows_q), right.column("id").take(rows_x), pa.array(s[best])], names=names)

    found = asked.groupBy("shard", "block").cogroup(stored.groupBy("shard", "block")).applyInArrow(within, f"query_id {kind}, id {kind}, score double")
    # at most k rows a block and query reach the last step
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def op3_adaptive_scan(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    found = search(vectors, lambda i: i % 20 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")
