"""Shards of nearly equal bytes by a histogram sort, with DataFrame operations only.

Rows are ordered by (hash of the text, hash of the id, row number), so equal texts lie side by side.  The n - 1
splitters of that order are found by counting: each round deals every interval that still holds a
sought splitter into equal-width probes, and one aggregation over all partitions gives the exact bytes below
each probe; a splitter is settled when a probe is within ``TOLERANCE`` of a shard's share, and otherwise its interval
shrinks to the probe that its target falls into.  A text whose copies alone exceed the tolerance is cut by the next
part of the order, so a hot group is split exactly there and at most one group a splitter is split at all.
Once all splitters stand, rows are exchanged once, by shard and piece.

The driver sees about ``PROBES`` counts a round, whatever the number of rows; a round that shrinks every interval by
PROBES / n divides the range of a hash by at least 100 with 40 shards, so rounds are few.  A shard's rows are
numbered in pieces of at most about ``PIECE`` rows, dealt by a hash of the row number, so no task holds a shard; the pieces'
offsets (64 n + rows / PIECE short rows at most) are broadcast.

Defined results: a null text counts as empty; a null id is an id like any other; rows that repeat id and text are
rows of their own and may be split between shards; a shard may stay empty where one row outweighs a share; an empty
table gives no row.  Columns of the input keep their names within the struct ``doc``.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hexflow.llm.shared import Tables

#: How far from its target a splitter may lie, in shares; counts that a round sends to the driver; most rows of a piece.
TOLERANCE, PROBES, PIECE = 0.001, 4096, 1 << 20
#: Bytes that a row counts besides its text.
OVERHEAD = 16
#: The parts of the order and their largest values.
ORDER = {"_h": (1 << 62) - 1, "_d": (1 << 62) - 1, "_row": (1 << 63) - 1}
KEYS = tuple(ORDER)


@dataclass(frozen=True)
class Interval:
    """Rows that have ``path`` in the first parts of the order and the next part within low to high."""

    path: tuple[int, ...] = ()
    low: int = 0
    high: int = ORDER["_h"]

    @property
    def key(self) -> str:
        return KEYS[len(self.path)]

    def holds(self) -> Column:
        inside = F.col(self.key).between(F.lit(self.low), F.lit(self.high))
        for key, value in zip(KEYS, self.path, strict=False):
            inside = (F.col(key) == F.lit(value)) & inside
        return inside

    def step(self, probes: int) -> int:
        return (self.high - self.low) // probes + 1


@dataclass(frozen=True)
class Sought:
    """A splitter's target in bytes, where it lies, and the exact bytes of all rows before that interval."""

    target: float
    within: Interval
    below: int = 0


def sized(docs: DataFrame, id_col: str, text_col: str, keep: bool) -> DataFrame:
    """Each row's id, size, checksum and place in the order; with ``keep``, its own columns too."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    hashed = lambda c: F.shiftrightunsigned(F.xxhash64(c), 2)
    return docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        hashed(text).alias("_h"), hashed(F.col(id_col)).alias("_d"), F.monotonically_increasing_id().alias("_row"),
        *([F.struct(*docs.columns).alias("doc")] if keep else []),
    )


def histogram(rows: DataFrame, intervals: list[Interval]) -> dict[Interval, list[tuple[int, int, int]]]:
    """For each interval, its probes that have rows, in order: the least and the largest key, and the exact bytes."""
    probes = max(64, PROBES // len(intervals))
    where, bucket = F.lit(None).cast("int"), F.lit(None).cast("long")
    for i, x in enumerate(intervals):
        where = F.when(x.holds(), F.lit(i)).otherwise(where)
        bucket = F.when(F.col("_i") == i, F.expr(f"({x.key} - {x.low}L) div {x.step(probes)}L")).otherwise(bucket)
    at = rows.select("size", *KEYS, where.alias("_i")).where("_i is not null").withColumn("_b", bucket)
    key = F.coalesce(*[F.when(F.col("_i").isin([i for i, x in enumerate(intervals) if x.key == k]), F.col(k)) for k in KEYS if any(x.key == k for x in intervals)])
    counted = at.groupBy("_i", "_b").agg(F.min(key).alias("low"), F.max(key).alias("high"), F.sum("size").alias("bytes"))
    out: dict[Interval, list[tuple[int, int, int]]] = {x: [] for x in intervals}
    for r in sorted(counted.collect(), key=lambda r: (r["_i"], r["_b"])):  # bounded by PROBES, or 64 an interval
        out[intervals[r["_i"]]].append((r["low"], r["high"], r["bytes"]))
    return out


def narrowed(s: Sought, probes: list[tuple[int, int, int]], tolerance: float) -> Sought | tuple[int, ...]:
    """The splitter, once a probe's edge is near enough or nothing is left to cut; else where it is sought next."""
    below = s.below
    for low, high, size in probes:
        if below + size >= s.target:
            break
        below += size
    path = s.within.path
    edges = sorted(((abs(below - s.target), (*path, low)), (abs(below + size - s.target), (*path, high + 1))))
    last = low == high and len(path) == len(KEYS) - 1
    if edges[0][0] <= tolerance or last:
        return edges[0][1]
    if low == high:
        path = (*path, low)
        return Sought(s.target, Interval(path, 0, ORDER[KEYS[len(path)]]), below)
    return Sought(s.target, replace(s.within, low=low, high=high), below)


def splitters(rows: DataFrame, n: int, total: int, tolerance: float = TOLERANCE) -> list[tuple[int, ...]]:
    """The n - 1 places in the order, each the first of its shard, that cut the bytes nearly evenly."""
    found: list[tuple[int, ...]] = []
    sought = [Sought(total * k / n, Interval()) for k in range(1, n)] if total else []
    while sought:
        counts = histogram(rows, list(dict.fromkeys(s.within for s in sought)))
        after = [narrowed(s, counts[s.within], tolerance * total / n) for s in sought]
        found += [x for x in after if isinstance(x, tuple)]
        sought = [x for x in after if isinstance(x, Sought)]
    return sorted((*x, *[0] * (len(KEYS) - len(x))) for x in found)


def _reaches(place: tuple[int, ...]) -> Column:
    """The row is at this place of the order or after it."""
    out = F.lit(True)
    for i in range(len(KEYS) - 1, -1, -1):
        key, value = F.col(KEYS[i]), F.lit(min(place[i], (1 << 63) - 1))
        rest = any(place[i + 1 :])
        out = (key > value) | ((key == value) & out) if rest else (key >= value)
    return out


def shard_of(places: list[tuple[int, ...]], first: int = 0) -> Column:
    """How many splitters a row reaches, by a tree of comparisons."""
    if not places:
        return F.lit(first)
    mid = len(places) // 2
    return F.when(_reaches(places[mid]), shard_of(places[mid + 1 :], first + mid + 1)).otherwise(shard_of(places[:mid], first))


def shard(docs: DataFrame, n: int = 40, tolerance: float = TOLERANCE, id_col: str = "doc_id", text_col: str = "text", keep: bool = True) -> DataFrame:
    """Every row's ``id, size, text_crc32, shard, slot``, and with ``keep`` its own columns as the struct ``doc``.

    Sizes are the text's UTF-8 bytes and OVERHEAD.  Slots count a shard's rows from 0 without a gap.
    """
    rows = Tables(docs.sparkSession).keep(sized(docs, id_col, text_col, keep))
    bytes_, count = rows.agg(F.sum("size"), F.count("*")).first()
    placed = rows.withColumn("shard", shard_of(splitters(rows, n, bytes_ or 0, tolerance)))
    in_shard = {r["shard"]: r["count"] for r in placed.groupBy("shard").count().collect()}  # one row a shard
    most = min(PIECE, -(-count // (64 * n)) or 1)
    pieces = F.element_at(F.array(*[F.lit(-(-in_shard.get(i, 0) // most) or 1) for i in range(n)]), F.col("shard") + 1)
    placed = placed.withColumn("_piece", F.pmod(F.xxhash64("_row"), pieces))
    up_to = Window.partitionBy("shard").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    before = placed.groupBy("shard", "_piece").agg(F.count("*").alias("_n")).select("shard", "_piece", F.coalesce(F.sum("_n").over(up_to), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("shard", "_piece").orderBy(*KEYS)) - 1
    out = placed.withColumn("_at", within).join(F.broadcast(before), ["shard", "_piece"])
    return out.select("id", "size", "text_crc32", "shard", (F.col("_before") + F.col("_at")).cast("long").alias("slot"), *(["doc"] if keep else []))


def op12_histogram_sort(spark, sf_dir: str) -> DataFrame:
    out = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"), 40, keep=False)
    return out.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
