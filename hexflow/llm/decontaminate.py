"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of ``size`` consecutive words of each benchmark item (an item
of fewer words is one window).  For the windows of one length m, a shift table over
blocks of two words tells how far the search may skip, buckets keyed by the last
block's hash and, within it, the first block's select the windows to test, and direct comparison, of word hashes and then of the words'
bytes, confirms occurrences.
All texts of an Arrow slice are searched in lockstep, one cursor per stretch of words.

The benchmark goes to the executors in blocks of at most ``BLOCK_CHARS`` characters (a longer
item is a block of its own), one broadcast and one pass over the documents each; no document is shuffled.  A
block's tables take about 20 bytes a character at most: the items' words stand once, windows are places in them, and the
shift table has a byte or two for each of 8 places a distinct word pair.  Between passes the
findings are written, so only one block is held at a time.

Defined results: a null or empty text, or one without words, has no words and is never
contaminated.  Benchmark rows whose id is null, or whose text is null or without words, take no
part; rows that repeat an item_id add their windows to that item.  Every document row
gives one result row, repeated rows included.  An empty benchmark hits nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from hexflow.llm import text as T
from hexflow.llm.shared import Tables

#: Benchmark characters that are broadcast at once.
BLOCK_CHARS = 8_000_000
_LANE = 512
_PAIR = np.uint64(0xD1342543DE82EF95)


@dataclass
class Windows:
    """The patterns of one length with their shift table and suffix buckets."""

    m: int
    block: int
    at: np.ndarray  #: each pattern's first word among the items' words, ordered by bucket
    bucket: np.ndarray  #: hash of each pattern's last and first block, ascending
    shift: np.ndarray  #: by block hash, how far the search may move on
    item_first: np.ndarray  #: patterns + 1 offsets into item_ids
    item_ids: np.ndarray  #: positions in the list of items

    @classmethod
    def build(cls, hashed: np.ndarray, at: np.ndarray, items: np.ndarray, m: int) -> Windows:
        """``at`` has the first word of each window among the ``hashed`` words, ``items`` the window's item."""
        block = min(2, m)
        coded = blocks(hashed, block)
        whole = np.zeros(len(at), np.uint64)
        for j in range(m):
            whole = T.mix(whole * _PAIR + hashed[at + j])
        _, one, which = np.unique(whole, return_index=True, return_inverse=True)
        starts = at[one]
        bucket = _bucket(coded, starts + m - 1, m, block)
        order = np.argsort(bucket, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        which = place[which]
        order_of = np.lexsort((items, which))
        which, items = which[order_of], items[order_of]
        new = np.concatenate([[True], (which[1:] != which[:-1]) | (items[1:] != items[:-1])])
        which, items = which[new], items[new]
        ends = np.zeros(len(hashed), bool)
        for j in range(block - 1, m):
            ends[starts + j] = True
        size = 1 << max(12, int(len(np.unique(coded[ends])) * 8).bit_length())
        shift = np.full(size, m - block + 1, dtype=np.uint8 if m < 256 else np.uint32)
        for j in range(block - 1, m):
            np.minimum.at(shift, (coded[starts + j] & np.uint64(size - 1)).astype(np.int64), shift.dtype.type(m - 1 - j))
        return cls(m, block, starts[order], bucket[order], shift, np.searchsorted(which, np.arange(len(order) + 1)), items)

    def search(self, hashed: np.ndarray, first: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Last words and patterns of all occurrences, by word hashes, in texts whose words begin at ``first``; ``known`` are the items' words."""
        begin, end = first[:-1] + self.m - 1, first[1:]
        lanes = np.maximum(0, -(-(end - begin) // _LANE))
        text = np.repeat(np.arange(len(begin)), lanes)
        k = np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        at = begin[text] + k * _LANE
        stop = np.minimum(at + _LANE, end[text])
        coded = blocks(hashed, self.block)
        mask, found = np.uint64(len(self.shift) - 1), []
        while len(at):
            skip = self.shift[(coded[at] & mask).astype(np.int64)].astype(np.int64)
            found.append(at[skip == 0])
            at = at + np.maximum(skip, 1)
            alive = at < stop
            at, stop = at[alive], stop[alive]
        at = np.concatenate(found) if found else np.zeros(0, dtype=np.int64)
        bucket = _bucket(coded, at, self.m, self.block)
        lo, hi = (np.searchsorted(self.bucket, bucket, side) for side in ("left", "right"))
        n = hi - lo
        at, pattern = np.repeat(at, n), np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        for j in range(self.m):  # direct comparison; each step drops what differs
            same = hashed[at - self.m + 1 + j] == known[self.at[pattern] + j]
            at, pattern = at[same], pattern[same]
        return at, pattern


def blocks(hashed: np.ndarray, block: int) -> np.ndarray:
    """Hash of the block of words that ends at each word."""
    if block == 1:
        return hashed
    coded = hashed.copy()
    coded[1:] += hashed[:-1] * _PAIR
    return coded


def _bucket(coded: np.ndarray, last: np.ndarray, m: int, block: int) -> np.ndarray:
    """Of windows by their last words: the last block's hash with the first block's."""
    return T.mix(coded[last] * _PAIR + coded[last - m + block])


@dataclass
class Block:
    """Some items: their words, as bytes and hashes, and the search structures for their windows, by length."""

    names: list[str]
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashed: np.ndarray
    tables: list[Windows]

    @classmethod
    def build(cls, names: list[str], texts: list[str], size: int) -> Block:
        offsets, data = T.utf8(pa.array(texts, pa.large_string()))
        base, parts = 0, []
        found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        n_words = 0
        for a, b in T.slices(offsets):
            w = T.words(offsets, data, a, b, T.ALNUM)
            parts.append((w.data, w.starts + base, w.ends + base, w.hashes()))
            for i, (x, y) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)):
                if y > x:
                    m = min(size, y - x)
                    found.setdefault(m, []).append((n_words + np.arange(x, y - m + 1), np.full(y - m + 1 - x, a + i)))
            base, n_words = base + len(w.data), n_words + len(w.starts)
        data, starts, ends, hashed = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, t) for t in (np.uint8, np.int64, np.int64, np.uint64))
        tables = [Windows.build(hashed, *(np.concatenate(x) for x in zip(*v, strict=True)), m) for m, v in sorted(found.items())]
        return cls(names, data, starts, ends, hashed, tables)

    def occurrences(self, t: Windows, w: T.Words, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Last words and patterns of the windows of one length whose words stand there byte for byte."""
        last, pattern = t.search(hashed, w.first, self.hashed)
        if not len(last):
            return last, pattern
        ours = (last[:, None] - np.arange(t.m)).ravel()
        theirs = (t.at[pattern][:, None] + t.m - 1 - np.arange(t.m)).ravel()
        pairs, back = np.unique(ours * np.int64(len(self.starts)) + theirs, return_inverse=True)
        x, y = pairs // len(self.starts), pairs % len(self.starts)
        n = w.ends[x] - w.starts[x]
        same = n == self.ends[y] - self.starts[y]
        each = np.where(same, n, 0)
        step = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        differ = w.data[np.repeat(w.starts[x], each) + step] != self.data[np.repeat(self.starts[y], each) + step]
        same &= np.bincount(np.repeat(np.arange(len(x)), each), weights=differ, minlength=len(x)) == 0
        right = same[back.ravel()].reshape(-1, t.m).all(axis=1)
        return last[right], pattern[right]


def _scan(column: pa.Array, block: Block) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """For each text: a mask of the words hit, and the positions of the items found."""
    offsets, data = T.utf8(column)
    for a, b in T.slices(offsets):
        w = T.words(offsets, data, a, b, T.ALNUM)
        h, text = w.hashes(), w.text_of
        delta = np.zeros(len(h) + 1, dtype=np.int64)
        owners, items = [], []
        for t in block.tables:
            last, pattern = block.occurrences(t, w, h)
            np.add.at(delta, last - t.m + 1, 1)
            np.add.at(delta, last + 1, -1)
            n = t.item_first[pattern + 1] - t.item_first[pattern]
            owners.append(np.repeat(text[last], n))
            items.append(t.item_ids[np.repeat(t.item_first[pattern] - np.cumsum(n) + n, n) + np.arange(n.sum())])
        hit = np.cumsum(delta[:-1]) > 0
        both = np.unique(np.stack([np.concatenate(owners), np.concatenate(items)]), axis=1) if owners else np.zeros((2, 0), dtype=np.int64)
        cut = np.searchsorted(both[0], np.arange(b - a + 1))
        for i in range(b - a):
            yield hit[w.first[i] : w.first[i + 1]], both[1, cut[i] : cut[i + 1]]


def find_contamination(docs: DataFrame, benchmark: DataFrame, size: int = 13, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", keep: bool = False) -> DataFrame:
    """One row per document: ``id``, ``n_words``, ``n_hit``, ``items`` (ids found, as strings).

    With ``keep``, the documents' own columns come along in a struct ``doc``.
    """
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text")).where("item is not null and text is not null")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n_blocks = max(1, -(-2 * chars // BLOCK_CHARS)) if chars > BLOCK_CHARS else 1  # dealt by hash: half full on average
    # each text goes to the workers once, and doesn't come back from the last pass unless it is kept
    given = F.struct("*").alias("doc") if keep else F.col(text_col).alias("text")
    out = docs.select(F.col(id_col).alias("id"), given, F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.lit(None).cast("binary").alias("hits"), F.expr("cast(array() as array<string>)").alias("items"))
    schema, spark = out.schema, docs.sparkSession
    written, before = Tables(spark) if n_blocks > 1 else None, None
    for k in range(n_blocks):
        block = items.where(F.pmod(F.xxhash64("item"), F.lit(n_blocks)) == k).toPandas()
        shared = spark.sparkContext.broadcast(Block.build(block.item.tolist(), block.text.tolist(), size))

        last_pass = k == n_blocks - 1
        names = [c for c in schema.names if not last_pass or c not in ("text", "hits")]

        def scan(batches, shared=shared, names=names):
            held = shared.value
            for batch in batches:
                texts = batch.column("doc").field(text_col) if keep else batch.column("text")
                n, n_hit, bits, found = [], [], [], []
                before, were = batch.column("hits").to_pylist(), batch.column("items").to_pylist()
                for (hit, which), old, known in zip(_scan(texts, held), before, were, strict=True):
                    if old:
                        hit = hit | np.unpackbits(np.frombuffer(old, dtype=np.uint8), count=len(hit)).astype(bool)
                    n.append(len(hit))
                    n_hit.append(int(hit.sum()))
                    bits.append(np.packbits(hit).tobytes() if hit.any() else None)
                    found.append(sorted({*known, *(held.names[i] for i in which)}) if len(which) else known)
                new = {"n_words": pa.array(n, pa.int64()), "n_hit": pa.array(n_hit, pa.int64()), "hits": pa.array(bits, pa.binary()), "items": pa.array(found, pa.list_(pa.string()))}
                yield pa.RecordBatch.from_arrays([new[c] if c in new else batch.column(c) for c in names], names=names)

        out = out.mapInArrow(scan, StructType([schema[c] for c in names]))
        if k < n_blocks - 1:
            out, last = written.keep(out), before
            before = out
            shared.unpersist()
            if last is not None:
                written.drop(last)
    return out.select("id", "n_words", "n_hit", "items", *(["doc"] if keep else []))


def is_contaminated() -> F.Column:
    """The contamination rule: at least one word in twenty is hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 13, **columns: str) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    kept = find_contamination(docs, benchmark, size, keep=True, **columns).where(~is_contaminated())
    return kept.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])


def op1_wu_manber(spark, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = find_contamination(docs, benchmark)
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), is_contaminated().alias("contaminated"),
    )


#: The windows by their text, joined to the windows of the documents of equal length.
OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(13, len(w)) AS m, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS win
       FROM (SELECT item, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') AS win
       FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM bw) WHERE len(w) >= m)),
hit AS (SELECT doc_id, dw.m, i, item FROM dw JOIN bw ON dw.m = bw.m AND dw.win = bw.win),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
"""
