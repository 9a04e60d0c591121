"""N-gram Jaccard join: size-aware heavy-light join of documents' shingle sets.

Documents are sets of distinct 5-word shingles and link at a Jaccard similarity of 0.75.
Equal sets are one class from the start.  Two sets of n and m tokens that link share at
least c = ceil(3(n + m) / 7).  Small (light) sets enumerate their subsets of the fixed sizes c that
their partners' sizes ask for, and equal subsets are candidates.  Large (heavy) sets scan the inverted
lists of their prefixes in rarity order, with length and position filters.  The boundary is the
size with the least total cost: subsets enumerated below it, list entries scanned
above it, both counted over the whole corpus.

Candidates of a list are first held against its leader, the set with the fewest tokens of its own: near
copies of one text differ from each other by two edits' tokens and from the text itself by one's.  Entries that by length
and position fit no other of their list go.  Those outside their list's main component then meet all of the list that is
not in their component; where that would be more than ``ENOUGH`` times all entries, they first meet a few
others, then more.  So every link between different components is found, while a group
of copies costs about its size and not its square.  Components come from large-star and
small-star rounds.  Keys, leaders and hubs that may be hot are dealt over several places.

Defined results: a document without words, or with a null text, has no shingles, links
with nothing and is its own component; a text of fewer than five words is one shingle.  The component id
is the smallest doc_id reachable (a null id counts as the smallest and gives null).  Rows that
repeat a doc_id are separate documents.  Extra columns pass ``drop_near_duplicates`` unchanged.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hexflow.llm import sets
from hexflow.llm import text as T
from hexflow.llm.shared import Tables, spread_join

#: No boundary is sought beyond this size: the number of subsets only grows from there.
LARGEST_LIGHT = 16
#: Entries of a list, on average, that the sets outside its main component meet before they meet all, if all would be more
#: than ENOUGH times as many pairs as there are entries.
SAMPLED, ENOUGH = (4, 16, 64), 4
#: Entries of a list that meet in one task.
TOGETHER = 10_000


def _signed(batch: pa.RecordBatch):
    """Size and set hash of each text of a batch."""
    offsets, data = T.utf8(batch.column("text"))
    sizes, sigs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for _, _, _, tokens, owner, k in _slices(offsets, data):
        n, sig = sets.sketch(tokens, owner, k)
        sizes.append(n)
        sigs.append(sig)
    return np.concatenate(sizes), np.concatenate(sigs)


def _slices(offsets, data):
    for a, b in T.slices(offsets):
        w = T.words(offsets, data, a, b, T.SPACED)
        tokens, owner = T.distinct(*T.shingles(w.hashes(), w.first))
        yield a, b, w, tokens, owner, b - a


def text_sets(batch: pa.RecordBatch):
    """The shingle sets of the texts that have words."""
    offsets, data = T.utf8(batch.column("text"))
    ids = batch.column("id").to_numpy()
    for a, _, w, tokens, owner, _ in _slices(offsets, data):
        live = np.flatnonzero(w.n > 0)
        zero = np.zeros(len(live), np.int64)
        yield ids[a + live], zero, zero, tokens, np.searchsorted(live, owner)


def subset_sizes(n: int) -> list[int]:
    """The overlaps that partners of a set of n tokens ask for."""
    least, most = -(-sets.NUM * n // sets.DEN), sets.DEN * n // sets.NUM
    return sorted({int(sets.overlap(n, m)) for m in range(max(1, least), most + 1)})


def boundary(classes: DataFrame) -> int:
    """The largest light size, by the cost of both ways over all classes: subsets made, and entries of the lists scanned for each set; the largest of equal cost."""
    entries = sets.postings(classes.where(F.col("n") <= 2 * LARGEST_LIGHT), ())
    own = entries.groupBy("key", F.least("n", F.lit(LARGEST_LIGHT + 1)).alias("n")).agg(F.count("*").alias("own"))
    lists = own.groupBy("key").agg(F.sum("own").alias("size"), F.collect_list(F.struct("n", "own")).alias("each"))
    scanned = {r.n: r.cost for r in lists.select("size", F.explode("each").alias("each")).groupBy("each.n").agg(F.sum(F.col("each.own").cast("double") * F.col("size")).alias("cost")).collect()}
    known = F.octet_length("tokens") / 8
    subsets = {r.n: r.each for r in classes.where(F.col("n") <= LARGEST_LIGHT).groupBy(F.col("n"), known.cast("int").alias("known")).count().groupBy("n").agg(F.collect_list(F.struct("known", "count")).alias("each")).collect()}
    light = {n: sum(r["count"] * sum(comb(r.known, c) for c in subset_sizes(n) if c <= r.known) for r in each) for n, each in subsets.items()}
    costs = {b: sum(light.get(n, 0) for n in range(1, b + 1)) + sum(scanned.get(n, 0) for n in range(b + 1, LARGEST_LIGHT + 2)) for b in range(LARGEST_LIGHT + 1)}
    return min(costs, key=lambda b: (costs[b], -b))


def light_entries(classes: DataFrame, largest: int) -> DataFrame:
    """``key, sig, n, most, alone`` for each subset of the light sets; ``most`` does not bind here."""

    def subsets(batches):
        for batch in batches:
            keys, rows = [], []
            for i, (n, raw) in enumerate(zip(batch.column("n").to_pylist(), batch.column("tokens").to_pylist(), strict=True)):
                t = np.sort(T.mix(np.frombuffer(raw, np.uint64)))
                for c in subset_sizes(n):
                    if c > len(t):
                        continue
                    h = np.full(comb(len(t), c), c, dtype=np.uint64)
                    which = np.array(list(combinations(range(len(t)), c)))
                    for j in range(c):
                        h = T.mix(h * np.uint64(0x9E3779B97F4A7C15) + t[which[:, j]])
                    keys.append(h)
                    rows.append(np.full(len(h), i))
            if keys:
                at = pa.array(np.concatenate(rows))
                rest = [batch.column(c).take(at) for c in ("sig", "n", "alone")]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.full(len(at), 1 << 40)), *rest], names=["key", "most", "sig", "n", "alone"])

    return classes.where(F.col("n") <= largest).select("n", "sig", "alone", "tokens").mapInArrow(subsets, "key long, most long, sig long, n long, alone long")


def components(links: DataFrame, tables: Tables) -> DataFrame:
    """``node, root`` for all nodes of the links (a, b) but the roots themselves; the root is the smallest node."""
    edges, old = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v"), None
    count = edges.count()
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("_size"))
        star = spread_join(both, low, "u", "_size", 2 * count).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = star.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("_size"))
        small = spread_join(star, low, "u", "_size", count).select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        edges = tables.keep(small.where("u <> v").distinct())
        if old is not None:
            tables.drop(old)
        old, count = edges, edges.count()
        # stars are done when every node points to one other, which points nowhere
        ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
        if ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up > 0 and down > 0").isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def linked(classes: DataFrame, tables: Tables) -> DataFrame:
    """``node, root`` of the classes that links join to another, but the roots themselves."""
    largest = boundary(classes)
    # a heavy set's partner may be light, down to three quarters of its size
    heavy = sets.postings(classes, ("alone",), least=-(-sets.NUM * (largest + 1) // sets.DEN)).select("key", "sig", "n", "most", "alone")
    made = tables.keep(heavy.union(light_entries(classes, largest).select("key", "sig", "n", "most", "alone")))
    total = made.count()
    # first one leader for each set: of its lists' leaders the one with the fewest tokens of its own
    lead = F.min(F.struct("alone", F.xxhash64("sig").alias("h"), "sig", "n", "most")).alias("lead")
    lists = made.groupBy("key").agg(lead, F.count("*").alias("size"), F.min("n").alias("least"), F.max("most").alias("reach")).where("size > 1")
    entries = tables.keep(spread_join(made, lists, "key", "size", total).where("most >= least and n <= reach").drop("least", "reach"))
    tables.drop(made)
    fits = (F.col("n") <= F.col("lead.most")) & (F.col("lead.n") <= F.col("most"))
    near = entries.where(fits & (F.col("sig") != F.col("lead.sig"))).groupBy(F.col("sig").alias("b")).agg(F.min("lead").alias("lead"))
    pairs = tables.keep(near.select(F.col("lead.sig").alias("a"), "b"))
    found = tables.keep(sets.verified(pairs, classes, pairs.count()))
    tables.drop(pairs)
    stars = components(found, tables)
    tables.drop(found)
    for drawn in (*SAMPLED, None):
        left = tables.keep(_divided(entries.drop("lead", "size"), stars))
        work = left.where("root <> main").agg(F.sum("size")).first()[0] or 0
        last = drawn is None or work <= ENOUGH * total
        if work:
            few = F.pmod(F.xxhash64("key", "sig", F.lit(drawn or 0)), F.lit(1 << 20)) * F.col("size") < (drawn or 0) * (1 << 20)
            pairs = tables.keep(_between(left.where("root <> main"), left if last else left.where(few)))
            found = tables.keep(sets.verified(pairs, classes, pairs.count()))
            if not found.isEmpty():
                stars = components(found.union(stars.select(F.col("node").alias("a"), F.col("root").alias("b"))), tables)
            tables.drop(pairs, found)
        tables.drop(left)
        if last:
            tables.drop(entries)
            return stars


def _divided(entries: DataFrame, stars: DataFrame) -> DataFrame:
    """Entries of lists with more than one component, with root, the list's size and main component, that of its leader."""
    rooted = entries.join(stars, F.col("sig") == F.col("node"), "left").select("key", "sig", "n", "most", "alone", F.coalesce("root", "sig").alias("root"))
    lead = F.min(F.struct("alone", F.xxhash64("key", "sig").alias("h"), "root")).alias("lead")
    lists = rooted.groupBy("key").agg(lead, F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("size"), F.min("n").alias("least"), F.max("most").alias("reach"))
    lists = lists.where("low <> high").select("key", "size", "least", "reach", F.col("lead.root").alias("main"))
    return rooted.join(lists, "key").where("most >= least and n <= reach").select("key", "sig", "n", "most", "root", "size", "main")


def _between(xs: DataFrame, ys: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) of one list and different components that length and position allow.

    A long list's ``xs`` are dealt over several places, and its ``ys`` go to each.
    """
    places = F.least(F.ceil(F.col("size") / TOGETHER), F.lit(64))
    x = xs.withColumn("place", F.pmod(F.xxhash64("sig"), places)).alias("x")
    y = ys.withColumn("place", F.explode(F.sequence(F.lit(0).cast("long"), places - 1))).alias("y")
    same = (F.col("x.key") == F.col("y.key")) & (F.col("x.place") == F.col("y.place"))
    apart = (F.col("x.root") != F.col("y.root")) & (F.col("x.n") <= F.col("y.most")) & (F.col("y.n") <= F.col("x.most"))
    return x.join(y, same).where(apart).select(F.least("x.sig", "y.sig").alias("a"), F.greatest("x.sig", "y.sig").alias("b")).distinct()


def _signed_rows(given: DataFrame) -> DataFrame:
    def sign(batches):
        for batch in batches:
            n, sig = _signed(batch)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("th"), pa.array(n), pa.array(sig, mask=n == 0)], names=["id", "th", "n", "sig"])

    return given.mapInArrow(sign, "id long, th long, n long, sig long")


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, th, n, low`` of every document row: text hash, set size, and id and text hash of its component's first document."""
    tables = Tables(docs.sparkSession)
    given = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    texts = given.select(F.coalesce("id", F.lit(0)).alias("id"), F.lit(0).cast("long").alias("th"), F.coalesce("text", F.lit("")).alias("text"))
    found = tables.keep(sets.survivors(texts, text_sets, copies=False))  # its shuffles are the largest, and go here
    classes = tables.keep(sets.classes(found))
    tables.drop(found)
    stars = linked(classes, tables)
    tables.drop(classes)
    signed = tables.keep(_signed_rows(given))
    worded = signed.where("sig is not null")
    own = worded.groupBy("sig").agg(F.min(F.struct("id", "th")).alias("low"), F.count("*").alias("_size"))
    named = tables.keep(own.join(stars, F.col("sig") == F.col("node"), "left").select("sig", "low", "_size", F.coalesce("root", "sig").alias("root")))
    lows = named.groupBy("root").agg(F.min("low").alias("first"), F.count("*").alias("_classes"))
    named = spread_join(named.drop("low"), lows, "root", "_classes", named.count()).select("sig", "_size", F.col("first").alias("low"))
    alone = signed.where("sig is null").select("id", "th", "n", F.struct("id", "th").alias("low"))
    return spread_join(worded, named, "sig", "_size", signed.count()).select("id", "th", "n", "low").union(alone)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_shingles, component_id`` of every document row."""
    return grouped(docs, id_col, text_col).select("id", F.col("n").alias("n_shingles"), F.col("low.id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, the first by id and text hash, with its own columns; documents without words all stay."""
    first = grouped(docs, id_col, text_col).where("n = 0 or (id <=> low.id and th = low.th)")
    first = first.select(F.struct("id", "th").alias("_place"), (F.col("n") == 0).alias("_wordless")).distinct()
    row = docs.select(F.struct("*").alias("_row"), F.struct(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("th")).alias("_place"))
    again = F.row_number().over(Window.partitionBy("_place").orderBy(F.xxhash64("_row")))
    out = row.join(first, "_place").withColumn("_again", again).where("_wordless or _again = 1")
    return out.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])


def op7_heavy_light(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).withColumnRenamed("id", "doc_id")


#: All pairs that share a shingle, their Jaccard similarity, and components by least ids.
OP7_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
comp(id, c) USING KEY (id) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.y, min(comp.c) FROM comp JOIN e ON e.x = comp.id JOIN recurring.comp k ON k.id = e.y WHERE comp.c < k.c GROUP BY e.y)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, c AS component_id FROM d JOIN comp ON id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
