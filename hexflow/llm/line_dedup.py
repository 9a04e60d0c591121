"""Line dedup by an exact set-similarity join over all lines of the corpus.

A line's tokens are its distinct 5-word shingles.  They are ordered by rarity; lines that
share a token of their prefixes, agree in length and by the token's positions are
candidates; their Jaccard similarity is verified; and a line goes if an earlier line
(by doc_id, then line number) matches it.  Equal lines are one set from the start.  A line is first held against the
earliest line and the most central one (fewest tokens of its own) of its inverted lists; entries that by length and
position fit no other of their list go; those still unresolved meet earlier entries of their lists, at first a few where
all would be more than ``ENOUGH`` times as many pairs as there are entries, at last all.  So a group of copies
costs about its size, not its square.  Keys that may be hot are dealt over several places.

Defined results: a null text stays null; a line of fewer than ``MIN_WORDS`` words is left
alone and matches nothing; kept lines stay joined by newlines, and a text all of whose
lines go becomes empty.  A null doc_id comes before all others.  Rows that repeat doc_id and
text count as one document and lose the same lines; rows that share only the doc_id are
told apart by their text.  Extra columns pass unchanged.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexflow.llm import sets
from hexflow.llm import text as T
from hexflow.llm.shared import Tables, spread_join

MIN_WORDS = 5
#: Earlier entries of a list, on average, that unresolved lines meet before they meet all, if all would be more than ENOUGH
#: times as many pairs as there are entries.
SAMPLED, ENOUGH = (4, 16, 64), 4
#: Entries of a list that meet in one task.
TOGETHER = 10_000


def _key(id_col: str, text_col: str) -> list[F.Column]:
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("id"), F.xxhash64(F.col(text_col)).alias("th")]


def line_sets(batch: pa.RecordBatch):
    """The shingle sets of the lines of at least MIN_WORDS words."""
    offsets, data = T.utf8(batch.column("text"))
    ids, th = batch.column("id").to_numpy(), batch.column("th").to_numpy()
    for a, b in T.slices(offsets):
        w = T.words(offsets, data, a, b, T.SPACED)
        breaks = np.flatnonzero(w.data == 10)
        start = np.sort(np.concatenate([w.offsets[:-1], breaks + 1]))  # lines, by their first byte
        text = np.searchsorted(w.offsets[1:], start, "right")
        # a line begins at its text's start or after a break; an empty text's start may equal the next one's
        start_of = np.concatenate([w.offsets[:-1], breaks + 1])
        owner = np.concatenate([np.arange(b - a), np.searchsorted(w.offsets, breaks, "right") - 1])
        order = np.lexsort((start_of, owner))
        start, text = start_of[order], owner[order]
        line = np.arange(len(start)) - np.searchsorted(text, np.arange(b - a))[text]
        first = np.concatenate([np.searchsorted(w.starts, start), [len(w.starts)]])
        n = np.diff(first)
        tokens, group = T.shingles(w.hashes(), first)
        keep = n[group] >= MIN_WORDS
        tokens, group = T.distinct(tokens[keep], group[keep])
        live = np.flatnonzero(n >= MIN_WORDS)
        yield ids[a + text[live]], th[a + text[live]], line[live], tokens, np.searchsorted(live, group)


def removed_lines(docs: DataFrame, tables: Tables, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, th, lines``: the numbers (from 0) of the lines that go, for each text that loses any."""
    given = docs.select(*_key(id_col, text_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    lines = tables.keep(sets.survivors(given, line_sets))
    place = F.struct("id", "th", "line")
    classes = tables.keep(sets.classes(lines, F.min(place).alias("at"), F.count("*").alias("_size")))
    lines, before = tables.keep(lines.select("sig", "id", "th", "line")), lines
    tables.drop(before)
    gone = _matched(classes, tables).select("sig", F.lit(True).alias("gone"))
    status = tables.keep(classes.select("sig", "at", "_size").join(gone, "sig", "left"))
    tables.drop(classes)
    out = spread_join(lines, status, "sig", "_size", lines.count()).where(F.coalesce("gone", F.lit(False)) | (place != F.col("at")))
    out = tables.keep(out.groupBy("id", "th").agg(F.sort_array(F.collect_set("line")).alias("lines")))
    tables.drop(lines, status)
    return out


def _matched(classes: DataFrame, tables: Tables) -> DataFrame:
    """``sig`` of the sets that an earlier one matches."""
    made = tables.keep(sets.postings(classes, ("alone", "at")).select("key", "sig", "n", "most", "alone", "at"))
    total = made.count()
    early, central = (F.min(F.struct(*order, "at", "sig", "n", "most")) for order in ((), ("alone",)))
    lists = made.groupBy("key").agg(early.alias("early"), central.alias("central"), F.count("*").alias("size"), F.min("n").alias("least"), F.max("most").alias("reach")).where("size > 1")
    entries = tables.keep(spread_join(made, lists, "key", "size", total).where("most >= least and n <= reach").drop("least", "reach"))
    tables.drop(made)
    leads = None
    for lead in ("early", "central"):
        fits = (F.col("n") <= F.col(f"{lead}.most")) & (F.col(f"{lead}.n") <= F.col("most")) & (F.col(f"{lead}.at") < F.col("at"))
        one = entries.where(fits).groupBy(F.col("sig").alias("b")).agg(F.min(lead).alias("lead")).select(F.col("lead.sig").alias("a"), "b")
        leads = one if leads is None else leads.union(one)
    pairs = tables.keep(leads.distinct())
    found = [tables.keep(sets.verified(pairs, classes, pairs.count()).select("b").distinct())]
    tables.drop(pairs)
    for drawn in (*SAMPLED, None):
        done = reduce(DataFrame.union, found).select(F.col("b").alias("sig"))
        open_ = entries.join(done, "sig", "left_anti")
        work = open_.agg(F.sum("size")).first()[0] or 0
        last = drawn is None or work <= ENOUGH * total
        if work:
            few = F.pmod(F.xxhash64("key", "sig", F.lit(drawn or 0)), F.lit(1 << 20)) * F.col("size") < (drawn or 0) * (1 << 20)
            pairs = tables.keep(_earlier(open_, entries if last else entries.where(few)))
            found.append(tables.keep(sets.verified(pairs, classes, pairs.count()).select("b").distinct()))
            tables.drop(pairs)
        if last:
            tables.drop(entries)
            return reduce(DataFrame.union, found).select(F.col("b").alias("sig"))


def _earlier(xs: DataFrame, ys: DataFrame) -> DataFrame:
    """Candidate pairs (a earlier than b) of one list that length and position allow; a long list's ``xs`` are dealt over several places."""
    places = F.least(F.ceil(F.col("size") / TOGETHER), F.lit(64))
    x = xs.select("key", "sig", "n", "most", "at", F.pmod(F.xxhash64("sig"), places).alias("place")).alias("x")
    y = ys.select("key", "sig", "n", "most", "at", F.explode(F.sequence(F.lit(0).cast("long"), places - 1)).alias("place")).alias("y")
    same = (F.col("x.key") == F.col("y.key")) & (F.col("x.place") == F.col("y.place"))
    fits = (F.col("y.at") < F.col("x.at")) & (F.col("x.n") <= F.col("y.most")) & (F.col("y.n") <= F.col("x.most"))
    return x.join(y, same).where(fits).select(F.col("y.sig").alias("a"), F.col("x.sig").alias("b")).distinct()


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without the lines that match an earlier one."""
    tables = Tables(docs.sparkSession)
    gone = removed_lines(docs, tables, id_col, text_col).select(F.struct("id", "th").alias("_place"), F.col("lines").alias("_lines"))
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    at = docs.columns.index(text_col)
    row = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in names.items()], F.struct(*_key(id_col, text_col)).alias("_place"))
    both = row.join(gone, "_place", "left").drop("_place")

    def cut(batches):
        for batch in batches:
            lines, text = batch.column("_lines"), batch.column(at)
            hit = lines.is_valid()
            where = np.flatnonzero(hit.to_numpy(zero_copy_only=False))
            new = []
            for t, gone_here in zip(text.take(pa.array(where)).to_pylist(), lines.take(pa.array(where)).to_pylist(), strict=True):
                gone_here = set(gone_here)
                new.append("\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone_here))
            text = pc.replace_with_mask(text, hit, pa.array(new, text.type))
            yield pa.RecordBatch.from_arrays([text if i == at else batch.column(i) for i in range(len(names))], names=list(names.values()))

    out = both.mapInArrow(cut, both.drop("_lines").schema)
    return out.select(*[F.col(k).alias(c) for c, k in names.items()])


def op9_prefix_filter(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = dedup_lines(docs.withColumn("_n", F.size(F.split("text", "\n", -1)).cast("long")))
    n_kept = F.when(F.col("text") == "", F.lit(0)).otherwise(F.size(F.split("text", "\n", -1))).cast("long")
    return kept.select("doc_id", F.col("_n").alias("n_lines"), n_kept.alias("n_kept"), F.sha2("text", 256).alias("text_sha256"))


#: All pairs of lines that share a shingle, and their Jaccard similarity.
OP9_SQL = r"""
WITH l AS (SELECT doc_id, i, line, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
           FROM (SELECT doc_id, unnest(range(len(x))) AS i, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents))),
s AS (SELECT DISTINCT doc_id, i, array_to_string(w[k : k + 4], ' ') AS g FROM (SELECT doc_id, i, w, unnest(range(1, len(w) - 3)) AS k FROM l WHERE len(w) >= 5)),
n AS (SELECT doc_id, i, count(*) AS n FROM s GROUP BY ALL),
o AS (SELECT a.doc_id AS da, a.i AS ia, b.doc_id AS db, b.i AS ib, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND (a.doc_id < b.doc_id OR a.doc_id = b.doc_id AND a.i < b.i) GROUP BY ALL),
gone AS (SELECT DISTINCT db AS doc_id, ib AS i FROM o JOIN n p ON p.doc_id = da AND p.i = ia JOIN n q ON q.doc_id = db AND q.i = ib WHERE 100 * c >= 75 * (p.n + q.n - c)),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS t FROM l ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_lines, CAST(CASE WHEN coalesce(t, '') = '' THEN 0 ELSE len(string_split(t, chr(10))) END AS BIGINT) AS n_kept, sha256(coalesce(t, '')) AS text_sha256
FROM documents LEFT JOIN kept USING (doc_id)
"""
