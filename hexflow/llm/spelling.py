"""Spelling variants by forward and backward minimal acyclic automata.

The words of a corpus that occur often enough are held in automata whose states count the words below them, so that
a walk also yields the word's number among the sorted words (a perfect hash).  One error leaves one half of a word
untouched: the forward automaton is walked exactly along the first half and completed with one error, the backward
automaton, which holds the words reversed, likewise along the last half.  What the backward walk finds is dropped if the first
half matches too, since the forward walk has found it; so nothing is counted twice and no pairs are exchanged: each word sends
one row with its number of near words and its best one.

Words are dealt by direction and first ``KEY`` code points (which any untouched half holds) into groups of about
``PART`` words, an automaton each.  A beginning that more than PART words share is dealt by length and whole half instead,
its words being held under the three lengths that one error can ask from; a half that still has more than PART words is cut into
parts and blocks of asking words, each part meeting each block.  So no group is unbounded and none is capped.

Defined results: a null text has no words; a null id is written as an empty one; rows that repeat an id and text count
each; words of fewer than ``LETTERS`` code points are left out; an empty table gives no row.  Other columns, whatever
their names, don't matter.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexflow.llm.shared import Tables

RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: A run loses a letter if this divides its checksum; least code points and occurrences of a word; how many times more frequent a form is.
SLIP, LETTERS, TWICE, TIMES = 31, 7, 2, 10
#: Code points that beginnings are dealt by (at most half of LETTERS); words of a group; words that a task counts before it sends them on.
KEY, PART, HELD = 3, 8192, 200_000


def slip(run: str, prefix: int) -> str:
    """The run, or what is left of it where its checksum, continued from the id's, deletes a code point."""
    h = zlib.crc32(run.encode(), prefix)
    return run if h % SLIP else run[: (k := h % len(run))] + run[k + 1 :]


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, n``: the words and their occurrences in whole texts."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["word", "n"])
        for batch in batches:
            for i in range(batch.num_rows):
                part = batch.slice(i, 1)
                text = pc.ascii_lower(part.column("text"))[0].as_py()
                prefix = zlib.crc32(f"{part.column('id')[0].as_py()}:".encode())
                for run, n in Counter(RUN.findall(text)).items():
                    if len(run) >= LETTERS and len(word := slip(run, prefix)) >= LETTERS:
                        seen[word] += n
                if len(seen) >= HELD:
                    yield out()
                    seen.clear()
        yield out()

    given = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return given.mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= TWICE)


class Automaton:
    """The minimal acyclic automaton of sorted, distinct words.

    A state has a mark whether a word ends there and, for each letter, the next state and how many words of this state come before those
    with that letter; summed along a walk, this is the word's number.
    """

    def __init__(self, ordered: list[str]):
        self.final: list[bool] = []
        self.next: list[dict[str, tuple[int, int]]] = []
        self.size: list[int] = []
        known: dict[tuple, int] = {}
        open_: list[tuple[list[bool], dict[str, int]]] = [([False], {})]
        last = ""

        def close(depth: int) -> None:
            while len(open_) > depth + 1:
                end, edges = open_.pop()
                open_[-1][1][last[len(open_) - 1]] = self._state(known, end[0], edges)

        for word in ordered:
            n = 0
            for a, b in zip(word, last, strict=False):
                if a != b:
                    break
                n += 1
            close(n)
            open_.extend(([False], {}) for _ in range(len(word) - n))
            open_[-1][0][0] = True
            last = word
        close(0)
        self.root = self._state(known, *[open_[0][0][0], open_[0][1]])

    def _state(self, known: dict[tuple, int], end: bool, edges: dict[str, int]) -> int:
        key = (end, *edges.items())
        if key not in known:
            known[key] = len(self.final)
            numbered, n = {}, int(end)
            for letter, to in edges.items():
                numbered[letter] = (to, n)
                n += self.size[to]
            self.final.append(end)
            self.next.append(numbered)
            self.size.append(n)
        return known[key]

    def walk(self, state: int, number: int, word: str, start: int, stop: int) -> tuple[int, int] | None:
        """The state and number after the letters from start to stop."""
        next_ = self.next
        for i in range(start, stop):
            step = next_[state].get(word[i])
            if step is None:
                return None
            state, number = step[0], number + step[1]
        return state, number

    def number(self, word: str) -> int | None:
        """The word's place among the sorted words."""
        at = self.walk(self.root, 0, word, 0, len(word))
        return at[1] if at and self.final[at[0]] else None

    def near(self, word: str, exact: int) -> set[int]:
        """Numbers of the words that begin with the first ``exact`` letters and differ from this one by one error after them."""
        found: set[int] = set()
        at, n = self.walk(self.root, 0, word, 0, exact), len(word)

        def rest(state: int, number: int, i: int) -> None:
            if (end := self.walk(state, number, word, i, n)) and self.final[end[0]]:
                found.add(end[1])

        for i in range(exact, n + 1):
            if at is None:
                break
            state, number = at
            own, before = word[i : i + 1], word[i - 1 : i] if i > exact else ""
            if own and own != before:  # a repeated letter's deletion is that of the first
                rest(state, number, i + 1)
            for letter, (to, skipped) in self.next[state].items():
                if own and letter != own:
                    rest(to, number + skipped, i + 1)
                if letter != before:
                    rest(to, number + skipped, i)
            step = self.next[state].get(own)
            at = (step[0], number + step[1]) if step else None
        return found


def half(word: str) -> int:
    """Letters of the first half."""
    return len(word) // 2


def _within(table: pa.Table) -> pa.Table:
    """Of a group, each asking word's near words: how many, and the most frequent, by occurrences and then code points."""
    backward = bool(table.column("backward")[0].as_py())
    held = table.filter(table.column("held"))
    counts = dict(zip(held.column("spelt").to_pylist(), held.column("n").to_pylist(), strict=True))
    ordered = sorted(counts)
    automaton, turned = Automaton(ordered), [w[::-1] for w in ordered] if backward else ordered
    asking = table.filter(table.column("asks"))
    out: list[tuple] = []
    for spelt, n in zip(asking.column("spelt").to_pylist(), asking.column("n").to_pylist(), strict=True):
        word = spelt[::-1] if backward else spelt
        near = automaton.near(spelt, len(word) - half(word) if backward else half(word))
        if backward:
            near = [k for k in near if not turned[k].startswith(word[: half(word)])]
        best = min(((-counts[ordered[k]], turned[k]) for k in near), default=None)
        out.append((word, n, len(near), best and -best[0], best and best[1]))
    columns = list(zip(*out, strict=True)) or [[]] * 5
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["word", "n", "n_near", "best_n", "best"])


def _dealt(vocabulary: DataFrame, total: int) -> DataFrame:
    """``backward, place, spelt, n, held, asks``: the groups' words, and whether the group's automaton holds them or they ask it."""
    ways = F.explode(F.array(F.struct(F.lit(False).alias("backward"), F.col("word").alias("spelt")), F.struct(F.lit(True).alias("backward"), F.reverse("word").alias("spelt")))).alias("w")
    rows = vocabulary.select("n", ways).select("w.backward", "w.spelt", "n", F.substring("w.spelt", 1, KEY).alias("key"))
    bucket = lambda *c: F.pmod(F.xxhash64(*c), F.lit(max(1, -(-2 * total // PART))))
    # at most 2 total / PART beginnings, and 6 total / PART halves, are hot
    hot = F.broadcast(rows.groupBy("backward", "key").count().where(F.col("count") > PART).select("backward", "key"))
    cold = rows.join(hot, ["backward", "key"], "left_anti").select("backward", F.struct(F.lit(0).alias("kind"), bucket("backward", "key").alias("a"), F.lit(0).cast("long").alias("b")).alias("place"), "spelt", "n", F.lit(True).alias("held"), F.lit(True).alias("asks"))

    def halved(length):
        first = F.floor(length / 2).cast("int")
        return F.concat_ws(":", length, F.substring(F.col("spelt"), F.lit(1), F.when(F.col("backward"), length - first).otherwise(first)))

    rows = rows.join(hot, ["backward", "key"], "left_semi")
    long_ = F.char_length("spelt")
    asks = rows.select("backward", "spelt", "n", halved(long_).alias("half"))
    held = rows.select("backward", "spelt", "n", F.explode(F.sequence(F.greatest(long_ - 1, F.lit(LETTERS)), long_ + 1)).alias("l")).select("backward", "spelt", "n", halved(F.col("l")).alias("half"))
    parts = F.broadcast(held.groupBy("backward", "half").count().where(F.col("count") > PART).select("backward", "half", F.ceil(F.col("count") / PART).alias("parts")))
    own, every = F.pmod(F.xxhash64("spelt"), F.col("parts")), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))

    def placed(df: DataFrame, part, block, holds: bool) -> DataFrame:
        df = df.join(parts, ["backward", "half"], "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long")))
        df = df.withColumn("part", part).withColumn("block", block)
        whole = F.col("parts") == 1
        kind = F.when(whole, 1).otherwise(2)
        a = F.when(whole, bucket("backward", "half")).otherwise(F.xxhash64("half"))
        b = F.when(whole, F.lit(0).cast("long")).otherwise(F.col("part") * F.col("parts") + F.col("block"))
        return df.select("backward", F.struct(kind.alias("kind"), a.alias("a"), b.alias("b")).alias("place"), "spelt", "n", F.lit(holds).alias("held"), F.lit(not holds).alias("asks"))

    return cold.union(placed(held, own, every, True)).union(placed(asks, every, own, False))


def near_words(vocabulary: DataFrame, total: int) -> DataFrame:
    """``word, n, n_near, form, form_n`` of each word of ``vocabulary`` (distinct ``word`` with ``n``, ``total`` rows)."""
    found = _dealt(vocabulary, total).groupBy("backward", "place").applyInArrow(_within, "word string, n long, n_near long, best_n long, best string")
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("best")))).alias("b")
    out = found.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best)
    is_form = -F.col("b.m") >= TIMES * F.col("n")
    return out.select("word", "n", "n_near", F.when(is_form, F.col("b.best")).alias("form"), F.when(is_form, -F.col("b.m")).alias("form_n"))


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each word with its form, and the root that its forms lead to.

    A form is TIMES as frequent as its word, so a chain has at most log(most / 2) / log(TIMES) links, and halving
    that many jumps reaches every root.
    """
    tables = Tables(docs.sparkSession)
    vocabulary = tables.keep(words(docs, id_col, text_col))
    total, most = vocabulary.agg(F.count("*"), F.max("n")).first()
    near = tables.keep(near_words(vocabulary, total))
    tables.drop(vocabulary)
    links = int(math.log(max(most or 0, TWICE) / TWICE, TIMES)) + 1
    jumps = near.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(links))):
        further = tables.keep(jumps.join(jumps.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left").select("word", F.coalesce("next", "root").alias("root")))
        if hasattr(jumps, "_path"):
            tables.drop(jumps)
        jumps = further
    return near.join(jumps, "word", "left").withColumn("root", F.coalesce("root", "word"))


def op13_two_automata(spark, sf_dir: str) -> DataFrame:
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("word", "form", "root", "n", "n_near", "form_n")


def _crc_table() -> list[int]:
    """The reflected CRC-32 of each byte, from its polynomial."""
    out = []
    for x in range(256):
        for _ in range(8):
            x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
        out.append(x)
    return out


#: Near words by their deletions: equal with one place deleted in both (replaced), or one is the other's deletion.
OP13_SQL = rf"""
WITH RECURSIVE run AS (SELECT doc_id, run, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents)
    WHERE length(run) >= {LETTERS} GROUP BY ALL),
hexed AS (SELECT run, k, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM run),
coded AS (SELECT run, k, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(x) // 2), lambda i: CAST('0x' || x[2 * i + 1 : 2 * i + 2] AS BIGINT))),
    lambda c, b: xor(c >> 8, list_extract(CAST({_crc_table()} AS BIGINT[]), (xor(c, b) & 255) + 1))), 4294967295::BIGINT) AS h FROM hexed),
w AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (SELECT CASE WHEN h % {SLIP} = 0 THEN run[1 : h % length(run)] || run[h % length(run) + 2 :] ELSE run END AS word, k FROM coded) WHERE length(word) >= {LETTERS} GROUP BY word HAVING sum(k) >= {TWICE}),
d AS (SELECT word, n, i, word[1 : i] || word[i + 2 :] AS x FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM w)),
near AS (SELECT a.word, b.word AS other, b.n FROM d a JOIN d b ON a.i = b.i AND a.x = b.x AND a.word <> b.word UNION SELECT d.word, w.word, w.n FROM d JOIN w ON w.word = d.x UNION SELECT w.word, d.word, d.n FROM d JOIN w ON w.word = d.x),
best AS (SELECT word, count(*) AS n_near, max(n) AS most FROM near GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= {TIMES} * w.n THEN (SELECT min(other) FROM near x WHERE x.word = w.word AND x.n = most) END AS form, CASE WHEN most >= {TIMES} * w.n THEN most END AS form_n FROM w LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS here, 0 AS links FROM f UNION ALL SELECT c.word, f.form, links + 1 FROM chain c JOIN f ON f.word = c.here WHERE f.form IS NOT NULL),
root AS (SELECT word, arg_max(here, links) AS root FROM chain GROUP BY word)
SELECT word, form, root, n, n_near, CAST(form_n AS BIGINT) AS form_n FROM f JOIN root USING (word)
"""
