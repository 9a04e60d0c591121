"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words become symbols (insult, threat verb, target, negator, reporting verb, intent);
three letter-to-letter transducers (negation scope, reported speech, target and threat)
are composed into one, and each clause is read by the composition.  What it writes
tells matched patterns apart: an aimed insult from a bare, a negated or a reported one.
A text's score is the logistic of the weighted pattern counts.

The lexicon is short lists of words in four languages plus words and word stems learned from
labelled rows; the weights are fitted on the same rows around hand-set values.  Both use
at most ``SAMPLE`` labelled documents, chosen by a hash of their id, and lexicon and
weights are all that reaches the driver.

Defined results: a null or empty text, or one without a match, gets the grammar's base score.
Labels that are null, or whose doc_id is null or without a document, teach nothing; a document with
several labels counts as toxic if one says so, and of several texts with one doc_id the one of least hash teaches.  Without labels, the hand-set weights
and the listed words hold.  Every document row gives one result row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexflow.llm import text as T
from hexflow.llm.shared import Tables

#: Most labelled documents that lexicon and weights are learned from.
SAMPLE = 20_000
#: Most candidate words and stems, and the toxic documents that a new one must explain.
CANDIDATES, SUPPORT = 5_000, 4
STEM_BYTES = (4, 5, 6, 7, 8)

OTHER, INSULT, THREAT, TARGET, NEGATOR, REPORT, INTENT, STOP = "oITPNRF."
# Words of each symbol, in English, German, French and Spanish.
WORDS = {
    INSULT: "idiot idiots moron morons stupid loser losers pathetic worthless scum trash clown disgusting dumb imbecile retard bastard bitch asshole fool filthy vermin garbage jerk degenerate cretin dimwit",
    THREAT: "kill hurt murder destroy beat stab shoot strangle burn hang töten umbringen ermorden erschießen verprügeln tuer assassiner frapper égorger matar asesinar golpear degollar",
    TARGET: "you your yours youre he him she her they them their u dich dir euch euer deine ihn ihnen toi vous votre elle eux usted ustedes vosotros ella ellos",
    NEGATOR: "not no never isn aren wasn don doesn nor without neither nicht kein keine nie pas jamais nunca",
    REPORT: "said says say wrote writes claimed claims quoted quote reported reports alleged called told tells sagte sagten schrieb schreibt behauptet zitierte dijo dijeron escribió afirmó citó affirma écrit déclara",
    INTENT: "will gonna going ll shall must should want wanna werde werden wirst soll sollte vais allons faut veux voy vamos quiero debería",
}


@dataclass
class Transducer:
    """Deterministic and letter to letter: ``step(state, symbol)`` gives the next state and what is written."""

    start: object
    step: object

    def compose(self, other: Transducer) -> Transducer:
        """Reads as this one, and writes what ``other`` writes for this one's writing."""

        def step(state, symbol):
            a, mid = self.step(state[0], symbol)
            b, out = other.step(state[1], mid)
            return (a, b), out

        return Transducer((self.start, other.start), step)

    def table(self, alphabet: str) -> tuple[list[dict[str, int]], list[dict[str, str]]]:
        """All states reachable over the alphabet, as transition and output tables."""
        found, todo, go, out = {self.start: 0}, [self.start], [], []
        for state in todo:
            go.append({})
            out.append({})
            for x in alphabet:
                after, out[-1][x] = self.step(state, x)
                if after not in found:
                    found[after] = len(todo)
                    todo.append(after)
                go[-1][x] = found[after]
        return go, out


def negation(scope: int = 3) -> Transducer:
    """Insults (i) and threats (t) within so many words of a negator."""

    def step(left, x):
        if x == NEGATOR:
            return scope, x
        if x == STOP:
            return 0, x
        return max(0, left - 1), x.lower() if left and x in (INSULT, THREAT) else x

    return Transducer(0, step)


def reported() -> Transducer:
    """Insults (J) and threats (U) that follow a reporting verb in their clause."""

    def step(on, x):
        if x in (REPORT, STOP):
            return int(x == REPORT), x
        return on, {INSULT: "J", THREAT: "U"}.get(x, x) if on else x

    return Transducer(0, step)


def aimed(scope: int = 5) -> Transducer:
    """Insults near a target after it (A), and threats between intent and target (K)."""

    def step(state, x):
        target, intent = state
        after = (scope if x == TARGET else max(0, target - 1), scope if x == INTENT else max(0, intent - 1))
        if x == STOP:
            return (0, 0), x
        if x == INSULT and target:
            return after, "A"
        return after, "K" if x == THREAT and (intent or target) else x

    return Transducer((0, 0), step)


#: What the grammar writes for a match, with hand-set weights of log1p(count).
PATTERNS = {"I": 5.0, "A": 6.0, "J": 1.5, "i": 1.0, "K": 6.0, "T": 0.3, "U": 0.3, "t": 0.0}
BASE = -4.0
GO, OUT = negation().compose(reported()).compose(aimed()).table(OTHER + INSULT + THREAT + TARGET + NEGATOR + REPORT + INTENT + STOP)


@dataclass
class Grammar:
    """Lexicon (word hashes with their symbols, stem hashes) and the weights of the patterns."""

    words: np.ndarray
    symbols: np.ndarray
    stems: dict[int, np.ndarray]
    weights: np.ndarray

    @classmethod
    def of(cls, learned: list[str], stems: list[str]) -> Grammar:
        lexicon = {w: s for s, ws in WORDS.items() for w in ws.split()} | dict.fromkeys(learned, INSULT)
        hashed = T.hash_words(list(lexicon))
        order = np.argsort(hashed)
        by_length = {n: np.sort(T.hash_words(own)) for n in STEM_BYTES if (own := [s for s in stems if len(s.encode()) == n])}
        return cls(hashed[order], np.array([ord(x) for x in lexicon.values()], dtype=np.uint8)[order], by_length, np.array([BASE, *PATTERNS.values()]))

    def symbols_of(self, w: T.Words) -> np.ndarray:
        h = w.hashes()
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        out = np.where(self.words[at] == h, self.symbols[at], np.uint8(ord(OTHER)))
        for n, known in self.stems.items():
            long = np.flatnonzero(w.ends - w.starts >= n)
            x = w.hashes(w.starts[long], w.starts[long] + n)
            at = np.minimum(np.searchsorted(known, x), len(known) - 1)
            out[long[known[at] == x]] = ord(INSULT)
        return out

    def counts(self, column: pa.Array) -> np.ndarray:
        """For each text, how often each pattern matched in its clauses."""
        offsets, data = T.utf8(column)
        found = np.zeros((len(column), len(PATTERNS)))
        names = {x: i for i, x in enumerate(PATTERNS)}
        for a, b in T.slices(offsets):
            w = T.words(offsets, data, a, b, T.ALNUM)
            symbols = self.symbols_of(w)
            stops = np.concatenate([[0], np.cumsum(_STOPS[w.data])])
            clause = stops[w.starts]
            hits = np.flatnonzero((symbols == ord(INSULT)) | (symbols == ord(THREAT)))
            owner = np.searchsorted(w.first, hits, "right") - 1
            for text, c in sorted(set(zip(owner.tolist(), clause[hits].tolist(), strict=True))):
                lo, hi = w.first[text], w.first[text + 1]
                x, y = lo + np.searchsorted(clause[lo:hi], c), lo + np.searchsorted(clause[lo:hi], c, "right")
                state = 0
                for s in symbols[x:y].tobytes().decode():
                    if (out := OUT[state][s]) in names:
                        found[a + text, names[out]] += 1
                    state = GO[state][s]
        return found

    def score(self, counts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.weights[0] + np.log1p(counts) @ self.weights[1:])))

    def fit(self, counts: np.ndarray, toxic: np.ndarray, prior: float = 1.0) -> None:
        """Newton steps for the logistic likelihood with a Gaussian prior at the hand-set weights."""
        x = np.hstack([np.ones((len(counts), 1)), np.log1p(counts)])
        at = self.weights.copy()
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
            slope = x.T @ (toxic - p) - prior * (at - self.weights)
            move = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + prior * np.eye(len(at)), slope)
            at += np.clip(move, -2, 2)
            if np.abs(move).max() < 1e-8:
                break
        self.weights = at


_STOPS = np.zeros(256, dtype=np.int64)
_STOPS[[ord(c) for c in ".!?;:\n"]] = 1


def _terms(text: str) -> set[str]:
    """Words, and word stems marked by a trailing ``*``."""
    w = T.words(*T.utf8(pa.array([text])), 0, 1, T.ALNUM)
    raw = w.data.tobytes()
    found = set()
    for a, b in zip(w.starts.tolist(), w.ends.tolist(), strict=True):
        word = raw[a:b]
        found.add(word)
        found.update(word[:n] + b"*" for n in STEM_BYTES if n <= len(word))
    return {x.decode() for x in found if (x[:-1] if x.endswith(b"*") else x).decode("utf-8", "ignore").encode() == x.removesuffix(b"*")}


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Grammar:
    """A grammar from at most ``SAMPLE`` labelled documents."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(SAMPLE)  # the bound of the broadcast
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known), "id")
    # a label teaches once, however many rows repeat its doc_id
    one = chosen.groupBy("id").agg(F.min_by(F.struct("text", "toxic"), F.xxhash64("text")).alias("row"))
    tables = Tables(docs.sparkSession)
    sample = tables.keep(one.select("row.text", "row.toxic"))

    def count(batches):
        pos, neg = {}, {}
        for batch in batches:
            for text, toxic in zip(batch.text, batch.toxic, strict=True):
                into = pos if toxic == 1 else neg
                for term in _terms(text or ""):
                    into[term] = into.get(term, 0) + 1
        yield pd.DataFrame([(t, pos.get(t, 0), neg.get(t, 0)) for t in pos.keys() | neg.keys()], columns=["term", "pos", "neg"])

    counts = sample.mapInPandas(count, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    counts = counts.where((F.col("pos") >= SUPPORT) & (F.col("pos") >= 3 * F.col("neg")))
    candidates = counts.orderBy(F.desc(F.col("pos") - F.col("neg")), "term").limit(CANDIDATES).toPandas()
    terms = set(candidates.term)
    bad = dict(zip(candidates.term, candidates.neg, strict=True))
    marked = docs.sparkSession.sparkContext.broadcast(terms)

    def occurrences(batches):
        for batch in batches:
            batch = batch[batch.toxic == 1]
            yield pd.DataFrame({"terms": [sorted(_terms(t or "") & marked.value) for t in batch.text]})

    covers: dict[str, set[int]] = {}
    for i, row in enumerate(sample.where("toxic = 1").mapInPandas(occurrences, "terms array<string>").collect()):
        for term in row.terms:
            covers.setdefault(term, set()).add(i)
    grammar = Grammar.of(*explain(covers, bad))
    shared = docs.sparkSession.sparkContext.broadcast(grammar)

    def features(batches):
        for batch in batches:
            yield pd.DataFrame({"counts": list(shared.value.counts(pa.array(batch.text))), "toxic": batch.toxic})

    rows = sample.mapInPandas(features, "counts array<double>, toxic int").toPandas()
    tables.drop(sample)
    if len(rows):
        grammar.fit(np.stack(rows.counts), (rows.toxic == 1).to_numpy(float))
    return grammar


def explain(covers: dict[str, set[int]], bad: dict[str, int]) -> tuple[list[str], list[str]]:
    """Greedily, the words and stems that explain toxic documents not explained so far.

    So the rare words that copies of one toxic document share do not enter the lexicon.
    """
    covers = {t: set(d) for t, d in covers.items()}
    chosen: list[str] = []
    while covers:
        best = max(covers, key=lambda t: (len(covers[t]) - 3 * bad[t], -len(t), t))
        if len(covers[best]) - 3 * bad[best] < SUPPORT:
            break
        chosen.append(best)
        done = covers.pop(best)
        covers = {t: left for t, d in covers.items() if (left := d - done)}
    return [t for t in chosen if not t.endswith("*")], [t[:-1] for t in chosen if t.endswith("*")]


def score(docs: DataFrame, grammar: Grammar, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and ``score`` of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(grammar)

    def scan(batches):
        for batch in batches:
            scores = shared.value.score(shared.value.counts(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(scores)], names=["id", "score"])

    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return given.mapInArrow(scan, f"id {given.schema['id'].dataType.simpleString()}, score double")


def drop_toxic(docs: DataFrame, grammar: Grammar, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The documents whose score stays below the threshold, with their own columns."""
    shared = docs.sparkSession.sparkContext.broadcast(grammar)
    at = docs.columns.index(text_col)

    def scan(batches):
        for batch in batches:
            keep = shared.value.score(shared.value.counts(batch.column(at))) < threshold
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(scan, docs.schema)


def op6_pattern_grammar(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    scored = score(docs, learn(docs, labels.where(~held_out)))
    return scored.select(F.col("id").alias("doc_id"), F.pmod(F.crc32(F.col("id").cast("string")), F.lit(4)).eqNullSafe(2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
