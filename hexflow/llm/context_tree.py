"""LM scoring by context-tree weighting over bytes, beside a smoothed word base.

The model codes a text's bytes (A-Z lower-cased) and an end sign, each byte as eight binary
decisions.  A decision's contexts are the last 0 to ``DEPTH`` bytes; every context and
decision has a Krichevsky-Trofimov estimate, and a context mixes its own estimate with
its children's in equal prior parts, so all depths are weighted by how well they coded
the training texts.  Before a text stand bytes 0.

Texts are dealt into chunks of about ``CHUNK_BYTES``.  A chunk sends the distinct words and
byte grams it holds, with their training counts, to buckets dealt by hash; buckets add up the
counts; the tree is built from depth 3 down in groups that hold whole sets of contexts alike in their
last three bytes; and each
chunk gets back one number for each of its words and grams, in the order it sent them.  So
nothing that grows without bound is broadcast or gathered: the sums of the upper levels (at most 2^24
decisions of two bytes' contexts, of which text has a few in a hundred; 12 bytes each when broadcast)
and five sums reach the driver.  Chances travel as log odds, which do not saturate.

Defined results: a null or empty text is only its end sign; a null doc_id counts as training.
An empty training set leaves every estimate at one half and every count at nought.  Every
document row gives one result row, repeated rows included.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexflow.llm import text as T
from hexflow.llm.shared import Tables

DEPTH = 5
CHUNK_BYTES = 16_000_000
#: Distinct words and grams in a bucket, about.
BUCKET_ENTRIES = 500_000
END = 0xFF  # no UTF-8 text holds it
_LN2 = np.log(2.0)
WORD, GRAM = 0, 1


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Log of the gamma function for x >= 0.5, by Stirling's series from x + 8 on."""
    x = np.asarray(x, dtype=float)
    shift = np.ones_like(x)
    for i in range(8):
        shift *= x + i
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(shift)


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log probability that the KT estimator gives to a zeros and b ones."""
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1.0) - np.log(np.pi)


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Context and byte at each place of each text and at its end; offsets of the texts' grams.

    A gram holds the last byte's context highest: c1, c2, ..., cDEPTH, then the coded byte.
    """
    n = np.diff(offsets)
    k = len(n)
    at = np.concatenate([[0], np.cumsum(n + DEPTH + 1)])
    padded = np.zeros(at[-1], dtype=np.uint8)
    padded[np.arange(len(data)) + np.repeat(at[:-1] - offsets[:-1] + DEPTH, n)] = data
    padded[at[1:] - 1] = END
    wide = padded.astype(np.uint64)
    g = wide.copy()
    for j in range(1, DEPTH + 1):
        g[j:] |= wide[:-j] << np.uint64(8 * (DEPTH + 1 - j))
    coded = np.ones(len(padded), dtype=bool)
    coded[(at[:-1, None] + np.arange(DEPTH)).ravel()] = False
    return g[coded], np.concatenate([[0], np.cumsum(n + 1)])


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and their counts added up."""
    keys = np.concatenate([k for k, _ in parts])
    order = np.argsort(keys)
    keys, counts = keys[order], np.concatenate([c for _, c in parts])[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first, dtype=np.uint32) if len(first) else counts


#: Entries of a chunk that wait before they are added up.
PENDING = 1 << 20


def _entries(table: pa.Table):
    """The chunk's slices, and its distinct words and grams with training counts, ascending."""
    offsets, data = T.utf8(table.column("text"))
    train = ~table.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
    nothing = np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    parts: dict[int, list] = {WORD: [nothing], GRAM: [nothing]}
    for a, b in T.slices(offsets):
        w = T.words(offsets, data, a, b, T.SPACED)
        g, first = grams(w.data, w.offsets)
        for kind, keys, n in ((WORD, w.hashes(), w.n), (GRAM, g, np.diff(first))):
            learned = np.repeat(train[a:b], n)
            found, counts = np.unique(keys[learned], return_counts=True)
            asked = np.unique(keys[~learned])
            parts[kind].append((np.concatenate([found, asked]), np.concatenate([counts, np.zeros(len(asked), np.int64)]).astype(np.uint32)))
            if sum(len(k) for k, _ in parts[kind][1:]) > PENDING:
                parts[kind] = [_summed(parts[kind])]
    return (offsets, data), {kind: _summed(own) for kind, own in parts.items()}


def _bucket(keys: np.ndarray, n: int) -> np.ndarray:
    return (T.mix(keys) % np.uint64(n)).astype(np.int64)


def _above(code: np.ndarray) -> np.ndarray:
    """Decisions of the contexts without their furthest byte."""
    return ((code >> np.uint64(16)) << np.uint64(8)) | (code & np.uint64(0xFF))


def _tree(key: np.ndarray, count: np.ndarray):
    """Per depth 3..DEPTH: decision codes, log KT, log weighted, zeros, ones; for grams of whole depth-3 subtrees.

    Then their sums for depth 2: codes, zeros, ones, log weighted; and each gram's symbol and context.
    """
    levels = {}
    symbol = (key & np.uint64(0xFF)).astype(np.int64)
    context = key >> np.uint64(8)
    live = count > 0
    node = np.concatenate([(1 << i) | (symbol[live] >> (8 - i)) for i in range(8)])
    bit = np.concatenate([(symbol[live] >> (7 - i)) & 1 for i in range(8)])
    times = np.tile(count[live].astype(float), 8)
    code = (np.tile(context[live], 8) << np.uint64(8)) | node.astype(np.uint64)
    zeros, ones, below = times * (bit == 0), times * (bit == 1), None
    for depth in range(DEPTH, 2, -1):
        codes, back = np.unique(code, return_inverse=True)
        zeros, ones = (np.bincount(back, weights=x, minlength=len(codes)) for x in (zeros, ones))
        kt = log_kt(zeros, ones)
        weighted = kt if below is None else np.logaddexp(kt, np.bincount(back, weights=below, minlength=len(codes))) - _LN2
        levels[depth] = codes, kt, weighted, zeros, ones
        code, below = _above(codes), weighted
    codes, back = np.unique(code, return_inverse=True)
    return levels, (codes, *(np.bincount(back, weights=x, minlength=len(codes)) for x in (zeros, ones, below))), symbol, context


def _mixed(share, zeros, ones, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chances of a one and of a zero: the context's own estimate in its share, the deeper ones' in the rest."""
    n = zeros + ones + 1
    return share * (ones + 0.5) / n + (1 - share) * p, share * (zeros + 0.5) / n + (1 - share) * q


def _chances(levels, symbol, context) -> np.ndarray:
    """Log odds of a one at each gram's eight decisions, from depth 3 down."""
    out = np.empty((len(symbol), 8))
    for i in range(8):
        node = ((1 << i) | (symbol >> (8 - i))).astype(np.uint64)
        p = q = np.full(len(symbol), 0.5)
        for depth in range(DEPTH, 2, -1):
            codes, kt, weighted, zeros, ones = levels[depth]
            code = ((context >> np.uint64(8 * (DEPTH - depth))) << np.uint64(8)) | node
            if not len(codes):
                continue
            at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
            known = codes[at] == code
            share = np.exp(kt[at] - weighted[at] - (_LN2 if depth < DEPTH else 0.0))
            p, q = (np.where(known, x, 0.5) for x in _mixed(share, zeros[at], ones[at], p, q))
        out[:, i] = np.log(p) - np.log(q)
    return out


@dataclass
class Upper:
    """Depths 2 to 0: codes of the decisions, ascending, the contexts' shares, and log odds of their own estimates."""

    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, code: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> Upper:
        """From the sums of depth 2's decisions over the groups."""
        levels = []
        for _ in range(3):
            codes, back = np.unique(code, return_inverse=True)
            zeros, ones, below = (np.bincount(back, weights=x, minlength=len(codes)) for x in (zeros, ones, below))
            kt = log_kt(zeros, ones)
            weighted = np.logaddexp(kt, below) - _LN2
            levels.append((codes.astype(np.uint32), np.exp(kt - weighted - _LN2).astype(np.float32), np.log((ones + 0.5) / (zeros + 0.5)).astype(np.float32)))
            code, below = _above(codes), weighted
        return cls(levels)

    def log10(self, key: np.ndarray, odds: np.ndarray) -> np.ndarray:
        """Log probability of each gram's symbol, from the deeper levels' log odds of its eight decisions."""
        symbol, total = (key & np.uint64(0xFF)).astype(np.int64), np.zeros(len(key))
        for i in range(8):
            node = ((1 << i) | (symbol >> (8 - i))).astype(np.uint64)
            p, q = 1 / (1 + np.exp(-odds[:, i])), 1 / (1 + np.exp(odds[:, i]))
            for depth, (codes, share, own) in zip((2, 1, 0), self.levels, strict=True):
                if not len(codes):
                    continue
                code = (((key >> np.uint64(8 * (DEPTH + 1 - depth))) << np.uint64(8)) | node).astype(np.uint32)
                at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
                known, w, o = codes[at] == code, share[at].astype(float), own[at].astype(float)
                p, q = (np.where(known, w / (1 + np.exp(-s * o)) + (1 - w) * x, 0.5) for s, x in ((1, p), (-1, q)))
            total += np.log10(np.where((symbol >> (7 - i)) & 1, p, q))
        return total


def score(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte`` of every document; the others train.

    The last is the model's code length, spread over the text's bytes and its end sign.
    """
    tables = Tables(docs.sparkSession)
    given = docs.select(F.col(id_col).alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size, trained = given.agg(F.sum(F.octet_length("text")), F.count_if(~F.col("held_out"))).first()
    n_chunks = max(1, -(-(size or 0) // CHUNK_BYTES))
    n_buckets = n_groups = max(64, (size or 0) // 30 // BUCKET_ENTRIES)
    given = given.withColumn("chunk", F.pmod(F.xxhash64("id", "text"), F.lit(n_chunks)))

    def ask(table: pa.Table) -> pa.Table:
        rows = []
        for kind, (keys, counts) in _entries(table)[1].items():
            bucket = _bucket(keys, n_buckets)
            order = np.argsort(bucket, kind="stable")
            cut = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
            keys, counts = keys[order], counts[order]
            rows += [(k * 2 + kind, keys[a:b].tobytes(), counts[a:b].tobytes()) for k, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]
        cols = list(zip(*rows, strict=True)) or [(), (), ()]
        chunk = pa.array([table.column("chunk")[0].as_py()] * len(rows), pa.int64())
        return pa.table([pa.array(cols[0], pa.int64()), chunk, pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())], names=["bucket", "chunk", "keys", "counts"])

    asked = tables.keep(given.groupBy("chunk").applyInArrow(ask, "bucket long, chunk long, keys binary, counts binary"))

    def add(table: pa.Table):
        parts = [np.frombuffer(x, np.uint64) for x in table.column("keys").to_pylist()]
        keys, back = np.unique(np.concatenate(parts), return_inverse=True)
        counts = np.bincount(back, weights=np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("counts").to_pylist()]), minlength=len(keys))
        return parts, keys, back, counts.astype(np.int64)

    def sum_grams(table: pa.Table) -> pa.Table:
        _, keys, _, counts = add(table)
        return pa.table([pa.array(_bucket(keys >> np.uint64(8 * (DEPTH - 2)), n_groups)), pa.array(keys.view(np.int64)), pa.array(counts)], names=["part", "gram", "n"])

    def subtree(table: pa.Table) -> pa.Table:
        keys, counts = table.column("gram").to_numpy().view(np.uint64), table.column("n").to_numpy()
        levels, (codes, *sums), symbol, context = _tree(keys, counts)
        odds = _chances(levels, symbol, context).astype(np.float32)
        k, m = len(keys), len(codes)
        at = (np.arange(k + 1) * 32).astype(np.int32)
        flat = pa.Array.from_buffers(pa.binary(), k, [None, pa.py_buffer(at.tobytes()), pa.py_buffer(odds.tobytes())])
        nought = np.zeros(k)
        return pa.table(
            [pa.array(np.concatenate([keys, codes]).view(np.int64)), pa.concat_arrays([flat, pa.nulls(m, pa.binary())]), *(pa.array(np.concatenate([nought, x])) for x in sums)],
            names=["code", "odds", "zeros", "ones", "weighted"],
        )

    counted = asked.where("bucket % 2 = 1").groupBy("bucket").applyInArrow(sum_grams, "part long, gram long, n long")
    nodes = tables.keep(counted.groupBy("part").applyInArrow(subtree, "code long, odds binary, zeros double, ones double, weighted double"))
    sums = nodes.where("odds is null").groupBy("code").agg(*(F.sum(x).alias(x) for x in ("zeros", "ones", "weighted"))).toArrow()
    top = docs.sparkSession.sparkContext.broadcast(Upper.of(sums.column("code").to_numpy().view(np.uint64), *(sums.column(c).to_numpy() for c in ("zeros", "ones", "weighted"))))

    def finish(batches):
        for batch in batches:
            key = batch.column("code").to_numpy().view(np.uint64)
            odds = np.frombuffer(b"".join(batch.column("odds").to_pylist()), np.float32).reshape(-1, 8).astype(float)
            yield pa.RecordBatch.from_arrays([pa.array(_bucket(key, n_buckets) * 2 + 1), batch.column("code"), pa.array(top.value.log10(key, odds))], names=["bucket", "gram", "value"])

    model = nodes.where("odds is not null").select("code", "odds").mapInArrow(finish, "bucket long, gram long, value double")

    def answer_grams(left: pa.Table, right: pa.Table) -> pa.Table:
        gram, value = right.column("gram").to_numpy().view(np.uint64), right.column("value").to_numpy()
        order = np.argsort(gram)
        gram, value = gram[order], value[order].astype(np.float32)
        out = [value[np.searchsorted(gram, np.frombuffer(x, np.uint64))].tobytes() for x in left.column("keys").to_pylist()]
        return pa.table([left.column("chunk"), left.column("bucket"), pa.array(out, pa.binary())], names=["chunk", "bucket", "answer"])

    def answer_words(table: pa.Table) -> pa.Table:
        parts, _, back, counts = add(table)
        at = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        out = [counts[back[a:b]].astype(np.uint32).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
        k = len(out)
        chunk = pa.array([*table.column("chunk").to_pylist(), -1], pa.int64())
        bucket = pa.array([table.column("bucket")[0].as_py()] * (k + 1), pa.int64())
        totals = [pa.array([0] * k + [int(x)], pa.int64()) for x in (counts.sum(), (counts > 0).sum())]
        return pa.table([chunk, bucket, pa.array([*out, None], pa.binary()), *totals], names=["chunk", "bucket", "answer", "n", "distinct"])

    kind = "chunk long, bucket long, answer binary"
    words = asked.where("bucket % 2 = 0").groupBy("bucket").applyInArrow(answer_words, f"{kind}, n long, distinct long")
    words = tables.keep(words)
    answers = words.where("chunk >= 0").select("chunk", "bucket", "answer").union(asked.where("bucket % 2 = 1").select("bucket", "chunk", "keys").groupBy("bucket").cogroup(model.groupBy("bucket")).applyInArrow(answer_grams, kind))
    n_words, v_words = (x or 0 for x in words.where("chunk < 0").agg(F.sum("n"), F.sum("distinct")).first())
    total, distinct = n_words + trained, v_words + (trained > 0)
    unit = np.log10(total + 0.5 * (distinct + 1))

    def finish_chunk(left: pa.Table, right: pa.Table) -> pa.Table:
        (offsets, data), entries = _entries(left)
        got = {(b % 2, b // 2): x for b, x in zip(right.column("bucket").to_pylist(), right.column("answer").to_pylist(), strict=True)}
        value = {}
        for which, (keys, _) in entries.items():
            order = np.argsort(_bucket(keys, n_buckets), kind="stable")
            flat = b"".join(got[which, k] for k in range(n_buckets) if (which, k) in got)
            value[which] = np.empty(len(keys), np.uint32 if which == WORD else np.float32)
            value[which][order] = np.frombuffer(flat, value[which].dtype)
        base, known, tokens, model_score, symbols = [], [], [], [], []
        for a, b in T.slices(offsets):
            w = T.words(offsets, data, a, b, T.SPACED)
            c = value[WORD][np.searchsorted(entries[WORD][0], w.hashes())].astype(float)
            own = w.text_of
            k = b - a
            base.append(np.bincount(own, weights=np.log10(c + 0.5) - unit, minlength=k) + (np.log10(trained + 0.5) - unit))
            known.append(np.bincount(own, weights=c > 0, minlength=k).astype(np.int64) + (trained > 0))
            tokens.append(w.n + 1)
            g, first = grams(w.data, w.offsets)
            own_grams, back = np.unique(g, return_inverse=True)
            p = value[GRAM][np.searchsorted(entries[GRAM][0], own_grams)][back].astype(float)
            model_score.append(np.add.reduceat(p, first[:-1]))
            symbols.append(np.diff(first))
        cat = lambda x: pa.array(np.concatenate(x))
        return pa.table([left.column("id"), left.column("held_out"), cat(tokens), cat(known), pa.array([total] * len(left), pa.int64()), cat(base), cat(model_score), pa.array(np.concatenate(model_score) / -np.log10(2) / np.concatenate(symbols))], names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"])

    out = f"id {given.schema['id'].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    return given.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(finish_chunk, out)


def op10_context_tree(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 1
    return score(docs, held_out).withColumnRenamed("id", "doc_id")
