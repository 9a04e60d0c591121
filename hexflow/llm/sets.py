"""Common ground of the exact joins on shingle sets: rarity, survivors, verification.

A text or line is a set of distinct 5-word shingles.  Two sets link when
``100 * |x & y| >= 75 * |x | y|``, so a set has a partner only if 75 of 100 of its tokens
occur elsewhere.  ``survivors`` counts every token over the whole corpus, drops the sets
that cannot have a partner, and orders the tokens of the others by rarity.  Tokens
travel packed: a task sends each token bucket one array instead of one row a token, and
the buckets are dealt by the token's hash.  Equal sets of a task are merged before anything is
sent, so a group of copies costs a set a task and not a set a copy.

Tokens are hashes; the packed form keeps 40 bits and the bucket.  Tokens that fall together
change the order of rarity, which may be any; a pair's overlap is wrong only if two of its own few
hundred tokens do, about n * m chances in 2^46.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexflow.llm import text as T
from hexflow.llm.shared import spread_join

#: The least Jaccard similarity of linked sets, as a fraction.
NUM, DEN = 75, 100
#: Tokens in a bucket on average, and in what a task sends at once.
BUCKET_TOKENS, FLUSH_TOKENS, FLUSH_ITEMS = 1_000_000, 700_000, 60_000


def overlap(n: int | np.ndarray, m: int | np.ndarray):
    """Least number of common tokens of linked sets of n and m tokens."""
    return -(-NUM * (n + m) // (NUM + DEN))


def prefix(n):
    """Tokens, in rarity order, of which a linked partner shares at least one."""
    return n - -(-NUM * n // DEN) + 1


def largest_partner(n, i):
    """Largest partner whose first common token can be at position i of n."""
    return (NUM + DEN) * (n - i) // NUM - n


def sketch(tokens: np.ndarray, owner: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and set hashes of k sets; ``owner`` ascends."""
    n = np.bincount(owner, minlength=k).astype(np.int64)
    total = np.concatenate([[np.uint64(0)], np.cumsum(T.mix(tokens ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)])
    at = np.concatenate([[0], np.cumsum(n)])
    return n, T.mix(total[at[1:]] - total[at[:-1]] + n.astype(np.uint64)).view(np.int64)


Units = Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]


#: Packed rows: a bucket's tokens of a sender (size: how many), its places (size: -1) or its sets (size: -2).
#: The first ``repeated`` sets of a sender stand for several places each.
NAMES = ["bucket", "sender", "size", "repeated", "packed"]
ROW = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]


def _forty(packed: np.ndarray, n: int) -> np.ndarray:
    return packed[: 4 * n].view(np.uint32).astype(np.uint64) | (packed[4 * n : 5 * n].astype(np.uint64) << np.uint64(32))


def _steps(places: np.ndarray) -> bytes:
    """Ascending places as steps of one byte, or of two or four where that is too small."""
    steps = np.diff(places.astype(np.int64), prepend=0)
    return steps.astype(np.uint8 if steps.max() < 1 << 8 else np.uint16 if steps.max() < 1 << 16 else np.uint32).tobytes()


def _places(packed: np.ndarray, n: int) -> np.ndarray:
    return np.cumsum(packed.copy().view(f"u{len(packed) // n}") if n else packed, dtype=np.int64).astype(np.uint32)


def survivors(given: DataFrame, units: Units, copies: bool = True) -> DataFrame:
    """The sets that can have a partner or, with ``copies``, a copy: ``id, th, line, n, sig, tokens``.

    ``units`` yields, for the texts of a batch, the sets' id, text hash and line (arrays), the
    distinct tokens ordered by set, and each token's set.  ``tokens`` holds the set's tokens
    that occur more than once, as uint64 in the order of rarity; the n - len(tokens)
    others would stand before them.  Of equal sets that one task read together, only the first
    has them, and without ``copies`` the others have no row.
    """
    size = given.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_buckets = max(64, size // (6 * BUCKET_TOKENS))

    def send(batches):
        task, k = TaskContext.get().partitionId() if TaskContext.get() else 0, 0
        held: list[tuple] = []
        tokens = items = 0

        def flush():
            nonlocal held, tokens, items, k
            place, sigs, sizes, toks, owners = [], [], [], [], []
            base = 0
            for ids, th, line, t, o in held:
                n, sig = sketch(t, o, len(ids))
                place.append(np.stack([ids, th, line]))
                sizes.append(n)
                sigs.append(sig)
                toks.append(t)
                owners.append(o + base)
                base += len(ids)
            n, t, o = np.concatenate(sizes), np.concatenate(toks), np.concatenate(owners)
            sig, one, of, times = np.unique(np.concatenate(sigs), return_index=True, return_inverse=True, return_counts=True)
            turn = np.argsort(times < 2, kind="stable")  # sets of several places first
            rank = np.empty(len(turn), np.int64)
            rank[turn] = np.arange(len(turn))
            first = np.zeros(base, bool)
            first[one] = True
            kept = np.flatnonzero(first[o])
            t, o = t[kept], rank[of[o[kept]]]
            bucket = ((t & np.uint64(0xFFFFFF)) % np.uint64(n_buckets)).astype(np.int32)
            order = np.argsort(o, kind="stable")
            order = order[np.argsort(bucket[order].astype(np.uint16) if n_buckets < 65536 else bucket[order], kind="stable")]
            t, o, bucket = t[order] >> np.uint64(24), o[order].astype(np.uint32), bucket[order]
            cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, dtype=np.int64)
            end = np.concatenate([cut[1:], [len(bucket)]])
            name, repeated = (task << 24) | k, int((times > 1).sum())
            at = np.concatenate([np.concatenate(place, axis=1), rank[of][None]]).astype(np.int64)
            home = int(name % n_buckets)
            rows = [(home, name, -1, repeated, at.tobytes()), (home, name, -2, repeated, np.stack([n[one][turn], sig[turn]]).astype(np.int64).tobytes())]
            low, high = t.astype(np.uint32), (t >> np.uint64(32)).astype(np.uint8)
            rows += [(int(bucket[a]), name, b - a, repeated, low[a:b].tobytes() + high[a:b].tobytes() + _steps(o[a:b])) for a, b in zip(cut.tolist(), end.tolist(), strict=True)]
            held, tokens, items, k = [], 0, 0, k + 1
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, ROW, strict=True)], names=NAMES)

        for batch in batches:
            for unit in units(batch):
                if items + len(unit[0]) > FLUSH_ITEMS and held:
                    yield flush()
                if len(unit[0]):
                    held.append(unit)
                tokens, items = tokens + len(unit[3]), items + len(unit[0])
                if tokens >= FLUSH_TOKENS:
                    yield flush()
        if held:
            yield flush()

    def count(table: pa.Table) -> pa.Table:
        rows = list(zip(*(table.column(c).to_pylist() for c in NAMES), strict=True))
        out = [r for r in rows if r[2] < 0]
        parts = [(s, n, d, np.frombuffer(p, np.uint8)) for _, s, n, d, p in rows if n >= 0]
        if parts:
            owners = [_places(p[5 * n :], n) for _, n, _, p in parts]
            _, back = np.unique(np.concatenate([_forty(p, n) for _, n, _, p in parts]), return_inverse=True)
            df = np.bincount(back, weights=np.concatenate([1.0 + (o < d * copies) for o, (_, _, d, _) in zip(owners, parts, strict=True)])).astype(np.int64)[back]
            at = np.cumsum([0, *(n for _, n, _, _ in parts)])
            for (s, n, d, p), own, a in zip(parts, owners, at, strict=False):
                keep = np.flatnonzero(df[a : a + n] > 1)
                if len(keep):
                    # rarity only orders the tokens, alike in all sets: beyond 65535 it need not tell them apart
                    often = np.minimum(df[a : a + n][keep], 65535).astype(np.uint16)
                    low, high = p[: 4 * n].view(np.uint32)[keep], p[4 * n : 5 * n][keep]
                    out.append((rows[0][0], s, len(keep), d, low.tobytes() + high.tobytes() + often.tobytes() + _steps(own[keep])))
        cols = list(zip(*out, strict=True)) or [()] * 5
        return pa.table([pa.array(c, t) for c, t in zip(cols, ROW, strict=True)], names=NAMES)

    def gather(table: pa.Table) -> pa.Table:
        rows = list(zip(*(table.column(c).to_pylist() for c in NAMES), strict=True))
        at = np.frombuffer(next(r[4] for r in rows if r[2] == -1), np.int64).reshape(4, -1)
        n, sig = np.frombuffer(next(r[4] for r in rows if r[2] == -2), np.int64).reshape(2, -1)
        parts = [(b, k, np.frombuffer(p, np.uint8)) for b, _, k, _, p in rows if k >= 0]
        if parts:
            t = np.concatenate([(_forty(p, k) << np.uint64(24)) | np.uint64(b) for b, k, p in parts])
            df = np.concatenate([p[5 * k : 7 * k].copy().view(np.uint16) for _, k, p in parts])
            own = np.concatenate([_places(p[7 * k :], k) for _, k, p in parts])
        else:
            t, df, own = np.zeros(0, np.uint64), np.zeros(0, np.uint16), np.zeros(0, np.uint32)
        known = np.bincount(own, minlength=len(n))
        fit = (known > 0) & (DEN * known >= NUM * n)
        keep = fit[own]
        t, df, own = t[keep], df[keep], own[keep]
        order = np.lexsort((t, df))
        order = order[np.argsort(own[order], kind="stable")]
        t = t[order]
        end = np.cumsum(np.where(fit, known, 0))
        live = np.flatnonzero(fit[at[3]])
        of = at[3][live]
        first = np.zeros(len(live), bool)
        first[np.unique(of, return_index=True)[1]] = True
        if not copies:
            live, of, first = live[first], of[first], first[first]
        # the sets' tokens stand in the order of the sets, the places' in that of the places
        size = np.where(first, known[of], 0)
        cut = np.concatenate([[0], np.cumsum(size)])
        flat = t[np.repeat(end[of] - known[of] - cut[:-1], size) + np.arange(cut[-1])]
        bits = pa.py_buffer(np.packbits(first, bitorder="little").tobytes())
        packed = pa.Array.from_buffers(pa.binary(), len(live), [bits, pa.py_buffer((cut * 8).astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())])
        cols = [at[0][live], at[1][live], at[2][live], n[of], sig[of]]
        return pa.table([*map(pa.array, cols), packed], names=["id", "th", "line", "n", "sig", "tokens"])

    kind = "bucket int, sender long, size int, repeated int, packed binary"
    counted = given.mapInArrow(send, kind).groupBy("bucket").applyInArrow(count, kind)
    return counted.groupBy("sender").applyInArrow(gather, "id long, th long, line long, n long, sig long, tokens binary")


def classes(found: DataFrame, *more: F.Column) -> DataFrame:
    """A row for each different set: ``sig, n, tokens``, ``alone`` (how many of its tokens no other set has), and these aggregates."""
    one = found.groupBy("sig").agg(F.first("n").alias("n"), F.first("tokens", ignorenulls=True).alias("tokens"), *more)
    return one.withColumn("alone", F.col("n") - (F.octet_length("tokens") / 8).cast("long"))


def common(a: bytes, b: bytes) -> int:
    return len(np.intersect1d(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), assume_unique=True))


def verified(pairs: DataFrame, classes: DataFrame, total: int) -> DataFrame:
    """Those of the ``total`` ``pairs`` (a, b: set hashes) whose sets link; a's tokens travel to b's."""
    held = classes.select("sig", "n", "tokens")
    # a set may be in a great many pairs as their first
    often = pairs.groupBy("a").agg(F.count("*").alias("_size"))
    first = held.select(F.col("sig").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta")).join(often, "a")
    both = spread_join(pairs, first, "a", "_size", total).drop("_size")
    both = both.join(held.select(F.col("sig").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb")), "b")

    def check(batches):
        for batch in batches:
            na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            got = np.array([common(x, y) for x, y in zip(batch.column("ta").to_pylist(), batch.column("tb").to_pylist(), strict=True)], dtype=np.int64)
            keep = pa.array(DEN * got >= NUM * (na + nb - got))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    return both.mapInArrow(check, "a long, b long")


def postings(classes: DataFrame, columns: tuple[str, ...], least: int = 0) -> DataFrame:
    """Inverted-list entries of the sets' prefixes: ``key, sig, n, most`` and these columns.

    ``most`` is the largest partner whose first common token can be the entry's.
    """

    def entries(batches):
        for batch in batches:
            n, tokens = batch.column("n").to_numpy(), batch.column("tokens").to_pylist()
            keys, owner, most = [], [], []
            for i, raw in enumerate(tokens):
                t = np.frombuffer(raw, np.uint64)
                alone = n[i] - len(t)
                take = max(0, prefix(n[i]) - alone)
                if n[i] < least or not take:
                    continue
                at = alone + np.arange(min(take, len(t)))
                keys.append(t[: len(at)])
                owner.append(np.full(len(at), i))
                most.append(largest_partner(n[i], at))
            if not keys:
                continue
            own = pa.array(np.concatenate(owner))
            rest = [batch.column(c).take(own) for c in ("sig", "n", *columns)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(most)), *rest], names=["key", "most", "sig", "n", *columns])

    kinds = {f.name: f.dataType.simpleString() for f in classes.schema}
    given = classes.select("sig", "n", "tokens", *columns)
    return given.mapInArrow(entries, "key long, most long, sig long, n long" + "".join(f", {c} {kinds[c]}" for c in columns))
