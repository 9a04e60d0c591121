"""SentencePiece encoding with seeded merge-dropout, and its exact inverse.

A public merge-type (BPE) model gives the pieces and their ranks; nothing is trained.
Each stretch that starts a word is segmented by taking candidate merges in rank order,
leftmost first, from an agenda.  A candidate is skipped when a hash keyed by the seed,
the document's id, the stretch, its place in the text and the candidate's span falls below ``dropout``, so
a run is reproducible while every occurrence of a word draws its own.  Without dropout the segmentation is the
library's own.  That and the merges that make it are remembered for a stretch: an occurrence none of whose
merges is skipped has the same agenda to the end and so the same pieces; only the others run theirs.  The agendas of
many stretches advance in lockstep; stretches of more than ``LOCKSTEP`` characters use a heap.

Defined results: a null text has null ids and decodes to null; an empty text has none and
decodes to an empty text.  A character without a piece, and a literal U+2581 (the
model's own sign for a space), become byte pieces, so every text decodes exactly.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexflow.llm import text as T

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = 0x2581
LOCKSTEP = 48
SLICE_BYTES = 1 << 19
#: Characters whose stretches advance together.
TOGETHER = 1 << 17
#: Segmentations without dropout that a worker remembers before it starts anew.
REMEMBERED = 100_000
_NONE = np.int64(1 << 40)
_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


@dataclass
class Memory:
    """Stretches by hash, ascending, with their pieces and merges (each start, middle and end) without dropout."""

    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    ids_at: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    spans: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    spans_at: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))

    def add(self, keys: np.ndarray, ids: np.ndarray, n: np.ndarray, spans: np.ndarray, m: np.ndarray) -> None:
        """``n`` and ``m`` have how many pieces and merges each new stretch has."""
        both = np.concatenate([self.keys, keys])
        order = np.argsort(both)
        self.keys = both[order]
        self.ids, self.ids_at = taken(np.concatenate([self.ids, ids]), np.concatenate([self.ids_at, self.ids_at[-1] + np.cumsum(n)]), order)
        self.spans, self.spans_at = taken(np.concatenate([self.spans, spans]), np.concatenate([self.spans_at, self.spans_at[-1] + np.cumsum(m)]), order)


def taken(pool: np.ndarray, at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ranges ``which`` of a pool one after the other, and their offsets."""
    n = (at[1:] - at[:-1])[which]
    own = np.concatenate([[0], np.cumsum(n)])
    return pool[np.repeat(at[which] - own[:-1], n) + np.arange(own[-1])], own


@dataclass
class Pieces:
    """A model's pieces in arrays: characters, merges by pair, bytes."""

    chars: np.ndarray  #: code point -> piece or -1
    pairs: np.ndarray  #: left * 2^20 + right, ascending
    merged: np.ndarray  #: the piece that a pair makes
    rank: np.ndarray  #: rank of each piece, lower first
    first_byte: int
    raw: np.ndarray  #: bytes of all pieces, a space for its sign
    raw_at: np.ndarray  #: pieces + 1 offsets into raw
    seed: int = 0
    dropout: float = 0.0
    _known: Memory = field(default_factory=Memory, repr=False)

    @classmethod
    def load(cls, path: str = MODEL, seed: int = 0, dropout: float = 0.0) -> Pieces:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        usual = {names[i]: i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
        if any("▁" in p.lstrip("▁") for p in usual):
            raise ValueError("a piece crosses the start of a word")
        chars = np.full(0x110000, -1, dtype=np.int32)
        for p, i in usual.items():
            if len(p) == 1:
                chars[ord(p)] = i
        found = sorted((usual[p[:k]] * (1 << 20) + usual[p[k:]], i) for p, i in usual.items() for k in range(1, len(p)) if p[:k] in usual and p[k:] in usual)
        pairs, merged = (np.array(x, dtype=np.int64) for x in zip(*found, strict=True))
        rank = np.argsort(np.argsort([-sp.get_score(i) for i in range(n)], kind="stable"), kind="stable")
        first_byte = next(i for i in range(n) if sp.is_byte(i))
        raw = [bytes([i - first_byte]) if sp.is_byte(i) else names[i].replace("▁", " ").encode() if names[i] in usual else b"" for i in range(n)]
        return cls(chars, pairs, merged, rank, first_byte, np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum([0, *map(len, raw)]), seed, dropout)

    def __getstate__(self):
        return self.__dict__ | {"_known": Memory()}

    def merges(self, left, right, key, start, middle, end):
        """The piece and the rank of each candidate; a candidate that is none or is skipped has rank _NONE."""
        pair = left * (1 << 20) + right
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        ok = (self.pairs[at] == pair) & (left >= 0) & (right >= 0)
        piece = np.where(ok, self.merged[at], -1)
        rank = np.where(ok, self.rank[piece], _NONE)
        if self.dropout and key is not None:
            real = np.flatnonzero(ok)
            key = key if np.ndim(key) == 0 else key[real]
            rank[real[self.skipped(key, start[real], middle[real], end[real])]] = _NONE
        return piece, rank

    def skipped(self, key, start, middle, end) -> np.ndarray:
        h = T.mix(key + start.astype(np.uint64) * _K[0] + middle.astype(np.uint64) * _K[1] + end.astype(np.uint64) * _K[2])
        return (h >> np.uint64(11)).astype(float) / (1 << 53) < self.dropout

    def segment(self, codes: np.ndarray, first: np.ndarray, keys: np.ndarray | None, made_by: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of stretches of code points, and how many each has; ``keys`` seed each one's skips, none are without.

        ``made_by`` receives arrays of stretches, starts, middles and ends of the merges; stretches too long for lockstep give none.
        """
        n = np.diff(first)
        long = np.flatnonzero(n > LOCKSTEP)
        alone = [self._alone(codes[first[i] : first[i + 1]], None if keys is None else keys[i]) for i in long.tolist()]
        live = np.flatnonzero((n > 0) & (n <= LOCKSTEP))
        which = np.repeat(np.arange(len(live)), n[live])
        offset = np.arange(len(which)) - np.repeat(np.cumsum(n[live]) - n[live], n[live])
        code = codes[first[live][which] + offset]
        # one row a symbol: its stretch, first character, end, piece; then the candidate with the next symbol
        symbol, begin, end = self.chars[code].astype(np.int64), offset, offset + 1
        code = code.astype(np.int64)
        keys = None if keys is None else keys[live]

        def candidates(i):
            j = i + 1
            real = j < len(symbol)
            i, j = i, np.where(real, j, i)
            piece, rank = self.merges(symbol[i], symbol[j], None if keys is None else keys[which[i]], begin[i], end[i], end[j])
            rank = np.where(real & (which[i] == which[j]), rank, _NONE)
            return piece, rank

        made, rank = candidates(np.arange(len(symbol)))
        done: list[tuple] = []
        while len(symbol):
            heads = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]]))
            size = np.diff(np.concatenate([heads, [len(which)]]))
            best = np.minimum.reduceat(rank, heads)
            over = np.repeat(best == _NONE, size)
            if over.any():
                done.append((which[over], symbol[over], code[over]))
                keep = ~over
                which, symbol, code, begin, end, made, rank = (x[keep] for x in (which, symbol, code, begin, end, made, rank))
                best, size = best[best != _NONE], size[best != _NONE]
                if not len(symbol):
                    break
            hit = np.flatnonzero(rank == np.repeat(best, size))
            hit = hit[np.concatenate([[True], which[hit][1:] != which[hit][:-1]])]  # leftmost
            if made_by is not None:
                made_by.append((live[which[hit]], begin[hit], end[hit], end[hit + 1]))
            symbol[hit], end[hit] = made[hit], end[hit + 1]
            keep = np.ones(len(symbol), dtype=bool)
            keep[hit + 1] = False
            hit = hit - np.arange(len(hit))
            which, symbol, code, begin, end, made, rank = (x[keep] for x in (which, symbol, code, begin, end, made, rank))
            for i in (hit, hit[hit > 0] - 1):
                made[i], rank[i] = candidates(i)
        count = np.zeros(len(n), np.int64)
        pool = np.zeros(0, np.int32)
        if done:
            which, symbol, code = (np.concatenate(x) for x in zip(*done, strict=True))
            order = np.argsort(which, kind="stable")
            pool, each = self._spelt(symbol[order], code[order])
            count[live] = np.bincount(which[order], weights=each, minlength=len(live))
        if not alone:
            return pool, count
        count[long] = [len(x) for x in alone]
        at = np.concatenate([np.flatnonzero(n <= LOCKSTEP), long])
        turn = np.empty(len(n), np.int64)
        turn[at] = np.arange(len(n))
        return taken(np.concatenate([pool, *alone]), np.concatenate([[0], np.cumsum(count[at])]), turn)[0], count

    def _spelt(self, symbols: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces, with byte pieces for the characters that have none, and how many each symbol gives."""
        lost = np.flatnonzero(symbols < 0)
        n = np.ones(len(symbols), np.int64)
        c = codes[lost] & 0x1FFFFF
        size = 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)
        n[lost] = size
        out = np.repeat(symbols, n).astype(np.int32)
        at = (np.cumsum(n) - n)[lost]
        lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[size]
        for j in range(4):
            has = size > j
            byte = (lead if j == 0 else 0x80) | (c >> (6 * np.maximum(0, size - 1 - j))) & (0xFF if j == 0 else 0x3F)
            out[at[has] + j] = self.first_byte + byte[has]
        return out, n

    def _alone(self, codes: np.ndarray, key: np.uint64 | None) -> np.ndarray:
        """One long stretch, by a heap of candidates."""
        symbol = self.chars[codes].astype(np.int64).tolist()
        n = len(symbol)
        end, prev, after = list(range(1, n + 1)), list(range(-1, n - 1)), [*range(1, n), -1]

        def push(i):
            batch = np.array(i)
            nxt = np.array([after[x] for x in i])
            piece, rank = self.merges(np.array([symbol[x] for x in i]), np.array([symbol[x] for x in nxt]), key, batch, nxt, np.array([end[x] for x in nxt]))
            return [(r, x, y, end[y], p) for r, x, y, p in zip(rank.tolist(), i, nxt.tolist(), piece.tolist(), strict=True) if r < _NONE]

        heap = push(list(range(n - 1)))
        heapq.heapify(heap)
        while heap:
            _, i, j, stop, piece = heapq.heappop(heap)
            if symbol[i] is None or after[i] != j or symbol[j] is None or end[j] != stop or end[i] != j:
                continue
            symbol[i], symbol[j], end[i], after[i] = piece, None, stop, after[j]
            if after[j] >= 0:
                prev[after[j]] = i
            fresh = [x for x in (prev[i], i) if x >= 0 and after[x] >= 0]
            for item in push(fresh) if fresh else ():
                heapq.heappush(heap, item)
        live = [i for i in range(n) if symbol[i] is not None]
        return self._spelt(np.array([symbol[i] for i in live]), codes[live].astype(np.int64))[0]

    def encoded(self, column: pa.Array, documents: np.ndarray):
        """Slice by slice: its first text and the one after its last, their pieces, and each text's offsets into them."""
        offsets, data = T.utf8(column)
        for a, b in T.slices(offsets, SLICE_BYTES):
            ids, n = self._slice(offsets, data, a, b, documents[a:b])
            yield a, b, ids, np.concatenate([[0], np.cumsum(n)]).astype(np.int64)

    def encode(self, column: pa.Array, documents: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pieces of the texts, and each text's offsets into them."""
        found = [(ids, np.diff(first)) for _, _, ids, first in self.encoded(column, documents)]
        ids, n = zip(*found, strict=True) if found else ([np.zeros(0, np.int32)], [np.zeros(0, np.int64)])
        return np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(n))]).astype(np.int64)

    def _slice(self, offsets, data, a, b, documents):
        raw = data[offsets[a] : offsets[b]]
        size = np.diff(offsets[a : b + 1])
        codes = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), dtype=np.uint32)
        lead = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        first = lead[offsets[a : b + 1] - offsets[a]]
        # every text that isn't empty gets the model's space in front; a literal sign is marked as another character
        at = first[:-1][size > 0]
        codes = np.where(codes == SPACE, np.uint32(SPACE | 1 << 21), np.where(codes == 0x20, np.uint32(SPACE), codes))
        codes = np.insert(codes, at, np.uint32(SPACE))
        first = first + np.concatenate([[0], np.cumsum(size > 0)])
        starts = codes == SPACE
        starts[1:] &= codes[:-1] != SPACE
        starts[first[:-1][size > 0]] = True
        begin = np.flatnonzero(starts)
        if not len(begin):
            return np.zeros(0, dtype=np.int32), np.zeros(b - a, dtype=np.int64)
        own = np.append(begin, len(codes))
        length = np.diff(own)
        text = np.searchsorted(first, begin, "right") - 1
        powers, inverse = T.tables(len(codes) + 1)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(powers[: len(codes)] * codes, dtype=np.uint64)])
        h = T.mix((sums[own[1:]] - sums[begin]) * inverse[begin] + length.astype(np.uint64) * _K[3])
        plain = (length <= LOCKSTEP) & (np.add.reduceat(codes >= 0x110000, begin) == 0)
        usual = np.flatnonzero(plain)
        unique, one, back = np.unique(h[usual], return_index=True, return_inverse=True)
        self._remember(unique, codes, begin[usual[one]], length[usual[one]])
        known = self._known
        entry = np.searchsorted(known.keys, unique)[back]
        place = (begin - first[text]).astype(np.uint64)
        key = T.mix(T.mix(h + np.uint64(self.seed * int(_K[1]) % (1 << 64)) + documents[text] * _K[2]) + place * _K[0])
        if self.dropout:
            spans, spans_at = taken(known.spans, known.spans_at, entry)
            of = np.repeat(usual, np.diff(spans_at))
            hit = self.skipped(key[of], spans & np.uint64(0xFF), (spans >> np.uint64(8)) & np.uint64(0xFF), spans >> np.uint64(16))
            plain[of[hit]] = False
        same = plain[usual]
        pool, pool_at = taken(known.ids, known.ids_at, entry[same])
        rest = np.flatnonzero(~plain)
        flat, flat_at = taken(codes, own, rest)
        others, others_n = self._each(flat, flat_at, key[rest])
        n = np.zeros(len(begin), np.int64)
        n[plain], n[rest] = np.diff(pool_at), others_n
        turn = np.empty(len(begin), np.int64)
        turn[np.concatenate([np.flatnonzero(plain), rest])] = np.arange(len(begin))
        ids, _ = taken(np.concatenate([pool, others]), np.concatenate([[0], np.cumsum(np.concatenate([n[plain], n[rest]]))]), turn)
        return ids, np.bincount(text, weights=n, minlength=b - a).astype(np.int64)

    def _remember(self, unique: np.ndarray, codes: np.ndarray, begin: np.ndarray, length: np.ndarray) -> None:
        """Segments those of the stretches without dropout that are not known."""
        if len(self._known.keys) > REMEMBERED:
            self._known = Memory()
        at = np.minimum(np.searchsorted(self._known.keys, unique), max(0, len(self._known.keys) - 1))
        new = np.flatnonzero(self._known.keys[at] != unique) if len(self._known.keys) else np.arange(len(unique))
        if not len(new):
            return
        own = np.concatenate([[0], np.cumsum(length[new])])
        flat = codes[np.repeat(begin[new] - own[:-1], length[new]) + np.arange(own[-1])]
        merges: list = []
        ids, n = self.segment(flat, own, None, merges)
        which, *parts = (np.concatenate(x) for x in zip(*merges, strict=True)) if merges else [np.zeros(0, np.int64)] * 4
        order = np.argsort(which, kind="stable")
        packed = (parts[0] | parts[1] << 8 | parts[2] << 16).astype(np.uint64)[order]
        self._known.add(unique[new], ids, n, packed, np.bincount(which, minlength=len(new)))

    def _each(self, codes, own, keys) -> tuple[np.ndarray, np.ndarray]:
        """Segments of all stretches, some at a time."""
        ids, counts, i = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], 0
        while i < len(keys):
            j = max(i + 1, int(np.searchsorted(own, own[i] + TOGETHER, "right")) - 1)
            flat, n = self._marked(codes[own[i] : own[j]], own[i : j + 1] - own[i], keys[i:j])
            ids.append(flat)
            counts.append(n)
            i = j
        return np.concatenate(ids), np.concatenate(counts)

    def _marked(self, flat, own, keys) -> tuple[np.ndarray, np.ndarray]:
        """Segments; stretches with a literal sign for a space are few and get its bytes."""
        ids, n = self.segment(np.where(flat < 0x110000, flat, 0x10FFFF), own, keys)
        marked = np.unique(np.searchsorted(own, np.flatnonzero(flat >= 0x110000), "right") - 1)
        if not len(marked):
            return ids, n
        parts = np.split(ids, np.cumsum(n)[:-1])
        for i in marked.tolist():
            codes = np.where(flat[own[i] : own[i + 1]] >= 0x110000, SPACE, flat[own[i] : own[i + 1]])
            found, last = [], 0
            for j in [*np.flatnonzero(flat[own[i] : own[i + 1]] >= 0x110000).tolist(), len(codes)]:
                if j > last:
                    found.append(self.segment(codes[last:j], np.array([0, j - last]), keys[i : i + 1])[0])
                if j < len(codes):
                    found.append(self._spelt(np.array([-1]), np.array([SPACE]))[0])
                last = j + 1
            parts[i] = np.concatenate(found)
        return np.concatenate(parts), np.array([len(x) for x in parts])

    def decode(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The texts' UTF-8 bytes and offsets, without the model's space in front."""
        n = self.raw_at[ids + 1] - self.raw_at[ids]
        out = self.raw[np.repeat(self.raw_at[ids] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        at = np.concatenate([[0], np.cumsum(n)])[first]
        keep = np.ones(len(out), dtype=bool)
        full = at[:-1] < at[1:]
        keep[at[:-1][full]] = False
        return out[keep], at - np.concatenate([[0], np.cumsum(full)])

    def raw_text(self, ids: list[int]) -> str:
        """One text from its pieces."""
        out, _ = self.decode(np.array(ids, dtype=np.int64), np.array([0, len(ids)]))
        return out.tobytes().decode()


def keys_of(ids: pa.Array) -> np.ndarray:
    """A document's key, from its id alone."""
    return np.array([int.from_bytes(blake2b(str(x).encode(), digest_size=8).digest()) for x in ids.to_pylist()], dtype=np.uint64)


def encode(docs: DataFrame, pieces: Pieces, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and ``ids`` (array<int>) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(pieces)
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def scan(batches):
        for batch in batches:
            text, id_ = batch.column("text"), batch.column("id")
            for a, b, ids, first in shared.value.encoded(text, keys_of(id_)):
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids, pa.int32()), mask=text[a:b].is_null() if text.null_count else None)
                yield pa.RecordBatch.from_arrays([id_[a:b], lists], names=["id", "ids"])

    return given.mapInArrow(scan, f"id {given.schema['id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, pieces: Pieces) -> DataFrame:
    """``id`` and ``text`` of every row of ``id`` and ``ids``."""
    shared = encoded.sparkSession.sparkContext.broadcast(pieces)
    given = encoded.select("id", "ids")

    def scan(batches):
        for batch in batches:
            lists = batch.column("ids")
            texts = decode_lists(shared.value, lists)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], names=["id", "text"])

    return given.mapInArrow(scan, f"id {given.schema['id'].dataType.simpleString()}, text string")


def decode_lists(pieces: Pieces, lists: pa.ListArray) -> list[str | None]:
    out, at = pieces.decode(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate([[0], np.cumsum(np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))]))
    raw, null = out.tobytes(), lists.is_null().to_pylist()
    return [None if null[i] else raw[at[i] : at[i + 1]].decode() for i in range(len(lists))]


def round_trip(docs: DataFrame, pieces: Pieces, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``n_pieces``, ``ids_sha256`` (of the little-endian int32 ids) and whether the ids decode to the text; a null text counts as empty."""
    import hashlib

    shared = docs.sparkSession.sparkContext.broadcast(pieces)
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def scan(batches):
        for batch in batches:
            p, text = shared.value, batch.column("text")
            digest, same, count = [], [], []
            ids_of = keys_of(batch.column("id"))
            offsets, data = T.utf8(text)
            for a, b, ids, first in p.encoded(text, ids_of):
                out, at = p.decode(ids, first)
                raw, given_raw, base = out.tobytes(), data[offsets[a] : offsets[b]].tobytes(), offsets[a]
                for i in range(b - a):
                    digest.append(hashlib.sha256(ids[first[i] : first[i + 1]].tobytes()).hexdigest())
                    same.append(raw[at[i] : at[i + 1]] == given_raw[offsets[a + i] - base : offsets[a + i + 1] - base])
                count.extend(np.diff(first).tolist())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(count, pa.int64()), pa.array(digest), pa.array(same)], names=["id", "n_pieces", "ids_sha256", "lossless"])

    return given.mapInArrow(scan, f"id {given.schema['id'].dataType.simpleString()}, n_pieces long, ids_sha256 string, lossless boolean")


def op8_merge_dropout(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return round_trip(docs, Pieces.load(seed=1, dropout=0.1)).withColumnRenamed("id", "doc_id")
