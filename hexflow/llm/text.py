"""Vectorised word handling on Arrow string columns, shared by the corpus operators.

Texts stay in Arrow's UTF-8 buffer; words are byte ranges of that buffer and are
identified by a 64-bit hash of their bytes.  Work goes in slices of about
``SLICE_BYTES`` so that memory does not depend on the batch or the partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_A = np.uint64(0xD6E8FEB86659FD93)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words ``[^\x20\x09-\x0D]+``; bytes of characters beyond ASCII are word bytes.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` once A-Z is lower-cased.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

@cache
def _kept(size: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, x)]), dtype=np.uint64) for x in (_P, _P_INV))


def tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, for n positions; only those of a usual slice are kept."""
    return _kept(SLICE_BYTES + 1) if n <= SLICE_BYTES + 2 else _kept.__wrapped__(n)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Words:
    """The words of some texts: byte ranges, and where each text's words begin."""

    data: np.ndarray  #: lower-cased bytes of the texts
    starts: np.ndarray  #: first byte of each word
    ends: np.ndarray  #: byte after each word
    first: np.ndarray  #: texts + 1 offsets into the words
    offsets: np.ndarray  #: texts + 1 offsets into the bytes
    _sums: np.ndarray | None = None

    @property
    def n(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1, dtype=np.int64), self.n)

    def hashes(self, starts: np.ndarray | None = None, ends: np.ndarray | None = None) -> np.ndarray:
        """64-bit hashes of byte ranges, of the words by default."""
        starts, ends = (self.starts, self.ends) if starts is None else (starts, ends)
        powers, inverse = tables(len(self.data) + 1)
        if self._sums is None:
            sums = np.empty(len(self.data) + 1, dtype=np.uint64)
            sums[0] = 0
            np.cumsum(powers[: len(self.data)] * self.data, dtype=np.uint64, out=sums[1:])
            self._sums = sums
        h = (self._sums[ends] - self._sums[starts]) * inverse[starts]
        return mix(h + (ends - starts).astype(np.uint64) * _A)


def hash_words(words: list[str]) -> np.ndarray:
    """The hashes that Words.hashes gives for these (lower-case) words."""
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(x) for x in raw], dtype=np.int64)
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    starts = ends - np.array([len(x) for x in raw], dtype=np.int64)
    return Words(data, starts, ends, np.array([0, len(raw)]), np.array([0, len(data)])).hashes()


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; nulls become empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return offsets, data


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes; a longer text stands alone."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        b = min(b, n, a + 60_000)
        yield a, b
        a = b


def words(offsets: np.ndarray, data: np.ndarray, a: int, b: int, kind: np.ndarray) -> Words:
    """The words of texts a to b, A-Z lower-cased; ``kind`` marks the bytes of words."""
    offs = (offsets[a : b + 1] - offsets[a]).astype(np.int64)
    low = LOWER[data[offsets[a] : offsets[b]]]
    inside = np.zeros(len(low) + 1, dtype=bool)
    inside[:-1] = kind[low]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cut = offs[:-1][offs[:-1] < offs[1:]]
    begins[cut] = inside[cut]
    starts = np.flatnonzero(begins)
    stops = np.ones(len(low) + 1, dtype=bool)
    stops[:-1] = ~inside[:-1]
    close = np.zeros(len(low) + 1, dtype=bool)
    close[1:] = inside[:-1] & stops[1:]
    inner = offs[1:][(offs[1:] > 0)]
    close[inner] |= inside[inner - 1]
    return Words(low, starts, np.flatnonzero(close), np.searchsorted(starts, offs), offs)


def shingles(hashed: np.ndarray, first: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k-word shingles and the group (text or line) of each.

    ``first`` are group offsets into ``hashed``.  A group of fewer than k words has
    its whole sequence as one shingle; one without words has none.
    """
    n = np.diff(first)
    found, owner = [], []
    if len(hashed) >= k:
        h = hashed[: len(hashed) - k + 1].copy()
        for j in range(1, k):
            h = h * _A + hashed[j : len(hashed) - k + 1 + j]
        group = np.repeat(np.arange(len(n)), n)[: len(h)]
        whole = np.arange(len(h)) + k <= first[group + 1]
        found.append(mix(h[whole]))
        owner.append(group[whole])
    for m in range(1, k):
        short = np.flatnonzero(n == m)
        if len(short):
            h = hashed[first[short]]
            for j in range(1, m):
                h = h * _A + hashed[first[short] + j]
            found.append(mix(h + np.uint64(m)))
            owner.append(short)
    if not found:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    return np.concatenate(found), np.concatenate(owner)


def distinct(tokens: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct tokens of each owner, ordered by owner, then token."""
    order = np.argsort(tokens)
    order = order[np.argsort(owner[order].astype(np.uint16 if len(owner) and owner.max() < 65536 else np.int64), kind="stable")]
    t, o = tokens[order], owner[order]
    new = np.ones(len(t), dtype=bool)
    new[1:] = (t[1:] != t[:-1]) | (o[1:] != o[:-1])
    return t[new], o[new]
