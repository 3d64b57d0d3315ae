"""Words of Arrow text batches as numpy arrays: boundaries, hashes, hashes of runs of words.

Words are hashed eight bytes at a time, each step a bijection that mixes all bits, so no family of texts is known to
collide; runs of words are polynomials over those hashes. A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and carriage return, which is
``[^\\x20\\x09-\\x0D]+`` on the text, since UTF-8 uses those bytes for nothing else. Batches are cut into pieces of a few
megabytes of whole texts, so that memory follows the longest text and not the batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE_BYTES = 2 << 20
_SLICE_WORDS = 1 << 18

_rng = np.random.Generator(np.random.PCG64(20240607))
_SEEDS = _rng.integers(1, 1 << 63, 2, dtype=np.uint64)
_FOLDED = np.arange(256, dtype=np.uint8)
_FOLDED[ord("A") : ord("Z") + 1] += 32
# Of eight bytes, those that belong to a word of which so many are left.
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
_LONG = 256
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
# Two odd bases with their inverses modulo 2^64; hashes of the two are independent.
_BASES = tuple(int(x) for x in (_rng.integers(1 << 40, 1 << 62, 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)))
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 1 << 23:
            _powers[base] = have
    return have[:n]


def _inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def _runs(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hash of values[start:end] for every pair, the same wherever the run stands."""
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * _power(base, len(values)), out=total[1:])
    return mix((total[ends] - total[starts]) * _power(_inverse(base), len(values) + 1)[starts])


def hash_words(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each buf[start:end], one for either seed. Words over 256 bytes are digested one by one."""
    size = end - start
    out = mix(size.astype(np.uint64) + _SEEDS[seed])
    eight = np.ndarray(len(buf) + 1, np.dtype("<u8"), np.concatenate([buf, np.zeros(8, dtype=np.uint8)]).data, strides=(1,))
    for i in np.flatnonzero(size > _LONG):
        digest = hashlib.blake2b(buf[start[i] : end[i]].tobytes(), digest_size=8, key=_SEEDS[seed].tobytes()).digest()
        out[i] = np.frombuffer(digest, dtype="<u8")[0]
    rows, done = np.flatnonzero((size > 0) & (size <= _LONG)), 0
    while len(rows):
        part = eight[start[rows] + done] & _MASKS[np.minimum(size[rows] - done, 8)]
        out[rows] = mix(out[rows] ^ part)
        done += 8
        rows = rows[size[rows] > done]
    return out


@dataclass
class Piece:
    """Some whole texts of a batch. Word i of the piece is buf[start[i]:end[i]]; text d has words first[d]:first[d + 1]."""

    rows: np.ndarray  # positions of the texts in the batch
    buf: np.ndarray
    offsets: np.ndarray  # of the texts in buf
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        """Text of each word."""
        return np.repeat(np.arange(len(self.rows)), self.n_words)

    def hashes(self, fold: bool) -> np.ndarray:
        """A 64-bit hash of each word; with fold, A-Z count as a-z."""
        out = np.empty(len(self.start), dtype=np.uint64)
        for a in range(0, len(out), _SLICE_WORDS):
            s, e = self.start[a : a + _SLICE_WORDS], self.end[a : a + _SLICE_WORDS]
            part = self.buf[s[0] : e[-1]]
            out[a : a + _SLICE_WORDS] = hash_words(_FOLDED[part] if fold else part, s - s[0], e - s[0])
        return out

    def runs_at(self, hashes: np.ndarray, at: np.ndarray, length: int, second: bool = False) -> np.ndarray:
        """Hash of the ``length`` words from each word in ``at``; the runs must lie inside the piece."""
        if not len(at):
            return np.zeros(0, dtype=np.uint64)
        return _runs(hashes, at, at + length, _BASES[second])

    def run_starts(self, length: int) -> np.ndarray:
        """Words from which ``length`` words of the same text follow, itself included."""
        ok = np.ones(len(self.start), dtype=bool)
        ends = self.first[1:]
        for back in range(1, length):
            at = ends - back
            ok[at[at >= self.first[:-1]]] = False
        return np.flatnonzero(ok)

    def text(self, d: int) -> bytes:
        return self.buf[self.offsets[d] : self.offsets[d + 1]].tobytes()


def _offsets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; nulls are empty."""
    if pa.types.is_dictionary(column.type):
        column = column.dictionary_decode()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not wide and not (pa.types.is_string(column.type) or pa.types.is_binary(column.type)):
        column, wide = column.cast(pa.large_string()), True
    if column.null_count:
        column = column.fill_null(b"" if "binary" in str(column.type) else "")
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if offsets is None or not len(column):
        return np.zeros(len(column) + 1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    at = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return at, np.zeros(0, dtype=np.uint8) if data is None else np.frombuffer(data, dtype=np.uint8)


def pieces(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[Piece]:
    """The texts of a column in pieces of about ``limit`` bytes; every text, null ones included, is in one piece."""
    offsets, data = _offsets(column)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        b = min(b, len(column))
        buf = data[offsets[a] : offsets[b]]
        own = offsets[a : b + 1] - offsets[a]
        edge = np.zeros(len(buf) + 1, dtype=bool)
        edge[own] = True
        word = ~_SPACE[buf]
        space_before = np.ones(len(buf), dtype=bool)
        space_before[1:] = ~word[:-1]
        space_after = np.ones(len(buf), dtype=bool)
        space_after[:-1] = ~word[1:]
        start = np.flatnonzero(word & (space_before | edge[:-1]))
        end = np.flatnonzero(word & (space_after | edge[1:])) + 1
        yield Piece(np.arange(a, b), buf, own, start, end, np.searchsorted(start, own))
        a = b


def shingles(piece: Piece, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The distinct k-word shingles of each text, A-Z folded: (hashes sorted within the text, first index of each text).

    A text of fewer words has its whole sequence as one shingle; a text without words has none.
    """
    hashes, n = piece.hashes(fold=True), piece.n_words
    starts = piece.run_starts(k)
    values, docs = piece.runs_at(hashes, starts, k), piece.doc[starts]
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        whole = np.concatenate([piece.runs_at(hashes, piece.first[[d]], int(n[d])) for d in short])
        # The length tells a short sequence from a shingle of k words.
        whole = mix(whole + n[short].astype(np.uint64))
        values, docs = np.concatenate([values, whole]), np.concatenate([docs, short])
    order = np.lexsort((values, docs))
    values, docs = values[order], docs[order]
    keep = np.ones(len(values), dtype=bool)
    keep[1:] = (values[1:] != values[:-1]) | (docs[1:] != docs[:-1])
    values, docs = values[keep], docs[keep]
    return values, np.searchsorted(docs, np.arange(len(piece.rows) + 1))
