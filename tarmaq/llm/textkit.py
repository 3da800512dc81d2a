"""Array routines over Arrow string columns: word spans, rolling hashes, tokens.

Everything here works on whole texts. ``chunks`` only bounds how many *documents* are worked on
at a time, so memory follows the longest single text, not the size of a batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import wraps

import numpy as np
import pyarrow as pa

#: Text bytes worked on at a time; one longer text is a chunk of its own.
CHUNK_BYTES = 2 << 20

#: The word separators of every operator: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = b" \t\n\x0b\x0c\r"
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[bool, np.ndarray] = {}


def released() -> None:
    """Give freed memory back to the system: Python workers outlive their tasks and share an executor's memory with the next stage."""
    for inverse in [k for k, v in _powers.items() if len(v) > CHUNK_BYTES]:
        del _powers[inverse]
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than glibc
        pass


def lean(run: Callable) -> Callable:
    """A function of Arrow batches that leaves no freed memory behind when its task ends."""

    @wraps(run)
    def lean_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            released()

    return lean_run


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection on 64 bits."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=_U) * _BASE)


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; the base is odd, so the inverse powers exist."""
    have = _powers.get(inverse)
    if have is None or len(have) < n:
        out = np.full(max(n, 1 << 16), _INVERSE if inverse else _BASE, _U)
        out[0] = 1
        have = np.multiply.accumulate(out)
        if n <= 4 * CHUNK_BYTES:  # one huge text must not stay in memory
            _powers[inverse] = have
    return have[:n]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Prefix sums p with span hash (p[e] - p[s]) * base**-s, see span_hash."""
    out = np.empty(len(values) + 1, _U)
    out[0] = 0
    np.cumsum(values * powers(len(values)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span; equal spans hash alike wherever they stand."""
    return mix((prefix[end] - prefix[start]) * powers(len(prefix), True)[start] + (end - start).astype(_U) * _U(0xD6E8FEB86659FD93))


@dataclass
class Texts:
    """A chunk of texts: their bytes back to back, document i at offsets[i]:offsets[i + 1]."""

    data: np.ndarray
    offsets: np.ndarray
    valid: np.ndarray
    rows: slice

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def chunks(column: pa.Array, max_bytes: int = CHUNK_BYTES) -> Iterator[Texts]:
    """Cut a string column into runs of whole documents of about max_bytes; nulls count as empty."""
    if len(column) == 0:
        return
    valid = np.asarray(column.is_valid())
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    at = 0
    while at < len(column):
        to = int(np.searchsorted(offsets, offsets[at] + max_bytes, "right")) - 1
        to = min(max(to, at + 1), len(column))
        yield Texts(raw[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], valid[at:to], slice(at, to))
        at = to


@dataclass
class Words:
    """start, end: byte spans of all words; first[i]:first[i + 1] are those of document i."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.start)


def words(t: Texts) -> Words:
    """The maximal runs without a separator."""
    n = len(t.data)
    if not n:
        zero = np.empty(0, np.int64)
        return Words(zero, zero, np.zeros(len(t.offsets), np.int64))
    inside = ~_IS_SPACE[t.data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[t.offsets[:-1][t.offsets[:-1] < n]] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[t.offsets[1:][t.offsets[1:] > 0] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    return Words(start, end, np.searchsorted(start, t.offsets).astype(np.int64))


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def word_hashes(t: Texts, w: Words, fold: bool = False) -> np.ndarray:
    """A 64-bit hash of each word; with fold, A-Z count as a-z."""
    data = _FOLD[t.data] if fold else t.data
    return span_hash(prefix_hash(_BYTE[data]), w.start, w.end)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n-word runs of a word sequence (those over a document's end too)."""
    k = len(hashes) - n + 1
    if k <= 0:
        return np.empty(0, _U)
    at = np.arange(k)
    return span_hash(prefix_hash(hashes), at, at + n)


def doc_of(first: np.ndarray) -> np.ndarray:
    """The document index of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def full_runs(first: np.ndarray, n: int) -> np.ndarray:
    """Indexes of the words at which a run of n words of one document starts."""
    total = int(first[-1])
    if total < n:
        return np.empty(0, np.int64)
    last = np.repeat(first[1:], np.diff(first))
    at = np.arange(total)
    return at[at + n <= last]


def pieces_of(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Flat indexes of many spans one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
