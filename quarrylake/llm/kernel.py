"""Vectorised text kernel: words, word hashes and word n-gram hashes of many texts at once.

Everything works on the UTF-8 bytes of an Arrow string column, a megabyte at a time; a longer text is cut
inside, so working memory is a few bytes for each byte of it.

Hashes find candidates only.  A span's hash takes its bytes eight at a time, each lane mixed into the
state by a bijection that isn't linear (beyond ``LONG`` bytes: a BLAKE2 digest), so spans of up to eight bytes and one length never collide.
Where a match is confirmed, :func:`equal_spans` compares the bytes themselves.
"""

from __future__ import annotations

import ctypes
import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser on uint64 values."""
    x = x + _ODD
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def constants(n: int, salt: int) -> np.ndarray:
    """n odd 64-bit multipliers, from a rule."""
    return mix(np.arange(n, dtype=np.uint64) + (np.uint64(salt) << np.uint64(32))) | np.uint64(1)


class Alphabet:
    """Which bytes belong to words, and what each byte counts as: A-Z folded to a-z if asked."""

    def __init__(self, separators: list[int], fold: bool = True):
        self.inside = np.ones(256, dtype=bool)
        self.inside[separators] = False
        self.letter = np.arange(256, dtype=np.uint8)
        self.letter[65:91] += np.uint8(32 * fold)


#: Words are runs of anything but space and the control characters 9 to 13.
SPACED = Alphabet([32, *range(9, 14)])
#: Words are runs of ASCII letters, digits and all characters outside ASCII.
ALNUM = Alphabet([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
#: All bytes as they are.
EXACT = Alphabet([], fold=False)

#: Bytes of a span that are mixed lane by lane, and spans hashed at once.
LONG, SPANS = 256, 1 << 16
#: The first k bytes of a lane.
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_held: dict[object, object] = {}


def held(name: object, make):
    """The one large object that a worker process keeps from task to task; asking for another drops it."""
    if name not in _held:
        release()
        _held[name] = make()
    return _held[name]


def release() -> None:
    """Give back what this worker process has kept, before work that needs room of its own."""
    _held.clear()
    _trim()


def _trim() -> None:
    """Hand free memory back to the system: idle worker processes share a machine with the JVM."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(work: Callable) -> Callable:
    """A function over batches that leaves no free memory with its worker process."""

    @functools.wraps(work)
    def run(batches):
        try:
            yield from work(batches)
        finally:
            _trim()

    return run


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    buffers = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(buffers[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data, offsets


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one row."""
    n, first = len(offsets) - 1, 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def word_spans(data: np.ndarray, offsets: np.ndarray, alphabet: Alphabet) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and for each text the index of its first word (one more at the end).

    ``offsets`` count from the start of ``data``; words never cross texts.
    """
    starts, ends, n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], len(data)
    for a in range(0, n, SLICE_BYTES):
        b = min(n, a + SLICE_BYTES)
        # One byte before and behind; outside of all texts is no word.
        inside = np.zeros(b - a + 2, dtype=bool)
        low, high = max(a - 1, 0), min(b + 1, n)
        inside[low - a + 1 : high - a + 1] = alphabet.inside[data[low:high]]
        edge = np.zeros(b - a + 1, dtype=bool)
        edge[offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, b, "right")] - a] = True
        own = inside[1:-1]
        starts.append(np.flatnonzero(own & (~inside[:-2] | edge[:-1])) + a)
        ends.append(np.flatnonzero(own & (~inside[2:] | edge[1:])) + a + 1)
    starts, ends = np.concatenate(starts), np.concatenate(ends)
    return starts, ends, np.searchsorted(starts, offsets)


def lanes(data: np.ndarray, alphabet: Alphabet) -> np.ndarray:
    """The eight bytes from each place on as a number, the first byte lowest; behind the end are zeros."""
    padded = np.zeros(len(data) + 8, np.uint8)
    np.take(alphabet.letter, data, out=padded[: len(data)], mode="clip")
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, alphabet: Alphabet, eights: np.ndarray | None = None) -> np.ndarray:
    """64-bit hash of each span."""
    eights = lanes(data, alphabet) if eights is None else eights
    out = np.empty(len(starts), np.uint64)
    for a in range(0, len(starts), SPANS):
        start = starts[a : a + SPANS]
        size = ends[a : a + SPANS] - start
        h = mix(mix(size.astype(np.uint64)) ^ (eights[start] & _MASK[np.minimum(size, 8)]))
        rows, at = np.flatnonzero(size > 8), 8
        while len(rows) and at < LONG:
            left = size[rows] - at
            h[rows] = mix(h[rows] ^ (eights[start[rows] + at] & _MASK[np.minimum(left, 8)]))
            at += 8
            rows = rows[left > 8]
        for i in np.flatnonzero(size > LONG):
            h[i] = int.from_bytes(hashlib.blake2b(alphabet.letter[data[start[i] : start[i] + size[i]]], digest_size=8).digest(), "little")
        out[a : a + SPANS] = h
    return out


def equal_spans(one: np.ndarray, one_starts: np.ndarray, one_ends: np.ndarray, two: np.ndarray, two_starts: np.ndarray, two_ends: np.ndarray) -> np.ndarray:
    """Whether spans of one text (as :func:`lanes`) and of another have the same bytes, pair by pair."""
    size = one_ends - one_starts
    same = size == two_ends - two_starts
    rows, at = np.flatnonzero(same & (size > 0)), 0
    while len(rows):
        left = size[rows] - at
        mask = _MASK[np.minimum(left, 8)]
        unequal = ((one[one_starts[rows] + at] ^ two[two_starts[rows] + at]) & mask) != 0
        same[rows[unequal]] = False
        at += 8
        rows = rows[(left > 8) & ~unequal]
    return same


def gram_hashes(words: np.ndarray, n: int, salt: int = 7) -> np.ndarray:
    """Hash of the n words from each position; the last n-1 positions are missing."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    total, size = np.zeros(len(words) - n + 1, dtype=np.uint64), len(words) - n + 1
    for k, c in enumerate(constants(n, salt)):
        total += words[k : k + size] * c
    return mix(total)


def hashed_words(data: np.ndarray, offsets: np.ndarray, alphabet: Alphabet) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and for each text the index of its first word."""
    starts, ends, first = word_spans(data, offsets, alphabet)
    return span_hashes(data, starts, ends, alphabet), first


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row, last row, bytes and offsets (from 0) of parts of a column."""
    data, offsets = string_buffers(column)
    for a, b in slices(offsets, limit):
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
