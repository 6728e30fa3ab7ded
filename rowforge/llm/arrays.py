"""Texts as numpy arrays: words, their hashes, and n-gram hashes, for batches of any texts.

A batch is worked off in chunks of about a megabyte of UTF-8; one longer text is a chunk of its own and its words
are hashed piece by piece, so memory follows the chunk and never the batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
_PIECE = 1 << 15
_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads all 64 bits (the one of splitmix64)."""
    out = x.astype(_U, copy=True)
    with np.errstate(over="ignore"):
        for lo in range(0, out.size, _PIECE):  # what the processor's cache holds
            x = out[lo : lo + _PIECE]
            x ^= x >> _U(30)
            x *= _U(0xBF58476D1CE4E5B9)
            x ^= x >> _U(27)
            x *= _U(0x94D049BB133111EB)
            x ^= x >> _U(31)
    return out


def stream(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random words."""
    with np.errstate(over="ignore"):
        return mix64((np.arange(1, n + 1, dtype=_U) + _U(seed) * _U(1 << 32)) * _U(0x9E3779B97F4A7C15))


_BYTE = stream(256, 1) | _U(1)
_BASE = 0x9DDFEA08EB382D69 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def powers(n: int, base: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        steps = np.full(size, base, dtype=_U)
        steps[0] = 1
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(steps)
        if size <= 4 * CHUNK:
            _powers[base] = have
    return have[:n]


@dataclass
class Texts:
    """Some texts: their bytes end to end, and where each begins (and the last ends)."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1


def chunks(texts: pa.Array | pa.ChunkedArray, most: int = CHUNK) -> Iterator[Texts]:
    """Consecutive chunks of a string column; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks)
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1
        hi = min(max(hi, lo + 1), len(texts))
        yield Texts(lo, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


@cache
def _trim():
    """glibc's ``malloc_trim``; where there is none, nothing."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError, TypeError):
        return lambda pad: 0


def give_back() -> None:
    """Return freed memory to the system. Allocators keep what the largest chunk took, as long as the worker lives."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


@dataclass
class Words:
    """The words of some texts: byte ranges, and the text of each."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray


def words(t: Texts, space: np.ndarray = _SPACE) -> Words:
    """Runs of bytes that are not white space, cut where a text ends."""
    n = len(t.data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, none)
    blank = space[t.data]
    first, last = np.empty(n, bool), np.empty(n, bool)
    first[0], first[1:] = True, blank[:-1]
    last[-1], last[:-1] = True, blank[1:]
    begins, ends = t.offsets[:-1], t.offsets[1:]
    first[begins[begins < n]] = True
    last[ends[ends > begins] - 1] = True
    start = np.flatnonzero(first & ~blank)
    end = np.flatnonzero(last & ~blank) + 1
    return Words(start, end, np.searchsorted(t.offsets, start, "right") - 1)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte range; the ranges are in order and do not overlap."""
    out = np.empty(len(start), dtype=_U)
    lo = 0
    with np.errstate(over="ignore"):
        while lo < len(start):
            base = start[lo]
            hi = max(lo + 1, int(np.searchsorted(end, base + CHUNK, "right")))
            s, e = start[lo:hi] - base, end[lo:hi] - base
            size = int(e[-1])
            total = np.zeros(size + 1, dtype=_U)
            np.cumsum(_BYTE[data[base : base + size]] * powers(size, _BASE), out=total[1:])
            out[lo:hi] = (total[e] - total[s]) * powers(size + 1, _INVERSE)[s]
            lo = hi
        return mix64(out + _U(seed) * _U(0x9E3779B97F4A7C15) + (end - start).astype(_U))


def runs(word: np.ndarray, where: np.ndarray, n: int) -> np.ndarray:
    """A rolling hash of the ``n`` words from each place on; the caller drops runs that cross texts."""
    out = np.zeros(len(where), dtype=_U)
    with np.errstate(over="ignore"):
        for i in range(n):
            out *= _U(0xD6E8FEB86659FD93)
            out += word[where + i]
    return mix64(out)


def ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stable order of 64-bit ``keys``, and the keys in that order.

    Values are sorted several times faster than places. So the place of each key goes into its low bits, after leading
    bits that all keys share are shifted out. Keys that differ in the lost bits alone may end up in the wrong order; that
    shows, and then places are sorted.
    """
    n = len(keys)
    if n < 2:
        return np.arange(n), keys
    shared = 64 - (int(keys.min()) ^ int(keys.max())).bit_length()
    low = _U((1 << (n - 1).bit_length()) - 1)
    packed = keys << _U(min(shared, 63))
    packed &= ~low
    packed |= np.arange(n, dtype=_U)
    packed.sort()
    packed &= low
    order = packed.view(np.int64)
    found = keys[order]
    if (found[1:] < found[:-1]).any():
        order = np.argsort(keys, kind="stable")
        found = keys[order]
    return order, found


def begins(found: np.ndarray) -> np.ndarray:
    """Whether each of some ordered keys is the first of its equals."""
    new = np.ones(len(found), bool)
    np.not_equal(found[1:], found[:-1], out=new[1:])
    return new


def repeated(keys: np.ndarray, times: int = 2) -> np.ndarray:
    """Whether each key occurs ``times`` times or more."""
    ordered = np.sort(keys)
    found = ordered[times - 1 :][ordered[times - 1 :] == ordered[: len(ordered) - times + 1]]
    if not len(found):
        return np.zeros(len(keys), bool)
    found = found[np.concatenate([[True], found[1:] != found[:-1]])]
    at = np.searchsorted(found, keys)
    at[at == len(found)] = 0
    return found[at] == keys


def per_doc(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Sums of integer ``values`` by text, exact."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    edge = np.searchsorted(doc, np.arange(n + 1))
    return total[edge[1:]] - total[edge[:-1]]


def code_points(data: np.ndarray) -> np.ndarray:
    """For each byte position, how many code points begin before it; one more entry than bytes."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out
