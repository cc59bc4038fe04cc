"""Vectorised words and word hashes over the UTF-8 bytes of many texts at once.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D; A-Z are folded to a-z.
Words are identified by 64-bit hashes (a polynomial over per-byte random values, finally mixed).
"""

from __future__ import annotations

import ctypes
import functools
import inspect
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_RAW = _BYTE.copy()
_BYTE[65:91] = _BYTE[97:123]
_P = np.uint64(0x9E3779B97F4A7C15)
_PI = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P^0..P^(n-1) and their inverses modulo 2^64; kept for the life of the worker."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        for k, base in enumerate((_P, _PI)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _powers[k] = np.multiply.accumulate(a)
    return _powers[0][:n], _powers[1][:n]


def _give_back() -> None:
    """Hand freed memory back to the system: Python workers live on between tasks and share an executor's memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(f: Callable) -> Callable:
    """``f`` of one or two arguments (Arrow batches or groups), after which freed memory goes back to the system."""
    # Spark tells functions apart by their number of arguments, so each form has its own wrapper
    if inspect.isgeneratorfunction(f):

        @functools.wraps(f)
        def one(batches):
            yield from f(batches)
            _give_back()

        return one

    def done(out):
        _give_back()
        return out

    if f.__code__.co_argcount == 1:
        return functools.wraps(f)(lambda table: done(f(table)))
    return functools.wraps(f)(lambda left, right: done(f(left, right)))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    y = x >> np.uint64(33)
    y ^= x
    x = y
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def distinct(a: np.ndarray) -> np.ndarray:
    """The ascending distinct values, by sorting."""
    a = np.sort(a)
    return a[np.concatenate(([True], a[1:] != a[:-1]))] if len(a) else a


def order_of(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stable argsort of non-negative numbers and the sorted numbers; where number and place fit 63 bits, they are sorted as one."""
    low = len(a).bit_length()
    if not len(a) or int(a.max()) >> (63 - low):
        order = np.argsort(a, kind="stable")
        return order, a[order]
    key = a.astype(np.int64)
    key <<= low
    key |= np.arange(len(a))
    key.sort()
    order = key & ((1 << low) - 1)
    key >>= low
    return order, key


def sort_order(a: np.ndarray) -> np.ndarray:
    """A stable argsort of 64-bit hashes: places go into the low bits and plain numbers are sorted."""
    low = np.uint64((1 << len(a).bit_length()) - 1)
    key = a & ~low | np.arange(len(a), dtype=np.uint64)
    key.sort()
    order = (key & low).astype(np.int64)
    s = a[order]
    # different hashes that agree in all other bits may have come in the wrong order
    return order if (s[1:] >= s[:-1]).all() else np.argsort(a, kind="stable")


def codes(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ascending distinct hashes, the number of each hash among them, and their counts."""
    order = sort_order(a)
    s = a[order]
    head = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1]))) if len(s) else np.empty(0, np.int64)
    n = np.diff(np.append(head, len(s)))
    number = np.empty(len(a), np.int32)
    number[order] = np.repeat(np.arange(len(head), dtype=np.int32), n)
    return s[head], number, n


def utf8(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n+1) of a string column; null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    col = pc.fill_null(col.cast(pa.large_binary()), b"")
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64, len(col) + 1, col.offset * 8)
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.empty(0, np.uint8)
    return buf, off - off[0]


def slices(off: np.ndarray, most: int = 1 << 17) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes each, so that 8 bytes for each of them stay in a cache; a longer text stands alone."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def prefix_hash(buf: np.ndarray, fold: bool = True) -> np.ndarray:
    """Running sums (n+1) from which span_hash takes the hash of any span; ``fold``: A-Z as a-z."""
    c = np.zeros(len(buf) + 1, np.uint64)
    x = (_BYTE if fold else _RAW)[buf]
    x *= powers(len(buf) + 1)[0][: len(buf)]
    np.cumsum(x, out=c[1:])
    return c


def span_hash(c: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((c[end] - c[start]) * powers(len(c))[1][start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_spans(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word; a word never crosses a text's end."""
    inside = np.zeros(len(buf) + 2, bool)
    np.logical_and(buf != 32, buf - np.uint8(9) > 4, out=inside[1:-1])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    cut = off[1:-1]
    cut = cut[inside[cut] & inside[cut + 1]]
    if len(cut):
        cut = distinct(cut)
        start, end = np.sort(np.concatenate((start, cut))), np.sort(np.concatenate((end, cut)))
    return start, end


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word, and for each text the number of words before it (n+1)."""
    if not len(buf):
        z = np.empty(0, np.int64)
        return np.empty(0, np.uint64), z, z, np.zeros(len(off), np.int64)
    start, end = word_spans(buf, off)
    return span_hash(prefix_hash(buf), start, end), start, end, np.searchsorted(start, off)


def hash_bytes(token: bytes) -> int:
    """The hash that ``words`` gives to one word."""
    buf = np.frombuffer(token, np.uint8)
    return int(span_hash(prefix_hash(buf), np.array([0]), np.array([len(buf)]))[0])


_GRAM = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of ``n`` consecutive word hashes (across texts too; the caller masks)."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    s = h[: len(h) - n + 1] * _GRAM[0]
    for j in range(1, n):
        s = s + h[j : len(h) - n + 1 + j] * _GRAM[j]
    return mix(s + np.uint64(n))


def shingle_sets(buf: np.ndarray, off: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """Per text the ascending distinct hashes of its n-word shingles; fewer words: the whole sequence as one."""
    h, _, _, first = words(buf, off)
    all_grams = grams(h, n)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= n:
            yield distinct(all_grams[a : b - n + 1])
        else:
            yield grams(h[a:b], b - a) if b > a else np.empty(0, np.uint64)


def binary_column(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())
