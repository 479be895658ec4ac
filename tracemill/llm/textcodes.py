"""Vectorised hashing of words and word shingles over Arrow string columns.

All work is on the UTF-8 bytes of many texts laid end to end, in pieces of
bounded size, so that Python loops run over texts and never over words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes that are handled at once; a single longer text is handled alone.
PIECE = 1 << 20

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x2545F4914F6CDD1D
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: spreads every bit of the input over the output."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tables() -> tuple[np.ndarray, np.ndarray]:
    code = np.arange(256, dtype=np.uint8)
    lower = code.copy()
    lower[65:91] += 32
    space = np.zeros(256, bool)
    space[[32, *range(9, 14)]] = True
    return lower, space


LOWER, SPACE = _tables()
_BYTE = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _GOLD)


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.empty(n + 1, np.uint64), np.empty(n + 1, np.uint64)
    inverse = pow(_BASE, -1, 1 << 64)
    for out, base in ((up, _BASE), (down, inverse)):
        out[0] = 1
        done, step = 1, base
        while done < n + 1:  # doubling: out[done:2 done] = out[:done] * base^done
            m = min(done, n + 1 - done)
            np.multiply(out[:m], np.uint64(step), out=out[done : done + m])
            done += m
            step = step * step & _MASK
    return up, down


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    size = PIECE
    while size < n:
        size *= 2
    return _powers(size)


def string_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if column.null_count:
        null = np.asarray(column.is_null())
        if (offsets[1:][null] > offsets[:-1][null]).any():  # a null may cover bytes: rebuild
            return string_buffer(column.fill_null(b""))
    return raw, offsets


def pieces(column: pa.Array, size: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first, last, bytes, offsets)`` of runs of texts of about ``size`` bytes; offsets start at 0."""
    raw, offsets = string_buffer(column)
    n, first = len(offsets) - 1, 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last, raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text number, start and end of every word; ASCII letters are taken as lower case."""
    n = len(data)
    empty = np.zeros(0, np.int64)
    if not n:
        return np.zeros(0, np.uint64), empty, empty, empty
    solid = ~SPACE[data]
    begins = np.empty(n, bool)
    begins[0] = True
    np.logical_not(solid[:-1], out=begins[1:])
    ends = np.empty(n, bool)
    ends[-1] = True
    np.logical_not(solid[1:], out=ends[:-1])
    edge = offsets[:-1][offsets[:-1] < n]
    begins[edge] = True
    ends[edge[edge > 0] - 1] = True
    start, end = np.flatnonzero(begins & solid), np.flatnonzero(ends & solid) + 1
    up, down = powers(n)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[LOWER[data]] * up[:n], out=total[1:])
    h = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    text = np.searchsorted(offsets, start, "right") - 1
    return h, text, start, end


def run_hashes(numbers: np.ndarray, start: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hash of every run of numbers that begins there and has this size, in order."""
    up, down = powers(len(numbers))
    total = np.zeros(len(numbers) + 1, np.uint64)
    np.cumsum(mix((numbers.astype(np.uint64) + np.uint64(1)) * _GOLD) * up[: len(numbers)], out=total[1:])
    return mix((total[start + sizes] - total[start]) * down[start] + sizes.astype(np.uint64))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its word shingles; a shorter text is one shingle."""
    h, text, _, _ = word_hashes(data, offsets)
    n_texts = len(offsets) - 1
    counts = np.bincount(text, minlength=n_texts)
    first = np.concatenate([[0], np.cumsum(counts)])
    gram = np.zeros(max(len(h) - width + 1, 0), np.uint64)
    for k in range(width):
        gram += h[k : k + len(gram)] * np.uint64((int(_GOLD) * (2 * k + 1)) & _MASK)
    gram = mix(gram + np.uint64(width))
    out, none = [], np.zeros(0, np.uint64)
    for i in range(n_texts):
        a, b = first[i], first[i + 1]
        if b - a >= width:
            g = np.sort(gram[a : b - width + 1])
            out.append(g[np.concatenate([[True], g[1:] != g[:-1]])] if len(g) > 1 else g)
        elif b > a:
            one = np.uint64(b - a)
            for k in range(b - a):
                one = np.uint64((int(one) + int(h[a + k]) * (int(_GOLD) * (2 * k + 1) & _MASK)) & _MASK)
            out.append(mix(np.array([one], np.uint64)))
        else:
            out.append(none)
    return out
