"""Whole-column hashing of words, lines and word n-grams, without a Python object per word.

A word is a maximal run of bytes other than ``[\\x20\\x09-\\x0D]``. UTF-8 never has
those bytes inside another character, so bytes and code points agree on words.
The hash of a byte run is ``sum(T[b_i] * B**i) mod 2**64``, taken from prefix sums,
then mixed. Equal runs have equal hashes; different ones share a 64-bit hash with
a chance of about 2**-60 a pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
BLOCK = 1 << 18
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


with np.errstate(over="ignore"):
    TABLE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
    BASE = U(0xD1342543DE82EF95)
    _INV = U(pow(int(BASE), -1, 1 << 64))
    POWER = np.cumprod(np.concatenate([np.ones(1, U), np.full(BLOCK, BASE, U)]))
    INVERSE = np.cumprod(np.concatenate([np.ones(1, U), np.full(BLOCK, _INV, U)]))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null counts as empty."""
    column = column.fill_null("") if column.null_count else column
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(outside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs where ``outside`` is false, cut at row offsets."""
    inside = ~outside
    first, last = inside.copy(), inside.copy()
    first[1:] &= outside[:-1]
    last[:-1] &= outside[1:]
    at = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[at] = inside[at]
    at = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    last[at] = inside[at]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends, in bytes, of all words."""
    return runs(SPACE[data], offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte run; runs are in order and don't overlap."""
    out = np.empty(len(starts), U)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(starts):
            j = int(np.searchsorted(ends, starts[i] + BLOCK, "right"))
            if j <= i:  # a run longer than a block: by pieces
                h = U(0)
                for a in range(int(starts[i]), int(ends[i]), BLOCK):
                    part = TABLE[data[a : min(a + BLOCK, int(ends[i]))]]
                    h = mix(h + (part * POWER[: len(part)]).sum(dtype=U))
                out[i] = mix(h + U(ends[i] - starts[i]))
                i += 1
                continue
            a, b = int(starts[i]), int(ends[j - 1])
            sums = np.zeros(b - a + 1, U)
            np.cumsum(TABLE[data[a:b]] * POWER[: b - a], out=sums[1:])
            s, e = starts[i:j] - a, ends[i:j] - a
            out[i:j] = mix((sums[e] - sums[s]) * INVERSE[s] + (e - s).astype(U))
            i = j
    return out


def per_row(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each row, the index of its first run; one more entry at the end."""
    return np.searchsorted(starts, offsets, "left")


_STEP = U(0x9FB21C651E98DF25)


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every ``n`` consecutive hashes (rows aren't respected: drop windows that cross them)."""
    if len(h) < n:
        return np.zeros(0, U)
    with np.errstate(over="ignore"):
        out, have, width, power, step = None, 0, 1, h, _STEP
        left = n
        while left:
            if left & 1:
                take = power[have:]
                scale = U(pow(int(_STEP), have, 1 << 64))
                out = take * scale if out is None else out[: len(take)] + take * scale
                have += width
            left >>= 1
            if left:
                power = power[:-width] + power[width:] * step if len(power) > width else power[:0]
                step = step * step
                width *= 2
        return mix(out[: len(h) - n + 1] + U(n))


def windows(first: np.ndarray, n: int) -> np.ndarray:
    """Starts of all windows of ``n`` words that lie in one row; ``first`` is from per_row."""
    counts = np.maximum(np.diff(first) - n + 1, 0)
    total = int(counts.sum())
    base = np.repeat(first[:-1] - (np.cumsum(counts) - counts), counts)
    return base + np.arange(total)


def slices(column: pa.Array, most: int = 1 << 18):
    """Row ranges of about ``most`` bytes of text each, so that scratch arrays stay small."""
    _, offsets = utf8(column)
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        j = min(j, n)
        yield i, j
        i = j
