"""Vectorised word and shingle hashing over Arrow string buffers.

Words are maximal runs of bytes other than space and \\x09-\\x0D; those separators are ASCII, so the split is the
same on UTF-8 bytes as on code points.  A-Z are folded to lower case first.  Every word gets a 64-bit polynomial
hash (random odd base, random value per byte, arithmetic modulo 2**64) computed with one running sum per chunk,
and every shingle a mixed 64-bit linear combination of its words' hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(0x5EED_2024)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_RAW = _BYTE.copy()
_BYTE[65:91] = _BYTE[97:123]  # A-Z hash as a-z
_BASE = 0x9E37_79B9_7F4A_7C15
_BASE_INV = pow(_BASE, -1, 2**64)
_COEF = _RNG.integers(1, 2**63, 32, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True

_pow = np.ones(1, dtype=np.uint64)
_inv = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the base and of its inverse; kept between calls and grown when a longer text comes."""
    global _pow, _inv
    if len(_pow) < n:
        m = max(n, 1 << 16)
        for name, base in (("_pow", _BASE), ("_inv", _BASE_INV)):
            x = np.full(m, base, dtype=np.uint64)
            x[0] = 1
            globals()[name] = np.multiply.accumulate(x)
    return _pow[:n], _inv[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, in place where it can be."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58_476D_1CE4_E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D0_49BB_1331_11EB)
    x ^= x >> np.uint64(31)
    return x


def utf8_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and its n + 1 offsets into them; nulls have no bytes."""
    if pa.types.is_string(column.type):
        kind = np.int32
    else:
        column, kind = column.cast(pa.large_string()), np.int64
    if column.null_count:
        column = column.fill_null("")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=kind, count=len(column) + 1 + column.offset)[column.offset :].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, size: int = 1 << 20, rows: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of at most `rows` rows and about `size` bytes each; a longer text stands alone."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, side="right")) - 1)
        b = min(b, n, a + rows)
        yield a, b
        a = b


def byte_sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums s, and powers p of the inverse base: (s[b] - s[a]) * p[a] is the hash of the bytes a..b, case kept."""
    return _sums(data, _RAW)


def folded_sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """byte_sums() with A-Z as a-z."""
    return _sums(data, _BYTE)


def _sums(data: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    power, inverse = _powers(len(data) + 1)
    sums = np.empty(len(data) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(values[data] * power[:-1], out=sums[1:])
    return sums, inverse


def word_hashes(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word of the texts data[offsets[i]:offsets[i+1]], its start and end byte, and for each text the index of its first word (n + 1 values)."""
    gap = space[data]
    first = np.empty(len(data), dtype=bool)
    if len(data):
        np.greater(gap[:-1], gap[1:], out=first[1:])
        first[0] = not gap[0]
    inner = offsets[:-1][offsets[:-1] < len(data)]
    first[inner] = ~gap[inner]
    starts = np.flatnonzero(first)
    last = np.empty(len(data), dtype=bool)
    if len(data):
        np.less(gap[:-1], gap[1:], out=last[:-1])
        last[-1] = not gap[-1]
    ends_at = offsets[1:][offsets[1:] > 0] - 1
    last[ends_at] = ~gap[ends_at]
    ends = np.flatnonzero(last) + 1
    sums, inverse = folded_sums(data)
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    return hashes, starts, ends, np.searchsorted(starts, offsets)


def shingle_sets(column: pa.Array, width: int = 5) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For chunks of rows a..b: a, b, the rows' sorted distinct shingle hashes on end, and b - a + 1 offsets into them.

    A text with fewer than `width` words, but not none, has its whole sequence as its only shingle."""
    data, offsets = utf8_parts(column)
    for a, b in chunks(offsets):
        own = offsets[a : b + 1] - offsets[a]
        words, _, _, begin = word_hashes(data[offsets[a] : offsets[b]], own)
        counts = np.diff(begin)
        long = np.maximum(counts - width + 1, 0)
        n = np.where(counts > 0, np.maximum(long, 1), 0)
        at = np.concatenate(([0], np.cumsum(n)))
        flat = np.empty(at[-1], dtype=np.uint64)
        m = len(words) - width + 1
        if m > 0:
            grams = words[:m] * _COEF[0]
            for k in range(1, width):
                grams += words[k : k + m] * _COEF[k]
            is_in = np.zeros(len(words) + 1, dtype=np.int32)
            np.add.at(is_in, begin[:-1][long > 0], 1)
            np.add.at(is_in, (begin[:-1] + long)[long > 0], -1)
            keep = np.cumsum(is_in[:m]) > 0
            flat[np.repeat(long > 0, n)] = mix(grams)[keep[:m]]
        for i in np.flatnonzero((counts > 0) & (long == 0)):
            w = words[begin[i] : begin[i + 1]]
            flat[at[i]] = mix((w * _COEF[8 : 8 + len(w)]).sum(dtype=np.uint64)[None] + np.uint64(len(w)))[0]
        for i in range(b - a):
            flat[at[i] : at[i + 1]].sort()
        new = np.ones(len(flat), dtype=bool)
        new[1:] = flat[1:] != flat[:-1]
        new[at[:-1][n > 0]] = True
        kept = np.concatenate(([0], np.cumsum(new)))
        yield a, b, flat[new], kept[at]
