"""Words and word shingles of many texts at once, as 64-bit numbers in numpy arrays.

A word is a run of ASCII letters, digits and bytes of non-ASCII characters, in lower case (ASCII and Latin-1 letters);
everything else separates words. Texts are handled whole, in slices of half a megabyte, so memory follows the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19
SHINGLE = 5
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_byte = np.arange(256)
_WORD = ((_byte >= 48) & (_byte <= 57)) | ((_byte >= 65) & (_byte <= 90)) | ((_byte >= 97) & (_byte <= 122)) | (_byte >= 128)
_LOWER = (_byte + 32 * ((_byte >= 65) & (_byte <= 90))).astype(np.uint8)
_STEPS = np.array([pow(0xD6E8FEB86659FD93, k + 1, 1 << 64) for k in range(64)], dtype=_U)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on all bits (the finaliser of splitmix64)."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1), kept and grown as needed."""
    if base not in _powers or len(_powers[base]) < n:
        p = np.full(max(n, 2 * SLICE_BYTES), base, dtype=_U)
        p[0] = 1
        _powers[base] = np.cumprod(p)
    return _powers[base][:n]


def byte_slices(column: pa.Array) -> Iterator[tuple[int, int, list[bytes]]]:
    """Ranges of about SLICE_BYTES of a column of texts, with their UTF-8 bytes (null: empty); only one slice is held as objects."""
    raw = column.cast(pa.binary())
    size = pc.fill_null(pc.binary_length(raw), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total, at = np.cumsum(size), 0
    while at < len(raw):
        end = max(at + 1, int(np.searchsorted(total, total[at] - size[at] + SLICE_BYTES, side="right")))
        yield at, end, [t or b"" for t in raw.slice(at, end - at).to_pylist()]
        at = end


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all words of texts, in order: hash, index of the text, start and end byte in that text."""
    sizes = np.array([len(t) + 1 for t in texts])
    first = np.cumsum(sizes) - sizes
    raw = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    low = _LOWER[raw]
    low[1:] += ((raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)).astype(np.uint8) * np.uint8(32)
    inside = np.zeros(len(raw) + 1, dtype=np.int8)
    inside[1:] = _WORD[raw]
    edge = np.flatnonzero(np.diff(inside))
    start, end = edge[0::2], edge[1::2]
    total = np.zeros(len(raw) + 1, dtype=_U)
    np.cumsum((low.astype(_U) + _U(1)) * _power(_BASE, len(raw)), out=total[1:])
    h = mix((total[end] - total[start]) * _power(_INVERSE, len(raw))[start])
    text = np.searchsorted(first, start, side="right") - 1
    return h, text, start - first[text], end - first[text]


def shingles(h: np.ndarray, group: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hash and group of every run of `size` words within a group; a group of fewer words gives one shingle of them all.

    The shingle with index i of the first len(h) - size + 1 candidates starts at word i. group is ascending.
    """
    n = max(0, len(h) - size + 1)
    out = np.zeros(n, dtype=_U)
    for k in range(size):
        out += h[k : k + n] * _STEPS[k]
    whole = group[:n] == group[size - 1 :] if n else np.zeros(0, bool)
    out, of = mix(out[whole]), group[:n][whole]
    begin = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, int)
    count = np.diff(np.r_[begin, len(group)])
    short = np.flatnonzero(count < size)
    if len(short):
        extra = np.zeros(len(short), dtype=_U)
        for k in range(size - 1):
            has = count[short] > k
            extra[has] += h[begin[short][has] + k] * _STEPS[k]
        out, of = np.r_[out, mix(extra)], np.r_[of, group[begin[short]]]
        order = np.argsort(of, kind="stable")
        out, of = out[order], of[order]
    return out, of


def distinct(x: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values of each group, sorted within it: value, group, how often, index of one of them in the input."""
    order = np.lexsort((x, group))
    x, group = x[order], group[order]
    new = np.r_[True, (x[1:] != x[:-1]) | (group[1:] != group[:-1])] if len(x) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    return x[at], group[at], np.diff(np.r_[at, len(x)]), order[at]


def bounds(group: np.ndarray, n: int) -> np.ndarray:
    """Where each of the groups 0..n begins in an ascending array."""
    return np.searchsorted(group, np.arange(n + 1))
