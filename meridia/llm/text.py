"""Byte-level text kernels shared by the operators: words, lines and shingles as numpy hashes.

Everything works on the UTF-8 buffer of an Arrow string array, so a batch of whole texts is
hashed with a handful of vector operations and no Python loop over words. Buffers are cut at
white space into bounded chunks: memory does not grow with the length of a text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
_RNG = np.random.default_rng(20240229)
#: A random 64-bit value for each byte; A-Z share the values of a-z in FOLDED.
BYTES = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FOLDED = BYTES.copy()
FOLDED[65:91] = BYTES[97:123]
_P = 0x9E3779B97F4A7C55
_POW: list[np.ndarray] = []
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, for n positions at least."""
    if not _POW or len(_POW[0]) < n:
        size = max(n, CHUNK + 4096)
        inv = pow(_P, -1, 2**64)
        for base in (_P, inv):
            p = np.empty(size, np.uint64)
            p[0] = 1
            p[1:] = np.uint64(base)
            _POW.append(np.multiply.accumulate(p))
        _POW[:] = _POW[-2:]
    return _POW[0], _POW[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Avalanche the bits of 64-bit hashes (the finaliser of MurmurHash3)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def buffer(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its n + 1 offsets; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        col = pa.concat_arrays(col.chunks) if isinstance(col, pa.ChunkedArray) else col
    col = col.cast(pa.large_string()).fill_null("")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes outside gap; a run never crosses a text's end."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~gap[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = BYTES) -> np.ndarray:
    """A 64-bit hash of data[start:end] for sorted, non-overlapping spans."""
    out = np.zeros(len(starts), np.uint64)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(starts):
            base = starts[i]
            j = max(i + 1, int(np.searchsorted(ends, base + CHUNK, "right")))
            stop = ends[j - 1]
            up, down = _powers(int(stop - base) + 1)
            sums = np.zeros(stop - base + 1, np.uint64)
            np.cumsum(table[data[base:stop]] * up[: stop - base], out=sums[1:])
            s, e = starts[i:j] - base, ends[i:j] - base
            out[i:j] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
            i = j
    return out


def words(col: pa.Array, folded: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the white-space separated words (A-Z lowered if folded) and n + 1 bounds by text."""
    data, offsets = buffer(col)
    starts, ends = spans(data, offsets)
    return hash_spans(data, starts, ends, FOLDED if folded else BYTES), np.searchsorted(starts, offsets)


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values; numpy's own unique hashes first, which is slower here."""
    if len(values) < 2:
        return values
    ordered = np.sort(values)
    return ordered[np.append(True, ordered[1:] != ordered[:-1])]


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k successive words of one text; with fewer words, of the whole sequence."""
    if not len(hashes):
        return hashes
    k = min(k, len(hashes))
    with np.errstate(over="ignore"):
        out = np.zeros(len(hashes) - k + 1, np.uint64)
        for i in range(k):
            out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[i : len(hashes) - k + 1 + i]
        return mix(out + np.uint64(k))
