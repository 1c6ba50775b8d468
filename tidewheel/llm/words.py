"""Words of whole text columns as arrays: bounds, owners and 64-bit hashes, without a Python step for each word."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The white space of the contracts is \x20 and \x09-\x0D; A-Z become a-z.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Words longer than this are hashed one by one; shorter ones by differences of running sums over a segment.
LONG = 64
SEGMENT = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(SEGMENT + LONG, _BASE))])
_INVERSES = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(SEGMENT + LONG, _INVERSE))])
_LETTERS = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows one after the other, and the offsets of the rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays([c.cast(pa.large_string()) for c in column.chunks]) if column.num_chunks else pa.array([], pa.large_string())
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows of about ``most`` bytes of text, so that arrays over a run stay small."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), np.int64)
    part = np.cumsum(sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def word_hashes(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all rows in order, and the number of words of each row. ``breaks``: bytes between words."""
    inside = ~breaks[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    hashes = np.empty(len(starts), np.uint64)
    low = LOWER[data]
    a = 0
    while a < len(starts):
        at = starts[a]
        b = max(a + 1, int(np.searchsorted(ends, at + SEGMENT, "right")))
        part = low[at : min(ends[b - 1], at + SEGMENT)]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_LETTERS[part] * _POWERS[: len(part)], out=sums[1:])
        s, e = starts[a:b] - at, np.minimum(ends[a:b] - at, len(part))
        hashes[a:b] = mix((sums[e] - sums[s]) * _INVERSES[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        a = b
    for i in np.flatnonzero(ends - starts > LONG):
        hashes[i] = int.from_bytes(hashlib.blake2b(low[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return hashes, counts


def shingle_sets(hashes: np.ndarray, counts: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row; with fewer words than ``width`` the whole sequence is one."""
    n = len(hashes)
    rolled = np.zeros(max(0, n - width + 1), np.uint64)
    for j in range(width):
        rolled = mix(rolled + hashes[j : n - width + 1 + j]) if n >= width else rolled
    ends = np.cumsum(counts)
    out = []
    for end, count in zip(ends.tolist(), counts.tolist(), strict=True):
        if count >= width:
            out.append(np.unique(rolled[end - count : end - width + 1]))
        elif count:
            h = np.full(1, count, np.uint64)
            for x in hashes[end - count : end]:
                h = mix(h + x)
            out.append(mix(h + np.uint64(0x5851F42D4C957F2D)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
