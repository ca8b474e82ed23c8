"""Words of whole Arrow string columns as numpy arrays: no Python object per word.

Bytes of many texts are classed and hashed together. Work goes through
segments of about a megabyte, cut between words, so temporary arrays stay
small however long a text is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 20
_POSITIONS = 1024


def _random_odd(seed: int, n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_BYTE, _PLACE = _random_odd(11, 256), _random_odd(12, _POSITIONS)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_classes(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a:b + 1] = True
    return out


#: ASCII letters and digits, and every byte of a character beyond ASCII.
LETTERS = byte_classes((48, 57), (65, 90), (97, 122), (128, 255))
#: Everything but ASCII white space.
VISIBLE = ~byte_classes((9, 13), (32, 32))


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column without nulls."""
    if pa.types.is_large_string(col.type):
        col = col.cast(pa.string())
    raw = col.buffers()
    offsets = np.frombuffer(raw[1], np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    return np.frombuffer(raw[2], np.uint8) if raw[2] is not None else np.zeros(0, np.uint8), offsets


def segments(data: np.ndarray, offsets: np.ndarray, inner: np.ndarray) -> Iterator[tuple[int, int]]:
    """Spans of about SEGMENT bytes that end after a byte outside ``inner``, or at the end."""
    lo, end = int(offsets[0]), int(offsets[-1])
    while lo < end:
        hi = min(lo + SEGMENT, end)
        while hi < end:
            cut = np.flatnonzero(~inner[data[max(lo, hi - 4096):hi]])
            if len(cut):
                hi = max(lo, hi - 4096) + int(cut[-1]) + 1
                break
            hi = min(hi + 4096, end)
        yield lo, hi
        lo = hi


def hash_runs(seg: np.ndarray, starts: np.ndarray, member: np.ndarray) -> np.ndarray:
    """64-bit hash of each run of ``member`` bytes of ``seg``; starts: where runs begin."""
    idx = np.flatnonzero(member)
    if not len(idx):
        return np.zeros(0, np.uint64)
    first = np.searchsorted(idx, starts)
    place = idx - np.repeat(starts, np.diff(np.append(first, len(idx))))
    return mix(np.add.reduceat(_BYTE[seg[idx]] * _PLACE[place & (_POSITIONS - 1)] + (place >> 10).astype(np.uint64), first))


def word_hashes(col: pa.Array, inner: np.ndarray = LETTERS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs of ``inner`` bytes) of a column, and the word offsets of its texts."""
    data, offsets = buffers(col)
    hashes, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for lo, hi in segments(data, offsets, inner):
        seg = data[lo:hi]
        member = inner[seg]
        first = member.copy()
        first[1:] &= ~member[:-1]
        begin = offsets[np.searchsorted(offsets, lo):np.searchsorted(offsets, hi)] - lo
        first[begin] = member[begin]
        starts = np.flatnonzero(first)
        hashes.append(hash_runs(seg, starts, member))
        places.append(starts + lo)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(places), offsets)


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive words."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k, factor in enumerate(_random_odd(100 + size, size)):
        out += hashes[k:k + n] * factor
    return mix(out)
