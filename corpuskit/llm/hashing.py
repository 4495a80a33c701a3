"""Hashes of many short words at once: XXH3 with 64 bits, the values of ``xxhash.xxh3_64_intdigest``."""

from __future__ import annotations

import numpy as np
import xxhash

# The start of XXH3's secret.
_SECRET = np.frombuffer(bytes.fromhex(
    "b8fe6c3923a44bbe7c01812cf721ad1cded46de9839097db7240a4a4b7b3671f"
    "cb79e64eccc0e578825ad07dccff7221b8084674f743248e"), "<u8").astype(np.uint64)
_LOW = np.uint64(0xFFFFFFFF)
_EMPTY = np.uint64(0x2D06800538D394C2)
BLANK, LINE_FEED = 32, 10


def _u(x: int) -> np.uint64:
    return np.uint64(x)


def _fold(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The two halves of the 128-bit product, one over the other."""
    low, mid, other = (a & _LOW) * (b & _LOW), (a >> _u(32)) * (b & _LOW), (a & _LOW) * (b >> _u(32))
    cross = (low >> _u(32)) + (mid & _LOW) + other
    return (a * b) ^ ((a >> _u(32)) * (b >> _u(32)) + (mid >> _u(32)) + (cross >> _u(32)))


def part_hashes(raw: bytes) -> np.ndarray:
    """The hash of each part of ``raw`` between blanks and line feeds, empty parts among them."""
    data = np.frombuffer(raw + bytes(8), np.uint8)
    at = np.flatnonzero((data[:len(raw)] == BLANK) | (data[:len(raw)] == LINE_FEED))
    start, end = np.r_[0, at + 1], np.r_[at, len(raw)]
    size = end - start
    # Eight bytes from any place on.
    eight = np.ndarray((len(raw) + 1,), "<u8", data, 0, (1,))
    out = np.full(len(size), _EMPTY, np.uint64)

    few = np.flatnonzero((size >= 1) & (size <= 3))
    s, n = start[few], size[few]
    h = (data[s].astype(np.uint64) << _u(16)) | (data[s + (n >> 1)].astype(np.uint64) << _u(24))
    h |= data[end[few] - 1].astype(np.uint64) | (n.astype(np.uint64) << _u(8))
    h ^= (_SECRET[0] & _LOW) ^ (_SECRET[0] >> _u(32))
    h = (h ^ (h >> _u(33))) * _u(0xC2B2AE3D27D4EB4F)
    h = (h ^ (h >> _u(29))) * _u(0x165667B19E3779F9)
    out[few] = h ^ (h >> _u(32))

    some = np.flatnonzero((size >= 4) & (size <= 8))
    h = ((eight[end[some] - 4] & _LOW) + ((eight[start[some]] & _LOW) << _u(32))) ^ (_SECRET[1] ^ _SECRET[2])
    h ^= ((h << _u(49)) | (h >> _u(15))) ^ ((h << _u(24)) | (h >> _u(40)))
    h *= _u(0x9FB21C651E98DF25)
    h = (h ^ ((h >> _u(35)) + size[some].astype(np.uint64))) * _u(0x9FB21C651E98DF25)
    out[some] = h ^ (h >> _u(28))

    more = np.flatnonzero((size >= 9) & (size <= 16))
    a = eight[start[more]] ^ (_SECRET[3] ^ _SECRET[4])
    b = eight[end[more] - 8] ^ (_SECRET[5] ^ _SECRET[6])
    h = size[more].astype(np.uint64) + a.byteswap() + b + _fold(a, b)
    h = (h ^ (h >> _u(37))) * _u(0x165667919E3779F9)
    out[more] = h ^ (h >> _u(32))

    for i in np.flatnonzero(size > 16):
        out[i] = xxhash.xxh3_64_intdigest(raw[start[i]:end[i]])
    return out
