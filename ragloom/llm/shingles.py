"""Word shingles of texts as sets of 64-bit hashes, for whole batches at once.

A-Z is lower-cased, words are runs of ``[^\\x20\\x09-\\x0D]+``. A set holds the distinct
shingles of ``k`` consecutive words; a text of fewer words has its whole sequence
as its one shingle, a text without words the empty set.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from ragloom.llm.common import LOWER, SPACES, byte_view, mix, pieces

_SPACE = np.array([b in SPACES for b in range(256)])
#: A 64-bit value per lower-cased byte, and the odd base of the rolling hash.
_BYTE = mix(np.frombuffer(LOWER, np.uint8).astype(np.uint64) + np.uint64(0x51ED270B))
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)


@lru_cache(2)
def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of the words in a run of bytes."""
    inside = np.concatenate([[False], ~_SPACE[data], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[::2], edge[1::2]
    room = 1 << max(16, int(len(data)).bit_length())
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * _powers(room, _BASE)[: len(data)])])
    return starts, ends, mix((total[ends] - total[starts]) * _powers(room, _INVERSE)[starts])


def hashed(values: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For pieces of a batch: first text, last text, the words of each text, all word hashes."""
    data, offsets = byte_view(values)
    for lo, hi in pieces(offsets):
        # a space between texts, so that no word runs on
        bounds = offsets[lo : hi + 1] - offsets[lo]
        part = np.insert(data[offsets[lo] : offsets[hi]], bounds[1:-1], 32)
        starts, _, word = words(part)
        at = bounds[:-1] + np.arange(hi - lo)
        yield lo, hi, np.diff(np.append(np.searchsorted(starts, at), len(starts))), word


def shingles(word: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the shingles of one text in order."""
    n = len(word)
    if not n:
        return word
    many = min(n, k)
    total = np.full(n - many + 1, many, np.uint64)
    for i in range(many):
        total = total * np.uint64(0x9FB21C651E98DF25) + word[i : n - many + 1 + i]
    return mix(total)


def sets(values: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct shingles of every text of a batch."""
    out: list[np.ndarray] = []
    for _, _, sizes, word in hashed(values, k):
        ends = np.cumsum(sizes)
        out += [np.unique(shingles(word[e - n : e], k)) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
    return out
