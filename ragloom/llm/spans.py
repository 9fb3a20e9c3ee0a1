"""Words of a batch of texts as one Arrow array, cut without a Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from ragloom.llm.common import LOWER, PIECE_BYTES, byte_view, mix, pieces

_LOWER = np.frombuffer(LOWER, np.uint8)
_BYTE = mix(np.arange(256, dtype=np.uint64) + np.uint64(0x2545F491))
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """Which bytes lie in one of the ranges, ends included."""
    out = np.zeros(256, bool)
    for lo, hi in ranges:
        out[lo : hi + 1] = True
    return out


#: Letters, digits and all bytes of non-ASCII characters: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` after lower-casing A-Z.
WORD = byte_set((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
#: Letters and all bytes of non-ASCII characters: ``[^\x00-\x40\x5B-\x60\x7B-\x7F]``.
LETTER = byte_set((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
#: All but 0x20 and 0x09-0x0D.
SOLID = ~byte_set((0x20, 0x20), (0x09, 0x0D))


@dataclass(frozen=True)
class Words:
    """The words of texts ``lo`` to before ``hi`` of a batch, a space behind each word."""

    lo: int
    hi: int
    data: np.ndarray  # bytes of all words
    starts: np.ndarray  # of each word
    lengths: np.ndarray
    text: np.ndarray  # of each word, counted from ``lo``

    def __len__(self) -> int:
        return len(self.starts)

    def array(self, chosen: np.ndarray | None = None, limit: int | None = None) -> pa.Array:
        """The first ``limit`` bytes of the chosen words."""
        starts, lengths = (self.starts, self.lengths) if chosen is None else (self.starts[chosen], self.lengths[chosen])
        if limit is not None:
            lengths = np.minimum(lengths, limit)
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        kind = np.int32 if len(self.data) < 1 << 31 and offsets[-1] < 1 << 31 else np.int64
        at = np.repeat((starts - offsets[:-1]).astype(kind), lengths)
        at += np.arange(offsets[-1], dtype=kind)
        return binary_array(self.data[at], offsets)


def binary_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(
        pa.large_binary(), len(offsets) - 1,
        [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))],
    )


def batch_words(values: pa.Array, inside: np.ndarray, lower: bool = True, limit: int = PIECE_BYTES) -> Iterator[Words]:
    """The words, runs of ``inside`` bytes, of every text of a binary array; null has none."""
    data, offsets = byte_view(values)
    for lo, hi in pieces(offsets, limit):
        bounds = offsets[lo : hi + 1] - offsets[lo]
        # a space behind each text, so that no word runs on
        part = np.insert(data[offsets[lo] : offsets[hi]], bounds[1:], 32)
        if lower:
            part = _LOWER[part]
        edge = np.concatenate([[False], inside[part]])
        edge = np.flatnonzero(edge[1:] != edge[:-1])
        starts, ends = edge[::2], edge[1::2]
        text = np.repeat(np.arange(hi - lo), np.diff(np.searchsorted(starts, bounds[1:] + np.arange(hi - lo)), prepend=0))
        part[ends] = 32
        yield Words(lo, hi, part, starts, ends - starts, text)


def joined(words: Words) -> Words:
    """The same words with one space between neighbours, whatever stood there."""
    ends = np.cumsum(words.lengths + 1)
    starts = ends - words.lengths - 1
    at = np.repeat(words.starts - starts, words.lengths + 1) + np.arange(ends[-1] if len(ends) else 0)
    return Words(words.lo, words.hi, words.data[at], starts, words.lengths, words.text)


def hashes(values: pa.Array) -> np.ndarray:
    """A 64-bit hash of each value of a binary array."""
    data, offsets = byte_view(values)
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    power, inverse = (np.full(len(data) + 1, b, np.uint64) for b in (_BASE, _INVERSE))
    power[0] = inverse[0] = 1
    power, inverse = np.multiply.accumulate(power), np.multiply.accumulate(inverse)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((_BYTE[data] + np.uint64(1)) * power[:-1])])
    return mix((total[offsets[1:]] - total[offsets[:-1]]) * inverse[offsets[:-1]] + np.diff(offsets).astype(np.uint64))


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_CRC = _crc_table()


def crc32(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, step_bytes: int = 64) -> np.ndarray:
    """crc32 of each span of ``data``: byte after byte for all spans at once, long spans one by one."""
    import zlib

    out = np.zeros(len(starts), np.uint32)
    for i in np.flatnonzero(lengths > step_bytes).tolist():
        out[i] = zlib.crc32(data[starts[i] : starts[i] + lengths[i]])
    short = np.flatnonzero(lengths <= step_bytes)
    short = short[np.argsort(lengths[short].astype(np.uint8), kind="stable")[::-1]]
    at, size = starts[short], lengths[short]
    value = np.full(len(short), 0xFFFFFFFF, np.uint32)
    for j in range(int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -j))  # spans of more than j bytes
        value[:n] = _CRC[(value[:n] ^ data[at[:n] + j]) & 0xFF] ^ (value[:n] >> 8)
    out[short] = value ^ np.uint32(0xFFFFFFFF)
    return out
