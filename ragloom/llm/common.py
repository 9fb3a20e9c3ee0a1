"""Helpers of the operators on texts: byte views of Arrow batches, folds, words."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a kernel works on at once; a longer text is a piece of its own.
PIECE_BYTES = 1 << 20

#: The byte table that lower-cases A-Z and leaves all else, UTF-8 sequences included.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

#: Space characters of the word rules: 0x20 and 0x09-0x0D.
SPACES = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds)).cast("int")


def utf8(text: Column) -> Column:
    """The bytes of a text as stored, valid UTF-8 or not; null counts as empty."""
    return F.coalesce(text.cast("binary"), F.lit(b""))


def byte_view(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary array and the offsets of its values; null is empty."""
    if values.null_count:
        values = values.fill_null(b"")
    values = values.cast(pa.large_binary())
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    held = values.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    return data, offsets


def pieces(offsets: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about ``limit`` bytes, one text at least."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def give_back() -> None:
    """Return memory that this process holds but no longer uses to the machine; a worker lives on behind its task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


#: Caches that worker processes keep from task to task; functions decorated by ``lru_cache``.
KEPT: list = []


def kept(cache):
    """Registers a cache that tasks of other operators empty."""
    KEPT.append(cache)
    return cache


def forget(keeps: tuple = ()) -> None:
    for cache in KEPT:
        if cache not in keeps:
            cache.cache_clear()


def tidied(run: Callable[[Iterator], Iterator], keeps: tuple = ()) -> Callable[[Iterator], Iterator]:
    """The same function over batches for a task that needs none of the kept caches but ``keeps``:
    it empties the others at its start and gives its memory back at its end."""

    def tidy(batches: Iterator) -> Iterator:
        forget(keeps)
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidy


def tidied_group(run: Callable) -> Callable:
    """The same function over the rows of a group, giving its memory back behind each group."""

    def tidy(group: pa.Table) -> pa.Table:
        try:
            return run(group)
        finally:
            give_back()

    return tidy
